import json

import pytest

from termfall import Analyzer, Scoring, build
from termfall.functions.analysis import MODES
from termfall.operators import evaluate
from termfall.operators import search as ops
from termfall.plans.index import Index
from termfall.sources import readers, storage
from termfall.streaming import ingest

TEXTS = ["Running cats", "the dog", "Zürich café", ""]


def relations(index: Index):
    return sorted(map(tuple, index.docs.collect())), sorted(map(tuple, index.postings.collect())), sorted(map(tuple, index.terms.collect())), tuple(index.totals.first())


@pytest.mark.parametrize("stop", [True, False])
@pytest.mark.parametrize("mode", MODES)
def test_stored_and_loaded(spark, tmp_path, mode, stop):
    index = build(readers.from_list(spark, TEXTS), Analyzer(mode, stop), Scoring("bm25l", 1.1, 0.6, 0.3))
    path = str(tmp_path / "i")
    assert not storage.exists(spark, path)
    storage.save(index, path)
    again = storage.load(spark, path, cache=stop)
    assert (again.analyzer, again.scoring) == (index.analyzer, index.scoring)
    assert relations(again) == relations(index)
    # A new version beside one that is being read.
    storage.save(build(readers.from_list(spark, TEXTS[:1]), index.analyzer, index.scoring), path)
    assert relations(again) == relations(index)
    assert len(storage.load(spark, path)) == 1


def test_stored_searches_push_terms_down(spark, tmp_path):
    path = str(tmp_path / "i")
    storage.save(build(readers.from_list(spark, TEXTS), Analyzer("plain")), path)
    df = storage.load(spark, path).postings.filter("term = 'dog'").select("doc_id")
    text = df._jdf.queryExecution().toString()
    assert "EqualTo(term,dog)" in text
    assert "ReadSchema: struct<term:string,doc_id:bigint>" in text


def test_another_version_is_refused(spark, tmp_path):
    (tmp_path / "manifest-000000000001.json").write_text(json.dumps({"version": 99}))
    with pytest.raises(ValueError, match="version 99"):
        storage.load(spark, str(tmp_path))


def test_versions_and_crashes(spark, tmp_path):
    path = str(tmp_path / "i")
    made = [build(readers.from_list(spark, TEXTS[: i + 1]), Analyzer("plain")) for i in range(4)]
    with pytest.raises(FileNotFoundError):
        storage.load(spark, path)
    for i, index in enumerate(made):
        storage.save(index, path)
        assert len(storage.load(spark, path)) == i + 1
    # The one before stays for its readers, older ones are gone.
    assert len(list(tmp_path.glob("i/v-*"))) == len(list(tmp_path.glob("i/manifest-*.json"))) == storage.KEPT
    # A writer that died left a version without a manifest, and a draft: nothing changes.
    (tmp_path / "i/v-dead").mkdir()
    (tmp_path / "i/.manifest-000000000005.json-x").write_text("{")
    assert len(storage.load(spark, path)) == 4
    assert not storage.write_text(spark, storage._manifest(path, 4), "{}")
    assert not list(tmp_path.glob("i/v-*/forward"))


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"a\r\n\nb\n")
    assert [r.text for r in readers.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["a\r", "", "b"]
    assert [tuple(r) for r in readers.from_bytes(spark, b"").collect()] == [(0, "")]
    assert [r.text for r in readers.from_bytes(spark, b"x\n").collect()] == ["x", ""]
    (tmp_path / "c.json").write_text(json.dumps(["one", "zwei\nTexte"]))
    assert [tuple(r) for r in readers.read_json_texts(spark, str(tmp_path / "c.json")).collect()] == [(0, "one"), (1, "zwei\nTexte")]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "x?"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    corpus, queries, qrels = readers.read_retrieval_set(spark, str(tmp_path))
    assert sorted(map(tuple, corpus.collect())) == [("d1", "T", "x"), ("d2", "", "y")]
    assert [tuple(r) for r in queries.collect()] == [("q1", "x?")]
    assert [tuple(r) for r in qrels.collect()] == [("q1", "d1", 2)]
    made = readers.synthetic(spark, 50, ["a", "b", "c"], 2, 5).collect()
    assert {len(r.text.split(" ")) for r in made} == {2, 3, 4, 5}
    assert made == readers.synthetic(spark, 50, ["a", "b", "c"], 2, 5).collect()


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    docs = readers.from_list(spark, TEXTS * 3)
    docs.repartition(3).write.parquet(source)
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(source)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    ingest.ingest(stream, out, log).awaitTermination()
    assert relations(ingest.segments(spark, out)) == relations(build(docs))
    # Later documents become further segments.
    readers.from_list(spark, ["later text"], 100).write.mode("append").parquet(source)
    ingest.ingest(stream, out, log).awaitTermination()
    assert len(ingest.segments(spark, out)) == 13
    stored = ingest.compact(spark, out, str(tmp_path / "stored"))
    assert relations(stored) == relations(ingest.segments(spark, out))
    # How texts were analysed is kept: another analysis is refused.
    assert ingest.segments(spark, out).analyzer == Analyzer()
    with pytest.raises(ValueError, match="stored with"):
        ingest.segments(spark, out, Analyzer("plain"))
    with pytest.raises(ValueError, match="stored with"):
        ingest.ingest(stream, out, log, Analyzer("plain"))
    # So is an id that comes again.
    readers.from_list(spark, ["other text"], 100).write.mode("append").parquet(source)
    ingest.ingest(stream, out, log).awaitTermination()
    with pytest.raises(ValueError, match="document 100 was ingested 2 times"):
        ingest.segments(spark, out)
    assert len(ingest.segments(spark, out, check=False)) == 14


def test_ndcg(spark):
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 99)], "query_id int, rank int, doc_id bigint")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 10, 0), (2, 5, 1), (3, 1, 0)], "query_id int, doc_id bigint, rel int")
    got = {r.query_id: r.ndcg for r in evaluate.ndcg(results, qrels).collect()}
    import math

    want = (2 / math.log2(3) + 1 / math.log2(4)) / (2 + 1 / math.log2(3))
    assert got == {1: round(want, 6), 2: 0.0}


def test_quality_gate(spark):
    """Known items are found in every mode: the first words of a document ask for it."""
    texts = [f"alpha{i % 7} beta{i % 5} gamma{i % 3} number{i} runs quickly" for i in range(60)]
    docs = readers.from_list(spark, texts)
    queries = spark.createDataFrame([(i, f"number{i} running gamma{i % 3}") for i in range(60)], "query_id int, query string")
    qrels = spark.createDataFrame([(i, i, 1) for i in range(60)], "query_id int, doc_id bigint, rel int")
    titled = docs.selectExpr("doc_id", "text", "'t' AS title")
    got = evaluate.grid(titled, queries, qrels, [Analyzer("plain"), Analyzer()], [Scoring("lucene"), Scoring("bm25+")], titles=(0, 2)).collect()
    assert len(got) == 8
    assert min(r.ndcg for r in got) >= 0.64


def test_title_boost_and_latency(spark):
    row = spark.range(1).select(evaluate.boosted(*_lits("a b", "c"), 3).alias("t")).first()
    assert row.t == "a b a b a b c"
    seconds = spark.createDataFrame([(float(i),) for i in range(1, 101)], "seconds double")
    assert evaluate.latency(seconds).first().p50 == 50.5


def _lits(*values):
    from pyspark.sql import functions as F

    return [F.lit(v) for v in values]


def test_point_lookup(spark):
    index = build(readers.from_list(spark, ["a a b"]), Analyzer("plain", False))
    pairs = spark.createDataFrame([("a", 0), ("z", 0)], "term string, doc_id bigint")
    assert sorted(map(tuple, ops.term_frequency(index, pairs).collect())) == [("a", 0, 2), ("z", 0, 0)]
