"""Texts are analysed once for a search, and what a search doesn't need stays out of it."""

import pytest
from pyspark.sql import functions as F

from termfall import Analyzer, build, search
from termfall import queries as retrieval
from termfall.operators import mutate
from termfall.operators import search as ops
from termfall.sources import storage

from .conftest import SF
from .test_batch import PLAIN, found, frame, plan, texts

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def seen_by(spark, docs):
    """docs, and how many of its texts are read."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    return docs.withColumn("text", counted.asNondeterministic()("text")), seen


@pytest.mark.parametrize("analyzer", [PLAIN, Analyzer()])
def test_a_search_analyses_each_text_once(spark, analyzer):
    plain = frame(spark, texts(60, 3), "doc_id bigint, text string")
    docs, seen = seen_by(spark, plain)
    queries = frame(spark, ["w1 common W1", "w2 w30", "", "unknown"], "query_id int, query string")
    index = ops.indexed(docs, queries, analyzer)
    got = found(search(index, queries, 7))
    assert seen.value == 60
    assert got == found(search(build(plain, analyzer), queries, 7))
    assert index.totals.first() == build(plain, analyzer).totals.first()
    assert {r.term for r in index.terms.collect()} <= {"w1", "common", "w2", "w30", "unknown"}
    with pytest.raises(ValueError, match="some terms only"):
        storage.save(index, "/nowhere")


def test_many_terms_are_not_told_to_the_analysis(spark, monkeypatch):
    monkeypatch.setattr(ops, "MOST_TERMS", 2)
    plain = frame(spark, texts(30, 4), "doc_id bigint, text string")
    queries = frame(spark, ["w1 w2 w3"], "query_id int, query string")
    index = ops.indexed(plain, queries, PLAIN)
    assert not index.partial
    assert found(search(index, queries, 7)) == found(search(build(plain, PLAIN), queries, 7))


def test_scoring_analyses_each_text_once(spark):
    docs, seen = seen_by(spark, frame(spark, texts(40, 5), "doc_id bigint, text string"))
    queries = frame(spark, ["w1 common"], "query_id int, query string")
    got = ops.score(queries, docs.select(F.lit(0).alias("query_id"), "doc_id", "text"), build(docs.limit(0), PLAIN)).select("score").collect()
    assert len(got) == 40
    # Once for the scores; the last join reads the ids alone.
    assert seen.value == 40


@pytest.mark.parametrize("name", ["search_lucene", "search_parameters", "search_lang_filter", "query_analysis", "add_then_search", "delete_compact", "update_then_search", "score_batch"])
def test_registered_searches_read_analysed_rows(spark, name):
    text = plan(retrieval.QUERIES[name](spark, SF))
    assert text.count("ArrowEvalPython") <= (name in ("add_then_search", "update_then_search")) * 4
    assert "documents.parquet" not in text.replace("score_batch", "") or name in ("search_lang_filter", "score_batch", "update_then_search")


def test_point_lookups_leave_other_terms_out(spark):
    index = build(frame(spark, ["a a b", "b"], "doc_id bigint, text string"), PLAIN, only=["a"])
    assert [tuple(r) for r in index.postings.collect()] == [("a", 0, 2, 3)]
    assert sorted(map(tuple, index.docs.collect())) == [(0, 3), (1, 1)]


def test_workers_get_batches_of_bounded_bytes(spark):
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, str(256 << 20))
        build(frame(spark, ["a"], "doc_id bigint, text string"), PLAIN)
        assert int(spark.conf.get(BATCH)) <= 4 << 20
    finally:
        spark.conf.set(BATCH, before)


def test_ids_are_shifted_by_document(spark):
    """Not by posting, and not by a look through all deleted ids of a bucket."""
    index = mutate.delete(build(frame(spark, texts(40, 6), "doc_id bigint, text string"), PLAIN), spark.createDataFrame([(3,), (9,)], "doc_id bigint"))
    text = plan(index.postings)
    # From the top: postings are made of the rows that the joins return.
    assert text.index("Generate") < text.index("Join")


def test_postings_without_documents_rows_are_shifted(spark, tmp_path):
    """A stored index, from which ids on both sides of words and buckets go."""
    rows = [f"w{i}" for i in range(140)]
    storage.save(build(frame(spark, rows, "doc_id bigint, text string"), PLAIN), str(tmp_path / "i"))
    gone = [0, 30, 31, 32, 33, 62, 63, 64, 127, 139]
    index = mutate.delete(storage.load(spark, str(tmp_path / "i")), spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    want = [r for i, r in enumerate(rows) if i not in gone]
    assert sorted((r.doc_id, r.term) for r in index.postings.collect()) == list(enumerate(want))
    assert sorted(r.doc_id for r in index.docs.collect()) == list(range(130))


def test_a_stored_index_is_read_by_its_queries_terms(spark, tmp_path):
    """Other postings were read and shuffled to be joined."""
    path = str(tmp_path / "i")
    storage.save(build(frame(spark, texts(60, 7), "doc_id bigint, text string"), PLAIN), path)
    queries = frame(spark, ["w1 common W1", "w2"], "query_id int, query string")
    index = storage.load(spark, path)
    got = search(index, queries, 9)
    assert "In(term, [common,w1,w2])" in plan(got)
    assert found(got) == found(search(index, queries, 9, terms=["common", "w1", "w2", "w3"]))


def test_compaction_writes_no_copy_of_the_segments(spark, tmp_path, monkeypatch):
    from termfall.sources import readers
    from termfall.streaming import ingest

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    readers.from_list(spark, ["a a b", "c", ""]).write.parquet(source)
    ingest.ingest(spark.readStream.schema("doc_id bigint, text string").parquet(source), out, str(tmp_path / "log"), PLAIN).awaitTermination()
    saved = []
    save = storage.save
    monkeypatch.setattr(ingest.storage, "save", lambda index, path: saved.append(index.forward) or save(index, path))
    stored = ingest.compact(spark, out, str(tmp_path / "stored"))
    assert saved == [None]
    assert sorted(map(tuple, stored.postings.collect())) == [("a", 0, 2, 3), ("b", 0, 1, 3), ("c", 1, 1, 1)]
    assert sorted(map(tuple, stored.docs.collect())) == [(0, 3), (1, 1), (2, 0)]
