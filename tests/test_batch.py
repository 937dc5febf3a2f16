import random

import numpy as np
import pytest

from termfall import Analyzer, Scoring, build, search
from termfall import queries as retrieval
from termfall.functions.scoring import METHODS
from termfall.operators import batch, evaluate, mutate

from .conftest import SF

PLAIN = Analyzer("plain", False)


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [None if i % 29 == 5 else " ".join(["common"] * (i % 3) + r.choices(words, weights=[1 / (j + 1) for j in range(40)], k=r.randint(0, 12))) for i in range(n)]


def frame(spark, rows, columns):
    return spark.createDataFrame(list(enumerate(rows)), columns)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("k", [1, 10, 500])
def test_many_queries_find_what_search_finds(spark, monkeypatch, k):
    """Over several packs, blocks and chunks, with ties, queries of the same terms, empty and unknown ones."""
    for name, value in (("PACK", 90), ("BLOCK", 400), ("LEAST_SETS", 20), ("STRIDES", 4)):
        monkeypatch.setattr(batch, name, value)
    index = build(frame(spark, texts(250, 1), "doc_id bigint, text string").repartition(5), PLAIN)
    queries = frame(spark, [*texts(60, 2), "w1 w2", "W2 w1 w1", "", "unknown"], "query_id int, query string")
    several = batch.search_many(index, queries, k, [Scoring(m) for m in METHODS]).cache()
    for i, m in enumerate(METHODS):
        assert found(several.filter(several.method == i)) == found(search(index.scored_by(Scoring(m)), queries, k))
    # A changed index has no rows by document.
    index = mutate.delete(index, spark.createDataFrame([(3,), (7,)], "doc_id bigint"))
    assert found(batch.search_many(index, queries, k)) == found(search(index, queries, k))


def test_many_queries_without_documents_or_hits(spark):
    queries = frame(spark, ["a", None], "query_id int, query string")
    assert found(batch.search_many(build(spark.createDataFrame([], "doc_id bigint, text string"), PLAIN), queries, 5)) == []
    index = build(frame(spark, ["b", "", None], "doc_id bigint, text string"), PLAIN)
    assert found(batch.search_many(index, queries, 5)) == []
    assert found(batch.search_many(index, queries.filter("query_id = 9"), 5)) == []
    assert found(batch.search_many(index, frame(spark, ["b"], "query_id int, query string"), 0)) == []


@pytest.mark.parametrize("method", METHODS)
def test_formulas_of_arrays_are_those_of_columns(spark, method):
    from pyspark.sql import functions as F

    scoring = Scoring(method, k1=1.2, b=0.6, delta=0.7)
    rows = [(n, df, tf, dl) for n, df in ((9, 1), (9, 9), (1000, 40)) for tf, dl in ((1, 1), (7, 30))]
    got = spark.createDataFrame(rows, "n int, df int, tf int, dl int").select(scoring.idf(F.col("n"), F.col("df")), scoring.tf(F.col("tf"), F.col("dl"), F.lit(12.5))).collect()
    for (n, df, tf, dl), (idf, share) in zip(rows, got, strict=True):
        assert np.isclose(scoring.idf_of(n, np.array([df]))[0], idf, rtol=1e-12)
        assert np.isclose(scoring.tf_of(np.array([tf]), np.array([dl]), 12.5)[0], share, rtol=1e-12)


def plan(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan ==") :]


def test_known_items_make_no_row_for_each_pair(spark):
    """Postings aren't joined with query terms: that made a row for each query and document with a common word."""
    assert "term" not in plan(retrieval.ndcg_known_item(spark, SF))


@pytest.mark.parametrize("analyzers, titles", [([PLAIN], (0,)), ([PLAIN], (0, 3)), ([PLAIN, Analyzer()], (0,))])
def test_grids_make_no_row_for_each_pair(spark, analyzers, titles):
    """By methods, by titles and by tokenizers."""
    docs, queries, qrels = retrieval._known(spark, SF)
    assert "term" not in plan(evaluate.grid(docs, queries, qrels, analyzers, [Scoring(), Scoring("bm25l")], titles))


def test_a_batch_makes_no_row_for_each_pair(spark):
    assert "term" not in plan(retrieval.search_batch(spark, SF))
