import pytest

import __spark_entry__
from termfall import queries as retrieval

from .conftest import SF, rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(retrieval.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(retrieval.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = retrieval.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in retrieval.ORACLE_SQL:
        want = duck.sql(retrieval.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, got.columns) == rows(want, want.columns)


def test_synthetic_corpus_is_as_large_as_the_references(spark):
    docs = retrieval.QUERIES["synthetic_corpus"](spark, SF).selectExpr("doc_id", "split(text, ' ') AS words")
    got = docs.selectExpr("count(DISTINCT doc_id) AS n", "min(size(words)) AS least", "max(size(words)) AS most").first()
    assert tuple(got) == (100_000, 20, 200)
    assert {x.w for x in docs.selectExpr("explode(words) AS w").distinct().collect()} == set(retrieval.SYNTHETIC_WORDS)
