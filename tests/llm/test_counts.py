"""The counts of op10 apart from its model."""

from termfall.llm import quality, queries

from ..conftest import SF


def test_counts_take_one_pass_and_are_those_of_op10(spark):
    got = queries.quality_counts(spark, SF)
    text = got._jdf.queryExecution().toString()
    text = text[text.index("== Physical Plan ==") :]
    # The texts are read here, and nothing is shuffled or joined: there is no model.
    assert "documents.parquet" in text
    assert "Exchange" not in text
    assert "Join" not in text
    whole = queries.op10_quality(spark, SF)
    assert got.schema.names == [c for c in whole.columns if c not in ("kept", "nll", "place")]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect()))


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "x y z " * 30)], "id string, t string")
    got = {r.id: tuple(r)[1:] for r in quality.count_quality(docs, "id", "t").collect()}
    assert got == {"a": (0, 0, 0, 0, 0, True), "b": (0, 0, 0, 0, 0, True), "c": (90, 90, 0, 0, 90, True)}
    assert quality.count_quality(docs.filter("false"), "id", "t").collect() == []
