"""Ranking quality and query grids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer
from ..functions.scoring import Scoring
from ..plans.index import build
from .batch import search_many


def ndcg(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): linear gains, discount log2(rank + 1), for every query with a positive judgement; 0 for what wasn't found.

    results: (query_id, rank, doc_id); qrels: (query_id, doc_id, rel).
    """
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    ideal = qrels.filter("rel > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))).filter(F.col("rank") <= k)
    best = ideal.groupBy("query_id").agg(F.sum(gain).alias("best"))
    got = results.filter(F.col("rank") <= k).join(qrels.filter("rel > 0"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain).alias("got"))
    return best.join(got, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("got"), F.lit(0.0)) / F.col("best"), 6).alias("ndcg"))


def boosted(title: Column, body: Column, times: int) -> Column:
    """A text in which the title stands so many times before the body."""
    return F.concat_ws(" ", F.array_repeat(F.coalesce(title, F.lit("")), times), F.coalesce(body, F.lit("")))


def grid(docs: DataFrame, queries: DataFrame, qrels: DataFrame, analyzers: Iterable[Analyzer], scorings: Iterable[Scoring], titles: Iterable[int] = (0,), k: int = 10) -> DataFrame:
    """(mode, method, title, ndcg): mean NDCG@k of every combination. docs: (doc_id, text) and title, if titles are boosted.

    One analysis of the documents serves all methods: only scores depend on them.
    """
    out = None
    scorings = list(scorings)
    for times in titles:
        texts = docs.withColumn("text", boosted(F.col("title"), F.col("text"), times)) if times else docs
        for analyzer in analyzers:
            results = search_many(build(texts, analyzer), queries, k, scorings)
            for i, scoring in enumerate(scorings):
                each = ndcg(results.filter(F.col("method") == i), qrels, k).agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))
                row = each.select(F.lit(analyzer.mode).alias("mode"), F.lit(scoring.method).alias("method"), F.lit(times).alias("title"), "ndcg")
                out = row if out is None else out.unionByName(row)
    return out


def latency(seconds: DataFrame) -> DataFrame:
    """(n, mean, p50, p95, p99) of a table of seconds."""
    return seconds.agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), *[F.percentile("seconds", q / 100).alias(f"p{q}") for q in (50, 95, 99)])
