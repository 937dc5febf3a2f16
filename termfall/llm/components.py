"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _round(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (a, b). The least neighbour is a partial aggregate, so a hub's links needn't meet in one task."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node that has a link in links (a, b): root is the least node that can be reached.

    Roots themselves are included. Links to itself and repeated links are harmless; no links give no rows. Each round is
    checkpointed in the shared folder. The rounds end when a large and a small star leave the links as they were, which
    takes about log n rounds.
    """
    now = checkpointed(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = _sign(now)
    for _ in range(most_rounds):
        if sign[0] == 0:
            break
        now = checkpointed(_round(_round(now, large=True), large=False))
        before, sign = sign, _sign(now)
        if sign == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
