"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source's token share p becomes the weight p^a / sum of p^a. The exponent a is the least of [0, 1] at which the entropy of
the weights has come down to its target and no source is repeated more often than the limit; it is bisected, POINTS at a time. A weight
times the budget is a source's quota of tokens: so many whole epochs, and a rest.

Each epoch of a source is a permutation in blocks: a seeded hash of the document deals it to one of the source's blocks of about
BLOCK_TOKENS tokens and orders it inside. The rest of a quota is a prefix of one more such permutation, the longest whose
tokens stay within it. The cut is found from the blocks' token sums (partial sums before the shuffle) and from the one block that
holds it, so no task sees a whole source. Texts are never shuffled: a document's copies follow from its source's row.

Edge cases: null and empty texts have no tokens and go with their epoch; a null source is a source of its own; sources without
tokens, and all rows if there is no token at all, are kept once; rows with equal ids (repeated rows, null ids) share a place in
the order and are taken or left together; a budget over the limit times the corpus is cut to that; texts are counted whole; an
empty table gives an empty table; extra columns are kept (mix) or passed by (plan_copies).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SEED = 17
#: Share of the way from the corpus entropy to the uniform one; most repeats of a source; tokens of a block.
TOWARDS_UNIFORM, MOST_REPEATS, BLOCK_TOKENS = 0.5, 4.0, 1_000_000
#: Exponents tried in one job, and jobs: the exponent is exact to (POINTS + 1) ** -JOBS.
POINTS, JOBS = 63, 5
#: Sources whose rows may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000


def count_tokens(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A string that tells null from any source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def exponent(stats: DataFrame, total: float, budget: float, entropy: float, most_repeats: float) -> float:
    """The least exponent of [0, 1] with an entropy of at most `entropy` nats and at most `most_repeats` of any source; 1 if there is none."""
    p = F.col("tokens") / F.lit(total)
    low, high = 0.0, 1.0
    for _ in range(JOBS):
        step = (high - low) / (POINTS + 1)
        tried = [low + step * i for i in range(1, POINTS + 1)] + [high] + ([0.0] if low == 0 else [])
        each = stats.filter("tokens > 0").select(F.log(p).alias("lp"), F.explode(F.array(*map(F.lit, tried))).alias("a"))
        sums = each.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("lp")) * F.col("lp")).alias("zl"), F.max((F.col("a") - 1) * F.col("lp")).alias("top"))
        held = F.log("z") - F.col("a") * F.col("zl") / F.col("z")
        repeats = F.lit(budget / total) * F.exp("top") / F.col("z")
        fine = sums.filter((held <= entropy + 1e-12) & (repeats <= most_repeats * (1 + 1e-12))).agg(F.min("a")).first()[0]
        if fine is None:
            return 1.0
        if fine == 0.0:
            return 0.0
        low, high = max(low, fine - step), fine
    return high


def shares(counted: DataFrame, budget: float | None, towards_uniform: float, most_repeats: float) -> DataFrame | None:
    """A row per source key: tokens, weight, quota, whole epochs, rest, blocks. None if there is no token."""
    stats = checkpointed(counted.groupBy("key").agg(F.sum("n_tokens").alias("tokens")))
    total, logs, n = stats.filter("tokens > 0").agg(F.sum("tokens"), F.sum(F.col("tokens") * F.log("tokens")), F.count("*")).first()
    if not total:
        return None
    budget = min(float(total if budget is None else budget), most_repeats * total)
    own = math.log(total) - logs / total
    entropy = own + towards_uniform * (math.log(n) - own)
    a = exponent(stats, float(total), budget, entropy, most_repeats)
    power = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(total))))
    z = stats.filter("tokens > 0").agg(F.sum(power)).first()[0]
    quota = F.floor(power / F.lit(z) * F.lit(budget) + F.lit(1e-6))
    rows = stats.select("key", "tokens", F.when(F.col("tokens") > 0, power / F.lit(z)).otherwise(0.0).alias("weight"), F.when(F.col("tokens") > 0, quota).otherwise(0).alias("quota"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1)
    rows = rows.withColumn("whole", whole.cast("int"))
    rest = F.when(F.col("tokens") > 0, F.col("quota") - F.col("whole") * F.col("tokens")).otherwise(0)
    return rows.withColumns({"rest": rest.cast("bigint"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("bigint")})


def _place(copy: Column, row_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), copy, row_id)


def _with(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, "key")


def cuts(counted: DataFrame, sources: DataFrame, few: bool, seed: int) -> DataFrame:
    """sources, each with the place (block, order) up to which its last epoch goes; nulls: it has none."""
    placed = _with(counted, sources.filter("rest > 0").select("key", "whole", "rest", "blocks"), few).withColumn("order", _place(F.col("whole"), F.col("id"), seed))
    placed = placed.withColumn("block", F.pmod("order", "blocks"))
    sums = placed.groupBy("key", "rest", "block").agg(F.sum("n_tokens").alias("n"))
    line = Window.partitionBy("key").orderBy("block")
    ends = sums.withColumn("end", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # The first block that doesn't fit holds the cut.
    edge = ends.filter(F.col("end") > F.col("rest")).groupBy("key").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("end") + F.col("n")).alias("left")), "block").alias("e")).select("key", F.col("e.block").alias("cut_block"), F.col("e.left").alias("left"))
    inside = _with(placed, edge, few).filter(F.col("block") == F.col("cut_block"))
    # Rows of one order stand together: the frame is a range.
    at = inside.withColumn("end", F.sum("n_tokens").over(Window.partitionBy("key", "block").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)))
    last = at.filter(F.col("end") <= F.col("left")).groupBy("key").agg(F.max("order").alias("cut_order"))
    return sources.join(edge.select("key", "cut_block"), "key", "left").join(last, "key", "left")


def _expanded(rows: DataFrame, sources: DataFrame | None, few: bool, id_col: str, seed: int) -> DataFrame:
    if sources is None:
        out = rows.withColumns({"__copy": F.lit(0), "__blocks": F.lit(1).cast("bigint")})
    else:
        named = sources.select(F.col("key").alias("__key"), F.struct("whole", "rest", "cut_block", "cut_order").alias("__s"), F.col("blocks").alias("__blocks"))
        out = rows.join(F.broadcast(named) if few else named, "__key")
        out = out.withColumn("__order", _place(F.col("__s.whole"), F.col(id_col), seed)).withColumn("__block", F.pmod("__order", "__blocks"))
        s = F.col("__s")
        before = (F.col("__block") < s["cut_block"]) | ((F.col("__block") == s["cut_block"]) & (F.col("__order") <= s["cut_order"]))
        n = s["whole"] + F.when((s["rest"] > 0) & F.coalesce(before, F.lit(False)), 1).otherwise(0)
        out = out.withColumn("__n", n).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    order = _place(F.col("__copy"), F.col(id_col), seed)
    return out.withColumn("__order", order).withColumn("__block", F.pmod("__order", "__blocks"))


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, budget: float | None, towards_uniform: float, most_repeats: float, seed: int) -> tuple[DataFrame, DataFrame | None, bool]:
    counted = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"), count_tokens(F.col(text_col)).alias("n_tokens")))
    sources = shares(counted, budget, towards_uniform, most_repeats)
    if sources is None:
        return counted, None, True
    sources = checkpointed(sources)
    few = sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return counted, checkpointed(cuts(counted, sources, few, seed)), few


def plan_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: float | None = None, towards_uniform: float = TOWARDS_UNIFORM, most_repeats: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """A row per copy: id, source, copy (from 0), block and place_key (its place in that epoch's permutation), n_tokens."""
    counted, sources, few = _planned(docs, id_col, source_col, text_col, budget, towards_uniform, most_repeats, seed)
    out = _expanded(counted.withColumnRenamed("key", "__key"), sources, few, "id", seed)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("__copy").alias("copy"), F.col("__block").alias("block"), F.col("__order").alias("place_key"), "n_tokens")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: float | None = None, towards_uniform: float = TOWARDS_UNIFORM, most_repeats: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as its source's weight asks for, with the columns they came with."""
    _, sources, few = _planned(docs, id_col, source_col, text_col, budget, towards_uniform, most_repeats, seed)
    return _expanded(docs.withColumn("__key", source_key(F.col(source_col))), sources, few, id_col, seed).select(*docs.columns)
