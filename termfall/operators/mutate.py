"""Adding, deleting and updating documents. Relations are immutable: each operator returns another index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import Index, build
from ..sources.scratch import checkpointed

#: Ids of a bucket of the deletions' table; deletions that may be broadcast (a row of two longs each, and a row for each bucket).
BUCKET, MOST_BROADCAST = 4_096, 100_000
#: Ids of a word of bits: under 63, so that sums of bits don't overflow.
WORD = 32


def numbered(docs: DataFrame, start: int, order_col: str, id_col: str = "doc_id") -> DataFrame:
    """docs with ids start, start + 1, ... in the order of order_col, a unique value of any kind that has an order.

    Rows are dealt by ranges of the order, however sparse it is, and written; a task ranks its own range, and only the ranges' counts are
    summed along a line. Repeated values are numbered in any order.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(docs.repartitionByRange(parts, order_col).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(order_col)) - 1
    # A row for each shuffle partition: its broadcast is bounded by that setting.
    return placed.withColumn("__nth", within).join(F.broadcast(before), "__part").withColumn(id_col, F.col("__before") + F.col("__nth") + F.lit(start).cast("bigint")).drop("__part", "__nth", "__before")


def _refuse_repeated(docs: DataFrame) -> None:
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").first()
    if twice:
        raise ValueError(f"document {twice['doc_id']} is given {twice['n']} times")


def add(index: Index, docs: DataFrame, order_col: str | None = None, check: bool = True) -> Index:
    """The index with more documents. Without order_col, docs brings its doc_id; with it, ids go on from the number of documents.

    check: raise ValueError for an id that is given twice or is there already.
    """
    if order_col:
        docs = numbered(docs.drop("doc_id") if order_col != "doc_id" else docs.withColumnRenamed("doc_id", "__order"), len(index), order_col if order_col != "doc_id" else "__order")
    elif check:
        _refuse_repeated(docs)
        there = docs.join(index.docs.select("doc_id"), "doc_id", "left_semi").select("doc_id").first()
        if there:
            raise ValueError(f"document {there['doc_id']} is there already")
    more = build(docs.select("doc_id", "text"), index.analyzer, index.scoring)
    if index.forward is not None:
        return index.on(index.forward.unionByName(more.forward))
    return replace(index, docs=index.docs.unionByName(more.docs), postings=index.postings.unionByName(more.postings), stored_terms=None, stored_totals=None, forward=None)


def delete(index: Index, gone: DataFrame, compact: bool = True) -> Index:
    """The index without the ids of gone (doc_id). compact: later ids close the gaps, as positions in a list would.

    Ids that don't exist and repeated ids make no difference. Up to MOST_BROADCAST deletions travel to the relations, which then aren't
    shuffled; more are joined by a shuffle.
    """
    gone = checkpointed(gone.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(index.docs.select("doc_id"), "doc_id", "left_semi"))
    few = gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    small = F.broadcast if few else (lambda df: df)
    # A row for each document, where there is one, rather than for each posting.
    held = (index.docs, index.postings) if index.forward is None else (index.forward,)
    held = [df.join(small(gone), "doc_id", "left_anti") for df in held]
    if compact:
        low, high, n = index.docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
        if n and (low, high) == (0, n - 1):
            held = [_shifted(df, gone, n, small) for df in held]
        else:
            # Ids with gaps of their own: each id's rank among those that stay.
            moves = numbered(held[0].select("doc_id"), 0, "doc_id", "to").select("doc_id", "to")
            held = [df.join(moves, "doc_id").withColumn("doc_id", F.col("to")) for df in held]
    if index.forward is not None:
        return index.on(held[0])
    docs, postings = held
    return replace(index, docs=docs.select("doc_id", "dl"), postings=postings.select("term", "doc_id", "tf", "dl"), stored_terms=None, stored_totals=None, forward=None)


def _shifted(df: DataFrame, gone: DataFrame, n: int, small) -> DataFrame:
    """df, whose ids were 0 to n - 1, with each id less the number of deleted ids below it.

    A bucket of ids has its deleted ones as the bits of words, with their number before each word, and their number before the bucket: a row looks up one
    word, however many ids of its bucket are deleted.
    """
    word, bit = F.floor(F.col("doc_id") % BUCKET / WORD).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("doc_id") % BUCKET % WORD).cast("int"))
    bits = gone.groupBy(F.floor(F.col("doc_id") / BUCKET).alias("b"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = F.sequence(F.lit(0), F.lit(-(-BUCKET // WORD) - 1))
    held = bits.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"), F.sum(F.bit_count("bits")).alias("size"))
    held = held.withColumn("own", F.transform(words, lambda i: F.coalesce(F.try_element_at("set", i), F.lit(0).cast("bigint"))))
    less = F.transform(words, lambda i: F.aggregate(F.slice("own", 1, i), F.lit(0), lambda a, x: a + F.bit_count(x)))
    held = held.select("b", "size", "own", less.alias("less"))
    buckets = df.sparkSession.range(-(-n // BUCKET)).withColumnRenamed("id", "b").join(small(held), "b", "left")
    # One row for each BUCKET ids; sums over runs of BUCKET buckets, and of runs, so that no task has them all.
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    run = F.floor(F.col("b") / BUCKET)
    within = buckets.withColumns({"run": run, "size": size}).withColumn("upto", F.sum("size").over(Window.partitionBy("run").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    runs = within.groupBy("run").agg(F.sum("size").alias("n"))
    runs = runs.select("run", (F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    table = within.join(runs, "run").select("b", "own", "less", (F.col("before") + F.col("upto") - F.col("size")).alias("before"))
    table = F.broadcast(table) if n <= BUCKET * MOST_BROADCAST else table
    below = F.coalesce(F.element_at("less", word + 1) + F.bit_count(F.element_at("own", word + 1).bitwiseAND(bit - 1)), F.lit(0))
    return df.withColumn("b", F.floor(F.col("doc_id") / BUCKET)).join(table, "b").withColumn("doc_id", F.col("doc_id") - F.col("before") - below).drop("b", "own", "less", "before")


def update(index: Index, docs: DataFrame, check: bool = True) -> Index:
    """The index with other texts for the ids of docs (doc_id, text). check: raise IndexError for an id that doesn't exist, ValueError for one that is given twice."""
    if check:
        missing = docs.join(index.docs.select("doc_id"), "doc_id", "left_anti").select("doc_id").first()
        if missing:
            raise IndexError(f"no document {missing['doc_id']}")
        _refuse_repeated(docs)
    kept = delete(index, docs, compact=False)
    return add(kept, docs, check=False)
