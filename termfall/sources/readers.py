"""Corpora, queries and judgements as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_list(spark: SparkSession, texts: Sequence[str], start: int = 0) -> DataFrame:
    """(doc_id, text) of a list; positions are ids. Raises ValueError if an element is no string."""
    for i, t in enumerate(texts):
        if not isinstance(t, str):
            raise ValueError(f"element {i} is not a string")
    return local(spark, {"doc_id": pa.array(range(start, start + len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def local(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A table of the driver's. Small ones become part of the plan, with their size known to the optimiser."""
    return spark.createDataFrame(pa.table(columns))


def from_bytes(spark: SparkSession, data: bytes, start: int = 0) -> DataFrame:
    """(doc_id, text) of newline-separated bytes: what follows the last newline is a document too, even if empty. Raises UnicodeDecodeError."""
    return from_list(spark, data.decode("utf-8").split("\n"), start)


def split_lines(blobs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(blob id, line, text): the same rule for a table of texts, inside Spark."""
    return blobs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line", "text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of newline-separated files; carriage returns stay, and a last newline makes no empty document here."""
    return spark.read.text(path, lineSep="\n").withColumnRenamed("value", "text")


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a JSON file that holds one list of strings."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("texts"))
    return rows.select(F.posexplode("texts").alias("doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def read_retrieval_set(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv.

    corpus: (key, title, text), queries: (key, query), qrels: (query_key, doc_key, rel); keys are strings.
    """
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("key"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("key"), F.col("text").alias("query"))
    qrels = spark.read.option("sep", "\t").option("header", True).schema("query_key string, doc_key string, rel int").csv(f"{folder}/qrels/{split}.tsv")
    return corpus, queries, qrels


def synthetic(spark: SparkSession, docs: int, words: Sequence[str], least: int = 20, most: int = 200, seed: int = 42) -> DataFrame:
    """(doc_id, text): so many documents of least to most words, drawn by hashes of seed, document and position."""
    drawn = F.array(*map(F.lit, words))
    n = F.lit(least) + F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(most - least + 1))
    text = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.element_at(drawn, (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(words))) + 1).cast("int"))), " ")
    return spark.range(docs).select(F.col("id").alias("doc_id"), text.alias("text"))
