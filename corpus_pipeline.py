"""From raw documents to token ids: quality rules, near-dedup, PII, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. Null and empty texts fail the quality rules, so later stages see none of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from termfall.llm import bpe, mixing, pii, quality, similar
from termfall.llm.common import removed, removed_at_end, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counted rules and lie in their language's perplexity band."""
    return quality.keep_quality(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of five-word similarity 0.8 and above connect; SimHash and its trie join find the pairs."""
    return similar.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row."""
    return bpe.encode_documents(docs, *bpe.production())


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A language model, fingerprints and token merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written to the shared folder and read again; what the next one has read is removed."""
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{base}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                removed(spark, before)
            before = path
    removed_at_end(spark, base)
    return docs
