"""Structured Streaming into index segments.

Each micro-batch is analysed once and written as one segment under its batch number, so a batch that is run again after a failure
replaces its own segment and nothing is counted twice. How texts were analysed is stored beside the segments: another
analysis is refused. Segments are ordinary relations; reading them all gives an index, and compact() makes a stored one of them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import Analyzer
from ..functions.scoring import Scoring
from ..plans.index import Index, counted, of_forward
from ..sources import storage

_SEGMENT = "doc_id bigint, dl int, counts array<struct<term: string, tf: int>>, segment int"


def _settings(path: str) -> str:
    return f"{path}/settings.json"


def _stored(spark: SparkSession, path: str) -> Analyzer:
    return Analyzer(**json.loads(storage.read_text(spark, _settings(path))))


def ingest(docs: DataFrame, path: str, checkpoint: str, analyzer: Analyzer | None = None, available_now: bool = True) -> StreamingQuery:
    """Start writing a stream of (doc_id, text) as segments under path. available_now: stop when what is there has been read.

    Raises ValueError if the segments there were analysed otherwise.
    """
    spark = docs.sparkSession
    analyzer = analyzer or Analyzer()
    if not storage.write_text(spark, _settings(path), json.dumps(asdict(analyzer))):
        storage.refuse_other(path, _stored(spark, path), analyzer)

    def write(batch: DataFrame, number: int) -> None:
        counted(batch, analyzer).write.mode("overwrite").parquet(f"{path}/segments/segment={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def segments(spark: SparkSession, path: str, analyzer: Analyzer | None = None, scoring: Scoring | None = None, check: bool = True) -> Index:
    """The index of all segments written so far, with their analysis.

    Raises ValueError if another analysis is given and, with check, if an id was ingested twice.
    """
    found = _stored(spark, path)
    storage.refuse_other(path, found, analyzer)
    forward = spark.read.schema(_SEGMENT).parquet(f"{path}/segments").select("doc_id", "dl", "counts")
    if check:
        twice = forward.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").first()
        if twice:
            raise ValueError(f"document {twice['doc_id']} was ingested {twice['n']} times")
    return of_forward(forward, found, scoring or Scoring())


def compact(spark: SparkSession, path: str, to: str, scoring: Scoring | None = None) -> Index:
    """All segments written so far as a stored index at `to`, laid out by term."""
    # The segments are analysed rows already: save() need not write them once more.
    storage.save(replace(segments(spark, path, scoring=scoring), forward=None), to)
    return storage.load(spark, to)
