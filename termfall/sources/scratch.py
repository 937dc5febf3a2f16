"""Reliable cuts of lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return (given or sc.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch that Python gets.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a lower one stays. A worker's memory then doesn't depend on how long texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name))
    if not given or not 0 < int(given[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which is removed when the application ends. Spark removes the job's shuffle files once it is written."""
    spark, own = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(own)
    spark.conf.set(own, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(own, before)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_at"] = path
    return out


def removed(*tables: DataFrame) -> None:
    """Remove tables of written(), which nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.__dict__["written_at"])
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
