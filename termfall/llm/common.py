"""Shared plumbing: table access, slices of bounded bytes, reliable cuts in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python code works on at a time, and bytes of an Arrow batch.
SLICE_BYTES = 4 << 20
#: Rows that may be broadcast by hint; more are joined by a shuffle.
MOST_BROADCAST = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to SLICE_BYTES, the same for all operators; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name))
    if not given or not 0 < int(given[1]) <= SLICE_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which takes less disk than a checkpoint and can be read by columns.

    The table is removed when the application ends. release: have Spark remove the job's shuffle files as soon as the table is written; else they
    stay until the driver happens to collect its garbage.
    """
    spark, own = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(own)
    spark.conf.set(own, "true" if release else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(own, before)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder in the shared store removed when the driver ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder in the shared store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def few(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether df has at most so many rows."""
    return df.limit(most + 1).count() <= most


def joined(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts the other side if it has few rows."""
    return df.join(F.broadcast(small) if few(small) else small, on, how)


def size_of(df: DataFrame) -> int:
    """Bytes of df as the optimiser estimates them; for a table that is read, the size of its files. Unknown sizes count as 1 PB."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 50)


def ranges(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of strings that hold about `most` bytes together; a longer string has a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = before = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(size, before + most, "right")))
        yield start, stop - start
        start, before = stop, int(size[stop - 1])


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """The strings as lists of about `most` bytes."""
    for start, n in ranges(column, most):
        yield column.slice(start, n).to_pylist()


def map_slices(df: DataFrame, text_at: int, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over slices of bounded bytes (of the column at text_at); fn yields columns."""
    arrow = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in ranges(batch.column(text_at)):
                for out in fn(batch.slice(start, n)):
                    yield from pieces(out, arrow)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def pieces(columns: dict, schema: pa.Schema, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows from columns (lists or numpy arrays)."""
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for at in range(0, whole.num_rows, rows):
        yield whole.slice(at, rows)
