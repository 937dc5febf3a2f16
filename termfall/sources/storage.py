"""Stored indexes: versions of Parquet relations, and numbered manifests that name them.

The manifest with the highest number is the current one. A version is never written over: a new one is written beside it, then its
manifest gets the next number by a rename, so there is a current version at every moment; readers of the one before go on, older ones are
removed. All files go through Spark's file system, whatever store the path lies in. Postings are laid out by term, sorted, with Bloom
filters, so a search reads the row groups of its terms.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..functions.analysis import Analyzer
from ..functions.scoring import Scoring
from ..plans.index import Index, empty, of_forward

VERSION = 2
#: Versions that stay: the current one and those before it.
KEPT = 2
_MANIFEST = re.compile(r"manifest-(\d{12})\.json")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The manifests' numbers, rising."""
    fs, made = _fs(spark, path)
    if not fs.exists(made(path)):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(made(path)) if (m := _MANIFEST.fullmatch(s.getPath().getName())))


def _manifest(path: str, number: int) -> str:
    return f"{path}/manifest-{number:012d}.json"


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place by a rename; False if there is one already."""
    fs, made = _fs(spark, path)
    folder, _, name = path.rpartition("/")
    draft = made(f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(made(path)) or not fs.rename(draft, made(path)):
        fs.delete(draft, False)
        return False
    return True


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an index is stored at the path."""
    return bool(_numbers(spark, path))


def save(index: Index, path: str) -> None:
    """Write the index as the path's current version. Texts that aren't analysed yet are analysed once."""
    if index.partial:
        raise ValueError("an index of some terms only can't be stored")
    spark = index.docs.sparkSession
    version = f"{path}/v-{uuid.uuid4().hex}"
    fs, made = _fs(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = index
    if index.forward is not None:
        index.forward.write.parquet(f"{version}/forward")
        source = of_forward(spark.read.parquet(f"{version}/forward"), index.analyzer, index.scoring)
    source.docs.write.parquet(f"{version}/docs")
    by_term = source.postings.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id")
    by_term.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{version}/postings")
    stored = Index(spark.read.parquet(f"{version}/docs"), spark.read.parquet(f"{version}/postings"), index.analyzer, index.scoring)
    stored.terms.write.parquet(f"{version}/terms")
    stored.totals.write.parquet(f"{version}/totals")
    fs.delete(made(f"{version}/forward"), True)
    manifest = {"version": VERSION, "data": version.rpartition("/")[2], "analyzer": asdict(index.analyzer), "scoring": asdict(index.scoring)}
    number = max(_numbers(spark, path), default=0) + 1
    # Another writer may have taken the number.
    while not write_text(spark, _manifest(path, number), json.dumps(manifest, indent=1)):
        number += 1
    for old in _numbers(spark, path)[:-KEPT]:
        data = json.loads(read_text(spark, _manifest(path, old)))["data"]
        fs.delete(made(_manifest(path, old)), False)
        fs.delete(made(f"{path}/{data}"), True)


def load(spark: SparkSession, path: str, cache: bool = False) -> Index:
    """The stored index with its settings. cache: keep its relations in memory, instead of reading the columns that a query needs."""
    numbers = _numbers(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no index at {path}")
    manifest = json.loads(read_text(spark, _manifest(path, numbers[-1])))
    if manifest.get("version") != VERSION:
        raise ValueError(f"{path}: version {manifest.get('version')}, not {VERSION}")
    at = f"{path}/{manifest['data']}"

    def read(name: str) -> DataFrame:
        df = spark.read.parquet(f"{at}/{name}")
        return df.cache() if cache else df

    return Index(read("docs"), read("postings"), Analyzer(**manifest["analyzer"]), Scoring(**manifest["scoring"]), read("terms"), read("totals"))


def refuse_other(path: str, found: object, given: object | None) -> None:
    """Raise ValueError if settings are given that differ from the stored ones."""
    if given is not None and given != found:
        raise ValueError(f"{path} was stored with {found}, not {given}")


def open_or_create(spark: SparkSession, path: str, analyzer: Analyzer | None = None, scoring: Scoring | None = None) -> Index:
    """The stored index, or an empty one. Raises ValueError if settings are given that differ from the stored ones."""
    if not exists(spark, path):
        return empty(spark, analyzer, scoring)
    found = load(spark, path)
    refuse_other(path, found.analyzer, analyzer)
    refuse_other(path, found.scoring, scoring)
    return found
