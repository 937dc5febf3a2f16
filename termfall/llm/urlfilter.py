"""URL filters over a sorted digest array.

Blocklist entries are hashed with 64-bit xxhash, sorted and written to one file: count, longest entry, keys, offsets, strings. The file is
named by its content and handed out by Spark (addFile) once in an application; it lies in Spark's own folders, which Spark removes. Workers
memory-map it, probe it with a vectorised binary search and confirm each hit against the stored full string, so a hash
collision never blocks a URL. Explicit rules (host and path) come before the list; the longest rule that fits wins.

An entry is `host/` (the host and all subdomains) or `host/path` (that exact page). A list is given as strings or as a table with
one column, which is read by the driver: it is a file of the driver's before it is one of the executors', and never held in memory by workers.

Edge cases: null urls and urls without `://` have an empty host and path, fit no rule and no entry, and are allowed; long
urls are read whole: of a host's endings, those longer than the longest entry can't be listed and are not formed, so the work is linear;
repeated rows each get a row; an empty list blocks nothing; null entries are left out; ties between rules of equal length go to the
first one given; an empty table gives an empty table; extra columns are passed by.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, small_batches

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The production list, by rule: each of these names, alone and with a number below SERIES behind a hyphen, under each of these domains.
NAMES = ("casino-win", "free-bets", "cheap-pills", "spam-farm", "adult-x", "ads-track")
DOMAINS = ("example.com", "example.net", "example.org")
SERIES = 5_000


def production() -> Iterator[str]:
    """The entries of the production list."""
    for name in NAMES:
        for domain in DOMAINS:
            yield f"{name}.{domain}/"
            for i in range(SERIES):
                yield f"{name}-{i}.{domain}/"


_HEAD = "<QQ"
_HEAD_SIZE = struct.calcsize(_HEAD)


def pack(entries: Iterable[str]) -> bytes:
    """The sorted digest array as bytes."""
    keyed = sorted((xxhash.xxh64_intdigest(e), e) for e in {e.encode() for e in entries if e is not None})
    ends = np.cumsum([0, *(len(e) for _, e in keyed)], dtype="<u8")
    keys = np.array([k for k, _ in keyed], dtype="<u8")
    return struct.pack(_HEAD, len(keyed), max((len(e) for _, e in keyed), default=0)) + keys.tobytes() + ends.tobytes() + b"".join(e for _, e in keyed)


class DigestArray:
    """A packed list, mapped from a file or held as bytes."""

    def __init__(self, buffer) -> None:
        n, self.longest = struct.unpack_from(_HEAD, buffer)
        self.keys = np.frombuffer(buffer, "<u8", n, _HEAD_SIZE)
        self.ends = np.frombuffer(buffer, "<u8", n + 1, _HEAD_SIZE + 8 * n)
        self.buffer, self.base = buffer, _HEAD_SIZE + 8 * n + 8 * (n + 1)

    @classmethod
    def open(cls, path: str) -> DigestArray:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def contains(self, raw: Sequence[bytes], keys: np.ndarray | None = None) -> np.ndarray:
        """Which strings the list holds; equal keys are told apart by the stored strings."""
        if keys is None:
            keys = np.array([xxhash.xxh64_intdigest(s) for s in raw], dtype=np.uint64)
        left, right = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = np.zeros(len(raw), dtype=bool)
        for i in np.flatnonzero(right > left):
            out[i] = any(self.buffer[self.base + int(self.ends[j]) : self.base + int(self.ends[j + 1])] == raw[i] for j in range(left[i], right[i]))
        return out


@lru_cache(4)
def _mapped(name: str) -> DigestArray:
    return DigestArray.open(SparkFiles.get(name))


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (lower-cased A-Z) and path of a url."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def best_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def forms(host: str, path: str, longest: int) -> list[bytes]:
    """The entries of at most `longest` bytes that would block a page: its host's endings, shortest first, and the page itself."""
    out = []
    raw = host.encode("utf-8", "surrogatepass")
    at = len(raw)
    while (at := raw.rfind(b".", max(0, len(raw) - longest), at)) >= 0:
        out.append(raw[at + 1 :] + b"/")
    if len(raw) < longest:
        out.append(raw + b"/")
    if len(path) > 1 and len(raw) + len(path) <= longest:
        out.append(raw + path.encode("utf-8", "surrogatepass"))
    return out


def _handed_out(spark, entries: Iterable[str]) -> str:
    """The name under which executors find the packed list."""
    data = pack(entries)
    name = f"digests-{hashlib.sha256(data).hexdigest()}.bin"
    folder = os.path.join(SparkFiles.getRootDirectory(), "lists")
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, blocked: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """A row per page: id, host, path, the rule that decided (or null), the verdict, the listed entry that blocked it (or null)."""
    small_batches(pages.sparkSession)
    if isinstance(blocked, DataFrame):
        blocked = (r[0] for r in blocked.toLocalIterator())
    name = _handed_out(pages.sparkSession, production() if blocked is None else blocked)
    rules = tuple(rules)

    def judge(batch: pa.RecordBatch) -> Iterator[dict]:
        listed = _mapped(name)
        out: dict[str, list] = {k: [] for k in ("host", "path", "rule", "verdict", "entry")}
        asked: list[bytes] = []
        owner: list[int] = []
        for i, url in enumerate(batch.column(1).to_pylist()):
            host, p = split_url(url)
            rule = best_rule(host, p, rules)
            out["host"].append(host)
            out["path"].append(p)
            out["rule"].append(rule[0] if rule else None)
            out["verdict"].append(rule[1] if rule else "allow")
            out["entry"].append(None)
            if not rule and host:
                own = forms(host, p, listed.longest)
                asked += own
                owner += [i] * len(own)
        if asked:
            for j in np.flatnonzero(listed.contains(asked)):
                out["verdict"][owner[j]], out["entry"][owner[j]] = "block", asked[j].decode()
        yield {id_col: batch.column(0), **out}

    kind = pages.schema[id_col].dataType.simpleString()
    return map_slices(pages.select(F.col(id_col), F.col(url_col)), 1, judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, entry string")


SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') = 0 THEN '' ELSE substr(rest, strpos(rest, '/')) END AS path FROM parts),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM split),
listed AS (
  SELECT *, CASE WHEN rule IS NULL THEN nullif(regexp_extract(host, '(^|[.])((casino-win|free-bets|cheap-pills|spam-farm|adult-x|ads-track)(-(0|[1-9][0-9]{0,2}|[1-4][0-9]{3}))?[.]example[.](com|net|org))$', 2), '') END AS entry FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR entry IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  entry || '/' AS entry
FROM listed
"""
