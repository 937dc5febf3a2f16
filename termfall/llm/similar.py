"""Near-dedup by SimHash, a binary trie self-join and, since its budget is a rough one, exact Jaccard on what it finds.

A text's set is that of its hashed shingles of WORDS words. Texts with equal sets are one node. A node has a SimHash fingerprint of WIDE words of
64 majority bits, whose first word is the narrow one.

1. The narrow fingerprints are joined by the trie in BITS + 1 rotations (simhash.links), over all nodes. What lies within BITS bits and is similar
   is connected.
2. That budget reaches few pairs at LEAST, which differ in 15 to 19 % of the bits, and no rotation agrees for them. So the trie of the wide fingerprints, with
   a budget that a pair at LEAST exceeds once in 30,000, is dealt by BANDS keys, each made of ROWS least hashes of the set: a pair
   at LEAST shares a key with probability 1 - (1 - LEAST^ROWS)^BANDS, which is 0.99993, and more above. The nodes of a key are a bucket.
3. In each bucket the least node is compared with all others (exact Jaccard), and what is similar is connected. A tight group costs its size.
4. Buckets that still hold several components are open. Their nodes are dealt into blocks of about BLOCK; each pair of blocks is a
   pair of tries that one task walks, past what is connected. Pairs within the budget are compared exactly. So every pair of a bucket is decided or
   already connected, and no task holds a bucket.

The walk keeps pairs that are not similar from becoming rows: only their comparison grows with the square of what
stays apart in a bucket. Sets are made once, for nodes that meet others.

Edge cases: letters A-Z are folded and blanks split, as in simhash; null and empty texts and texts without a word have the empty set and
are one class; fewer words than a shingle needs give one shingle; texts are read whole; texts with equal sets are one node, known by a 64-bit
digest; ids that are null stay apart from the choice of the least id unless a class has no other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import ranges, slices, small_batches, written
from .components import components

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
SEED = 42
#: Shingles whose least hashes are taken at a time.
CHUNK = 2_000
#: Words of a wide fingerprint; by how many standard deviations a pair at LEAST may differ in more bits than expected; nodes of a block.
WIDE, SHORT, BLOCK = 64, 4.0, 1_024
#: Shingles from which a set's bits differ as those of large ones do, nearly: fewer have a budget of their own.
FEW = 48

_RANDOM = np.random.default_rng(SEED)
_ODD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE_ODD = _RANDOM.integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    own = np.fromiter((h(p, SEED) for p in parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(own))
    out = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = simhash.mixed(out * _STEP + own[k : len(own) - width + 1 + k])
    return np.unique(out)


def _least(found: np.ndarray, odd: np.ndarray) -> np.ndarray:
    least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[at : at + CHUNK, None] * odd).min(axis=0))
    return least


def _differ(both: int, a: int, b: int) -> float:
    """How likely a majority bit differs between two sets with `both` shingles in common and a and b of their own."""
    total = 0.0
    for c in range(both + 1):
        one, other = (sum(comb(k, i) for i in range(k + 1) if 2 * (c + i) > both + k) / 2**k for k in (a, b))
        total += comb(both, c) / 2**both * (one * (1 - other) + other * (1 - one))
    return total


@cache
def budgets(least: float = LEAST) -> np.ndarray:
    """Bits that two wide fingerprints may differ in, by the shingles of the smaller set, FEW at most: those of the least likely pair at `least`."""
    bits, p = simhash.WIDTH * WIDE, acos(2 * least / (1 + least)) / pi
    by = []
    for n in range(2 * FEW, -1, -1):
        # The larger set has at most n / least shingles, the pair at least n * least in common.
        p = max([p, *[_differ(both, n - both, k - both) for k in range(n, int(n / least) + 1) for both in range(n + 1) if least <= both / max(1, n + k - both) < 1]])
        by.append(p)
    return np.array([int(bits * x + SHORT * (bits * x * (1 - x)) ** 0.5) for x in by[: FEW - 1 : -1]])


def fingerprints(found: np.ndarray) -> np.ndarray:
    """BANDS fingerprints of a set of hashes."""
    least = _least(found, _ODD)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = simhash.mixed(out * _STEP + row)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _fingerprinted(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """A struct (node, fp, fps) beside the columns of docs: the digest of the text's set, its narrow fingerprint and the keys that deal the wide one."""

    @F.arrow_udf("struct<node: bigint, fp: bigint, fps: array<bigint>>")
    def made(texts: pa.Array) -> pa.Array:
        nodes, narrow, fps = [], [], []
        for some in slices(texts):
            for t in some:
                own = shingles(t, words)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                narrow.append(simhash.voted(own, _WIDE_ODD[:1])[0])
                fps.append(fingerprints(own))
        flat = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * BANDS, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([*[pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, narrow)], lists], ["node", "fp", "fps"])

    return docs.withColumn("__made", made.asNondeterministic()(F.col(text_col)))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, set, wide) of (node, text), written once. The keys and the number of shingles, FEW at most, stand behind the wide fingerprint."""

    @F.arrow_udf("struct<set: binary, wide: binary>")
    def made(given: pa.Array) -> pa.Array:
        sets = [shingles(t, words) for some in slices(given) for t in some]
        wide = [np.concatenate((simhash.voted(s, _WIDE_ODD), fingerprints(s), [np.uint64(min(len(s), FEW))])).tobytes() for s in sets]
        return pa.StructArray.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(wide, pa.binary())], ["set", "wide"])

    return written(texts.select("node", made.asNondeterministic()(F.col("text")).alias("m")).select("node", "m.*"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar."""
    schema = "a bigint, b bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in ranges(batch.column(2)):
                some = batch.slice(start, n)
                fine = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= least for x, y in zip(some.column(2), some.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine, pa.bool_())) for c in some.columns[:2]], names=["a", "b"])

    left, right = (sets.select(F.col("node").alias(k), F.col("set").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, schema), "links")


def _tight(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that the trie of narrow fingerprints links, in BITS + 1 rotations; those with one fingerprint form a star."""
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "heads")
    same = nodes.join(heads, "fp").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    left, right = (heads.select(F.col("fp").alias(k), F.col("first").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    near = simhash.links(heads.select("fp")).join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return written(same.unionByName(near).distinct(), "tight")


def _alike(open_: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different roots whose wide fingerprints are within the budget, of rows (bucket, blocks, node, root, wide). Each comes from the first bucket that both share."""
    most = budgets(least)
    schema = "a bigint, b bigint"
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "wide")

    def compare(bucket: int, own: np.ndarray, node: np.ndarray, root: np.ndarray, wide: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return (np.zeros(0, dtype=np.int64),) * 2
        at, split = (left, 0) if i == j else (np.concatenate((left, right)), len(left))
        bits, fps = most[wide[:, -1]], wide[:, WIDE:-1].view(np.int64)
        x, y = (at[k] for k in simhash.trie_pairs(wide[at, :WIDE], root[at], bits[at], split))
        fine = fps[x, (fps[x] == fps[y]).argmax(axis=1)] == bucket
        return node[x[fine]], node[y[fine]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(part: pa.Table) -> pa.RecordBatch:
            key = [part.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero(np.concatenate(([True], *[np.any([k[1:] != k[:-1] for k in key], axis=0)], [True])))
            own, node, root = (part.column(k).to_numpy() for k in (3, 4, 5))
            wide = np.frombuffer(b"".join(x.as_py() for x in part.column(6)), np.uint64).reshape(-1, WIDE + BANDS + 1)
            out = [compare(key[0][s], own[s:e], node[s:e], root[s:e], wide[s:e], key[1][s], key[2][s]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            # The last group may go on in the next batch.
            last = [now.column(k)[-1].as_py() for k in range(3)]
            same = np.all([now.column(k).to_numpy() == x for k, x in enumerate(last)], axis=0)
            cut = int(np.argmax(same))
            if cut:
                yield settled(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield settled(held)

    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, schema)


def _met(held: DataFrame, tight: DataFrame) -> DataFrame:
    """The nodes that meet others."""
    return held.select("node").union(tight.select("a")).union(tight.select("b")).distinct()


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select("node", "root")
    return nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(held: DataFrame, tight: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, root) of the nodes of held (bucket, node, first) and tight (a, b): components of the pairs of tight, or that share a bucket, that are similar."""
    stars = held.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    stars = written(stars.unionByName(tight).distinct(), "stars")
    links = _confirmed(stars, sets, least)
    nodes = _met(held, tight)
    placed = written(held.join(_roots(nodes, links), "node").select("bucket", "node", "root"), "placed")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    blocks = sizes.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    open_ = placed.join(blocks, "bucket").join(sets.select("node", "wide"), "node")
    rest = written(_alike(open_, least).join(stars, ["a", "b"], "left_anti"), "pairs")
    return _roots(nodes, links.unionByName(_confirmed(rest, sets, least)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of docs for each class, the one of the least id (a null id only if there is no other), with the columns it came with."""
    small_batches(docs.sparkSession)
    made = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))).withColumn("__hash", F.xxhash64(text_col))
    narrow = _fingerprinted(made.select("__id", "__hash", F.col(text_col).alias("__text")), "__text", words).select("__id", "__hash", "__made.*")
    # Copies have equal fingerprints: one row a node goes on.
    nodes = written(narrow.groupBy("node").agg(F.min(F.struct("__id", "__hash", "fp", "fps")).alias("k")).select("node", "k.*"), "nodes")
    held = nodes.select("node", F.explode("fps").alias("bucket"))
    many = held.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").select("bucket", "first")
    held = written(held.join(many, "bucket"), "buckets")
    tight = _tight(nodes.select("node", "fp"))
    at = nodes.select("node", "__id", "__hash")
    asked = at.join(_met(held, tight), "node", "left_semi")
    texts = made.select("__id", "__hash", F.col(text_col).alias("text")).join(asked, ["__id", "__hash"]).dropDuplicates(["node"]).select("node", "text")
    classed = classes(held, tight, _sets(texts, words), least)
    # A node that meets no other is a class of its own.
    all_ = at.join(classed, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = written(all_.groupBy("root").agg(F.min(F.struct("__id", "__hash")).alias("k")).select("k.*"), "kept")
    return made.join(kept, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
