"""SimHash near-dedup by a binary trie self-join.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Distinct fingerprints, not
documents, are joined: copies share one. A task keeps its fingerprints sorted, which is a binary trie in an array: a node is a range, and
an edge without branches is skipped. Pairs of nodes are walked together from the root down, the differing bits add up, and a
pair is dropped as soon as they exceed the budget; two single fingerprints are charged the differing bits of their last edges.

The trie is dealt to tasks by its BITS + 1 rotations: fingerprints that differ in at most BITS of 64 bits agree in one of BITS + 1
blocks, so in the rotation that begins with it they lie below one node, whose subtree is walked in one task. A fingerprint travels BITS + 1
times. Cut at depth p without rotations, it would travel to every node within BITS bits of its own: for p = 16, 697 times.

A task joins what it finds in a union-find and emits at most one link per fingerprint, never all pairs of a group; components then come from
star rounds over those links.

Edge cases: null and empty texts and texts without a word have the fingerprint zero and are linked like any other; fewer
words than a shingle needs give one shingle, the whole sequence; texts are read whole; repeated rows share a fingerprint
and a component; ids that are null stay apart from the choice of the least id unless a class has no other; an empty table gives
an empty table; extra columns are passed by (fingerprint_classes) or kept (keep_one).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, small_batches, to_arrow
from .components import components

BITS = 3
SEED = 42
WIDTH = 64
#: Node pairs that are walked at a time.
HELD = 200_000
#: Node pairs of wide fingerprints that are walked at a time.
WALKED = 20_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, blanks 0x20 and 0x09 to 0x0D only
    if not parts:
        return 0
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return h(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    hashes = np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, n, 16_384):
        ones += np.unpackbits(hashes[at : at + 16_384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, out_col: str = "fp") -> DataFrame:
    """All columns of docs and the fingerprint as a (signed) long."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for some in slices(texts) for t in some], dtype=np.uint64).view(np.int64))

    # Not deterministic for the optimiser, which else runs it again for a filter on its result.
    return docs.withColumn(out_col, made.asNondeterministic()(F.col(text_col)))


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        top = self.flat()
        pairs = np.unique(np.stack((top[a], top[b]), axis=1)[top[a] != top[b]], axis=0)
        for x, y in pairs.tolist():
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def flat(self) -> np.ndarray:
        while True:
            top = self.up[self.up]
            if np.array_equal(top, self.up):
                return top
            self.up = top


def trie_links(sorted_fps: np.ndarray, fixed: int, bits: int = BITS) -> np.ndarray:
    """For each of the sorted distinct fingerprints, the position of the least one that links over pairs lead to.

    Pairs agree in the first `fixed` bits and differ in at most `bits` of the others.
    """
    n = len(sorted_fps)
    sets = _Sets(n)
    shift = np.uint64(WIDTH - fixed)
    head = sorted_fps >> shift if fixed else np.zeros(n, dtype=np.uint64)
    cuts = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1], [True])))
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    #: For each depth, how many of the first i fingerprints have that bit set.
    ones: dict[int, np.ndarray] = {}

    def below(depth: int) -> np.uint64:
        return np.uint64((1 << (WIDTH - depth)) - 1)

    stack = [(fixed, lo[i : i + HELD], hi[i : i + HELD], lo[i : i + HELD], hi[i : i + HELD], np.zeros(len(lo[i : i + HELD]), dtype=np.int64)) for i in range(0, len(lo), HELD)]
    while stack:
        depth, a0, a1, b0, b1, spent = stack.pop()
        # Single fingerprints: what differs above is spent, what differs below is their last edges.
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = (x != y) & (np.bitwise_count((sorted_fps[x] ^ sorted_fps[y]) & below(depth)) + spent[single] <= bits)
            sets.join(x[near], y[near])
            a0, a1, b0, b1, spent = (v[~single] for v in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((sorted_fps >> np.uint64(WIDTH - 1 - depth)) & np.uint64(1), dtype=np.int64)))
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        left = np.concatenate((a0, am, a0, am))
        left_end = np.concatenate((am, a1, am, a1))
        right = np.concatenate((b0, bm, bm, b0))
        right_end = np.concatenate((bm, b1, b1, bm))
        cost = np.concatenate((spent, spent, spent + 1, spent + 1))
        keep = (left < left_end) & (right < right_end) & (cost <= bits)
        keep[3 * len(a0) :] &= ~same  # a node with itself: its halves meet once
        keep &= ~((left == right) & (left_end == right_end) & (left_end - left == 1))
        nxt = (left[keep], left_end[keep], right[keep], right_end[keep], cost[keep])
        for i in range(0, len(nxt[0]), HELD):
            stack.append((depth + 1, *(x[i : i + HELD] for x in nxt)))
    return sets.flat()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def voted(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The wide fingerprint of a set of hashes: a word of WIDTH majority bits for each multiplier. The empty set has zeros."""
    ones = np.zeros(WIDTH * len(odd), dtype=np.int64)
    for at in range(0, len(hashes), 2_048):
        some = mixed(hashes[at : at + 2_048, None] * odd)
        ones += np.unpackbits(some.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).view(">u8").astype(np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits the rows of a and b have in common; the rows differ."""
    differ = a ^ b
    word = (differ != 0).argmax(axis=1)
    x = differ[np.arange(len(differ)), word]
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    return WIDTH * (word + 1) - np.bitwise_count(x)


def _trie(rows: np.ndarray, first: int, nodes: dict[str, list[int]]) -> int:
    """Add the binary trie of sorted distinct rows to nodes, edges without branches skipped; its root. `first` is the position of the first row."""
    depth = _shared(rows[:-1], rows[1:]).tolist() if len(rows) > 1 else []
    lo, hi, at, left, right = (nodes[k] for k in ("lo", "hi", "depth", "left", "right"))

    def add(start: int, stop: int, d: int, one: int) -> int:
        for column, v in zip((lo, hi, at, left, right), (start, stop, d, one, -1), strict=True):
            column.append(v)
        return len(lo) - 1

    path: list[int] = []

    def closed(now: int, above: int) -> int:
        while path and at[path[-1]] > above:
            top = path.pop()
            right[top], hi[top] = now, hi[now]
            now = top
        return now

    leaf = WIDTH * rows.shape[1]
    now = add(first, first + 1, leaf, -1)
    for i, d in enumerate(depth, first + 1):
        below = closed(now, d)
        path.append(add(lo[below], -1, d, below))
        now = add(i, i + 1, leaf, -1)
    return closed(now, -1)


@cache
def _above(words: int) -> np.ndarray:
    """For each depth, the bits above it, of fingerprints of so many words and a word that isn't charged."""
    return np.packbits(np.arange(WIDTH * (words + 1)) < np.arange(WIDTH * words + 1)[:, None], axis=1).view(">u8").astype(np.uint64)


def trie_pairs(fps: np.ndarray, root: np.ndarray, bits: int | np.ndarray, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the wide fingerprints (rows of words) of different roots that differ in at most `bits` bits: one budget, or each its own, of which a pair has the larger.

    All pairs or, with split, those of one before it and one behind it. Pairs of nodes are walked from the root of the trie down; a pair is dropped when
    the bits above it differ too much or when all that lies below both is connected already.
    """
    n, words = fps.shape
    order = np.concatenate([at[np.lexsort(fps[at].T[::-1])] for at in (np.arange(split), np.arange(split, n)) if len(at)])
    # A last word, which is not charged, tells equal fingerprints apart.
    rows = np.concatenate((fps[order], np.arange(n, dtype=np.uint64)[:, None]), axis=1)
    columns: dict[str, list[int]] = {k: [] for k in ("lo", "hi", "depth", "left", "right")}
    tops = [_trie(rows[s:e], s, columns) for s, e in ((0, split), (split, n)) if e > s]
    lo, hi, depth, left, right = (np.array(columns[k]) for k in ("lo", "hi", "depth", "left", "right"))
    own = root[order]
    turns = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
    alone = turns[lo] == turns[hi - 1]
    above = _above(words)
    most = np.maximum.reduceat(np.append(np.broadcast_to(bits, n)[order], 0), np.stack((lo, hi), axis=1).ravel())[::2]
    a, b = [], []
    stack = [(np.array([tops[0]]), np.array([tops[-1]]))]
    while stack:
        x, y = stack.pop()
        keep = ~(alone[x] & alone[y] & (own[lo[x]] == own[lo[y]]))
        x, y = x[keep], y[keep]
        at = np.minimum(depth[x], depth[y])
        spent = np.zeros(len(x), dtype=np.int64)
        # Half of the words settle most pairs of single fingerprints.
        for part in (slice(0, words // 2), slice(words // 2, words)):
            spent += np.bitwise_count((rows[lo[x], part] ^ rows[lo[y], part]) & above[np.minimum(at, WIDTH * words), part]).sum(axis=1, dtype=np.int64)
            keep = spent <= np.maximum(most[x], most[y])
            x, y, at, spent = x[keep], y[keep], at[keep], spent[keep]
        ends = (left[x] < 0) & (left[y] < 0)
        a.append(lo[x[ends]])
        b.append(lo[y[ends]])
        x, y, at = x[~ends], y[~ends], at[~ends]
        # What branches here goes on as its halves; a node with itself: its halves meet once.
        in_x, in_y, same = depth[x] == at, depth[y] == at, x == y
        only_x, only_y, both = in_x & ~in_y, in_y & ~in_x, in_x & in_y
        cross = both & ~same
        halves = ((only_x, left, None), (only_x, right, None), (only_y, None, left), (only_y, None, right), (both, left, left), (both, right, right), (both, left, right), (cross, right, left))
        nx = np.concatenate([x[m] if p is None else p[x[m]] for m, p, _ in halves])
        ny = np.concatenate([y[m] if q is None else q[y[m]] for m, _, q in halves])
        stack += [(nx[i : i + WALKED], ny[i : i + WALKED]) for i in range(0, len(nx), WALKED)]
    return order[np.concatenate(a)], order[np.concatenate(b)]


def links(distinct: DataFrame, bits: int = BITS, fp_col: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints, at most one for each fingerprint and block, that connect what differs in at most `bits` bits."""
    spark = distinct.sparkSession
    schema = "a bigint, b bigint"
    arrow = to_arrow(spark, schema)
    edges = [WIDTH * i // (bits + 1) for i in range(bits + 2)]
    turned = distinct.select(F.col(fp_col).alias("fp"), F.explode(F.array(*[F.lit(i) for i in range(bits + 1)])).alias("block"))
    key = F.lit(None).cast("bigint")
    for i in range(bits + 1):
        part = F.shiftrightunsigned(F.shiftleft("fp", edges[i]), WIDTH - (edges[i + 1] - edges[i]))
        key = F.when(F.col("block") == i, part).otherwise(key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps: list[np.ndarray] = []
        blocks: list[np.ndarray] = []
        for batch in batches:
            fps.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            blocks.append(batch.column(1).to_numpy(zero_copy_only=False))
        if not fps:
            return
        fp, block = np.concatenate(fps), np.concatenate(blocks)
        for i in range(bits + 1):
            own, turn = fp[block == i], np.uint64(edges[i])
            if len(own) > 1:
                rolled = np.sort(own << turn | own >> np.uint64(WIDTH - edges[i])) if turn else np.sort(own)
                root = trie_links(rolled, edges[i + 1] - edges[i], bits)
                at = np.flatnonzero(root != np.arange(len(root)))
                back = rolled >> turn | rolled << np.uint64(WIDTH - edges[i]) if turn else rolled
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(back[at].view(np.int64)), pa.array(back[root[at]].view(np.int64))], schema=arrow)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return turned.repartition(parts, F.col("block"), key).mapInArrow(join, schema)


def _classes(distinct: DataFrame, bits: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint; root is a fingerprint of the class."""
    roots = components(links(distinct, bits)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def fingerprint_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = BITS) -> DataFrame:
    """A row per document: id, fingerprint (16 hex digits), component_id (least id reachable over links)."""
    made = checkpointed(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", words, "fp").select("__id", "fp"))
    classed = _classes(made.groupBy("fp").agg(F.min("__id").alias("least")), bits)
    lowest = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    out = made.join(classed.join(lowest, "root").select("fp", "component_id"), "fp", "left")
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = BITS) -> DataFrame:
    """One row of docs for each class, the one of the least id (a null id only if there is no other), with the columns it came with.

    Texts are fingerprinted once and move in one shuffle, by id and hash, so copies are spread.
    """
    made = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))).withColumn("__hash", F.xxhash64(text_col))
    narrow = checkpointed(fingerprints(made.select("__id", "__hash", F.col(text_col).alias("__text")), "__text", words).select("__id", "__hash", "fp"))
    classed = _classes(narrow.groupBy("fp").agg(F.min(F.struct("__id", "__hash")).alias("least")), bits)
    kept = classed.groupBy("root").agg(F.min("least").alias("k")).select("k.*")
    return made.join(kept, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
