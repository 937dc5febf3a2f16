"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else as well. The steps:

1. Sampling. Every window of LENGTH bytes has one anchor: the first of its least-hashed GRAM-byte grams, a function of the window's
   bytes alone. Equal windows thus have equal anchors at equal distances, and neighbouring windows with one anchor form a
   block. Only about one suffix in 70 is an anchor.
2. Distinguishing prefixes and pre-aggregation. Blocks are counted by the hash of their anchor's gram (partial sums before the shuffle),
   with the least and largest 128-bit digest of a block's bytes and distance. A gram found once makes all its windows unique. A gram
   whose blocks all have one digest is one block in copies: merging would compare a string with itself, so all its windows are repeats,
   and a group of copies, however large, is never exchanged. Joining the counts back is a plain equi-join, which adaptive execution splits
   where a gram is hot.
3. Merge sort. Blocks whose grams have differing surroundings are exchanged. A map task sorts its anchor suffixes into runs, front-coded:
   a suffix is stored as the length of the prefix shared with its predecessor, and the rest. A reducer merges the runs
   with a loser tree whose players carry the prefix length that they share with the last winner: players with different
   lengths are ordered without looking at bytes, and equal ones are compared from that length on, so known prefixes are never
   compared again. The merge yields the sorted suffixes with their common prefix lengths; the parts before the
   anchors are sorted the same way, backwards.
4. Decision. The window that starts d bytes before an anchor repeats if another block's suffix agrees over LENGTH - d bytes and its
   reversed head over d bytes: for each d, both are intervals of the sorted orders.

A gram with over HOT blocks of differing surroundings would fill a task. Its windows are counted by 128-bit digests instead, again
with partial sums: the same decision, window by window, for any number of blocks.

Rows are told apart by a 128-bit digest of id and text, nulls flagged, so rows that share a key share their result.

Edge cases: null and empty texts and texts shorter than LENGTH lose nothing; texts are UTF-8 bytes, read whole, and matches never
cross documents; repeated rows are repeats of each other; overlapping repeats inside a text count; rows with a null id keep
it; an empty table gives an empty table; extra columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ranges, slices, small_batches, to_arrow, written

LENGTH = 200
GRAM = 64  # a power of two
SPAN = LENGTH - GRAM + 1
#: Blocks of one gram that one task may hold; more are decided by digests.
HOT = 100_000
#: Bytes of blocks that a map task gathers before it writes its runs; bytes of a text that are sampled at a time.
RUN_BYTES, PART_BYTES = 32 << 20, 16 << 20
#: Blocks that meet in a merging task, about.
MERGED = 20_000

_R = np.random.default_rng(20_240_601)
_BYTE = _R.integers(1 << 63, dtype=np.uint64, size=256) | np.uint64(1)
_MULT = [np.uint64(int(x) | 1) for x in _R.integers(1 << 62, size=8)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h, size, k = _BYTE[data], 1, 0
    while size < GRAM:
        h = h[:-size] * _MULT[k] + h[size:]
        h ^= h >> np.uint64(29)
        size, k = size * 2, k + 1
    return h * _MULT[7]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def blocks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of windows in texts laid end to end: start of the first window, windows, distance to the anchor, text."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    # 36 bits of the hash, then the position (PART_BYTES are under 2^28): the least key is the first of the least hashes.
    h = gram_hashes(data)
    keys = (h >> np.uint64(28)) << np.uint64(28) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_least(keys, SPAN) & np.uint64((1 << 28) - 1)).astype(np.int64)
    at = np.arange(len(anchor))
    owner = np.searchsorted(ends, at, "right")
    inside = at + LENGTH <= ends[owner]
    at, anchor, owner = at[inside], anchor[inside], owner[inside]
    if not len(at):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))))
    n = np.diff(np.append(new, len(at)))
    return at[new], n, anchor[new] - at[new], owner[new]


def _parts(raw: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, int, int]]:
    """Texts laid end to end, their ends, the number of the first one, and where it begins; a long text comes in parts that share windows' ends."""
    if len(raw) == 1 and len(raw[0]) > PART_BYTES:
        for at in range(0, len(raw[0]), PART_BYTES):
            part = raw[0][at : at + PART_BYTES + LENGTH - 1]
            yield part, np.array([len(part)]), 0, at
    else:
        yield b"".join(raw), np.cumsum([len(x) for x in raw], dtype=np.int64), 0, 0


_BLOCKS = "d bigint, h bigint, place bigint, gram bigint, whole bigint, more bigint"


def sampled(keyed: DataFrame) -> DataFrame:
    """Blocks of all texts: row key (d, h), place (start, windows, distance packed), hash of the gram and digest of the block."""
    arrow = to_arrow(keyed.sparkSession, _BLOCKS)
    hashed, digest = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in ranges(batch.column(2)):
                d, h = (batch.column(i).slice(at, size).to_numpy(zero_copy_only=False) for i in (0, 1))
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).slice(at, size).to_pylist()]
                for joined, ends, first, begin in _parts(raw):
                    start, n, distance, owner = blocks(np.frombuffer(joined, dtype=np.uint8), ends)
                    if not len(start):
                        continue
                    anchor = (start + distance).tolist()
                    stop = (start + n - 1 + LENGTH).tolist()
                    gram = np.fromiter((hashed(joined[a : a + GRAM]) for a in anchor), dtype=np.uint64, count=len(start)).view(np.int64)
                    whole = np.frombuffer(b"".join(digest(joined[s:e], x) for s, e, x in zip(start.tolist(), stop, distance.tolist(), strict=True)), dtype=np.int64).reshape(-1, 2)
                    own = begin + start - np.concatenate(([0], ends[:-1]))[owner]
                    columns = [d[first + owner], h[first + owner], own << 16 | n << 8 | distance, gram, *np.ascontiguousarray(whole.T)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return keyed.select("d", "h", "text").mapInArrow(run, _BLOCKS)


def _shared(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of a and b, of which `known` bytes are known."""
    n = min(len(a), len(b))
    step = 8
    while known < n:
        if a[known : known + step] != b[known : known + step]:
            while step > 1:
                step //= 2
                if a[known : known + step] == b[known : known + step]:
                    known += step
            return known
        known, step = known + step, step * 2
    return n


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Sorted strings as common prefix lengths and rests."""
    prefix = np.zeros(len(strings), dtype=np.int32)
    for i in range(1, len(strings)):
        prefix[i] = _shared(strings[i - 1], strings[i], 0)
    return prefix, [s[p:] for s, p in zip(strings, prefix.tolist(), strict=True)]


def front_decode(prefix: list[int], rests: list[bytes]) -> list[bytes]:
    out, last = [], b""
    for p, r in zip(prefix, rests, strict=True):
        last = last[:p] + r
        out.append(last)
    return out


def loser_merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (strings, common prefix lengths). Returns (run, index) in order, and each one's common prefix with its predecessor."""
    k = 1
    while k < max(2, len(runs)):
        k *= 2
    heads: list[bytes | None] = [runs[i][0][0] if i < len(runs) and runs[i][0] else None for i in range(k)]
    at = [0] * k
    known = [0 if x is not None else -1 for x in heads]
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two players that share known[...] bytes with one and the same string."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if heads[a] is None:
            return a, b
        x, y = heads[a], heads[b]
        n = _shared(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    tree = [0] * (2 * k)
    for i in range(k):
        tree[k + i] = i
    for i in range(k - 1, 0, -1):
        tree[i], loser[i] = play(tree[2 * i], tree[2 * i + 1])
    best = tree[1]
    order, common = [], []
    while heads[best] is not None:
        order.append((best, at[best]))
        common.append(known[best])
        at[best] += 1
        strings, prefix = runs[best]
        if at[best] < len(strings):
            heads[best], known[best] = strings[at[best]], prefix[at[best]]
        else:
            heads[best], known[best] = None, -1
        i = (k + best) // 2
        while i:
            best, loser[i] = play(best, loser[i])
            i //= 2
    return order, common


_RUNS = "part int, n int, prefix binary, rests binary, heads binary, d binary, h binary, place binary"


def _pack(part: int, own: list[tuple[bytes, bytes, int, int, int]]) -> dict:
    """A front-coded run of (suffix, reversed head, d, h, place)."""
    own.sort(key=lambda x: x[0])
    prefix, rests = front_code([x[0] for x in own])
    return {"part": part, "n": len(own), "prefix": prefix.tobytes(), "rests": b"".join(rests), "heads": b"".join(x[1] for x in own), "d": np.array([x[2] for x in own], dtype=np.int64).tobytes(), "h": np.array([x[3] for x in own], dtype=np.int64).tobytes(), "place": np.array([x[4] for x in own], dtype=np.int64).tobytes()}


def _unpack(row: dict) -> tuple[list[bytes], list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    place = np.frombuffer(row["place"], dtype=np.int64)
    prefix = np.frombuffer(row["prefix"], dtype=np.int32)
    n, distance = place >> 8 & 255, place & 255
    cut = np.concatenate(([0], np.cumsum(n - 1 + LENGTH - distance - prefix))).tolist()
    head = np.concatenate(([0], np.cumsum(distance))).tolist()
    rests = [row["rests"][a:b] for a, b in zip(cut, cut[1:], strict=False)]
    heads = [row["heads"][a:b] for a, b in zip(head, head[1:], strict=False)]
    return front_decode(prefix.tolist(), rests), prefix.tolist(), heads, np.frombuffer(row["d"], dtype=np.int64), np.frombuffer(row["h"], dtype=np.int64), place


def repeated_windows(order_prefix: np.ndarray, head_rank: np.ndarray, head_prefix: np.ndarray, n: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """For blocks in suffix order: which windows, by distance to the anchor, are found in two blocks at least.

    order_prefix: common prefix with the predecessor; head_rank: rank of each block's reversed head; head_prefix: by rank, the head's common
    prefix with its predecessor.
    """
    size = len(n)
    out = np.zeros((size, SPAN), dtype=bool)
    for back in range(SPAN):
        valid = np.flatnonzero((distance - n + 1 <= back) & (back <= distance))
        if len(valid) < 2:
            continue
        suffix = np.cumsum(order_prefix < LENGTH - back)
        head = np.cumsum(head_prefix < back)[head_rank]
        _, inverse, times = np.unique(suffix[valid].astype(np.int64) * (size + 1) + head[valid], return_inverse=True, return_counts=True)
        out[valid, back] = times[inverse] > 1
    return out


def _merge_part(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (d, h, start, end) of the repeated windows among the runs of one part."""
    runs = [_unpack(r) for r in rows]
    order, common = loser_merge([(r[0], r[1]) for r in runs])
    which = np.array([a for a, _ in order])
    index = np.array([b for _, b in order])
    first = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs])))[which] + index
    d, h, place = (np.concatenate([r[i] for r in runs])[first] for i in (3, 4, 5))
    heads = [runs[a][2][b] for a, b in order]
    ranked = sorted(range(len(heads)), key=heads.__getitem__)
    head_prefix = np.zeros(len(heads), dtype=np.int64)
    for i in range(1, len(ranked)):
        head_prefix[i] = _shared(heads[ranked[i - 1]], heads[ranked[i]], 0)
    head_rank = np.empty(len(heads), dtype=np.int64)
    head_rank[ranked] = np.arange(len(heads))
    start, n, distance = place >> 16, place >> 8 & 255, place & 255
    hit = repeated_windows(np.array(common, dtype=np.int64), head_rank, head_prefix, n, distance)
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    anchor = start[row] + distance[row]
    return d[row], h[row], anchor - (past - 1), anchor - low + LENGTH


def _listed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """Row key, text and places of each row."""
    for at, size in ranges(batch.column(2)):
        for d, h, text, places in zip(*(batch.column(i).slice(at, size).to_pylist() for i in range(4)), strict=True):
            yield d, h, text.encode("utf-8", "surrogatepass"), places


def _runs(listed: DataFrame, parts: int) -> DataFrame:
    """Front-coded runs of the blocks listed beside each text, by part."""
    arrow = to_arrow(listed.sparkSession, _RUNS)

    def flush(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        rows = [_pack(part, own) for part, own in held.items()]
        held.clear()
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[i : i + 64], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for d, h, raw, places in _listed(batch):
                for place in places:
                    start, n, distance = place >> 16, place >> 8 & 255, place & 255
                    anchor, stop = start + distance, start + n - 1 + LENGTH
                    part = xxhash.xxh3_64_intdigest(raw[anchor : anchor + GRAM], 7) % parts
                    held.setdefault(part, []).append((raw[anchor:stop], raw[start:anchor][::-1], d, h, place))
                    size += stop - start + 200
            if size > RUN_BYTES:
                yield from flush(held)
                size = 0
        if held:
            yield from flush(held)

    return listed.mapInArrow(run, _RUNS)


_SPANS = "d bigint, h bigint, start bigint, stop bigint"


def _merged(runs: DataFrame, parts: int) -> DataFrame:
    arrow = to_arrow(runs.sparkSession, _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by.setdefault(row["part"], []).append(row)
        while by:
            d, h, start, stop = _merge_part(by.popitem()[1])
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(h), pa.array(start), pa.array(stop)], schema=arrow)

    return runs.repartitionById(parts, F.col("part")).mapInArrow(run, _SPANS)


def _by_digest(listed: DataFrame) -> DataFrame:
    """Spans of the windows of hot grams, by counting 128-bit digests of windows."""
    schema = "d bigint, h bigint, at bigint, w1 bigint, w2 bigint"
    arrow = to_arrow(listed.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, h, raw, places in _listed(batch):
                at = np.concatenate([np.arange(p >> 16, (p >> 16) + (p >> 8 & 255)) for p in places])
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in at.tolist()), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d)), pa.array(np.full(len(at), h)), pa.array(at), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], schema=arrow)

    windows = listed.mapInArrow(run, schema)
    twice = checkpointed(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"))
    return windows.join(twice, ["w1", "w2"]).select("d", "h", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("stop"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(keyed texts, spans of repeated bytes by row key). Spans may overlap and touch."""
    spark = docs.sparkSession
    small_batches(spark)
    given, text = F.col(id_col).cast("string"), F.col(text_col)
    d, h = (F.xxhash64(F.lit(seed), given.isNull(), given, text.isNull(), text) for seed in (1, 2))
    keyed = docs.select(F.col(id_col).alias("id"), d.alias("d"), h.alias("h"), text.alias("text"))
    found = sampled(keyed)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("whole", "more") for f in (F.min, F.max)]
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), *ends).filter("n > 1")
    one = (F.col("min_whole") == F.col("max_whole")) & (F.col("min_more") == F.col("max_more"))
    kind = F.when(one, F.lit(0)).when(F.col("n") <= hot, F.lit(1)).otherwise(F.lit(2))
    # Written first: then both sides of the join are plain exchanges, which adaptive execution can split at a hot gram.
    shared = found.join(written(grams.select("gram", kind.alias("kind")), "grams"), "gram")
    places = [F.expr(f"collect_set(CASE WHEN kind = {k} THEN place END)").alias(f"k{k}") for k in range(3)]
    listed = written(shared.groupBy("d", "h").agg(*places), "places")
    merged = listed.agg(F.sum(F.size("k1"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-merged // MERGED))

    def beside(k: int) -> DataFrame:
        return keyed.join(listed.filter(F.size(f"k{k}") > 0).select("d", "h", f"k{k}"), ["d", "h"]).select("d", "h", "text", f"k{k}")

    spans = listed.select("d", "h", F.explode("k0").alias("p")).select("d", "h", F.shiftright("p", 16).alias("start"), (F.shiftright("p", 16) + F.shiftright("p", 8).bitwiseAND(F.lit(255)) + (LENGTH - 1)).alias("stop"))
    spans = spans.unionByName(_merged(_runs(beside(1), parts), parts))
    if listed.filter(F.size("k2") > 0).limit(1).count():
        spans = spans.unionByName(_by_digest(beside(2)))
    return keyed, spans


def _kept(raw: bytes, spans: list) -> tuple[bytes, int, int]:
    """The bytes that stay, how many went, in how many runs."""
    if not spans:
        return raw, 0, 0
    keep, at, removed, runs = [], 0, 0, 0
    last = -1
    for s, e in sorted(spans):
        if s > last:
            runs += 1
            keep.append(raw[at:s])
            removed += e - s
            last = at = e
        elif e > last:
            removed += e - last
            last = at = e
    return b"".join([*keep, raw[at:]]), removed, runs


_OUT = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """A row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, the remaining bytes."""
    keyed, spans = repeated_spans(docs, id_col, text_col, hot)
    lists = spans.groupBy("d", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string, kept: binary>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip((t for some in slices(texts) for t in some), spans, strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            pairs = s.values.flatten() if s.is_valid else []
            kept, removed, runs = _kept(raw, list(zip(pairs[0].to_pylist(), pairs[1].to_pylist(), strict=True)) if len(pairs) else [])
            rows.append({"n_bytes": len(raw), "n_removed": removed, "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_bytes else None})
        return pa.array(rows, type=_OUT)

    out = keyed.join(lists, ["d", "h"], "left").select(F.col("id").alias(id_col), cut("text", "spans").alias("__cut"))
    return out.select(id_col, *[F.col(f"__cut.{f.name}").alias(f.name) for f in _OUT if with_bytes or f.name != "kept"])
