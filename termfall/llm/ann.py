"""Approximate nearest neighbours over randomly rotated one-bit codes, in cells.

Fitting. A sample of at most SAMPLE vectors of each length (SAMPLE_BYTES at most; those of the least hashed ids) gives the centres of the cells by
k-means, about one for CELL vectors, and is itself broadcast. How many cells a query must visit is measured on the sample: the least
number that holds the share TARGET of the true neighbours of PILOTS of its vectors. Vectors in clusters need few cells; of vectors
without structure most cells must be visited, and no index avoids that.

Index. Every vector belongs to the cell of its nearest centre. Its residual is padded with zeros to at least EXPAND times its length, turned
by a random rotation (sign flips and Hadamard transforms, ROUNDS times) and kept as its signs, packed to bits, with two correction scalars: the residual's
length, and how well the signs stand for its direction. codes() gives a row per vector; blocks() packs them into rows of
one cell of about BLOCK vectors each, beside the vectors themselves for reranking.

Search. A query is ranked exactly against the sample, which gives a lower bound for its k-th best score, then sent to the blocks of its cells.
There its inner products are estimated from the packed bits by counting bits: the rotated query is rounded to PLANES bits, and each plane
is met with the codes by AND and popcount. Only vectors whose estimate plus its error bound reaches the k-th best score known
are fetched from the block and scored exactly, in double precision. Each block returns k at most.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries or candidates; vectors of
different lengths are not compared; ties go to the smaller id; fewer than k candidates give them all; a query's own row
is no candidate, but a repeated row with another id is; rows that share an id count once, with their best score; rows with a null id
take no part; an empty table gives an empty table; extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, to_arrow, written

SEED = 7
#: Vectors of a sample at most, and their bytes; vectors of a cell and of a block, about; cells at most.
SAMPLE, SAMPLE_BYTES, CELL, BLOCK, MOST_CELLS = 16_384, 64 << 20, 1_024, 2_048, 2_048
#: Steps of k-means; vectors of the sample that ask for their neighbours in it; share of those that must lie in the visited cells.
STEPS, PILOTS, TARGET = 8, 512, 0.98
#: Bits of a code by component, at least; rounds of the rotation; bits that a component of a query is rounded to.
EXPAND, ROUNDS, PLANES = 4, 3, 5
#: The error bound holds with a probability that rises with this factor.
EPSILON = 2.2
#: Queries that are packed together, and queries that meet a block at a time.
QUERIES, STEP = 512, 32


def code_length(dim: int) -> int:
    """Bits of a code: a power of two, 64 at least."""
    return max(64, 1 << (EXPAND * dim - 1).bit_length())


@lru_cache(8)
def _flips(bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, bits]).integers(0, 2, (ROUNDS, bits)).astype(np.float32) * 2 - 1


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Padded and rotated vectors; inner products stay as they were."""
    n, dim = vectors.shape
    bits = code_length(dim)
    x = np.zeros((n, bits), dtype=np.float32)
    x[:, :dim] = vectors
    for flips in _flips(bits):
        x *= flips
        half = 1
        while half < bits:
            pairs = x.reshape(n, bits // (2 * half), 2, half)
            x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, bits)
            half *= 2
        x /= np.float32(bits**0.5)
    return x


def encode(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (bytes), lengths, and the inner product of each unit residual with its unit sign vector."""
    length = np.linalg.norm(residuals, axis=1)
    turned = rotate(residuals)
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / np.maximum(length, 1e-30)
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, fit, 1.0)


@dataclass(frozen=True)
class Asked:
    """Queries made ready: exact ones, bit planes [plane, query, word], and what turns counts of bits into inner products."""

    vectors: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    norm: np.ndarray
    loss: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Asked:
        turned = rotate(vectors)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-30)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        rounded = low[:, None] + step[:, None] * level
        planes = np.stack([np.packbits(level >> p & 1, axis=1).view(np.uint64) for p in range(PLANES)])
        return cls(vectors, planes, low, step, rounded.sum(axis=1), np.linalg.norm(vectors, axis=1), np.linalg.norm(turned - rounded, axis=1))


def estimate(asked: Asked, some: slice, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products [query, vector] of some queries with coded vectors of a cell, and their error bounds. bits: [word, vector]."""
    size = 64 * len(bits)
    common = np.bitwise_count(bits).sum(axis=0, dtype=np.float32)
    planes = asked.planes[:, some]
    counts = np.zeros((planes.shape[1], bits.shape[1]), dtype=np.float32)
    for p, plane in enumerate(planes):
        met = np.zeros(counts.shape, dtype=np.uint16)
        for w, word in enumerate(bits):
            met += np.bitwise_count(plane[:, w, None] & word)
        counts += np.float32(1 << p) * met
    signs = 2 * (asked.low[some, None] * common + asked.step[some, None] * counts) - asked.total[some, None]
    guess = (asked.vectors[some] @ centre).astype(np.float32)[:, None] + signs * (length / fit / size**0.5)
    error = np.sqrt(asked.norm[some, None] ** 2 * (1 - np.minimum(fit, 1) ** 2) + asked.loss[some, None] ** 2) * (length / fit * EPSILON / (size - 1) ** 0.5)
    return guess, error + 1e-5 * asked.norm[some, None] * (length + np.linalg.norm(centre)) + 1e-12


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (vectors * query).sum(axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id; one for each id."""
    order = np.lexsort((ids, -scores))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]


def search_block(query_ids: np.ndarray, asked: Asked, bounds: np.ndarray, ids: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, vectors: np.ndarray, centre: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
    """([query ids, ids, scores] of what reaches each query's bound, k at most; how many vectors were scored exactly)."""
    out: list[list[np.ndarray]] = [[], [], []]
    reranked = 0
    words = np.ascontiguousarray(bits.view(np.uint64).T)
    for at in range(0, len(query_ids), STEP):
        some = slice(at, min(at + STEP, len(query_ids)))
        guess, error = estimate(asked, some, words, length, fit, centre)
        near = guess + error >= bounds[some, None]
        for i in range(some.stop - at):
            rows = np.flatnonzero(near[i])
            reranked += len(rows)
            scores = exact(vectors[rows], asked.vectors[at + i])
            fine = (scores >= bounds[at + i]) & (ids[rows] != query_ids[at + i])
            rows, scores = rows[fine], scores[fine]
            best = _best(scores, ids[rows], k)
            for x, values in zip(out, (np.full(len(best), query_ids[at + i]), ids[rows][best], scores[best]), strict=True):
                x.append(values)
    return [np.concatenate(x) if x else np.zeros(0) for x in out], reranked


@dataclass(frozen=True)
class Cells:
    """What is fitted on a sample of vectors of one length: centres, spread and blocks of each cell, cells that a query visits, the sample."""

    centres: np.ndarray
    spread: np.ndarray
    blocks: np.ndarray
    visits: int
    ids: np.ndarray
    vectors: np.ndarray

    @classmethod
    def fit(cls, ids: np.ndarray, vectors: np.ndarray, n: int, k: int) -> Cells:
        """From a sample of n vectors."""
        r = np.random.default_rng(SEED)
        ids, first = np.unique(ids, return_index=True)
        vectors = vectors[first]
        size = max(1, min(MOST_CELLS, round(n / CELL), len(ids) // 8))
        centres = vectors[r.permutation(len(ids))[:size]]
        for _ in range(STEPS):
            cell = nearest(centres, vectors)
            count = np.bincount(cell, minlength=size)
            sums = np.zeros_like(centres)
            np.add.at(sums, cell, vectors)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        cell = nearest(centres, vectors)
        off = ((vectors - centres[cell]) ** 2).mean(axis=1)
        count = np.bincount(cell, minlength=size)
        spread = np.sqrt(np.bincount(cell, off, minlength=size) / np.maximum(count, 1))
        blocks = np.maximum(1, np.ceil(count * (n / len(ids)) / BLOCK)).astype(np.int64)
        out = cls(centres, spread, blocks, size, ids, vectors)
        pilots = r.permutation(len(ids))[:PILOTS]
        scores = vectors[pilots] @ vectors.T
        scores[np.arange(len(pilots)), pilots] = -np.inf
        true = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(ids) - 1))]
        place = np.argsort(out.order(vectors[pilots]), axis=1)[np.arange(len(pilots))[:, None], cell[true]]
        return cls(centres, spread, blocks, int(np.quantile(place, TARGET, method="higher")) + 1, ids, vectors)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Cells of each query, the most promising first."""
        return np.argsort(-(queries @ self.centres.T + 2 * np.linalg.norm(queries, axis=1)[:, None] * self.spread), axis=1, kind="stable")

    def first(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """[query ids, ids, scores] of the k best of the sample, and each query's k-th best score (-inf: there are fewer)."""
        out: list[list[np.ndarray]] = [[], [], []]
        bounds = np.full(len(queries), -np.inf)
        rough = queries @ self.vectors.T
        for i, q in enumerate(queries):
            need = min(k, len(self.ids) - 1)
            rows = np.flatnonzero(rough[i] >= np.partition(rough[i], len(self.ids) - 1 - need)[len(self.ids) - 1 - need] - 1e-9 * (1 + abs(rough[i]).max()))
            rows = rows[self.ids[rows] != query_ids[i]]
            scores = exact(self.vectors[rows], q)
            best = _best(scores, self.ids[rows], k)
            if len(best) == k:
                bounds[i] = scores[best[-1]]
            for x, values in zip(out, (np.full(len(best), query_ids[i]), self.ids[rows][best], scores[best]), strict=True):
                x.append(values)
        return [np.concatenate(x) for x in out], bounds


def nearest(centres: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(vectors[at : at + 4096] @ centres.T - half, axis=1) for at in range(0, len(vectors), 4096)])


def valid_vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v) that take part, components as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return frame.filter(fine).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def fit(rows: DataFrame, k: int) -> dict[int, Cells]:
    """Cells for each length of vectors in use, from its sample."""
    out = {}
    for dim, n in sorted(map(tuple, rows.groupBy(F.size("v")).agg(F.count("*")).collect())):  # a row for each length
        size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        place = F.xxhash64(F.lit(SEED), "id")
        # Most rows are left out where they lie; so many more than needed pass that enough do.
        share = F.pmod(place, F.lit(1 << 40)) < F.lit(int(min(1.0, (size + 8 * size**0.5 + 50) / n) * (1 << 40)))
        some = rows.filter((F.size("v") == dim) & share).orderBy(place, "id").limit(size).toArrow()
        out[dim] = Cells.fit(some["id"].to_numpy(), np.array(some["v"].combine_chunks().flatten()).reshape(-1, dim), n, k)
    return out


def _by_length(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of one length at a time: length, ids, vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            ids, lists = batch.column(0).slice(at, most).to_numpy(zero_copy_only=False), batch.column(1).slice(at, most)
            flat, size = np.array(lists.flatten()), lists.value_lengths().to_numpy(zero_copy_only=False)
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                yield dim, ids[own], flat[start[own][:, None] + np.arange(dim)]


_CODES = "dim int, cell int, block bigint, id bigint, bits binary, length double, fit double, v binary"


def _coded(rows: DataFrame, cells: dict[int, Cells], with_vectors: bool) -> DataFrame:
    arrow = to_arrow(rows.sparkSession, _CODES)
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, vectors in _by_length(batches, 4096):
            own = shared.value[dim]
            cell = nearest(own.centres, vectors)
            bits, length, fitted = encode(vectors - own.centres[cell])
            block = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % own.blocks[cell]
            columns = [np.full(len(ids), dim, dtype=np.int32), cell.astype(np.int32), block, ids, [b.tobytes() for b in bits], length, fitted, [v.tobytes() for v in vectors] if with_vectors else [None] * len(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, _CODES)


def codes(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """The index: a row (dim, cell, block, id, bits, length, fit) for every vector that takes part."""
    small_batches(frame.sparkSession)
    rows = valid_vectors(frame, id_col, vector_col)
    return _coded(rows, fit(rows, k), with_vectors=False).drop("v")


_BLOCKS = "dim int, cell int, block bigint, ids binary, bits binary, length binary, fit binary, vectors binary"


def blocks(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """The index packed: a row for each block of a cell."""
    arrow = to_arrow(rows.sparkSession, _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            join = lambda i: b"".join(x.as_py() for x in t.column(i))
            row = {k: t.column(i)[0].as_py() for i, k in enumerate(("dim", "cell", "block"))}
            row |= {"ids": t.column(3).to_numpy().tobytes(), "bits": join(4), "length": t.column(5).to_numpy().tobytes(), "fit": t.column(6).to_numpy().tobytes(), "vectors": join(7)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cuts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                now = tuple(key[:, s].tolist())
                if held and (now != last or sum(b.num_rows for b in held) >= 2 * BLOCK):
                    yield packed(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = now
        if held:
            yield packed(held)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(int(c.blocks.sum()) for c in cells.values()) // 16)
    coded = _coded(rows, cells, with_vectors=True)
    return coded.repartition(parts, "dim", "cell", "block").sortWithinPartitions("dim", "cell", "block").mapInArrow(run, _BLOCKS)


_ASKED = "dim int, cell int, block bigint, qids binary, bounds binary, qvectors binary, query_id bigint, vec_id bigint, score double"


def _questions(asked: DataFrame, cells: dict[int, Cells], k: int) -> DataFrame:
    """Queries packed for the blocks that they visit; and, with a null dim, what they find in the sample."""
    arrow = to_arrow(asked.sparkSession, _ASKED)
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, vectors in _by_length(batches, QUERIES):
            own = shared.value.get(dim)
            if own is None:
                continue
            found, bounds = own.first(ids, vectors, k)
            none = [None] * len(found[0])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*[none] * 6, *found], arrow, strict=True)], schema=arrow)
            visited = own.order(vectors)[:, : own.visits]
            for cell in np.unique(visited).tolist():
                q = np.flatnonzero((visited == cell).any(axis=1))
                row = {"dim": dim, "cell": cell, "qids": ids[q].tobytes(), "bounds": bounds[q].tobytes(), "qvectors": vectors[q].tobytes()}
                yield pa.RecordBatch.from_pylist([{**row, "block": b} for b in range(int(own.blocks[cell]))], schema=arrow)

    return asked.mapInArrow(run, _ASKED)


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by inner product, but for the row of its own id."""
    spark = candidates.sparkSession
    small_batches(spark)
    rows, asked = valid_vectors(candidates, id_col, vector_col), valid_vectors(queries, id_col, vector_col)
    cells = fit(rows, k)
    questions = written(_questions(asked, cells, k), "questions")
    pairs = blocks(rows, cells).join(questions.filter("dim IS NOT NULL").drop("query_id", "vec_id", "score"), ["dim", "cell", "block"])
    shared = spark.sparkContext.broadcast({dim: c.centres for dim, c in cells.items()})
    schema = "query_id bigint, vec_id bigint, score double"
    arrow = to_arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}
                dim, centre = row["dim"].as_py(), shared.value[row["dim"].as_py()][row["cell"].as_py()]
                read = lambda name, kind=np.float64, row=row: np.frombuffer(row[name].as_buffer(), kind)
                bits = read("bits", np.uint8).reshape(-1, code_length(dim) // 8)
                found, _ = search_block(read("qids", np.int64), Asked.of(read("qvectors").reshape(-1, dim)), read("bounds"), read("ids", np.int64), bits, read("length"), read("fit"), read("vectors").reshape(-1, dim), centre, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)

    found = pairs.select("dim", "cell", "qids", "bounds", "qvectors", "ids", "bits", "length", "fit", "vectors").mapInArrow(run, schema)
    found = found.unionByName(questions.filter("dim IS NULL").select("query_id", "vec_id", "score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
