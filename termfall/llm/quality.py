"""Quality rules: counted rules plus perplexity under a modified Kneser-Ney model of characters per language.

The model has n-grams of ORDER code points, kept apart by case, digit and sign. It is a table that grows with the corpus and is not
broadcast; documents meet the part of it that they ask for:

1. Texts are packed into chunks of one language (compressed Arrow streams of about CHUNK bytes, one row each).
2. Each chunk counts its distinct n-grams, and in how many texts each is found. Sums over the chunks are the corpus counts. An n-gram is
   two longs, so contexts and suffixes are shifts and masks.
3. Spark turns counts into probabilities, level by level: raw counts at the top, counts of distinct characters to the left below,
   three discounts per language and level, interpolation down to the uniform distribution. n-grams found in one text only
   don't count (a text's own would vouch for it); they are asked for, and back off.
4. The probabilities go back to the chunks that asked. The most frequent n-grams, which nearly all chunks ask for, are broadcast, HEAD at most;
   the others come by a plain join. A chunk's part of the model is two sorted arrays, hashed keys and log probabilities, probed by
   vectorised binary search at each position of its texts.

A document is rejected when a counted rule fails or when its mean negative log probability per character leaves its language's
band. A text of L characters deviates by chance as sqrt(1 / L + 1 / LONG) does; with that as unit, the band reaches from the median
BELOW scales down and ABOVE scales up, a scale being 1.4826 times the median absolute deviation, LEAST_SCALE at least. Medians are taken over
all documents of the language that pass the counted rules. The reaches were set on labelled rows: the README has the share of clean
and of bad documents beyond them.

Edge cases: null and empty texts have no words and fail the base rule; a null language is a language of its own, the
empty string; a text of whitespace only has no words; texts are read whole; repeated rows count as often as they stand there;
an empty table gives an empty table; a language whose documents all fail the counted rules has no band and rejects nothing
more; extra columns are passed by (score_quality) or kept (keep_quality).
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import few, joined, map_slices, pieces, shared_dir, size_of, slices, small_batches, to_arrow, written

ORDER = 5
#: Bytes of text in a chunk, about, and in an input task at least (as files hold them).
CHUNK, TASK = 32 << 20, 48 << 20
#: n-grams that are broadcast: those whose count reaches the least power of two that so many don't exceed.
HEAD = 1 << 20
#: Documents with fewer words fail.
LEAST_WORDS = 50
#: Reach of a band below and above the median, in scales; the least scale; characters beyond which a text's deviation hardly falls.
BELOW, ABOVE, LEAST_SCALE, LONG = 5.0, 6.0, 0.2, 5_000
#: Bytes of texts, and characters of a long text, that are worked on at a time.
SLICE, WINDOW = 1 << 20, 1_000_000
#: n-grams of slices that are held before they are summed.
MERGED = 1 << 18

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Stands before a text's first character.
_PAD = "\n" * (ORDER - 1)
#: Bits of a code point in a packed n-gram: its first two characters are in `hi`, the last three in `lo`.
_BITS = 21
_MASK = (1 << _BITS) - 1


def _packed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hi and lo of the n-gram that ends at each position from the fifth on."""
    p = points.astype(np.int64)
    n = len(p) - ORDER + 1
    return p[:n] << _BITS | p[1 : n + 1], p[2 : n + 2] << 2 * _BITS | p[3 : n + 3] << _BITS | p[4 : n + 4]


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' code points, each behind a pad; where the n-gram of each character begins; the text each belongs to."""
    points = np.frombuffer((_PAD + _PAD.join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return points, np.arange(len(owner)) + (ORDER - 1) * owner, owner


def _windows(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """hi and lo of a long text's n-grams, part by part."""
    padded = _PAD + text
    for at in range(0, len(text), WINDOW):
        yield _packed(np.frombuffer(padded[at : at + WINDOW + ORDER - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32))


def _summed(hi: np.ndarray, lo: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct n-grams in order, and the sums of each further array over them."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    return hi[first], lo[first], *[np.add.reduceat(m[order], first) for m in more]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hi, lo, count and number of texts of each distinct n-gram of non-empty texts."""
    if len(texts) == 1 and len(texts[0]) > WINDOW:
        found = [_summed(*x, np.ones(len(x[0]), dtype=np.int64)) for x in _windows(texts[0])]
        hi, lo, n = _summed(*map(np.concatenate, zip(*found, strict=True)))
        return hi, lo, n, np.ones(len(n), dtype=np.int64)
    points, at, owner = _laid(texts)
    # Characters by number: few enough of them let n-gram and text share one integer, which sorts fast.
    signs = np.flatnonzero(np.bincount(points))
    base = len(signs)
    if base**ORDER * len(texts) < 1 << 63:
        rank = np.zeros(int(signs[-1]) + 1, dtype=np.int64)
        rank[signs] = np.arange(base)
        x = rank[points]
        size = len(x) - ORDER + 1
        code = x[:size].copy()
        for k in range(1, ORDER):
            code *= base
            code += x[k : size + k]
        both = np.sort(code[at] * len(texts) + owner)
        code = both // len(texts)
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        texts_of = np.add.reduceat(np.concatenate(([1], (both[1:] != both[:-1]).astype(np.int64))), first)
        n, code = np.diff(np.append(first, len(code))), code[first]
        c = [signs[code // base**k % base].astype(np.int64) for k in range(ORDER - 1, -1, -1)]
        return c[0] << _BITS | c[1], c[2] << 2 * _BITS | c[3] << _BITS | c[4], n, texts_of
    hi, lo = (v[at] for v in _packed(points))
    order = np.lexsort((owner, lo, hi))
    hi, lo, owner = hi[order], lo[order], owner[order]
    new = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
    first = np.flatnonzero(new)
    other = new | np.concatenate(([True], owner[1:] != owner[:-1]))
    return hi[first], lo[first], np.diff(np.append(first, len(hi))), np.add.reduceat(other.astype(np.int64), first)


def _key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The 64-bit hash of packed n-grams."""
    x = hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ lo.view(np.uint64)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Part:
    """A part of a model: sorted hashes of n-grams and their log probabilities.

    Where the hashes of each head of bits begin is kept, so that a binary search is left with the few that share a head.
    """

    def __init__(self, keys: np.ndarray, log_probs: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], log_probs[order]
        bits = max(8, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Where each hash stands; -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(asked), -1)
        at = np.minimum(self.starts[asked >> self.shift], len(self.keys) - 1)
        rest = np.flatnonzero(self.keys[at] != asked)
        at[rest] = found = np.minimum(np.searchsorted(self.keys, asked[rest]), len(self.keys) - 1)
        at[rest[self.keys[found] != asked[rest]]] = -1
        return at

    def of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Log probabilities; every n-gram must be there."""
        at = self.find(_key(hi, lo))
        if len(at) and at.min() < 0:
            raise LookupError("an n-gram that was not asked for")
        return self.values[at]

    def sums(self, texts: list[str]) -> np.ndarray:
        """The summed log probabilities of each non-empty text."""
        if len(texts) == 1 and len(texts[0]) > WINDOW:
            return np.array([sum(float(self.of(*x).sum(dtype=np.float64)) for x in _windows(texts[0]))])
        points, at, owner = _laid(texts)
        hi, lo = (v[at] for v in _packed(points))
        return np.bincount(owner, self.of(hi, lo), minlength=len(texts))


def _stored(batches: list[pa.RecordBatch]) -> bytes:
    """Batches as one compressed Arrow stream. Block sorting packs texts best, and they travel twice."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batches[0].schema) as writer:
        for b in batches:
            writer.write_batch(b)
    return bz2.compress(out.getvalue())


def _read(stored: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(bz2.decompress(stored.as_buffer())).read_all().combine_chunks()


_CHUNKS = "chunk bigint, lang string, rows binary, hi bigint, lo bigint, n bigint, texts bigint"


def chunks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, text, ...) packed by task and language: (chunk, lang, rows), and the distinct n-grams of each chunk.

    The latter are (chunk, lang, hi, lo, n, texts); texts stops at 2. Both come of one pass and lie in one table.
    """
    arrow = to_arrow(rows.sparkSession, _CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, list[pa.RecordBatch]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            number += 1
            size.pop(lang)
            own = held.pop(lang)
            none = {"hi": None, "lo": None, "n": None, "texts": None}
            yield pa.RecordBatch.from_pylist([{"chunk": number, "lang": lang, "rows": _stored(own), **none}], schema=arrow)
            whole = pa.chunked_array([b.column(1) for b in own]).combine_chunks()
            own.clear()
            found: list[tuple[np.ndarray, ...]] = []
            for some in slices(whole, SLICE):
                if texts := [t for t in some if t]:
                    found.append(ngrams(texts))
                    # Sums so far: never many times the chunk's distinct n-grams.
                    if sum(len(x[0]) for x in found[1:]) > max(MERGED, len(found[0][0])):
                        found = [_summed(*map(np.concatenate, zip(*found, strict=True)))]
            del whole
            if found:
                hi, lo, n, texts_of = _summed(*map(np.concatenate, zip(*found, strict=True)))
                found.clear()
                yield from pieces({"chunk": np.full(len(hi), number), "lang": [lang] * len(hi), "rows": [None] * len(hi), "hi": hi, "lo": lo, "n": n, "texts": np.minimum(texts_of, 2)}, arrow)

        for batch in batches:
            which = batch.column(0).dictionary_encode()
            for i, lang in enumerate(which.dictionary.to_pylist()):
                own = batch.filter(pc.equal(which.indices, i))
                held.setdefault(lang, []).append(own)
                size[lang] = size.get(lang, 0) + own.nbytes
                if size[lang] >= CHUNK:
                    yield from flush(lang)
            while sum(size.values()) > CHUNK + CHUNK // 2:
                yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)
        # The worker goes on to other tasks.
        pa.default_memory_pool().release_unused()

    spark = rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size_of(rows) // TASK))
    both = written(rows.coalesce(tasks).mapInArrow(run, _CHUNKS), "chunks")
    return both.filter("rows IS NOT NULL").select("chunk", "lang", "rows"), both.filter("rows IS NULL").drop("rows")


def _discounts(counted: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the discounts for counts of 1, 2 and 3 or more of (lang, c)."""
    n = counted.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y = F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5)
    raw = [F.when(n1 > 0, 1 - 2 * y * n2 / n1).otherwise(0.5), F.when(n2 > 0, 2 - 3 * y * n3 / n2).otherwise(1.0), F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(1.5)]
    return n.select("lang", *[F.least(F.greatest(d, F.lit(0.1)), F.lit(0.95 * k)).alias(f"d{k}") for k, d in enumerate(raw, 1)])


#: By level (n-grams of so many characters): the columns that tell an n-gram, its context and its suffix.
def _keys(level: int) -> tuple[list[Column], list[Column], list[Column]]:
    hi, lo = F.col("hi"), F.col("lo")
    kept = {5: [hi, lo], 4: [hi.bitwiseAND(F.lit(_MASK)), lo], 3: [F.lit(0).cast("bigint"), lo], 2: [F.lit(0).cast("bigint"), lo.bitwiseAND(F.lit((1 << 2 * _BITS) - 1))], 1: [F.lit(0).cast("bigint"), lo.bitwiseAND(F.lit(_MASK))]}
    own = kept[level]
    return own, [own[0], F.shiftright(own[1], _BITS)], kept[level - 1] if level > 1 else []


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, hi, lo, c, p) of counts (lang, hi, lo, c): modified Kneser-Ney; n-grams with c = 0 are asked for only."""
    # A row for each language: broadcast unless there are very many.
    small = F.broadcast if few(counts.select("lang").distinct()) else (lambda df: df)
    levels = {ORDER: counts.select("lang", "hi", "lo", "c")}
    for k in range(ORDER - 1, 0, -1):
        hi, lo = _keys(k)[0]
        levels[k] = levels[k + 1].groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.count_if(F.col("c") > 0).alias("c"))
    below = None
    for k in range(1, ORDER + 1):
        own, context, suffix = _keys(k)
        rows = levels[k].join(small(_discounts(levels[k])), "lang")
        c = F.col("c")
        cut = F.when(c >= 3, F.col("d3")).when(c == 2, F.col("d2")).when(c == 1, F.col("d1")).otherwise(0.0)
        # A context's n-grams are as many as there are characters, at most.
        by = Window.partitionBy("lang", *context)
        # Whole numbers are summed, so the order of rows makes no difference.
        ones, twos, more = (F.count_if(x).over(by) for x in (c == 1, c == 2, c >= 3))
        rows = rows.withColumns({"cut": cut, "total": F.sum("c").over(by), "cuts": F.col("d1") * ones + F.col("d2") * twos + F.col("d3") * more, "signs": F.count("*").over(by)})
        gamma = F.when(F.col("total") > 0, F.col("cuts") / F.col("total")).otherwise(1.0)
        mine = F.when(c > 0, (c - F.col("cut")) / F.col("total")).otherwise(0.0)
        if below is None:
            below = rows.select("lang", "hi", "lo", "c", (mine + gamma / F.col("signs")).alias("p"))
        else:
            rows = rows.select("lang", "hi", "lo", "c", mine.cast("float").alias("mine"), gamma.cast("float").alias("gamma"))
            low = below.select(F.col("lang").alias("slang"), F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("sp"))
            rows = rows.join(low, (F.col("lang") == F.col("slang")) & (suffix[0] == F.col("shi")) & (suffix[1] == F.col("slo")))
            below = rows.select("lang", "hi", "lo", "c", (F.col("mine") + F.col("gamma") * F.col("sp")).alias("p"))
    return below


def fit(found: DataFrame) -> DataFrame:
    """The model (lang, hi, lo, c, lp) of the chunks' n-grams: a row for each that is found anywhere, with its log probability."""
    sums = found.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    counts = written(sums.select("lang", "hi", "lo", F.when(F.col("texts") > 1, F.col("n")).otherwise(0).alias("c")), "counts", release=True)
    return written(probabilities(counts).select("lang", "hi", "lo", "c", F.log("p").cast("float").alias("lp")), "model", release=True)


def head_of(model: DataFrame) -> DataFrame:
    """The most frequent n-grams of the model, HEAD at most."""
    size = F.floor(F.log2("c")).cast("int")
    left, least = HEAD, 62
    for k, n in sorted(map(tuple, model.filter("c > 0").groupBy(size).agg(F.count("*")).collect()), reverse=True):  # a row for each power of two
        left -= n
        if left < 0:
            break
        least = k
    return model.filter(F.col("c") >= F.lit(1 << least))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=n)
    m = np.uint64(len(seen))
    pair = ids[:-1] * m + ids[1:]
    if len(seen) >= 2_000_000:
        # Numbered by pair: the product with a word's number stays below 2^64 for texts of under 2^32 words.
        pair = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    key = pair[:-1] * m + ids[2:]
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[back] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What is measured of each text; nll: the mean negative log probability of a character, chars: their number.
_MEASURES = StructType([*[StructField(f"m_{c}", LongType()) for c in _COUNTS], StructField("m_chars", LongType()), StructField("m_nll", DoubleType())])


def measured(rows: DataFrame, kept: list[int]) -> DataFrame:
    """Rows (lang, text, ...) as the columns at `kept`, the language, and what _MEASURES says."""
    small_batches(rows.sparkSession)
    packed, found = chunks(rows)
    model = fit(found)
    head = head_of(model)
    held = head.select("lang", "hi", "lo", "lp").toArrow()
    coded = held["lang"].combine_chunks().dictionary_encode()
    keys, values = _key(held["hi"].to_numpy(), held["lo"].to_numpy()), held["lp"].to_numpy()
    by_lang = {lang: Part(keys[own], values[own]) for i, lang in enumerate(coded.dictionary.to_pylist()) for own in (coded.indices.to_numpy() == i,)}
    none = Part(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32))
    shared = rows.sparkSession.sparkContext.broadcast(by_lang)

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (batch.column(i).to_numpy() for i in (2, 3))
            which, keys = batch.column(1).dictionary_encode(), _key(hi, lo)
            out = np.ones(len(keys), dtype=bool)
            for i, lang in enumerate(which.dictionary.to_pylist()):
                own = which.indices.to_numpy() == i
                out[own] = shared.value.get(lang, none).find(keys[own]) < 0
            yield batch.filter(pa.array(out))

    tail = found.select("chunk", "lang", "hi", "lo").mapInArrow(unknown, "chunk bigint, lang string, hi bigint, lo bigint")
    parts = tail.join(model.select("lang", "hi", "lo", "lp"), ["lang", "hi", "lo"]).select("chunk", "hi", "lo", "lp")
    schema = StructType([StructField("m_lang", rows.schema[0].dataType), *[rows.schema[i] for i in kept], *_MEASURES])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        hi, lo, lp = (right.column(i).to_numpy() for i in (1, 2, 3))
        first = shared.value.get(left.column(1)[0].as_py(), none)
        part = Part(np.concatenate((first.keys, _key(hi, lo))), np.concatenate((first.values, lp)))
        out = []
        for stored in left.column(2):
            given = _read(stored)
            counts: list[tuple] = []
            nll: list[float | None] = []
            for texts in slices(given.column(1).chunk(0), SLICE):
                counts += [(*base_counts(t), len(t or "")) for t in texts]
                sums = iter(part.sums(own) if (own := [t for t in texts if t]) else ())
                nll += [float(-next(sums)) / len(t) if t else None for t in texts]
            columns = [given.column(0), *[given.column(i) for i in kept], *[pa.array(c, pa.int64()) for c in zip(*counts, strict=True)], pa.array(nll, pa.float64())]
            out.append(pa.Table.from_arrays(columns, schema=arrow))
        return pa.concat_tables(out)

    return written(packed.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(score, schema), "measured", release=True)


def _verdicts(scored: DataFrame) -> DataFrame:
    """scored with base_failed and kept."""
    failed = _fails(F.col("m_n_words"), F.col("m_n_repeat_words"))
    scored = scored.withColumn("m_failed", failed)
    return joined(scored, written(bands(scored.filter(~failed)), "bands"), "m_lang", "left").withColumn("m_kept", ~F.col("m_failed") & F.coalesce(F.abs(_place()) <= 1, F.lit(True)))


def _fails(n_words: Column, n_repeat_words: Column) -> Column:
    """Whether the counted rules reject a text."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > 50 * n_words)


def count_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, counts and base_failed as score_quality has them, in one pass: they need no model."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        counts = map(base_counts, batch.column(1).to_pylist())
        yield {"m_id": batch.column(0).to_pylist(), **dict(zip(_COUNTS, zip(*counts, strict=True), strict=True))}

    rows = map_slices(docs.select(F.col(id_col), F.col(text_col)), 1, count, f"m_id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return rows.select(F.col("m_id").alias(id_col), *_COUNTS, _fails(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"))


def _unit() -> Column:
    return F.sqrt(1 / F.greatest(F.col("m_chars"), F.lit(1)) + F.lit(1 / LONG))


def _place() -> Column:
    """Where a text lies in its band: -1 and 1 are the borders, 0 the median."""
    off = (F.col("m_nll") - F.col("m_mid")) / (_unit() * F.col("m_scale"))
    return off / F.when(off < 0, F.lit(BELOW)).otherwise(F.lit(ABOVE))


def _median(rows: DataFrame, by: list[str], value: Column, digits: int, name: str) -> DataFrame:
    """The median of a value, rounded to so many digits, by groups. Rounded values are counted first, with partial sums: no group's rows meet in one task."""
    counted = rows.select(*by, F.round(value, digits).alias("v")).filter("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.percentile("v", 0.5, F.col("n")).alias(name))


def bands(scored: DataFrame) -> DataFrame:
    """(m_lang, m_mid, m_scale) from rows (m_lang, m_nll, m_chars)."""
    scored = scored.select("m_lang", "m_nll", "m_chars")
    middle = written(_median(scored, ["m_lang"], F.col("m_nll"), 4, "m_mid"), "medians")
    off = F.abs(F.col("m_nll") - F.col("m_mid")) / _unit()
    spread = _median(joined(scored, middle, "m_lang"), ["m_lang", "m_mid"], off, 3, "m_mad")
    return spread.select("m_lang", "m_mid", F.greatest(F.lit(LEAST_SCALE), 1.4826 * F.col("m_mad")).alias("m_scale"))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: id, counts, base_failed, kept, nll (nats a character) and place (in its band: -1 and 1 are the borders)."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("m_id"))
    judged = _verdicts(measured(rows, [2]))
    return judged.select(F.col("m_id").alias(id_col), *[F.col(f"m_{c}").alias(c) for c in _COUNTS], F.col("m_failed").alias("base_failed"), F.col("m_kept").alias("kept"), F.col("m_nll").alias("nll"), _place().alias("place"))


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that pass, with the columns they came with. Texts are packed once and measured once."""
    shared_dir(docs.sparkSession)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    rows = numbered.select(F.coalesce(F.col(at[lang_col]), F.lit("")).alias("lang"), F.col(at[text_col]).alias("text"), *[c for c in numbered.columns if c != at[text_col]])
    judged = _verdicts(measured(rows, list(range(1, len(rows.columns)))))
    names = [F.col("text" if c == at[text_col] else c).alias(name) for name, c in at.items()]
    return judged.filter("m_kept").select(*names)


#: The counts and the base rules in SQL.
SQL = f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM given),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) > 2),
keyed AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL)
SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < {LEAST_WORDS} OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM words LEFT JOIN covered USING (doc_id)
"""
