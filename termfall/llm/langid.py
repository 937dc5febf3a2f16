"""Language identification as inference of a mixture.

Spark counts character n-grams (orders 2 and 3, hashed into BUCKETS counters a language, so a model can't outgrow its bound) over all
training texts of each language. A document is a bag of words; a word's likelihood under a language is the product of its
n-gram probabilities, tempered by the number of orders. Expectation-maximisation estimates the proportions of the languages in the document. The language set
is chosen by penalised likelihood: starting from all languages, the one with the least weight is dropped and the proportions are
estimated anew, and the set with the largest log likelihood minus PENALTY times its size times log(words) stays.

Edge cases: null texts, empty texts and texts without a letter are `und` with score 0; an empty training set makes every text
`und`; texts are read whole; ties between languages go to the first by name; a null language teaches nothing; a null id counts as the
empty string when rows are held out; repeated rows count as often as they stand there; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, ranges, slices, small_batches, to_arrow

BUCKETS = 1 << 16
ORDERS = (2, 3)
_MIX = np.uint32(0x9E3779B1)
#: Added to each counter; steps of EM for each set of languages; price of a language, in half logs of the number of words.
SMOOTH, STEPS, PENALTY = 0.5, 6, 3.0
#: Bytes of texts that are worked on at a time: their arrays of words by languages should stay in a processor's cache.
SLICE = 1 << 18
#: Languages that one broadcast model may hold: each takes BUCKETS * 4 bytes.
MOST_LANGUAGES = 512


@lru_cache(1)
def _letters() -> np.ndarray:
    """2 for code points that are letters, 1 for marks, 0 for others."""
    import unicodedata

    return np.fromiter((2 if chr(i).isalpha() else unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), dtype=np.int8, count=0x110000)


def _in_words(kinds: np.ndarray) -> np.ndarray:
    """Which characters stand in words: runs of letters and marks that hold a letter."""
    some = kinds > 0
    first = np.flatnonzero(some & ~np.concatenate(([False], some[:-1])))
    if len(first):
        length = np.flatnonzero(some & ~np.concatenate((some[1:], [False]))) + 1 - first
        bare = np.flatnonzero(np.maximum.reduceat(np.where(some, kinds, 0), first) < 2)
        for i in bare.tolist():
            some[first[i] : first[i] + length[i]] = False
    return some


def words_of(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """n-gram buckets of all words laid end to end by order, where each word's begin, and the text each word belongs to.

    A word is a run of letters and marks that holds a letter, lower-cased, with a blank on either side.
    """
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _in_words(_letters()[points])
    x = np.where(letter, points, np.uint32(32))
    starts = np.cumsum([1, *(len(t) + 1 for t in lowered[:-1])]) if lowered else np.zeros(0, dtype=np.int64)
    after = np.concatenate(([False], letter[:-1]))
    first = letter & ~after
    text_of = np.searchsorted(starts, np.flatnonzero(first), "right") - 1
    # n-grams end at a letter or at the blank after a word, so a word of k letters has k + 1 of each order.
    ends = np.flatnonzero(letter | after)
    cuts = np.flatnonzero(first[ends])
    found = []
    for n in ORDERS:
        h = np.full(len(ends), n, dtype=np.uint32)
        past = np.zeros(len(ends), dtype=bool)
        for k in range(n):
            # What lies before the blank in front of a word is another word.
            sign = np.where(past, np.uint32(32), x[np.maximum(ends - k, 0)])
            past |= (sign == 32) & (k > 0)
            h ^= sign
            h *= _MIX
            h ^= h >> np.uint32(15)
        found.append(h & np.uint32(BUCKETS - 1))
    return found, cuts, text_of


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name, and log probabilities [bucket, language], from all rows with a language."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "lang string, bucket int, n bigint"
    arrow = to_arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, size in ranges(batch.column(0), SLICE):
                by: dict[str, list[str]] = {}
                for t, lang in zip(*(batch.column(i).slice(start, size).to_pylist() for i in (0, 1)), strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, own in by.items():
                    held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    for grams in words_of(own)[0]:
                        held[lang] += np.bincount(grams, minlength=BUCKETS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield from pieces({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": n[at]}, arrow)

    counted = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col).mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    coded = counted["lang"].combine_chunks().dictionary_encode()
    given, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    names = sorted(given)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; a broadcast model may hold {MOST_LANGUAGES}")
    table = np.full((BUCKETS, len(names)), SMOOTH)
    buckets, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    for i, name in enumerate(names):
        own = which == given.index(name)
        table[buckets[own], i] += n[own]
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, text_of: np.ndarray, cuts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each text, over its allowed languages. like: scaled likelihoods [word, language]."""
    weights = allowed / allowed.sum(axis=1, keepdims=True)
    sizes = np.diff(np.append(cuts, len(like)))[:, None]
    for _ in range(STEPS):
        share = like * weights[text_of]
        share /= share.sum(axis=1, keepdims=True)
        weights = np.add.reduceat(share, cuts, axis=0) / sizes
    total = np.log(np.maximum((like * weights[text_of]).sum(axis=1), 1e-300))
    return weights, np.add.reduceat(total, cuts)


def mixtures(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Language proportions of each text; zeros where it has no letter."""
    out = np.zeros((len(texts), table.shape[1]))
    grams, cuts, text_of = words_of(texts)
    if not len(text_of) or not table.shape[1]:
        return out
    n = len(text_of)
    logs = np.add.reduceat(sum(table[g] for g in grams), cuts, axis=0) / len(ORDERS)
    logs -= logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logs, -60.0))
    have, cuts = np.unique(text_of, return_index=True)
    own = np.searchsorted(have, text_of)
    count = np.diff(np.append(cuts, n))
    price = PENALTY * 0.5 * np.log(np.maximum(count, 2))
    allowed = np.ones((len(have), table.shape[1]))
    weights, total = _em(like, own, cuts, allowed)
    best, best_value = weights, total - price * allowed.sum(axis=1)
    # Languages of no weight go at once; the rest one by one.
    allowed = np.where(weights > np.minimum(0.5 / count[:, None], weights.max(axis=1, keepdims=True) / 2), 1.0, 0.0)
    while True:
        weights, total = _em(like, own, cuts, allowed)
        size = allowed.sum(axis=1)
        value = total - price * size
        better = value > best_value
        best, best_value = np.where(better[:, None], weights, best), np.where(better, value, best_value)
        more = size > 1
        if not more.any():
            break
        least = np.where(allowed > 0, weights, np.inf).argmin(axis=1)
        allowed[np.flatnonzero(more), least[more]] = 0
    out[have] = best
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def predict(docs: DataFrame, names: list[str], table: np.ndarray, text_col: str = "text") -> Column:
    """A struct column: lang_pred, score, and the languages of the document with their proportions."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<lang_pred: string, score: double, languages: array<string>, shares: array<double>>")
    def guessed(texts: pa.Array) -> pa.Array:
        own, model = shared.value
        rows = []
        for w in (w for some in slices(texts, SLICE) for w in mixtures(some, model)):
            order = [i for i in np.argsort(-w, kind="stable") if w[i] > 0]
            rows.append({"lang_pred": own[order[0]], "score": float(min(1.0, w[order[0]])), "languages": [own[i] for i in order], "shares": [float(w[i]) for i in order]} if order else {"lang_pred": "und", "score": 0.0, "languages": [], "shares": []})
        return pa.array(rows, type=kind)

    return guessed(F.col(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: id, held_out, lang_pred, score, languages, shares; learned from the rows that aren't held out."""
    names, table = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(docs, names, table, text_col).alias("__lang"))
    return out.select(id_col, "held_out", "__lang.*")
