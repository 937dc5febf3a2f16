"""Text to terms: lower case, ASCII folding, splitting, stopwords, stemming.

The plain mode is a Catalyst expression where terms are asked for. Folding and stemming have no built-in function, and counting the terms
of a text in place has none that is linear: one Arrow UDF handles a batch of texts and remembers the result of each distinct chunk, so a
corpus needs no shuffle to be analysed. A null text is an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemmer import stem

MODES = ("plain", "unicode", "stem", "unicode_stem")

#: The English stopwords, in their published order.
STOPWORDS = frozenset(
    """
    a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself its itself them theirs themselves
    what which who whom when where why how all each every both few more most other some
    am been being do does did doing would should could ought might shall can need dare had has have having
    about above after again against below between during from further here once only out over same so than too under until up very own just
    don now d ll m o re s t ve
    """.split()
)

#: Chunks that a worker remembers before it starts anew.
REMEMBERED = 500_000

_SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms. mode: one of MODES, any case, with or without the underscore."""

    mode: str = "unicode_stem"
    use_stopwords: bool = True

    def __post_init__(self) -> None:
        found = {m.replace("_", ""): m for m in MODES}.get(self.mode.lower().replace("_", ""))
        if found is None:
            raise ValueError(f"unknown tokenizer mode {self.mode!r}; one of {', '.join(MODES)}")
        object.__setattr__(self, "mode", found)

    def terms(self, text: Column) -> Column:
        """An array of terms in text order."""
        if self.mode == "plain":
            parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda x: x != "")
            return F.filter(parts, lambda x: ~x.isin(*sorted(STOPWORDS))) if self.use_stopwords else parts
        return self._udf()(text)

    def counts(self, text: Column, only: Iterable[str] | None = None) -> Column:
        """A struct of a text's length in terms and its distinct terms with their numbers: (dl, counts[(term, tf)]). only: count these terms and no others; the length is whole."""
        split = self.splitter()
        wanted = None if only is None else frozenset(only)

        @F.arrow_udf(f"struct<dl: int, counts: array<{_COUNT}>>")
        def counted(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([of_slice(some) for some in _slices(texts)])

        def of_slice(texts: list[str | None]) -> pa.Array:
            sizes, lens, terms, numbers = [0], [], [], []
            for t in texts:
                words = split(t)
                lens.append(len(words))
                found = Counter(words if wanted is None else filter(wanted.__contains__, words))
                terms += found.keys()
                numbers += found.values()
                sizes.append(len(terms))
            each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(numbers, pa.int32())], ["term", "tf"])
            return pa.StructArray.from_arrays([pa.array(lens, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)], ["dl", "counts"])

        # Not deterministic for the optimiser, which else runs it again for each field.
        return counted.asNondeterministic()(text)

    def splitter(self) -> Callable[[str | None], list[str]]:
        """A function from a text to its terms, outside Spark."""
        drop = STOPWORDS if self.use_stopwords else frozenset()
        mode = self.mode
        if mode == "plain":
            return lambda text: [x for x in _words((text or "").lower()) if x not in drop]
        return lambda text: _remembered(mode, drop)(text)

    def _udf(self):
        split = self.splitter()

        @F.arrow_udf("array<string>")
        def analysed(texts: pa.Array) -> pa.Array:
            rows = [split(t) for some in _slices(texts) for t in some]
            sizes = [0]
            for r in rows:
                sizes.append(sizes[-1] + len(r))
            return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(list(chain.from_iterable(rows)), pa.string()))

        return analysed


_COUNT = "struct<term: string, tf: int>"


def _slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[list[str | None]]:
    """The texts as lists of about so many bytes."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and size + n > most:
            yield texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    yield texts.slice(start).to_pylist()


def fold(text: str) -> str:
    """Compatibility decomposition without what lies outside ASCII."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def analyze(text: str | None, analyzer: Analyzer) -> list[str]:
    """The terms of one text, outside Spark."""
    return analyzer.splitter()(text)


_ASCII = re.compile(r"[A-Za-z0-9]+")
_SPLIT = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Alphabetic or numeric, as Unicode has it: letters, the marks and signs that count as alphabetic, and numbers of any kind.
_ANY = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def _words(text: str) -> list[str]:
    return _ASCII.findall(text) if text.isascii() else _ANY.findall(text)


_CACHES: dict = {}


def _remembered(mode: str, drop: frozenset[str]):
    """A function from text to terms that remembers chunks. Folding joins what it doesn't split, so chunks end at ASCII separators."""
    folds, stems = mode.startswith("unicode"), mode.endswith("stem")
    known: dict[str, list[str]] = _CACHES.setdefault((mode, bool(drop)), {})

    def terms(text: str | None) -> list[str]:
        if len(known) > REMEMBERED:
            known.clear()
        out: list[str] = []
        for chunk in _SPLIT.split((text or "").lower()):
            if chunk:
                found = known.get(chunk)
                if found is None:
                    words = _ASCII.findall(fold(chunk)) if folds else _words(chunk)
                    found = [stem(w) if stems else w for w in words if w not in drop]
                    known[chunk] = found = [w for w in found if w]
                out += found
        return out

    return terms
