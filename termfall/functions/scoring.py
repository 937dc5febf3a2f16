"""Five BM25 formulas, as column expressions and over arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the formulas.
METHODS = ("lucene", "robertson", "atire", "bm25l", "bm25+")


@dataclass(frozen=True)
class Scoring:
    """method: one of METHODS (bm25plus too), any case; k1, b and delta are taken as they are."""

    method: str = "lucene"
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5

    def __post_init__(self) -> None:
        name = self.method.lower()
        name = "bm25+" if name == "bm25plus" else name
        if name not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; one of {', '.join(METHODS)}")
        object.__setattr__(self, "method", name)

    def idf(self, n: Column, df: Column) -> Column:
        """Inverse document frequency of a term in df of n documents."""
        return self._idf(n.cast("double"), df.cast("double"), F.log, lambda x: F.greatest(F.lit(0.0), x))

    def idf_of(self, n: float, df: np.ndarray) -> np.ndarray:
        """The same of arrays."""
        return self._idf(float(n), df.astype(float), np.log, lambda x: np.maximum(0.0, x))

    def _idf(self, n, df, log, least_zero):
        if self.method == "lucene":
            return log(1 + (n - df + 0.5) / (df + 0.5))
        if self.method == "robertson":
            return least_zero(log((n - df + 0.5) / (df + 0.5)))
        if self.method == "atire":
            return log(n / df)
        return log((n + 1) / (df + 0.5 if self.method == "bm25l" else df))

    def tf(self, tf: Column, length: Column, average: Column) -> Column:
        """The share of a term that stands tf times in a document of that length."""
        return self._tf(tf.cast("double"), length.cast("double"), average, *(F.lit(float(x)) for x in (self.k1, self.b, self.delta)))

    def tf_of(self, tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
        """The same of arrays."""
        return self._tf(tf.astype(float), length.astype(float), average, *map(float, (self.k1, self.b, self.delta)))

    def _tf(self, tf, length, average, k1, b, d):
        norm = 1 - b + b * length / average
        if self.method in ("lucene", "robertson"):
            return tf / (k1 * norm + tf)
        if self.method == "atire":
            return tf * (k1 + 1) / (tf + k1 * norm)
        if self.method == "bm25l":
            c = tf / norm
            return (k1 + 1) * (c + d) / (k1 + c + d)
        return (k1 + 1) * tf / (k1 * norm + tf) + d
