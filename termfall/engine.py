"""A text index with the list-style interface: add, delete, update, search, score, save, load."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .functions.analysis import Analyzer
from .functions.scoring import Scoring
from .operators import mutate
from .operators import search as ops
from .plans.index import Index, empty, of_forward
from .sources import readers, storage
from .sources.scratch import checkpointed

#: Terms that a scan may be filtered by.
MOST_TERMS = 1_000


class TextIndex:
    """A mutable handle on an immutable Index. Ids are positions: deleting closes gaps, adding goes on at the end.

    With a path, the stored index there is opened if there is one, and every change is saved.
    """

    def __init__(self, spark: SparkSession, method: str = "lucene", k1: float = 1.5, b: float = 0.75, delta: float = 0.5, tokenizer: str = "unicode_stem", use_stopwords: bool = True, path: str | None = None) -> None:
        analyzer, scoring = Analyzer(tokenizer, use_stopwords), Scoring(method, k1, b, delta)
        self.spark, self.path = spark, path
        self.index: Index = storage.open_or_create(spark, path, analyzer, scoring) if path else empty(spark, analyzer, scoring)

    @classmethod
    def load(cls, spark: SparkSession, path: str, mmap: bool = False) -> TextIndex:
        """A stored index, not bound to its path. mmap: read lazily instead of caching."""
        out = cls.__new__(cls)
        out.spark, out.path, out.index = spark, None, storage.load(spark, path, cache=not mmap)
        return out

    def save(self, path: str) -> None:
        storage.save(self.index, path)

    def _changed(self, index: Index) -> None:
        self.index = index
        if self.path:
            storage.save(index, self.path)
            self.index = storage.load(self.spark, self.path)
        else:
            # Written at each change, so a plan never grows with the number of changes.
            if index.forward is not None:
                index = of_forward(checkpointed(index.forward), index.analyzer, index.scoring)
            else:
                index = Index(checkpointed(index.docs), checkpointed(index.postings), index.analyzer, index.scoring)
            self.index = index

    def add(self, documents: Sequence[str]) -> list[int]:
        """Add texts; returns their ids."""
        start = len(self)
        docs = readers.from_list(self.spark, documents, start)
        self._changed(mutate.add(self.index, docs, check=False))
        return list(range(start, start + len(documents)))

    def add_bytes(self, data: bytes) -> list[int]:
        """Add newline-separated documents."""
        return self.add(data.decode("utf-8").split("\n"))

    def add_frame(self, docs: DataFrame, order_col: str) -> None:
        """Add a table (text, order_col) in the order of a unique whole number."""
        self._changed(mutate.add(self.index, docs, order_col))

    def delete(self, ids: Sequence[int]) -> None:
        """Remove documents; later ids move down."""
        if ids:
            self._changed(mutate.delete(self.index, self._ids(ids)))

    def update(self, doc_id: int, text: str) -> None:
        """Replace a text. Raises IndexError for an id that doesn't exist."""
        self._changed(mutate.update(self.index, readers.from_list(self.spark, [text], doc_id)))

    def _queries(self, query: Sequence[str]) -> DataFrame:
        return readers.local(self.spark, {"query_id": pa.array(range(len(query)), pa.int32()), "query": pa.array(query, pa.string())})

    def _ids(self, ids: Sequence[int]) -> DataFrame:
        return readers.local(self.spark, {"doc_id": pa.array([int(i) for i in ids], pa.int64())})

    def search(self, query: str | Sequence[str], k: int, subset: Sequence[int] | Sequence[Sequence[int]] | None = None):
        """[(id, score)] for a string, a list of such lists for a list of strings.

        subset: ids that may be found; for a list of queries a list of lists, one for each (ValueError otherwise). [] is not None.
        """
        if isinstance(query, str):
            return self.search([query], k, None if subset is None else [subset])[0]
        if subset is not None and len(subset) != len(query):
            raise ValueError(f"{len(query)} queries, {len(subset)} subsets")
        allowed = None
        if subset is not None:
            pairs = [(i, int(d)) for i, own in enumerate(subset) for d in own]
            allowed = readers.local(self.spark, {"query_id": pa.array([i for i, _ in pairs], pa.int32()), "doc_id": pa.array([d for _, d in pairs], pa.int64())})
        queries = self._queries(query)
        # The terms are known here: few of them reach the scan of the postings as a filter.
        split = self.index.analyzer.splitter()
        terms = sorted({t for q in query for t in split(q)})
        out: list[list[tuple[int, float]]] = [[] for _ in query]
        for r in ops.search(self.index, queries, k, allowed, terms if len(terms) <= MOST_TERMS else None).orderBy("query_id", "rank").collect():  # k rows a query
            out[r["query_id"]].append((r["doc_id"], r["score"]))
        return out

    def score(self, query: str | Sequence[str], documents: Sequence[str] | Sequence[Sequence[str]]):
        """Scores of the given texts, which are their own corpus; for a list of queries a list of lists of texts."""
        if isinstance(query, str):
            return self.score([query], [documents])[0]
        if len(query) != len(documents):
            raise ValueError(f"{len(query)} queries, {len(documents)} lists of documents")
        rows = [(q, i, t) for q, own in enumerate(documents) for i, t in enumerate(own)]
        number, place, texts = zip(*rows, strict=True) if rows else ((), (), ())
        docs = readers.local(self.spark, {"query_id": pa.array(number, pa.int32()), "doc_id": pa.array(place, pa.int64()), "text": pa.array(texts, pa.string())})
        queries = self._queries(query)
        out: list[list[float]] = [[0.0] * len(own) for own in documents]
        for r in ops.score(queries, docs, self.index).collect():
            out[r["query_id"]][r["doc_id"]] = r["score"]
        return out

    def __len__(self) -> int:
        return len(self.index)

    def is_empty(self) -> bool:
        return self.index.is_empty()
