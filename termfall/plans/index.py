"""An index is relations: docs (doc_id, dl), postings (term, doc_id, tf, dl), terms (term, df), and totals.

Texts become one row each, with their terms counted in place (the forward rows); postings are those rows laid out by term. So building takes no shuffle but the
layout of a stored index.

A posting carries its document's length, so scoring needs no join with docs. Raw frequencies are kept and scores are computed when a
query comes, so documents can be added and removed without rewriting scores.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer
from ..functions.scoring import Scoring
from ..sources.scratch import small_batches


@dataclass(frozen=True)
class Index:
    """Relations and settings. terms and totals follow from the others unless a stored index brings them."""

    docs: DataFrame
    postings: DataFrame
    analyzer: Analyzer = field(default_factory=Analyzer)
    scoring: Scoring = field(default_factory=Scoring)
    stored_terms: DataFrame | None = None
    stored_totals: DataFrame | None = None
    #: Analysed documents that docs and postings both come from, where they do: whoever writes both analyses once.
    forward: DataFrame | None = None
    #: Whether postings and terms are those of some terms only; docs and totals are whole in any case. Such an index can be searched for these terms, not stored.
    partial: bool = False

    @property
    def terms(self) -> DataFrame:
        """(term, df)"""
        return self.stored_terms if self.stored_terms is not None else self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def totals(self) -> DataFrame:
        """One row (num_docs, total_tokens, avgdl); avgdl is null without documents."""
        if self.stored_totals is not None:
            return self.stored_totals
        sums = self.docs.agg(F.count("*").alias("num_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_tokens"))
        return sums.withColumn("avgdl", F.try_divide(F.col("total_tokens").cast("double"), F.col("num_docs")))

    def only(self, terms: list[str]) -> Index:
        """The index as far as some terms go; totals stay."""
        held = F.col("term").isin(terms)
        out = replace(self, postings=self.postings.filter(held), stored_terms=None if self.stored_terms is None else self.stored_terms.filter(held))
        out.__dict__["numbers"] = self.numbers  # read once for the index that it is of
        return out

    @cached_property
    def numbers(self) -> tuple[int, float | None] | None:
        """num_docs and avgdl of a stored index, read once; None if they are still to be computed."""
        return tuple(self.stored_totals.select("num_docs", "avgdl").first()) if self.stored_totals is not None else None

    def by_document(self) -> DataFrame:
        """(doc_id, dl, counts): a row per document with its terms. Only an index that wasn't made of such rows is shuffled for them."""
        if self.forward is not None:
            return self.forward
        held = self.postings.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("counts"))
        return self.docs.join(held, "doc_id", "left").select("doc_id", "dl", F.coalesce("counts", F.array().cast("array<struct<term: string, tf: int>>")).alias("counts"))

    def on(self, forward: DataFrame) -> Index:
        """The index of other analysed documents under the same settings."""
        return replace(of_forward(forward.select("doc_id", "dl", "counts"), self.analyzer, self.scoring), partial=self.partial)

    def scored_by(self, scoring: Scoring) -> Index:
        """The same index under another formula: nothing is computed anew."""
        return replace(self, scoring=scoring)

    def __len__(self) -> int:
        return int(self.totals.first()["num_docs"])

    def is_empty(self) -> bool:
        return len(self) == 0


def counted(docs: DataFrame, analyzer: Analyzer, id_col: str = "doc_id", text_col: str = "text", *keys: str, only: Iterable[str] | None = None) -> DataFrame:
    """(keys, doc_id, dl, counts): a row per document with its terms (or with these only), counted where the text lies. No shuffle."""
    small_batches(docs.sparkSession)
    each = docs.select(*keys, F.col(id_col).cast("bigint").alias("doc_id"), analyzer.counts(F.col(text_col), only).alias("c"))
    return each.select(*keys, "doc_id", F.col("c.dl").alias("dl"), F.col("c.counts").alias("counts"))


def postings_of(forward: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, doc_id, tf, dl) of (keys, doc_id, dl, counts)."""
    return forward.select(*keys, "doc_id", "dl", F.inline("counts")).select(*keys, "term", "doc_id", "tf", "dl")


def of_forward(forward: DataFrame, analyzer: Analyzer, scoring: Scoring) -> Index:
    """The index of analysed documents (doc_id, dl, counts)."""
    return Index(forward.select("doc_id", "dl"), postings_of(forward), analyzer, scoring, forward=forward)


def build(docs: DataFrame, analyzer: Analyzer | None = None, scoring: Scoring | None = None, id_col: str = "doc_id", text_col: str = "text", only: Iterable[str] | None = None) -> Index:
    """The index of a table of documents. Lazy: nothing runs until it is read, and each reading analyses the texts. Ids must be unique; a null text is an empty document.

    only: these terms' postings alone. search.indexed() has the queries' terms and writes what it analyses.
    """
    analyzer = analyzer or Analyzer()
    return replace(of_forward(counted(docs, analyzer, id_col, text_col, only=only), analyzer, scoring or Scoring()), partial=only is not None)


def empty(spark, analyzer: Analyzer | None = None, scoring: Scoring | None = None) -> Index:
    """An index without documents."""
    return build(spark.createDataFrame([], "doc_id bigint, text string"), analyzer, scoring)
