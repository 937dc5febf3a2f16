"""Lexical retrieval on Spark DataFrames."""

from .engine import TextIndex
from .functions.analysis import Analyzer
from .functions.scoring import Scoring
from .operators.search import score, search
from .plans.index import Index, build

__all__ = ["Analyzer", "Index", "Scoring", "TextIndex", "build", "score", "search"]
