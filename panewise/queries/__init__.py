"""The query registry: every operator as a Spark query and, where SQL can say it, its oracle."""

from .base import ORACLES, QUERIES, Corpus, corpus, forget_corpora
from . import detect, extract, results  # noqa: F401  (registers the queries)

__all__ = ["ORACLES", "QUERIES", "Corpus", "corpus", "forget_corpora"]
