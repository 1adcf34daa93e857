"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, kept, table
from .containment import clean
from .cross_parsing import recognised, sample
from .novelty import dictionary, redacted
from .packing import packed
from .parity_join import survivors
from .queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null ones and those without a letter."""
    importable(spark)
    return recognised(docs, sample(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    importable(spark)
    return survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain three quarters of a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    importable(spark)
    return redacted(docs, dictionary(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of 1024 tokens."""
    importable(spark)
    return packed(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(steps: list[tuple[str, Stage]], spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in steps[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return steps[-1][1](spark, docs, sf_dir)
