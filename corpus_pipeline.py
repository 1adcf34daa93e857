"""Documents to packed training sequences: five stages, each one operator of panewise.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panewise.llm import stages

STAGES = stages.STAGES

#: Language models, compression and packing are not SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(STAGES, spark, sf_dir)
