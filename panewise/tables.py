"""Small dimension tables (rule catalogues, path lists) as plan-local relations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def sql_literal(value) -> str:
    """A Spark SQL literal for a str, bool, int or None."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\x00", "\\0")
    escaped = escaped.replace("${", "\\u0024{")  # or Spark takes it for a variable
    return f"'{escaped}'"


def local_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A VALUES relation: its size is fixed by the code, so joining it by broadcast is safe."""
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
