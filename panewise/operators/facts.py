"""Facts: everything the detectors need from a text, taken in one pass.

A facts table has one row per asset, without the body: its keys and headers, and one array
column per text-level operator. Operators read such a column when their input has it and
compute it from ``content`` when it has not, so they work on assets and on facts alike. A
whole scan reads the captures once, and every later step reads only its own column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..functions.sqlexpr import F

#: asset columns a facts table keeps
META = (
    "site", "base_url", "asset_seq", "is_main", "url", "kind", "status", "content_type", "headers",
)


def fact(assets: DataFrame, name: str, build: Callable[[], Column]) -> Column:
    """The stored fact, or its expression over the text."""
    return F.col(name) if name in assets.columns else build()


def facts_table(assets: DataFrame, builders: dict[str, Callable[[], Column]]) -> DataFrame:
    return assets.select(*META, *[build().alias(name) for name, build in builders.items()])
