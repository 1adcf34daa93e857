"""The shared projection that turns match rows into findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.sqlexpr import F
from ..functions.text import make_snippet
from ..model import EVIDENCE, FINDING_COLUMNS
from ..rules.vulns import Rule
from ..tables import local_table
from .facts import fact

DETECTOR_ORDER = {
    name: i
    for i, name in enumerate(
        ("technology", "secrets", "sql", "xss", "misc", "access", "endpoints", "headers", "site")
    )
}


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (r.id, i, r.title, r.severity, r.detail, r.remediation, "|".join(r.tags))
        for i, r in enumerate(rules)
    ]
    return local_table(
        spark, ("rule", "rule_ord", "title", "severity", "detail", "remediation", "tag_list"), rows
    )


def with_rules(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Catalogue columns for each hit; the catalogue's size is fixed by the code."""
    table = rule_table(hits.sparkSession, rules)
    return hits.join(F.broadcast(table), "rule").withColumn("tags", F.split("tag_list", r"\|"))


def evidence_of(**pairs: Column) -> Column:
    flat = [x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*flat) if flat else F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")
    )


def tags_of(*tags: str) -> Column:
    return F.array(*[F.lit(t) for t in tags])


def to_findings(rows: DataFrame, detector: str, category: str, **columns: Column) -> DataFrame:
    """Fill in what a finding row needs; ``columns`` overrides what ``rows`` carries."""
    have = set(rows.columns)
    base = {
        "detector_ord": F.lit(DETECTOR_ORDER[detector]),
        "category": F.lit(category),
        "rule_ord": F.lit(0) if "rule_ord" not in have else F.col("rule_ord"),
        "region_idx": F.lit(0) if "region_idx" not in have else F.col("region_idx"),
        "pos": F.lit(0) if "pos" not in have else F.col("pos"),
        "evidence": evidence_of(),
    }
    base.update(columns)
    casts = {"evidence": EVIDENCE, "tags": "array<string>", "asset_seq": "bigint",
             "detector_ord": "int", "rule_ord": "int", "region_idx": "int", "pos": "int",
             "line": "int", "col": "int"}
    out = []
    for name in FINDING_COLUMNS:
        column = base.get(name, F.col(name))
        out.append(column.cast(casts.get(name, "string")).alias(name))
    return rows.select(*out)


def opening() -> Column:
    """The excerpt that places a finding about a whole response."""
    return make_snippet(F.col("content"), F.lit(0), F.lit(0))


def document_place(head: Column) -> dict[str, Column]:
    """Place of a finding about a whole response: line 1, and the text's opening."""
    return {"line": F.lit(1), "col": F.lit(1), "snippet": head}


def main_documents(assets: DataFrame) -> DataFrame:
    """(site, asset_seq, url, snippet) of each site's own document, where site-wide findings
    are placed. ``is_main`` marks one capture per site."""
    return assets.where("is_main").select(
        "site", "asset_seq", "url", fact(assets, "f_head", opening).alias("snippet")
    )
