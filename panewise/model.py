"""Vocabulary shared by every operator: severities, confidences, categories, job options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from .functions.sqlexpr import F

# Ordinals and labels of the result model.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
SEVERITY_RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
CONFIDENCE_RANK = {"CONFIRMED": 3, "FIRM": 2, "TENTATIVE": 1}
SECRET = "Secret"
VULNERABILITY = "Vulnerability"
ACCESS = "Access Control"
EXPOSURE = "Information Exposure"
HEADER = "Security Header"
CATEGORIES = (SECRET, VULNERABILITY, ACCESS, EXPOSURE, HEADER)

#: Columns that identify the capture a row came from.
ASSET_KEYS = ("site", "base_url", "asset_seq", "url", "kind")

EVIDENCE = "map<string,string>"

#: Row order inside a site: capture, detector, rule, region, position.
FINDING_ORDER = ("asset_seq", "detector_ord", "rule_ord", "region_idx", "pos")

FINDING_COLUMNS = (
    "site", "asset_seq", "detector_ord", "rule_ord", "region_idx", "pos",
    "category", "title", "severity", "confidence", "value", "detail", "remediation",
    "evidence", "tags", "url", "line", "col", "snippet",
)


@dataclass(frozen=True)
class Options:
    """Job parameters. None of them drops or cuts data: bodies and sites are read whole."""

    min_confidence: str = "FIRM"
    min_severity: str = "INFO"
    fail_on: str | None = None
    #: epoch seconds that token expiry is judged against; None is the time of the run
    as_of: int | None = None


def _rank(label: Column, ranks: dict[str, int]) -> Column:
    upper = F.upper(label)
    out = F.lit(0)
    for name, weight in ranks.items():
        out = F.when(upper == name, F.lit(weight)).otherwise(out)
    return out


def severity_weight(label: Column) -> Column:
    return _rank(label, SEVERITY_RANK)


def confidence_weight(label: Column) -> Column:
    return _rank(label, CONFIDENCE_RANK)


def severity_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), rank)


def confidence_label(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("TENTATIVE"), F.lit("FIRM"), F.lit("CONFIRMED")), rank)


def escalate(label: Column) -> Column:
    """One severity step up; the top and unknown labels stay."""
    rank = severity_weight(label)
    return F.when(rank == 0, label).otherwise(severity_label(F.least(rank + 1, F.lit(5))))
