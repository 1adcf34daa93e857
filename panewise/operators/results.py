"""Merging findings and summarising sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from ..functions.sqlexpr import F
from ..functions.text import strip
from ..functions.urls import host_of, is_backend_host, registrable
from ..model import (
    CONFIDENCE_RANK, EXPOSURE, FINDING_ORDER, SEVERITIES, SEVERITY_RANK, confidence_label,
    confidence_weight, severity_label, severity_weight,
)
from .facts import fact
from .findings import evidence_of, tags_of, to_findings

#: further places shown with a merged finding; finding_places has all of them
EXTRA_PLACES = 50


def finding_key(value: Column, snippet: Column) -> Column:
    return F.when(value != "", strip(value)).otherwise(strip(snippet))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One row per (site, category, title, key): the first row's fields, the worst severity,
    the best confidence, the first 50 further places to show, and the true number of mentions;
    finding_places has all places.

    Counts and extremes combine on the map side. The places list is a top-51 per key: Spark's
    window group limit trims each task to 51 rows per key before the shuffle, so a key that
    holds a third of all findings never piles up in one task.
    """
    key = ["site", "category", "title", "key"]
    keyed = findings.withColumn("key", finding_key(F.col("value"), F.col("snippet")))
    merged = keyed.groupBy(*key).agg(
        F.count("*").alias("mentions"),
        F.max(severity_weight(F.col("severity"))).alias("severity_rank"),
        F.max(confidence_weight(F.col("confidence"))).alias("confidence_rank"),
    )
    first = Window.partitionBy(*key).orderBy(*FINDING_ORDER)
    place = F.struct("url", "line", "col", "snippet")
    kept = [c for c in findings.columns if c not in (*key, "severity", "confidence")]
    places = (
        keyed.withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= EXTRA_PLACES + 1)
        .groupBy(*key)
        .agg(
            F.min_by(F.struct(*kept), "rn").alias("f"),
            F.array_sort(F.collect_list(F.struct("rn", place.alias("place")))).alias("seen"),
        )
    )
    return merged.join(places, key).select(
        "site", "category", "title", "key",
        severity_label(F.col("severity_rank")).alias("severity"),
        confidence_label(F.col("confidence_rank")).alias("confidence"),
        "severity_rank", "confidence_rank",
        *[F.col("f." + c).alias(c) for c in kept],
        F.col("mentions").alias("occurrences"),
        "mentions",
        F.transform(
            F.slice("seen", 2, EXTRA_PLACES), lambda s: s["place"]
        ).alias("also_seen"),
    )


def finding_places(findings: DataFrame) -> DataFrame:
    """Every place of every merged finding, one row each, by the finding's key."""
    key = finding_key(F.col("value"), F.col("snippet")).alias("key")
    return findings.select("site", "category", "title", key, "url", "line", "col", "snippet")


def filter_min_confidence(findings: DataFrame, level: str = "FIRM") -> DataFrame:
    return findings.where(confidence_weight(F.col("confidence")) >= CONFIDENCE_RANK[level.upper()])


def filter_min_severity(findings: DataFrame, level: str = "INFO") -> DataFrame:
    return findings.where(severity_weight(F.col("severity")) >= SEVERITY_RANK[level.upper()])


def finding_sort() -> list[Column]:
    """Report order inside a site."""
    return [
        severity_weight(F.col("severity")).desc(), confidence_weight(F.col("confidence")).desc(),
        F.col("category"), F.col("title"), *[F.col(c) for c in FINDING_ORDER],
    ]


def sorted_findings(findings: DataFrame, min_confidence: str = "FIRM") -> DataFrame:
    return filter_min_confidence(findings, min_confidence).orderBy("site", *finding_sort())


def sorted_technologies(technologies: DataFrame) -> DataFrame:
    return technologies.orderBy("site", "category", "name")


def sorted_services(services: DataFrame) -> DataFrame:
    return services.orderBy("site", "category", "name")


def sorted_endpoints(endpoints: DataFrame) -> DataFrame:
    return endpoints.orderBy("site", "scope", "url", "method")


def severity_counts(findings: DataFrame, sites: DataFrame, min_confidence: str = "FIRM") -> DataFrame:
    """Zero-filled counts per severity for every site."""
    visible = filter_min_confidence(findings, min_confidence)
    counts = visible.groupBy("site").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    )
    return sites.select("site").distinct().join(counts, "site", "left").na.fill(0)


def max_severity(findings: DataFrame, sites: DataFrame, min_confidence: str = "FIRM") -> DataFrame:
    worst = filter_min_confidence(findings, min_confidence).groupBy("site").agg(
        F.max(severity_weight(F.col("severity"))).alias("severity_rank")
    )
    return (
        sites.select("site").distinct().join(worst, "site", "left")
        .withColumn("max_severity", F.when(
            F.col("severity_rank") > 0, severity_label(F.col("severity_rank"))))
        .select("site", F.coalesce("severity_rank", F.lit(0)).alias("severity_rank"), "max_severity")
    )


def ci_gate(
    findings: DataFrame, sites: DataFrame, fail_on: str, min_confidence: str = "FIRM"
) -> DataFrame:
    """failed is true, with exit code 2, when a site's worst finding reaches the threshold."""
    failed = F.col("severity_rank") >= SEVERITY_RANK[fail_on.upper()]
    return max_severity(findings, sites, min_confidence).select(
        "site", "max_severity", failed.alias("failed"),
        F.when(failed, 2).otherwise(0).alias("exit_code"),
    )


def hidden_count(findings: DataFrame, sites: DataFrame, min_confidence: str = "FIRM") -> DataFrame:
    low = F.count_if(
        confidence_weight(F.col("confidence")) < CONFIDENCE_RANK[min_confidence.upper()]
    )
    counts = findings.groupBy("site").agg(low.alias("hidden"))
    return sites.select("site").distinct().join(counts, "site", "left").na.fill(0)


def backend_hosts(endpoints: DataFrame) -> DataFrame:
    """API addresses per host, asset and analytics hosts left out."""
    return (
        endpoints.where(F.col("endpoint_kind").isin("api", "graphql", "websocket"))
        .withColumn("host", host_of(F.col("url")))
        .where((F.col("host") != "") & is_backend_host(F.col("host")))
        .groupBy("site", "base_url", "host").agg(F.count("*").alias("n"))
    )


def topk_hosts(endpoints: DataFrame, k: int = 15) -> DataFrame:
    rank = Window.partitionBy("site").orderBy(F.desc("n"), "host")
    return (
        backend_hosts(endpoints).withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
    )


def backend_summary(endpoints: DataFrame) -> DataFrame:
    """One finding per site: its backend hosts, the 15 busiest by name."""
    domain = host_of(F.col("base_url"))
    root = registrable(domain)
    own = (F.col("host") == domain) | (F.col("host") == root) | F.endswith(
        F.col("host"), F.concat(F.lit("."), root)
    )
    hosts = backend_hosts(endpoints)
    totals = hosts.groupBy("site", "base_url").agg(
        F.count("*").alias("hosts"), F.count_if(~own).alias("external")
    )
    line = F.concat("host", F.lit(" ("), F.col("n").cast("string"), F.lit(" endpoints)"))
    listed = topk_hosts(endpoints).groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")
    )
    rows = totals.join(listed, "site").withColumn(
        "listing", F.array_join(F.transform("lines", lambda x: x["line"]), ", ")
    )
    return to_findings(
        rows, "endpoints", EXPOSURE, asset_seq=F.lit(0), rule_ord=F.lit(400),
        title=F.lit("Backend hosts discovered"), severity=F.lit("INFO"),
        confidence=F.lit("CONFIRMED"), value=F.col("listing"),
        url=F.col("base_url"), line=F.lit(0), col=F.lit(0), snippet=F.lit(""),
        detail=F.concat(
            F.lit("The scanned pages call "), F.col("hosts").cast("string"),
            F.lit(" backend host(s)"),
            F.when(F.col("external") > 0, F.concat(
                F.lit("; "), F.col("external").cast("string"),
                F.lit(" belong to others"))).otherwise(""),
            F.lit(". A test of the site has to cover each of them.")),
        remediation=F.lit("Look at login and origin rules of each host."),
        evidence=evidence_of(hosts=F.col("listing")),
        tags=tags_of("recon", "backend"),
    )


def url_scope_breakdown(urls: DataFrame) -> DataFrame:
    return urls.groupBy("site", "scope").agg(F.count("*").alias("urls"))


def rows_per_category(
    findings: DataFrame, limit: int = 40, min_confidence: str = "FIRM", *ties: str
) -> DataFrame:
    """The first findings of each category in report order: a top-k report. ``ties`` are columns
    that decide between findings of one place."""
    rank = Window.partitionBy("site", "category").orderBy(*finding_sort(), *ties)
    return (
        filter_min_confidence(findings, min_confidence)
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit)
    )


def scan_stats(
    assets: DataFrame, captures: DataFrame, findings: DataFrame, endpoints: DataFrame,
    urls: DataFrame, technologies: DataFrame, services: DataFrame,
) -> DataFrame:
    """Counters per site. Each input is reduced to one row per site before the joins."""
    requests = captures.groupBy("site").agg(F.count_distinct("url").alias("requests"))
    scanned = assets.groupBy("site").agg(
        F.count("*").alias("assets_scanned"), F.sum(fact(assets, "f_chars", lambda: F.length("content"))).alias("bytes_scanned")
    )
    out = requests.join(scanned, "site", "left")
    for name, table in (
        ("findings", findings), ("endpoints", endpoints), ("urls", urls),
        ("technologies", technologies), ("services", services),
    ):
        out = out.join(table.groupBy("site").agg(F.count("*").alias(name)), "site", "left")
    return out.na.fill(0)


def detector_errors(captures: DataFrame) -> DataFrame:
    """Captures no detector can read, with the reason; the scan itself goes on."""
    from ..sources.assets import is_textual

    reason = (
        F.when(F.col("url").isNull() | (host_of(F.col("url")) == ""), "no usable url")
        .when(~is_textual(F.col("content_type")), "binary content")
        .when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty body")
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    )
    return captures.select("site", "asset_seq", "url", reason.alias("error")).where("error is not null")
