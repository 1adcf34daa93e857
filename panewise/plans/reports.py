"""Site reports as tables of lines, written in order without gathering a site anywhere.

A report is rows (site, section, item, part, line). Sorting by those columns is a range sort:
a site with a third of all rows spans many tasks, and its report is the files of its folder
read in name order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window

from ..functions.sqlexpr import F
from ..functions.text import redact
from ..model import (
    ACCESS, EXPOSURE, FINDING_ORDER, HEADER, SECRET, SEVERITIES, SEVERITY_RANK, VULNERABILITY,
    confidence_weight, severity_weight,
)
from ..operators import results as rs
from ..session import checkpoint_dir
from .scan import Scan

LINE_ORDER = ("site", "section", "item", "part")
API_KINDS = ("api", "graphql", "websocket")
#: Categories in the order of the screen summary, with their headings.
HEADINGS = {
    SECRET: "[!] SECRETS & CREDENTIALS",
    VULNERABILITY: "[!] VULNERABILITIES & BAD PRACTICES",
    ACCESS: "[!] ROLES, PERMISSIONS & ACCESS CONTROL",
    EXPOSURE: "[!] INFORMATION EXPOSURE",
    HEADER: "[+] SECURITY HEADERS",
}


def shown_value(findings: DataFrame) -> DataFrame:
    """Credentials never leave in full: values, and the places that quote them, are cut."""
    secret, value = F.col("category") == SECRET, F.col("value")
    safe = redact(value)

    def quoted(snippet: Column) -> Column:
        cut = F.replace(snippet, value, safe)
        partial = (F.length(value) > 15) & F.contains(cut, F.left(value, F.lit(12)))
        return F.when(secret & partial, "").when(secret, cut).otherwise(snippet)

    return findings.withColumns(
        {
            "value": F.when(secret, safe).otherwise(value),
            "snippet": quoted(F.col("snippet")),
            "also_seen": F.transform(
                "also_seen",
                lambda p: F.struct(
                    p["url"].alias("url"), p["line"].alias("line"), p["col"].alias("col"),
                    quoted(p["snippet"]).alias("snippet"),
                ),
            ),
        }
    )


def numbered(findings: DataFrame) -> DataFrame:
    """Adds each finding's number in its site's report and the category before it.

    The rows are range sorted and checkpointed, so partitions are fixed; numbers then come
    from counts per (site, partition), never from one task per site.
    """
    checkpoint_dir(findings.sparkSession)
    ordered = (
        findings.orderBy("site", *rs.finding_sort()).checkpoint()
        .withColumn("pid", F.spark_partition_id())
        .withColumn("mid", F.monotonically_increasing_id())
    )
    parts = ordered.groupBy("site", "pid").agg(
        F.count("*").alias("n"), F.min("mid").alias("first_mid"),
        F.max_by("category", "mid").alias("last_category"),
    )
    by_site = Window.partitionBy("site").orderBy("pid")
    before = parts.select(
        "site", "pid", "first_mid",
        F.sum("n").over(by_site.rowsBetween(Window.unboundedPreceding, -1)).alias("base"),
        F.lag("last_category").over(by_site).alias("category_before"),
    )
    in_part = Window.partitionBy("site", "pid").orderBy("mid")
    return (
        ordered.join(before, ["site", "pid"])
        .withColumn("category_here", F.lag("category").over(in_part))
        .withColumn(
            "index",
            F.coalesce(F.col("base"), F.lit(0)) + F.col("mid") - F.col("first_mid") + 1,
        )
        .withColumn("previous_category", F.coalesce("category_here", "category_before"))
        .drop("pid", "mid", "first_mid", "base", "category_before", "category_here")
    )


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _escape_code(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("`"), F.lit("'")), F.lit("\n"), F.lit(" "))


def _cells(*cells) -> Column:
    parts: list[Column] = [F.lit("| ")]
    for i, cell in enumerate(cells):
        parts += [cell, F.lit(" | " if i < len(cells) - 1 else " |")]
    return F.concat(*parts)


def _lines(rows: DataFrame, section: int, item: Column, lines: Column, *keep) -> DataFrame:
    """Explode an array of lines; null entries are lines that do not apply."""
    return rows.select(
        "site", *keep, F.lit(section).alias("section"), item.cast("bigint").alias("item"),
        F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("part", "line"),
    )


def _ranked(rows: DataFrame, order: list, limit: int | None = None) -> DataFrame:
    """Position in a listing; listings with a limit are top-k reports."""
    if limit is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("site").orderBy(*order))
    return rows.withColumn("rn", rank).where(F.col("rn") <= limit)


def _texts(*lines) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])


def _headed(rows: DataFrame, section: int, heading: list, order: list[Column], line: Column,
            limit: int | None = None) -> DataFrame:
    """A listing with a heading and a closing blank line. Lines sort by a text key, so no
    site-wide numbering is needed."""
    listed = _ranked(rows, order, limit)
    head = rows.select("site").distinct()
    key = F.concat_ws("\x1f", *order)
    body = listed.select(
        "site", F.lit(section).alias("section"), F.lit(1).cast("bigint").alias("item"),
        key.alias("sort_key"), F.lit(0).alias("part"), line.alias("line"),
    )
    top = _lines(head, section, F.lit(0), _texts(*heading)).withColumn("sort_key", F.lit(""))
    end = _lines(head, section, F.lit(2), _texts("")).withColumn("sort_key", F.lit(""))
    return top.unionByName(body).unionByName(end)


def _where(url: Column, line: Column) -> Column:
    return F.concat(url, F.when(line > 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(""))


def markdown_lines(scan: Scan, min_confidence: str = "TENTATIVE") -> DataFrame:
    """The full site report in Markdown, as ordered lines."""
    findings = rs.filter_min_confidence(scan.findings, min_confidence)
    counts = rs.severity_counts(scan.findings, scan.sites, min_confidence)
    head = counts.join(scan.stats, "site", "left").na.fill(0)
    text = lambda c: F.col(c).cast("string")
    top = _lines(head, 0, F.lit(0), _texts(
        F.concat(F.lit("# Front-end security scan — "), F.col("site")), "",
        "| | |", "|---|---|",
        _cells(F.lit("Target"), F.col("site")),
        _cells(F.lit("Requests"), text("requests")),
        _cells(F.lit("Assets scanned"), text("assets_scanned")),
        _cells(F.lit("Bytes scanned"), text("bytes_scanned")), "",
        "## Findings by severity", "", "| Severity | Count |", "|---|---|",
        *[_cells(F.lit(s), text(s.lower())) for s in SEVERITIES], "",
    ))
    f = numbered(shown_value(findings))
    more = F.col("occurrences") - 1
    code = lambda s: F.concat(F.lit("`"), _escape_code(s), F.lit("`"))
    block = F.concat(
        F.when(F.coalesce(F.col("previous_category"), F.lit("")) != F.col("category"),
               F.array(F.concat(F.lit("### "), F.col("category")), F.lit("")))
        .otherwise(F.array().cast("array<string>")),
        F.array(
            F.concat(F.lit("#### "), F.col("index").cast("string"), F.lit(". ["),
                     F.col("severity"), F.lit("] "), _escape(F.col("title"))),
            F.lit(""),
            F.concat(F.lit("- **Confidence:** "), F.col("confidence")),
            F.when(F.col("value") != "",
                   F.concat(F.lit("- **Value:** "), code(F.col("value")))),
            F.concat(F.lit("- **Location:** "), _where(F.col("url"), F.col("line"))),
            F.when(more > 0, F.concat(F.lit("- **Also seen in:** "), more.cast("string"),
                                      F.lit(" other location(s)"))),
        ),
        F.transform(F.slice("also_seen", 1, 8),
                    lambda p: F.concat(F.lit("  - "), _where(p["url"], p["line"]))),
        F.array(
            F.when(F.col("detail") != "",
                   F.concat(F.lit("- **Detail:** "), _escape(F.col("detail")))),
            F.when(F.col("remediation") != "",
                   F.concat(F.lit("- **Remediation:** "), _escape(F.col("remediation")))),
            F.when(F.size("tags") > 0,
                   F.concat(F.lit("- **Tags:** "), F.array_join("tags", ", "))),
        ),
        F.when(F.col("snippet") != "", F.array(
            F.lit(""), F.lit("```"), F.left("snippet", F.lit(400)), F.lit("```")))
        .otherwise(F.array().cast("array<string>")),
        F.transform(
            F.filter(F.array_sort(F.map_entries("evidence")), lambda e: e["value"] != ""),
            lambda e: F.concat(F.lit("- _"), e["key"], F.lit("_: "),
                               code(F.left(e["value"], F.lit(300))))),
        F.array(F.lit("")),
    )
    finding_lines = _lines(f, 4, F.col("index"), block).unionByName(
        _lines(findings.select("site").distinct(), 4, F.lit(0), _texts("## Findings", ""))
    )
    api = scan.endpoints.where(F.col("endpoint_kind").isin(*API_KINDS))
    pages = scan.endpoints.where("endpoint_kind = 'page'")
    url_count = scan.urls.groupBy("site").agg(F.count("*").alias("n"))
    url_lines = _headed(scan.urls, 7, [""], [F.col("url")], F.concat(F.lit("- "), F.col("url")),
                        limit=500)
    url_head = _lines(url_count, 7, F.lit(-1), _texts(
        F.concat(F.lit("## All URLs ("), F.col("n").cast("string"), F.lit(")"))))
    version = F.when(F.col("version") == "", "unknown").otherwise(F.col("version"))
    listings = [
        _headed(scan.technologies, 2,
                ["## Technologies and versions", "", "| Name | Version | Category | Evidence |",
                 "|---|---|---|---|"],
                [F.col("category"), F.col("name")],
                _cells(*[_escape(c) for c in (F.col("name"), version, F.col("category"),
                                              F.col("evidence"))])),
        _headed(scan.services, 3,
                ["## Third-party services", "", "| Service | Category | Host |", "|---|---|---|"],
                [F.col("category"), F.col("name")],
                _cells(*[_escape(F.col(c)) for c in ("name", "category", "host")])),
        _headed(api, 5,
                ["## API endpoints", "", "| Method | Endpoint | Kind | Scope |",
                 "|---|---|---|---|"],
                [F.col("scope"), F.col("url"), F.col("method")],
                _cells(F.col("method"), _escape(F.col("url")), F.col("endpoint_kind"),
                       F.col("scope"))),
        _headed(pages, 6, ["## Routes / pages discovered", ""], [F.col("url"), F.col("method")],
                F.concat(F.lit("- "), F.col("url")), limit=200),
        url_lines,
        _headed(scan.emails, 8, ["## Email addresses", ""], [F.col("email")],
                F.concat(F.lit("- "), F.col("email"))),
        _headed(scan.errors, 9, ["## Request errors", ""], [F.col("url"), F.col("error")],
                F.concat(F.lit("- "), _escape(F.concat("url", F.lit(": "), "error"))), limit=100),
    ]
    plain = [top, finding_lines, url_head]
    return reduce(
        DataFrame.unionByName,
        [p.withColumn("sort_key", F.lit("")) for p in plain] + listings,
    )


def text_lines(scan: Scan, min_confidence: str = "TENTATIVE") -> DataFrame:
    """The plain-text site report, as ordered lines."""
    rule = "=" * 78
    counts = rs.severity_counts(scan.findings, scan.sites, min_confidence)
    requests = scan.captures.groupBy("site").agg(F.count_distinct("url").alias("requests"))
    head = counts.join(requests, "site", "left").na.fill(0)
    totals = F.concat_ws("  ", *[
        F.concat(F.lit(s + "="), F.col(s.lower()).cast("string")) for s in SEVERITIES])
    top = _lines(head, 0, F.lit(0), _texts(
        rule, F.concat(F.lit("FRONT-END SECURITY SCAN — "), F.col("site")),
        F.concat(F.col("requests").cast("string"), F.lit(" requests")), rule, "",
        F.concat(F.lit("SEVERITY: "), totals)))
    f = numbered(shown_value(rs.filter_min_confidence(scan.findings, min_confidence)))
    block = F.array(
        F.lit(""),
        F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("severity"),
                 F.lit(" — "), F.col("title"), F.lit(" ("), F.col("confidence"), F.lit(")")),
        F.when(F.col("value") != "",
               F.concat(F.lit("    value : "), F.left("value", F.lit(200)))),
        F.concat(F.lit("    where : "), _where(F.col("url"), F.col("line"))),
        F.when(F.col("occurrences") > 1, F.concat(
            F.lit("    seen  : "), F.col("occurrences").cast("string"), F.lit(" location(s)"))),
        F.when(F.col("detail") != "", F.concat(F.lit("    detail: "), F.col("detail"))),
        F.when(F.col("remediation") != "",
               F.concat(F.lit("    fix   : "), F.col("remediation"))),
        F.when(F.col("snippet") != "",
               F.concat(F.lit("    code  : "), F.left("snippet", F.lit(200)))),
    )
    finding_lines = _lines(f, 3, F.col("index"), block).unionByName(
        _lines(f.select("site").distinct(), 3, F.lit(0),
               _texts("", "-- FINDINGS " + "-" * 66)))
    version = F.when(F.col("version") == "", "unknown").otherwise(F.col("version"))
    api = scan.endpoints.where(F.col("endpoint_kind").isin(*API_KINDS))
    url_count = scan.urls.groupBy("site").agg(F.count("*").alias("n"))
    url_head = _lines(url_count, 5, F.lit(-1), _texts(
        "", F.concat(F.lit("-- URLS ("), F.col("n").cast("string"), F.lit(") " + "-" * 55))))

    def wide(c: Column, n: int) -> Column:
        return F.rpad(F.left(c, F.lit(n)), n, " ")

    listings = [
        _headed(scan.technologies, 1, ["", "-- TECHNOLOGIES " + "-" * 62],
                [F.lower("name"), F.col("name")],
                F.concat(F.lit("  "), wide(F.col("name"), 34), F.lit(" "), wide(version, 14),
                         F.lit(" "), F.col("category"))),
        _headed(scan.services, 2, ["", "-- THIRD-PARTY SERVICES " + "-" * 54], [F.col("name")],
                F.concat(F.lit("  "), wide(F.col("name"), 34), F.lit(" "), F.col("category"))),
        _headed(api, 4, ["", "-- API ENDPOINTS " + "-" * 61], [F.col("url"), F.col("method")],
                F.concat(F.lit("  "), F.rpad("method", 7, " "), F.lit(" "), F.col("url"))),
    ]
    urls = scan.urls.select(
        "site", F.lit(5).alias("section"), F.lit(1).cast("bigint").alias("item"),
        F.col("url").alias("sort_key"), F.lit(0).alias("part"),
        F.concat(F.lit("  "), F.col("url")).alias("line"))
    # The closing blank line of a listing belongs to the Markdown layout only.
    listings = [x.where("not (item = 2 and line = '')") for x in listings]
    end = _lines(counts, 6, F.lit(0), _texts("", rule))
    plain = [top, finding_lines, url_head, end]
    return reduce(
        DataFrame.unionByName,
        [p.withColumn("sort_key", F.lit("")) for p in plain] + listings + [urls],
    )


def json_rows(scan: Scan, min_confidence: str = "TENTATIVE") -> DataFrame:
    """Report content as JSON, one row per entry: (site, section, json)."""
    def rows(table: DataFrame, section: str, *columns) -> DataFrame:
        return table.select(
            "site", F.lit(section).alias("section"), F.to_json(F.struct(*columns)).alias("json"))

    version = F.when(F.col("version") == "", "unknown").otherwise(F.col("version"))
    findings = shown_value(rs.filter_min_confidence(scan.findings, min_confidence))
    location = F.struct("url", "line", F.col("col").alias("column"), "snippet")
    counts = rs.severity_counts(scan.findings, scan.sites, min_confidence)
    summary = counts.join(scan.stats, "site", "left").na.fill(0)
    stats = ("requests", "assets_scanned", "bytes_scanned", "findings", "endpoints", "urls",
             "technologies", "services")
    return reduce(DataFrame.unionByName, [
        rows(summary, "summary",
             F.struct(*[F.col(s.lower()).alias(s) for s in SEVERITIES]).alias("severity_counts"),
             F.struct(*stats).alias("stats")),
        rows(scan.technologies, "technologies", "name", version.alias("version"), "category",
             "evidence", "source"),
        rows(scan.services, "services", "name", "host", "category"),
        rows(scan.endpoints, "endpoints", "method", "url",
             F.col("endpoint_kind").alias("kind"), "scope", "source"),
        rows(findings, "findings", "category", "title", "severity", "confidence", "value",
             "detail", "remediation", "evidence", "tags", "occurrences",
             location.alias("location"), "also_seen"),
        rows(scan.urls, "urls", "url"),
        rows(scan.emails, "emails", "email"),
        rows(scan.errors, "errors", "url", "error"),
    ])


def report_name(domain: Column, stamp: Column) -> Column:
    """A file-safe name for a site's report; a hash keeps apart sites whose names were altered."""
    site = F.coalesce(domain, F.lit("target"))
    safe = F.btrim(F.regexp_replace(site, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    mark = F.when(safe == site, "").otherwise(
        F.concat(F.lit("_"), F.left(F.sha2(site, F.lit(256)), F.lit(8)))
    )
    return F.concat(F.when(safe == "", "target").otherwise(safe), mark, F.lit("_"), stamp)


def write_lines(lines: DataFrame, path: str, stamp: str) -> None:
    """Ordered text files, one folder per site."""
    (
        lines.orderBy("site", "section", "item", "sort_key", "part")
        .select(report_name(F.col("site"), F.lit(stamp)).alias("report"),
                F.col("line").alias("value"))
        .write.mode("overwrite").partitionBy("report").text(path)
    )


def write_json(rows: DataFrame, path: str, stamp: str) -> None:
    """JSON lines in one folder per site and section."""
    (
        rows.select(report_name(F.col("site"), F.lit(stamp)).alias("report"), "section",
                    F.col("json").alias("value"))
        .repartitionByRange("report", "section", "value")
        .write.mode("overwrite").partitionBy("report", "section").text(path)
    )


def write_reports(scan: Scan, directory: str, stamp: str, formats=("json", "md"),
                  min_confidence: str = "TENTATIVE") -> list[str]:
    """Write the asked formats below ``directory`` and return the folders."""
    written = []
    for fmt in (f.strip().lower() for f in formats):
        path = f"{directory}/{ {'markdown': 'md', 'text': 'txt'}.get(fmt, fmt) }"
        if fmt == "json":
            write_json(json_rows(scan, min_confidence), path, stamp)
        elif fmt in ("md", "markdown"):
            write_lines(markdown_lines(scan, min_confidence), path, stamp)
        elif fmt in ("txt", "text"):
            write_lines(text_lines(scan, min_confidence), path, stamp)
        else:
            continue
        written.append(path)
    return written


def _row(*cells) -> Column:
    return F.concat(F.lit("  "), F.concat_ws("  ", *cells))


def _short(url: Column) -> Column:
    """The end of a long address."""
    tail = F.substring_index(url, "/", -1)
    return (
        F.when(F.length(url) <= 46, url).when(tail != "", F.concat(F.lit("…/"), tail))
        .otherwise(F.right(url, F.lit(46)))
    )


def _report_order() -> list[Column]:
    """Texts that sort findings of a category in report order; a digest of the key holds together
    the lines of findings that have the same place."""
    numbers = [F.lpad(F.col(c).cast("string"), 19, "0") for c in FINDING_ORDER]
    severity = F.lit(5) - severity_weight(F.col("severity"))
    confidence = F.lit(3) - confidence_weight(F.col("confidence"))
    return [
        severity.cast("string"), confidence.cast("string"), F.col("title"), *numbers,
        F.left(F.sha2("key", F.lit(256)), F.lit(8)),
    ]


def _rest(max_rows: int) -> Column:
    rest = F.col("n") - max_rows
    return F.when(rest > 0, F.concat(
        F.lit("  … and "), rest.cast("string"), F.lit(" more in the report file")))


def console_panel(scan: Scan) -> DataFrame:
    """Per site: the figures at the top of the screen summary."""
    shown = scan.options.min_confidence
    counts = rs.severity_counts(scan.findings, scan.sites, shown)
    headline = F.concat_ws("  ", *[
        F.when(F.col(s.lower()) > 0, F.concat(F.col(s.lower()).cast("string"), F.lit(" " + s)))
        for s in SEVERITIES])
    return (
        counts.join(rs.hidden_count(scan.findings, scan.sites, shown), "site")
        .join(scan.stats.select("site", "requests", "bytes_scanned"), "site", "left")
        .select(
            "site", F.coalesce("requests", F.lit(0)).alias("requests"),
            F.floor(F.coalesce("bytes_scanned", F.lit(0)) / 1024).alias("kb_scanned"),
            F.when(headline == "", "no findings above the confidence threshold")
            .otherwise(headline).alias("headline"),
            "hidden",
        )
    )


def console_findings(scan: Scan, max_rows: int = 40) -> list[DataFrame]:
    """Findings by category: the first rows, how many more there are, and the details of every
    finding of severity HIGH or worse. Lines sort by a text key, so no window holds a category."""
    shown = scan.options.min_confidence
    visible = rs.filter_min_confidence(scan.findings, shown)
    per_category = visible.groupBy("site", "category").agg(F.count("*").alias("n"))
    first = rs.rows_per_category(scan.findings, max_rows, shown, "key")
    grave = visible.where(
        (severity_weight(F.col("severity")) >= SEVERITY_RANK["HIGH"]) & (F.col("detail") != ""))
    # categories of a user's own detectors come last
    place = F.array_position(F.array(*[F.lit(c) for c in HEADINGS]), F.col("category"))
    item = F.when(place > 0, place).otherwise(len(HEADINGS) + 1)
    heading = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair]), F.col("category")),
        F.concat(F.lit("[!] "), F.upper("category")),
    )

    def key(step: str, *order: Column) -> Column:
        return F.concat_ws("\x1f", F.col("category"), F.lit(step), *order).alias("sort_key")

    more = F.col("occurrences") - 1
    row = _row(
        "severity", F.initcap(F.left("confidence", F.lit(4))), "title",
        F.when(F.col("value") != "", F.col("value")).otherwise(F.left("snippet", F.lit(80))),
        F.concat(
            _where(_short(F.col("url")), F.col("line")),
            F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)")))
            .otherwise("")),
    )
    return [
        _lines(per_category, 3, item, _texts(
            "", heading, "  Sev  Conf  Issue  Value / evidence  Where"), key("0")),
        _lines(shown_value(first), 3, item, _texts(row), key("1", *_report_order())),
        _lines(per_category, 3, item, _texts(_rest(max_rows)), key("2")),
        _lines(grave, 3, item, _texts(
            F.concat(F.lit("  ▸ "), F.col("title"), F.lit(" "), F.col("detail")),
            F.when(F.col("remediation") != "",
                   F.concat(F.lit("    fix: "), F.col("remediation"))),
        ), key("3", *_report_order())),
    ]


def console_summary(scan: Scan, max_rows: int = 40, verbose: bool = False) -> DataFrame:
    """The screen summary of every site, as lines that sort by site, section, item, sort_key and
    part: the panel, whose figures are columns of its lines too, technologies, services, findings
    by category with the details of HIGH and worse, API endpoints, URLs by scope and, if
    ``verbose``, request errors. Colours and boxes are left out."""
    text = lambda c: F.col(c).cast("string")
    per_site = lambda rows: rows.groupBy("site").agg(F.count("*").alias("n"))
    key = lambda *order: F.concat_ws("\x1f", *order).alias("sort_key")
    figures = ("requests", "kb_scanned", "headline", "hidden")
    top = _lines(console_panel(scan), 0, F.lit(0), _texts(
        "SCAN SUMMARY",
        F.concat(F.lit("Target      "), F.col("site")),
        F.concat(F.lit("Requests    "), text("requests"), F.lit(" request(s)   ·   "),
                 text("kb_scanned"), F.lit(" KB scanned")),
        F.concat(F.lit("Findings    "), F.col("headline")),
        F.when(F.col("hidden") > 0, F.concat(
            text("hidden"), F.lit(" low-confidence finding(s) hidden; min_confidence TENTATIVE "
                                  "shows them"))),
    ), *figures, key(F.lit("")))
    version = F.when(F.col("version") == "", "unknown").otherwise(F.col("version"))
    technologies = [
        _lines(per_site(scan.technologies), 1, F.lit(0), _texts(
            "", "[+] TECHNOLOGIES & VERSIONS", "  Name  Version  Category  Evidence"),
            key(F.lit(""))),
        _lines(scan.technologies, 1, F.lit(1), _texts(_row("name", version, "category", "evidence")),
               key("category", F.lower("name"), "name")),
    ]
    services = [
        _lines(per_site(scan.services), 2, F.lit(0), _texts(
            "", "[+] THIRD-PARTY SERVICES", "  Service  Category  Host"), key(F.lit(""))),
        _lines(scan.services, 2, F.lit(1), _texts(_row("name", "category", "host")),
               key("category", "name")),
    ]
    api = scan.endpoints.where(F.col("endpoint_kind").isin(*API_KINDS))
    calls = per_site(api)
    own_first = [
        F.when(F.col("scope") == "same-origin", "0").otherwise("1"), F.col("url"), F.col("method")]
    endpoints = [
        _lines(calls, 4, F.lit(0), _texts(
            "", F.concat(F.lit("[+] API ENDPOINTS ("), text("n"), F.lit(")")),
            "  Method  Endpoint  Kind  Scope"), key(F.lit(""))),
        _lines(_ranked(api, own_first, max_rows), 4, F.lit(1), _texts(
            _row("method", "url", "endpoint_kind", "scope")), key(*own_first)),
        _lines(calls, 4, F.lit(2), _texts(_rest(max_rows)), key(F.lit(""))),
    ]
    scopes = rs.url_scope_breakdown(scan.urls).groupBy("site").agg(
        F.sum("urls").alias("n"),
        F.array_sort(F.collect_list(F.struct("scope", "urls"))).alias("scopes"))
    breakdown = F.array_join(F.transform(
        "scopes", lambda s: F.concat(s["urls"].cast("string"), F.lit(" "), s["scope"])), ", ")
    urls = _lines(scopes, 5, F.lit(0), _texts("", F.concat(
        F.lit("[+] "), text("n"), F.lit(" URL(s) collected ("), breakdown, F.lit(")"))),
        key(F.lit("")))
    lines = [top, *technologies, *services, *console_findings(scan, max_rows), *endpoints, urls]
    if verbose:
        met = [F.lpad(text("asset_seq"), 19, "0"), F.col("url"), F.col("error")]
        lines += [
            _lines(per_site(scan.errors), 6, F.lit(0), _texts("", "Request errors"), key(F.lit(""))),
            _lines(_ranked(scan.errors, met, 20), 6, F.lit(1), _texts(
                F.concat(F.lit("  "), F.concat_ws(": ", "url", "error"))), key(*met)),
        ]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lines)
    return out.select(
        "site", *figures, "section", "item", "sort_key", "part",
        F.translate("line", "\r\n", "  ").alias("line"),
    )
