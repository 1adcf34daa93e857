"""Captured responses as the ``assets`` table every operator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window

from ..functions.sqlexpr import F
from ..functions.text import clean_marks, strip
from ..functions.urls import path_of

# What counts as text and as script, and the page extensions.
TEXTUAL = ("text/", "json", "javascript", "xml", "html", "ecmascript", "css")
JS_TYPES = ("javascript", "ecmascript", "jsx", "typescript")
JS_PATHS = (".js", ".mjs", ".cjs")
HTML_PATHS = (".html", ".htm", ".php", ".asp", ".aspx", ".jsp")

CAPTURE_SCHEMA = (
    "site string, base_url string, asset_seq bigint, is_main boolean, url string, status int, "
    "content_type string, headers map<string,string>, content string"
)
#: Rows of a file of captures: some MB, so that a table of one row group still fills the cores.
ROWS_PER_FILE = 1000


def _any(text: Column, needles) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def _ends(text: Column, suffixes) -> Column:
    out = F.lit(False)
    for suffix in suffixes:
        out = out | text.endswith(suffix)
    return out


def is_textual(content_type: Column) -> Column:
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    return (lowered == "") | _any(lowered, TEXTUAL)


def classify_kind(url: Column, content_type: Column, content: Column) -> Column:
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    path = F.lower(path_of(url))
    opening = F.lower(F.left(F.ltrim(content, F.lit(" \t\n\r\x0b\x0c")), F.lit(200)))
    return (
        F.when(path.endswith(".map"), "map")
        .when(_any(lowered, JS_TYPES) | _ends(path, JS_PATHS), "js")
        .when(lowered.contains("json") | path.endswith(".json"), "json")
        .when(lowered.contains("css") | path.endswith(".css"), "css")
        .when(lowered.contains("html") | _ends(path, HTML_PATHS), "html")
        .when(
            (lowered == "") & (opening.startswith("<!doctype html") | opening.startswith("<html")),
            "html",
        )
        .otherwise("other")
    )


def is_admitted() -> Column:
    return (
        is_textual(F.col("content_type"))
        & (F.coalesce(F.length("content"), F.lit(0)) > 0)
        & (F.col("status") < 400)
    )


def scan_responses(captures: DataFrame) -> DataFrame:
    """Admit responses: textual, with a body, status below 400. A narrow step."""
    admitted = captures.where(is_admitted()).withColumn("content", clean_marks(F.col("content")))
    return admitted.withColumn(
        "kind", classify_kind(F.col("url"), F.col("content_type"), F.col("content"))
    )


def asset_cap(assets: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` captures of each site: a report for planning crawls. No scan uses it.

    The rank runs over keys, not bodies, and Spark's window group limit cuts each task's
    rows to ``limit`` per site before the shuffle, so one huge site stays small.
    """
    first = Window.partitionBy("site").orderBy("asset_seq")
    kept = (
        assets.select("site", "asset_seq")
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= limit)
        .drop("_rn")
    )
    return assets.join(kept, ["site", "asset_seq"], "left_semi")


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captures from parquet, orc, or JSON lines; the schema is given, never inferred."""
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(CAPTURE_SCHEMA)
    return reader.load(path)


# Host name shape of a scan target.
_HOSTNAME = (
    r"^(?=.{1,253}$)(?!-)[A-Za-z0-9-_]{1,63}(?<!-)"
    r"(?:\.(?!-)[A-Za-z0-9-_]{1,63}(?<!-))*+\.?$"
)
_IPV6 = r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$"


def normalize_target(targets: DataFrame, column: str = "target") -> DataFrame:
    """Adds base_url, domain, scheme_inferred and, for a bad target, the reason.

    Rows with a reason belong in a rejects table; the rest are scan targets.
    """
    from ..functions.urls import authority_of, host_of, scheme_of

    raw = strip(F.coalesce(F.col(column), F.lit("")))
    inferred = ~raw.contains("://")
    full = F.when(inferred, F.concat(F.lit("https://"), raw)).otherwise(raw)
    host = host_of(full)
    valid_host = host.rlike(_HOSTNAME) | host.rlike(_IPV6)
    reason = (
        F.when(raw == "", "empty target")
        .when(~scheme_of(full).isin("http", "https"), "unsupported scheme")
        .when(host == "", "no hostname")
        .when(~valid_host, "invalid hostname")
    )
    path = F.when(path_of(full) == "", F.lit("/")).otherwise(path_of(full))
    query = F.regexp_extract(full, r"^[^?#]*(\?[^#]+)?", 1)
    base = F.concat(scheme_of(full), F.lit("://"), authority_of(full), path, query)
    return targets.withColumns(
        {
            "scheme_inferred": inferred & (raw != ""),
            "reject_reason": reason,
            "base_url": F.when(reason.isNull(), base),
            "domain": F.when(reason.isNull(), host),
        }
    )
