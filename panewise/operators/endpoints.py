"""URLs, API calls, routes, sockets and mail addresses: the map of what a site talks to.

Endpoint rows are (site, base_url, asset_seq, phase, region_idx, op, pos, method, url,
endpoint_kind, scope, inferred, source); the order columns replace "first seen".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame

from ..functions.sqlexpr import F
from ..functions.predicates import is_mime_type, is_route_like
from ..functions.text import exploded, pinned, rx, strip
from ..functions.urls import (
    clean_url, endpoint_kind, has_static_extension, host_of, is_api_like, is_api_path, join_url,
    resolve_api_path, url_scope,
)
from ..rules import endpoints as R
from .facts import fact
from .hits import hits

ORDER = ("asset_seq", "phase", "region_idx", "op", "pos")
COLUMNS = (
    "site", "base_url", *ORDER, "method", "url", "endpoint_kind", "scope", "inferred", "source",
)
_BASE = ("site", "base_url", "asset_seq")


def _mentions(pattern: str, group: int, prefix: str, hint: str) -> Column:
    """Matches over a whole text without trailing punctuation."""
    content = F.col("content")
    found = F.transform(
        F.regexp_extract_all(content, F.lit(rx(pattern)), F.lit(group)),
        lambda u: F.concat(F.lit(prefix), F.regexp_replace(u, rx(R.TRAILING_JUNK), "")),
    )
    return F.when(content.contains(hint), found)


def url_matches() -> Column:
    return _mentions(R.ABSOLUTE_URL, 0, "", "://")


def relative_url_matches() -> Column:
    return _mentions(R.PROTOCOL_RELATIVE, 1, "https://", "//")


def socket_matches() -> Column:
    return _mentions(R.WEBSOCKET, 0, "", "://")


def email_matches() -> Column:
    found = F.regexp_extract_all("content", F.lit(rx(R.EMAIL)), F.lit(0))
    return F.when(F.col("content").contains("@"), F.array_distinct(found))


def _found(assets: DataFrame, found: Column) -> DataFrame:
    return exploded(assets, (*_BASE, F.col("url").alias("source")), found, "pos", "found")


def _domain() -> Column:
    return host_of(F.col("base_url"))


def _endpoint(rows: DataFrame, first_phase: int, first_op: int, **columns: Column) -> DataFrame:
    """Endpoint rows; order columns that ``rows`` lacks take the given places."""
    base = {
        "phase": F.lit(first_phase), "op": F.lit(first_op),
        "region_idx": F.lit(0), "pos": F.lit(0),
        **{c: F.col(c) for c in ("phase", "op", "region_idx", "pos") if c in rows.columns},
        "scope": url_scope(F.col("url"), _domain()),
        **columns,
    }
    ints = {"phase", "op", "region_idx", "pos"}
    return rows.select(
        *[
            (base.get(c, F.col(c)).cast("int") if c in ints else base.get(c, F.col(c))).alias(c)
            for c in COLUMNS
        ]
    )


def absolute_urls(assets: DataFrame) -> DataFrame:
    found = fact(assets, "f_urls", url_matches)
    return _found(assets, found).withColumnRenamed("found", "url").withColumn("phase", F.lit(0))


def protocol_relative_urls(assets: DataFrame) -> DataFrame:
    found = fact(assets, "f_relative_urls", relative_url_matches)
    return _found(assets, found).withColumnRenamed("found", "url").withColumn("phase", F.lit(1))


def recorded_urls(assets: DataFrame) -> DataFrame:
    """Cleaned URL mentions, with their order columns."""
    both = absolute_urls(assets).unionByName(protocol_relative_urls(assets))
    return pinned(both.withColumnRenamed("url", "found"), url=clean_url(F.col("found"))).where(
        F.col("url") != ""
    )


def url_endpoints(urls: DataFrame) -> DataFrame:
    """URL mentions that look like API addresses."""
    api = urls.where(~has_static_extension(F.col("url")) & is_api_like(F.col("url")))
    return _endpoint(
        api, 0, 0, method=F.lit("GET"), inferred=F.lit(True),
        endpoint_kind=endpoint_kind(F.col("url")),
    )


def websockets(assets: DataFrame) -> DataFrame:
    rows = _found(assets, fact(assets, "f_sockets", socket_matches)).withColumnRenamed(
        "found", "url"
    )
    return _endpoint(
        rows, 2, 0, method=F.lit("WS"), endpoint_kind=F.lit("websocket"), inferred=F.lit(False)
    )


def emails(assets: DataFrame) -> DataFrame:
    """Distinct addresses per site, all of them."""
    found = exploded(assets, ("site",), fact(assets, "f_emails", email_matches), "email")
    ending = r"(?i)\.(?:" + "|".join(e[1:] for e in R.EMAIL_NOT) + r")\z"
    return found.where(~F.col("email").rlike(ending)).distinct()


# ---- code-level operators ------------------------------------------------------------


def literal_path_gate(value: Column, name: Column) -> Column:
    v = strip(value)
    return v.startswith("/") & is_api_path(v)


def route_constant_gate(value: Column, name: Column) -> Column:
    """A lower-case multi-part route assigned to a name; not a type, file or style token."""
    v = strip(value)
    return (
        (name != "")
        & v.contains("/")
        & ~v.startswith("/")
        & is_route_like(v)
        & ~is_mime_type(v)
        & ~F.substring_index(v, "/", -1).contains(".")
        & ~F.substring_index(v, "/", 1).contains(".")
        & ~F.exists(F.split(v, "/"), lambda s: s.rlike(rx(r"^\d+$")))
    )


LITERAL_GATES = {"ep_literal": literal_path_gate, "ep_constant": route_constant_gate}


def record_calls(calls: DataFrame) -> DataFrame:
    """(raw_url, method, inferred) call rows as endpoint rows: absolute, cleaned, no assets."""
    raw = F.col("raw_url")
    skip = F.lit(False)
    for prefix in R.NOT_AN_ADDRESS:
        skip = skip | raw.startswith(prefix)
    absolute = (
        F.when(raw.startswith("http://") | raw.startswith("https://"), raw)
        .when(raw.startswith("//"), F.concat(F.lit("https:"), raw))
        .when(raw.startswith("/"), resolve_api_path(F.col("source"), F.col("base_url"), raw))
    )
    rows = pinned(
        calls.where((raw != "") & ~skip), url=clean_url(absolute)
    ).where((F.col("url") != "") & ~has_static_extension(F.col("url")))
    return _endpoint(
        rows, 3, 0, endpoint_kind=endpoint_kind(F.col("url"))
    )


def _calls(rows: DataFrame, op: int, raw: Column, method: Column, inferred: Column) -> DataFrame:
    return rows.select(
        *_BASE, F.col("url").alias("source"), "region_idx", "pos", F.lit(op).alias("op"),
        raw.alias("raw_url"), method.alias("method"), inferred.alias("inferred"),
    )


def _group(i: int) -> Column:
    return F.get("groups", F.lit(i))


def call_site_rows(hit_rows: DataFrame) -> DataFrame:
    """Request calls: the verb is in the call, in its options, or assumed."""
    option = F.upper(F.regexp_extract("tail", rx(R.METHOD_OPTION), 1))
    verb = F.upper(_group(0))
    return _calls(
        hit_rows.where("rule = 'ep_call'"), 0, strip(_group(1)),
        F.when(verb != "", verb).when(option != "", option).otherwise("GET"),
        (verb == "") & (option == ""),
    )


def mention_rows(hit_rows: DataFrame) -> DataFrame:
    return _calls(
        hit_rows.where("rule = 'ep_mention'"), 1, _group(1), F.upper(_group(0)), F.lit(False)
    )


def literal_path_rows(hit_rows: DataFrame) -> DataFrame:
    return _calls(
        hit_rows.where("rule = 'ep_literal'"), 2, strip(F.col("text")), F.lit("GET"), F.lit(True)
    )


def route_constant_rows(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.where("rule = 'ep_constant'").select(
        *_BASE, F.col("url").alias("source"), "region_idx", "pos",
        strip(F.col("text")).alias("route"), F.get("groups", F.lit(0)).alias("key"),
    )


def route_tables(constants: DataFrame) -> DataFrame:
    """Route constants count once a region holds three distinct ones."""
    region = ("site", "base_url", "asset_seq", "source", "region_idx")
    tables = (
        constants.groupBy(*region)
        .agg(F.array_sort(F.collect_set("route")).alias("routes"))
        .where(F.size("routes") >= 3)
        .select(*region, F.posexplode("routes").alias("pos", "url"))
    )
    return _endpoint(
        tables, 3, 3, method=F.lit("GET"), endpoint_kind=F.lit("api"),
        scope=F.lit("relative"), inferred=F.lit(True),
    )


def spa_route_rows(hit_rows: DataFrame) -> DataFrame:
    rows = (
        hit_rows.where("rule = 'ep_route'")
        .select(
            *_BASE, F.col("url").alias("source"), "region_idx", "pos",
            join_url(F.col("base_url"), _group(0)).alias("url"),
        )
    )
    return _endpoint(
        rows, 4, 0, method=F.lit("GET"), endpoint_kind=F.lit("page"), inferred=F.lit(True)
    )


def endpoint_hits(assets: DataFrame) -> DataFrame:
    return hits(assets, raw_rules=R.CALL_RULES, literal_gates=LITERAL_GATES, locate=False)


def code_endpoints(hit_rows: DataFrame) -> DataFrame:
    """Every endpoint row that comes from code."""
    calls = reduce(
        DataFrame.unionByName,
        [call_site_rows(hit_rows), mention_rows(hit_rows), literal_path_rows(hit_rows)],
    )
    return (
        record_calls(calls)
        .unionByName(route_tables(route_constant_rows(hit_rows)))
        .unionByName(spa_route_rows(hit_rows))
    )


def raw_endpoints(assets: DataFrame, hit_rows: DataFrame | None = None) -> DataFrame:
    """Endpoint mentions of all kinds, before any merging."""
    hit_rows = endpoint_hits(assets) if hit_rows is None else hit_rows
    return (
        url_endpoints(recorded_urls(assets))
        .unionByName(websockets(assets))
        .unionByName(code_endpoints(hit_rows))
    )


def dedupe_endpoints(endpoints: DataFrame) -> DataFrame:
    """The first mention per method and URL; partial aggregation keeps hot URLs cheap."""
    order = F.struct(*ORDER)
    kept = F.struct("method", "base_url", "endpoint_kind", "scope", "inferred", "source", *ORDER)
    return (
        endpoints.groupBy("site", F.upper("method").alias("method_key"), "url")
        .agg(F.min_by(kept, order).alias("first"))
        .select("site", "url", "first.*")
    )


def collapse_inferred_endpoints(endpoints: DataFrame) -> DataFrame:
    """Drop an assumed GET where a real verb was seen for the same URL."""
    assumed = F.col("inferred") & (F.upper("method") == "GET")
    explicit = (
        endpoints.where(~F.col("inferred") & (F.upper("method") != "GET"))
        .select("site", "url").distinct()
    )
    return endpoints.where(~assumed).unionByName(
        endpoints.where(assumed).join(explicit, ["site", "url"], "left_anti")
    )


def dedupe_urls(assets: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Distinct URLs of a site with their scope: mentions and called addresses."""
    mentioned = recorded_urls(assets).select(
        "site", "url", url_scope(F.col("url"), _domain()).alias("scope")
    )
    called = endpoints.where((F.col("phase") == 3) & (F.col("op") < 3)).select(
        "site", "url", "scope"
    )
    return mentioned.unionByName(called).groupBy("site", "url").agg(F.min("scope").alias("scope"))
