"""The link graph between captures: scripts, pages, source maps, and walks over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.sqlexpr import F
from ..functions.text import exploded, pinned, rx
from ..functions.urls import join_url, resolve_url, same_site, without_fragment
from ..rules import endpoints as R
from ..session import checkpoint_dir
from ..tables import local_table

_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_KEYS = ("site", "base_url", "asset_seq", "url")
LINK_COLUMNS = ("site", "base_url", "asset_seq", "src_url", "dst_url", "link_kind")


def _markup(content: Column) -> Column:
    """A page without comments and without script and style bodies, whose text is no markup."""
    visible = F.regexp_replace(content, r"<!--[\s\S]*?-->", "")
    return F.regexp_replace(
        visible, r"(?i)(<(script|style)\b[^>]*>)[\s\S]*?</\2\s*>", "$1"
    )


def _tags(assets: DataFrame, name: str) -> DataFrame:
    pattern = rf"(?i)<{name}\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    return exploded(
        assets.where((F.col("kind") == "html") & F.lower("content").contains("<" + name)), _KEYS,
        F.regexp_extract_all(_markup(F.col("content")), F.lit(pattern), F.lit(1)), "attrs",
    )


def attribute(attrs: Column, name: str) -> Column:
    """Value of a tag attribute, empty when absent; entities are resolved."""
    pattern = rf"(?i)(?:^|[\s\"'/]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(attrs, pattern, g) for g in (1, 2, 3)])
    for entity, char in _ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def _links(rows: DataFrame, kind: str, target: Column) -> DataFrame:
    return (
        pinned(rows, dst_url=target)
        .where(F.col("dst_url").isNotNull() & (F.col("dst_url") != ""))
        .select(
            "site", "base_url", "asset_seq", F.col("url").alias("src_url"), "dst_url",
            F.lit(kind).alias("link_kind"),
        )
    )


def extract_page_links(assets: DataFrame) -> DataFrame:
    rows = pinned(
        _tags(assets, "a"), target=resolve_url(F.col("url"), attribute(F.col("attrs"), "href"))
    )
    return _links(
        rows.where(same_site(F.col("target"), F.col("base_url"))), "page",
        without_fragment(F.col("target")),
    ).distinct()


def extract_script_links(assets: DataFrame) -> DataFrame:
    """Script tags, script-like link tags, and quoted script paths in code or markup."""
    tags = _links(
        _tags(assets, "script"), "script",
        resolve_url(F.col("url"), attribute(F.col("attrs"), "src")),
    )
    attrs = F.col("attrs")
    link_rows = pinned(
        _tags(assets, "link"), target=resolve_url(F.col("url"), attribute(attrs, "href"))
    )
    is_script = (
        F.endswith(F.substring_index("target", "?", 1), F.lit(".js"))
        | (F.lower(attribute(attrs, "as")) == "script")
        | F.lower(attribute(attrs, "rel")).contains("modulepreload")
    )
    linked = _links(link_rows.where(is_script), "script", F.col("target"))
    candidates = exploded(
        assets.where(F.col("kind").isin("js", "json", "html")), _KEYS,
        F.regexp_extract_all("content", F.lit(rx(R.INLINE_SCRIPT_URL)), F.lit(1)), "candidate",
    ).where(F.col("candidate").rlike(r"^(?:http|/|\./|\.\./)"))
    quoted = pinned(candidates, target=resolve_url(F.col("url"), F.col("candidate")))
    inline = _links(
        quoted.where(same_site(F.col("target"), F.col("base_url"))), "script", F.col("target")
    )
    return tags.unionByName(linked).unionByName(inline).distinct()


def extract_sourcemap_links(assets: DataFrame) -> DataFrame:
    rows = exploded(
        assets.where(
            F.col("kind").isin("js", "css") & F.col("content").contains("sourceMappingURL")
        ),
        _KEYS, F.regexp_extract_all("content", F.lit(rx(R.SOURCEMAP_COMMENT)), F.lit(1)), "ref",
    ).where(~F.col("ref").startswith("data:"))
    return _links(rows, "sourcemap", resolve_url(F.col("url"), F.col("ref"))).distinct()


def next_build_chunks(assets: DataFrame) -> DataFrame:
    rows = exploded(
        assets.where(F.col("url").contains("_buildManifest") | F.col("url").contains("webpack")),
        _KEYS, F.regexp_extract_all("content", F.lit(rx(R.NEXT_CHUNK)), F.lit(1)), "path",
    )
    return _links(rows, "chunk", join_url(F.col("base_url"), F.col("path"))).distinct()


def link_table(assets: DataFrame) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            f(assets)
            for f in (
                extract_script_links, extract_page_links, extract_sourcemap_links,
                next_build_chunks,
            )
        ],
    )


def captured_urls(assets: DataFrame) -> DataFrame:
    return assets.select(
        "site", without_fragment(F.col("url")).alias("url_nofrag")
    ).distinct()


def uncaptured_links(links: DataFrame, assets: DataFrame) -> DataFrame:
    """Links that point at nothing in the capture."""
    wanted = links.select(
        "site", without_fragment(F.col("dst_url")).alias("url_nofrag"), "link_kind"
    ).distinct()
    return wanted.join(captured_urls(assets), ["site", "url_nofrag"], "left_anti")


def manifest_candidates(assets: DataFrame, technologies: DataFrame) -> DataFrame:
    """Framework manifests a detected stack should have, that the capture does not hold."""
    spark = assets.sparkSession
    paths = local_table(spark, ("tech", "path"), R.MANIFEST_PATHS)
    bases = assets.where("is_main").select("site", "base_url")
    by_stack = (
        technologies.select("site", F.col("name").alias("tech"))
        .join(F.broadcast(paths), "tech").join(bases, "site")
        .select("site", "base_url", "path")
    )
    build_id = F.regexp_extract("content", R.NEXT_BUILD_ID, 1)
    by_build = (
        assets.where(F.col("is_main") & F.col("content").contains("buildId"))
        .select("site", "base_url", build_id.alias("build_id"))
        .where("build_id != ''")
        .select(
            "site", "base_url",
            F.explode(F.array(*[
                F.concat(F.lit("/_next/static/"), F.col("build_id"), F.lit("/" + name))
                for name in R.BUILD_MANIFESTS
            ])).alias("path"),
        )
    )
    wanted = by_stack.unionByName(by_build).select(
        "site", join_url(F.col("base_url"), F.col("path")).alias("url_nofrag")
    ).distinct()
    return wanted.join(captured_urls(assets), ["site", "url_nofrag"], "left_anti")


def _walk(
    spark: SparkSession, edges: DataFrame, seeds: DataFrame, max_depth: int | None
) -> DataFrame:
    """Breadth-first walk: (site, url, depth) of every node reached.

    Each level is a join of the frontier with the edge table and an anti join with what was
    visited. Levels are checkpointed to the shared folder, so the plan stays short and a lost
    executor costs one level. The edges are checkpointed once, laid out by the key that every
    level joins on, so no level shuffles them again.
    """
    checkpoint_dir(spark)
    edges = edges.select("site", "src", "dst").repartition("site", "src").distinct().checkpoint()
    visited = seeds.select("site", F.col("url"), F.lit(0).alias("depth")).distinct().checkpoint()
    frontier, depth = visited, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            frontier.select("site", F.col("url").alias("src"))
            .join(edges, ["site", "src"])
            .select("site", F.col("dst").alias("url")).distinct()
            .join(visited.select("site", "url"), ["site", "url"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = step.checkpoint()
        if frontier.isEmpty():
            break
        # Levels stay separate files; they are only folded together now and then, so the
        # visited set is not rewritten at every level.
        visited = visited.unionByName(frontier)
        if depth % 16 == 0:
            visited = visited.checkpoint()
    return visited


def _captured_edges(links: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges between captured responses, by URL without fragment."""
    return (
        links.select(
            "site", without_fragment(F.col("src_url")).alias("src"),
            without_fragment(F.col("dst_url")).alias("dst"),
        )
        .join(captured_urls(assets).withColumnRenamed("url_nofrag", "dst"), ["site", "dst"])
    )


def _seeds(assets: DataFrame) -> DataFrame:
    return assets.where("is_main").select("site", without_fragment(F.col("url")).alias("url"))


def page_reachability(assets: DataFrame, depth: int) -> DataFrame:
    """Captured pages within ``depth`` page links of the site's own document."""
    edges = _captured_edges(extract_page_links(assets), assets)
    return _walk(assets.sparkSession, edges, _seeds(assets), depth)


def asset_closure(assets: DataFrame) -> DataFrame:
    """Captured scripts reached from the site's own document, to the end."""
    scripts = extract_script_links(assets).unionByName(next_build_chunks(assets))
    return _walk(
        assets.sparkSession, _captured_edges(scripts, assets), _seeds(assets), None
    )
