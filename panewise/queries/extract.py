"""Sources, projections and predicates."""

from __future__ import annotations


from ..functions import predicates as pr
from ..functions import text as tx
from ..functions import urls as ur
from ..functions.sqlexpr import F
from ..operators import endpoints as ep
from ..operators import links as lk
from ..operators import regions as rg
from ..rules import endpoints as er
from ..rules import words as W
from ..sources import assets as src
from .base import (
    ASSETS, REGIONS, TOKENS, VENDOR, Corpus, column, flat, in_list, line, path, query, re2, rp, s,
    same_site, scope, snippet, values,
)

# ---- sources -------------------------------------------------------------------------


@query("scan_responses", ASSETS + """
SELECT site, asset_seq, url, kind, length(content)::BIGINT AS chars, md5(content) AS body FROM assets""")
def _(c: Corpus):
    return flat(c.assets.select(
        "site", "asset_seq", "url", "kind", F.length("content").alias("chars"),
        F.md5("content").alias("body")))


@query("is_textual", ASSETS + """
SELECT content_type, count(*) AS n, bool_and(regexp_matches(content_type,
  '(?i)text/|json|javascript|xml|html|ecmascript|css')) AS textual FROM captures GROUP BY 1""")
def _(c: Corpus):
    return c.captures.groupBy("content_type").agg(
        F.count("*").alias("n"), F.every(src.is_textual(F.col("content_type"))).alias("textual"))


@query("classify_kind", ASSETS + """
SELECT kind, content_type, count(*) AS n FROM assets GROUP BY 1, 2""")
def _(c: Corpus):
    return c.assets.groupBy("kind", "content_type").agg(F.count("*").alias("n"))


@query("asset_cap", ASSETS + """
SELECT site, asset_seq FROM (SELECT site, asset_seq,
  row_number() OVER (PARTITION BY site ORDER BY asset_seq) rn FROM assets) WHERE rn <= 300""")
def _(c: Corpus):
    return src.asset_cap(c.assets, 300).select("site", "asset_seq")


@query("normalize_target", r"""
SELECT url AS target, false AS scheme_inferred, CAST(NULL AS VARCHAR) AS reject_reason,
  regexp_replace(url, '#.*$', '') AS base_url,
  lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain FROM pages
UNION ALL
SELECT 'site' || page_id || '.example.org', true, NULL, 'https://site' || page_id || '.example.org/',
  'site' || page_id || '.example.org' FROM pages
UNION ALL
SELECT 'ftp://h/' || page_id, false, 'unsupported scheme', NULL, NULL FROM pages
UNION ALL
SELECT 'bad host ' || page_id, true, 'invalid hostname', NULL, NULL FROM pages""")
def _(c: Corpus):
    pages, pid = c.table("pages"), F.col("page_id").cast("string")
    targets = pages.select(F.explode(F.array(
        F.col("url"), F.concat(F.lit("site"), pid, F.lit(".example.org")),
        F.concat(F.lit("ftp://h/"), pid), F.concat(F.lit("bad host "), pid))).alias("target"))
    return src.normalize_target(targets)


# ---- regions and literals --------------------------------------------------------------


@query("code_regions", REGIONS + """
SELECT site, asset_seq, region_idx::BIGINT AS region_idx, region_kind, off::BIGINT AS off,
  md5(code) AS code FROM regions""")
def _(c: Corpus):
    return flat(c.regions.select(
        "site", "asset_seq", "region_idx", "region_kind", "off", F.md5("code").alias("code")))


_LITERALS = TOKENS + """
SELECT site, asset_seq, region_idx::BIGINT AS region_idx, (off + start)::BIGINT AS "start",
  (off + start + length(raw))::BIGINT AS "end", raw, left(raw, 1) AS quote,
  left(raw, 1) = '`' AND contains(raw, '${') AS interpolated, key FROM literals"""


@query("string_literals", _LITERALS)
def _(c: Corpus):
    return flat(rg.string_literals(c.regions).drop("value", "url", "kind"))


@query("literal_offsets", TOKENS + """
SELECT site, asset_seq, region_idx::BIGINT AS region_idx, count(*) AS literals,
  min(off + start)::BIGINT AS first_at, max(off + start + length(raw))::BIGINT AS last_end
FROM literals GROUP BY 1, 2, 3""")
def _(c: Corpus):
    return flat(rg.string_literals(c.regions).groupBy("site", "asset_seq", "region_idx").agg(
        F.count("*").alias("literals"), F.min("start").alias("first_at"),
        F.max("end").alias("last_end")))


@query("decode_escapes", "SELECT doc_id, md5(text) AS decoded FROM documents")
def _(c: Corpus):
    """Documents written the way a script would quote them, read back."""
    written = F.replace(F.replace(F.replace(F.replace(
        F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")),
        F.lit("é"), F.lit("\\u{e9}")), F.lit("'"), F.lit("\\x27"))
    return c.table("documents").select("doc_id", written.alias("written")).select(
        "doc_id", F.md5(tx.decode_escapes(F.col("written"))).alias("decoded"))


@query("comments", TOKENS + """
SELECT site, asset_seq, region_idx::BIGINT AS region_idx, (off + start)::BIGINT AS "start",
  (off + start + length(raw))::BIGINT AS "end", raw AS text, left(raw, 2) = '/*' AS block
FROM tokens WHERE comment""")
def _(c: Corpus):
    return flat(rg.comments(c.regions).drop("url", "kind"))


@query("strip_comments", TOKENS + """
SELECT site, asset_seq, region_idx::BIGINT AS region_idx, md5(code) AS stripped,
  length(code)::BIGINT AS chars FROM stripped""")
def _(c: Corpus):
    code = rg.strip_comments(F.col("code"))
    return flat(c.regions.select("site", "asset_seq", "region_idx", code.alias("stripped")).select(
        "site", "asset_seq", "region_idx", F.md5("stripped").alias("stripped"),
        F.length("stripped").alias("chars")))


@query("preceding_identifier", TOKENS + """
SELECT key, count(*) AS n FROM literals GROUP BY key""")
def _(c: Corpus):
    return rg.string_literals(c.regions).groupBy("key").agg(F.count("*").alias("n"))


@query("enclosing_region", TOKENS + """
SELECT site, asset_seq, (off + start)::BIGINT AS pos, min(region_idx)::BIGINT AS region_idx
FROM (SELECT l.site, l.asset_seq, l.off, l.start, r.region_idx FROM literals l JOIN regions r
      ON r.site = l.site AND r.asset_seq = l.asset_seq
      AND l.off + l.start >= r.off AND l.off + l.start < r.off + length(r.code)) GROUP BY 1, 2, 3""")
def _(c: Corpus):
    at = rg.string_literals(c.regions).select("site", "asset_seq", F.col("start").alias("pos"))
    return flat(rg.enclosing_region(c.regions, at.distinct()))


@query("line_column", TOKENS + f"""
SELECT site, asset_seq, (off + start)::BIGINT AS pos, {line("content", "(off + start)")} AS line,
  {column("content", "(off + start)")} AS col FROM literals""")
def _(c: Corpus):
    rows = rg.string_literals(c.regions).select("site", "asset_seq", F.col("start").alias("pos"))
    content = c.assets.select("site", "asset_seq", "content")
    x, p = F.col("content"), F.col("pos")
    return flat(rows.join(content, ["site", "asset_seq"]).select(
        "site", "asset_seq", "pos", tx.line_of(x, p).alias("line"), tx.column_of(x, p).alias("col")))


@query("make_snippet", TOKENS + f"""
SELECT site, asset_seq, (off + start)::BIGINT AS pos,
  {snippet("content", "(off + start)", "(off + start + length(raw))")} AS snippet FROM literals""")
def _(c: Corpus):
    rows = rg.string_literals(c.regions).select(
        "site", "asset_seq", F.col("start").alias("pos"), "end")
    content = c.assets.select("site", "asset_seq", "content")
    place = tx.make_snippet(F.col("content"), F.col("pos"), F.col("end"))
    return flat(rows.join(content, ["site", "asset_seq"]).select(
        "site", "asset_seq", "pos", place.alias("snippet")))


@query("asset_filename", ASSETS + """
SELECT site, asset_seq, coalesce(nullif(regexp_extract(rtrim(split_part(url, '?', 1), '/'),
  '([^/]*)$', 1), ''), url) AS filename, length(content)::BIGINT AS size FROM assets""")
def _(c: Corpus):
    return flat(c.assets.select(
        "site", "asset_seq", ur.asset_filename(F.col("url")).alias("filename"),
        F.length("content").alias("size")))


@query("redact", TOKENS + """
SELECT DISTINCT value, CASE WHEN value = '' THEN '' WHEN length(v) <= 15 THEN v
  ELSE left(v, 6) || '…' || right(v, 4) END AS shown
FROM (SELECT raw AS value, trim(raw, chr(32) || chr(9) || chr(10) || chr(13)) AS v FROM literals)""")
def _(c: Corpus):
    rows = rg.string_literals(c.regions).select(F.col("raw").alias("value")).distinct()
    return rows.select("value", tx.redact(F.col("value")).alias("shown"))


# ---- whole-text projections ------------------------------------------------------------

_EMAIL = rp(er.EMAIL)


@query("emails", ASSETS + f"""
SELECT DISTINCT site, email FROM (SELECT site, unnest(regexp_extract_all(content, {_EMAIL})) AS email
  FROM assets) WHERE NOT regexp_matches(email, '(?i)[.](png|jpg|gif|js|css)$')""")
def _(c: Corpus):
    return ep.emails(c.assets)


_JUNK = s(er.TRAILING_JUNK)


def _urls_sql(pattern: str, group: int, prefix: str = "") -> str:
    return f"""SELECT site, asset_seq, (i - 1)::BIGINT AS pos,
  {s(prefix)} || regexp_replace(u, {_JUNK}, '') AS url FROM (
  SELECT site, asset_seq, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM (
    SELECT site, asset_seq, regexp_extract_all(content, {rp(pattern)}, {group}) AS us FROM assets))"""


@query("absolute_urls", ASSETS + _urls_sql(er.ABSOLUTE_URL, 0))
def _(c: Corpus):
    return flat(ep.absolute_urls(c.assets).select("site", "asset_seq", "pos", "url"))


#: RE2 has no look-behind: the character before the slashes is matched and left out
_PROTO = er.PROTOCOL_RELATIVE.replace(r"(?<![:\w])//", r"(?:^|[^:\w])//")


@query("protocol_relative_urls", ASSETS + _urls_sql(_PROTO, 1, "https://"))
def _(c: Corpus):
    return flat(ep.protocol_relative_urls(c.assets).select("site", "asset_seq", "pos", "url"))


@query("clean_url", ASSETS + f"""
SELECT DISTINCT url, CASE WHEN length(u) - length(replace(u, '/', '')) >= 2 THEN u ELSE '' END AS cleaned
FROM (SELECT url, rtrim(regexp_replace(url, {s(er.INTERPOLATED_TAIL)}, ''), '?&=/') AS u
      FROM ({_urls_sql(er.ABSOLUTE_URL, 0)}))""")
def _(c: Corpus):
    rows = ep.absolute_urls(c.assets).select("url").distinct()
    return rows.select("url", ur.clean_url(F.col("url")).alias("cleaned"))


@query("url_scope", ASSETS + f"""
SELECT a.site, l.url, {scope("l.url", "a.base_url")} AS scope FROM
  (SELECT DISTINCT site, base_url FROM assets) a JOIN
  (SELECT DISTINCT site, url FROM ({_urls_sql(er.ABSOLUTE_URL, 0)})) l USING (site)""")
def _(c: Corpus):
    rows = ep.absolute_urls(c.assets).select("site", "base_url", "url").distinct()
    domain = ur.host_of(F.col("base_url"))
    return rows.select("site", "url", ur.url_scope(F.col("url"), domain).alias("scope"))


@query("same_site", ASSETS + f"""
SELECT a.site, l.url, {same_site("l.url", "a.base_url")} AS same_site,
  {same_site("l.url", "a.base_url")} AS own_origin FROM
  (SELECT DISTINCT site, base_url FROM assets) a JOIN
  (SELECT DISTINCT site, url FROM ({_urls_sql(er.ABSOLUTE_URL, 0)})) l USING (site)""")
def _(c: Corpus):
    from ..operators.technologies import own_origin

    rows = ep.absolute_urls(c.assets).select("site", "base_url", "url").distinct()
    u, b = F.col("url"), F.col("base_url")
    return rows.select("site", "url", ur.same_site(u, b).alias("same_site"),
                       own_origin(u, ur.host_of(b)).alias("own_origin"))


def api_path(p: str) -> str:
    return f"(regexp_matches({p}, {rp(er.API_PATH)}) OR regexp_matches({p}, {rp(er.GENERIC_API_PATH)}))"


def kind_sql(url: str) -> str:
    p = f"lower({path(url)})"
    return (f"CASE WHEN contains({p}, 'graphql') OR ends_with({p}, '/gql') THEN 'graphql' "
            f"WHEN {api_path(p)} THEN 'api' ELSE 'page' END")


BACKEND = "|".join(h.replace(".", "[.]") for h in er.NON_BACKEND_HOSTS)


def api_like(url: str) -> str:
    from .base import host

    return (f"(NOT regexp_matches({host(url)}, '{BACKEND}') AND {path(url)} NOT IN ('', '/') "
            f"AND {api_path(path(url))})")


_ALL_URLS = f"SELECT DISTINCT url FROM (SELECT url FROM captures UNION ALL SELECT url FROM ({_urls_sql(er.ABSOLUTE_URL, 0)}))"


def _all_urls(c: Corpus):
    return c.captures.select("url").unionByName(ep.absolute_urls(c.assets).select("url")).distinct()


@query("endpoint_kind", ASSETS + f"SELECT url, {kind_sql('url')} AS endpoint_kind FROM ({_ALL_URLS})")
def _(c: Corpus):
    return _all_urls(c).select("url", ur.endpoint_kind(F.col("url")).alias("endpoint_kind"))


@query("is_api_like", ASSETS + f"SELECT url, {api_like('url')} AS api_like FROM ({_ALL_URLS})")
def _(c: Corpus):
    return _all_urls(c).select("url", ur.is_api_like(F.col("url")).alias("api_like"))


@query("is_vendor_bundle", ASSETS + f"SELECT url, {VENDOR} AS vendor FROM ({_ALL_URLS})")
def _(c: Corpus):
    return _all_urls(c).select("url", pr.is_vendor_bundle(F.col("url")).alias("vendor"))


@query("resolve_api_path", ASSETS + f"""
SELECT site, asset_seq, CASE WHEN contains({path("url")}, '/wp-json')
    THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/wp-json' || '/v2/items'
  ELSE regexp_extract(base_url, '^[a-z]+://[^/?#]*') || '/v2/items' END AS resolved FROM assets""")
def _(c: Corpus):
    r = ur.resolve_api_path(F.col("url"), F.col("base_url"), F.lit("/v2/items"))
    return c.assets.select("site", "asset_seq", r.alias("resolved"))


# ---- links -----------------------------------------------------------------------------

_VISIBLE = (
    "regexp_replace(regexp_replace(regexp_replace(content, '<!--[\\s\\S]*?-->', '', 'g'), "
    "'(?i)(<script\\b[^>]*>)[\\s\\S]*?</script\\s*>', '\\1', 'g'), "
    "'(?i)(<style\\b[^>]*>)[\\s\\S]*?</style\\s*>', '\\1', 'g')"
)


def _attr(attrs: str, name: str) -> str:
    p = f"""(?i)(?:^|[\\s"'/]){name}\\s*=\\s*(?:"([^"]*)"|'([^']*)'|([^\\s"'>]+))"""
    one = " || ".join(f"coalesce(regexp_extract({attrs}, {s(p)}, {g}), '')" for g in (1, 2, 3))
    return f"replace({one}, '&amp;', '&')"


def _tags(name: str) -> str:
    p = f"""(?i)<{name}\\b((?:[^>"']|"[^"]*"|'[^']*')*)>"""
    return (f"(SELECT site, base_url, asset_seq, url, unnest(regexp_extract_all({_VISIBLE}, {s(p)}, 1))"
            f" AS attrs FROM assets WHERE kind = 'html')")


def _resolve(base: str, ref: str) -> str:
    """Reference resolution for the shapes the corpus holds."""
    origin = f"regexp_extract({base}, '^[a-z]+://[^/?#]*')"
    bpath = f"coalesce(nullif({path(base)}, ''), '/')"
    folder = f"regexp_extract({bpath}, '^(.*/)[^/]*$', 1)"
    parent = f"regexp_replace({folder}, '[^/]*/$', '')"
    r = f"trim({ref})"
    return (
        f"CASE WHEN {r} = '' OR regexp_matches({r}, '^(data:|javascript:|mailto:|tel:|#|blob:)') THEN NULL "
        f"WHEN regexp_matches({r}, '^https?://') THEN {r} "
        f"WHEN regexp_matches({r}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL "
        f"WHEN starts_with({r}, '//') THEN regexp_extract({base}, '^[a-z]+:') || {r} "
        f"WHEN starts_with({r}, '/') THEN {origin} || {r} "
        f"WHEN starts_with({r}, './') THEN {origin} || {folder} || substr({r}, 3) "
        f"WHEN starts_with({r}, '../') THEN {origin} || "
        f"CASE WHEN {parent} = '' THEN '/' ELSE {parent} END || substr({r}, 4) "
        f"ELSE {origin} || {folder} || {r} END"
    )


PAGE_LINKS = f"""SELECT DISTINCT site, asset_seq, url AS src_url, split_part(target, '#', 1) AS dst_url
FROM (SELECT site, base_url, asset_seq, url, {_resolve("url", _attr("attrs", "href"))} AS target
      FROM {_tags("a")} t)
WHERE target IS NOT NULL AND {same_site("target", "base_url")}"""
SCRIPT_LINKS = f"""SELECT DISTINCT site, asset_seq, src_url, dst_url FROM (
  SELECT site, asset_seq, url AS src_url, {_resolve("url", _attr("attrs", "src"))} AS dst_url
  FROM {_tags("script")} t1
  UNION ALL
  SELECT site, asset_seq, url, target FROM (
    SELECT *, {_resolve("url", _attr("attrs", "href"))} AS target FROM {_tags("link")} t2)
  WHERE ends_with(split_part(target, '?', 1), '.js') OR lower({_attr("attrs", "as")}) = 'script'
    OR contains(lower({_attr("attrs", "rel")}), 'modulepreload')
  UNION ALL
  SELECT site, asset_seq, url, target FROM (
    SELECT site, base_url, asset_seq, url, {_resolve("url", "u")} AS target FROM (
      SELECT site, base_url, asset_seq, url, unnest(regexp_extract_all(content, {rp(er.INLINE_SCRIPT_URL)}, 1)) AS u
      FROM assets WHERE kind IN ('js', 'json', 'html'))
    WHERE regexp_matches(u, '^(?:http|/|\\./|\\.\\./)'))
  WHERE {same_site("target", "base_url")})
WHERE dst_url IS NOT NULL"""
MAP_LINKS = f"""SELECT DISTINCT site, asset_seq, url AS src_url, {_resolve("url", "u")} AS dst_url FROM (
  SELECT site, asset_seq, url, unnest(regexp_extract_all(content, {rp(er.SOURCEMAP_COMMENT)}, 1)) AS u
  FROM assets WHERE kind IN ('js', 'css')) WHERE NOT starts_with(u, 'data:')"""
CHUNK_LINKS = f"""SELECT DISTINCT site, asset_seq, url AS src_url,
  regexp_extract(base_url, '^[a-z]+://[^/?#]*') || u AS dst_url FROM (
  SELECT site, base_url, asset_seq, url, unnest(regexp_extract_all(content, {rp(er.NEXT_CHUNK)}, 1)) AS u
  FROM assets WHERE contains(url, '_buildManifest') OR contains(url, 'webpack'))"""


def _link_columns(df):
    return df.select("site", "asset_seq", "src_url", "dst_url")


@query("extract_page_links", ASSETS + PAGE_LINKS)
def _(c: Corpus):
    return _link_columns(lk.extract_page_links(c.assets))


@query("extract_script_links", ASSETS + SCRIPT_LINKS)
def _(c: Corpus):
    return _link_columns(lk.extract_script_links(c.assets))


@query("extract_sourcemap_links", ASSETS + MAP_LINKS)
def _(c: Corpus):
    return _link_columns(lk.extract_sourcemap_links(c.assets))


@query("next_build_chunks", ASSETS + CHUNK_LINKS)
def _(c: Corpus):
    return _link_columns(lk.next_build_chunks(c.assets))


@query("resolve_url", ASSETS + f"""
SELECT DISTINCT url, attrs, {_resolve("url", _attr("attrs", "href"))} AS resolved FROM {_tags("a")} t""")
def _(c: Corpus):
    rows = lk._tags(c.assets, "a").select("url", "attrs").distinct()
    href = lk.attribute(F.col("attrs"), "href")
    return rows.select("url", "attrs", ur.resolve_url(F.col("url"), href).alias("resolved"))


ALL_LINKS = f"""links AS (
  SELECT site, src_url, dst_url, 'page' AS link_kind FROM ({PAGE_LINKS})
  UNION ALL SELECT site, src_url, dst_url, 'script' FROM ({SCRIPT_LINKS})
  UNION ALL SELECT site, src_url, dst_url, 'sourcemap' FROM ({MAP_LINKS})
  UNION ALL SELECT site, src_url, dst_url, 'chunk' FROM ({CHUNK_LINKS})),
captured AS (SELECT DISTINCT site, split_part(url, '#', 1) AS url_nofrag FROM assets)"""


@query("uncaptured_links", ASSETS + "," + ALL_LINKS + """
SELECT DISTINCT l.site, split_part(l.dst_url, '#', 1) AS url_nofrag, link_kind FROM links l
WHERE l.dst_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM captured k WHERE k.site = l.site
  AND k.url_nofrag = split_part(l.dst_url, '#', 1))""")
def _(c: Corpus):
    return lk.uncaptured_links(lk.link_table(c.assets), c.assets)


def _walk_sql(kinds: str, depth: str) -> str:
    recursive = ASSETS.replace("WITH ", "WITH RECURSIVE ", 1)
    return recursive + "," + ALL_LINKS + f""",
edges AS (SELECT DISTINCT l.site, split_part(src_url, '#', 1) AS src, k.url_nofrag AS dst
  FROM links l JOIN captured k ON k.site = l.site AND k.url_nofrag = split_part(dst_url, '#', 1)
  WHERE link_kind IN {kinds}),
walk(site, url, depth) AS (
  SELECT site, split_part(url, '#', 1), 0 FROM assets WHERE is_main
  UNION
  SELECT w.site, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.site = w.site AND e.src = w.url
  WHERE w.depth < {depth})
SELECT site, url, min(depth)::BIGINT AS depth FROM walk GROUP BY site, url"""


@query("page_reachability", _walk_sql("('page')", "3"))
def _(c: Corpus):
    return flat(lk.page_reachability(c.assets, 3))


@query("asset_closure", _walk_sql("('script', 'chunk')", "12"))
def _(c: Corpus):
    return flat(lk.asset_closure(c.assets))


# ---- predicates ------------------------------------------------------------------------

#: Distinct space-separated tokens of every document, and every distinct literal body.
_TOKENS_SQL = TOKENS + """, toks AS (
  SELECT DISTINCT tok FROM (
    SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS tok FROM documents
    UNION ALL SELECT substr(raw, 2, length(raw) - 2) FROM literals WHERE kind <> 'other')
  WHERE tok <> '') """


def _tokens(c: Corpus):
    words = c.table("documents").select(
        F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("tok"))
    bodies = rg.string_literals(c.regions).where("kind <> 'other'").select(
        F.expr("substr(raw, 2, length(raw) - 2)").alias("tok"))
    return words.unionByName(bodies).where("tok <> ''").distinct()


_T = "trim(tok, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
_LOW_VARIETY = " OR ".join(
    f"(length({_T}) % {n} = 0 AND length({_T}) // {n} >= 4 "
    f"AND repeat(left({_T}, {n}), (length({_T}) // {n})::BIGINT) = {_T})" for n in (1, 2, 3, 4))
PLACEHOLDER = (
    f"({_T} = '' OR lower({_T}) IN {in_list(W.PLACEHOLDER_VALUES)} OR {_LOW_VARIETY} OR "
    + " OR ".join(f"regexp_matches({_T}, {rp(p)})" for p in W.PLACEHOLDER_SHAPES) + ")"
)
_L = r"\p{L}"
_ENTROPY = (
    "(SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*)::DOUBLE AS n, length({v})::DOUBLE AS t "
    "FROM (SELECT unnest(string_split({v}, '')) AS ch) WHERE ch <> '' GROUP BY ch))"
)
CLASSES = (
    "((regexp_matches({v}, '[a-z]'))::INT + (regexp_matches({v}, '[A-Z]'))::INT "
    "+ (regexp_matches({v}, '\\p{{Nd}}'))::INT + (regexp_matches({v}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]'))::INT)"
)
HUMAN = (
    "(contains({v}, ' ') AND (regexp_matches({v}, " + s(_L + "{2,}(?:[\\s'’]" + _L + "{2,}){2,}").replace("{", "{{").replace("}", "}}")
    + ") OR (len(regexp_extract_all({v}, '\\p{{L}}{{2,}}')) >= 2 AND len(list_filter("
    "regexp_extract_all({v}, '\\p{{L}}{{2,}}'), lambda w: lower(w) IN " + in_list(W.COMMON_WORDS) + ")) > 0)))"
)
ROUTE = "(contains({v}, '/') AND (regexp_matches({v}, " + rp(W.MIME_LIKE).replace("{", "{{").replace("}", "}}") + ") OR regexp_matches({v}, " + rp(W.ROUTE_LIKE).replace("{", "{{").replace("}", "}}") + ")))"


def _predicate(name: str, sql: str, build, out: str = "result"):
    @query(name, _TOKENS_SQL + f"SELECT tok, {sql} AS {out} FROM toks")
    def _(c: Corpus, build=build, out=out):
        return flat(_tokens(c).select("tok", build(F.col("tok")).alias(out)))


_predicate("is_placeholder", PLACEHOLDER, pr.is_placeholder)
_predicate("charset_classes", CLASSES.format(v="tok") + "::BIGINT", pr.charset_classes)
_predicate("is_human_text", HUMAN.format(v=_T), pr.is_human_text)
_predicate("is_route_like", ROUTE.format(v=_T), pr.is_route_like)
_predicate("is_mime_type", f"regexp_matches({_T}, {rp(W.MIME_LIKE)})", pr.is_mime_type)
_predicate("contains_html", f"(regexp_matches(tok, {rp(W.HTML_TAG)}) OR regexp_matches(tok, {rp(W.JSX_TAG)}))",
           pr.contains_html)
_predicate("is_hash_like", "(regexp_matches(tok, '^[0-9a-fA-F]+$') AND length(tok) IN (7,8,16,20,32,40,64,128))",
           pr.is_hash_like)
_predicate("benign_ip", f"regexp_matches({_T}, '^(?:0\\.0\\.0\\.0|10\\.0\\.0\\.0|192\\.168\\.0\\.0|172\\.16\\.0\\.0)$')",
           pr.is_benign_ip)


@query("shannon_entropy", _TOKENS_SQL + """
, ch AS (SELECT tok, c, count(*)::DOUBLE AS n FROM (
    SELECT tok, unnest(string_split(tok, '')) AS c FROM toks) WHERE c <> '' GROUP BY ALL)
SELECT tok, round(coalesce(-sum(n / length(tok) * log2(n / length(tok))), 0), 6) AS entropy
FROM ch GROUP BY tok""")
def _(c: Corpus):
    return _tokens(c).select("tok", F.round(pr.shannon_entropy(F.col("tok")), 6).alias("entropy"))


@query("looks_random", _TOKENS_SQL + f"""
, long AS (SELECT tok, t, CASE
    WHEN length(t) < 12 OR {CLASSES.format(v="t")} < 2 THEN false
    WHEN regexp_matches(t, '\\p{{L}}{{2,}}\\s+\\p{{L}}{{2,}}\\s+\\p{{L}}{{2,}}') THEN false
    WHEN length(t) < 32 AND regexp_matches(t, '^\\p{{L}}+(?:[\\s_-]\\p{{L}}+)*$') THEN false
    WHEN {ROUTE.format(v="t")} THEN false
    ELSE NOT {HUMAN.format(v="t")} END AS likely FROM (SELECT tok, {_T} AS t FROM toks)),
e AS (SELECT tok, -sum(n / length(t) * log2(n / length(t))) AS entropy FROM (
    SELECT tok, t, c, count(*)::DOUBLE AS n FROM (
      SELECT tok, t, unnest(string_split(t, '')) AS c FROM long WHERE likely) WHERE c <> '' GROUP BY ALL) GROUP BY tok)
SELECT tok, likely AND coalesce(entropy, 0) >= 3.0 AS result FROM long LEFT JOIN e USING (tok)""")
def _(c: Corpus):
    return _tokens(c).select("tok", pr.looks_random(F.col("tok")).alias("result"))


@query("is_real_role", _TOKENS_SQL + """
SELECT tok, (lower({t}) <> '' AND length({t}) <= 48 AND lower({t}) NOT IN {deny}
  AND NOT regexp_matches(tok, {perm}) AND NOT regexp_matches({t}, '^[0-9.]+$')
  AND NOT regexp_matches(tok, '[<>{{}}()\\[\\]/\\\\]')) AS result FROM toks""".format(
    t=_T, deny=in_list(__import__("panewise.rules.access", fromlist=["x"]).ROLE_DENYLIST),
    perm=rp(__import__("panewise.rules.access", fromlist=["x"]).PERMISSION_DENY)))
def _(c: Corpus):
    return _tokens(c).select("tok", pr.is_real_role(F.col("tok")).alias("result"))


@query("parse_version", _TOKENS_SQL + r"""
SELECT tok, regexp_extract(t, '^([0-9]+)', 1)::HUGEINT::VARCHAR AS major,
  coalesce(nullif(regexp_extract(t, '^[0-9]+\.([0-9]+)', 1), ''), '0')::HUGEINT::VARCHAR AS minor,
  coalesce(nullif(regexp_extract(t, '^[0-9]+\.[0-9]+\.([0-9]+)', 1), ''), '0')::HUGEINT::VARCHAR AS patch
FROM (SELECT tok, trim(tok) AS t FROM toks) WHERE regexp_matches(t, '^[0-9]')""")
def _(c: Corpus):
    v = _tokens(c).select("tok", pr.parse_version(F.col("tok")).alias("v")).where("v is not null")
    return v.select("tok", *[F.col(f"v.{p}").cast("string").alias(p) for p in ("major", "minor", "patch")])


@query("looks_like_prose", f"""
SELECT 'd' || doc_id AS id, (len(ws) >= 5 AND (regexp_matches(text, {rp(W.HTML_ENTITY)}) OR
   (len(list_filter(ws, lambda w: lower(w) IN {in_list(W.COMMON_WORDS)})) / len(ws)::DOUBLE >= 0.7
    AND len(regexp_extract_all(text, '[{{}}();=\\[\\]<>|&$]')) <= 2))) AS prose
FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z'']{{2,}}') AS ws FROM documents)
UNION ALL
SELECT 'c' || conv_id || '-' || turn, (len(ws) >= 5 AND (regexp_matches(text, {rp(W.HTML_ENTITY)}) OR
   (len(list_filter(ws, lambda w: lower(w) IN {in_list(W.COMMON_WORDS)})) / len(ws)::DOUBLE >= 0.7
    AND len(regexp_extract_all(text, '[{{}}();=\\[\\]<>|&$]')) <= 2)))
FROM (SELECT conv_id, turn, text, regexp_extract_all(text, '[A-Za-z'']{{2,}}') AS ws FROM conversations)""")
def _(c: Corpus):
    docs = c.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = c.table("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        "text")
    return docs.unionByName(turns).select("id", pr.looks_like_prose(F.col("text")).alias("prose"))


@query("is_minified", ASSETS + """
SELECT site, asset_seq, CASE WHEN n = 0 THEN length(content) > 500
  ELSE length(content) / (n + 1) > 300 END AS minified
FROM (SELECT *, length(content) - length(replace(content, chr(10), '')) AS n FROM assets)""")
def _(c: Corpus):
    return c.assets.select("site", "asset_seq", pr.is_minified(F.col("content")).alias("minified"))


@query("looks_like_html", ASSETS + f"""
SELECT site, asset_seq, regexp_matches(content, {rp(W.HTML_DOCUMENT)}) AS html FROM assets""")
def _(c: Corpus):
    return c.assets.select("site", "asset_seq", pr.looks_like_html(F.col("content")).alias("html"))


_B64 = ("decode(from_base64(t || repeat('=', ((4 - length(t) % 4) % 4)::BIGINT)))")
_SEGMENTS = _TOKENS_SQL + r"""
, segs AS (SELECT DISTINCT tok, i, translate(seg, '-_', '+/') AS t FROM (
    SELECT tok, unnest(string_split(tok, '.')) AS seg, generate_subscripts(string_split(tok, '.'), 1) AS i
    FROM toks WHERE regexp_matches(tok, '^eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}')) WHERE i <= 2)
"""


@query("decode_jwt", _SEGMENTS + f"""
, jwt_parts AS (SELECT tok, i, CASE WHEN json_valid(j) THEN j END AS j
            FROM (SELECT tok, i, {_B64} AS j FROM segs))
SELECT h.tok, coalesce(json_type(h.j) = 'OBJECT' AND json_type(p.j) = 'OBJECT'
  AND (json_exists(h.j, '$.alg') OR json_exists(h.j, '$.typ')), false) AS jwt
FROM jwt_parts h JOIN jwt_parts p ON p.tok = h.tok AND h.i = 1 AND p.i = 2""")
def _(c: Corpus):
    rows = _tokens(c).where(r"tok rlike '^eyJ[A-Za-z0-9_\\-]{5,}\\.[A-Za-z0-9_\\-]{5,}'")
    return rows.select("tok", pr.is_jwt(F.col("tok")).alias("jwt"))


@query("base64_json", _SEGMENTS + f"""
SELECT DISTINCT t AS segment, regexp_matches({_B64}, '^\\s*[{{\\[]') AS is_json FROM segs""")
def _(c: Corpus):
    rows = _tokens(c).where(r"tok rlike '^eyJ[A-Za-z0-9_\\-]{5,}\\.[A-Za-z0-9_\\-]{5,}'").select(
        F.explode(F.slice(F.split("tok", r"\."), 1, 2)).alias("seg"))
    rows = rows.select(F.translate("seg", "-_", "+/").alias("segment")).distinct()
    return rows.select("segment", pr.base64_json(F.col("segment")).alias("is_json"))
