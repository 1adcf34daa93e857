"""What every registered query shares: the corpus on Spark, and its DuckDB restatement."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.sqlexpr import F
from ..operators import regions as rg
from ..plans.scan import Scan
from ..session import work_folder, written
from ..sources.assets import ROWS_PER_FILE, scan_responses
from ..sources.corpus import captures, corpus_sql


class Corpus:
    """The derived captures of one data folder, written once, and what is built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def captures(self) -> DataFrame:
        # Bodies are not shuffled: each task writes its split of the input as files of few rows, and
        # the files are dealt over the cores when they are read, for matching is CPU-bound.
        rows = captures(self.spark, self.sf_dir)
        folder = work_folder(self.spark, "captures")
        return written(rows, folder, maxRecordsPerFile=ROWS_PER_FILE, compression="zstd")

    @cached_property
    def assets(self) -> DataFrame:
        return scan_responses(self.captures)

    @cached_property
    def regions(self) -> DataFrame:
        return rg.code_regions(self.assets)

    @cached_property
    def scan(self) -> Scan:
        return Scan(self.captures)

    def scan_of(self, *detectors: str) -> Scan:
        """A scan with these detectors, for tables that need no other: the whole one if its pass over
        the text is done, else one with these alone."""
        if "facts" in self.scan.__dict__:
            return self.scan
        scans = self.__dict__.setdefault("scans", {})
        return scans.setdefault(detectors, Scan(self.captures, detectors))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


_corpora: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """One corpus per session and folder, so that its written tables serve all queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _corpora:
        _corpora[key] = Corpus(spark, sf_dir)
    return _corpora[key]


def forget_corpora() -> None:
    _corpora.clear()


Query = Callable[[Corpus], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a Spark query and, where SQL can say it, the DuckDB statement it must equal."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def flat(df: DataFrame) -> DataFrame:
    """Comparable columns: whole numbers as BIGINT, lists and maps as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, T.MapType):
            c = F.array_join(
                F.array_sort(
                    F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
                ),
                "|",
            )
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- DuckDB text ---------------------------------------------------------------------


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(s(v) for v in values) + ")"


def values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else s(v) for v in row) + ")" for row in rows
    )


def re2(pattern: str) -> str:
    """A pattern for RE2: no possessive repeats or limits on groups, and \\w for all letters and digits."""
    pattern = pattern.replace("){1,127}", ")+").replace("){0,127}", ")*")
    out, in_class, first, i = [], False, -1, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\w":
            out.append(r"\p{L}\p{N}_" if in_class else r"[\p{L}\p{N}_]")
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(two)
            i += 2
            continue
        if pattern[i] == "[" and not in_class:
            in_class, first = True, i + 1
        elif pattern[i] == "]" and in_class and i != first:
            in_class = False
        elif pattern[i] == "[" and in_class:
            out.append("\\")
        if two in ("*+", "++", "?+") and not in_class:
            out.append(two[0])
            i += 2
            continue
        out.append(pattern[i])
        i += 1
    return "".join(out)


def rp(pattern: str) -> str:
    """An RE2 pattern as a SQL literal."""
    return s(re2(pattern))


def positions(source: str, text: str, pattern: str, emits: str, length: str, keys: str) -> str:
    """Matches with offsets: mark, split, unnest, and a running sum over the pieces. ``f`` is
    the list of emitted fields, ``start`` the offset, ``gap`` the text after the match."""
    mark = "chr(1) || " + s(emits.replace("|", "\x02")) + " || chr(3)"
    return f"""(
  SELECT {keys}, i, f, gap, start0::BIGINT AS start FROM (
    SELECT *, sum(CASE WHEN i = 1 THEN length(piece) ELSE ({length}) + length(gap) END)
        OVER (PARTITION BY {keys} ORDER BY i)
      - CASE WHEN i = 1 THEN length(piece) ELSE ({length}) + length(gap) END AS start0
    FROM (SELECT {keys}, i, piece, string_split(split_part(piece, chr(3), 1), chr(2)) AS f,
            CASE WHEN i = 1 THEN '' ELSE substr(piece, strpos(piece, chr(3)) + 1) END AS gap
          FROM (SELECT {keys}, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
                FROM (SELECT {keys}, string_split(regexp_replace({text}, {rp(pattern)}, {mark}, 'g'),
                             chr(1)) AS ps FROM {source}))))
  WHERE i > 1)"""


_A = "site, base_url, asset_seq, url, kind, content"
_TOKEN = (
    r"(//[^\n\r]*|/\*[\s\S]*?\*/)"
    r"|(\"[^\"\\\r\n]*(?:\\[^\n][^\"\\\r\n]*)*\"|'[^'\\\r\n]*(?:\\[^\n][^'\\\r\n]*)*'"
    r"|`[^`\\]*(?:\\[^\n][^`\\]*)*`)"
)
_BLANK = r"^\s*$"
_REGIONS = f"""
html AS (SELECT * FROM assets WHERE kind = 'html'),
parts AS (
  SELECT {_A}, 1 AS part, i, 'script' AS region_kind, start + length(f[1]) + 8 AS off, f[2] AS code
  FROM {positions("html", "content", r"(?i)<script\b([^>]*)>([\s\S]*?)(</script\s*>)", r"\1|\2|\3",
                  "length(f[1]) + length(f[2]) + length(f[3]) + 8", _A)}
  WHERE NOT regexp_matches(f[1], {s(r'''(?i)type\s*=\s*["']?text/(?:template|html|x-[a-z0-9_]+)''')})
  UNION ALL
  SELECT {_A}, 2, i, 'handler', start + length(f[1]) + 1, f[2]
  FROM {positions("html", "content", '''(?i)(\\son[a-z]{2,20}\\s*=\\s*)(?:"([^"]*)"|'([^']*)')''',
                  r"\1|\2\3", "length(f[1]) + length(f[2]) + 2", _A)}
  UNION ALL
  SELECT {_A}, 3, i, 'uri', start + length(f[1]) + 12, f[2]
  FROM {positions("html", "content", '''(?i)((?:href|src|action|formaction)\\s*=\\s*)(?:"javascript:([^"]*)"|'javascript:([^']*)')''',
                  r"\1|\2\3", "length(f[1]) + length(f[2]) + 13", _A)}),
regions AS (
  SELECT {_A}, row_number() OVER (PARTITION BY site, asset_seq ORDER BY part, i) - 1 AS region_idx,
         region_kind, off, code
  FROM parts WHERE NOT regexp_matches(code, '{_BLANK}')
  UNION ALL
  SELECT {_A}, 0, 'whole', 0, content FROM assets WHERE kind <> 'html')"""
_R = "site, base_url, asset_seq, url, kind, content, region_idx, off, code"
_TOKENS = f"""
tokens AS (
  SELECT {_R}, i, start, f[1] || f[2] AS raw, f[1] <> '' AS comment, gap
  FROM {positions("regions", "code", _TOKEN, r"\1|\2", "length(f[1]) + length(f[2])", _R)}),
stripped AS (
  SELECT r.* EXCLUDE (code), coalesce(substr(r.code, 1, t.head) || t.body, r.code) AS code
  FROM regions r LEFT JOIN (
    SELECT site, asset_seq, region_idx, min(start) AS head,
           string_agg(CASE WHEN comment THEN regexp_replace(raw, '[^\\n]', ' ', 'g') ELSE raw END
                      || gap, '' ORDER BY i) AS body
    FROM tokens GROUP BY 1, 2, 3) t USING (site, asset_seq, region_idx)),
literals AS (
  SELECT *, substr(code, greatest(1, start - 79), least(start, 80)) AS before,
    replace(replace(substr(raw, 2, length(raw) - 2), '\\n', chr(10)), '\\/', '/') AS value,
    regexp_extract(substr(code, greatest(1, start - 79), least(start, 80)),
      {s(r'''([A-Za-z_$][A-Za-z0-9_$-]*)\s*["']?\s*[:=]\s*(?:new\s+[A-Za-z0-9_]+\s*\(\s*)?$''')}, 1) AS key
  FROM tokens WHERE NOT comment)"""

#: CTE chains for statements to build on.
ASSETS = "WITH " + corpus_sql()
REGIONS = ASSETS + "," + _REGIONS
TOKENS = REGIONS + "," + _TOKENS

#: The same with what a scan reads: maps opened, their sources in their place.
_SCANNED = """assets AS (
  SELECT * FROM admitted WHERE kind <> 'map' UNION ALL
  SELECT site, base_url, asset_seq, false, url || ' (original sources)', 200,
    'application/javascript', '{}', array_to_string(sources, chr(10)), 'js'
  FROM (SELECT *, CAST(json_extract(content, '$.sourcesContent') AS VARCHAR[]) AS sources
        FROM admitted WHERE kind = 'map' AND json_valid(content)) WHERE len(sources) > 0)"""
SCAN = ASSETS.replace("assets AS (SELECT * FROM admitted)", _SCANNED)
SCAN_TOKENS = SCAN + "," + _REGIONS + "," + _TOKENS

VENDOR = (
    "regexp_matches(url, "
    + rp(
        r"(?i)/(?:node_modules|vendor|bower_components)/"
        r"|(?:^|/)(?:jquery|bootstrap|lodash|moment|underscore|angular|vue|react|polyfill|core-js"
        r"|regenerator|swiper|slick|gsap|three|chart|d3|axios|popper|modernizr|tailwind"
        r"|fontawesome)[.\-@]?[\d.]*(?:\.min)?\.js"
    )
    + ")"
)


def host(url: str) -> str:
    """Host of a URL; the corpus holds no user info and no bracketed address."""
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def root(host_sql: str) -> str:
    return f"array_to_string(string_split({host_sql}, '.')[-2:], '.')"


def scope(url: str, base: str) -> str:
    h, b = host(url), host(base)
    return (
        f"CASE WHEN {h} = '' OR {h} = {b} THEN 'same-origin' "
        f"WHEN {h} = {root(b)} OR ends_with({h}, '.' || {root(b)}) THEN 'subdomain' "
        f"ELSE 'external' END"
    )


def same_site(url: str, base: str) -> str:
    return f"({scope(url, base)} <> 'external' AND {host(url)} <> '')"


def line(content: str, pos: str) -> str:
    prefix = f"substr({content}, 1, {pos})"
    return (
        f"CASE WHEN {pos} <= 0 THEN 1 ELSE length({prefix}) - length(replace({prefix}, chr(10), ''))"
        f" + 1 END::BIGINT"
    )


def column(content: str, pos: str) -> str:
    prefix = f"substr({content}, 1, {pos})"
    return (
        f"CASE WHEN {pos} <= 0 THEN 1 ELSE length(regexp_extract({prefix}, '[^\\n]*$')) + 1 "
        f"END::BIGINT"
    )


def snippet(content: str, start: str, stop: str) -> str:
    pad = f"greatest(0, (110 - (({stop}) - ({start}))) // 2)"
    left, right = f"greatest(0, ({start}) - {pad})", f"least(length({content}), ({stop}) + {pad})"
    body = (
        f"trim(regexp_replace(substr({content}, ({left} + 1)::BIGINT, ({right} - {left})::BIGINT), "
        f"'\\s+', ' ', 'g'))"
    )
    return (
        f"left(CASE WHEN {left} > 0 THEN '…' ELSE '' END || {body} || "
        f"CASE WHEN {right} < length({content}) THEN '…' ELSE '' END, 150)"
    )


def closed(source: str, found: str, pattern: str) -> str:
    """Hits that end at an opening bracket, up to the one that closes it."""
    keys = "site, asset_seq, region_idx"
    heads = f"(SELECT * FROM {source} WHERE regexp_matches(code, {rp(pattern)}))"
    brackets = positions(heads, "code", _TOKEN + r"|([\[\]{}])", r"\1\2|\3", "length(f[1]) + length(f[2])", keys)
    pairs = f"""(SELECT {keys}, start AS opened, lead(start) OVER same AS closed, kind || lead(kind) OVER same AS kinds FROM (
      SELECT {keys}, start, f[2] AS kind, sum(CASE WHEN f[2] IN ('[', '{{') THEN 1 ELSE -1 END)
          OVER (PARTITION BY {keys} ORDER BY start) + CASE WHEN f[2] IN ('[', '{{') THEN 0 ELSE 1 END AS level
      FROM {brackets} WHERE f[2] <> '') WINDOW same AS (PARTITION BY {keys}, level ORDER BY start))"""
    ends = "right(h.text, 1) IN ('[', '{')"
    return f"""SELECT rule, {", ".join("h." + c for c in _R.split(", "))}, start,
      CASE WHEN {ends} THEN closed + 1 ELSE stop END AS stop,
      CASE WHEN {ends} THEN substr(code, (start + 1)::BIGINT, (closed + 1 - start)::BIGINT) ELSE text END AS text,
      CASE WHEN {ends} THEN [groups[1], substr(code, stop::BIGINT, (closed + 2 - stop)::BIGINT)] ELSE groups END AS groups, tail
    FROM ({found}) h LEFT JOIN {pairs} p ON h.site = p.site AND h.asset_seq = p.asset_seq AND h.region_idx = p.region_idx
      AND h.stop = p.opened + 1 AND kinds IN ('[]', '{{}}') WHERE NOT {ends} OR closed IS NOT NULL"""


def hits(source: str, rules, patterns: dict[str, str] | None = None) -> str:
    """Rule hits of a code table; ``patterns`` restates rules RE2 cannot run."""
    parts = []
    for rule in rules:
        pattern = (patterns or {}).get(rule.id, rule.pattern)
        groups = "|".join(["\\0"] + [f"\\{g + 1}" for g in range(rule.groups)])
        found = (
            f"SELECT {s(rule.id)} AS rule, {_R}, start, start + length(f[1]) AS stop, "
            f"f[1] AS text, f[2:] AS groups, "
            f"substr(code, (start + length(f[1]) + 1)::BIGINT, 240) AS tail FROM "
            + positions(source, "code", pattern, groups, "length(f[1])", _R)
        )
        parts.append(closed(source, found, pattern) if rule.body else found)
    return "(" + " UNION ALL ".join(parts) + ")"


def rule_rows(rules) -> str:
    """The catalogue as a table: rule, rule_ord, title, severity."""
    rows = values((r.id, i, r.title, r.severity) for i, r in enumerate(rules))
    return f"(VALUES {rows}) AS rules(rule, rule_ord, title, severity)"
