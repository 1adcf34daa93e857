"""Detector queries. Each oracle is also a part of the whole-scan oracles in ``results``."""

from __future__ import annotations

from ..functions.sqlexpr import F
from ..operators import access as acc
from ..operators import endpoints as ep
from ..operators import exposure as ex
from ..operators import headers as hd
from ..operators import links as lk
from ..operators import rule_join as rj
from ..operators import secrets as sc
from ..operators import technologies as tc
from ..operators import vulnerabilities as vu
from ..operators.findings import main_documents
from ..rules import access as ar
from ..rules import endpoints as er
from ..rules import secrets as sr
from ..rules import technologies as tr
from ..rules import vulns as vr
from ..rules import words as wr
from .base import (
    ASSETS, REGIONS, SCAN, SCAN_TOKENS, VENDOR, Corpus, column, flat, hits, host, in_list, line, path, positions, query, rp,
    rule_rows, s, scope, snippet, values,
)
from .extract import (
    BACKEND, CLASSES, HUMAN, PLACEHOLDER, ROUTE, _all_urls, _resolve, api_like, api_path, kind_sql,
)

FINDING = (
    "site", "asset_seq", "detector_ord", "rule_ord", "region_idx", "pos", "category", "title",
    "severity", "confidence", "value", "detail", "url", "line", "col", "snippet",
)
#: name -> (CTE prefix, SELECT) of the finding oracles
FINDING_SQL: dict[str, str] = {}


def show(findings):
    return flat(findings.select(*FINDING))


def _spot(start: str = "(off + start)", stop: str = "(off + stop)") -> str:
    return (f"{line('content', start)} AS line, {column('content', start)} AS col, "
            f"{snippet('content', start, stop)} AS snippet")


def _part_spot() -> str:
    """A part of a literal, ``shift`` characters behind its start, with the literal's excerpt."""
    return (f"{line('content', '(off + start + shift)')} AS line, {column('content', '(off + start + shift)')} AS col, "
            f"{snippet('content', '(off + start)', '(off + stop)')} AS snippet")


def _finding(source: str, detector: int, category: str, title: str, severity: str,
             confidence: str, value: str, detail: str, spot: str, rule_ord: str = "rule_ord",
             region: str = "region_idx", pos: str = "start", url: str = "url",
             seq: str = "asset_seq") -> str:
    return f"""SELECT site, {seq}::BIGINT AS asset_seq, {detector}::BIGINT AS detector_ord,
  ({rule_ord})::BIGINT AS rule_ord, ({region})::BIGINT AS region_idx, ({pos})::BIGINT AS pos,
  {s(category)} AS category, {title} AS title, {severity} AS severity, {confidence} AS confidence,
  {value} AS value, {detail} AS detail, {url} AS url, {spot} FROM {source}"""


def finding_query(name: str, sql: str, prefix: str = SCAN_TOKENS):
    FINDING_SQL[name] = sql
    return query(name, prefix + " " + sql)


def _details(rules) -> str:
    rows = values((r.id, i, r.title, r.severity, r.detail) for i, r in enumerate(rules))
    return f"(VALUES {rows}) AS rules(rule, rule_ord, title, severity, detail)"


VULN, ACC, EXPO, SECRET, HEAD = (
    "Vulnerability", "Access Control", "Information Exposure", "Secret", "Security Header")

# ---- vulnerabilities -------------------------------------------------------------------

#: RE2 has no look-ahead: these match wider, and the exclusion is tested on the rest
_WIDER = {
    "misc_http": r"[\"'](http://[\w.\-]+\.[a-z]{2,}[^\"'\s]*)[\"']",
    "xss_innerhtml": r"\.\s*(?:innerHTML|outerHTML)\s*(?:\+)?=\s*",
    "xss_eval": r"\beval\s*\(\s*",
    "xss_jquery": r"\$\([^)]{0,80}\)\s*\.\s*(?:html|append|prepend|after|before|replaceWith)\s*\(\s*",
}
_NAMESPACES = (r"^http://(?:localhost|127\.0\.0\.1|0\.0\.0\.0"
               r"|(?:www\.)?(?:w3|schema|purl|gmpg|xmlns|openurl|ns\.adobe|iptc)\.org"
               r"|(?:www\.)?(?:creativecommons|w3c)\.org)")
_HTML = f"(regexp_matches(text, {rp(wr.HTML_TAG)}) OR regexp_matches(text, {rp(wr.JSX_TAG)}))"


@finding_query("misc_vulns", _finding(
    f"""(SELECT *, coalesce(nullif(array_to_string(groups, ''), ''), text) AS val
         FROM {hits("regions", vr.MISC_RULES, _WIDER)} h JOIN {_details(vr.MISC_RULES)} USING (rule)
         WHERE NOT ({VENDOR} AND severity IN ('LOW', 'INFO'))
           AND NOT (rule = 'misc_http' AND regexp_matches(groups[1], {s(_NAMESPACES)}))
           AND NOT (rule = 'misc_graphql' AND {_HTML}))""",
    4, VULN, "title", "severity", "'FIRM'", "val", "detail", _spot()))
def _(c: Corpus):
    return show(vu.misc_vulns(c.scan.assets))


_TABLE_RULES = (*vr.MISC_RULES, *er.CALL_RULES)


@query("rule_join", REGIONS + f""" SELECT site, asset_seq, region_idx::BIGINT AS region_idx, rule,
  start::BIGINT AS start, stop::BIGINT AS stop, text, array_to_string(groups, '|') AS groups
FROM {hits("regions", _TABLE_RULES, _WIDER)}
WHERE NOT (rule = 'misc_http' AND regexp_matches(groups[1], {s(_NAMESPACES)}))""")
def _(c: Corpus):
    rules = rj.rule_rows(c.spark, _TABLE_RULES)
    return flat(rj.rule_hits(c.regions, rules, ("site", "asset_seq", "region_idx")))


@finding_query("xss_sinks", _finding(
    f"""(SELECT *, regexp_extract(text || left(tail, 200), {rp(vr.XSS_TAINT)}) AS taint
         FROM {hits("stripped", vr.XSS_RULES, _WIDER)} h JOIN {_details(vr.XSS_RULES)} USING (rule)
         WHERE NOT {VENDOR}
           AND NOT (rule = 'xss_innerhtml' AND regexp_matches(tail, '^["'']\\s*["'']'))
           AND NOT (rule IN ('xss_eval', 'xss_jquery') AND regexp_matches(tail, '^["'']')))""",
    3, VULN, "title",
    "CASE WHEN taint = '' THEN severity WHEN severity = 'LOW' THEN 'MEDIUM' ELSE 'HIGH' END",
    "CASE WHEN taint = '' THEN 'TENTATIVE' ELSE 'FIRM' END", "text",
    "CASE WHEN taint = '' THEN 'Markup or code is made from a value at run time.' ELSE 'Markup or code is made from what the visitor sends (`' || taint || '`).' END",
    _spot()))
def _(c: Corpus):
    return show(vu.xss_sinks(c.scan.assets))


@finding_query("orm_usage", _finding(
    f"""(SELECT * FROM {hits("stripped", vr.ORM_RULES)} h JOIN {_details(vr.ORM_RULES)} USING (rule)
         WHERE NOT {VENDOR})""",
    2, VULN, "title", "severity", "'FIRM'", "text", "detail", _spot(),
    rule_ord="rule_ord + 1"))
def _(c: Corpus):
    return show(vu.orm_usage(c.scan.assets))


def _verb(verb: str, head: str, follows: str) -> str:
    """A statement's verb and target: the rest after a head is what stands behind its first place."""
    if verb == "UNION":
        return f"WHEN regexp_matches(body, {rp(head)}) THEN 'UNION|'"
    inner = head.removeprefix("(?i)").replace("(" + vr._IDENT + ")", "(?:" + vr._IDENT + ")")
    rest = f"regexp_extract(body, {rp('(?is)' + inner + '(.*)$')}, 1)"
    named = f"regexp_extract(body, {rp(head)}, 1)" if verb != "SELECT" else f"regexp_extract({rest}, {rp(follows)}, 1)"
    target = f"regexp_replace({named}, {rp(vr.SQL_TARGET_NOISE)}, '', 'g')"
    after = f"AND regexp_matches({rest}, {rp(follows)}) " if follows and verb != "SELECT" else ""
    return (f"WHEN regexp_matches({target}, {rp(vr.SQL_VALID_TABLE)}) {after}AND "
            f"lower(split_part({target}, '.', 1)) NOT IN {in_list(vr.SQL_STOPWORD_TARGETS)} "
            f"THEN '{verb}|' || {target}")


_PROSE = (
    f"(len(regexp_extract_all(text, '[A-Za-z'']{{2,}}')) >= 5 AND (regexp_matches(text, {rp(wr.HTML_ENTITY)}) OR "
    f"(len(list_filter(regexp_extract_all(text, '[A-Za-z'']{{2,}}'), lambda w: lower(w) IN {in_list(wr.COMMON_WORDS)}))"
    f" / len(regexp_extract_all(text, '[A-Za-z'']{{2,}}'))::DOUBLE >= 0.7 "
    f"AND len(regexp_extract_all(text, '[{{}}();=\\[\\]<>|&$]')) <= 2)))"
)
_LITERALS = (
    "(SELECT *, start + length(raw) AS stop, value AS text, "
    "left(raw, 1) = '`' AND contains(raw, '${') AS interpolated FROM literals)"
)
#: Semicolons outside quotes end a statement: pieces between semicolons, those that begin inside a
#: string joined to the one before.
_SQL_LITERALS = f"""(SELECT *, row_number() OVER (ORDER BY site, asset_seq, region_idx, start) AS lit FROM {_LITERALS}
  WHERE NOT {VENDOR} AND regexp_matches(upper(text), 'SELECT|INSERT|UPDATE|DELETE|DROP|TRUNCATE|UNION')
    AND regexp_matches(text, {rp(vr.SQL_CORROBORATION)}) AND NOT {_HTML} AND NOT {_PROSE})"""
_STATEMENTS = f"""(SELECT lit, min(bgn) AS bgn, string_agg(piece, ';' ORDER BY k) AS body FROM (
  SELECT *, sum(CASE WHEN quotes % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lit ORDER BY k) AS n FROM (
    SELECT lit, k, piece, coalesce(sum(length(piece) - length(replace(piece, chr(39), ''))) OVER before, 0) AS quotes,
      coalesce(sum(length(piece) + 1) OVER before, 0) AS bgn
    FROM (SELECT lit, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k
          FROM (SELECT lit, string_split(text, ';') AS ps FROM {_SQL_LITERALS}))
    WINDOW before AS (PARTITION BY lit ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
  GROUP BY lit, n)"""
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13)"
_SQL_ROWS = f"""(SELECT *, interp <> '' OR (interpolated AND contains(text, '${{')) AS injected FROM (
  SELECT * EXCLUDE (text), regexp_extract(CASE WHEN several THEN trim(body, {_BLANKS}) ELSE text END, {rp(vr.SQL_INTERPOLATION)}) AS interp,
    CASE WHEN several THEN trim(body, {_BLANKS}) ELSE text END AS text,
    CASE WHEN several AND length(text) = stop - start - 2
      THEN (1 + bgn + length(body) - length(ltrim(body, {_BLANKS})))::BIGINT ELSE 0 END AS shift
  FROM (SELECT *, count(*) OVER (PARTITION BY lit) > 1 AS several FROM (
    SELECT *, CASE {" ".join(_verb(*x) for x in vr.SQL_STATEMENTS)} END AS stmt
    FROM {_SQL_LITERALS} JOIN {_STATEMENTS} USING (lit)) WHERE stmt IS NOT NULL)))"""


@finding_query("sql_statements", _finding(
    _SQL_ROWS, 2, VULN,
    f"CASE WHEN injected THEN {s(vr.SQL_INJECTION[1])} ELSE {s(vr.SQL_RAW[1])} END",
    "CASE WHEN injected THEN 'CRITICAL' ELSE 'HIGH' END", "'FIRM'",
    "trim(regexp_replace(text, '\\s+', ' ', 'g'))",
    f"CASE WHEN injected THEN {s(vr.SQL_INJECTION[2])} ELSE {s(vr.SQL_RAW[2])} END",
    _part_spot(), rule_ord="0", pos="start + shift"))
def _(c: Corpus):
    return show(vu.sql_statements(c.scan.assets))


@query("sql_evidence", SCAN_TOKENS + f"""
SELECT site, asset_seq, (start + shift)::BIGINT AS pos, split_part(stmt, '|', 1) AS statement,
  coalesce(nullif(split_part(stmt, '|', 2), ''), '-') AS target, text AS query,
  nullif(interp, '') AS interpolation FROM {_SQL_ROWS}""")
def _(c: Corpus):
    e = F.col("evidence")
    return flat(vu.sql_statements(c.scan.assets).select(
        "site", "asset_seq", "pos", *[F.try_element_at(e, F.lit(k)).alias(k)
                                      for k in ("statement", "target", "query", "interpolation")]))


# ---- access ----------------------------------------------------------------------------

_ROLE_SET = in_list(ar.PRIVILEGED_ROLES)


def _real_role(v: str) -> str:
    return (f"(lower({v}) <> '' AND length({v}) <= 48 AND lower({v}) NOT IN {in_list(ar.ROLE_DENYLIST)} "
            f"AND NOT regexp_matches({v}, {rp(ar.PERMISSION_DENY)}) "
            f"AND NOT regexp_matches({v}, '^[0-9.]+$') AND NOT regexp_matches({v}, '[<>{{}}()\\[\\]/\\\\]'))")


def _priv(v: str) -> str:
    plain = f"replace(lower({v}), '-', '_')"
    return f"({plain} IN {_ROLE_SET} OR ltrim({plain}, 'role_') IN {_ROLE_SET})"


_VOCABULARY = f"""(SELECT *, CASE rule WHEN 'acc_role' THEN start + length(groups[1]) + length(groups[2])
    WHEN 'acc_catalogue' THEN start ELSE start + 1 END AS fstart,
    CASE WHEN rule = 'acc_catalogue' THEN stop
      WHEN rule = 'acc_role' THEN start + length(groups[1]) + length(groups[2]) + length(groups[3])
      ELSE start + 1 + length(groups[1]) END AS fstop FROM (
  SELECT *, row_number() OVER (PARTITION BY site, asset_seq, seen ORDER BY region_idx, rule_ord, stop) AS rn
  FROM (SELECT *, CASE WHEN rule = 'acc_catalogue'
          THEN array_to_string(list_sort(list_distinct(list_transform(items, lambda x: lower(x)))), '|')
          ELSE lower(single) END AS seen
    FROM (SELECT *, CASE rule WHEN 'acc_role' THEN trim(groups[3]) WHEN 'acc_catalogue' THEN ''
                    ELSE groups[1] END AS single,
            CASE WHEN rule = 'acc_catalogue' THEN list_filter(list_transform(
              regexp_extract_all(groups[2], '["'']([^"'']{{2,64}})["'']', 1), lambda x: trim(x)),
              lambda x: {_real_role("x")}) ELSE [] END AS items
          FROM {hits("stripped", ar.ROLE_RULES)} h JOIN {_details(ar.ROLE_RULES)} USING (rule)
          WHERE NOT {VENDOR})
    WHERE CASE rule WHEN 'acc_role' THEN {_real_role("single")} WHEN 'acc_catalogue' THEN len(items) > 0
      WHEN 'acc_permission' THEN NOT regexp_matches(single, {rp(ar.PERMISSION_DENY)}) ELSE true END))
  WHERE rn = 1)"""
_PRIV_ITEMS = f"list_filter(items, lambda x: replace(lower(x), '-', '_') IN {_ROLE_SET})"
_IS_PRIV = f"CASE WHEN rule = 'acc_catalogue' THEN len({_PRIV_ITEMS}) > 0 ELSE {_priv('single')} END"
_ROLES = _finding(
    _VOCABULARY, 5, ACC,
    f"CASE WHEN rule IN ('acc_role', 'acc_constant') AND {_IS_PRIV} THEN 'Privileged role name exposed' "
    "WHEN rule IN ('acc_role', 'acc_constant') THEN 'Role name exposed' "
    "WHEN rule = 'acc_catalogue' THEN 'Role/permission catalogue exposed (`' || groups[1] || '`)' ELSE title END",
    f"CASE WHEN rule <> 'acc_permission' AND {_IS_PRIV} THEN 'MEDIUM' ELSE 'LOW' END", "'FIRM'",
    "CASE WHEN rule = 'acc_catalogue' THEN array_to_string(items, ', ') ELSE single END",
    f"CASE WHEN rule IN ('acc_role', 'acc_constant') THEN 'Delivered code names the role `' || single || '`' "
    f"|| CASE WHEN {_IS_PRIV} THEN ', a privileged one' ELSE '' END || '.' "
    f"WHEN rule = 'acc_catalogue' THEN 'Delivered code lists ' || len(items) || ' entries of `' "
    f"|| groups[1] || '`' || CASE WHEN {_IS_PRIV} THEN ', some of them privileged (' "
    f"|| array_to_string({_PRIV_ITEMS}, ', ') || ')' ELSE '' END || '. They show how the application divides rights.' "
    f"ELSE detail END",
    _spot("(off + fstart)", "(off + fstop)"))


@finding_query("first_seen_roles", _ROLES)
def _(c: Corpus):
    return show(acc.role_vocabulary(c.scan.assets))


for _name, _rule in (("role_assignments", 0), ("role_catalogues", 1), ("role_constants", 2),
                     ("permission_strings", 3)):
    @query(_name, SCAN_TOKENS + f" SELECT * FROM ({_ROLES}) WHERE rule_ord = {_rule}")
    def _(c: Corpus, rule=_rule):
        return show(acc.role_vocabulary(c.scan.assets).where(f"rule_ord = {rule}"))


def _first(source: str, key: str) -> str:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, asset_seq, region_idx, {key} "
            f"ORDER BY stop) AS rn FROM {source}) WHERE rn = 1)")


_CHECKS = _first(
    f"(SELECT *, groups[1] || '(' || trim(groups[2]) || ')' AS call FROM {hits('stripped', ar.CHECK_RULES)} h "
    f"JOIN {_details(ar.CHECK_RULES)} USING (rule) WHERE NOT {VENDOR} AND trim(groups[2]) <> '')", "call")


@finding_query("permission_checks", _finding(
    _CHECKS, 5, ACC, "title", "severity", "'FIRM'", "call", "detail", _spot(), rule_ord="10"))
def _(c: Corpus):
    return show(acc.permission_checks(c.scan.assets))


@query("first_seen_calls", SCAN_TOKENS + f"""
SELECT site, count(*) AS calls, count(DISTINCT call) AS distinct_calls FROM {_CHECKS} GROUP BY site""")
def _(c: Corpus):
    return acc.permission_checks(c.scan.assets).groupBy("site").agg(
        F.count("*").alias("calls"), F.count_distinct("value").alias("distinct_calls"))


@finding_query("auth_bypass", _finding(
    f"(SELECT * FROM {hits('stripped', ar.BYPASS_RULES)} h JOIN {_details(ar.BYPASS_RULES)} USING (rule) "
    f"WHERE NOT {VENDOR})",
    5, ACC, "title", "severity", "'FIRM'", "text", "detail", _spot(), rule_ord="rule_ord + 20"))
def _(c: Corpus):
    return show(acc.auth_bypass(c.scan.assets))


@finding_query("idor_hints", _finding(
    _first(f"(SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS val FROM "
           f"{hits('stripped', ar.IDOR_RULES)} h JOIN {_details(ar.IDOR_RULES)} USING (rule) WHERE NOT {VENDOR})",
           "val"),
    5, ACC, "title", "severity", "'TENTATIVE'", "val", "detail", _spot(), rule_ord="30"))
def _(c: Corpus):
    return show(acc.idor_hints(c.scan.assets))


@query("feature_flags", SCAN_TOKENS + f"""
SELECT site, asset_seq, url, region_idx::BIGINT AS region_idx, start::BIGINT AS pos, groups[1] AS flag,
  groups[2] AS value FROM {hits('stripped', ar.FLAG_RULES)} WHERE NOT {VENDOR}""")
def _(c: Corpus):
    return flat(acc.feature_flags(c.scan.assets))


# ---- secrets ---------------------------------------------------------------------------

_LIT = f"(SELECT *, row_number() OVER (ORDER BY site, asset_seq, region_idx, start) AS lit FROM {_LITERALS})"
_SHAPES = [p for _i, _t, p, _s in sr.PROVIDERS] + [sr.JWT]
#: All shapes of a literal from left to right; a match is the first provider's that it is whole.
_SHAPED = positions(_LIT, "text", "|".join(f"(?:{p})" for p in _SHAPES), r"\0", "length(f[1])", "lit, text")
_KIND = " ".join(f"WHEN regexp_full_match(val, {rp(p)}) THEN {i}" for i, p in enumerate(_SHAPES))
_PROVIDER_ROWS = values(
    (i, rid, title, sev) for i, (rid, title, _p, sev) in enumerate(sr.PROVIDERS))
_GENERIC = (
    f"(regexp_matches(key, {rp(sr.SECRET_KEY)}) AND NOT {VENDOR} AND NOT "
    + PLACEHOLDER.replace("tok", "text")
    + " AND NOT (regexp_replace(lower(key), '[^a-z0-9]', '', 'g') <> '' AND "
      "regexp_replace(lower(key), '[^a-z0-9]', '', 'g') = regexp_replace(lower(text), '[^a-z0-9]', '', 'g'))"
    + " AND NOT contains(text, '://') AND NOT " + ROUTE.format(v="text") + " AND NOT " + HUMAN.format(v="text")
    + " AND NOT (regexp_matches(text, '^[0-9a-fA-F]+$') AND length(text) IN (7,8,16,20,32,40,64,128))"
    + " AND NOT regexp_matches(text, '[\\s(){};]') AND length(text) >= 12 AND " + CLASSES.format(v="text")
    + " >= 2 AND NOT (length(text) < 32 AND regexp_matches(text, '^\\p{L}+(?:[\\s_-]\\p{L}+)*$'))"
    + " AND list_sum(list_transform(list_distinct(string_split(text, '')), lambda ch: "
      "-((length(text) - length(replace(text, ch, ''))) / length(text)::DOUBLE) * "
      "log2((length(text) - length(replace(text, ch, ''))) / length(text)::DOUBLE))) >= 3.0)"
)
_JWT_JSON = "decode(from_base64(translate({seg}, '-_', '+/') || repeat('=', ((4 - length({seg}) % 4) % 4)::BIGINT)))"
_HEADER = _JWT_JSON.format(seg="split_part(val, '.', 1)")
_PAYLOAD = _JWT_JSON.format(seg="split_part(val, '.', 2)")
_CLAIMS = in_list(ar.JWT_AUTHZ_CLAIMS)
_SHAPE_ROWS = f"""(SELECT lit, bgn, val, rule_ord, payload,
    CASE WHEN rule_ord = {len(sr.PROVIDERS)} THEN list_sort(list_filter(json_keys(payload), lambda k: k IN {_CLAIMS})) END AS authz
  FROM (SELECT *, CASE WHEN rule_ord = {len(sr.PROVIDERS)} THEN {_HEADER} END AS head,
      CASE WHEN rule_ord = {len(sr.PROVIDERS)} THEN {_PAYLOAD} END AS payload
    FROM (SELECT *, CASE {_KIND} END AS rule_ord FROM (SELECT lit, start AS bgn, f[1] AS val FROM {_SHAPED})))
  WHERE rule_ord < {len(sr.PROVIDERS)} OR (CASE WHEN json_valid(head) AND json_valid(payload) THEN
    coalesce(json_type(head) = 'OBJECT' AND json_type(payload) = 'OBJECT'
      AND (json_exists(head, '$.alg') OR json_exists(head, '$.typ')), false) ELSE false END))"""
_SECRET_ROWS = f"""(SELECT l.*, rule_ord, val, payload, authz,
    CASE WHEN length(text) = stop - start - 2 THEN 1 + bgn ELSE 0 END AS shift
  FROM {_LIT} l JOIN {_SHAPE_ROWS} USING (lit)
  UNION ALL SELECT *, {len(sr.PROVIDERS) + 1}, text, NULL, NULL, 0 FROM {_LIT}
  WHERE {_GENERIC} AND lit NOT IN (SELECT lit FROM {_SHAPE_ROWS}))"""
_JWT_PRIV = "regexp_matches(json_extract_string(payload, '$.role'), '^(admin|root|owner)$')"
_SECRETS = _finding(
    f"(SELECT * FROM {_SECRET_ROWS} x LEFT JOIN (VALUES {_PROVIDER_ROWS}) AS pr(p, pid, ptitle, psev) ON p = rule_ord)",
    1, SECRET,
    f"CASE rule_ord WHEN {len(sr.PROVIDERS)} THEN 'JSON Web Token (JWT)' WHEN {len(sr.PROVIDERS) + 1} THEN "
    f"{s(sr.GENERIC_TITLE)} ELSE ptitle END",
    f"CASE WHEN rule_ord = {len(sr.PROVIDERS)} AND {_JWT_PRIV} THEN 'CRITICAL' ELSE coalesce(psev, 'HIGH') END",
    f"CASE WHEN rule_ord = {len(sr.PROVIDERS) + 1} THEN 'FIRM' ELSE 'CONFIRMED' END", "val",
    f"CASE rule_ord WHEN {len(sr.PROVIDERS)} THEN CASE WHEN len(authz) > 0 THEN 'The token states rights: ' "
    f"|| array_to_string(authz, ', ') || '.' ELSE 'The token states no rights.' END "
    f"|| CASE WHEN {_JWT_PRIV} THEN ' One of them is privileged.' ELSE '' END "
    f"|| CASE WHEN json_exists(payload, '$.exp') THEN CASE WHEN CAST(json_extract_string(payload, '$.exp') AS DOUBLE) "
    f">= epoch(now()) THEN ' It has not run out.' ELSE ' It has run out.' END ELSE '' END "
    f"WHEN {len(sr.PROVIDERS) + 1} THEN {s(sr.GENERIC_DETAIL)} ELSE {s(sr.PROVIDER_DETAIL)} END", _part_spot(), pos="start + shift")
FINDING_SQL["secrets"] = _SECRETS


@query("secrets", SCAN_TOKENS + _SECRETS)
def _(c: Corpus):
    return show(sc.secrets(c.scan.assets))


_GROUPS = {
    "secret_aws": ("AWS Access Key ID",),
    "secret_stripe": ("Stripe Secret Key", "Stripe Publishable Key"),
    "secret_google": ("Google API Key",),
    "secret_jwt": ("JSON Web Token (JWT)",),
    "secret_dburl": ("Database Connection String",),
    "secret_pem": ("Private Key",),
    "secret_github": ("GitHub Token",),
    "secret_slack": ("Slack Token",),
    "secret_other_providers": tuple(t for _i, t, _p, _s in sr.PROVIDERS[8:]),
    "secret_generic": (sr.GENERIC_TITLE,),
}
for _name, _titles in _GROUPS.items():
    @query(_name, SCAN_TOKENS + f" SELECT * FROM ({_SECRETS}) WHERE title IN {in_list(_titles)}")
    def _(c: Corpus, titles=_titles):
        return show(sc.secrets(c.scan.assets).where(F.col("title").isin(*titles)))


# ---- endpoints -------------------------------------------------------------------------

_EP = ("site", "asset_seq", "region_idx", "pos", "raw_url", "method", "inferred")
_CALL_HITS = hits("regions", er.CALL_RULES)
_OPTION = f"upper(regexp_extract(tail, {rp(er.METHOD_OPTION)}, 1))"
CALLS_SQL = f"""SELECT site, base_url, asset_seq, url AS source, region_idx::BIGINT AS region_idx,
    start::BIGINT AS pos, 0 AS op, trim(groups[2]) AS raw_url,
    coalesce(nullif(upper(groups[1]), ''), nullif({_OPTION}, ''), 'GET') AS method,
    groups[1] = '' AND {_OPTION} = '' AS inferred FROM {_CALL_HITS} WHERE rule = 'ep_call'"""
MENTIONS_SQL = f"""SELECT site, base_url, asset_seq, url AS source, region_idx::BIGINT AS region_idx,
    start::BIGINT AS pos, 1 AS op, groups[2] AS raw_url, upper(groups[1]) AS method, false AS inferred
  FROM {_CALL_HITS} WHERE rule = 'ep_mention'"""
_V = "trim(value, chr(32) || chr(9) || chr(10) || chr(13))"
LITERAL_PATHS_SQL = f"""SELECT site, base_url, asset_seq, url AS source, region_idx::BIGINT AS region_idx,
    start::BIGINT AS pos, 2 AS op, {_V} AS raw_url, 'GET' AS method, true AS inferred
  FROM literals WHERE starts_with({_V}, '/') AND {api_path(_V)}"""
CONSTANTS_SQL = f"""SELECT site, base_url, asset_seq, url AS source, region_idx::BIGINT AS region_idx,
    start::BIGINT AS pos, {_V} AS route, key FROM literals
  WHERE key <> '' AND contains({_V}, '/') AND NOT starts_with({_V}, '/')
    AND {ROUTE.format(v=_V)} AND NOT regexp_matches({_V}, {rp(wr.MIME_LIKE)})
    AND NOT contains(regexp_extract({_V}, '([^/]*)$', 1), '.')
    AND NOT contains(split_part({_V}, '/', 1), '.')
    AND NOT regexp_matches({_V}, '(?:^|/)[0-9]+(?:/|$)')"""
_STATIC = "|".join(e[1:] for e in er.STATIC_EXTENSIONS)


def _clean(u: str) -> str:
    cut = f"rtrim(regexp_replace({u}, {s(er.INTERPOLATED_TAIL)}, ''), '?&=/')"
    return f"CASE WHEN length({cut}) - length(replace({cut}, '/', '')) >= 2 THEN {cut} ELSE '' END"


def _static(u: str) -> str:
    return f"regexp_matches(lower({path(u)}), '[.]({_STATIC})$')"


RECORDED_SQL = f"""SELECT *, {kind_sql("url")} AS endpoint_kind, {scope("url", "base_url")} AS scope FROM (
  SELECT * EXCLUDE (raw_url), {_clean('''CASE WHEN regexp_matches(raw_url, '^https?://') THEN raw_url
      WHEN starts_with(raw_url, '//') THEN 'https:' || raw_url
      WHEN starts_with(raw_url, '/') THEN CASE WHEN contains(''' + path("source") + ''', '/wp-json')
          AND NOT starts_with(raw_url, '/wp-json')
        THEN regexp_extract(source, '^[a-z]+://[^/?#]*') || '/wp-json' || raw_url
        ELSE regexp_extract(base_url, '^[a-z]+://[^/?#]*') || raw_url END END''')} AS url
  FROM ({CALLS_SQL} UNION ALL {MENTIONS_SQL} UNION ALL {LITERAL_PATHS_SQL})
  WHERE raw_url <> ''
    AND NOT regexp_matches(raw_url, '^(data:|blob:|mailto:|tel:|javascript:|#)'))
WHERE url IS NOT NULL AND url <> '' AND NOT {_static("url")}"""
_OPTIONAL = "site, asset_seq, region_idx, pos, raw_url, method, inferred"


def _ep_hits(c: Corpus):
    return ep.endpoint_hits(c.scan.assets)


for _name, _sql, _rows in (
    ("call_sites", CALLS_SQL, ep.call_site_rows),
    ("method_url_mentions", MENTIONS_SQL, ep.mention_rows),
    ("literal_api_paths", LITERAL_PATHS_SQL, ep.literal_path_rows),
):
    @query(_name, SCAN_TOKENS + f" SELECT {_OPTIONAL} FROM ({_sql})")
    def _(c: Corpus, rows=_rows):
        return flat(rows(_ep_hits(c)).select(*_EP))


@query("record_call", SCAN_TOKENS + f"""
SELECT site, asset_seq, region_idx, pos, op::BIGINT AS op, method, url, endpoint_kind, scope, inferred
FROM ({RECORDED_SQL})""")
def _(c: Corpus):
    h = _ep_hits(c)
    calls = ep.call_site_rows(h).unionByName(ep.mention_rows(h)).unionByName(ep.literal_path_rows(h))
    return flat(ep.record_calls(calls).select(
        "site", "asset_seq", "region_idx", "pos", "op", "method", "url", "endpoint_kind", "scope", "inferred"))


@query("route_constants", SCAN_TOKENS + f"""
SELECT site, asset_seq, region_idx, pos, route, key FROM ({CONSTANTS_SQL})""")
def _(c: Corpus):
    return flat(ep.route_constant_rows(_ep_hits(c)).select(
        "site", "asset_seq", "region_idx", "pos", "route", "key"))


TABLES_SQL = f"""SELECT DISTINCT c.site, c.base_url, c.asset_seq, c.source, c.region_idx, route AS url FROM ({CONSTANTS_SQL}) c
  JOIN (SELECT site, asset_seq, region_idx FROM ({CONSTANTS_SQL}) GROUP BY ALL
        HAVING count(DISTINCT route) >= 3) t USING (site, asset_seq, region_idx)"""


@query("route_tables", SCAN_TOKENS + f"SELECT site, asset_seq, region_idx, url, 'relative' AS scope FROM ({TABLES_SQL})")
def _(c: Corpus):
    return flat(ep.route_tables(ep.route_constant_rows(_ep_hits(c))).select(
        "site", "asset_seq", "region_idx", "url", "scope"))


SPA_SQL = f"""SELECT site, base_url, asset_seq, url AS source, region_idx::BIGINT AS region_idx, start::BIGINT AS pos,
  {_resolve("base_url", "groups[1]")} AS url FROM {_CALL_HITS}
  WHERE rule = 'ep_route'"""


@query("spa_routes", SCAN_TOKENS + f"SELECT site, asset_seq, region_idx, pos, url FROM ({SPA_SQL})")
def _(c: Corpus):
    return flat(ep.spa_route_rows(_ep_hits(c)).select("site", "asset_seq", "region_idx", "pos", "url"))


WS_SQL = f"""SELECT site, base_url, asset_seq, source, (i - 1)::BIGINT AS pos, regexp_replace(u, {s(er.TRAILING_JUNK)}, '') AS url
FROM (SELECT site, base_url, asset_seq, url AS source, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM (
  SELECT site, base_url, asset_seq, url, regexp_extract_all(content, {rp(er.WEBSOCKET)}) AS us FROM assets))"""


@query("websockets", SCAN + f"SELECT site, asset_seq, pos, url, {scope('url', 'base_url')} AS scope FROM ({WS_SQL})")
def _(c: Corpus):
    return flat(ep.websockets(c.scan.assets).select("site", "asset_seq", "pos", "url", "scope"))


# ---- technologies ----------------------------------------------------------------------

TECH = ("site", "asset_seq", "source_ord", "pos", "name", "version", "category", "evidence", "url")


def tech_show(rows):
    return flat(rows.select(*TECH))


_HEADER_ROWS = """(SELECT site, base_url, asset_seq, is_main, url, content, lower(k) AS header,
    json_extract_string(headers_json, '$."' || k || '"') AS hv
  FROM (SELECT *, unnest(json_keys(headers_json)) AS k FROM assets WHERE headers_json <> '{}'))"""
_HEADER_RULES = f"(VALUES {values((h, i, t, x) for i, (h, t, x) in enumerate(tr.HEADER_RULES))}) AS hr(header, rule_ord, tech, category)"
_PARTS = f"""(SELECT *, trim(split_part(part, '/', 1)) AS pname,
    CASE WHEN contains(part, '/') THEN trim(substr(part, strpos(part, '/') + 1)) ELSE '' END AS pversion
  FROM (SELECT * EXCLUDE (ps), trim(unnest(ps)) AS part, generate_subscripts(ps, 1) - 1 AS part_idx FROM (
    SELECT *, string_split_regex(hv, '[,;]') AS ps FROM {_HEADER_ROWS} JOIN {_HEADER_RULES} USING (header)
    WHERE tech = '')) WHERE part <> '')"""
TECH_SQL = {
    "tech_headers": f"""SELECT site, asset_seq, 0::BIGINT AS source_ord, (rule_ord * 1000)::BIGINT AS pos, tech AS name, '' AS version, category,
        header || ': ' || hv AS evidence, url FROM {_HEADER_ROWS} JOIN {_HEADER_RULES} USING (header) WHERE tech <> ''
      UNION ALL SELECT site, asset_seq, 0, (rule_ord * 1000 + part_idx)::BIGINT, pname, pversion, category, header || ' header', url
      FROM {_PARTS} WHERE pname <> ''""",
    "tech_cookies": f"""SELECT site, asset_seq, 1::BIGINT AS source_ord, ord::BIGINT AS pos, name, '' AS version, category,
        'cookie fingerprint' AS evidence, url FROM {_HEADER_ROWS} h
      JOIN (VALUES {values((i, p, n, x) for i, (p, n, x) in enumerate(tr.COOKIE_RULES))}) AS cr(ord, pattern, name, category)
      ON header = 'set-cookie' AND regexp_matches(hv, pattern)""",
    "tech_filename": f"""SELECT site, asset_seq, 3::BIGINT AS source_ord, 0::BIGINT AS pos,
        array_to_string(list_transform(regexp_extract_all(nm, '[a-zA-Z]+|[^a-zA-Z]+'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') AS name,
        regexp_replace(v, '[.]min$', '') AS version, 'library' AS category, 'filename version' AS evidence, url
      FROM (SELECT *, regexp_extract(url, {rp(tr.FILENAME_VERSION)}, 1) AS v,
          trim(replace(regexp_extract(regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1), '^(.*?)(?:[-.@][0-9]|$)', 1), '.min', ''), '-_.') AS nm
        FROM assets) WHERE v <> '' AND length(nm) > 2""",
}
_CONTENT = " UNION ALL ".join(
    f"SELECT site, asset_seq, {i} AS pos, {s(n)} AS rname, {s(x)} AS category, {s(e)} AS evidence, url, "
    + (f"trim(regexp_extract(content, {rp(p)}, {g}))" if g else "''") + " AS found"
    + f" FROM assets WHERE regexp_matches(content, {rp(p)})"
    for i, (n, x, g, e, p, _h) in enumerate(tr.CONTENT_RULES))
_SPLIT = rp(tr.GENERATOR_SPLIT)
TECH_SQL["tech_content"] = f"""SELECT site, asset_seq, 2::BIGINT AS source_ord, pos::BIGINT AS pos,
    CASE WHEN rname <> 'Generator' THEN rname WHEN regexp_matches(found, {_SPLIT}) THEN trim(regexp_extract(found, {_SPLIT}, 1))
      ELSE split_part(found, ' ', 1) END AS name,
    CASE WHEN rname <> 'Generator' THEN found WHEN regexp_matches(found, {_SPLIT}) THEN regexp_extract(found, {_SPLIT}, 2) ELSE '' END AS version,
    category, evidence, url FROM ({_CONTENT})"""


def _wp(i: int, kind: str, pattern: str) -> str:
    from .base import positions

    rows = positions("assets", "content", pattern, r"\0|\1", "length(f[1])", "site, asset_seq, url, content")
    return f"""SELECT site, asset_seq, {5 + i}::BIGINT AS source_ord, start::BIGINT AS pos, 'WordPress {kind}: ' || f[2] AS name,
      regexp_extract(substr(content, (start + 1)::BIGINT, (length(f[1]) + 60)::BIGINT), {rp(tr.ASSET_VERSION)}, 1) AS version,
      'wordpress-{kind}' AS category, 'asset path' AS evidence, url FROM {rows}"""


TECH_SQL["wordpress_extensions"] = " UNION ALL ".join(_wp(i, k, p) for i, (k, p) in enumerate(tr.WP_EXTENSIONS))


def _banner() -> str:
    from .base import positions

    rows = positions("(SELECT * FROM assets WHERE kind IN ('js', 'css', 'html'))", "content", tr.BANNER,
                     r"\0|\1|\2", "length(f[1])", "site, asset_seq, url")
    return f"""SELECT site, asset_seq, 4::BIGINT AS source_ord, start::BIGINT AS pos, f[2] AS name, f[3] AS version, 'library' AS category,
      'bundle banner' AS evidence, url FROM {rows} WHERE lower(f[2]) NOT IN {in_list(tr.BANNER_NOT)}"""


TECH_SQL["tech_banners"] = _banner()
_NEXT_PATTERN = r"(<script[^>]+id=\"__NEXT_DATA__\"[^>]*>)([\s\S]*?)(</script>)"
_PAYLOADS = positions(
    "(SELECT site, asset_seq, content FROM assets WHERE contains(content, '__NEXT_DATA__'))", "content", _NEXT_PATTERN,
    r"\1|\2|\3", "length(f[1]) + length(f[2]) + length(f[3])", "site, asset_seq, content")
_NEXT_ROWS = f"""(SELECT a.*, p.at0, p.j FROM assets a JOIN (
    SELECT site, asset_seq, start + length(f[1]) AS at0, f[2] AS j FROM {_PAYLOADS}) p USING (site, asset_seq)
  WHERE json_valid(j) AND json_type(j) = 'OBJECT')"""
TECH_SQL["next_build"] = f"""SELECT site, asset_seq, 7::BIGINT AS source_ord, at0::BIGINT AS pos, 'Next.js' AS name, '' AS version,
  'framework' AS category, 'buildId ' || json_extract_string(j, '$.buildId') AS evidence, url FROM {_NEXT_ROWS}
  WHERE json_extract_string(j, '$.buildId') <> ''"""

for _name, _build in (
    ("tech_headers", tc.tech_headers), ("tech_cookies", tc.tech_cookies),
    ("tech_content", tc.tech_content), ("tech_filename", tc.tech_filename),
    ("tech_banners", tc.tech_banners), ("wordpress_extensions", tc.wordpress_extensions),
    ("next_build", tc.next_data_technologies),
):
    @query(_name, SCAN + " " + TECH_SQL[_name])
    def _(c: Corpus, build=_build):
        return tech_show(build(c.scan.assets))


_DOC = ("1::BIGINT AS line, 1::BIGINT AS col, " + snippet("content", "0", "0") + " AS snippet")


@finding_query("version_disclosures", _finding(
    f"(SELECT * FROM {_PARTS} WHERE pversion <> '')", 0, EXPO, "'Server software version disclosed'", "'LOW'",
    "'CONFIRMED'", "header || ': ' || part",
    "'The `' || header || '` header tells the exact version, and with it the published weaknesses.'", _DOC, region="0", pos="part_idx"))
def _(c: Corpus):
    return show(tc.version_disclosures(c.scan.assets))


_ENV_RX = rp(tr.ENV_KEY)
ENV_SQL = f"""env_nodes(site, asset_seq, at0, key, val, parent_env, depth) AS (
  SELECT site, asset_seq, at0, '', j::JSON, false, 0 FROM {_NEXT_ROWS}
  UNION ALL
  SELECT n.site, n.asset_seq, n.at0, coalesce(k.key, ''), k.value, NOT regexp_matches(n.key, {_ENV_RX})
      AND lower(n.key) IN {in_list(tr.ENV_OBJECTS)} AND json_type(n.val) = 'OBJECT', n.depth + 1
  FROM env_nodes n, json_each(n.val) AS k
  WHERE json_type(n.val) IN ('OBJECT', 'ARRAY')),
env_keys AS (
  SELECT site, asset_seq, at0, key FROM env_nodes WHERE depth >= 1 AND regexp_matches(key, {_ENV_RX})
  UNION ALL SELECT site, asset_seq, at0, key FROM env_nodes WHERE parent_env AND depth >= 2),
"""
_RSCAN = SCAN_TOKENS.replace("WITH ", "WITH RECURSIVE ", 1)


@query("collect_env_keys", _RSCAN + ", " + ENV_SQL.rstrip().rstrip(",")
       + " SELECT site, asset_seq, key, count(*) AS n FROM env_keys GROUP BY ALL")
def _(c: Corpus):
    rows = tc._next_data(c.scan.assets)
    keys = tc.collect_env_keys(rows, ("site", "asset_seq", "pos"))
    return keys.groupBy("site", "asset_seq", "key").agg(F.count("*").alias("n"))


_NEXT_SPOT = _spot("at0", "at0 + 200")
_NEXT_FINDINGS = _finding(
    f"""(SELECT * FROM {_NEXT_ROWS} WHERE json_extract(j, '$.runtimeConfig.serverRuntimeConfig') IS NOT NULL
        AND CAST(json_extract(j, '$.runtimeConfig.serverRuntimeConfig') AS VARCHAR) NOT IN ('{{}}', '[]', 'null', '""', '0', 'false'))""",
    0, EXPO, "'Next.js serverRuntimeConfig exposed to the browser'", "'HIGH'", "'CONFIRMED'",
    "CAST(json_extract(j, '$.runtimeConfig.serverRuntimeConfig') AS VARCHAR)",
    "'The page''s data holds settings that only the server should see.'", _NEXT_SPOT, rule_ord="100", region="0", pos="at0",
) + " UNION ALL " + _finding(
    f"""(SELECT n.*, k.listing, k.total FROM {_NEXT_ROWS} n JOIN (SELECT site, asset_seq, at0,
        array_to_string(list_sort(list(key)), ', ') AS listing, count(*) AS total FROM env_keys GROUP BY site, asset_seq, at0) k
        USING (site, asset_seq, at0))""",
    0, EXPO, "'Environment variables embedded in __NEXT_DATA__'", "'MEDIUM'", "'CONFIRMED'", "listing",
    "total || ' environment variable(s) are part of the page''s data, for every visitor to read.'",
    _NEXT_SPOT, rule_ord="101", region="0", pos="at0")
FINDING_SQL["next_data"] = _NEXT_FINDINGS


@query("next_data", _RSCAN + ", " + ENV_SQL.rstrip().rstrip(",") + " " + _NEXT_FINDINGS)
def _(c: Corpus):
    return show(tc.next_data_findings(c.scan.assets))


SERVICES_SQL = f"""SELECT site, name, arg_min(host, struct_pack(a := asset_seq, b := ord)) AS host,
    arg_min(category, struct_pack(a := asset_seq, b := ord)) AS category
  FROM assets JOIN (VALUES {values((i, h, n, x) for i, (h, n, x) in enumerate(tr.SERVICE_HOSTS))}) AS sh(ord, host, name, category)
  ON contains(content, host) GROUP BY site, name"""


@query("services", SCAN + " " + SERVICES_SQL)
def _(c: Corpus):
    return tc.services(c.scan.assets).select("site", "name", "host", "category")


MENTIONED = " UNION ALL ".join(TECH_SQL.values())
_ORD = "struct_pack(a := asset_seq, b := source_ord, c := pos)"
MERGED_SQL = f"""SELECT site, lower(name) AS name_key,
    coalesce(arg_min(name, {_ORD}) FILTER (WHERE regexp_matches(name, '^\\p{{Lu}}')), arg_min(name, {_ORD})) AS name,
    arg_min(category, {_ORD}) AS category,
    coalesce(arg_min(version, {_ORD}) FILTER (WHERE version <> ''), '') AS version,
    coalesce(arg_min(evidence, {_ORD}) FILTER (WHERE version <> ''), arg_min(evidence, {_ORD})) AS evidence,
    coalesce(arg_min(url, {_ORD}) FILTER (WHERE version <> ''), arg_min(url, {_ORD})) AS source
  FROM ({MENTIONED}) WHERE name <> '' GROUP BY site, lower(name)"""


@query("merge_technologies", SCAN + " " + MERGED_SQL)
def _(c: Corpus):
    return c.scan_of("technology").technologies


_MAINS = f"(SELECT site, asset_seq, url, content, {snippet('content', '0', '0')} AS head FROM assets WHERE is_main)"
_AT = "1::BIGINT AS line, 1::BIGINT AS col, head AS snippet"
_VER = ("struct_pack(a := coalesce(try_cast(nullif(regexp_extract({v}, '^(\\d+)', 1), '') AS INT), 0), "
        "b := coalesce(try_cast(nullif(regexp_extract({v}, '^\\d+\\.(\\d+)', 1), '') AS INT), 0), "
        "c := coalesce(try_cast(nullif(regexp_extract({v}, '^\\d+\\.\\d+\\.(\\d+)', 1), '') AS INT), 0))")


@finding_query("outdated_components", _finding(
    f"""(SELECT t.site, m.asset_seq, m.url, m.head, r.* , t.version FROM ({MERGED_SQL}) t
      JOIN (VALUES {values((n, i, mn, sv, d) for i, (n, mn, sv, d) in enumerate(tr.OUTDATED))}) AS r(rname, rule_ord, minimum, sev, rdetail)
        ON lower(rname) = name_key JOIN {_MAINS} m ON m.site = t.site
      WHERE regexp_matches(t.version, '^[0-9]') AND {_VER.format(v="t.version")} < {_VER.format(v="minimum")})""",
    8, VULN, "'Outdated component: ' || rname || ' ' || version", "sev", "'FIRM'", "rname || ' ' || version", "rdetail",
    _AT, region="0", pos="0"), SCAN)
def _(c: Corpus):
    return show(tc.outdated_components(c.scan_of("technology").technologies, main_documents(c.scan.assets)))


_WORDPRESS = f"""SELECT site, split_part(category, '-', 2) AS k, regexp_replace(name, '^[^:]*: ', '') AS slug, version
  FROM ({MERGED_SQL}) WHERE category IN ('wordpress-plugin', 'wordpress-theme')"""


@query("wordpress_names", SCAN + f" SELECT site, k AS wp_kind, slug, version FROM ({_WORDPRESS})")
def _(c: Corpus):
    return tc.wordpress_names(c.scan_of("technology").technologies)


@finding_query("wordpress_summary", _finding(
    f"""(SELECT w.*, m.asset_seq, m.url, m.head FROM (
      SELECT site, k, count(*) AS n, count(*) FILTER (WHERE version <> '') AS v,
        array_to_string(list_transform(list_sort(list(struct_pack(s := slug, v := version)))[1:{tr.WP_SHOWN}],
          lambda e: e.s || CASE WHEN e.v <> '' THEN ' ' || e.v ELSE '' END), ', ') AS listing
      FROM ({_WORDPRESS}) GROUP BY 1, 2) w
      JOIN {_MAINS} m USING (site))""",
    8, EXPO, "'WordPress ' || k || 's enumerated'", "CASE WHEN v > 0 THEN 'MEDIUM' ELSE 'LOW' END", "'CONFIRMED'", "listing",
    "n || ' ' || k || '(s) show in the addresses of files' || CASE WHEN v > 0 THEN ', ' || v || ' with their "
    "version' ELSE '' END || '. Old extensions are a common way into such sites.'", _AT,
    rule_ord="CASE WHEN k = 'plugin' THEN 50 ELSE 51 END", region="0", pos="0"), SCAN)
def _(c: Corpus):
    return show(tc.wordpress_summary(c.scan_of("technology").technologies, main_documents(c.scan.assets)))


@query("manifest_candidates", SCAN + f"""
SELECT DISTINCT site, url_nofrag FROM (
  SELECT t.site, regexp_extract(m.base_url, '^[a-z]+://[^/?#]*') || mp.path AS url_nofrag FROM ({MERGED_SQL}) t
    JOIN (VALUES {values(er.MANIFEST_PATHS)}) AS mp(tech, path) ON mp.tech = t.name
    JOIN assets m ON m.site = t.site AND m.is_main
  UNION ALL
  SELECT site, regexp_extract(base_url, '^[a-z]+://[^/?#]*') || '/_next/static/' || b || '/' || f FROM (
    SELECT *, regexp_extract(content, {rp(er.NEXT_BUILD_ID)}, 1) AS b, unnest({list(er.BUILD_MANIFESTS)}) AS f
    FROM assets WHERE is_main) WHERE b <> '') w
WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.site = w.site AND split_part(a.url, '#', 1) = w.url_nofrag)""")
def _(c: Corpus):
    return lk.manifest_candidates(c.scan.assets, c.scan_of("technology").technologies)


# ---- headers ---------------------------------------------------------------------------


def _h(name: str) -> str:
    return (f"coalesce((SELECT max(x.hv) FROM {_HEADER_ROWS} x WHERE x.site = d.site AND x.asset_seq = d.asset_seq "
            f"AND x.header = '{name}'), '')")


_DOCS = f"""(SELECT d.*, {_h('content-security-policy')} AS csp, {_h('access-control-allow-origin')} AS acao,
  lower({_h('access-control-allow-credentials')}) AS acac, {_h('set-cookie')} AS cookies
  FROM assets d WHERE is_main AND headers_json <> '{{}}')"""


@finding_query("missing_headers", _finding(
    f"""(SELECT d.*, e.* FROM {_DOCS} d, (VALUES {values((i, n, v, t) for i, (n, v, t, _f) in enumerate(tr.EXPECTED_HEADERS))})
         AS e(rule_ord, name, sev, txt)
       WHERE NOT EXISTS (SELECT 1 FROM {_HEADER_ROWS} x WHERE x.site = d.site AND x.asset_seq = d.asset_seq AND x.header = e.name)
         AND NOT (e.name = 'x-frame-options' AND contains(csp, 'frame-ancestors')))""",
    7, HEAD, "'Missing security header: ' || name", "sev", "'CONFIRMED'", "name", "txt", _DOC, region="0", pos="0"), SCAN)
def _(c: Corpus):
    return show(hd.missing_headers(c.scan.assets))


_PROBLEMS = (
    "list_filter([CASE WHEN contains(csp, '''unsafe-inline''') THEN '`''unsafe-inline''` lets injected inline scripts run' END, CASE WHEN contains(csp, '''unsafe-eval''') THEN '`''unsafe-eval''` lets text run as code' END, "
    "CASE WHEN regexp_matches(csp, '(?:script-src|default-src)[^;]*[*](?:[^.]|$)') THEN 'scripts may come from a wildcard "
    "source' END, CASE WHEN contains(csp, 'data:') AND contains(csp, 'script-src') THEN 'scripts may come from `data:` "
    "addresses' END], lambda p: p IS NOT NULL)"
)


@finding_query("csp_quality", _finding(
    f"(SELECT *, {_PROBLEMS} AS problems FROM {_DOCS} WHERE len({_PROBLEMS}) > 0)", 7, HEAD,
    "'Weak Content-Security-Policy'", "'MEDIUM'", "'CONFIRMED'", "csp",
    "'The policy leaves gaps: ' || array_to_string(problems, '; ') || '.'", _DOC, rule_ord="10", region="0",
    pos="0"), SCAN)
def _(c: Corpus):
    return show(hd.csp_quality(c.scan.assets))


@finding_query("cors_headers", _finding(
    f"(SELECT * FROM {_DOCS} WHERE trim(acao) = '*')", 7, HEAD,
    "CASE WHEN acac = 'true' THEN 'Dangerous CORS configuration' ELSE 'Wildcard CORS origin' END",
    "CASE WHEN acac = 'true' THEN 'HIGH' ELSE 'LOW' END", "'CONFIRMED'",
    "CASE WHEN acac = 'true' THEN acao || ' / credentials: ' || acac ELSE acao END",
    "CASE WHEN acac = 'true' THEN 'Every origin is allowed, and credentials with it.' "
    "ELSE 'Scripts of every site can read this answer.' END", _DOC, rule_ord="20", region="0", pos="0"), SCAN)
def _(c: Corpus):
    return show(hd.cors_headers(c.scan.assets))


_COOKIES = f"""(SELECT *, list_filter([CASE WHEN NOT contains(lower(cookie), 'httponly') THEN 'HttpOnly' END,
    CASE WHEN NOT contains(lower(cookie), 'secure') THEN 'Secure' END,
    CASE WHEN NOT contains(lower(cookie), 'samesite') THEN 'SameSite' END], lambda m: m IS NOT NULL) AS missing,
    trim(split_part(cookie, '=', 1)) AS cname
  FROM (SELECT * EXCLUDE (cs), unnest(cs) AS cookie, generate_subscripts(cs, 1) - 1 AS ci FROM (
    SELECT *, string_split(regexp_replace(cookies, ',(\\s*[A-Za-z0-9_-]+=)', chr(1) || '\\1', 'g'), chr(1)) AS cs
    FROM {_DOCS} WHERE cookies <> '')))"""


@finding_query("cookie_flags", _finding(
    f"(SELECT * FROM {_COOKIES} WHERE len(missing) > 0)", 7, HEAD,
    "'Cookie `' || cname || '` missing ' || array_to_string(missing, '/')",
    "CASE WHEN regexp_matches(cname, '(?i)sess|auth|token|jwt|login|remember|sid') THEN 'MEDIUM' ELSE 'LOW' END",
    "'CONFIRMED'", "cookie",
    "'Attributes that this cookie lacks: ' || array_to_string(missing, ', ') || '.' || CASE WHEN "
    "regexp_matches(cname, '(?i)sess|auth|token|jwt|login|remember|sid') AND list_contains(missing, 'HttpOnly') THEN "
    "' By its name it carries a session, which scripts can read.' ELSE '' END", _DOC, rule_ord="30 + ci",
    region="0", pos="0"), SCAN)
def _(c: Corpus):
    return show(hd.cookie_flags(c.scan.assets))


# ---- exposure --------------------------------------------------------------------------

_NO_SPOT = "0::BIGINT AS line, 0::BIGINT AS col, '' AS snippet"
_MAPS = """(SELECT *, len(CAST(json_extract(content, '$.sources') AS VARCHAR[])) AS n,
    coalesce(len(CAST(json_extract(content, '$.sourcesContent') AS VARCHAR[])), 0) AS embedded
  FROM admitted WHERE kind = 'map' AND json_valid(content))"""


@finding_query("sourcemap_exposure", _finding(
    _MAPS, 8, EXPO, "'Source map published'", "CASE WHEN embedded > 0 THEN 'MEDIUM' ELSE 'LOW' END", "'CONFIRMED'", "url",
    "CASE WHEN embedded > 0 THEN 'Anyone can fetch this source map; it holds the text of ' || n || ' original file(s), with their comments and paths.' ELSE 'Anyone can fetch this source map; it names ' || n || ' original file(s).' END", _NO_SPOT, rule_ord="200", region="0", pos="0"), SCAN)
def _(c: Corpus):
    return show(ex.sourcemap_exposure(c.assets))


@query("sourcemap_sources", SCAN + """
SELECT site, asset_seq, url, content FROM assets WHERE ends_with(url, ' (original sources)')""")
def _(c: Corpus):
    return ex.sourcemap_sources(c.assets).select("site", "asset_seq", "url", "content")


_HEADTXT = "lower(ltrim(content, chr(32) || chr(9) || chr(10) || chr(13)))"
_REAL = f"""(content = '' OR NOT (
    (regexp_matches({_HEADTXT}, '^(<!doctype html|<html)') AND p NOT IN ('/robots.txt', '/sitemap.xml'))
    OR (ends_with(p, '.json') AND NOT regexp_matches({_HEADTXT}, '^[{{\\[]'))
    OR (p = '/.git/config' AND NOT contains(lower(content), '[core]'))
    OR (p = '/.git/HEAD' AND NOT starts_with(lower(content), 'ref:'))
    OR (starts_with(p, '/.env') AND NOT contains(content, '='))))"""


@finding_query("exposed_paths", _finding(
    f"""(SELECT c.*, sp.* FROM (SELECT *, {path("url")} AS p FROM captures WHERE status = 200) c
      JOIN (VALUES {values((p, i, t, v) for i, (p, t, v) in enumerate(tr.SENSITIVE_PATHS))}) AS sp(spath, ord, stitle, sev)
      ON c.p = sp.spath WHERE {host("url")} = {host("base_url")} AND {_REAL})""",
    8, EXPO, "stitle", "sev", "'CONFIRMED'", "url", "'`' || p || '` answers with status 200 to anyone.'",
    "0::BIGINT AS line, 0::BIGINT AS col, trim(left(content, 160)) AS snippet", rule_ord="ord + 300", region="0", pos="0"), SCAN)
def _(c: Corpus):
    return show(ex.exposed_paths(c.captures))


@query("looks_like_real_file", ASSETS + f"""
SELECT site, asset_seq, {_REAL} AS real FROM (SELECT *, {path("url")} AS p FROM captures)""")
def _(c: Corpus):
    from ..functions.urls import path_of

    real = ex.looks_like_real_file(path_of(F.col("url")), F.col("content"))
    return c.captures.select("site", "asset_seq", real.alias("real"))
