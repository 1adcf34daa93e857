"""Code regions and string literals of an asset, as array expressions and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.sqlexpr import F
from ..functions.text import (
    CLOSE, FIELD, WHITESPACE, decode_escapes, exploded, fields_of, gap_length, let, marked, matches,
    pieces_of, prefix_sums,
)

# Where code hides in a page. Groups are ours: they carry the offsets.
_SCRIPT = r"(?i)<script\b([^>]*)>([\s\S]*?)(</script\s*>)"
_TEMPLATE_TYPE = r"(?i)type\s*=\s*[\"']?text/(?:template|html|x-\w+)"
_HANDLER = r"(?i)(\son[a-z]{2,20}\s*=\s*)(?:\"([^\"]*)\"|'([^']*)')"
_JS_URI = (
    r"(?i)((?:href|src|action|formaction)\s*=\s*)"
    r"(?:\"javascript:([^\"]*)\"|'javascript:([^']*)')"
)
# The tokens of the script lexer. Unrolled and possessive, because Java's
# engine recurses on (a|b)* and overflows its stack on long literals.
TOKENS = (
    r"(//[^\n\r]*+|/\*[\s\S]*?\*/)"
    r"|(\"[^\"\\\r\n]*+(?:\\[^\n][^\"\\\r\n]*+)*+\""
    r"|'[^'\\\r\n]*+(?:\\[^\n][^'\\\r\n]*+)*+'"
    r"|`[^`\\]*+(?:\\[^\n][^`\\]*+)*+`)"
)
#: the name a literal is assigned to, searched in the 80 characters before it
_ASSIGNED_TO = r"([A-Za-z_$][\w$\-]*)\s*[\"']?\s*[:=]\s*(?:new\s+\w+\s*\(\s*)?$"


def _region(kind: str, off: Column, code: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("region_kind"), off.cast("int").alias("off"), code.alias("code")
    )


def _not_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE)) != ""


def code_region_array(kind: Column, content: Column) -> Column:
    """array<region_kind, off, code>: whole text, or the code parts of a page in page order
    per part kind."""
    scripts = F.filter(
        matches(
            marked(content, _SCRIPT, ["$1", "$2", "$3"]),
            lambda f: F.length(f[0]) + F.length(f[1]) + F.length(f[2]) + 8,
            lambda start, f: F.struct(
                f[0].alias("attrs"),
                _region("script", start + F.length(f[0]) + 8, f[1]).alias("r"),
            ),
        ),
        lambda s: _not_blank(s["r"]["code"]) & ~s["attrs"].rlike(_TEMPLATE_TYPE),
    )
    handlers = matches(
        marked(content, _HANDLER, ["$1", "$2$3"]),
        lambda f: F.length(f[0]) + F.length(f[1]) + 2,
        lambda start, f: _region("handler", start + F.length(f[0]) + 1, f[1]),
    )
    uris = matches(
        marked(content, _JS_URI, ["$1", "$2$3"]),
        lambda f: F.length(f[0]) + F.length(f[1]) + 13,
        lambda start, f: _region("uri", start + F.length(f[0]) + 12, f[1]),
    )
    empty = F.slice(F.array(_region("whole", F.lit(0), content)), 1, 0)
    lowered = F.lower(content)
    page = F.concat(
        F.when(lowered.contains("<script"), F.transform(scripts, lambda s: s["r"])).otherwise(empty),
        F.when(
            lowered.contains("on"), F.filter(handlers, lambda r: _not_blank(r["code"]))
        ).otherwise(empty),
        F.when(
            lowered.contains("javascript:"), F.filter(uris, lambda r: _not_blank(r["code"]))
        ).otherwise(empty),
    )
    return F.when(kind == "html", page).otherwise(F.array(_region("whole", F.lit(0), content)))


def token_pieces(code: Column) -> Column:
    """The text cut before each comment or literal; piece 0 is what precedes the first."""
    return pieces_of(marked(code, TOKENS, ["$1", "$2"]))


#: One number holds an offset and, in multiples of this, a depth.
_DEPTH = 1 << 40


def bracket_pairs(code: Column) -> Column:
    """map<open, close>: the offsets of each bracket or brace outside literals and comments and of the
    one of its kind that closes it. At one depth they open and close in turn, so sorting by depth
    and offset puts each pair side by side."""

    def kind(piece: Column) -> Column:
        return F.substring_index(F.substring_index(piece, CLOSE, 1), FIELD, -1)

    def sizes(ps: Column) -> Column:
        # the marks are no part of the text, and the first piece has none
        return F.transform(
            ps,
            lambda p, i: F.when(i == 0, F.length(p).cast("bigint")).otherwise(
                F.length(p) - 2 + F.when(kind(p).isin("[", "{"), F.lit(_DEPTH))
                .when(kind(p).isin("]", "}"), F.lit(-_DEPTH)).otherwise(F.lit(0))
            ),
        )

    def levels(ps: Column, sums: Column) -> Column:
        found = F.transform(
            F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))),
            lambda p, i: F.struct(
                (F.floor((F.element_at(sums, i + 2) + F.lit(_DEPTH // 2)) / F.lit(_DEPTH))
                 + F.when(kind(p).isin("[", "{"), F.lit(1)).otherwise(F.lit(0))).alias("level"),
                F.pmod(F.element_at(sums, i + 2), F.lit(_DEPTH)).cast("int").alias("start"), kind(p).alias("kind"),
            ),
        )
        return F.array_sort(F.filter(found, lambda b: b["kind"] != ""))

    def paired(ls: Column) -> Column:
        entries = F.transform(
            ls,
            lambda b, i: F.when(
                (F.get(ls, i + 1)["level"] == b["level"]) & F.concat(b["kind"], F.get(ls, i + 1)["kind"]).isin("[]", "{}"),
                F.struct(b["start"].alias("open"), F.get(ls, i + 1)["start"].alias("close")),
            ),
        )
        return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))

    pieces = pieces_of(marked(code, TOKENS + r"|([\[\]{}])", ["$1$2", "$3"]))
    return let(let(pieces, lambda ps: let(prefix_sums(sizes(ps), of="bigint"), lambda sums: levels(ps, sums))), paired)


def _written(piece: Column) -> Column:
    """A piece as it stands in the source."""
    return F.replace(F.replace(piece, F.lit(FIELD), F.lit("")), F.lit(CLOSE), F.lit(""))


def strip_comments(code: Column) -> Column:
    """Comments become spaces; newlines and every offset stay."""
    rebuilt = F.array_join(
        F.transform(
            token_pieces(code),
            lambda p, i: F.when(i == 0, p)
            .when(F.startswith(p, F.lit("/")), F.concat(
                F.regexp_replace(fields_of(p)[0], r"[^\n]", " "),
                F.substring_index(p, CLOSE, -1)))
            .otherwise(_written(p)),
        ),
        "",
    )
    return F.when(code.contains("//") | code.contains("/*"), rebuilt).otherwise(code)


def token_array(code: Column) -> Column:
    """array<start, raw, comment, before>: every comment and literal with its offset and the
    80 characters of source that precede it."""

    def build(ps: Column) -> Column:
        sizes = F.transform(
            ps,
            lambda p, i: F.when(i == 0, F.length(p)).otherwise(
                F.length(fields_of(p)[0]) + F.length(fields_of(p)[1]) + gap_length(p)
            ),
        )
        return let(
            prefix_sums(sizes),
            lambda starts: F.transform(
                F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))),
                # An assigned name never reaches past the token before the literal, so the
                # piece before it holds all the 80-character look-back can see.
                lambda p, i: F.struct(
                    F.element_at(starts, i + 2).alias("start"),
                    F.concat(fields_of(p)[0], fields_of(p)[1]).alias("raw"),
                    F.startswith(p, F.lit("/")).alias("comment"),
                    F.right(_written(F.element_at(ps, i + 1)), F.lit(80)).alias("before"),
                ),
            ),
        )

    return let(token_pieces(code), build)


def assigned_name(before: Column) -> Column:
    return F.regexp_extract(before, "(?dU)" + _ASSIGNED_TO, 1)


def preceding_identifier(source: Column, offset: Column, window: int = 80) -> Column:
    """The name the text at ``offset`` (0-based) is assigned to, or an empty string."""
    start = F.greatest(F.lit(0), offset - window)
    return assigned_name(F.substr(source, start + 1, offset - start))


def literal_body(raw: Column) -> Column:
    return F.substr(raw, F.lit(2), F.length(raw) - 2)


def code_regions(assets: DataFrame) -> DataFrame:
    """One row per code region."""
    return exploded(
        assets, ("site", "base_url", "asset_seq", "url", "kind"),
        code_region_array(F.col("kind"), F.col("content")), "region_idx", "r",
    ).select("site", "base_url", "asset_seq", "url", "kind", "region_idx", "r.*")


def _tokens(regions: DataFrame) -> DataFrame:
    return exploded(
        regions, ("site", "asset_seq", "url", "kind", "region_idx", "off"),
        token_array(F.col("code")), "t",
    ).select("site", "asset_seq", "url", "kind", "region_idx", "off", "t.*")


def string_literals(regions: DataFrame) -> DataFrame:
    """One row per string or template literal, with absolute offsets."""
    start = F.col("off") + F.col("start")
    body = literal_body(F.col("raw"))
    return _tokens(regions).where(~F.col("comment")).select(
        "site", "asset_seq", "url", "kind", "region_idx",
        start.alias("start"),
        (start + F.length("raw")).alias("end"),
        "raw",
        F.left("raw", F.lit(1)).alias("quote"),
        decode_escapes(body).alias("value"),
        (F.startswith("raw", F.lit("`")) & body.contains("${")).alias("interpolated"),
        assigned_name(F.col("before")).alias("key"),
    )


def comments(regions: DataFrame) -> DataFrame:
    """One row per comment."""
    start = F.col("off") + F.col("start")
    return _tokens(regions).where("comment").select(
        "site", "asset_seq", "url", "kind", "region_idx",
        start.alias("start"),
        (start + F.length("raw")).alias("end"),
        F.col("raw").alias("text"),
        F.startswith("raw", F.lit("/*")).alias("block"),
    )


def enclosing_region(regions: DataFrame, positions: DataFrame) -> DataFrame:
    """The first region holding each (site, asset_seq, pos): equality on the asset, range on
    the offset, so Spark hashes on the asset and never builds a cross product."""
    spans = regions.select(
        "site", "asset_seq", "region_idx", "off", (F.col("off") + F.length("code")).alias("stop")
    )
    return (
        positions.join(spans, ["site", "asset_seq"])
        .where((F.col("pos") >= F.col("off")) & (F.col("pos") < F.col("stop")))
        .groupBy("site", "asset_seq", "pos")
        .agg(F.min("region_idx").alias("region_idx"))
    )
