"""Value predicates: placeholders, entropy, prose, routes, tokens. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column

from .sqlexpr import F
from ..rules import words as W
from .text import let, rx, strip

_LETTER = r"\p{L}"
#: a unit of 1 to 4 characters, four times or more
_LOW_VARIETY = r"^(.{1,4}?)\1{3,}$"
_SENTENCE = _LETTER + r"{2,}\s+" + _LETTER + r"{2,}\s+" + _LETTER + r"{2,}"
_WORDY = r"^" + _LETTER + r"+(?:[\s_\-]" + _LETTER + r"+)*+$"
_WORD_RUN = _LETTER + r"{2,}(?:[\s'’]" + _LETTER + r"{2,}){2,}"


def _word_list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def is_placeholder(value: Column, key: Column | None = None) -> Column:
    """True when the value is an example or template rather than a live secret."""

    def check(s: Column) -> Column:
        lowered = F.lower(s)
        out = (s == "") | lowered.isin(*W.PLACEHOLDER_VALUES)
        if key is not None:
            norm_key = F.regexp_replace(F.lower(F.coalesce(key, F.lit(""))), "[^a-z0-9]", "")
            norm_value = F.regexp_replace(lowered, "[^a-z0-9]", "")
            out = out | ((norm_key != "") & (norm_key == norm_value))
        out = out | s.rlike(rx(_LOW_VARIETY))
        for shape in W.PLACEHOLDER_SHAPES:
            hit = s.rlike(rx(shape))
            part = W.SHAPE_PARTS.get(shape)
            out = out | (hit if part is None else s.contains(part) & hit)
        return out

    return let(strip(F.coalesce(value, F.lit(""))), check)


def shannon_entropy(value: Column) -> Column:
    """Bits per character."""

    def bits(v: Column) -> Column:
        n = F.length(v).cast("double")
        chars = F.array_distinct(F.split(v, ""))
        return F.aggregate(
            F.filter(chars, lambda c: c != ""),
            F.lit(0.0),
            lambda acc, c: let(
                (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / n,
                lambda p: acc - p * F.log2(p),
            ),
        )

    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit(0.0)).otherwise(bits(value))


def charset_classes(value: Column) -> Column:
    out = F.lit(0)
    for pattern in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"):
        out = out + value.rlike(rx(pattern)).cast("int")
    return out


def is_human_text(value: Column) -> Column:
    """True for a phrase: a UI string or an i18n message."""

    def check(s: Column) -> Column:
        words = F.regexp_extract_all(s, F.lit(rx(_LETTER + "{2,}")), F.lit(0))
        common = F.exists(words, lambda w: F.lower(w).isin(*W.COMMON_WORDS))
        return s.contains(" ") & (s.rlike(rx(_WORD_RUN)) | ((F.size(words) >= 2) & common))

    return let(strip(value), check)


def is_mime_type(value: Column) -> Column:
    return strip(value).rlike(rx(W.MIME_LIKE))


def is_route_like(value: Column) -> Column:
    s = strip(value)
    return s.contains("/") & (s.rlike(rx(W.MIME_LIKE)) | s.rlike(rx(W.ROUTE_LIKE)))


def looks_random(value: Column, min_length: int = 12, min_entropy: float = 3.0) -> Column:
    """True for what reads like generated key material."""

    def check(s: Column) -> Column:
        return (
            (F.length(s) >= min_length)
            & ~s.rlike(rx(_SENTENCE))
            & ~is_human_text(s)
            & ~(s.rlike(rx(_WORDY)) & (F.length(s) < 32))
            & ~is_route_like(s)
            & (charset_classes(s) >= 2)
            & (shannon_entropy(s) >= min_entropy)
        )

    return let(strip(value), check)


def contains_html(text: Column) -> Column:
    return text.contains("<") & (text.rlike(rx(W.HTML_TAG)) | text.rlike(rx(W.JSX_TAG)))


def looks_like_prose(text: Column, max_word_ratio: float = 0.7) -> Column:
    words = F.regexp_extract_all(text, F.lit("[A-Za-z']{2,}"), F.lit(0))
    symbols = F.regexp_count(text, F.lit(r"[{}();=\[\]<>|&$]"))

    def check(ws: Column) -> Column:
        common = F.size(F.filter(ws, lambda w: F.lower(w).isin(*W.COMMON_WORDS)))
        ratio = common / F.size(ws)
        return (F.size(ws) >= 5) & (
            text.rlike(rx(W.HTML_ENTITY)) | ((ratio >= max_word_ratio) & (symbols <= 2))
        )

    return let(words, check)


def is_vendor_bundle(url: Column) -> Column:
    return url.rlike(rx(W.VENDOR_URL))


def is_minified(source: Column) -> Column:
    n = F.length(source)
    newlines = n - F.length(F.replace(source, F.lit("\n"), F.lit("")))
    return F.when(n == 0, F.lit(False)).when(newlines == 0, n > 500).otherwise(
        n / (newlines + 1) > 300
    )


def is_hash_like(value: Column) -> Column:
    return value.rlike(rx("^[0-9a-fA-F]+$")) & F.length(value).isin(*W.HASH_LENGTHS)


def looks_like_html(content: Column) -> Column:
    return content.rlike(rx(W.HTML_DOCUMENT))


def _b64url_text(segment: Column) -> Column:
    """Text of a base64url segment, null when it is not base64."""
    binary = F.try_to_binary(F.translate(segment, "-_", "+/"), F.lit("base64"))
    return F.make_valid_utf8(binary.cast("string"))


def jwt_part(token: Column, index: int) -> Column:
    """Header (0) or payload (1) of a token as a map of JSON text, null when it is no object."""
    text = _b64url_text(F.get(F.split(token, r"\."), F.lit(index)))
    return F.when(
        strip(text).startswith("{"), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    )


def is_jwt(token: Column) -> Column:
    header, payload = jwt_part(token, 0), jwt_part(token, 1)
    return F.coalesce(
        (F.map_contains_key(header, "alg") | F.map_contains_key(header, "typ"))
        & payload.isNotNull(),
        F.lit(False),
    )


def base64_json(value: Column) -> Column:
    text = strip(_b64url_text(value))
    return F.coalesce(text.startswith("{") | text.startswith("["), F.lit(False))


def is_benign_ip(value: Column) -> Column:
    from ..rules.vulns import BENIGN_IP

    return strip(value).rlike(rx(BENIGN_IP))


def is_real_role(value: Column) -> Column:
    """A role name rather than an ARIA role, UI word, path, number or markup."""
    from ..rules import access as A

    lowered = F.lower(strip(value))
    return (
        (lowered != "")
        & (F.length(lowered) <= 48)
        & ~lowered.isin(*A.ROLE_DENYLIST)
        & ~value.rlike(rx(A.PERMISSION_DENY))
        & ~lowered.rlike(rx(r"^[\d.]+$"))
        & ~value.rlike(rx(A.ROLE_MARKUP))
    )


def parse_version(version: Column) -> Column:
    """``a[.b[.c]]`` at the start as a struct of ints, null when there is none."""
    def number(group: int) -> Column:
        part = F.regexp_extract(s, r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?", group)
        return F.when(part == "", F.lit(0)).otherwise(part.cast("decimal(38,0)"))

    s = strip(version)
    return F.when(
        s.rlike(r"^\d"),
        F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")),
    )
