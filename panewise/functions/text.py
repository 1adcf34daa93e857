"""Text expressions: positional regex matching, line and column, snippets, escapes.

Spark's regex functions return text, not positions. ``marked`` wraps every match in
characters no text may hold, in one pass of ``regexp_replace``; splitting on them gives the
matches, their groups and the gaps between, and running sums of the lengths give the
offsets. Everything stays a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame

from .sqlexpr import F

# Noncharacters: permanently reserved code points that interchanged text never carries.
OPEN, CLOSE, FIELD = "\ufdd0", "\ufdd1", "\ufdd2"
_MARKS = (OPEN, CLOSE, FIELD)

#: What str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def rx(pattern: str) -> str:
    """Unicode classes, and only ``\\n`` as a line end for ``.`` and ``$``."""
    return "(?dU)" + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once.

    A filter on a plain computed column is pushed below the projection and the expression runs
    again there; the output of a generator is an attribute, so nothing is pushed through it.
    """
    for name in columns:
        if name in df.columns:
            df = df.drop(name)
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def exploded(df: DataFrame, keep: Sequence, array: Column, *names: str) -> DataFrame:
    """Keep columns plus one row per array element, with position when two names are given.

    An inner explode makes Spark test the array's size in a filter first, which evaluates the
    array twice; the outer form does not, and the empty rows it adds are dropped here.
    """
    if len(names) == 2:
        out = df.select(*keep, F.posexplode_outer(array).alias(*names))
    else:
        out = df.select(*keep, F.explode_outer(array).alias(*names))
    return out.where(F.col(names[-1]).isNotNull())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        hit = text.contains(needle)
        out = hit if out is None or needle == needles[0] else out | hit
    return out


def held_signs(text: Column, signs: Iterable[str]) -> Column:
    """Which of some characters a text holds, for ``holds_sign``."""
    return F.struct(*[text.contains(sign).alias(f"s{ord(sign)}") for sign in sorted(set(signs))])


def holds_sign(held: Column, signs: str) -> Column:
    """Whether a text holds one of the characters."""
    out = F.lit(False)
    for sign in signs:
        out = out | held[f"s{ord(sign)}"]
    return out


def clean_marks(text: Column) -> Column:
    """Swap the reserved marks for U+FFFD, so lengths stay; nearly always a no-op."""
    return F.when(
        contains_any(text, _MARKS), F.translate(text, "".join(_MARKS), "\ufffd" * len(_MARKS))
    ).otherwise(text)


def marked(text: Column, pattern: str, emit: Sequence[str]) -> Column:
    """Replace each match of ``pattern`` by OPEN emit[0] FIELD emit[1] ... CLOSE."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(OPEN + FIELD.join(emit) + CLOSE))


def pieces_of(marked_text: Column) -> Column:
    return F.split(marked_text, OPEN)


def fields_of(piece: Column) -> Column:
    return F.split(F.substring_index(piece, CLOSE, 1), FIELD)


def gap_length(piece: Column) -> Column:
    """Length of the unmatched text that follows a match."""
    return F.length(piece) - F.length(F.substring_index(piece, CLOSE, 1)) - 1


def prefix_sums(sizes: Column, block: int = 64, of: str = "int") -> Column:
    """Exclusive running sums of an array of ints (or of another type).

    Appending to one array is quadratic, so sums run inside blocks of 64 and over the
    block totals; a bundle with 100,000 tokens stays cheap.
    """

    def scan(values: Column) -> Column:
        return F.aggregate(
            values,
            F.array(F.lit(0).cast(of) if of != "int" else F.lit(0)),
            lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)),
        )

    def blocked(values: Column) -> Column:
        count = F.ceil(F.size(values) / F.lit(block)).cast("int")
        scans = F.transform(
            F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
            lambda b: scan(F.slice(values, b * block + 1, F.lit(block))),
        )
        return let(
            scans,
            lambda ss: let(
                scan(F.transform(ss, lambda s: F.element_at(s, -1))),
                lambda base: F.flatten(
                    F.transform(
                        ss,
                        lambda s, b: F.transform(
                            F.slice(s, F.lit(1), F.size(s) - 1),
                            lambda v: v + F.element_at(base, b + 1),
                        ),
                    )
                ),
            ),
        )

    return let(sizes, lambda v: F.when(F.size(v) <= block, scan(v)).otherwise(blocked(v)))


def matches(
    marked_text: Column,
    length_of: Callable[[Column], Column],
    build: Callable[[Column, Column], Column],
) -> Column:
    """Array of ``build(start, fields)``; ``length_of(fields)`` is a match's source length."""

    def from_pieces(ps: Column) -> Column:
        sizes = F.transform(
            ps,
            lambda p, i: F.when(i == 0, F.length(p)).otherwise(
                length_of(fields_of(p)) + gap_length(p)
            ),
        )
        return let(
            prefix_sums(sizes),
            lambda starts: F.transform(
                F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))),
                lambda p, i: build(F.element_at(starts, i + 2), fields_of(p)),
            ),
        )

    return let(pieces_of(marked_text), from_pieces)


def line_of(content: Column, offset: Column) -> Column:
    prefix = F.substr(content, F.lit(1), offset)
    newlines = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit("")))
    return F.when(offset <= 0, F.lit(1)).otherwise(newlines + 1)


def column_of(content: Column, offset: Column) -> Column:
    prefix = F.substr(content, F.lit(1), offset)
    tail = F.substring_index(prefix, "\n", -1)
    return F.when(offset <= 0, F.lit(1)).otherwise(F.length(tail) + 1)


def make_snippet(content: Column, start: Column, end: Column, width: int = 110) -> Column:
    """A one-line excerpt centred on the match."""
    pad = F.greatest(F.lit(0), F.floor((F.lit(width) - (end - start)) / 2).cast("int"))
    left = F.greatest(F.lit(0), start - pad)
    right = F.least(F.length(content), end + pad)
    excerpt = strip(
        F.regexp_replace(F.substr(content, left + 1, right - left), rx(r"\s+"), " ")
    )
    return F.substring(
        F.concat(
            F.when(left > 0, F.lit("…")).otherwise(F.lit("")),
            excerpt,
            F.when(right < F.length(content), F.lit("…")).otherwise(F.lit("")),
        ),
        1,
        width + 40,
    )


#: Characters of one part of a text; reading at an offset costs about this much, wherever it is.
PART = 4096


def text_parts(text: Column) -> Column:
    """A text cut into parts of PART characters once, so that reading at many offsets does not
    start from its beginning each time."""
    return F.regexp_extract_all(text, F.lit("(?s).{1," + str(PART) + "}"), F.lit(0))


def text_at(parts: Column, start: Column, length: Column) -> Column:
    """``length`` characters from the offset ``start`` of a text in parts."""
    first = F.floor(start / F.lit(PART)).cast("int")
    last = F.floor((start + length) / F.lit(PART)).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(length > 0, F.substr(near, (start - first * PART + 1).cast("int"), length)).otherwise("")


def placing(text: Column) -> Column:
    """What place_of needs of a text: its parts, the line ends before each part, the offset of the
    last of them (-1 if there is none), and the text's length."""

    def ends(parts: Column) -> Column:
        counts = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
        lasts = F.transform(
            parts,
            lambda p, i: F.when(
                p.contains("\n"), i * PART + F.length(p) - F.length(F.substring_index(p, "\n", -1)) - 1
            ).otherwise(F.lit(-1)),
        )
        before = F.aggregate(
            lasts, F.array(F.lit(-1)),
            lambda seen, x: F.concat(seen, F.array(F.greatest(F.element_at(seen, -1), x))),
        )
        return F.struct(
            parts.alias("parts"), prefix_sums(counts).alias("lines"), before.alias("last"),
            F.length(text).alias("size"),
        )

    return let(text_parts(text), ends)


def place_of(placed: Column, start: Column, stop: Column, width: int = 110) -> Column:
    """Line, column and excerpt of a match: the same as line_of, column_of and make_snippet."""
    part = F.floor(start / F.lit(PART)).cast("int")
    pad = F.greatest(F.lit(0), F.floor((F.lit(width) - (stop - start)) / 2).cast("int"))
    left, right = F.greatest(F.lit(0), start - pad), F.least(placed["size"], stop + pad)

    def place(head: Column) -> Column:
        own = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
        col = F.when(own > 0, F.length(F.substring_index(head, "\n", -1)) + 1).otherwise(
            start - F.get(placed["last"], part)
        )
        excerpt = strip(F.regexp_replace(text_at(placed["parts"], left, right - left), rx(r"\s+"), " "))
        snippet = F.concat(
            F.when(left > 0, F.lit("…")).otherwise(F.lit("")), excerpt,
            F.when(right < placed["size"], F.lit("…")).otherwise(F.lit("")),
        )
        return F.struct(
            F.when(start <= 0, F.lit(1)).otherwise(F.get(placed["lines"], part) + own + 1).cast("int").alias("line"),
            F.when(start <= 0, F.lit(1)).otherwise(col).cast("int").alias("col"),
            F.substring(snippet, 1, width + 40).alias("snippet"),
        )

    return let(text_at(placed["parts"], part * PART, start - part * PART), place)


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(text, rx(r"\s+"), " ")


def redact(value: Column, keep: int = 6) -> Column:
    """First ``keep`` and last four characters of a credential."""
    s = strip(value)
    short = F.length(s) <= keep * 2 + 3
    return F.when(value.isNull() | (value == ""), F.lit("")).otherwise(
        F.when(short, s).otherwise(F.concat(F.left(s, F.lit(keep)), F.lit("…"), F.right(s, F.lit(4))))
    )


# The escape forms of a string literal, and the single-letter escapes.
_CODE_ESCAPE = r"\\u\{?([0-9a-fA-F]{1,6})\}?|\\x([0-9a-fA-F]{2})"
_LETTER_ESCAPES = {
    "n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\x0b", "0": "\x00",
}


def _code_point(hex_digits: Column, written: Column) -> Column:
    """The character of a hex code; impossible codes stay as written, halves of surrogate
    pairs become U+FFFD because a Spark string cannot hold them."""
    code = F.conv(hex_digits, 16, 10).cast("int")
    char = F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")
    return (
        F.when(code > 0x10FFFF, written)
        .when(code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .otherwise(char)
    )


def decode_escapes(body: Column) -> Column:
    """Resolve the escapes of a string literal body."""

    def codes(text: Column) -> Column:
        return let(
            pieces_of(marked(text, _CODE_ESCAPE, ["$1$2", "$0"])),
            lambda ps: F.array_join(
                F.transform(
                    ps,
                    lambda p, i: F.when(i == 0, p).otherwise(
                        F.concat(
                            let(fields_of(p), lambda f: _code_point(f[0], f[1])),
                            F.substring_index(p, CLOSE, -1),
                        )
                    ),
                ),
                "",
            ),
        )

    def letters(text: Column) -> Column:
        out = F.regexp_replace(text, r"\\([\s\S])", OPEN + "$1")
        for letter, char in _LETTER_ESCAPES.items():
            out = F.replace(out, F.lit(OPEN + letter), F.lit(char))
        return F.replace(out, F.lit(OPEN), F.lit(""))

    has_code = body.contains("\\u") | body.contains("\\x")
    return F.when(
        body.contains("\\"), letters(F.when(has_code, codes(body)).otherwise(body))
    ).otherwise(body)
