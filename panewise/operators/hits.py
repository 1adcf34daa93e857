"""Rule hits: one narrow pass over the text that turns assets into small match rows.

Everything that needs the text (matching, line and column, snippet, the source after a
match) happens inside one projection per asset; only hits leave it. Detectors then work on
hits, which are orders of magnitude smaller than the captures, and no body is ever shuffled
or copied per match.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from ..functions.sqlexpr import F
from ..functions.predicates import is_vendor_bundle
from ..functions.text import (
    OPEN, contains_any, decode_escapes, exploded, held_signs, holds_sign, let, marked,
    matches, place_of, placing, rx, text_at, text_parts,
)
from ..model import ASSET_KEYS
from ..rules.signs import SIGNS
from ..rules.vulns import Rule
from .regions import (
    assigned_name, bracket_pairs, code_region_array, literal_body, strip_comments, token_array,
)

HIT_FIELDS = (
    "region_idx", "rule", "pos", "start", "stop", "text", "groups", "tail", "line", "col",
    "snippet",
)


def _raw_hit(rule: Column, start: Column, text: Column, length: Column, groups: Column) -> Column:
    return F.struct(
        rule.alias("rule"), start.cast("int").alias("start"),
        (start + length).cast("int").alias("stop"), text.alias("text"), groups.alias("groups"),
    )


def _no_hits() -> Column:
    one = _raw_hit(F.lit(""), F.lit(0), F.lit(""), F.lit(0), F.array(F.lit("")))
    return F.slice(F.array(one), 1, 0)


def _may_match(lowered: Column, rule: Rule, signs: Column | None = None) -> Column:
    """The cheapest tests first: what every match holds, then the hints."""
    out = contains_any(lowered, rule.hints)
    for needle in reversed(rule.needs):
        out = lowered.contains(needle) & out
    if signs is not None and rule.id in SIGNS:
        out = holds_sign(signs, SIGNS[rule.id]) & out
    return out


def rule_matches(code: Column, lowered: Column, rules: Sequence[Rule]) -> Column:
    """Raw hits of all rules in one text: the cheap hints decide which patterns run. Which signs a
    text holds is found once for all rules, and most prose has none of them."""
    signs = sorted({sign for rule in rules for sign in SIGNS.get(rule.id, "")})
    if not signs:
        return _rule_matches(code, lowered, rules, None)
    return let(held_signs(lowered, signs), lambda held: _rule_matches(code, lowered, rules, held))


def _rule_matches(code: Column, lowered: Column, rules: Sequence[Rule], signs: Column | None) -> Column:
    candidates = [
        F.struct(
            F.lit(rule.id).alias("rule"),
            F.when(
                _may_match(lowered, rule, signs),
                marked(code, rx(rule.pattern), ["$0"] + [f"${g + 1}" for g in range(rule.groups)]),
            ).alias("marked"),
        )
        for rule in rules
    ]
    found = F.filter(F.array(*candidates), lambda c: c["marked"].contains(OPEN))
    return F.flatten(
        F.transform(
            found,
            lambda c: matches(
                c["marked"],
                lambda f: F.length(f[0]),
                lambda start, f: _raw_hit(
                    c["rule"], start, f[0], F.length(f[0]),
                    F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))),
                ),
            ),
        )
    )


def closed_matches(code: Column, lowered: Column, rules: Sequence[Rule]) -> Column:
    """Raw hits of all rules; those of rules with a body reach to the bracket that closes theirs,
    however long that is. Only texts with such a rule's beginning are searched for brackets."""
    found, with_body = rule_matches(code, lowered, rules), [r for r in rules if r.body]
    if not with_body:
        return found
    begun = F.lit(False)
    for rule in with_body:
        begun = begun | (_may_match(lowered, rule) & code.rlike(rx(rule.pattern)))

    def opens(h: Column) -> Column:
        return h["rule"].isin(*[r.id for r in with_body]) & F.right(h["text"], F.lit(1)).isin("[", "{")

    def whole(h: Column, parts: Column, close: Column) -> Column:
        first = F.slice(h["groups"], F.lit(1), F.size(h["groups"]) - 1)
        body = text_at(parts, h["stop"] - 1, close + 2 - h["stop"])
        text = text_at(parts, h["start"], close + 1 - h["start"])
        return _raw_hit(h["rule"], h["start"], text, close + 1 - h["start"], F.concat(first, F.array(body)))

    def reaching(g: Column) -> Column:
        return F.transform(g["found"], lambda h: F.when(~opens(h), h).when(
            F.map_contains_key(g["pairs"], h["stop"] - 1),
            whole(h, g["parts"], F.try_element_at(g["pairs"], h["stop"] - 1)),
        ))

    given = F.struct(
        found.alias("found"), F.when(begun, text_parts(code)).alias("parts"),
        F.when(begun, bracket_pairs(code)).alias("pairs"),
    )
    return F.filter(let(given, reaching), lambda h: h.isNotNull())


def _focus(h: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Start and stop of the part of a match that its finding points at."""
    start, stop = h["start"], h["stop"]
    for rule in rules:
        if not rule.focus:
            continue
        begin = h["start"] + rule.lead
        for group in range(rule.focus - 1):
            begin = begin + F.length(F.get(h["groups"], F.lit(group)))
        here = h["rule"] == rule.id
        start = F.when(here, begin).otherwise(start)
        stop = F.when(
            here, begin + F.length(F.get(h["groups"], F.lit(rule.focus - 1)))
        ).otherwise(stop)
    return start, stop


#: A literal gate looks at (value, name before it) and must pass every literal its detector
#: could report; the detector applies the exact test to the few that pass.
LiteralGate = Callable[[Column, Column], Column]


def literal_matches(code: Column, gates: dict[str, LiteralGate]) -> Column:
    """Literals that pass a gate, as raw hits: text is the decoded value, groups hold the
    assigned name and whether it is an interpolated template."""
    def passing(name: str, gate: LiteralGate, literals: Column) -> Column:
        return F.transform(
            F.filter(literals, lambda t: gate(t["value"], t["name"])),
            lambda t: _raw_hit(
                F.lit(name), t["start"], t["value"], F.length(t["raw"]),
                F.array(t["name"], t["interpolated"]),
            ),
        )

    def literals_of(tokens: Column) -> Column:
        return F.transform(
            F.filter(tokens, lambda t: ~t["comment"]),
            lambda t: F.struct(
                t["start"].alias("start"), t["raw"].alias("raw"),
                decode_escapes(literal_body(t["raw"])).alias("value"),
                assigned_name(t["before"]).alias("name"),
                F.when(F.startswith(t["raw"], F.lit("`")) & t["raw"].contains("${"), F.lit("1"))
                .otherwise(F.lit("")).alias("interpolated"),
            ),
        )

    return let(
        literals_of(token_array(code)),
        lambda ls: F.concat(*[passing(n, g, ls) for n, g in gates.items()]),
    )


def hit_array(
    raw_rules: Sequence[Rule] = (),
    stripped_rules: Sequence[Rule] = (),
    literal_gates: dict[str, LiteralGate] | None = None,
    locate: bool = True,
) -> Column:
    """All hits of the given rules in an asset's code.

    raw_rules run on code as written, stripped_rules on code without comments, literal_gates
    on string literals.
    """
    tails = {r.id: r.tail for r in (*raw_rules, *stripped_rules) if r.tail}

    def _with_tail(found: Column, source: Column, tail_of: dict[str, int]) -> Column:
        if not tail_of:
            return F.transform(found, lambda h: _tailed(h, source, tail_of))
        # most texts have no hit, and then nothing is cut
        parts = F.when(F.size(found) > 0, text_parts(source))
        return let(parts, lambda ps: F.transform(found, lambda h: _tailed(h, ps, tail_of)))

    def _tailed(h: Column, parts: Column, tail_of: dict[str, int]) -> Column:
        tail = F.lit("")
        for length in sorted(set(tail_of.values())):
            names = [n for n, size in tail_of.items() if size == length]
            tail = F.when(
                h["rule"].isin(*names), text_at(parts, h["stop"], F.lit(length))
            ).otherwise(tail)
        return F.struct(
            h["rule"].alias("rule"), h["start"].alias("start"), h["stop"].alias("stop"),
            h["text"].alias("text"), h["groups"].alias("groups"), tail.alias("tail"),
        )

    def region_hits(code: Column) -> Column:
        parts = []
        if raw_rules:
            parts.append(
                let(
                    let(F.lower(code), lambda lc: rule_matches(code, lc, raw_rules)),
                    lambda found: _with_tail(found, code, tails),
                )
            )
        if stripped_rules:
            parts.append(
                let(
                    strip_comments(code),
                    lambda sc: let(
                        let(F.lower(sc), lambda lc: closed_matches(sc, lc, stripped_rules)),
                        lambda found: _with_tail(found, sc, tails),
                    ),
                )
            )
        if literal_gates:
            parts.append(_with_tail(literal_matches(code, literal_gates), code, {}))
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    content = F.col("content")

    def located(placed: Column, region_idx: Column, off: Column, h: Column) -> Column:
        start, stop = _focus(h, (*raw_rules, *stripped_rules))
        start, stop = off + start, off + stop

        def hit(place: Column) -> Column:
            return F.struct(
                region_idx.alias("region_idx"), h["rule"].alias("rule"), h["start"].alias("pos"),
                start.alias("start"), stop.alias("stop"), h["text"].alias("text"),
                h["groups"].alias("groups"), h["tail"].alias("tail"),
                place["line"].alias("line"), place["col"].alias("col"), place["snippet"].alias("snippet"),
            )

        if not locate:
            return hit({"line": F.lit(0), "col": F.lit(0), "snippet": F.lit("")})
        return let(place_of(placed, start, stop), hit)

    found = F.transform(
        code_region_array(F.col("kind"), content),
        lambda r, i: F.struct(i.alias("i"), r["off"].alias("off"), region_hits(r["code"]).alias("hits")),
    )

    def placed_hits(regions: Column) -> Column:
        any_hit = F.exists(regions, lambda r: F.size(r["hits"]) > 0)
        return let(
            F.when(any_hit, placing(content)),
            lambda placed: F.flatten(
                F.transform(
                    regions,
                    lambda r: F.transform(r["hits"], lambda h: located(placed, r["i"], r["off"], h)),
                )
            ),
        )

    return let(found, placed_hits)


def hit_rows(assets: DataFrame, found: Column, vendor_skip: Sequence[str] = ()) -> DataFrame:
    """Hits as rows. Rules named in ``vendor_skip`` do not report in library files."""
    vendor = is_vendor_bundle(F.col("url"))
    out = exploded(assets, (*ASSET_KEYS, vendor.alias("vendor")), found, "h")
    if vendor_skip:
        out = out.where(~(F.col("vendor") & F.col("h.rule").isin(*vendor_skip)))
    return out.select(*ASSET_KEYS, *[F.col("h." + f).alias(f) for f in HIT_FIELDS])


def hits(
    assets: DataFrame,
    raw_rules: Sequence[Rule] = (),
    stripped_rules: Sequence[Rule] = (),
    literal_gates: dict[str, LiteralGate] | None = None,
    vendor_skip: Sequence[str] = (),
    locate: bool = True,
) -> DataFrame:
    """Hit rows straight from assets."""
    every_rule = {r.id for r in (*raw_rules, *stripped_rules)} | set(literal_gates or {})
    if vendor_skip and every_rule <= set(vendor_skip):
        # The whole file is skipped before any matching.
        assets = assets.where(~is_vendor_bundle(F.col("url")))
    found = hit_array(raw_rules, stripped_rules, literal_gates, locate)
    return hit_rows(assets, found, vendor_skip)


def within_literal(offset: Column) -> dict[str, Column]:
    """Place of a part of a literal that begins at ``offset`` of its value. Escapes make the value
    shorter than its source; then the part has the literal's own place."""
    plain = F.length("text") == F.col("stop") - F.col("start") - 2
    head = F.substr("text", F.lit(1), offset)
    lines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    col = F.when(lines > 0, F.length(F.substring_index(head, "\n", -1)) + 1).otherwise(F.col("col") + 1 + offset)
    return {
        "pos": F.when(plain, F.col("pos") + 1 + offset).otherwise(F.col("pos")),
        "line": F.when(plain, F.col("line") + lines).otherwise(F.col("line")),
        "col": F.when(plain, col).otherwise(F.col("col")),
    }
