"""Each sign is in every match of its rule: read off the parsed pattern."""

from __future__ import annotations

from re import _parser

import pytest

from panewise.operators.access import ACCESS_RULES
from panewise.operators.hits import hit_array
from panewise.operators.technologies import content_matches
from panewise.rules.signs import CONTENT_SIGNS, SIGNS
from panewise.rules.technologies import CONTENT_RULES
from panewise.rules.vulns import MISC_RULES, ORM_RULES, XSS_RULES
from panewise.sources.assets import CAPTURE_SCHEMA, scan_responses

RULES = {r.id: r for r in (*MISC_RULES, *ORM_RULES, *XSS_RULES, *ACCESS_RULES)}


def holds(items, signs: set[str]) -> bool:
    """Whether every match of a parsed sequence holds one of the signs."""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and chr(arg) in signs:
            return True
        if name == "IN" and all(str(o) == "LITERAL" and chr(a) in signs for o, a in arg):
            return True
        if name == "SUBPATTERN" and holds(arg[3], signs):
            return True
        if name == "ATOMIC_GROUP" and holds(arg, signs):
            return True
        if name == "BRANCH" and all(holds(branch, signs) for branch in arg[1]):
            return True
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0 and holds(arg[2], signs):
            return True
    return False


@pytest.mark.parametrize("rule", sorted(SIGNS))
def test_every_match_holds_a_sign(rule):
    assert holds(_parser.parse(RULES[rule].pattern), set(SIGNS[rule]))


@pytest.mark.parametrize("rule", CONTENT_RULES, ids=lambda r: f"{r[0]} {r[3]}")
def test_every_match_of_a_content_rule_holds_a_sign(rule):
    signs = CONTENT_SIGNS.get((rule[0], rule[3]))
    assert signs is None or holds(_parser.parse(rule[4]), set(signs))


def test_content_signs_name_one_rule_each():
    names = [(r[0], r[3]) for r in CONTENT_RULES]
    assert len(set(names)) == len(names) and set(CONTENT_SIGNS) <= set(names) and len(CONTENT_SIGNS) > 30


def test_content_rules_find_what_hints_and_patterns_find(spark):
    """With signs as without, on texts of a rule's hints and pieces."""
    import random
    import re

    draw, pieces = random.Random(7), sorted({h for r in CONTENT_RULES for h in r[5]})
    more = ["=", '"', "'", " ", "_", "-", "/", ".", ".js", '"1.2.3"', "React.version", '"react": "^17.1"', "Vue", "Wix", "VERSION = '4.17.1' lodash", "jQuery.fn.jquery = '2.2.4'"]
    more += ["<meta name='generator' content='Own 3'>", 'ng-version="9.1"', "__NEXT_DATA__", "/page-data/", "__NUXT__", "Ember.VERSION='3.1'", "Magento_x", "csrf-token\" content", "hx-get="]
    texts = ["".join(draw.choices(pieces + more, k=draw.randint(1, 6))) for _ in range(2000)]
    rows = [("s.com", "https://s.com/", i, False, f"https://s.com/{i}.js", 200, "text/javascript", {}, t) for i, t in enumerate(texts)]
    assets = scan_responses(spark.createDataFrame(rows, CAPTURE_SCHEMA))
    found = assets.select("asset_seq", content_matches().alias("h")).selectExpr("asset_seq", "inline(h)")
    got = {(r.asset_seq, r.pos) for r in found.select("asset_seq", "pos").collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, r in enumerate(CONTENT_RULES) if any(h in t.lower() for h in r[5]) and re.search(r[4], t)}
    assert got == want and len({k for _i, k in want}) > 25


def test_a_text_with_hints_and_a_sign_is_searched(spark):
    texts = ["eval (x)", "eval x", "a = location; debug", "role admin update", "const userRole = \'boss\'", "\'depot.update\' b"]
    rows = [("s.com", "https://s.com/", i, False, f"https://s.com/{i}.js", 200, "text/javascript", {}, t) for i, t in enumerate(texts)]
    assets = scan_responses(spark.createDataFrame(rows, CAPTURE_SCHEMA))
    found = assets.select("asset_seq", hit_array((), (*XSS_RULES, *ACCESS_RULES)).alias("h")).selectExpr("asset_seq", "inline(h)")
    got = {(r.asset_seq, r.rule) for r in found.select("asset_seq", "rule").collect()}
    assert got == {(0, "xss_eval"), (4, "acc_role"), (5, "acc_permission")}
