"""Rules as a table against the branches of the catalogue and against Python."""

import random
import re

import pytest

from panewise.operators import rule_join as rj
from panewise.operators.hits import hits
from panewise.queries import corpus
from panewise.rules.endpoints import CALL_RULES
from panewise.rules.vulns import MISC_RULES

KEYS = ("site", "asset_seq", "region_idx")
SF = "/root/testdata/sf0.001"


def test_equals_the_branches_on_the_corpus(spark):
    c = corpus(spark, SF)
    rules = (*MISC_RULES, *CALL_RULES)
    branches = hits(c.assets, raw_rules=rules, locate=False)
    want = sorted((*r,) for r in branches.select(*KEYS, "rule", "pos", "text", "groups").collect())
    got = rj.rule_hits(c.regions, rj.rule_rows(spark, rules), KEYS)
    assert sorted((*r,) for r in got.select(*KEYS, "rule", "start", "text", "groups").collect()) == want and want


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "w7" * 5000 + " key_17=Abc9 " + "x " * 9000 + "key_17=Z key_4999=q"), (103, "KEY_12=Up and key_12=low")]
    return spark.createDataFrame(rows, "id long, code string").cache()


def catalogue(spark, n):
    rows = [(f"r{i}", f"(?i)key_{i}=(\\w+)", 1, [f"key_{i}="], []) for i in range(n)]
    rows += [("both", "w1[0-9]+ w2[0-9]+", 0, [], ["w1", "w2"]), ("bare", "w39[0-9]{2}", 0, [], []), ("short", "w7", 0, ["w7"], None)]
    rows += [("bare", "again", 0, [], []), (None, "x", 0, [], []), ("none", None, 0, [], [])]
    return spark.createDataFrame(rows, rj.RULES)


def brute(rows, rules):
    first = {r.rule: r for r in reversed(rules) if r.rule is not None and r.pattern is not None}
    return sorted((t.id, r.rule, m.start(), m.end(), m[0], list(m.groups())) for t in rows if t.code for r in first.values() for m in re.finditer(r.pattern, t.code))


@pytest.mark.parametrize("n", [20, 5000])
def test_equals_python_for_any_number_of_rules(spark, texts, n):
    rules = catalogue(spark, n).where("pattern is null or pattern != 'again'")
    got = rj.rule_hits(texts, rules, ("id",))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert len(plan) < 200_000
    assert sorted((*r,) for r in got.collect()) == brute(texts.collect(), rules.collect())


def test_candidates_are_few(spark, texts):
    found = rj.candidates(texts.where("code is not null"), catalogue(spark, 300).where("rule like 'r%'"), ("id",))
    assert {r.id: sorted(x.rule for x in r.rules) for r in found.collect()} == {102: ["r17"], 103: ["r12"]}


def test_only_grams_of_a_known_shape_are_cut_out(spark):
    odd = "a]b^c-d\\[&&e\U0001f600\u0131f\nok"
    rows = spark.createDataFrame([(1, "plain prose of many words " + odd), (2, odd[3:]), (3, "")], "id long, code string")
    wanted = ["]b^c", "-d\\[", "&&e\U0001f600", "\u0131f\no"]
    known = spark.createDataFrame([(g,) for g in [*wanted, ""]], "gram string")
    got = {(r.id, r.gram) for r in rj.gram_rows(rows, ["id"], rows.code, known).collect()}
    assert {g for i, g in got if i == 1} == {"", *wanted} and {g for i, g in got if i == 2} == {"", *wanted[1:]}
    none = rj.gram_rows(rows, ["id"], rows.code, known.where("gram = ''"))
    assert {(r.id, r.gram) for r in none.collect()} == {(i, "") for i in (1, 2, 3)}


def test_empty_tables_and_repeats(spark, texts):
    rules = catalogue(spark, 5)
    assert rj.rule_hits(texts.limit(0), rules, ("id",)).count() == 0
    assert rj.rule_hits(texts, rules.limit(0), ("id",)).count() == 0
    assert rj.rule_hits(texts, rules.where("rule = 'bare'"), ("id",)).select("rule").distinct().count() <= 1
