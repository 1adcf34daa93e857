"""Language, secrets, licenses, quality and toxicity: brute force or held-out accuracy."""

import hashlib
import math
import random
import re
import string
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panewise.llm import cross_parsing, license_templates, novelty, quality_gam, toxic_segments
from panewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=40), st.text("abcd", max_size=40))
def test_phrases_are_longest_matches(sample, text):
    parser = cross_parsing.Parser((("x", sample),))
    symbols = parser.symbol[np.array([ord(c) for c in text] or [97], np.int64)]
    count, at = 1, 0
    text = text or "a"
    for end in range(1, len(text) + 1):
        if text[at:end] not in sample:
            count, at = count + 1, end - 1
            at += text[at:end] not in sample
    assert parser.phrases(symbols[:, None]).tolist() == [[count]]


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_cross_parsing"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_languages_of_many_scripts(spark):
    """Nine invented languages, with syllabaries and thousands of characters among them."""
    rnd = random.Random(12)
    letters = {"el": (0x3B1, 24), "ru": (0x430, 32), "ar": (0x627, 28), "hi": (0x905, 48), "ka": (0x10D0, 33), "th": (0xE01, 46), "am": (0x1200, 300), "ko": (0xAC00, 2500), "zh": (0x4E00, 3000)}
    rows = []
    for lang, (first, n) in letters.items():
        known = [c for c in map(chr, range(first, first + n)) if c.isalpha()]
        words = ["".join(rnd.choices(known, k=rnd.randint(1, 4))) for _ in range(600)]
        rows += [(len(rows) + k, " ".join(rnd.choices(words, k=60)), lang) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit = cross_parsing.sample(docs, F.col("doc_id") % 2 == 0)
    held = cross_parsing.identified(docs.where("doc_id % 2 = 1"), fit).collect()
    right = {k: lang for k, _, lang in rows}
    assert sum(r.lang_pred == right[r.doc_id] for r in held) / len(held) > 0.95


def test_languages_of_odd_documents(spark, odd_documents, no_documents):
    sample = (("de", "der schnelle braune fuchs springt"), ("en", "mixed case text and one more another text w of id four x"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in cross_parsing.identified(odd_documents, sample).where("doc_id is not null").collect()}
    assert [got[i][0] for i in range(4)] == ["und"] * 4 and got[8][0] == "en" and got[9][0] in ("de", "en")
    assert {r.lang_pred for r in cross_parsing.identified(odd_documents, ()).collect()} == {"und"}
    kept = cross_parsing.recognised(odd_documents, sample)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 5
    assert cross_parsing.identified(no_documents, sample).count() == 0 and cross_parsing.sample(no_documents, F.lit(True)) == ()
    assert len(cross_parsing.sample(odd_documents, F.col("doc_id") < 9)) == 1


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out)


SNIPPETS = ("token=", "Secret: '", "api_key = ", "APIKEY:", "password\"  : \"", "passwd=", "AKIA", "AKIAAKIA", "é🎉 ", " ", "\n", "=", ".", "deadbeef", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "x", "ſecret=abcdefghijklmnop")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SNIPPETS), max_size=14))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    found = novelty.Scanner(b"some dictionary").scan([text, None])
    assert [x for x in found[0] if x[1] < 3] == brute_spans(text) and found[1] == []


def test_secrets_of_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LABELLED}/documents.parquet").collect()}
    names = ("assign", "access", "hex")
    for r in QUERIES["op2_novelty"](spark, LABELLED).collect():
        spans = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in spans) for kind in range(3)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("novel")] == (joined.split(",") if joined else [])


def test_novel_strings_need_context_and_entropy():
    rnd = random.Random(4)
    key = "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(40))
    scan = novelty.Scanner((novelty.IDENTIFIERS + " config_value_for_the_private_key_2_of_production").encode()).scan
    text = f"the private signing value is {key} here"
    assert scan([text]) == [[(29, 3, 69)]]
    assert scan([f"a plain number is {key} here"]) == [[]]
    assert scan(["the private value is config_value_for_the_private_key_2_of_production"]) == [[]]
    assert scan([f"é🎉 private {key} and private {key}"])[0][0] == (11, 3, 51)


def novel_keys(spark, copies, others):
    rnd = random.Random(8)
    key = lambda: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(40))
    prose = lambda: " ".join(rnd.choice(("alpha", "gamma", "window", "server")) for _ in range(20))
    texts = [f"{prose()} the private signing value is {key()} {prose()}"] * copies
    texts += [f"{prose()} the private signing value is {key()} {prose()}" for _ in range(others)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    primed = novelty.dictionary(docs)
    assert not any(re.search("is ([A-Za-z0-9]{40})", t)[1].encode() in primed for t in texts)
    at = {i: re.search("is ([A-Za-z0-9]{40})", t).span(1) for i, t in enumerate(texts)}
    found = novelty.scanned(docs, primed).collect()
    assert len(found) == len(texts) and all(r.spans == f"novel:{at[r.doc_id][0]}:{at[r.doc_id][1]}" for r in found)
    return primed


def test_secrets_of_copies_and_of_small_tables_are_novel(spark):
    novel_keys(spark, 200, 400)
    primed = novel_keys(spark, 0, 10)
    assert b"\nserver\n" in primed and novelty.IDENTIFIERS.encode() in primed


@pytest.mark.parametrize("size", [20, 512, 513, 1600, 100_003])
def test_novel_strings_of_any_length(size):
    rnd = random.Random(size)
    blob = "".join(rnd.choice(string.ascii_letters + string.digits + "+/") for _ in range(size - 2)) + "a1"
    scan = novelty.Scanner(novelty.IDENTIFIERS.encode()).scan
    assert [x for x in scan([f"private_key: '{blob}'"])[0] if x[1] == 3] == [(14, 3, 14 + size)]
    assert scan([f"private_key: '{'xy1' * size}'", f"number: '{blob}'"]) == [[], []]


def test_rest_of_a_run_outside_base_spans():
    scan = novelty.Scanner(novelty.IDENTIFIERS.encode()).scan
    left, right, inner = "Zq7XwK2mPvR9sTgYhL4n", "QmW8rUzJx5GkTyVpN3oS", "0123456789abcdef"
    at = len("private value ")
    assert scan([f"private value {left}{inner}{right}"]) == [[(at, 3, at + 20), (at + 20, 2, at + 36), (at + 36, 3, at + 56)]]
    assert scan([f"private value Zq7XwK{inner}"]) == [[(at, 3, at + 6), (at + 6, 2, at + 22)]]
    assert scan([f"private value ID-{inner} {inner}0000"]) == [[(at + 3, 2, at + 19), (at + 20, 2, at + 40)]]
    assert scan(["private: my_token=Zq7XwK2mPvR9sTgYhL4n"]) == [[(12, 0, 38)]]
    text = f"private value {left}{inner}{right} end"
    assert novelty.without(text, scan([text])[0], "") == "private value  end"


def test_words_count_equal_texts_once(spark):
    texts = ["copied words here"] * 9 + ["other words", "other words two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert novelty.dictionary(docs).decode().split("\n")[:-1] == ["other", "words"]


def test_the_commonest_words_fill_the_dictionary(spark):
    """Word w<k> is in so many texts as its class says; the bytes end within the class of two texts."""
    name = lambda k: "w" + "".join(chr(97 + int(d)) for d in f"{k:05d}")
    often = {name(k): 2 if k >= 40 else 100 - k for k in range(1000)}
    docs = spark.createDataFrame(
        [(i, " ".join(w for w, n in often.items() if i < n) + " " + "z" * (i + 1)) for i in range(100)], "doc_id long, text string"
    )
    got = novelty.dictionary(docs, 7 * 300).decode().split("\n")[:-1]
    assert got[-40:] == sorted(often, key=often.get)[-40:] and 200 < len(got) <= 300 and len(set(got)) == len(got)
    assert set(got) <= set(often) and len(novelty.dictionary(docs, 7 * 1000).decode().split("\n")) == 1001
    assert novelty.dictionary(docs, 10).decode() == "\n".join([name(0), novelty.IDENTIFIERS])


def test_redaction_of_odd_documents(spark, odd_documents, no_documents):
    rows = odd_documents.withColumn("text", F.when(F.col("doc_id") == 5, F.lit("a token=abcdefghijklmnopqr b 0123456789abcdef0 c")).otherwise(F.col("text")))
    got = novelty.redacted(rows, novelty.dictionary(rows))
    assert got.columns == rows.columns and got.count() == rows.count()
    assert got.where("doc_id = 5").select("text", "n_chars").first()[:] == ("a [SECRET] b [SECRET] c", 23)
    same = got.where("doc_id <> 5 or doc_id is null").exceptAll(rows)
    assert same.count() == 0
    assert novelty.scanned(no_documents, novelty.dictionary(no_documents)).count() == 0
    assert novelty.scanned(odd_documents, b"").count() == odd_documents.count()


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(label, i) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for _, i in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, _ in at}))


BASE = ("n_words", "n_base", "first_word", "last_word", "base_labels")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(("under", "The", "MIT", "license", "Apache", "version-2", "CC", "by/nc", "é", "2.", "{", "nc")), max_size=12), max_size=4))
def test_base_licenses_equal_brute_force(rows):
    texts = [" ".join(r) for r in rows]
    assert [tuple(r[c] for c in BASE) for r in license_templates.scan(texts)] == [brute_licenses(t) for t in texts]


@pytest.mark.parametrize("text, labels, score", [
    ("Released under the MIT License.", "mit", 1.0),
    ("Licensed under the terms of the Apache License, Version 2.0", "apache-2", 1.0),
    ("licensed under the GNU General Public License, version 3.", "gpl", 1.0),
    ("Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc", 1.0),
    ("Creative Commons Attribution 4.0 International License", "cc-by", 1.0),
    ("Redistribution and use in source and binary forms, with modification", "", pytest.approx(9 / 21)),
    ("This is free and unencumbered software released into the private domain", "", pytest.approx(9 / 11)),
    ("the mit", "", 0.0),
    ("", "", 0.0),
])
def test_templates(text, labels, score):
    row = next(license_templates.scan([text]))
    assert (row["labels"], row["score"]) == (labels, score)


def test_licenses_of_whole_and_odd_tables(spark, odd_documents, no_documents):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LABELLED}/documents.parquet").collect()}
    for r in QUERIES["op4_license_templates"](spark, LABELLED).collect():
        assert tuple(r[c] for c in BASE) == brute_licenses(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert license_templates.scanned(odd_documents).where("n_base = 0 and score = 0").count() == odd_documents.count()
    assert license_templates.scanned(no_documents).count() == 0


def held_out_accuracy(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    rows = QUERIES[query](spark, LABELLED).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(held) > 50 and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == labels[r.doc_id] for r in held) / len(held)


def test_quality_of_held_out_documents(spark):
    assert held_out_accuracy(spark, "op8_quality_gam", "quality") > 0.95


def test_many_rare_toxic_words(spark):
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice(string.ascii_lowercase) for _ in range(8))
    common, rare = [name() for _ in range(200)], [name() for _ in range(533)]
    prose = lambda bad: " ".join(rnd.choice(common) for _ in range(15)) + "".join(f" {w} {rnd.choice(common)}" for w in bad)
    rows = [(i, prose(rare[(4 * i + k) % 533] for k in range(4)) if i < 2100 else prose(()), int(i < 2100)) for i in range(4200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    held = F.col("doc_id") % 21 == 0
    model = toxic_segments.fitted(docs, docs.where(~held).select("doc_id", "label"))
    got = toxic_segments.scored(docs.where(held), model).collect()
    assert len(got) == 200 and all((r.score >= 0.7) == (r.doc_id < 2100) for r in got)


def test_toxicity_of_held_out_documents(spark):
    assert held_out_accuracy(spark, "op9_toxic_segments", "toxic") > 0.93


def test_model_learns_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(4000, len(quality_gam.FEATURES)))
    y = (x[:, 1] * x[:, 4] > 0).astype(float)
    model = quality_gam.Model(x, y)
    assert (4, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_features_by_hand():
    row = dict(zip(quality_gam.FEATURES, next(quality_gam.features(["Ab ab cd!\nX1 | é"]))[0], strict=True))
    assert row["log_chars"] == pytest.approx(math.log1p(16)) and row["log_words"] == pytest.approx(math.log1p(6))
    assert row["distinct_words"] == pytest.approx(5 / 6) and row["repeats_next"] == pytest.approx(1 / 6) and row["top_word"] == pytest.approx(2 / 6)
    assert row["upper"] == pytest.approx(2 / 8) and row["bars"] == pytest.approx(1 / 6) and row["short_lines"] == 1.0


def brute_segments(places, values, cost):
    """All segments of which every shorter part scores less, without those inside longer ones of the kind."""
    n = max(places, default=-1) + 1
    score = np.full(n, -cost)
    score[places] = values
    total = np.concatenate(([0.0], np.cumsum(score)))
    firm = [
        (a, b) for a in range(n) for b in range(a, n)
        if (total[a + 1:b + 1] > total[a]).all() and total[b + 1] > total[a] and (total[a + 1:b + 1] < total[b + 1]).all()
    ]
    whole = [(a, b) for a, b in firm if not any((c, d) != (a, b) and c <= a and b <= d for c, d in firm)]
    return [(a, b, total[b + 1] - total[a]) for a, b in whole]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 96).map(lambda v: v / 16), min_size=1, max_size=14), st.sampled_from([1 / 16, 0.5, 2.0]))
def test_all_maximal_segments_are_found(marked, cost):
    """Sixteenths add up exactly, so ties and segments of equal scores are compared too."""
    places = sorted(marked)
    values = [marked[p] for p in places]
    with mock.patch.object(toxic_segments, "COST", cost):
        found = toxic_segments.segments(places, values)
    assert found == [x for x in brute_segments(places, values, cost) if x[2] >= toxic_segments.SIGNIFICANT]


def test_distant_passages_are_segments_of_their_own():
    assert [x[:2] for x in toxic_segments.segments([0, 1, 201], [6.0, 6.0, 6.0])] == [(0, 1), (201, 201)]
    assert [x[:2] for x in toxic_segments.segments([5, 1005], [6.0, 6.0])] == [(5, 5), (1005, 1005)]
    many = list(range(0, 2_000_000, 10))
    assert len(toxic_segments.segments(many, [0.25] * len(many))) == 0


def test_models_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 0), (5, 1), (8, None), (99, 1), (None, 1)], "doc_id long, label int")
    for module in (quality_gam, toxic_segments):
        for known in (labels, labels.limit(0), labels.where("label = 1")):
            got = module.scored(odd_documents, module.fitted(odd_documents, known))
            assert got.count() == odd_documents.count() and got.where("score >= 0 and score <= 1").count() == got.count()
        assert module.scored(no_documents, module.fitted(no_documents, labels)).count() == 0
