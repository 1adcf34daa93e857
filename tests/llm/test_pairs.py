"""The Jaccard join, containment search and cover tree against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panewise.llm import containment, cover_tree, parity_join
from panewise.llm.components import components
from panewise.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(60)]
SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def brute_jaccard(rows):
    sets, groups, holders = {d: shingles(t) for d, t in rows}, Groups(), defaultdict(list)
    for d, s in sets.items():
        groups.find(d)
        near = defaultdict(int)
        for x in s:
            for other in holders[x]:
                near[other] += 1
            holders[x].append(d)
        for other, n in near.items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                groups.link(d, other)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def copies(rnd, n, sizes):
    """Texts with edits of a few originals, some after a line that many share."""
    base = [[rnd.choice(WORDS) for _ in range(rnd.choice(sizes))] for _ in range(n // 20)]
    shared = [rnd.choice(WORDS) for _ in range(20)]
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            if words:
                k = rnd.randrange(len(words))
                words[k : k + 1] = rnd.choice([[rnd.choice(WORDS)], [], [words[k], rnd.choice(WORDS)]])
        yield i * 3 - 500, " ".join(shared * (rnd.random() < 0.3) + words)


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 16)
    rows = list(copies(random.Random(3), 1200, [0, 1, 2, 4, 5, 6, 7, 8, 9, 12, 20, 60, 130, 300]))
    got = parity_join.classes_and_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_jaccard(rows)


def test_jaccard_join_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op5_parity_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(rows)


@pytest.mark.parametrize("seed", range(20))
def test_sketch_words_of_linked_sets_meet(seed):
    rnd = np.random.default_rng(seed)
    rank = rnd.integers(0, 200, parity_join.COUNTERS).astype(np.uint8)
    a = int(rnd.integers(1, 400))
    first = np.sort(rnd.integers(0, 1 << 63, a).astype(np.uint64))
    for _ in range(20):
        lost = int(rnd.integers(0, a // 4 + 1))
        more = rnd.integers(0, 1 << 63, int(rnd.integers(0, a // 3 + 1))).astype(np.uint64)
        second = np.unique(np.concatenate((rnd.permutation(first)[lost:], more)))
        common = len(np.intersect1d(first, second))
        if 100 * common < 75 * (a + len(second) - common):
            continue
        keys = [set(parity_join.entries_of(np.zeros(len(v), np.int64), v, np.array([len(v)]), rank)[1].tolist()) for v in (first, second)]
        assert keys[0] & keys[1]


def test_jaccard_join_of_odd_documents(spark, odd_documents, no_documents):
    got = parity_join.classes_and_components(odd_documents)
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got.collect())
    assert len(rows) == odd_documents.count()
    sizes = {(r[1], r[2], r[3]) for r in rows if not r[0]}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (5, 36, 4), (6, 37, 4), (10, 1, 10)} <= sizes
    assert [r[3] for r in rows if r[0]] == [-1, 4]  # a null id without words, and a copy of document 4
    kept = parity_join.survivors(odd_documents)
    assert kept.columns == odd_documents.columns
    left = [(r.doc_id, (r.text or "")[:12]) for r in kept.collect()]
    assert len(left) == len(set(left)) and {d for d, _ in left} == {0, 1, 2, 3, 4, 7, 8, 9, 10, None}
    assert parity_join.classes_and_components(no_documents).count() == 0
    assert parity_join.survivors(no_documents).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (500, 400), (500, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [100, *range(200, 230)]}, 400: 400, 500: 400}


def brute_leaks(docs, items):
    sets = {d: shingles(t) for d, t in docs}
    goal = {i: s for i, t in items if (s := shingles(t))}
    return {(d, i): len(q & s) for d, s in sets.items() for i, q in goal.items() if 4 * len(q & s) >= 3 * len(q)}


def test_containment_of_the_whole_table(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r.doc_id, r.item_id): r.n_common for r in QUERIES["op10_containment"](spark, SF).collect()}
    assert got == brute_leaks(docs, items) and got


def test_containment_equals_brute_force(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 2, 4, 5, 6, 9, 20, 60])))) for i in range(60)]
    docs = []
    for d in range(300):
        words = [rnd.choice(WORDS) for _ in range(rnd.choice([0, 3, 30, 200]))]
        part = rnd.choice(items)[1].split()
        if part and rnd.random() < 0.7:
            part[rnd.randrange(len(part))] = rnd.choice([*WORDS, part[0]])
        docs.append((d, " ".join(words[: len(words) // 2] + part + words[len(words) // 2 :]).upper()))
    got = containment.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.n_common for r in got.collect()} == brute_leaks(docs, items)


def test_containment_of_odd_documents(spark, odd_documents, no_documents):
    prose = odd_documents.where("doc_id = 5").first().text
    items = spark.createDataFrame([(1, prose, 0), (2, None, 0), (3, "", 0), (None, "another text of id four", 0), (1, prose, 1)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in containment.leaks(odd_documents, items).collect()}
    assert got == {(4, 1), (5, 1), (6, 1), (None, 1), (4, None)}
    clean = containment.clean(odd_documents, items)
    assert clean.columns == odd_documents.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in clean.collect()) == [-1, 0, 1, 2, 3, 7, 8, 9, 10]
    assert containment.leaks(no_documents, items).count() == 0 and containment.clean(odd_documents, items.limit(0)).count() == odd_documents.count()


def brute_cosine(rows):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near, groups = unit @ unit.T >= 0.9, Groups()
    for i, j in zip(*np.nonzero(near), strict=True):
        groups.link(ids[i], ids[j])
    return {d: (int(n) - 1, groups.find(d)) for d, n in zip(ids, near.sum(axis=1), strict=True)}


def test_cover_tree_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op6_cover_tree"](spark, SF).collect()}
    assert got == brute_cosine(rows)


def test_cover_tree_in_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 150), ("PIVOTS", 12), ("LOCAL", 16), ("CELLS", 1 << 12)):
        monkeypatch.setattr(cover_tree, name, value)
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(30, 8))
    rows = [(i, [float(x) for x in base[rnd.integers(30)] + rnd.normal(size=8) * rnd.choice([0, 0.05, 0.2, 0.4])]) for i in range(900)]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute_cosine(rows)


def test_cover_tree_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [1.0, None], [inf, 1.0], [1.0, 2.0], [2.0, 4.0], [1.0], [-2.0], [1e200, 2e200], [1.0, 2.0]]
    rows = [(i, v, "clash") for i, v in enumerate(vectors)] + [(None, [1.0, 2.0], None), (6, [5.0, -1.0], None), (None, [-3.0, 1.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(table).collect()), key=str)
    wanted = [(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 8, 9)] + [(i, 4, 6, i == 6) for i in (6, 7, 10, 11, None)]
    assert got == sorted([*wanted, (6, 0, 6, True), (None, 0, None, False)], key=str)
    assert cover_tree.near_duplicates(table.limit(0)).count() == 0


def test_a_hidden_pair_across_pivots(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    angle = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first()[:] == (56, 56, 0)
