"""Hard negatives by zone maps against all products."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panewise.llm import zone_negatives
from panewise.llm.queries import QUERIES
from panewise.llm.zone_negatives import anchors_of, blocks_of, bounds, hard_negatives, hilbert, needed

SF = "/root/testdata/sf0.001"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def expected(rows, every=100):
    """All products in Python integers, of (vec_id, embedding, label)."""
    use = []
    for key, v, label in rows:
        if key is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * x)) for x in v]
        if max(map(abs, q)) < 1 << 31 and len(q) * max(map(abs, q)) ** 2 < 1 << 62:
            use.append((key, q, label))
    out = []
    for k, (key, q, label) in enumerate(use):
        if key % every:
            continue
        score = [(-sum(x * y for x, y in zip(q, p, strict=True)), other, of) for j, (other, p, of) in enumerate(use) if j != k and len(p) == len(q)]
        score.sort(key=lambda s: s[:2])
        for p, positive, _ in [s for s in score if s[2] == label][:5]:
            found = [(n, other) for n, other, of in score if of != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(key, positive, r, other, -p, -n) for r, (n, other) in enumerate(found, 1)]
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    changed = [(k, v, (label + 1) % 10 if k % 7 == 0 else label) for k, v, label in rows]
    found = got(QUERIES["op12_zone_negatives"](spark, SF))
    assert found == expected(changed) and found


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(zone_negatives, "BLOCK_BYTES", 16 * 4 * 4)
    monkeypatch.setattr(zone_negatives, "PAGE", 3)


SCHEMA = "vec_id long, embedding array<double>, label long, block long, anchor string, q int, late boolean"


def test_odd_vectors(spark, small_blocks):
    rnd = random.Random(4)
    rows = []
    for k in range(400):
        v = [rnd.choice([0.0, 0.25, -0.5, rnd.gauss(0, 1)]) for _ in range(4)]
        rows.append((k, v, rnd.choice([0, 0, 0, 1, 2])))
    same = [0.5, 0.5, 0.0, 0.0]
    rows += [(1000 + k, same, k % 2) for k in range(120)]  # ties of many equal vectors
    rows += [(100, same, 0), (100, same, 0), (200, [1.0, 2.0, 3.0, 4.0], 1)]  # repeated ids
    rows += [(None, same, 0), (300, None, 0), (500, same, None), (600, [], 0), (700, [1.0, None, 0.0, 0.0], 0)]
    rows += [(800, [float("nan")] * 4, 0), (900, [float("inf"), 0.0, 0.0, 0.0], 0), (1200, [1e300, 0.0, 0.0, 0.0], 0)]
    rows += [(1300, [1.0, 2.0], 0), (1301, [2.0, 1.0], 0), (1302, [1.0, 1.5], 1), (1400, [0.0] * 4, 2), (-100, same, 7), (1500, [4e6, -4e6, 1e6, 0.1], 1)]
    odd = spark.createDataFrame([(*r, 1, "clash", 2, True) for r in rows], SCHEMA).repartition(3)
    assert got(hard_negatives(odd)) == expected(rows)
    assert hard_negatives(odd.limit(0)).count() == 0
    assert hard_negatives(odd.where("vec_id = 1400")).count() == 0


def test_zone_maps_spare_clustered_blocks(spark, small_blocks):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 4)) * 4
    rows = [(k, (centres[k % 12] + rnd.normal(size=4) * 0.02).tolist(), k % 12 % 3) for k in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    blocks = blocks_of(table)
    anchors = anchors_of(blocks, 100)
    read = sum(r["bits"].bit_count() for r in needed(anchors, blocks, True).collect())
    of_label = dict(blocks.groupBy("label").count().collect())
    all_pairs = sum(of_label[r["label"]] for r in anchors.select("label").collect())
    assert read < 0.5 * all_pairs
    assert got(hard_negatives(table)) == expected(rows)


def test_neighbours_on_the_curve_are_neighbours_in_space():
    cells = np.array(list(itertools.product(range(8), repeat=3)), np.int64)
    place = hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-(10**6), 10**6), min_size=3, max_size=3), min_size=2, max_size=12))
def test_bounds_hold(rows):
    a, body = np.array(rows[:1], np.float64), np.array(rows[1:], np.float64)
    least, most = bounds(a, body.min(axis=0)[None], body.max(axis=0)[None])
    assert (least[0, 0] <= a @ body.T).all() and (a @ body.T <= most[0, 0]).all()
