"""Near duplicates of embeddings by a dual traversal of a cover tree.

Distances are chords between unit vectors; a cosine of c is a chord of sqrt(2 - 2c). The upper part
of the tree is made on a bounded sample: pivots in farthest-first order, so that the first ones
form a coarse net and each level, of half the radius, holds the levels above it. Every vector
hangs below its nearest pivot; a node's covering radius is the largest distance that occurs, taken
over all rows. Two nodes are compared only if their distance is at most both radii and the chord
of the threshold. Inside the task of a pair of nodes the traversal goes on: each side is covered
again by local nets of halving radii, pairs of local nodes beyond their bounds are dropped, pairs
wholly within the threshold are linked without a look, and the rest is multiplied out. Single
precision decides only beyond a margin; pairs within it are multiplied again in double precision.

A node is dealt in blocks of about BLOCK vectors, so a crowded one is many tasks. A task returns
counts and a spanning forest of its links, not the links. Equal vectors are one class: they are
compared once and counted as often as they occur.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing
and are their own component; so do vectors of different lengths with each other. Equal ids are
rows of their own. A null id stays null; a component of null ids only is null. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, kept
from .components import components

THRESHOLD = 0.9
#: Vectors of a block; sample the pivots are chosen from; most pivots; local nodes of a block.
BLOCK, SAMPLE, PIVOTS, LOCAL = 8192, 4096, 1024, 128
#: Single precision decides cosines farther than this from the threshold.
MARGIN = 1e-5
#: Cosines held at once.
CELLS = 1 << 21
FOUND = "node long, links long, other long"


def nets(unit: np.ndarray, most: int, least_radius: float) -> tuple[np.ndarray, list[float]]:
    """Indices of a farthest-first order and the radius that each prefix covers; it ends when the
    radius falls below the least one."""
    if not len(unit):
        return np.empty(0, np.int64), []
    chosen, radii = [0], []
    near = np.full(len(unit), np.inf)
    while True:
        near = np.minimum(near, np.maximum(0, 2 - 2 * unit @ unit[chosen[-1]]))
        far = int(np.argmax(near))
        radii.append(float(np.sqrt(near[far])))
        if len(chosen) >= min(most, len(unit)) or radii[-1] <= least_radius:
            return np.array(chosen), radii
        chosen.append(far)


def level(radii: list[float], bound: float) -> int:
    """Size of the coarsest level, of radii halving from the root's, that covers within bound."""
    want = radii[0]
    while want > bound:
        want /= 2
    return next((k + 1 for k, r in enumerate(radii) if r <= want), len(radii))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v, node, dim) with node null for vectors that cannot link."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select("vec_id", v.alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value to the comparison, so they are one to the class
    return rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).withColumn("node", F.when(good, F.xxhash64("v")))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest component: no overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(node, copies, v, dim, cell, distance): each class below its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cosine = unit_rows(part.column("v"), dim) @ pivots[dim].T
                cell = np.argmax(cosine, axis=1)
                chord = np.sqrt(np.maximum(0, 2 - 2 * cosine[np.arange(len(cell)), cell]))
                cols = [part.column(c) for c in ("node", "copies", "v", "dim")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(cell.astype(np.int32)), pa.array(chord)], names=["node", "copies", "v", "dim", "cell", "distance"])

    return classes.mapInArrow(run, "node long, copies long, v array<double>, dim int, cell int, distance double")


class Side:
    """A block: its vectors under local nets."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, unit: np.ndarray, chord: float):
        centres, radii = nets(unit, LOCAL, chord / 4)
        centres = centres[: level(radii, chord / 4)]
        near = np.argmax(unit @ unit[centres].T, axis=1)
        order = np.argsort(near, kind="stable")
        self.nodes, self.copies, self.unit = nodes[order], copies[order], unit[order]
        self.single = self.unit.astype(np.float32)
        self.centre = unit[centres]
        self.edge = np.searchsorted(near[order], np.arange(len(centres) + 1))
        gap = np.sqrt(np.maximum(0, 2 - 2 * (self.unit * self.centre[near[order]]).sum(axis=1)))
        self.radius = np.array([gap[a:b].max(initial=0.0) for a, b in zip(self.edge[:-1], self.edge[1:], strict=True)]) + 1e-9


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n by the links (i, j)."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def traverse(left: Side, right: Side, same: bool, threshold: float) -> pa.RecordBatch:
    """Counts of links of both blocks' vectors, and a forest of the links."""
    chord = np.sqrt(2 - 2 * threshold)
    n = len(left.nodes)
    links = np.zeros(n + (0 if same else len(right.nodes)), np.int64)
    shift = 0 if same else n
    low = np.arange(len(links))
    apart = np.sqrt(np.maximum(0, 2 - 2 * left.centre @ right.centre.T))
    reach = left.radius[:, None] + right.radius[None, :]
    close, whole = apart <= reach + chord, apart + reach + 1e-9 < chord
    for p in range(len(left.centre)):
        a, b = left.edge[p], left.edge[p + 1]
        others = np.flatnonzero(close[p])
        if same:
            others = others[others >= p]
        if not len(others) or a == b:
            continue
        at = np.concatenate([np.arange(right.edge[q], right.edge[q + 1]) for q in others])
        sure = np.repeat(whole[p][others], right.edge[others + 1] - right.edge[others])
        width = max(256, CELLS // int(b - a))
        for k in range(0, len(at), width):
            cols = at[k : k + width]
            yes = np.zeros((b - a, len(cols)), bool)
            known = sure[k : k + width]
            yes[:, known] = True
            rest = np.flatnonzero(~known)
            if len(rest):
                cosine = left.single[a:b] @ right.single[cols[rest]].T
                yes[:, rest] = cosine >= threshold
                i, j = np.nonzero(np.abs(cosine - threshold) <= MARGIN)
                if len(i):
                    yes[i, rest[j]] = (left.unit[a + i] * right.unit[cols[rest[j]]]).sum(axis=1) >= threshold
            if same:
                yes &= cols[None, :] > np.arange(a, b)[:, None]
            i, j = np.nonzero(yes)
            if not len(i):
                continue
            i, j = i + a, cols[j]
            links[: n] += np.bincount(i, right.copies[j], n).astype(np.int64)
            links[shift:] += np.bincount(j, left.copies[i], len(links) - shift).astype(np.int64)
            low = roots(len(links), np.concatenate((np.arange(len(links)), i)), np.concatenate((low, j + shift)))
    every = left.nodes if same else np.concatenate((left.nodes, right.nodes))
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(every[hit]), pa.array(links[hit]), pa.array(every[low[hit]])], names=["node", "links", "other"])


def compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, links, other) for each pair of blocks."""
    chord = float(np.sqrt(2 - 2 * threshold))

    def side(items, dim: int) -> Side:
        s = items.values
        return Side(s.field("node").to_numpy(), s.field("copies").to_numpy(), unit_rows(s.field("v"), dim), chord)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, same = batch.column("dim")[k].as_py(), batch.column("same")[k].as_py()
                left = side(batch.column("x")[k], dim)
                yield traverse(left, left if same else side(batch.column("y")[k], dim), same, threshold)

    return pairs.select("dim", "same", "x", "y").mapInArrow(run, FOUND)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding)."""
    chord = float(np.sqrt(2 - 2 * threshold))
    known = kept(usable(rows), "vectors")
    valid = known.where("node is not null")
    classes = valid.groupBy("node").agg(F.count("*").alias("copies"), F.first("v").alias("v"), F.min("vec_id").alias("least"))
    classes = kept(classes.withColumn("dim", F.size("v")), "classes")
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for dim, n in counts.items():
        some = bounded(classes.where(F.col("dim") == dim), "node", SAMPLE).select("node", "v").orderBy("node").limit(SAMPLE)
        unit = unit_rows(pa.array([r["v"] for r in some.collect()] or [[1.0] * dim], pa.list_(pa.float64())), dim)
        chosen, radii = nets(unit, min(PIVOTS, max(1, -(-n // BLOCK))), chord / 2)
        pivots[dim] = unit[chosen]
    placed = kept(cells(classes.select("node", "copies", "v", "dim"), pivots), "cells")
    found = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    radius = {(r["dim"], r["cell"]): (r["radius"] + 1e-9, -(-r["n"] // BLOCK)) for r in found}
    close = []  # at most PIVOTS nodes for each length of vectors
    for dim, p in pivots.items():
        apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
        mine = sorted(c for d, c in radius if d == dim)
        close += [(dim, a, b) for a in mine for b in mine if a <= b and (a == b or apart[a, b] <= radius[dim, a][0] + radius[dim, b][0] + chord)]
    spark = rows.sparkSession
    blocks = spark.createDataFrame([(d, c, n) for (d, c), (_, n) in radius.items()], "dim int, cell int, blocks int")
    block = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int").alias("block")
    item = F.struct("node", "copies", "v").alias("item")
    dealt = placed.join(F.broadcast(blocks), ["dim", "cell"]).select("dim", "cell", block, item)
    dealt = kept(dealt.groupBy("dim", "cell", "block").agg(F.collect_list("item").alias("items")), "blocks")  # about BLOCK each

    x, y = (dealt.select("dim", F.col("cell").alias(f"c{n}"), F.col("block").alias(f"b{n}"), F.col("items").alias(n)) for n in ("x", "y"))
    near = spark.createDataFrame(close, "dim int, cx int, cy int")
    pairs = x.join(F.broadcast(near), ["dim", "cx"]).join(y, ["dim", "cy"]).where("cx < cy or bx <= by")
    same = ((F.col("cx") == F.col("cy")) & (F.col("bx") == F.col("by"))).alias("same")
    pairs = pairs.select("dim", same, "x", F.when(~same, F.col("y")).alias("y"))
    links = kept(compared(pairs, threshold), "pairs")

    joined = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = classes.select("node", "copies", "least").join(total, "node", "left").join(joined, "node", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "node"))
    of_class = of_class.join(of_class.groupBy("component").agg(F.min("least").alias("first")), "component")
    out = known.select("vec_id", "node").join(of_class, "node", "left")
    n = F.when(F.col("node").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
