"""Hard negatives by blocks of vectors in Hilbert order with zone maps.

Vectors are rounded to integers and sorted by length, label and their place on a Hilbert curve, over
the leading directions of a bounded sample; neighbours on the curve are neighbours in space. Each
run of BLOCK vectors of one label is a row of a Parquet table: its vectors, its ids, and its zone
map, the least and greatest value of every dimension. By interval arithmetic a zone map gives a
lower and an upper bound of the inner product of an anchor with any vector of the block.

An anchor's positives are its best vectors of the same label. Those in its own block give a score
that the last positive has at least; blocks whose upper bound is below are not read. Each positive
then opens a window of scores in which its negatives lie, and a block of another label is read
only if its bounds meet one of the anchor's windows. What is read is multiplied out exactly.

Both searches run in two steps. First the zone maps, dealt in pages, meet all anchors; the result
is a bit for every block of a segment that an anchor must read. Then anchors are sent to the
segments they need, where the blocks of one segment are held in memory and anchors stream past.
Only each anchor's best rows of a window leave the task. So no task holds a label, the work of a
segment is bounded by the number of anchors, and zone maps are never broadcast.

Cases: rows with a null id, label or vector, an empty vector, or a component that is null or not
finite take no part, nor do those whose products no long could hold; vectors of different lengths
have no product. Repeated ids are rows of their own; equal scores are ordered by id. An anchor
without another row of its label, or without a row in a window, gives no rows for it. Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, bounded, kept

#: Vectors are rounded down to multiples of 1 / SCALE.
SCALE = 256
#: Rows and bytes of a block, blocks of a segment, zone maps of a page.
BLOCK_BITS, BLOCK_BYTES, SEGMENT_BITS, PAGE = 10, 1 << 20, 4, 1024
BLOCK, SEGMENT = 1 << BLOCK_BITS, 1 << SEGMENT_BITS
#: Rows that the curve's directions come from; directions, and bits of each.
SAMPLE, DIRECTIONS, BITS = 4096, 8, 8
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
LEAST, GREATEST = -(1 << 62), 1 << 62

KEYED = "dim int, label string, place long, vec_id long, q binary"
BLOCKS = "block long, dim int, label string, low binary, high binary, ids binary, q binary"
ANCHORS = "anchor long, anchor_id long, dim int, label string, q binary, lows array<long>, highs array<long>"
NEEDED = "segment long, bits int, anchor long, dim int, q binary, lows array<long>, highs array<long>"
FOUND = "anchor long, nth int, vec_id long, score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (values below 2**bits; 64 bits in all)."""
    x = [cells[:, k].astype(np.uint64) for k in range(cells.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        below = np.uint64((1 << b) - 1)
        for k in range(len(x)):
            turned = (x[k] >> np.uint64(b)) & one == 1
            swap = np.where(turned, 0, (x[0] ^ x[k]) & below).astype(np.uint64)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one == 1, np.uint64((1 << b) - 1), np.uint64(0))
    place = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for k in range(len(x)):
            place = place << one | ((x[k] ^ flip) >> np.uint64(b)) & one
    return place


def directions(sample: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vector: leading principal directions, least value and width of a cell."""
    by_size = defaultdict(list)
    for v in sample:
        by_size[len(v)].append(v)
    out = {}
    for size, rows in by_size.items():
        x = np.array(rows, np.float64)
        x /= max(1.0, np.abs(x).max())
        axes = np.eye(size)[:, :DIRECTIONS]
        if len(x) > size:
            axes = np.linalg.eigh(np.cov(x.T).reshape(size, size))[1][:, ::-1][:, :DIRECTIONS]
        z = np.array(rows, np.float64) @ axes
        out[size] = axes, z.min(axis=0), np.maximum(np.ptp(z, axis=0), 1e-9) / (1 << BITS)
    return out


def places(q: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Signed, so that the order of the longs is that of the curve."""
    size = q.shape[1]
    axes, low, width = known.get(size, (np.eye(size)[:, :DIRECTIONS], np.float64(-SCALE), np.float64(2 * SCALE / (1 << BITS))))
    cells = np.clip((q @ axes - low) / width, 0, (1 << BITS) - 1).astype(np.int64)
    return (hilbert(cells, BITS) ^ np.uint64(1 << 63)).view(np.int64)


def integers(column: pa.Array) -> list[np.ndarray]:
    """The rounded vectors of a column, one array for each."""
    ends = column.offsets.to_numpy()
    values = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def holds(v: np.ndarray) -> bool:
    """Whether products of such vectors fit a long, and components an int."""
    most = float(np.abs(v).max())
    return most < 1 << 31 and len(v) * most * most < LEAST * -1.0


def _usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = vectors.where(named & (F.size("embedding") > 0) & finite)
    return rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def blocks_of(vectors: DataFrame) -> DataFrame:
    """The written table of blocks of (vec_id, label, embedding). A block's number orders it in its
    part of the curve; SEGMENT numbers make a segment."""
    rows = _usable(vectors)
    some = (np.floor(SCALE * np.array(r[0])) for r in bounded(rows, "vec_id", SAMPLE).select("embedding").collect())
    known = directions([v for v in some if holds(v)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_size = defaultdict(list)
            for k, v in enumerate(integers(batch.column("embedding"))):
                if holds(v):
                    of_size[len(v)].append((k, v))
            for size, mine in of_size.items():
                q = np.array([v for _, v in mine])
                rows = pa.array([k for k, _ in mine])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(mine), pa.int32()), batch.column("label").take(rows), pa.array(places(q, known)), batch.column("vec_id").take(rows),
                     binary([v.tobytes() for v in q.astype(np.int32)])],
                    names=[x.split()[0] for x in KEYED.split(", ")],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 31
        now, ids, q = None, [], []

        def block() -> pa.RecordBatch:
            nonlocal number, ids, q
            rows = np.frombuffer(b"".join(q), np.int32).reshape(len(q), now[0])
            keys = np.array(ids, np.int64)
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[order], keys[order]
            low, high = rows.min(axis=0), rows.max(axis=0)
            small = np.int16 if low.min() >= -(1 << 15) and high.max() < 1 << 15 else np.int32
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.string()), *(binary([x.tobytes()]) for x in (low, high, keys, rows.astype(small)))],
                names=[x.split()[0] for x in BLOCKS.split(", ")],
            )
            number, ids, q = number + 1, [], []
            return out

        for batch in batches:
            for dim, label, key, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "label", "vec_id", "q")), strict=True):
                if ids and ((dim, label) != now or len(ids) == max(16, min(BLOCK, BLOCK_BYTES // (4 * dim)))):
                    yield block()
                now = dim, label
                ids.append(key)
                q.append(data)
        if ids:
            yield block()

    order = ["dim", "label", "place", "vec_id"]
    placed = rows.mapInArrow(keyed, KEYED).repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(placed.mapInArrow(cut, BLOCKS), "zone-blocks")


def vectors_in(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * n * dim else np.int32
    return np.frombuffer(data, kind).reshape(n, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: in double precision while their size allows it."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def longs(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int64()))


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """The vectors whose id every divides, with the score that their last positive has at least.
    Their number is that of the row: block and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                rows = vectors_in(r["q"], len(ids), r["dim"])
                lows = np.full(len(at), LEAST)
                if len(ids) > POSITIVES:
                    score = products(rows[at], rows)
                    score[np.arange(len(at)), at] = LEAST
                    lows = np.partition(score, len(ids) - POSITIVES, axis=1)[:, len(ids) - POSITIVES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((r["block"] << BLOCK_BITS) + at), pa.array(ids[at]), pa.array([r["dim"]] * len(at), pa.int32()), pa.array([r["label"]] * len(at), pa.string()),
                     binary([x.tobytes() for x in rows[at].astype(np.int32)]), longs([[x] for x in lows.tolist()]), longs([[GREATEST]] * len(at))],
                    names=[x.split()[0] for x in ANCHORS.split(", ")],
                )

    return blocks.select("block", "dim", "label", "ids", "q").mapInArrow(run, ANCHORS)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each row of a with any vector between low and high, row by
    row of these; widened by what double precision may lose."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    least = plus @ low.T + minus @ high.T
    most = plus @ high.T + minus @ low.T
    return least - 1 - np.abs(least) * 1e-12, most + 1 + np.abs(most) * 1e-12


def needed(anchors: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """For each anchor and segment, a bit for each of its blocks, of the anchor's label or of other
    labels, whose bounds meet one of the anchor's windows (lows and highs)."""
    zones = blocks.select("block", "dim", "label", "low", "high")
    pages = max(1, -(-zones.count() // PAGE))
    page = F.pmod(F.xxhash64(F.shiftright("block", SEGMENT_BITS)), F.lit(pages)).cast("int")
    zones = zones.withColumn("page", page)
    spread = anchors.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    both = zones.unionByName(spread, allowMissingColumns=True).withColumn("late", F.col("anchor").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], {}
        for batch in batches:
            of_page = batch.column("page").to_numpy()
            late = batch.column("late").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((of_page[1:] != of_page[:-1]) | (late[1:] != late[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if of_page[a] != now:
                    now, held, ready = int(of_page[a]), [], {}
                if not late[a]:
                    held += part.select(["block", "dim", "label", "low", "high"]).to_pylist()
                    continue
                for dim in set(part.column("dim").to_pylist()):
                    if dim not in ready:
                        mine = sorted((z for z in held if z["dim"] == dim), key=lambda z: z["block"])
                        ready[dim] = np.array([z["block"] for z in mine], np.int64), [z["label"] for z in mine], *(
                            np.array([np.frombuffer(z[c], np.int32) for z in mine], np.float64) for c in ("low", "high")
                        )
                    if len(ready[dim][0]):
                        yield from meet(part.filter(pa.array(part.column("dim").to_numpy() == dim)), dim, *ready[dim])

    def meet(part: pa.RecordBatch, dim: int, block, label, low, high) -> Iterator[pa.RecordBatch]:
        names, code = np.unique(np.array(label + part.column("label").to_pylist()), return_inverse=True)
        zone_label, anchor_label = code[: len(label)], code[len(label) :]
        segment = block // SEGMENT
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        weight = np.int64(1) << (block % SEGMENT)
        step = max(1, (1 << 21) // len(block))
        for s in range(0, part.num_rows, step):
            rows = part.slice(s, step)
            a = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int32).reshape(rows.num_rows, dim).astype(np.float64)
            least, most = bounds(a, low, high)
            wanted = (anchor_label[s : s + step, None] == zone_label[None]) == same
            meets = np.zeros_like(wanted)
            for lows, highs in windows(rows):
                meets |= (most >= lows[:, None]) & (least <= highs[:, None])
            bits = np.add.reduceat((wanted & meets) * weight, first, axis=1)
            r, c = np.nonzero(bits)
            chosen = rows.take(pa.array(r))
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment[first][c]), pa.array(bits[r, c].astype(np.int32)), *(chosen.column(x) for x in ("anchor", "dim", "q", "lows", "highs"))],
                names=[x.split()[0] for x in NEEDED.split(", ")],
            )

    return both.repartition("page").sortWithinPartitions("page", "late").mapInArrow(run, NEEDED)


def windows(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lows, highs) of the first window of each row, of the second and so on; missing ones are empty."""
    sides = [rows.column(c).to_pylist() for c in ("lows", "highs")]
    for k in range(max(map(len, sides[0]), default=0)):
        yield tuple(np.array([x[k] if k < len(x) else none for x in side], np.int64) for side, none in zip(sides, (GREATEST, LEAST), strict=True))


def best(anchors: DataFrame, blocks: DataFrame, same: bool, most: int) -> DataFrame:
    """(anchor, nth, vec_id, score, place): the first rows of every window of every anchor, by
    score and then id."""
    wanted = needed(anchors, blocks, same).withColumn("late", F.lit(True))
    bodies = blocks.select("block", "dim", "ids", "q", F.shiftright("block", SEGMENT_BITS).alias("segment"), F.lit(False).alias("late"))
    both = wanted.unionByName(bodies, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            of_segment = batch.column("segment").to_numpy()
            late = batch.column("late").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((of_segment[1:] != of_segment[:-1]) | (late[1:] != late[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if of_segment[a] != now:
                    now, held = int(of_segment[a]), []
                if late[a]:
                    yield from multiplied(part, held)
                else:
                    held += part.select(["block", "dim", "ids", "q"]).to_pylist()

    def multiplied(part: pa.RecordBatch, held: list[dict]) -> Iterator[pa.RecordBatch]:
        bits, anchor = part.column("bits").to_numpy(), part.column("anchor").to_numpy()
        for z in held:
            mine = np.flatnonzero(bits >> (z["block"] % SEGMENT) & 1)
            keys = np.frombuffer(z["ids"], np.int64)
            body = vectors_in(z["q"], len(keys), z["dim"])
            for s in range(0, len(mine), BLOCK):
                at = mine[s : s + BLOCK]
                rows = part.take(pa.array(at))
                a = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int32).reshape(len(at), z["dim"])
                score = products(a, body)
                if same:  # an anchor is no positive of itself
                    own = np.flatnonzero(anchor[at] >> BLOCK_BITS == z["block"])
                    score[own, anchor[at[own]] & (BLOCK - 1)] = -GREATEST - 1
                for k, (lows, highs) in enumerate(windows(rows)):
                    r, c = np.nonzero((score >= lows[:, None]) & (score <= highs[:, None]))
                    value = score[r, c]
                    order = np.lexsort((c, -value, r))  # ids rise with the place in the block
                    r, c, value = r[order], c[order], value[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c, value = (x[rank < most] for x in (r, c, value))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[at][r]), pa.array(np.full(len(r), k, np.int32)), pa.array(keys[c]), pa.array(value)],
                        names=[x.split()[0] for x in FOUND.split(", ")],
                    )

    found = both.repartition("segment").sortWithinPartitions("segment", "late", "block").mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every row of
    (vec_id, label, embedding) whose id every divides."""
    blocks = blocks_of(vectors)
    anchors = kept(anchors_of(blocks, every), "zone-anchors")
    positives = kept(best(anchors, blocks, True, POSITIVES), "zone-positives")
    # a window needs 0.8 * p <= n <= p, which no n meets for p < 0
    window = F.struct("place", F.expr("score - score div 5").alias("low"), F.col("score").alias("high"))
    opened = positives.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("w"))
    opened = opened.select("anchor", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    windowed = kept(anchors.drop("lows", "highs").join(opened, "anchor"), "zone-windows")
    found = best(windowed, blocks, False, NEGATIVES)
    found = found.select("anchor", (F.col("nth") + 1).alias("nth"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("anchor", F.col("place").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(of, ["anchor", "nth"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

