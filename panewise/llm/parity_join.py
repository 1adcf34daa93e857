"""Jaccard self-join of shingle sets by parity sketches.

A document's sketch of P words is the exclusive or of 64-bit hashes: each shingle is added, by
parity, to the word its hash picks. A shingle that two documents do not share changes one word,
so the number of differing words is at most the size of the symmetric difference, and that is at
most (a + b) / 7 for sets of sizes a and b of similarity 3/4. Sizes fall into bands between
powers of two; a band's sketches have as many words as its least size (64 at least), and a
document that may have partners in the band below is also sketched for that band.

Pigeonhole: if at most d words differ, d + 1 words of a document, taken in an order that both
documents share, meet d + 1 words of the other. The order puts words of frequent shingles last:
counts of all shingles of all documents, in a table of 2**20 counters, decide. Words without a
shingle come last of all, so they are used only where a small document has no others.

Candidates are verified on the texts. Documents of the same shingle set are one class and one node.
The nodes that share a sketch word are linked to the least of them, their centre; all that meet at
a centre are its star. First each node is tested against its most frequent centre, which joins
copies into components. Then, in stars that hold several components, pairs of nodes of different
components are held against two bounds, the sizes and the Hamming distance of parity sketches of
SKETCH_BITS bits, one bit for each shingle. In rounds, each node's nearest partner is verified and
components merge, as long as that finds links; last, all pairs that are left are verified. Large
stars are dealt in pairs of blocks. So no link between components is lost, and copies are not
compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import binary, finished, if_few, kept, lean, texts
from .components import components

WIDTH = 5
#: Similarity of 75 of 100 or more.
SHARE = 75
COUNTERS, CHUNK = 1 << 20, 1 << 10
LEAST_WORDS = 64
#: Sketch words in one part of the exchange; a part is sorted in memory.
PART_ENTRIES = 1 << 18
#: Sketch words, and class signatures, that a task holds before it passes them on.
FLUSH, SEEN = 1 << 18, 1 << 18

FACTS = "doc_id long, text_hash long, n long, sig long, chunk int, counts binary"
ENTRIES = "part int, keys binary, owners binary"
FOUND = "a long, b long, n long"
#: Bits of the sketches that verification is spared by; nodes of a star in one block.
SKETCH_BITS, BLOCK = 2048, 2048


def sets_of(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: text and hash of each distinct shingle, set sizes and 64-bit set signatures."""
    owner, value = chars.shingles(*chars.word_table(cp, starts, "unspaced"), WIDTH)
    n = np.bincount(owner, minlength=len(starts) - 1)
    sig = np.zeros(len(n), np.uint64)
    full = n > 0
    if len(value):
        first = np.searchsorted(owner, np.flatnonzero(full))
        sig[full] = np.add.reduceat(chars.mixed(value), first)
    return owner, value, n, chars.mixed(sig + n.astype(np.uint64))


def most_different(n: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """The largest symmetric difference with a partner of at most that size: J >= s is
    I >= s / (1 + s) * (a + b), so it is at most (1 - s) / (1 + s) * (a + b)."""
    return (100 - SHARE) * (n + partner) // (100 + SHARE)


def sketch_words(owner, value, n, words, depth, band, rank) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the first depth + 1 words of each document's sketch; words, depth and
    band by document. Documents of no words are left out."""
    use = (words > 0)[owner]
    owner, value = owner[use], value[use]
    place = (value >> np.uint64(20)) & (words[owner] - 1).astype(np.uint64)
    cell = owner.astype(np.uint64) << np.uint64(40) | place
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    xor = np.bitwise_xor.reduceat(chars.mixed(value + np.uint64(7)), first)
    rare = np.minimum.reduceat(rank[(value >> np.uint64(44)).astype(np.int64)], first)
    doc = (cell[first] >> np.uint64(40)).astype(np.int64)
    place = cell[first] & np.uint64((1 << 40) - 1)
    filled = np.bincount(doc, minlength=len(n))
    short = np.flatnonzero((words > 0) & (filled <= depth))
    if len(short):  # add the empty words, which come last
        more = [(d, p) for d in short.tolist() for p in sorted(set(range(int(words[d]))) - set(place[doc == d].tolist()))]
        doc = np.concatenate((doc, np.array([d for d, _ in more], np.int64)))
        place = np.concatenate((place, np.array([p for _, p in more], np.uint64)))
        xor = np.concatenate((xor, np.zeros(len(more), np.uint64)))
        rare = np.concatenate((rare, np.full(len(more), 255, rare.dtype)))
    key = chars.mixed(xor ^ chars.mixed(band[doc].astype(np.uint64) << np.uint64(40) | place))
    order = np.lexsort((key, rare, doc))
    doc, key = doc[order], key[order]
    begin = np.searchsorted(doc, np.arange(len(n)))
    within = np.arange(len(doc)) - begin[doc] <= depth[doc]
    return doc[within], key[within]


def entries_of(owner, value, n, rank) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) in a document's own band and, where it may have smaller partners, below."""
    size = np.maximum(n, 1)
    band = np.floor(np.log2(size)).astype(np.int64)
    band -= (1 << band) > size
    band += (2 << band) <= size
    low = np.int64(1) << band
    own = np.where(n > 0, np.maximum(low, LEAST_WORDS), 0)
    below = np.where((n > 1) & (SHARE * n < 100 * low), np.maximum(low >> 1, LEAST_WORDS), 0)
    d1, k1 = sketch_words(owner, value, n, own, most_different(n, 100 * n // SHARE), band, rank)
    d2, k2 = sketch_words(owner, value, n, below, most_different(n, np.minimum(n, low - 1)), band - 1, rank)
    return np.concatenate((d1, d2)), np.concatenate((k1, k2))


def facts(docs: DataFrame) -> DataFrame:
    """Set size and signature of each document, and each task's shingle counters in chunks."""

    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for low, high, cp, starts in chars.blocks(texts(batch)):
                _, value, n, sig = sets_of(cp, starts)
                np.add(counts, np.bincount((value >> np.uint64(44)).astype(np.int64), minlength=COUNTERS), out=counts, casting="unsafe")
                none = pa.nulls(high - low, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids[low:high], hashes[low:high], pa.array(n, pa.int64()), pa.array(sig.view(np.int64)), none, pa.nulls(high - low, pa.binary())],
                    names=names,
                )
        for k in range(0, COUNTERS, 64 * CHUNK):
            parts = [counts[c : c + CHUNK] for c in range(k, k + 64 * CHUNK, CHUNK)]
            none = pa.nulls(64, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(range(k // CHUNK, k // CHUNK + 64), pa.int32()), binary([p.tobytes() for p in parts])],
                names=names,
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(run), FACTS)


def ranks(known: DataFrame) -> np.ndarray:
    """For each counter, the order of its shingles: the logarithm of their count, eight steps to
    an octave. 2**20 bytes at any size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[c] = total.get(c, 0) + np.frombuffer(data, np.uint32).astype(np.uint64)
        for c, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), binary([np.minimum(255, 8 * np.log2(1 + sums / 16)).astype(np.uint8).tobytes()])], names=["chunk", "ranks"])

    rows = known.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(lean(add), "chunk int, ranks binary").collect()
    out = np.zeros(COUNTERS, np.uint8)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["ranks"], np.uint8)
    return out


def sketched(docs: DataFrame, rank: np.ndarray, parts: int) -> DataFrame:
    """Sketch words of every class in each task, packed by part of the exchange."""
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = sent.value, set()
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            key, own = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            part = (key // np.uint64((1 << 64) // parts + 1)).astype(np.int64)  # a range of keys
            rows: tuple[list, ...] = ([], [], [])
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for row, x in zip(rows, (int(part[s]), key[s:e].tobytes(), own[s:e].tobytes()), strict=True):
                    row.append(x)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *map(binary, rows[1:])], names=["part", "keys", "owners"])

        for batch in batches:
            for _, _, cp, starts in chars.blocks(texts(batch)):
                owner, value, n, sig = sets_of(cp, starts)
                fresh = np.zeros(len(n), bool)
                for k, s in enumerate(sig.tolist()):  # one copy of a class from each task is enough
                    if n[k] and s not in seen:
                        fresh[k] = True
                        seen.add(s)
                if len(seen) > SEEN:
                    seen.clear()
                use = fresh[owner]
                doc, key = entries_of(owner[use], value[use], np.where(fresh, n, 0), rank)
                keys.append(key)
                owners.append(sig[doc])
                held += len(key)
                if held >= FLUSH:
                    yield packed()
                    keys, owners, held = [], [], 0
        if held:
            yield packed()

    return docs.select("text").where("text is not null").mapInArrow(lean(run), ENTRIES)


def met(key: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Of one part: each key's least member with each other one, as (a, b, keys in common)."""
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
    key, own = key[fresh], own[fresh]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    rest = np.ones(len(own), bool)
    rest[edge[:-1]] = False
    a, b = own[edge[:-1]][group[rest]], own[rest]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
    return [a[at], b[at], np.diff(np.append(at, len(a)))]


def matched(entries: DataFrame) -> DataFrame:
    """Candidates: a centre, a node of its star, and the sketch words of a part they share."""

    def rows(key, own) -> pa.RecordBatch:
        a, b, n = met(np.concatenate(key), np.concatenate(own))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n, pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, own = None, [], []
        for batch in batches:
            for part, k, o in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "owners")), strict=True):
                if part != now and key:
                    yield rows(key, own)
                    key, own = [], []
                now = part
                key.append(np.frombuffer(k, np.uint64))
                own.append(np.frombuffer(o, np.uint64))
        if key:
            yield rows(key, own)

    return entries.repartition("part").sortWithinPartitions("part").mapInArrow(lean(run), FOUND)


def similar(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, by the texts of bodies (sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [t for pair in zip(texts(batch, "x"), texts(batch, "y"), strict=True) for t in pair]
            good = np.zeros(batch.num_rows, bool)
            odd: tuple | None = None
            for low, high, cp, starts in chars.blocks(both):
                owner, value, n, _ = sets_of(cp, starts)
                owner = owner + low
                if odd is not None:  # the block began inside a pair
                    owner, value = np.concatenate((odd[0], owner)), np.concatenate((odd[1], value))
                odd = None
                if high % 2:
                    last = owner == high - 1
                    odd = owner[last], value[last]
                    owner, value = owner[~last], value[~last]
                if not len(owner):
                    continue
                pair = owner // 2
                order = np.lexsort((value, pair))
                p, v = pair[order], value[order]
                common = np.bincount(p[1:][(p[1:] == p[:-1]) & (v[1:] == v[:-1])], minlength=batch.num_rows)
                total = np.bincount(p, minlength=batch.num_rows)
                good |= (total > 0) & (100 * common >= SHARE * (total - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    # written first: Spark then knows how small they are, and few pairs do not move all texts
    pairs = kept(pairs.select("a", "b"), "candidates")
    nodes = kept(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "candidate-nodes")
    needed = kept(bodies.join(if_few(nodes), "sig", "left_semi"), "candidate-bodies")
    x, y = (needed.select(F.col("sig").alias(e), F.col("text").alias(t)) for e, t in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").mapInArrow(lean(run), "a long, b long")


def bodies_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, text) of one document for each node. A document's signature is computed again, so
    repeated and null ids do not bring a wrong text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("sig").to_numpy()
            for low, high, cp, starts in chars.blocks(texts(batch)):
                sig = sets_of(cp, starts)[3].view(np.int64)
                good = pa.array(sig == wanted[low:high])
                yield pa.RecordBatch.from_arrays([batch.column(c)[low:high].filter(good) for c in ("sig", "text")], names=["sig", "text"])

    wanted = kept(classes.join(nodes, "sig", "left_semi").select("sig", F.col("doc_id").alias("wanted")), "wanted")
    found = docs.select("doc_id", "text").join(if_few(wanted), F.col("doc_id").eqNullSafe(F.col("wanted")))
    return found.select("sig", "text").mapInArrow(lean(run), "sig long, text string").dropDuplicates(["sig"])


def parity_sketches(bodies: DataFrame) -> DataFrame:
    """(node, n, sketch): set size and the parities of the shingles' bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, cp, starts in chars.blocks(texts(batch), 1 << 16):
                owner, value, n, _ = sets_of(cp, starts)
                bit = owner * SKETCH_BITS + (chars.mixed(value + np.uint64(3)) % np.uint64(SKETCH_BITS)).astype(np.int64)
                odd = np.packbits((np.bincount(bit, minlength=SKETCH_BITS * len(n)) & 1).astype(bool).reshape(len(n), -1), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("sig")[low:high], pa.array(n, pa.int64()), binary([x.tobytes() for x in odd])], names=["node", "n", "sketch"])

    return bodies.select("sig", "text").mapInArrow(lean(run), "node long, n long, sketch binary")


def may_link(left: tuple, right: tuple, same: bool, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of two blocks (components, sizes, sketches) that are in different
    components and within both bounds; of each left one all, or the nearest only."""
    (c1, n1, s1), (c2, n2, s2) = left, right
    out = []
    order = np.argsort(n2, kind="stable")
    sizes = n2[order]
    for i in range(len(n1)):
        low, high = np.searchsorted(sizes, [-(-SHARE * n1[i] // 100), 100 * n1[i] // SHARE + 1])
        at = order[low:high]
        at = at[c2[at] != c1[i]]
        if same and not nearest:
            at = at[at > i]
        if len(at):
            apart = np.bitwise_count(s2[at] ^ s1[i]).sum(axis=1)
            good = apart <= most_different(n2[at], n1[i])
            at = at[good]
            if nearest and len(at):
                at = at[[int(np.argmin(apart[good]))]]
            out.append((np.full(len(at), i), at))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def between_components(stars: DataFrame, sketches: DataFrame, nearest: bool) -> DataFrame:
    """(a, b) of the stars' nodes (star, node, component) that may link; all, or each node's
    nearest one."""
    sizes = stars.groupBy("star").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = sizes.where("low < high").select("star", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = kept(stars.join(mixed, "star"), "mixed").join(sketches, "node").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("blocks", "other")

    def pairs(rows: list[dict]) -> pa.RecordBatch:
        first, last = rows[0]["x"], rows[0]["y"]

        def block(which: int):
            mine = [r for r in rows if r["own"] == which]
            sketch = np.frombuffer(b"".join(r["sketch"] for r in mine), np.uint64).reshape(len(mine), -1)
            return np.array([r["node"] for r in mine], np.int64), (np.array([r["component"] for r in mine], np.int64), np.array([r["n"] for r in mine], np.int64), sketch)

        ids1, left = block(first)
        ids2, right = block(last)
        i, j = may_link(left, right, first == last, nearest)
        a, b = ids1[i], ids2[j]
        if nearest and first != last:
            j, i = may_link(right, left, False, True)
            a, b = np.concatenate((a, ids1[i])), np.concatenate((b, ids2[j]))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = r["star"], r["x"], r["y"]
                if key != now and rows:
                    yield pairs(rows)
                    rows = []
                now = key
                rows.append(r)
        if rows:
            yield pairs(rows)

    keys = ["star", "x", "y"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "a long, b long").distinct()


def classes_and_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and text_hash of every row of (doc_id, text).

    Words are runs of characters other than white space, A-Z lower-cased; the set is the distinct
    runs of five words. Cases: a null text, or one without words, has size 0 and no links, its
    component is its own id; fewer than five words count as one shingle. Rows of equal texts, or
    of one id, are linked by their texts alone. A null id stays null; a component of null ids only
    is null. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = kept(facts(docs), "facts")
    rows = known.where("chunk is null")
    total = rows.agg(F.sum("n")).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, -(-total // (2 * PART_ENTRIES)))
    found = matched(sketched(docs, ranks(known), parts))
    pairs = kept(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    classes = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    bodies = kept(bodies_of(docs, classes, nodes), "bodies")

    first = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    links = kept(similar(first, bodies), "links")
    joined = kept(components(links), "components")
    stars = pairs.select(F.col("a").alias("star"), F.col("b").alias("node"))
    stars = stars.union(stars.select("star", F.col("star").alias("node")).distinct())
    stars = kept(stars, "stars")
    sketches = kept(parity_sketches(bodies), "sketches")

    def more(nearest: bool) -> DataFrame:
        now = stars.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return kept(similar(between_components(now, sketches, nearest), bodies), "more")

    for nearest in (True, False):
        while not (new := more(nearest)).isEmpty():
            links = kept(links.union(new), "links")
            joined = kept(components(links), "components")
            if not nearest:
                break

    least = classes.join(joined, classes["sig"] == joined["node"]).groupBy("component").agg(F.min("doc_id").alias("least"))
    of_class = classes.join(joined, classes["sig"] == joined["node"], "left").join(least, "component", "left")
    of_class = of_class.select("sig", F.coalesce("least", classes["doc_id"]).alias("least"))
    out = rows.select("doc_id", "text_hash", "n", "sig").join(of_class, "sig", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash")


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the least id, with its columns. Documents
    without words stay. Of repeated rows of that id the least hash of the text stays, and of equal
    rows one; a component of null ids only keeps the least hash of the text."""
    rows = finished(docs.sparkSession, lambda: classes_and_components(docs), "components")
    worded = rows.where("n_shingles > 0").groupBy("component_id")
    first = worded.agg(F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("first_id"), F.col("x.text_hash").alias("first_hash"))
    copies = rows.where("n_shingles > 0").groupBy("doc_id", "text_hash").count()
    same = copies["doc_id"].eqNullSafe(first["first_id"]) & (copies["text_hash"] == first["first_hash"])
    marked = copies.join(first, same, "left").where("first_hash is null or count > 1")
    marked = marked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("first_hash").isNotNull().alias("_stays"))
    marked = if_few(kept(marked, "marked"))
    text = F.xxhash64(docs["text"])
    clean = docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]) & (text == marked["_hash"]), "left_anti")
    repeated = marked.where("_stays")
    if repeated.isEmpty():
        return clean
    again = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["_id"]) & (text == repeated["_hash"]), "left_semi")
    return clean.union(again.dropDuplicates(["doc_id", "text"]))
