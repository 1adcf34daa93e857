"""Quality scores by a generalised additive model with pairwise interactions.

Features of a text are counts and shares of its characters, words and lines. Each feature has a
table over its quantile bins, and some pairs of features have a table over coarser bins. Fitting
boosts in cycles: one feature after the other takes a shallow tree (at most three cuts over its
bins) fitted to the current residuals, at a small rate; then the pairs that reduce the loss most
take trees of one cut in each of the two features. The trees add up in the tables, so a score is
the logistic of a sum of table entries, looked up for whole blocks of texts.

Fitting takes at most about ROWS labelled rows (a bound, spread by a hash of doc_id); every text is
scored whole. Cases: a null text counts as empty and is scored by the bins of zeros. Null labels
are not used; repeated labels of a document count each. With no label at all every score is 0.5.
Repeated rows and null ids are kept; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import bounded, texts

ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 60, 40, 0.15, 1.0
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "blank", "symbols", "stops", "bars", "marked_words",
    "distinct_words", "repeats_next", "top_word", "line_length", "short_lines", "non_ascii", "distinct_letters",
)


def _per(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.maximum(n, 1)


def features(batch: list[str | None]) -> Iterator[np.ndarray]:
    """A row of numbers for each text, block by block."""
    for low, high, cp, starts in chars.blocks(batch):
        k = high - low
        n = np.diff(starts) - 1
        kind = chars.table("class")[cp]
        ends = starts[1:] - 1

        def count(flag, starts=starts, ends=ends):
            total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
            return total[ends] - total[starts[:-1]]

        letters = count(kind == 1)
        upper = count((cp >= 65) & (cp <= 90) | (cp >= 0xC0) & (cp <= 0xDE))
        symbol = (kind == 4) & (cp != 0x2E) & (cp != 0x2C)
        s, e = chars.spans(chars.table("unspaced")[cp])
        h = chars.span_hashes(chars.lowered(cp), s, e)
        first = np.searchsorted(s, starts)
        words = np.diff(first)
        owner = np.repeat(np.arange(k), words)
        order = np.lexsort((h, owner))
        oo, hh = owner[order], h[order]
        edge = np.flatnonzero(np.concatenate(([True], (oo[1:] != oo[:-1]) | (hh[1:] != hh[:-1])))) if len(oo) else np.empty(0, np.int64)
        distinct = np.bincount(oo[edge], minlength=k)
        top = np.zeros(k)
        np.maximum.at(top, oo[edge], np.diff(np.append(edge, len(oo))))
        again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=k)
        odd_end = np.bincount(owner[symbol[e - 1]], minlength=k)
        ls, le = chars.spans((cp != 0x0A) & (cp != chars.SENTINEL))
        lo = chars.owners(starts, ls)
        lines = np.bincount(lo, minlength=k)
        short = np.bincount(lo[le - ls < 40], minlength=k)
        seen = np.unique(chars.owners(starts, np.flatnonzero(kind == 1)) << 8 | (cp[kind == 1] & 255).astype(np.int64)) >> 8
        alphabet = np.bincount(seen, minlength=k)
        yield np.column_stack((
            np.log1p(n), np.log1p(words), _per(n, words), _per(upper, letters), _per(count(kind == 2), n), _per(count(kind == 3), n),
            _per(count(symbol), n), _per(count((cp == 0x2E) | (cp == 0x21) | (cp == 0x3F)), words), _per(count(cp == 0x7C), words), _per(odd_end, words),
            _per(distinct, words), _per(again, words), _per(top, words), np.log1p(_per(n, lines)), _per(short, lines), _per(count(cp > 127), n), alphabet,
        ))


def _cuts(g: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """Values by bin of a tree of at most that many cuts, each the best of the leaf it splits."""
    leaves = [(0, len(g))]
    gain = lambda a, b: g[a:b].sum() ** 2 / (w[a:b].sum() + RIDGE)
    for _ in range(most):
        best = (1e-12, None, 0)
        for leaf in leaves:
            a, b = leaf
            if b - a < 2:
                continue
            left, lw = np.cumsum(g[a:b])[:-1], np.cumsum(w[a:b])[:-1]
            rest, rw = g[a:b].sum() - left, w[a:b].sum() - lw
            gains = left**2 / (lw + RIDGE) + rest**2 / (rw + RIDGE) - gain(a, b)
            i = int(np.argmax(gains))
            if gains[i] > best[0]:
                best = (gains[i], leaf, a + i + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (w[a:b].sum() + RIDGE)
    return out


def _quarters(g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree of one cut in each direction of a square of bins."""
    cg, cw = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, w))
    best, where = 0.0, None
    m = len(g)
    base = cg[m, m] ** 2 / (cw[m, m] + RIDGE)
    for i in range(1, m):
        for j in range(1, m):
            quads = [(cg[a, b] - cg[c, b] - cg[a, d] + cg[c, d], cw[a, b] - cw[c, b] - cw[a, d] + cw[c, d]) for c, a in ((0, i), (i, m)) for d, b in ((0, j), (j, m))]
            gain = sum(x * x / (y + RIDGE) for x, y in quads) - base
            if gain > best:
                best, where = gain, (i, j, [x / (y + RIDGE) for x, y in quads])
    out = np.zeros_like(g)
    if where:
        i, j, v = where
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.empty(0) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.start = float(np.log(mean / (1 - mean)))
        if len(y) and 0 < y.sum() < len(y):
            self.fit(self.binned(x), y)

    def binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]

    def coarse(self, b: np.ndarray, k: int) -> np.ndarray:
        return b * PAIR_BINS // len(self.tables[k])

    def fit(self, bins: list[np.ndarray], y: np.ndarray) -> None:
        f = np.full(len(y), self.start)

        def slopes():
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for k, b in enumerate(bins):
                g, w = slopes()
                m = len(self.tables[k])
                add = RATE * _cuts(np.bincount(b, g, m), np.bincount(b, w, m), 3)
                self.tables[k] += add
                f += add[b]
        coarse = [self.coarse(b, k) for k, b in enumerate(bins)]

        def square(i, j):
            g, w = slopes()
            cell = coarse[i] * PAIR_BINS + coarse[j]
            return [np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, w)]

        every = [(i, j) for i in range(len(bins)) for j in range(i)]
        chosen = sorted(every, key=lambda ij: (-_quarters(*square(*ij))[0], ij))[:PAIRS]
        self.pairs = {ij: np.zeros((PAIR_BINS, PAIR_BINS)) for ij in chosen}
        for _ in range(PAIR_ROUNDS):
            for i, j in chosen:
                add = RATE * _quarters(*square(i, j))[1]
                self.pairs[i, j] += add
                f += add[coarse[i], coarse[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        f = np.full(len(x), self.start)
        for t, b in zip(self.tables, bins, strict=True):
            f += t[b]
        for (i, j), t in self.pairs.items():
            f += t[self.coarse(bins[i], i), self.coarse(bins[j], j)]
        return 1 / (1 + np.exp(-f))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from (doc_id, label) rows; null labels are left out."""
    names = [f"f{k}" for k in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in features(texts(batch)):
                cols = [pa.array(c) for c in x.astype(np.float64).T]
                yield pa.RecordBatch.from_arrays([batch.column("label")[at : at + len(x)], *cols], names=["label", *names])
                at += len(x)

    some = bounded(labels.where("label is not null").select("doc_id", F.col("label").cast("int")), "doc_id", rows).limit(2 * rows)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", "text")  # at most 2 * rows small rows
    got = found.mapInArrow(run, "label int, " + ", ".join(f"{n} double" for n in names)).toPandas().sort_values(["label", *names])
    return Model(got[names].to_numpy(float), (got["label"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in features(texts(batch)):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at : at + len(x)], pa.array(model.score(x))], names=["doc_id", "score"])
                at += len(x)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
