"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text for each language gives, from any place of a text, the longest
piece that also occurs in that language's text. Cutting a text into such pieces gives a number of
phrases; phrases times the bits of a place in the labelled text, over the text's length, estimate
the bits a character costs under that language, and the language of fewest bits wins.

Texts are lower-cased, runs of other characters than letters become one blank. Parsing begins anew
every SEGMENT characters, so the segments of many texts step through all automata side by side.

Fitting takes from each language at most DRAWS stretches of DRAW characters, of documents in the
order of a hash of doc_id, up to TRAIN_CHARS; every text is judged whole. All letters of these
stretches are told apart, in any script.

Cases: a null text, or one without a letter, is `und` with score 0; so is every text when nothing
is labelled. The score is one less the ratio of the best to the second best bits (1 if there is
one language only). Ties go to the first label. Repeated rows are judged alike, null ids stay
null; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chars
from .common import lean, texts

SEGMENT = 256
TRAIN_CHARS, DRAW, DRAWS = 1 << 15, 512, 128
BLOCK_CHARS = 1 << 19
UNKNOWN = "und"
PAD, SPACE, OTHER = 0, 1, 2

Sample = tuple[tuple[str, str], ...]


def plain(text: str) -> str:
    """Letters in lower case, with one blank between runs of them."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def sample(docs: DataFrame, usable: Column) -> Sample:
    """(label, text) of each language, from the rows that are usable and labelled."""
    key = F.xxhash64(F.col("doc_id"), F.lit(29))
    start = F.pmod(key, F.greatest(F.length("text") - DRAW, F.lit(1))) + 1
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = rows.select("lang", key.alias("key"), F.substring(F.col("text"), start.cast("int"), F.lit(DRAW)).alias("part"))
    first = Window.partitionBy("lang").orderBy("key", "part")
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= DRAWS)
    parts: dict[str, dict[str, None]] = {}
    for r in rows.orderBy("lang", "rank").collect():
        if p := plain(r["part"]):
            parts.setdefault(r["lang"], {})[p] = None
    return tuple((lang, " ".join(p)[:TRAIN_CHARS]) for lang, p in sorted(parts.items()))


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by symbol; the first state is the root."""
    step: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if size[at] + 1 == size[to]:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return step


class Transitions:
    """(state, symbol) -> state in an open-addressed table, a quarter full: memory follows the number
    of transitions, three for each labelled character at most, whatever the alphabet."""

    EMPTY = np.uint64((1 << 64) - 1)
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, key: np.ndarray, to: np.ndarray):
        bits = max(4, (4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key = np.full(1 << bits, self.EMPTY)
        self.to = np.full(1 << bits, -1, np.int32)
        slot, left = self.slot(key), np.arange(len(key))
        while len(left):
            free = left[self.key[slot[left]] == self.EMPTY]
            at, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.key[at], self.to[at] = key[mine], to[mine]
            left = left[self.key[slot[left]] != key[left]]
            slot[left] = slot[left] + 1 & self.mask

    @staticmethod
    def keys(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return state.astype(np.uint64) << np.uint64(21) | symbol.astype(np.uint64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key * self.SPREAD >> self.shift).astype(np.int64)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of each, -1 without one."""
        key = self.keys(state, symbol)
        slot = self.slot(key)
        seen = self.key[slot]
        out = np.where(seen == key, self.to[slot], -1)
        left = np.flatnonzero((seen != key) & (seen != self.EMPTY))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            seen = self.key[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (seen != self.EMPTY)]
        return out


class Parser:
    """The automata of all languages in one table of transitions, over all letters that occur in the
    labelled texts; letters that do not are one symbol without a transition."""

    def __init__(self, sample: Sample):
        self.labels = [lang for lang, _ in sample]
        letters = sorted(set("".join(t for _, t in sample)) - {" "})
        self.symbol = np.where(chars.table("class") == 1, OTHER, SPACE).astype(np.uint32)
        for k, c in enumerate(letters):
            self.symbol[ord(c)] = k + 3
        state, symbol, to, roots, bits, base = [], [], [], [], [], 0
        for _, text in sample:
            codes = self.symbol[np.array([ord(c) for c in text], np.int64)].tolist()
            steps = automaton(codes)
            for s, edges in enumerate(steps):
                state += [base + s] * len(edges)
                symbol += edges
                to += [base + t for t in edges.values()]
            roots.append(base)
            bits.append(math.log2(max(2, len(codes))))
            base += len(steps)
        self.step = Transitions(Transitions.keys(np.array(state, np.int64), np.array(symbol, np.int64)), np.array(to, np.int32))
        self.roots, self.bits = np.array(roots, np.int32), np.array(bits)

    def phrases(self, symbols: np.ndarray) -> np.ndarray:
        """Phrases of each segment (a column of symbols) under each language."""
        state = np.repeat(self.roots, symbols.shape[1])
        root = state.copy()
        count = np.ones(len(state), np.int32)
        for row in symbols:
            sym = np.tile(row, len(self.roots))
            to = np.where(sym == PAD, state, self.step(state, sym))
            broken = np.flatnonzero(to < 0)
            count[broken] += 1
            again = self.step(root[broken], sym[broken])
            to[broken] = np.where(again < 0, root[broken], again)
            state = to
        return count.reshape(len(self.roots), -1)

    def judge(self, batch: list[str | None]) -> tuple[list[str], np.ndarray]:
        labels, scores = [], np.zeros(len(batch))
        names = np.array([*self.labels, UNKNOWN], object)
        for low, high, cp, starts in chars.blocks([t.lower() if t else t for t in batch], BLOCK_CHARS):
            if not self.labels:
                labels += [UNKNOWN] * (high - low)
                continue
            sym = self.symbol[cp]
            sym[cp == chars.SENTINEL] = SPACE
            keep = np.flatnonzero((sym[1:] != SPACE) | (sym[:-1] != SPACE)) + 1
            sym, owner = sym[keep], chars.owners(starts, keep)
            lettered = np.bincount(owner[sym != SPACE], minlength=high - low)
            use = lettered[owner] > 0
            sym, owner = sym[use], owner[use]
            begin = np.searchsorted(owner, np.arange(high - low + 1))
            n = np.diff(begin)
            parts = -(-n // SEGMENT)
            first = np.cumsum(parts) - parts
            place = np.arange(len(sym)) - begin[owner]
            grid = np.zeros((SEGMENT, int(parts.sum())), np.uint32)
            grid[place % SEGMENT, first[owner] + place // SEGMENT] = sym
            counts = self.phrases(grid)
            of = np.repeat(np.arange(high - low), parts)
            total = np.stack([np.bincount(of, c, minlength=high - low) for c in counts])
            cost = total * self.bits[:, None] / np.maximum(n, 1)
            best = np.where(n > 0, np.argmin(cost, axis=0), len(self.labels))
            labels += names[best].tolist()
            if len(self.labels) > 1:
                two = np.partition(cost, 1, axis=0)[:2]
                scores[low:high] = np.where(n > 0, 1 - two[0] / np.maximum(two[1], 1e-9), 0)
            else:
                scores[low:high] = n > 0
        return labels, np.clip(scores, 0, 1)


@lru_cache(maxsize=2)
def parser(sample: Sample) -> Parser:
    return Parser(sample)


def identified(docs: DataFrame, known: Sample) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = parser(known).judge
        for batch in batches:
            labels, scores = judge(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, known: Sample) -> DataFrame:
    """The documents that are in some language, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = parser(known).judge
        for batch in batches:
            labels, _ = judge(texts(batch))
            yield batch.filter(pa.array([x != UNKNOWN for x in labels], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
