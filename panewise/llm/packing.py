"""Packing of token streams by order-preserving dynamic programming.

The documents of an input split, in the order in which Spark reads them, are one stream of ids.
It may be cut at document ends (free), sentence ends (a small truncation penalty) and, where no
boundary comes for a while, between any two tokens (a larger penalty). The programme chooses the
cuts of least padding plus penalties; since a window holds at most `length` tokens, the best
predecessor is the head of a monotone queue, and the work is linear in the number of boundaries.
A sequence whose length is a power of two takes no padding; from `least_short` on such windows
are chosen anywhere, smaller ones only for the rest at the end of a split.

A split's stream is solved in stretches of `stretch` tokens; the last window of a stretch is
solved again with the next one, so memory is bounded by a stretch and the longest document.
Packing needs no shuffle. Sequence ids are the split's number and a count, so a task that runs
again makes the same rows.

Cases: a null or empty text is the end token alone. A null id stays null. Repeated ids are packed
as documents of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import chars
from .bpe import coder
from .common import lean, texts

LENGTH = 1024
#: Truncation penalties, in tokens of padding.
SENTENCE, ANYWHERE = 2, 12
#: A stretch of this many tokens without a boundary gets cuts of the last kind, this far apart.
GAP, GRID = 32, 16
LEAST_SHORT = 256
STRETCH = 1 << 18

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def sentence_ends(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which pretokens begin a sentence: after a line's end, or white space after . ! or ?"""
    before = cp[at - 1]
    stop = np.isin(before, [0x2E, 0x21, 0x3F, 0x3002, 0xFF01, 0xFF1F])
    return (before == 0x0A) | (stop & (chars.table("class")[cp[at]] == 3))


def cuts(positions: list[int], penalties: list[int], length: int, least_short: int) -> list[int]:
    """Indices of the chosen positions, first and last included, of least padding plus penalties.
    Neighbouring positions lie at most length apart."""
    shorts = [1 << k for k in range(1, length.bit_length()) if least_short <= 1 << k < length]
    value = [positions[0]] + [0] * (len(positions) - 1)  # cost so far plus the position
    back = [0] * len(positions)
    place = {positions[0]: 0}
    queue = deque([0])
    for i in range(1, len(positions)):
        p = positions[i]
        while positions[queue[0]] < p - length:
            queue.popleft()
        j = queue[0]
        best = value[j] + length - p
        for s in shorts:
            k = place.get(p - s)
            if k is not None and value[k] - p + s < best:
                best, j = value[k] - p + s, k
        back[i] = j
        best += penalties[i] + p
        value[i] = best
        place[p] = i
        while queue and value[queue[-1]] >= best:
            queue.pop()
        queue.append(i)
    out = [len(positions) - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Stream:
    """The stream of one split: takes documents, gives pieces."""

    def __init__(self, split: int, length: int, least_short: int):
        self.length, self.least_short = length, least_short
        self.sequence = split << 32
        self.ids = np.empty(0, np.uint32)
        self.marks = np.empty(0, np.int64)
        self.costs = np.empty(0, np.int64)
        self.docs: list[tuple[int | None, int, int]] = []  # id, first position, tokens

    def add(self, ids: np.ndarray, marks: np.ndarray, costs: np.ndarray, docs: list[tuple[int | None, int, int]]) -> None:
        n = len(self.ids)
        self.ids = np.concatenate((self.ids, ids))
        self.marks = np.concatenate((self.marks, marks + n))
        self.costs = np.concatenate((self.costs, costs))
        self.docs += [(d, s + n, k) for d, s, k in docs]

    def solve(self, final: bool) -> list[np.ndarray | list]:
        """Pieces of all windows but the last one, which stays unless the stream ends here."""
        n = len(self.ids)
        if not n:
            return [[] for _ in _NAMES]
        marks, costs = self.marks[self.marks < n], self.costs[self.marks < n]
        marks, costs = np.concatenate(([0], marks, [n])), np.concatenate(([0], costs, [0]))
        gap = np.diff(marks)
        more = np.where(gap > GAP, (gap - 1) // GRID, 0)
        base = np.repeat(marks[:-1], more)
        grid = base + GRID * (1 + np.arange(len(base)) - np.repeat(np.cumsum(more) - more, more))
        order = np.argsort(all_marks := np.concatenate((marks, grid)), kind="stable")
        penalties = np.concatenate((costs, np.full(len(grid), ANYWHERE)))[order]
        positions = all_marks[order]
        chosen = positions[cuts(positions.tolist(), penalties.tolist(), self.length, self.least_short)]
        if final:
            rest, last = int(chosen[-1] - chosen[-2]), int(chosen[-2])
            if rest & (rest - 1):
                bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
                chosen = np.concatenate((chosen[:-1], last + np.cumsum(bits)))
        elif len(chosen) > 2:
            chosen = chosen[:-1]
        done = int(chosen[-1])
        out = self.pieces(chosen)
        self.ids = self.ids[done:]
        keep = self.marks > done
        self.marks, self.costs = self.marks[keep] - done, self.costs[keep]
        self.docs = [(d, s - done, k) for d, s, k in self.docs if s + k > done]
        return out

    def pieces(self, chosen: np.ndarray) -> list:
        first = np.array([s for _, s, _ in self.docs], np.int64)
        total = np.array([k for _, _, k in self.docs], np.int64)
        inner = first[(first > chosen[0]) & (first < chosen[-1])]
        at = np.union1d(inner, chosen)
        begin, size = at[:-1], np.diff(at)
        doc = np.searchsorted(first, begin, side="right") - 1
        window = np.searchsorted(chosen, begin, side="right") - 1
        view = memoryview(np.ascontiguousarray(self.ids, "<u4")).cast("B")
        checks = [crc32(view[4 * b : 4 * (b + s)]) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]
        names = [self.docs[k][0] for k in doc.tolist()]
        sequences = self.sequence + window
        self.sequence += len(chosen) - 1
        return [names, begin - first[doc], size, checks, total[doc], sequences, begin - chosen[window]]


def packed(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, least_short: int = LEAST_SHORT) -> DataFrame:
    """Packs (doc_id, text) into sequences; one row for each piece of a document in a sequence.
    path: the tokenizer's file, on every executor."""
    least = max(2, min(least_short, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        stream = Stream(TaskContext.get().partitionId(), length, least)

        def made(final: bool) -> pa.RecordBatch:
            kinds = [pa.array(x, pa.int64()) for x in stream.solve(final)]
            return pa.RecordBatch.from_arrays(kinds, names=_NAMES)

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for low, high, cp, starts, ids, bounds, at, first in code.encode(texts(batch)):
                n = np.diff(bounds)
                shift = np.arange(high - low)
                out = np.full(len(ids) + high - low, end_id, np.uint32)
                owner = np.repeat(shift, n)
                out[np.arange(len(ids)) + owner] = ids
                begin = bounds[:-1] + shift
                after = begin + n + 1
                if len(at):
                    ends = first[np.flatnonzero(sentence_ends(cp, at))]
                    ends = ends[ends > 0]
                    ends = ends + chars.owners(bounds, ends)
                    marks, where = np.unique(np.concatenate((after, ends)), return_index=True)
                    costs = np.where(where < len(after), 0, SENTENCE)
                else:
                    marks, costs = after, np.zeros(len(after), np.int64)
                stream.add(out, marks, costs, list(zip(ids_of[low:high], begin.tolist(), (n + 1).tolist(), strict=True)))
                if len(stream.ids) >= STRETCH:
                    yield made(False)
        yield made(True)

    return docs.select("doc_id", "text").mapInArrow(lean(run), PIECES)
