"""Texts as code point arrays, and vectorised words and hashes over many texts at once.

A block is a few texts joined into one array with a sentinel before, between and after them, so
that no word, pretoken or phrase can reach from one text into the next. Work inside a block is
numpy over all its texts; a text longer than a block is a block by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: One past the last code point.
SENTINEL = 0x110000
BLOCK_CHARS = 1 << 18
#: Spans are hashed in stretches of about this many characters, which bounds the tables.
STRETCH = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points, start of each text and one past the last
    sentinel). Text k lies in cp[starts[k] : starts[k + 1] - 1]; null counts as empty."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or (size + len(texts[end] or "") <= limit and end - at < limit >> 3)):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
        cp = np.full(int(starts[-1]), SENTINEL, np.uint32)
        keep = np.ones(len(cp), bool)
        keep[0] = False
        keep[starts[1:] - 1] = False
        cp[keep] = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
        yield at, end, cp, starts
        at = end


@cache
def table(name: str) -> np.ndarray:
    """A property of every code point and of the sentinel, which has none."""
    if name == "mix":
        return mixed(np.arange(SENTINEL + 1, dtype=np.uint64) + np.uint64(1))
    if name == "class":  # 1 letter, 2 number, 3 white space, 4 other, 0 sentinel
        kinds = {"L": 1, "N": 2}
        out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 4) for c in range(SENTINEL)), np.uint8, SENTINEL)
        out = np.append(out, np.uint8(0))
        out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
        return out
    if name == "lower":  # A-Z only
        out = np.arange(SENTINEL + 1, dtype=np.uint32)
        out[65:91] += 32
        return out
    out = np.ones(SENTINEL + 1, bool)
    out[SENTINEL] = False
    if name == "unspaced":  # [^\x20\x09-\x0D]
        out[[*range(9, 14), 0x20]] = False
    elif name == "wordlike":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
        out[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
    else:
        raise KeyError(name)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def spans(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; the first and the last are false."""
    edges = np.flatnonzero(member[1:] != member[:-1]) + 1
    return edges[::2], edges[1::2]


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's characters, by differences of one running sum."""
    out = np.empty(len(starts), np.uint64)
    mix, at = table("mix"), 0
    while at < len(starts):
        base = int(starts[at])
        end = max(at + 1, int(np.searchsorted(starts, base + STRETCH)))
        part = cp[base : int(ends[at:end].max())]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mix[part] * up[: len(part)], out=total[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        out[at:end] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    return out


def owners(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text of each position in a block."""
    return np.searchsorted(starts, positions, side="right") - 1


def lowered(cp: np.ndarray) -> np.ndarray:
    return table("lower")[cp]


def word_table(cp: np.ndarray, starts: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block in order, and the first word of each text (and one more)."""
    low = lowered(cp)
    s, e = spans(table(kind)[low])
    return span_hashes(low, s, e), np.searchsorted(s, starts)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle of a block, by text and then by hash. A text of fewer
    words than width has its whole sequence as one; without words it has none."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    length = np.minimum(n, width)[owner]
    value = np.zeros(len(owner), np.uint64)
    for k in range(width):
        inside = length > k
        value[inside] = mixed(value[inside] * _M2 + hashes[at[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[fresh], value[fresh]
