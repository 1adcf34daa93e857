"""Token ids of many texts at once with a public byte-level BPE of the tokenizers library.

Texts are cut into pretokens by the vocabulary's published pattern in numpy; the library's model
encodes each distinct pretoken once, and a bounded table of them serves the later texts of a
Python worker. Texts that contain the string of an added token go through the library whole.
"""

from __future__ import annotations

import json
from functools import cache
from itertools import chain

import numpy as np

from . import chars

#: Pretokens remembered in a worker; when they are too many, those of several blocks stay.
REMEMBERED = 1 << 19


@cache
def coder(path: str) -> Coder:
    return Coder(path)


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without normaliser and prefix space is needed")
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.small = self.library.get_vocab_size() <= 1 << 16
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.stand = np.array([b if b in plain else next(rest) for b in range(256)], np.uint32)
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begin = np.empty(0, np.int64)
        self.count = np.empty(0, np.int32)
        self.used = np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    def shrink(self) -> None:
        """Forget the pretokens of the fewest blocks, half of the room at least."""
        least = 1
        if len(self.used):
            least = max(2, 1 + int(np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]))
        stay = self.used >= least
        if 2 * int(stay.sum()) > REMEMBERED:
            self.forget()
            return
        begin, count = self.begin[stay], self.count[stay].astype(np.int64)
        first = np.cumsum(count) - count
        self.flat = self.flat[np.repeat(begin - first, count) + np.arange(int(count.sum()))]
        self.keys, self.begin, self.count, self.used = self.keys[stay], first, self.count[stay], np.ones(int(stay.sum()), np.int32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add pretokens, as byte-level strings, that are not yet known; keys are sorted."""
        encode = self.library.model.tokenize
        ids = [[t.id for t in encode(w)] for w in words]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))))
        spot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spot, keys)
        self.begin = np.insert(self.begin, spot, begin)
        self.count = np.insert(self.count, spot, count)
        self.used = np.insert(self.used, spot, np.zeros(len(keys), np.int32))

    def shown(self, cp: np.ndarray) -> tuple[str, np.ndarray]:
        """A block in the characters that stand for bytes, and the offset of each code point."""
        cp = np.where(cp == chars.SENTINEL, 0x20, cp)
        size = np.add.reduce([cp >= low for low in (0x80, 0x800, 0x10000)], axis=0, dtype=np.int64) + 1
        data = cp.tobytes().decode("utf-32-le").encode()
        text = self.stand[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")
        return text, np.concatenate(([0], np.cumsum(size)))

    def block(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block: the ids, the first id of each text (and one more), the first character of
        each pretoken and its first id."""
        at = pretokens(cp)
        ends = np.append(at[1:], len(cp))
        inside = cp[at] != chars.SENTINEL
        at, ends = at[inside], ends[inside]
        unique, sample, inverse = np.unique(chars.span_hashes(cp, at, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > REMEMBERED:
            self.shrink()
        spot = np.searchsorted(self.keys, unique)
        known = self.keys[np.minimum(spot, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            text, byte = self.shown(cp)
            self.learn(unique[new], [text[s:e] for s, e in zip(byte[at[sample[new]]].tolist(), byte[ends[sample[new]]].tolist(), strict=True)])
            spot = np.searchsorted(self.keys, unique)
        self.used[spot] += 1
        count = self.count[spot][inverse]
        first = np.cumsum(count, dtype=np.int64) - count
        total = int(count.sum(dtype=np.int64))
        ids = self.flat[np.repeat(self.begin[spot][inverse] - first, count) + np.arange(total)]
        bounds = np.append(first, total)[np.searchsorted(at, starts)]
        return ids, bounds, at, first

    def encode(self, texts: list[str | None]):
        """For each block of texts: first row, row after the last, then what block() gives; where
        a text holds an added token, its ids are the library's own."""
        for low, high, cp, starts in chars.blocks(texts):
            odd = [k for k in range(low, high) if texts[k] and any(a in texts[k] for a in self.added)]
            if not odd:
                yield low, high, cp, starts, *self.block(cp, starts)
                continue
            for k in range(low, high):
                _, _, cp, starts = next(chars.blocks(texts[k : k + 1], 1))
                if k in odd:
                    ids = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                    yield k, k + 1, cp, starts, ids, np.array([0, len(ids)]), np.empty(0, np.int64), np.empty(0, np.int64)
                else:
                    yield k, k + 1, cp, starts, *self.block(cp, starts)


def pretokens(cp: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin: a contraction, a run of letters, numbers or other
    characters with at most one blank before it, or white space up to the last one before a word.
    The sentinels count as matches."""
    kind = chars.table("class")[cp]
    start = np.ones(len(cp), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[cp == chars.SENTINEL] = True
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & (kind[1:] != 0))  # white space before a word
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    quote = np.flatnonzero(cp[:-2] == 0x27)
    quote = quote[start[quote] & (kind[quote + 1] == 1)]
    for q in quote.tolist():
        two = chr(cp[q + 1]) + (chr(cp[q + 2]) if cp[q + 2] < chars.SENTINEL else "")
        size = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if size:
            start[q + 1] = False
            if kind[q + 1 + size] == 1:
                start[q + 1 + size] = True
    return np.flatnonzero(start)
