"""Encoding and decoding with a word BPE of the tokenizers library, by content-defined chunks.

Texts are cut where a rolling hash of the last WINDOW characters hits a fixed pattern, so equal
passages are cut alike in every document that holds them. A Python worker encodes each distinct
chunk once and remembers it by its whole string; no exchange is needed, which would move more
bytes than encoding saves. A chunk by itself is not what the library sees: letters, contractions,
combining marks and merges may reach across a cut. So each join is repaired: from a word of the
left chunk that no later character can change, to some characters into the right chunk, the text is
encoded again. The join is done when both agree: a word begins at the same character in the new ids and in
the right chunk's own, and the following words have the same ids. Until then the stretch grows,
twice as far each time, over whole chunks where none of their words agree.

Why agreement suffices: the pattern is matched from left to right without looking back, so from a
place where both begin a word, both go on alike. A place counts only where Unicode composition cannot
join it to the character before, and with a further such place LOOK characters on in the stretch.

A chunk's ids come from the library's model, word by word, where all characters are below U+0300:
these have no composition, and lower-casing and cutting them is a plain pattern, held against the
library in the tests. Any other chunk goes through the library as it is. Texts that hold a special
token's string are cut there first, as the library does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import lean, texts

#: Characters under the rolling hash; one place in MEAN is a cut; the sizes that a chunk may have.
WINDOW, MEAN, LEAST, MOST = 16, 384, 64, 2048
#: How far a contraction looks, and the first stretch into the right chunk.
LOOK, STRETCH = 3, 24
#: Bounds of a worker's memory: characters in remembered chunks, words in each of the two tables
#: of remembered ones, their length.
CHUNK_CHARS, WORDS, WORD_CHARS = 1 << 22, 1 << 18, 64
#: Places hashed at a time, and ids in a batch; words whose places are noted from the end.
STEP, LAST = 1 << 18, 6

#: Characters that are not composed and stay one character below U+0300 in lower case.
_PLAIN = [chr(c) for c in range(0x300) if len(chr(c).lower()) == 1 and chr(c).lower() < "̀"]
_OF = {k: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == k) for k in "LN"}
#: Fixed: white space, and the vocabulary's published pattern, of those characters.
_SPACE = "\t-\r \x85\xa0"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_OF['L']}]+|[{_OF['N']}]|[^{_SPACE}{_OF['L']}{_OF['N']}]+")
PLAIN = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]*")

IDS = "doc_id {id}, ids array<int>, decoded string"


@cache
def joinable() -> frozenset[str]:
    """Characters that composition or reordering may tie to the character before them."""
    out = {chr(c) for c in range(0x1100, 0x1200)}
    for c in range(0xA0, chars.SENTINEL):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
        if unicodedata.combining(chr(c)):
            out.add(chr(c))
    return frozenset(out)


def apart(text: str, at: int) -> bool:
    """Whether no composition joins the character with what is before it."""
    return text[at] < "̀" or text[at] not in joinable()


def pieces(text: str) -> list[str]:
    """The text cut behind each WINDOW characters whose hash is a multiple of MEAN, but for cuts
    nearer than LEAST to the last one; and MOST characters behind that at the latest."""
    out, last = [], 0
    if len(text) > LEAST:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        for low in range(0, len(cp) - WINDOW + 1, STEP):
            at = np.arange(low, min(low + STEP, len(cp) - WINDOW + 1))
            for cut in (at[chars.span_hashes(cp, at, at + WINDOW) % np.uint64(MEAN) == 0] + WINDOW).tolist():
                while cut - last > MOST:
                    out.append(text[last : last + MOST])
                    last += MOST
                if cut - last >= LEAST:
                    out.append(text[last:cut])
                    last = cut
    while len(text) - last > MOST:
        out.append(text[last : last + MOST])
        last += MOST
    return [*out, text[last:]] if last < len(text) else out


class Encoded:
    """A stretch's words: the packed ids of each, and where they begin, which is looked up when asked
    for. All characters but white space are in words. A word that begins within a character, as
    lower case can be longer, counts with the word before."""

    __slots__ = ("begins", "ids", "known", "last", "text")

    def __init__(self, text: str, ids: list[bytes], known: list[int] | None = None, last: list[int] | None = None):
        self.text, self.ids = text, ids
        self.known: list[int] = known or []
        self.last = last or []
        self.begins: Iterator[re.Match] | None = None

    def begin(self, k: int) -> int:
        if k >= len(self.ids) - len(self.last):
            return self.last[len(self.ids) - 1 - k]
        if self.begins is None:
            self.begins = WORD.finditer(self.text.lower())
        while len(self.known) <= k:
            self.known.append(next(self.begins).start())
        return self.known[k]

    def words(self, low: int, high: int | None = None) -> bytes:
        return b"".join(self.ids[low:high])


@cache
def coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


class ChunkCoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or spec["post_processor"]:
            raise ValueError("a vocabulary of lower-cased words in bytes without decoder is needed")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.stand = {b: chr(b if b in shown else next(rest)) for b in range(256)}
        self.names = [self.library.id_to_token(k) or "" for k in range(self.library.get_vocab_size())]
        self.kind = np.dtype("<u2" if len(self.names) <= 1 << 16 else "<u4")
        self.word_ids: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.chunks: dict[str, Encoded] = {}
        self.held = self.encoded = 0

    def packed(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes()

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind)

    def word(self, word: str) -> bytes:
        """The ids of a word that is not among the latest: remembered from before them, or new."""
        ids = self.earlier.get(word)
        if ids is None:
            shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.stand)
            ids = self.packed([t.id for t in self.library.model.tokenize(shown)])
        if len(self.word_ids) >= WORDS:
            self.earlier, self.word_ids = self.word_ids, {}
        if len(word) <= WORD_CHARS:
            self.word_ids[word] = ids
        return ids

    def stretch(self, text: str) -> Encoded:
        """The ids of a text by itself."""
        self.encoded += len(text)
        if PLAIN.fullmatch(text):
            word, low, last = self.word, text.lower(), []
            words = WORD.findall(low)
            at = len(low)
            for w in words[:-LAST:-1]:
                at = low.rindex(w, 0, at)
                last.append(at)
            known = self.word_ids.get
            return Encoded(text, [known(w) or word(w) for w in words], last=last)
        got = self.library.encode(text, add_special_tokens=False)
        begin, first, now, end = [], [], None, 0
        for k, (w, (at, after)) in enumerate(zip(got.word_ids, got.offsets, strict=True)):
            if w != now and at >= end:
                begin.append(at)
                first.append(k)
            now, end = w, after
        ids = got.ids
        return Encoded(text, [self.packed(ids[a:b]) for a, b in zip(first, [*first[1:], len(ids)], strict=True)], begin)

    def chunk(self, text: str) -> Encoded:
        found = self.chunks.get(text)
        if found is None:
            if self.held + len(text) > CHUNK_CHARS:
                self.chunks.clear()
                self.held = 0
            found = self.chunks[text] = self.stretch(text)
            self.held += len(text)
        return found

    def joined(self, parts: list[str]) -> bytes:
        """The packed ids of the parts' whole text. left is right from its word number done on, but for
        what later characters may change; out holds the ids of everything before that word."""
        if not parts:
            return b""
        out: list[bytes] = []
        left, done, k, together = self.chunk(parts[0]), 0, 1, 1
        while k < len(parts):
            part = "".join(parts[k : k + together])
            right = self.chunk(part) if together == 1 else self.stretch(part)
            k += together
            back, at = self.back(left, done)
            tail = left.text[at:]
            out += left.ids[done:back]
            width, meets = max(STRETCH, len(tail)), None
            while meets is None:
                new = self.stretch(tail + part[:width])
                if width >= len(part) and k >= len(parts):
                    return b"".join(out) + new.words(0)
                meets = self.agreed(new, right, len(tail))
                if meets is None and width >= len(part):
                    break
                width *= 2
            if meets is None:
                left, done, together = new, 0, 2 * together
            else:
                out += new.ids[: meets[0]]
                left, done, together = right, meets[1], 1
        return b"".join(out) + left.words(done)

    def back(self, left: Encoded, done: int) -> tuple[int, int]:
        """The last word, done at the earliest, that begins where no later character can change it,
        and that place."""
        for k in range(len(left.ids) - 1, done - 1, -1):
            at = left.begin(k)
            if k == done or at < len(left.text) - LOOK and apart(left.text, at):
                return k, at
        return done, len(left.text)

    def agreed(self, new: Encoded, right: Encoded, cut: int) -> tuple[int, int] | None:
        """(word of new, word of right) that begin at the same character and are followed by equal
        words, up to one that begins LOOK characters later at least."""
        theirs = 0

        def of_right(at: int) -> int | None:
            nonlocal theirs
            while theirs < len(right.ids) and right.begin(theirs) + cut < at:
                theirs += 1
            return theirs if theirs < len(right.ids) and right.begin(theirs) + cut == at else None

        for k in range(len(new.ids)):
            at = new.begin(k)
            mine = of_right(at) if at >= cut and apart(new.text, at) else None
            if mine is None:
                continue
            for j in range(k + 1, len(new.ids)):
                far = new.begin(j)
                if far >= at + LOOK and apart(new.text, far):
                    other = of_right(far)
                    if other is not None and new.ids[k:j] == right.ids[mine:other]:
                        return k, mine
                    break
            theirs = mine
        return None

    def encode(self, text: str) -> bytes:
        """The library's ids of a text, packed."""
        out, at = b"", 0
        for m in self.special.finditer(text):
            out += self.joined(pieces(text[at : m.start()])) + self.packed([self.library.token_to_id(m[0])])
            at = m.end()
        return out + self.joined(pieces(text[at:]))

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids, special tokens too: without a decoder, tokens and blanks."""
        return " ".join(map(self.names.__getitem__, ids))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of every row of (doc_id, text): the library's ids and what they
    decode to.

    Cases: a null text is empty; an empty text, or one of white space, has no ids and decodes to the
    empty string. Rows of equal texts or ids are rows of their own, a null id stays null. Other columns
    are not read. An empty table gives no rows. path is the vocabulary's file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            rows = texts(batch)
            at = 0
            while at < len(rows):
                low, ids, size = at, [], 0
                while at < len(rows) and size < STEP:
                    ids.append(bpe.ids(bpe.encode(rows[at] or "")))
                    size += len(ids[-1])
                    at += 1
                shown = pa.array((bpe.decode(x.tolist()) for x in ids), pa.string())
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:at], lists, shown], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), IDS.format(id=dict(docs.dtypes)["doc_id"]))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of every row of (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            shown = pa.array((bpe.decode(x or []) for x in batch.column("ids").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), shown], names=["doc_id", "ids", "decoded"])

    ids = F.col("ids").cast("array<int>")
    return rows.select("doc_id", ids.alias("ids")).mapInArrow(lean(run), IDS.format(id=dict(rows.dtypes)["doc_id"]))


def digests(rows: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of ids, as decimal numbers with blanks, and of the decoded text."""
    numbers = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
