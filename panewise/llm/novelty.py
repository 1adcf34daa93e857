"""Secret scans: fixed shapes, and strings that compression primed with ordinary words finds new.

Base spans are the stated patterns of kinds assign, access and hex. The method adds spans of kind
novel: a run of 20 and more characters of [A-Za-z0-9+/_=-] with letters and digits, after a sensitive
word within 64 characters, whose marginal cost is high: the bytes zstandard needs for context and
run, less the bytes for the context alone, are at least 0.7 of the run's length. Runs of more than
512 are judged in equal pieces of at most that and reported whole if one is new. The compressor is
primed with code identifiers and the words that most distinct texts of the table hold (of words in
about as many texts a part by hash, where not all fit), never with text, and the context is the 256
characters before the run. What base spans cover is not reported again; what they leave of a run is
judged, and reported in as many spans as it has parts.

Positions are code points, ends exclusive. Texts are scanned whole. Cases: a null text counts as
empty; null and repeated ids are kept as they are; an empty table gives no rows. Other columns are
not read by the scan and kept by the redaction.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chars
from .common import kept, lean, texts

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|credential|auth|bearer|private|signature", re.IGNORECASE | re.ASCII)
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
LEAST_NOVEL, PIECE, NEAR, CONTEXT, NEW = 20, 512, 64, 256, 0.7
#: Whole runs of 4 to 32 lower-case letters, with dashes; those in this many distinct texts are counted
#: over all documents, and the commonest, up to these bytes, stand before the identifiers.
WORD = "(?<![A-Za-z0-9+/_=-])[a-z][a-z_-]{3,31}+(?![A-Za-z0-9+/_=-])"
LEAST_TEXTS, DICTIONARY = 2, 100_000
#: Classes of counts for each doubling, and parts of a class: at most some thousands of sums go to the driver.
LEVELS, PARTS = 16, 4096
IDENTIFIERS = (
    "import export default function return const class public private static void string number boolean null true false "
    "config settings environment process.env getenv os.environ username email address account client_id client_secret "
    "access_token refresh_token api_key apikey authorization bearer password passwd secret token private_key public_key "
    "https://www.example.com/api/v1/users http://localhost:8080 content-type application/json user-agent accept "
    "BEGIN PRIVATE KEY END PRIVATE KEY ssh-rsa sha256 md5 base64 0123456789 abcdefghijklmnopqrstuvwxyz"
)

FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
Span = tuple[int, int, int]  # start, kind, end


def _class(members: str) -> np.ndarray:
    out = np.zeros(chars.SENTINEL + 1, bool)
    out[[ord(c) for c in members]] = True
    return out


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scanner:
    def __init__(self, dictionary: bytes):
        self.hex, self.run = _class(DIGITS + "abcdef"), _class(DIGITS + UPPER + LOWER + "+/_=-")
        self.digit, self.letter = _class(DIGITS), _class(UPPER + LOWER)
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = lambda data, z=zstandard.ZstdCompressor(level=6, dict_data=primed): len(z.compress(data))

    def is_new(self, before: str, run: str) -> bool:
        """Whether a piece of the run is new after the text before it; pieces are of equal length."""
        known, n = self.size(before.encode()), -(-len(run) // PIECE)
        cuts = [len(run) * k // n for k in range(n + 1)]
        return any(self.size((before + run[a:b]).encode()) - known >= NEW * (b - a) for a, b in zip(cuts, cuts[1:]))

    def novel(self, text: str, start: int, end: int, base: list[Span]) -> list[Span]:
        """What is left of a run outside the base spans, if it is new. A run ends where an assign span
        begins, as what precedes is part of a name, unless that is a run by itself."""
        before = text[max(0, start - CONTEXT) : start]
        if not SENSITIVE.search(before[-NEAR:]):
            return []
        base = [x for x in base if x[0] < end and start < x[2]]
        end = min([end, *(max(start, s) for s, k, _ in base if k == 0)])
        if end - start < LEAST_NOVEL:
            return []
        rest, at = [], start
        for s, _, e in base:
            if at < min(s, end):
                rest.append((at, 3, min(s, end)))
            at = max(at, e)
        if at < end:
            rest.append((at, 3, end))
        run = "".join(text[s:e] for s, _, e in rest)
        judged = text[start:end] if len(run) >= LEAST_NOVEL else run
        if not (DIGIT.search(judged) and LETTER.search(judged)):
            return []
        return rest if self.is_new(before, run) else []

    def base(self, text: str) -> list[Span]:
        """Spans of the assign and access patterns."""
        out = []
        if text.find("AKIA") >= 0:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        low = text.encode().lower()
        if any(w in low for w in (b"passw", b"secret", b"token", b"api")):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        return out

    def scan(self, batch: list[str | None]) -> list[list[Span]]:
        """The spans of each text, by start and then by kind."""
        out: list[list[Span]] = []
        for low, high, cp, starts in chars.blocks(batch):
            found = [self.base(t) if t else [] for t in batch[low:high]]
            s, e = chars.spans(self.hex[cp])
            long = e - s >= LEAST_HEX
            s, e = s[long], e[long]
            for k, a, b in zip((own := chars.owners(starts, s)).tolist(), (s - starts[own]).tolist(), (e - starts[own]).tolist(), strict=True):
                found[k].append((a, 2, b))
            s, e = chars.spans(self.run[cp])
            fit = e - s >= LEAST_NOVEL
            s, e = s[fit], e[fit]
            base = [sorted(x) for x in found]
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                if not (self.digit[cp[a:b]].any() and self.letter[cp[a:b]].any()):
                    continue
                k = int(chars.owners(starts, np.array([a]))[0])
                a, b = a - int(starts[k]), b - int(starts[k])
                found[k] += self.novel(batch[low + k], a, b, base[k])
            out += [sorted(x) for x in found]
        return out


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> bytes:
    """Identifiers and the words that most distinct texts hold, commonest last, most bytes of them.
    Sums per class of counts tell the driver where these end, and then it gets those words alone."""
    rows = docs.where("text is not null").select(F.expr("xxhash64(text)").alias("h"), F.expr("xxhash64(text, 31)").alias("g"), words("text"))
    held = rows.where("words <> ''").dropDuplicates(["h", "g"]).select(F.explode(F.split("words", " ")).alias("word"))
    common = held.groupBy("word").count().where(F.col("count") >= LEAST_TEXTS)
    level = F.floor(F.log2("count") * LEVELS).cast("int")
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS)).cast("int")
    common = kept(common.select("word", "count", level.alias("level"), part.alias("part")), "novelty-words")
    whole, room = end_of(common, "level", most, upward=False)
    # of the first class that does not fit, as many equal parts by a hash of the word as fit
    some, _ = end_of(common.where(F.col("level") == whole - 1), "part", room, upward=True)
    taken = common.where((F.col("level") >= whole) | ((F.col("level") == whole - 1) & (F.col("part") < some)))
    found = sorted(taken.select("count", "word").collect(), key=lambda r: (-r["count"], r["word"]))
    return "\n".join([*(r["word"] for r in reversed(found)), IDENTIFIERS]).encode()


def end_of(common: DataFrame, key: str, most: int, upward: bool) -> tuple[int, int]:
    """Words are taken key by key, from the lowest or from the highest, while they fit into the bytes:
    the key where that ends (exclusive upward, else inclusive) and the bytes left."""
    sums = common.groupBy(key).agg(F.sum(F.length("word") + 1).alias("bytes")).orderBy(key if upward else F.desc(key)).collect()
    end = sums[0][key] if sums else 0
    for r in sums:
        if r["bytes"] > most:
            return (r[key], most) if upward else (r[key] + 1, most)
        end, most = r[key] + (1 if upward else 0), most - r["bytes"]
    return end, most


def words(column: str) -> Column:
    """The distinct words of a text, with blanks between. A word is a whole run without digits and
    capitals, so no string that is judged can be one or, as none of its characters parts them, reach
    over two."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0))), " ").alias("words")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanned(docs: DataFrame, primed: bytes) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(primed).scan
        for batch in batches:
            found = scan(texts(batch))
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in found], pa.int64()) for kind in range(4)]
            sha = [hashlib.sha256(joined([y for y in x if y[1] < 3]).encode()).hexdigest() for x in found]
            cols = [batch.column("doc_id"), *counts[:3], pa.array(sha, pa.string()), pa.array(map(joined, found), pa.string()), counts[3]]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run), FOUND)


def without(text: str, spans: list[Span], mark: str) -> str:
    """The text with each group of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, primed: bytes, mark: str = "[SECRET]") -> DataFrame:
    """The documents with all spans replaced, n_chars, if there, counted anew; no row goes."""
    counted = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(primed).scan
        for batch in batches:
            had = texts(batch)
            now = [without(t, x, mark) if x else t for t, x in zip(had, scan(had), strict=True)]
            new = {"text": pa.array(now, batch.column("text").type)}
            if counted:
                old = batch.column("n_chars").to_pylist()
                new["n_chars"] = pa.array([n if a is b else len(b) for n, a, b in zip(old, had, now, strict=True)], batch.column("n_chars").type)
            cols = [new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
