"""Toxicity by maximum-scoring segments of token log-odds.

The tokens of a word are itself and its first four, five and six letters. Fitting counts, for each
token, the labelled documents of either kind that hold it, with an informative Dirichlet prior of
the tokens' overall shares. Typical of toxic documents are tokens of log-odds of `LEAST_ODDS` or more
whose z, the signed root of the likelihood ratio of the two shares, is `MARKED` or more, and so high
that not more than one of all tokens is expected to reach it by chance. A word carries the highest
log-odds of its marked tokens, capped, and every other word a small cost. The scan then finds all
segments of a text that are maximal (every shorter part of one scores less, and no longer segment
is like that) and score SIGNIFICANT or more, in one pass: a list of candidates with the running sum
before and after each, where a new one is joined to the nearest earlier one that began lower, as
long as that one also ended lower. Of segments with equal scores both are found.

Scores of segments are calibrated by extreme values: chance segments of a text of n words reach S
with probability 1 - exp(-K n exp(-lambda S)), where lambda solves sum p exp(lambda s) = 1 over
the words of clean documents, and K is what makes the number of significant segments expected in
clean documents the number found there. A text's evidence is minus the logarithm of that for its segments,
added up; a logistic curve of the evidence, fitted on the labelled rows, is the score.

At most about ROWS labelled rows of each label are used for fitting (a bound, spread by a hash of
doc_id; equal texts count once); every text is scored whole. Cases: a null text counts as empty,
has no segment and the score of no evidence. Null labels are not used. Without labels of both
kinds there is no evidence in any text and the score is the share of toxic labels (0 without
labels). Repeated rows and null ids are kept; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import bounded, kept, texts

ROWS = 15_000
#: Mass of the prior, in documents; least z of a marked word.
PRIOR, MARKED = 20.0, 4.0
#: A marked token is in so many labelled toxic documents at least, however many there are.
LEAST_DOCS = 3
CAP, COST, SIGNIFICANT, LEAST_ODDS = 6.0, 0.05, 2.0, 3.0
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    """Marked words (sorted hashes and scores), scale and number of chance scores, and the logistic."""

    words: np.ndarray
    values: np.ndarray
    rate: float
    karlin: float
    slope: float
    shift: float

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        out = 0.0
        for _, _, score in segments:
            expected = self.karlin * max(n, 1) * np.exp(-self.rate * score)
            out += max(0.0, -np.log(max(-np.expm1(-expected), 1e-12)))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


def words_of(cp: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Words are runs of letters, A-Z lower-cased. For each kind of token, the words that have one
    and its hash; and the first word of each text (and one more)."""
    low = chars.lowered(cp)
    s, e = chars.spans(chars.table("class")[low] == 1)
    tokens = [(np.arange(len(s)), chars.span_hashes(low, s, e))]
    for k in PREFIXES:
        long = np.flatnonzero(e - s > k)
        tokens.append((long, chars.mixed(chars.span_hashes(low, s[long], s[long] + k) + np.uint64(k))))
    return tokens, np.searchsorted(s, starts)


def segments(places: list[int], values: list[float]) -> list[tuple[int, int, float]]:
    """(first word, last word, score) of the significant maximal segments; places are the marked words.

    A candidate also holds the place in the list of the nearest earlier one that began at a lower sum.
    Those between are never looked at again, so the work is linear."""
    out: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, -1
    for p, v in zip(places, values, strict=True):
        start, first, back = total - COST * (p - at - 1), p, len(out) - 1
        total, at = start + v, p
        while True:
            while back >= 0 and out[back][2] >= start:
                back = out[back][4]
            if back < 0 or out[back][3] >= total:
                break
            first, _, start, _, earlier = out[back]
            del out[back:]
            back = earlier
        out.append((first, p, start, total, back))
    return [(a, b, r - s) for a, b, s, r, _ in out if r - s >= SIGNIFICANT]


def found(batch: list[str | None], words: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, list]]:
    """(number of words, segments) of each text."""
    for low, high, cp, starts in chars.blocks(batch):
        tokens, first = words_of(cp, starts)
        n = np.diff(first).tolist()
        if not len(words):
            yield from ((k, []) for k in n)
            continue
        of_word = np.zeros(int(first[-1]))
        for at, h in tokens:
            spot = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hit = words[spot] == h
            of_word[at[hit]] = np.maximum(of_word[at[hit]], values[spot[hit]])
        hit = np.flatnonzero(of_word)
        cut = np.searchsorted(hit, first)
        value = of_word[hit]
        for k in range(high - low):
            a, b = cut[k], cut[k + 1]
            yield n[k], segments((hit[a:b] - first[k]).tolist(), value[a:b].tolist()) if b > a else []


def fitted(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from (doc_id, label) rows."""
    kinds = labels.where("label is not null").select("doc_id", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"))
    some = [bounded(kinds.where(F.col("label") == k), "doc_id", rows).limit(2 * rows) for k in (0, 1)]
    some = some[0].union(some[1])
    train = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most 4 * rows small rows
    train = kept(train.select("label", "text").dropDuplicates(["label", "text"]), "toxic-train")
    size = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    share = toxic / max(1, clean + toxic)
    none = Model(np.empty(0, np.uint64), np.empty(0), 1.0, 1.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not clean or not toxic:
        return none

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            for low, high, cp, starts in chars.blocks(texts(batch)):
                tokens, first = words_of(cp, starts)
                h = np.concatenate([x for _, x in tokens])
                owner = np.repeat(np.arange(high - low), np.diff(first))[np.concatenate([at for at, _ in tokens])]
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
                bad = label[low:high][owner[fresh]]
                u, inv = np.unique(h[fresh], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(np.bincount(inv, bad, len(u)).astype(np.int64)), pa.array(np.bincount(inv, minlength=len(u)))],
                    names=["word", "toxic", "docs"],
                )

    seen = train.mapInArrow(counts, "word long, toxic long, docs long").groupBy("word").agg(F.sum("toxic").alias("y"), F.sum("docs").alias("n"))
    prior = F.col("n") * PRIOR / (clean + toxic)
    odds = lambda y, total: F.log((y + prior) / (F.lit(total + PRIOR) - y + 1))
    delta = odds(F.col("y"), toxic) - odds(F.col("n") - F.col("y"), clean)
    seen = kept(seen, "toxic-words")
    least = max(MARKED, float(np.sqrt(2 * np.log(max(1, seen.count())))))
    both = clean + toxic
    cell = lambda k, of, total: F.when(k > 0, k * F.log(k * both / (of * total))).otherwise(0.0)
    y, n = F.col("y").cast("double"), F.col("n").cast("double")
    gain = cell(y, n, toxic) + cell(n - y, n, clean) + cell(toxic - y, both - n, toxic) + cell(clean - n + y, both - n, clean)
    marked = seen.where(F.col("y") >= LEAST_DOCS).select("word", delta.alias("delta"), F.sqrt(F.greatest(2 * gain, F.lit(0.0))).alias("z"))
    # every marked token is in LEAST_DOCS texts of the bounded sample, so these rows do not grow with the table
    top = marked.where((F.col("z") >= least) & (F.col("delta") >= LEAST_ODDS)).select("word", "delta").collect()
    if not top:
        return none
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    words, values = words[order], np.minimum(CAP, np.array([r["delta"] for r in top]))[order]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(found(texts(batch), words, values))
            hits = [len(x) for _, x in rows]
            scores = [[s for *_, s in x] for _, x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([n for n, _ in rows], pa.int64()), pa.array(hits, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["label", "n", "hits", "scores"])

    got = train.mapInArrow(stats, "label int, n long, hits long, scores array<double>").collect()
    total = sum(r["n"] for r in got if not r["label"])
    chance = [s for r in got if not r["label"] for s in r["scores"]]
    p = (len(chance) + 0.5) / max(total, 1)
    mean = np.exp(np.mean(np.log(chance))) if chance else float(np.median(values))
    low, high = 1e-6, 50.0
    for _ in range(80):  # p exp(rate mean) + (1 - p) exp(-rate COST) = 1
        rate = (low + high) / 2
        if p * np.exp(min(rate * mean, 700)) + (1 - p) * np.exp(-rate * COST) < 1:
            low = rate
        else:
            high = rate
    rate = max(low, 1e-3)
    karlin = min(1.0, (len(chance) + 0.5) / max(total, 1) * np.exp(min(rate * SIGNIFICANT, 700)))
    model = Model(words, values, rate, float(karlin), 0.0, 0.0)
    x = np.array([model.evidence([(0, 0, s) for s in r["scores"]], r["n"]) for r in got])
    y = np.array([float(r["label"]) for r in got])
    w = np.where(y > 0, 0.5 / toxic, 0.5 / clean) * len(y)
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton, with a small ridge
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (y - q) * x).sum() - 0.01 * a, (w * (y - q)).sum() - 0.01 * b])
        c = w * q * (1 - q)
        h = np.array([[(c * x * x).sum() + 0.01, (c * x).sum()], [(c * x).sum(), c.sum() + 0.01]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + move[0], b + move[1]
        if abs(move).max() < 1e-8:
            break
    model.slope, model.shift = float(max(a, 0.0)), float(b)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the toxic passages, in words, of every row of (doc_id, text)."""
    place = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(found(texts(batch), model.words, model.values))
            score = model.score(np.array([model.evidence(x, n) for n, x in rows]))
            spans = [[{"first_word": a, "last_word": b, "score": s} for a, b, s in x] for _, x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(spans, place)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<first_word:bigint,last_word:bigint,score:double>>")
