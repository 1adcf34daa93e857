"""License scans by template markup compiled to token automata.

A template is a license's wording with markup: [a b|c] is optional, one of its alternatives or
nothing; {n} is replaceable, at most n words of any kind. All other words are mandatory. The
templates compile into one automaton over words; a text has a license's label where its words run
from a template's start to its end, so every mandatory word is there, in order and exactly, and
nothing but optional and replaceable words between them. The automaton starts at every word of a
text, so all of the text is read; texts without any word that only templates' triggers have are
passed over, since each template has its trigger among its mandatory words.

Base labels come from fixed phrases, found wherever their words stand consecutively. Words are runs
of letters, digits and non-ASCII characters, A-Z lower-cased.

The score is the largest share of a template's mandatory words that some place has matched in
order, 1 where a label was found. Cases: a null text counts as empty, with no words and no labels;
repeated rows and null ids are kept; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chars
from .common import texts

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licenses. (label, trigger word, template)
TEMPLATES = (
    ("mit", "mit", "[released|licensed|distributed|available|provided] under the [terms of the|conditions of the] mit license"),
    (
        "mit", "merge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    ("apache-2", "apache", "[licensed|released|distributed] under the [terms of the] apache license version 2 [0]"),
    ("cc-by", "attribution", "creative commons attribution [4|3|2] [0|5] [international|unported|generic] license"),
    ("cc-by-nc", "cc", "[licensed|released|available] under [a|the] [creative commons] cc by nc [sa|nd] {2} [license]"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial [sharealike|noderivatives|noderivs] {3} license"),
    ("gpl", "gnu", "[licensed] under the [terms of the] gnu [affero|lesser|library] general public license [as published by the free software foundation] [either] version {2}"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "fee", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
)

FOUND = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, places array<struct<label:string,first_word:bigint,last_word:bigint>>"
)


class Automaton:
    """States are numbers; a state has words that lead on, or any word, and ends of labels."""

    def __init__(self, templates):
        self.words: list[dict[str, set[int]]] = []
        self.any: list[set[int]] = []
        self.free: list[set[int]] = []  # reached without a word
        self.share: list[float] = []
        self.ends: dict[int, str] = {}
        start = self.state(0.0)
        for label, _, template in templates:
            parts = re.findall(r"\[[^]]*\]|\{\d+\}|\S+", template)
            mandatory = sum(p[0] not in "[{" for p in parts)
            at, seen = self.state(0.0), 0
            self.free[start].add(at)
            for p in parts:
                seen += p[0] not in "[{"
                after = self.state(seen / mandatory)
                if p[0] == "[":
                    self.free[at].add(after)
                    for choice in p[1:-1].split("|"):
                        self.path(at, after, choice.split())
                elif p[0] == "{":
                    self.free[at].add(after)
                    here = at
                    for _ in range(int(p[1:-1])):
                        on = self.state(self.share[at])
                        self.any[here].add(on)
                        self.free[on].add(after)
                        here = on
                else:
                    self.path(at, after, [p])
                at = after
            self.ends[at] = label
        self.start = self.closed({start})

    def state(self, share: float) -> int:
        self.words.append({})
        self.any.append(set())
        self.free.append(set())
        self.share.append(share)
        return len(self.words) - 1

    def path(self, at: int, to: int, words: list[str]) -> None:
        for k, w in enumerate(words):
            on = to if k == len(words) - 1 else self.state(self.share[at])
            self.words[at].setdefault(w, set()).add(on)
            at = on

    def closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        return self.closed({t for s in states for t in (*self.words[s].get(word, ()), *self.any[s])})

    def scan(self, words: list[str]) -> tuple[set[tuple[str, int, int]], float]:
        """(label, first word, last word) of every accepted run, the longest from each start, and
        the best share of mandatory words."""
        openers = {w for s in self.start for w in self.words[s]}
        found, best = set(), 0.0
        for first, word in enumerate(words):
            if word not in openers:
                continue
            states, last = self.start, {}
            for k in range(first, len(words)):
                states = self.step(states, words[k])
                if not states:
                    break
                best = max(best, max(self.share[s] for s in states))
                for s in states:
                    if s in self.ends:
                        last[self.ends[s]] = k
            found |= {(label, first, k) for label, k in last.items()}
        return found, 1.0 if found else best


def hash_of(words: list[str]) -> np.ndarray:
    """The words' hashes as in a block."""
    _, _, cp, starts = next(chars.blocks(words))
    return chars.span_hashes(cp, starts[:-1], starts[1:] - 1)


@cache
def compiled():
    phrases = [(label, hash_of(p.split())) for p, label in PHRASES.items()]
    return Automaton(TEMPLATES), hash_of(sorted({t for _, t, _ in TEMPLATES})), phrases


def scan(batch: list[str | None]) -> Iterator[dict]:
    automaton, triggers, phrases = compiled()
    for low, high, cp, starts in chars.blocks(batch):
        cp = chars.lowered(cp)
        s, e = chars.spans(chars.table("wordlike")[cp])
        h = chars.span_hashes(cp, s, e)
        first = np.searchsorted(s, starts)
        owner = np.repeat(np.arange(high - low), np.diff(first))
        base: list[list[tuple[str, int]]] = [[] for _ in range(high - low)]
        for label, p in phrases:
            n = len(p)
            at = np.flatnonzero(h[: len(h) - n + 1] == p[0]) if len(h) >= n else np.empty(0, np.int64)
            for k in range(1, n):
                at = at[h[at + k] == p[k]]
            at = at[owner[at] == owner[at + n - 1]] if len(at) else at
            for i in at.tolist():
                base[owner[i]].append((label, i - int(first[owner[i]])))
        wanted = np.unique(owner[np.isin(h, triggers)])
        more: dict[int, tuple] = {}
        for k in wanted.tolist():
            words = [cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(s[first[k] : first[k + 1]].tolist(), e[first[k] : first[k + 1]].tolist(), strict=True)]
            more[k] = automaton.scan(words)
        for k in range(high - low):
            found, score = more.get(k, (set(), 0.0))
            own = sorted({x for x, _ in base[k]})
            at = [i for _, i in base[k]]
            yield {
                "n_words": int(first[k + 1] - first[k]), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
                "base_labels": ",".join(own), "labels": ",".join(sorted({*own, *(x for x, _, _ in found)})), "score": 1.0 if own else score,
                "places": [{"label": x, "first_word": a, "last_word": b} for x, a, b in sorted(found)],
            }


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each row of (doc_id, text); places are the templates' word runs."""
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(place)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(scan(texts(batch)))
            cols = [pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
