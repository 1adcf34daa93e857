"""Token ids against the tokenizers library, packing and file round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panewise.llm import packing, token_files
from panewise.llm.bpe import Coder
from panewise.llm.queries import QUERIES, vocabulary
from panewise.session import work_folder

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(vocabulary())
CODER = Coder(vocabulary())


def own(texts):
    out = []
    for low, high, _, _, ids, bounds, *_ in CODER.encode(texts):
        out += [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(high - low)]
    return out


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z's t'll''re  \n\t é漢٣7!?.🎉") | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_ids_equal_the_library(texts):
    assert own(texts) == library(texts)


def test_added_tokens_and_nulls():
    texts = ["a<|endoftext|>b", None, "", "plain", "'s", "x's'", " 'll"]
    assert own(texts) == library(texts)


def test_ids_survive_forgetting(monkeypatch):
    monkeypatch.setattr("panewise.llm.bpe.REMEMBERED", 64)
    texts = [f"word{i} other{i % 7} again" for i in range(500)]
    coder = Coder(vocabulary())
    got = [ids.tolist() for t in texts for *_, ids, _, _, _ in coder.encode([t])]
    assert got == library(texts)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(rows, documents):
    """rows against (doc_id, text): every id in one piece, no gap, no sequence over 1024."""
    wanted = sorted((d is None, d, len(ids) + 1, crc([*ids, 0])) for (d, _), ids in zip(documents, library([t for _, t in documents]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted({(d is None, d) for d, _ in documents}) == sorted((d is None, d) for d in by_doc)
    for d, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(n for _, x, n, _ in wanted if x == d)
        texts = [t for x, t in documents if x == d]
        if len(texts) == 1:
            ids, at = [*library(texts)[0], 0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
                at += p.length
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, padding + sum(r.length for r in rows))


def test_packing_of_the_whole_table(spark):
    documents = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_pieces(QUERIES["op3_packing"](spark, SF).collect(), documents) < 0.02


def test_packing_of_odd_documents(spark, odd_documents, no_documents):
    documents = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    check_pieces(packing.packed(odd_documents.coalesce(1), vocabulary()).collect(), documents)
    assert packing.packed(no_documents, vocabulary()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(0, 9)), min_size=1, max_size=40))
def test_cuts_are_optimal(steps):
    positions, penalties = [0], [0]
    for gap, cost in steps:
        positions.append(positions[-1] + gap)
        penalties.append(cost)
    pad = lambda n: 0 if n & (n - 1) == 0 and n >= 4 or n == 16 else 16 - n
    best = [0] + [10**9] * len(steps)
    for i in range(1, len(positions)):
        for j in range(i):
            if positions[i] - positions[j] <= 16:
                best[i] = min(best[i], best[j] + pad(positions[i] - positions[j]) + penalties[i])
    chosen = packing.cuts(positions, penalties, 16, 4)
    cost = sum(pad(positions[b] - positions[a]) + penalties[b] for a, b in zip(chosen[:-1], chosen[1:], strict=True))
    assert chosen[0] == 0 and chosen[-1] == len(steps) and cost == best[-1]


def test_token_files_of_the_whole_table(spark):
    documents = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    at, wanted = 0, []
    for (d, _), ids in zip(documents, library([t for _, t in documents]), strict=True):
        wanted.append((d, at, len(ids) + 1, crc([*ids, 2])))
        at += len(ids) + 1
    got = QUERIES["op7_token_files"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == wanted


def test_token_files_open_single_documents(spark, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2000)
    folder = work_folder(spark, "test-files")
    token_files.write(odd_documents, vocabulary(), folder, 2)
    rows = token_files.read(spark, folder).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and len(rows) == odd_documents.count()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    texts = [r.text for r in odd_documents.where("doc_id = 4").collect()]
    assert sorted(token_files.document(spark, folder, 4)) == sorted([*x, 2] for x in library(texts))
    assert token_files.document(spark, folder, 99) == []
    with pytest.raises(ValueError, match="dictionary"):
        token_files.opened(b"", None, 2, "a", "b")
    folder = work_folder(spark, "test-files")
    token_files.write(no_documents, vocabulary(), folder, 2)
    assert token_files.read(spark, folder).count() == 0
