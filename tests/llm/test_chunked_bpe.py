"""Chunked encoding and decoding against the tokenizers library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panewise.llm import chunked_bpe
from panewise.llm.chunked_bpe import ChunkCoder, decoded, digests, encoded, pieces
from panewise.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
PATH = vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = ChunkCoder(PATH)
#: Contractions, joining marks, letters whose lower case is longer, jamo, special tokens.
ODD = "'relsvmdt 'll \t ȩ̣́̈İıIΣǅ한한क़12٣!?.🎉漢<|endoftext|>"


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text, coder=CODER):
    return coder.ids(coder.encode(text)).tolist()


@pytest.fixture
def tiny_chunks(monkeypatch):
    for name, value in {"WINDOW": 2, "MEAN": 3, "LEAST": 1, "MOST": 7, "STRETCH": 2}.items():
        monkeypatch.setattr(chunked_bpe, name, value)


@pytest.mark.usefixtures("tiny_chunks")
def test_joins_of_tiny_chunks():
    @settings(max_examples=2000, deadline=None)
    @given(st.text(st.sampled_from(ODD) | st.characters(exclude_categories=["Cs"]), max_size=60))
    def check(text):
        assert "".join(pieces(text)) == text
        assert own(text) == ids(text)

    check()


def test_plain_characters_are_cut_and_lowered_as_the_library_does():
    for c in map(chr, range(0x300)):
        for text in (c, f"a{c}b", f"1{c}'s", f"{c}{c} {c}"):
            assert CODER.ids(CODER.stretch(text).words(0)).tolist() == ids(text)


@pytest.mark.parametrize("text", ["x" * 70_000, "漢字" * 9000, "'re" * 4000, "é" * 5000, "́" * 3000, "한" * 3000, "12345" * 2000, "<|endoftext|>" * 500, "a b " * 20_000])
def test_texts_that_agree_late_or_never(text):
    assert own(text) == ids(text)


def test_shared_passages_are_encoded_once(spark):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("length(text) > 5000").limit(5).collect()]
    coder = ChunkCoder(PATH)
    for text in rows:
        coder.encode(text)
    before = coder.encoded
    for k, text in enumerate(rows):
        assert own(f"Edited {k}. {text} And more.", coder) == ids(f"Edited {k}. {text} And more.")
    assert coder.encoded - before < 0.25 * before


def test_bounded_memory(monkeypatch):
    monkeypatch.setattr(chunked_bpe, "CHUNK_CHARS", 900)
    monkeypatch.setattr(chunked_bpe, "WORDS", 50)
    coder = ChunkCoder(PATH)
    for k in range(200):
        text = " ".join(f"word{k * j} again" for j in range(90))
        assert own(text, coder) == ids(text)
        assert sum(map(len, coder.chunks)) <= 900 + 2048 and len(coder.word_ids) <= 50


def row(doc, text):
    found = ids(text or "")
    shown = LIBRARY.decode(found, skip_special_tokens=False)
    return doc, len(found), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, found)), shown))


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(str, r)))


def test_whole_table(spark):
    documents = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert order(map(tuple, QUERIES["op11_chunked_bpe"](spark, SF).collect())) == order(row(*d) for d in documents)


def test_odd_documents(spark, odd_documents, no_documents):
    documents = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    found = encoded(odd_documents, PATH)
    assert order(map(tuple, digests(found).collect())) == order(row(*d) for d in documents)
    again = decoded(found.select("doc_id", "ids"), PATH)
    assert order(map(tuple, digests(again).collect())) == order(row(*d) for d in documents)
    assert digests(encoded(no_documents, PATH)).count() == 0
