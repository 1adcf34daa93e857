"""The pipeline against a brute-force version of its stages."""

import sys
import zlib
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_pairs import brute_jaccard, brute_leaks  # noqa: E402
from test_texts import brute_spans  # noqa: E402

from panewise.llm.queries import vocabulary  # noqa: E402

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = "", 0
    for s, _, e in brute_spans(text):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def brute(documents, items):
    rows = [(d, t) for d, t in documents if t and any(c.isalpha() for c in t)]
    groups = brute_jaccard(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    bad = {d for d, _ in brute_leaks(rows, items)}
    return {d: redacted(t) for d, t in rows if d not in bad}


def test_pipeline_equals_brute_force(spark):
    documents, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    wanted = brute(documents, items)
    assert 0 < len(wanted) < len(documents)
    library = Tokenizer.from_file(vocabulary())
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == wanted.keys()
    for d, text in wanted.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)


def test_stages_take_odd_and_empty_tables(spark, odd_documents, no_documents):
    for docs, empty in ((odd_documents, False), (no_documents, True)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SF)
            assert (got.count() == 0) == empty, name
            assert got.columns == docs.columns or name == "packing"
