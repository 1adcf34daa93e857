import random

import pytest

from panewise.llm.common import importable

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(autouse=True, scope="session")
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and clashing names."""
    rnd = random.Random(5)
    prose = " ".join(rnd.choice(WORDS) for _ in range(40))
    long = " ".join(rnd.choice(WORDS) for _ in range(30_000))
    texts = [None, "", " \n\t", "...", prose, prose, prose + " more", long, "Mixed CASE text. And one more!", "é漢字 🎉", "x" * 70_000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, prose, None, None, None), (None, None, None, None, None), (4, prose, "en", "s", 1), (4, "another text of id four", "en", "s", 1)]
    rows = [(*r, 7, "clash", 0.5, 3, "y") for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, fold int, label string, score double, n long, sig string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
