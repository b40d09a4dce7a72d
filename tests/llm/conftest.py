import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l".split()]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of documents with the columns that operators meet, and two whose names they use themselves."""

    def make(texts, ids=None, **more):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        columns = {"doc_id": ids, "text": texts, "lang": ["en"] * n, "source": [f"s{i % 3}" for i in range(n)], "n_chars": [len(t or "") for t in texts], "row": ["x"] * n, "score": [7] * n} | more
        shape = "doc_id long, text string, lang string, source string, n_chars long, row string, score int"
        return spark.createDataFrame(list(zip(*(columns[c.split()[0]] for c in shape.split(", ")), strict=True)), shape).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random words."""

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


#: Texts every operator has to take: null, empty, blank, no letters, one word, very long word, odd characters.
ODD = [None, "", " \t\n", "12 34 !!", "word", "x" * 50_000, "a b   ß É \U0001f600 İ", "a b", "a b"]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
