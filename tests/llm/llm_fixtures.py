"""Tables the corpus tests share."""

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, words, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None, langs=None):
        n = len(texts)
        ids, sources, langs = ids or list(range(n)), sources or ["a"] * n, langs or ["en"] * n
        rows = [(i, t, g, s, None if t is None else len(t)) for i, t, s, g in zip(ids, texts, sources, langs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, repeated ids and columns of clashing names."""
    rng = random.Random(3)
    long = "\n".join(sentence(rng, 50, 5000) for _ in range(2000))
    rows = [
        (1, "one two three four five six\nline\nmore", "en", "a", 1), (1, "one two three four five six\nline\nmore", "en", "a", 1),
        (2, None, "en", "a", None), (3, "", "de", None, 0), (4, " \n\t ", None, "b", 4), (None, "a text without an id", None, None, None),
        (None, None, None, None, None), (5, long, "en", "b", len(long)), (6, long, "en", "b", len(long)), (7, "word", "fr", "c", 4),
        (7, "another text of the same id", "fr", "c", 9), (8, "mail to ab.1@mail.example.com, 10.20.30.40", "xx", "c", 9), (9, "É" * 300, "fr", "c", 300),
    ]
    clash = ["doc", "k", "h1", "rep", "spans", "lines", "size", "target", "draw", "mix_copies", "type", "own", "score", "held_out", "toxic", "limit"]
    rows = [(*r, *[i] * len(clash)) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} int" for c in clash))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (7, 1, 1), (None, 1, 1), (5, None, None), (8, 1, 0), (9, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int"
    )
