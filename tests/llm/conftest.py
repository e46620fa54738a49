import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, block long, size long, key string, kept string, lines string, tid string, hot boolean, ids string, rank string, quality string"
N_EXTRA = 11
WORDS = "the of and to in is it on as with by at from this that are be or an was her his one all".split()


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, *[None] * N_EXTRA)


@pytest.fixture
def make(spark):
    """Rows (doc_id, text[, lang, source]) as documents with extra columns
    whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], DOCS)


@pytest.fixture
def odd(make):
    """Nulls everywhere, empty and very long texts, repeated rows."""
    rng = random.Random(3)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    same = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = [(1, None), (2, ""), (3, "   \n\t\n"), (4, long), (5, same), (5, same), (6, same.upper()), (None, same), (7, "x"), (8, same, None, None), (9, "é\nÉ é 中文 😀"), (None, None, None, None)]
    return make(rows)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))
