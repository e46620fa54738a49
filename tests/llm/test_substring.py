import random
from collections import Counter

import pytest

from tests.llm.conftest import prose
from tracelake.llm import substring


def slow(texts, n):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize(("window", "block", "bucket"), [(35, 1 << 20, 6 << 20), (35, 2000, 3000), (5, 1000, 500)])
def test_against_brute_force(spark, make, window, block, bucket):
    rng = random.Random(7)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randrange(0, 200)) for _ in range(40)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(6)] + [texts[3], texts[3], passage + "  \t" + passage, "x " * 100, None, ""]
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(make(list(enumerate(texts))), window=window, block_bytes=block, bucket_bytes=bucket).collect()}
    assert [out[i] for i in range(len(texts))] == slow(texts, window)


def test_odd_rows(odd, make):
    out = substring.dedup_substrings(odd)
    rows = out.collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in by[5]] == [60, 60] and by[6][0].n_removed == 0 and by[1][0].kept == "" and by[3][0].n_words == 0
    assert substring.dedup_substrings(make([])).count() == 0


def test_rows_that_repeat_often(make, monkeypatch):
    """Copies of whole rows, nulls and short texts beside the blocks, and what
    they share with others still found."""
    monkeypatch.setattr(substring, "UNFOLDED", 3)
    rng = random.Random(2)
    base, alone = prose(rng, 60, 10**6), prose(rng, 50, 10**6)
    rows = [(7, base)] * 8 + [(8, "x " + base + " y")] + [(9, None)] * 7 + [(None, None)] * 7 + [(10, "a b")] * 9 + [(11, "z" * 80)] * 6 + [(12, alone)] + [(None, alone + " end")] * 6
    out = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(make(rows), copies=4).collect())
    assert out == sorted((i or 0, *x) for (i, _), x in zip(rows, slow([t for _, t in rows], 35)))
