import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from tracelake.llm import heavylight, jaccardjoin, simhash


def brute(rows, n=5):
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    least = {}
    for (i, _), v in zip(rows, label):
        least[v] = min((x for x in (least.get(v), i) if x is not None), default=None)
    return sorted([(i, len(s), least[v]) for (i, _), s, v in zip(rows, sets, label)], key=str)


def run(make, rows, **settings):
    return sorted(map(tuple, jaccardjoin.linked_documents(make(rows), **settings).collect()), key=str)


def edited(words, k, rng):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"z{rng.random()}"
    return words


def sample(seed=12):
    """Pairs of all similarities and sizes, a chained family, a passage that
    many share, copies."""
    rng = random.Random(seed)
    texts = []
    for k in range(120):
        n = rng.choice([1, 2, 4, 5, 6, 9, 10, 14, 30, 60, 200, 700])
        words = prose(rng, n, 10**6).split()
        texts.append(" ".join(words))
        texts.append(" ".join(edited(words, rng.randrange(1 + n // 40 + 1), rng)[k % 3 :]))
    base = prose(rng, 200, 10**6).split()
    for _ in range(50):
        texts.append(" ".join(edited(base, 3, rng)))
    passage = prose(rng, 60, 10**6)
    texts += [prose(rng, 25, 10**6) + " " + passage + " " + prose(rng, 25, 10**6) for _ in range(40)]
    texts += [texts[0].upper()] * 30 + ["a b c d e f g h i", "a b c d e f g h i j", "a b c d", "a b c d e"]
    return list(enumerate(texts))


@pytest.mark.parametrize("settings", [{}, {"light": 0}, {"light": 150}, {"light": 10**6, "hot": 7, "many": 3}, {"hot": 5, "many": 2, "light": 40}, {"hot": 3, "many": 16, "light": 0}])
def test_against_brute_force(make, settings):
    """Whatever the boundary, and with lists that are long for the setting."""
    rows = sample()
    assert run(make, rows, **settings) == brute(rows)


def test_odd_rows(odd, make, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(make, rows) == brute(rows)
    assert run(make, []) == []
    none = [(1, None), (2, ""), (3, " \n"), (None, None)]
    assert run(make, none) == brute(none) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)], key=str)


def test_boundary_by_cost(spark):
    """Few shared shingles in long lists make sets light; many shared ones in
    short lists, heavy."""
    columns = "node long, n int, ats array<int>, keys array<bigint>, ms array<bigint>"
    long_lists = [(k, 20, [3, 4], [1, 2], [50_000, 50_000]) for k in range(20)]
    assert heavylight.boundary(spark.createDataFrame(long_lists, columns), 0.8) >= 20
    short = [(k, 200, list(range(40)), [k * 100 + i for i in range(40)], [2] * 40) for k in range(20)]
    assert heavylight.boundary(spark.createDataFrame(short, columns), 0.8) < 200


def test_frequencies_stream(spark, monkeypatch):
    """Keys over several Arrow batches, and of more nodes than are counted."""
    monkeypatch.setattr(heavylight, "OFTEN", 50)
    rows = [(k % 7, k, 3, 0) for k in range(70)] + [(100, k, 3, 0) for k in range(300)] + [(200, 1, 3, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        got = heavylight.frequencies(spark.createDataFrame(rows, "key long, node long, n int, at int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.key, r.node, r.m) for r in got) == sorted([(k % 7, k, 10) for k in range(70)] + [(100, k, 50) for k in range(300)])


def test_two_shingles_of_longer_prefixes():
    """Sets of the similarity share two shingles of prefixes one longer."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(4, 80))
        a = rng.permutation(1000)[:n]
        b = np.concatenate((a[rng.permutation(n)[: n - n // 9]], rng.permutation(np.arange(1000, 1100))[: int(rng.integers(0, 3))]))
        both = len(np.intersect1d(a, b))
        if both * 1.8 >= 0.8 * (len(a) + len(b)) and both > 1:
            first = [np.sort(x)[: heavylight.prefix_length(len(x), 0.8) + 1] for x in (a, b)]
            assert len(np.intersect1d(*first)) >= 2


def test_long_signatures_keep_links():
    """They differ in no more than two sets do, whatever their sizes, and tell
    large sets apart that share little."""
    rng = np.random.default_rng(7)
    for n in (513, 1000, 1024, 1025, 1800, 3000, 9000):
        a = rng.integers(-(2**63), 2**63 - 1, n)
        b = np.concatenate((a[: n - n // 10], rng.integers(-(2**63), 2**63 - 1, n // 10 + 30)))
        x, y = heavylight.long_parities(a), heavylight.long_parities(b)
        assert len(x) * 8 >= n
        assert heavylight.differing(x, y) == heavylight.differing(y, x) <= len(np.setxor1d(a, b))
        other = heavylight.long_parities(rng.integers(-(2**63), 2**63 - 1, n))
        assert heavylight.differing(x, other) > 2 * n / 9
    assert heavylight.long_parities(a[:512]) is None


def test_large_texts_with_a_passage_are_not_verified(make, monkeypatch):
    """Long texts that share a passage, or are variants of one text below the
    similarity, are not fetched for an exact check; links are."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(40)]
    texts = [[f"a{i}x{k}" for k in range(1500)] + passage for i in range(20)]
    base = [f"b{k}" for k in range(2000)]
    texts += [edited(base, 90, rng) for _ in range(20)]
    texts += [base, edited(base, 10, rng)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    asked, real = [], jaccardjoin._verified
    monkeypatch.setattr(simhash, "COMMON", 0)  # as if none were in the sample
    monkeypatch.setattr(jaccardjoin, "_verified", lambda pairs, *more: asked.append(pairs.count()) or real(pairs, *more))
    assert run(make, rows) == brute(rows)
    assert 0 < sum(asked) <= 60


def test_word_hashes(monkeypatch):
    """One for each word, the same wherever it stands and in whatever part."""
    text = "".join(random.Random(9).choices(["a", "B", "é", "\x1c", "zz", " ", "\n", "\t ", "w" * 300], k=4000))
    words = text.encode().lower().split()
    got = simhash.word_hashes(text)
    assert len(got) == len(words)
    assert len(set(zip(words, got.tolist()))) == len(set(words)) == len(set(got.tolist()))
    monkeypatch.setattr(simhash, "TEXT_PART", 100)
    assert simhash.word_hashes(text).tolist() == got.tolist()
    assert [len(simhash.word_hashes(t)) for t in (None, "", " \n", "x" * 500, " " * 500 + "x")] == [0, 0, 0, 1, 1]
