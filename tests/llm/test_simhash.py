import random

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import prose
from tracelake.llm import simhash


def slow_fingerprint(text, n=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    out = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams):
            out |= 1 << b
    return out


def slow_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a b c", "a  B\tc\nd é É", "x " * 500, "  a"])
def test_fingerprint(text):
    assert simhash.document_fingerprint(text, 3) == slow_fingerprint(text)


def test_components_against_all_pairs(spark, make):
    rng = random.Random(5)
    texts = [prose(rng, 80) for _ in range(40)]
    for _ in range(80):  # near copies of copies
        words = rng.choice(texts).split()
        words[rng.randrange(len(words))] = f"z{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts += rng.choices(texts, k=30)
    out = {r.doc_id: r for r in simhash.near_duplicates(make(list(enumerate(texts)))).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    label = slow_components(fps)
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    assert all(out[i].fp % (1 << 64) == fps[i] for i in out)
    assert [out[i].component_id for i in range(len(texts))] == [least[x] for x in label]
    assert len(set(label)) < len(texts) - 40


@pytest.mark.parametrize("hot", [2048, 3])
def test_links_connect_all_within_three_bits(spark, hot):
    """Dense clusters too, with buckets passed on for refinement or not."""
    rng = np.random.default_rng(1)
    fps = []
    for base in rng.integers(0, 1 << 63, 6, dtype=np.uint64).tolist():
        for _ in range(60):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, 3, hot).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    group = {x: {x} for x in fps}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                assert group[a] is group[b]


@pytest.mark.parametrize("local", [1 << 20, 100, 0])
def test_connected(spark, local):
    """By stars to the end, or by one task from some point on."""
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in simhash.connected(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    assert all(got.get(x, x) == least for x, least in label.items())


def test_odd_rows(odd, make):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert {by[i][0].component_id for i in (1, 2, 3)} == {1} and by[1][0].fp == 0
    assert {r.component_id for i in (5, 6, 8) for r in by[i]} == {5} and len(by[5]) == 2
    assert sorted(r.component_id for r in by[None]) == [1, 5]
    assert simhash.near_duplicates(make([])).count() == 0


def test_similar_documents(spark, make):
    """Near copies are found over a large group and small ones, chains
    included; texts of another content stay alone."""
    rng = random.Random(8)
    texts = [prose(rng, 150, 5000) for _ in range(60)]
    base = len(texts)
    origin = list(range(base))
    for k in range(120):
        i = 0 if k < 60 else rng.randrange(base)
        words = texts[i].split()
        words[rng.randrange(len(words))] = f"z{k}"
        texts.append(" ".join(words))
        origin.append(i)
    out = {r.doc_id: r.component_id for r in simhash.similar_documents(make(list(enumerate(texts)))).collect()}
    assert [out[i] for i in range(len(texts))] == origin


def test_similar_odd_rows(odd, make):
    out = {}
    for r in simhash.similar_documents(odd).collect():
        out.setdefault(r.doc_id, []).append(r.component_id)
    assert sum(map(len, out.values())) == odd.count()
    assert {out[i][0] for i in (1, 2, 3)} == {1} and out[5] == [5, 5] and out[6] == [5] and out[8] == [5] and sorted(out[None]) == [1, 5]
    assert simhash.similar_documents(make([])).count() == 0


def jaccard_components(texts, least=0.8, n=5):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return label


def test_signatures_bound_the_difference():
    """No pair of sets differs in fewer shingles than their signatures in bits."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        both, a, b = (rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 300)) for _ in range(3))
        x, y = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
        differ = int(np.bitwise_count((simhash.parities(x) ^ simhash.parities(y)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(x, y))


@pytest.mark.parametrize(("rows", "many"), [(1024, 16), (3, 2)])
def test_similar_documents_recall(spark, make, monkeypatch, rows, many):
    """Lone pairs of similarity 0.7 to 0.9 and a family of copies, against
    brute force; shingles of many documents whole and in parts."""
    monkeypatch.setattr(simhash, "MANY", many)
    rng = random.Random(12)
    texts = []
    for k in range(150):
        words = prose(rng, 200, 10**6).split()
        texts.append(" ".join(words))
        for _ in range(2 + k % 6):
            words[rng.randrange(len(words))] = f"z{rng.random()}"
        texts.append(" ".join(words[k % 9 :]))
    base = prose(rng, 200, 10**6).split()
    for _ in range(60):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(len(words))] = f"z{rng.random()}"
        texts.append(" ".join(words))
    want = jaccard_components(texts)
    assert 60 < sum(want[i + 1] == want[i] for i in range(0, 300, 2)) < 150
    out = {r.doc_id: r.component_id for r in simhash.similar_documents(make(list(enumerate(texts))), bucket_rows=rows).collect()}
    assert [out[i] for i in range(len(texts))] == want
