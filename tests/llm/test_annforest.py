import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import annforest

SCHEMA = "vec_id long, embedding array<float>, label int, id long, hash long, hashes string, part long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, None, None, None) for i, v in rows], SCHEMA)


def slow(rows, k=20):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            out[q] = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
    return out


def answers(spark, rows, **options):
    got = {}
    for r in annforest.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r.query_id, []).append(r)
    for rs in got.values():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(rs, rs[1:]))
    return got


def share(got, want):
    hits = sum(len({r.vec_id for r in got[q]} & {i for _, i in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize(("candidates", "group", "least"), [(10**9, 1 << 16, 1.0), (4000, 1 << 16, 0.9), (4000, 150, 0.9), (None, 150, 0.93)])
def test_recall(spark, candidates, group, least):
    """All rows as candidates: exact; fewer, or a fitted number: at least 0.9
    of the nearest, on clusters of unequal norms, in one block or many."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((25, 16)) * rng.uniform(0.5, 2, (25, 1))
    x = (centres[rng.integers(25, size=800)] + 0.25 * rng.standard_normal((800, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = answers(spark, rows, candidates=candidates, group_rows=group, trees=16), slow(rows)
    assert got.keys() == want.keys() and share(got, want) >= least
    for q, rs in got.items():
        assert len(rs) == 20
        assert all(abs(r.score - float(x[q].astype(float) @ x[r.vec_id].astype(float))) < 1e-9 for r in rs)


@pytest.mark.parametrize("group", [60, 1 << 16])
def test_skew_loses_no_result(spark, group):
    """Most rows in one tight cluster, the rest scattered, one vector a
    thousand times longer: every query gets its 20 rows at the least budget,
    however small the blocks, and the long one is never missed."""
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.standard_normal(12) + 1e-3 * rng.standard_normal((900, 12)), rng.standard_normal((59, 12)), 1000 * np.ones((1, 12)))).astype(np.float32)
    x = x[np.r_[:959][rng.permutation(959)].tolist() + [959]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = answers(spark, rows, candidates=0, group_rows=group, trees=4), slow(rows)
    assert got.keys() == want.keys() and all(len(rs) == 20 for rs in got.values())
    assert all({r.vec_id for r in got[q]} >= {i for _, i in want[q] if i == 959} for q in want)


def test_depth_and_candidates():
    """A query that matches nothing deeply ascends to all rows at depth 0;
    counts and candidates are those of plain prefixes."""
    rng = np.random.default_rng(2)
    h, q = (rng.integers(0, 1 << 16, (n, 3)).astype(np.uint32) for n in (400, 9))
    forest = annforest.Forest(h, np.arange(400) < 2, 16)
    counts = forest.counts(q)
    for i in range(9):
        shared = annforest.shared_bits(h, q[i], 16)
        assert shared.max() <= 16 and all(f"{a:016b}"[:n] == f"{b:016b}"[:n] and (n == 16 or f"{a:016b}"[n] != f"{b:016b}"[n]) for row, ns in zip(h[:20], shared[:20]) for a, b, n in zip(row, q[i], ns))
        for d in range(17):
            assert counts[i, d] == (shared[2:] >= d).sum()
        for d in (0, 3, 16):
            met = list(forest.candidates(q[i : i + 1], np.array([d])))[0]
            assert set(met) == set(np.flatnonzero((shared >= d).any(axis=1))) | {0, 1}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (20, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 0.0]), (40, [1.0, 0.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (None, [1.0, 1.0]), (8, [])]
    out = {}
    for r in annforest.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, trees=4).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert out == {0: [(7, 2.0), (6, 1.0), (40, 1.0)], 40: [(7, 2.0), (0, 1.0), (6, 1.0)]}
    assert annforest.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(200)]
    out = annforest.nearest(frame(spark, rows), F.col("vec_id") == 20, trees=4).collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank)] == list(range(20))


def test_a_repeated_id_has_one_vector(spark):
    """The least of its vectors, whichever order they come in."""
    rows = [(0, [1.0, 0.0]), (1, [5.0, 1.0]), (1, [2.0, 9.0]), (2, [3.0, 0.0])]
    for some in (rows, rows[::-1]):
        out = answers(spark, some, trees=4)
        assert [(r.vec_id, r.score) for r in out[0]] == [(2, 3.0), (1, 2.0)]
