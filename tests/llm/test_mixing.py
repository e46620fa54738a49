import hashlib

from pyspark.sql import functions as F

from tracelake.llm import mixing


def slow_targets(sizes, weights, epochs=3):
    """Clamp one round after another."""
    total, clamped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in clamped}
        left = total - sum(clamped.values())
        if not free:
            return clamped
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return clamped | share
        clamped |= {s: epochs * sizes[s] for s in over}


def slow_mix(rows, epochs=3):
    """How often each of ``(id, source, size)`` is taken: one pass over the
    seeded order after another, one document at a time; ids differ."""
    order = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    sizes = {s: sum(n for _, t, n in rows if t == s) for s in order}
    targets = slow_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, epochs)
    times = {}
    for s in order:
        mine = sorted((hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}:{n}".encode()).hexdigest(), i, n) for i, t, n in rows if t == s)
        whole = min(int(targets[s] // sizes[s]), epochs) if sizes[s] else 0
        times |= {i: whole for _, i, _ in mine}
        missing, taken = targets[s] - whole * sizes[s], set()
        for _ in range(mixing.PASSES):
            upto, some = 0, [x for x in mine if x not in taken and 0 < x[2] <= missing]
            for x in some:
                upto += x[2]
                if upto <= missing:
                    taken.add(x)
            missing -= sum(x[2] for x in some if x in taken)
        spare = [(abs(n - missing), r, i, n) for r, i, n in mine if (r, i, n) not in taken and 0 < n < 2 * missing]
        taken |= {min(spare)[1:]} if spare else set()
        for _, i, _ in taken:
            times[i] += 1
    return times


def test_against_brute_force(spark, make):
    rows = [(i, "w " * (1 + (i * 7919) % 97 * (1 + 30 * (i % 11 == 0))), "en", ["a", "b", "c", None][i * i % 7 % 4]) for i in range(300)]
    got = {r.doc_id: r.repeats for r in mixing.mix(make(rows)).collect()}
    assert got == slow_mix([(i, s, len(t.split())) for i, t, _, s in rows])


def test_targets_and_closeness(spark, make):
    rows, i = [], 0
    for k, (source, n) in enumerate({"a": 4, "b": 400, "c": 30, None: 90, "é": 0}.items()):
        for _ in range(n):
            rows.append((i, "w " * (1 + (i * 7919) % 50 + k), "en", source))
            i += 1
    rows.append((i, None, "en", "é"))
    out = mixing.mix(make(rows)).collect()
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = slow_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert abs(mine[0].target - want[s]) < 1e-6 and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= 5
    assert all(r.taken == r.repeats * r.size <= 3 * r.size for r in out)
    assert sorted(map(tuple, mixing.mix(make(rows[::-1])).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_one_dominant_text(spark, make):
    """A long text at the edge shuts nothing out: smaller ones fill the rest."""
    rows = [(0, "w " * 200_000, "en", "a")] + [(i, "w " * 100, "en", "a") for i in range(1, 1001)]
    weights = [("a", 90), ("b", 210 + 90)]
    rows += [(2000 + i, "v " * 1000, "en", "b") for i in range(90)]
    frame = spark.createDataFrame(weights, "source string, weight long")
    for seed in ("1", "2", "3"):
        out = mixing.mix(make(rows), weights=frame, seed=seed).collect()
        a = [r for r in out if r.source == "a"]
        assert 100_000 < a[0].target < 200_000
        small = sum(r.taken for r in a if r.size == 100)
        assert small == 100_000 and sum(r.repeats for r in a if r.size > 100) in (0, 1)
        assert abs(sum(r.taken for r in a) - a[0].target) <= abs(100_000 - a[0].target)


def test_copies_of_one_row(spark, make, monkeypatch):
    """Copies are taken one by one and unfolded in parts; null ids too."""
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(5, "a b c", "en", "s")] * 50 + [(None, "a b", "en", "s")] * 30 + [(100 + i, "x " * 40, "en", "t") for i in range(6)]
    out = mixing.mix(make(rows), weights=spark.createDataFrame([("s", 1), ("t", 3)], "source string, weight long")).collect()
    assert len(out) == 86 and sum(r.doc_id == 5 for r in out) == 50 and sum(r.doc_id is None for r in out) == 30
    mine = [r for r in out if r.source == "s"]
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3 and 0 < sum(r.taken for r in mine) < 210
    assert sorted(map(str, mixing.mix(make(rows[::-1]), weights=spark.createDataFrame([("s", 1), ("t", 3)], "source string, weight long")).collect())) == sorted(map(str, out))


def test_turns_over_ranges(spark):
    """Many sources, ranked over several ranges as in one list."""
    names = [f"site-{i * 7919 % 1009:04d}" for i in range(1009)] + [None, "é", "Z"]
    got = {r.source: r.weight for r in mixing.turn_weights(spark.createDataFrame([(n,) for n in names], "source string").repartition(5)).collect()}
    order = sorted(n for n in names if n is not None) + [None]
    assert got == {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}


def test_own_weights(spark, make):
    weights = spark.createDataFrame([("a", 1), ("b", 0)], "source string, weight long")
    out = mixing.mix(make([(1, "x y", "en", "a"), (2, "x y", "en", "b")]), weights=weights).collect()
    assert {r.source: r.taken for r in out} == {"a": 4, "b": 0}


def test_odd_rows(odd, make):
    out = mixing.mix(odd)
    assert out.count() == odd.count()
    assert out.filter("doc_id = 1").first().taken == 0
    assert out.agg(F.count_distinct("source")).first()[0] == 1 and out.filter("source is null").count() == 2
    assert mixing.mix(make([])).count() == 0
    assert [r.taken for r in mixing.mix(make([(1, None)])).collect()] == [0]
