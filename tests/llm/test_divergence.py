import random
import re
from collections import Counter, defaultdict

from tracelake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, terms=200):
    counts, within = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(found)
        within[lang].update(set(found))
    out = []
    for lang in within:
        kept = [t for t, n in within[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, terms)):
                out += [(lang, s, part, item.decode(), -f, k) for k, (f, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for extra in ("term", "n", "i", "p", "q", "value", "item", "shard", "players", "rank", "doc_id"):
        df = df.withColumn(extra, df.source)
    return sorted(map(tuple, divergence.audit(df, **settings).collect()))


def sample(n, sources, seed=2):
    rng = random.Random(seed)
    text = lambda: " ".join(f"{rng.choice('aAbBé中')}{'x' * int(rng.paretovariate(0.7) % 40)}{rng.choice([' ', ', ', '1', '_'])}" for _ in range(rng.randrange(60)))
    return [(text(), rng.choice(["en", "fr", "de"]), rng.choice(sources)) for _ in range(n)]


def test_against_brute_force(spark):
    rows = sample(300, [f"s{k}" for k in range(7)] + [None, "é", "z"])
    want = brute(rows)
    assert run(spark, rows) == want
    # many shards, several waves of rounds, heaps that leave terms out
    assert run(spark, rows, shard=5, rounds=2, terms=4) == brute(rows, terms=4)
    odd = [r for r in rows if r[2] != "z"]
    assert run(spark, odd, shard=3, rounds=4) == brute(odd)


def test_nulls_empty_and_long_texts(spark):
    rows = [(None, None, None), ("", "en", "a"), ("1 2 3", "en", "b"), (None, "en", "c"), ("only once here", "xx", "a"), ("x", "xx", "b"), ("alone", "yy", "a")]
    assert run(spark, rows) == brute(rows)
    rows += [("word other " * 40_000, "en", "a"), ("Word", "en", "d"), ("word", "en", "d"), ("WORD", None, None)] + [("same text", "en", "c")] * 30
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_flushing_changes_nothing(spark, monkeypatch):
    rows = sample(80, ["a", "b"])
    monkeypatch.setattr(divergence, "HELD", 10)
    assert run(spark, rows) == brute(rows)
