import hashlib
import random
import zlib

from tracelake.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, fanout=2, tampered=7):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""

    def leaf(i, text, lang, source, n):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            a = at // fanout * fanout
            out.append(("".join(level[a:at]), "".join(level[at + 1 : a + fanout])))
            at //= fanout
        return out

    langs = {}
    for i, text, lang, source, n in rows:
        hit = i is not None and n is not None and zlib.crc32(str(i).encode()) % tampered == 0
        langs.setdefault(lang, []).append(((i is not None, i or 0), leaf(i, text, lang, source, n), leaf(i, text, lang, source, n + 1) if hit else None, i))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([r[1] for r in sorted(langs[g], key=lambda r: r[:2])]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for at, (_, h, bad, i) in enumerate(sorted(langs[g], key=lambda r: r[:2])):
            runs = path(trees[k], at) + path(top, k)
            acc = bad or h
            for a, b in runs:
                acc = digest(a + acc + b)
            out.append((i, h, trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in runs)), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("rank", "g", "leaf", "i", "n", "hash", "shown", "block", "path"):  # names that it uses itself
        df = df.withColumn(extra, df.text)
    out = merkle.manifest(df, **settings).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, out.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([k, k * 1000, -k]), f"text {k}" * rng.choice([0, 1, 3]), rng.choice(["en", "de", None, "", "é"]), rng.choice(["a", None]), rng.choice([k, None])) for k in range(700)]
    rows += [(None, "x", "en", "a", 1), (None, None, None, None, None), ((1 << 63) - 1, "y", "en", None, 3), (-(1 << 63), "z", "en", None, 3), (5, "long " * 50_000, "en", "a", 7)]
    want = brute(rows)
    assert run(spark, rows) == want and 0 < sum(not r[-1] for r in want) < len(want)
    assert run(spark, rows, block=4, digits=1) == want
    assert run(spark, rows, fanout=3, block=9) == brute(rows, 3)


def test_ties_and_repeats(spark):
    """One id holds most rows, and most of those are equal: counts finer than
    the id split them."""
    rows = [(7, "same", "en", "a", 4)] * 60 + [(7, f"t{k}", "en", "a", 4) for k in range(40)] + [(k, "t", "en", "a", 1) for k in range(9)] + [(None, "n", "en", "a", 1)] * 20
    assert run(spark, rows, bucket=8, block=16) == run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    one = [(1, "a", None, None, None)]
    assert run(spark, one) == brute(one) and run(spark, one)[0][1] == run(spark, one)[0][3]
    apart = [(k, "a", f"l{k}", None, None) for k in range(5)]
    assert run(spark, apart) == brute(apart)
    assert run(spark, one * 3) == brute(one * 3)


def test_proofs_show_tampering(spark):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(100)]
    for r in run(spark, rows):
        assert r[-1] == (zlib.crc32(str(r[0]).encode()) % 7 != 0)
