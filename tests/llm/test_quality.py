import random
import re
from collections import Counter

from tests.llm.conftest import prose
from tracelake.llm import quality


def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


def test_stats():
    rng = random.Random(1)
    texts = [None, "", "a\n\na", "x " * 9, "a b c d e f g h " * 3, "  é | # ab\x0bcd", *(prose(rng, 300, 6).replace("w1 ", "\n") for _ in range(20))]
    assert [quality.document_stats(t) for t in texts] == [slow_stats(t) for t in texts]


def test_thresholds_adapt(spark, make):
    """Long words are normal in one source and odd in the other; a small
    source is judged by its language."""
    rng = random.Random(2)
    text = lambda size: " ".join("".join(rng.choice("abcde") for _ in range(size)) for _ in range(60))
    rows = [(i, text(5), "en", "web") for i in range(150)] + [(200 + i, text(12), "en", "code") for i in range(150)]
    rows += [(500, text(12), "en", "web"), (501, text(5), "en", "code"), (502, text(5) + " #" * 30, "en", "web"), (503, text(5), "en", "tiny"), (504, text(40), "en", "tiny"), (505, "short", "en", "web")]
    out = {r.doc_id: r.quality for r in quality.judge(make(rows)).select("doc_id", "quality").collect()}
    assert all(out[i].kept for i in range(150)) and all(out[200 + i].kept for i in range(150))
    assert [out[i].kept for i in range(500, 506)] == [False, False, False, True, False, False]
    assert out[505].base_failed and not out[500].base_failed


def test_sketches_merge(spark, make):
    rng = random.Random(3)
    df = spark.createDataFrame([("en", "a", rng.randrange(10**6)) for _ in range(500)], "lang string, source string, x long")
    names = list(quality.MEASURES)
    both = df.select("lang", "source", *(df.x.alias(m) for m in names))
    parts = both.randomSplit([0.5, 0.5], 1)
    merged = quality.sketches(parts[0]).unionByName(quality.sketches(parts[1])).groupBy("lang", "source", "measure", "value").sum("n")
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in quality.sketches(both).collect()}
    # the quantile of a sketch is the true one, rounded down by less than 1/32
    values = sorted(r.x for r in df.collect())
    upto, counts = 0, sorted((r.value, r["sum(n)"]) for r in merged.filter(f"measure = '{names[0]}'").collect())
    ranks = {}
    for value, n in counts:
        ranks |= dict.fromkeys(range(upto, upto + n), value)
        upto += n
    assert upto == 500 and all(ranks[k] <= x < ranks[k] + max(1, ranks[k] / 32) for k, x in enumerate(values))


def test_odd_rows(odd, make):
    for keep in (False, True):
        out = quality.judge(odd, keep_text=keep)
        assert out.count() == odd.count() and "quality" in out.columns and ("text" in out.columns) == keep
        by = {r.doc_id: r.quality for r in out.collect()}
        assert by[1].base_failed and by[2].n_words == 0 and not by[3].kept and by[5].n_words == 60
    assert quality.judge(make([])).count() == 0
