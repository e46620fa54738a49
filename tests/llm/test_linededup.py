import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import linededup as ld


def slow(texts, least=10):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    counts = {}
    for lines in split:
        for k in {key(x) for x in lines} - {""}:
            counts[k] = counts.get(k, 0) + 1
    return [(len(s), sum(counts.get(key(x), 0) >= least for x in s), "\n".join(x for x in s if counts.get(key(x), 0) < least)) for s in split]


def corpus(n=60):
    rng = random.Random(4)
    common = ["Home", "  about US\t", "©", "É", "é", " ", ""]
    return ["\n".join(rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(16)}" for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_both_paths_against_brute_force(spark, make, monkeypatch):
    """Filters at the reading tasks, or dealt by one shard or many, in parts."""
    texts = [*corpus(), None, ""]
    want = slow(texts)
    monkeypatch.setattr(ld, "PART_KEYS", 50)
    for limit, keys in ((ld.BROADCAST_BYTES, 3), (0, ld.KEYS_PER_SHARD), (0, 4)):
        out = {r.doc_id: r for r in ld.dedup_lines(make(list(enumerate(texts))), broadcast_bytes=limit, keys_per_shard=keys).select("doc_id", "lines.*").collect()}
        assert [(out[i].n_lines, out[i].n_dropped, out[i].kept) for i in range(len(texts))] == want
    assert sum(d for _, d, _ in want) > 50


@pytest.mark.parametrize("limit", [ld.BROADCAST_BYTES, 0])
def test_every_text_passes_the_filters(spark, make, monkeypatch, limit):
    """On either path a key that no filter has is never dropped."""
    monkeypatch.setattr(ld.CuckooFilter, "contains", lambda self, keys: np.zeros(len(keys), bool))
    out = ld.dedup_lines(make(list(enumerate(corpus()))), broadcast_bytes=limit)
    assert out.agg(F.sum("lines.n_dropped")).first()[0] == 0


def test_reversible(spark, make):
    """Deleting what was inserted restores counts and filters' answers."""
    first, more = [(i, t) for i, t in enumerate(corpus())], [(100 + i, t) for i, t in enumerate(corpus(40))]
    none, no_filters = ld.empty_state(spark)
    refs = ld.insert(none, make(first)).cache()
    grown = ld.insert(refs, make(more)).cache()
    assert {tuple(r) for r in ld.delete(grown, make(more)).collect()} == {tuple(r) for r in refs.collect()}
    shards = 3
    base = ld.update_filters(no_filters, none, refs, shards)
    up = ld.update_filters(base, refs, grown, shards)
    down = ld.update_filters(up, grown, refs, shards)

    def answers(filters, of):
        tables = {r["shard"]: ld.CuckooFilter.from_bytes(bytes(r["filter"])) for r in filters.collect()}
        keys = [bytes(r["key"]) for r in of.filter(F.col("refs") >= ld.MIN_DOCS).collect()]
        return [bool(tables[s].contains([k])[0]) for k in keys for s in [ld.shard_of(k, shards)]]

    assert all(answers(base, refs)) and all(answers(up, grown)) and all(answers(down, refs))
    assert len(answers(up, grown)) > len(answers(base, refs))
    # a text is judged as it was before the insertion
    docs = make(first)
    before, after = (ld.lookup(docs, r, f, shards).select("doc_id", "lines.*").collect() for r, f in ((refs, base), (ld.delete(grown, make(more)), down)))
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(20_000)]
    table = ld.CuckooFilter.of(keys[:10_000])
    assert table.contains(keys[:10_000]).all() and table.contains(keys[10_000:]).mean() < 0.002
    assert all(map(table.delete, keys[:5_000]))
    assert table.contains(keys[5_000:10_000]).all() and table.contains(keys[:5_000]).mean() < 0.002
    assert ld.CuckooFilter.from_bytes(table.to_bytes()).contains(keys[5_000:10_000]).all()


def test_odd_rows(odd, make):
    out = ld.dedup_lines(odd)
    assert out.columns == [c for c in odd.columns if c != "lines"] + ["lines"] and out.count() == odd.count()
    by = {r.doc_id: r.lines for r in out.collect()}
    assert (by[1].n_lines, by[2].n_lines, by[3].n_lines, by[3].n_dropped) == (1, 1, 3, 0)
    assert ld.dedup_lines(odd, min_docs=5).filter("lines.n_dropped > 0").count() == 5
    assert ld.dedup_lines(make([])).count() == 0 and ld.dedup_lines(make([]), broadcast_bytes=0).count() == 0
