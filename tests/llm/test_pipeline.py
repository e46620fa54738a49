import hashlib
import random

import duckdb
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.conftest import prose  # noqa: E402
from tests.llm.test_linededup import slow as slow_lines  # noqa: E402
from tests.llm.test_mixing import slow_mix  # noqa: E402
from tests.llm.test_simhash import jaccard_components  # noqa: E402
from tracelake.llm import linededup, pieces  # noqa: E402
from tracelake.llm.queries import ORACLE_SQL  # noqa: E402


def row_key(r):
    """The name that the stages give a row, as text."""
    md5 = lambda v: hashlib.md5(str(v).encode()).hexdigest() if v is not None else "-"
    digest = md5("".join(md5(r[c]) for c in pipeline.COLUMNS[1:]))
    no_id = str(r.doc_id is None).lower()
    return f"{{{no_id}, {'null' if r.doc_id is None else r.doc_id}, {digest}}}"


def test_each_stage_by_hand(spark, tmp_path):
    """Each stage against SQL or plain Python on its own input."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        text = prose(rng, 80)
        rows.append((i, "\n".join(["Subscribe now"] * (i % 3 == 0) + [text]), "en", "ab"[i % 2], len(text)))
    rows += [(200 + i, r[1] + " more", r[2], r[3], r[4]) for i, r in enumerate(rows[:20])] + [(300, "short", "en", "a", 5), (301, None, None, None, None), (302, rows[1][1], "en", "a", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(s.columns == pipeline.COLUMNS for s in seen[1:5])
    given = [{r.doc_id: r for r in s.collect()} for s in seen[:4]]

    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in duck.execute(f"select doc_id from ({ORACLE_SQL['op7_quality']}) where kept").fetchall()}
    assert set(given[1]) == kept and 300 not in kept and 301 not in kept and len(kept) > 100

    ids = sorted(given[1])
    lines = dict(zip(ids, slow_lines([given[1][i].text for i in ids])))
    assert {i: r.text for i, r in given[2].items()} == {i: t for i, (_, _, t) in lines.items() if t.split()}
    assert any(d for _, d, _ in lines.values()) and all(r.n_chars == len(r.text) for r in given[2].values())

    ids = sorted(given[2])
    assert set(given[3]) == {ids[k] for k in set(jaccard_components([given[2][i].text for i in ids]))} and 302 not in given[3]

    want = slow_mix([(row_key(r), r.source, len(r.text.split())) for r in given[3].values()])
    got = {}
    for r in seen[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: want[row_key(r)] for i, r in given[3].items() if want[row_key(r)]}

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoded = [(r.doc_id, r.ids) for r in seen[5].collect()]
    assert all(x == sp.encode(given[3][i].text) for i, x in encoded) and len(encoded) == sum(got.values())
    assert sorted((r.doc_id, r.ids) for r in pipeline.run(spark, str(tmp_path)).collect()) == sorted(encoded)


def test_rows_that_differ_beside_their_text(spark, make):
    """Equal ids and texts of another language or source: one stays, whichever
    order they come in; the mix takes each by itself."""
    rng = random.Random(6)
    a, b = prose(rng, 80, 5000), prose(rng, 80, 5000)
    rows = [(1, a, "en", "s"), (1, a, "de", "s"), (1, a, "de", "t"), (2, b, "en", "t"), (2, b, "en", "t")]
    outs = [pipeline.near_dedup(spark, make(some), "").collect() for some in (rows, rows[::-1])]
    assert sorted(outs[0]) == sorted(outs[1]) and [r.doc_id for r in sorted(outs[0])] == [1, 2]
    mixed = pipeline.source_mixing(spark, make(rows), "").collect()
    assert sum(len(r.text.split()) for r in mixed) == 80 * 5 and {tuple(r)[:4] for r in mixed} <= set(rows)


def test_null_and_repeated_ids(spark, make):
    """No text of its own is lost for its id, and equal rows are one."""
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 80, 5000) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, c), (5, d), (6, d)]
    out = pipeline.near_dedup(spark, make(rows), "")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, a), (0, b), (5, c), (5, d)])
    mixed = pipeline.source_mixing(spark, make(rows), "").collect()
    assert sum(len(r.text.split()) for r in mixed) == 80 * 7 and {r.text for r in mixed} <= {a, b, c, d}


def test_odd_tables(spark, odd):
    """Nulls, empty, blank and very long texts, equal rows: what each stage
    keeps of them by itself."""
    alone = {name: stage(spark, odd, "") for name, stage in pipeline.STAGES}
    left = {name: sorted((r.doc_id or 0) for r in out.collect()) for name, out in alone.items()}
    assert left["line_dedup"] == [0, 4, 5, 5, 6, 7, 8, 9]
    assert left["near_dedup"] == [1, 4, 5, 7, 9]
    assert set(left["source_mixing"]) <= {0, 4, 5, 6, 7, 8, 9} and 4 in left["source_mixing"]
    assert left["encoding"] == sorted((r.doc_id or 0) for r in odd.collect())
    assert not set(left["quality_rules"]) & {1, 2, 3, 7}
    empty = odd.filter("doc_id = -1")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
    assert linededup.MIN_DOCS == 10
