"""Known values for the telemetry operators."""

import base64
import contextlib
import json
import random
import struct
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracelake.operators import agents, cost, filters, metrics, ordering, registry, retrieval, rollup, tree
from tracelake.plans.fields import SPANS, TRACES
from tracelake.sources import otlp, otlp_proto

MS = 1_000_000
SPAN = "organization_id string, trace_id string, span_id string, parent_span_id string, name string, category string, status string, start_ns long, end_ns long, duration_ns long, model string, session_id string, input_tokens long, output_tokens long, cost_total decimal(26,12)"


def spans(spark, rows):
    """(trace, span, parent, start, end[, name, status]) in ms."""
    out = []
    for t, s, p, a, b, *rest in rows:
        name, status = [*rest, "op", "ok"][:2] if len(rest) < 2 else rest
        out.append(("o", t, s, p, name, "custom", status, a * MS, None if b is None else b * MS, None if b is None else (b - a) * MS, f"m{s}", "", 100, 50, Decimal("0.0015")))
    return spark.createDataFrame(out, SPAN)


def test_percentiles_are_exact_lower(spark):
    df = spark.range(1, 101).select((F.col("id") * MS).alias("d"))
    r = metrics.percentiles(df, [], "d").first()
    assert (r.p50, r.p75, r.p95, r.p99, r.n, r.max) == (50 * MS, 75 * MS, 95 * MS, 99 * MS, 100, 100 * MS)
    two = metrics.percentiles(spark.createDataFrame([(1,), (2,)], "d long"), [], "d", [0.95]).first()
    assert two.p95 == 1


def test_percentiles_against_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None, "c"]), rng.choice([None, rng.randrange(-10**9, 10**12), rng.randrange(50)])) for _ in range(3000)]
    got = {r.g: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()}
    for g in ("a", None, "c"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert [got[g][f"p{p}"] for p in (50, 75, 90, 95, 99)] == [v[int(p / 100 * (len(v) - 1))] for p in (50, 75, 90, 95, 99)]
        assert got[g].n == len(v) and got[g].max == v[-1]


def test_decimal_sums_are_exact(spark):
    df = spark.createDataFrame([("a", Decimal("0.1")), ("a", Decimal("0.2")), ("a", Decimal("0.3")), ("a", None)], "g string, cost_total decimal(26,12)")
    assert metrics.aggregate(df, ["g"], metrics.measure("sum_known", "cost_total")).first().value == Decimal("0.6")
    assert metrics.aggregate(df, ["g"], metrics.measure("count")).first().n == 4


def test_buckets():
    assert metrics.auto_interval(0, 3600 * 10**9) == "1m" and metrics.auto_interval(0, 90 * 86400 * 10**9) == "7d"
    assert metrics.partial_bucket(100, 70, 60) == 60 and metrics.partial_bucket(50, 70, 60) is None


def test_filters_refuse_what_is_not_registered(spark):
    df = spans(spark, [("t", "1", "", 0, 1)])
    for bad in [("nope", "eq", 1), ("name", "gt", "a"), ("status", "eq", "fine"), ("input_tokens", "between", [5, 1]), ("name", "in", ["x"] * 201)]:
        with pytest.raises(ValueError):
            filters.where(df, SPANS, [bad])
    with pytest.raises(ValueError):
        filters.where(df, SPANS, [("name", "eq", "x")] * 26)
    with pytest.raises(ValueError):
        filters.time_range(SPANS, 0, 401 * 86400 * 10**9)


def test_filter_is_pushed_down(spark, tmp_path):
    spans(spark, [("t", "1", "", 0, 1)]).write.parquet(f"{tmp_path}/s")
    plan = filters.where(spark.read.parquet(f"{tmp_path}/s"), SPANS, [("duration_ms", "gte", 1), ("name", "starts_with", "o")]).select("span_id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(duration_ns,1000000)" in plan and "StringStartsWith(name,o)" in plan
    assert "ReadSchema: struct<span_id:string,name:string,duration_ns:bigint>" in plan


@pytest.mark.parametrize("sort", [["-cost"], ["cost"], ["duration_ms", "-name"]])
def test_keyset_pages_have_no_gap_or_repeat(spark, sort):
    rng = random.Random(2)
    df = spans(spark, [("t", f"{i:02d}", "", 0, rng.choice([None, 1, 2, 3]), rng.choice("ab")) for i in range(23)])
    df = df.withColumn("cost_total", F.when(F.col("span_id") % 3 != 0, (F.col("span_id") % 4).cast("decimal(26,12)")))
    seen, cursor = [], None
    while True:
        rows = [r.asDict() for r in ordering.page(df, SPANS, sort, cursor, 5).collect()]
        seen += [r["span_id"] for r in rows[:5]]
        if len(rows) <= 5:
            break
        cursor = ordering.cursor_of(rows[4], SPANS, sort)
    assert seen == [r.span_id for r in df.orderBy(*ordering.order(ordering.terms(SPANS, sort))).collect()]


def test_sort_terms():
    assert ordering.terms(TRACES, ["-cost"]) == [("total_cost", True), ("trace_id", True)]
    with pytest.raises(ValueError):
        ordering.terms(SPANS, ["tags"])


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, p string")
    new = spark.createDataFrame([("a", 1, "x2"), ("b", 1, "late"), ("c", 1, "z")], "k string, v int, p string")
    assert {tuple(r) for r in rollup.upsert(old, new, ["k"], ["v"]).collect()} == {("a", 1, "x2"), ("b", 2, "y"), ("c", 1, "z")}


def test_rollup_status(spark):
    df = spans(spark, [("ok", "1", "", 0, 9), ("ok", "2", "1", 1, 5), ("err", "1", "", 0, 9, "op", "error"), ("open", "1", "", 0, None), ("lost", "2", "1", 3, 4), ("lost", "3", "1", 2, 4, "first", "ok")])
    got = {r.trace_id: r for r in rollup.trace_rollup(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "err": "error", "open": "incomplete", "lost": "incomplete"}
    assert got["ok"].models == ["m1", "m2"] and got["ok"].total_cost == Decimal("0.003") and got["ok"].duration_ns == 9 * MS
    assert got["lost"].name == "first" and got["lost"].root_span_id == "" and got["open"].end_ns is None


def test_usage_and_cost_lattices(spark):
    df = spark.createDataFrame([(1, "provider", "final"), (1, "estimated", "estimated"), (2, None, None), (3, "provider", "final")], "t int, usage_source string, cost_estimation_status string")
    got = {r.t: (r.u, r.c) for r in df.groupBy("t").agg(rollup.weakest_source().alias("u"), rollup.worst_cost_status().alias("c")).collect()}
    assert got == {1: ("estimated", "estimated"), 2: ("missing", "unpriced"), 3: ("provider", "final")}


def test_self_time(spark):
    """Overlapping children count once; a longer child leaves 0."""
    df = spans(spark, [("t", "p", "", 0, 100), ("t", "a", "p", 10, 50), ("t", "b", "p", 30, 70), ("u", "p", "", 0, 10), ("u", "c", "p", 0, 99), ("u", "d", "c", 1, None)])
    assert {(r.trace_id, r.span_id): r.self_ns // MS for r in tree.self_time(df).collect()} == {("t", "p"): 40, ("t", "a"): 40, ("t", "b"): 40, ("u", "p"): 0, ("u", "c"): 99}


def test_trees_with_cycles_and_orphans(spark):
    df = spans(spark, [("c", "a", "b", 0, 1), ("c", "b", "a", 0, 1), ("o", "x", "gone", 0, 5), ("o", "y", "x", 1, 4), ("t", "r", "", 0, 9), ("t", "s", "r", 0, 8), ("t", "f", "r", 0, 3), ("t", "l", "f", 0, 9)])
    deep = {(r.trace_id, r.span_id): r.depth for r in tree.depths(df).collect()}
    assert deep["o", "x"] == 0 and deep["o", "y"] == 1 and deep["t", "l"] == 2 and deep["c", "a"] == 64
    assert {r.span_id for r in tree.orphans(df).collect()} == {"x"}
    path = sorted((r.trace_id, r.position, r.span_id) for r in tree.critical_path(df).collect())
    assert path == [("t", 0, "r"), ("t", 1, "s")]
    below = {(r.trace_id, r.span_id): r.descendants for r in tree.descendants(df.filter("trace_id <> 'c'")).collect()}
    assert below["t", "r"] == 3 and below["t", "f"] == 1 and below["o", "y"] == 0


def test_deep_chain(spark):
    df = spans(spark, [("t", f"{i}", f"{i - 1}" if i else "", i, 200 - i) for i in range(40)])
    assert {int(r.span_id): r.depth for r in tree.depths(df).collect()} == {i: i for i in range(40)}


def test_compare(spark):
    df = spans(spark, [("l", "1", "", 0, 10), ("l", "2", "1", 1, 5, "a"), ("l", "3", "1", 5, 9, "a"), ("r", "7", "", 0, 30), ("r", "8", "7", 1, 8, "a"), ("r", "9", "7", 2, 3, "b")])
    pairs = spark.createDataFrame([("l", "r")], "left_trace string, right_trace string")
    got = {(r.depth, r.name, r.ordinal): (r.side, r.delta_ns) for r in tree.compare(pairs, df).collect()}
    assert got == {(0, "op", 0): ("both", 20 * MS), (1, "a", 0): ("both", 3 * MS), (1, "a", 1): ("left", None), (1, "b", 0): ("right", None)}


def test_retrieval_diagnostics(spark):
    docs = spark.createDataFrame([("s", "d1", 0, 0.9, 1, True, 10, False, "w", "x"), ("s", "d2", 1, 0.5, 0, False, 5, True, "", "y"), ("s", "d3", 2, 0.4, 4, True, None, False, "w", "z")], "step_id string, document_id string, rank long, score double, rerank_rank long, selected boolean, token_count long, truncated boolean, source string, content_preview string")
    r = retrieval.diagnostics(docs).first()
    assert (r.document_count, r.selected_count, r.context_tokens, r.truncated_count, r.missing_source_count, r.rerank_promotions, r.rerank_demotions) == (3, 2, 10, 1, 1, 1, 2)
    assert abs(r.mean_rank_movement - 4 / 3) < 1e-12 and abs(r.score_margin - 0.4) < 1e-12


def test_near_duplicates(spark):
    text = "one two three four five six seven eight nine ten " * 3
    docs = spark.createDataFrame([("s", "a", 0, text), ("s", "b", 1, text.upper()), ("s", "c", 2, "quite another text"), ("u", "d", 0, text)], "step_id string, document_id string, rank long, content_preview string")
    assert [tuple(r) for r in retrieval.near_duplicates(docs).collect()] == [("s", "a", "b")]


def test_ranking_metrics(spark):
    docs = spark.createDataFrame([("q", d, i) for i, d in enumerate("abcd")] + [("n", "z", 0)], "step_id string, document_id string, rank long")
    labels = spark.createDataFrame([("q", "b", 1.0), ("q", "d", 1.0), ("q", "x", 1.0), ("q", "a", 0.0)], "step_id string, document_id string, gain double")
    got = {r.step_id: r for r in retrieval.ranking_metrics(docs, labels, 3).collect()}
    assert (got["q"].precision, got["q"].recall, got["q"].rr) == (1 / 3, 1 / 3, 0.5) and got["n"].precision is None and got["n"].ndcg is None
    assert abs(got["q"].ndcg - 0.6309297535714575 / 2.1309297535714578) < 1e-9


STEP = "run_id long, agent_id string, step_number long, step_type string, tool_name string, parent_step long, retry_of long, branch_id string, handoff_target string, loop_iteration int, start_ns long, duration_ns long"


def test_agent_graph(spark):
    rows = [(1, "a", 1, "plan", "", None, None, "", "", None, 0, 5), (1, "a", 2, "tool", "t", 1, None, "x", "b", None, 1, 7), (1, "a", 3, "tool", "t", None, 2, "", "", None, 2, 1), (1, "a", 4, "tool", "t", None, None, "", "", None, 3, 2), (1, "b", 1, "act", "", None, None, "", "", None, 4, 9)]
    df = spark.createDataFrame(rows, STEP)
    assert {(r.source, r.target, r.kind) for r in agents.edges(df).collect()} == {("a#1", "a#2", "branch"), ("a#2", "a#3", "retry"), ("a#3", "a#4", "sequence"), ("a#2", "b#1", "handoff")}
    assert agents.loops(df).first().loop_detected is True
    assert {r.node for r in agents.longest_paths(df).filter("on_path").collect()} == {"a#1", "a#2", "a#3", "a#4"}
    assert agents.nodes(df, 2).count() == 2
    both = [sorted(map(tuple, agents.longest_paths(df, limit).collect())) for limit in (agents.MAX_NODES, None)]
    assert both[0] == both[1]


def rules(spark, rows):
    out = [("p", m, "input", a, b, lo, hi, 1_000_000, Decimal(price), d and Decimal(d), "USD", org) for m, a, b, lo, hi, price, d, org in rows]
    return spark.createDataFrame(out, cost.RULE)


def total(spark, book, quantity, graduated=False, model="m", at=0):
    usage = spark.createDataFrame([("1", "P", model, "input", quantity, at)], "id string, provider string, model string, category string, quantity long, at_ns long")
    r = cost.costs(usage, book, graduated).first()
    return r.total and float(r.total), r.status


def test_costs(spark):
    tiers = rules(spark, [("m", 0, None, 0, 100_000, "1", None, None), ("m", 0, None, 100_000, None, "2", None, None)])
    assert total(spark, tiers, 250_000) == (0.5, "final") and total(spark, tiers, 250_000, True) == (0.4, "final")
    assert total(spark, rules(spark, [("m", 0, None, 0, None, "1", "0.2", None)]), 1_000_000) == (0.8, "final")
    assert total(spark, rules(spark, [("m", 0, None, 0, 10, "1", None, None), ("m", 0, None, 10, 20, "3", None, None)]), 1_000_000) == (3.0, "final")
    dated = rules(spark, [("m", 0, 10, 0, None, "1", None, None), ("m", 10, None, 0, None, "2", None, None), ("*", 0, None, 0, None, "9", None, None)])
    assert total(spark, dated, 1_000_000, at=9)[0] == 1.0 and total(spark, dated, 1_000_000, at=10)[0] == 2.0
    assert total(spark, dated, 1_000_000, model="M-2024-01-01", at=10)[0] == 2.0 and total(spark, dated, 1_000_000, model="other")[0] == 9.0
    assert total(spark, rules(spark, [("m", 0, None, 0, None, "1", None, None)]), 5, model="x") == (None, "unpriced")


def test_price_books(spark):
    book = rules(spark, [("m", 0, 10, 0, None, "1", None, None), ("m", 0, 10, 0, None, "2", None, "t"), ("n", 0, 10, 0, None, "3", None, None), ("n", 5, 20, 0, None, "4", None, None), ("n", 20, 9, 0, None, "-1", "1.5", None)])
    assert sorted(float(r.unit_price) for r in cost.tenant_rules(book, "t").filter("model = 'm'").collect()) == [2.0]
    assert [float(r.unit_price) for r in cost.overlaps(book).collect()] == [4.0]
    assert [float(r.unit_price) for r in cost.invalid(book).collect()] == [-1.0]


def test_currencies(spark):
    df = spark.createDataFrame([("USD", 10.0), ("EUR", 8.0), ("JPY", 5.0)], "currency string, total double")
    got = {r.currency: (r.converted, r.missing_rate) for r in metrics.converted_totals(df, spark.createDataFrame([("USD", 1.0), ("EUR", 1.1)], "currency string, rate double")).collect()}
    assert got["JPY"] == (None, True) and abs(got["USD"][0] + got["EUR"][0] - 18.8) < 1e-9


def test_stale(spark):
    s = spark.createDataFrame([("o", "a", 5), ("o", "b", 5), ("o", "c", 5)], "organization_id string, trace_id string, ingested_ns long")
    t = spark.createDataFrame([("o", "a", 5), ("o", "b", 4)], "organization_id string, trace_id string, ingested_ns long")
    assert {r.trace_id for r in rollup.stale_rollups(s, t).collect()} == {"b", "c"}


def test_versions_and_aliases(spark):
    old = spark.createDataFrame([("p", "h1", 1)], "name string, content_hash string, version_number long")
    new = spark.createDataFrame([("p", "h1", 9), ("p", "h3", 5), ("p", "h2", 3), ("q", "h1", 1)], "name string, content_hash string, created_at long")
    assert {tuple(r) for r in registry.assign_versions(new, ["name"], existing=old).collect()} == {("p", "h1", 1), ("p", "h2", 2), ("p", "h3", 3), ("q", "h1", 1)}
    aliases = spark.createDataFrame([("p", "prod", "v1", None)], "name string, alias string, version_id string, previous_version_id string")
    versions = spark.createDataFrame([("v2", True), ("v3", False)], "version_id string, published boolean")
    moves = spark.createDataFrame([("p", "prod", "v2"), ("p", "dev", "v3")], "name string, alias string, version_id string")
    after = registry.promote(aliases, moves, versions)
    assert [tuple(r) for r in after.collect()] == [("p", "prod", "v2", "v1")]
    assert registry.resolve(aliases.select("name", "alias"), after, versions).first().version_id == "v2"
    left = spark.createDataFrame([("m", {"a": "1", "b": "2"})], "k string, fields map<string,string>")
    right = spark.createDataFrame([("m", {"a": "1", "b": "3", "c": "4"})], "k string, fields map<string,string>")
    assert {(r.field, r.change) for r in registry.field_diff(left, right, ["k"]).collect()} == {("b", "modified"), ("c", "added")}


def chain(n, trace="t"):
    """A trace of n spans, each below the one before."""
    return [(trace, f"{i:04d}", f"{i - 1:04d}" if i else "", i, 1000 - i, "n") for i in range(n)]


TREE = "trace_id string, span_id string, parent_span_id string, start_ns long, end_ns long, name string"


def test_deep_traces_and_cycles(spark):
    """No cap on ancestors or paths; cycles end, and lead nowhere."""
    cycle = [("c", "a", "b", 0, 9, "n"), ("c", "b", "a", 1, 9, "n"), ("c", "x", "a", 2, 9, "n"), ("c", "r", "", 3, 9, "n"), ("c", "k", "r", 4, 8, "n")]
    spans = spark.createDataFrame(chain(150) + cycle, TREE)
    got = {(r.trace_id, r.span_id): r.descendants for r in tree.descendants(spans).collect()}
    assert all(got["t", f"{i:04d}"] == 149 - i for i in range(150))
    assert {k[1]: v for k, v in got.items() if k[0] == "c"} == {"a": 2, "b": 2, "x": 0, "r": 1, "k": 0}
    path = sorted((r.trace_id, r.position, r.span_id) for r in tree.critical_path(spans).collect())
    assert path == [("c", 0, "r"), ("c", 1, "k")] + [("t", i, f"{i:04d}") for i in range(150)]


def test_near_duplicates_against_brute_force(spark):
    """Whole texts and all documents of a step, whatever they begin with."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    opening = " ".join(word() for _ in range(600))
    texts = {}
    for i in range(90):
        words = [word() for _ in range(rng.randrange(3, 400))]
        texts[f"{i:03d}"] = " ".join(words)
        for _ in range(1 + i % 7):
            words[rng.randrange(len(words))] = word()
        texts[f"{i:03d}c"] = " ".join(words)
    texts |= {"900": opening + " " + " ".join(word() for _ in range(900)), "901": opening + " " + " ".join(word() for _ in range(900)), "902": "", "903": "  "}
    rows = [(s, i, k, t) for s in ("s", "r") for k, (i, t) in enumerate(sorted(texts.items()))]

    def grams(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]) - 1e-9}
    docs = spark.createDataFrame(rows, "step_id string, document_id string, rank int, content_preview string")
    got = retrieval.near_duplicates(docs).collect()
    assert len(want) > 5 and {(r.left_id, r.right_id) for r in got if r.step_id == "s"} == want and len(got) == 2 * len(want)
    some = {(r.left_id, r.right_id) for r in retrieval.near_duplicates(docs, first=20).collect()}
    assert some == {p for p in want if max(sorted(texts).index(x) for x in p) < 20}


def test_filter_texts_as_values():
    assert filters.coerce(SPANS, "input_tokens", "12") == 12 and filters.coerce(SPANS, "duration_ms", "1.5") == 1.5
    assert filters.coerce(SPANS, "status", "error") == "error"
    for name, token in (("input_tokens", "1.5"), ("duration_ms", "x"), ("status", "errr")):
        with pytest.raises(ValueError, match=name):
            filters.coerce(SPANS, name, token)


def test_latest_takes_nulls_as_least(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 4), (None, 4, 1), (None, 5, 2)], "k string, x int, v int")
    assert sorted((r.k or "", r.x) for r in rollup.latest(df, ["k"], ["v"]).collect()) == [("", 5), ("a", 2)]


def test_old_tables_are_swept(spark):
    from tracelake.plans import lineage

    table = lineage.cut(spark.range(5))
    assert lineage.sweep(spark, 3600) == 0 and table.count() == 5
    time.sleep(1.1)
    kept = lineage.cut(spark.range(3))
    assert lineage.sweep(spark, 1) >= 1 and kept.count() == 3


def _wire(number, value):
    """One field in the protobuf wire format."""

    def varint(n):
        out = b""
        n &= (1 << 64) - 1
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, bool) or isinstance(value, int):
        return varint(number << 3) + varint(int(value))
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def _proto_value(v):
    (name, x), *_ = v.items()
    if name == "arrayValue":
        return _wire(5, b"".join(_wire(1, _proto_value(i)) for i in x.get("values", [])))
    if name == "kvlistValue":
        return _wire(6, b"".join(_wire(1, _proto_pair(i)) for i in x.get("values", [])))
    if name == "bytesValue":
        return _wire(7, base64.b64decode(x))
    return _wire({"stringValue": 1, "boolValue": 2, "intValue": 3, "doubleValue": 4}[name], int(x) if name == "intValue" else x)


def _proto_pair(p):
    return _wire(1, p["key"]) + _wire(2, _proto_value(p["value"]))


def _proto_request(r):
    fixed = lambda n, v: bytes([n << 3 | 1]) + int(v).to_bytes(8, "little")
    pairs = lambda n, a: b"".join(_wire(n, _proto_pair(p)) for p in a)

    def span(s):
        out = _wire(1, bytes.fromhex(s["traceId"])) + _wire(2, bytes.fromhex(s["spanId"])) + _wire(4, bytes.fromhex(s.get("parentSpanId", "")))
        out += _wire(5, s["name"]) + _wire(6, s["kind"]) + fixed(7, s["startTimeUnixNano"]) + fixed(8, s["endTimeUnixNano"]) + pairs(9, s["attributes"]) + _wire(10, 3)
        out += b"".join(_wire(11, fixed(1, e["timeUnixNano"]) + _wire(2, e["name"]) + pairs(3, e["attributes"])) for e in s["events"])
        out += b"".join(_wire(13, _wire(1, bytes.fromhex(l["traceId"])) + _wire(2, bytes.fromhex(l["spanId"])) + pairs(4, l["attributes"])) for l in s["links"])  # noqa: E741
        return out + _wire(15, _wire(2, s["status"]["message"]) + _wire(3, int(s["status"]["code"])))

    return b"".join(_wire(1, _wire(1, pairs(1, g["resource"]["attributes"])) + b"".join(_wire(2, _wire(1, _wire(1, "scope")) + b"".join(_wire(2, span(s)) for s in c["spans"])) for c in g["scopeSpans"])) for g in r["resourceSpans"])


def _otlp_request():
    pair = lambda k, **v: {"key": k, "value": v}
    values = [pair("s", stringValue="é \"q\""), pair("i", intValue="-7"), pair("big", intValue=str(2**62)), pair("d", doubleValue=2.5), pair("b", boolValue=True), pair("raw", bytesValue="AAH/"), pair("s", stringValue="last wins")]
    values += [pair("a", arrayValue={"values": [{"stringValue": "x"}, {"stringValue": "y"}]}), pair("n", arrayValue={"values": [{"intValue": "1"}, {"doubleValue": 0.5}]}), pair("mixed", arrayValue={"values": [{"stringValue": "x"}, {"intValue": "2"}, {"boolValue": False}]}), pair("none", arrayValue={})]
    values += [pair("map", kvlistValue={"values": [pair("k", intValue="3"), pair("l", arrayValue={"values": [{"stringValue": "in"}]})]})]
    span = {"traceId": "ab" * 16, "spanId": "01" * 8, "parentSpanId": "02" * 8, "name": "n", "kind": 3, "startTimeUnixNano": str(1_704_067_200 * 10**9), "endTimeUnixNano": str(1_704_067_200 * 10**9 + 5), "attributes": values, "status": {"code": "2", "message": "broken"}}
    span |= {"events": [{"timeUnixNano": "17", "name": "ev", "attributes": [pair("k", intValue="1")]}], "links": [{"traceId": "cd" * 16, "spanId": "03" * 8, "attributes": [pair("platform.retry_of", stringValue="x")]}]}
    other = {**span, "spanId": "04" * 8, "attributes": [], "events": [], "links": []}
    return {"resourceSpans": [{"resource": {"attributes": [pair("service.name", stringValue="svc")]}, "scopeSpans": [{"spans": [span, other]}, {"spans": [other]}]}, {"resource": {"attributes": []}, "scopeSpans": [{"spans": [other]}]}]}


def test_both_encodings_decode_alike(spark):
    """Requests in protobuf and JSON yield equal rows; damaged bytes are
    rejects, wherever they are cut."""
    r = _otlp_request()
    data = _proto_request(r)
    text = otlp.decode(spark.createDataFrame([("r", json.dumps(r))], "request_id string, body string"))
    binary = otlp_proto.decode(spark.createDataFrame([("r", data)], "request_id string, body binary"))
    want = sorted(map(str, text.collect()))
    assert sorted(map(str, binary.collect())) == want and len(want) == 4
    a = text.filter("index = 0").first()
    assert a.attributes["s"] == "last wins" and a.attributes["mixed"] == '["x","2","False"]' and a.attributes["map"] == '{"k":3,"l":["in"]}' and a.attributes["n"] == "[1.0,0.5]" and a.attributes["none"] == "[]"
    assert (a.kind, a.status, a.status_message, a.events[0].attributes, a.links[0].attributes) == ("client", "error", "broken", {"k": "1"}, {"platform.retry_of": "x"})
    rng = random.Random(4)
    damaged = [data[:k] for k in (1, 2, 7, 50, len(data) - 1)] + [bytes(rng.randrange(256) for _ in range(200)) for _ in range(20)] + [None]
    for d in damaged[:-1]:
        with contextlib.suppress(ValueError):
            otlp_proto.request(d)
    rows = otlp_proto.decode(spark.createDataFrame([(str(k), d) for k, d in enumerate(damaged)], "request_id string, body binary")).collect()
    assert {x.request_id for x in rows if x.reject == "undecodable"} >= {"0", "2", "3", "4", str(len(damaged) - 1)}


def test_cost_breakdown(spark):
    """A formula that can be checked by hand, for every component."""
    rule = "provider string, model string, category string, from_ns long, to_ns long, tier_min long, tier_max long, unit_quantity long, unit_price string, discount string, currency string, organization_id string"
    rules = spark.createDataFrame([("p", "m", "output", 0, None, 0, None, 1_000_000, "2", None, "USD", None), ("p", "m", "input", 0, 100, 0, None, 1_000_000, "9", None, "USD", None), ("p", "m", "input", 100, None, 0, None, 1_000_000, "1.00", "0.25", "USD", None)], rule)
    rules = rules.withColumn("unit_price", F.col("unit_price").cast("decimal(18,9)")).withColumn("discount", F.col("discount").cast("decimal(9,6)"))
    usage = spark.createDataFrame([("a", "p", "m", "input", 1200, 100), ("a", "p", "m", "output", 340, 100), ("a", "p", "m", "cached_input", 5, 100), ("b", "p", "m", "input", 10, 99), ("c", "p", "x", "input", 10, 99)], "id string, provider string, model string, category string, quantity long, at_ns long")
    got = {r.id: r for r in cost.breakdown(usage, rules).collect()}
    assert got["a"].formula == "(1200/1000000*1.00)*(1-0.25) + 340/1000000*2.00" and str(got["a"].total) == "0.001580000000"
    assert [c.category for c in got["a"].components] == ["input", "output"] and got["a"].unpriced_categories == ["cached_input"] and got["a"].status == "estimated"
    assert got["b"].formula == "10/1000000*9.00" and (got["c"].formula, got["c"].total, got["c"].status, got["c"].components) == ("0", None, "unpriced", None)


def test_long_price_histories(spark):
    """Ten thousand windows of one model: a use meets those of its time, so the
    join gives no more rows than uses and tiers, and the same prices."""
    width = 10**9
    rule = spark.range(10_000).select(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("input").alias("category"), (F.col("id") * width).alias("from_ns"), F.when(F.col("id") < 9_999, (F.col("id") + 1) * width).alias("to_ns"), F.lit(0).cast("long").alias("tier_min"), F.lit(None).cast("long").alias("tier_max"), F.lit(1).cast("long").alias("unit_quantity"), (F.col("id") + 1).cast("decimal(18,9)").alias("unit_price"), F.lit(None).cast("decimal(9,6)").alias("discount"), F.lit("USD").alias("currency"))
    usage = spark.range(3_000).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("input").alias("category"), F.lit(1).cast("long").alias("quantity"), (F.col("id") * 3_700_000_001).alias("at_ns"))
    got = {int(r.id): float(r.amount) for r in cost.components(usage, rule).collect()}
    assert got == {k: min(k * 3_700_000_001 // width, 9_999) + 1.0 for k in range(3_000)}
    bins = cost.in_bins(rule)
    assert bins.count() <= 10_000 + 400, "a window of a second takes one bin, the last one some on each level"
    wide = cost.in_bins(rule.limit(1).withColumn("from_ns", F.lit(12_345).cast("long")).withColumn("to_ns", F.lit(1 << 61).cast("long")))
    assert wide.count() <= 62 * 5


def test_preorder(spark):
    """Siblings by start, orphans as roots, a cycle nowhere, a deep chain."""
    rows = [("t", "r", "", 0), ("t", "a", "r", 2), ("t", "b", "r", 1), ("t", "c", "a", 3), ("t", "o", "gone", 9), ("t", "x", "y", 1), ("t", "y", "x", 1)]
    rows += [("d", str(k), str(k - 1) if k else "", 0) for k in range(150)]
    got = {}
    for r in tree.preorder(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start_ns long")).collect():
        got.setdefault(r.trace_id, []).append((r.position, r.span_id, r.depth, r.children, r.descendants))
    assert sorted(got["t"]) == [(0, "r", 0, 2, 3), (1, "b", 1, 0, 0), (2, "a", 1, 1, 1), (3, "c", 2, 0, 0), (4, "o", 0, 0, 0)]
    assert sorted(got["d"]) == [(k, str(k), k, int(k < 149), 149 - k) for k in range(150)]


def test_retries_by_link(spark):
    link = lambda s, **a: [{"span_id": s, "attributes": {f"platform.{k}": v for k, v in a.items()}}]
    rows = [("t", "1", "call", []), ("t", "2", "call", link("1", retry_of="1")), ("t", "3", "call", link("1", retry_of="1")), ("t", "4", "other", link("1")), ("u", "1", "a", []), ("u", "2", "a", []), ("u", "3", "b", [])]
    df = spark.createDataFrame([(t, s, "", n, k, l) for k, (t, s, n, l) in enumerate(rows)], "trace_id string, span_id string, parent_span_id string, name string, start_ns long, links array<struct<span_id:string,attributes:map<string,string>>>")
    assert sorted(map(tuple, tree.retries(df).collect())) == [("t", "1", 2), ("u", "1", 1)]


def test_near_duplicates_with_a_footer(spark, monkeypatch):
    """A footer in every document makes no candidates; pairs are found beside
    it, and where a shingle is dealt in parts."""
    rng = random.Random(6)
    footer = " ".join(f"f{k}" for k in range(40))
    texts = [" ".join(f"w{rng.random()}" for _ in range(60)) for _ in range(300)]
    texts += [texts[k] + " x" for k in range(0, 300, 30)]
    rows = [("s", f"d{k}", k, f"{t} {footer}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "step_id string, document_id string, rank int, content_preview string")
    want = {(f"d{k}", f"d{300 + i}") for i, k in enumerate(range(0, 300, 30))}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, _, _, t in rows]
    assert all(len(sets[int(a[1:])] & sets[int(b[1:])]) >= 0.9 * len(sets[int(a[1:])] | sets[int(b[1:])]) for a, b in want)
    assert {(r.left_id, r.right_id) for r in retrieval.near_duplicates(df).collect()} == want
    monkeypatch.setattr(retrieval, "DEALT", 3)
    copies = spark.createDataFrame([("s", f"d{k}", k, "the same text of more than five words") for k in range(20)], df.schema)
    assert retrieval.near_duplicates(copies).count() == 190
