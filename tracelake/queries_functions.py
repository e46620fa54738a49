"""Queries for scalar functions, smaller joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import redaction, scalars
from tracelake.operators import cost, metrics, registry, retrieval, rollup, tree
from tracelake.queries import A, D, E, L, _latest, _p, query
from tracelake.sources import adapters, sinks

HOUR = metrics.INTERVALS["1h"]


@query("select event_id, epoch_us(ts) // 1000000 * 1000 seconds_ms, epoch_us(ts) * 1000 between 946684800000000000 and 4102444800000000000 plausible, value * 1e6 / 1e6 ms from events")
def fn_time(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    ns = scalars.timestamp_to_ns(F.col("ts"))
    return e.select("event_id", (F.unix_seconds(scalars.ns_to_timestamp(ns)) * 1000).alias("seconds_ms"), scalars.plausible_ns(ns).alias("plausible"), scalars.ns_to_ms(F.col("value") * 1e6).alias("ms"))


@query("select event_id, epoch_us(ts) // 1000000 * 1000000000 a, epoch_us(ts) * 1000 b from events")
def fn_parse_ts(spark, sf_dir):
    """The same time as RFC 3339 text (to the second) and as nanoseconds."""
    e = adapters.table(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", scalars.parse_ns(text).alias("a"), scalars.parse_ns(scalars.timestamp_to_ns(F.col("ts")).cast("string")).alias("b"))


@query("select event_id, replace(replace(lower(event_type), '-', '_'), ' ', '_') in ('custom') known, case event_id % 3 when 0 then 'tool_call' when 1 then 'db_query' else 'custom' end coerced from events")
def fn_enum_coerce(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, " Tool-Call ").when(F.col("event_id") % 3 == 1, "DB Query").otherwise("unheard of")
    e = adapters.table(spark, sf_dir, "events")
    return e.select("event_id", (scalars.coerce_category(F.col("event_type")) != "custom").alias("known"), scalars.coerce_category(raw).alias("coerced"))


@query(f"with {E} select span_id, coalesce(input_tokens + output_tokens, input_tokens) total, case when cast(span_id as bigint) % 2 = 0 then greatest(input_tokens - coalesce(output_tokens, 0), 0) else input_tokens end billable from e")
def fn_usage(spark, sf_dir):
    s = adapters.event_spans(spark, sf_dir)
    convention = F.when(F.col("span_id").cast("long") % 2 == 0, "inclusive").otherwise("exclusive")
    total = scalars.total_tokens(F.lit(None).cast("long"), F.col("input_tokens"), F.col("output_tokens"))
    return s.select("span_id", total.alias("total"), scalars.billable_input(F.col("input_tokens"), F.col("output_tokens"), convention).alias("billable"))


@query(f"with {E}, x as (select span_id, input_tokens a, output_tokens b, cast(span_id as bigint) % 3 k from e) select span_id, case k when 0 then a when 1 then b else coalesce(b, a) end merged from x")
def fn_usage_merge(spark, sf_dir):
    s = adapters.event_spans(spark, sf_dir)
    k = F.col("span_id").cast("long") % 3
    a, b = F.col("input_tokens"), F.col("output_tokens")
    left, right = F.when(k == 2, b).otherwise(a), F.when(k == 2, a).otherwise(b)
    first = F.when(k == 0, "provider").when(k == 1, "estimated").otherwise("client")
    return s.select("span_id", scalars.merged_usage(left, right, first, F.lit("client")).alias("merged"))


@query("""select event_id, case event_id % 3 when 0 then 'openai' when 1 then 'bedrock' else 'anthropic' end provider, event_id % 100 input_tokens, event_id % 7 output_tokens, case when event_id % 3 <> 1 then event_id % 5 end cached_input_tokens, case event_id % 3 when 0 then 'inclusive' else 'exclusive' end cache_convention from events""")
def fn_provider_usage(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    i, k = F.col("event_id"), F.col("event_id") % 3
    raw = (
        F.when(k == 0, F.to_json(F.struct((i % 100).alias("prompt_tokens"), (i % 7).alias("completion_tokens"), F.struct((i % 5).alias("cached_tokens")).alias("prompt_tokens_details"))))
        .when(k == 1, F.to_json(F.struct((i % 100).alias("inputTokens"), (i % 7).alias("outputTokens"))))
        .otherwise(F.to_json(F.struct((i % 100).alias("input_tokens"), (i % 7).alias("output_tokens"), (i % 5).alias("cache_read_input_tokens"))))
    )
    name = scalars.provider_of(F.when(k == 0, "gpt-x").when(k == 1, "amazon.nova").otherwise("claude-x"))
    return e.select("event_id", name.alias("provider"), scalars.provider_usage(name, raw).alias("u")).select("event_id", "provider", "u.*")


@query("""select event_id, substr(event_type, 1, 4) as name, '{"k":"' || json_extract_string(props, '$.k') || '"}' props from events""")
def fn_truncate_project(spark, sf_dir):
    """Text cut to a column's limit, and a map less promoted keys as JSON."""
    e = adapters.table(spark, sf_dir, "events")
    m = F.map_concat(scalars.json_map(F.col("props")), F.create_map(F.lit("promoted"), F.lit("1")))
    return e.select("event_id", F.substring("event_type", 1, 4).alias("name"), F.to_json(scalars.without_keys(m, ["promoted"])).alias("props"))


@query("""with recursive b as (select event_id, event_type || '-é' k from events), x as (select event_id, k, 0 i, cast(0 as bigint) h from b union all select event_id, k, i + 1, (h * 131 + cast('0x' || substr(hex(encode(k)), 2 * i + 1, 2) as bigint)) % 4294967296 from x where i < octet_length(encode(k))) select event_id, h % 8 as "partition" from x where i = octet_length(encode(k))""")
def fn_partition(spark, sf_dir):
    return adapters.table(spark, sf_dir, "events").select("event_id", scalars.partition_of(F.concat("event_type", F.lit("-é"))).alias("partition"))


@query(f"with {E}, x as (select span_id, case when cast(span_id as bigint) % 2 = 0 then input_tokens else 7 end i, case when cast(span_id as bigint) % 3 = 0 then null else output_tokens end o from e) select span_id, i input_tokens, o output_tokens from x")
def fn_usage_extract(spark, sf_dir):
    """The platform's key wins by presence, with a value or without."""
    s = adapters.event_spans(spark, sf_dir)
    n = F.col("span_id").cast("long")
    pairs = F.create_map(F.lit("gen_ai.usage.input_tokens"), F.col("input_tokens").cast("string"), F.lit("gen_ai.usage.output_tokens"), F.col("output_tokens").cast("string"))
    own = F.when(n % 2 == 1, F.create_map(F.lit("platform.usage.input_tokens"), F.lit("7"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    none = F.when(n % 3 == 0, F.create_map(F.lit("platform.usage.output_tokens"), F.lit("?"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    m = F.map_concat(pairs, own, none)
    return s.select("span_id", scalars.usage(m, "input_tokens").alias("input_tokens"), scalars.usage(m, "output_tokens").alias("output_tokens"))


@query(f"with {E} select span_id, coalesce(cast(cast(cost_total as decimal(26,6)) as varchar), '-') cost, case when duration_ns / 1e6 < 1000 then cast(round(duration_ns / 1e6) as bigint) || 'ms' else '-' end took from e")
def fn_format(spark, sf_dir):
    s = adapters.event_spans(spark, sf_dir)
    text = F.regexp_replace(scalars.format_cost(F.col("cost_total"), F.lit("USD")), " USD$", "")
    return s.select("span_id", F.coalesce(text, F.lit("-")).alias("cost"), scalars.format_duration(F.col("duration_ns") / 1e6).alias("took"))


@query(f"with {E} select span_id, (input_tokens - output_tokens) \"absolute\", round(case when output_tokens <> 0 then (input_tokens - output_tokens) / output_tokens::double end, 9) relative from e")
def fn_delta(spark, sf_dir):
    absolute, relative = scalars.delta(F.col("output_tokens"), F.col("input_tokens"))
    return adapters.event_spans(spark, sf_dir).select("span_id", absolute.alias("absolute"), F.round(relative, 9).alias("relative"))


@query("with k as (select event_id, case event_id % 4 when 0 then 'Api_Key' when 1 then 'x-cookie-id' when 2 then 'author' else 'note' end k from events) select event_id, k, case when contains(lower(k), 'api_key') or contains(lower(k), 'cookie') then '[redacted]' else 'plain' end v from k")
def redact_keys(spark, sf_dir):
    key = F.when(F.col("event_id") % 4 == 0, "Api_Key").when(F.col("event_id") % 4 == 1, "x-cookie-id").when(F.col("event_id") % 4 == 2, "author").otherwise("note")
    m = redaction.attributes(F.create_map(key, F.lit("plain")))
    return adapters.table(spark, sf_dir, "events").select("event_id", F.explode(m).alias("k", "v"))


@query("select doc_id, case when length(text) > 500 then substr(text, 1, 500) || '…[truncated]' else text end text from documents")
def redact_truncate(spark, sf_dir):
    return adapters.table(spark, sf_dir, "documents").select("doc_id", redaction.truncated(F.col("text"), 500).alias("text"))


@query(f"with {E} select session_id, {_p(0.9)} \"value\", count(duration_ns) n from e group by session_id order by 2 desc, 1 limit 8")
def agg_percentile_groups(spark, sf_dir):
    return metrics.aggregate_percentile(adapters.event_spans(spark, sf_dir), ["session_id"], "duration_ns", 0.9, 8)


@query(f"with {E} select start_ns // {HOUR} * {HOUR} bucket, {_p(0.5)} \"value\", count(duration_ns) n from e group by 1")
def agg_timeseries_percentile(spark, sf_dir):
    return metrics.timeseries_percentile(adapters.event_spans(spark, sf_dir), "start_ns", HOUR, "duration_ns", 0.5)


@query(f"with {E} select model, count(*) n, cast(sum(input_tokens) as bigint) tokens from e where model <> '' group by model")
def agg_count_spans(spark, sf_dir):
    return adapters.event_spans(spark, sf_dir).filter("model <> ''").groupBy("model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"))


@query(f"with {E} select session_id from e group by session_id order by sum(input_tokens) desc, session_id limit 7")
def agg_top_groups(spark, sf_dir):
    return metrics.top_groups(adapters.event_spans(spark, sf_dir), ["session_id"], metrics.measure("sum", "input_tokens"), 7)


@query(f"with {E}, x as (select trace_id, case when output_tokens is null then 'missing' when cast(span_id as bigint) % 5 = 0 then 'estimated' else 'provider' end s from e) select trace_id, case when bool_or(s = 'missing') then 'missing' when bool_or(s = 'estimated') then 'estimated' else 'provider' end usage_source from x group by trace_id")
def agg_usage_acc(spark, sf_dir):
    source = F.when(F.col("output_tokens").isNull(), F.lit(None)).when(F.col("span_id").cast("long") % 5 == 0, "estimated").otherwise("provider")
    return adapters.event_spans(spark, sf_dir).withColumn("usage_source", source).groupBy("trace_id").agg(rollup.weakest_source().alias("usage_source"))


@query("select count(*) as \"rows\", cast(sum(strlen(cast(to_json(struct_pack(a := event_id, b := event_type, c := props)) as varchar))) as bigint) bytes from events")
def agg_manifest(spark, sf_dir):
    """Rows, and bytes as JSON lines."""
    return sinks.manifest(adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("a"), F.col("event_type").alias("b"), F.col("props").alias("c")))


@query(f"with {E}, b as (select start_ns // {HOUR} * {HOUR} bucket, session_id, name, count(*) n from e group by 1, 2, 3), g as (select *, bucket - row_number() over (partition by session_id, name order by bucket) * {HOUR} k from b) select session_id, name, min(bucket) \"first\", max(bucket) \"last\", count(*) points from g group by session_id, name, k")
def chart_segments(spark, sf_dir):
    by = ["session_id", "name"]
    series = metrics.timeseries(adapters.event_spans(spark, sf_dir), "start_ns", HOUR, metrics.measure("count"), by)
    return metrics.segments(series, by, HOUR).drop("segment")


@query(f"with {L}, u as (select trace_id, name, min((start_ns, span_id)) born from l group by 1, 2) select trace_id, string_agg(name, '|' order by born) services from u group by trace_id")
def services_order(spark, sf_dir):
    out = tree.services_in_order(_latest(spark, sf_dir), "name")
    return out.select("trace_id", F.array_join("services", "|").alias("services"))


@query(f"with {L}, dc as (select trace_id, span_id, cast(span_id as bigint) % 4 n from l where cast(span_id as bigint) % 4 > 0) select l.trace_id, l.span_id, coalesce(n, 0) documents from l left join dc using (trace_id, span_id) where category = 'retrieval'")
def retrieval_spans(spark, sf_dir):
    spans = _latest(spark, sf_dir)
    n = (F.col("span_id").cast("long") % 4).cast("int")
    docs = spans.filter(n > 0).select("trace_id", "span_id", F.explode(F.sequence(F.lit(1), n)).alias("rank"))
    return retrieval.spans_with_documents(spans, docs).select("trace_id", "span_id", "documents")


@query(f"with {D}, r as (select step_id, document_id, row_number() over (partition by step_id order by rank desc) - 1 nr from d), k as (select * from r where nr < 5) select d.step_id, d.document_id, k.nr new_rank, d.rank - k.nr rank_delta from d left join k using (step_id, document_id)")
def rerank_positions(spark, sf_dir):
    docs = adapters.retrieval_documents(spark, sf_dir)
    lists = docs.groupBy("step_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "document_id")), asc=False), lambda r: r["document_id"]), 1, 5).alias("ids"))
    return retrieval.rerank_positions(docs.select("step_id", "document_id", "rank"), lists).select("step_id", "document_id", F.col("new_rank").cast("long").alias("new_rank"), "rank_delta")


@query("select r_name as name, case when r_regionkey % 2 = 0 then 'v' || (r_regionkey + 10) else 'v' || r_regionkey end version_id, case when r_regionkey % 2 = 0 then 'v' || r_regionkey end previous_version_id, n_name from region join nation on n_regionkey = r_regionkey")
def alias_resolve(spark, sf_dir):
    """Aliases after a promotion, resolved; versions are keyed by region."""
    r = adapters.table(spark, sf_dir, "region")
    v = F.concat(F.lit("v"), F.col("r_regionkey"))
    up = F.concat(F.lit("v"), F.col("r_regionkey") + 10)
    aliases = r.select(F.col("r_name").alias("name"), F.lit("prod").alias("alias"), v.alias("version_id"), F.lit(None).cast("string").alias("previous_version_id"))
    changes = r.select(F.col("r_name").alias("name"), F.lit("prod").alias("alias"), up.alias("version_id"))
    drafts = r.select(up.alias("version_id"), (F.col("r_regionkey") % 2 == 0).alias("published"))
    after = registry.promote(aliases, changes, drafts)
    n = adapters.table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    versions = n.select(v.alias("version_id"), "n_name").unionByName(n.select(up.alias("version_id"), "n_name"))
    got = registry.resolve(after.select("name", "alias"), after, versions)
    return got.join(after.select("name", "previous_version_id"), "name").select("name", "version_id", "previous_version_id", "n_name")


@query("with p as (select p_brand model, p_size, p_partkey from part), own as (select distinct model, p_size from p where p_partkey % 3 <> 1), pub as (select distinct model, p_size from p where p_partkey % 3 <> 0) select model, p_size tier_min, 'tenant' origin from own union all select model, p_size, 'public' from pub where (model, p_size) not in (select model, p_size from own)")
def tenant_precedence(spark, sf_dir):
    """Every part is a tenant's rule, a public one or both."""
    p = adapters.table(spark, sf_dir, "part")
    third = F.col("p_partkey") % 3
    owner = F.explode(F.when(third == 0, F.array(F.lit("t"))).when(third == 1, F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit("t"), F.lit(None).cast("string"))))
    book = p.select(F.lit("acme").alias("provider"), F.col("p_brand").alias("model"), F.lit("input").alias("category"), F.lit(0).alias("from_ns"), F.col("p_size").alias("tier_min"), owner.alias("organization_id")).distinct()
    return cost.tenant_rules(book, "t").select("model", "tier_min", F.when(F.col("organization_id").isNull(), "public").otherwise("tenant").alias("origin"))


@query("select p_partkey from part where p_partkey % 7 = 0 or p_partkey % 11 = 0 or p_size % 5 = 0 or p_size % 6 = 1 or p_partkey % 13 = 0")
def price_invalid(spark, sf_dir):
    """Parts as price rules, some of them wrong in each of the five ways."""
    p, k, size = adapters.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("long")
    rules = p.select(
        "p_partkey", F.when(k % 7 == 0, -1).otherwise(F.col("p_retailprice")).alias("unit_price"), F.when(k % 11 == 0, 0).otherwise(1000).alias("unit_quantity"),
        F.when(k % 13 == 0, F.lit(1.0)).alias("discount"), size.alias("from_ns"), F.when(F.col("p_size") % 5 == 0, size).when(F.col("p_size") % 2 == 0, size + 1).alias("to_ns"),
        F.lit(3).alias("tier_min"), F.when(F.col("p_size") % 6 == 1, 3).otherwise(9).alias("tier_max"),
    )
    return cost.invalid(rules).select("p_partkey")


@query(f"with {E} select organization_id, trace_id, span_id from e where trace_id not in (select trace_id from e where name = 'signup')")
def sink_delete_children(spark, sf_dir):
    s = adapters.event_spans(spark, sf_dir)
    return rollup.without_children(s, s.filter("name = 'signup'")).select("organization_id", "trace_id", "span_id")


@query(f"with {A}, x as (select run_id, list_sort(list_distinct(list(role))) a, list_sort(list_distinct(list(role) filter (where step_number > 2))) b from s group by run_id) select run_id, array_to_string(list_filter(a, lambda v: not list_contains(coalesce(b, []), v)), ',') only_left, coalesce(b, []) <> a differs from x")
def set_diff(spark, sf_dir):
    s = adapters.agent_steps(spark, sf_dir).groupBy("run_id").agg(F.sort_array(F.collect_set("step_type")).alias("a"), F.sort_array(F.collect_set(F.when(F.col("step_number") > 2, F.col("step_type")))).alias("b"))
    left, _, differs = registry.set_diff("a", "b")
    return s.select("run_id", F.array_join(F.sort_array(left), ",").alias("only_left"), differs.alias("differs"))


@query("select l_orderkey trace_id, sha256(string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey)) as \"ref\" from lineitem group by l_orderkey having length(string_agg(l_linenumber || ':' || l_partkey, ',')) > 40")
def sink_offload(spark, sf_dir):
    """Payloads beyond 40 characters leave for an object store, by digest."""
    li = adapters.table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"])), ",").alias("payload"))
    rows, _ = sinks.offload(lines, "payload", 40)
    return rows.filter("payload_ref is not null").select(F.col("l_orderkey").alias("trace_id"), F.regexp_replace("payload_ref", "^sha256:", "").alias("ref"))


@query("""with n as (select range id from range(8000)) select cast(id % 8 as varchar) span_id, case when id % 8 > 0 then cast((id % 8 - 1) // 2 as varchar) else '' end parent, count(*) spans, cast(sum(id // 8 * 1000000000 + id % 8 * 1000000) as bigint) starts, 50 sessions, true plausible from n group by 1, 2, id % 8""")
def src_demo_gen(spark, sf_dir):
    """The shape of the generated traces; draws stay within their bounds."""
    s = adapters.generated_spans(spark, 1000)
    fine = F.col("input_tokens").between(200, 3999) & F.col("output_tokens").between(20, 799) & F.col("duration_ns").between(10_000_000, 409_000_000) & F.col("status").isin("ok", "error")
    return s.groupBy("span_id", F.col("parent_span_id").alias("parent")).agg(F.count("*").alias("spans"), F.sum(F.col("start_ns") - 1_704_067_200 * 10**9).alias("starts"), F.count_distinct("session_id").alias("sessions"), F.bool_and(fine).alias("plausible"))


@query(f"with {L} select trace_id, min(start_ns) start_ns, max(end_ns) end_ns, count(*) n from l where category in ('retrieval', 'rerank') or category = 'chat_completion' group by trace_id")
def trace_windows(spark, sf_dir):
    return _latest(spark, sf_dir).filter(F.col("category").isin("retrieval", "rerank", "chat_completion")).groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("n"))
