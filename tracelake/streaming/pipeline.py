"""From raw batches to roll-ups with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracelake.functions import redaction
from tracelake.functions.scalars import content_hash, infer_category, ns_to_timestamp, plausible_ns, provider_of, span_identity, total_tokens, usage
from tracelake.operators import cost, metrics
from tracelake.operators.rollup import trace_rollup
from tracelake.plans.lineage import cut
from tracelake.sources.otlp import decode
from tracelake.sources.store import SPAN, TABLES, VERSION, Store

#: Token counts of a span that are stored and priced, and ones only stored.
USED = ("input_tokens", "output_tokens", "cached_input_tokens")
COUNTED = ("total_tokens", "reasoning_tokens")
#: Fixed value: documents of a retrieval step that are kept, and lengths of texts.
DOCUMENTS, QUERY, PREVIEW = 500, 4096, 2048
#: What a document says of itself.
DOCUMENT = "struct<document_id:string,chunk_id:string,rank:int,score:double,rerank_score:double,rerank_rank:int,selected:boolean,token_count:bigint,truncated:boolean,source:string,title:string,content:string,content_ref:string,metadata:map<string,string>>"
#: Columns of a span from its own attributes, by name.
NAMED = {"project_id": "project.id", "session_id": "session.id", "subject_id": "subject.id", "release": "release", "git_commit": "git.commit", "prompt_version_id": "prompt.version_id", "model_config_id": "model.config_id", "dataset_version_id": "dataset.version_id", "agent_id": "agent.id"}
#: Parts that a trace's spans are dealt to for its roll-up.
PARTS = 8
LATE_NS, SKEW_NS = 7 * 86_400 * 10**9, 300 * 10**9


def checked(spans: DataFrame, now_ns: int) -> DataFrame:
    """Adds ``late_arrival`` and ``reject``: late spans are flagged and kept;
    implausible, future and inverted times are rejected."""
    reject = (
        F.when(~plausible_ns(F.col("start_ns")), "implausible_time")
        .when(F.col("start_ns") > now_ns + SKEW_NS, "clock_skew")
        .when(F.col("end_ns") < F.col("start_ns"), "end_before_start")
    )
    return spans.withColumn("late_arrival", F.col("start_ns") < now_ns - LATE_NS).withColumn("reject", reject if "reject" not in spans.columns else F.coalesce("reject", reject))


def quota(spans: DataFrame, time: str = "start_ns") -> DataFrame:
    """Spans for each organization and day."""
    return spans.groupBy("organization_id", F.date_format(ns_to_timestamp(F.col(time)), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("spans"))


def consumer_lag(heads: DataFrame, committed: DataFrame) -> DataFrame:
    """``topic, lag`` over ``topic, partition, offset`` tables."""
    at = committed.select("topic", "partition", F.col("offset").alias("done"))
    lag = F.greatest(F.col("offset") - F.coalesce("done", F.lit(0)), F.lit(0))
    return heads.join(at, ["topic", "partition"], "left").groupBy("topic").agg(F.sum(lag).alias("lag"))


def deduplicated(stream: DataFrame, identity: str = "content_hash", watermark: str = "1 hour") -> DataFrame:
    """A delivery of a span already seen within the watermark is dropped.
    ``arrived_at`` is the time of arrival: a late event is not."""
    return stream.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["organization_id", identity])


def live_tail(stream: DataFrame, watermark: str = "30 seconds") -> DataFrame:
    """Each trace once, as it appears."""
    return stream.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["organization_id", "trace_id"])


def split_poison(raw: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame]:
    """Good spans and dead letters of raw requests."""
    spans = checked(decode(raw), now_ns)
    return spans.filter("reject is null").drop("reject"), spans.filter("reject is not null").select("request_id", "index", "reject")


def delivery() -> Column:
    """The identity of a span's delivery."""
    return content_hash(span_identity(*(F.col(c) for c in ("organization_id", "project_id", "trace_id", "span_id", "start_ns", "end_ns", "name", "status"))))


def described(spans: DataFrame, organization: str, policy: redaction.Policy = redaction.Policy()) -> DataFrame:
    """Decoded spans with what their attributes say (category, provider, model,
    session, lineage, usage and where it comes from), the identity of a
    delivery, the rows that are derived from them (``events, documents,
    step``), and the attributes redacted last; keys that were are listed among
    them.  Derived texts are redacted as payloads."""
    attributes, own = F.col("attributes"), policy.prefix
    get = lambda k: F.try_element_at(attributes, F.lit(k))
    text = lambda *keys: F.coalesce(*(F.nullif(get(k), F.lit("")) for k in keys), F.lit(""))
    whole = lambda k: get(f"{own}{k}").try_cast("int")
    about = lambda k: F.coalesce(F.try_element_at("resource", F.lit(k)), F.lit(""))
    safe = lambda t, n: F.substring(F.coalesce(redaction.payload(t, policy), F.lit("")), 1, n)
    model = text("gen_ai.response.model", "gen_ai.request.model")
    listed = lambda k: F.coalesce(F.from_json(get(f"{own}{k}"), "array<string>"), F.expr("cast(array() as array<string>)"))
    names = {n: text(f"{own}{k}", *(["session.id"] if n == "session_id" else [])) for n, k in NAMED.items()}
    out = spans.drop("service_name", "category", "tags").select(
        "*", F.lit(organization).alias("organization_id"), infer_category(attributes, own).alias("category"), model.alias("model"),
        F.coalesce(F.nullif(text("gen_ai.provider.name", "gen_ai.system"), F.lit("")), provider_of(model), F.lit("")).alias("provider"),
        *(c.alias(n) for n, c in names.items()), *(usage(attributes, n, own).alias(n) for n in (*USED, *COUNTED)),
        about("deployment.environment").alias("environment"), about("service.name").alias("service_name"), about("telemetry.sdk.name").alias("sdk_name"), about("telemetry.sdk.version").alias("sdk_version"),
        listed("tags").alias("tags"), get(f"{own}latency.time_to_first_token_ms").try_cast("double").alias("time_to_first_token_ms"), text(f"{own}agent.tool.name", "gen_ai.tool.name").alias("tool_name"),
        (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
    )
    known = F.coalesce(*USED).isNotNull()
    source = text(f"{own}usage.source")
    out = out.withColumn("usage_source", F.when(~known, "missing").when(source != "", source).otherwise("provider")).withColumn("total_tokens", total_tokens(F.col("total_tokens"), F.col("input_tokens"), F.col("output_tokens")))
    # a reject is no other delivery's repeat
    apart = F.concat_ws("/", F.lit("reject"), "request_id", "index")
    out = out.withColumn("content_hash", F.when(F.col("reject").isNull() if "reject" in spans.columns else F.lit(True), delivery()).otherwise(apart)).withColumn("_clean", redaction.attributes(attributes, policy))

    found = F.slice(F.from_json(get(f"{own}retrieval.documents"), "array<string>"), 1, DOCUMENTS)
    secret = lambda k, v: redaction.sensitive_key(k, policy) | F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False))
    clean = lambda m: F.transform_values(F.coalesce(m, F.expr("cast(map() as map<string,string>)")), lambda k, v: F.when(secret(k, v), redaction.MARK).otherwise(redaction.payload(v, policy)))

    def document(d: Column, i: Column) -> Column:
        plain = {c: d[c] for c in ("chunk_id", "source", "title", "content_ref")}
        numbers = {c: d[c] for c in ("score", "rerank_score", "rerank_rank", "token_count")}
        return F.struct(
            F.coalesce(F.nullif(d["document_id"], F.lit("")), F.concat(F.lit("doc-"), i)).alias("document_id"), *(F.coalesce(v, F.lit("")).alias(c) for c, v in plain.items()),
            F.coalesce(F.nullif(d["rank"], F.lit(0)), i).alias("rank"), *(v.alias(c) for c, v in numbers.items()), *(F.coalesce(d[c], F.lit(False)).alias(c) for c in ("selected", "truncated")),
            safe(d["content"], PREVIEW).alias("content_preview"), clean(d["metadata"]).alias("metadata"),
        )

    # what is no object is none of them, but counts for their numbers
    places = F.transform(found, lambda d, i: F.struct(F.when(d.rlike(r"^\s*\{"), F.from_json(d, DOCUMENT)).alias("d"), i.alias("i")))
    documents = F.transform(F.filter(places, lambda p: p["d"].isNotNull()), lambda p: document(p["d"], p["i"]))
    shared = {"query": safe(get(f"{own}retrieval.query"), QUERY), "rewritten_query": safe(get(f"{own}retrieval.rewritten_query"), QUERY), "retriever_name": text(f"{own}retrieval.retriever.name"), "knowledge_base_version": text(f"{own}knowledge_base.version"), "embedding_model": text(f"{own}retrieval.embedding.model"), "search_type": text(f"{own}retrieval.search_type")}
    step = F.struct(
        whole("agent.step.number").alias("step_number"), text(f"{own}agent.version").alias("agent_version"), safe(get(f"{own}agent.goal"), PREVIEW).alias("goal"), whole("agent.step.parent").alias("parent_step"),
        F.coalesce(F.nullif(text(f"{own}agent.step.type"), F.lit("")), F.lit("observation")).alias("step_type"), safe(get(f"{own}agent.decision_summary"), QUERY).alias("decision_summary"), text(f"{own}agent.tool.status").alias("tool_status"),
        text(f"{own}agent.handoff.target").alias("handoff_target"), listed("agent.memory.read_keys").alias("memory_read_keys"), listed("agent.memory.write_keys").alias("memory_write_keys"), whole("agent.retry_of").alias("retry_of"), text(f"{own}agent.branch.id").alias("branch_id"),
        whole("agent.loop.iteration").alias("loop_iteration"), text(f"{own}agent.termination_reason").alias("termination_reason"), whole("agent.max_steps").alias("max_steps"),
    )
    out = out.withColumn("documents", documents).withColumn("retrieved", F.struct(*(c.alias(n) for n, c in shared.items())))
    out = out.withColumn("step", F.when(whole("agent.step.number").isNotNull() & (F.col("agent_id") != ""), step))
    out = out.withColumn("events", F.transform("events", lambda e: F.struct(e["sequence"].alias("sequence"), e["name"].alias("name"), e["time_ns"].alias("time_ns"), clean(e["attributes"]).alias("attributes"))))
    gone = redaction.redacted_keys(attributes, F.col("_clean"))
    kept = F.when(F.size(gone) > 0, F.map_concat("_clean", F.create_map(F.lit(f"{own}redacted.keys"), F.to_json(gone)))).otherwise(F.col("_clean"))
    message = F.coalesce(F.nullif(F.try_element_at("_clean", F.lit("exception.message")), F.lit("")), redaction.payload(F.col("status_message"), policy), F.lit(""))
    return out.withColumn("error_message", F.substring(message, 1, PREVIEW)).withColumn("attributes", kept).drop("_clean")


#: What pricing adds to a span, and its name in a cost's breakdown.
PRICES = {"cost_total": "total", "cost_status": "status", "cost_currency": "currency", "cost_formula": "formula", "cost_components": "components", "unpriced_categories": "unpriced_categories"}
#: Which spans are billable.
CALL = "provider <> '' and model <> ''"


def _row_id(spans: DataFrame) -> Column:
    return F.col("_row") if "_row" in spans.columns else F.concat_ws("/", "trace_id", "span_id", "content_hash")


def charges(spans: DataFrame, book: DataFrame) -> DataFrame:
    """``_id`` and the prices of spans that are billable calls."""
    calls = spans.filter(CALL).select(_row_id(spans).alias("id"), "provider", "model", F.col("start_ns").alias("at_ns"), "usage_source", F.explode(F.create_map(*(x for n in USED for x in (F.lit(n.removesuffix("_tokens")), F.col(n))))).alias("category", "quantity"))
    return cost.breakdown(calls.filter("quantity > 0"), book).select(F.col("id").alias("_id"), *(F.col(c).alias(n) for n, c in PRICES.items()))


def charged(spans: DataFrame, got: DataFrame) -> DataFrame:
    """Spans with their charges: calls meet these, the others stay where they lie."""
    calls = spans.filter(CALL).join(got, _row_id(spans) == F.col("_id"), "left").drop("_id")
    return calls.unionByName(spans.filter(f"not ({CALL})"), allowMissingColumns=True)


def priced(spans: DataFrame, book: DataFrame | None) -> DataFrame:
    """Adds ``cost_total, cost_status, cost_currency, cost_formula,
    cost_components``: every span that names a provider and a model and reports
    usage is a billable call, whatever its category; the others have no cost.
    Cached input is charged apart."""
    if book is None:
        types = {"cost_total": cost.MONEY, "cost_components": cost.COMPONENTS, "unpriced_categories": "array<string>"}
        return spans.withColumns({n: F.lit(None).cast(types.get(n, "string")) for n in PRICES})
    return charged(spans, charges(spans, book))


def arrived(raw: DataFrame, organization: str, now_ns: Column | int | None = None, policy: redaction.Policy = redaction.Policy(), decoder: Callable[..., DataFrame] = decode) -> DataFrame:
    """Spans and rejects of raw requests, described: a row function, the same
    for a batch and for a stream."""
    now = F.unix_micros(F.current_timestamp()) * 1000 if now_ns is None else now_ns
    keep = [c for c in ("arrived_at",) if c in raw.columns]
    return described(checked(decoder(raw, keep=keep), now), organization, policy)


#: Columns that name a row's span in the tables derived from it.
OF_SPAN = ("organization_id", "project_id", "environment", "trace_id", "span_id", *VERSION, "event_date", "bucket", "gone")


def fanned_out(good: DataFrame, got: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows of each table that a batch's spans yield; those that show a
    cost meet the charges, if spans are not priced yet."""
    key = [F.col(c) for c in OF_SPAN]
    paid = lambda df: df if got is None else charged(df, got)
    return {
        "spans": paid(good).drop("_row", "events", "documents", "retrieved", "step", "cost_formula", "cost_components", "unpriced_categories", "reject"),
        "span_events": good.select(*key, F.inline("events")),
        "retrieval_documents": good.select(*key, F.col("start_ns").alias("time_ns"), "retrieved.*", F.inline("documents")),
        "agent_steps": paid(good.filter("step is not null")).select(*key, "agent_id", "step.*", "start_ns", "duration_ns", "tool_name", "input_tokens", "output_tokens", "cost_total", "status", "error_message"),
        "cost_records": cost_records(paid(good)),
    }


def cost_records(good: DataFrame) -> DataFrame:
    """A row for each span that was billable."""
    return good.filter("cost_status is not null").select(*OF_SPAN, F.col("start_ns").alias("time_ns"), "provider", "model", F.col("cost_total").alias("total"), F.col("cost_currency").alias("currency"), F.col("cost_status").alias("estimation_status"), "usage_source", F.col("cost_formula").alias("formula"), F.col("cost_components").alias("components"), "unpriced_categories")


def ingest_batch(store: Store, organization: str, clock: Callable[[], int], book: DataFrame | None = None, policy: redaction.Policy = redaction.Policy(), decoder: Callable[..., DataFrame] = decode) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: one parse of a micro-batch of raw requests, or
    of rows that ``arrived``, fanned out to the store's tables.

    Spans are written redacted and priced, with their events, retrieved
    documents, agent steps and cost records; a span that was there before
    leaves a mark where it was, which hides the rows derived from it.  Roll-ups
    of the traces touched are computed anew from the units these have spans in,
    bins of the series are added, and taken back for versions that are
    replaced.  All of it is there at once when the batch is committed; run
    again, a batch writes the same.  What is read are the touched buckets of
    the days on which touched traces have spans; nothing else of the past."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = clock()
        rows = batch if "content_hash" in batch.columns else arrived(batch.select("request_id", "body"), organization, now, policy, decoder)
        # hashes of deliveries are long and follow from the rest: stored spans get theirs again
        rows = cut(rows.drop("content_hash").withColumn("_row", F.monotonically_increasing_id()))
        dead = rows.filter("reject is not null").select("request_id", "index", "reject").withColumn("batch_id", F.lit(batch_id))
        dead.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{store.root}/dead_letters")
        good = newest(rows.filter("reject is null"))
        got = None if book is None else cut(charges(good, book))
        good = (priced(good, None) if book is None else good).withColumn("ingested_ns", F.lit(now).cast("long")).withColumn("batch_id", F.lit(batch_id)).withColumn("gone", F.lit(False))
        good = good.withColumn("event_date", F.to_date(ns_to_timestamp(F.col("start_ns")))).withColumn("bucket", store.bucket())
        before = min(store.committed(), batch_id - 1)
        touched = cut(good.select("organization_id", "trace_id", "bucket").distinct())
        traces = store.rows("traces", store.units_of("traces", touched), before)
        places = good.select("event_date", "bucket")
        if traces is not None:
            at = lambda c: F.to_date(ns_to_timestamp(F.col(c)))
            had = store.merged("traces", traces).join(touched.select("organization_id", "trace_id"), ["organization_id", "trace_id"], "left_semi")
            places = places.union(had.select(F.explode(F.sequence(at("start_ns"), at("last_start_ns"))), "bucket"))
        old = store.rows("spans", store.units_of("spans", places), before)
        out, then = fanned_out(good, got), None
        if old is not None:
            again = old.select(*SPAN, *VERSION, "gone", "event_date", "bucket", "start_ns", "name", "duration_ns").join(good.select(*SPAN, F.col("index").alias("_index")), list(SPAN))
            then = cut(store.merged("spans", again))
            marks = then.select(*SPAN, "event_date", "bucket", F.lit(now).cast("long").alias("ingested_ns"), F.lit(batch_id).alias("batch_id"), F.col("_index").alias("index"), F.lit(True).alias("gone"))
            out = {t: df.unionByName(marks, allowMissingColumns=True) for t, df in out.items()}
        store.add("spans", out.pop("spans"), batch_id, {"content_hash": F.when(~F.col("gone"), delivery())})
        # what follows reads narrow columns of what was written
        own = store.written("spans", batch_id)
        if own is not None:
            own = own.filter("not gone")
            both = own if old is None else own.unionByName(old.join(touched.select("organization_id", "trace_id"), ["organization_id", "trace_id"], "left_semi"), allowMissingColumns=True)
            # a trace lies in few parts, so that its sums and lists are small before they are brought together
            both = both.withColumn("_part", F.pmod(F.xxhash64("span_id"), F.lit(PARTS))).repartition("organization_id", "trace_id", "_part")
            rolled = trace_rollup(both if old is None else store.merged("spans", both, within=["_part"])).drop("ingested_ns")
            out["traces"] = rolled.withColumn("ingested_ns", F.lit(now).cast("long")).withColumn("batch_id", F.lit(batch_id)).withColumn("index", F.lit(0)).withColumn("gone", F.lit(False)).withColumn("bucket", store.bucket())
            out["series_5m"] = series(own, then, store.buckets).withColumn("batch_id", F.lit(batch_id)).withColumn("gone", F.lit(False))
            for table, df in out.items():
                store.add(table, df, batch_id)
        merged = [store.compact(t, store.units_added(t, batch_id), batch_id) for t in TABLES]
        store.commit(batch_id)
        if any(merged):
            store.vacuum(keep=2)  # the last batch may be run again

    return write


def newest(spans: DataFrame) -> DataFrame:
    """The newest delivery of each span of a batch, by request.  Hashes of
    spans tell if any may have come twice; only the ids of those are compared,
    and rows with all they hold stay where they lie unless one has to go."""
    key = F.xxhash64("trace_id", "span_id").alias("_key")
    twice = cut(spans.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select("_key"))
    if twice.isEmpty():
        return spans
    ids = spans.select("trace_id", "span_id", "request_id", "index", "_row", key).join(twice, "_key", "left_semi")
    rank = F.row_number().over(W.partitionBy("trace_id", "span_id").orderBy(*(F.desc_nulls_last(v) for v in ("request_id", "index", "_row"))))
    older = cut(ids.withColumn("_rank", rank).filter("_rank > 1").select("_row"))
    return spans if older.isEmpty() else cut(spans.join(older, "_row", "left_anti"))


def series(new: DataFrame, replaced: DataFrame | None, buckets: int) -> DataFrame:
    """Bins of the five-minute series that a batch adds, less those of the
    versions that it replaces."""

    def bins(spans: DataFrame, sign: int) -> DataFrame:
        made = metrics.preaggregate(spans.filter("duration_ns is not null"), "start_ns", ["organization_id", "name"], "duration_ns").withColumnRenamed("bucket", "time_ns")
        return made.withColumn("n", F.col("n") * sign).withColumn("sum", F.col("sum") * sign)

    both = bins(new, 1) if replaced is None else bins(new, 1).unionByName(bins(replaced, -1))
    both = both.groupBy("time_ns", "organization_id", "name", "bin").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    return both.withColumn("event_date", F.to_date(ns_to_timestamp(F.col("time_ns")))).withColumn("bucket", F.pmod(F.xxhash64("organization_id", "name"), F.lit(buckets)).cast("int"))


def ingest(raw: DataFrame, store: Store, organization: str, checkpoint: str, window: str = "1 hour", now_ns: Column | int | None = None, clock: Callable[[], int] = time.time_ns, book: DataFrame | None = None, policy: redaction.Policy = redaction.Policy(), decoder: Callable[..., DataFrame] = decode) -> DataStreamWriter:
    """The stream of raw requests (``request_id, body, arrived_at``) into the
    store.  A delivery that was seen within the window, in whichever batch, is
    dropped before it reaches one.  What has been seen is state of the query,
    kept with the batch that saw it: if that fails, its claims go with it."""
    rows = deduplicated(arrived(raw, organization, now_ns, policy, decoder), watermark=window)
    return rows.writeStream.foreachBatch(ingest_batch(store, organization, clock, book, policy)).option("checkpointLocation", checkpoint)


def replay(spark: SparkSession, dead_path: str, replayed: DataFrame | None = None) -> DataFrame:
    """Dead letters that have not been replayed."""
    dead = spark.read.parquet(dead_path)
    return dead if replayed is None else dead.join(replayed.select("request_id", "index"), ["request_id", "index"], "left_anti")


def expired(spans: DataFrame, horizons: DataFrame, now_ns: int, default_days: int = 30) -> DataFrame:
    """Rows beyond their project's horizon (``project_id, days``)."""
    joined = spans.join(horizons, "project_id", "left")
    return joined.filter(F.col("start_ns") < F.lit(now_ns) - F.coalesce("days", F.lit(default_days)).cast("long") * 86_400 * 10**9).drop("days")


def drop_partitions(spark: SparkSession, path: str, before: datetime) -> list[str]:
    """Retention by event day: the day folders of a table that end before a
    time.  Folders are listed, the table is not read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(root) if f.getPath().getName().startswith("event_date="))
    gone = [n for n in names if n.removeprefix("event_date=") < before.strftime("%Y-%m-%d")]
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
    return gone


def kafka_requests(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw requests from Kafka, keyed by trace (needs the Kafka package on the
    cluster); offsets live in the query's checkpoint."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.concat_ws(":", "topic", "partition", "offset").alias("request_id"), F.col("value").cast("string").alias("body"), F.col("timestamp").alias("arrived_at"))


def file_requests(spark: SparkSession, path: str) -> DataFrame:
    """Raw requests from JSON-lines files as they land."""
    return spark.readStream.schema("request_id string, body string, arrived_at timestamp").json(path)
