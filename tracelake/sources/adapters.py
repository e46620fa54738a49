"""Telemetry tables from the star schema and text tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import json_map, timestamp_to_ns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each event; a trace for each user and day."""
    e = table(spark, sf_dir, "events")
    start = timestamp_to_ns(F.col("ts"))
    return e.select(
        F.concat(F.lit("org-"), F.col("user_id") % 3).alias("organization_id"),
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.col("event_type").alias("name"),
        F.col("event_type").alias("category"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        start.alias("start_ns"),
        F.round(F.col("value") * 1e6).cast("long").alias("duration_ns"),
        (start + F.round(F.col("value") * 1e6).cast("long")).alias("end_ns"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("model-"), F.col("user_id") % 5)).alias("model"),
        F.lit("acme").alias("provider"),
        (F.col("event_id") % 1000).alias("input_tokens"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 300).alias("output_tokens"),
        F.when(F.col("event_id") % 6 != 0, F.col("value").cast("decimal(18,2)")).alias("cost_total"),
        F.concat(F.lit("session-"), F.col("user_id") % 20).alias("session_id"),
        json_map(F.col("props")).alias("attributes"),
        F.array(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id") % 4)).alias("tags"),
    )


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each order line, with versions: a trace for each order, the
    parent at half the line number.  Lines meet their parts first (not at all
    if no model is read) and their orders last, so they lie by trace."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    p = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.max("p_brand").alias("p_brand"))
    start = timestamp_to_ns(F.col("o_orderdate")) + F.col("l_linenumber") * 1_000_000
    length = F.col("l_quantity").cast("long") * 1_000_000
    parent = F.call_function("div", F.col("l_linenumber"), F.lit(2))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("org").alias("organization_id"),
        F.col("l_orderkey").alias("trace_id"),
        F.col("l_linenumber").cast("string").alias("span_id"),
        F.when(parent > 0, parent.cast("string")).otherwise("").alias("parent_span_id"),
        F.concat(F.lit("op-"), F.col("l_linenumber") % 3).alias("name"),
        F.when(F.col("l_linenumber") % 3 == 0, "retrieval").when(F.col("l_linenumber") % 3 == 1, "chat_completion").otherwise("tool_call").alias("category"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"),
        start.alias("start_ns"),
        F.when(F.col("l_linestatus") == "O", start + length).when(F.col("l_quantity") > 5, start + length).alias("end_ns"),
        F.when((F.col("l_linestatus") == "O") | (F.col("l_quantity") > 5), length).alias("duration_ns"),
        F.coalesce("p_brand", F.lit("")).alias("model"),
        F.col("l_quantity").cast("long").alias("input_tokens"),
        F.lit(None).cast("long").alias("output_tokens"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost_total"),
        F.concat(F.lit("session-"), F.col("o_custkey") % 100).alias("session_id"),
        F.col("l_shipdate").alias("version_1"),
        F.col("l_partkey").alias("version_2"),
        F.col("l_suppkey").alias("version_3"),
        F.col("l_extendedprice").alias("version_4"),
    )


VERSION = ["version_1", "version_2", "version_3", "version_4"]


def retrieval_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of some ten documents: a source's ids in hundreds."""
    d = table(spark, sf_dir, "documents")
    rank = F.col("doc_id") % 100
    return d.select(
        F.concat_ws("-", "source", F.call_function("div", F.col("doc_id"), F.lit(100))).alias("step_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        rank.alias("rank"),
        (1.0 / (rank + 1)).alias("score"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7).alias("rerank_rank"),
        (rank < 30).alias("selected"),
        F.call_function("div", F.col("n_chars"), F.lit(4)).alias("token_count"),
        (F.col("n_chars") > 2048).alias("truncated"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("source"),
        F.substring("text", 1, 2048).alias("content_preview"),
    )


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retrieval step for each source, its documents whole."""
    return table(spark, sf_dir, "documents").select("source", F.col("source").alias("step_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("rank"), F.col("text").alias("content_preview"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``step_id, document_id, gain`` from the quality labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    l = table(spark, sf_dir, "labels").join(docs, "doc_id")  # noqa: E741
    return l.select(F.concat_ws("-", "source", F.call_function("div", F.col("doc_id"), F.lit(100))).alias("step_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("quality").cast("double").alias("gain"))


def agent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory for ten conversations, each an agent; a step for a turn."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min(F.length("text")).alias("n"))
    return c.select(
        F.call_function("div", F.col("conv_id"), F.lit(10)).alias("run_id"),
        F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("agent_id"),
        F.col("turn").alias("step_number"),
        F.col("role").alias("step_type"),
        F.col("role").alias("tool_name"),
        F.when(F.col("turn") % 4 == 3, F.col("turn") - 2).alias("parent_step"),
        F.when(F.col("turn") % 5 == 4, F.col("turn") - 1).alias("retry_of"),
        F.when(F.col("conv_id") % 2 == 0, "b").otherwise("").alias("branch_id"),
        F.when(F.col("turn") == 1, F.lpad((F.col("conv_id") + 1).cast("string"), 8, "0")).otherwise("").alias("handoff_target"),
        F.lit(None).cast("int").alias("loop_iteration"),
        F.when(F.col("turn") % 3 == 2, F.concat("role", F.lit("-done"))).otherwise("").alias("termination_reason"),
        F.when(F.col("turn") % 2 == 1, F.col("turn") + 5).alias("max_steps"),
        (F.col("turn") * 1000).alias("start_ns"),
        (F.col("n") * 1000).cast("long").alias("duration_ns"),
    )


def generated_spans(spark: SparkSession, traces: int, spans_each: int = 8, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Synthetic spans by hashes of (seed, number): the same on every run and
    any cluster.  3 % fail; tokens and kinds vary as an application's would."""
    n = spark.range(0, traces * spans_each, numPartitions=partitions)
    trace, at = F.call_function("div", F.col("id"), F.lit(spans_each)), F.col("id") % spans_each
    draw = lambda tag, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "id"), F.lit(m))
    start = F.lit(1_704_067_200 * 10**9) + trace * 10**9 + at * 1_000_000
    length = (draw("d", 400) + 10) * 1_000_000
    kinds = F.array(*map(F.lit, ("chat_completion", "retrieval", "tool_call", "embedding")))
    return n.select(
        F.lit("org").alias("organization_id"), F.md5(F.concat(F.lit(f"{seed}:"), trace)).alias("trace_id"), at.cast("string").alias("span_id"),
        F.when(at > 0, F.call_function("div", at - 1, F.lit(2)).cast("string")).otherwise("").alias("parent_span_id"),
        F.element_at(kinds, (draw("k", 4) + 1).cast("int")).alias("name"), F.element_at(kinds, (draw("k", 4) + 1).cast("int")).alias("category"),
        F.when(draw("e", 100) < 3, "error").otherwise("ok").alias("status"), start.alias("start_ns"), (start + length).alias("end_ns"), length.alias("duration_ns"),
        F.concat(F.lit("model-"), draw("m", 3)).alias("model"), F.concat(F.lit("session-"), trace % 50).alias("session_id"),
        (draw("i", 3800) + 200).alias("input_tokens"), (draw("o", 780) + 20).alias("output_tokens"), F.lit(None).cast("decimal(26,12)").alias("cost_total"),
    )
