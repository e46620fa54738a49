"""Versioned rows, trace roll-ups and what makes one stale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.plans.lineage import cut

#: Categories that count as model calls, and usage sources from
#: weakest to strongest.
MODEL_CALLS = ("llm_generation", "chat_completion", "rerank")
SOURCES = ("missing", "estimated", "client", "provider")
MAX_VALUES = 32
#: Columns that a roll-up reads, by type; those that a table lacks are null.
ROLLED = {
    **dict.fromkeys(("organization_id", "project_id", "environment", "trace_id", "span_id", "parent_span_id", "name", "category", "status", "error_message", "session_id", "subject_id", "release", "git_commit", "sdk_name", "sdk_version", "usage_source", "cost_currency", "cost_status", "model", "provider", "service_name", "prompt_version_id", "model_config_id", "dataset_version_id"), "string"),
    **dict.fromkeys(("start_ns", "end_ns", "ingested_ns", "input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_tokens"), "bigint"),
    "time_to_first_token_ms": "double", "sampling_rate": "double", "cost_total": "decimal(26,12)", "tags": "array<string>",
}
#: Lists of unique values in a roll-up, and the column of a span they come from.
LISTS = {"models": "model", "providers": "provider", "service_names": "service_name", "prompt_version_ids": "prompt_version_id", "model_config_ids": "model_config_id", "dataset_version_ids": "dataset_version_id"}
ERRORS = 3
#: Spans of a trace whose lists are made in one row.
WHOLE = 1000


def latest(df: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row for each key, the one of the greatest version (nulls least).

    A row number with a limit of one: replaced rows are dropped within their
    partition before the shuffle, which carries each row as it is."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*(F.desc_nulls_last(v) for v in version)))
    return df.withColumn("_rank", rank).filter("_rank = 1").select(*df.columns)


def upsert(table: DataFrame, new: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Replaces rows by ones of the same key and an equal or greater version."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, [*version, "_new"]).drop("_new")


def is_root(parent: str = "parent_span_id") -> Column:
    return F.coalesce(F.col(parent), F.lit("")) == ""


def _first(field: str) -> Column:
    """The first non-empty value in order of (start, span)."""
    return F.coalesce(F.min_by(field, F.when(F.coalesce(F.col(field), F.lit("")) != "", F.struct("start_ns", "span_id"))), F.lit(""))


def ordered_lists(spans: DataFrame, key: list[str], values: Column) -> DataFrame:
    """``key, lists``: for each kind of value its first unique ones, in order of
    first appearance, by kind.

    ``values`` is an array of ``kind, value, apart, most`` for each span: equal
    values of one ``apart`` count once, and ``most`` of a kind stay.  All kinds
    take one pass: values are made unique before a trace's are brought
    together, and only the first of each kind are collected."""
    rows = spans.select(*key, "start_ns", "span_id", F.inline(values)).filter(F.coalesce("value", F.lit("")) != "")
    firsts = rows.groupBy(*key, "kind", "value", "apart", "most").agg(F.min(F.struct("start_ns", "span_id")).alias("at"))
    rank = F.row_number().over(W.partitionBy(*key, "kind").orderBy("at", "value"))
    some = firsts.withColumn("_r", rank).filter(F.col("_r") <= F.col("most"))
    lists = some.groupBy(*key, "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "value"))), lambda r: r["value"]).alias("list"))
    return lists.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("kind", "list"))).alias("lists"))


def gathered_lists(spans: DataFrame, key: list[str]) -> DataFrame:
    """A roll-up's lists from one row for each trace; for traces of few spans,
    whose values need no rows of their own."""
    row = F.struct("start_ns", "span_id", *LISTS.values(), F.when(F.col("status") == "error", _error_line()).alias("error"), F.sort_array("tags").alias("tags"))
    rows = spans.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("_v"))
    told = lambda found: F.array_remove(F.array_compact(found), "")
    v = F.col("_v")
    lists = {n: F.slice(F.array_distinct(told(v[c])), 1, MAX_VALUES) for n, c in LISTS.items()}
    lists["error"] = F.slice(told(v["error"]), 1, ERRORS)
    lists["tags"] = F.slice(F.array_distinct(told(F.flatten(F.array_compact(v["tags"])))), 1, MAX_VALUES)
    return rows.select(*key, F.map_from_arrays(F.array(*map(F.lit, lists)), F.array(*lists.values())).alias("lists"))


def _lists(spans: DataFrame, key: list[str], values: Column) -> DataFrame:
    """Lists of written spans: traces of up to ``WHOLE`` spans are gathered,
    the values of larger ones are dealt as rows."""
    large = cut(spans.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE).select(*(F.col(k).alias(f"_{k}") for k in key)))
    if large.isEmpty():
        return gathered_lists(spans, key)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return gathered_lists(spans.join(large, same, "left_anti"), key).unionByName(ordered_lists(spans.join(large, same, "left_semi"), key, values))


def kind(name: str, value: Column, apart: Column | None = None, most: int = MAX_VALUES) -> Column:
    return F.struct(F.lit(name).alias("kind"), value.cast("string").alias("value"), (F.lit("") if apart is None else apart).alias("apart"), F.lit(most).alias("most"))


def status_of() -> Column:
    """error if any span failed; ok if a root is there and all spans are
    closed; else incomplete."""
    return F.when(F.bool_or(F.col("status") == "error"), "error").when(F.bool_or(is_root()) & F.bool_and(F.col("end_ns").isNotNull()), "ok").otherwise("incomplete")


def trace_rollup(spans: DataFrame) -> DataFrame:
    """One row for each trace, from all its spans (de-duplicated before).
    Columns that spans lack are null in them; what is read is written once."""
    key = ["organization_id", "trace_id"]
    spans = cut(spans.select(*((F.col(c) if c in spans.columns else F.lit(None)).cast(t if c != "trace_id" else (spans.schema[c].dataType.simpleString())).alias(c) for c, t in ROLLED.items())))
    at = F.struct("start_ns", "span_id")
    root = F.when(is_root(), at)
    category = lambda *names: F.sum(F.col("category").isin(*names).cast("long"))
    known = F.col("time_to_first_token_ms").isNotNull()
    first = F.min_by(F.struct("project_id", "environment", "sampling_rate"), at)
    base = spans.groupBy(*key).agg(
        F.coalesce(F.min_by("name", root), F.min_by("name", at)).alias("name"),
        F.min("start_ns").alias("start_ns"),
        F.max("start_ns").alias("last_start_ns"),
        F.max("end_ns").alias("end_ns"),
        (F.max("end_ns") - F.min("start_ns")).alias("duration_ns"),
        status_of().alias("status"),
        F.coalesce(F.min_by("span_id", root), F.lit("")).alias("root_span_id"),
        F.count("*").alias("span_count"),
        F.sum((F.col("status") == "error").cast("long")).alias("error_count"),
        *(_first(c).alias(c) for c in ("session_id", "subject_id", "release", "git_commit", "sdk_name", "sdk_version")),
        *(F.sum(f"{c}_tokens").alias(f"total_{c}_tokens") for c in ("input", "output", "cached_input", "reasoning")),
        F.sum("total_tokens").alias("total_tokens"),
        weakest_source("usage_source").alias("usage_source"),
        F.sum("cost_total").alias("total_cost"),
        F.coalesce(F.min_by("cost_currency", F.when(F.col("cost_total").isNotNull() & (F.coalesce("cost_currency", F.lit("")) != ""), at)), F.lit("")).alias("cost_currency"),
        worst_cost_status(F.when(F.col("cost_total").isNotNull(), F.col("cost_status"))).alias("cost_status"),
        F.min_by("time_to_first_token_ms", F.when(known, at)).alias("time_to_first_token_ms"),
        category(*MODEL_CALLS).alias("llm_call_count"),
        category("retrieval").alias("retrieval_count"),
        category("tool_call").alias("tool_call_count"),
        category("agent_decision", "agent_handoff").alias("agent_step_count"),
        F.max("ingested_ns").alias("ingested_ns"),
        first.alias("_first"),
    )
    kinds = [kind(name, F.col(c)) for name, c in LISTS.items()]
    kinds.append(kind("error", F.when(F.col("status") == "error", _error_line()), F.col("span_id"), ERRORS))
    tags = F.transform(F.coalesce("tags", F.expr("cast(array() as array<string>)")), lambda t: kind("tags", t))
    lists = _lists(spans, key, F.concat(F.array(*kinds), tags))
    out = base.join(lists, key, "left")
    got = lambda name: F.try_element_at("lists", F.lit(name))
    some = lambda name: F.coalesce(got(name), F.expr("cast(array() as array<string>)")).alias(name)
    return out.select(*(c for c in base.columns if c != "_first"), "_first.*", *map(some, (*LISTS, "tags")), _joined_errors(F.coalesce(got("error"), F.expr("cast(array() as array<string>)"))).alias("error_summary"), (F.col("status") != "incomplete").alias("complete"))


def _error_line() -> Column:
    return F.when(F.coalesce("error_message", F.lit("")) != "", F.substring(F.concat_ws(": ", "name", "error_message"), 1, 512))


def _joined_errors(lines: Column) -> Column:
    return F.substring(F.array_join(lines, " | "), 1, 2048)


def errors_summary(spans: DataFrame) -> DataFrame:
    """The first three error messages of each trace, joined."""
    key = ["organization_id", "trace_id"]
    lists = ordered_lists(spans.filter("status = 'error'"), key, F.array(kind("error", _error_line(), F.col("span_id"), ERRORS)))
    return lists.select(*key, _joined_errors(F.col("lists")["error"]).alias("error_summary"))


def weakest_source(column: str | Column = "usage_source") -> Column:
    """A trace's usage is as good as its weakest span's; none is missing."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCES)), F.col(column) if isinstance(column, str) else column), F.lit(1))
    return F.element_at(F.array(*map(F.lit, SOURCES)), F.min(F.greatest(rank, F.lit(1))).cast("int"))


def worst_cost_status(column: str | Column = "cost_estimation_status") -> Column:
    order = ("unpriced", "estimated", "final")
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column) if isinstance(column, str) else column)
    worst = F.min(F.when(at > 0, at)).cast("int")
    return F.when(worst.isNull(), "unpriced").otherwise(F.element_at(F.array(*map(F.lit, order)), worst))


def stale_rollups(spans: DataFrame, traces: DataFrame, since_ns: int | None = None) -> DataFrame:
    """Traces whose roll-up is missing or older than their newest span."""
    key = ["organization_id", "trace_id"]
    newest = (spans if since_ns is None else spans.filter(F.col("ingested_ns") >= since_ns)).groupBy(*key).agg(F.max("ingested_ns").alias("newest_ns"))
    had = traces.select(*key, F.col("ingested_ns").alias("rolled_ns"))
    return newest.join(had, key, "left").filter(F.col("rolled_ns").isNull() | (F.col("rolled_ns") < F.col("newest_ns")))


def without_children(table: DataFrame, traces: DataFrame) -> DataFrame:
    """Derived rows less those of traces that are about to be derived again."""
    return table.join(traces.select("organization_id", "trace_id").distinct(), ["organization_id", "trace_id"], "left_anti")
