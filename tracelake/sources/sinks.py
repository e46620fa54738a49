"""Writers: span tables laid out for pruning, exports, offloaded payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tracelake.functions import redaction
from tracelake.functions.scalars import ns_to_timestamp

#: Columns that the keys of a map may become.
COLUMNS = 10_000


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by event day, sorted by tenant and time within files, with
    Bloom filters on ids: scans prune by day, row group and id."""
    out = spans.withColumn("event_date", F.to_date(ns_to_timestamp(F.col("start_ns"))))
    # a day's rows in several files, so that a busy day is no single task
    out.repartition("event_date", F.pmod(F.xxhash64("trace_id"), F.lit(16))).sortWithinPartitions("event_date", "organization_id", "start_ns").write.mode(mode).partitionBy("event_date").option("parquet.bloom.filter.enabled#trace_id", "true").parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    return df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema))


def redacted(df: DataFrame, policy: redaction.Policy = redaction.Policy()) -> DataFrame:
    """Texts, lists of texts and maps of texts by policy; numbers as they are."""

    def column(f: StructField) -> Column:
        kind = f.dataType.simpleString()
        if kind == "string":
            return redaction.payload(F.col(f.name), policy).alias(f.name)
        if kind == "array<string>":
            return F.transform(f.name, lambda t: redaction.payload(t, policy)).alias(f.name)
        if kind == "map<string,string>":
            return redaction.attributes(F.col(f.name), policy).alias(f.name)
        return F.col(f.name)

    return df.select(*map(column, df.schema))


def union_keys(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """``key, rank``: the keys of a map column over all rows, in the order in
    which they are first seen: by row, then by place within it."""
    seen = df.select(*order, F.posexplode(F.map_keys(column)).alias("_at", "key"))
    first = seen.groupBy("key").agg(F.min(F.struct(*order, "_at")).alias("_first"))
    return first.withColumn("rank", F.row_number().over(W.orderBy("_first", "key"))).select("key", "rank")  # a row for each key


def spread(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """A column for each key of a map, in first-seen order, in its place; a
    name that is taken has the map's name before it.  The header is what the
    driver gets: at most ``COLUMNS`` keys, more are refused."""
    keys = [r[0] for r in union_keys(df, column, order).orderBy("rank").limit(COLUMNS + 1).collect()]
    if len(keys) > COLUMNS:
        raise ValueError(f"{column} has more than {COLUMNS} keys")
    taken = {c.lower() for c in df.columns} - {column.lower()}
    named = [F.try_element_at(column, F.lit(k)).alias(f"{column}.{k}" if k.lower() in taken else k) for k in keys]
    return df.select(*(x for c in df.columns for x in (named if c == column else [F.col(c)])))


def export(df: DataFrame, path: str, kind: str = "jsonl", limit: int | None = 1_000_000, policy: redaction.Policy | None = redaction.Policy(), maps: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """jsonl, csv or parquet, redacted unless ``policy`` is None; the limit is
    the feature's own.  In csv, ``maps`` name columns that become one for each
    of their keys, first seen first by ``order``; other nested ones are JSON."""
    df = df if limit is None else df.limit(limit)
    df = df if policy is None else redacted(df, policy)
    if kind == "csv":
        for column in maps:
            df = spread(df, column, order)
        flat(df).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "jsonl":
        df.write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def manifest(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes"))


def offload(df: DataFrame, column: str, longest: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Long payloads leave the table: the rows with a reference (SHA-256) and a
    preview, and the payloads, each once."""
    long = F.length(column) > longest
    ref = F.when(long, F.concat(F.lit("sha256:"), F.sha2(column, 256)))
    rows = df.withColumn(f"{column}_ref", ref).withColumn(column, F.substring(column, 1, longest))
    payloads = df.filter(long).select(F.concat(F.lit("sha256:"), F.sha2(column, 256)).alias("ref"), F.col(column).alias("payload")).dropDuplicates(["ref"])
    return rows, payloads
