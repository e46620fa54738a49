"""Metric queries: aggregates, time series, exact percentiles, overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bucket widths in nanoseconds.
INTERVALS = {k: n * 10**9 for k, n in {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400, "7d": 604800}.items()}
LEVELS = (0.5, 0.75, 0.9, 0.95, 0.99)


def bucket(ns: Column, width_ns: int) -> Column:
    """Start of the epoch-aligned bucket."""
    return F.call_function("div", ns, F.lit(width_ns).cast("long")) * F.lit(width_ns).cast("long")


def auto_interval(start_ns: int, end_ns: int) -> str:
    """The narrowest width that needs at most 60 buckets."""
    return next((k for k, w in INTERVALS.items() if w * 60 >= end_ns - start_ns), "7d")


def partial_bucket(end_ns: int, now_ns: int, width_ns: int) -> int | None:
    """Start of the bucket that is still filling, if the window has it."""
    return now_ns // width_ns * width_ns if end_ns > now_ns else None


def measure(aggregation: str, column: str | None = None) -> Column:
    """count, sum (nulls count as 0), avg, min, max, unique, error_rate.
    Decimals stay exact."""
    c = F.col(column) if column else None
    return {
        "count": lambda: F.count("*"),
        "sum": lambda: F.sum(F.coalesce(c, F.lit(0))),
        "sum_known": lambda: F.sum(c),
        "avg": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "unique": lambda: F.count_distinct(c),
        "error_rate": lambda: F.sum((F.col("status") == "error").cast("long")) / F.count("*"),
    }[aggregation]()


def aggregate(df: DataFrame, by: Sequence[str], value: Column, limit: int = 20) -> DataFrame:
    """The groups with the largest values; ties by key."""
    return df.groupBy(*by).agg(value.alias("value"), F.count("*").alias("n")).orderBy(F.desc("value"), *by).limit(limit)


def percentiles(df: DataFrame, by: Sequence[str], column: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Exact lower order statistics ``v[floor(p (n - 1))]`` of a whole number,
    with n, avg and max, for each group; nulls are left out.

    Two passes: counts of the values cut to nine significant bits find where
    each rank falls, and only the values of those bins are then ranked, so no
    group is ever sorted as a whole.
    """
    by = list(by)
    v = F.col(column).cast("long")
    size = F.abs(v)
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(size)) - 9, F.lit(0))).cast("long")
    base = df.filter(F.col(column).isNotNull()).select(*by, v.alias("_v"), (F.signum(v).cast("long") * (size - size % step)).alias("_c"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    bins = base.groupBy(*by, "_c").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"), F.max("_v").alias("_m"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(group.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(group))
    target = F.floor(F.col("_p") * (F.col("_total") - 1))
    wanted = bins.withColumn("_p", F.explode(F.array(*map(F.lit, map(float, levels))))).filter((target >= F.col("_before")) & (target < F.col("_before") + F.col("_n")))
    wanted = wanted.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col("_c").alias("_wc"), "_p", (target - F.col("_before")).alias("_at"))

    def same(left: str, right: str) -> Column:
        on = F.col(left) == F.col(right)
        for i, k in enumerate(by):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return on

    fine = base.join(wanted.drop("_p", "_at").distinct(), same("_c", "_wc"), "left_semi").groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n"))
    inside = W.partitionBy(*by, "_c").orderBy("_v")
    fine = fine.withColumn("_upto", F.sum("_n").over(inside))
    hit = fine.join(wanted, same("_c", "_wc")).filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    names = [f"p{round(p * 100)}" for p in levels]
    out = hit.groupBy(*by).agg(*(F.max(F.when(F.col("_p") == float(p), F.col("_v"))).alias(n) for p, n in zip(levels, names)))
    totals = bins.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("avg"), F.max("_m").alias("max"))
    if not by:
        return out.withColumn("_j", F.lit(0)).join(totals.withColumn("_j", F.lit(0)), "_j").drop("_j")
    keyed = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), "n", "avg", "max")
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out.join(keyed, on).drop(*(f"_k{i}" for i in range(len(by))))


def aggregate_percentile(df: DataFrame, by: Sequence[str], column: str, level: float, limit: int = 20) -> DataFrame:
    """As ``aggregate``, by an exact percentile."""
    out = percentiles(df, by, column, [level]).withColumnRenamed(f"p{round(level * 100)}", "value")
    return out.select(*by, "value", "n").orderBy(F.desc("value"), *by).limit(limit)


def timeseries_percentile(df: DataFrame, time: str, width_ns: int, column: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """``bucket, by..., value, n`` of an exact percentile."""
    out = percentiles(df.withColumn("bucket", bucket(F.col(time), width_ns)), ["bucket", *by], column, [level])
    return out.select("bucket", *by, F.col(f"p{round(level * 100)}").alias("value"), "n")


def top_groups(df: DataFrame, by: Sequence[str], value: Column, n: int) -> DataFrame:
    return aggregate(df, by, value, n).select(*by)


def timeseries(df: DataFrame, time: str, width_ns: int, value: Column, by: Sequence[str] = (), top: int | None = None, top_value: Column | None = None, other: bool = False) -> DataFrame:
    """``bucket, by..., value, n``; with ``top``, only the n largest groups
    over the whole window, or the others together as ``__other__``."""
    by = list(by)
    if top is not None and by:
        # at most ``top`` rows
        best = F.broadcast(top_groups(df, by, value if top_value is None else top_value, top).select(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(by))))
        on = F.lit(True)
        for i, k in enumerate(by):
            on = on & F.col(k).eqNullSafe(F.col(f"_t{i}"))
        if other:
            df = df.join(best.withColumn("_in", F.lit(True)), on, "left")
            for k in by:
                df = df.withColumn(k, F.when(F.col("_in"), F.col(k)).otherwise("__other__"))
        else:
            df = df.join(best, on, "left_semi")
    return df.groupBy(bucket(F.col(time), width_ns).alias("bucket"), *by).agg(value.alias("value"), F.count("*").alias("n"))


def series_totals(series: DataFrame, by: Sequence[str]) -> DataFrame:
    return series.groupBy(*by).agg(F.sum("value").alias("total"), F.sum("n").alias("n"))


def overview(spans: DataFrame, *more: Column) -> DataFrame:
    """One row from one pass: requests, errors, tokens, cost."""
    return spans.agg(
        F.count_distinct("trace_id").alias("request_count"),
        F.sum((F.col("status") == "error").cast("long")).alias("error_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_total").alias("cost_total"),
        F.bool_or(F.col("cost_total").isNull()).alias("cost_is_partial"),
        *more,
    )


def whole_overview(traces: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """One row from the roll-ups of a window: requests, errors and their rate,
    tokens, cost, and exact percentiles of latency and time to first token.

    Both measures are ranked in one pass, keyed by measure; the counts are one
    aggregate more over the same rows."""
    measured = F.array(*(F.struct(F.lit(m).alias("measure"), c.cast("long").alias("v")) for m, c in (("latency_ns", F.col("duration_ns")), ("ttft_us", F.round(F.col("time_to_first_token_ms") * 1000)))))
    ranked = percentiles(traces.select(F.inline(measured)), ["measure"], "v", levels)
    names = [f"p{round(p * 100)}" for p in levels]
    one = ranked.groupBy().agg(*(F.max(F.when(F.col("measure") == m, F.col(n))).alias(f"{m}_{n}") for m in ("latency_ns", "ttft_us") for n in names))
    counts = traces.agg(
        F.count("*").alias("request_count"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum("error_count") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("error_rate"),
        *(F.coalesce(F.sum(f"total_{c}tokens"), F.lit(0)).alias(f"{c}tokens") for c in ("", "input_", "output_")),
        F.sum("total_cost").alias("total_cost"),
        F.coalesce(F.bool_or(F.col("cost_status").isin("estimated", "unpriced")), F.lit(False)).alias("cost_is_partial"),
    )
    return counts.join(F.broadcast(one))  # a row and a row


def overview_compared(spans: DataFrame, time: str, start_ns: int, end_ns: int) -> DataFrame:
    """The window and the equal one before it, in one scan."""
    both = spans.filter((F.col(time) >= 2 * start_ns - end_ns) & (F.col(time) < end_ns))
    window = F.when(F.col(time) >= start_ns, "current").otherwise("previous")
    return both.groupBy(window.alias("window")).agg(F.count_distinct("trace_id").alias("request_count"), F.sum((F.col("status") == "error").cast("long")).alias("error_count"), F.sum("input_tokens").alias("input_tokens"))


def distinct_values(df: DataFrame, column: str, prefix: str | None = None, limit: int = 100) -> DataFrame:
    c = F.col(column)
    df = df.filter(c.isNotNull() & (c != ""))
    if prefix:
        df = df.filter(c.startswith(prefix))
    return df.groupBy(c.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def shares(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Each group's part of the total."""
    sums = df.groupBy(*by).agg(F.sum(column).alias("total"))
    whole = sums.agg(F.sum(F.col("total").cast("double")).alias("_whole"))  # one row
    return sums.crossJoin(F.broadcast(whole)).withColumn("share", F.col("total").cast("double") / F.col("_whole")).drop("_whole")


def converted_totals(df: DataFrame, rates: DataFrame, amount: str = "total", currency: str = "currency") -> DataFrame:
    """Totals by currency, and in the base currency where a rate is known."""
    sums = df.groupBy(F.col(currency).alias("currency")).agg(F.sum(amount).alias("total"))
    return sums.join(rates.select(F.col("currency"), F.col("rate")), "currency", "left").select("currency", "total", (F.col("total") * F.col("rate")).alias("converted"), F.col("rate").isNull().alias("missing_rate"))


def preaggregate(df: DataFrame, time: str, by: Sequence[str], column: str, width_ns: int = INTERVALS["5m"]) -> DataFrame:
    """A roll-up table that merges: counts, sums and a quantile state (counts
    of values cut to six significant bits) for each bucket and group."""
    v = F.col(column)
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 6, F.lit(0))).cast("long")
    return df.groupBy(bucket(F.col(time), width_ns).alias("bucket"), *by, (v - v % step).alias("bin")).agg(F.count("*").alias("n"), F.sum(v).alias("sum"))


def from_preaggregate(table: DataFrame, by: Sequence[str], level: float) -> DataFrame:
    """n, sum and an approximate percentile from the roll-up table."""
    merged = table.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    w = W.partitionBy(*by)
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min(F.when(F.col("upto") > F.floor(F.lit(float(level)) * (F.col("total") - 1)), F.col("bin"))).alias("percentile"))


def segments(series: DataFrame, by: Sequence[str], width_ns: int, partial: Sequence[int] | None = None) -> DataFrame:
    """Contiguous runs of buckets with a value: gaps and islands.

    With ``partial``, the buckets that are still filling, a run also ends where
    those begin or end, ``partial`` tells which it is, and the next run goes on
    from the last bucket before it, so that the line stays whole; runs of one
    bucket, which are no line, go."""
    w = W.partitionBy(*by).orderBy("bucket")
    known = series.filter(F.col("value").isNotNull()).withColumn("partial", F.col("bucket").isin(list(partial or ())))
    gap = F.coalesce(F.col("bucket") - F.lag("bucket").over(w) != width_ns, F.lit(True))
    turn = F.coalesce(F.col("partial") != F.lag("partial").over(w), F.lit(False))
    runs = known.withColumn("_gap", gap).withColumn("_turn", turn & ~F.col("_gap")).withColumn("segment", F.sum((F.col("_gap") | F.col("_turn")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = F.max(F.col("_turn").cast("long"))
    out = runs.groupBy(*by, "segment").agg((F.min("bucket") - joined * width_ns).alias("first"), F.max("bucket").alias("last"), (F.count("*") + joined).alias("points"), F.first("partial").alias("partial"))
    return out.drop("partial") if partial is None else out.filter("points > 1")
