"""Quality rules with thresholds that adapt to each language and source.

Every document gets whole-text measures.  Those that pass the base rules feed
quantile sketches: counts of the measures, each rounded down to six
significant bits.  Such sketches are exact sums, so they merge in any order,
from (language, source) up to language and to the whole corpus.  Fences drawn
from each group's quartiles replace fixed cutoffs and are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import cut

#: Fixed value: what counts as a symbol.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Measure: (numerator, denominator, scale, least spread, has a lower fence).
#: The least spread stands in for the quartiles' distance where most
#: documents agree, so that a single odd character rejects nothing.
MEASURES = {
    "mean_word_chars": ("word_chars", "n_words", 1000, 250, True),
    "symbol_share": ("n_symbols", "word_chars", 10000, 50, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000, 75, False),
    "repeat_share": ("n_repeat_words", "n_words", 1000, 50, False),
}
REACH = 4
MIN_GROUP = 100


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more in one text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        h = np.zeros(n, np.uint64)
        for j in range(window):
            h = h * np.uint64(0xD6E8FEB86659FD93) + x[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def document_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines


def with_stats(docs: DataFrame, text_col: str, keep_text: bool) -> DataFrame:
    """The rows of ``docs`` with a struct column ``_stats``."""
    kept = [c for c in docs.columns if keep_text or c != text_col]
    name = "_stats"
    while name in docs.columns:
        name += "_"
    fields = [x.split()[0] for x in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([document_stats(t) for t in batch.column(0).to_pylist()], np.int64).reshape(-1, len(fields))
            stats = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(fields))], fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], stats], [*kept, name])

    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add(name, T.StructType([T.StructField(f, T.LongType()) for f in fields]))
    return docs.select(F.col(f"`{text_col}`"), *(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema), name


def _base_failed(stats: Column) -> Column:
    return (stats.n_words < 20) | (100 * stats.n_repeat_words > 30 * stats.n_words)


def _measure(stats: Column, name: str) -> Column:
    num, den, scale, _, _ = MEASURES[name]
    return F.when(stats[den] > 0, F.call_function("div", stats[num] * scale, stats[den])).otherwise(0)


def _rounded(value: Column) -> Column:
    """Down to six significant bits."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return value - value % step


def sketches(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, measure, value, n``: one quantile sketch for each
    language, source and measure; sketches merge by adding n."""
    rows = stats.select(lang, source, F.explode(F.create_map(*(x for m in MEASURES for x in (F.lit(m), F.col(m))))).alias("measure", "value"))
    return rows.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source"), "measure", _rounded(F.col("value")).alias("value")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """``keys, measure, n, lo, hi`` of the sketches merged by ``keys``."""
    group = W.partitionBy(*keys, "measure")
    merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("total", F.sum("n").over(group))
    quartiles = ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("value"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("value"))).alias("q3"),
        F.max("total").alias("n"),
    )
    pick = lambda i: F.element_at(F.create_map(*(x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v[i])))), F.col("measure"))
    width = reach * F.greatest(F.col("q3") - F.col("q1"), pick(3).cast("long"))
    return quartiles.select(*keys, "measure", "n", F.when(pick(4), F.col("q1") - width).alias("lo"), (F.col("q3") + width).alias("hi"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """``lang, source, measure, lo, hi`` for every (language, source) of the
    sketches: ``reach`` times the quartiles' distance beyond the quartiles.
    A group of fewer than ``min_group`` documents takes the fences of its
    language, or of the whole corpus if that is small too."""
    fine = _quartiles(sketch, ["lang", "source"], reach)
    by_lang = _quartiles(sketch, ["lang"], reach).select(F.col("lang").alias("_l"), F.col("measure").alias("_m"), F.struct("n", "lo", "hi").alias("b1"))
    overall = _quartiles(sketch, [], reach).select(F.col("measure").alias("_m"), F.struct("n", "lo", "hi").alias("b0"))
    out = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m"))).drop("_l", "_m")
    out = out.join(overall, F.col("measure") == F.col("_m")).drop("_m")
    best = F.when(F.col("n") >= min_group, F.struct("n", "lo", "hi")).when(F.col("b1.n") >= min_group, F.col("b1")).otherwise(F.col("b0"))
    return out.withColumn("best", best).select("lang", "source", "measure", "best.lo", "best.hi")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, reach: int = REACH, keep_text: bool = False) -> DataFrame:
    """The rows of ``docs`` (its text only if ``keep_text``) and the struct
    ``quality``: the six measures' counts, base_failed and kept.

    A row fails the base rules with fewer than 20 words or over 30 % of its
    words in repeated windows (a null, empty or blank text has no words); any
    other row is kept if all measures lie within its group's fences.  A null
    language or source is a group of its own.  Repeated rows are judged alike
    and each kept or not; an empty table stays empty.  A column named
    ``quality`` in ``docs`` is replaced; other columns pass unchanged.
    """
    docs = docs.drop("quality")
    measured, name = with_stats(docs, text_col, keep_text)
    if not keep_text:
        measured = cut(measured)
    stats = F.col(name)
    view = measured.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), _base_failed(stats).alias("failed"), *(_measure(stats, m).alias(m) for m in MEASURES))
    edge = cut(fences(cut(sketches(view.filter(~F.col("failed")))), min_group, reach))
    wide = edge.groupBy("lang", "source").pivot("measure", list(MEASURES)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    bound = F.col("_fences")
    wide = wide.select(F.col("lang").alias("_flang"), F.col("source").alias("_fsource"), F.struct(*(f"{m}_{x}" for m in MEASURES for x in ("lo", "hi"))).alias("_fences"))
    lang, source = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    out = measured.join(wide, lang.eqNullSafe(F.col("_flang")) & source.eqNullSafe(F.col("_fsource")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        value = _measure(stats, m)
        inside = inside & (value <= F.coalesce(bound[f"{m}_hi"], value)) & (value >= F.coalesce(bound[f"{m}_lo"], value))
    failed = _base_failed(stats)
    counts = [stats[x.split()[0]].alias(x.split()[0]) for x in STATS.split(", ")]
    return out.select(*(F.col(f"`{c}`") for c in measured.columns if c != name), F.struct(*counts, failed.alias("base_failed"), (~failed & inside).alias("kept")).alias("quality"))
