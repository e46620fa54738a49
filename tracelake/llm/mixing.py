"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its weight's share of all words; a source whose
share exceeds ``epochs`` times its size is clamped there and the excess goes
to the others by weight, until none is above.  Sampling: all documents are
taken as many whole times as the target allows.  The fractional repetition
takes documents in a seeded order, leaving out those larger than what is still
missing; where the next one does not fit, the pass begins anew over those that
do, PASSES times at most.  Last, the one document whose size is nearest to what
is then missing is added.

Rows of equal id, source and size are one row with a number of copies, which
the order never tells apart.  It is split in 4096 buckets whose sums are added
up first, so no source's rows ever meet in one task, and sources are ranked by
ranges, so neither do the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import cut

EPOCHS = 3
SEED = "mix-2"
PASSES = 4
#: The weights that sources take in turn.
WEIGHTS = (5, 2, 1)
#: Copies of one row that a task unfolds at a time.
COPIES = 1 << 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def turn_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, column: str = "source") -> DataFrame:
    """Adds ``weight``: the sources by code point, null last, take the weights
    in turn.  They are ranked within ranges, after the counts of the ranges
    before; one row for each range is all that meets in one task."""
    ranged = cut(sources.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_from").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy(F.col("_range").alias("_from")).agg(F.count("*").alias("_n")).withColumn("_before", before)
    at = F.row_number().over(W.partitionBy("_range").orderBy(F.col(column).asc_nulls_last())) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_at") + F.col("_before")) % len(weights) + 1).cast("int"))
    ranked = ranged.withColumn("_at", at).join(starts, F.col("_range") == F.col("_from"))
    return ranked.withColumn("weight", pick.cast("long")).select(*sources.columns, "weight")


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, weight`` with ``target`` (double).  Each pass is
    one aggregate over the sources; the level rises until no more clamp."""
    cap = F.col("source_size") * epochs
    level, last = 0.0, None
    while level != last:
        clamped = F.col("weight") * F.lit(level) > cap
        total, used, free = sources.agg(F.sum("source_size"), F.sum(F.when(clamped, cap).otherwise(0)), F.sum(F.when(clamped, 0).otherwise(F.col("weight")))).first()
        last, level = level, (total - used) / free if free else level
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def _fits() -> Column:
    """A row that what is missing in its source has room for."""
    return (F.col("copies") > F.col("extra")) & (F.col("size") > 0) & (F.col("size") <= F.col("missing"))


def _by_source(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Joined with a table that has a row, or one for each bucket, a source."""
    on = F.col("source").eqNullSafe(F.col("_s"))
    if "_b" in small.columns:
        on = on & (F.col("bucket") == F.col("_b"))
    return rows.join(small, on, how).drop("_s", "_b")


def _pass(rows: DataFrame) -> DataFrame:
    """``rows`` that all fit, with ``extra`` after one run through the order."""
    room = (F.col("copies") - F.col("extra")) * F.col("size")
    parts = rows.groupBy(F.col("source").alias("_s"), F.col("bucket").alias("_b")).agg(F.sum(room).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = _by_source(rows, parts.withColumn("_before", before))
    state = F.when(F.col("_before") + F.col("_sum") <= F.col("missing"), "all").when(F.col("_before") >= F.col("missing"), "none").otherwise("edge")
    rows = rows.withColumn("_state", state)
    plain = rows.filter("_state <> 'edge'").withColumn("extra", F.when(F.col("_state") == "all", F.col("copies")).otherwise(F.col("extra")))
    # the one bucket of each source where the rest ends
    inside = W.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum(room).over(inside), F.lit(0))
    more = F.least(F.greatest(F.floor((F.col("missing") - F.col("_start")) / F.col("size")), F.lit(0)), F.col("copies") - F.col("extra"))
    edge = rows.filter("_state = 'edge'").withColumn("_start", start).withColumn("extra", F.col("extra") + more).drop("_start")
    return plain.unionByName(edge).drop("_state", "_before", "_sum")


def _unfolded(rows: DataFrame) -> DataFrame:
    """A row for each copy, ``copy`` from 1 on; many copies of one row are
    dealt to several tasks."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    many = rows.filter(F.col("copies") > COPIES).withColumn("_part", part).repartition("_part")
    split = rows.filter(F.col("copies") <= COPIES).withColumn("_part", F.lit(0).cast("long")).unionByName(many)
    copy = F.explode(F.sequence(F.col("_part") * COPIES + 1, F.least(F.col("copies"), (F.col("_part") + 1) * COPIES)))
    return split.withColumn("copy", copy).drop("_part")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, seed: str = SEED, weights: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, repeats, taken`` for each row.

    ``weights`` has ``source, weight``; without it sources take 5, 2, 1 in
    turn.  A null or empty text has size 0 and takes nothing; a null source is
    a source; sources of no words have target 0.  The seeded order is by the
    MD5 of seed, id and size, so reruns agree; repeated rows are taken one by
    one.  An empty table gives no rows; other columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size")))
    rows = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("rank", rank).withColumn("bucket", F.substring("rank", 1, 3)))
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    if weights is None:
        sources = turn_weights(sources)
    else:
        sources = sources.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0, ["weight"])
    planned = water_fill(cut(sources), epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("int")
    planned = cut(planned.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "_s"))
    columns = ["doc_id", "source", "size", "copies", "rank", "bucket", "extra"]
    left = planned.select("_s", F.col("rest").alias("missing"))
    now, settled = rows.withColumn("extra", F.lit(0).cast("long")), []
    for _ in range(PASSES):
        known = _by_source(now, left)
        settled.append(known.filter(~_fits()).select(*columns))
        seen = Observation()
        now = cut(_pass(known.filter(_fits())).select(*columns).observe(seen, F.count("*").alias("rows")))
        taken = now.groupBy(F.col("source").alias("_t")).agg(F.sum(F.col("extra") * F.col("size")).alias("_taken"))
        if not seen.get.get("rows"):
            break
        # extra is counted anew in each pass: what was taken before is settled
        left = cut(left.join(taken, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", (F.col("missing") - F.coalesce("_taken", F.lit(0))).alias("missing")))
        settled.append(now.filter("extra = copies").select(*columns))
        part = now.filter("extra > 0 and extra < copies")
        settled.append(part.withColumn("copies", F.col("extra")).select(*columns))
        now = now.filter("extra < copies").withColumn("copies", F.col("copies") - F.col("extra")).withColumn("extra", F.lit(0).cast("long"))
    settled.append(now)
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    # a row may have been settled in parts
    out = cut(out.groupBy("doc_id", "source", "size", "rank").agg(F.sum("copies").alias("copies"), F.sum("extra").alias("extra")))
    spare = _by_source(out, left).filter((F.col("extra") < F.col("copies")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("missing")))
    best = spare.groupBy(F.col("source").alias("_s")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "rank", "doc_id", "size")).alias("_best"))
    out = _by_source(_by_source(out, best, "left"), planned.drop("weight", "rest"))
    added = F.coalesce((F.col("_best.rank") == F.col("rank")) & F.col("_best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_best.size") == F.col("size")), F.lit(False))
    out = _unfolded(out.withColumn("extra", F.col("extra") + added.cast("long")))
    repeats = F.col("whole") + (F.col("copy") <= F.col("extra")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", repeats.cast("int").alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"))
