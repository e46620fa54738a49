"""Diagnostics of retrieval steps and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.plans.lineage import cut

STEP = "step_id"
SHINGLE, NEAR = 5, 0.9
#: Documents of one shingle that meet in one part; prefixes that have a shingle
#: beyond which it comes last.
DEALT, OFTEN = 1024, 64


def diagnostics(docs: DataFrame) -> DataFrame:
    """One row for each retrieval step; partial aggregates throughout."""
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    moved = F.abs(F.col("rank") - F.col("rerank_rank"))
    base = docs.groupBy(STEP).agg(
        F.count("*").alias("document_count"),
        count(F.col("selected")).alias("selected_count"),
        (F.count("*") - count(F.col("selected"))).alias("unused_count"),
        ((F.count("*") - count(F.col("selected"))) / F.count("*")).alias("unused_ratio"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        F.avg("score").alias("score_mean"),
        F.stddev_samp("score").alias("score_stddev"),
        F.sum(F.when(F.col("selected"), F.coalesce("token_count", F.lit(0))).otherwise(0)).alias("context_tokens"),
        count(F.col("truncated")).alias("truncated_count"),
        count(F.coalesce(F.col("source"), F.lit("")) == "").alias("missing_source_count"),
        F.avg(moved).alias("mean_rank_movement"),
        count(F.col("rerank_rank") < F.col("rank")).alias("rerank_promotions"),
        count(F.col("rerank_rank") > F.col("rank")).alias("rerank_demotions"),
    )
    ranked = docs.filter("score is not null").withColumn("_r", F.row_number().over(W.partitionBy(STEP).orderBy(F.desc("score"))))
    top = ranked.filter("_r <= 2").groupBy(STEP).agg((F.max(F.when(F.col("_r") == 1, F.col("score"))) - F.max(F.when(F.col("_r") == 2, F.col("score")))).alias("score_margin"))
    twice = docs.filter("document_id is not null and document_id <> ''").groupBy(STEP, "document_id").count().filter("count > 1").groupBy(STEP).agg(F.count("*").alias("duplicate_ids"))
    return base.join(top, STEP, "left").join(twice, STEP, "left").fillna(0, ["duplicate_ids"])


def near_duplicates(docs: DataFrame, threshold: float = NEAR, first: int | None = None) -> DataFrame:
    """``step_id, left_id, right_id``: pairs among a step's documents whose
    five-word shingles have a Jaccard similarity of at least ``threshold``;
    with ``first``, among its first so many, which is what a view shows.

    Of two such sets, in any order of shingles common to the step, the first
    few (a share of 1 - threshold and one more) have a member in common, so only
    these are dealt and compared; whole sets meet for candidates only.  The
    order is that of the shingles' hashes, with those last, by their number,
    that many prefixes have: a passage that many share counts only for documents
    that are made of little else.  A shingle that many still have is dealt in
    parts, any two of which meet in a task of their own.
    """
    docs = docs.filter("content_preview <> ''")
    order = ["rank", "document_id"]
    if first is not None:
        docs = docs.withColumn("_r", F.row_number().over(W.partitionBy(STEP).orderBy(*order))).filter(F.col("_r") <= first)
    words = F.filter(F.split(F.lower("content_preview"), r"\s+"), lambda w: w != "")
    n = F.size("words")
    grams = F.when(n < SHINGLE, F.array(F.array_join("words", " "))).otherwise(F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.array_join(F.slice("words", i, SHINGLE), " ")))
    sets = docs.withColumn("words", words).filter(F.size("words") > 0).select(STEP, *order, F.sort_array(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))).alias("grams"))
    # a number of its own for each row; written, so it stays
    sets = cut(sets.select("*", F.size("grams").alias("n"), F.monotonically_increasing_id().alias("_r")))
    most = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    plain = cut(sets.select(STEP, "_r", "n", F.posexplode(F.slice("grams", F.lit(1), most)).alias("at", "g")).withColumn("at", F.col("at") + 1))
    often = cut(plain.groupBy(F.col(STEP).alias("_s"), F.col("g").alias("_g")).agg(F.count("*").alias("m")).filter(F.col("m") > OFTEN))
    listed = lambda df: (df[STEP] == often["_s"]) & (df["g"] == often["_g"])
    # sets with such a shingle in their prefix have their prefix drawn anew
    again = cut(plain.join(often, listed(plain), "left_semi").select(F.col("_r").alias("_a")).distinct())
    every = sets.join(again, F.col("_r") == F.col("_a"), "left_semi").select(STEP, "_r", "n", F.explode("grams").alias("g"))
    nth = F.row_number().over(W.partitionBy("_r").orderBy(F.col("m").asc_nulls_first(), "g"))
    drawn = every.join(often, listed(every), "left").withColumn("at", nth).filter(F.col("at") <= most)
    some = cut(plain.join(again, F.col("_r") == F.col("_a"), "left_anti").select(STEP, "_r", "n", "at", "g").unionByName(drawn.select(STEP, "_r", "n", "at", "g")))
    long = some.groupBy(F.col(STEP).alias("_s"), F.col("g").alias("_g")).agg(F.count("*").alias("m")).filter(F.col("m") > DEALT)
    parts = F.ceil(F.coalesce("m", F.lit(1)) / DEALT).cast("int")
    some = some.join(long, (F.col(STEP) == F.col("_s")) & (F.col("g") == F.col("_g")), "left").withColumn("part", F.pmod(F.xxhash64("_r", "g"), parts.cast("long")).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), parts - 1)))
    some = cut(some.select(STEP, "_r", "n", "g", "at", "part", F.least("part", "_x").alias("i"), F.greatest("part", "_x").alias("j")))
    cell = ["i", "j"]
    other = some.select(F.col(STEP).alias("_s"), F.col("g").alias("_g"), *(F.col(c).alias(f"{c}2") for c in ("_r", "n", "at", "part", *cell)))
    alike = (F.col("n") >= F.lit(threshold) * F.col("n2") - 1e-9) & (F.col("n2") >= F.lit(threshold) * F.col("n") - 1e-9)
    # what is left behind a first common shingle must be enough
    room = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1 >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n2")) - 1e-9
    once = (F.col("part") != F.col("part2")) | (F.col("i") == F.col("j"))
    same = (F.col(STEP) == F.col("_s")) & (F.col("g") == F.col("_g")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))
    pairs = some.join(other, same & (F.col("_r") < F.col("_r2")) & alike & room & once).select("_r", "_r2").distinct()
    side = lambda r, tag: sets.select(STEP, F.col("_r").alias(r), F.struct(*order, "_r").alias(tag), F.col("grams").alias(f"{tag}_grams"))
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    met = pairs.join(side("_r", "a"), "_r").join(side("_r2", "b").drop(STEP), "_r2")
    met = met.filter(both >= F.lit(threshold) * (F.size("a_grams") + F.size("b_grams") - both) - 1e-9)
    ids = [F.when(F.col("a") < F.col("b"), F.col(x)["document_id"]).otherwise(F.col(y)["document_id"]) for x, y in ("ab", "ba")]
    return met.select(STEP, ids[0].alias("left_id"), ids[1].alias("right_id"))


def ranking_metrics(docs: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``step_id, precision, recall, rr, ndcg`` of the first k documents by
    rank against ``step_id, document_id, gain`` (relevant: gain above 0).
    Null where a step has no relevant label, or for ndcg no label."""
    at = F.row_number().over(W.partitionBy(STEP).orderBy("rank", "document_id"))
    ranked = docs.select(STEP, "document_id", "rank").withColumn("pos", at)
    judged = ranked.join(labels, [STEP, "document_id"], "left")
    relevant = F.coalesce(F.col("gain") > 0, F.lit(False))
    top = F.col("pos") <= k
    got = judged.groupBy(STEP).agg(
        F.sum((top & relevant).cast("long")).alias("hits"),
        F.sum(top.cast("long")).alias("top"),
        F.min(F.when(relevant, F.col("pos"))).alias("first"),
        F.coalesce(F.sum(F.when(top, F.col("gain") / F.log2(F.col("pos") + 1))), F.lit(0.0)).alias("dcg"),
    )
    ideal = labels.withColumn("pos", F.row_number().over(W.partitionBy(STEP).orderBy(F.desc("gain"))))
    ideal = ideal.groupBy(STEP).agg(F.sum((F.col("gain") > 0).cast("long")).alias("relevant"), F.sum(F.when(F.col("pos") <= k, F.col("gain") / F.log2(F.col("pos") + 1))).alias("idcg"))
    joined = got.join(ideal, STEP, "left")
    known = F.col("relevant") > 0
    return joined.select(
        STEP,
        F.when(known, F.col("hits") / F.col("top")).alias("precision"),
        F.when(known, F.col("hits") / F.col("relevant")).alias("recall"),
        F.when(known, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"),
        F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"),
    )


def spans_with_documents(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Retrieval and rerank spans with their documents' count, zero included."""
    counts = docs.groupBy("trace_id", "span_id").agg(F.count("*").alias("documents"))
    return spans.filter(F.col("category").isin("retrieval", "rerank")).join(counts, ["trace_id", "span_id"], "left").fillna(0, ["documents"])


def view(spans: DataFrame, docs: DataFrame, prefix: str = "platform.") -> DataFrame:
    """One row for each retrieval or rerank span: header, documents by rank,
    diagnostics (``document_count`` 0 without documents) and the six stages
    (query, rewrite, embedding, retrieval, rerank, selection) in order, each
    with whether it took place.  ``docs`` has trace_id, span_id and what a
    document says of its step."""
    text = lambda name: F.coalesce(F.try_element_at("attributes", F.lit(f"{prefix}{name}")), F.lit(""))
    key = ["trace_id", "span_id"]
    header = spans.filter(F.col("category").isin("retrieval", "rerank")).select(
        *key, "name", "start_ns", (F.col("duration_ns") / 1e6).alias("latency_ms"), text("retrieval.query").alias("_query"), text("retrieval.reranker.model").alias("reranker_model"),
        text("retrieval.embedding.latency_ms").try_cast("double").alias("embedding_latency_ms"), text("retrieval.reranker.latency_ms").try_cast("double").alias("reranker_latency_ms"),
    )
    said = [c for c in ("query", "rewritten_query", "embedding_model", "search_type") if c in docs.columns]
    listed = docs.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "document_id", "score", "selected"))).alias("documents"),
        *(F.min_by(c, "rank").alias(f"_first_{c}") for c in said),
    )
    stats = diagnostics(docs.withColumn(STEP, F.struct(*key))).withColumnRenamed(STEP, "_step")
    out = header.join(listed, key, "left").join(stats, F.struct(*key) == F.col("_step"), "left").drop("_step")
    got = lambda c: F.coalesce(F.col(f"_first_{c}"), F.lit("")) if c in said else F.lit("")
    out = out.withColumn("query", F.when(got("query") != "", got("query")).otherwise(F.col("_query"))).withColumn("rewritten_query", got("rewritten_query"))
    out = out.withColumn("document_count", F.coalesce("document_count", F.lit(0))).withColumn("selected_count", F.coalesce("selected_count", F.lit(0)))
    reranked = F.col("mean_rank_movement").isNotNull()
    stage = lambda name, detail, ms, there: F.struct(F.lit(name).alias("stage"), detail.alias("detail"), ms.cast("double").alias("latency_ms"), there.alias("present"))
    none = F.lit(None)
    stages = F.array(
        stage("query", F.substring("query", 1, 200), none, F.col("query") != ""),
        stage("rewrite", F.substring("rewritten_query", 1, 200), none, (F.col("rewritten_query") != "") & (F.col("rewritten_query") != F.col("query"))),
        stage("embedding", got("embedding_model"), F.col("embedding_latency_ms"), got("embedding_model") != ""),
        stage("retrieval", F.concat("document_count", F.lit(" documents")), F.col("latency_ms"), F.lit(True)),
        stage("rerank", F.when(reranked, F.format_string("mean movement %.1f", "mean_rank_movement")).otherwise(""), F.col("reranker_latency_ms"), reranked),
        stage("selection", F.concat("selected_count", F.lit(" of "), "document_count", F.lit(" selected, "), F.coalesce("context_tokens", F.lit(0)), F.lit(" tokens")), none, F.lit(True)),
    )
    return out.withColumn("stages", stages).drop("_query", *(f"_first_{c}" for c in said))


def rerank_positions(docs: DataFrame, reranked: DataFrame) -> DataFrame:
    """Documents with their place in a step's reranked list of ids."""
    places = reranked.select(STEP, F.posexplode("ids").alias("new_rank", "document_id"))
    return docs.join(places.dropDuplicates([STEP, "document_id"]), [STEP, "document_id"], "left").withColumn("rank_delta", F.col("rank") - F.col("new_rank"))
