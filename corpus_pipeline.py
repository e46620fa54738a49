"""A corpus pipeline: quality rules, line de-duplication, near-duplicate
removal, source mixing and encoding.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept, and returns a DataFrame, which ``run`` writes as Parquet and reads again
as the next stage's docs.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import linededup, mixing, pieces, quality, simhash
from tracelake.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and wordless texts have too few words and go; a null lang or
    source is a group of its own; very long texts are read whole; repeated rows
    are judged alike; an empty table stays empty; extra columns go."""
    return quality.judge(docs.select(*COLUMNS), keep_text=True).filter("quality.kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten or more documents go; so do documents left without a word,
    null and empty texts among them.

    Each row counts as a document, whatever its id; n_chars is counted anew;
    very long texts are read whole; an empty table stays empty; extra columns
    go."""
    out = linededup.dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("lines.kept"))
    return out.withColumn("n_chars", F.length("text").cast("long")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def _hash() -> Column:
    """A digest of the row without its id; nulls count as nulls."""
    return F.md5(F.concat(*(F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in COLUMNS[1:])))


def _key() -> Column:
    """Names a row by all it holds, for ids may be null or repeat: rows of one
    key are equal.  Rows with an id come first, by id."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), _hash().alias("hash"))


def _keyed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` joined with ``keys`` (``key``, the number ``n`` of its rows and
    more), one row for each key."""
    right = keys.select(F.col("key.doc_id").alias("_id"), F.col("key.hash").alias("_hash"), *(c for c in keys.columns if c != "key"))
    out = docs.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (_hash() == F.col("_hash"))).drop("_id", "_hash")
    if keys.filter("n > 1").isEmpty():
        return out
    return out.filter("n = 1").unionByName(out.filter("n > 1").dropDuplicates())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id
    (ties: by a digest of the row): groups of similarity 0.8 or more over
    five-word shingles.

    Null, empty and wordless texts are alike, so one of them stays; a null id
    comes after all others; equal rows are one; very long texts are read whole;
    an empty table stays empty; extra columns go."""
    docs = docs.select(*COLUMNS)
    groups = simhash.similar_documents(docs.select(_key().alias("key"), "text"), id_col="key")
    kept = cut(groups.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n")))
    return _keyed(docs, kept).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (up to three times).

    Null, empty and wordless texts have no size and are never taken; a null
    source is a source; equal rows are taken one by one; very long texts count
    whole; an empty table stays empty; extra columns go."""
    docs = docs.select(*COLUMNS)
    times = mixing.mix(docs.select(_key().alias("key"), "text", "source"), id_col="key")
    times = cut(times.groupBy(F.col("doc_id").alias("key")).agg(F.sum("repeats").cast("int").alias("times"), F.count("*").alias("n"), F.max("size").alias("size")))
    out = _keyed(docs, times.filter("times > 0 and size > 0").drop("size"))
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip``: the piece ids of every text.

    A null or empty text has none; ids are passed on as they are, null or
    repeated; very long texts are encoded whole; an empty table stays empty."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("encoding", encoding),
]

#: XXH64 under SimHash and the piece ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
