"""Content-addressed versions, aliases and differences between versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assign_versions(rows: DataFrame, parent: Sequence[str], digest: str = "content_hash", born: str = "created_at", existing: DataFrame | None = None) -> DataFrame:
    """``parent..., content_hash, version_number``: equal content is one
    version; new content gets the next numbers in order of first appearance."""
    parent = list(parent)
    new = rows.groupBy(*parent, digest).agg(F.min(born).alias("_born"))
    base = F.lit(0)
    if existing is not None:
        new = new.join(existing.select(*parent, digest), [*parent, digest], "left_anti")
        new = new.join(existing.groupBy(*parent).agg(F.max("version_number").alias("_max")), parent, "left")
        base = F.coalesce(F.col("_max"), F.lit(0))
    numbered = new.withColumn("version_number", F.row_number().over(W.partitionBy(*parent).orderBy("_born", digest)) + base)
    out = numbered.select(*parent, digest, F.col("version_number").cast("long").alias("version_number"))
    return out if existing is None else existing.select(*parent, digest, F.col("version_number").cast("long")).unionByName(out)


def with_parents(versions: DataFrame, parent: Sequence[str], digest: str = "content_hash") -> DataFrame:
    """Adds ``parent_version``, the content that a version follows; null for
    the first of its name."""
    return versions.withColumn("parent_version", F.lag(digest).over(W.partitionBy(*parent).orderBy("version_number")))


def promote(aliases: DataFrame, changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Aliases after ``changes`` (``name, alias, version_id``): the version
    before is kept as previous; drafts (``published`` false) are refused."""
    ok = changes.join(versions.filter("published").select("version_id"), "version_id", "left_semi").select("name", "alias", F.col("version_id").alias("_to"))
    joined = aliases.join(ok, ["name", "alias"], "full")
    moved = F.col("_to").isNotNull() & ~F.col("_to").eqNullSafe(F.col("version_id"))
    return joined.select("name", "alias", F.coalesce("_to", "version_id").alias("version_id"), F.when(moved, F.col("version_id")).otherwise(F.col("previous_version_id")).alias("previous_version_id"))


def resolve(names: DataFrame, aliases: DataFrame, versions: DataFrame) -> DataFrame:
    """The version each ``name, alias`` stands for now."""
    return names.join(aliases.select("name", "alias", "version_id"), ["name", "alias"]).join(versions, "version_id")


def message_diff(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``key..., change`` for each message: added, removed, modified or same."""
    side = lambda df, tag: df.select(*key, F.struct(*fields).alias(tag))
    both = side(left, "_l").join(side(right, "_r"), list(key), "full")
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("_l").eqNullSafe(F.col("_r")), "modified").otherwise("same")
    return both.select(*key, change.alias("change"))


def field_diff(left: DataFrame, right: DataFrame, key: Sequence[str], column: str = "fields") -> DataFrame:
    """``key..., field, change`` of map columns with canonical JSON values."""
    flat = lambda df: df.select(*key, F.explode(column).alias("field", "_v"))
    return message_diff(flat(left), flat(right), [*key, "field"], ["_v"]).filter("change <> 'same'")


def set_diff(left: str, right: str) -> tuple:
    """Array expressions: only in left, only in right, differ as sets."""
    return F.array_except(left, right), F.array_except(right, left), F.array_sort(F.array_distinct(left)) != F.array_sort(F.array_distinct(right))
