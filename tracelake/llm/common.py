"""What the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.lineage import cut, drop

__all__ = ["cut", "drop", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of a text column: one scan, one number."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
