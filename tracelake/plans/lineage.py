"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "tracelake.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where everything runs in one process, as in tests, a temporary folder
    stands in for one that is not set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set(_OWN, named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: what follows
    depends on that table alone, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that no result reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, seconds: float) -> int:
    """Deletes this library's tables in the shared folder that are older; none
    that a result still reads may be.  Returns how many went."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("tracelake-") and f.getModificationTime() < (time.time() - seconds) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)
