"""Tables that are merged bucket by bucket, batch by batch.

Rows lie in units: an event day (where a table has one) and a bucket of trace
ids.  A batch adds a folder to each unit it touches and is there for readers
once its number is committed, so it is whole or not there at all, and one that
is run again overwrites its own folders.  A reader takes of each unit the last
folder that holds it whole (a base) and those of later batches.  After
``folders`` batches a unit is merged into a new base; what a batch reads of a
unit is therefore bounded, however many batches there were.

    root/<table>/event_date=<day>/bucket=<n>/commit=<d or b><batch>/*.parquet
    root/_committed/<batch>

Rows have ``ingested_ns, batch_id, index``, by which the newest version of a
span or trace is told, and ``gone``: a row without content that says that the
span has no others of older versions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VERSION = ("ingested_ns", "batch_id", "index")


@dataclass(frozen=True)
class Kind:
    """What a table's rows belong to, and if its units have days."""

    owner: tuple[str, ...]
    by_day: bool = True


SPAN, TRACE = ("organization_id", "trace_id", "span_id"), ("organization_id", "trace_id")
TABLES = {
    "spans": Kind(SPAN), "span_events": Kind(SPAN), "retrieval_documents": Kind(SPAN), "agent_steps": Kind(SPAN), "cost_records": Kind(SPAN),
    "traces": Kind(TRACE, by_day=False), "series_5m": Kind((), by_day=True),
}


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, folders: int = 8) -> None:
        self.spark, self.root, self.buckets, self.folders = spark, root, buckets, folders
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files ---------------------------------------------------------------

    def _names(self, pattern: str) -> list[str]:
        """Paths under the root that match, relative to it."""
        found = self._fs.globStatus(self._path(f"{self.root}/{pattern}"))
        cut = len(self._fs.makeQualified(self._path(self.root)).toString()) + 1
        return sorted(f.getPath().toString()[cut:] for f in found or [])

    def committed(self) -> int:
        """The last batch that readers see; -1 before the first."""
        return max((int(n.rsplit("/", 1)[1]) for n in self._names("_committed/*")), default=-1)

    def commit(self, batch_id: int) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/_committed"))
        self._fs.create(self._path(f"{self.root}/_committed/{batch_id}"), True).close()
        for n in self._names("_committed/*"):
            if int(n.rsplit("/", 1)[1]) < batch_id:
                self._fs.delete(self._path(f"{self.root}/{n}"), False)

    def folders_of(self, table: str, units: Iterable[str] | None = None, upto: int | None = None) -> list[str]:
        """The folders that make up a table, or some of its units, as of a batch."""
        upto = self.committed() if upto is None else upto
        patterns = [f"{table}/*/*/*" if TABLES[table].by_day else f"{table}/*/*"] if units is None else [f"{table}/{u}/commit=*" for u in units]
        by_unit: dict[str, list[tuple[int, bool, str]]] = {}
        for pattern in patterns:
            for name in self._names(pattern):
                unit, _, commit = name.rpartition("/commit=")
                if commit and int(commit[1:]) <= upto:
                    by_unit.setdefault(unit, []).append((int(commit[1:]), commit[0] == "b", name))
        out = []
        for found in by_unit.values():
            base = max((n for n, whole, _ in found if whole), default=-1)
            out += [name for n, whole, name in found if (n == base if whole else n > base)]
        return sorted(out)

    # -- rows ----------------------------------------------------------------

    def bucket(self):
        return F.pmod(F.xxhash64("organization_id", "trace_id"), F.lit(self.buckets)).cast("int")

    def rows(self, table: str, units: Iterable[str] | None = None, upto: int | None = None) -> DataFrame | None:
        """All versions that units hold; None if nothing is there."""
        folders = self.folders_of(table, units, upto)
        if not folders:
            return None
        reader = self.spark.read.option("basePath", f"{self.root}/{table}").option("mergeSchema", "true")
        return reader.parquet(*(f"{self.root}/{f}" for f in folders)).drop("commit")

    def read(self, table: str, units: Iterable[str] | None = None) -> DataFrame | None:
        """The newest version of everything in a table."""
        rows = self.rows(table, units)
        return None if rows is None else self.merged(table, rows).drop("gone", "bucket")

    def written(self, table: str, batch_id: int) -> DataFrame | None:
        """What a batch added to a table, committed or not."""
        folders = self._added(table, batch_id)
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{f}" for f in folders)).drop("commit") if folders else None

    def _added(self, table: str, batch_id: int) -> list[str]:
        return self._names(f"{table}/{'*/*' if TABLES[table].by_day else '*'}/commit=d{batch_id:012d}")

    def units_added(self, table: str, batch_id: int) -> list[str]:
        """The units that a batch added to; folders are listed, nothing is read."""
        return [f.rpartition("/commit=")[0].removeprefix(f"{table}/") for f in self._added(table, batch_id)]

    def merged(self, table: str, rows: DataFrame, keep_gone: bool = False, within: Sequence[str] = ()) -> DataFrame:
        """Rows of each owner's newest version; bins added up in series.  Rows
        that lie by columns of their owner, or ``within`` ones that follow from
        these, are not dealt again."""
        owner = TABLES[table].owner
        if not owner:
            by = [c for c in rows.columns if c not in ("n", "sum", "batch_id", "gone")]
            return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).filter("n <> 0").withColumn("batch_id", F.lit(0)).withColumn("gone", F.lit(False))
        version = F.struct(*VERSION)
        rows = rows.withColumn("_newest", F.max(version).over(W.partitionBy(*owner, *within)))
        return rows.filter((F.col("_newest") == version) & (F.lit(keep_gone) | ~F.col("gone"))).drop("_newest")

    def units_of(self, table: str, rows: DataFrame) -> list[str]:
        """The units of ``event_date, bucket`` rows: days and buckets, not rows."""
        by_day = TABLES[table].by_day
        found = rows.select(*(["event_date"] if by_day else []), "bucket").distinct().collect()
        return sorted((f"event_date={r.event_date}/" if by_day else "") + f"bucket={r.bucket}" for r in found)

    def _write(self, table: str, rows: DataFrame, commit: str, late: dict[str, Column] | None = None) -> None:
        by = (["event_date"] if TABLES[table].by_day else []) + ["bucket"]
        # rows without a day are in no unit that readers or retention would find
        out = rows.withColumn("commit", F.lit(commit))
        out = out.repartition(*by).withColumns(late or {}).sortWithinPartitions(*by, *(c for c in ("trace_id", "span_id") if c in rows.columns))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "commit").parquet(f"{self.root}/{table}")

    def add(self, table: str, rows: DataFrame, batch_id: int, late: dict[str, Column] | None = None) -> None:
        """A batch's rows, with ``event_date`` (where days are) and ``bucket``;
        ``late`` columns follow from others and are worked out where they are
        written."""
        self._write(table, rows, f"d{batch_id:012d}", late)

    def compact(self, table: str, units: Iterable[str], batch_id: int) -> list[str]:
        """Merges units of many folders, the batch's own among them, into bases
        that are committed with it; returns which."""
        many = []
        for unit in units:
            if len(self.folders_of(table, [unit], batch_id)) > self.folders:
                many.append(unit)
        if many:
            # a marker stays: what it hides may lie in another day's unit
            self._write(table, self.merged(table, self.rows(table, many, batch_id), keep_gone=True), f"b{batch_id:012d}")
        return many

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that the last ``keep`` commits do not read; returns how many."""
        last, gone = self.committed(), 0
        for table, kind in TABLES.items():
            used = {f for n in range(max(0, last - keep + 1), last + 1) for f in self.folders_of(table, None, n)}
            for name in self._names(f"{table}/*/*/*" if kind.by_day else f"{table}/*/*"):
                commit = name.rpartition("/commit=")[2]
                if commit and int(commit[1:]) <= last and name not in used:
                    gone += self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone

    def drop_days(self, before: str) -> list[str]:
        """Retention: deletes the day folders, of all tables, before a day; the
        folders are listed, no table is read."""
        gone = [n for t, k in TABLES.items() if k.by_day for n in self._names(f"{t}/event_date=*") if n.rpartition("=")[2] < before]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone
