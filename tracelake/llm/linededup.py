"""Line de-duplication that stays reversible.

State: an exact reference-count table (in how many documents each line key
occurs) and, for each shard of the keys, a cuckoo filter over the keys at or
above the threshold.  Inserting documents adds to the counts, deleting them
subtracts; keys that cross the threshold are inserted into or deleted from
their shard's filter.  Looking up a text asks the filters first and the exact
table about their hits, so a filter's false positives drop nothing.

A corpus is an insertion into an empty state.  While filters and hot keys are
small they go to the tasks that read the texts; beyond, the texts' keys are
dealt by shard, and in parts of a shard, to where its filter and its hot keys
are.  A shard holds some KEYS_PER_SHARD hot keys, so their number grows with
the state.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import cut

MIN_DOCS = 10
_WS = b" \t\n\v\f\r"
#: What may be sent to every task: filters and hot keys, in bytes.
BROADCAST_BYTES = 8 << 20
KEYS_PER_SHARD = 50_000
#: Keys of texts that meet one shard's filter in one task.
PART_KEYS = 1 << 20


def line_key(line: bytes) -> bytes:
    """A line without outer white space, in lower case (A-Z); may be empty."""
    return line.strip(_WS).lower()


def digest(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class CuckooFilter:
    """16-bit tags in buckets of four; a key's two buckets differ by a hash of
    its tag, so a tag moves, and goes, without its key."""

    SLOTS = 4

    def __init__(self, capacity: int, cells: np.ndarray | None = None) -> None:
        n = 1
        while n * self.SLOTS * 0.8 < capacity:
            n *= 2
        self.cells = np.zeros((n, self.SLOTS), np.uint16) if cells is None else cells

    def _place(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        tag = (x[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        mask = np.uint64(len(self.cells) - 1)
        first = x[:, 0] & mask
        return tag, first.astype(np.int64), (first ^ self._shift(tag)).astype(np.int64)

    def _shift(self, tag: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & np.uint64(len(self.cells) - 1)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.empty(0, bool)
        tag, i, j = self._place(keys)
        return ((self.cells[i] == tag[:, None]) | (self.cells[j] == tag[:, None])).any(axis=1)

    def insert(self, key: bytes) -> bool:
        """False if there is no room: build a larger one from the exact table."""
        tag, i, j = (x[0] for x in self._place([key]))
        for at in (i, j):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = tag
                return True
        at = j
        for kick in range(500):
            slot = kick % self.SLOTS
            tag, self.cells[at, slot] = self.cells[at, slot], tag
            at = int(at) ^ int(self._shift(np.array([tag], np.uint16))[0])
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = tag
                return True
        return False

    def delete(self, key: bytes) -> bool:
        tag, i, j = (x[0] for x in self._place([key]))
        for at in (i, j):
            found = np.flatnonzero(self.cells[at] == tag)
            if len(found):
                self.cells[at, found[0]] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return struct.pack("<q", len(self.cells)) + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16, offset=8).reshape(struct.unpack("<q", data[:8])[0], cls.SLOTS).copy())

    @classmethod
    def of(cls, keys: Iterable[bytes]) -> CuckooFilter:
        keys = list(keys)
        room = max(16, len(keys))
        while True:
            out = cls(room)
            if all(map(out.insert, keys)):
                return out
            room *= 2


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[4:8], "little") % shards


def _key_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``key, refs``: documents that hold each line key, added up by batch;
    a key may come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                counts.update({line_key(x) for x in _encode(text).split(b"\n")})
            counts.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["key", "refs"])

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "key binary, refs long")


def empty_state(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The exact table ``key, refs`` and the filters ``shard, filter`` of no
    documents."""
    none = spark.range(1).filter(F.lit(False))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return none.select(null("binary", "key"), null("long", "refs")), none.select(null("int", "shard"), null("binary", "filter"))


def insert(refs: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The exact table with more documents; each row of ``docs`` is one."""
    return refs.select("key", "refs").unionByName(_key_counts(docs, text_col)).groupBy("key").agg(F.sum("refs").alias("refs"))


def delete(refs: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table without these documents, which were inserted before."""
    gone = _key_counts(docs, text_col).withColumn("refs", -F.col("refs"))
    return refs.select("key", "refs").unionByName(gone).groupBy("key").agg(F.sum("refs").alias("refs")).filter("refs > 0")


def _sharded(refs: DataFrame, shards: int) -> DataFrame:
    low = F.conv(F.concat(*(F.hex(F.substring("key", i, 1)) for i in (8, 7, 6, 5))), 16, 10).cast("long")
    return refs.withColumn("shard", (low % shards).cast("int"))


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """The filters after the counts went from ``before`` to ``after``: only
    keys that crossed the threshold are inserted or deleted; a filter without
    room is built again from its shard's keys of the exact table.  Another
    number of shards begins with no filters and nothing before."""
    was = before.select("key", F.col("refs").alias("was"))
    joined = after.join(was, "key", "full").select("key", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("refs", F.lit(0)).alias("refs"))
    near = _sharded(joined.filter((F.col("refs") >= min_docs) | (F.col("was") >= min_docs)), shards)

    def update(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        table = CuckooFilter.from_bytes(bytes(old["filter"].iloc[0])) if len(old) else CuckooFilter.of([])
        now, then = rows["refs"] >= min_docs, rows["was"] >= min_docs
        ok = all([table.delete(bytes(k)) for k in rows["key"][then & ~now]]) and all(table.insert(bytes(k)) for k in rows["key"][now & ~then])
        if not ok:
            table = CuckooFilter.of(map(bytes, rows["key"][now]))
        return pd.DataFrame({"shard": [key[0]], "filter": [table.to_bytes()]})

    return filters.groupBy("shard").cogroup(near.groupBy("shard")).applyInPandas(update, "shard int, filter binary")


def _drop(text: str | None, hot: set[bytes] | frozenset[bytes]) -> tuple[int, int, str]:
    lines = _encode(text).split(b"\n")
    kept = [x for x in lines if not ((k := line_key(x)) and digest(k) in hot)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")


def _by_broadcast(docs: DataFrame, filters: dict[int, bytes], hot: frozenset[bytes], shards: int, cols: list[str], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: CuckooFilter.from_bytes(x) for s, x in filters.items()}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = {digest(k) for t in texts for x in _encode(t).split(b"\n") if (k := line_key(x))}
            by_shard: dict[int, list[bytes]] = {}
            for k in keys:
                by_shard.setdefault(shard_of(k, shards), []).append(k)
            hits = {k for s, ks in by_shard.items() if s in tables for k, hit in zip(ks, tables[s].contains(ks)) if hit}
            yield _rows(batch, [_drop(t, hits & hot) for t in texts], cols)

    return docs.mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, found: list[tuple[int, int, str]], cols: list[str]) -> pa.RecordBatch:
    n, d, kept = zip(*found) if found else ((), (), ())
    line = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.string())], ["n_lines", "n_dropped", "kept"])
    return pa.RecordBatch.from_arrays([*batch.columns[1 : 1 + len(cols)], line], [*cols, "lines"])


def _by_shuffle(docs: DataFrame, text_col: str, filters: DataFrame, hot: DataFrame, shards: int, parts: int, cols: list[str], schema: T.StructType) -> DataFrame:
    """Any number of hot keys: each distinct text's keys meet their shard's
    filter, and its hits the shard's hot keys.  Copies of a text are one before
    they are dealt; adaptive execution splits the join that follows."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({digest(k) for x in _encode(t).split(b"\n") if (k := line_key(x))}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["tid", "keys"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tid = F.concat(F.md5(text), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    asked = docs.select(F.col(f"`{text_col}`").alias("t"), tid.alias("tid")).mapInArrow(keys, "tid string, keys array<binary>")
    asked = _sharded(asked.select("tid", F.explode("keys").alias("key")).distinct(), shards).withColumn("part", F.pmod(F.xxhash64("tid"), F.lit(parts)))
    held = filters.join(_sharded(hot, shards).groupBy("shard").agg(F.collect_list("key").alias("keys")), "shard")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return left.select(["tid", "key"]).slice(0, 0)
        table = CuckooFilter.from_bytes(right.column("filter")[0].as_py())
        left = left.select(["tid", "key"]).filter(pa.array(table.contains(left.column("key").to_pylist())))
        exact = set(right.column("keys")[0].as_py())
        return left.filter(pa.array([k in exact for k in left.column("key").to_pylist()], pa.bool_()))

    hits = asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(probe, "tid string, key binary")
    hits = hits.groupBy(F.col("tid").alias("_tid")).agg(F.collect_list("key").alias("_keys"))
    joined = docs.join(hits, tid == F.col("_tid"), "left").drop("_tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot_of = batch.column(batch.num_columns - 1).to_pylist()
            yield _rows(batch, [_drop(t, frozenset(h or ())) for t, h in zip(batch.column(0).to_pylist(), hot_of)], cols)

    return joined.mapInArrow(run, schema)


def lookup(docs: DataFrame, refs: DataFrame, filters: DataFrame, shards: int, text_col: str = "text", min_docs: int = MIN_DOCS, keep_text: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` with the struct ``lines``: n_lines before dropping,
    n_dropped, and kept, the text without lines whose key is in at least
    ``min_docs`` documents of ``refs``."""
    docs = docs.drop("lines")
    cols = [c for c in docs.columns if keep_text or c != text_col]
    schema = docs.select(*(F.col(f"`{c}`") for c in cols)).schema.add("lines", T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]))
    text = "_text"
    while text in cols:
        text += "_"
    rows = docs.select(F.col(f"`{text_col}`").alias(text), *(F.col(f"`{c}`") for c in cols))
    hot = refs.filter(F.col("refs") >= min_docs).select("key")
    n, total = refs.agg(F.count_if(F.col("refs") >= min_docs), F.sum("refs")).first()
    if n * 40 <= broadcast_bytes:  # 16 bytes a key, some 10 in a filter
        tables = {r["shard"]: bytes(r["filter"]) for r in filters.collect()}
        return _by_broadcast(rows, tables, frozenset(bytes(r["key"]) for r in hot.collect()), shards, cols, schema)
    return _by_shuffle(rows, text, filters, hot, shards, (total or 0) // (shards * PART_KEYS) + 1, cols, schema)


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, keep_text: bool = True, broadcast_bytes: int = BROADCAST_BYTES, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Each row of ``docs`` with the struct ``lines`` (see lookup), after they
    were inserted into an empty state.

    Every row counts as a document.  A null or empty text is one empty line;
    lines of white space only have no key and always stay.  A document whose
    lines all go keeps its row with an empty text.  An empty table stays
    empty; a column named ``lines`` is replaced, others pass unchanged.
    """
    no_refs, no_filters = empty_state(docs.sparkSession)
    refs = cut(insert(no_refs, docs, text_col))
    shards = refs.filter(F.col("refs") >= min_docs).count() // keys_per_shard + 1
    filters = cut(update_filters(no_filters, no_refs, refs, shards, min_docs))
    return lookup(docs, refs, filters, shards, text_col, min_docs, keep_text, broadcast_bytes)
