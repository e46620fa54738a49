"""A Merkle manifest of a table: leaves, subroots by language, root, proofs.

The rank of a row within its language comes from a radix-ranked trie, without
a sort of the table: rows are counted by the digits of their ids, finest
digits first, the counts are added up digit by digit until a language has few
of them, and each count then learns how many rows stand before it from its
parent and its siblings.  Only the rows of one finest count, which share all
digits but the last, are ordered, in their own task.  Ids that repeat go on
with the digits of their leaf, and equal leaves with those of a row number, so
no task orders more than ``BUCKET`` rows.

The digits of a rank in the base of the fanout are the key of its leaf in the
trie of nodes.  Leaves that share all but the last ``levels_of_block`` digits
are reduced in one task, their nodes likewise, until one is left.  Proofs are
built on the way back, from a block's siblings and the path of its parent.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import cut

FANOUT = 2
#: Leaves, or nodes, that are reduced in one task at most.
BLOCK = 1024
#: Hex digits of a key that are counted together, and rows of one count that
#: are ordered in one task.
DIGITS, BUCKET = 2, 4096
#: One in so many ids, by CRC-32, is checked with a tampered row.
TAMPERED = 7
_KEY = 1 + 16 + 16 + 16
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """SHA-256 of the values, each by its length in bytes, a colon and itself;
    ``-`` stands for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _key() -> Column:
    """Hex digits in the order of (id, nulls first; leaf; row number)."""
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    low = F.lit(-(1 << 63)).cast("long")
    number = F.col("doc_id").cast("long")
    return F.concat(F.when(number.isNull(), "0").otherwise("1"), hexed(F.coalesce(number.bitwiseXOR(low), F.lit(0).cast("long"))), F.substring("leaf", 1, 16), hexed(F.col("i")))


def ranked(rows: DataFrame, digits: int = DIGITS, bucket: int = BUCKET) -> DataFrame:
    """Adds ``rank``, from 0 within ``g``, and ``n``, the rows of g, to a
    written table with ``g, doc_id, leaf, i``, i being different in each row."""
    prefix = lambda c, k: F.substring(c, 1, k)
    before = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy("g", *by).orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    longest = 17 - digits
    counts = [cut(rows.groupBy("g", prefix(_key(), longest).alias("at")).agg(F.count("*").alias("n")))]
    lengths = [longest]
    while lengths[-1] > digits and (counts[-1].groupBy("g").count().agg(F.max("count")).first()[0] or 0) > 16**digits:
        lengths.append(lengths[-1] - digits)
        counts.append(cut(counts[-1].groupBy("g", prefix("at", lengths[-1]).alias("at")).agg(F.sum("n").alias("n"))))

    def under(child: DataFrame, parent: DataFrame, length: int) -> DataFrame:
        """Counts with what stands before them: a parent's rows and those of siblings."""
        up = parent.select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.col("before").alias("_before"))
        inside = child.withColumn("_up", prefix("at", length)).withColumn("_inside", before("_up"))
        return inside.join(up, (F.col("g") == F.col("_g")) & (F.col("_up") == F.col("_at"))).select("g", "at", "n", (F.col("_before") + F.col("_inside")).alias("before"))

    placed = counts[-1].withColumn("before", before())
    for child, length in zip(counts[-2::-1], lengths[:0:-1]):
        placed = under(child, placed, length)
    totals = counts[-1].groupBy(F.col("g").alias("_g")).agg(F.sum("n").alias("n"))
    placed, out, length = cut(placed), None, longest
    while True:
        last = length >= _KEY
        own = placed if last else placed.filter(F.col("n") <= bucket)
        own = own.select(F.col("g").alias("_g"), F.col("at").alias("_at"), "before")
        here = rows.withColumn("_k", prefix(_key(), length)).join(own, (F.col("g") == F.col("_g")) & (F.col("_k") == F.col("_at"))).drop("_g", "_at")
        order = W.partitionBy("g", "_k").orderBy(F.col("doc_id").asc_nulls_first(), "leaf", "i")
        here = here.withColumn("rank", F.col("before") + F.row_number().over(order) - 1).drop("_k", "before")
        out = here if out is None else out.unionByName(here)
        hot = placed.filter(F.col("n") > bucket)
        if last or hot.isEmpty():
            return out.join(totals, F.col("g") == F.col("_g")).drop("_g")
        named = hot.select(F.col("g").alias("_g"), F.col("at").alias("_at"))
        rows = rows.withColumn("_k", prefix(_key(), length)).join(named, (F.col("g") == F.col("_g")) & (F.col("_k") == F.col("_at")), "left_semi").drop("_k")
        finer = cut(rows.groupBy("g", prefix(_key(), min(length + digits, _KEY)).alias("at")).agg(F.count("*").alias("n")))
        placed, length = cut(under(finer, hot, length)), min(length + digits, _KEY)


def by_ranges(groups: DataFrame) -> DataFrame:
    """``g`` and its ``rank`` among all, by UTF-8 bytes: ranked within ranges,
    after the counts of the ranges before."""
    ranged = cut(groups.repartitionByRange("g").withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_from").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy(F.col("_range").alias("_from")).agg(F.count("*").alias("_n")).withColumn("_before", before)
    inside = F.row_number().over(W.partitionBy("_range").orderBy("g")) - 1
    return ranged.withColumn("_in", inside).join(starts, F.col("_range") == F.col("_from")).withColumn("rank", F.col("_before") + F.col("_in")).drop("_range", "_in", "_from", "_n", "_before")


def height(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def levels_of_block(fanout: int, block: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= block:
        levels += 1
    return levels


def reduced(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """A block's nodes, level by level from its leaves up."""
    out = [hashes]
    for _ in range(levels):
        last = out[-1]
        out.append([_digest("".join(last[at : at + fanout])) for at in range(0, len(last), fanout)])
    return out


def siblings(nodes: list[list[str]], place: int, fanout: int) -> list[str]:
    """For each level below the top, what stands before and after a leaf's node
    in its run, with a comma between."""
    out = []
    for level in nodes[:-1]:
        first = place // fanout * fanout
        out.append("".join(level[first:place]) + "," + "".join(level[place + 1 : first + fanout]))
        place //= fanout
    return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for run in path:
        left, _, right = run.partition(",")
        leaf = _digest(left + leaf + right)
    return leaf


class _Trie:
    """Blocks of nodes ``g, n, rank, hash`` by longest prefix of their ranks."""

    def __init__(self, fanout: int, block: int) -> None:
        self.fanout, self.levels = fanout, levels_of_block(fanout, block)
        self.width = fanout**self.levels

    def blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.call_function("div", F.col("rank"), F.lit(self.width).cast("long")))

    def _local(self, table: pa.Table, step: int) -> tuple[pa.Table, list[list[str]]]:
        """A block in order of rank, and its nodes."""
        table = table.take(pc.sort_indices(table, [("rank", "ascending")]))
        left = height(table.column("n")[0].as_py(), self.fanout) - step * self.levels
        return table, reduced(table.column("hash").to_pylist(), max(0, min(self.levels, left)), self.fanout)

    def up(self, nodes: DataFrame, step: int) -> DataFrame:
        """The tops of all blocks, as nodes."""

        def top(table: pa.Table) -> pa.Table:
            table, made = self._local(table, step)
            return pa.table({"g": table.column("g")[:1], "n": table.column("n")[:1], "rank": pa.array([table.column("block")[0].as_py()], pa.int64()), "hash": pa.array([made[-1][0]], pa.string())})

        return self.blocks(nodes).groupBy("g", "block").applyInArrow(top, "g string, n long, rank long, hash string")

    def down(self, nodes: DataFrame, tops: DataFrame, step: int, give, schema: str) -> DataFrame:
        """``give(block, paths, top)`` for each block with the row of its top
        among ``tops``, the path of which continues those of its leaves."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            table, made = self._local(left, step)
            rest = right.column("path")[0].as_py()
            paths = [siblings(made, p, self.fanout) + rest for p in range(table.num_rows)]
            return give(table, paths, {c: right.column(c)[0].as_py() for c in right.column_names})

        return self.blocks(nodes).groupBy("g", "block").cogroup(tops.withColumnRenamed("rank", "block").groupBy("g", "block")).applyInArrow(run, schema)

    def climb(self, nodes: DataFrame, most: int) -> list[DataFrame]:
        """The nodes, the tops of their blocks, and so on to one a group."""
        out = [nodes]
        for step in range(-(-height(most, self.fanout) // self.levels)):
            out.append(cut(self.up(out[-1], step)))
        return out

    def descend(self, climbed: list[DataFrame], tops: DataFrame) -> DataFrame:
        """``g, rank, path, subroot, root`` for the first of the climbed tables'
        tops, from those of the last."""

        def give(table: pa.Table, paths: list[list[str]], top: dict) -> pa.Table:
            n = table.num_rows
            return pa.table({"g": table.column("g"), "rank": table.column("rank"), "path": pa.array(paths, pa.list_(pa.string())), "subroot": pa.array([top["subroot"]] * n, pa.string()), "root": pa.array([top["root"]] * n, pa.string())})

        for step in range(len(climbed) - 2, 0, -1):
            tops = cut(self.down(climbed[step], tops, step, give, "g string, rank long, path array<string>, subroot string, root string"))
        return tops


def manifest(docs: DataFrame, id_col: str = "doc_id", tampered: int = TAMPERED, fanout: int = FANOUT, block: int = BLOCK, digits: int = DIGITS, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, lang, rank, leaf, subroot,
    root, proof_sha256, proof, folded_root, verified``.

    Nulls are hashed as ``-`` and a null lang is a group of its own, the first;
    a null id stands before all others and is never tampered with; ids that
    repeat stand in order of their leaves, and equal rows in any, which changes
    nothing; empty and very long texts are hashed whole.  A language of one row
    has that leaf for its subroot; an empty table gives no rows.  proof has the
    siblings of every level, those before and after the own node parted by a
    comma.  Other columns are ignored.
    """
    trie = _Trie(fanout, block)
    id_type = docs.schema[id_col].dataType.simpleString()
    values = {c: F.col(id_col if c == "doc_id" else c) for c in _FIELDS}
    changed = values | {"n_chars": values["n_chars"] + 1}
    hit = F.crc32(values["doc_id"].cast("string")) % tampered == 0
    group = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), "lang"))  # null first
    leaves = cut(docs.select(values["doc_id"].alias("doc_id"), group.alias("g"), leaf_of(*values.values()).alias("leaf"), F.when(hit, leaf_of(*changed.values())).alias("shown"), F.monotonically_increasing_id().alias("i")))
    nodes = cut(ranked(leaves, digits, bucket).select("doc_id", "g", "n", "rank", F.col("leaf").alias("hash"), "shown"))
    most = nodes.agg(F.max("n")).first()[0]
    climbed = trie.climb(nodes, most or 0)

    subroots = by_ranges(climbed[-1].select("g", F.col("hash").alias("h")))
    groups = subroots.agg(F.count("*")).first()[0]
    heads = cut(subroots.select(F.lit("").alias("g"), F.lit(groups).cast("long").alias("n"), "rank", F.col("h").alias("hash"), F.col("g").alias("name")))
    above = trie.climb(heads, groups)
    root = above[-1] if len(above) > 1 else heads
    whole = root.select("g", "rank", F.expr("cast(array() as array<string>)").alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))

    def to_subroots(table: pa.Table, paths: list[list[str]], top: dict) -> pa.Table:
        n = table.num_rows
        return pa.table({"g": table.column("name"), "rank": pa.array([0] * n, pa.int64()), "path": pa.array(paths, pa.list_(pa.string())), "subroot": table.column("hash"), "root": pa.array([top["root"]] * n, pa.string())})

    tops = cut(trie.down(heads, trie.descend(above, whole), 0, to_subroots, "g string, rank long, path array<string>, subroot string, root string"))

    def proofs(table: pa.Table, paths: list[list[str]], top: dict) -> pa.Table:
        n, leaf = table.num_rows, table.column("hash").to_pylist()
        shown = [s or h for s, h in zip(table.column("shown").to_pylist(), leaf)]
        back = [folded(s, p) for s, p in zip(shown, paths)]
        proof = [_digest("".join(p).replace(",", "")) for p in paths]
        lang = table.column("g")[0].as_py()
        columns = [table.column("doc_id"), pa.array([None if lang == "-" else lang[1:]] * n, pa.string()), table.column("rank"), table.column("hash"), pa.array([top["subroot"]] * n, pa.string()), pa.array([top["root"]] * n, pa.string())]
        columns += [pa.array(proof, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(back, pa.string()), pa.array([b == top["root"] for b in back], pa.bool_())]
        return pa.table(columns, ["doc_id", "lang", "rank", "leaf", "subroot", "root", "proof_sha256", "proof", "folded_root", "verified"])

    schema = f"doc_id {id_type}, lang string, rank long, leaf string, subroot string, root string, proof_sha256 string, proof array<string>, folded_root string, verified boolean"
    return trie.down(nodes, trie.descend(climbed, tops), 0, proofs, schema)
