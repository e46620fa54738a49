"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Each tree hashes every vector to a string of BITS signs of random
projections; a tree is its strings in sorted order, so all rows that share a
prefix are adjacent.  A query descends to its longest match and then ascends
in all trees at the same pace: the depth is lowered, by one everywhere, until
the rows that share a prefix of that depth with it, over all trees, number
``candidates``; at depth 0 that is every row.  Those rows are scored exactly.

``candidates`` is fitted: for a bounded sample of queries the true neighbours
are found by scoring all rows, and the budget is the least one that reaches
``recall`` of them.  It is never below (k + 2) rows a tree, so by counting some
tree alone gives a query k + 2 different entries: no query gets fewer than k
rows unless there are fewer.

Inner products are brought to angles by one more coordinate, which lifts a row
to the bound of its norm class and is zero for queries.  Classes are powers of
two of the largest norm; those of at most ``FEW`` entries are candidates of
every query, so that a few very long vectors neither hide nor flatten the rest.

Rows with the same vector are one entry of the index.  Entries are dealt by a
hash into blocks, each of which holds its share of every tree over one copy of
its vectors; a query's depth follows from its counts summed over blocks.  Both
entries and queries of a group are bounded, whatever prefix they share, and
only each query's best rows leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import cut

BITS, TREES = 32, 48
K = 20
#: Recall that the budget of candidates is fitted to, and the queries it is
#: fitted on (a bounded sample; every row is indexed and every query answered).
RECALL, FIT_QUERIES = 0.95, 128
#: Entries, and queries, of one group; small tables make some groups more.
GROUP_ROWS, LEAST_ROWS, LEAST_GROUPS = 1 << 16, 2048, 16
#: Norm classes, and entries of a class that every query looks at.
CLASSES, FEW = 16, 256


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees * bits, dim + 1)).astype(np.float32)


def strings(x: np.ndarray, planes_: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(row, tree): the first bit of a string is the highest."""
    signs = (x @ planes_.T > 0).reshape(len(x), trees, bits)
    return (signs * (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))).sum(axis=2, dtype=np.uint32)


def shared_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the longest common prefix."""
    x = (a ^ b).astype(np.float64)
    return bits - np.frexp(x)[1]


def valid(vector: Column) -> Column:
    """Has no null or non-finite component and is not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """``vector, ids``: distinct vectors with their k + 1 least ids, as many as
    any query can need (it leaves out its own).  Copies are cut to these before
    they are shuffled (a limit by group), so a vector of many rows is no load."""
    rank = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    least = vectors.withColumn("_r", rank).filter(F.col("_r") <= k + 1)
    return least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _hashes(column: pa.Array | pa.ChunkedArray, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, trees)


def _hashed(rows: DataFrame, col: str, dim: int, top: float | None, trees: int, bits: int) -> DataFrame:
    """Adds ``hashes``, the strings of all trees, and ``norm_class``; ``top``:
    the largest norm, for index entries, None for queries."""
    matrix = planes(dim, trees, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(col)
        for batch in batches:
            x = _matrix(batch.column(at), dim)
            scale = np.abs(x).max(axis=1, keepdims=True)  # no overflow at either end
            norm = np.linalg.norm(x / scale, axis=1) * scale[:, 0]
            if top is None:
                kind, lifted = np.zeros(len(x), np.int32), np.column_stack((x / scale, np.zeros(len(x))))
            else:
                kind = np.clip(np.floor(np.log2(top) - np.log2(norm)), 0, CLASSES - 1).astype(np.int32)
                bound = top * 0.5**kind
                lifted = np.column_stack((x / bound[:, None], np.sqrt(np.maximum(1 - (norm / bound) ** 2, 0))))
            h = strings(lifted.astype(np.float32), matrix, trees, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind), pa.array([r.tobytes() for r in h], pa.binary())], [*names, "norm_class", "hashes"])

    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", norm_class int, hashes binary"
    return rows.mapInArrow(run, schema)


class Forest:
    """The trees over a block's entries."""

    def __init__(self, hashes: np.ndarray, always: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(hashes)
        self.always = np.flatnonzero(always)
        rest = np.flatnonzero(~always)
        self.order = [rest[np.argsort(h[rest], kind="stable")] for h in hashes.T]
        self.sorted = [h[o].astype(np.uint64) for h, o in zip(hashes.T, self.order)]

    def ranges(self, tree: int, q: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows are that share ``depth`` bits with each string."""
        step = np.uint64(1) << (np.uint64(self.bits) - np.asarray(depth, np.uint64))
        low = q.astype(np.uint64) & ~(step - np.uint64(1))
        return np.searchsorted(self.sorted[tree], low), np.searchsorted(self.sorted[tree], low + step)

    def counts(self, q: np.ndarray) -> np.ndarray:
        """(query, depth): rows over all trees that share 0..bits first bits."""
        out = np.zeros((len(q), self.bits + 1), np.int64)
        for tree in range(len(self.sorted)):
            for d in range(self.bits + 1):
                lo, hi = self.ranges(tree, q[:, tree], d)
                out[:, d] += hi - lo
        return out

    def candidates(self, q: np.ndarray, depth: np.ndarray) -> Iterator[np.ndarray]:
        """The different rows that each query meets at its depth."""
        spans = [self.ranges(tree, q[:, tree], depth) for tree in range(len(self.sorted))]
        seen = np.zeros(self.n, bool)
        for i in range(len(q)):
            seen[:] = False
            seen[self.always] = True
            for order, (lo, hi) in zip(self.order, spans):
                seen[order[lo[i] : hi[i]]] = True
            yield np.flatnonzero(seen)


def _best(x: np.ndarray, q: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with the ``keep`` largest inner products and all that tie with
    the last, and the products, added up in the same order for every row."""
    some = x[rows]
    s = some @ q
    if len(s) > keep:
        least = np.partition(s, len(s) - keep)[len(s) - keep]
        near = s >= least - 1e-9 * max(1.0, abs(least))
        rows, some = rows[near], some[near]
    return rows, (some * q).sum(axis=1)


def _fit(entries: DataFrame, asking: DataFrame, counted: DataFrame, few: list[int], dim: int, k: int, trees: int, bits: int, recall: float) -> int:
    """The least budget that finds ``recall`` of the sample's true neighbours.

    A neighbour is met once the depth falls to the most bits it shares with
    the query in any tree; the budget must exceed the rows met one deeper."""
    sample = asking.orderBy(F.xxhash64("query_id"), "query_id").limit(FIT_QUERIES).collect()
    asks = [r["query_id"] for r in sample]
    q = np.array([r["q"] for r in sample], np.float64)
    qh = np.frombuffer(b"".join(bytes(r["hashes"]) for r in sample), np.uint32).reshape(-1, trees)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, h = _matrix(batch.column(0), dim), _hashes(batch.column(2), trees)
            ids, kind = batch.column(1).to_pylist(), batch.column(3).to_numpy()
            out: list[tuple[int, int, float, int]] = []
            for i, ask in enumerate(asks):
                rows, s = _best(x, q[i], np.arange(len(x)), k + 1)
                depth = np.where(np.isin(kind[rows], few), bits, shared_bits(h[rows], qh[i], bits).max(axis=1))
                out += [(ask, v, float(a), int(d)) for r, a, d in zip(rows, s, depth) for v in ids[r] if v != ask]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))], ["query_id", "vec_id", "score", "depth"])

    found = entries.select("vector", "ids", "hashes", "norm_class").mapInArrow(exact, "query_id long, vec_id long, score double, depth int")
    at = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("_at", at).filter(F.col("_at") <= k).select("query_id", "depth")
    rows = true.join(counted, "query_id").select("depth", F.array(*(f"c{d}" for d in range(bits + 1))).alias("c")).collect()
    need = sorted(r["c"][r["depth"] + 1] + 1 if r["depth"] < bits else 0 for r in rows)
    return need[int(np.ceil(recall * len(need))) - 1] if need else 0


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, trees: int = TREES, bits: int = BITS, candidates: int | None = None, recall: float = RECALL, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` is
    true, the k rows found with the largest inner product (fewer if there are
    fewer), itself left out, ties to the smaller id.  ``candidates`` sets the
    budget (see above) instead of fitting it to ``recall``.

    Null and zero vectors, and those with a null or non-finite component or of
    another length than most, neither ask nor answer; rows with a null id are
    left out; of rows that repeat an id the least vector stands.  Copies of a
    vector answer by smallest id.  An empty table gives no rows; other columns
    are ignored.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # half the bytes to move, and as exact
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & valid(F.col("vector"))).withColumn("dim", F.size("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda a, v: F.call_function("hypot", a, v.cast("double")))
    shape = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(length).alias("top")).orderBy(F.desc("n"), "dim").first()
    spark = vectors.sparkSession
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, top = shape["dim"], shape["n"], shape["top"] * (1 + 1e-12)
    rows = cut(rows.filter(F.col("dim") == dim).groupBy("id").agg(F.min("vector").alias("vector"), F.bool_or("asks").alias("asks")))
    entries = cut(_hashed(_entries(rows.drop("asks"), k), "vector", dim, top, trees, bits))
    asking = cut(_hashed(rows.filter("asks").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "q", dim, None, trees, bits).drop("norm_class"))
    few = [r["norm_class"] for r in entries.groupBy("norm_class").count().collect() if r["count"] <= FEW]

    blocks = max(n // group_rows + 1, min(LEAST_GROUPS, n // LEAST_ROWS + 1))
    chunks = asking.count() // group_rows + 1
    block, chunk = F.pmod(F.xxhash64("vector"), F.lit(blocks)), F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))

    def held(*columns: str) -> DataFrame:
        return entries.select(*columns, F.col("norm_class").isin(few).alias("always"), block.alias("block")).withColumn("chunk", every(chunks)).groupBy("block", "chunk")

    def sent(df: DataFrame) -> DataFrame:
        return df.withColumn("chunk", chunk).withColumn("block", every(blocks)).groupBy("block", "chunk")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        forest = Forest(_hashes(left.column("hashes"), trees), left.column("always").to_numpy(), bits)
        c = forest.counts(_hashes(right.column("hashes"), trees))
        return pa.table({"query_id": right.column("query_id"), **{f"c{d}": pa.array(c[:, d]) for d in range(bits + 1)}})

    depths = "query_id long, " + ", ".join(f"c{d} long" for d in range(bits + 1))
    counted = held("hashes").cogroup(sent(asking.select("query_id", "hashes"))).applyInArrow(count, depths)
    counted = cut(counted.groupBy("query_id").agg(*(F.sum(f"c{d}").alias(f"c{d}") for d in range(bits + 1))))
    if candidates is None:
        candidates = _fit(entries, asking, counted, few, dim, k, trees, bits, recall)
    candidates = max(candidates, (k + 2) * trees)
    depth = F.lit(0)
    for d in range(1, bits + 1):
        depth = F.when(F.col(f"c{d}") >= candidates, d).otherwise(depth)
    chosen = counted.select("query_id", depth.alias("depth"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        forest = Forest(_hashes(left.column("hashes"), trees), left.column("always").to_numpy(), bits)
        x, q = _matrix(left.column("vector"), dim), _matrix(right.column("q"), dim)
        ids, asks = left.column("ids").to_pylist(), right.column("query_id").to_pylist()
        out: list[tuple[int, int, float]] = []
        for i, met in enumerate(forest.candidates(_hashes(right.column("hashes"), trees), right.column("depth").to_numpy())):
            best = sorted((-float(s), v) for r, s in zip(*_best(x, q[i], met, k + 1)) for v in ids[r] if v != asks[i])
            out += [(asks[i], v, -m) for m, v in best[:k]]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = held("vector", "ids", "hashes").cogroup(sent(asking.join(chosen, "query_id"))).applyInArrow(score, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
