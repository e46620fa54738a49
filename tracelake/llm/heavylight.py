"""A size-aware heavy-light join of shingle sets by Jaccard similarity.

Sets come with the first of their shingles in an order common to all, common
shingles last.  Two sets that reach the similarity share one shingle at least
of their prefixes, and two of prefixes that are one longer, so

* a heavy set scans the inverted lists of its prefix, which hold all sets that
  are not too small for it;
* light sets enumerate the pairs of shingles of the longer prefix, and meet
  where they have a pair in common.

Shingles that only one set has are left out of both.  The boundary between
light and heavy is the size at which the cost of both is least: rows that are
shuffled, and sets that are compared within lists, by classes of sizes; for
pairs the lists' lengths come from a sample of the pairs.  It decides how a
link is found, never whether.

Lists longer than ``HOT`` are not searched at once.  Their sets are indexed
again among themselves, by the exact numbers of sets that share a shingle,
rarest first; lists that are still longer then are dealt in cells of that size.
Sets are compared by size, place and a parity signature, whose differing bits
never exceed the sets' differing shingles; what that leaves is verified.  In a
list of many sets each is paired with its closest first; only sets that are
not linked after that are compared once more.  The signature tells large sets
little, as about half of its bits differ whatever they share; a large set has a
longer one besides, which every pair of two large sets has to pass once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, drop

#: Sets of a list, or of a cell's side, that are searched together; sets of a
#: list from which on the closest come first; how many those are.
HOT, MANY, CLOSEST = 1024, 16, 2
#: Longs of a signature, and of a large set's longer one at most.
SIGNATURE, LONGEST = 8, 1024
#: Rows of one key that are counted; it has that many or more, then.
OFTEN = 1 << 20
#: For the boundary: what a comparison costs, in rows; the share of pairs that
#: is counted; the ratio of two classes of sizes; pairs of a set that is light.
COMPARED, SAMPLED, CLASS, PAIRS = 0.02, 64, 1.25, 2048
_SMALL = 12
SIGNATURES = [f"s{i}" for i in range(SIGNATURE)]


def parities(values: np.ndarray, longs: int = SIGNATURE) -> np.ndarray:
    """For each of 64 * longs classes of shingles whether a set has an odd
    number of them, as longs.  Two sets' signatures differ in no more bits than
    the sets differ in shingles."""
    odd = np.bincount((values.view(np.uint64) >> np.uint64(17)) % np.uint64(64 * longs), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def long_parities(values: np.ndarray) -> bytes | None:
    """A large set's signature of as many classes as it has shingles, up to the
    next power of two and no more than 64 * LONGEST; none for other sets."""
    if len(values) <= 64 * SIGNATURE:
        return None
    return parities(values, min(LONGEST, 1 << int(len(values) - 1).bit_length() - 6)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two long signatures differ, the longer one folded to the
    classes of the other."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    m = min(len(x), len(y))
    x, y = (v if len(v) == m else np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def prefix_length(n: int | np.ndarray, share: float) -> int | np.ndarray:
    """Shingles of n, first in the common order, of which one at least is in
    every set that holds ``share`` of them."""
    return n - np.ceil(share * n - 1e-9).astype(np.int64) + 1


def frequencies(entries: DataFrame) -> DataFrame:
    """``key, node, n, at`` with ``m``, the nodes of the key, without keys of
    one node.  Rows of a key stream by in order; no more than OFTEN are held."""
    columns = ["key", "node", "n", "at"]

    def give(rows: list[np.ndarray], m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(m.astype(np.int64))], [*columns, "m"])

    def counted(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1], [True])))
        m = np.repeat(np.diff(edges), np.diff(edges))
        if (m > 1).any():
            yield give([c[m > 1] for c in rows], m[m > 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        passing = None  # a key of OFTEN nodes or more
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy() for k in range(4)]
            if passing is not None:
                n = int(np.searchsorted(rows[0], passing, "right"))
                if n:
                    yield give([c[:n] for c in rows], np.full(n, OFTEN))
                    rows = [c[n:] for c in rows]
                if not len(rows[0]):
                    continue
                passing = None
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows)]
            start = int(np.searchsorted(rows[0], rows[0][-1]))
            if start:
                yield from counted([c[:start] for c in rows])
            held = [c[start:] for c in rows]
            if len(held[0]) >= OFTEN:
                yield give(held, np.full(len(held[0]), OFTEN))
                passing, held = held[0][0], None
        if held is not None:
            yield from counted(held)

    return entries.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long, n int, at int, m long")


def _indexed(shared: DataFrame, singles: DataFrame) -> DataFrame:
    """``node, n, at, keys, ms, s0...``: the shared shingles of each node's
    longer prefix in their order."""
    listed = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "key", "m"))).alias("e"))
    flat = listed.select(F.col("node").alias("_n"), *(F.col(f"e.{c}").alias(f"{c}s") for c in ("at", "key", "m")))
    return cut(flat.join(singles.select("node", "n", *SIGNATURES), F.col("_n") == F.col("node")).drop("_n"))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def size_class(n: int | np.ndarray) -> int | np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS) + 1e-9).astype(np.int64)


def boundary(index: DataFrame, similarity: float) -> int:
    """The size up to which sets are light: that of the least cost.  The driver
    gets one row for each class of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, cls, enum, rows, scan = [], [], [], [], []
            for n, ats, keys, ms in zip(*(batch.column(k).to_pylist() for k in range(4))):
                first = int(prefix_length(np.int64(n), similarity))
                inside = int(np.searchsorted(np.array(ats), first))
                r, c = len(keys), int(size_class(np.int64(n)))
                key.append(None), cls.append(c), enum.append(r * (r - 1) // 2), rows.append(inside), scan.append(sum(ms[:inside]))
                if r * (r - 1) // 2 <= PAIRS:
                    i, j = np.triu_indices(r, 1)
                    k = np.array(keys, np.int64)
                    pairs = _pair_key(k[i], k[j])
                    for p in pairs[pairs.view(np.uint64) % np.uint64(SAMPLED) == 0].tolist():
                        key.append(p), cls.append(c), enum.append(0), rows.append(0), scan.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(cls, pa.int32()), *(pa.array(x, pa.int64()) for x in (enum, rows, scan))], ["key", "cls", "enum", "rows", "scan"])

    by = index.select("n", "ats", "keys", "ms").mapInArrow(run, "key long, cls int, enum long, rows long, scan long")
    by = cut(by.groupBy("key", "cls").agg(F.count("*").alias("k"), *(F.sum(c).alias(c) for c in ("enum", "rows", "scan"))))
    met = by.filter("key is not null")
    lists = met.groupBy("key").agg(F.sum("k").alias("all"))
    light = {r[0]: SAMPLED * r[1] for r in met.join(lists, "key").groupBy("cls").agg(F.sum(F.col("k") * F.col("all"))).collect()}
    cost = {r.cls: (r.enum + COMPARED * light.get(r.cls, 0), r.rows + COMPARED * r.scan) for r in by.filter("key is null").collect()}
    # no class whose sets may have more than PAIRS pairs is light
    last = next(c for c in range(1000) if (k := int(prefix_length(np.ceil(CLASS ** (c + 1)).astype(np.int64), similarity)) + 1) * (k - 1) // 2 > PAIRS)
    ends = [-1, *(c for c in sorted(cost) if c < last)]
    best = min(ends, key=lambda c: (sum(x for k, (x, _) in cost.items() if k <= c) + sum(y for k, (_, y) in cost.items() if k > c), c))
    # sizes of that class and below
    return 0 if best < 0 else int(np.ceil(CLASS ** (best + 1) - 1e-6)) - 1


def _lists(index: DataFrame, labels: DataFrame, light: int, similarity: float) -> DataFrame:
    """``single, key, m, node, n, at, label, s0...``: members of the inverted
    lists that heavy sets scan, and of the pairs of light ones; m bounds the
    members of a list."""
    named = index.join(labels.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n"), "left").drop("_n").withColumn("label", F.coalesce("label", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, label = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("node", "n", "label"))
            bits = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in SIGNATURES], axis=1)
            ats, keys, ms = (batch.column(batch.schema.get_field_index(c)) for c in ("ats", "keys", "ms"))
            parts, size = [], 0
            for k in range(batch.num_rows):
                at, key, m = (c[k].values.to_numpy() for c in (ats, keys, ms))
                if n[k] >= similarity * (light + 1) - 1e-9:  # may meet a heavy set
                    inside = at < prefix_length(n[k], similarity)
                    parts.append((np.full(inside.sum(), k), np.full(inside.sum(), True), key[inside], m[inside], at[inside]))
                if n[k] <= light:
                    i, j = np.triu_indices(len(key), 1)
                    parts.append((np.full(len(i), k), np.full(len(i), False), _pair_key(key[i], key[j]), np.minimum(m[i], m[j]), at[i]))
                size += len(parts[-1][0])
                if size > 20_000 or k == batch.num_rows - 1:
                    row, single, key, m, at = map(np.concatenate, zip(*parts))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (single, key, m.astype(np.int64), node[row], n[row], at.astype(np.int32), label[row])), *map(pa.array, bits[row].T)], ["single", "key", "m", "node", "n", "at", "label", *SIGNATURES])
                    parts, size = [], 0

    return named.mapInArrow(run, "single boolean, key long, m long, node long, n int, at int, label long, " + ", ".join(f"{s} long" for s in SIGNATURES))


def _dealt(lists: DataFrame, hot: int) -> DataFrame:
    """Adds ``i, j, part``: a long list is dealt in parts; any two of them meet
    in a cell, where only members of different parts are compared, and each
    meets itself in one."""
    parts = F.ceil(F.col("m") / hot).cast("int")
    part = F.pmod(F.xxhash64("node", "key"), parts.cast("long")).cast("int")
    rows = lists.withColumn("part", F.when(F.col("m") > hot, part).otherwise(0)).withColumn("_x", F.explode(F.sequence(F.lit(0), F.when(F.col("m") > hot, parts - 1).otherwise(0))))
    return rows.withColumn("i", F.least("part", "_x")).withColumn("j", F.greatest("part", "_x")).drop("_x", "m")


class Search:
    """Compares the members of lists."""

    def __init__(self, light: int, similarity: float, many: int, closest: int | None) -> None:
        self.light, self.s, self.many, self.closest = light, similarity, many, closest

    def _fit(self, r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether size, place and label leave room for a link."""
        s, a, b = self.s, r["n"][i].astype(np.int64), r["n"][j].astype(np.int64)
        room = np.minimum(a - r["at"][i], b - r["at"][j])
        ok = (r["label"][i] != r["label"][j]) & (np.minimum(a, b) >= s * np.maximum(a, b) - 1e-9) & (room >= s / (1 + s) * (a + b) - 1e-9)
        ok &= ~r["single"][i] | (np.maximum(a, b) > self.light)
        return ok & ((r["part"][i] != r["part"][j]) | (r["i"][i] == r["j"][i]))

    def _near(self, r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which signatures allow one, and how far apart they are for their size."""
        both = r["n"][i].astype(np.int64) + r["n"][j]
        differ = np.bitwise_count(r["bits"][i] ^ r["bits"][j]).sum(axis=1, dtype=np.int64)
        return differ <= both * (1 - self.s) / (1 + self.s) + 1e-6, differ / both

    def list_pairs(self, r: dict[str, np.ndarray], start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one list's rows."""
        of, left, right = np.arange(start, stop), [], []
        if (r["label"][of] == r["label"][start]).all():
            return of[:0], of[:0]
        few = self.closest is not None and len(of) > self.many
        for at in range(0, len(of), 64):
            mine = of[at : at + 64]
            i, j = np.repeat(mine, len(of)), np.tile(of, len(mine))
            # all for the closest of each; each pair once else
            ok = np.flatnonzero(self._fit(r, i, j) & ((i != j) if few else (i < j)))
            i, j = i[ok], j[ok]
            near, how = self._near(r, i, j)
            i, j, how = i[near], j[near], how[near]
            if few and len(i):
                order = np.lexsort((how, i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.repeat(np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))), np.diff(np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True])))))
                i, j = i[rank < self.closest], j[rank < self.closest]
            left.append(i)
            right.append(j)
        return np.concatenate(left), np.concatenate(right)

    def pairs(self, r: dict[str, np.ndarray], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows within the lists that begin at the edges."""
        sizes, left, right = np.diff(edges), [], []
        small = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
        name = np.repeat(np.arange(len(sizes)), sizes)
        for d in range(1, _SMALL):
            i, j = small[: len(small) - d], small[d:]
            same = name[i] == name[j]
            i, j = i[same], j[same]
            if not len(i):
                break
            ok = self._fit(r, i, j)
            i, j = i[ok], j[ok]
            ok = self._near(r, i, j)[0]
            left.append(i[ok])
            right.append(j[ok])
        for k in np.flatnonzero(sizes > _SMALL):
            i, j = self.list_pairs(r, int(edges[k]), int(edges[k + 1]))
            left.append(i)
            right.append(j)
        none = np.empty(0, np.int64)
        i, j = (np.concatenate(x) if x else none for x in (left, right))
        a, b = r["node"][i], r["node"][j]
        found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return found[:, 0], found[:, 1]


def _found(lists: DataFrame, search: Search) -> DataFrame:
    """``a, b``: pairs that may be links.  Lists stream by in order; a task
    holds one, or one cell, and a batch."""
    place = ["single", "key", "i", "j"]
    columns = [*place, "part", "node", "n", "at", "label"]

    def whole(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Searches the lists that have ended; returns the rows that are left."""
        r = {c: table.column(c).to_numpy() for c in columns}
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in place:
            new[1:] |= r[c][1:] != r[c][:-1]
        edges = np.append(np.flatnonzero(new), len(new))
        stop = len(new) if last or not len(new) else int(edges[-2])
        if stop:
            r = {c: v[:stop] for c, v in r.items()}
            r["bits"] = np.stack([table.column(s).to_numpy()[:stop] for s in SIGNATURES], axis=1).view(np.uint64)
            a, b = search.pairs(r, edges[: np.searchsorted(edges, stop) + 1])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        return table.slice(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = yield from whole(table if held is None else pa.concat_tables([held, table]), False)
        if held is not None:
            yield from whole(held, True)

    return lists.select(*columns, *SIGNATURES).repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long").distinct()


def _screened(pairs: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (``a, b``) without those of two large sets (``node, n, long``)
    whose long signatures leave no room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [x is None or y is None or differing(x, y) <= (m + n) * (1 - similarity) / (1 + similarity) + 1e-6 for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: large.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("long").alias(f"long_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select("a", "b", "n_a", "n_b", "long_a", "long_b").mapInArrow(run, "a long, b long")


def join(singles: DataFrame, whole: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], connect: Callable[[DataFrame], DataFrame], linked: DataFrame | None = None, similarity: float = 0.8, hot: int = HOT, many: int = MANY, closest: int = CLOSEST, light: int | None = None) -> DataFrame:
    """``a, b``: links that, with those of ``linked``, connect all sets of at
    least this similarity.

    ``singles`` has a row for each set: ``node, n, prefix, long, s0...``, the
    name, the size, the longer prefix (one more than ``prefix_length``) and the
    signatures, the long one (``long_parities``) of large sets only.  ``whole`` gives ``node, set`` for some nodes, ``verify`` keeps
    the pairs that reach the similarity, ``connect`` labels what links connect.
    ``light`` sets the boundary instead of the cost.
    """
    entries = singles.filter("n > 1").select("node", "n", F.posexplode("prefix").alias("at", "key"))
    index = _indexed(frequencies(entries), singles)
    large = cut(singles.filter("long is not null").select("node", "n", "long"))
    bound = boundary(index, similarity) if light is None else light
    none = singles.select(F.col("node"), F.col("node").alias("label")).limit(0)
    labels = cut(connect(linked)) if linked is not None else none
    lists = cut(_lists(index, labels, bound, similarity))
    found = [_found(_dealt(lists.filter(F.col("m") <= hot), hot), Search(bound, similarity, many, closest))]

    # sets of long lists once more, by exact numbers
    far = cut(lists.filter(F.col("m") > hot).select("node").distinct())
    again = None
    if not far.isEmpty():
        sets = cut(whole(far))
        every = sets.select("node", F.size("set").alias("n"), F.lit(0).alias("at"), F.explode("set").alias("key"))
        ordered = frequencies(every).groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("m", "key"))).alias("e"))
        ordered = ordered.withColumn("lone", F.col("n") - F.size("e"))  # shingles of no other set come first
        least = F.ceil(F.col("n") * similarity - 1e-9)
        ordered = ordered.select("node", "n", "lone", F.posexplode(F.slice("e", 1, F.greatest(F.lit(0), F.col("n") - least + 2 - F.col("lone")).cast("int"))).alias("k", "x"))
        shared = ordered.select(F.col("x.key").alias("key"), "node", "n", (F.col("lone") + F.col("k")).cast("int").alias("at"), "x.m")
        again = _indexed(shared, singles)
        drop(sets)
        bound_again = boundary(again, similarity) if light is None else light
        found.append(_found(_dealt(_lists(again, labels, bound_again, similarity), hot), Search(bound_again, similarity, many, closest)))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()
    first = verify(_screened(pairs, large, similarity))
    so_far = first if linked is None else first.unionByName(linked)

    # of lists of many only the closest have been compared
    labels = cut(connect(so_far))
    rest = lists.filter((F.col("m") > _SMALL) & (F.col("m") > many) & (F.col("m") <= hot)).drop("label")
    rest = rest.join(labels.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n"), "left").drop("_n").withColumn("label", F.coalesce("label", "node"))
    found = [_found(_dealt(rest, hot), Search(bound, similarity, many, None))]
    if again is not None:
        found.append(_found(_dealt(_lists(again, labels, bound_again, similarity).filter((F.col("m") > _SMALL) & (F.col("m") > many)), hot), Search(bound_again, similarity, many, None)))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()
    out = first.unionByName(verify(_screened(pairs, large, similarity)))
    drop(index, large, lists, far, labels, *([again] if again is not None else []))
    return out
