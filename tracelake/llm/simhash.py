"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  If two fingerprints
differ in at most three bits, one of the segments differs in at most one, so
both fingerprints share an index entry: the segment itself, or the segment
with the differing bit wild.  Entries meet in an equality shuffle and every
candidate is verified on the whole fingerprint.

Exact copies are one index row (a distinct fingerprint).  A bucket with many
different fingerprints is not expanded into pairs: it is searched breadth
first and yields one link per fingerprint reached.  A bucket beyond
``HOT_BUCKET`` rows is sent on, indexed again by the variants of its other
segment's halves; as at least 46 of the 64 bits are then fixed, no such bucket
can hold more than 2^18 fingerprints, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracelake.llm import heavylight
from tracelake.llm.common import cut, drop
from tracelake.llm.heavylight import SIGNATURE, SIGNATURES, long_parities, parities, prefix_length

HOT_BUCKET = 2048
#: Edges of a graph that one task may hold: 16 MB.
LOCAL_EDGES = 1 << 20
_PAIRWISE = 12


def document_fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of one text (unsigned)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 65536):  # very long texts in parts
        part = values[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed long) for every row; a null or wordless text has 0."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([document_fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: 2 segments, each whole (wild = 32) and with each bit wild."""
    one = F.lit(1).cast("long")
    out = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("v"))
    wild = (F.col("v") % 33).cast("int")
    segment = F.when(F.col("v") < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    mask = F.when(wild < 32, F.bitwise_not(F.call_function("shiftleft", one, wild))).otherwise(F.lit(-1).cast("long"))
    return out.select((F.call_function("shiftleft", F.col("v").cast("long"), F.lit(32))).bitwiseOR(segment.bitwiseAND(mask)).alias("key"), "fp")


def _refined(hot: DataFrame) -> DataFrame:
    """The variants of the other segment's two 16-bit halves, within a bucket."""
    one = F.lit(1).cast("long")
    out = hot.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("v"))
    wild = (F.col("v") % 17).cast("int")
    other = F.when(F.shiftright("key", 32) < 33, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    half = F.when(F.col("v") < 17, F.shiftrightunsigned(other, 16)).otherwise(other.bitwiseAND(F.lit(0xFFFF)))
    mask = F.when(wild < 16, F.bitwise_not(F.call_function("shiftleft", one, wild))).otherwise(F.lit(-1).cast("long"))
    # the first key takes 39 bits; with 6 for the variant and 16 for the half, 61
    sub = F.call_function("shiftleft", F.col("key"), F.lit(22)).bitwiseOR(F.call_function("shiftleft", F.col("v").cast("long"), F.lit(16))).bitwiseOR(half.bitwiseAND(mask))
    return out.select(sub.alias("key"), "fp")


def bucket_links(fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket: breadth first, each
    fingerprint compared with those not reached yet."""
    left, a, b = fp.copy(), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_distance
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    none = np.empty(0, fp.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _split_sides(key: np.ndarray, fp: np.ndarray, refined: bool) -> bool:
    """Whether a bucket can hold a link that no other bucket has: one with a
    wild bit needs fingerprints with either value of that bit."""
    if refined:
        return True
    v = int(key) >> 32
    if v % 33 == 32:
        return True
    bit = (fp >> np.uint64(v % 33 + (32 if v < 33 else 0))) & np.uint64(1)
    return bool(bit.any() and not bit.all())


def _links_of(key: np.ndarray, fp: np.ndarray, max_distance: int, refined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key; buckets are whole."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(edge)
    a, b = [], []
    keep = np.repeat((sizes > 1) & (sizes <= _PAIRWISE), sizes)
    k, f = key[keep], fp[keep]
    for d in range(1, min(_PAIRWISE, int(sizes.max(initial=1)))):
        i = np.flatnonzero(k[d:] == k[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= max_distance]
        a.append(f[i])
        b.append(f[i + d])
    for g in np.flatnonzero(sizes > _PAIRWISE):
        rows = fp[edge[g] : edge[g + 1]]
        if _split_sides(key[edge[g]], rows, refined):
            x, y = bucket_links(rows, max_distance)
            a.append(x)
            b.append(y)
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _verify(index: DataFrame, max_distance: int, refined: bool, hot_bucket: int) -> DataFrame:
    """``hot, a, b``: links (a, b), and rows (key, fp) of buckets passed on."""

    def rows(hot: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["hot", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last bucket may go on in the next batch
        streaming = None  # key of a bucket that is being passed on
        for batch in batches:
            key, fp = (batch.column(i).to_numpy() for i in (0, 1))
            fp = fp.view(np.uint64)
            if streaming is not None:
                n = int(np.searchsorted(key, streaming, "right"))
                if n:
                    yield rows(True, key[:n], fp[:n])
                    key, fp = key[n:], fp[n:]
                if len(key):
                    streaming = None
            if not len(key):
                continue
            held.append((key, fp))
            key, fp = (np.concatenate(x) for x in zip(*held))
            start = int(np.searchsorted(key, key[-1]))
            if start:
                yield from whole(key[:start], fp[:start])
            key, fp = key[start:], fp[start:]
            if not refined and len(key) > hot_bucket:
                streaming, held = key[-1], []
                yield rows(True, key, fp)
            else:
                held = [(key, fp)]
        if held:
            yield from whole(*(np.concatenate(x) for x in zip(*held)))

    def whole(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not refined:
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            hot = np.repeat(np.diff(edge) > hot_bucket, np.diff(edge))
            if hot.any():
                yield rows(True, key[hot], fp[hot])
                key, fp = key[~hot], fp[~hot]
        if len(key):
            a, b = _links_of(key, fp, max_distance, refined)
            if len(a):
                yield rows(False, a, b)

    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "hot boolean, a long, b long")


def links(fps: DataFrame, max_distance: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect whatever
    differs in ``max_distance`` (at most 3) or fewer bits; a spanning forest
    of each large bucket, every pair of small ones."""
    if not 0 <= max_distance <= 3:
        raise ValueError("two segments find at most 3 differing bits")
    first = cut(_verify(_variants(fps), max_distance, False, hot_bucket))
    out = first.filter(~F.col("hot")).select("a", "b")
    hot = first.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not hot.isEmpty():
        out = out.unionByName(_verify(_refined(hot), max_distance, True, hot_bucket).select("a", "b"))
    return out.distinct()


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        last = label.copy()
        np.minimum.at(label, last[a], low)
        np.minimum.at(label, last[b], low)
        label = label[label]
        if (label == last).all():
            rest = label != np.arange(len(nodes))
            return nodes[rest], nodes[label[rest]]


def connected(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node, label``: the smallest node reachable, for all other nodes.

    Alternating large and small stars over minima contract the graph; nothing
    is gathered per node or on the driver.  Once no more than ``local_edges``
    (16 bytes each) are left, which is checked, one task does the rest."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select("b", "a"))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a")
        if large:
            out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def measured(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        written = cut(e.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")))
        return written, (seen.get.get("n") or 0, seen.get.get("x"), seen.get.get("s"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        node, label = _smallest(*(rows.column(c).to_numpy() for c in ("a", "b")))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(label, pa.int64())], ["node", "label"])

    now, seen = measured(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while seen[0] > local_edges:
        last = seen
        now, seen = measured(star(star(now, True), False))
        if last == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return now.coalesce(1).mapInArrow(finish, "node long, label long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, fp, component_id``.

    component_id is the smallest doc_id reachable over links of at most
    ``max_distance`` differing bits, the row's own included.  Null and
    wordless texts have fingerprint zero and link like any other; a repeated
    row is repeated in the result; rows with a null id keep their row and
    count for no component's smallest id (null if it has no other).  An empty
    table gives no rows; other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    labels = connected(links(distinct.select("fp"), max_distance, hot_bucket))
    labelled = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return fps.join(labelled.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# Lower similarities.  At a Jaccard similarity of 0.8 some 15 % of the bits of a
# SimHash differ, so no signature over few segments can promise to find a pair.
# Signatures of a pass before only join what is nearly equal; the rest is found
# by the shingles themselves, completely (see similar_documents).

#: Nodes of a shingle that are searched together, and from which on the closest
#: come first.
BUCKET_ROWS, MANY = heavylight.HOT, heavylight.MANY
#: Documents sampled, and shingles listed, to put common shingles last.  They
#: set an order only; what is found does not depend on them.
SAMPLE_DOCS, COMMON = 20_000, 100_000
#: Nodes whose texts are fetched by a broadcast of their names.
BROADCAST_NODES = 100_000
#: Shingles of a group of sets that are verified together: 32 MB.
CELL = 1 << 22
#: Bytes of a text that are hashed at once.
TEXT_PART = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


#: A number for each byte, zero between words, and for its place in a word.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_PLACES = _mixed(np.arange(1 << 32, (1 << 32) + 256, dtype=np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' numbers times their places', summed up."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    gaps = np.flatnonzero(_BYTES[raw] == 0) if len(raw) > TEXT_PART else np.empty(0, np.int64)
    cuts = gaps[np.minimum(np.searchsorted(gaps, np.arange(TEXT_PART, len(raw), TEXT_PART)), len(gaps) - 1)] if len(gaps) else gaps
    out = []
    for part in np.split(raw, np.unique(cuts)):  # very long texts in parts
        value = _BYTES[part]
        inside = value != 0
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        if not len(starts):
            continue
        place = np.arange(starts[0], len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
        most = int(place.max()) + 1
        places = _PLACES if most <= len(_PLACES) else _mixed(np.arange(1 << 32, (1 << 32) + most, dtype=np.uint64))
        out.append(_mixed(np.add.reduceat(value[starts[0] :] * places[place], starts - starts[0])))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    words = word_hashes(text)
    k = min(len(words), shingle)
    n = len(words) - k + 1 if k else 0
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[i : i + n]
    h = np.sort(_mixed(h).view(np.int64))
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if n else h


def _set_fingerprint(values: np.ndarray) -> int:
    """The 64-bit SimHash (signed) of a set of shingle hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        counts += np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<i8")[0])


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that repeat in a sample of the documents, least common first."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle))], ["h"])

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE_DOCS))) == 0)
    rows = sample.mapInArrow(run, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    return np.array([r[0] for r in reversed(rows)], np.int64)


def _node(values: np.ndarray) -> int:
    """The name of a set."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefixes(docs: DataFrame, similarity: float, shingle: int, fingerprint: bool = True) -> DataFrame:
    """``doc_id, th, node, fp, n, prefix, long, s0...``: th is a hash of the
    text; node names the shingle set, fp is its SimHash (0 unless asked for), n
    its size; prefix has its first shingles, common ones last, one more than
    ``prefix_length``; the rest are its signatures, long that of a large set."""
    common = _common(docs, shingle)
    order = np.argsort(common, kind="stable")
    listed = common[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            first = []
            for v in sets:
                rank = np.zeros(len(v), np.int64)
                if len(listed) and len(v):
                    at = np.minimum(np.searchsorted(listed, v), len(listed) - 1)
                    rank = np.where(listed[at] == v, order[at] + 1, 0)
                first.append(v[np.argsort(rank, kind="stable")][: int(prefix_length(len(v), similarity)) + 1 if len(v) else 0])
            bits = np.array([parities(v) for v in sets], np.int64).reshape(-1, SIGNATURE)
            columns = [pa.array([_node(v) for v in sets], pa.int64()), pa.array([_set_fingerprint(v) if fingerprint else 0 for v in sets], pa.int64()), pa.array([len(v) for v in sets], pa.int32()), _lists(first), pa.array([long_parities(v) for v in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *map(pa.array, bits.T)], ["doc_id", "th", "node", "fp", "n", "prefix", "long", *SIGNATURES])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type}, th long, node long, fp long, n int, prefix array<bigint>, long binary, " + ", ".join(f"{c} long" for c in SIGNATURES))


def _named(asked: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked`` (``node`` and other columns) with ``text``.  ``nodes`` names a
    row of each, by its id and the hash of its text; only that row is read."""
    seen = Observation()
    columns = asked.columns
    named = cut(asked.join(nodes.select(F.col("node").alias("_n"), F.col("pick.th").alias("th"), F.col("pick.doc_id").alias("_id")), F.col("node") == F.col("_n")).select(*columns, "th", "_id").observe(seen, F.count("*").alias("n")))
    small = (seen.get.get("n") or 0) <= BROADCAST_NODES
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    return texts.join(F.broadcast(named) if small else named, (F.col("_th") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(*columns, "text")


def _whole_sets(asked: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, set``, one row a node, for rows may repeat whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                good = [(n, v) for n, v in zip(part.column(0).to_pylist(), sets) if _node(v) == n]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in good], pa.int64()), _lists([v for _, v in good])], ["node", "set"])

    return _named(asked.select("node"), docs, nodes).mapInArrow(run, "node long, set array<bigint>").groupBy("node").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose exact Jaccard similarity is reached.

    What pairs tie together is verified together, so that a text is sent once,
    compressed, and not with each of its pairs: ties are put into groups of
    some ``CELL`` shingles; one that is larger is dealt in parts of that size,
    any two of which are a group, and a text goes where it has pairs."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ties = connected(pairs).withColumnRenamed("node", "_n")
    named = cut(ends.join(ties, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("label", "node").alias("tie")).join(nodes.select(F.col("node").alias("_n"), "n"), F.col("node") == F.col("_n")).drop("_n"))
    sizes = cut(named.groupBy("tie").agg(F.ceil(F.sum("n") / CELL).alias("parts"), F.sum("n").alias("n")))
    groups = (sizes.agg(F.sum("n")).first()[0] or 0) // CELL + 1
    place = named.join(sizes.drop("n"), "tie").select("node", "tie", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    side = lambda x, *more: place.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}"), *more)
    one = F.col("parts") == 1
    cell = (F.when(one, F.pmod(F.xxhash64("tie"), F.lit(groups))).otherwise(F.col("tie")).alias("g"), F.when(one, 0).otherwise(F.least("part_a", "part_b")).alias("i"), F.when(one, 0).otherwise(F.greatest("part_a", "part_b")).alias("j"))
    dealt = cut(pairs.join(side("a", "tie", "parts"), "a").join(side("b"), "b").select("a", "b", *cell))
    asked = dealt.select(F.col("a").alias("node"), "g", "i", "j").union(dealt.select("b", "g", "i", "j")).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            texts = [pack(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.binary())], ["node", "g", "i", "j", "text"])

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        of = {}
        for n, t in zip(right.column("node").to_pylist(), right.column("text").to_pylist()):
            if n not in of:
                v = shingle_set(unpack(t).decode("utf-8", "surrogatepass"), shingle)
                if _node(v) == n:
                    of[n] = v
        good = []
        for x, y in zip(*(left.column(c).to_pylist() for c in ("a", "b"))):
            p, q = of[x], of[y]
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(both * (1 + similarity) >= similarity * (len(p) + len(q)) - 1e-9)
        return left.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = _named(asked, docs, nodes).mapInArrow(packed, "node long, g long, i int, j int, text binary")
    out = cut(dealt.groupBy("g", "i", "j").cogroup(texts.groupBy("g", "i", "j")).applyInArrow(check, "a long, b long"))
    drop(pairs, named, sizes, dealt)
    return out


def _single(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, prefix, long, s0...``: one row for each node.  Only copies are
    brought together, each partition's first."""
    wanted = ["node", "n", "prefix", "long", *SIGNATURES]
    seen = Observation()
    copied = cut(nodes.filter("copies > 1").select("node").observe(seen, F.count("*").alias("n")))
    copied = F.broadcast(copied) if (seen.get.get("n") or 0) <= 10 * BROADCAST_NODES else copied
    rest = rows.select(*wanted).join(copied, "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in wanted[1:]))
    return rows.select(*wanted).join(copied, "node", "left_anti").unionByName(rest)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, component_id`` for each row: documents linked where the sets
    of their word shingles have at least this Jaccard similarity.

    All such documents are linked.  SimHash signatures join what is nearly
    equal first; the rest is found by the heavy-light join of the shingle sets.
    Every pair of either is verified on its sets.  Null, wordless, repeated and
    null-id rows and empty tables are as in near_duplicates.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_prefixes(docs, similarity, shingle))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("th", "doc_id")).alias("pick"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.count("*").alias("copies")))
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    head = lambda n: heads.select(F.col("fp").alias(n), F.col("head").alias(f"head_{n}"))
    near = links(heads.select("fp")).join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    first = _verified(same.unionByName(near), docs, nodes, similarity, shingle)
    verify = lambda pairs: _verified(pairs, docs, nodes, similarity, shingle)
    rest = heavylight.join(_single(rows, nodes), lambda named: _whole_sets(named, docs, nodes, shingle), verify, connected, first, similarity, bucket_rows, MANY)
    labels = connected(first.unionByName(rest))
    labelled = nodes.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return rows.select("doc_id", "node").join(labelled.join(least, "label").select("node", "component_id"), "node").select("doc_id", "component_id")
