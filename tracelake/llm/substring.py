"""Substring de-duplication over windows of a fixed number of words.

Every window gets a Rabin-Karp hash.  Documents are dealt into blocks of
about a megabyte; a block sends each of its different hashes once, packed by
hash bucket, and a shuffle brings the blocks' shares of a bucket together,
where hashes that come from two blocks are found.  Those go back to the blocks
that have them; there, windows that repeat, within a block or across, merge
into maximal intervals, whose words go.

Texts too short for a window are in no block.  Of rows that repeat over
COPIES times two stand in the blocks for all, so that neither nulls nor copies
of one row fill a block.

A hash is 64 bits, and equal hashes meet in a bucket that another hash of the
window picks, so by chance two different windows agree once in 2^(64 + log2
buckets) pairs; the number of buckets grows with the corpus.  A bucket gets at
most one entry from each block for one window, however often that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, text_bytes

WINDOW = 35
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 6 << 20
#: Copies of one row (id and text) that may stand in a block, and copies that
#: a task unfolds at a time.
COPIES, UNFOLDED = 1000, 1 << 16
_BASE = 0x9E3779B97F4A7C55
_BASE2 = 0xC2B2AE3D27D4EB4F


class _Words(dict):
    """Word hashes, kept for frequent words."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found


class WindowHasher:
    """Rolling hashes modulo 2^64: with the odd base inverted, prefix sums of
    word hash times base^-i give every window by one difference."""

    def __init__(self, window: int) -> None:
        self.window, self.words = window, _Words()
        self.powers: dict[int, np.ndarray] = {}

    def _power(self, base: int, n: int) -> np.ndarray:
        found = self.powers.get(base)
        if found is None or len(found) < n:
            found = np.full(max(n, 4096), base, np.uint64)
            found[0] = 1
            found = self.powers[base] = np.cumprod(found, dtype=np.uint64)
        return found[:n]

    def _rolled(self, x: np.ndarray, base: int) -> np.ndarray:
        n = len(x) - self.window + 1
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self._power(pow(base, -1, 1 << 64), len(x)), out=sums[1:])
        h = (sums[self.window :] - sums[:n]) * self._power(base, n)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def __call__(self, words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the bucket of every window."""
        if len(words) < self.window:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        x = np.array([*map(self.words.__getitem__, words)], np.uint64)
        with np.errstate(over="ignore"):
            first = self._rolled(x, _BASE)
            second = self._rolled((x ^ (x >> np.uint64(31))) * np.uint64(_BASE2), _BASE2)
        return first, ((second >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _by_bucket(h: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    h, bucket = h[order], bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[a]), h[a:b]


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Words of windows at these starts: overlapping windows merge."""
    edges = np.zeros(n_words + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, copies: int = COPIES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs``.

    kept has the words outside all repeated windows, joined by one space.  A
    window is repeated if its word sequence starts anywhere else in the input,
    be it in the same text or in a repeated row.  A null, empty or blank text
    has no words and an empty kept; texts shorter than the window lose
    nothing; an empty table gives no rows; other columns are ignored.
    """
    total = text_bytes(docs, text_col)
    blocks, buckets = total // block_bytes + 1, total // bucket_bytes + 1
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept string"
    every = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * window - 1  # words and what parts them

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that need no block: all of their words go, or none."""
        for batch in batches:
            words, gone = [_words(t) for t in batch.column(1).to_pylist()], batch.column(3).to_pylist()
            removed = [len(w) if g and len(w) >= window else 0 for w, g in zip(words, gone)]
            kept = [b"" if r else b" ".join(w) for w, r in zip(words, removed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), batch.column(2)], ["doc_id", "n_words", "n_removed", "kept", "n"])

    apart = every.filter(short).select("doc_id", "text", F.lit(1).cast("long").alias("n"), F.lit(False).alias("gone"))
    rows = every.filter(~short).withColumn("shown", F.lit(True))
    often = cut(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > copies).select("h"))
    if not often.isEmpty():
        counted = cut(rows.join(often, "h", "left_semi").groupBy("doc_id", "text", "h").agg(F.count("*").alias("n")))
        apart = apart.unionByName(counted.filter("n > 1").select("doc_id", "text", "n", F.lit(True).alias("gone")))
        twice = counted.select("doc_id", "text", "h", (F.col("n") == 1).alias("shown"), F.explode(F.sequence(F.lit(1), F.least("n", F.lit(2)).cast("int")))).drop("col")
        rows = rows.join(often, "h", "left_anti").unionByName(twice)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(UNFOLDED).cast("long"))))
    copy = F.explode(F.sequence(F.col("_part") * UNFOLDED + 1, F.least("n", (F.col("_part") + 1) * UNFOLDED)))
    apart = apart.mapInArrow(whole, f"{schema}, n long").withColumn("_part", part).withColumn("_copy", copy).select("doc_id", "n_words", "n_removed", "kept")
    rows = rows.select("doc_id", "text", F.pmod("h", F.lit(blocks)).alias("block"), "shown")

    def share(table: pa.Table) -> pa.Table:
        hasher, found = WindowHasher(window), []
        for text in table.column("text").to_pylist():
            found.append(hasher(_words(text), buckets))
        h, b = (np.concatenate(x) for x in zip(*found))
        parts = [(k, np.unique(x).tobytes()) for k, x in _by_bucket(h, b)]
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([k for k, _ in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64()), "hashes": pa.array([x for _, x in parts], pa.binary())})

    def repeated(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        shares = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        every = np.sort(np.concatenate(shares))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for block, x in zip(table.column("block").to_pylist(), shares):
            hit = twice[np.minimum(np.searchsorted(twice, x), len(twice) - 1)] == x if len(twice) else np.zeros(len(x), bool)
            if hit.any():  # positions in the block's sorted share: 4 bytes for 8
                out.append((block, np.flatnonzero(hit).astype(np.uint32).tobytes()))
        return pa.table({"block": pa.array([x for x, _ in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "at": pa.array([x for _, x in out], pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        hasher = WindowHasher(window)
        texts = [_words(t) for t in left.column("text").to_pylist()]
        hashed = [hasher(w, buckets) for w in texts]
        at = dict(zip(right.column("bucket").to_pylist(), right.column("at").to_pylist()))
        h, b = (np.concatenate(x) for x in zip(*hashed)) if hashed else (np.empty(0, np.uint64), np.empty(0, np.int64))
        order = np.argsort(b, kind="stable")
        flags = np.zeros(len(h), bool)
        start = 0
        for k, x in _by_bucket(h, b):
            values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
            hit = counts > 1
            if k in at:
                hit[np.frombuffer(at[k], np.uint32)] = True
            flags[order[start : start + len(x)]] = hit[inverse]
            start += len(x)
        n_words, n_removed, kept, start = [], [], [], 0
        shown = left.column("shown").to_pylist()
        for words, (hs, _), show in zip(texts, hashed, shown):
            if not show:
                start += len(hs)
                continue
            gone = covered(np.flatnonzero(flags[start : start + len(hs)]), len(words), window)
            start += len(hs)
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join(words if not n_removed[-1] else [w for w, g in zip(words, gone.tolist()) if not g]))
        return pa.table({"doc_id": left.column("doc_id").filter(left.column("shown")), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    shares = rows.groupBy("block").applyInArrow(share, "bucket long, block long, hashes binary")
    back = shares.groupBy("bucket").applyInArrow(repeated, "block long, bucket long, at binary")
    return apart.unionByName(rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(remove, schema))
