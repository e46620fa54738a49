"""How the sources of each language differ in the terms they use.

Terms that enough documents of a language have are kept.  A group (language
and source) is a vector of smoothed frequencies over them, in whole parts of
``SCALE``; terms that a group lacks have one value, so only the others are
stored, packed by shard of the vocabulary: sorted numbers by their differences
and the frequencies, compressed.

The groups of a language play a round-robin tournament.  In round r of the
circle method group i meets the group j with i + j = 2r modulo the number of
players less one, or the last player if that is i itself.  Of each meeting one
group is at home: its vector stays with its partition, which visitors pass one
after another in the order of the rounds, so a task holds two shards of a
vector.  A meeting yields both directions.  Rounds are played ``ROUNDS`` at a
time, which bounds the copies that are under way.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import cut

#: Parts of one, and documents of a language that a kept term is in.
SCALE, MIN_DOCS = 1_000_000_000, 3
#: Terms of a group that are reported.
TERMS = 200
#: Terms of a shard, rounds under way at a time, and counts a task holds.
SHARD, ROUNDS, HELD = 8192, 16, 200_000
#: The letters of a term, as bytes of lower-cased UTF-8.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` summed up by task; a row of the empty
    term for each group, whether it has terms or not."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, within) in held.items():
            terms = [b"", *counts]
            n, docs = [0, *counts.values()], [0, *(within[t] for t in counts)]
            for at in range(0, len(terms), 10_000):
                to = slice(at, at + 10_000)
                size = len(terms[to])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms[to], pa.binary()).cast(pa.string()), pa.array(n[to], pa.int64()), pa.array(docs[to], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = held.get((lang, source))
                if own is None:
                    own = held[lang, source] = (Counter(), Counter())
                before = len(own[0])
                found = _TERM.findall(text.lower())
                own[0].update(found)
                own[1].update(set(found))
                size += len(own[0]) - before
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text("lang"), text("source"), text("text").cast("binary")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int64)


def meeting(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int) -> tuple[int, int]:
    """The divergence of a from b and of b from a over one shard of so many
    terms: ids, frequencies, and the frequency of all other terms."""
    ids = np.union1d(a[0], b[0])
    p, q = np.full(len(ids), a[2], np.int64), np.full(len(ids), b[2], np.int64)
    p[np.searchsorted(ids, a[0])] = a[1]
    q[np.searchsorted(ids, b[0])] = b[1]
    square, rest = (p - q) ** 2, (a[2] - b[2]) ** 2
    other = terms - len(ids)
    return int((square // q).sum()) + other * (rest // b[2]), int((square // p).sum()) + other * (rest // a[2])


def _vectors(docs: DataFrame, min_docs: int, terms: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """Groups ``lang, source, i, players, shards``, and vectors ``lang, source,
    shard, ids, ps, rest, size, top``: size is the shard's terms, rest the
    frequency of those not in ids, top the first terms above the language's."""
    every = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    # one row of each term counts for it
    first = F.row_number().over(term.orderBy("source")) == 1
    kept = every.withColumn("all_docs", F.sum("docs").over(term)).withColumn("nl", F.sum("n").over(term)).withColumn("first", first)
    kept = cut(kept.filter((F.col("all_docs") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "nl", "first"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum((F.col("first") & (F.col("term") != "")).cast("long")).alias("firsts"))
    w = W.partitionBy("lang")
    sums = sums.withColumn("all_total", F.sum("total").over(w)).withColumn("v", F.sum("firsts").over(w)).withColumn("i", F.row_number().over(w.orderBy("source")) - 1).withColumn("n_groups", F.count("*").over(w))
    shards = F.call_function("div", F.col("v"), F.lit(shard).cast("long")) + 1
    groups = cut(sums.select("lang", "source", "total", "all_total", "v", "i", (F.col("n_groups") + F.col("n_groups") % 2).alias("players"), shards.alias("shards")))

    wide = "decimal(28,0)"
    part = lambda n, total: F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + F.col("v")).cast(wide))
    langs = groups.groupBy("lang").agg(F.max("v").alias("v"), F.max("shards").alias("shards"), F.max("all_total").alias("all_total"))
    own = kept.filter("term <> ''")
    numbered = own.filter("first").select("lang", "term", "nl").join(langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    numbered = cut(numbered.withColumn("id", (F.row_number().over(W.partitionBy("lang", "shard").orderBy("term")) - 1).cast("long")).select("lang", "term", "shard", "id", part(F.col("nl"), F.col("all_total")).alias("q")))
    entries = own.select("lang", "source", "term", "n").filter("n > 0").join(numbered, ["lang", "term"]).join(groups.select("lang", "source", "total", "v"), ["lang", "source"])
    entries = entries.select("lang", "source", "shard", "id", "term", "q", part(F.col("n"), F.col("total")).alias("p"))

    def pack(table: pa.Table) -> pa.Table:
        ids, p, q = (table.column(c).to_numpy() for c in ("id", "p", "q"))
        more = np.flatnonzero(p > q)
        value = (p[more] - q[more]) ** 2 // q[more]
        names = table.column("term").take(pa.array(more)).to_pylist()
        best = heapq.nsmallest(terms, zip((-value).tolist(), [t.encode() for t in names]))
        order = np.argsort(ids)
        top = [{"item": t.decode(), "value": -f} for f, t in best]
        return pa.table({"lang": table.column("lang")[:1], "source": table.column("source")[:1], "shard": table.column("shard")[:1], "ids": pa.array([_pack(np.diff(ids[order], prepend=0))], pa.binary()), "ps": pa.array([_pack(p[order])], pa.binary()), "top": pa.array([top], pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())])))})

    packed = entries.groupBy("lang", "source", "shard").applyInArrow(pack, "lang string, source string, shard long, ids binary, ps binary, top array<struct<item string, value bigint>>")
    sizes = numbered.groupBy("lang", "shard").agg(F.count("*").alias("size"))
    grid = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumn("rest", F.when(F.col("v") > 0, part(F.lit(0).cast("long"), F.col("total"))).otherwise(1))
    vectors = grid.select("lang", "source", "i", "players", "shard", "rest").join(packed, ["lang", "source", "shard"], "left").join(sizes, ["lang", "shard"], "left")
    return groups, cut(vectors.withColumn("size", F.coalesce("size", F.lit(0))))


def _play(vectors: DataFrame, rounds: range) -> DataFrame:
    """``lang, source, item, value``: what a group's meetings in some rounds
    yield, for each shard."""
    players, r, i = F.col("players"), F.col("round"), F.col("i").cast("long")
    turned = F.pmod(2 * r - i, players - 1)
    other = F.when(i == players - 1, r).when(turned == i, players - 1).otherwise(turned)
    some = vectors.withColumn("round", F.explode(F.sequence(F.lit(rounds.start).cast("long"), F.lit(rounds.stop - 1).cast("long")))).filter(r < players - 1).withColumn("j", other)
    # the home side alternates, so that every group is at home about as often
    home = F.when((i + F.col("j")) % 2 == 0, F.least(i, F.col("j"))).otherwise(F.greatest(i, F.col("j")))
    columns = ["lang", "shard", "home", "round", "source", "size", "rest", "ids", "ps"]
    visits = some.withColumn("home", home).filter(F.col("home") != i).select(*columns)
    stay = vectors.withColumn("home", i).withColumn("round", F.lit(-1).cast("long")).select(*columns)
    place = ["lang", "shard", "home"]
    met = stay.unionByName(visits).repartition(*place).sortWithinPartitions(*place, "round")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own = name = None
        empty = np.empty(0, np.int64)
        for batch in batches:
            out = []
            for lang, shard, home, turn, source, size, rest, ids, ps in zip(*(batch.column(k).to_pylist() for k in range(9))):
                vector = (np.cumsum(_unpack(ids)), _unpack(ps), rest) if ids is not None else (empty, empty, rest)
                if turn < 0:
                    at, own, name = (lang, shard, home), vector, source
                elif at == (lang, shard, home):  # else a player that is not there
                    there, back = meeting(own, vector, size)
                    out += [(lang, name, source, there), (lang, source, name, back)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])

    return met.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group of a language
    and a source, ``pair`` rows with its divergence from each other source of
    the language, and ``term`` rows with its first terms that are more frequent
    than in the language, by their share in its divergence from that.

    A null text, lang or source is the empty text; a group of empty texts has
    pairs and no terms; a language of one source has no pairs; repeated rows
    count each; very long texts count whole; ties go by the item's bytes; an
    empty table gives no rows; other columns are ignored.
    """
    groups, vectors = _vectors(docs, min_docs, terms, shard)
    last = (groups.agg(F.max("players")).first()[0] or 0) - 1
    pairs = None
    for first in range(0, max(last, 1), rounds):
        played = _play(vectors, range(first, first + rounds)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        # the last wave alone need not be written: nothing follows it
        played = cut(played) if first + rounds < last else played
        pairs = played if pairs is None else pairs.unionByName(played)
    best = vectors.select("lang", "source", F.explode("top").alias("t")).select("lang", "source", "t.item", "t.value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= terms).withColumn("part", F.lit("term"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
