"""Documents linked by the Jaccard similarity of their word shingles.

A size-aware heavy-light join (see ``heavylight``): light sets meet on the
pairs of shingles that they enumerate, heavy ones scan inverted lists, with
the boundary where the cost of both is least.  Equal sets are one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import heavylight
from tracelake.llm.common import cut
from tracelake.llm.simhash import _prefixes, _single, _verified, _whole_sets, connected

SIMILARITY, SHINGLE = 0.8, 5


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, hot: int = heavylight.HOT, many: int = heavylight.MANY, light: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: n_shingles different
    shingles, and the smallest doc_id that links reach, the own included.

    Two documents link where their sets of shingles, lower-cased, have at least
    this similarity.  A text of fewer words is one shingle; a null, empty or
    blank text has none and links with nothing.  Repeated rows each keep their
    row; a null id counts for no component's smallest (null if it has no
    other); very long texts count whole; an empty table gives no rows; other
    columns are ignored.  ``light`` sets the boundary instead of the cost.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_prefixes(docs, similarity, shingle, fingerprint=False))
    some = rows.filter("n > 0")
    nodes = cut(some.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("th", "doc_id")).alias("pick"), F.min("n").alias("n"), F.count("*").alias("copies")))
    verify = lambda pairs: _verified(pairs, docs, nodes, similarity, shingle)
    links = heavylight.join(_single(some, nodes), lambda named: _whole_sets(named, docs, nodes, shingle), verify, connected, None, similarity, hot, many, light=light)
    labels = connected(links).withColumnRenamed("node", "_n")
    labelled = nodes.join(labels, F.col("node") == F.col("_n"), "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least_id").alias("least"))
    found = labelled.join(least, "label").select(F.col("node").alias("_n"), "least")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return rows.join(found, (F.col("node") == F.col("_n")) & (F.col("n") > 0), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"))
