"""Span trees: depth, ancestors, critical path, self time, comparison.

Every step is a join on (trace, span); no trace is gathered in one task, so a
trace may have any number of spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.rollup import kind, ordered_lists
from tracelake.plans.lineage import cut

MAX_DEPTH = 64
KEY = "trace_id"


def _once(spans: DataFrame, *columns: str) -> DataFrame:
    """The columns in use, written: what makes spans (their de-duplication, as
    a rule) runs once, however often they are read."""
    return cut(spans.select(KEY, "span_id", *columns))


def _links(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, up``: up is null for roots and orphans."""
    ids = spans.select(KEY, F.col("span_id").alias("up")).distinct()
    own = spans.select(KEY, "span_id", F.when(F.coalesce(F.col("parent_span_id"), F.lit("")) != "", F.col("parent_span_id")).alias("_p"))
    found = ids.withColumnRenamed("up", "_u").withColumnRenamed(KEY, "_t")
    return own.join(found, (F.col(KEY) == F.col("_t")) & (F.col("_p") == F.col("_u")), "left").select(KEY, "span_id", F.col("_u").alias("up"))


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent is named but absent."""
    ids = spans.select(F.col(KEY).alias("_t"), F.col("span_id").alias("_u"))
    return spans.filter(F.coalesce(F.col("parent_span_id"), F.lit("")) != "").join(ids, (F.col(KEY) == F.col("_t")) & (F.col("parent_span_id") == F.col("_u")), "left_anti")


def depths(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, depth`` by pointer doubling: each round joins the
    pointers with themselves and doubles their reach, up to 64 levels; a cycle
    ends at that bound."""
    return _depths(_once(spans, "parent_span_id"))


def _depths(spans: DataFrame) -> DataFrame:
    jump = _links(spans).withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0))
    for _ in range(MAX_DEPTH.bit_length() - 1):
        seen = Observation()
        jump = cut(jump.observe(seen, F.count("up").alias("on")))
        if not seen.get.get("on"):
            break
        far = jump.select(F.col(KEY).alias("_t"), F.col("span_id").alias("_s"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        jump = jump.join(far, (F.col(KEY) == F.col("_t")) & (F.col("up") == F.col("_s")), "left").select(KEY, "span_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
    return jump.select(KEY, "span_id", F.least("depth", F.lit(MAX_DEPTH)).alias("depth"))


def ancestors(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, ancestor, distance`` for all pairs; on a cycle each
    pair once, and no span is its own ancestor.

    A round doubles the reach: what is within a span's reach, and what is
    within that of the span at its end.  Where pointers still lead on beyond
    64 levels, the largest trace bounds the reach, as only a cycle exceeds it."""
    spans = _once(spans, "parent_span_id")
    links = cut(_links(spans).filter("up is not null"))
    pairs = links.select(KEY, "span_id", F.col("up").alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    jump, reach, longest = links, 1, None
    while True:
        ends = jump.select(F.col(KEY).alias("_t"), F.col("span_id").alias("_s"), F.col("up").alias("_up"))
        far = ends.join(pairs, (F.col(KEY) == F.col("_t")) & (F.col("span_id") == F.col("_up"))).select(KEY, F.col("_s").alias("span_id"), "ancestor", (F.col("distance") + reach).alias("distance"))
        on = jump.join(ends, (F.col(KEY) == F.col("_t")) & (F.col("up") == F.col("_s"))).select(KEY, "span_id", F.col("_up").alias("up"))
        pairs, jump = cut(pairs.unionByName(far)), cut(on)
        reach *= 2
        if longest is None and reach >= MAX_DEPTH:
            longest = spans.groupBy(KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if jump.isEmpty() or (longest is not None and reach >= longest):
            return pairs.filter("ancestor <> span_id").groupBy(KEY, "span_id", "ancestor").agg(F.min("distance").alias("distance"))


def descendants(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, descendants``: how many spans stand below each."""
    counts = ancestors(spans).groupBy(KEY, F.col("ancestor").alias("span_id")).agg(F.count("*").alias("descendants"))
    return spans.select(KEY, "span_id").join(counts, [KEY, "span_id"], "left").select(KEY, "span_id", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def critical_path(spans: DataFrame) -> DataFrame:
    """``trace_id, position, span_id``: from the first root on, the child that
    ends last (ties: the first by start and id); open children are passed over.

    Pointers run from each chosen child to its parent and double their reach
    in every round, so a path of n spans takes log n rounds; a span is on the
    path if they lead to the root.  Spans on a cycle lead nowhere."""
    spans = _once(spans, "parent_span_id", "start_ns", "end_ns")
    at = F.struct("start_ns", "span_id")
    first = spans.filter(F.coalesce(F.col("parent_span_id"), F.lit("")) == "").groupBy(KEY).agg(F.min(at).alias("a")).select(KEY, F.col("a.span_id").alias("span_id"))
    closed = spans.filter(F.col("end_ns").isNotNull() & (F.coalesce(F.col("parent_span_id"), F.lit("")) != "") & (F.col("parent_span_id") != F.col("span_id")))
    best = closed.groupBy(KEY, F.col("parent_span_id").alias("up")).agg(F.min(F.struct((-F.col("end_ns")).alias("e"), "start_ns", "span_id")).alias("b"))
    now = cut(best.select(KEY, F.col("b.span_id").alias("span_id"), "up", F.lit(1).cast("long").alias("distance")))
    reach = 1
    longest = spans.groupBy(KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while reach < longest:
        far = now.select(F.col(KEY).alias("_t"), F.col("span_id").alias("_s"), F.col("up").alias("_up"), F.col("distance").alias("_d"))
        now = now.join(far, (F.col(KEY) == F.col("_t")) & (F.col("up") == F.col("_s")), "left")
        seen = Observation()
        now = now.observe(seen, F.count("_up").alias("moved")).select(KEY, "span_id", F.coalesce("_up", "up").alias("up"), (F.col("distance") + F.coalesce("_d", F.lit(0))).alias("distance"))
        now = cut(now)
        reach *= 2
        if not seen.get.get("moved"):
            break
    root = first.select(F.col(KEY).alias("_t"), F.col("span_id").alias("_r"))
    path = now.join(root, (F.col(KEY) == F.col("_t")) & (F.col("up") == F.col("_r")))
    return first.select(KEY, F.lit(0).cast("long").alias("position"), "span_id").unionByName(path.select(KEY, F.col("distance").alias("position"), "span_id"))


def self_time(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, self_ns``: duration less the union of the closed
    children's intervals, at least 0; open spans are left out."""
    spans = _once(spans, "parent_span_id", "start_ns", "end_ns", "duration_ns")
    children = spans.filter(F.col("end_ns").isNotNull()).select(F.col(KEY).alias("_t"), F.col("parent_span_id").alias("_p"), F.col("start_ns").alias("_s"), F.col("end_ns").alias("_e"))
    before = F.max("_e").over(W.partitionBy("_t", "_p").orderBy("_s", "_e").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.lit(0).cast("long"), F.col("_e") - F.greatest(F.col("_s"), F.coalesce(before, F.col("_s"))))
    covered = children.withColumn("added", added).groupBy("_t", "_p").agg(F.sum("added").alias("covered"))
    own = spans.filter(F.col("duration_ns").isNotNull()).select(KEY, "span_id", "duration_ns")
    joined = own.join(covered, (F.col(KEY) == F.col("_t")) & (F.col("span_id") == F.col("_p")), "left")
    return joined.select(KEY, "span_id", F.greatest(F.col("duration_ns") - F.coalesce("covered", F.lit(0)), F.lit(0)).alias("self_ns"))


def services_in_order(spans: DataFrame, column: str = "service_name") -> DataFrame:
    """``trace_id, services``: distinct, in order of first appearance."""
    lists = ordered_lists(spans, [KEY], F.array(kind("services", F.col(column))))
    return lists.select(KEY, F.col("lists")["services"].alias("services"))


def retry_groups(spans: DataFrame) -> DataFrame:
    """``trace_id, original, retries`` where (parent, name) occurs again: the
    first span and how many follow it."""
    groups = spans.groupBy(KEY, F.coalesce("parent_span_id", F.lit("")).alias("parent"), "name")
    return groups.agg(F.min_by("span_id", F.struct("start_ns", "span_id")).alias("original"), (F.count("*") - 1).alias("retries")).filter("retries > 0").select(KEY, "original", "retries")


def retry_links(links: DataFrame) -> DataFrame:
    """``trace_id, original, retries`` from explicit retry links
    ``trace_id, span_id, retry_of``."""
    return links.filter("retry_of is not null").groupBy(KEY, F.col("retry_of").alias("original")).agg(F.count("*").alias("retries"))


def retries(spans: DataFrame, prefix: str = "platform.") -> DataFrame:
    """``trace_id, original, retries``: of a trace with links that are marked as
    retries, those; of another, equal names under one parent.  ``links`` has
    ``span_id, attributes`` of each link."""
    spans = _once(spans, "parent_span_id", "name", "start_ns", "links")
    marked = spans.select(KEY, "span_id", F.explode("links").alias("l")).filter(F.coalesce(F.try_element_at("l.attributes", F.lit(f"{prefix}retry_of")), F.lit("")) != "")
    linked = retry_links(marked.select(KEY, "span_id", F.col("l.span_id").alias("retry_of")))
    return linked.unionByName(retry_groups(spans.join(linked.select(KEY).distinct(), KEY, "left_anti")))


def preorder(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, position, depth, children, descendants``: the rows of
    a trace in the order in which a reader goes down its tree, from 0 on;
    siblings by start and id, orphans as roots.  Spans on a cycle have no root
    and no row.

    An Euler tour: every span is entered and left, and each of these events
    names the next.  How many entries and exits follow an event is found by
    doubling the reach of these pointers, so a trace of n spans takes log n
    joins, however deep it is, and is nowhere gathered."""
    spans = _once(spans, "parent_span_id", "start_ns")
    tree = spans.select(KEY, "span_id", "start_ns").join(_links(spans), [KEY, "span_id"])
    order = W.partitionBy(KEY, "up").orderBy("start_ns", "span_id")
    tree = tree.withColumn("after", F.lead("span_id").over(order)).select(KEY, "span_id", "up", "after", F.row_number().over(order).alias("nth"))
    first = tree.filter("nth = 1 and up is not null").select(F.col(KEY).alias("_t"), F.col("up").alias("_u"), F.col("span_id").alias("first"))
    tree = cut(tree.join(first, (F.col(KEY) == F.col("_t")) & (F.col("span_id") == F.col("_u")), "left").select(KEY, "span_id", "up", "after", "first"))
    event = lambda span, leaves: F.struct(span.alias("span"), leaves.alias("leaves"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None)
    c = F.col
    enter = F.when(c("first").isNotNull(), event(c("first"), no)).otherwise(event(c("span_id"), yes))
    leave = F.when(c("after").isNotNull(), event(c("after"), no)).when(c("up").isNotNull(), event(c("up"), yes)).otherwise(none)
    now = tree.select(KEY, c("span_id").alias("span"), no.alias("leaves"), enter.alias("to"), F.lit(1).cast("long").alias("ins"), F.lit(0).cast("long").alias("outs"))
    now = now.unionByName(tree.select(KEY, c("span_id").alias("span"), yes.alias("leaves"), leave.alias("to"), F.lit(0).cast("long").alias("ins"), F.lit(1).cast("long").alias("outs")))
    longest, reach = 2 * (spans.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0), 1
    while True:
        seen = Observation()
        now = cut(now.observe(seen, F.count("to").alias("on")))
        if not seen.get.get("on") or reach > longest:  # what goes on then is a cycle
            break
        far = now.select(c(KEY).alias("_t"), c("span").alias("_s"), c("leaves").alias("_l"), c("to").alias("_to"), c("ins").alias("_i"), c("outs").alias("_o"))
        now = now.join(far, (c(KEY) == c("_t")) & (c("to.span") == c("_s")) & (c("to.leaves") == c("_l")), "left")
        now = now.select(KEY, "span", "leaves", c("_to").alias("to"), (c("ins") + F.coalesce("_i", F.lit(0))).alias("ins"), (c("outs") + F.coalesce("_o", F.lit(0))).alias("outs"))
        reach *= 2
    ended = now.filter(c("to").isNull())
    by = ended.groupBy(KEY, "span").agg(F.max(F.when(~c("leaves"), F.struct("ins", "outs"))).alias("a"), F.max(F.when(c("leaves"), F.struct("ins", "outs"))).alias("z"))
    whole = ended.groupBy(c(KEY).alias("_t")).agg(F.max("ins").alias("_ins"), F.max("outs").alias("_outs"))
    children = tree.filter("up is not null").groupBy(c(KEY).alias("_ct"), c("up").alias("_cu")).agg(F.count("*").alias("children"))
    out = by.join(whole, c(KEY) == c("_t")).join(children, (c(KEY) == c("_ct")) & (c("span") == c("_cu")), "left")
    position = c("_ins") - c("a.ins")
    return out.select(KEY, c("span").alias("span_id"), position.alias("position"), (position - (c("_outs") - c("a.outs"))).alias("depth"), F.coalesce("children", F.lit(0)).alias("children"), (c("a.ins") - c("z.ins") - 1).alias("descendants"))


def structural_keys(spans: DataFrame) -> DataFrame:
    """Adds depth and ordinal, the nth (depth, name) of its trace by start."""
    deep = spans.join(_depths(spans), [KEY, "span_id"])
    return deep.withColumn("ordinal", F.row_number().over(W.partitionBy(KEY, "depth", "name").orderBy("start_ns", "span_id")) - 1)


#: What a trace is made by, in two traces' comparison.
LINEAGE = ("prompt_version_ids", "model_config_ids", "dataset_version_ids", "models", "release")


def lineage(pairs: DataFrame, traces: DataFrame) -> DataFrame:
    """``left_trace, right_trace, field, left, right, changed``: what the two
    traces of a pair were made by, from their roll-ups; lists are compared as
    sets.  A trace without a roll-up has nothing."""
    value = lambda c: F.col(c) if traces.schema[c].dataType.typeName() == "array" else F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.expr("cast(array() as array<string>)"))
    # a trace's values come as one row to each side of a pair
    made = cut(traces.select(KEY, F.struct(*(value(c).alias(c) for c in LINEAGE)).alias("made")))
    side = lambda trace, name: made.select(F.col(KEY).alias(trace), F.col("made").alias(name))
    met = pairs.select("left_trace", "right_trace").join(side("left_trace", "_l"), "left_trace", "left").join(side("right_trace", "_r"), "right_trace", "left")
    out = met.select("left_trace", "right_trace", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col("_l")[c].alias("left"), F.col("_r")[c].alias("right")) for c in LINEAGE))))
    none = F.expr("cast(array() as array<string>)")
    out = out.withColumn("left", F.coalesce("left", none)).withColumn("right", F.coalesce("right", none))
    return out.select("left_trace", "right_trace", "field", "left", "right", (F.array_sort(F.array_distinct("left")) != F.array_sort(F.array_distinct("right"))).alias("changed"))


def compare(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """For each pair ``left_trace, right_trace``: spans matched on (depth,
    name, ordinal), with the difference of their durations, and those on one
    side only."""
    keyed = cut(structural_keys(_once(spans, "parent_span_id", "name", "start_ns", "duration_ns")))
    match = ["left_trace", "right_trace", "depth", "name", "ordinal"]

    def side(trace: str, tag: str) -> DataFrame:
        return pairs.join(keyed.withColumnRenamed(KEY, trace), trace).select(*match, F.col("span_id").alias(f"{tag}_span"), F.col("duration_ns").alias(f"{tag}_ns"))

    both = side("left_trace", "left").join(side("right_trace", "right"), match, "full")
    kind = F.when(F.col("left_span").isNull(), "right").when(F.col("right_span").isNull(), "left").otherwise("both")
    return both.withColumn("side", kind).withColumn("delta_ns", F.col("right_ns") - F.col("left_ns"))
