"""Agent trajectories as graphs.  ``run_id`` names a trajectory."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.plans.lineage import cut

MAX_NODES = 500


def nodes(steps: DataFrame, limit: int | None = MAX_NODES) -> DataFrame:
    """Steps in order of (agent, step, start) with ``node`` names; at most
    ``limit`` for each trajectory, which is what a graph view shows."""
    out = steps.withColumn("node", F.concat_ws("#", "agent_id", "step_number"))
    if limit is None:
        return out
    at = F.row_number().over(W.partitionBy("run_id").orderBy("agent_id", "step_number", "start_ns"))
    return out.withColumn("_n", at).filter(F.col("_n") <= limit).drop("_n")


def edges(steps: DataFrame, limit: int | None = MAX_NODES) -> DataFrame:
    """``run_id, source, target, kind``: a step's retry edge, else its parent
    edge (branch or sequence), else one from the agent's step before; and
    handoffs to the first step of the receiving agent.  No loops, no repeats."""
    own = nodes(steps, limit)
    names = own.select(F.col("run_id").alias("_run"), F.col("agent_id").alias("_a"), F.col("step_number").alias("_s"), F.col("node").alias("_node")).distinct()

    def find(df: DataFrame, step: str, out: str) -> DataFrame:
        on = (F.col("run_id") == F.col("_run")) & (F.col("agent_id") == F.col("_a")) & (F.col(step) == F.col("_s"))
        return df.join(names, on, "left").drop("_run", "_a", "_s").withColumnRenamed("_node", out)

    linked = find(find(own, "retry_of", "retry_node"), "parent_step", "parent_node")
    before = F.lag("node").over(W.partitionBy("run_id", "agent_id").orderBy("step_number", "start_ns"))
    linked = linked.withColumn("before", before)
    explicit = F.coalesce("retry_node", "parent_node")
    kind = F.when(F.col("retry_node").isNotNull(), "retry").when(F.col("parent_node").isNotNull() & (F.coalesce(F.col("branch_id"), F.lit("")) != ""), "branch").otherwise("sequence")
    # an explicit edge from a step to itself is none, and leaves the fallback
    source = F.when(explicit != F.col("node"), explicit).otherwise(F.col("before"))
    plain = linked.select("run_id", source.alias("source"), F.col("node").alias("target"), F.when(explicit != F.col("node"), kind).otherwise("sequence").alias("kind"))
    first = own.groupBy(F.col("run_id").alias("_run"), F.col("agent_id").alias("_a")).agg(F.min("step_number").alias("_s"))
    handed = own.filter(F.coalesce(F.col("handoff_target"), F.lit("")) != "").join(first, (F.col("run_id") == F.col("_run")) & (F.col("handoff_target") == F.col("_a")))
    handoffs = handed.select("run_id", F.col("node").alias("source"), F.concat_ws("#", "_a", "_s").alias("target"), F.lit("handoff").alias("kind"))
    return plain.unionByName(handoffs).filter("source is not null and source <> target").distinct()


def loops(steps: DataFrame) -> DataFrame:
    """``run_id, loop_detected``: an iteration above two, or one (agent, tool,
    type) three times or more."""
    repeated = steps.filter(F.coalesce(F.col("tool_name"), F.lit("")) != "").groupBy("run_id", "agent_id", "tool_name", "step_type").count().groupBy("run_id").agg(F.max("count").alias("most"))
    deep = steps.groupBy("run_id").agg(F.max(F.coalesce("loop_iteration", F.lit(0))).alias("deepest"))
    return deep.join(repeated, "run_id", "left").select("run_id", ((F.col("deepest") > 2) | (F.coalesce("most", F.lit(0)) >= 3)).alias("loop_detected"))


def limits(steps: DataFrame) -> DataFrame:
    """``run_id, termination_reason, max_steps, total_steps, retry_count,
    truncated``: the last reason and budget that a trajectory's steps name, in
    the order of a graph, and whether that graph leaves steps out."""
    at = F.struct("agent_id", "step_number", "start_ns")
    said = F.coalesce(F.col("termination_reason"), F.lit("")) != ""
    return steps.groupBy("run_id").agg(
        F.coalesce(F.max_by("termination_reason", F.when(said, at)), F.lit("")).alias("termination_reason"),
        F.max_by("max_steps", F.when(F.col("max_steps").isNotNull(), at)).alias("max_steps"),
        F.count("*").alias("total_steps"),
        F.count("retry_of").alias("retry_count"),
        (F.count("*") > MAX_NODES).alias("truncated"),
    )


def _path_of(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """The longest path of one trajectory, node by node in their order."""
    own = own.sort_values(["step_number", "agent_id"], na_position="first")
    at = {n: k for k, n in enumerate(own["node"])}
    place, before = list(zip(own["step_number"], own["agent_id"])), [[] for _ in at]
    for a, b in zip(links["source"], links["target"]):
        if a in at and b in at and place[at[a]] < place[at[b]]:
            before[at[b]].append((place[at[a]], a))
    best, pred = [int(x) for x in own["own_ns"]], [None] * len(at)
    for k in range(len(at)):
        offers = [(-best[at[a]], p, a) for p, a in before[k]]
        if offers and min(offers)[0] < 0:
            best[k], pred[k] = best[k] - min(offers)[0], min(offers)[2]
    on, k = [False] * len(at), min(range(len(at)), default=None, key=lambda i: (-best[i], place[i], own["node"].iloc[i]))
    while k is not None:
        on[k] = True
        k = None if pred[k] is None else at[pred[k]]
    return pd.DataFrame({"run_id": own["run_id"], "node": own["node"], "best_ns": best, "on_path": on})


def longest_paths(steps: DataFrame, limit: int | None = MAX_NODES) -> DataFrame:
    """``run_id, node, best_ns, on_path``: the path of greatest total duration
    over forward edges in order of (step, agent).  A graph of at most ``limit``
    nodes a trajectory is solved trajectory by trajectory; without a limit, by
    rounds: each takes the best predecessor of every node, until nothing
    changes."""
    own = nodes(steps, limit).groupBy("run_id", "node").agg(F.max(F.coalesce("duration_ns", F.lit(0))).alias("own_ns"), F.min("step_number").alias("step_number"), F.min("agent_id").alias("agent_id"))
    if limit is not None:
        kind = steps.schema["run_id"].dataType.simpleString()
        links = edges(steps, limit).select(F.col("run_id").alias("_run"), "source", "target")
        return own.groupBy("run_id").cogroup(links.groupBy("_run")).applyInPandas(_path_of, f"run_id {kind}, node string, best_ns long, on_path boolean")
    place = F.struct("step_number", "agent_id")
    own = cut(own.withColumn("place", place))
    a = own.select(F.col("run_id").alias("_r"), F.col("node").alias("_n"), F.col("place").alias("_pa"))
    e = edges(steps, limit).join(a, (F.col("run_id") == F.col("_r")) & (F.col("source") == F.col("_n"))).drop("_r", "_n")
    b = a.withColumnRenamed("_pa", "_pb")
    e = cut(e.join(b, (F.col("run_id") == F.col("_r")) & (F.col("target") == F.col("_n"))).filter("_pa < _pb").select("run_id", "source", "target", F.col("_pa").alias("place")).distinct())
    best = own.select("run_id", "node", "own_ns", F.col("own_ns").alias("best_ns"), F.lit(None).cast("string").alias("pred"), "place")
    while True:
        from_ = best.select(F.col("run_id").alias("_r"), F.col("node").alias("_n"), F.col("best_ns").alias("_b"))
        offer = e.join(from_, (F.col("run_id") == F.col("_r")) & (F.col("source") == F.col("_n"))).groupBy(F.col("run_id").alias("_r2"), "target").agg(F.max("_b").alias("offer"), F.min(F.struct((-F.col("_b")).alias("b"), "place", "source")).alias("by"))
        joined = best.join(offer, (F.col("run_id") == F.col("_r2")) & (F.col("node") == F.col("target")), "left")
        better = F.coalesce(F.col("offer") + F.col("own_ns") > F.col("best_ns"), F.lit(False))
        now = cut(joined.select("run_id", "node", "own_ns", F.when(better, F.col("offer") + F.col("own_ns")).otherwise(F.col("best_ns")).alias("best_ns"), F.when(better, F.col("by.source")).otherwise(F.col("pred")).alias("pred"), "place", better.alias("changed")))
        best = now.drop("changed")
        if now.filter("changed").isEmpty():
            break
    last = best.groupBy("run_id").agg(F.min(F.struct((-F.col("best_ns")).alias("b"), "place", "node")).alias("l")).select("run_id", F.col("l.node").alias("node"))
    path = step = cut(last)
    while True:
        step = cut(step.join(best.select("run_id", "node", "pred"), ["run_id", "node"]).filter("pred is not null").select("run_id", F.col("pred").alias("node")))
        if step.isEmpty():
            break
        path = path.unionByName(step)
    return best.join(path.withColumn("on_path", F.lit(True)), ["run_id", "node"], "left").select("run_id", "node", "best_ns", F.coalesce("on_path", F.lit(False)).alias("on_path"))
