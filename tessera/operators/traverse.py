"""Frontier joins over edge tables: reverse reachability with depth, shortest call paths, closures, components.

The steps of a walk are written once, without the sites that it doesn't need. A level is then one join of the
frontier with the steps and one anti-join with what was seen. Frontiers are written between levels, which ends
their lineage, and every loop ends on an empty frontier or a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import written
from .graph import kind_order

BUDGET = 500


def impact(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth of all that depends on the roots (column node), directly or not; roots themselves excluded. Edges may repeat: what a level reaches is made distinct."""
    steps = written(edges.select(F.col("dst").alias("node"), F.col("src").alias("_next")), "impact-steps")
    seen = frontier = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "impact-0")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.select("node").join(steps, "node").select(F.col("_next").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), f"impact-{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def impact_within_budget(edges: DataFrame, roots: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, bool]:
    """(rows, truncated): breadth-first in a fixed order until `budget` nodes are seen, as a queue would go.

    Roots go in order of their name; a node's dependents in order of (src, kind, line, column). A node is
    expanded only if fewer than the budget were seen before its turn, so the last one may go past it; roots
    count. Rows: node, depth, via (the node that admitted it), kind, line, column. A frontier that is expanded
    has fewer rows than the budget; over these alone run the windows that number parents and nodes. The last
    parent's dependents, which may be very many, are written and never numbered.
    """
    first = roots.select("node").distinct()
    seen = written(first.select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("long").alias("_parent_turn")), "budget-0")
    frontier, count, depth = seen, seen.count(), 0
    steps = written(edges.select(F.col("dst").alias("_dst"), F.col("src").alias("_src"), "kind", "line", "column"), "budget-steps") if count < budget else edges
    while count < budget:
        depth += 1
        turns = frontier.select(F.col("node").alias("_dst"), F.row_number().over(W.orderBy("_parent_turn", "node")).cast("long").alias("_parent_turn"))
        children = steps.join(F.broadcast(turns), "_dst")  # fewer rows than the budget
        children = children.join(seen.select(F.col("node").alias("_src")), "_src", "left_anti")
        # each new node by the first edge that admits it
        admitted = children.groupBy("_src").agg(F.min(F.struct("_parent_turn", "_src", kind_order().alias("_k"), "line", "column", "kind", F.col("_dst").alias("via"))).alias("e"))
        admitted = written(admitted.select(F.col("_src").alias("node"), F.lit(depth).alias("depth"), "e.via", "e.kind", "e.line", "e.column", "e._parent_turn"), f"budget-children-{depth}")
        per_parent = admitted.groupBy("_parent_turn").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.orderBy("_parent_turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        open_ = per_parent.withColumn("_before", before).where(F.col("_before") + count < budget).agg(F.max("_parent_turn").alias("t"), F.sum("_n").alias("n")).first()
        if not open_["n"]:
            break
        # turns are in order: those up to the last open one
        frontier = admitted.where(F.col("_parent_turn") <= open_["t"])
        seen, count = seen.unionByName(frontier), count + open_["n"]
    return seen.where("depth > 0").drop("_parent_turn"), count >= budget


def trace(calls: DataFrame, start: str, end: str, budget: int = BUDGET) -> list[str] | None:
    """Nodes of a shortest call path, the one a queue in order of names finds first; None if none is known."""
    spark = calls.sparkSession
    if start == end:
        return [start]
    reverse = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("CALLS").alias("kind"), F.lit(0).alias("line"), F.lit(0).alias("column")).distinct()
    # forward from start: what "depends" on it over turned edges
    rows, _ = impact_within_budget(reverse, spark.createDataFrame([(start,)], "node string"), budget)
    # only nodes that admitted others, fewer than the budget, and the end can be on a path
    inner = rows.select(F.col("via").alias("node")).distinct()
    via = {r["node"]: r["via"] for r in rows.join(inner, "node", "left_semi").unionByName(rows.where(F.col("node") == end)).select("node", "via").collect()}
    path = [end]
    while path[-1] != start:
        if path[-1] not in via:
            return None
        path.append(via[path[-1]])
    return path[::-1]


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: the roots and everything that reaches them."""
    return impact(edges, roots).select("node").union(roots.select("node")).distinct()


def pool_components(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """node, component (least node reachable, direction aside) for a pool of nodes, by repeated minimum."""
    both = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct(), "components-edges")
    now = written(pool.select("node", F.col("node").alias("component")), "components")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("component").alias("_low"))
        after = written(now.join(near, now["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("_low", "component")).alias("component")), "components")
        if after.join(now, ["node", "component"], "left_anti").isEmpty():
            return after
        now = after


def two_hop_sums(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """node, direct (sum over neighbours' scores) and two_hop (over their neighbours but the node itself).

    Parallel edges count each, both ways; scores has node and s.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select("dst", "src"))
    direct = both.join(scores, both["b"] == scores["node"]).groupBy("a").agg(F.sum("s").alias("direct"))
    second = both.alias("x").join(both.alias("y"), F.col("x.b") == F.col("y.a")).where("x.a <> y.b").select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
    two = second.join(scores, second["b"] == scores["node"]).groupBy("a").agg(F.sum("s").alias("two_hop"))
    zero = F.lit(0.0)
    return scores.join(direct.withColumnRenamed("a", "node"), "node", "left").join(two.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("direct", zero).alias("direct"), F.coalesce("two_hop", zero).alias("two_hop"))
