"""Level-synchronous traversals.

Each level is one join of the frontier with the edges and one anti-join with
what is known.  Levels are written to the shared folder, so plans stay short
and a lost executor costs a level at most; only a row count reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from . import components


def distances(edges: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """(id, distance) of all nodes that the root reaches over any edge."""
    spark = edges.sparkSession
    # Repeated edges stay: dropping them would hold a task's share of all pairs.
    hops = materialize(edges.select("from_id", "to_id"), "hops")
    level = materialize(spark.range(1).select(F.lit(root).alias("id"), F.lit(0).alias("distance")), "level")
    known, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        # Told apart after the shuffle, where a task has its share of ids only.
        reached = level.join(hops, level["id"] == hops["from_id"]).select(F.col("to_id").alias("id")).repartition("id").distinct()
        level = materialize(
            reached.join(known.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("distance")), "level"
        )
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def root_distance(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Distance of every node; those out of reach get one beyond the largest."""
    found = distances(edges, root)
    far = found.agg((F.max("distance") + 1).alias("far"))
    return nodes.select("id").join(found, "id", "left").join(F.broadcast(far)).select(
        "id", F.coalesce("distance", "far").alias("distance")
    )


def unreachable(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    return nodes.join(distances(edges, root).select("id"), "id", "left_anti")


def shortest_trails(edges: DataFrame, root: str) -> DataFrame:
    """(id, distance, trail) with the first shortest trail: among equally
    short ones, the one whose parent came first, then the lower edge id."""
    spark = edges.sparkSession
    hops = materialize(edges.select("id", "from_id", "to_id"), "hops")
    # ``place`` numbers a level's nodes in the order of their discovery.
    level = materialize(
        spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("distance"), F.array(F.lit(root)).alias("trail"), F.lit(0).cast("long").alias("place")), "trail"
    )
    known, depth = level, 0
    while True:
        depth += 1
        # A node's first parent is found among numbers; trails and edge ids are fetched for that one only.
        reached = hops.select("from_id", F.col("to_id").alias("node")).join(level.select(F.col("node").alias("from_id"), "place"), "from_id")
        first = reached.repartition("node").groupBy("node").agg(F.min("place").alias("place")).join(known.select("node"), "node", "left_anti")
        first = materialize(first.join(level.select("place", F.col("node").alias("from_id"), "trail"), "place"), "first")
        if first.isEmpty():
            break
        by = hops.select("id", "from_id", F.col("to_id").alias("node")).join(first, ["from_id", "node"])
        once = F.row_number().over(Window.partitionBy("node").orderBy("id"))
        by = by.repartition("node").withColumn("_r", once).filter("_r = 1").orderBy("place", "id")
        level = materialize(
            by.select("node", F.lit(depth).alias("distance"), F.array_append("trail", F.col("node")).alias("trail"), F.monotonically_increasing_id().alias("place")), "trail"
        )
        known = known.unionByName(level)
    return known.select(F.col("node").alias("id"), "distance", "trail")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Nodes on or between cycles: what is left when nodes without an edge in
    or out are peeled until none is.  Empty if and only if acyclic."""
    left = materialize(edges.select("from_id", "to_id").distinct(), "core")
    size = left.count()
    while size:
        sources = left.select(F.col("from_id").alias("n")).distinct()
        targets = left.select(F.col("to_id").alias("n")).distinct()
        kept = left.join(targets.withColumnRenamed("n", "from_id"), "from_id", "left_semi").join(
            sources.withColumnRenamed("n", "to_id"), "to_id", "left_semi"
        ).select("from_id", "to_id")
        left = materialize(kept, "core")
        now = left.count()
        if now == size:
            break
        size = now
    return left.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


def would_close_cycle(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """``candidates`` (from_id, to_id) with ``closes``: whether the progression
    edges already lead from to_id back to from_id."""
    reach = components.Reach(edges.filter("edge_type = 'progression'"))
    return reach.answers(candidates, "to_id", "from_id").withColumnRenamed("reaches", "closes")


def _closing(candidates: DataFrame, wanted: DataFrame, hops: DataFrame) -> DataFrame:
    """``candidates`` with ``closes``: ``wanted`` (from_id, to_id, before)
    walk ``hops`` (at, next, since), those with a position only if it is
    before theirs."""
    level = materialize(wanted.select("from_id", "to_id", "before", F.col("to_id").alias("at")), "reach")
    known = level
    rounds = 0
    while True:  # Known triples only grow, so it ends.
        step = level.filter("at <> from_id").join(hops, "at").filter("since IS NULL OR since < before")
        step = step.select("from_id", "to_id", "before", F.col("next").alias("at")).distinct()
        level = materialize(step.join(known, ["from_id", "to_id", "at"], "left_anti"), "reach")
        if level.isEmpty():
            break
        known = known.unionByName(level)
        rounds += 1
        if rounds % 8 == 0:
            known = materialize(known.repartition("from_id", "to_id", "at"), "known")
    hit = known.filter("at = from_id").select("from_id", "to_id").distinct().withColumn("hit", F.lit(True))
    return candidates.join(hit, ["from_id", "to_id"], "left").select(
        *candidates.columns, F.coalesce("hit", F.lit(False)).alias("closes")
    )
