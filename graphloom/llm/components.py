"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), where component
    is the smallest node that can be reached.

    Every round is one large-star and one small-star step (joins and partial
    aggregates over the edge table, which never grows), written to the
    shared folder.  The number of rounds follows the logarithm of the
    longest chain, and rounds go on until nothing changes.  Nothing but a row
    count and a checksum reaches the driver.

    Defined results: edges of a node to itself and repeated edges change
    nothing (a node with no other edge is left out); edges with a null end
    are ignored; no edges give no rows; extra columns are ignored.
    """
    now = materialize(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        stamp = _stamp(now)
        if stamp == before or stamp[0] == 0:
            break
        before = stamp
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: every larger neighbour of a node turns to the node's minimum.
        large = (
            both.join(least, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        # Small star: a node and its smaller neighbours turn to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        now = materialize(small, "edges")
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti"))
