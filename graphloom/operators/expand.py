"""Frontier expansion and the bounded context of a node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from ..schemas import EDUCATION_TYPES, WORKING_TYPES
from . import components
from .traverse import _closing


def fix_edge_types(edges: DataFrame, exam: str = "exam", working=WORKING_TYPES, education=EDUCATION_TYPES) -> DataFrame:
    """The grammar of edges, without the cycle rule: ``edges`` (from_type,
    to_type, edge_type, ...), exam to exam dropped, a gate exactly where one
    end is an exam, and work to education sideways."""
    either = (F.col("from_type") == exam) | (F.col("to_type") == exam)
    back = F.col("from_type").isin(*working) & F.col("to_type").isin(*education)
    gated = F.when(either, "exam_gate").when(F.col("edge_type") == "exam_gate", "progression").otherwise(F.col("edge_type"))
    return edges.filter((F.col("from_type") != exam) | (F.col("to_type") != exam)).withColumn("edge_type", gated).withColumn(
        "edge_type", F.when(back & (F.col("edge_type") == "progression"), "lateral").otherwise(F.col("edge_type"))
    )


def settle_edges(edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """``proposals`` (id, from_id, to_id, edge_type, pos, ...) as if inserted
    one after another in order of ``pos``: a progression edge that would close
    a cycle with the progression edges there by then becomes lateral.

    A proposal whose ends are in different strong components of the graph with
    all proposals in it can't close a cycle, whatever becomes of the others:
    one pass over the edges accepts all of these.  Only proposals inside a
    component, with the edges of that component, go through rounds: one that
    no earlier undecided one can turn into a cycle is accepted, and one that
    closes a cycle with what is accepted turns lateral; the first undecided
    one is always decided."""
    there = edges.filter("edge_type = 'progression'").select("from_id", "to_id")
    wanted = proposals.filter("edge_type = 'progression'")
    within = components.strong_components(there.unionByName(wanted.select("from_id", "to_id")))
    ends = lambda df: df.join(within.select(F.col("id").alias("from_id"), F.col("component").alias("ca")), "from_id").join(
        within.select(F.col("id").alias("to_id"), F.col("component").alias("cb")), "to_id"
    ).filter("ca = cb").drop("ca", "cb")
    known = ends(there).select(F.col("from_id").alias("at"), F.col("to_id").alias("next"))
    known = materialize(known.distinct().withColumn("since", F.lit(None).cast("long")), "hops")
    open_ = materialize(ends(wanted).select("id", "from_id", "to_id", F.col("pos").cast("long").alias("before")), "open")
    turned = None
    while not open_.isEmpty():
        earlier = open_.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), F.col("before").alias("since"))
        closing = materialize(_closing(open_, open_, known.unionByName(earlier)), "closing")
        safe = closing.filter("NOT closes")
        known = materialize(
            known.unionByName(safe.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), F.col("before").alias("since"))), "hops"
        )
        again = _closing(closing.filter("closes").drop("closes"), closing.filter("closes"), known)
        again = materialize(again, "again")
        lateral = again.filter("closes").select("id")
        turned = lateral if turned is None else turned.unionByName(lateral)
        open_ = materialize(again.filter("NOT closes").drop("closes"), "open")
    if turned is None:
        return proposals
    turned = materialize(turned.withColumn("turned", F.lit(True)), "turned")
    kind = F.when(F.col("turned"), "lateral").otherwise(F.col("edge_type"))
    return proposals.join(turned, "id", "left").withColumn("edge_type", kind).select(*proposals.columns)


def resume(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """Queued items (id, depth, pos, expanded) that are neither done nor unknown."""
    done = frontier.filter("expanded").select("id")
    return frontier.filter("NOT expanded").join(done, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")


def expand(
    root: str, spark, successors: Callable[[DataFrame], DataFrame], max_depth: int
) -> DataFrame:
    """(id, depth, expanded): breadth-first expansion from the root.
    ``successors`` maps a level (id, depth) to rows (from_id, to_id); a node
    is expanded once, where its depth is below ``max_depth``."""
    level = materialize(spark.range(1).select(F.lit(root).alias("id"), F.lit(0).alias("depth")), "frontier")
    known = level
    for depth in range(1, max_depth + 1):
        reached = successors(level).select(F.col("to_id").alias("id")).distinct()
        level = materialize(
            reached.join(known.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")), "frontier"
        )
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known.withColumn("expanded", F.col("depth") < max_depth)


def frontier_counts(frontier: DataFrame, max_depth: int) -> DataFrame:
    return frontier.agg(
        F.count_if(F.col("depth") < max_depth).alias("pending"), F.count_if(F.col("depth") == max_depth).alias("retained")
    )


def context_slice(
    tiers: DataFrame, max_lines: int = 300, max_chars: int = 12_000
) -> DataFrame:
    """Per owner the lines that fit both budgets: ``tiers`` (owner, tier, pos,
    id, line) in order of tier and position, each id once, stopping at the
    first that overflows.  One owner's tiers are a bounded group."""
    once = Window.partitionBy("owner", "id").orderBy("tier", "pos")
    order = Window.partitionBy("owner").orderBy("tier", "pos", "id")
    # Both windows work where the owner is: nothing is sorted before the one shuffle.
    first = tiers.repartition("owner").withColumn("d", F.row_number().over(once)).filter("d = 1")
    return (
        first.withColumn("n", F.row_number().over(order))
        .withColumn("chars", F.sum(F.char_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("n") <= max_lines) & (F.col("chars") <= max_chars))
        .select("owner", "id", "line", "tier")
    )
