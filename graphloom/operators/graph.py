"""Relational queries over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def adjacency(edges: DataFrame, by: str = "from_id") -> DataFrame:
    """Edges of each node as an ordered array (edge id order).

    One row holds all edges of a node; use it only where a search needs them
    together, and joins on the edge table otherwise."""
    return edges.groupBy(F.col(by).alias("node_id")).agg(
        F.array_sort(F.collect_list(F.struct("id", "from_id", "to_id", "edge_type", "is_common_route"))).alias("edges")
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_count, out_count), zero where a node has no edge.

    Both ends are counted in one pass and one shuffle."""
    ends = edges.select(
        F.explode(F.array(
            F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        )).alias("e")
    ).groupBy("e.id").agg(F.sum("e.i").alias("in_count"), F.sum("e.o").alias("out_count"))
    return nodes.select("id").join(ends, "id", "left").select(
        "id", F.coalesce("in_count", F.lit(0)).alias("in_count"), F.coalesce("out_count", F.lit(0)).alias("out_count")
    )


def directory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The public listing of nodes with their degrees (order: title, id)."""
    return nodes.join(degrees(nodes, edges), "id").select(
        "id", "type", "title", F.array_join("aliases", "|").alias("aliases"),
        text.node_href("id").alias("href"), "in_count", "out_count",
    )


def surfaces(extra: Column | None = None) -> Column:
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    return names if extra is None else F.concat(names, F.array(extra))


def directory_filter(nodes: DataFrame, query: str, node_type: str = "all") -> DataFrame:
    """Nodes whose title or an alias holds the query; literal, any case."""
    needle = query.strip().lower()
    out = nodes if node_type == "all" else nodes.filter(F.col("type") == node_type)
    if needle:
        out = out.filter(F.exists(surfaces(), lambda x: F.contains(F.lower(x), F.lit(needle))))
    return out


def first_shown(found: DataFrame, limit: int = 100) -> DataFrame:
    """The first results in directory order, with the count of those hidden."""
    total = found.agg(F.count("*").alias("total"))
    shown = found.orderBy("title", "id").limit(limit)
    return shown.join(F.broadcast(total)).withColumn("hidden", F.greatest(F.col("total") - limit, F.lit(0)))


def map_filter(nodes: DataFrame, edges: DataFrame, query: str, node_type: str = "all") -> tuple[DataFrame, DataFrame]:
    """As the directory filter but ids are searched too; edges stay only
    where both ends do."""
    needle = query.strip().lower()
    seen = nodes if node_type == "all" else nodes.filter(F.col("type") == node_type)
    if needle:
        seen = seen.filter(F.exists(surfaces(F.col("id")), lambda x: F.contains(F.lower(x), F.lit(needle))))
    ids = seen.select("id")
    kept = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(
        ids.select(F.col("id").alias("to_id")), "to_id", "left_semi"
    )
    return seen, kept


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent_id, id, title, edge_type, is_common_route), in order of title, id."""
    return edges.join(nodes.select(F.col("id").alias("to_id"), "title", "type"), "to_id").select(
        F.col("from_id").alias("parent_id"), F.col("to_id").alias("id"), "type", "title", "edge_type", "is_common_route"
    )


def parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("from_id"), "title", "type"), "from_id").select(
        F.col("to_id").alias("child_id"), F.col("from_id").alias("id"), "type", "title", "edge_type", "is_common_route"
    )


def top_hubs(nodes: DataFrame, edges: DataFrame, root: str, limit: int = 200) -> DataFrame:
    """The root, then the nodes of highest in-degree, ties by id."""
    counts = degrees(nodes, edges).select("id", "in_count")
    best = counts.filter(F.col("id") != root).orderBy(F.desc("in_count"), "id").limit(limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("in_count"), "id")))
    pinned = counts.filter(F.col("id") == root).withColumn("rank", F.lit(0))
    return pinned.unionByName(ranked).select("rank", "id", "in_count")


def has_child_title(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``candidates`` (parent_id, title, ...) whose parent has a child of that
    title or alias already, letter case apart."""
    names = edges.join(nodes.select(F.col("id").alias("to_id"), "title", "aliases"), "to_id").select(
        F.col("from_id").alias("parent_id"), F.explode(surfaces()).alias("name")
    ).select("parent_id", F.lower(text.strip("name")).alias("folded"))
    return candidates.withColumn("folded", F.lower(text.strip("title"))).join(
        names, ["parent_id", "folded"], "left_semi"
    ).drop("folded")


def by_route(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``wanted`` (type, slug, ...) with the ``node_id`` and ``title`` of the
    node that has both, or nulls: a node counts only if its own type and slug
    are those asked for, not if just the joined id agrees."""
    at = nodes.select(
        F.col("id").alias("node_id"), F.col("type").alias("_type"), text.id_slug("id").alias("_slug"), "title"
    )
    same = (F.col("type") == F.col("_type")) & (F.col("slug") == F.col("_slug"))
    same = same & (F.col("node_id") == F.concat_ws(":", "type", "slug"))
    return wanted.join(at, same, "left").drop("_type", "_slug")


def last_wins(rows: DataFrame, key: str = "id", position: str = "pos") -> DataFrame:
    """One row per key, the one with the highest position."""
    fields = [F.col(c) for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*fields), position).alias("_r"))
    return best.select(key, "_r.*")


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` and those of ``new`` that are no loops and not there yet;
    of equal new ones, that of the lowest position."""
    fresh = new.filter("from_id <> to_id").withColumn("id", F.concat("from_id", F.lit("->"), "to_id"))
    fields = [F.col(c) for c in edges.columns if c != "id"]
    first = fresh.groupBy("id").agg(F.min_by(F.struct(*fields), "pos").alias("_r")).select("id", "_r.*")
    return edges.unionByName(first.join(edges.select("id"), "id", "left_anti"))


def styled_edges(edges: DataFrame, distance: DataFrame) -> DataFrame:
    """Colour bucket, width and opacity of map edges; ``distance`` (id,
    distance) of all nodes, those out of reach one beyond the largest."""
    return edges.join(distance.select(F.col("id").alias("to_id"), "distance"), "to_id").select(
        "id",
        F.least("distance", F.lit(5)).alias("bucket"),
        F.when(F.col("is_common_route"), 2.0).otherwise(1.0).alias("width"),
        F.when(F.col("edge_type") == "lateral", 0.35).otherwise(0.75).alias("opacity"),
    )


def flow_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A spoken label of each edge: what it leads to, from where, and how."""
    title = nodes.select("id", "title")
    return (
        edges.join(title.select(F.col("id").alias("from_id"), F.col("title").alias("parent")), "from_id", "left")
        .join(title.select(F.col("id").alias("to_id"), F.col("title").alias("child")), "to_id", "left")
        .select(
            "id",
            F.concat(
                F.coalesce("child", text.readable_id("to_id")), F.lit(", from "),
                F.coalesce("parent", text.readable_id("from_id")),
                F.when(F.col("edge_type") == "lateral", " (sideways)")
                .when(F.col("edge_type") == "exam_gate", " (through an exam)").otherwise(""),
            ).alias("label"),
        )
    )


def carousel(items: DataFrame, selected: str, width: int = 5) -> DataFrame:
    """(offset, id) around the selected one of ``items`` (pos from 0, id):
    a frame that wraps, without clones; an unknown selection counts as the
    first."""
    counted = items.agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("id") == selected, F.col("pos"))), F.lit(0)).alias("at"))
    low = F.when(F.col("n") < width, -F.floor((F.col("n") - 1) / 2)).otherwise(-(width // 2))
    spans = counted.filter("n > 0").select(
        "n", "at", F.explode(F.sequence(low, low + F.least(F.col("n"), F.lit(width)) - 1)).alias("offset")
    ).withColumn("pos", F.pmod(F.col("at") + F.col("offset"), F.col("n")))
    return items.join(F.broadcast(spans), "pos").select(F.col("offset").cast("int").alias("offset"), "id")


def move_selection(items: DataFrame, delta: int) -> DataFrame:
    """(id, next_id): where each selection moves by ``delta`` places."""
    n = items.agg(F.count("*").alias("n"))
    moved = items.join(F.broadcast(n)).select("id", F.pmod(F.col("pos") + delta, F.col("n")).alias("pos"))
    return moved.join(items.select("pos", F.col("id").alias("next_id")), "pos").select("id", "next_id")
