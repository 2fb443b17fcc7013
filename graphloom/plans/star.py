"""A typed graph out of the driver's star-schema tables.

root -> region -> nation -> customer / supplier are progression edges,
supplier -> part are gate edges, and rings of the nations of a region are
lateral edges, which close cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = "market:all"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")

    def of(name: str, key: str, title, aliases=none) -> DataFrame:
        return _read(spark, sf_dir, name).select(
            _id(name, key).alias("id"), F.lit(name).alias("type"), title.alias("title"), aliases.alias("aliases")
        )

    root = spark.range(1).select(
        F.lit(ROOT).alias("id"), F.lit("market").alias("type"), F.lit("all").alias("title"), none.alias("aliases")
    )
    parts = [
        of("region", "r_regionkey", F.col("r_name")),
        of("nation", "n_nationkey", F.col("n_name")),
        of("customer", "c_custkey", F.col("c_name"), F.array("c_mktsegment")),
        of("supplier", "s_suppkey", F.col("s_name")),
        of("part", "p_partkey", F.concat_ws(" ", "p_name", "p_type"), F.array("p_brand")),
    ]
    for p in parts:
        root = root.unionByName(p)
    return root


def _edges(df: DataFrame, from_id, to_id, edge_type: str, common) -> DataFrame:
    return df.select(
        F.concat(from_id, F.lit("->"), to_id).alias("id"),
        from_id.alias("from_id"),
        to_id.alias("to_id"),
        F.lit(edge_type).alias("edge_type"),
        common.alias("is_common_route"),
    )


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progression and lateral edges."""
    yes, no = F.lit(True), F.lit(False)
    region, nation = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    ring = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = nation.select(
        "n_nationkey",
        F.coalesce(F.lead("n_nationkey").over(ring), F.first("n_nationkey").over(whole)).alias("next"),
    ).filter("next <> n_nationkey")
    return (
        _edges(region, F.lit(ROOT), _id("region", "r_regionkey"), "progression", yes)
        .unionByName(_edges(nation, _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "progression", yes))
        .unionByName(
            _edges(_read(spark, sf_dir, "customer"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"),
                   "progression", F.col("c_acctbal") >= 0)
        )
        .unionByName(
            _edges(_read(spark, sf_dir, "supplier"), _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"),
                   "progression", F.col("s_acctbal") >= 0)
        )
        .unionByName(_edges(nexts, _id("nation", "n_nationkey"), _id("nation", "next"), "lateral", no))
    )


def gate_edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """``once`` False leaves repeated ones, for steps that merge them."""
    pairs = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    pairs = pairs.distinct() if once else pairs
    return _edges(pairs, _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "exam_gate", F.lit(True))


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    return walk_edges(spark, sf_dir).unionByName(gate_edges(spark, sf_dir, once))


#: The same tables as common table expressions for the oracle.
SQL = """
star_nodes AS (
  SELECT 'market:all' AS id, 'market' AS type, 'all' AS title, CAST([] AS VARCHAR[]) AS aliases
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, [] FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, [] FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, [c_mktsegment] FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, [] FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name || ' ' || p_type, [p_brand] FROM part
), walk_pairs AS (
  SELECT 'market:all' AS from_id, 'region:' || r_regionkey AS to_id, 'progression' AS edge_type, true AS is_common_route FROM region
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'progression', true FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'progression', c_acctbal >= 0 FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'progression', s_acctbal >= 0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || nxt, 'lateral', false FROM (
    SELECT n_nationkey, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey),
                                 min(n_nationkey) OVER (PARTITION BY n_regionkey)) AS nxt FROM nation) WHERE nxt <> n_nationkey
), walk_edges AS (
  SELECT from_id || '->' || to_id AS id, * FROM walk_pairs
), star_edges AS (
  SELECT * FROM walk_edges
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey || '->part:' || l_partkey, 'supplier:' || l_suppkey,
    'part:' || l_partkey, 'exam_gate', true FROM lineitem
)
"""


def oracle(body: str, *tables: str) -> str:
    """``body`` over the star tables; ``tables`` are more expressions."""
    return "WITH RECURSIVE " + ", ".join([SQL.strip(), *tables]) + "\n" + body
