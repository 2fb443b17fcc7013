"""Kept stores: vectors packed in blocks, and answers by key.

Both only ever get new files: nothing that is there is packed or written
again, and a failed append leaves what was there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve
from ..runtime import materialize
from .readers import exists

BUCKETS = 64


def append_vectors(vectors: DataFrame, path: str, same_type: bool = True, block: int = resolve.BLOCK) -> int:
    """Add ``vectors`` (id, type, vec, pos) whose ids the store lacks, in
    blocks of their own, with their lengths taken out; returns how many."""
    spark = vectors.sparkSession
    rows = resolve._grouped(vectors, F.col("pos"), same_type)
    part = 0
    if exists(spark, path):
        there = spark.read.parquet(path)
        rows = rows.join(there.select(F.explode("ids").alias("id")), "id", "left_anti")
        part = 1 + there.agg(F.max("part")).first()[0]
    rows = materialize(rows.select("grp", "id", "pos", "vec"), "new-vectors")
    count = rows.count()
    if count:
        # The number of the append keeps names of blocks apart.
        packed = resolve.packed_blocks(rows, block).withColumn("block", F.xxhash64("grp", "block", F.lit(part))).withColumn("part", F.lit(part))
        packed.write.mode("append").parquet(path)
    return count


def nearest_in_store(queries: DataFrame, path: str, k: int = resolve.NEIGHBOURS, same_type: bool = True, block: int = resolve.BLOCK, stats: dict | None = None) -> DataFrame:
    """(q_id, id, score, rank): as ``resolve.nearest`` against the vectors of
    the store, whose blocks are read as they are; ids are strings."""
    left = resolve.packed_blocks(resolve._grouped(queries, F.lit(0), same_type), block)
    left = materialize(left.withColumn("block", F.xxhash64("grp", "block")), "query-blocks")
    right = queries.sparkSession.read.parquet(path).drop("part")
    return resolve.nearest_blocks(left, right, k, stats).select("q_id", "id", "score", "rank")


def _probe(spark: SparkSession, keys: DataFrame, path: str) -> DataFrame:
    """``keys`` (key, ...) that the store lacks."""
    if not exists(spark, path):
        return keys
    return keys.join(spark.read.parquet(path).select("bucket", "key"), ["bucket", "key"], "left_anti")


def through_cache(rows: DataFrame, path: str, produce: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` (key, ...) with ``value``, from the store or from ``produce``
    (rows of distinct keys to (key, value)), which is asked only for keys that
    the store lacks and whose answers are kept.

    The store is looked at again before writing, as another writer may have
    answered meanwhile; if both write all the same, readers take the least
    value of a key, so every reader sees one."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    wanted = rows.select(bucket.alias("bucket"), "*")
    missing = materialize(_probe(spark, wanted.dropDuplicates(["key"]), path), "cache-misses")
    if not missing.isEmpty():
        made = produce(missing.drop("bucket")).select("key", "value")
        fresh = materialize(made.select(bucket.alias("bucket"), "key", "value"), "cache-answers")
        _probe(spark, fresh, path).write.mode("append").partitionBy("bucket").parquet(path)
    if not exists(spark, path):
        return wanted.drop("bucket").withColumn("value", F.lit(None).cast("string"))
    known = spark.read.parquet(path).groupBy("bucket", "key").agg(F.min("value").alias("value"))
    return wanted.join(known, ["bucket", "key"], "left").drop("bucket")
