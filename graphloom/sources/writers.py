"""Sinks: appends, keyed upserts, snapshots that change only if they must."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot
from ..runtime import materialize, scratch_path
from .readers import exists


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "true").json(path)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Put ``source`` in the place of ``target``: what was there steps aside
    first and goes when the new table is in place, so one of both is always
    whole.  ``recovered`` finishes a move that broke off between the two."""
    jvm = spark._jvm
    src, dst, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target, f"{target.rstrip('/')}.old"))
    fs = dst.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(dst.getParent())
    if fs.exists(dst):
        if fs.exists(aside):
            fs.delete(aside, True)
        if not fs.rename(dst, aside):
            raise OSError(f"could not move {target} aside")
    if not fs.rename(src, dst):
        if fs.exists(aside):
            fs.rename(aside, dst)
        raise OSError(f"could not move {source} to {target}")
    fs.delete(aside, True)


def recovered(spark: SparkSession, path: str) -> str:
    """``path``, its old table moved back if a move broke off half-way."""
    aside = f"{path.rstrip('/')}.old"
    if not exists(spark, path) and exists(spark, aside):
        _move(spark, aside, path)
    return path


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside the target and move into place when complete, so that a
    failed job leaves the old table."""
    staging = f"{path.rstrip('/')}.staging"
    df.write.mode("overwrite").format(fmt).save(staging)
    _move(df.sparkSession, staging, path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as JSON with its keys in order, put in place whole."""
    overwrite(report.select(*sorted(report.columns)).coalesce(1), path, "json")


def save_sorted(df: DataFrame, path: str, key: str = "id") -> None:
    """JSON lines in order of the key over all files, nulls left out."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], delete: DataFrame | None = None) -> DataFrame:
    """``old`` with rows of equal keys replaced by ``new``, and those of
    ``delete`` gone."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    if delete is not None:
        kept = kept.join(delete.select(*keys), keys, "left_anti")
    return kept.unionByName(new)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str, generated_at: str) -> bool:
    """Write core nodes, edges and a manifest; False, and nothing written,
    where the content digest is that of the manifest already there.

    The tables go to a folder of their own, and the manifest, which names it,
    is moved into place last: readers see the old snapshot or the new one."""
    spark = nodes.sparkSession
    nodes, edges = snapshot.checked(nodes, edges)
    digest = {"nodes": snapshot.digest(nodes), "edges": snapshot.digest(edges)}
    manifest = f"{path}/manifest"
    if exists(spark, recovered(spark, manifest)):
        old = json.loads(spark.read.text(manifest).first()[0])
        if old["digest"] == digest:
            return False
    version = hashlib.sha256(json.dumps(digest, sort_keys=True).encode()).hexdigest()[:16]
    overwrite(snapshot.core(nodes) if "facts" in nodes.columns else nodes, f"{path}/{version}/nodes")
    overwrite(edges, f"{path}/{version}/edges")
    row = json.dumps({"schema_version": 1, "generated_at": generated_at, "digest": digest, "version": version}, sort_keys=True)
    overwrite(spark.createDataFrame([(row,)], "value string").coalesce(1), manifest, "text")
    return True


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that the manifest names."""
    version = json.loads(spark.read.text(recovered(spark, f"{path}/manifest")).first()[0])["version"]
    return spark.read.parquet(f"{path}/{version}/nodes"), spark.read.parquet(f"{path}/{version}/edges")


def start_frontier(spark: SparkSession, path: str, root: str) -> bool:
    """A work queue that holds the root, unless there is one already."""
    if exists(spark, path):
        return False
    row = json.dumps({"queue": [{"id": root, "depth": 0}], "expanded": []})
    overwrite(spark.createDataFrame([(row,)], "value string").coalesce(1), path, "text")
    return True


def sync_documents(docs: DataFrame, path: str, buckets: int = 64) -> int:
    """Bring a keyed table of documents (name, body) up to date; returns how
    many were changed, added or pruned.

    A document lives in the bucket that its name hashes to.  Only buckets in
    which something differs by digest are written, each as a whole and in the
    place of its old files; buckets that lost their last document go."""
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int")
    mark = docs.withColumn("digest", F.sha2("body", 256)).withColumn("bucket", bucket)
    if not exists(spark, path):
        mark.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return mark.count()
    there = spark.read.schema(mark.schema).parquet(path)
    changed = materialize(snapshot.difference(mark, there).withColumn("bucket", bucket), "changes")
    count = changed.count()
    if count:
        touched = changed.select("bucket").distinct()
        fresh = materialize(mark.join(touched, "bucket", "left_semi"), "changed-buckets")
        fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        gone = touched.join(fresh.select("bucket").distinct(), "bucket", "left_anti").collect()  # at most ``buckets``
        for row in gone:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={row.bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return count


__all__ = ["append", "overwrite", "read_snapshot", "recovered", "save_sorted", "start_frontier", "scratch_path", "sync_documents", "upsert", "write_snapshot"]
