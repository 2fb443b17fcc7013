"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, scratch_path, shared_dir

__all__ = ["arrow_rows", "bounded_batches", "bucket_count", "bucketed", "drop_table", "free_name", "is_held_out", "materialize", "scratch_path", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most ``rows`` rows at a time to Python while this holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of this many rows, so that memory
    follows the texts of a batch and not of ten thousand rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def drop_table(written: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing
    reads any more, on whichever file system holds them."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        if not folder.startswith(shared_dir(spark)) and f"/{shared_dir(spark).split('://')[-1].strip('/')}/" not in f"{folder}/":
            raise ValueError("only scratch tables are deleted")
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bucket_count(spark: SparkSession, df: DataFrame, bytes_each: int = 16 << 20, least: int = 8) -> int:
    """Partitions that hold about ``bytes_each`` bytes of the files under
    ``df`` (the optimiser's own size estimate, so it follows the input)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 55:  # the optimiser's word for "unknown"
        return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // bytes_each))


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``: later
    groupings by it read it in place instead of shuffling it."""
    path = scratch_path(df.sparkSession, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(min(buckets, 100_000), key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_held_out(doc_id: str, modulus: int) -> Column:
    """True where crc32 of the id's decimal digits leaves remainder 1."""
    digits = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(digits.cast("binary")), F.lit(modulus)) == 1
