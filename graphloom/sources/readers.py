"""Typed scans of registry, snapshot and ledger files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators.graph import last_wins


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; no rows where the path does not exist, and
    blank lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def _defaults(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")),
        "description": F.coalesce("description", F.lit("")),
        "is_terminal": F.coalesce("is_terminal", F.lit(False)),
        "needs_review": F.coalesce("needs_review", F.lit(False)),
    })


def _placed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``pos``: file, place of the split in it, row in that."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, pos struct<file:string,at:long,row:long>")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    return spark.read.schema(schema).json(path).select("*", place.alias("pos"))


def registry(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; of rows that repeat an id the last in the file stays."""
    nodes = _defaults(_placed(spark, nodes_path, schemas.NODE))
    edges = _placed(spark, edges_path, schemas.EDGE).withColumn("is_common_route", F.coalesce("is_common_route", F.lit(True)))
    return last_wins(nodes), last_wins(edges)


def frontier(spark: SparkSession, path: str) -> DataFrame:
    """The work queue (id, depth, pos, expanded) of {queue, expanded}."""
    raw = spark.read.schema("queue array<struct<id:string,depth:int>>, expanded array<string>").option("multiLine", True).json(path)
    queue = raw.select(F.posexplode("queue").alias("pos", "q")).select("q.id", "q.depth", F.col("pos").cast("long"), F.lit(False).alias("expanded"))
    done = raw.select(F.explode("expanded").alias("id")).select(
        "id", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("pos"), F.lit(True).alias("expanded")
    )
    return queue.unionByName(done)


def exams(spark: SparkSession, path: str) -> DataFrame:
    """Curated exams: a map of name to (level, notes) as gate nodes."""
    raw = spark.read.schema("exams map<string,struct<level:string,notes:string>>").option("multiLine", True).json(path)
    e = raw.select(F.explode("exams").alias("title", "x"))
    level = F.replace("x.level", F.lit("_"), F.lit(" "))
    notes = F.when(F.coalesce("x.notes", F.lit("")) != "", F.concat(F.lit(". "), "x.notes")).otherwise("")
    return e.select(
        F.concat(F.lit("exam:"), text.slugify("title")).alias("id"), F.lit("exam").alias("type"), "title",
        F.concat(F.initcap(level), F.lit(" exam"), notes).alias("description"),
    )


def seeded(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``nodes`` and those seeds whose id is new; doing it again adds nothing."""
    return nodes.unionByName(seeds.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


def facts_of(facts: DataFrame, node_id: str) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return facts.filter(F.col("id") == node_id).select("facts")


def judge_band(spark: SparkSession, path: str, default: float = 0.8) -> float:
    """The band that a calibration report recommends; ``default`` only where
    there is no report, and an error where there is one without a band."""
    if not exists(spark, path):
        return default
    row = spark.read.schema("recommended_judge_band double").option("multiLine", True).json(path).first()
    if row is None or row.recommended_judge_band is None:
        raise ValueError(f"no recommended_judge_band in {path}")
    return row.recommended_judge_band


def previous_audit(spark: SparkSession, path: str) -> DataFrame:
    """Checks of the last audit; none where the report is missing or broken."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.AUDIT)
    raw = spark.read.schema(f"checks array<struct<{schemas.AUDIT.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.explode("checks").alias("c")).select("c.*")


def failures(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, "stage string, node_id string, error string").filter(
        "stage = 'enrichment' AND node_id IS NOT NULL"
    ).distinct()


def table_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, n) of Parquet tables; 0 for one that cannot be read."""
    known = {}
    for name, path in paths.items():
        try:
            known[name] = spark.read.parquet(path)
        except AnalysisException:
            known[name] = spark.range(0)
    return row_counts(**known)


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of several tables in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
