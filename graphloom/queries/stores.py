"""Kept stores, ledgers and release gates over facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lint, service
from ..runtime import scratch_path
from ..sources import readers, stores, writers
from .resolution import VEC, _vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


@query(f"""WITH {VEC} SELECT q_id, id, rank, round(s, 4) AS score FROM (
  SELECT CAST(a.vec_id AS VARCHAR) AS q_id, CAST(b.vec_id AS VARCHAR) AS id, list_cosine_similarity(a.e, b.e) AS s,
    CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS INTEGER) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 50 = 0) WHERE rank <= 5""")
def stored_neighbours(spark, sf_dir):
    """The neighbours of a stated set of vectors in a store that was filled by
    three appends, the last of which brings nothing new."""
    v = _vectors(spark, sf_dir)
    path = scratch_path(spark, "vector-store")
    for part in (v.filter("id % 3 = 0"), v.filter("id % 3 <> 0"), v.filter("id % 2 = 0")):
        stores.append_vectors(part, path, block=256)
    found = stores.nearest_in_store(v.filter("id % 50 = 0"), path, 5, block=256)
    return found.select("q_id", "id", "rank", F.round("score", 4).alias("score"))


@query("""SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE source IN ('src0', 'src1')) THEN 'first ' ELSE 'second ' END || length(text) AS value
FROM documents WHERE text IS NOT NULL""")
def cached_answers(spark, sf_dir):
    """Every document's answer through a store that two sources filled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    keyed = docs.select("doc_id", "source", F.sha2("text", 256).alias("key"), F.char_length("text").alias("n"))
    path = scratch_path(spark, "answers")
    say = lambda word: lambda missing: missing.select("key", F.concat(F.lit(f"{word} "), F.col("n").cast("string")).alias("value"))
    stores.through_cache(keyed.filter("source IN ('src0', 'src1')"), path, say("first"))
    return stores.through_cache(keyed, path, say("second")).select("doc_id", "value")


@query("""SELECT 'part--' || p_partkey AS name, CASE WHEN p_size % 10 = 3 THEN p_brand ELSE p_name END AS body FROM part WHERE p_size % 10 <> 7
UNION ALL SELECT 'changed', CAST(count(*) AS VARCHAR) FROM part WHERE p_size % 10 IN (3, 7)
UNION ALL SELECT 'again', '0'""")
def document_sync(spark, sf_dir):
    """Documents brought up to date where a tenth changed and a tenth went,
    and once more where nothing did."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("name", F.concat(F.lit("part--"), F.col("p_partkey").cast("string")))
    path = scratch_path(spark, "documents")
    writers.sync_documents(p.select("name", F.col("p_name").alias("body")), path)
    new = p.filter("p_size % 10 <> 7").select("name", F.when(F.col("p_size") % 10 == 3, F.col("p_brand")).otherwise(F.col("p_name")).alias("body"))
    counts = [(label, str(writers.sync_documents(new, path))) for label in ("changed", "again")]
    return spark.read.parquet(path).select("name", "body").unionByName(spark.createDataFrame(counts, "name string, body string"))


@query("""SELECT source AS model, count(*) AS n, CAST(sum(CASE WHEN length(text) % 7 = 3 THEN 2 ELSE 1 END * (length(text) // 4)) AS BIGINT) AS usage_tokens
FROM documents WHERE text IS NOT NULL AND length(text) % 5 <> 0 GROUP BY source""")
def usage_ledger(spark, sf_dir):
    """Tokens by source of a service that some requests ask twice, and that
    fails for others; the ledger is a file of JSON lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL").select(F.col("doc_id").alias("key"), "source", F.col("text").alias("request"))

    def count(request: str) -> tuple[str, int]:
        asked, _, again = request.partition("\n\nThe last answer was not valid")
        if len(asked) % 5 == 0:
            raise RuntimeError("refused")
        return ("odd" if len(asked) % 7 == 3 and not again else "fine"), len(asked) // 4

    answered = service.answers(docs, count, lambda a: "odd" if a == "odd" else None, stop_after=1 << 30, attempts=2, wait=0.0)
    path = scratch_path(spark, "usage")
    writers.append(service.usage_rows(answered, "offline", "lengths", "v1"), path)
    ledger = readers.json_lines(spark, path, "key long, provider string, model string, prompt_version string, usage_tokens long")
    named = ledger.drop("model").join(docs.select("key", F.col("source").alias("model")), "key")
    return service.usage_rollup(named, "model")


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'degree' WHEN 1 THEN 'exam' ELSE 'job_role' END AS type,
  CASE n_chars % 4 WHEN 0 THEN 'eligibility' WHEN 1 THEN 'duration' WHEN 2 THEN 'purpose' ELSE 'skills' END AS key, n_chars % 5 = 0 AS bare, n_chars % 7 = 0 AS bare_fact FROM documents)
SELECT rule, count(*) AS n, min(doc_id) AS first FROM (
  SELECT doc_id, 'section without sources' AS rule FROM d WHERE bare UNION ALL SELECT doc_id, 'quick fact without sources' FROM d WHERE bare_fact
  UNION ALL SELECT doc_id, 'unsupported section' FROM d WHERE NOT ((type = 'degree' AND key IN ('eligibility', 'duration')) OR (type = 'exam' AND key IN ('eligibility', 'purpose')) OR (type = 'job_role' AND key = 'skills')))
GROUP BY rule""")
def fact_gates(spark, sf_dir):
    """What keeps the documents' sections, as facts, from a release."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int"))
    urls = lambda none: F.when(none, F.array().cast("array<string>")).otherwise(F.array(F.lit("https://example.org/")))
    facts = F.struct(
        F.array(F.struct(F.lit("length").alias("label"), urls(F.col("n_chars") % 7 == 0).alias("source_urls"))).alias("quick_facts"),
        F.array(F.struct(pick(("eligibility", "duration", "purpose", "skills"), F.col("n_chars") % 4).alias("key"), urls(F.col("n_chars") % 5 == 0).alias("source_urls"))).alias("sections"),
    )
    rows = d.select(F.col("doc_id").alias("node_id"), pick(("degree", "exam", "job_role"), F.col("doc_id") % 3).alias("type"), facts.alias("facts"))
    return lint.fact_gates(rows).groupBy("rule").agg(F.count("*").alias("n"), F.min(F.col("subject").cast("long")).alias("first"))


@query("SELECT DISTINCT 'doc-' || doc_id AS node_id, CASE WHEN quality = 1 THEN 'thin' ELSE 'late' END AS error FROM labels WHERE toxic = 1")
def failure_ledger(spark, sf_dir):
    """Failures appended to a ledger in two goes, one of them twice, among
    rows of other stages and rows without a node."""
    l = spark.read.parquet(f"{sf_dir}/labels.parquet")
    path = scratch_path(spark, "failures")
    rows = l.select(
        F.when(F.col("toxic") == 1, "enrichment").otherwise("audit").alias("stage"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("node_id"),
        F.when(F.col("quality") == 1, "thin").otherwise("late").alias("error"))
    for part in (rows.filter("error = 'thin'"), rows, rows.withColumn("node_id", F.lit(None).cast("string"))):
        writers.append(part, path)
    return readers.failures(spark, path).select("node_id", "error")
