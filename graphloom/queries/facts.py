"""Fact documents, citations and audits over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import normalize_domain_url, normalize_url
from ..operators import facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


URL = """u AS (SELECT page_id, url, regexp_extract(trim(url), '^(?i)(https?)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$', ['scheme', 'auth', 'path', 'query', 'frag']) AS m FROM pages),
n AS (SELECT page_id, url, lower(m.scheme) || '://' || lower(regexp_replace(m.auth, ':\\d*$', '')) || regexp_extract(m.auth, ':(\\d+)$') ||
  CASE WHEN m.path = '' THEN '/' ELSE m.path END || CASE WHEN length(m.query) > 1 THEN m.query ELSE '' END AS norm,
  lower(regexp_replace(m.auth, ':\\d*$', '')) AS host FROM u)"""


def _pages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return p.withColumn("norm", normalize_domain_url("url")).withColumn("host", F.regexp_extract("norm", "^https?://([^/:]+)", 1))


@query(f"WITH {URL} SELECT page_id, norm FROM n")
def normalize_urls(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "norm")


@query(f"WITH {URL} SELECT page_id, norm FROM n")
def normalize_urls_any(spark, sf_dir):
    """The same through the standard library, which knows addresses too."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", normalize_url("url").alias("norm"))


@query(f"""WITH {URL}, parts AS (SELECT host AS node_id, page_id * 2 AS pos, norm AS url FROM n UNION ALL SELECT host, page_id * 2 + 1, 'https://' || host || '/' FROM n),
f AS (SELECT node_id, url, min(pos) AS pos FROM parts GROUP BY ALL)
SELECT node_id, count(*) AS n, string_agg(url, ' ' ORDER BY pos) AS urls FROM f GROUP BY node_id""")
def citations_per_node(spark, sf_dir):
    """Distinct citations of each host in order of first use."""
    p = _pages(spark, sf_dir)
    home = F.concat(F.lit("https://"), "host", F.lit("/"))
    parts = p.select(F.col("host").alias("node_id"), F.col("page_id").alias("pos"), F.array("norm", home).alias("urls"))
    return facts.citations(parts).select("node_id", F.size("urls").cast("long").alias("n"), F.array_join("urls", " ").alias("urls"))


@query(f"""WITH {URL} SELECT DISTINCT url FROM (SELECT norm AS url FROM n WHERE ('2026-0' || (page_id % 9 + 1) || '-01') >= '2026-04-01'
  UNION ALL SELECT 'https://' || host || '/' FROM n)""")
def collect_urls(spark, sf_dir):
    p = _pages(spark, sf_dir)
    reviewed = F.concat(F.lit("2026-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("-01"))
    docs = p.select(reviewed.alias("last_reviewed"), F.array("norm").alias("urls"))
    edges = p.select(F.array(F.concat(F.lit("https://"), "host", F.lit("/"))).alias("urls"))
    return facts.collect_urls(docs, edges, since="2026-04-01")


STATUS = "[200, 301, 401, 404, 410, 500][page_id % 6 + 1]"


def _audit(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 301, 401, 404, 410, 500)]), (F.col("page_id") % 6 + 1).cast("int"))
    return facts.classify(_pages(spark, sf_dir).select("page_id", F.col("norm").alias("url"), status.alias("status"), F.lit(None).cast("string").alias("error")))


@query(f"""WITH {URL} SELECT page_id, norm AS url, CAST({STATUS} AS INTEGER) AS status, {STATUS} IN (200, 301, 401) AS reachable, {STATUS} IN (404, 410) AS definitive_failure FROM n""")
def audit_classify(spark, sf_dir):
    return _audit(spark, sf_dir).select("page_id", "url", "status", "reachable", "definitive_failure")


@query(f"""WITH {URL}, prev AS (SELECT norm AS url, bool_or({STATUS} IN (200, 301, 401)) AS ok FROM n WHERE length(norm) % 4 <> 0 GROUP BY norm),
cur AS (SELECT DISTINCT norm AS url FROM n WHERE length(norm) % 5 <> 0)
SELECT url, CASE WHEN url IN (SELECT url FROM prev WHERE ok) THEN 'carried' ELSE 'audit' END AS state FROM cur""")
def audit_incremental(spark, sf_dir):
    """Which of the current URLs an earlier audit has proven."""
    rows = _audit(spark, sf_dir)
    prev = rows.filter(F.char_length("url") % 4 != 0).groupBy("url").agg(
        F.bool_or("reachable").alias("reachable")).withColumn("definitive_failure", F.lit(False))
    current = rows.filter(F.char_length("url") % 5 != 0).select("url").distinct()
    todo, carried = facts.split_incremental(current, prev)
    return todo.select("url", F.lit("audit").alias("state")).unionByName(carried.select("url", F.lit("carried").alias("state")))


@query("""WITH s AS (SELECT doc_id, ['degree', 'exam', 'job_role'][doc_id % 3 + 1] AS type, ['eligibility', 'duration', 'purpose', 'skills'][n_chars % 4 + 1] AS key,
  CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE source END AS heading, text AS body, n_chars % 5 AS cites, CASE WHEN doc_id % 11 = 0 THEN '2026-13-40' ELSE '2026-07-19' END AS day FROM documents)
SELECT node_id, rule FROM (
  SELECT doc_id AS node_id, 'unsupported section' AS rule FROM s WHERE NOT ((type = 'degree' AND key IN ('eligibility', 'duration')) OR (type = 'exam' AND key IN ('eligibility', 'purpose')) OR (type = 'job_role' AND key = 'skills'))
  UNION ALL SELECT doc_id, 'empty heading' FROM s WHERE trim(heading) = '' UNION ALL SELECT doc_id, 'no prose' FROM s WHERE trim(body) = ''
  UNION ALL SELECT doc_id, 'uncited section' FROM s WHERE cites = 0 UNION ALL SELECT doc_id, 'bad date' FROM s WHERE day = '2026-13-40')""")
def facts_violations(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int"))
    return facts.section_violations(d.select(
        F.col("doc_id").alias("node_id"), pick(("degree", "exam", "job_role"), F.col("doc_id") % 3).alias("type"),
        pick(("eligibility", "duration", "purpose", "skills"), F.col("n_chars") % 4).alias("key"),
        F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("source")).alias("heading"), F.col("text").alias("body"),
        F.array_repeat(F.lit("https://example.org/"), (F.col("n_chars") % 5).cast("int")).alias("source_urls"),
        F.when(F.col("doc_id") % 11 == 0, "2026-13-40").otherwise("2026-07-19").alias("last_reviewed"),
    ))


@query("""SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def enrichment_candidates(spark, sf_dir):
    """Documents without a good label and without a failure (a toxic label)."""
    d, l = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = l.filter("quality = 1").select("doc_id", F.lit(True).alias("g")).distinct()
    nodes = d.join(good, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("g", F.lit(False)).alias("has_facts"))
    failed = l.filter("toxic = 1").select(F.lit("enrichment").alias("stage"), F.col("doc_id").alias("node_id"))
    return facts.enrichment_candidates(nodes, failed)
