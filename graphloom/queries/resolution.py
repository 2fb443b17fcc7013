"""Entity resolution over parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import resolve
from .text import sql_norm

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("vec_id").alias("pos"))


COS = "round(CASE WHEN list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e) = 0 THEN 0 ELSE list_cosine_similarity(a.e, b.e) END, 4)"
VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _nearest_sql(k: int, join: str) -> str:
    return f"""WITH {VEC} SELECT q_id, id, rank, round(s, 4) AS score FROM (
  SELECT a.vec_id AS q_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s,
    CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS INTEGER) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND {join}) WHERE rank <= {k}"""


@query(_nearest_sql(5, "a.label = b.label"))
def knn_same_type(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return resolve.nearest(v, v, 5).select("q_id", "id", "rank", F.round("score", 4).alias("score"))


@query(_nearest_sql(100, "a.vec_id % 50 = 0"))
def knn_any_type(spark, sf_dir):
    """The hundred nearest of any type for a stated set of queries."""
    v = _vectors(spark, sf_dir)
    return resolve.nearest(v.filter("id % 50 = 0"), v, 100, same_type=False).select("q_id", "id", "rank", F.round("score", 4).alias("score"))


def _registry(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("type"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"), F.array("p_brand", "p_name").alias("aliases"), F.col("p_partkey").alias("pos"))


@query(f"""WITH s AS (SELECT p_partkey, unnest([p_name || ' ' || p_type, p_brand, p_name]) AS name FROM part),
i AS (SELECT {sql_norm('name')} AS norm, 'part:' || max(p_partkey) AS id FROM s GROUP BY 1)
SELECT o.o_orderkey AS case_id, i.id AS matched_id FROM (SELECT o_orderkey, upper(p_name) || CASE WHEN o_orderkey % 3 = 0 THEN ' & ' ELSE '  ' END || p_type AS title
  FROM orders JOIN part ON p_partkey = o_custkey) o LEFT JOIN i ON i.norm = {sql_norm('o.title')}""")
def exact_gate(spark, sf_dir):
    """Titles in other spellings, one an order, against the alias index."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    title = F.concat(F.upper("p_name"), F.when(F.col("o_orderkey") % 3 == 0, " & ").otherwise("  "), "p_type")
    cases = o.join(p, F.col("p_partkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("case_id"), F.lit("part").alias("type"), title.alias("title"))
    return resolve.exact_gate(cases, resolve.alias_index(_registry(spark, sf_dir))).select("case_id", "matched_id")


#: Registry: vectors with an odd id, named after their label; cases: the
#: even ones, some with a known title, some aggregates, the rest new.
CASE_TITLE = """CASE WHEN vec_id % 6 = 0 THEN 'VECTOR  ' || (vec_id + 1) || '!' WHEN vec_id % 10 = 4 THEN 'First long title ' || vec_id || ' | second long title'
  WHEN vec_id % 10 = 8 THEN 'Short ' || vec_id || '  |' || chr(9) || ' x ' ELSE 'Model ' || vec_id END"""


@query(f"""WITH {VEC}, reg AS (SELECT 'label' || label || ':' || vec_id AS id, 'label' || label AS type, 'Vector ' || vec_id AS title, vec_id, e FROM v WHERE vec_id % 2 = 1),
c0 AS (SELECT vec_id AS case_id, 'label' || label AS type, e, {CASE_TITLE} AS given FROM v WHERE vec_id % 2 = 0),
c AS (SELECT *, regexp_replace(trim(regexp_replace(given, '\\s+', ' ', 'g')), ' *\\| *', '/', 'g') AS title, contains(given, '|') AS piped, given LIKE 'First long%' AS agg FROM c0),
g AS (SELECT c.*, reg.id AS matched FROM c LEFT JOIN reg ON reg.type = c.type AND {sql_norm('reg.title')} = {sql_norm('c.title')}),
near AS (SELECT g.case_id, reg.id, list_cosine_similarity(g.e, reg.e) AS s, row_number() OVER (PARTITION BY g.case_id ORDER BY list_cosine_similarity(g.e, reg.e) DESC, reg.vec_id) AS k
  FROM g JOIN reg ON reg.type = g.type WHERE NOT agg AND matched IS NULL),
top AS (SELECT case_id, id, s FROM near WHERE k = 1 AND s >= 0.2),
o AS (SELECT g.*, CASE WHEN top.s >= 0.5 THEN top.id END AS linked, top.s FROM g LEFT JOIN top USING (case_id))
SELECT case_id, title, CASE WHEN agg THEN 'rejected_aggregate' WHEN matched IS NOT NULL THEN 'linked_exact' WHEN linked IS NOT NULL THEN 'linked_judge' ELSE 'minted' END AS action,
  CASE WHEN agg THEN NULL WHEN matched IS NOT NULL THEN matched WHEN linked IS NOT NULL THEN linked
    ELSE type || ':' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END AS node_id,
  NOT agg AND matched IS NULL AND linked IS NULL AND piped AS needs_review,
  CASE WHEN agg THEN NULL WHEN matched IS NOT NULL THEN 1.0::DOUBLE WHEN linked IS NOT NULL THEN round(s, 4) END AS score FROM o""")
def er_ladder(spark, sf_dir):
    """Half of the vectors resolved against the other half, with a judge that
    takes the nearest above a threshold."""
    return _decided(spark, sf_dir)[0].select("case_id", "title", "action", "node_id", "needs_review", "score")


def _decided(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("type", F.concat(F.lit("label"), "type"))
    reg = v.filter("id % 2 = 1").select(
        F.concat("type", F.lit(":"), F.col("id").cast("string")).alias("id"), "type", "vec", "pos",
        F.concat(F.lit("Vector "), F.col("id").cast("string")).alias("title"), F.array().cast("array<string>").alias("aliases"))
    cases = v.filter("id % 2 = 0").select(
        F.col("id").alias("case_id"), "type", "vec", F.expr(CASE_TITLE.replace("vec_id", "id")).alias("title"), F.lit("Parent").alias("parent_title"))
    return resolve.resolve(cases, reg.drop("vec"), reg, resolve.band_judge(0.5), band=0.2), reg, cases


THRESHOLDS = [round(0.05 * i, 2) for i in range(-20, 21)]
PAIRS = f"""WITH {VEC}, x AS (SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.label = b.label THEN 'same_role' ELSE 'distinct' END AS label,
  list_cosine_similarity(a.e, b.e) AS s, false AS exact FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"""


def _pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("title", F.concat(F.lit("Vector "), F.col("id").cast("string")))
    a, b = v.select(F.col("id").alias("a"), F.col("type").alias("ta")), v.select((F.col("id")).alias("b"), F.col("type").alias("tb"))
    pairs = a.join(b, F.col("b") == F.col("a") + 1).select(
        "a", "b", F.when(F.col("ta") == F.col("tb"), "same_role").otherwise("distinct").alias("label"))
    return resolve.similarity_rows(pairs, v)


@query(PAIRS + " SELECT a, b, label, round(s, 4) AS score, exact FROM x")
def similarity_rows(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("score", F.round("score", 4))


@query(PAIRS + f""" SELECT (SELECT max(t) FROM (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]::DOUBLE[]) AS t) WHERE t <= min(s) FILTER (label = 'same_role')) AS band,
  0::BIGINT AS missed, count(*) AS n_pairs, count(*) FILTER (label = 'same_role') AS n_same, count(*) FILTER (label = 'same_role') AS n_near FROM x""".replace("WHERE t <= min(s) FILTER (label = 'same_role')", "WHERE t <= (SELECT min(s) FROM x WHERE label = 'same_role')"))
def er_calibration(spark, sf_dir):
    return resolve.calibrate(_pairs(spark, sf_dir), THRESHOLDS)


@query("""WITH t AS (SELECT doc_id, source, sha256('{"dims":64,"model":"m","text":"' || sha256(text) || '"}') AS key FROM documents)
SELECT doc_id, key FROM t WHERE key NOT IN (SELECT key FROM t WHERE source IN ('src0', 'src1'))""")
def embedding_cache_misses(spark, sf_dir):
    """Documents whose text no document of two cached sources has."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    key = text.cache_key(text="digest", model=F.lit("m"), dims=F.lit(64))
    cache = d.filter("source IN ('src0', 'src1')").select(key.alias("key")).distinct()
    return resolve.cache_misses(d, cache, key).select("doc_id", "key")
