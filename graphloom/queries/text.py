"""Titles and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import pages, text
from ..operators import resolve
from ..plans import star
from ..plans.star import oracle
from ..schemas import ABBREVIATIONS, BARE_GENERICS, LEVEL_TOKENS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def sql_slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def sql_norm(c: str) -> str:
    padded = f"(' ' || trim(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ')"
    spelled = reduce(lambda t, kv: f"replace({t}, ' {kv[0]} ', ' {kv[1]} ')", ABBREVIATIONS, padded)
    return f"trim(regexp_replace({spelled}, '\\s+', ' ', 'g'))"


#: Part names in many spellings, by size of the part.
SPELL = """CASE p_size % 6 WHEN 0 THEN 'Sr. ' || p_name || ' & Govt. ' || p_type WHEN 1 THEN upper(p_name) || ' (M.Tech)' WHEN 2 THEN p_name || ' Govt Govt Dept.'
  WHEN 3 THEN 'Junior ' || p_name || ' | Associate ' || p_type WHEN 4 THEN p_name || ' Ph.D' ELSE p_name || ' or ' || p_type END"""
WORD = """CASE p_size % 5 WHEN 0 THEN 'Ph.D.' WHEN 1 THEN 'Masters' WHEN 2 THEN 'Research' WHEN 3 THEN p_name ELSE 'Higher  Studies..' END"""


def _parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", "p_name", "p_type", "p_size", F.expr(SPELL).alias("title"), F.expr(WORD).alias("word"))


@query(oracle(f"SELECT id, {sql_slug('title')} AS slug FROM star_nodes"))
def slugify_titles(spark, sf_dir):
    return star.nodes(spark, sf_dir).select("id", text.slugify("title").alias("slug"))


@query(f"SELECT p_partkey, {sql_norm('title')} AS norm FROM (SELECT p_partkey, {SPELL} AS title FROM part)")
def normalize_titles(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", text.normalize_title("title").alias("norm"))


@query(f"""SELECT p_partkey, len(ps) >= 2 AND len(list_filter(ps, lambda p: length(p) < 8)) = 0 AS aggregate FROM (
  SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(regexp_replace(title, '\\([^)]*\\)', '', 'g'), '\\|| or '), lambda p: trim(p)), lambda p: p <> '') AS ps
  FROM (SELECT p_partkey, {SPELL} AS title FROM part))""")
def aggregate_titles(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", text.looks_aggregate("title").alias("aggregate"))


@query(f"""SELECT p_partkey, {sql_norm('word')} IN ({', '.join(f"'{g}'" for g in BARE_GENERICS)}) AS generic,
  regexp_replace(word, '\\.+$', '') || ' in ' || trim(regexp_replace(p_type, ' *\\([^)]*\\)', '', 'g')) AS qualified
FROM (SELECT p_partkey, p_type, {WORD.replace('p_name', 'part.p_name')} AS word FROM part)""")
def generic_titles(spark, sf_dir):
    return _parts(spark, sf_dir).select(
        "p_partkey", text.is_bare_generic("word").alias("generic"), text.qualified_title("word", "p_type").alias("qualified"))


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split({sql_norm('title')}, ' '),
  lambda t: t IN ({', '.join(f"'{t}'" for t in LEVEL_TOKENS)})))), ' ') AS levels FROM (SELECT p_partkey, {SPELL} AS title FROM part)""")
def level_tokens(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(text.level_tokens("title"), " ").alias("levels"))


@query(f"""WITH c AS (SELECT p_partkey AS case_id, 'part:' || {sql_slug('p_name')} AS base FROM part),
w AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY case_id) AS nth FROM c),
t AS (SELECT DISTINCT base, length(base) % 2 = 0 AS one, length(base) % 3 = 0 AS two FROM c),
a AS (SELECT w.*, one, two, nth + CASE WHEN one THEN 1 ELSE 0 END AS n1 FROM w JOIN t USING (base))
SELECT case_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS minted_id FROM (
  SELECT *, n1 + CASE WHEN two AND n1 >= 2 THEN 1 ELSE 0 END AS n FROM a)""")
def mint_ids(spark, sf_dir):
    """Ids for all parts where some bases, and some second numbers, are taken."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("case_id"), F.lit("part").alias("type"), F.col("p_name").alias("title"))
    base = p.select(F.concat(F.lit("part:"), text.slugify("title")).alias("id")).distinct()
    taken = base.filter(F.char_length("id") % 2 == 0).unionByName(
        base.filter(F.char_length("id") % 3 == 0).select(F.concat("id", F.lit("-2")).alias("id")))
    return resolve.mint_ids(p, taken)


@query(oracle("""SELECT id, upper(substr(type, 1, 1)) || substr(type, 2) AS label, replace(substr(id, strpos(id, ':') + 1), '-', ' ') AS readable,
  '/explore/' || type || '/' || substr(id, strpos(id, ':') + 1) || '?from=market%3Aall' AS href,
  type || ': ' || title || ' — ' || substr(repeat(title || ' ', 40), 1, 160) AS embedding_text,
  CASE WHEN length(title) > 80 THEN 'small' WHEN length(title) > 40 THEN 'medium' ELSE 'large' END AS font FROM star_nodes"""))
def labels_and_links(spark, sf_dir):
    n = star.nodes(spark, sf_dir)
    return n.select(
        "id", text.humanize("type").alias("label"), text.readable_id("id").alias("readable"),
        text.explore_href("id", F.lit("market:all")).alias("href"),
        text.embedding_text("type", "title", F.repeat(F.concat("title", F.lit(" ")), 40)).alias("embedding_text"),
        text.font_bucket("title").alias("font"),
    )


@query(oracle("""SELECT id, 'Explore paths around ' || title || ' — example.org' AS page_title,
  'Explore routes into and career options after ' || title || '.' AS description, 'noindex, follow' AS robots,
  '/careers/' || substr(id, 1, strpos(id, ':') - 1) || '/' || substr(id, strpos(id, ':') + 1) AS canonical FROM star_nodes"""))
def explorer_pages(spark, sf_dir):
    return pages.explorer_metadata(star.nodes(spark, sf_dir), "example.org")


@query("""WITH p AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN p_brand ELSE replace(p_type, ' ', '/ ') || '/' || p_brand END AS context FROM part)
SELECT p_partkey, p_name || ' — context: ' || CASE WHEN coalesce(context, '') = '' THEN ''
  WHEN strpos(context, '/') = 0 THEN context ELSE string_split(context, '/')[-2] || ' / ' || string_split(context, '/')[-1] END AS pair_text FROM p""")
def pair_texts(spark, sf_dir):
    k = F.col("p_partkey") % 5
    long = F.concat(F.replace("p_type", F.lit(" "), F.lit("/ ")), F.lit("/"), "p_brand")
    context = F.when(k == 0, "").when(k == 2, F.col("p_brand")).when(k > 2, long)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.pair_text("p_name", context).alias("pair_text"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS shown FROM orders""")
def long_dates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", text.long_date("o_orderdate").alias("shown"))




def _levels(c: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in LEVEL_TOKENS)
    return f"list_sort(list_distinct(list_filter(string_split({sql_norm(c)}, ' '), lambda t: t IN ({tokens}))))"


def _aggregate(c: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({c}, '\\([^)]*\\)', '', 'g'), '\\|| or '), lambda p: trim(p)), lambda p: p <> '')"
    return f"(len({parts}) >= 2 AND len(list_filter({parts}, lambda p: length(p) < 8)) = 0)"


_GENERIC = ", ".join(f"'{g}'" for g in BARE_GENERICS)


@query(f"""WITH t AS (SELECT p_partkey, p_brand, {SPELL} AS title FROM part),
p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand = b.p_brand AS same, a.title AS x, b.title AS y FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1)
SELECT a, b, CASE WHEN rule IN (1, 2) THEN 'same_role' WHEN rule = 10 THEN 'excluded' ELSE 'distinct' END AS decision, CAST(rule AS INTEGER) AS rule FROM (
  SELECT a, b, CASE WHEN same AND {sql_slug('x')} = {sql_slug('y')} THEN 1
    WHEN same AND list_sort(string_split({sql_slug('x')}, '-')) = list_sort(string_split({sql_slug('y')}, '-')) THEN 2
    WHEN {sql_norm('x')} IN ({_GENERIC}) OR {sql_norm('y')} IN ({_GENERIC}) THEN 6
    WHEN {_levels('x')} <> {_levels('y')} THEN 7 WHEN {_aggregate('x')} OR {_aggregate('y')} THEN 10 WHEN NOT same THEN 11 ELSE 12 END AS rule FROM p)""")
def rubric_decisions(spark, sf_dir):
    """The rubric's mechanical rules on each part and the next."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.expr(SPELL).alias("title"))
    a = p.select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("ta"), F.col("title").alias("x"), (F.col("p_partkey") + 1).alias("b"))
    b = p.select(F.col("p_partkey").alias("b"), F.col("p_brand").alias("tb"), F.col("title").alias("y"))
    said = pages.rubric(F.col("ta"), F.col("x"), F.col("tb"), F.col("y"))
    return a.join(b, "b").select("a", "b", said.alias("r")).select("a", "b", "r.decision", "r.rule")


@query(oracle("""SELECT id, title || ' | example.org' AS page_title,
  array_to_string(list_append(list_prepend(title, aliases), upper(substr(type, 1, 1)) || substr(type, 2)), ', ') AS keywords,
  'https://example.org/careers/' || type || '/' || substr(id, strpos(id, ':') + 1) AS canonical FROM star_nodes"""))
def page_metadata(spark, sf_dir):
    return pages.metadata(star.nodes(spark, sf_dir), "example.org")


@query(oracle("""SELECT n.id, coalesce(p.t, '[]') AS parents, coalesce(c.t, '[]') AS children FROM star_nodes n
LEFT JOIN (SELECT id, '[' || string_agg('"' || title || '"', ',' ORDER BY k) || ']' AS t FROM (
  SELECT e.to_id AS id, n.title, row_number() OVER (PARTITION BY e.to_id ORDER BY n.title, n.id) AS k FROM star_edges e JOIN star_nodes n ON n.id = e.from_id) WHERE k <= 12 GROUP BY id) p ON p.id = n.id
LEFT JOIN (SELECT id, '[' || string_agg('"' || title || '"', ',' ORDER BY k) || ']' AS t FROM (
  SELECT e.from_id AS id, n.title, row_number() OVER (PARTITION BY e.from_id ORDER BY n.title, n.id) AS k FROM star_edges e JOIN star_nodes n ON n.id = e.to_id) WHERE k <= 12 GROUP BY id) c ON c.id = n.id"""))
def prompt_neighbours(spark, sf_dir):
    """The first twelve titles (a prompt's limit) on either side of a node."""
    return pages.neighbour_titles(star.nodes(spark, sf_dir), star.edges(spark, sf_dir))


@query("""SELECT o_orderkey, '{"@context":"https://schema.org","@type":"Article","headline":"' || o_orderpriority || '","datePublished":"' || strftime(o_orderdate, '%Y-%m-%d') || '","dateModified":"' ||
  CASE WHEN o_orderkey % 2 = 0 THEN '2026-07-19' ELSE strftime(o_orderdate, '%Y-%m-%d') END || '"}' AS json FROM orders""")
def article_json(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    changed = F.when(F.col("o_orderkey") % 2 == 0, "2026-07-19")
    return o.select("o_orderkey", pages.article(F.col("o_orderpriority"), day, changed, F.lit("2026-01-01")).alias("json"))


@query("""SELECT p_partkey, CAST(round(least(greatest(p_size * 20.0::DOUBLE * least(1.0::DOUBLE, 660.0::DOUBLE / (p_size * 30.0::DOUBLE)), 240.0::DOUBLE), 520.0::DOUBLE)) AS INTEGER) AS height FROM part""")
def pane_heights(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", pages.pane_height(F.col("p_size") * 30.0, F.col("p_size") * 20.0).alias("height"))
