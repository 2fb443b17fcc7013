"""Sources, sinks, gates, prompts and ledgers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages, text
from ..operators import expand, facts, graph, lint, resolve, snapshot
from ..plans import star
from ..plans.star import ROOT, oracle
from ..runtime import scratch_path
from ..sources import readers, writers
from . import resolution

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def _saved(spark, sf_dir):
    """The star graph as registry files, each node twice: the last one counts."""
    n = star.nodes(spark, sf_dir)
    nodes, edges = scratch_path(spark, "registry-nodes"), scratch_path(spark, "registry-edges")
    twice = n.withColumn("title", F.concat("title", F.lit(" (old)"))).withColumn("no", F.lit(0)).unionByName(n.withColumn("no", F.lit(1)))
    twice.coalesce(1).sortWithinPartitions("no").drop("no").write.option("ignoreNullFields", "true").json(nodes)
    writers.save_sorted(star.edges(spark, sf_dir), edges)
    return readers.registry(spark, nodes, edges)


@query(oracle("SELECT id, title, 'n' AS kind, len(aliases) AS size FROM star_nodes UNION ALL SELECT id, to_id, 'e', 0 FROM star_edges"))
def registry_round_trip(spark, sf_dir):
    n, e = _saved(spark, sf_dir)
    return n.select("id", "title", F.lit("n").alias("kind"), F.size("aliases").cast("long").alias("size")).unionByName(
        e.select("id", F.col("to_id").alias("title"), F.lit("e").alias("kind"), F.lit(0).cast("long").alias("size")))


@query(oracle("""SELECT id, type, title, substr(id, strpos(id, ':') + 1) AS slug, CASE WHEN length(title) % 2 = 0 THEN title END AS fact FROM star_nodes"""))
def snapshot_round_trip(spark, sf_dir):
    """Core nodes without their facts, read back, with the facts put on again."""
    n = star.nodes(spark, sf_dir).withColumn("facts", F.when(F.char_length("title") % 2 == 0, F.struct("title")))
    path = scratch_path(spark, "snapshot")
    writers.write_snapshot(n, star.edges(spark, sf_dir), path, "2020-01-01")
    core, _ = writers.read_snapshot(spark, path)
    return snapshot.with_facts(core, n.filter("facts IS NOT NULL")).select("id", "type", "title", "slug", F.col("facts.title").alias("fact"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 7 <> 0""")
def keyed_upsert(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.filter("k % 3 = 0 AND k % 7 <> 0").withColumn("v", F.col("v") * 2)
    return writers.upsert(o, new, ["k"], o.filter("k % 7 = 0"))


@query("""SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'absent', 0""")
def counts_with_a_missing_table(spark, sf_dir):
    return readers.table_counts(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "absent")})


LOOKED_UP = """w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 4 WHEN 0 THEN 'supplier' WHEN 1 THEN 'Part' ELSE 'part' END AS type,
  CASE l_linenumber % 4 WHEN 0 THEN CAST(l_suppkey AS VARCHAR) WHEN 2 THEN l_partkey || 'x' ELSE CAST(l_partkey AS VARCHAR) END AS slug FROM lineitem)"""


@query(oracle("""SELECT l_orderkey, l_linenumber, w.type, slug, n.id AS node_id, n.title, CASE WHEN length(n.title) % 2 = 0 THEN n.title END AS fact
FROM w LEFT JOIN star_nodes n ON n.id = w.type || ':' || w.slug AND n.type = w.type""", LOOKED_UP))
def node_lookups(spark, sf_dir):
    """Nodes and their documents by type and slug for every line of an order:
    its part, its supplier, a type that differs by case, or a slug of none."""
    line = F.col("l_linenumber") % 4
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.when(line == 0, "supplier").when(line == 1, "Part").otherwise("part").alias("type"),
        F.when(line == 0, F.col("l_suppkey").cast("string")).when(line == 2, F.concat("l_partkey", F.lit("x")))
        .otherwise(F.col("l_partkey").cast("string")).alias("slug"),
    )
    n = star.nodes(spark, sf_dir)
    kept = snapshot.documents(n.withColumn("facts", F.when(F.char_length("title") % 2 == 0, F.struct("title"))))
    return snapshot.facts_at(graph.by_route(wanted, n), n, kept).select(
        "l_orderkey", "l_linenumber", "type", "slug", "node_id", "title", F.col("facts.title").alias("fact"))


@query(f"""SELECT band AS judge_band, missed AS missed_duplicates, n_pairs AS labeled_pairs, 'trained here' AS provider
FROM ({resolution.ORACLES["er_calibration"]})""")
def er_report(spark, sf_dir):
    """A calibration's report, written, and what a later run reads of it."""
    path = scratch_path(spark, "report")
    done = resolve.calibrate(resolution._pairs(spark, sf_dir), resolution.THRESHOLDS)
    writers.write_report(resolve.report(done, provider="trained here"), path)
    again = readers.json_lines(spark, path, "missed_duplicates long, labeled_pairs long, provider string")
    return again.select(F.lit(readers.judge_band(spark, path)).alias("judge_band"), "missed_duplicates", "labeled_pairs", "provider")


GATES = """g AS (SELECT id, type, length(title) % 2 = 0 AS has FROM star_nodes WHERE type <> 'market'),
gates AS (SELECT 'root is missing' AS rule, 'market:all' AS subject
  UNION ALL SELECT 'missing facts', id FROM g WHERE NOT has
  UNION ALL SELECT 'frontier work left', id FROM g WHERE type = 'nation'
  UNION ALL SELECT 'unresolved failure', id FROM g WHERE type = 'region')"""


@query(oracle("SELECT rule, count(*) AS n, min(subject) AS first FROM gates GROUP BY rule", GATES))
def release_gates(spark, sf_dir):
    """A release without its root, some facts, with work and failures left."""
    n = star.nodes(spark, sf_dir).filter("type <> 'market'").withColumn("facts", F.when(F.char_length("title") % 2 == 0, F.struct("title")))
    frontier = n.filter("type IN ('nation', 'customer')").select(
        "id", F.when(F.col("type") == "nation", 2).otherwise(4).alias("depth"), F.lit(False).alias("expanded"))
    failed = n.filter("type = 'region'").select(F.col("id").alias("node_id"))
    gates = lint.release_gates(n, ROOT, frontier, failed)
    return gates.groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("first"))


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey // 2 END AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders),
v AS (SELECT 'repeated key' AS rule, coalesce(CAST(k AS VARCHAR), 'null') AS subject FROM o GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT 'null in k', 'null' FROM o WHERE k IS NULL
  UNION ALL SELECT 'null in s', coalesce(CAST(k AS VARCHAR), 'null') FROM o WHERE s IS NULL
  UNION ALL SELECT 'price', coalesce(CAST(k AS VARCHAR), 'null') FROM o WHERE NOT p < 200000)
SELECT rule, count(*) AS n, max(subject) AS last FROM v GROUP BY rule""")
def table_constraints(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_orderkey") / 2)).alias("k"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("s"), F.col("o_totalprice").alias("p"))
    found = lint.constraints(o, ["k"], ["s"], {"price": "p < 200000"})
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.max("subject").alias("last"))


@query("""SELECT 'documents' AS subject FROM (SELECT count(*) AS n FROM documents) WHERE n > 0""")
def reset_conditions(spark, sf_dir):
    """Which of three tables a reset should have left empty still hold rows."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lint.not_empty(documents=d, none=d.filter("doc_id < 0"), far=d.filter("n_chars < 0")).select("subject")


@query("""WITH d AS (SELECT doc_id, doc_id % 12 AS k FROM documents)
SELECT 'n' || doc_id AS node_id, rule FROM (
  SELECT doc_id, unnest(CASE k WHEN 1 THEN ['schema version'] WHEN 2 THEN ['bad date'] WHEN 3 THEN ['unknown key'] WHEN 4 THEN ['uncited section']
    WHEN 5 THEN ['uncited quick fact'] WHEN 6 THEN ['bad link'] WHEN 7 THEN ['no prose'] WHEN 8 THEN ['provenance'] WHEN 9 THEN ['unsupported section']
    WHEN 10 THEN ['unknown key in sections'] WHEN 11 THEN ['no sections'] ELSE [] END) AS rule FROM d)""")
def document_violations(spark, sf_dir):
    """Fact documents made from the documents' ids, each with one fault or none."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("doc_id") % 12).alias("k"))
    body = """concat('{"schema_version":', if(k = 1, '2', '1'), ',"last_reviewed":"', if(k = 2, '2024-13-01', '2024-05-01'), '"', if(k = 3, ',"more":1', ''),
      ',"quick_facts":[{"label":"l","value":"v","source_urls":[', if(k = 5, '', '"https://a.example.org/x"'), ']}]',
      ',"sections":[', if(k = 11, '', concat('{"key":"', if(k = 9, 'format', 'duration'), '","heading":"h","paragraphs":[', if(k = 7, '', '"p"'), '],"bullets":[]',
      if(k = 10, ',"tone":"x"', ''), ',"source_urls":[', if(k = 4, '', '"https://a.example.org/y"'), ']}')), ']',
      ',"useful_links":[{"label":"l","url":"', if(k = 6, 'http://localhost/', 'https://a.example.org/'), '","kind":"k"}]',
      ',"prov":{"model":"', if(k = 8, 'other', 'm'), '","prompt_version":"1","generated_at":"2024-05-01"}}')"""
    made = d.select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("node_id"), F.lit("degree").alias("type"), F.expr(body).alias("body"))
    return facts.document_violations(made, "m", "1")


@query("""WITH RECURSIVE w AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation) SELECT a, b, a <> b AS kept FROM w""")
def edge_inserts(spark, sf_dir):
    """Edges between nations, inserted twice, loops left out."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    ends = n.select(F.col("a").cast("string").alias("from_id"), F.col("b").cast("string").alias("to_id"), F.lit("progression").alias("edge_type"), F.lit(0).alias("pos"))
    none = ends.limit(0).withColumn("id", F.lit("")).select("id", "from_id", "to_id", "edge_type", "pos")
    once = graph.insert_edges(none, ends)
    again = graph.insert_edges(once, ends)
    kept = again.select(F.col("from_id").cast("long").alias("a"), F.lit(True).alias("kept"))
    return n.join(kept, "a", "left").select("a", "b", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(oracle("""SELECT e.from_id AS node_id, count(*) AS n, min(e.id) AS first, max(e.id) AS last FROM star_edges e GROUP BY e.from_id"""))
def adjacency_lists(spark, sf_dir):
    lists = graph.adjacency(star.edges(spark, sf_dir))
    return lists.select("node_id", F.size("edges").cast("long").alias("n"), F.col("edges")[0]["id"].alias("first"), F.element_at("edges", -1)["id"].alias("last"))


@query("""SELECT 'part:' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_brand || ',Kind ' || p_type ELSE p_brand END AS aliases FROM part""")
def alias_surfaces(spark, sf_dir):
    """A known surface, the node's own title and a new one, added to parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("aliases"), "p_size", "p_type")
    more = n.select("id", F.explode(F.array(F.col("aliases")[0], F.concat(F.upper("title"), F.lit("!")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Kind "), "p_type")))).alias("surface"))
    out = resolve.new_aliases(more.filter("surface IS NOT NULL"), n)
    return out.select("id", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query(oracle("""SELECT id, type AS kind, substr(id, strpos(id, ':') + 1) AS slug, replace(substr(id, strpos(id, ':') + 1), '-', ' ') AS guessed FROM star_nodes WHERE type = 'nation'"""))
def id_parts(spark, sf_dir):
    """Point lookups by type and slug: an id taken apart and put together."""
    n = star.nodes(spark, sf_dir).filter("type = 'nation'")
    parts = n.select("id", text.id_type("id").alias("kind"), text.id_slug("id").alias("slug"), text.title_from_id("id").alias("guessed"))
    return parts.join(n.select("type", text.id_slug("id").alias("s")), (F.col("kind") == F.col("type")) & (F.col("slug") == F.col("s")), "left_semi")


@query("""SELECT event_id, ip, n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || (event_id % 9) WHEN 1 THEN '7.7.7.7' ELSE 'unknown' END AS ip,
  CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM events)""")
def request_fields(spark, sf_dir):
    """Client addresses and newline lists of requests made from the events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    four, three = F.col("event_id") % 4, F.col("event_id") % 3
    forwarded = F.when(four == 0, F.concat(F.lit(" 10.0.0."), (F.col("event_id") % 9).cast("string"), F.lit(", 1.1.1.1")))
    lines = F.when(three == 0, " a \n\n b ").when(three == 1, "a\n").otherwise("\n ")
    return e.select("event_id", text.client_ip(forwarded, F.when(four == 1, "7.7.7.7")).alias("ip"), F.size(text.newline_list(lines)).alias("n"))


@query(oracle("""SELECT 'https://example.org' || p AS url, '2024-01-02' AS lastmod FROM (SELECT unnest(['/', '/about', '/explore', '/guides']) AS p)
  UNION ALL SELECT 'https://example.org/careers/' || type || '/' || substr(id, strpos(id, ':') + 1), CASE WHEN length(title) % 2 = 0 THEN '2023-05-06' ELSE '2024-01-02' END FROM star_nodes
  UNION ALL SELECT 'https://example.org/guides/' || lower(r_name), '2024-01-02' FROM region"""))
def sitemap_full(spark, sf_dir):
    n = star.nodes(spark, sf_dir).withColumn("changed", F.when(F.char_length("title") % 2 == 0, "2023-05-06").otherwise("unreadable"))
    guides = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lower("r_name").alias("slug"), F.lit(None).cast("string").alias("changed"))
    return pages.sitemap(n, "example.org", ["/", "/about", "/explore", "/guides"], guides, "2024-01-02")


@query(oracle("""SELECT e.to_id AS id, 'Name what follows.' || chr(10) || chr(10) || 'NODE: ' || n.title || chr(10) || chr(10) || 'WAY FROM THE START: all → ' || p.title || chr(10) || chr(10) ||
  'ALREADY KNOWN:' || chr(10) || '- ' || p.title AS prompt FROM walk_edges e JOIN star_nodes n ON n.id = e.to_id JOIN star_nodes p ON p.id = e.from_id WHERE p.type = 'region'"""))
def expansion_prompts(spark, sf_dir):
    n, e = star.nodes(spark, sf_dir), star.walk_edges(spark, sf_dir).filter("from_id LIKE 'region:%'")
    up = n.select(F.col("id").alias("from_id"), F.col("title").alias("up"))
    rows = e.join(up, "from_id").join(n.select(F.col("id").alias("to_id"), "title"), "to_id")
    known = F.array(F.concat(F.lit("- "), "up"))
    prompt = pages.expansion_prompt("title", F.lit(None).cast("string"), F.array(F.lit("all"), F.col("up")), known, "Name what follows.")
    return rows.select(F.col("to_id").alias("id"), prompt.alias("prompt"))


@query(f"""WITH o AS ({resolution.ORACLES['er_ladder']})
SELECT '2024-01-02' AS date, CASE action WHEN 'rejected_aggregate' THEN 'rejected' ELSE action END AS action, count(*) AS n, round(sum(score), 2) AS score,
  count(*) FILTER (action = 'linked_judge') AS judged FROM o GROUP BY action""")
def er_ledger(spark, sf_dir):
    rows = resolve.ledger(resolution._decided(spark, sf_dir)[0], "2024-01-02", "band")
    judged = F.count_if(F.col("judge_model").isNotNull() & (F.col("action") == "linked_judge")).alias("judged")
    return rows.groupBy("date", "action").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"), judged)


@query(f"""WITH o AS ({resolution.ORACLES['er_ladder']}),
m AS (SELECT node_id, min(case_id) AS c FROM o WHERE action = 'minted' GROUP BY node_id)
SELECT 'label' || label || ':' || vec_id AS id, vec_id AS pos FROM embeddings WHERE vec_id % 2 = 1
UNION ALL SELECT node_id, c + 1 + (SELECT max(vec_id) FROM embeddings WHERE vec_id % 2 = 1) FROM m""")
def er_vectors(spark, sf_dir):
    decided, reg, cases = resolution._decided(spark, sf_dir)
    return resolve.grown_vectors(reg, decided, cases).select("id", "pos")


@query(oracle("""SELECT id, depth FROM (SELECT id, length(title) % 5 AS depth, length(title) % 3 = 0 AS done, type FROM star_nodes) WHERE NOT done AND type <> 'part'"""))
def frontier_resume(spark, sf_dir):
    n = star.nodes(spark, sf_dir)
    queue = n.select("id", (F.char_length("title") % 5).alias("depth"), F.lit(0).alias("pos"), F.lit(False).alias("expanded"))
    done = n.filter(F.char_length("title") % 3 == 0).select("id", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("pos"), F.lit(True).alias("expanded"))
    return expand.resume(queue.unionByName(done), n.filter("type <> 'part'")).select("id", "depth")


@query("""WITH r AS (SELECT n_nationkey AS a, lead(n_nationkey) OVER w AS b, first_value(n_nationkey) OVER w AS f FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))
SELECT a || '->' || coalesce(b, f) AS id, CASE WHEN b IS NULL THEN 'lateral' ELSE 'progression' END AS edge_type FROM r WHERE a <> coalesce(b, f)""")
def settled_edges(spark, sf_dir):
    """The rings of each region's nations, inserted in order of the keys: the
    last edge of a ring would close it."""
    ring = star.walk_edges(spark, sf_dir).filter("edge_type = 'lateral'")
    a, b = text.id_slug("from_id"), text.id_slug("to_id")
    wanted = ring.select(F.concat(a, F.lit("->"), b).alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit("progression").alias("edge_type"), a.try_cast("long").alias("pos"))
    return expand.settle_edges(wanted.limit(0), wanted).select("id", "edge_type")
