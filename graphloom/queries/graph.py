"""Graph queries over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import components, expand, graph, lint, routes, snapshot, traverse
from ..plans import star
from ..plans.star import ROOT, oracle
from ..runtime import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def shown_path():
    return F.replace("path", F.lit("\u0000"), F.lit(" > ")).alias("path")


#: All simple routes of the star graph, and their ranks.
ROUTES = """r AS (
  SELECT 'market:all' AS target, ['market:all'] AS nodes, CAST([] AS VARCHAR[]) AS eids, 0 AS niche, 0 AS sideways, 0 AS hops
  UNION ALL
  SELECT e.to_id, list_append(r.nodes, e.to_id), list_append(r.eids, e.id), r.niche + CASE WHEN e.is_common_route THEN 0 ELSE 1 END,
    r.sideways + CASE WHEN e.edge_type = 'lateral' THEN 1 ELSE 0 END, r.hops + 1
  FROM r JOIN star_edges e ON e.from_id = r.target
  WHERE NOT list_contains(r.nodes, e.to_id) AND r.hops < 20
)"""
RANKED = """p AS (SELECT *, array_to_string(nodes, chr(1)) AS path FROM r), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY niche, sideways, hops, path) AS INTEGER) AS rank FROM p
), listed AS (SELECT * FROM ranked WHERE rank <= 10)"""
VIA = """own AS (
  SELECT e.from_id AS parent, l.target, l.nodes, l.niche, l.sideways, l.hops, l.path, l.rank + 1 AS pos, l.nodes[-2] = e.from_id AS enters
  FROM star_edges e JOIN listed l ON l.target = e.to_id
), through AS (
  SELECT parent, target, min(pos) AS first FROM own WHERE enters GROUP BY ALL
), ext0 AS (
  SELECT e.from_id AS parent, e.to_id AS target, list_append(q.nodes, e.to_id) AS nodes,
    q.niche + CASE WHEN e.is_common_route THEN 0 ELSE 1 END AS niche, q.sideways + CASE WHEN e.edge_type = 'lateral' THEN 1 ELSE 0 END AS sideways,
    q.hops + 1 AS hops, row_number() OVER (PARTITION BY e.from_id, e.to_id ORDER BY q.niche, q.sideways, q.hops, q.path) AS k
  FROM star_edges e JOIN p q ON q.target = e.from_id
  WHERE NOT list_contains(q.nodes, e.to_id)
    AND NOT EXISTS (SELECT 1 FROM through t WHERE t.parent = e.from_id AND t.target = e.to_id)
), via0 AS (
  SELECT o.parent, o.target, o.nodes, o.niche, o.sideways, o.hops, o.path, CASE WHEN o.pos = t.first THEN 0 ELSE o.pos END AS pos
  FROM own o LEFT JOIN through t USING (parent, target)
  UNION ALL
  SELECT parent, target, nodes, niche, sideways, hops, array_to_string(nodes, chr(1)), 0 FROM ext0 WHERE k = 1
), via1 AS (
  SELECT *, row_number() OVER (PARTITION BY parent, target, path ORDER BY pos) AS d FROM via0
), via AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY parent, target ORDER BY pos) AS INTEGER) AS rank FROM via1 WHERE d = 1
)"""
PARENTS = """best AS (SELECT * FROM ranked WHERE rank = 1), prank AS (
  SELECT e.to_id AS child_id, e.from_id AS parent_id, CAST(row_number() OVER (PARTITION BY e.to_id ORDER BY
    e.is_common_route DESC, CASE e.edge_type WHEN 'progression' THEN 0 WHEN 'exam_gate' THEN 1 ELSE 2 END,
    CASE WHEN b.target IS NULL THEN 1 ELSE 0 END, b.niche, b.sideways, b.hops, b.path, n.title, e.from_id) AS INTEGER) AS rank
  FROM star_edges e JOIN star_nodes n ON n.id = e.from_id LEFT JOIN best b ON b.target = e.from_id
)"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.best_routes(star.edges(spark, sf_dir), ROOT)


@query(oracle(
    "SELECT target, rank, niche, sideways, hops, replace(path, chr(1), ' > ') AS path FROM listed", ROUTES, RANKED))
def routes_topk(spark, sf_dir):
    """The ten best simple routes from the root to every node."""
    return routes.top_routes(_routes(spark, sf_dir)).select("target", "rank", "niche", "sideways", "hops", shown_path())


@query(oracle(
    "SELECT parent, target, rank, niche, sideways, hops, replace(path, chr(1), ' > ') AS path FROM via WHERE rank <= 10", ROUTES, RANKED, VIA))
def routes_via_parent(spark, sf_dir):
    edges = routes.merged(star.edges(spark, sf_dir, once=False))
    out = routes.paths_via_parent(routes.best_routes(edges, ROOT), edges, between=" > ")
    return out.select("parent", "target", "rank", "niche", "sideways", "hops", "path")


@query(oracle("SELECT child_id, parent_id, rank FROM prank", ROUTES, RANKED, PARENTS))
def parent_ranking(spark, sf_dir):
    return routes.parent_ranking(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), _routes(spark, sf_dir))


@query(oracle("""SELECT n.id,
  (SELECT count(*) FROM star_edges e WHERE e.to_id = n.id) AS n_parents,
  (SELECT count(*) FROM star_edges e WHERE e.from_id = n.id) AS n_children,
  (SELECT count(*) FROM listed l WHERE l.target = n.id) AS n_routes,
  s.parent_id AS selected_parent, v.nodes[list_position(v.nodes, s.parent_id) - 1] AS back_to
FROM star_nodes n LEFT JOIN prank s ON s.child_id = n.id AND s.rank = 1
LEFT JOIN via v ON v.target = n.id AND v.parent = s.parent_id AND v.rank = 1""", ROUTES, RANKED, VIA, PARENTS))
def node_page_view(spark, sf_dir):
    return routes.page_views(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), _routes(spark, sf_dir))


@query(oracle("""SELECT target, nodes[-2] AS parent, min(rank) AS rank FROM listed WHERE len(nodes) > 1 GROUP BY ALL""", ROUTES, RANKED))
def per_parent_routes(spark, sf_dir):
    return routes.per_parent_routes(_routes(spark, sf_dir)).select("target", "parent", "rank")


@query()
def route_map_merge(spark, sf_dir):
    return routes.merge_routes(routes.top_routes(_routes(spark, sf_dir)))


@query(oracle("""SELECT target AS id, CAST(hops AS INTEGER) AS distance, array_to_string(nodes, ' > ') AS trail FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY hops, eids) AS k FROM r) WHERE k = 1""", ROUTES))
def shortest_trail(spark, sf_dir):
    out = traverse.shortest_trails(star.edges(spark, sf_dir), ROOT)
    return out.select("id", "distance", F.array_join("trail", " > ").alias("trail"))


DISTANCE = """near AS (SELECT target, min(hops) AS d FROM r GROUP BY target), dist AS (
  SELECT n.id, CAST(coalesce(near.d, (SELECT max(d) + 1 FROM near)) AS INTEGER) AS distance FROM star_nodes n LEFT JOIN near ON near.target = n.id
)"""


@query(oracle("SELECT id, distance FROM dist", ROUTES, DISTANCE))
def root_distance(spark, sf_dir):
    return traverse.root_distance(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), ROOT)


@query(oracle("""SELECT id, type FROM star_nodes WHERE id NOT IN (SELECT b FROM seen)""",
  """seen AS (SELECT 'market:all' AS b UNION SELECT e.to_id FROM seen JOIN star_edges e ON e.from_id = seen.b
  WHERE NOT (e.edge_type = 'progression' AND NOT e.is_common_route))"""))
def unreachable_nodes(spark, sf_dir):
    """What common routes and sideways steps do not reach."""
    usable = star.edges(spark, sf_dir).filter("NOT (edge_type = 'progression' AND NOT is_common_route)")
    return traverse.unreachable(star.nodes(spark, sf_dir), usable, ROOT).select("id", "type")


CLOSURE = "reach AS (SELECT from_id AS a, to_id AS b FROM walk_edges UNION SELECT reach.a, e.to_id FROM reach JOIN walk_edges e ON e.from_id = reach.b)"


@query(oracle("""SELECT DISTINCT x.id FROM star_nodes x WHERE x.id IN (SELECT a FROM cyc) OR (
  EXISTS (SELECT 1 FROM reach JOIN cyc ON cyc.a = reach.a WHERE reach.b = x.id)
  AND EXISTS (SELECT 1 FROM reach JOIN cyc ON cyc.a = reach.b WHERE reach.a = x.id))""",
  CLOSURE, "cyc AS (SELECT DISTINCT a FROM reach WHERE a = b)"))
def progression_cycle_core(spark, sf_dir):
    """The nodes that the rings of nations keep from being acyclic."""
    return traverse.cyclic_core(star.walk_edges(spark, sf_dir))


@query(oracle("""SELECT c.from_id, c.to_id, c.from_id = c.to_id OR EXISTS (
  SELECT 1 FROM reach WHERE reach.a = c.to_id AND reach.b = c.from_id) AS closes
FROM (SELECT from_id, to_id FROM star_edges UNION SELECT to_id, from_id FROM star_edges) c""",
  """reach AS (SELECT from_id AS a, to_id AS b FROM star_edges WHERE edge_type <> 'lateral'
  UNION SELECT reach.a, e.to_id FROM reach JOIN star_edges e ON e.from_id = reach.b WHERE e.edge_type <> 'lateral')"""))
def would_create_cycle(spark, sf_dir):
    """Every edge and its reverse, against all edges that are not sideways."""
    e = materialize(star.edges(spark, sf_dir).select("from_id", "to_id", "edge_type"), "star-edges")
    both = e.select("from_id", "to_id").unionByName(e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    ways = e.withColumn("edge_type", F.when(F.col("edge_type") == "lateral", "lateral").otherwise("progression"))
    return traverse.would_close_cycle(both.repartition("from_id", "to_id").distinct(), ways)


#: The star graph, and a ring of the customers of each nation and segment.
RINGED = """ringed AS (SELECT from_id, to_id FROM star_edges UNION ALL
  SELECT 'customer:' || c_custkey, 'customer:' || coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER w)
  FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)
), ringed_reach AS (SELECT from_id AS a, to_id AS b FROM ringed UNION SELECT r.a, e.to_id FROM ringed_reach r JOIN ringed e ON e.from_id = r.b)"""


@query(oracle("""SELECT x.a AS id, min(x.b) AS component FROM ringed_reach x JOIN ringed_reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a""", RINGED))
def cycle_components(spark, sf_dir):
    """The strong components of the star graph with rings of customers."""
    ring = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    after = F.coalesce(F.lead("c_custkey").over(ring), F.min("c_custkey").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    name = lambda c: F.concat(F.lit("customer:"), c.cast("string"))
    rings = spark.read.parquet(f"{sf_dir}/customer.parquet").select(name(F.col("c_custkey")).alias("from_id"), name(after).alias("to_id"))
    return components.strong_components(star.edges(spark, sf_dir).select("from_id", "to_id").unionByName(rings))


DEGREES = """deg AS (SELECT n.id, coalesce(i.c, 0) AS in_count, coalesce(o.c, 0) AS out_count FROM star_nodes n
  LEFT JOIN (SELECT to_id, count(*) AS c FROM star_edges GROUP BY 1) i ON i.to_id = n.id
  LEFT JOIN (SELECT from_id, count(*) AS c FROM star_edges GROUP BY 1) o ON o.from_id = n.id)"""


@query(oracle("""SELECT n.id, n.type, n.title, array_to_string(n.aliases, '|') AS aliases,
  '/careers/' || n.type || '/' || substr(n.id, strpos(n.id, ':') + 1) AS href, in_count, out_count
FROM star_nodes n JOIN deg USING (id)""", DEGREES))
def directory(spark, sf_dir):
    return graph.directory(star.nodes(spark, sf_dir), star.edges(spark, sf_dir))


@query(oracle("""SELECT id, title, total, greatest(total - 100, 0) AS hidden FROM (
  SELECT id, title, count(*) OVER () AS total, row_number() OVER (ORDER BY title, id) AS k FROM star_nodes
  WHERE contains(lower(title), 'in') OR len(list_filter(aliases, lambda a: contains(lower(a), 'in'))) > 0) WHERE k <= 100"""))
def directory_search(spark, sf_dir):
    """The first hundred hits of a search (a display limit) and how many are hidden."""
    found = graph.directory_filter(star.nodes(spark, sf_dir), " IN ")
    return graph.first_shown(found, 100).select("id", "title", "total", "hidden")


@query(oracle("""SELECT e.id FROM star_edges e WHERE e.from_id IN (SELECT id FROM v) AND e.to_id IN (SELECT id FROM v)""",
  """v AS (SELECT id FROM star_nodes WHERE contains(lower(title), '2') OR contains(id, '2')
  OR len(list_filter(aliases, lambda a: contains(lower(a), '2'))) > 0)"""))
def map_filter(spark, sf_dir):
    return graph.map_filter(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), "2")[1].select("id")


@query(oracle("""SELECT e.from_id AS parent_id, n.id, n.type, n.title, e.edge_type, e.is_common_route FROM star_edges e JOIN star_nodes n ON n.id = e.to_id"""))
def children(spark, sf_dir):
    return graph.children(star.nodes(spark, sf_dir), star.edges(spark, sf_dir))


@query(oracle("""SELECT e.to_id AS child_id, n.id, n.type, n.title, e.edge_type, e.is_common_route FROM star_edges e JOIN star_nodes n ON n.id = e.from_id"""))
def parents(spark, sf_dir):
    return graph.parents(star.nodes(spark, sf_dir), star.edges(spark, sf_dir))


@query(oracle("""SELECT 0 AS rank, id, in_count FROM deg WHERE id = 'market:all' UNION ALL SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY in_count DESC, id) AS INTEGER) AS rank, id, in_count FROM deg WHERE id <> 'market:all') WHERE rank <= 200""", DEGREES))
def top_hubs(spark, sf_dir):
    """The root and the 200 nodes of highest in-degree (a top-k report)."""
    return graph.top_hubs(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), ROOT)


@query(oracle("SELECT DISTINCT type FROM star_nodes"))
def node_types(spark, sf_dir):
    return star.nodes(spark, sf_dir).select("type").distinct()


@query(oracle("""SELECT c.key, c.parent_id FROM c WHERE EXISTS (SELECT 1 FROM star_edges e JOIN star_nodes n ON n.id = e.to_id
  WHERE e.from_id = c.parent_id AND (lower(trim(n.title)) = lower(trim(c.title)) OR lower(trim(c.title)) IN (SELECT lower(trim(a)) FROM (SELECT unnest(n.aliases) AS a))))""",
  """c AS (SELECT c_custkey AS key, 'nation:' || (c_custkey % 25) AS parent_id, '  ' || upper(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END) || ' ' AS title FROM customer)"""))
def child_title_exists(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("key"), F.concat(F.lit("nation:"), (F.col("c_custkey") % 25).cast("string")).alias("parent_id"),
        F.concat(F.lit("  "), F.upper(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment"))), F.lit(" ")).alias("title"),
    )
    return graph.has_child_title(c, star.nodes(spark, sf_dir), star.edges(spark, sf_dir)).select("key", "parent_id")


@query(oracle("""SELECT e.id, CAST(least(d.distance, 5) AS INTEGER) AS bucket, CASE WHEN e.is_common_route THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS width,
  CASE WHEN e.edge_type = 'lateral' THEN 0.35::DOUBLE ELSE 0.75::DOUBLE END AS opacity FROM star_edges e JOIN dist d ON d.id = e.to_id""", ROUTES, DISTANCE))
def map_edges_styled(spark, sf_dir):
    e = star.edges(spark, sf_dir)
    return graph.styled_edges(e, traverse.root_distance(star.nodes(spark, sf_dir), e, ROOT))


@query(oracle("""SELECT e.id, c.title || ', from ' || p.title || CASE e.edge_type WHEN 'lateral' THEN ' (sideways)' WHEN 'exam_gate' THEN ' (through an exam)' ELSE '' END AS label
FROM star_edges e JOIN star_nodes p ON p.id = e.from_id JOIN star_nodes c ON c.id = e.to_id"""))
def route_flow_labels(spark, sf_dir):
    return graph.flow_labels(star.nodes(spark, sf_dir), star.edges(spark, sf_dir))


SHUFFLED = """typed AS (SELECT e.id, f.type AS from_type, t.type AS to_type,
  CASE length(e.id) % 3 WHEN 0 THEN 'progression' WHEN 1 THEN 'exam_gate' ELSE 'lateral' END AS edge_type
  FROM star_edges e JOIN star_nodes f ON f.id = e.from_id JOIN star_nodes t ON t.id = e.to_id)"""


@query(oracle("""SELECT id, CASE WHEN from_type IN ('nation', 'supplier', 'customer') AND to_type IN ('region', 'nation') AND g = 'progression' THEN 'lateral' ELSE g END AS edge_type FROM (
  SELECT *, CASE WHEN from_type = 'part' OR to_type = 'part' THEN 'exam_gate' WHEN edge_type = 'exam_gate' THEN 'progression' ELSE edge_type END AS g
  FROM typed WHERE NOT (from_type = 'part' AND to_type = 'part'))""", SHUFFLED))
def edge_grammar_fix(spark, sf_dir):
    kind = star.nodes(spark, sf_dir).select("id", "type")
    e = star.edges(spark, sf_dir).join(kind.select(F.col("id").alias("from_id"), F.col("type").alias("from_type")), "from_id").join(
        kind.select(F.col("id").alias("to_id"), F.col("type").alias("to_type")), "to_id"
    )
    m = F.char_length("id") % 3
    e = e.withColumn("edge_type", F.when(m == 0, "progression").when(m == 1, "exam_gate").otherwise("lateral"))
    fixed = expand.fix_edge_types(e, exam="part", working=("nation", "supplier", "customer"), education=("region", "nation"))
    return fixed.select("id", "edge_type")


@query(oracle("""SELECT severity, rule, count(*) AS n, min(subject) AS first FROM v GROUP BY severity, rule""",
  """n2 AS (SELECT id, type, CASE WHEN length(title) % 5 = 0 THEN title || '  | ' || type ELSE title END AS title FROM star_nodes)""",
  """e2 AS (SELECT id, from_id, CASE WHEN length(id) % 7 = 0 THEN to_id || 'x' ELSE to_id END AS to_id, edge_type, is_common_route FROM star_edges)""",
  """t2 AS (SELECT e.*, f.type AS f, t.type AS t FROM e2 e JOIN n2 f ON f.id = e.from_id JOIN n2 t ON t.id = e.to_id)""",
  """s2 AS (SELECT type || ':' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM n2 GROUP BY 1 HAVING count(*) > 1)""",
  """seen AS (SELECT 'market:all' AS b UNION SELECT e.to_id FROM seen JOIN e2 e ON e.from_id = seen.b)""",
  """reach AS (SELECT from_id AS a, to_id AS b FROM e2 WHERE edge_type = 'progression' UNION SELECT reach.a, e.to_id FROM reach JOIN e2 e ON e.from_id = reach.b WHERE e.edge_type = 'progression')""",
  """v AS (
  SELECT DISTINCT 'error' AS severity, 'unknown endpoint' AS rule, id AS subject FROM e2 WHERE from_id NOT IN (SELECT id FROM n2) OR to_id NOT IN (SELECT id FROM n2)
  UNION ALL SELECT 'error', 'edge grammar', id FROM t2 WHERE (f = 'part' OR t = 'part') <> (edge_type = 'exam_gate')
  UNION ALL SELECT 'error', 'exam to exam', id FROM t2 WHERE f = 'part' AND t = 'part'
  UNION ALL SELECT 'error', 'pipe in title', id FROM n2 WHERE contains(title, '|')
  UNION ALL SELECT 'warning', 'doubled white space', id FROM n2 WHERE regexp_matches(title, '\\s{2,}')
  UNION ALL SELECT 'error', 'slug collision', slug FROM s2
  UNION ALL SELECT 'warning', 'not reachable', id FROM n2 WHERE type <> 'part' AND id NOT IN (SELECT b FROM seen)
  UNION ALL SELECT DISTINCT 'error', 'progression cycle', a FROM reach WHERE a = b)"""))
def lint_report(spark, sf_dir):
    """All rules over the star graph with defects sown by title and id length."""
    n = star.nodes(spark, sf_dir)
    n = n.withColumn("title", F.when(F.char_length("title") % 5 == 0, F.concat("title", F.lit("  | "), "type")).otherwise(F.col("title")))
    e = star.edges(spark, sf_dir)
    e = e.withColumn("to_id", F.when(F.char_length("id") % 7 == 0, F.concat("to_id", F.lit("x"))).otherwise(F.col("to_id")))
    return lint.summary(lint.report(n, e, ROOT, exam="part"))


@query(oracle("""SELECT id, type, title, substr(id, strpos(id, ':') + 1) AS slug, type || '--' || substr(id, strpos(id, ':') + 1) || '.json' AS name FROM star_nodes"""))
def snapshot_core(spark, sf_dir):
    n = star.nodes(spark, sf_dir).withColumn("facts", F.struct("title"))
    names = snapshot.documents(n).select("name", F.regexp_replace(F.regexp_replace("name", r"\.json$", ""), "^([a-z]+)--", "$1:").alias("id"))
    return snapshot.core(n).join(names, "id").select("id", "type", "title", "slug", "name")


@query("""WITH e AS (SELECT 'part--' || p_partkey || '.json' AS name, sha256(p_name) AS digest FROM part WHERE p_size % 10 <> 0),
s AS (SELECT 'part--' || p_partkey || '.json' AS name, sha256(CASE WHEN p_size % 7 = 0 THEN p_brand ELSE p_name END) AS digest FROM part WHERE p_size % 11 <> 0)
SELECT name, state FROM (SELECT coalesce(e.name, s.name) AS name, CASE WHEN s.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'extra'
  WHEN e.digest <> s.digest THEN 'changed' END AS state FROM e FULL OUTER JOIN s ON e.name = s.name) WHERE state IS NOT NULL""")
def snapshot_diff(spark, sf_dir):
    """Two versions of the part documents, by size of the part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("name", F.concat(F.lit("part--"), F.col("p_partkey").cast("string"), F.lit(".json")))
    old = F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    expected = p.filter("p_size % 10 <> 0").select("name", F.sha2("p_name", 256).alias("digest"))
    stored = p.filter("p_size % 11 <> 0").select("name", F.sha2(old, 256).alias("digest"))
    return snapshot.difference(expected, stored)


@query("""WITH i AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, count(*) OVER () AS n FROM nation),
c AS (SELECT coalesce(max(CASE WHEN n_name = 'NATION_7' THEN pos END), 0) AS at, max(n) AS n FROM i)
SELECT CAST(o AS INTEGER) AS "offset", i.n_name AS id FROM c, (SELECT unnest(range(-2, 3)) AS o), i WHERE i.pos = ((c.at + o) % c.n + c.n) % c.n""")
def carousel_window(spark, sf_dir):
    return graph.carousel(_places(spark, sf_dir), "NATION_7", 5)


@query("""WITH i AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, count(*) OVER () AS n FROM nation)
SELECT a.n_name AS id, b.n_name AS next_id FROM i a JOIN i b ON b.pos = ((a.pos - 3) % a.n + a.n) % a.n""")
def move_selection(spark, sf_dir):
    return graph.move_selection(_places(spark, sf_dir), -3)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select((F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("pos"), F.col("n_name").alias("id"))


CONTEXT = """tiers AS (
  SELECT id AS owner, 0 AS tier, 0 AS pos, id, id || ' ' || title AS line FROM star_nodes WHERE type = 'supplier'
  UNION ALL SELECT e.to_id, 1, 0, e.from_id, e.from_id || ' ' || n.title FROM walk_edges e JOIN star_nodes n ON n.id = e.from_id WHERE e.to_id LIKE 'supplier:%'
  UNION ALL SELECT e.from_id, 2, CAST(replace(e.to_id, 'part:', '') AS INTEGER), e.to_id, e.to_id || ' ' || n.title FROM star_edges e JOIN star_nodes n ON n.id = e.to_id WHERE e.edge_type = 'exam_gate'
), c1 AS (SELECT *, row_number() OVER (PARTITION BY owner, id ORDER BY tier, pos) AS d FROM tiers),
c2 AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY tier, pos, id) AS n,
  sum(length(line) + 1) OVER (PARTITION BY owner ORDER BY tier, pos, id ROWS UNBOUNDED PRECEDING) AS chars FROM c1 WHERE d = 1)"""


@query(oracle("SELECT owner, id, line, CAST(tier AS INTEGER) AS tier FROM c2 WHERE n <= 300 AND chars <= 2000", CONTEXT))
def context_slice(spark, sf_dir):
    """What fits a supplier's context: itself, its nation, then its parts."""
    n, e = star.nodes(spark, sf_dir), star.edges(spark, sf_dir)
    line = F.concat("id", F.lit(" "), "title").alias("line")
    own = n.filter("type = 'supplier'").select(F.col("id").alias("owner"), F.lit(0).alias("tier"), F.lit(0).alias("pos"), "id", line)
    up = graph.parents(n, star.walk_edges(spark, sf_dir)).filter("child_id LIKE 'supplier:%'").select(
        F.col("child_id").alias("owner"), F.lit(1).alias("tier"), F.lit(0).alias("pos"), "id", line)
    down = graph.children(n, e).filter("edge_type = 'exam_gate'").select(
        F.col("parent_id").alias("owner"), F.lit(2).alias("tier"), text.id_slug("id").cast("int").alias("pos"), "id", line)
    return expand.context_slice(own.unionByName(up).unionByName(down), 300, 2000)


@query(oracle("""SELECT target AS id, CAST(min(hops) AS INTEGER) AS depth, min(hops) < 4 AS expanded FROM r GROUP BY target HAVING min(hops) <= 4""", ROUTES))
def frontier_expand(spark, sf_dir):
    e = star.edges(spark, sf_dir)
    step = lambda level: e.join(level.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return expand.expand(ROOT, spark, step, 4)


@query(oracle("""SELECT count(*) FILTER (d < 4) AS pending, count(*) FILTER (d = 4) AS retained FROM (SELECT min(hops) AS d FROM r GROUP BY target)""", ROUTES))
def frontier_counts(spark, sf_dir):
    return expand.frontier_counts(frontier_expand(spark, sf_dir), 4)


@query(oracle("""SELECT id, 'https://example.org/careers/' || type || '/' || substr(id, strpos(id, ':') + 1) AS url, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS lastmod FROM star_nodes"""))
def sitemap_rows(spark, sf_dir):
    built = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("lastmod"))
    return star.nodes(spark, sf_dir).join(F.broadcast(built)).select(
        "id", F.concat(F.lit("https://example.org"), text.node_href("id")).alias("url"), "lastmod")
