from pyspark.sql import functions as F

from graphloom.operators import expand, graph, lint, routes, snapshot, traverse
from graphloom.plans import star

ROOT = "school_stage:start"
EDGES = [
    (ROOT, "stream:arts", "progression", True),
    (ROOT, "diploma:film", "progression", True),
    (ROOT, "certification:restoring", "progression", False),
    ("stream:arts", "degree:history", "progression", True),
    ("diploma:film", "degree:history", "lateral", False),
    ("degree:history", "degree:archives", "progression", True),
    ("degree:archives", "job_role:curator", "progression", True),
    ("diploma:film", "job_role:editor", "progression", True),
    ("job_role:editor", "diploma:film", "lateral", False),
    ("job_role:editor", "job_role:curator", "lateral", True),
    ("certification:restoring", "job_role:curator", "progression", False),
    ("job_role:curator", "job_role:patron", "lateral", True),
    ("job_role:patron", "job_role:curator", "lateral", True),
]


def edges(spark, rows=EDGES):
    df = spark.createDataFrame(rows, "from_id string, to_id string, edge_type string, is_common_route boolean")
    return df.select(F.concat("from_id", F.lit("->"), "to_id").alias("id"), "*")


def nodes(spark, ids=None):
    ids = ids or sorted({x for e in EDGES for x in e[:2]})
    rows = [(i, i.split(":")[0], i.split(":")[1], []) for i in ids]
    return spark.createDataFrame(rows, "id string, type string, title string, aliases array<string>")


def test_routes_are_ranked_by_niche_lateral_length(spark):
    found = routes.top_routes(routes.best_routes(edges(spark), ROOT)).filter("target = 'job_role:curator'").orderBy("rank").collect()
    assert [(r.niche, r.sideways, r.hops, r.nodes[-2]) for r in found] == [
        (0, 0, 4, "degree:archives"), (0, 1, 3, "job_role:editor"), (1, 1, 4, "degree:archives"), (2, 0, 2, "certification:restoring")]
    assert all(len(set(r.nodes)) == len(r.nodes) for r in found)


def test_requested_parent_comes_first(spark):
    every = routes.best_routes(edges(spark), ROOT)
    via = routes.routes_via_parent(every, edges(spark)).filter("target = 'job_role:curator'")
    firsts = {r.parent: r.nodes for r in via.filter("rank = 1").collect()}
    assert firsts["job_role:editor"][-2] == "job_role:editor"
    assert firsts["degree:archives"][-2] == "degree:archives"
    # Only routes through the target lead to this parent: nothing to extend.
    assert firsts["job_role:patron"][-2] == "degree:archives"


def test_default_parent(spark):
    every = routes.best_routes(edges(spark), ROOT)
    rank = routes.parent_ranking(nodes(spark), edges(spark), every).filter("child_id = 'job_role:curator'")
    assert [r.parent_id for r in rank.orderBy("rank").collect()] == [
        "degree:archives", "job_role:editor", "job_role:patron", "certification:restoring"]


def test_merged_map_has_no_cycle(spark):
    rows = [("t", 1, ["r", "a", "b", "t"]), ("t", 2, ["r", "b", "a", "t"])]
    listed = spark.createDataFrame(rows, "target string, rank int, nodes array<string>")
    merged = {(r.from_id, r.to_id): (r.selected, r.layer) for r in routes.merge_routes(listed).collect()}
    assert ("b", "a") not in merged
    assert merged["a", "b"] == (True, 2) and merged["b", "t"] == (True, 3) and merged["a", "t"][0] is False


def test_beam_keeps_the_best(spark):
    exact = routes.top_routes(routes.simple_routes(edges(spark), ROOT), 1).select("target", "path")
    beam = routes.top_routes(routes.simple_routes(edges(spark), ROOT, beam=5), 1).select("target", "path")
    assert {tuple(r) for r in exact.collect()} == {tuple(r) for r in beam.collect()}


def test_traversals(spark):
    e = edges(spark)
    d = {r.id: r.distance for r in traverse.root_distance(nodes(spark), e, ROOT).collect()}
    assert d[ROOT] == 0 and d["job_role:curator"] == 2 and d["job_role:patron"] == 3
    core = {r.id for r in traverse.cyclic_core(e).collect()}
    # Two cycles, and what lies between them.
    assert core == {"diploma:film", "job_role:editor", "degree:history", "degree:archives", "job_role:curator", "job_role:patron"}
    assert traverse.cyclic_core(e.filter("edge_type = 'progression'")).isEmpty()
    trail = {r.id: r.trail for r in traverse.shortest_trails(e, ROOT).collect()}
    assert trail["job_role:curator"] == [ROOT, "certification:restoring", "job_role:curator"]
    asked = spark.createDataFrame([("job_role:curator", ROOT), (ROOT, "job_role:curator")], "from_id string, to_id string")
    closes = {(r.from_id, r.to_id): r.closes for r in traverse.would_close_cycle(asked, e).collect()}
    assert closes == {("job_role:curator", ROOT): True, (ROOT, "job_role:curator"): False}


def test_cycle_of_more_than_64_edges(spark):
    chain = spark.createDataFrame(
        [(f"n{i}", f"n{i + 1}", "progression") for i in range(66)], "from_id string, to_id string, edge_type string")
    asked = spark.createDataFrame([("n66", "n0"), ("n0", "n66")], "from_id string, to_id string")
    closes = {(r.from_id, r.to_id): r.closes for r in traverse.would_close_cycle(asked, chain).collect()}
    assert closes == {("n66", "n0"): True, ("n0", "n66"): False}


def test_settled_edges_equal_one_by_one_insertion(spark):
    import random

    rng = random.Random(4)
    pairs = [p for p in {(rng.randrange(9), rng.randrange(9)) for _ in range(40)} if p[0] != p[1]]
    there = [(9, 0), (1, 9)]
    rows = [(f"{a}->{b}", str(a), str(b), rng.choice(["progression", "progression", "lateral"]), n) for n, (a, b) in enumerate(sorted(pairs))]
    schema = "id string, from_id string, to_id string, edge_type string, pos long"
    known = spark.createDataFrame([(f"{a}->{b}", str(a), str(b), "progression", -1) for a, b in there], schema)
    got = {r.id: r.edge_type for r in expand.settle_edges(known, spark.createDataFrame(rows, schema)).collect()}
    nexts = {str(a): {str(b)} for a, b in there}

    def leads(a, b):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += nexts.get(x, ())
        return False

    want = {}
    for i, a, b, kind, _ in rows:
        want[i] = "lateral" if kind == "progression" and leads(b, a) else kind
        if want[i] == "progression":
            nexts.setdefault(a, set()).add(b)
    assert got == want and list(want.values()).count("lateral") > sum(r[3] == "lateral" for r in rows)


def test_insert_edges(spark):
    e = edges(spark).withColumn("pos", F.lit(0))
    new = spark.createDataFrame(
        [("a", "a", "lateral", True, 1), ("a", "b", "lateral", True, 3), ("a", "b", "progression", True, 2)],
        "from_id string, to_id string, edge_type string, is_common_route boolean, pos int")
    added = graph.insert_edges(e, new).filter("from_id = 'a'").collect()
    assert [(r.to_id, r.edge_type) for r in added] == [("b", "progression")]


def test_hubs_pin_the_root(spark):
    hubs = [r.id for r in graph.top_hubs(nodes(spark), edges(spark), ROOT, 2).orderBy("rank").collect()]
    assert hubs == [ROOT, "job_role:curator", "degree:history"]


def test_carousel_wraps_without_clones(spark):
    items = spark.createDataFrame(list(enumerate("abcdef")), "pos long, id string")
    shown = [(r.offset, r.id) for r in graph.carousel(items, "a", 5).orderBy("offset").collect()]
    assert shown == [(-2, "e"), (-1, "f"), (0, "a"), (1, "b"), (2, "c")]
    few = spark.createDataFrame(list(enumerate("abc")), "pos long, id string")
    assert [r.id for r in graph.carousel(few, "?", 5).orderBy("offset").collect()] == ["c", "a", "b"]


def test_grammar_and_lint(spark):
    typed = spark.createDataFrame(
        [("exam", "exam", "progression"), ("degree", "exam", "progression"), ("degree", "degree", "exam_gate"), ("job_role", "degree", "progression")],
        "from_type string, to_type string, edge_type string")
    fixed = {(r.from_type, r.to_type): r.edge_type for r in expand.fix_edge_types(typed).collect()}
    assert fixed == {("degree", "exam"): "exam_gate", ("degree", "degree"): "progression", ("job_role", "degree"): "lateral"}
    rules = {r.rule for r in lint.report(nodes(spark), edges(spark), ROOT).collect()}
    assert rules == set()
    broken = edges(spark, [*EDGES, ("degree:archives", "nowhere:x", "progression", True), ("degree:archives", "degree:history", "progression", True)])
    found = lint.report(nodes(spark), broken, ROOT)
    assert {r.rule for r in found.collect()} == {"unknown endpoint", "progression cycle"}
    assert lint.exit_code(found) == 1


def test_context_budget(spark):
    rows = [("o", 0, 0, "self", "x" * 10), ("o", 1, 0, "a", "y" * 10), ("o", 2, 0, "a", "y" * 10), ("o", 2, 1, "b", "z" * 100), ("o", 2, 2, "c", "c")]
    tiers = spark.createDataFrame(rows, "owner string, tier int, pos int, id string, line string")
    assert {r.id for r in expand.context_slice(tiers, 300, 30).collect()} == {"self", "a"}
    assert {r.id for r in expand.context_slice(tiers, 3, 1000).collect()} == {"self", "a", "b"}


def test_snapshot_difference(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "name string, digest string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "name string, digest string")
    assert {(r.name, r.state) for r in snapshot.difference(a, b).collect()} == {("y", "changed"), ("z", "missing"), ("w", "extra")}
    assert snapshot.digest(a) == snapshot.digest(a.orderBy(F.desc("name"))) != snapshot.digest(b)


def test_star_graph_is_sound(spark, sf_dir):
    assert lint.missing_endpoints(star.nodes(spark, sf_dir), star.edges(spark, sf_dir)).isEmpty()
