"""Strong components and reachability labels against plain Python."""

import random

import pytest

from graphloom.operators import components, expand, traverse

EDGE = "from_id string, to_id string"


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), list(out.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(out.get(x, ()))
        reach[start] = seen
    return reach


def graphs():
    r = random.Random(11)
    name = "n{:03d}".format
    yield [(name(r.randrange(24)), name(r.randrange(24))) for _ in range(30)]
    yield [(name(r.randrange(16)), name(r.randrange(16))) for _ in range(50)]
    yield [(name(a), name(b)) for a, b in ((r.randrange(20), r.randrange(20)) for _ in range(60)) if a < b] + [(name(3), name(3))]
    ring = [(name(i), name((i + 1) % 6)) for i in range(6)]
    yield ring + [(a + "x", b + "x") for a, b in ring] + [(name(0), name(2) + "x"), (name(1), "tail"), ("head", name(4))]


@pytest.mark.parametrize("edges", list(graphs()), ids=["sparse", "dense", "acyclic", "rings"])
def test_components_and_reach_equal_the_closure(spark, edges):
    df = spark.createDataFrame([*edges, *edges[:3], (None, "a"), ("a", None)], EDGE)
    reach = closure(edges)
    want = {x: min(y for y in reach[x] | {x} if x in reach[y] or y == x) for x in reach if x in reach[x]}
    assert {r.id: r.component for r in components.strong_components(df).collect()} == want
    ids = sorted(reach)
    pairs = [(x, y) for x in ids for y in ids] + [("unknown", ids[0]), (ids[0], "unknown")]
    clean = df.filter("from_id IS NOT NULL AND to_id IS NOT NULL")
    got = components.Reach(clean).answers(spark.createDataFrame(pairs, "x string, y string")).collect()
    assert len(got) == len(pairs)
    assert all(r.reaches == (r.x == r.y or r.y in reach.get(r.x, ())) for r in got)


def test_long_rings_and_chains_take_few_rounds(spark, monkeypatch):
    name = "n{:04d}".format
    written = []
    whole = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: written.append(label) or whole(df, label))
    ring = [(name(i), name((i + 1) % 300)) for i in range(300)]
    chain = [(name(1000 + i), name(1001 + i)) for i in range(300)]
    # A way from the ring into the chain, two back from its middle, and a hub before the ring.
    more = [(name(7), name(1000)), (name(1150), name(3)), (name(1150), name(200)), *[("hub", name(i)) for i in range(300)], (name(1040), name(1010))]
    got = {r.id: r.component for r in components.strong_components(spark.createDataFrame(ring + chain + more, EDGE)).collect()}
    assert got == {name(i): name(0) for i in [*range(300), *range(1000, 1151)]}
    assert len(written) < 90


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], EDGE)
    assert components.strong_components(none).count() == 0
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "x string, y string")
    assert {(r.x, r.y, r.reaches) for r in components.Reach(none).answers(pairs).collect()} == {("a", "a", True), ("a", "b", False)}


def test_settled_edges_equal_one_by_one_insertion(spark):
    r = random.Random(5)
    name = "n{:02d}".format
    there = [(f"e{i}", *sorted((name(r.randrange(12)), name(r.randrange(12)))), "progression") for i in range(8)]
    there = [x for x in there if x[1] != x[2]]
    wanted = [(f"p{i}", name(r.randrange(12)), name(r.randrange(12)), r.choice(["progression", "progression", "lateral"]), i) for i in range(30)]
    out = expand.settle_edges(
        spark.createDataFrame(there, "id string, from_id string, to_id string, edge_type string"),
        spark.createDataFrame(wanted, "id string, from_id string, to_id string, edge_type string, pos int"),
    )
    now, want = [x[1:3] for x in there], {}
    for i, a, b, kind, _ in wanted:
        if kind == "progression" and (a == b or a in closure(now).get(b, ())):
            kind = "lateral"
        if kind == "progression":
            now.append((a, b))
        want[i] = kind
    assert {x.id: x.edge_type for x in out.collect()} == want
    assert "lateral" in want.values()


def test_would_close_cycle_takes_loops_and_unknown_ends(spark):
    edges = spark.createDataFrame([("a", "b", "progression"), ("b", "c", "progression"), ("c", "a", "lateral")], f"{EDGE}, edge_type string")
    asked = spark.createDataFrame([("c", "a"), ("a", "c"), ("z", "z"), ("z", "a"), ("c", "a")], EDGE)
    got = [(x.from_id, x.to_id, x.closes) for x in traverse.would_close_cycle(asked, edges).collect()]
    assert sorted(got) == [("a", "c", False), ("c", "a", True), ("c", "a", True), ("z", "a", False), ("z", "z", True)]


def test_labels_are_made_only_between_what_is_asked(spark, monkeypatch):
    written = []
    whole = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: written.append((label, whole(df, label))) or written[-1][1])
    fan = [("root", f"mid{i}") for i in range(20)] + [(f"mid{i}", f"leaf{i}.{k}") for i in range(20) for k in range(20)]
    df = spark.createDataFrame([*fan, ("root", "ring0"), ("ring0", "ring1"), ("ring1", "ring0")], EDGE)
    both = spark.createDataFrame([*fan, *[(b, a) for a, b in fan], ("ring1", "ring0")], "x string, y string")
    got = {(r.x, r.y): r.reaches for r in components.Reach(df).answers(both).collect()}
    assert got == {(a, b): True for a, b in fan} | {(b, a): False for a, b in fan} | {("ring1", "ring0"): True}
    # Edges and their reverses need no label at all.
    assert not any(label.startswith("dag") for label, _ in written)
    asked = [("root", "leaf3.4"), ("root", "leaf5.6"), ("mid1", "leaf2.2"), ("leaf3.4", "root")]
    got = {(r.x, r.y): r.reaches for r in components.Reach(df).answers(spark.createDataFrame(asked, "x string, y string")).collect()}
    assert got == dict(zip(asked, (True, True, False, False)))
    assert max(table.count() for label, table in written if label.startswith("dag")) <= 8
