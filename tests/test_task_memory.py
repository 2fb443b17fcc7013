"""What a single task has to hold: no sort or map of its whole share."""

from graphloom.operators import expand, lint, traverse

EDGE = "id string, from_id string, to_id string, edge_type string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_sorts_no_violations(spark):
    rows = [("error", "a", "s2"), ("error", "a", "s1"), ("warning", "a", "s3"), ("warning", "b", None)]
    out = lint.summary(spark.createDataFrame(rows, "severity string, rule string, subject string"))
    assert "Sort [" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [("error", "a", 2, "s1"), ("warning", "a", 1, "s3"), ("warning", "b", 1, None)]
    assert lint.summary(spark.createDataFrame([], "severity string, rule string, subject string")).count() == 0


def test_distances_keep_no_pairs_apart(spark, monkeypatch):
    plans = {}
    whole = traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, label: plans.setdefault(label, _plan(df)) and whole(df, label))
    edges = spark.createDataFrame([("e1", "r", "a", ""), ("e2", "r", "a", ""), ("e3", "a", "b", "")], EDGE)
    got = sorted((r.id, r.distance) for r in traverse.distances(edges, "r").collect())
    assert got == [("a", 1), ("b", 2), ("r", 0)]
    assert "Aggregate" not in plans["hops"]


def test_trails_are_fetched_for_first_parents_only(spark, monkeypatch):
    plans = []
    whole = traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, label: plans.append(_plan(df)) or whole(df, label))
    # b is found from a2 first, as e1 comes before e2; of two edges the lower id counts, and c's order follows it.
    edges = [("e1", "r", "a2"), ("e2", "r", "a1"), ("e0", "a1", "b"), ("e9", "a2", "b"), ("e7", "a2", "c"), ("e3", "a2", "c"), ("e5", "a2", "d"), ("x1", "d", "z"), ("x0", "c", "z"), ("l", "b", "r")]
    df = spark.createDataFrame([(*e, "") for e in edges], EDGE)
    got = {r.id: (r.distance, r.trail) for r in traverse.shortest_trails(df, "r").collect()}
    assert got == {
        "r": (0, ["r"]), "a2": (1, ["r", "a2"]), "a1": (1, ["r", "a1"]), "b": (2, ["r", "a2", "b"]), "c": (2, ["r", "a2", "c"]),
        "d": (2, ["r", "a2", "d"]), "z": (3, ["r", "a2", "c", "z"]),
    }
    assert not any("SortAggregate" in plan for plan in plans)


def test_context_sorts_where_the_owner_is(spark):
    rows = [("o", 1, 2, "x", "later"), ("o", 0, 5, "x", "first"), ("o", 1, 1, "y", "next"), ("p", 0, 0, "x", "other")]
    out = expand.context_slice(spark.createDataFrame(rows, "owner string, tier int, pos int, id string, line string"), 300, 11)
    assert _plan(out).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect())) == [("o", "x", "first", 0), ("o", "y", "next", 1), ("p", "x", "other", 0)]
