import pytest
from compare import differences

from graphloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    ours, theirs, rows = differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)
    assert rows > 0
    assert not ours and not theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert not queries.QUERIES[name](spark, sf_dir).isEmpty()


def test_route_map_merge_equals_brute_force(spark, sf_dir):
    """The query that SQL does not express: every target's routes merged again
    by matrices of reachability and relaxed layers."""
    import numpy as np

    from graphloom.operators import routes
    from graphloom.plans import star

    got = {}
    for r in queries.QUERIES["route_map_merge"](spark, sf_dir).collect():
        got.setdefault(r.target, {})[r.from_id, r.to_id] = (r.selected, r.layer)
    listed = {}
    for r in routes.top_routes(routes.best_routes(star.edges(spark, sf_dir), star.ROOT)).collect():
        listed.setdefault(r.target, []).append((r["rank"], list(r.nodes)))
    want = {}
    for target, ways in listed.items():
        ways = [w for _, w in sorted(ways)]
        names = sorted({x for w in ways for x in w})
        at = {x: i for i, x in enumerate(names)}
        reach, kept = np.eye(len(names), dtype=bool), []
        for w in ways:
            for a, b in zip(w, w[1:]):
                if (a, b) not in kept and not reach[at[b], at[a]]:
                    kept.append((a, b))
                    reach |= np.outer(reach[:, at[a]], reach[at[b]])
        layer = dict.fromkeys(names, 0)
        for _ in names:
            for a, b in kept:
                layer[b] = max(layer[b], layer[a] + 1)
        first = set(zip(ways[0], ways[0][1:]))
        if kept:
            want[target] = {(a, b): ((a, b) in first, layer[b]) for a, b in kept}
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_points_import_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
