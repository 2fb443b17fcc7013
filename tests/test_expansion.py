"""Expansion from a queue: one step after another, killed, resumed."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import expansion

S = {
    "stage:a": [{"existing_id": "stage:b"}, {"new_title": "Clerk", "new_type": "job_role", "one_line_definition": "d", "confidence": "niche"}],
    "stage:b": [{"existing_id": "job_role:night-guard"}, {"existing_id": "exam:x"}, {"new_title": "no type"}, {"existing_id": "stage:a"}],
    "job_role:clerk": [{"existing_id": "stage:b"}, {"new_title": "CLERK", "new_type": "job_role", "one_line_definition": "again"}],
    "stage:night-guard": [],
    "exam:x": [{"existing_id": "exam:y"}, {"existing_id": "job_role:clerk", "edge_type": "lateral"}],
}


def service():
    """The answers as a local function: tasks get it by value."""
    import json

    known = dict(S)
    return lambda request: json.dumps({"is_terminal": not known[request], "successors": known[request]})


def by_title(candidates, nodes):
    known = nodes.select(text.normalize_title("title").alias("norm"), "type", F.col("id").alias("found"))
    rows = candidates.withColumn("norm", text.normalize_title("title")).join(known, ["norm", "type"], "left")
    minted = F.concat("type", F.lit(":"), text.slugify("title"))
    return rows.select("case_id", F.when(F.col("found").isNull(), "minted").otherwise("linked_exact").alias("action"), F.coalesce("found", minted).alias("node_id"), "title")


@pytest.fixture
def seeds(spark):
    rows = [("stage:a", "stage", "A"), ("stage:b", "stage", "B"), ("exam:x", "exam", "X"), ("exam:y", "exam", "Y")]
    return spark.createDataFrame([(i, t, x, [], "", n) for n, (i, t, x) in enumerate(rows)], "id string, type string, title string, aliases array<string>, description string, pos long")


def result(spark, path):
    s = expansion.load(spark, path)
    return (
        sorted((r.id, r.title, r.is_terminal) for r in s.nodes.collect()), sorted((r.id, r.edge_type, r.is_common_route) for r in s.edges.collect()),
        sorted((r.id, r.depth, r.expanded) for r in s.queue.collect()),
    )


EDGES = sorted([
    ("stage:a->stage:b", "progression", True), ("stage:a->job_role:clerk", "progression", False), ("stage:b->stage:night-guard", "progression", True),
    ("stage:b->exam:x", "exam_gate", True), ("stage:b->stage:a", "lateral", True), ("job_role:clerk->stage:b", "progression", True), ("exam:x->job_role:clerk", "exam_gate", True),
])


def test_a_killed_run_resumes_to_the_same_result(spark, seeds, tmp_path, monkeypatch):
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    ask = service()
    assert expansion.bootstrap(seeds, whole, "stage:a") and expansion.bootstrap(seeds, broken, "stage:a")
    assert not expansion.bootstrap(seeds, whole, "stage:a")
    done, down = expansion.run(spark, whole, ask, by_title, every=1)
    assert done == 5 and not down
    nodes, edges, queue = result(spark, whole)
    # The unknown id has no type of its own: it takes its parent's.
    assert edges == EDGES
    assert ("stage:night-guard", "night guard", True) in nodes and all(q[2] for q in queue) and "exam:y" not in {q[0] for q in queue}
    real, calls = expansion.overwrite, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("killed before the manifest moved")
        return real(*args)

    monkeypatch.setattr(expansion, "overwrite", dies)
    with pytest.raises(OSError, match="killed"):
        expansion.run(spark, broken, ask, by_title, every=1)
    assert expansion.load(spark, broken).queue.filter("expanded").count() == 2
    monkeypatch.setattr(expansion, "overwrite", real)
    assert expansion.run(spark, broken, ask, by_title, every=1) == (3, False)
    assert result(spark, broken) == (nodes, edges, queue)


def test_failures_go_to_the_back_and_end_the_run(spark, seeds, tmp_path):
    path = str(tmp_path / "down")
    expansion.bootstrap(seeds, path, "stage:a")

    answer = service()

    def half(request):
        if request != "stage:a":
            raise RuntimeError("no answer")
        return answer(request)

    done, down = expansion.run(spark, path, half, by_title, every=2, stop_after=4, attempts=1)
    assert (done, down) == (1, True)
    state = expansion.load(spark, path)
    waiting = [(r.id, r.expanded) for r in state.queue.orderBy("pos").collect()]
    assert waiting[0] == ("stage:a", True) and not any(e for _, e in waiting[1:]) and len(waiting) == 3


def test_context_tiers(spark, seeds):
    from graphloom.operators.expand import context_slice

    trails = spark.createDataFrame([("exam:y", ["stage:a", "exam:y"])], "id string, trail array<string>")
    near = spark.createDataFrame([("exam:y", "stage:b", 1), ("stage:a", "exam:x", 1)], "q_id string, id string, rank int")
    rows = context_slice(expansion.context_tiers(seeds, trails, near), 10, 1000).collect()
    assert sorted((r.tier, r.id, r.line) for r in rows) == [(0, "exam:y", "exam:y | Y"), (1, "stage:a", "stage:a | A"), (2, "stage:b", "stage:b | B"), (3, "exam:x", "exam:x | X")]
