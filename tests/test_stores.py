"""Kept stores, ordered resolution and readers of ledgers."""

import json

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import resolve, service
from graphloom.sources import readers, stores, writers


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_one_changed_document_rewrites_one_bucket(spark, tmp_path):
    path = tmp_path / "docs"
    docs = spark.createDataFrame([(f"d{n}", f"text {n}") for n in range(60)], "name string, body string")
    assert writers.sync_documents(docs, str(path), buckets=8) == 60
    before = files(path)
    changed = docs.withColumn("body", F.when(F.col("name") == "d7", "new").otherwise(F.col("body")))
    assert writers.sync_documents(changed, str(path), buckets=8) == 1
    after = files(path)
    assert len({f.split("/")[0] for f in before.keys() ^ after.keys()}) == 1
    assert writers.sync_documents(changed.filter("name = 'd7'"), str(path), buckets=8) == 59
    assert [tuple(r) for r in spark.read.parquet(str(path)).select("name", "body").collect()] == [("d7", "new")]
    assert len([d for d in path.iterdir() if d.name.startswith("bucket=")]) == 1


def test_appended_blocks_stay_and_answer_as_one(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"n{i}", "t", rng.standard_normal(6).tolist(), i) for i in range(90)]
    v = spark.createDataFrame(rows, "id string, type string, vec array<double>, pos long")
    path = tmp_path / "vectors"
    assert stores.append_vectors(v.filter("pos < 50"), str(path), block=16) == 50
    before = files(path)
    assert stores.append_vectors(v, str(path), block=16) == 40 and stores.append_vectors(v, str(path), block=16) == 0
    assert before.items() <= files(path).items()
    key = lambda df: sorted((r.q_id, r["rank"], r.id) for r in df.collect())
    assert key(stores.nearest_in_store(v, str(path), 4, block=16)) == key(resolve.nearest(v, v, 4))


def test_a_second_writer_between_probe_and_write(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "key string, n int")
    asked = []

    def slow(missing):
        asked.append(sorted(r.key for r in missing.collect()))
        if len(asked) == 1:  # another writer answers b meanwhile
            stores.through_cache(rows.filter("key = 'b'"), path, lambda m: m.select("key", F.lit("theirs").alias("value")))
        return missing.select("key", F.lit("ours").alias("value"))

    got = {(r.key, r.n): r.value for r in stores.through_cache(rows, path, slow).collect()}
    assert got == {("a", 1): "ours", ("a", 3): "ours", ("c", 4): "ours", ("b", 2): "theirs"}
    assert spark.read.parquet(path).count() == 3 and asked == [["a", "b", "c"]]
    again = stores.through_cache(rows, path, slow)
    assert again.count() == 4 and len(asked) == 1


def test_usage_is_observed(spark):
    from pyspark.sql import Observation

    seen = Observation("usage")
    requests = spark.createDataFrame([("a", "xx"), ("b", "xxxx"), ("c", "")], "key string, request string")

    def count(request):
        if not request:
            raise ValueError("empty")
        return request, len(request)

    rows = {r.key: (r.calls, r.tokens) for r in service.answers(requests, count, observation=seen, attempts=2, wait=0.0).collect()}
    assert rows == {"a": (1, 2), "b": (1, 4), "c": (2, 0)} and seen.get == {"calls": 4, "tokens": 6, "failures": 1}


def test_in_order_equals_one_after_another(spark):
    rng = np.random.default_rng(3)
    base = {x: rng.standard_normal(8) for x in "pqr"}
    near = lambda x, by: (base[x] + by * rng.standard_normal(8)).tolist()
    registry = [(f"t:r{i}", "t", f"Registered {i}", rng.standard_normal(8).tolist(), i) for i in range(6)]
    cases = [(0, "Alpha one", near("p", 0)), (1, "Beta", near("q", 0)), (2, "Alpha uno", near("p", 0.01)), (3, "ALPHA ONE", near("r", 0)), (4, "Registered  2", near("q", 0.01)), (5, "Gamma", near("q", 0.02))]
    nodes = spark.createDataFrame([(i, t, x, [], p) for i, t, x, _, p in registry], "id string, type string, title string, aliases array<string>, pos long")
    vectors = spark.createDataFrame([(i, t, v, p) for i, t, _, v, p in registry], "id string, type string, vec array<double>, pos long")
    asked = spark.createDataFrame([(c, "t", x, "Parent", v) for c, x, v in cases], "case_id long, type string, title string, parent_title string, vec array<double>")
    decided, grown, more = resolve.resolve_in_order(asked, nodes, vectors, resolve.band_judge(0.9), band=0.5)
    got = {r.case_id: (r.action, r.node_id) for r in decided.collect()}
    known = [(i, x, np.array(v)) for i, _, x, v, _ in registry]
    want = {}
    for c, title, v in cases:
        norm = " ".join(title.lower().split())
        exact = [i for i, x, _ in known if " ".join(x.lower().split()) == norm]
        scored = sorted(((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), n) for n, (_, _, w) in enumerate(known)))
        if exact:
            want[c] = ("linked_exact", exact[-1])
        elif -scored[0][0] >= 0.9:
            want[c] = ("linked_judge", known[scored[0][1]][0])
        else:
            new = "t:" + norm.replace(" ", "-")
            want[c] = ("minted", new)
            known.append((new, title, np.array(v)))
    assert got == want and got[2] == ("linked_judge", "t:alpha-one") and got[3][0] == "linked_exact" and got[5][0] == "linked_judge"
    assert {r.id for r in grown.collect()} == {k[0] for k in known} == {r.id for r in more.collect()}


def test_readers_of_curated_and_reported_files(spark, tmp_path):
    (tmp_path / "exams.json").write_text(json.dumps({"exams": {"Big Test": {"level": "all_india", "notes": "Once a year"}, "Small": {"level": "state", "notes": None}}}))
    got = {r.id: (r.type, r.title, r.description) for r in readers.exams(spark, str(tmp_path / "exams.json")).collect()}
    assert got["exam:big-test"] == ("exam", "Big Test", "All India exam. Once a year") and got["exam:small"][2] == "State exam"
    facts = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, facts string")
    assert [r.facts for r in readers.facts_of(facts, "b").collect()] == ["y"] and readers.facts_of(facts, "c").count() == 0
    assert readers.previous_audit(spark, str(tmp_path / "none")).count() == 0
    check = {"url": "https://example.org/", "status": 200}
    (tmp_path / "audit.json").write_text(json.dumps({"checks": [check, {**check, "status": 404}]}))
    assert sorted(r.status for r in readers.previous_audit(spark, str(tmp_path / "audit.json")).collect()) == [200, 404]
    path = str(tmp_path / "ledger")
    row = spark.createDataFrame([("enrichment", "n1", None), ("other", "n2", "x")], "stage string, node_id string, error string")
    writers.append(row, path)
    writers.append(row, path)
    assert [tuple(r) for r in readers.failures(spark, path).collect()] == [("enrichment", "n1", None)]
