import pytest
from pyspark.sql import functions as F

from graphloom.functions import text, urls
from graphloom.operators import facts, intake, resolve, snapshot
from graphloom.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("title, norm", [
    ("B.Tech", "b technology"), ("Ph.D in Law", "phd in law"), ("R&D", "r and d"), ("Govt Govt", "government govt"),
    ("Counselor (Pediatric)", "counsellor paediatric"), ("  ", ""),
])
def test_normalize_title(spark, title, norm):
    assert one(spark, text.normalize_title(F.lit(title))) == norm


def test_titles(spark):
    assert one(spark, text.slugify(F.lit("R&D — Élan 2!"))) == "r-d-lan-2"
    assert one(spark, text.looks_aggregate(F.lit("Lower Clerk | Upper Clerk")))
    assert not one(spark, text.looks_aggregate(F.lit("CA | Chartered Accountancy")))
    assert not one(spark, text.looks_aggregate(F.lit("Senior Clerk (LDC | JSA or more)")))
    assert one(spark, text.is_bare_generic(F.lit("Ph.D.")))
    assert one(spark, text.qualified_title(F.lit("Ph.D."), F.lit("Law (Hons)"))) == "Ph.D in Law"
    assert one(spark, text.explore_href(F.lit("degree:mba"), F.lit("degree:bca"))) == "/explore/degree/mba?from=degree%3Abca"
    assert one(spark, text.id_slug(F.lit("a:b:c"))) == "b:c"
    assert one(spark, text.pair_text(F.lit("T"), F.lit("a/b/c"))) == "T — context: b / c"
    assert one(spark, text.pair_text(F.lit("T"), F.lit("c"))) == "T — context: c"
    assert one(spark, text.pair_text(F.lit("T"), F.lit(None).cast("string"))) == "T — context: "
    assert one(spark, text.newline_list(F.lit(" a \n\n b0"))) == ["a", "b0"]
    assert one(spark, text.client_ip(F.lit(" 1.2.3.4, 5"), F.lit(None))) == "1.2.3.4"
    assert one(spark, text.client_ip(F.lit(None), F.lit(None))) == "unknown"
    with pytest.raises(Exception, match="malformed"):
        one(spark, text.split_id(F.lit("bad:")))


@pytest.mark.parametrize("url, norm", [
    (" HTTPS://Museum.Example.ORG/visit#hours ", "https://museum.example.org/visit"), ("http://x.org", "http://x.org/"), ("http://x.org:80/?a=1", "http://x.org:80/?a=1"),
    ("ftp://x.org/", None), ("http://127.0.0.1/", None), ("http://169.254.169.254/", None), ("http://[::1]/", None),
    ("http://localhost/", None), ("http://a.local/", None), ("http://u:p@x.org/", None), ("nonsense", None),
])
def test_urls(spark, url, norm):
    assert urls.public_url(url) == norm
    assert one(spark, urls.normalize_domain_url(F.lit(url))) == norm


def test_probe_follows_only_public_redirects(spark):
    answers = {"https://a.org/": (301, "http://169.254.169.254/", None), "https://b.org/": (404, None, None), "https://c.org/": (301, None, None)}
    df = spark.createDataFrame([(u,) for u in answers], "url string")
    got = {r.url: (r.reachable, r.definitive_failure) for r in facts.classify(facts.probe(df, lambda u: answers[u])).collect()}
    assert got == {"https://a.org/": (False, True), "https://b.org/": (False, True), "https://c.org/": (True, False)}


def test_citations_keep_first_use(spark):
    rows = [("n", 2, ["b", "c"]), ("n", 1, ["a", "b"])]
    df = spark.createDataFrame(rows, "node_id string, pos int, urls array<string>")
    assert facts.citations(df).first().urls == ["a", "b", "c"]


def test_mint_takes_the_lowest_free_number(spark):
    cases = spark.createDataFrame([(1, "t", "X"), (2, "t", "x!"), (3, "t", "x")], "case_id int, type string, title string")
    taken = spark.createDataFrame([("t:x",), ("t:x-3",)], "id string")
    assert [r.minted_id for r in resolve.mint_ids(cases, taken).orderBy("case_id").collect()] == ["t:x-2", "t:x-4", "t:x-5"]


def test_calibration(spark):
    rows = spark.createDataFrame([(0.7, "same_role", False), (0.95, "distinct", False)], "score double, label string, exact boolean")
    assert resolve.calibrate(rows, [0.0, 0.6, 0.75]).first().band == 0.6
    with pytest.raises(Exception, match="no threshold"):
        resolve.calibrate(rows, [0.75, 0.8]).collect()


def test_verdicts_are_checked(spark):
    bad = spark.createDataFrame([(1, "distinct", "id", None)], "case_id int, decision string, judged_id string, rationale string")
    with pytest.raises(Exception, match="bad verdict"):
        resolve.checked_verdicts(bad).collect()


def test_limiter_window_begins_with_the_first_call(spark):
    calls = [("k", n, ms) for n, ms in enumerate([0, 10, 20, 30, 40, 50, 59_999, 60_000])] + [("other", 99, 5)]
    got = {r.req_id: r.allowed for r in intake.rate_limit(spark.createDataFrame(calls, "key string, req_id long, ms long")).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: True, 99: True}


def test_unknown_keys(spark):
    assert one(spark, intake.unknown_keys(F.lit('{"title":1,"extra":2}'), ["title"])) == ["extra"]


def test_registry_files(spark, tmp_path):
    path = str(tmp_path / "nodes.jsonl")
    (tmp_path / "nodes.jsonl").write_text('{"id":"a:x","type":"a","title":"X"}\n\n{"id":"a:x","type":"a","title":"Y","extra":1}\n')
    nodes, edges = readers.registry(spark, path, str(tmp_path / "none.jsonl"))
    row = nodes.first()
    assert (row.title, row.aliases, row.is_terminal) == ("Y", [], False) and edges.isEmpty()
    assert readers.judge_band(spark, str(tmp_path / "none.json")) == 0.8
    report = spark.createDataFrame([(0.75, 0, "m")], "recommended_judge_band double, missed_duplicates int, model string")
    writers.write_report(report, str(tmp_path / "report"))
    assert readers.judge_band(spark, str(tmp_path / "report")) == 0.75
    assert next((tmp_path / "report").glob("part-*")).read_text() == '{"missed_duplicates":0,"model":"m","recommended_judge_band":0.75}\n'
    writers.write_report(report.drop("recommended_judge_band"), str(tmp_path / "report"))
    with pytest.raises(ValueError, match="no recommended_judge_band"):
        readers.judge_band(spark, str(tmp_path / "report"))
    assert readers.seeded(nodes, nodes).count() == 1


def test_snapshot_is_written_only_if_it_changed(spark, tmp_path):
    nodes = spark.createDataFrame([("a:x", "a", "X"), ("a:y", "a", "Y")], "id string, type string, title string")
    edges = spark.createDataFrame([("a:x->a:y", "a:x", "a:y")], "id string, from_id string, to_id string")
    path = str(tmp_path / "snap")
    assert writers.write_snapshot(nodes, edges, path, "one") is True
    assert writers.write_snapshot(nodes.orderBy("title"), edges, path, "two") is False
    with pytest.raises(snapshot.InvalidSnapshot):
        writers.write_snapshot(nodes.filter("id = 'a:x'"), edges, path, "three")
    assert "one" in spark.read.text(f"{path}/manifest").first()[0]
    docs = spark.createDataFrame([("n", "body")], "name string, body string")
    assert writers.sync_documents(docs, str(tmp_path / "docs")) == 1
    assert writers.sync_documents(docs, str(tmp_path / "docs")) == 0


def test_a_broken_move_is_recovered(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    writers.overwrite(spark.range(3), path)
    os.rename(path, f"{path}.old")
    assert spark.read.parquet(writers.recovered(spark, path)).count() == 3
    writers.overwrite(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not os.path.exists(f"{path}.old")


def test_guarded_calls():
    from graphloom.operators import service

    waits, seen = [], []

    def flaky(request):
        seen.append(request)
        if len(seen) < 3:
            raise OSError("busy")
        return "ok" if "not valid" in request else "nonsense"

    assert service.call("ask", flaky, lambda a: None if a == "ok" else "say ok", sleep=waits.append) == "ok"
    assert waits == [0.5, 1.0] and seen[-1].endswith("say ok")
    with pytest.raises(ValueError, match="never right"):
        service.call("ask", lambda r: "x", lambda a: "never right", sleep=waits.append)


def test_a_service_that_is_down_stops_the_job(spark):
    from graphloom.operators import service

    def down(request):
        raise OSError("no service")

    requests = spark.createDataFrame([(str(i), "r") for i in range(4)], "key string, request string").coalesce(1)
    rows = service.answers(requests, down, attempts=1).collect()
    assert len(rows) == 4 and all(r.error == "no service" for r in rows)
    more = requests.unionByName(requests).coalesce(1)
    with pytest.raises(Exception, match="5 failures in a row"):
        service.answers(more, down, attempts=1).collect()


def test_neighbours_equal_brute_force_in_small_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"n{i}", f"t{i % 2}", (rng.integers(-3, 4, 4) / 2).tolist(), i) for i in range(60)]
    rows += [("same1", "t0", rows[0][2], 70), ("same2", "t0", rows[0][2], 71), ("zero", "t0", [0.0] * 4, 72), ("none", "t0", None, 73), ("alone", "t9", [1.0] * 4, 74)]
    v = spark.createDataFrame(rows, "id string, type string, vec array<double>, pos long")
    got = {}
    for r in resolve.nearest(v, v, 4, block=7).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.id)
    for q, kind, a, _ in rows:
        if a is None:
            continue
        scored = []
        for i, t, b, pos in rows:
            if b is not None and t == kind and i != q:
                scale = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(np.dot(a, b) / scale), 9) if scale else 0.0, pos, i))
        assert got.get(q, []) == [i for _, _, i in sorted(scored)[:4]]


def test_blocks_that_cannot_hold_a_neighbour_are_left_out(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    rows = [(f"n{i}", "t", (centres[i % 12] + 0.02 * rng.standard_normal(16)).tolist(), i) for i in range(720)]
    v = spark.createDataFrame(rows, "id string, type string, vec array<double>, pos long").repartition(3)
    stats = {}
    got = {}
    for r in resolve.nearest(v, v, 3, block=20, stats=stats).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.id)
    m = np.array([r[2] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    scores = m @ m.T
    np.fill_diagonal(scores, -2)
    for i, best in enumerate(np.argsort(-scores, axis=1, kind="stable")[:, :3]):
        assert set(got[f"n{i}"]) == {f"n{j}" for j in best}
    assert stats["pairs"] > 1000 and stats["scored"] < 0.5 * stats["pairs"]


def test_rubric_section_and_frontier(spark, tmp_path):
    from graphloom.functions import pages

    body = "# Guide\n\n## Table of rules\n1. one\n2. two\n\n## Other\nx"
    assert one(spark, pages.markdown_section(F.lit(body), "Table of rules")) == "1. one\n2. two"
    path = str(tmp_path / "frontier.json")
    assert writers.start_frontier(spark, path, "a:x") and not writers.start_frontier(spark, path, "b:y")
    row = readers.frontier(spark, path).first()
    assert (row.id, row.depth, row.expanded) == ("a:x", 0, False)
    assert one(spark, text.today("2020-02-03")) == "2020-02-03"


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    gone = spark.createDataFrame([("b",)], "k string")
    assert [tuple(r) for r in writers.upsert(old, new, ["k"], gone).collect()] == [("a", 9)]
