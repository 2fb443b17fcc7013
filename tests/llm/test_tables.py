"""Operators on pages and vectors, and the registered queries' SQL."""

import math

import numpy as np
import pandas as pd
import pytest
from compare import differences
from pyspark.sql import functions as F

from graphloom.llm import htmltext, queries, topk, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    ours, theirs, rows = differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)
    assert rows > 0 and not ours and not theirs


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 2), (2, [1.0], 3), (3, None, 4), (4, [float("nan"), 1.0], 5), (5, [None, 1.0], 6), (None, [1.0, 1.0], 7), (6, [-1.0, -1.0], 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    a = 256 * 256
    assert got == [(0, 1, 1, a + 128 * 128), (0, 2, 2, a), (0, 3, 6, -a - 128 * 256)]
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5])], "vec_id long, embedding array<float>")
    again = [(r.query_id, r.rank, r.vec_id) for r in topk.search(twice, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert again == [(0, 1, 1), (0, 2, 1)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def _brute_topk(rows, k=5):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    out = set()
    for q in whole:
        if q % 50 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v)), -(2**63)), 2**63 - 1), i) for i, v in whole.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_topk_leaves_out_blocks_of_clustered_vectors(spark, monkeypatch):
    r = np.random.default_rng(3)
    heads = r.standard_normal((40, 16))
    made = [(n, (heads[n % 40] + 0.05 * r.standard_normal(16)).astype(np.float32).tolist()) for n in range(4000)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    assert {tuple(x) for x in topk.search(df, F.col("vec_id") % 50 == 0).collect()} == _brute_topk(made)
    # One group in the order of cells: fewer than half of its blocks are scored.
    batch = pd.DataFrame({"id": [n for n, _ in made], "v": [v for _, v in made]})
    ordered = next(topk._cells(iter([batch]))).sort_values(["cell", "id"])
    d_ids, d = ordered["id"].to_numpy(), topk._matrix(ordered["v"].tolist(), 16)
    asked = d_ids % 50 == 0
    monkeypatch.setattr(topk, "BLOCK", 64)
    found, scored = topk.best_in_group(d_ids[asked], d[asked], d_ids, d, 5, {})
    share = scored / (asked.sum() * -(-len(d) // 64))
    assert share < 0.5, share
    assert {(a, b, c) for a, b, c in found.itertuples(index=False)} == {(q, i, s) for q, _, i, s in _brute_topk(made)}


def test_topk_over_several_groups_and_beyond_a_long(spark, monkeypatch):
    r = np.random.default_rng(4)
    made = [(n, r.standard_normal(5).astype(np.float32).tolist()) for n in range(300)]
    for size in ("GROUP_ROWS", "PIECE_ROWS", "BLOCK", "CHUNK_GROUPS"):
        monkeypatch.setattr(topk, size, 7)
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    assert {tuple(x) for x in topk.search(df, F.col("vec_id") % 50 == 0).collect()} == _brute_topk(made)
    huge = [(n, [float(np.float32(v)), 1.0]) for n, v in enumerate([3e38, 3e38, -3e38, 1e12, -1e12, 0.0, 2.5])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    assert {tuple(x) for x in topk.search(df, F.col("vec_id") % 50 == 0).collect()} == _brute_topk(huge)


def test_warc_edges(spark):
    long = "<p>" + "é" * 60_000
    rows = [(1, "http://x/ y", long), (2, None, long), (3, "u", None), (None, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", "\r\n\r\nWARC/1.1 " * 30), (1, "again", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    kinds = sorted((r[0] is None, r[0] or 0, r[1], r[3], r[4]) for r in got)
    assert kinds == sorted([
        (False, 1, 120_003, "response", None), (False, 1, 120_003, "revisit", 1), (False, 2, 120_003, "revisit", 1), (True, 0, 120_003, "revisit", 1),
        (False, 3, 0, "response", None), (False, 4, 5, "response", None), (False, 5, 5, "response", None), (False, 6, 390, "response", None)])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunked_framing_and_segments():
    assert warc.dechunked(warc.chunked(b"x" * 10_000)) == b"x" * 10_000 and warc.dechunked(warc.chunked(b"")) == b""
    for broken in (b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"0\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)
    part = lambda n, b, t=None: {"segment": n, "block": b, "total": t}
    assert warc.joined_segments([part(2, b"b", 2), part(1, b"a")]) == b"ab"
    for wrong in ([part(1, b"a"), part(3, b"b", 2)], [part(1, b"a"), part(2, b"b", 3)], [part(1, b"a"), part(2, b"b")]):
        with pytest.raises(ValueError):
            warc.joined_segments(wrong)


def test_archives_of_many_members_and_broken_records(spark, tmp_path):
    import gzip
    import hashlib

    def record(n, body, kind="response", length=None):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = f"WARC/1.1\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:{n}>\r\nX-Page-Id: {(1 << 53) + n}\r\nContent-Length: {length or len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    whole = [record(n, b"page %d" % n) for n in range(1, 6)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, [record(0, b"", "warcinfo"), *whole])))
    got = {r.page_id: r.payload_digest for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {(1 << 53) + n: hashlib.sha256(b"page %d" % n).hexdigest() for n in range(1, 6)}
    bad = [record(6, b"x", length=9999), record(7, b"good"), b"junk\r\n", record(8, b"also good")]
    (tmp_path / "b.warc").write_bytes(b"".join(bad))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record(9, b"nine")) + gzip.compress(record(10, b"cut"))[:-12])
    with pytest.raises(Exception):
        warc.read_archives(spark, str(tmp_path)).collect()
    kept = {r.page_id - (1 << 53) for r in warc.read_archives(spark, str(tmp_path), skip=True).collect()}
    assert kept >= {1, 2, 3, 4, 5, 7, 8, 9} and 6 not in kept


PAGE = """<html><body class="nav-open"><header><h1>Site</h1></header><div class="menu">m</div><div id="wrap12"><div class="post-body{n}">
<h2>T &amp; U</h2><p>First para &eacute; with <a href=x>link</a> text that is long enough.<p>Second&nbsp;para <b>bo</b>ld<br>line</div>
<section class="comments"><p>very long comment text very long comment text very long comment text very long comment</p></section></div>
<aside>side</aside><div class="cookie-notice">cookies</div><form><p>f</p></form><script>var t="</p>";</script><footer>foot</footer>"""


def test_main_text(spark):
    rows = [(n, "http://a.org/x", PAGE.format(n=n)) for n in range(4)] + [
        (10, "http://b.org/", "<nav>n</nav><article><h1>H</h1><p>one<p>two</article>"), (11, None, None), (12, "x", ""), (13, "http://b.org/2", "plain text"), (None, "http://a.org/", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in htmltext.digest(pages).collect()}
    assert got[0].text == "T & U First para é with link text that is long enough. Second para bold line"
    assert got[10].text == "H one two" and got[11].text == got[12].text == "" and got[13].text == "plain text"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == 9
    assert htmltext.digest(pages.limit(0)).count() == 0


def test_host_path_wins_over_a_page_of_its_own(spark):
    body = "<div class=story><p>{}</p></div><div class=extra><p>{}</p></div>"
    rows = [(n, "http://h.org/", body.format("word " * 80, "few words")) for n in range(5)] + [(9, "http://h.org/", body.format("short story", "much longer extra text " * 9))]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short story"


def test_segmented_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert warc.round_trip(pages).count() == pages.count()


def test_raw_elements_end_at_their_own_end_tag_alone():
    body = "<p>The body of the page.</p>"
    for raw in ("<script>for(i=0;i<n;i++){f(i)}</script>", "<script>var a = '<!--';</script>", "<style>a:before{content:'<b'}</STYLE >",
                "<script>if(a<b)g('<p title=\"')</script>", "<script>x</scripts>y</script>", "<textarea><!-- a <b </textarea>",
                "<script>", "<noscript>", "<svg/>", "<title>a<b</title>"):
        for html in (f"<html><body>{raw}{body}</body></html>", f"<div>{body}{raw}</div>"):
            assert htmltext.extract(html, []) == "The body of the page.", html


def test_articles_keep_what_the_contract_does_not_name():
    html = "<article><p>Energy is <math>E</math> here.</p><div class='legal'>The court held so.</div><ul class=tags><li>one</ul><div class='side-by-side'>pair</div></article>"
    assert htmltext.extract(html, []) == "Energy is E here. The court held so. one pair"


def test_extreme_pages_cost_what_their_size_does():
    import time

    began = time.perf_counter()
    for page, want in (("<a x='" * 30_000, None), ("<div>" * 60_000 + "deep text" + "</div>" * 60_000, "deep text"), ("<b>" * 20_000 + "</i>" * 20_000 + "x", "x"),
                       ('<p title="' * 20_000 + ">", None), ("<p>a<i>" * 20_000, None), ("<" * 200_000, None), ("<!--" * 100_000, "")):
        got = htmltext.extract(page, [])
        assert want is None or got == want
        htmltext.candidates(page)
    assert time.perf_counter() - began < 40


def test_names_that_only_mention_a_part_keep_the_article():
    body = "<article><h1>Title</h1><p>The whole article stands here.</p>{}</article>"
    want = "Title The whole article stands here."
    for wrapper in ("class='content has-sidebar'", "id=page class='header-fixed'", "class='page no-sidebar'", "class='layout widget'", "class='main_content with-banner'"):
        for tag in ("div", "main"):
            html = f"<body><div class=site-header>Site</div><{tag} {wrapper}>{body.format('')}</{tag}><div class='comment-list'>said</div><div id=sidebar-left>side</div></body>"
            assert htmltext.extract(html, []) == want, wrapper
    for inner in ("share-price", "related-work", "alert", "comments-on-kant", "social-history"):
        assert htmltext.extract(body.format(f"<div class='{inner}'>And more.</div>"), []) == f"{want} And more.", inner
    for inner in ("share-buttons", "related-posts", "ad", "ad-300x250", "cookie-notice", "post-comments", "newsletter_signup", "comments2"):
        assert htmltext.extract(body.format(f"<div class='{inner}'>And more.</div>"), []) == want, inner
    talk = "<div class=comments>" + "<article><p>A comment longer than the article itself.</p></article>" * 9 + "</div>"
    assert htmltext.extract(f"<body>{body.format('')}{talk}</body>", []) == want


def test_generated_pages_give_their_text(spark):
    import random

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for n in range(40):
        paragraphs = [line(r.randint(8, 60)) for _ in range(r.randint(2, 6))]
        wrapper = r.choice(["content has-sidebar", "wrap header-fixed", "page no-sidebar", "main-wrapper"])
        boxes = [f"<div class='{c}'><p>{line(6)}</p></div>" for c in r.sample(["ad", "related-posts", "share-bar", "cookie-notice", "comment-list"], 3)]
        article = "".join(f"<p>{p}</p>" + (f"<div class=ad>{line(3)}</div>" if r.random() < 0.3 else "") for p in paragraphs)
        html = f"<html><body class='nav-open'><nav>{line(4)}</nav><div class='{wrapper}'><div class=story{n % 3}><h1>t{n}</h1>{article}</div></div>{''.join(boxes)}<footer>{line(5)}</footer></body></html>"
        rows.append((n, f"http://h{n % 4}.org/{n}", html))
        want[n] = " ".join([f"t{n}", *paragraphs])
    got = {x.page_id: x.text for x in htmltext.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
