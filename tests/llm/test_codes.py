"""Product codes and the trees behind them."""

import hashlib
import random

import numpy as np

from graphloom.llm import codes
from graphloom.llm.gnat import Gnat


def test_gnat_equals_a_scan_with_ties_and_equal_entries():
    rng = np.random.default_rng(3)
    for n, dims, spread, degree, leaf in [(1, 4, 5, 8, 6), (5, 4, 2, 8, 6), (64, 4, 300, 8, 6), (64, 2, 2, 8, 6), (200, 3, 4, 3, 2), (500, 4, 1 << 24, 6, 4), (40, 1, 1, 8, 6)]:
        entries = rng.integers(-spread, spread + 1, (n, dims))
        queries = np.concatenate([rng.integers(-spread, spread + 1, (400, dims)), entries])
        tree = Gnat(entries, degree, leaf)
        index, gap = tree.nearest(queries)
        all_gaps = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == all_gaps.argmin(axis=1)).all() and (gap == all_gaps.min(axis=1)).all()
        assert tree.computed <= tree.scanned


def test_gnat_leaves_subtrees_out_of_clustered_entries():
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (12, 4))
    entries = np.concatenate([c + rng.integers(-20, 20, (20, 4)) for c in centres])
    tree = Gnat(entries)
    tree.nearest(entries + rng.integers(-5, 5, entries.shape))
    assert tree.computed < 0.3 * tree.scanned


def brute(rows):
    """The contract in plain Python, for vectors of one length."""
    import math

    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = len(kept[0][1]) // 16
    part = lambda v, p: v[p * step : (p + 1) * step]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(x, book):
        return min(range(len(book)), key=lambda i: (gap(x, book[i]), i))

    for _ in range(2):
        for p in range(16):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v, p), books[p]), []).append(part(v, p))
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, lab in kept:
        at = [near(part(v, p), books[p]) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for e in at), sum(gap(part(v, p), books[p][e]) for p, e in enumerate(at)), lab))
    per = {}
    for _, _, error, lab in out:
        per[lab] = per.get(lab, 0) + error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, per[lab], sha) for i, c, e, lab in out), key=str)


def test_codes_equal_brute_force(spark):
    r = random.Random(9)
    rows = [(n, [r.choice([r.uniform(-1, 1), 0.25, -0.5]) for _ in range(32)], r.choice([None, 1, 2])) for n in range(150)]
    rows += [(7, rows[8][1], 1), (7, rows[7][1], 1), (None, rows[3][1], None), (1000, None, 1), (1001, [float("nan")] * 32, 1), (1002, [None] + [0.5] * 31, 2), (1003, [float("inf")] * 32, 2)]
    rows += [(2000 + n, [0.125] * 32, 5) for n in range(100)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    got = sorted((tuple(x) for x in codes.digest(df.repartition(5)).collect()), key=str)
    single = [(i, v and [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert got == brute(single)


def test_codes_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert codes.digest(spark.createDataFrame([], schema)).count() == 0
    assert codes.digest(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [], None), (3, [1e300, -1e300, 0.0], 1)], schema)
    got = {x.vec_id: x for x in codes.digest(few).collect()}
    assert {k: x.error for k, x in got.items()} == {1: 0, 2: 0, 3: 0} and all(len(x.code) == 32 for x in got.values())


def test_decoding_gives_entries_within_the_error(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vec")
    books = codes.fit(rows)
    coded = codes.encode(rows, books)
    back = {x.id: (x.vec, x.error) for x in codes.decode(coded, books).collect()}
    for x in rows.collect():
        vec, error = back[x.id]
        assert sum((np.floor(256 * np.float64(a)) - 256 * b) ** 2 for a, b in zip(x.vec, vec)) == error
