"""The conversation trie against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from graphloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    below = {s: [0, 0] for s in members}
    children = dict.fromkeys(members, 0)
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            below[s[:d]][0] += children[s] == 0
            below[s[:d]][1] += saved
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], *below[s], sha(sorted(c for c in m if seqs[c] == s))) for s, m in members.items()
    )


def made(seed):
    r = random.Random(seed)
    texts = ["", None, "a b", "a b\tc", "hello there x", "long " * 50, "a" * 70 + "b", "a" * 70 + "c"]
    rows = []
    for c in r.sample(range(400), 120):
        for t in range(r.choice([1, 1, 2, 3, 4, 5, 6, 40])):
            rows.append((c, t, r.choice(["user", "assistant", None]) if t > 3 else "user", r.choice(texts[:3] if t < 3 else texts)))
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(6)]
    rows += [(600, None, "user", "null turn"), (600, 1, "user", "x"), (600, None, "assistant", "y"), (600, 1, "user", "x"), (None, 1, "user", "lost"), (621, 0, "u", "only")]
    rows += [(640 + n, t, "user", "deep") for n in range(3) for t in range(30 + n)]
    return rows


@pytest.mark.parametrize("thin, cells", [(trie.THIN, trie.CELLS), (10, 64), (0, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, thin, cells):
    monkeypatch.setattr(trie, "SEGMENT", 7)
    monkeypatch.setattr(trie, "WIDE_STEP", 16)
    monkeypatch.setattr(trie, "RUN_BYTES", 64)
    rows = made(thin)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], f"{SCHEMA}, k1 string, depth int").repartition(6)
    got = sorted((tuple(x) for x in trie.digest(df, thin, cells).collect()), key=lambda x: tuple((y is not None, y) for y in x))
    assert got == sorted(brute(rows), key=lambda x: tuple((y is not None, y) for y in x))


def test_trie_edges(spark):
    assert trie.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.digest(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).count() == 0
    # Conversations 7 and 8 lose all their turns where h is large enough and no source exists.
    rows = [(c, 0, None, None) for c in range(1, 9)]
    got = sorted(tuple(x) for x in trie.digest(spark.createDataFrame(rows, SCHEMA)).select("conv_id", "depth", "n_convs").collect())
    assert got == sorted((x[0], x[1], x[3]) for x in brute(rows))
    turnless = [(c, 0, "u", "x") for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 and c % 20][:5]
    got = [tuple(x) for x in trie.digest(spark.createDataFrame(turnless, SCHEMA)).collect()]
    assert got == brute(turnless) and len(got) == 1


def test_steps_cover_every_depth_once():
    r = random.Random(2)
    for _ in range(200):
        lengths = [(n, r.choice([1, 3, 50, 5000])) for n in r.sample(range(1, 500), r.randint(1, 30))]
        plan = trie.steps(lengths, thin=r.choice([0, 10, 4096]), cells=r.choice([1, 64, 1 << 20]))
        assert plan[0][1] == max(n for n, _ in lengths) and plan[-1][0] == 0
        assert all(a[0] == b[1] for a, b in zip(plan, plan[1:])) and all(low < high for low, high, _ in plan)
