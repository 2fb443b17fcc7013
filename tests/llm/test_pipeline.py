"""The pipeline against its stages' definitions on a small table."""

import zlib

import numpy as np

import corpus_pipeline
from graphloom.llm import decontam, neardup, secrets, toxicity
from graphloom.llm.common import materialize, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.digest(before, table(spark, sf_dir, "labels")).filter("predicted = 1").collect()}
    assert ids(after) == ids(before) - bad

    before, after = seen["near_duplicates"]
    sets = {r.doc_id: set(neardup.shingle_set(r.text, 5).tolist()) for r in before.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert ids(after) == {i for i in sets if root(i) == i}

    before, after = seen["decontamination"]
    leaks = {r.doc_id for r in decontam.contaminated(before, table(spark, sf_dir, "benchmark")).collect()}
    assert leaks and ids(after) == ids(before) - leaks

    before, after = seen["secret_scan"]
    assert ids(after) == ids(before)
    assert secrets.digest(after.select("doc_id", "text")).agg({"n_hex": "sum"}).first()[0] == 0
    assert all(r.n_chars == len(r.text) for r in after.collect())

    from tokenizers import Tokenizer

    from graphloom.llm.queries import tokenizer_path

    before, after = seen["packing"]
    tk = Tokenizer.from_file(tokenizer_path())
    tokens = {r.doc_id: [*tk.encode(r.text, add_special_tokens=False).ids, 1] for r in before.collect()}
    rows = after.collect()
    assert sum(r.length for r in rows) == sum(map(len, tokens.values()))
    for r in rows:
        part = tokens[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32


def test_empty(spark, sf_dir):
    empty = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, sf_dir), f"empty-{name}")
        assert empty.isEmpty()
