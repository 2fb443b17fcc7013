"""SimHash near-duplicates, linked through BK-trees.

Each text becomes a 64-bit fingerprint of its word shingles.  Distinct
fingerprints are routed to shards such that every pair within the radius
meets in one shard at least: 64 bits split into ``radius + 1`` blocks, one of
which a pair must share, and the remaining bits split the same way again.
Shards with many fingerprints are split further, four levels at most, beyond
which under 2**20 distinct values remain.  In a shard a BK-tree (children
keyed by their integer Hamming distance to the parent) is searched along the
edges within the radius, and the links become one star per local component.
A global component search joins the stars.

The trees are not broadcast: the number of fingerprints grows with the
input, so a tree stays in the task that holds its shard.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows keep one result each; an empty table gives none; extra
columns are ignored.  Rows whose id is null take part as copies but get a
component only from others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: A shard with more distinct fingerprints is split by more of their bits.
SHARD_ROWS = 2000
LEVELS = 4


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` words (repeats included)."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.array([digest(line[a:b], seed) for a, b in spans], dtype=np.uint64)


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, fp) with fp the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words) for t in texts], dtype="int64")

    return docs.select(F.col(id_col), fp(F.col(text_col)).alias("fp"))


def _masks(radius: int) -> list[list[int]]:
    """By level, the bit masks of all shard paths; the children of path p
    are the paths (radius + 1) * p ... of the next level."""
    fan = radius + 1
    paths = [(0, list(range(64)))]
    by_level = []
    for _ in range(LEVELS):
        grown = []
        for mask, rest in paths:
            for block in np.array_split(rest, fan):
                taken = set(block.tolist())
                grown.append((mask | sum(1 << b for b in taken), [b for b in rest if b not in taken]))
        paths = grown
        by_level.append([m - (1 << 64) if m >> 63 else m for m, _ in paths])
    return by_level


def _keys(paths: list[tuple[int, int]]) -> Column:
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard"))
                for p, m in paths
            ]
        )
    )


class BKTree:
    """Integers under Hamming distance; children keyed by distance."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int) -> int:
        self.keys.append(key)
        self.children.append({})
        new, at = len(self.keys) - 1, 0
        while new:
            d = (key ^ self.keys[at]).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return new

    def within(self, key: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.keys else []
        while stack:
            at = stack.pop()
            d = (key ^ self.keys[at]).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def _stars(radius: int):
    """For each shard, (node, smallest linked node) of its local components."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out_a, out_b = [], []
            for nodes, fps in zip(batch["nodes"], batch["fps"]):
                order = sorted((n, f & (2**64 - 1)) for n, f in zip(nodes.tolist(), fps.tolist()))
                tree, parent = BKTree(), []

                def root(i: int) -> int:
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for i, (_, key) in enumerate(order):
                    parent.append(i)
                    for j in tree.within(key, radius):
                        a, b = root(i), root(j)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                    tree.add(key)
                for i, (node, _) in enumerate(order):
                    if (r := root(i)) != i:
                        out_a.append(node)
                        out_b.append(order[r][0])
            yield pd.DataFrame({"a": out_a, "b": out_b}, dtype="int64")

    return link


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges (a, b) that connect the same nodes as all pairs of
    ``nodes`` (node, fp: distinct fingerprints) within ``radius`` do."""
    masks = _masks(radius)
    fan = radius + 1
    level = min(1, LEVELS - 1)
    rows = nodes.select("node", "fp", _keys(list(enumerate(masks[level]))).alias("k")).select("node", "fp", "k.*")
    found = None
    while True:
        shards = rows.groupBy("path", "shard").agg(F.count("*").alias("n"))
        large = None
        if level < LEVELS - 1:
            large = materialize(shards.filter(F.col("n") > SHARD_ROWS).select("path", "shard"), "shards")
            if large.isEmpty():
                large = None
        ready = rows if large is None else rows.join(large, ["path", "shard"], "left_anti")
        stars = (
            ready.groupBy("path", "shard")
            .agg(F.collect_list(F.struct("node", "fp")).alias("members"))
            .filter(F.size("members") > 1)
            .select(F.col("members.node").alias("nodes"), F.col("members.fp").alias("fps"))
            .mapInPandas(_stars(radius), "a long, b long")
        )
        found = stars if found is None else found.unionByName(stars)
        if large is None:
            return found
        level += 1
        child = F.array(*[F.lit(m) for m in masks[level]])
        rows = (
            rows.join(large, ["path", "shard"], "left_semi")
            .select("node", "fp", F.col("path").alias("up"), F.explode(F.array(*[F.lit(i) for i in range(fan)])).alias("c"))
            .withColumn("path", F.col("up") * fan + F.col("c"))
            .select("node", "fp", "path", F.col("fp").bitwiseAND(F.element_at(child, F.col("path") + 1)).alias("shard"))
        )


def components(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = materialize(fingerprints(docs, words=words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    joined = connected_components(links(nodes.filter("node is not null"), radius))
    by_print = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
