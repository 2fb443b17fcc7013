"""Near-duplicate removal at a set Jaccard similarity, by SimHash and BK-trees.

Every text gets two SimHash fingerprints of its word shingles (one hash each,
mixed two ways).  Texts are routed to shards by bands of minima of further
mixed hashes: the numbers of minima and of bands follow from the similarity
alone, so that a pair at it is met with ``RECALL`` probability at any number
of texts, and unlike texts share no shard.  In a shard, texts are searched in
a BK-tree of leaders under the Hamming distance of the two fingerprints
together.  A text proposes its ``NEAREST`` leaders within the radius, and
becomes a leader itself unless one of them is so near that the two can only be
copies.  So a shard proposes a few pairs a text, however many copies meet
there; each band takes its texts in an order of its own, so that others lead.

Shards of more than ``SHARD_ROWS`` rows are dealt to parts first, and the
leaders of all parts meet afterwards: only what a copy stands for is left out.
Where the leaders of a shard are too many as well, they are split by bits of
the fingerprints, again in several bands; after ``FURTHER_LEVELS`` splits the
parts of what is left meet two by two, each two in a row of their own.

Proposed pairs are verified by the exact Jaccard similarity of their shingle
sets and joined to components.  These proposals are a first pass that joins
most and promises nothing: afterwards every shard that holds more than one
component has all its pairs within the radius met, block by block of
``BLOCK_ROWS`` rows, and those between different components are verified too,
the nearest of each text first and pairs that others joined meanwhile left
out.  So no pair that shares a shard and lies within the radius is lost,
whatever led, and whatever the first pass left out.  Of a component the row
with the smallest id stays.

Defined results: texts of the same shingle set (exact copies, letter case
apart; all empty texts) are one node; of rows that share id and text one
stays, rows that share an id alone are separate texts; rows with a null id
always stay and stand for no other; an empty table stays empty; all columns
are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, drop_table, free_name, materialize
from .components import connected_components
from .pitman_yor import word_hashes
from .simhash import BKTree

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.995
PRINTS = 2
#: Leaders that a text proposes in a shard.
NEAREST = 3
#: Proposals of a node that are verified first.
FIRST = 2
#: Differing bits of two fingerprints (128) up to which texts are copies.
COPIES = 10
SHARD_ROWS = 4000
#: Rows of a block of a shard, of which two meet at a time.
BLOCK_ROWS = 4096
#: Pairs of a text that are verified in the first round of what the proposals
#: left; as many times more in each further round.
ROUND = 16
#: Classes of hashes (by their first seven bits) that are counted for a bound.
COUNTS = 128
FURTHER_BITS, FURTHER_BANDS, FURTHER_LEVELS = 3, 4, 8

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``words`` words, in order; of
    the whole sequence if it is shorter."""
    h = word_hashes((text or "").encode().lower())[1]
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * _MIX[i % 4]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def prints_of(hashes: np.ndarray) -> list[int]:
    out = []
    for mix in _MIX[:PRINTS]:
        h = (hashes ^ (hashes >> np.uint64(29))) * mix
        h ^= h >> np.uint64(32)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 65536):
            ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64
            )
        bits = np.packbits(ones * 2 > len(h), bitorder="little").tobytes()
        out.append(int.from_bytes(bits, "little", signed=True))
    return out


def set_key(hashes: np.ndarray) -> int:
    """One number for the whole set."""
    with np.errstate(over="ignore"):
        total = (hashes * _MIX[1] ^ (hashes >> np.uint64(32))).sum(dtype=np.uint64) ^ np.uint64(len(hashes)) * _MIX[0]
    return int(total.astype(np.int64))


def differing(similarity: float) -> float:
    """Share of fingerprint bits that differ at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def band_plan(similarity: float) -> tuple[int, int]:
    """Bands, and minima in each: as many minima as leave a pair at the
    similarity about 0.4 to agree, and bands for the recall."""
    minima = min(8, max(1, round(math.log(0.4) / math.log(min(similarity, 0.99)))))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - min(similarity, 0.99) ** minima)), minima


def band_keys(hashes: np.ndarray, bands: int, minima: int) -> list[int]:
    """The shard of a set of hashes in each band (of an empty one: none)."""
    if not len(hashes):
        return []
    odd = np.random.default_rng(minima).integers(0, 2**63, bands * minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(odd), 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        mixed = hashes[i : i + 4096][:, None] * odd
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _MIX[0]).min(axis=0))
    out = np.zeros(bands, dtype=np.uint64)
    for i, column in enumerate(least.reshape(bands, minima).T):
        out = (out ^ column) * _MIX[i % 4]
        out ^= out >> np.uint64(31)
    return out.view(np.int64).tolist()


def counts_of(hashes: np.ndarray) -> list[int]:
    """How many hashes fall into each of ``COUNTS`` classes, a byte each, eight
    in a number; all zero, for "not known", where a byte would not hold one.
    The sum of the lesser counts of two sets is never below what they share."""
    counts = np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=COUNTS)
    if counts.max() > 255:
        counts[:] = 0
    return counts.astype(np.uint8).view(np.int64).tolist()


LED = "band int, shard long, node long, fp long, more long, leader long, apart int, leads boolean"


def _leaders(radius: int, copies: int):
    """One row a proposal, and one for each member that stays a leader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LED.split(", ")]
        for batch in batches:
            out = []
            for band, shard, nodes, fps, mores in zip(batch["band"], batch["shard"], batch["nodes"], batch["fps"], batch["mores"]):
                tree, leaders = BKTree(), []
                order = np.argsort((nodes.astype(np.uint64) + np.uint64(band + 1)) * _MIX[band % 4], kind="stable")
                for node, fp, more in zip(nodes[order].tolist(), fps[order].tolist(), mores[order].tolist()):
                    key = (fp & (2**64 - 1)) << 64 | more & (2**64 - 1)
                    near = sorted(((tree.keys[i] ^ key).bit_count(), leaders[i]) for i in tree.within(key, radius))
                    leads = not near or near[0][0] > copies
                    for apart, leader in near[:NEAREST]:
                        out.append((band, shard, node, fp, more, leader, apart, False))
                    if leads:
                        tree.add(key)
                        leaders.append(node)
                        out.append((band, shard, node, fp, more, None, 0, True))
            if out:
                columns = dict(zip(names, zip(*out)))
                # A float would not hold the key of a node.
                columns["leader"] = pd.array(columns["leader"], dtype="Int64")
                yield pd.DataFrame(columns)

    return run


def _shards(rows: DataFrame, keys: list[str], radius: int, copies: int) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.collect_list(F.struct("node", "fp", "more")).alias("members"))
        .filter(F.size("members") > 1)
        .select("band", "shard", *[F.col(f"members.{c}").alias(f"{c}s") for c in ("node", "fp", "more")])
        .mapInPandas(_leaders(radius, copies), LED)
    )


def _large(rows: DataFrame, keys: list[str]) -> DataFrame:
    return materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_ROWS), "large-shards")


def _bits(start: int, number: int) -> Column:
    """``number`` bits of both fingerprints from place ``start`` on, as one number."""
    places = np.random.default_rng(start).choice(128, number, replace=False).tolist()
    one = lambda b: F.shiftright(F.col("fp" if b < 64 else "more"), b % 64).bitwiseAND(1)
    return sum((F.shiftleft(one(b), i) for i, b in enumerate(places[1:], 1)), one(places[0]))


def radius_of(similarity: float) -> int:
    """Differing bits (of 128) up to which texts may be alike."""
    share = differing(similarity)
    return math.ceil(128 * share + 3 * math.sqrt(128 * share * (1 - share)))


def members_of(nodes: DataFrame) -> DataFrame:
    """(band, shard, node, fp, more): ``nodes`` (node, p0, p1, bands) in every
    shard where they are not alone."""
    member = nodes.select(F.posexplode("bands").alias("band", "shard"), "node", F.col("p0").alias("fp"), F.col("p1").alias("more"))
    shared = member.groupBy("band", "shard").count().filter("count > 1").drop("count")
    return materialize(member.join(shared.hint("merge"), ["band", "shard"]), "members")


def proposals(members: DataFrame, similarity: float) -> DataFrame:
    """The first candidate pairs (a, b) of ``members_of`` nodes, with the bits
    that tell them apart; ``meetings`` has the rest."""
    radius = radius_of(similarity)
    found, scratch = [], []

    def kept(df: DataFrame, label: str) -> DataFrame:
        scratch.append(materialize(df, label))
        return scratch[-1]

    def led(rows: DataFrame, keys: list[str]) -> DataFrame:
        out = kept(_shards(rows, keys, radius, COPIES), "led")
        found.append(out.filter("leader IS NOT NULL").select(F.col("node").alias("a"), F.col("leader").alias("b"), "apart"))
        return out

    keys = ["band", "shard"]
    rows = members
    large = _large(rows, keys)
    led(rows.join(large, keys, "left_anti"), keys)
    level = 0
    rows = rows.join(large, keys, "left_semi")
    while not large.isEmpty():
        level += 1
        # Members of a large shard meet in parts, then the parts' leaders meet.
        part = F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("n") / SHARD_ROWS)).cast("int")
        first = led(rows.join(large, keys).withColumn("part", part), [*keys, "part"])
        # A part's only member is a leader that met nobody.
        alone = rows.join(large, keys).withColumn("part", part)
        alone = alone.join(alone.groupBy(*keys, "part").count().filter("count = 1"), [*keys, "part"], "left_semi")
        rows = kept(
            first.filter("leads").select(*keys, "node", "fp", "more").unionByName(alone.select(*keys, "node", "fp", "more")), "leaders"
        )
        large = _large(rows, keys)
        led(rows.join(large, keys, "left_anti"), keys)
        if large.isEmpty() or level > FURTHER_LEVELS:
            if level > FURTHER_LEVELS:
                parts = F.ceil(F.col("n") * 2 / SHARD_ROWS).cast("int")
                own = rows.join(large, keys).withColumn("own", F.pmod(F.xxhash64("node", F.lit(0)), parts).cast("int"))
                other = own.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
                led(other.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")), [*keys, "low", "high"])
            break
        band = F.explode(F.array(*[F.lit(i) for i in range(FURTHER_BANDS)]))
        split = rows.join(large, keys, "left_semi").withColumn("further", band)
        bits = F.lit(None)
        for i in range(FURTHER_BANDS):
            bits = F.when(F.col("further") == i, _bits(1000 * level + i, FURTHER_BITS)).otherwise(bits)
        rows = kept(
            split.select(
                (F.col("band") * FURTHER_BANDS + F.col("further")).cast("int").alias("band"),
                F.xxhash64("band", "shard", "further", bits).alias("shard"), "node", "fp", "more",
            ),
            "further",
        )
        large = _large(rows, keys)
        led(rows.join(large, keys, "left_anti"), keys)
        rows = rows.join(large, keys, "left_semi")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = materialize(pairs.groupBy("a", "b").agg(F.min("apart").alias("apart")), "proposals")
    for table in scratch:
        drop_table(table)
    return pairs


def _met(radius: int, similarity: float):
    """(a, b, apart): the pairs of different labels within ``radius`` of two
    blocks, or of one with itself, without those whose counts show that they
    share too little."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high, owns, nodes, fps, mores, labels, counts in batch.itertuples(index=False):
                fps, mores = fps.view(np.uint64), mores.view(np.uint64)
                counts = np.stack(counts).view(np.uint8)
                sizes = counts.sum(axis=1, dtype=np.int64)
                one = np.flatnonzero(owns == low)
                other = one if low == high else np.flatnonzero(owns == high)
                for i in range(0, len(one), 64):
                    rows = one[i : i + 64]
                    apart = np.bitwise_count(fps[rows, None] ^ fps[other]) + np.bitwise_count(mores[rows, None] ^ mores[other])
                    near = (apart <= radius) & (labels[rows, None] != labels[other])
                    if low == high:
                        near &= nodes[rows, None] > nodes[other]
                    xs, ys = np.nonzero(near)
                    for k in range(0, len(xs), 65536):
                        x, y = xs[k : k + 65536], ys[k : k + 65536]
                        p, q = rows[x], other[y]
                        both = np.minimum(counts[p], counts[q]).sum(axis=1, dtype=np.int64)
                        may = (both + 1e-6 >= similarity * (sizes[p] + sizes[q] - both)) | (sizes[p] == 0) | (sizes[q] == 0)
                        a, b = nodes[p[may]], nodes[q[may]]
                        yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b), "apart": apart[x[may], y[may]].astype(np.int32)})

    return run


def meetings(members: DataFrame, nodes: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a > b) of ``members`` that share a shard and lie within the
    radius, with the bits that tell them apart, but for pairs of one component
    of ``joined`` (node, component) and pairs that the counts of ``nodes``
    (node, counts) prove to be less alike.

    A shard's rows are dealt to blocks, and any two blocks are a row of their
    own: a task holds two blocks at a time, however large the shard."""
    keys = ["band", "shard"]
    named = members.join(joined.hint("merge"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    named = materialize(named, "labelled")
    mixed = named.groupBy(*keys).agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    mixed = mixed.filter("least < most").select(*keys, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = named.join(mixed.hint("merge"), keys).join(nodes.select("node", "counts").hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(0)), F.col("blocks")).cast("int"))
    two = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = two.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    columns = ["own", "node", "fp", "more", "label", "counts"]
    blocks = two.groupBy(*keys, "low", "high").agg(F.collect_list(F.struct(*columns)).alias("members"))
    blocks = blocks.select("low", "high", *[F.col(f"members.{c}").alias(f"of_{c}") for c in columns])
    with arrow_rows(members.sparkSession, 16):
        found = materialize(blocks.mapInPandas(_met(radius_of(similarity), similarity), "a long, b long, apart int"), "met")
    drop_table(named)
    return found.groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _jaccard(words: int):
    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out, known = [], {}
        for x, y in zip(a, b):
            for t in (x, y):
                if t not in known:
                    known[t] = shingle_set(t, words)
            p, q = known[x], known[y]
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(1, len(p) + len(q) - both) if len(p) or len(q) else 1.0)
        return pd.Series(out, dtype="float64")

    return jaccard


def _signed(words: int, similarity: float):
    """The key of a text's set, its fingerprints and its shards."""
    plan = band_plan(similarity)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            sets = [shingle_set(t, words) for t in texts]
            yield pd.Series([[set_key(s), *prints_of(s), *counts_of(s), *band_keys(s, *plan)] for s in sets])

    return F.pandas_udf(run, "array<long>")


def _keepers(docs: DataFrame, id_col, text_col, similarity: float, words: int) -> DataFrame:
    """(id, text_key, set, keeper): for each id and text, the id of the row
    that stands for its group."""
    p = F.col("p")
    known = materialize(
        docs.filter(id_col.isNotNull())
        .select(id_col.alias("id"), F.xxhash64(text_col).alias("text_key"), _signed(words, similarity)(text_col).alias("p"))
        .select(
            "id", "text_key", p[0].alias("node"), p[1].alias("p0"), p[2].alias("p1"),
            F.slice(p, 2 + PRINTS, COUNTS // 8).alias("counts"),
            F.slice(p, 2 + PRINTS + COUNTS // 8, F.greatest(F.size(p) - 1 - PRINTS - COUNTS // 8, F.lit(0))).alias("bands"),
        ),
        "prints",
    )
    same = [F.first(c).alias(c) for c in ("p0", "p1", "counts", "bands")]
    nodes = materialize(known.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("first"), *same), "nodes")
    members = members_of(nodes)
    pairs = proposals(members, similarity)
    # One text a node: that of its first row.  The hints keep one plan at
    # every size.
    named = members.select("node").distinct().join(nodes.select("node", "first.*").hint("merge"), "node")
    texts = (
        docs.filter(id_col.isNotNull()).select(id_col.alias("id"), F.xxhash64(text_col).alias("text_key"), text_col.alias("text"))
        .join(named.hint("merge"), ["id", "text_key"]).groupBy("node").agg(F.first("text").alias("text"))
    )
    texts = materialize(texts, "texts")

    def verified(wanted: DataFrame) -> DataFrame:
        side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")).hint("merge")
        paired = wanted.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        with arrow_rows(docs.sparkSession, 256):
            return materialize(paired.filter(_jaccard(words)("text_a", "text_b") >= similarity).select("a", "b"), "verified")

    # The nearest of each node come first; of the others only pairs that the
    # first links did not join already are worth their texts.
    rank = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    ranked = materialize(pairs.withColumn("rank", rank), "ranked")
    edges = verified(ranked.filter(F.col("rank") <= FIRST))
    joined = materialize(connected_components(edges), "joined")

    def apart_yet(wanted: DataFrame, joined: DataFrame) -> DataFrame:
        """``wanted`` without the pairs that ``joined`` has in one component."""
        label = lambda s: joined.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
        both = wanted.join(label("a"), "a", "left").join(label("b"), "b", "left")
        return materialize(both.filter("NOT coalesce(of_a = of_b, false)").drop("of_a", "of_b"), "rest")

    rest = apart_yet(ranked.filter(F.col("rank") > FIRST), joined)
    edges = edges.unionByName(verified(rest))
    joined = materialize(connected_components(edges), "joined")
    # What no leader proposed: pairs of different components.
    seen = ranked.filter(F.col("rank") <= FIRST).select("a", "b").unionByName(rest.select("a", "b"))
    seen = seen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    unseen = meetings(members, nodes, joined, similarity).join(seen, ["a", "b"], "left_anti")
    left, most = materialize(unseen.withColumn("rank", rank), "unseen"), ROUND
    while not left.isEmpty():
        new = verified(left.filter(F.col("rank") <= most))
        left, most = left.filter(F.col("rank") > most), most * ROUND
        if not new.isEmpty():
            edges = edges.unionByName(new)
            joined = materialize(connected_components(edges), "joined")
            left = apart_yet(left, joined)
    member = nodes.join(joined, "node", "left").select("node", "first", F.coalesce("component", "node").alias("group"))
    keeper = member.groupBy("group").agg(F.min("first").alias("keeper"))
    return known.join(member.join(keeper, "group").select("node", "keeper"), "node").select("id", "text_key", "keeper")


def duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(doc_id, keeper) for every row that a row of another id stands for."""
    found = _keepers(docs, F.col("doc_id"), F.col("text"), similarity, words)
    return found.filter("keeper.id <> id").select(F.col("id").alias("doc_id"), F.col("keeper.id").alias("keeper"))


def drop_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group left."""
    found = _keepers(docs, F.col("doc_id"), F.col("text"), similarity, words)
    gone = materialize(found.filter("keeper <> struct(id, text_key)").select("id", "text_key").distinct(), "duplicates")
    repeated = materialize(found.groupBy("id", "text_key").count().filter("count > 1").select("id", "text_key"), "repeated")
    key, once = free_name(docs, "text_key"), free_name(docs, "repeated")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = lambda other: (keyed["doc_id"] == other["id"]) & (keyed[key] == other["text_key"])
    left = keyed.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    marked = repeated.withColumn(once, F.lit(True))
    same = (left["doc_id"] == marked["id"]) & (left[key] == marked["text_key"])
    single = left.join(marked, same, "left_anti").select(*docs.columns)
    many = left.join(marked, same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)
    return single.unionByName(many)
