"""The prefix trie of conversations, by truncation peeling.

The deepest turns come off first.  At depth d, conversations that end there
join the nodes that survived from depth d + 1, all are regrouped by their
sequence of d turns, and each group is a node: its members, children, leaves
and saved tokens are sums over what met in it.  Then every group loses its
last turn and goes on to depth d - 1.  A node is found and aggregated in the
same pass; prefixes are never expanded into rows of their own.

A sequence is known by its key: two 64-bit words, the exclusive or of a salted
hash of every (depth, turn) in it, the turns themselves entering by SHA-256.
Such a key can be summed in pieces, so no task needs a whole conversation.

How the work is dealt:

* Turns are numbered after one range shuffle by (conversation, turn, ...) of
  digests, not texts; a conversation of any length may span partitions.
* Wide depths (more than ``THIN`` distinct sequences alive) are peeled one a
  step, by a grouping with partial sums, so a prefix that a third of all
  conversations share costs a row a task.  Thin depths are peeled many at a
  step, in tasks: a step holds at most ``CELLS`` keys.  The plan of steps
  follows from a histogram of lengths; both ways give the same nodes.
* Ids of a node that very many conversations end at are packed into runs and
  streamed through SHA-256 in order, which no two tasks could share.

Defined results: rows with a null conversation id take no part; null role or
text is empty; turns are ordered by turn (null first), equal ones by role, the
text's first 64 characters and its digest; repeated rows are turns each; no
conversations give no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, scratch_path

#: Distinct sequences alive at a depth up to which a step takes many depths.
THIN = 4096
CELLS = 1 << 20
WIDE_STEP = 32
SEGMENT = 1024
RUN_BYTES = 1 << 16
HEAD = 3

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, words): the turns of each conversation from 1, as
    the SHA-256 of role and text and the number of words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").alias("at"), role.alias("role"), F.substring(text, 1, 64).alias("first"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("turn"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    keys = [F.col("conv_id"), F.col("at").asc_nulls_first(), F.col("role"), F.col("first"), F.col("turn")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(dealt.select("conv_id", "turn", "words", F.monotonically_increasing_id().alias("place")), "turns")


def _starts(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, first, before): where each partition's share of a
    conversation begins, and how many of its turns other shares hold before."""
    piece = F.shiftrightunsigned("place", 33)
    each = turns.groupBy("conv_id", piece.alias("piece")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with ``pos`` in their conversation, and (conv_id, n)."""
    starts = materialize(_starts(turns), "starts")
    placed = turns.withColumn("piece", F.shiftrightunsigned("place", 33)).join(starts.drop("n"), ["conv_id", "piece"])
    return placed.select("conv_id", (F.col("place") - F.col("first") + F.col("before") + 1).alias("pos"), "turn", "words"), starts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame, share: int = 20, heads: int = HEAD + 1) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn, words) of conversations that begin as others do,
    and (conv_id, n) of all: with h the id's CRC-32 modulo ``heads``, the first
    h turns come from conversation c - c % share, the rest are its own turns
    after the first h."""
    turns, sizes = positions(numbered(conversations))
    turns = materialize(turns, "placed")
    convs = sizes.select(
        "conv_id", "n", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % share).alias("source"),
    )
    lent = turns.filter((F.col("pos") < heads) & (F.col("conv_id") % share == 0)).groupBy(F.col("conv_id").alias("source")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn", "words"))).alias("lent")
    )
    convs = convs.join(lent, "source", "left").withColumn("lent", F.coalesce(F.filter("lent", lambda t: t["pos"] <= F.col("h")), F.array().cast("array<struct<pos:bigint,turn:binary,words:bigint>>")))
    convs = materialize(convs.withColumn("k", F.size("lent")).select("conv_id", "h", "k", "lent", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "convs")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "turn", "words")
    borrowed = convs.select("conv_id", F.explode("lent").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.turn", "t.words")
    return own.unionByName(borrowed), convs.select("conv_id", "n")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, depth, turn, words) with the key of the sequence
    up to each: running values in segments of ``SEGMENT`` turns, joined by the
    totals of the segments before."""
    hashed = turns.select(
        "conv_id", "depth", "words", F.floor((F.col("depth") - 1) / SEGMENT).alias("segment"),
        F.xxhash64(F.lit(0x5EED), "depth", "turn").alias("x1"), F.xxhash64(F.lit(0xC0DE), "turn", "depth").alias("x2"),
    ).repartition("conv_id", "segment")
    running = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = materialize(hashed.select("conv_id", "depth", "words", "segment", *[F.expr(f"bit_xor(x{i})").over(running).alias(f"k{i}") for i in (1, 2)]), "inside")
    # The last row of a full segment holds its total; short conversations have none.
    totals = inside.filter(F.col("depth") % SEGMENT == 0).select("conv_id", (F.col("segment") + 1).alias("segment"), *KEY)
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    carried = totals.select("conv_id", "segment", *[F.expr(f"bit_xor({k})").over(earlier).alias(f"c{k}") for k in KEY])
    zero = F.lit(0).cast("long")
    return inside.join(carried, ["conv_id", "segment"], "left").select(
        "conv_id", "depth", "words", *[F.col(k).bitwiseXOR(F.coalesce(F.col(f"c{k}"), zero)).alias(k) for k in KEY]
    )


def steps(lengths: list[tuple[int, int]], thin: int = THIN, cells: int = CELLS) -> list[tuple[int, int, bool]]:
    """(low, high, thin?) covering depths 1 to the longest, deepest first:
    a step peels depths high to low + 1.  ``lengths``: (length, sequences)."""
    found, alive, falling = [], 0, sorted((x for x in lengths if x[0] > 0), reverse=True)
    high = low = falling[0][0] if falling else 0
    most = 0  # alive at the shallowest depth of the step so far
    for at, (length, count) in enumerate(falling):
        alive += count
        end = falling[at + 1][0] if at + 1 < len(falling) else 0
        is_thin = alive <= thin
        if not is_thin and most and most <= thin and low < high:
            found.append((low, high, True))
            high = low
        most = alive
        while low > end:
            room = max(1, cells // alive) if is_thin else WIDE_STEP
            take = min(low - end, room - (high - low))
            if take <= 0:
                found.append((low, high, is_thin))
                high = low
                continue
            low -= take
    if low < high:
        found.append((low, high, most <= thin))
    return found


#: What moves from depth to depth: a member, and sums over the subtree.
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NODE = "depth int, k1 long, k2 long, up1 long, up2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def _peel_in_task(low: int):
    """Peel all depths above ``low`` of a bounded number of sequences."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ending: dict[int, list] = {}
        for r in frame.itertuples(index=False):
            ending.setdefault(int(r.end), []).append(r)
        alive: list[tuple] = []  # (path, conv, n_convs, n_children, n_leaves, saved)
        out = []
        for depth in range(max(ending), low, -1):
            alive += [([(p["k1"], p["k2"], p["words"]) for p in r.path], int(r.conv_id), int(r.n_convs), int(r.n_children), int(r.n_leaves), int(r.saved_tokens)) for r in ending.get(depth, [])]
            groups: dict[tuple, list] = {}
            for item in alive:
                groups.setdefault(item[0][-1][:2], []).append(item)
            alive = []
            for k, items in groups.items():
                path = items[0][0]
                conv, n, children = min(i[1] for i in items), sum(i[2] for i in items), sum(i[3] for i in items)
                leaves = sum(i[4] for i in items) if children else 1
                saved = sum(i[5] for i in items) + (n - 1) * path[-1][2]
                up = path[-2][:2] if len(path) > 1 else (None, None)
                out.append((depth, *k, *up, conv, n, children, leaves, saved))
                path.pop()
                alive.append((path, conv, n, 1, leaves, saved))
        # By column, as nullable integers: keys don't fit the floats that None would turn them into.
        return pd.DataFrame({c: pd.array(list(x), dtype="Int64") for c, x in zip(NODE_COLUMNS, zip(*out))})

    return run


def peel(keys: DataFrame, last: DataFrame, thin: int = THIN, cells: int = CELLS) -> DataFrame:
    """Nodes below the root: (depth, k1, k2, conv_id, n_convs, n_children,
    n_leaves, saved_tokens, up1, up2), the last two the parent's key.

    ``keys``: (conv_id, depth, words, k1, k2) of every turn; ``last``: those
    of each conversation's last turn."""
    spark = keys.sparkSession
    # Copies meet first: one row for each distinct sequence from here on.
    ended = materialize(last.groupBy(F.col("depth").alias("end"), *KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "ended")
    lengths = [(int(r.end), int(r.n)) for r in ended.groupBy("end").agg(F.count("*").alias("n")).collect()]
    plan = steps(lengths, thin, cells)
    if not plan:
        return spark.createDataFrame([], NODE)
    # Sequences that some step may ask for, their keys in one row a step.
    floors = sorted(low for low, _, _ in plan)
    step_of = F.size(F.filter(F.array(*[F.lit(x) for x in floors]), lambda x: x < F.col("depth"))) if len(floors) > 1 else F.lit(1)
    path = scratch_path(spark, "paths")
    (
        keys.join(ended.select("conv_id"), "conv_id", "left_semi").withColumn("step", step_of)
        .groupBy("step", "conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "k1", "k2", "words"))).alias("path"))
        .write.partitionBy("step").parquet(path)
    )
    paths = spark.read.schema("conv_id long, path array<struct<depth:bigint,k1:bigint,k2:bigint,words:bigint>>, step int").parquet(path)
    found: list[DataFrame] = []
    survivors = None  # (end, conv_id, sums): nodes without their last turn
    for low, high, is_thin in plan:
        fresh = ended.filter((F.col("end") > low) & (F.col("end") <= high)).select(
            "end", "conv_id", "n_convs", *[F.lit(0).cast("long").alias(c) for c in SUMS[1:]]
        )
        items = fresh if survivors is None else fresh.unionByName(survivors)
        of_step = paths.filter(F.col("step") == floors.index(low) + 1).select("conv_id", "path")
        items = items.join(of_step, "conv_id").withColumn("path", F.filter("path", lambda p: p["depth"] <= F.col("end")))
        if is_thin:
            bucket = F.pmod(F.col("path")[0]["k1"], F.lit(16))
            nodes = materialize(items.groupBy(bucket.alias("bucket")).applyInPandas(_peel_in_task(low), NODE), "nodes")
            found.append(nodes)
            survivors = nodes.filter(F.col("depth") == low + 1)
        else:
            items = materialize(items, "items")
            above = None
            for depth in range(high, low, -1):
                here = items.filter(F.col("end") == depth)
                here = here if above is None else here.unionByName(above)
                top = F.element_at("path", -1)
                grouped = here.groupBy(top["k1"].alias("k1"), top["k2"].alias("k2")).agg(
                    F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS], F.first("path").alias("path")
                )
                up = F.try_element_at("path", F.lit(-2))
                nodes = materialize(grouped.select(
                    F.lit(depth).alias("depth"), *KEY, up["k1"].alias("up1"), up["k2"].alias("up2"), "conv_id", "n_convs", "n_children",
                    F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(F.lit(1)).cast("long").alias("n_leaves"),
                    (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.element_at("path", -1)["words"]).alias("saved_tokens"),
                    F.slice("path", 1, F.size("path") - 1).alias("path"),
                ), "nodes")
                found.append(nodes.select(*NODE_COLUMNS))
                one = F.lit(1).cast("long").alias("n_children")
                above = nodes.select(F.lit(depth - 1).cast("long").alias("end"), "conv_id", "n_convs", one, "n_leaves", "saved_tokens", "path").select(*items.columns)
            survivors = nodes
        survivors = survivors.select(F.lit(low).cast("long").alias("end"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    out = found[0]
    for nodes in found[1:]:
        out = out.unionByName(nodes)
    # Across a step's lower edge the parent's key is that of the member's turn before.
    edges = [low for low, _, _ in plan if low > 0]
    if edges:
        before = keys.filter(F.col("depth").isin(edges)).select("conv_id", (F.col("depth") + 1).cast("int").alias("depth"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
        out = out.join(before, ["conv_id", "depth"], "left").withColumn("up1", F.coalesce("up1", "b1")).withColumn("up2", F.coalesce("up2", "b2")).select(*NODE_COLUMNS)
    return out


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256): of each (k1, k2, depth) the SHA-256 of its
    conv_ids in rising order.  Runs of ids of one range partition are packed
    into texts first, then each node's runs stream through one hash."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            depth, k1, k2, ids = (batch[c].to_numpy() for c in ("depth", "k1", "k2", "conv_id"))
            new = (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            cuts = (np.flatnonzero(new) + 1).tolist()
            texts = list(map(str, ids.tolist()))
            rows = []
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                for s in range(a, b, RUN_BYTES // 8):
                    rows.append((depth[a], k1[a], k2[a], ids[s], ",".join(texts[s : min(b, s + RUN_BYTES // 8)])))
            yield pd.DataFrame(rows, columns=["depth", "k1", "k2", "first", "run"])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            rows = []
            for d, a, b, run in zip(batch["depth"], batch["k1"], batch["k2"], batch["run"]):
                if (d, a, b) != key:
                    if state is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (d, a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(run.encode())
            yield pd.DataFrame(rows, columns=["depth", "k1", "k2", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "k1", "k2", "ends_sha256"])

    by = ["depth", "k1", "k2"]
    runs = ends.select(*by, "conv_id").repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").mapInPandas(
        pack, "depth long, k1 long, k2 long, first long, run string"
    )
    return runs.repartition(*by).sortWithinPartitions(*by, "first").mapInPandas(stream, "depth long, k1 long, k2 long, ends_sha256 string")


def build(turns: DataFrame, sizes: DataFrame, thin: int = THIN, cells: int = CELLS) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv_id, depth from 1, turn, words) of distinct depths;
    ``sizes``: (conv_id, n), conversations without turns included."""
    keys = materialize(prefix_keys(turns), "keys")
    last = materialize(keys.join(sizes.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]), "last")
    nodes = materialize(peel(keys, last, thin, cells), "trie")
    zero = F.lit(0).cast("long")
    top = nodes.filter("depth = 1").agg(
        F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), zero).alias("leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens")
    )
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").join(F.broadcast(top)).select(
        F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("up1"), F.lit(None).cast("long").alias("up2"), "conv_id",
        "n_convs", "n_children", F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens",
    )
    all_nodes = nodes.withColumn("up1", F.coalesce("up1", zero)).withColumn("up2", F.coalesce("up2", zero)).unionByName(root)
    parents = all_nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    ends = last.select("depth", *KEY, "conv_id").unionByName(sizes.filter("n = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        all_nodes.join(parents, ["depth", "up1", "up2"], "left").join(ends_digests(ends), ["depth", *KEY], "left")
        .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    )


def digest(conversations: DataFrame, thin: int = THIN, cells: int = CELLS) -> DataFrame:
    return build(*rebuilt(conversations), thin, cells)


#: CRC-32 of a text of digits, bit by bit; each -1 is one shift.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list(turn ORDER BY pos) AS own FROM t GROUP BY conv_id
), h AS (
  SELECT *, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS source FROM whole
), c AS MATERIALIZED (
  SELECT h.conv_id, list_concat(list_slice(coalesce(s.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) AS seq
  FROM h LEFT JOIN whole s ON h.source = s.conv_id
), member AS MATERIALIZED (
  SELECT conv_id, d AS depth, list_slice(seq, 1, d) AS pre, len(seq) = d AS ends
  FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM c)
), node AS MATERIALIZED (
  SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ids,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(list_filter(string_split_regex(pre[-1].t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved
  FROM member GROUP BY depth, pre
), parent AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id FROM node n LEFT JOIN node p ON n.depth = p.depth + 1 AND list_slice(n.pre, 1, n.depth - 1) = p.pre
), kids AS (
  SELECT depth - 1 AS depth, list_slice(pre, 1, depth - 1) AS pre, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2
), marked AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM parent n LEFT JOIN kids k USING (depth, pre)
), below AS (
  SELECT up AS depth, list_slice(pre, 1, up) AS pre, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM marked) GROUP BY 1, 2
)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, m.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ids, '')) AS ends_sha256
FROM marked m JOIN below b USING (depth, pre)
"""
