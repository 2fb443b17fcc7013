"""Entity resolution: exact gate, cosine shortlist, judge, mint, ledger."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.vectors import cosine, dot
from ..runtime import materialize

SHORTLIST = 3
NEIGHBOURS = 5
DEFAULT_BAND = 0.6


def alias_index(nodes: DataFrame) -> DataFrame:
    """(type, norm, id): the node of each normalised surface, last one wins.
    ``nodes`` needs a position ``pos``."""
    names = F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = nodes.select("id", "type", "pos", names.alias("name")).select(
        "id", "type", "pos", text.normalize_title("name").alias("norm")
    )
    return rows.groupBy("type", "norm").agg(F.max_by("id", "pos").alias("id"))


def exact_gate(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """``candidates`` (type, title, ...) with ``matched_id`` where the index
    knows their normalised title."""
    return (
        candidates.withColumn("norm", text.normalize_title("title"))
        .join(index.withColumnRenamed("id", "matched_id"), ["type", "norm"], "left")
        .drop("norm")
    )


def new_aliases(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, aliases) after adding ``aliases`` (id, surface): verbatim repeats
    and those that normalise to the node's own title are left out."""
    fresh = (
        aliases.join(nodes.select("id", "title", "aliases"), "id")
        .filter(~F.array_contains("aliases", F.col("surface")))
        .filter(text.normalize_title("surface") != text.normalize_title("title"))
        .groupBy("id").agg(F.array_sort(F.collect_set("surface")).alias("more"))
    )
    return nodes.join(fresh, "id", "left").select(
        "id", F.when(F.col("more").isNull(), F.col("aliases")).otherwise(F.array_union("aliases", "more")).alias("aliases")
    )


BLOCK = 1024
#: Random planes by whose sides vectors are dealt to blocks.
PLANES = 16
#: Bytes of vectors that a task holds, and of queries that pass by them there.
SHELF_BYTES = 1 << 23
SLOT_BYTES = 1 << 25
#: Queries and vectors of one matrix product, and numbers summed at once.
QUERIES, COLUMNS, SUMMED = 512, 2048, 1 << 21
_PACKED = "grp string, block long, ids array<string>, pos array<long>, matrix binary, centre array<double>, radius double"


def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((dims, PLANES))


def _unit(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(np.float64)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


@F.pandas_udf(T.LongType())
def _side(vectors: pd.Series) -> pd.Series:
    """One bit for each plane a vector is above: near ones share most."""
    out = np.empty(len(vectors), dtype=np.int64)
    sizes = vectors.map(len).to_numpy()
    for dims in np.unique(sizes):
        at = sizes == dims
        above = _unit(vectors[at]) @ _planes(dims) > 0
        out[at] = above @ (1 << np.arange(PLANES)[::-1])
    return pd.Series(out)


def packed_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (grp, id, pos, vec) as blocks of about ``block`` unit vectors
    of one group, each with its centre and the angle round it that holds all
    of its vectors.  A block is a cell of as many leading planes as the group
    needs; crowded cells are dealt on by hash."""
    sided = rows.withColumn("side", _side("vec"))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    bits = F.least(F.lit(PLANES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / block)).cast("int")))
    celled = sided.join(sizes, "grp").withColumn("cell", F.floor(F.col("side") / F.pow(F.lit(2.0), F.lit(PLANES) - bits)).cast("long"))
    crowd = celled.groupBy("grp", "cell").agg(F.count("*").alias("in_cell"))
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("in_cell") / block)).cast("long")
    dealt = celled.join(crowd, ["grp", "cell"]).select("grp", (F.col("cell") * (1 << 40) + salt).alias("block"), "id", "pos", "vec")

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        m = _unit(frame["vec"])
        centre = m.mean(axis=0)
        length = np.sqrt(centre @ centre)
        centre = centre / length if length > 0 else centre
        # A vector without length has cosine 0 with all: a quarter turn covers it.
        radius = float(np.arccos(np.clip(m @ centre, -1, 1)).max()) if length > 0 else np.pi
        return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "ids": [frame["id"].tolist()], "pos": [frame["pos"].tolist()],
                             "matrix": [m.tobytes()], "centre": [centre.tolist()], "radius": [radius + 1e-9]})

    return dealt.groupBy("grp", "block").applyInPandas(pack, _PACKED)


def _grouped(df: DataFrame, position: Column, same_type: bool) -> DataFrame:
    """(grp, id, pos, vec): groups of one type, or of all, and one length."""
    kind = F.coalesce(F.col("type"), F.lit("")) if same_type else F.lit("")
    return df.filter("vec IS NOT NULL AND id IS NOT NULL").select(
        F.concat(kind, F.lit("/"), F.size("vec").cast("string")).alias("grp"), F.col("id").cast("string").alias("id"), position.cast("long").alias("pos"), "vec"
    )


def _pair_scores(q: np.ndarray, m: np.ndarray, at: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Scores of stated pairs, summed in the same order for each, so that
    copies tie wherever they lie."""
    each = max(1, SUMMED // max(1, q.shape[1]))
    parts = [(q[at[i : i + each]] * m[col[i : i + each]]).sum(axis=1) for i in range(0, len(at), each)]
    return np.round(np.concatenate(parts), 12) if parts else np.empty(0)


def _best_of(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, m: np.ndarray, own: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, column, score): the k best of the columns ``m``, the first of
    equal ones, for each query, but for those below what is known to be its
    floor (``least``, which rises as columns are met)."""
    mine = [(i, c) for i, x in enumerate(q_ids) for c in own.get(x, ())]
    mine_at, mine_col = np.array(mine, dtype=np.int64).reshape(-1, 2).T
    at, col, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for low in range(0, len(ids), COLUMNS):
        scores = q @ m[low : low + COLUMNS].T
        here = (mine_col >= low) & (mine_col < low + COLUMNS)
        scores[mine_at[here], mine_col[here] - low] = -np.inf
        # Products differ in the last digits by the shape of a matrix.
        new_at, new_col = np.nonzero(scores >= (least - 1e-9)[:, None])
        if len(new_at) > 2 * k * len(q) and k < scores.shape[1]:
            nth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            new_at, new_col = np.nonzero(scores >= (np.fmax(least, nth) - 1e-9)[:, None])
        if not len(new_at):
            continue
        new_s = _pair_scores(q, m, new_at, new_col + low)
        at, col, s = np.concatenate([at, new_at]), np.concatenate([col, new_col + low]), np.concatenate([s, new_s])
        by = np.lexsort((col, -s, at))
        by = by[s[by] >= least[at[by]]]
        place = np.arange(len(by)) - np.searchsorted(at[by], at[by])
        at, col, s = (x[by[place < k]] for x in (at, col, s))
        full = place[place < k] == k - 1
        least[at[full]] = np.maximum(least[at[full]], s[full])
    return at, col, s


def _meetings(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The blocks of a shelf, which come first and stay, and blocks of queries
    that pass by: the k best of the blocks that each wants."""
    here, shelf, laid = None, {}, None
    for batch in batches:
        for row in batch.itertuples():
            if (row.grp, row.shelf, row.slot) != here:
                here, shelf, laid = (row.grp, row.shelf, row.slot), {}, None
            ids = np.array(list(row.ids), dtype=object)
            m = np.frombuffer(row.matrix).reshape(len(ids), -1)
            if row.wanted is None:
                shelf[row.block] = ids, np.array(list(row.pos), dtype=np.int64), m
                continue
            wanted = sorted(row.wanted)
            if laid != wanted:
                d_ids, d_pos, d = (np.concatenate([shelf[b][i] for b in wanted]) for i in range(3))
                order = np.argsort(d_pos, kind="stable")
                d_ids, d_pos, d, laid, own = d_ids[order], d_pos[order], d[order], wanted, {}
                for c, x in enumerate(d_ids):
                    own.setdefault(x, []).append(c)
            floors = {f["q_id"]: f["kth"] for f in row.floors} if row.floors is not None else {}
            for low in range(0, len(ids), QUERIES):
                part = ids[low : low + QUERIES]
                least = np.array([floors.get(x, -2.0) for x in part])
                at, col, s = _best_of(part, m[low : low + QUERIES], least, d_ids, d, own, k)
                yield pd.DataFrame({"q_block": row.block, "q_id": part[at], "id": d_ids[col], "pos": d_pos[col], "score": s})


_SCORED = "q_block long, q_id string, id string, pos long, score double"


def _bytes() -> Column:
    return F.size("ids").cast("double") * F.size("centre") * 8


def nearest_blocks(left: DataFrame, right: DataFrame, k: int, stats: dict | None = None) -> DataFrame:
    """(q_id, id, pos, score, rank) of the blocks of queries ``left`` against
    the blocks ``right``, both written tables of ``packed_blocks``.

    The schedule pairs block heads (centre and angle) alone.  First each block
    of queries meets the block whose centre is nearest.  What that gives is a
    floor under its queries' k-th best scores, and of the other pairs only
    those are scored whose vectors could reach it.  ``stats`` gets the number
    of pairs and of those scored.

    Vectors are not shuffled a pair of blocks at a time: alike blocks share a
    shelf of ``SHELF_BYTES``, and a block of queries goes once to each shelf
    on which it wants any.  A shelf stands once in every slot, one for each
    ``SLOT_BYTES`` of a group's queries, so that one group spreads over tasks,
    and a task holds one shelf while the queries of its slot pass by."""
    head = lambda df, s: df.select("grp", F.col("block").alias(f"{s}block"), F.col("centre").alias(f"{s}centre"), F.col("radius").alias(f"{s}radius"))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("q_centre", "d_centre"))))
    apart = F.greatest(F.lit(0.0), angle - F.col("q_radius") - F.col("d_radius"))
    pairs = head(left, "q_").join(head(right, "d_"), "grp").select("grp", "q_block", "d_block", F.cos(F.least(apart, F.lit(math.pi))).alias("bound"), angle.alias("angle"))
    pairs = materialize(pairs, "block-pairs")
    before = Window.partitionBy("grp").orderBy("side", "d_block").rowsBetween(Window.unboundedPreceding, -1)
    shelves = right.select("grp", F.col("block").alias("d_block"), _side("centre").alias("side"), _bytes().alias("bytes"))
    shelves = materialize(shelves.select("grp", "d_block", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0.0)) / SHELF_BYTES).alias("shelf")), "shelves")
    slots = left.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum(_bytes()) / SLOT_BYTES)).cast("int").alias("slots"))
    stood = right.withColumnRenamed("block", "d_block").join(shelves, ["grp", "d_block"]).join(slots, "grp").select(
        "grp", "shelf", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("d_block").alias("block"), "ids", "pos", "matrix",
        F.lit(None).cast("array<long>").alias("wanted"), F.lit(None).cast("array<struct<q_id:string,kth:double>>").alias("floors"),
    )
    asking = left.select("grp", F.col("block").alias("q_block"), "ids", "matrix").join(slots, "grp").withColumn("slot", F.pmod(F.hash("q_block"), F.col("slots")))

    def met(schedule: DataFrame, floors: DataFrame) -> DataFrame:
        wanted = schedule.join(shelves, ["grp", "d_block"]).groupBy("grp", "q_block", "shelf").agg(F.collect_list("d_block").alias("wanted"))
        passing = asking.join(wanted, ["grp", "q_block"]).join(floors.select("q_block", "floors"), "q_block", "left").select(
            "grp", "shelf", "slot", F.col("q_block").alias("block"), "ids", F.lit(None).cast("array<long>").alias("pos"), "matrix", "wanted", "floors"
        )
        together = stood.unionByName(passing).repartition("grp", "shelf", "slot")
        return together.sortWithinPartitions("grp", "shelf", "slot", F.col("wanted").isNotNull(), "block").mapInPandas(
            lambda batches: _meetings(batches, k), _SCORED
        )

    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("grp", "q_block").orderBy("angle", "d_block"))).filter("r = 1")
    none = left.limit(0).select(F.col("block").alias("q_block"), F.lit(None).cast("array<struct<q_id:string,kth:double>>").alias("floors"))
    opening = materialize(met(first, none), "opening")
    # Without k scores yet, a query's floor is below everything.
    known = opening.groupBy("q_block", "q_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    known = known.groupBy("q_block").agg(F.collect_list(F.struct("q_id", "kth")).alias("floors"), F.min("kth").alias("least"))
    known = left.select(F.col("block").alias("q_block"), F.size("ids").alias("size")).join(known, "q_block", "left")
    known = materialize(known.select("q_block", "floors", F.when(F.size("floors") >= F.col("size"), F.col("least")).otherwise(F.lit(-2.0)).alias("floor")), "floors")
    rest = pairs.join(first.select("grp", "q_block", "d_block"), ["grp", "q_block", "d_block"], "left_anti")
    rest = rest.join(known.select("q_block", "floor"), "q_block").filter(F.col("bound") >= F.col("floor") - 1e-9)
    rest = materialize(rest, "block-rest")
    if stats is not None:
        stats |= {"pairs": pairs.count(), "scored": left.count() + rest.count()}
    both = opening.unionByName(met(rest, known))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "pos")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("q_block")


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = NEIGHBOURS, same_type: bool = True, block: int = BLOCK, stats: dict | None = None
) -> DataFrame:
    """(q_id, id, score, rank): the k most similar other vectors of each
    query; ties by position.  Both sides (id, type, vec, pos); scores are
    compared to twelve decimals.

    Vectors are brought to length one once and packed in blocks of one type
    (of any type for a stated set of queries); ``nearest_blocks`` leaves out
    pairs of blocks that cannot hold a neighbour."""
    left = materialize(packed_blocks(_grouped(queries, F.lit(0), same_type), block), "query-blocks")
    right = materialize(packed_blocks(_grouped(vectors, F.col("pos"), same_type), block), "blocks")
    # Blocks of two groups may share a number.
    named = lambda df: df.withColumn("block", F.xxhash64("grp", "block"))
    found = nearest_blocks(named(left), named(right), k, stats)
    return found.select(
        F.col("q_id").cast(queries.schema["id"].dataType).alias("q_id"), F.col("id").cast(vectors.schema["id"].dataType).alias("id"), "score", "rank"
    )


def band_judge(threshold: float) -> Callable[[DataFrame], DataFrame]:
    """A judge for offline use: the best of the shortlist is the same role if
    it is at least this similar."""

    def judge(cases: DataFrame) -> DataFrame:
        best = F.try_element_at("shortlist", F.lit(1))
        same = best["score"] >= threshold
        return cases.select(
            "case_id",
            F.when(same, "same_role").otherwise("distinct").alias("decision"),
            F.when(same, best["id"]).alias("judged_id"),
            F.lit(None).cast("string").alias("rationale"),
        )

    return judge


def checked_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts in the closed form: a same_role names an id, no other does;
    rationales are cut to 300 characters."""
    d, m = F.col("decision"), F.col("judged_id")
    known = d.isin("same_role", "distinct", "unsure")
    fits = (d == "same_role") == m.isNotNull()
    wrong = F.raise_error(F.concat(F.lit("bad verdict for case "), F.col("case_id").cast("string"))).cast("string")
    return verdicts.withColumn("decision", F.when(known & fits, d).otherwise(wrong)).withColumn(
        "rationale", F.substring("rationale", 1, 300)
    )


def resolve(
    candidates: DataFrame,
    nodes: DataFrame,
    vectors: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    band: float = DEFAULT_BAND,
) -> DataFrame:
    """Decide a batch of ``candidates`` (case_id, type, title, parent_title,
    vec) against a frozen registry.

    Returns (case_id, title, action, node_id, needs_review, score, type,
    reason, candidates) with the actions rejected_aggregate, linked_exact,
    linked_judge and minted; candidates are what the judge saw.  Within
    the batch, equal titles of a type are resolved once and share the result;
    near duplicates within one batch are not seen."""
    cleaned = text.clean_title("title")
    cases = candidates.select(
        "case_id", "type", "vec", F.col("title").alias("given"), text.looks_aggregate(text.collapse("title")).alias("aggregate"),
        F.contains("title", F.lit("|")).alias("piped"),
        F.when(text.is_bare_generic(cleaned) & F.col("parent_title").isNotNull(),
               text.qualified_title(cleaned, "parent_title")).otherwise(cleaned).alias("title"),
    )
    gated = exact_gate(cases, alias_index(nodes)).withColumn("norm", text.normalize_title("title"))
    open_cases = gated.filter("NOT aggregate AND matched_id IS NULL")
    first = open_cases.groupBy("type", "norm").agg(F.min("case_id").alias("lead"))
    leads = open_cases.join(first, open_cases["case_id"] == first["lead"], "left_semi")
    near = nearest(leads.select(F.col("case_id").alias("id"), "type", "vec"), vectors)
    shortlist = near.groupBy(F.col("q_id").alias("case_id")).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), 1, SHORTLIST).alias("shortlist"),
        F.max("score").alias("top"),
    )
    to_judge = leads.join(shortlist.filter(F.col("top") >= band), "case_id").select(
        "case_id", "type", "title", "shortlist"
    )
    verdicts = checked_verdicts(judge(to_judge)).join(to_judge.select("case_id", "shortlist"), "case_id")
    inside = F.exists("shortlist", lambda s: s["id"] == F.col("judged_id"))
    judged = leads.join(
        verdicts.select("case_id", "decision", "judged_id", inside.alias("inside"), "rationale",
                        F.element_at("shortlist", 1)["score"].alias("score"),
                        F.transform("shortlist", lambda x: F.struct(x["id"].alias("id"), F.round(x["score"], 4).alias("score"))).alias("seen")),
        "case_id", "left",
    ).withColumn("links", F.coalesce((F.col("decision") == "same_role") & F.col("inside"), F.lit(False)))
    taken = nodes.select("id")
    minted = mint_ids(judged.filter("NOT links").select("case_id", "type", "title"), taken)
    outcome = judged.join(minted, "case_id", "left").select(
        "type", "norm",
        F.when(F.col("links"), "linked_judge").otherwise("minted").alias("o_action"),
        F.when(F.col("links"), F.col("judged_id")).otherwise(F.col("minted_id")).alias("o_id"),
        (~F.col("links") & (F.coalesce(F.col("decision").isin("same_role", "unsure"), F.lit(False)))).alias("o_review"),
        F.when(F.col("links"), F.round("score", 4)).alias("o_score"), "decision", "rationale", "seen",
    )
    reason = (
        F.when(F.col("aggregate"), "aggregate title").when(F.col("matched_id").isNotNull(), "normalised title match")
        .when(F.col("decision").isNull(), "nothing near").otherwise(F.concat(F.lit("judge: "), "decision", F.coalesce(F.concat(F.lit(" - "), "rationale"), F.lit(""))))
    )
    asked = ~F.col("aggregate") & F.col("matched_id").isNull()
    return gated.join(outcome, ["type", "norm"], "left").select(
        "case_id",
        "title",
        F.when(F.col("aggregate"), "rejected_aggregate").when(F.col("matched_id").isNotNull(), "linked_exact")
        .otherwise(F.col("o_action")).alias("action"),
        F.when(F.col("aggregate"), F.lit(None)).otherwise(F.coalesce("matched_id", "o_id")).alias("node_id"),
        (~F.col("aggregate") & F.col("matched_id").isNull() & (F.col("o_review") | ((F.col("o_action") == "minted") & F.col("piped")))).alias("needs_review"),
        F.when(~F.col("aggregate") & F.col("matched_id").isNotNull(), 1.0)
        .when(~F.col("aggregate"), F.col("o_score")).alias("score"),
        "type", reason.alias("reason"), F.when(asked, F.col("seen")).alias("candidates"),
    )


def _meets(candidates: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(case_id, last): for each candidate the latest earlier one of its type
    that could change its result if it was minted: one of the same normalised
    title, or one at least as near as the candidate's fifth registry vector.

    Pairs are looked at in blocks; a row a candidate and block comes out."""
    cases = candidates.withColumn("order", F.col("case_id").cast("long"))
    near = nearest(cases.select(F.col("order").alias("id"), "type", "vec"), vectors.withColumn("id", F.col("id").cast("string")), NEIGHBOURS, block=block)
    floor = near.groupBy(F.col("q_id").alias("order")).agg(F.when(F.count("*") >= NEIGHBOURS, F.min("score")).alias("floor"))
    floored = cases.filter("vec IS NOT NULL").join(floor, "order", "left").select(
        F.concat("type", F.lit("/"), F.size("vec").cast("string")).alias("grp"), F.col("order").alias("id"), F.coalesce("floor", F.lit(-2.0)).alias("floor"), "vec")
    sizes = floored.groupBy("grp").agg(F.count("*").alias("n"))
    dealt = floored.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "ids": [frame["id"].tolist()], "floors": [frame["floor"].tolist()], "matrix": [_unit(frame["vec"]).tobytes()]})

    packed = materialize(dealt.groupBy("grp", "block").applyInPandas(pack, "grp string, block long, ids array<long>, floors array<double>, matrix binary"), "case-blocks")
    other = packed.select("grp", F.col("block").alias("o_block"), F.col("ids").alias("o_ids"), F.col("matrix").alias("o_matrix"))

    def latest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, others = np.array(list(row.ids)), np.array(list(row.o_ids))
                m, o = np.frombuffer(row.matrix).reshape(len(ids), -1), np.frombuffer(row.o_matrix).reshape(len(others), -1)
                may = (np.round(m @ o.T, 12) >= np.array(list(row.floors))[:, None]) & (others[None] < ids[:, None])
                last = np.where(may, others[None], -1).max(axis=1)
                yield pd.DataFrame({"case_id": ids[last >= 0], "last": last[last >= 0]})

    pairs = packed.select("grp", "block").join(other.select("grp", "o_block"), "grp")
    met = pairs.join(packed, ["grp", "block"]).join(other, ["grp", "o_block"]).repartition("grp", "block", "o_block").drop("grp", "block", "o_block")
    by_vector = met.mapInPandas(latest, "case_id long, last long")
    twins = cases.withColumn("norm", text.normalize_title("title")).select(
        F.col("order").alias("case_id"), F.lag("order").over(Window.partitionBy("type", "norm").orderBy("order")).alias("last")
    ).filter("last IS NOT NULL")
    return by_vector.unionByName(twins).groupBy("case_id").agg(F.max("last").alias("last"))


def resolve_in_order(
    candidates: DataFrame, nodes: DataFrame, vectors: DataFrame, judge: Callable[[DataFrame], DataFrame], band: float = DEFAULT_BAND
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What resolving ``candidates`` one after another (whole, not negative
    ``case_id``, ascending) gives, each against the registry with all that was
    minted before it: (decisions, nodes, vectors) of which the last two have
    grown.  ``nodes`` (id, type, title, aliases, pos), ``vectors`` (id, type,
    vec, pos); columns beyond these are left out.

    Runs of candidates that cannot change each other's results are resolved
    together, so near duplicates of one batch meet.  A run ends where a
    candidate could be changed by one inside it."""
    cases = materialize(candidates.withColumn("case_id", F.col("case_id").cast("long")), "cases")
    meets = materialize(cases.select("case_id").join(_meets(cases, vectors), "case_id", "left"), "meets")
    nodes = nodes.select("id", "type", "title", "aliases", F.col("pos").cast("long").alias("pos"))
    vectors = vectors.select("id", "type", "vec", F.col("pos").cast("long").alias("pos"))
    top = nodes.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    decisions, low = None, cases.agg(F.min("case_id")).first()[0]
    while low is not None:
        high = meets.filter((F.col("case_id") > low) & (F.col("last") >= low)).agg(F.min("case_id")).first()[0]
        run = cases.filter(F.col("case_id") >= low)
        run = run if high is None else run.filter(F.col("case_id") < high)
        decided = materialize(resolve(run, nodes, vectors, judge, band), "decided")
        minted = decided.filter("action = 'minted'").select(
            F.col("node_id").alias("id"), "type", "title", F.array().cast("array<string>").alias("aliases"), (F.col("case_id") + (top + 1)).alias("pos"))
        vectors = materialize(grown_vectors(vectors, decided, run.select("case_id", "type", "vec")), "vectors")
        nodes = materialize(nodes.unionByName(minted), "nodes")
        decisions = decided if decisions is None else decisions.unionByName(decided)
        low = high
    if decisions is None:
        decisions = resolve(cases, nodes, vectors, judge, band)
    return decisions, nodes, vectors


def ledger(decided: DataFrame, day: str, judge_model: str) -> DataFrame:
    """One row of the decision ledger for each case that ``resolve`` decided;
    the judge and what it saw only where one was asked."""
    judged = F.col("candidates").isNotNull()
    return decided.select(
        F.lit(day).alias("date"), F.when(F.col("action") == "rejected_aggregate", "rejected").otherwise(F.col("action")).alias("action"),
        "title", "type", "node_id", F.round("score", 4).alias("score"), "reason", F.when(judged, F.lit(judge_model)).alias("judge_model"), "candidates",
    )


def grown_vectors(vectors: DataFrame, decided: DataFrame, candidates: DataFrame) -> DataFrame:
    """``vectors`` (id, type, vec, pos) and those of the nodes that were
    minted, by the first case of each, after all that were there in order of
    the (numeric, not negative) case ids."""
    minted = decided.filter("action = 'minted'").groupBy("node_id").agg(F.min("case_id").alias("case_id"))
    top = vectors.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("top"))
    fresh = candidates.join(minted, "case_id").join(F.broadcast(top)).select(
        F.col("node_id").alias("id"), "type", "vec", (F.col("top") + 1 + F.col("case_id")).alias("pos")
    )
    return vectors.select("id", "type", "vec", "pos").unionByName(fresh)


def mint_ids(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """(case_id, minted_id): base ids, with the lowest free numbers from 2 on
    where a base is taken, in order of case_id."""
    base = candidates.select(
        "case_id", F.concat("type", F.lit(":"), text.slugify("title")).alias("base")
    )
    number = F.row_number().over(Window.partitionBy("base").orderBy("case_id"))
    wanted = base.withColumn("nth", number)
    # Numbers of a base in use already; the base itself counts as 1.
    used = taken.select(
        F.regexp_replace("id", "-([2-9]|[1-9][0-9]+)$", "").alias("base"),
        F.coalesce(F.nullif(F.regexp_extract("id", "-([2-9]|[1-9][0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1)).alias("no"),
    ).unionByName(taken.select(F.col("id").alias("base"), F.lit(1).alias("no")))
    blocked = used.join(wanted.select("base").distinct(), "base", "left_semi").groupBy("base").agg(
        F.array_sort(F.collect_set("no")).alias("blocked")
    )
    # The nth free number: n plus the blocked numbers up to it.
    free = F.aggregate(
        F.coalesce("blocked", F.array().cast("array<int>")), F.col("nth"),
        lambda at, b: F.when(b <= at, at + 1).otherwise(at),
    )
    return wanted.join(blocked, "base", "left").select(
        "case_id", F.when(free == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), free.cast("string"))).alias("minted_id")
    )


def similarity_rows(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (a, b, label) with their cosine and whether the titles are
    equal once normalised."""
    side = lambda s: vectors.select(
        F.col("id").alias(s), F.col("vec").alias(f"{s}_vec"), F.col("title").alias(f"{s}_title")
    )
    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "label", cosine("a_vec", "b_vec").alias("score"),
        (text.normalize_title("a_title") == text.normalize_title("b_title")).alias("exact"),
    )


def calibrate(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """The highest threshold below which no same_role pair falls that the
    exact gate would not catch, and how many it would miss (none)."""
    near = (F.col("label") == "same_role") & ~F.col("exact")
    low = rows.agg(
        F.min(F.when(near, F.col("score"))).alias("lowest"), F.count("*").alias("n_pairs"),
        F.count_if(F.col("label") == "same_role").alias("n_same"), F.count_if(near).alias("n_near"),
    )
    safe = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("lowest").isNull() | (t <= F.col("lowest")))
    none = F.raise_error("no threshold is safe").cast("double")
    return low.select(
        F.when(F.size(safe) > 0, F.array_max(safe)).otherwise(none).alias("band"),
        F.lit(0).cast("bigint").alias("missed"), "n_pairs", "n_same", "n_near",
    )


def report(calibrated: DataFrame, **about: str) -> DataFrame:
    """The report of a calibration, with what else is to be known ``about`` it
    (provider, model, ...)."""
    return calibrated.select(
        F.col("band").alias("recommended_judge_band"), F.col("missed").alias("missed_duplicates"),
        F.col("n_pairs").alias("labeled_pairs"), *[F.lit(v).alias(k) for k, v in about.items()],
    )


def cache_misses(texts: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Rows of ``texts`` whose key the cache (key) does not hold."""
    return texts.withColumn("key", key).join(cache.select("key"), "key", "left_anti")


def embed_misses(texts: DataFrame, cache: DataFrame, key: Column, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of all texts: known ones from the cache (key, vec), the others
    from ``embedder``, each distinct key once."""
    missing = cache_misses(texts, cache, key).dropDuplicates(["key"])
    fresh = cache.select("key", "vec").unionByName(embedder(missing).select("key", "vec"))
    return texts.withColumn("key", key).join(fresh, "key")
