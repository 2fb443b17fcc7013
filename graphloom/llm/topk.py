"""Exact top-k by integer inner product, with block-at-a-time pruning.

Vectors are terms with signed impacts.  Rows are ordered by the cell of random
planes that they lie in, so that a range of rows is alike; ranges form groups,
and in a group blocks of at most ``BLOCK`` rows, each with a forward index (its
matrix) and the largest and smallest impact of every term.  For one query, the
sum over terms of the larger of ``q * max`` and ``q * min`` bounds every score
in a block.  A query visits blocks in order of falling bound and stops once the
bound is below its k-th best score; a block whose bound equals that score is
still scored, so ties go to smaller ids exactly.

Queries (a stated set) come in pieces, cut in the order of cells too.  A piece
meets first the group that promises most; the k-th best score that each of its
queries has there goes with it to the other groups, and those whose bounds are
below it for every query of the piece are never visited.  Groups stay where
they are shuffled to once and pieces come to them; only the k best of each
meeting go to the final ranking.  No task holds all queries or all vectors.
Where vectors have no structure, bounds rule nothing out and every piece meets
every group.

Defined results: vectors that are null or hold null or non-finite components
take no part, neither as query nor as candidate; vectors shorter than the
longest count as padded with zeros; rows with a null id take no part; rows
that share an id are one query, with the smallest of their vectors, and not
candidates of it, but candidates of others once each; scores beyond a long's
range count as its nearest end; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 256
GROUP_ROWS = 16384
PIECE_ROWS = 256
CHUNK_GROUPS = 1024
SCALE = 256
PLANES = 24
SEED = 9

PACKED = "ids binary, mat binary, n int, dims int, high binary, low binary"
LONG = np.iinfo(np.int64)


def _matrix(vectors, dims: int) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold it exactly whatever its size."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(SCALE * np.asarray(v, dtype=np.float64))
    return out


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The side of each random plane that a vector is on, as bits."""
    for batch in batches:
        dims = max(map(len, batch["v"]), default=0)
        planes = np.random.default_rng(SEED).standard_normal((dims, PLANES))
        # A common scale changes no side, and keeps large values finite.
        m = _matrix(batch["v"].tolist(), dims)
        sides = m / max(np.abs(m).max(initial=0), 1.0) @ planes > 0
        yield batch.assign(cell=sides @ (1 << np.arange(PLANES, dtype=np.int64)))


def _packer(rows_each: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def out() -> pd.DataFrame:
            rows = pd.concat(held)
            dims = max(map(len, rows["v"]))
            ids, m = rows["id"].to_numpy(np.int64), _matrix(rows["v"].tolist(), dims)
            return pd.DataFrame(
                {
                    "ids": [ids.tobytes()],
                    "mat": [m.tobytes()],
                    "n": [len(ids)],
                    "dims": [dims],
                    "high": [m.max(axis=0).tobytes()],
                    "low": [m.min(axis=0).tobytes()],
                }
            )

        for batch in batches:
            for at in range(0, len(batch), rows_each):
                part = batch.iloc[at : at + rows_each]
                while len(part):
                    take = part.iloc[: rows_each - count]
                    held.append(take)
                    count += len(take)
                    part = part.iloc[len(take) :]
                    if count == rows_each:
                        yield out()
                        held, count = [], 0
        if count:
            yield out()

    return pack


def _unpack(ids, mat, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(mat).reshape(n, dims)


def _pad(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def _alike(q: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Matrices of one width, in numbers in which their products are exact:
    doubles below 2**53, where products are fast, else whole numbers."""
    dims = max(q.shape[1], *[m.shape[1] for m in others])
    widest = max(float(np.abs(m).max(initial=0)) for m in others)
    padded = [_pad(m, dims) for m in (q, *others)]
    if float(np.abs(q).max(initial=0)) * widest * dims < 2**53:
        return padded
    whole = np.frompyfunc(int, 1, 1)
    return [whole(m).reshape(m.shape) for m in padded]


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, a bound of its scores there."""
    return _in_range(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)


def _in_range(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, LONG.min, LONG.max) if scores.dtype == object else scores


def best_in_group(q_ids, q, d_ids, d, k: int, floors: dict[int, int]) -> tuple[pd.DataFrame, int]:
    """The k best rows of one group for each query of one piece, but for those
    below the query's floor; and the number of blocks scored."""
    q, d = _alike(q, d)
    starts = range(0, len(d_ids), BLOCK)
    high = np.stack([d[s : s + BLOCK].max(axis=0) for s in starts])
    low = np.stack([d[s : s + BLOCK].min(axis=0) for s in starts])
    bounds = _bounds(q, high, low)
    out_q, out_v, out_s, scored = [], [], [], 0
    for i, qid in enumerate(q_ids):
        best_s, best_v = np.empty(0, d.dtype), np.empty(0, np.int64)
        least = floors.get(int(qid), LONG.min)
        for b in np.argsort(-bounds[i], kind="stable"):
            if bounds[i, b] < least:
                break
            s = b * BLOCK
            ids, scores = d_ids[s : s + BLOCK], _in_range(d[s : s + BLOCK] @ q[i])
            scored += 1
            good = (ids != qid) & (scores >= least)
            if good.any():
                all_s, all_v = np.concatenate([best_s, scores[good]]), np.concatenate([best_v, ids[good]])
                keep = np.lexsort((all_v, -all_s))[:k]
                best_s, best_v = all_s[keep], all_v[keep]
                if len(best_s) >= k:
                    least = max(least, int(best_s[-1]))
        out_q += [qid] * len(best_s)
        out_v += best_v.tolist()
        out_s += [int(x) for x in best_s]
    return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s}, dtype="int64"), scored


def _floors(row) -> dict[int, int]:
    return {f["query_id"]: f["least"] for f in row.floors} if row.floors is not None else {}


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names and extreme impacts of many groups in one row."""
    for batch in batches:
        for at in range(0, len(batch), CHUNK_GROUPS):
            part = batch.iloc[at : at + CHUNK_GROUPS]
            dims = int(part["dims"].max())
            sides = [np.stack([_pad(np.frombuffer(x)[None], dims)[0] for x in part[c]]) for c in ("high", "low")]
            yield pd.DataFrame(
                {
                    "c_groups": [part["g"].to_numpy(np.int64).tobytes()],
                    "c_high": [sides[0].tobytes()],
                    "c_low": [sides[1].tobytes()],
                    "c_n": [len(part)],
                }
            )


def _scheduler(first: bool):
    """Of the groups of a chunk, for each piece: the one that promises most
    (``first``), or those in which a query's bound reaches its floor."""

    def schedule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                q_ids, q = _unpack(row.ids, row.mat, row.n, row.dims)
                high, low = (np.frombuffer(m).reshape(row.c_n, -1) for m in (row.c_high, row.c_low))
                bounds = _bounds(*_alike(q, high, low))
                groups = np.frombuffer(row.c_groups, dtype=np.int64)
                if first:
                    total = bounds.astype(float).sum(axis=0)
                    g, promise = groups[[total.argmax()]], total[[total.argmax()]]
                else:
                    floors = _floors(row)
                    least = np.array([floors.get(int(x), LONG.min) for x in q_ids], dtype=bounds.dtype if bounds.dtype == object else np.int64)
                    open_ = (bounds >= least[:, None]).any(axis=0) & (groups != row.home)
                    g, promise = groups[open_], np.zeros(int(open_.sum()))
                yield pd.DataFrame({"p": row.p, "g": g, "promise": promise})

    return schedule


def _meeter(k: int):
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                d_ids, d = _unpack(row.ids, row.mat, row.n, row.dims)
                q_ids, q = _unpack(row.q_ids, row.q_mat, row.q_n, row.q_dims)
                yield best_in_group(q_ids, q, d_ids, d, k, _floors(row))[0].assign(p=row.p)

    return meet


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for
    every row where the condition ``is_query`` holds."""
    sound = F.col(vec_col).isNotNull() & F.forall(
        vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = vectors.filter(sound & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("is_query")
    )

    def packed(df: DataFrame, rows_each: int, name: str, label: str) -> DataFrame:
        with_cells = df.mapInPandas(_cells, f"id long, v {df.schema['v'].dataType.simpleString()}, cell long")
        in_order = with_cells.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").select("id", "v")
        out = in_order.mapInPandas(_packer(rows_each), PACKED)
        return materialize(out.withColumn(name, F.monotonically_increasing_id()), label)

    groups = packed(rows.select("id", "v"), GROUP_ROWS, "g", "topk-groups")
    queries = rows.filter("is_query").groupBy("id").agg(F.min("v").alias("v"))
    pieces = packed(queries, PIECE_ROWS, "p", "topk-pieces")

    # Every piece meets every chunk of group summaries in a slot of its own.
    slots = max(pieces.count(), 1)
    chunks = groups.select("g", "dims", "high", "low").mapInPandas(
        _chunks, "c_groups binary, c_high binary, c_low binary, c_n int"
    ).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    scheduled = "p long, g long, promise double"

    def schedule(asking: DataFrame, first: bool) -> DataFrame:
        return (
            asking.withColumn("slot", F.pmod(F.hash("p"), F.lit(slots)))
            .join(chunks, "slot")
            .mapInPandas(_scheduler(first), scheduled)
        )

    def meet(asking: DataFrame, plan: DataFrame) -> DataFrame:
        as_query = [F.col(c).alias(f"q_{c}") for c in ("ids", "mat", "n", "dims")]
        asked = plan.select("p", "g").join(asking.select("p", "floors", *as_query), "p")
        # Pieces are streamed past the one row of their group.
        return asked.join(groups.select("g", "ids", "mat", "n", "dims"), "g").drop("g").mapInPandas(
            _meeter(k), "query_id long, vec_id long, score long, p long"
        )

    no_floors = F.lit(None).cast("array<struct<query_id:bigint,least:bigint>>").alias("floors")
    blank = pieces.select("p", "ids", "mat", "n", "dims", no_floors)
    home = schedule(blank, True).groupBy("p").agg(F.max_by("g", F.struct("promise", -F.col("g"))).alias("g"))
    home = materialize(home, "topk-home")
    first = materialize(meet(blank, home), "topk-first")
    floors = (
        first.groupBy("p", "query_id").agg(F.count("*").alias("found"), F.min("score").alias("least"))
        .filter(F.col("found") >= k)
        .groupBy("p").agg(F.collect_list(F.struct("query_id", "least")).alias("floors"))
    )
    knowing = (
        pieces.select("p", "ids", "mat", "n", "dims")
        .join(floors, "p", "left").join(home.withColumnRenamed("g", "home"), "p")
    )
    knowing = materialize(knowing, "topk-knowing")
    rest = meet(knowing, materialize(schedule(knowing, False), "topk-rest"))
    by_query = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    )
    return (
        first.unionByName(rest)
        .withColumn("rank", by_query)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
