"""Vector compression by product codes, entries found through GNATs.

Vectors become whole numbers, are cut into ``PARTS`` equal parts, and every
part is written as the index of the nearest entry of its position's codebook.
A codebook begins as that part of the first ``ENTRIES`` vectors and is moved
``ROUNDS`` times to the means of the parts assigned to it.

Codebooks have a fixed size (parts x entries x length, a few thousand whole
numbers), so they travel with the tasks.  A round reads the vectors, assigns
them batch by batch through one ``gnat.Gnat`` a position, and gives one row of
sums for each task, position and entry; Spark adds these up.  No vector is
shuffled; the last pass writes one short row a vector, which the sums of each
label join.

Defined results: rows whose vector is null or holds null or non-finite
components are left out; the first vectors are those of smallest id, equal
ids in order of their vectors, null ids last; rows that share an id are coded
each; fewer than ``ENTRIES`` vectors give smaller codebooks, none gives no
rows; vectors shorter than the longest, or of a length that the parts do not
divide, count as padded with zeros (an empty vector is all zeros); components
are held within plus and minus 2**24 after scaling, so that every sum is
exact in 64 bits up to 8,192 dimensions; null labels are one label; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .gnat import Gnat

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 24


def _sound(vec: str) -> Column:
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of floor(SCALE * x), zeros to the right."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    flat = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def cut(rows: np.ndarray) -> np.ndarray:
    """Rows as (position, row, component)."""
    return rows.reshape(len(rows), PARTS, -1).transpose(1, 0, 2)


def first_books(rows: DataFrame, dims: int) -> np.ndarray:
    """The codebooks to begin with: a bounded number of rows at the driver."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(ENTRIES).toArrow()
    return cut(whole(first["vec"], dims)).copy()


def _sums(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for p, part in enumerate(cut(whole(batch.column("vec"), dims))):
                index, _ = trees[p].nearest(part)
                np.add.at(total[p], index, part)
                count[p] += np.bincount(index, minlength=books.shape[1])
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e]), "total": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))}
            )

    each = rows.select("vec").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(books.shape[2])]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums)


def moved_books(rows: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks after one round: a row an entry comes to the driver."""
    out = books.copy()
    for r in _sums(rows, books, dims).collect():
        out[r.part, r.entry] = [r[f"t{i}"] // r.n for i in range(books.shape[2])]
    return out


def fit(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (position, entry, component) of ``rows`` (id, vec)."""
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return None
    dims = max(1, -(-longest // PARTS)) * PARTS
    books = first_books(rows, dims)
    for _ in range(rounds):
        books = moved_books(rows, books, dims)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (id, vec, ...) with their ``code`` (one byte a position) and
    ``error`` (squared distance to what the code stands for) for ``vec``."""
    dims = books.shape[0] * books.shape[2]
    kept = [c for c in rows.columns if c != "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            code = np.empty((batch.num_rows, len(trees)), dtype=np.uint8)
            error = np.zeros(batch.num_rows, dtype=np.int64)
            for p, part in enumerate(cut(whole(batch.column("vec"), dims))):
                index, gap = trees[p].nearest(part)
                code[:, p] = index
                error += gap
            columns = {c: batch.column(c) for c in kept}
            yield pa.RecordBatch.from_pydict({**columns, "code": pa.array([c.tobytes() for c in code], pa.binary()), "error": pa.array(error)})

    types = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(run, f"{types}code binary, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``vec``: the entries that each ``code`` names, as
    components of the scale of the vectors."""
    names = codes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            flat = books[np.arange(len(books)), index].reshape(batch.num_rows, -1) / SCALE
            columns = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict({**columns, "vec": pa.array(list(flat), pa.list_(pa.float64()))})

    types = "".join(f"`{c}` {codes.schema[c].dataType.simpleString()}, " for c in names)
    return codes.mapInArrow(run, f"{types}vec array<double>")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row."""
    rows = vectors.filter(_sound(vec_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    books = fit(rows.select("id", "vec"))
    names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    if books is None:
        none = rows.select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("digest"))
        return none.toDF(*names)
    coded = materialize(encode(rows, books), "codes")
    # One row a label; where one label has a third of the rows, the adaptive
    # plan splits its side of the join.
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(names[0]), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias(names[4])
    )


def _round_sql(n: int) -> str:
    """One round: nearest entries under the books b{n}, and their means."""
    return f"""
a{n} AS (
  SELECT vec_id, label, p, x, i, d FROM (
    SELECT v.rid, v.vec_id, v.label, v.p, v.x, b.i,
      list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
      row_number() OVER (PARTITION BY v.rid, v.p ORDER BY list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.i) AS r
    FROM parts v JOIN b{n} b ON v.p = b.p) WHERE r = 1
), m{n} AS (
  SELECT p, i, list(m ORDER BY k) AS x FROM (
    SELECT p, i, k, CAST(floor(sum(c) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
    FROM (SELECT p, i, unnest(x) AS c, generate_subscripts(x, 1) AS k FROM a{n}) GROUP BY p, i, k) GROUP BY p, i
), b{n + 1} AS (
  SELECT b.p, b.i, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.i = m.i
)"""


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, vec_id, label, p, list_slice(e, p * (len(e) // 16) + 1, (p + 1) * (len(e) // 16)) AS x FROM v, range(16) t(p)
), b0 AS (
  SELECT p, rid - 1 AS i, x FROM parts WHERE rid <= 64
),{_round_sql(0)},{_round_sql(1)},{_round_sql(2)}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label
), book AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, i)) AS s FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, book
"""
