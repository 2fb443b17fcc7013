"""What meetings of blocks of vectors move."""

import numpy as np
import pytest

from graphloom.operators import resolve


def _moved(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def _best(rows, k):
    m = np.array([r[2] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(m @ m.T, 9)
    np.fill_diagonal(scores, -2)
    return {r[0]: [rows[j][0] for j in np.lexsort((np.arange(len(rows)), -scores[i]))[:k]] for i, r in enumerate(rows)}


def _found(spark, rows, k, block):
    v = spark.createDataFrame(rows, "id string, type string, vec array<double>, pos long").repartition(3)
    got = {}
    for r in resolve.nearest(v, v, k, block=block).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.id)
    return got


def test_vectors_are_not_shuffled_a_pair_of_blocks_at_a_time(spark):
    rng = np.random.default_rng(8)
    rows = [(f"n{i}", "t", rng.standard_normal(32).tolist(), i) for i in range(1600)]
    before = _moved(spark)
    assert _found(spark, rows, 3, 20) == _best(rows, 3)
    # Some hundred blocks, all pairs of which meet.
    assert _moved(spark) - before < 15 * len(rows) * 32 * 8


@pytest.mark.parametrize("shelf, slot", [(1, 1), (3000, 1 << 25), (1 << 23, 900)])
def test_neighbours_are_the_same_by_any_shelves_and_slots(spark, monkeypatch, shelf, slot):
    monkeypatch.setattr(resolve, "SHELF_BYTES", shelf)
    monkeypatch.setattr(resolve, "SLOT_BYTES", slot)
    rng = np.random.default_rng(9)
    rows = [(f"n{i}", "t", rng.standard_normal(8).tolist(), i) for i in range(80)]
    # Copies tie, wherever they lie.
    rows += [(f"c{i}", "t", rows[i % 40][2], 80 + i) for i in range(80)]
    assert _found(spark, rows, 4, 12) == _best(rows, 4)
