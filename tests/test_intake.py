import duckdb

from graphloom import queries


def test_edits_that_name_another_part_keep_their_own_original(spark, tmp_path):
    rows = [(n, f"part {n}", f"brand {n}", "t", size, 1.0) for n, size in [(1, 9), (2, 18), (3, 36), (4, 7), (5, 8)]]
    # Keys a million further: some are parts too, one of the same name.
    rows += [(1_000_001, "other", "brand x", "t", 1, 1.0), (1_000_003, "part 3", "brand y", "t", 2, 1.0)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["edit_decisions"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = sorted(db.execute(queries.ORACLES["edit_decisions"]).fetchall())
    assert got == want
    assert (1, 200, "part 1 / brand 1") in got and (2, 400, None) in got and (3, 409, None) in got
