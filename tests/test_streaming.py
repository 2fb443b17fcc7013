"""The rate limit's state over several micro-batches."""

from graphloom.operators import intake
from graphloom.streaming import rate_limit

SCHEMA = "key string, req_id long, ms long"


def test_expired_keys_leave_the_state_store(spark, tmp_path):
    minute = 60_000
    first = [("a", n, 1 + n * 1000) for n in range(7)] + [("b", 10, 500), ("c", 11, 30 * minute)]
    second = [("a", 20, 31 * minute), ("b", 21, 32 * minute), ("d", 22, 90 * minute)]
    late = [("e", 30, 1000)]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n, rows in enumerate((first, second, late)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        limited = rate_limit.rate_limit_stream(stream, 5, minute, late_ms=10 * minute)
        limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = {r.req_id: r.allowed for r in spark.read.parquet(out).collect()}
    asked = spark.createDataFrame(first + second, SCHEMA)
    assert got == {r.req_id: r.allowed for r in intake.rate_limit(asked, 5, minute).collect()}
    assert got[4] and not got[5] and 30 not in got
    # The watermark stands at minute 80: only the window of d is open.
    assert {r.key for r in rate_limit.live_windows(spark, checkpoint).collect()} == {"d"}
