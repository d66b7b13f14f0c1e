from kbforge import streaming


def test_percentile_of_a_large_window_is_exact(spark):
    n = 200_003
    rows = spark.range(n, numPartitions=3).selectExpr("timestamp'2024-01-01 00:00:00' AS ts", "'m' AS name", f"cast(id * 7919 % {n} AS double) AS duration_ms")
    got = {r.p95_ms for r in streaming.latency_sliding(rows, "10 minutes", "5 minutes").collect()}
    assert got == {float(-(-n * 95 // 100) - 1)}
