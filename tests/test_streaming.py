from pyspark.sql import functions as F

from kbforge import streaming
from kbforge.functions.storage import read_table
from kbforge.operators import analytics

SF = "/root/testdata/sf0.001"


def events(spark):
    return read_table(spark, SF, "events")


def run(spark, tmp_path, make, mode="append", parts=1):
    """Rows of a streaming query over the events, written in order of time in some files."""
    folder, schema = str(tmp_path / "in"), None
    rows = events(spark).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    rows.coalesce(1).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).parquet(folder)
    name = "t" + tmp_path.name.replace("-", "_")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_daily_stats(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: streaming.search_stats(s.selectExpr("ts", "event_type AS source", "value AS response_ms")))
    twin = events(spark).groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("source")).agg(F.count("*").alias("n"))
    want = {(str(r.day), r.source): r.n for r in twin.collect()}
    rows = got.collect()
    assert len({r.day for r in rows}) >= 28 and all(want[str(r.day.date()), r.source] == r.n for r in rows)


def test_sessions(spark, tmp_path):
    got = {(r.user_id, r.start): r.n for r in run(spark, tmp_path, lambda s: streaming.sessions(s.select("ts", "user_id"))).collect()}
    log = events(spark).selectExpr("event_id AS id", "user_id", "CAST(ts AS timestamp) AS created_at")
    twin = {(r.user_id, r.start): r.n for r in analytics.sessions(log).groupBy("user_id", "session_no").agg(F.min("created_at").alias("start"), F.count("*").alias("n")).collect()}
    assert len(got) > 0.9 * len(twin) and all(twin[k] == n for k, n in got.items())


def test_history_and_lockouts(spark, tmp_path):
    query = "concat('q', event_id % 7) AS query"
    got = {r.id: r.history for r in run(spark, tmp_path, lambda s: streaming.history(s.selectExpr("event_id AS id", "user_id", "ts", query))).collect()}
    log = events(spark).selectExpr("event_id AS id", "user_id", "ts AS created_at", query)
    assert got == {r.id: r.history for r in analytics.session_history(log).collect()}


def test_lockouts(spark, tmp_path):
    week = 7 * 86400
    got = {r.id: r.recent for r in run(spark, tmp_path, lambda s: streaming.lockouts(s.filter("event_type = 'error'").selectExpr("event_id AS id", "user_id AS ip", "ts"), week)).collect()}
    fails = events(spark).filter("event_type = 'error'").selectExpr("event_id AS id", "user_id AS ip", "ts")
    assert got and got == {r.id: r.recent for r in analytics.login_lockouts(fails, week).collect()}


def test_upserts_are_idempotent(spark, tmp_path):
    keep = streaming.upsert_into(str(tmp_path), ["k"], "at")
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string")
    b = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], a.schema)
    for n, rows in ((0, a), (1, b), (1, b)):
        keep(rows, n)
    assert sorted(map(tuple, streaming.latest_of(spark, str(tmp_path), ["k"], "at").collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    streaming.upsert_into(str(tmp_path), ["k"], "at", "1")(spark.createDataFrame([(1, 1, "e"), (2, 1, "f")], a.schema), 0)
    want = [(1, 1, "e"), (2, 2, "c"), (3, 1, "d")]
    assert sorted(map(tuple, streaming.latest_of(spark, str(tmp_path), ["k"], "at").collect())) == want
    streaming.compact(spark, str(tmp_path), ["k"], "at", str(tmp_path / "small"))
    assert sorted(map(tuple, streaming.latest_of(spark, str(tmp_path / "small"), ["k"], "at").collect())) == want


HOUR = 3600


def deliver(spark, tmp_path, make, files):
    """The rows of an append-mode stream after each of some deliveries, and the rows of state after the last."""
    seen = []
    for rows in files:
        spark.createDataFrame(rows, "at long, key long, value double").selectExpr("timestamp_seconds(at) AS ts", "key", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("ts timestamp, key long, value double").parquet(str(tmp_path / "in"))
        query = make(source).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        query = query.option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        state = query.lastProgress["stateOperators"][0]
        seen.append((spark.read.parquet(str(tmp_path / "out")).count(), state["numRowsTotal"]))
    return spark.read.parquet(str(tmp_path / "out")), seen


def test_days_are_given_once_over_and_state_is_bounded(spark, tmp_path):
    day = 24 * HOUR
    files = [[(d * day + k, 1, float(k)) for k in range(0, day, HOUR)] for d in range(6)]
    files[2].append((2 * day - 1800, 1, 100.0))  # the day before, within the delay of the day's start
    files[4].append((day // 2, 1, 999.0))  # days too late
    files[5].append((4 * day + 5, 1, 7.0))  # its day is not over when the delivery before ends
    make = lambda s: streaming.search_stats(s.selectExpr("ts", "cast(key AS string) AS source", "value AS response_ms"))
    out, seen = deliver(spark, tmp_path, make, files)
    got = {r.day.timestamp() // day: (r.n, r.avg_ms) for r in out.collect()}
    assert {d: n for d, (n, _) in got.items()} == {0: 24, 1: 25, 2: 24, 3: 24, 4: 25} and got[0][1] < 100_000
    assert [n for n, _ in seen] == [0, 1, 2, 3, 4, 5] and max(n for _, n in seen) <= 2


def test_sliding_windows_show_their_percentile_and_end(spark, tmp_path):
    files = [[(k * 60 + j, 1, float(k * 60 + j)) for k in range(30 * i, 30 * (i + 1)) for j in range(0, 60, 3)] for i in range(4)]
    make = lambda s: streaming.latency_sliding(s.selectExpr("ts", "cast(key AS string) AS name", "value AS duration_ms"))
    out, seen = deliver(spark, tmp_path, make, files)
    for r in out.collect():
        start = r.start.timestamp()
        own = sorted(v for rows in files for _, _, v in rows if start <= v < start + 600)
        assert (r.n, r.max_ms, r.p95_ms) == (len(own), own[-1], own[-(-len(own) * 95 // 100) - 1])
    # Windows of ten minutes and a delay of as much: what is open spans twenty minutes, whatever came before.
    assert out.count() > 80 and max(n for _, n in seen) <= 31


def test_sessions_end_and_leave_the_state(spark, tmp_path):
    users, gap = 50, 1800
    files = [[(i * 4 * HOUR + u * 7 + k * 600, u, 0.0) for u in range(users) for k in range(3)] for i in range(5)]
    files[3].append((100, 3, 0.0))  # hours too late: no session of its own
    out, seen = deliver(spark, tmp_path, lambda s: streaming.sessions(s.selectExpr("ts", "key AS user_id")), files)
    rows = out.collect()
    assert len(rows) == users * 4 == len({(r.user_id, r.start) for r in rows})
    assert all(r.n == 3 and r.end.timestamp() - r.start.timestamp() == 1200 + gap for r in rows)
    assert max(n for _, n in seen) <= users
