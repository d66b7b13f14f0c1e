"""The streaming forms over ``events``, run until all that is there is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbforge import streaming as ops
from kbforge.functions.storage import read_table, scratch
from kbforge.operators.store import page_store
from kbforge.plans.corpus import page_text_sql, plain_sql
from kbforge.plans.retrieval import STOPS
from kbforge.streaming import ingest

WEEK = 7 * 86400


def _instant(ts: Column) -> Column:
    """A time without zone as the instant that it names in UTC, whatever the session's zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def _shown(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def _ran(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], mode: str = "append", write=None) -> str:
    """The folder of the rows that the stream gave; its checkpoint lies beside it."""
    root = scratch(spark, "stream")
    out = f"{root}/rows"
    source = spark.readStream.schema(read_table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern, as the table may be a file or a folder
    each = write(out) if write else lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode == "append" else out)
    query = make(source.withColumn("ts", _instant(F.col("ts")))).writeStream.foreachBatch(each).outputMode(mode).trigger(availableNow=True)
    query.option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()
    return out


#: Ordered deliveries of the events: by stages of so many days since the first of January. Of each stage every fiftieth event of its
#: first half comes one delivery later, beyond any delay that is waited for, and so do some of its last half hour, within it.
STAGE_DAYS, STAGES = 8, 4
STAGE = f"least(datediff(ts, DATE'2024-01-01') div {STAGE_DAYS}, {STAGES - 1})"
LATE = f"(event_id % 50 = 0 AND datediff(ts, DATE'2024-01-01') % {STAGE_DAYS} < {STAGE_DAYS // 2} OR event_id % 5 = 1 AND ts >= date_add(DATE'2024-01-01', cast({STAGE} + 1 AS INT) * {STAGE_DAYS}) - INTERVAL 30 MINUTES)"


def _delivered(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that an append-mode stream gives, run once for each delivery from one checkpoint.

    A window is given once no row of it can come any more, so windows that end after the last row's time less the delay
    stay in the state.
    """
    root = scratch(spark, "stream")
    events = read_table(spark, d, "events").withColumn("stage", F.expr(f"{STAGE} + cast({LATE} AS INT)"))
    for k in range(STAGES + 1):
        events.filter(F.col("stage") == k).drop("stage").withColumn("ts", _instant(F.col("ts"))).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        query = make(source).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        query.option("checkpointLocation", f"{root}/checkpoint").start(f"{root}/rows").awaitTermination()
    return spark.read.parquet(f"{root}/rows")


def _stats(s: SparkSession, d: str) -> DataFrame:
    rows = _delivered(s, d, lambda e: ops.search_stats(e.selectExpr("ts", "event_type AS source", "value AS response_ms")))
    return rows.select(_shown(F.col("day")).alias("day"), "source", "n", F.round("avg_ms", 6).alias("avg_ms"))


def _sliding(s: SparkSession, d: str) -> DataFrame:
    rows = _delivered(s, d, lambda e: ops.latency_sliding(e.selectExpr("ts", "event_type AS name", "value AS duration_ms"), "6 hours", "2 hours", "1 hour"))
    return rows.select(_shown(F.col("start")).alias("start"), "name", "n", F.round("avg_ms", 6).alias("avg_ms"), "max_ms", "p95_ms")


def _sessions(s: SparkSession, d: str) -> DataFrame:
    rows = _delivered(s, d, lambda e: ops.sessions(e.select("ts", "user_id"), "6 hours"))
    return rows.select("user_id", _shown(F.col("start")).alias("start"), _shown(F.col("end")).alias("end"), "n")


def _history(s: SparkSession, d: str) -> DataFrame:
    path = _ran(s, d, lambda e: ops.history(e.selectExpr("event_id AS id", "user_id", "ts", "concat('q', event_id % 7) AS query"), 3, 6 * 3600))
    return s.read.parquet(path).select("id", "user_id", "history")


def _lockouts(s: SparkSession, d: str) -> DataFrame:
    path = _ran(s, d, lambda e: ops.lockouts(e.filter("event_type = 'error'").selectExpr("event_id AS id", "user_id AS ip", "ts"), WEEK, 3))
    return s.read.parquet(path).select("id", "ip", "recent")


#: Deliveries of page versions: all pages; a third of them cut after their first paragraph, with a fifth of the old ones; the second again.
SHORT = r"(?s)(<article>.*?</p>).*"
DELIVERIES = 3


def delivery(pages: DataFrame, number: int) -> DataFrame:
    first = pages.select("page_id", F.lit(1).cast("long").alias("version"), "url", "html")
    if number == 0:
        return first
    cut = first.filter("page_id % 3 = 0").withColumns({"version": F.lit(2).cast("long"), "html": F.regexp_replace("html", SHORT, "$1</article></body></html>")})
    return cut.unionByName(first.filter("page_id % 5 = 0"))


def _ingested(s: SparkSession, d: str) -> DataFrame:
    root = scratch(s, "ingest")
    store = page_store(s, f"{root}/store", 16)
    for number in range(DELIVERIES):
        delivery(read_table(s, d, "pages"), number).write.mode("append").parquet(f"{root}/in")
        stream = ingest.page_stream(s, f"{root}/in").writeStream.foreachBatch(ingest.into(store)).trigger(availableNow=True)
        stream.option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()
    documents = store.read("documents").select("page_id", "version", "url", "title", "n_chunks")
    counts = store.read("postings").groupBy("chunk_id").agg(F.count("*").alias("n_terms"))
    chunks = store.read("chunks").join(counts, "chunk_id", "left")
    return documents.join(chunks.drop("section", "kind", "total_chunks"), "page_id", "left").select("page_id", "version", "url", "title", "n_chunks", "chunk_index", "text", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def _feedback(s: SparkSession, d: str) -> DataFrame:
    votes = lambda e: e.filter("event_type IN ('purchase', 'signup')").selectExpr("user_id * 10 AS search_id", "struct(ts, event_id) AS voted", "CASE WHEN event_type = 'purchase' THEN 'up' ELSE 'down' END AS rating")
    path = _ran(s, d, votes, write=lambda out: ops.upsert_into(out, ["search_id"], "voted"))
    return ops.latest_of(s, path, ["search_id"], "voted").select("search_id", "rating", "voted.event_id")


QUERIES = {
    "stream_search_stats": _stats,
    "stream_latency_sliding": _sliding,
    "stream_sessions": _sessions,
    "stream_history": _history,
    "stream_lockouts": _lockouts,
    "stream_ingest": _ingested,
    "stream_feedback": _feedback,
}

_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_GAPS = "g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before {} INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))"
#: Each event with the watermark of its delivery (the latest time before it, in milliseconds, less an hour), and the last watermark.
_SEEN = f"""WITH e AS (SELECT *, least(date_diff('day', TIMESTAMP '2024-01-01', ts) // {STAGE_DAYS}, {STAGES - 1}) AS stage FROM events),
  d AS (SELECT *, stage + CAST(event_id % 50 = 0 AND date_diff('day', TIMESTAMP '2024-01-01', ts) % {STAGE_DAYS} < {STAGE_DAYS // 2}
        OR event_id % 5 = 1 AND ts >= TIMESTAMP '2024-01-01' + (stage + 1) * {STAGE_DAYS} * INTERVAL 1 DAY - INTERVAL 30 MINUTE AS INT) AS no FROM e),
  m AS (SELECT k, (SELECT max(date_trunc('milliseconds', ts)) - INTERVAL 1 HOUR FROM d WHERE no < k) AS before FROM range({STAGES + 2}) r(k)),
  seen AS (SELECT event_id, ts, user_id, event_type, value, coalesce(before, TIMESTAMP '1970-01-01') AS before, (SELECT max(before) FROM m) AS last FROM d JOIN m ON m.k = d.no)"""
_BEFORE = ", ".join(f"lag('q' || (event_id % 7), {k}) OVER w" for k in (3, 2, 1))
ORACLES = {
    "stream_search_stats": f"{_SEEN}, w AS (SELECT *, date_trunc('day', ts) AS day FROM seen) SELECT {_TIME.format('day')} AS day, event_type AS source, count(*) AS n, round(avg(value), 6) AS avg_ms FROM w WHERE day + INTERVAL 1 DAY > before AND day + INTERVAL 1 DAY <= last GROUP BY day, event_type",
    "stream_latency_sliding": f"{_SEEN}, w AS (SELECT *, time_bucket(INTERVAL 2 HOUR, ts) - unnest([0, 2, 4]) * INTERVAL 1 HOUR AS start FROM seen) SELECT {_TIME.format('start')} AS start, event_type AS name, count(*) AS n, round(avg(value), 6) AS avg_ms, max(value) AS max_ms, quantile_disc(value, 0.95) AS p95_ms FROM w WHERE start + INTERVAL 6 HOUR > before AND start + INTERVAL 6 HOUR <= last GROUP BY w.start, event_type",
    "stream_sessions": f"{_SEEN}, events AS (SELECT event_id, ts, user_id, last FROM seen WHERE ts + INTERVAL 6 HOUR > before), {_GAPS.format('>=')} SELECT user_id, {_TIME.format('min(ts)')} AS start, {_TIME.format('max(ts) + INTERVAL 6 HOUR')} AS end, count(*) AS n FROM g GROUP BY user_id, no HAVING max(ts) + INTERVAL 6 HOUR <= any_value(last)",
    "stream_history": f"WITH {_GAPS.format('>')} SELECT event_id AS id, user_id, concat_ws(' > ', {_BEFORE}) AS history FROM g WINDOW w AS (PARTITION BY user_id, no ORDER BY ts, event_id)",
    "stream_lockouts": """WITH f AS (SELECT event_id AS id, user_id AS ip, ts FROM events WHERE event_type = 'error'),
        r AS (SELECT id, ip, (SELECT count(*) FROM f b WHERE b.ip = a.ip AND b.ts >= a.ts - INTERVAL 7 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.id <= a.id))) AS recent FROM f a) SELECT * FROM r WHERE recent >= 3""",
    "stream_ingest": rf"""WITH v AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?s)(<article>.*?</p>).*', '\1</article>') ELSE html END AS html FROM pages),
        t AS (SELECT page_id, url, version, trim(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&')) AS title, {page_text_sql('html')} AS text FROM v),
        {plain_sql('t', 'page_id', '. ', 1000, 100)},
        o AS (SELECT page_id, len(cs) AS n_chunks, unnest(range(len(cs))) AS chunk_index, unnest(cs) AS text FROM c)
        SELECT t.page_id, t.version, t.url, t.title, coalesce(o.n_chunks, 0) AS n_chunks, o.chunk_index, o.text,
               len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(o.text, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: x NOT IN ({STOPS})))) AS n_terms FROM t LEFT JOIN o USING (page_id)""",
    "stream_feedback": "SELECT user_id * 10 AS search_id, CASE WHEN arg_max(event_type, struct_pack(ts, event_id)) = 'purchase' THEN 'up' ELSE 'down' END AS rating, arg_max(event_id, struct_pack(ts, event_id)) AS event_id FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id",
}
