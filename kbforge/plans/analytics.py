"""Log analytics over ``events`` as the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions.storage import read_table, scratch
from kbforge.operators import analytics as ops, daylog

AS_OF = "2024-01-31 00:00:00"
K = "CAST(get_json_object(props, '$.k') AS INT)"
SQL_LOG = """log AS (SELECT event_id AS id, ts AS created_at, event_type AS source, value AS response_time_ms, user_id, user_id AS session_id, k, k % 7 AS results_count,
  CASE WHEN event_id % 3 = 0 THEN 'QUERY ' ELSE 'query ' END || (k % 40)::VARCHAR AS query, event_id % 2 = 0 AS reranked, event_type = 'error' AS is_error,
  CASE WHEN event_id % 4 <> 0 THEN [(k % 10) / 10.0::DOUBLE, (event_id % 10) / 10.0::DOUBLE, (k % 3) / 10.0::DOUBLE] END AS scores,
  CASE WHEN event_id % 4 <> 0 THEN [['docs','cases','custom'][1 + k % 3], ['docs','cases','custom'][1 + event_id % 3], 'docs'] END AS source_types
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events))"""
SQL_VOTES = "votes AS (SELECT event_id AS vote_id, ts AS voted_at, user_id * 10 AS search_id, CASE WHEN event_type = 'purchase' THEN 'up' ELSE 'down' END AS rating, 'c' || event_id::VARCHAR AS comment, user_id AS session_id FROM events WHERE event_type IN ('purchase', 'signup'))"
SQL_FEEDBACK = SQL_VOTES + ", feedback AS (SELECT search_id, arg_max(rating, struct_pack(voted_at, vote_id)) AS rating, arg_max(comment, struct_pack(voted_at, vote_id)) AS comment, arg_min(session_id, struct_pack(voted_at, vote_id)) AS session_id, min(voted_at) AS created_at, max(voted_at) AS updated_at FROM votes GROUP BY search_id)"
SINCE = "TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {} DAY"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("k", F.expr(K))
    kinds = "array('docs','cases','custom')"
    return e.selectExpr(
        "event_id AS id", "ts AS created_at", "event_type AS source", "value AS response_time_ms", "user_id", "user_id AS session_id", "k", "k % 7 AS results_count",
        "concat(CASE WHEN event_id % 3 = 0 THEN 'QUERY ' ELSE 'query ' END, CAST(k % 40 AS STRING)) AS query", "event_id % 2 = 0 AS reranked", "event_type = 'error' AS is_error",
        "CASE WHEN event_id % 4 <> 0 THEN array(k % 10 / 10.0D, event_id % 10 / 10.0D, k % 3 / 10.0D) END AS scores",
        f"CASE WHEN event_id % 4 <> 0 THEN array({kinds}[k % 3], {kinds}[CAST(event_id % 3 AS INT)], 'docs') END AS source_types",
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'signup')")
    return e.selectExpr("event_id AS vote_id", "ts AS voted_at", "user_id * 10 AS search_id", "CASE WHEN event_type = 'purchase' THEN 'up' ELSE 'down' END AS rating", "concat('c', event_id) AS comment", "user_id AS session_id")


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    names = "array('embedding_generation','vector_search','total_search','llm_synthesis')"
    return e.selectExpr("event_id AS id", f"{names}[CAST(event_id % 4 AS INT)] AS name", "value * 40 AS duration_ms", "ts")


SQL_TIMINGS = "timings AS (SELECT event_id AS id, ['embedding_generation','vector_search','total_search','llm_synthesis'][1 + event_id % 4] AS name, value * 40 AS duration_ms, ts FROM events)"
SQL_LAST = "ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, id DESC) AS rank FROM timings)"
SQL_STATS = (
    "stats AS (SELECT name, count(*) AS n, round(avg(duration_ms), 2) AS avg_ms, round(min(duration_ms), 2) AS min_ms, round(max(duration_ms), 2) AS max_ms, "
    + ", ".join(f"round(list_sort(list(duration_ms))[1 + least(count(*) * {p} // 100, count(*) - 1)], 2) AS p{p}_ms" for p in ops.PERCENTILES)
    + " FROM ranked WHERE rank <= 1000 GROUP BY name)"
)


def _times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _f(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"


def _purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = daylog.DayLog(spark, scratch(spark, "log"))
    stored.write(log(spark, sf_dir), ops.upsert_feedback(votes(spark, sf_dir)))
    stored.purge(AS_OF, 20)
    kept, feedback = stored.searches(), stored.feedback()
    return kept.select(F.lit("search").alias("kind"), "id").unionByName(feedback.select(F.lit("feedback").alias("kind"), F.col("search_id").alias("id")))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    jobs = e.selectExpr("event_id AS id", "event_type AS job_type", "CASE WHEN event_id % 5 = 0 THEN 'running' ELSE 'completed' END AS status", "ts AS started_at", "CASE WHEN event_id % 5 <> 0 THEN ts + make_dt_interval(0, 0, 0, value) END AS finished_at")
    return ops.job_runs(jobs, AS_OF, 10)


def _job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_jobs(_jobs(spark, sf_dir), "view", "failed", 2, 15).select("id", "status", "total")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr("event_id AS id", "user_id AS ip", "ts")


QUERIES = {
    "popular_queries": lambda s, d: _times(ops.popular_queries(log(s, d), AS_OF, 20, 25), "last_at"),
    "search_stats": lambda s, d: ops.search_stats(log(s, d), AS_OF, 20),
    "recent_searches": lambda s, d: ops.recent_searches(log(s, d), 50).select("id", "query", "source"),
    "low_quality_searches": lambda s, d: ops.low_quality_searches(log(s, d), AS_OF, 20, 40),
    "conversations": lambda s, d: _times(ops.conversations(log(s, d), 20), "first_at", "last_at"),
    "source_insights": lambda s, d: ops.source_insights(log(s, d), AS_OF, 20),
    "retention_anonymize": lambda s, d: ops.retention_anonymize(log(s, d), AS_OF, 10).select("id", "query", "changed"),
    "retention_purge": _purged,
    "upsert_feedback": lambda s, d: _times(ops.upsert_feedback(votes(s, d)), "created_at", "updated_at"),
    "feedback_stats": lambda s, d: ops.feedback_stats(ops.upsert_feedback(votes(s, d)), log(s, d), AS_OF, 30),
    "recent_feedback": lambda s, d: ops.recent_feedback(ops.upsert_feedback(votes(s, d)), log(s, d), 20).select("search_id", "rating", "comment", "query", "source"),
    "latency_stats": lambda s, d: ops.latency_stats(timings(s, d)),
    "latency_recent": lambda s, d: _times(ops.latency_recent(timings(s, d), 10), "ts"),
    "error_rate": lambda s, d: ops.error_rate(log(s, d)),
    "latency_alerts": lambda s, d: ops.latency_alerts(ops.latency_stats(timings(s, d))),
    "job_runs": lambda s, d: ops.job_counts(_jobs(s, d)),
    "list_jobs": _job_page,
    "login_lockouts": lambda s, d: _times(ops.login_lockouts(_failures(s, d), 7 * 86400, 5), "ts", "locked_until"),
    "session_history": lambda s, d: ops.session_history(log(s, d)).select("id", "session_no", "history"),
}

ORACLES = {
    "popular_queries": f"WITH {SQL_LOG} SELECT arg_max(query, struct_pack(created_at, id)) AS query, count(*) AS n, {_f('max(created_at)')} AS last_at FROM log WHERE created_at >= {SINCE.format(20)} GROUP BY lower(query) ORDER BY n DESC, max(created_at) DESC, lower(query) LIMIT 25",
    "search_stats": f"""WITH {SQL_LOG}, w AS (SELECT * FROM log WHERE created_at >= {SINCE.format(20)}), a AS (SELECT 'total' AS facet, '' AS key, * FROM (SELECT count(*) AS n, avg(response_time_ms) AS a, avg(results_count) AS b FROM w)
        UNION ALL SELECT 'source', source, count(*), avg(response_time_ms), avg(results_count) FROM w GROUP BY source
        UNION ALL SELECT 'day', strftime(created_at, '%Y-%m-%d') AS d, count(*), avg(response_time_ms), avg(results_count) FROM log WHERE created_at >= {SINCE.format(7)} GROUP BY d) SELECT facet, key, n, round(a, 4) AS avg_ms, round(b, 4) AS avg_results FROM a""",
    "recent_searches": f"WITH {SQL_LOG} SELECT id, query, source FROM log ORDER BY created_at DESC, id DESC LIMIT 50",
    "low_quality_searches": f"WITH {SQL_LOG}, w AS (SELECT *, list_sum(scores) / 3 AS raw FROM (SELECT * FROM log WHERE created_at >= {SINCE.format(20)} AND scores IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 200)) SELECT id, query, round(raw, 4) AS avg_score FROM w WHERE raw <= 0.3 ORDER BY raw, created_at DESC, id DESC LIMIT 40",
    "conversations": f"WITH {SQL_LOG}, c AS (SELECT session_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, string_agg(query, ' | ' ORDER BY created_at, id) AS queries FROM log GROUP BY session_id ORDER BY first_at DESC, session_id LIMIT 20) SELECT session_id, n, {_f('first_at')} AS first_at, {_f('last_at')} AS last_at, queries FROM c",
    "source_insights": f"""WITH {SQL_LOG}, w AS (SELECT * FROM log WHERE created_at >= {SINCE.format(20)}), t AS (SELECT count(source_types) AS total, count(*) FILTER (source_types IS NOT NULL AND reranked) AS reranked_total FROM w),
        x AS (SELECT unnest(range(3)) AS pos, unnest(source_types) AS st, unnest(scores) AS sc FROM w WHERE source_types IS NOT NULL)
        SELECT st AS source_type, count(*) AS appearances, round(avg(sc), 4) AS avg_score, {", ".join(f"count(*) FILTER (pos = {k}) AS at_{k + 1}" for k in range(5))}, round(count(*) FILTER (pos = 0) * 100.0 / any_value(total), 1) AS win_rate, any_value(total) AS total, any_value(reranked_total) AS reranked_total, round(any_value(reranked_total) * 100.0 / any_value(total), 1) AS coverage FROM x, t GROUP BY st""",
    "retention_anonymize": f"WITH {SQL_LOG} SELECT id, CASE WHEN created_at < {SINCE.format(10)} THEN '[redacted]' ELSE query END AS query, created_at < {SINCE.format(10)} AS changed FROM log",
    "retention_purge": f"WITH {SQL_LOG}, {SQL_FEEDBACK} SELECT 'search' AS kind, id FROM log WHERE created_at >= {SINCE.format(20)} UNION ALL SELECT 'feedback', search_id FROM feedback WHERE search_id NOT IN (SELECT id FROM log WHERE created_at < {SINCE.format(20)})",
    "upsert_feedback": f"WITH {SQL_FEEDBACK} SELECT search_id, rating, comment, session_id, {_f('created_at')} AS created_at, {_f('updated_at')} AS updated_at FROM feedback",
    "feedback_stats": f"WITH {SQL_LOG}, {SQL_FEEDBACK}, f AS (SELECT count(*) AS total, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down FROM feedback WHERE created_at >= {SINCE.format(30)}), n AS (SELECT count(*) AS searches FROM log WHERE created_at >= {SINCE.format(30)}) SELECT total, up, down, round(up * 100.0 / total, 1) AS satisfaction, round(total * 100.0 / searches, 1) AS feedback_rate FROM f, n",
    "recent_feedback": f"WITH {SQL_LOG}, {SQL_FEEDBACK} SELECT search_id, rating, comment, query, source FROM (SELECT search_id, rating, comment FROM feedback ORDER BY updated_at DESC, search_id DESC LIMIT 20) JOIN log ON id = search_id",
    "latency_stats": f"WITH {SQL_TIMINGS}, {SQL_LAST}, {SQL_STATS} SELECT * FROM stats",
    "latency_recent": f"WITH {SQL_TIMINGS}, {SQL_LAST} SELECT name, id, {_f('ts')} AS ts, duration_ms FROM ranked WHERE rank <= 10",
    "error_rate": f"WITH {SQL_LOG} SELECT count(*) AS queries, count(*) FILTER (is_error) AS errors, round(count(*) FILTER (is_error) * 100.0 / count(*), 2) AS error_rate FROM log",
    "latency_alerts": f"WITH {SQL_TIMINGS}, {SQL_LAST}, {SQL_STATS}, l(name, target, warning) AS (VALUES ('embedding_generation', 200, 500), ('vector_search', 100, 300), ('total_search', 500, 1000), ('llm_synthesis', 2000, 5000)) SELECT name, p95_ms, CASE WHEN p95_ms > warning THEN 'warning' WHEN p95_ms > target THEN 'info' ELSE 'none' END AS alert FROM stats LEFT JOIN l USING (name)",
    "job_runs": f"SELECT job_type, status, count(*) AS n, sum(CASE WHEN event_id % 5 <> 0 THEN floor(value)::BIGINT END) AS seconds FROM (SELECT *, event_type AS job_type, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events) WHERE ts >= {SINCE.format(10)} GROUP BY CUBE (job_type, status)",
    "list_jobs": f"WITH j AS (SELECT event_id AS id, ts FROM events WHERE ts >= {SINCE.format(10)} AND event_type = 'view' AND event_id % 5 = 0) SELECT id, 'failed' AS status, (SELECT count(*) FROM j) AS total FROM j ORDER BY ts DESC, id DESC LIMIT 15 OFFSET 2",
    "login_lockouts": f"WITH e AS (SELECT event_id AS id, user_id AS ip, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error') SELECT id, ip, {_f('ts')} AS ts, recent, {_f('ts + INTERVAL 7 DAY')} AS locked_until FROM e WHERE recent >= 5",
    "session_history": f"""WITH {SQL_LOG}, f AS (SELECT *, coalesce((created_at > lag(created_at) OVER w + INTERVAL 30 MINUTE)::INT, 1) AS fresh FROM log WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at, id) AS session_no FROM f) SELECT id, session_no::BIGINT AS session_no, coalesce(string_agg(query, ' > ') OVER (PARTITION BY user_id, session_no ORDER BY created_at, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM s""",
}
