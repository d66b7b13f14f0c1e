"""Search-log analytics. Times are compared with an explicit ``as_of``, never with the clock; ties are always broken by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

REDACTED = "[redacted]"
#: Metric, target and warning in milliseconds.
LATENCY_LIMITS: tuple[tuple[str, float, float], ...] = (
    ("embedding_generation", 200.0, 500.0),
    ("vector_search", 100.0, 300.0),
    ("total_search", 500.0, 1000.0),
    ("llm_synthesis", 2000.0, 5000.0),
)
PERCENTILES = (50, 90, 95, 99)
RECENT_TIMINGS = 1000


def since(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def window_of(log: DataFrame, as_of: str, days: int) -> DataFrame:
    return log.filter(F.col("created_at") >= since(as_of, days))


def popular_queries(log: DataFrame, as_of: str, days: int = 30, limit: int = 20) -> DataFrame:
    """Queries by lower-cased text: count, last time, and the spelling of the latest search."""
    grouped = window_of(log, as_of, days).groupBy(F.lower("query").alias("key")).agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"), F.max_by("query", F.struct("created_at", "id")).alias("query"))
    return grouped.orderBy(F.desc("n"), F.desc("last_at"), "key").limit(limit).select("query", "n", "last_at")


def search_stats(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """``facet, key, n, avg_ms, avg_results``: the total, each source, and each of the last seven days."""
    rows = window_of(log, as_of, days)
    numbers = [F.count("*").alias("n"), F.round(F.avg("response_time_ms"), 4).alias("avg_ms"), F.round(F.avg("results_count"), 4).alias("avg_results")]
    total = rows.agg(*numbers).select(F.lit("total").alias("facet"), F.lit("").alias("key"), "*")
    source = rows.groupBy("source").agg(*numbers).select(F.lit("source").alias("facet"), F.col("source").alias("key"), "n", "avg_ms", "avg_results")
    day = window_of(log, as_of, min(days, 7)).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("key")).agg(*numbers).select(F.lit("day").alias("facet"), "key", "n", "avg_ms", "avg_results")
    return total.unionByName(source).unionByName(day)


def recent_searches(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def low_quality_searches(log: DataFrame, as_of: str, days: int = 30, limit: int = 20, most: float = 0.3) -> DataFrame:
    """Of the newest ``5 * limit`` searches with scores those with a mean of at most ``most``, worst first."""
    rows = window_of(log, as_of, days).filter(F.size("scores") > 0).orderBy(F.desc("created_at"), F.desc("id")).limit(5 * limit)
    mean = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")
    return rows.withColumn("raw", mean).filter(F.col("raw") <= most).orderBy("raw", F.desc("created_at"), F.desc("id")).limit(limit).select("id", "query", F.round("raw", 4).alias("avg_score"))


def conversations(log: DataFrame, limit: int = 20) -> DataFrame:
    """The sessions begun last: number of queries, first and last time, and the queries in order.

    The sessions are chosen before their texts are gathered.
    """
    times = log.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    chosen = times.orderBy(F.desc("first_at"), "session_id").limit(limit)
    texts = log.join(F.broadcast(chosen.select("session_id")), "session_id").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "query"))), lambda x: x["query"]), " | ").alias("queries"))
    return chosen.join(texts, "session_id")


def source_insights(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per source: wins, appearances and mean score in the top five, win rate of all searches with sources, and how many of these were reranked."""
    rows = window_of(log, as_of, days)
    typed = rows.filter("source_types IS NOT NULL")
    totals = rows.agg(F.count("source_types").alias("total"), F.count_if(F.col("source_types").isNotNull() & F.col("reranked")).alias("reranked_total"))
    top = typed.select(F.posexplode(F.slice(F.arrays_zip("source_types", "scores"), 1, 5)).alias("pos", "hit"))
    at = [F.count_if(F.col("pos") == k).alias(f"at_{k + 1}") for k in range(5)]
    per = top.groupBy(F.col("hit.source_types").alias("source_type")).agg(F.count("*").alias("appearances"), F.round(F.avg("hit.scores"), 4).alias("avg_score"), *at)
    wins = F.round(F.col("at_1") * 100.0 / F.col("total"), 1).alias("win_rate")
    return per.crossJoin(F.broadcast(totals)).select("source_type", "appearances", "avg_score", *(f"at_{k}" for k in range(1, 6)), wins, "total", "reranked_total", F.round(F.col("reranked_total") * 100.0 / F.col("total"), 1).alias("coverage"))


def retention_anonymize(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The log with texts of searches older than ``days`` redacted; 0 days turns it off."""
    if days <= 0:
        return log.withColumn("changed", F.lit(False))
    old = F.col("created_at") < since(as_of, days)
    gone = {c: F.when(old, F.lit(None)).otherwise(F.col(c)) for c in ("response", "normalized_query", "rewritten_query") if c in log.columns}
    return log.withColumns(gone | {"changed": old, "query": F.when(old, REDACTED).otherwise(F.col("query"))})


def retention_purge(log: DataFrame, feedback: DataFrame, as_of: str, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Searches within ``days`` and the feedback on them; 0 days turns it off."""
    if days <= 0:
        return log, feedback
    stale = log.filter(F.col("created_at") < since(as_of, days)).select(F.col("id").alias("search_id"))
    return window_of(log, as_of, days), feedback.join(stale, "search_id", "left_anti")


def upsert_feedback(votes: DataFrame) -> DataFrame:
    """One row a search: the last vote, with the session and the time of the first."""
    last = F.max_by(F.struct("rating", "comment"), F.struct("voted_at", "vote_id"))
    first = F.min_by(F.struct("session_id"), F.struct("voted_at", "vote_id"))
    return votes.groupBy("search_id").agg(last.alias("v"), first.alias("f"), F.min("voted_at").alias("created_at"), F.max("voted_at").alias("updated_at")).select("search_id", "v.*", "f.session_id", "created_at", "updated_at")


def feedback_stats(feedback: DataFrame, log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = window_of(feedback, as_of, days).agg(F.count("*").alias("total"), F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))
    searches = window_of(log, as_of, days).agg(F.count("*").alias("searches"))
    share = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), 1), F.lit(0.0))
    return rows.crossJoin(searches).select("total", "up", "down", share("up", "total").alias("satisfaction"), share("total", "searches").alias("feedback_rate"))


def recent_feedback(feedback: DataFrame, log: DataFrame, limit: int = 20) -> DataFrame:
    newest = feedback.orderBy(F.desc("updated_at"), F.desc("search_id")).limit(limit)
    return newest.join(log.select(F.col("id").alias("search_id"), "query", "source"), "search_id")


def _last(timings: DataFrame, n: int) -> DataFrame:
    return timings.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("rank") <= n)


def latency_stats(timings: DataFrame, last: int = RECENT_TIMINGS) -> DataFrame:
    """Of each metric's last rows: count, mean, least, most, and percentiles by index into the sorted values."""
    values = F.sort_array(F.collect_list("duration_ms"))
    grouped = _last(timings, last).groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.round(F.min("duration_ms"), 2).alias("min_ms"), F.round(F.max("duration_ms"), 2).alias("max_ms"), values.alias("v"))
    index = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1).cast("int")
    return grouped.select("name", "n", "avg_ms", "min_ms", "max_ms", *(F.round(F.get("v", index(p)), 2).alias(f"p{p}_ms") for p in PERCENTILES))


def latency_recent(timings: DataFrame, n: int = 10) -> DataFrame:
    return _last(timings, n).select("name", "id", "ts", "duration_ms")


def error_rate(log: DataFrame) -> DataFrame:
    counts = log.agg(F.count("*").alias("queries"), F.count_if(F.col("is_error")).alias("errors"))
    return counts.withColumn("error_rate", F.coalesce(F.round(F.try_divide(F.col("errors") * 100.0, F.col("queries")), 2), F.lit(0.0)))


def latency_alerts(stats: DataFrame, limits=LATENCY_LIMITS) -> DataFrame:
    """``name, p95_ms, alert``; metrics without limits raise none."""
    table = stats.sparkSession.createDataFrame(list(limits), "name string, target double, warning double")
    alert = F.when(F.col("p95_ms") > F.col("warning"), "warning").when(F.col("p95_ms") > F.col("target"), "info").otherwise("none")
    return stats.join(F.broadcast(table), "name", "left").select("name", "p95_ms", alert.alias("alert"))


def job_runs(jobs: DataFrame, as_of: str, keep_days: int = 30) -> DataFrame:
    """Runs kept, each with its duration; runs that never finished count as failed. Older ones are dropped."""
    kept = jobs.filter(F.col("started_at") >= since(as_of, keep_days))
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    return kept.withColumns({"duration_s": seconds, "status": F.when(F.col("status") == "running", "failed").otherwise(F.col("status"))})


def list_jobs(jobs: DataFrame, kind: str | None = None, status: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of the runs of a type and status, newest first, with the number of all that fit."""
    rows = jobs.filter(F.col("job_type") == kind) if kind else jobs
    rows = rows.filter(F.col("status") == status) if status else rows
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("started_at"), F.desc("id")).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def job_counts(jobs: DataFrame) -> DataFrame:
    """``job_type, status, n, seconds``; null stands for all types or states."""
    return jobs.cube("job_type", "status").agg(F.count("*").alias("n"), F.sum("duration_s").alias("seconds"))


def login_lockouts(failures: DataFrame, seconds: int = 300, most: int = 5) -> DataFrame:
    """At each failure the failures of the last ``seconds``, itself included; at ``most`` or more the address is locked."""
    frame = Window.partitionBy("ip").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    counted = failures.withColumn("recent", F.count("*").over(frame))
    return counted.filter(F.col("recent") >= most).select("id", "ip", "ts", "recent", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).alias("locked_until"))


def sessions(log: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """The log with ``session_no``: a new one begins after a gap of more than ``gap_minutes``."""
    order = Window.partitionBy("user_id").orderBy("created_at", "id")
    fresh = (F.col("created_at") > F.lag("created_at").over(order) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(gap_minutes))).cast("int")
    return log.withColumn("fresh", F.coalesce(fresh, F.lit(1))).withColumn("session_no", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def session_history(log: DataFrame, keep: int = 3, gap_minutes: int = 30) -> DataFrame:
    """Each question with the at most ``keep`` exchanges before it in its session."""
    order = Window.partitionBy("user_id", "session_no").orderBy("created_at", "id").rowsBetween(-keep, -1)
    return sessions(log, gap_minutes).withColumn("history", F.array_join(F.collect_list("query").over(order), " > "))
