from datetime import datetime, timedelta
from pathlib import Path

from kbforge.operators.analytics import retention_purge
from kbforge.operators.daylog import DayLog

START = datetime(2024, 1, 1)


def logs(spark, n=200):
    log = [(i, START + timedelta(hours=5 * i), f"q{i}") for i in range(n)] + [(9001, None, "no time")]
    feedback = [(i, "up") for i in range(0, n, 3)] + [(7777, "down"), (9001, "up")]
    return spark.createDataFrame(log, "id long, created_at timestamp_ntz, query string"), spark.createDataFrame(feedback, "search_id long, rating string")


def ids(df):
    return sorted(r[0] for r in df.collect())


def files(root):
    return {str(f): f.stat().st_mtime_ns for f in Path(root).rglob("*.parquet")}


def test_old_days_go_and_only_the_edge_is_rewritten(spark, tmp_path):
    log, feedback = logs(spark)
    stored = DayLog(spark, str(tmp_path))
    stored.write(log, feedback)
    before = files(tmp_path)
    stored.purge("2024-02-01 13:00:00", 20)
    kept, votes = retention_purge(log.filter("created_at IS NOT NULL"), feedback, "2024-02-01 13:00:00", 20)
    assert ids(stored.searches().select("id")) == [*ids(kept.select("id")), 9001]
    assert ids(stored.feedback().select("search_id")) == ids(votes.select("search_id"))
    after = files(tmp_path)
    assert {f.split("/day=")[1][:10] for f in after if f not in before} == {"2024-01-12"}
    assert all(after[f] == before[f] for f in after if f in before)
    stored.purge("2024-02-01 13:00:00", 20)
    stored.purge("2024-02-01 13:00:00", 0)
    assert ids(stored.searches().select("id")) == [*ids(kept.select("id")), 9001]


def test_an_edge_of_which_nothing_stays(spark, tmp_path):
    log, feedback = logs(spark, 30)
    stored = DayLog(spark, str(tmp_path))
    stored.write(log, feedback)
    stored.purge("2024-01-04 23:59:00", 1)
    assert min(stored.days("searches")).isoformat() == "2024-01-04"
    stored.purge("2030-01-01 00:00:00", 1)
    assert ids(stored.searches().select("id")) == [9001] and ids(stored.feedback().select("search_id")) == [7777, 9001]


def test_nothing_left(spark, tmp_path):
    log, feedback = logs(spark, 5)
    stored = DayLog(spark, str(tmp_path))
    stored.write(log.filter("created_at IS NOT NULL"), feedback.filter("search_id < 5"))
    stored.purge("2030-01-01 00:00:00", 1)
    assert stored.searches().columns == log.columns and stored.searches().count() == stored.feedback().count() == 0
