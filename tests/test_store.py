from pathlib import Path

import pytest
from kbforge.operators import store
from kbforge.operators.retrieval import bm25_postings
from kbforge.streaming import ingest
from pyspark.sql import functions as F

CHUNKS = "k long, text string, batch int"


def kept(spark, root, postings=True):
    tables = {"chunks": CHUNKS} | ({"postings": f"k long, {store.POSTINGS}"} if postings else {})
    return store.Store(spark, str(root), tables, ["k"], 32)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def size(root, commit):
    return sum(f.stat().st_size for f in Path(root).rglob("*.parquet") if f"/{commit}/" in str(f))


def test_only_touched_buckets_are_written_and_postings_keep_step(spark, tmp_path):
    s = kept(spark, tmp_path)
    first = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("some words of chunk "), "id").alias("text"), F.lit(1).alias("batch"))
    assert store.upsert(s, first, ["batch"], "one")
    change = spark.createDataFrame([(7, "words anew", 2), (5000, "a new one", 2), (None, "no key", 2), (9, "too old", 0)], CHUNKS)
    assert store.upsert(s, change, ["batch"], "two")
    want = {(k, f"some words of chunk {k}", 1) for k in range(3000) if k != 7} | {(7, "words anew", 2), (5000, "a new one", 2), (None, "no key", 2)}
    assert rows(s.read("chunks")) == sorted(want, key=str)
    rebuilt = bm25_postings(s.read("chunks"), "k")
    assert rows(s.read("postings").select("k", "term", "tf", "doc_len").filter("k IS NOT NULL")) == rows(rebuilt.filter("k IS NOT NULL"))
    # Four keys touch four of 32 buckets.
    assert 0 < size(tmp_path, "two") < 0.3 * size(tmp_path, "one")
    assert len(s.touched(change)) <= 4


def test_a_commit_counts_once_and_whole(spark, tmp_path):
    s = kept(spark, tmp_path, False)
    a, b = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], CHUNKS), spark.createDataFrame([(2, "c", 2)], CHUNKS)
    assert store.upsert(s, a, ["batch"], "run/1") and store.replace(s, b, "run/2") and not store.replace(s, a, "run/2")
    assert rows(s.read("chunks")) == [(1, "a", 1), (2, "c", 2)]
    # A writer that was lost before its manifest leaves nothing that is read.
    lost = kept(spark, tmp_path, False)
    real, calls = lost._names, []

    def names():
        calls.append(1)
        if len(calls) > 4:  # the rows are written, the manifest is not
            raise RuntimeError("lost")
        return real()

    lost._names = names
    with pytest.raises(RuntimeError):
        store.upsert(lost, spark.createDataFrame([(1, "lost", 9)], CHUNKS), ["batch"], "run/3")
    assert size(tmp_path, "run%2F3") > 0
    assert rows(s.read("chunks")) == [(1, "a", 1), (2, "c", 2)]
    assert store.upsert(s, spark.createDataFrame([(1, "made", 9)], CHUNKS), ["batch"], "run/3")
    assert rows(s.read("chunks")) == [(1, "made", 9), (2, "c", 2)]
    assert store.replace(s, b.limit(0), "empty") and rows(s.read("chunks")) == [(1, "made", 9), (2, "c", 2)]
    before = len(s.vacuum(1)), rows(s.read("chunks"))
    assert before[1] == [(1, "made", 9), (2, "c", 2)] and s.vacuum(1) == []


def page(*paras):
    return "<html><body><nav>menu</nav><article><h1>T</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "</article></body></html>"


def test_ingested_pages_equal_a_batch_build(spark, tmp_path):
    long = [("word " * 60).strip() + f" end{i}. Next" for i in range(20)]
    deliveries = [
        [(1, 1, "u1", page(*long)), (2, 1, "u2", page("short")), (3, 1, "u3", page("x")), (None, 1, "u", page("lost")), (4, 1, None, None)],
        [(1, 2, "u1", page(long[0])), (2, 1, "u2", page("other words of the same version")), (3, 0, "u3", page("older"))],
        [(3, 2, "u3", ""), (5, 1, "u5", page("new")), (5, 1, "u5", page("new")), (1, 1, "u1", page(*long))],
    ]
    s = store.page_store(spark, str(tmp_path / "store"), 8)
    seen = []
    for rows_ in [*deliveries, deliveries[1]]:
        spark.createDataFrame(rows_, ingest.VERSIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.page_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(ingest.into(s)).trigger(availableNow=True)
        stream.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
        seen.append(s.read("chunks").filter("page_id = 1").count())
    assert seen[0] > 5 and seen[1:] == [seen[1]] * 3 and seen[1] < seen[0]
    final = spark.createDataFrame([(1, 2, "u1", page(long[0])), (2, 1, "u2", page("short")), (3, 2, "u3", ""), (4, 1, None, None), (5, 1, "u5", page("new"))], ingest.VERSIONS)
    whole = store.page_store(spark, str(tmp_path / "whole"), 8)
    assert store.ingest_pages(whole, final, ingest.page_chunks(), "all")
    for table in store.PAGES:
        assert rows(s.read(table)) == rows(whole.read(table)), table
    assert {r.page_id for r in s.read("chunks").collect()} == {1, 2, 5} and s.read("documents").count() == 5
    # The same batch once more, as after a driver was lost between commit and checkpoint.
    before = rows(s.read("chunks"))
    again = ingest.into(s)
    again(spark.createDataFrame(deliveries[0], ingest.VERSIONS), 0)
    assert rows(s.read("chunks")) == before and len(s._names()) == 4


def test_kept_rows_and_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    s = kept(spark, tmp_path)
    first = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("some words of chunk "), "id").alias("text"), F.lit(1).alias("batch"))
    store.upsert(s, first, ["batch"], "one")
    changed = spark.createDataFrame([(k,) for k in range(0, 200, 3)], "k long")
    for most in (500_000, 20):  # all keys are broadcast at once, or those of some buckets
        monkeypatch.setattr(store, "BROADCAST_KEYS", most)
        stay = s.others("postings", list(range(32)), changed, s.files())
        plan = stay._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftAnti") == plan.count("strategy=broadcast") == (1 if most > 100 else 4)
        assert {r.k for r in stay.collect()} == {k for k in range(200) if k % 3} and stay.count() == 5 * 133 - 133
