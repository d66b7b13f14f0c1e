import pyarrow as pa
from kbforge.functions import helpers
from pyspark.sql import functions as F


def test_texts_are_read_in_slices(spark):
    texts = ["a" * 400, None, "", "b" * 700, "c" * 5000, *"d" * 10]
    parts = list(helpers.text_slices(pa.array(texts), 1000))
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 1000 for p in parts)
    assert list(helpers.text_slices(pa.array([], pa.string()))) == []


def test_a_batch_of_large_texts_gives_all_rows(spark):
    # Rows of one batch, of 40 MB in all.
    rows = spark.range(400, numPartitions=1).select("id", F.concat(F.lit("<body>"), F.repeat(F.lit("x"), 100_000)).alias("t"))
    plan = rows.select("id", helpers.html_column(F.col("t")).alias("p"))
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.filter(F.length("p.text") == 100_000).count() == 400
    assert rows.select("id", helpers.chunk_column(F.col("t"), "semantic").alias("c")).filter(F.size("c") == 1).count() == 400
