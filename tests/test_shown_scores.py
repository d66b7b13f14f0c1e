from kbforge.operators import retrieval


def test_context_shows_scores_rounded_by_their_exact_value(spark):
    scores = [1.0005, 2.0015, 0.0625, 12345.6785, 0.3, 8.1235, 3.0005, 0.9995]
    rows = [(i, 1, s, "docs", "t", "g", "text") for i, s in enumerate(scores)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, score double, source string, title string, group_key string, text string")
    assert [r.context for r in retrieval.format_context(hits).orderBy("query_id").collect()] == [f"[1] t [Source: docs] [Score: {s:.3f}]\ntext\n" for s in scores]
    halves = hits.withColumn("score", hits.score * 10)
    shown = [r.context.split('relevance="')[1].split('"')[0] for r in retrieval.build_context(halves).orderBy("query_id").collect()]
    assert shown == [f"{s * 10:.2f}" for s in scores]
