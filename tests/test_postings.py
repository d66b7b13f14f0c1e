import random
from collections import Counter

from kbforge.operators import corpus, fulltext, graph, retrieval


def test_terms_are_counted_where_they_are_read(spark):
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice("xyzäé") * rnd.choice([1, 2]) for _ in range(n))) for i, n in enumerate([0, 1, 2, 50, 900])] + [(9, None), (10, "the of")]
    found = retrieval.bm25_postings(spark.createDataFrame(texts, "doc_id long, text string"))
    want = {(i, t, n, sum(c.values())) for i, text in texts for c in [Counter(text.split() if i < 9 and text else [])] for t, n in c.items()}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_key_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "xx yy"), (1, "xx zz"), (None, "xx"), (None, "xx")], "doc_id long, text string")
    want = {(1, "xx", 2, 2), (1, "yy", 1, 2), (1, "zz", 1, 2), (None, "xx", 2, 1)}
    assert set(map(tuple, retrieval.bm25_postings(docs).collect())) == want
    queries = spark.createDataFrame([(7, "xx yy zz")], "query_id long, text string")
    assert set(map(tuple, retrieval.asked_postings(docs, queries)[0].select("doc_id", "term", "tf", "doc_len").collect())) == want


def test_many_asked_terms_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"xx w{i % 7} w{i % 3} tail{i}") for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 xx"), (2, "tail5 w6"), (3, "none here")], "query_id long, text string")
    few = sorted(map(tuple, retrieval.search_bm25(docs, queries, 9).collect()))
    monkeypatch.setattr(retrieval, "LISTED_TERMS", 2)
    assert sorted(map(tuple, retrieval.search_bm25(docs, queries, 9).collect())) == few


def test_entities_are_searched_by_numbers(spark, monkeypatch):
    seen, own = [], retrieval.asked_postings
    monkeypatch.setattr(retrieval, "asked_postings", lambda docs, queries: seen.append(docs.schema["doc_id"].dataType.simpleString()) or own(docs, queries))
    nodes = spark.createDataFrame([("Issue", f"{w} lens fault") for w in "zyxwvutsr"] + [("Solution", "lens lens"), ("Port", "lens"), ("Issue", "other: thing")], "label string, key string")
    got = graph.entity_search(nodes.repartition(3), spark.createDataFrame([(1, "lens")], "query_id long, text string"), 4).orderBy("rank").collect()
    assert [(r["label"], r["key"], r["rank"]) for r in got] == [("Solution", "lens lens", 1)] + [("Issue", f"{w} lens fault", i) for i, w in enumerate("rst", 2)]
    assert seen == ["bigint"] and got[1]["score"] == got[3]["score"]


def test_stems_are_counted_where_texts_are_read(spark):
    docs = spark.createDataFrame([(1, "Cameras camera running runs ran"), (2, None), (3, "the of"), (4, "élan CAMERAS")], "doc_id long, text string")
    found = fulltext.stemmed(docs.repartition(2))
    assert sorted(map(tuple, found.select("doc_id", "term", "tf", "doc_len").collect())) == [(1, "camera", 2, 5), (1, "ran", 1, 5), (1, "run", 2, 5), (4, "camera", 1, 2), (4, "élan", 1, 2)]
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()


def test_keywords_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * k) % 11} tail{i % 4} only{i}" for k in range(9))) for i in range(40)], "doc_id long, text string")
    found = corpus.document_keywords(docs)
    assert "SortMergeJoin" not in found._jdf.queryExecution().optimizedPlan().toString() and "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
    few = sorted(map(tuple, found.collect()))
    assert len(few) == 40
    monkeypatch.setattr(corpus, "KNOWN_TERMS", 5)
    assert sorted(map(tuple, corpus.document_keywords(docs).collect())) == few
