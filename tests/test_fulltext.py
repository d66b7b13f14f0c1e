import math
import random
import re

import pytest
from kbforge.functions.stemming import stem
from kbforge.operators import fulltext, retrieval


def terms(text, stems):
    found = [t for t in re.findall(r"\w+", (text or "").lower()) if t not in retrieval.STOP_WORDS]
    return [stem(t) for t in found] if stems else found


def brute(docs, queries, k, stems):
    own = {i: terms(t, stems) for i, t in docs}
    avg = sum(map(len, own.values())) / len(own)
    df = {}
    for ts in own.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for qid, q in queries:
        asked = {stem(t) if stems else t for t in set(terms(q, False)) - {"near", "not", "or", "and"}}
        wanted = {t for t in df if any(t.startswith(a) for a in asked)}
        scores = {}
        for i, ts in own.items():
            hit = wanted & set(ts)
            if hit:
                idf = lambda t: math.log1p((len(own) - df[t] + 0.5) / (df[t] + 0.5))
                scores[i] = round(sum(idf(t) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / avg)) for t in hit), 5)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(qid, i, s) for i, s in best]
    return sorted(out)


@pytest.mark.parametrize("stems", [False, True])
def test_search_against_brute_force(spark, stems):
    rnd = random.Random(2)
    words = ["camera", "cameras", "connected", "connecting", "connection", "run", "running", "near", "ports", "port", "é", "élan", "élans", "a", "zoom", "z", "2", "2nd", "caresses", "ponies"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(25)))) for i in range(90)] + [(500, None), (501, "")]
    queries = [(1, "camera"), (2, "conn NEAR run"), (3, "ports OR zoom"), (4, "é"), (5, "nothing"), (6, ""), (7, None), (8, "z 2 the ponies"), (9, "connected ports")]
    index = fulltext.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), stems)
    got = [(r.query_id, r.doc_id, round(r.score, 5)) for r in fulltext.search(index, spark.createDataFrame(queries, "query_id long, text string"), 500).collect()]
    want = brute(docs, queries, 500, stems)
    assert [g[:2] for g in sorted(got)] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-5 for g, w in zip(sorted(got), want))


def test_only_asked_postings_are_read(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id % 900, ' common q', id % 7) AS text")
        index = fulltext.build(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    asked = spark.createDataFrame([("q3",)], "prefix string")
    found = index.terms(asked)
    assert [tuple(r)[:3] for r in found.collect()] == [("q3", "q3", 571)]
    own, every = index.postings(found), spark.read.parquet(f"{index.root}/postings")
    assert own.count() == 571 and 0 < len(own.inputFiles()) < len(every.inputFiles())
    assert index.terms(spark.createDataFrame([("word12",)], "prefix string")).count() == 11
    assert index.terms(spark.createDataFrame([("zz",)], "prefix string")).count() == 0


def test_queries_meet_postings_by_their_document_only(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('camera cam', id % 40, ' port', id % 7) AS text")
    queries = [(1, "c cam"), (2, "camera ca"), (3, "por cam1"), (4, "port")]
    index = fulltext.build(docs)
    found = fulltext.search(index, spark.createDataFrame(queries, "query_id long, text string"), 300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc_id#\d+L?, ", plan) and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)
    # A term that several of a query's prefixes begin counts once.
    got = sorted((r.query_id, r.doc_id, round(r.score, 5)) for r in found.collect())
    want = brute([tuple(r) for r in docs.collect()], queries, 300, False)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-5 for g, w in zip(got, want))
