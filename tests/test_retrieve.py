import pytest
from kbforge.operators import retrieval


def frames(spark, texts, vectors):
    return retrieval.Collection(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))


@pytest.fixture(scope="module")
def found(spark):
    docs = [(0, "firmware of the RIO +LAN box"), (3, "nothing alike here"), (6, "other words too")]
    cases = [(1, "a quiet zebra"), (4, None), (7, "more zebra text")]
    custom = [(2, "plain"), (5, "plain again")]
    far, near = [0.0, 1.0], [1.0, 0.0]
    collections = {"docs": frames(spark, docs, [(0, far), (3, near), (6, [0.1, 1.0])]), "cases": frames(spark, cases, [(1, far), (4, [0.0, 0.0])]), "custom": frames(spark, custom, [(2, [0.9, 0.1])])}
    queries = spark.createDataFrame([(10, "RIO-Live firmware"), (11, "zebra"), (12, "nobody says this")], "query_id long, text string")
    asked = spark.createDataFrame([(10, near), (11, [-1.0, 0.0])], "query_id long, embedding array<float>")
    rows = retrieval.retrieve(collections, queries, asked, 3).collect()
    return {q: [(r.doc_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in (10, 11, 12)}


def test_words_in_their_usual_form_and_vectors_are_searched(found):
    # 3 and 2 share no word with the question; their vectors are near, but the reranker has them behind the words.
    assert found[10][0] == (0, 1.0) and {s for _, s in found[10][1:]} == {0.0} and len(found[10]) == 3


def test_every_collection_has_its_own_lists(found):
    assert found[11][:2] == [(1, 1.0), (7, 1.0)] and len(found[11]) == 3


def test_without_a_vector_only_words_count(found):
    assert found[12] == []


def test_dense_hits_are_fused_with_those_of_words(spark):
    one = frames(spark, [(0, "zebra"), (3, "other"), (6, None)], [(3, [1.0, 0.0]), (6, [0.5, 0.5])])
    queries = spark.createDataFrame([(10, "zebra")], "query_id long, text string")
    asked = spark.createDataFrame([(10, [1.0, 0.0])], "query_id long, embedding array<float>")
    rows = retrieval.search_hybrid_rrf(one, queries, asked, 5).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(0, round(1 / 61, 8)), (3, round(1 / 61, 8)), (6, round(1 / 62, 8))]
