import random

from kbforge.operators.retrieval import expected_documents


def test_containment_against_brute_force(spark):
    rnd = random.Random(6)
    words = ["hello", "world", "he", "Hello", "o", "lo", "ört", "wört", "a_b", "2", "22"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 3, 20, 60]))) for i in range(120)] + [(500, None), (501, "say hello world to all"), (502, "the " * 400)]
    asked = [text(n).strip() for n in (1, 2, 3, 4, 5, 7, 9) for _ in range(8)]
    for i, t in docs[:60]:
        if t and len(t) > 12:
            a = rnd.randrange(len(t) - 5)
            asked.append(t[a : a + rnd.randrange(1, 60)])
    asked += ["hello world", "llo wor", "ell", "o", "the the", "", "--", None, "world ", " hello", "(", "he"]
    queries = list(enumerate(asked))
    got = sorted(map(tuple, expected_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")).collect()))
    has_word = lambda q: any(c.isalnum() or c == "_" for c in q)
    want = sorted((k, i) for k, q in queries if q and has_word(q) for i, t in docs if t and q in t)
    assert got == want and sum(len(q.split()) == 1 for k, q in queries if q and any(k == g for g, _ in got)) > 5


def test_nothing_asked_or_there(spark):
    docs = spark.createDataFrame([(1, "some words are here")], "doc_id long, text string")
    none = spark.createDataFrame([], "query_id long, text string")
    assert expected_documents(docs, none).count() == 0
    assert expected_documents(docs.limit(0), spark.createDataFrame([(1, "some"), (2, "some words are here")], none.schema)).count() == 0
