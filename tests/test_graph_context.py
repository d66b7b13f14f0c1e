from kbforge.operators import graph


def test_context_of_hits_that_share_names(spark):
    steps = {"a": "dcba", "b": "edc", "c": "zyx", "d": "a"}
    around = [(s, "Port", n, 1 + (n in "dz")) for s, ns in steps.items() for n in ns]
    hits = [(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 11), (3, "b", 1), (3, "c", 10), (3, "none", 2)]
    rows = lambda data, names: spark.createDataFrame(data, names)
    names = rows([("Port", n, n.upper()) for n in "abcdexyz"], "type string, key string, name string")
    got = graph.graph_context(rows(hits, "query_id long, doc_key string, rank int"), rows(around, "seed string, type string, key string, hop int"), names)
    want = {}
    for q, seed, rank in hits:
        for s, _, n, hop in around:
            if s == seed and rank <= 10:
                own = want.setdefault(q, {})
                own[n.upper()] = min(hop, own.get(n.upper(), 9))
    assert {r.query_id: r.names for r in got.collect()} == {q: ", ".join(n for _, n in sorted((h, n) for n, h in own.items())[:3]) for q, own in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "near" in plan
