import numpy as np
import pyarrow as pa
import pytest
from kbforge.functions.storage import read_table
from kbforge.operators import vectors
from kbforge.plans.retrieval import PROBES


def brute(ids, m, queries, k):
    v = vectors.unit(np.array(m, float))
    out = []
    for qid, q in queries:
        scores = np.round(v @ vectors.unit(np.array([q], float))[0], 6) + 0.0
        order = np.lexsort((ids, -scores))[:k]
        out += [(qid, int(ids[i]), float(scores[i]), r + 1) for r, i in enumerate(order)]
    return sorted(out)


def table(spark, ids, m, name="vec_id"):
    return spark.createDataFrame([(int(i), [float(x) for x in row] if row is not None else None) for i, row in zip(ids, m)], f"{name} long, embedding array<float>")


@pytest.mark.parametrize("cells", [None, 1, 7])
def test_exact_search_against_brute_force(spark, monkeypatch, cells):
    rnd = np.random.default_rng(5)
    centers = rnd.normal(size=(6, 8))
    m = np.round((centers[rnd.integers(0, 6, 600)] + 0.3 * rnd.normal(size=(600, 8))).astype(np.float32), 3)
    m[:40] = m[0]
    m[40:45] = 0
    m[45:60] = -m[60:75]
    monkeypatch.setattr(vectors, "PART", 50)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    asked = [(k, m[k]) for k in (0, 41, 50, 100, 200, 300)] + [(1000 + k, rnd.normal(size=8).astype(np.float32)) for k in range(30)]
    found = vectors.search(vectors.build(table(spark, range(600), m).repartition(3), cells), table(spark, *zip(*asked), name="query_id"), 10)
    assert sorted(map(tuple, found.collect())) == brute(np.arange(600), m, asked, 10)


def test_odd_rows(spark):
    m = [[1, 0], [0, 0], None, [1, 0]]
    index = vectors.build(table(spark, range(4), m))
    asks = table(spark, [1, 2, 3], [[2, 0], [0, 0], None], "query_id")
    got = sorted(map(tuple, vectors.search(index, asks, 2).collect()))
    assert got == [(1, 0, 1.0, 1), (1, 3, 1.0, 2), (2, 0, 0.0, 1), (2, 1, 0.0, 2)]
    assert vectors.search(index, asks.limit(0)).count() == 0
    none = vectors.build(table(spark, range(4), m).limit(0))
    assert vectors.search(none, asks).count() == 0
    zeros = vectors.build(table(spark, [1], [[0, 0]]))
    assert [tuple(r) for r in vectors.search(zeros, asks.filter("query_id = 1")).collect()] == [(1, 1, 0.0, 1)]


def test_recall_of_a_few_cells(spark):
    rows = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    index = vectors.build(rows)
    asks = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in vectors.search(index, asks, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in vectors.search(index, asks, 10, PROBES).collect()}
    assert len(near & exact) >= 0.9 * len(exact) and len(exact) == 10 * asks.count()
    few = {(r.query_id, r.vec_id) for r in vectors.search(index, asks, 10, 3).collect()}
    assert 0.3 * len(exact) < len(few & exact) < len(near & exact)


def test_few_rows_are_worked_on_at_once(monkeypatch):
    monkeypatch.setattr(vectors, "MATRIX", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(25))], names=["a"])
    cut = list(vectors.few(iter([batch, batch.slice(0, 0)]), 30))
    assert [len(b) for b in cut] == [3] * 8 + [1] and [x for b in cut for x in b.column(0).to_pylist()] == list(range(25))
    assert [len(b) for b in vectors.few(iter([batch]), 1000)] == [1] * 25 and [len(b) for b in vectors.few(iter([batch]), 0)] == [25]
