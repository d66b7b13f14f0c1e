import random

import pytest
from kbforge.functions.storage import materialize
from kbforge.operators import catalog

SCHEMA = "id long, manufacturer string, device_type string, ports array<string>, protocols array<string>"


def brute(items, asked, limit):
    out = []
    for i, m, k, ports, protocols in asked:
        found = []
        for j, m2, k2, ports2, protocols2 in items:
            score = 3 * bool(m and m == m2) + 3 * bool(k and k == k2)
            score += sum(len({x for x in a or [] if x} & {x for x in b or [] if x}) for a, b in ((ports, ports2), (protocols, protocols2)))
            if score and i != j:
                found.append((-score, j))
        out += [(i, j, -s, r + 1) for r, (s, j) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def some(rnd, n, makers, kinds, marks, most):
    pick = lambda values: rnd.choice([None, "", *values])
    own = lambda: None if rnd.random() < 0.1 else [rnd.choice(["", *marks]) for _ in range(rnd.randrange(most))]
    return [(i, pick(makers), pick(kinds), own(), own()) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    items = some(rnd, 150, "ABCDE"[: 2 + seed], "xyz", "pqrstuvw"[: 3 + 2 * seed], 7) + [(1000 + i, "A", "x", ["p", "q"], None) for i in range(60)]
    asked = items[:25] + items[-3:] + [(5000, "A", "x", ["p", "none"], ["nobody"]), (5001, None, None, None, None), (5002, "Z", "z", ["zz"], [])]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for limit in (1, 5):
        assert sorted(map(tuple, catalog.related_items(df(items), df(asked), limit).collect())) == brute(items, asked, limit)
    assert catalog.related_items(df(items), df(asked).limit(0)).count() == 0 and catalog.related_items(df(items).limit(0), df(asked)).count() == 0


def test_lists_and_pairs_hold_classes_by_number(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(catalog, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    items = some(random.Random(7), 200, "AB", "xy", "pqrs", 6)
    df = spark.createDataFrame(items, SCHEMA)
    assert sorted(map(tuple, catalog.related_items(df, df.filter("id % 4 = 0"), 3).collect())) == brute(items, items[::4], 3)
    assert {dict(t.dtypes)["cls"] for name, t in written.items() if name != "classed"} == {"bigint"}
    # Of what the first list gives only what may be among the nearest is kept.
    assert written["reached"].filter("score < least").count() == 0 < written["reached"].count()


def test_no_growing_side_is_broadcast(spark, monkeypatch):
    plans = {}
    shown = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(catalog, "materialize", lambda df, name: plans.setdefault(name, shown(df)) and materialize(df, name))
    items = some(random.Random(8), 200, "AB", "xy", "pqrs", 6)
    df = spark.createDataFrame(items, SCHEMA)
    found = catalog.related_items(df, df.filter("id % 4 = 0"), 3)
    assert all("Broadcast" not in plan for plan in plans.values()) and plans["reached"].count("SortMergeJoin") == 3
    # The keys of many rows alone, a thousand at most.
    assert shown(found).count("BroadcastHashJoin") == 2
    assert sorted(map(tuple, found.collect())) == brute(items, items[::4], 3)
