import random
import re

import numpy as np
from kbforge.llm import decontaminate as dc


def plain(text):
    return "".join(map(chr, dc.normalised(text or "")[0]))


def brute(item, text):
    """Fewest edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def budget(m):
    return min(int(dc.RATE * m), (m - dc.Q) // dc.Q)


def edited(text, n, rnd):
    out = list(text)
    for _ in range(n):
        i = rnd.randrange(max(1, len(out)))
        kind = rnd.randrange(3)
        if not out:
            break
        if kind == 0:
            out[i] = rnd.choice("abcxyz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rnd.choice("abcxyz"))
    return "".join(out)


def test_normalised_keeps_places():
    text = "  Hé,  W\n--Ö 1😀𝐀 "
    codes, at = dc.normalised(text)
    assert plain(text) == re.sub(r"[\W_]+", " ", text.lower().replace("😀", " ")).strip() and [text[i] for i in at[:2]] == ["H", "é"]
    assert all(len(dc.normalised(t)[0]) == 0 for t in ("", " ", "--"))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeioutnsr") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, prose(rnd.choice([1, 2, 4, 9, 25, 50]))) for i in range(12)] + [(20, None), (21, "yes!"), (22, "")]
    docs = []
    for i in range(120):
        text = prose(rnd.randrange(0, 120))
        for _ in range(rnd.randrange(3)):
            item = rnd.choice(items[:12])[1]
            text += " " + edited(item, rnd.choice([0, 0, 1, 2, 5, 9, 20]), rnd) + " " + prose(4)
        docs.append((i, text.upper() if i % 9 == 0 else text))
    docs += [(200, None), (201, ""), (202, "yes"), (203, "eyes yesterday"), (None, items[4][1])]
    got = dc.regions(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    for i, text in docs:
        for j, item in items:
            a, b = plain(item), plain(text)
            k = budget(len(a))
            want = bool(a) and (brute(a, b) <= k if k >= 0 else f" {a} " in f" {b} ")
            assert ((i, j) in pairs) == want, (i, j)
    for r in got:
        a, b = plain(dict(items)[r.item_id]), plain(dict(docs)[r.doc_id][r.start : r.end])
        assert r.edits == (brute(a, b) if len(b) else 99) or r.edits >= brute(a, b)


def test_clean_and_empty(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from here"
    docs = spark.createDataFrame([(1, "start " + item + " end", "a"), (2, "nothing of the kind", "b"), (None, "x", "c"), (3, None, "d"), (1, "other row of the same id", "e")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    assert {r.item_id for r in dc.clean(docs, bench).collect()} == {"b", "c", "d"}
    assert {(r.doc_id, r.item_id, r.edits, r.start, r.end) for r in dc.regions(docs, bench).collect()} == {(1, 7, 0, 6, 6 + len(item)), (1, 8, 0, 6, 6 + len(item))}
    assert dc.clean(docs, bench.limit(0)).count() == 5 and dc.regions(docs.limit(0), bench).count() == 0
    long = spark.createDataFrame([(1, "word " * 200000 + item)], "doc_id long, text string")
    assert [r.item_id for r in dc.regions(long, bench.filter("item_id = 8")).collect()] == [8]


def test_blocks(spark):
    bench = spark.createDataFrame([(i, "x" * 50) for i in range(10)], "item_id long, text string")
    assert sorted(i for b in dc.blocks(bench, 120) for i, _ in b) == list(range(10)) and len(list(dc.blocks(bench, 120))) == 5
    assert np.array_equal(dc._grams(np.zeros(3, np.uint32)), np.zeros(0, np.uint64))


def test_string_ids_short_items_and_clashing_columns(spark):
    items = [("i1", "gpt"), ("i2", "GPT"), ("i3", "a-b"), ("i4", "the quick brown fox jumps over it")]
    docs = spark.createDataFrame([("d1", "my gpt, A b!", 1), ("d2", "agpt gpts", 2), ("d3", "the quick brown fox jumped over it", 3), (None, "gpt gpt", 4)], "doc_id string, text string, _hit int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(tuple(r) for r in dc.regions(docs.filter("doc_id IS NOT NULL"), bench).collect())
    assert [(d, i, a, b) for d, i, _, a, b in got] == [("d1", "i1", 3, 6), ("d1", "i2", 3, 6), ("d1", "i3", 8, 11), ("d3", "i4", 0, 34)]
    assert {(r.doc_id, r._hit) for r in dc.clean(docs, bench).collect()} == {("d2", 2)}
    old = dc.blocks.__defaults__
    dc.blocks.__defaults__ = (8,)
    try:
        assert sorted(tuple(r) for r in dc.regions(docs.filter("doc_id IS NOT NULL"), bench).collect()) == got
    finally:
        dc.blocks.__defaults__ = old
