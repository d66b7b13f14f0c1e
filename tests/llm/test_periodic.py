import random
import re
import zlib
from hashlib import sha256

import numpy as np
from kbforge.llm import periodic


def brute(words, shortest=12):
    """Every stretch that repeats with some period and cannot be extended; of one extent the least period counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(shortest, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def cases(seed, count, longest=70):
    rnd = random.Random(seed)
    for _ in range(count):
        n, k = rnd.randrange(1, longest), rnd.choice([1, 2, 2, 3, 5, 30])
        w = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            a, p = rnd.randrange(n), rnd.randrange(1, n + 1)
            stop = rnd.randrange(a, n) + 1
            w = [w[a + (i - a) % p] if a <= i < stop else x for i, x in enumerate(w)]
        yield w


def test_runs_against_brute_force():
    for w in cases(1, 1500):
        for shortest in (2, 12):
            assert [tuple(r) for r in periodic.runs_of(np.array(w), shortest).tolist()] == brute(w, shortest), w


def test_words_left_out_lie_in_no_run():
    texts = list(cases(2, 1500))
    ends = np.cumsum([0, *map(len, texts)])
    owner, runs = periodic._runs(np.concatenate(texts), ends)
    for k, w in enumerate(texts):
        assert [tuple(r) for r in runs[owner == k].tolist()] == brute(w), w


def test_the_tree_gives_common_extensions():
    for w in cases(3, 100, 40):
        symbols, text = np.unique(w, return_inverse=True)
        tree = periodic.SuffixTree((text + 1).tolist(), len(symbols))
        pairs = [(i, j) for i in range(len(w)) for j in range(len(w)) if i != j]
        if pairs:
            got = tree.common(*map(np.array, zip(*pairs)))
            assert got.tolist() == [next((k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k]), 0) for i, j in pairs]
        order = sorted(range(len(w)), key=lambda i: w[i:])
        assert sorted(range(len(w)), key=lambda i: tree.place[i]) == order
        order = sorted(range(len(w)), key=lambda i: [-x for x in w[i:]])
        assert sorted(range(len(w)), key=lambda i: tree.reverse_order()[i]) == order


def whole(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else x for i, x in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda t: sha256(t.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *shown, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_the_query_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["a", "b", "é", "x\x85y", "n\xa0b", "word"]
    texts = [None, "", " \t\n", "a " * 500, " ".join(map(str, range(300))), "x y z " * 4, "x y z " * 3 + "x y", "one\n" * 12, "one\n" * 11, " ".join(str(i % 40) for i in range(2000))]
    texts += [rnd.choice([" ", "\n", "\x0b "]).join(rnd.choice(words[:k]) for _ in range(rnd.randrange(200))) for k in (1, 2, 3, 6) for _ in range(40)]
    rows = [(i if i else None, t, [1], "k") for i, t in enumerate(texts)] + [(7, texts[7], [1], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, collapsed string").repartition(3)
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in periodic.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted((whole(i, t) for i, t, *_ in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))) > 5
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_a_long_periodic_text(spark):
    text = " ".join(f"w{i % 7001}" for i in range(100_000))
    (row,) = periodic.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 100_000, 7001)] and row.n_words == 100_000 and len(row.collapsed.split(" ")) == 7001
