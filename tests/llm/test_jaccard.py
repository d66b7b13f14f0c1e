import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from kbforge.functions.storage import read_table
from kbforge.llm import jaccard


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[i != j and a and b and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if near[i][j]:
                    group[i] = group[j] = min(group[i], group[j])
        if all(group[i] == group[j] for i in range(len(rows)) for j in range(len(rows)) if near[i][j]):
            break
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return sorted(((i, least[g], sum(map(bool, n))) for (i, _), g, n in zip(rows, group, near)), key=str)


def corpus(n=8, copies=9, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for g in range(n):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 40, 80, 200]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((len(rows), " ".join(own).upper() if rnd.random() < 0.1 else ", ".join(own)))
    return rows + [(900, None), (901, ""), (902, "--"), (None, rows[0][1]), (None, "only here in a row"), (5, rows[5][1]), (5, "same id but other words than it"), (7, "word " * 30000)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard.links(docs).collect()), key=str) == brute(rows)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = corpus(3, 30, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard.links(docs).collect()), key=str) == brute(rows)


def test_one_of_each_stays(spark):
    rows = [(*r, f"x{i}") for i, r in enumerate(corpus(4))] + [(3, corpus(4)[3][1], "x3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string").repartition(2)
    got = jaccard.first_of_each(docs).collect()
    groups = {g for i, g, _ in brute([(k, r[1]) for k, r in enumerate(rows)]) if shingles(rows[i][1])}
    worded = [r for r in got if shingles(r.text)]
    assert len(worded) == len(groups) and len(got) - len(worded) == 3


def test_empty_and_limits(spark):
    assert jaccard.links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    limits = jaccard.least_matches()
    assert len(limits) == 8 and limits == sorted(limits) and limits[-1] == pytest.approx(82, abs=4)


def test_a_column_named_row_stays(spark):
    one, other = "one two three four five six seven eight", "quite another text of which no word is shared"
    rows = [(1, one, "a"), (2, one, "b"), (3, other, "c"), (3, other, "c")]
    for name in ("row", "ROW"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} string")
        got = jaccard.first_of_each(docs)
        assert got.columns == docs.columns and sorted(r[2] for r in got.collect()) == ["a", "c"]


def test_links_of_all_documents(spark):
    """Every pair of a whole table, by counting shared shingles, against the join: recall and precision at the threshold are 1."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    shared = Counter(pair for own in holders.values() if len(own) > 1 for pair in combinations(sorted(own), 2))
    links = Counter(x for (a, b), n in shared.items() if 9 * n >= 4 * (len(sets[a]) + len(sets[b])) for x in (a, b))
    got = {r.doc_id: r.n_links for r in jaccard.links(docs).collect()}
    assert sum(links.values()) > 100 and got == {i: links[i] for i in sets}


def test_no_documents_and_columns_of_any_name(spark):
    names = ["fp", "component", "n", "sig", "ROW", "_row", "best", "g", "class_id", "copies", "Links"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    rows = [(1, "one two three four five six", *range(11)), (2, "one two three four five six", *range(11)), (3, None, *range(11))]
    got = jaccard.first_of_each(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", *names] and sorted(r[0] for r in got.collect()) == [1, 3]
    assert jaccard.first_of_each(spark.createDataFrame([], schema)).count() == 0
    assert jaccard.links(spark.createDataFrame([("b", "x y z"), ("a", "x y z")], "doc_id string, text string")).first().class_id == "a"


def test_unlike_texts_of_one_id_both_stay(spark):
    one, other = "one two three four five six seven eight", "quite another text of which no word is shared"
    rows = [(1, one), (1, other), (2, one), (3, other), (None, one), (None, "a third text that nobody else has written here")]
    got = sorted(map(tuple, jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, one), (1, other), rows[-1]], key=str)
