import math
import re
import zlib
from collections import Counter

from kbforge.functions.storage import read_table
from kbforge.llm import language


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    away = [i for i, r in got.items() if r.held_out]
    assert len(away) > 150 and sum(got[i].lang_pred == truth[i] for i in away) >= 0.97 * len(away)


def test_labels_of_held_out_rows_are_never_seen(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "ena dva tri", "hidden" if zlib.crc32(str(i).encode()) % 4 == 2 else ("aa" if i % 2 else "bb")) for i in range(60)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"aa", "bb"} and all((r.lang_pred == "aa") == bool(r.doc_id % 2) for r in got)


def test_odd_rows(spark):
    odd = [None, "", "123 !!", "zzz", "alphabet", "alpha " * 50000, "日本語"]
    rows = [(1, "alpha beta", "aa"), (3, "ena dva", "bb"), (3, "ena dva", "bb"), (None, "alpha", None)] + [(i, t, None) for i, t in enumerate(odd, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", language.F.lit("clash"))
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[10] == by[11] == by[12] == ("und", 0.0) and by[14][0] == by[15][0] == "aa" and by[None][0] == "aa"
    assert by[16] == ("aa", 0.5)  # nothing known: equal, the first
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", language.F.lit(None).cast("string"))).collect()} == {"und"}


def test_scores_against_brute_force(spark):
    texts = {"aa": ["alpha beta gamma alpha", "alphabet zeta beta", "gamma Alpha's delta"], "bb": ["ena dva tri ena", "dvanajst tri petnajst", "šest ena štiri"], "cc": ["uno dos tres", "dos cuatro uno, cinco"]}
    rows = [(t, lang) for lang, own in texts.items() for t in own]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), 10**9)
    langs = sorted(texts)
    counts = {g: Counter(w for t in texts[g] for w in re.findall(r"[^\W\d_]+", t.lower())) for g in langs}
    words = set().union(*counts.values())

    def cut(word, n):
        marked = word if n == 1 else f"\x02{word}\x03"
        return [marked[i : i + n] for i in range(len(marked) - n + 1)]

    grams = {g: {n: Counter(p for w, c in counts[g].items() for p in cut(w, n) for _ in range(c)) for n in language.ORDERS} for g in langs}

    def log(count, total, kinds):
        return math.log(count + 0.5) - math.log(total + 0.5 * (kinds + 1))

    def word_score(word, g):
        if word in words:
            return log(counts[g][word], sum(counts[g].values()), len(words))
        for n in language.ORDERS:
            known = set().union(*(grams[h][n] for h in langs))
            hits = [log(grams[g][n][p], sum(grams[g][n].values()), len(known)) for p in cut(word, n) if p in known]
            if hits:
                return sum(hits) / len(hits)
        return 0.0

    asked = ["alpha ena", "betas dvakrat", "dosuno trestri", "qqq", "šestdeset Alpha", "x", "zzz ena", "a " * 3]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(asked):
        sums = [sum(word_score(w, g) for w in re.findall(r"[^\W\d_]+", text.lower())) for g in langs]
        top = max(range(len(langs)), key=lambda i: (sums[i], -i))
        assert got[k][0] == langs[top] and abs(got[k][1] - 1 / sum(math.exp(s - sums[top]) for s in sums)) < 1e-9, text


def test_number_signs_are_no_letters(spark):
    rows = [(1, "alpha beta", "aa"), (10, "²½", None), (11, "Ⅷ ①", None), (12, "x²", None)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[10] == got[11] == "und" and got[12] == "aa"


def test_copies_and_many_languages_do_not_swell_the_sample(spark, monkeypatch):
    rows = [(f"text number {i}", "aa") for i in range(3000)] + [("one text again", "aa"), ("and another", "bb")] * 4000 + [("x" * 1_000_001, "bb"), (None, "bb"), ("no language", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    found = language.sample(docs, 50).collect()
    assert len(found) == len(set(found)) and 20 < len(found) < 100 and [r.text for r in found if r.lang == "bb"] == ["and another"]
    monkeypatch.setattr(language, "SAMPLE_ALL", 20)
    assert len(language.sample(docs, 50).collect()) < 40
