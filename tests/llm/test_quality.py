import re
from collections import Counter

from kbforge.llm import quality

BASE = " ".join(f"word{i}" for i in range(40))
TEXTS = [
    None, "", "   \n\t", BASE, BASE + "\n" + BASE, "a b c d e f g h " * 5, "one two three four five six seven eight nine " + BASE,
    "x\n" * 30, "# | # | " * 20, "SHOUT " + BASE.upper(), "uni\x85code\xa0words " + BASE, ("longer text " + BASE + "\n") * 300, BASE, BASE,
]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base


def test_measures_against_brute_force(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, fail_bits string").repartition(3)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i or None]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i
        assert r.kept == (r.fail_bits == 0) and not (r.base_failed and r.kept)
    assert got[3].kept and not got[9].kept and got[8].fail_bits & 4


def test_ablations_against_masks(spark):
    rows = quality.judge(spark.createDataFrame(enumerate(TEXTS), "doc_id long, text string")).cache()
    bits = [r.fail_bits for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        mask = quality.POLICIES[r.policy]
        bit = 1 << [n for n, _ in quality.RULES].index(r.rule)
        bad = [b for b in bits if b & mask]
        assert (r.rejected, r.rule_fails, r.rescued) == (len(bad), sum(b & bit > 0 for b in bad), sum(b & mask == bit for b in bad))


def test_keep_and_empty(spark):
    docs = spark.createDataFrame([(1, BASE, "a"), (1, "short", "b"), (None, BASE, "c"), (2, None, "d")], "doc_id long, text string, kept string")
    assert sorted(r.kept for r in quality.keep(docs).collect()) == ["a", "c"]
    empty = docs.limit(0)
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0 and quality.ablations(quality.judge(empty)).count() == 0
