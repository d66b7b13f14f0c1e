import random
import re

import pytest
from kbforge.functions import chunking, helpers
from kbforge.operators import corpus as ops
from kbforge.plans import corpus
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PIECES = ("Word ", "A longer sentence of words. ", "end.\n", "\n\n", "\n", "## Head\n", "## Other name\n", "  \xa0", "é. ", "## \n", "\x1c", "##\n\nName\n", "\x01\x02", "no end")
WAYS = {
    "plain": (chunking.plain, helpers.chunk_plain, [{}, {"size": 300, "overlap": 60, "separator": "\n"}, {"size": 300, "overlap": 0, "separator": ". "}]),
    "paragraphs": (chunking.paragraphs, helpers.chunk_paragraphs, [{}, {"tokens": 40, "overlap": 10, "whole": 20}]),
    "support_case": (chunking.support_case, helpers.chunk_support_case, [{}, {"tokens": 40, "overlap": 10, "whole": 20}]),
}


def odd_texts():
    rnd = random.Random(4)
    yield from (None, "", " \n\n ", "x" * 5000, ("Para. " * 50 + "\n\n") * 40, "a. " * 3000)
    for _ in range(250):
        yield "".join(rnd.choice([*PIECES, "x" * rnd.randrange(1, 300) + ". "]) for _ in range(rnd.randrange(60))) * rnd.choice([1, 1, 6])


@pytest.mark.parametrize("name", WAYS)
def test_folds_equal_their_twins_on_odd_texts(spark, name):
    fold, twin, options = WAYS[name]
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame(rows, "i long, t string")
    for own in options:
        found = df.select("i", fold(F.col("t"), **own).alias("c"))
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.i: [tuple(c) for c in r.c] if name == "support_case" else r.c for r in found.collect()}
        for i, t in rows:
            free = t.replace("\x01", "").replace("\x02", "") if t and name == "support_case" else t
            assert got[i] == twin(free, **own), (i, own)


def test_folds_equal_their_twins_on_the_tables(spark):
    for rows, mode, twin in (
        (corpus._paragraphed(spark, SF), "paragraphs", lambda t: [(c, None, "text") for c in helpers.chunk_paragraphs(t)]),
        (corpus._cases(spark, SF), "support_case", helpers.chunk_support_case),
        (corpus.docs(spark, SF), "plain", lambda t: [(c, None, "text") for c in helpers.chunk_plain(t)]),
    ):
        found = rows.select("text", helpers.chunk_column(F.col("text"), mode).alias("c")).collect()
        assert found and all([tuple(c) for c in r.c] == twin(r.text) for r in found)


def test_seven_sentences_are_found_in_one_pass(spark, monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a", "b. ", ". ", ".", "..", "\n", ".\n", "c d. "]) for _ in range(rnd.randrange(120))) for _ in range(400)]
    long = ["no point " * 60_000, "one. " * 6 + "x" * 400_000, "1.5 " * 80_000]
    rows = [(i, t) for i, t in enumerate([*texts, *long, None])]
    monkeypatch.setattr(corpus, "docs", lambda s, d: spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.text for r in corpus._paragraphed(spark, SF).collect()}
    # The pattern of the SQL; of the long texts none has seven sentences.
    assert [got[i] for i in range(len(texts))] == [re.sub(r"((?:[^.]*\. ){7})", "\\1\n\n", t) for t in texts]
    assert [got[len(texts) + i] for i in range(4)] == [*long, None]


def test_chunks_are_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, ""), (3, None)], "doc_id long, text string")
    found = ops.chunk_rows(docs, helpers.chunk_column(F.col("text"), "paragraphs"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert [(r.doc_id, r.chunk_index, r.total_chunks, r.text) for r in found.collect()] == [(1, 0, 1, "One. Two.")]
