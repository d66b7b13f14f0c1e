import numpy as np
from kbforge.llm import separators
from kbforge.llm.token_words import WordEncoder, default_tokenizer

TEXTS = ["", None, "one two", "a<|endoftext|>b", "x " * 5000, "last", "dup", "dup"]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(TEXTS)] + [(7, "again", 2)], "doc_id long, text string, file int").repartition(3)
    tok = WordEncoder(default_tokenizer(), plain_specials=True).tokenizer
    want = [(i or None, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(TEXTS), (7, "again")]]
    assert sorted(map(tuple, separators.token_counts(docs).collect()), key=str) == sorted(want, key=str)
    assert separators.token_counts(docs.limit(0)).count() == 0


def test_stitching_over_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = []
    for name, chance in (("a", 0.3), ("b", 0.02), ("c", 0.0), ("d", 1.0)):
        ids = np.where(rng.random(500) < chance, 9, rng.integers(10, 99, 500)).astype("<u2")
        (tmp_path / name).write_bytes(ids.tobytes())
        ends = [-1, *np.flatnonzero(ids == 9).tolist()]
        rows = [(name, k, a + 1, b - a - 1, True) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
        want += rows + ([(name, len(rows), ends[-1] + 1, 499 - ends[-1], False)] if ends[-1] < 499 else [])
    for size in (1, 7, 64, 1000):
        blocks = separators.read_flat(spark, str(tmp_path), 2, size)
        got = [(r.file[-1], r.ordinal, r.start, r.n_tokens, r.terminated) for r in separators.documents_of(blocks, 9).collect()]
        assert sorted(got) == sorted(want), size
