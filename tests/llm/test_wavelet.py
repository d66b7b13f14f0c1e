import zlib

import numpy as np
import pyarrow as pa
from kbforge.llm import wavelet
from kbforge.llm.token_words import WordEncoder, default_tokenizer
from kbforge.llm.wavelet import WaveletMatrix, pack, token_output, write_shards

ODD = ["", "   ", None, "a<|endoftext|>b c", "É é Σ DON'T it's 123abc!!,.. 你好😀 \x1c z\x85k \x0b\x0cfoo\x0bbar x's'tore'", "naïve–ª µ½² ÀÉÎ×÷ßÿ e\u0301", "x " * 30000, "ab cd", "ab cd"]


def test_words_give_the_whole_text_encoding():
    enc = WordEncoder(default_tokenizer())
    texts = [t or "" for t in ODD]
    whole = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for ids, starts in enc.encode(pa.array(texts)) for a, b in zip(starts, starts[1:])] == [w.ids for w in whole]


def test_another_tokenizer_file_is_encoded_by_the_library():
    import public_tokenizers

    enc = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.by_words
    texts = [t or "" for t in ODD]
    whole = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for ids, starts in enc.encode(pa.array(texts)) for a, b in zip(starts, starts[1:])] == [w.ids for w in whole]


def test_queries_match_the_sequence():
    seq = np.random.default_rng(3).integers(0, 40, 5000).astype("<u2")
    wm = WaveletMatrix(pack(seq, [7], [5000], 6))
    assert (wm.tokens() == seq).all()
    assert [wm.access(i) for i in (0, 511, 512, 4999)] == seq[[0, 511, 512, 4999]].tolist()
    for token in (0, 17, 39, 63, 64):
        at = np.flatnonzero(seq == token)
        assert wm.count(token) == len(at)
        assert wm.count(token, 600, 3000) == ((at >= 600) & (at < 3000)).sum()
        for k in {0, len(at) // 2, len(at) - 1} - {-1}:
            assert wm.occurrence(token, k) == (at[k] if k < len(at) else -1)
        assert wm.occurrence(token, len(at)) == -1


def test_empty_shard():
    wm = WaveletMatrix(pack(np.zeros(0, "<u2"), [], [], 4))
    assert wm.tokens().tolist() == [] and wm.count(1) == 0 and wm.occurrence(1, 0) == -1


def test_output_against_brute_force(spark):
    rows = [(i * 3 % 11, t, i) for i, t in enumerate(ODD)] + [(None, "null id", 1), (4, "again", 2), (4, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    tok = WordEncoder(default_tokenizer()).tokenizer
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_output(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = write_shards(docs, shard_tokens=100)
    assert small.count() > 1 and small.agg({"n_tokens": "sum"}).first()[0] == start


def test_no_documents(spark):
    assert token_output(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_rows_without_an_id(spark):
    rows = [(None, f"text {i % 1000}") for i in range(3000)] + [(None, "copies")] * 3000 + [(i, "x") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in wavelet.ordered(docs).groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.6 * len(rows)
    got = token_output(docs).collect()
    assert len(got) == len(rows) and sorted(r.start for r in got)[0] == 0
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and [r.doc_id for r in sorted(got, key=lambda r: r.start)][-5:] == [0, 1, 2, 3, 4]
