import random
from hashlib import md5

import numpy as np
import pyarrow as pa
import sentencepiece
from kbforge.functions.storage import read_table
from kbforge.llm import sentencepiece as sp

TEXTS = [None, "", " ", "  Hello  wörld\n\nfoo\tb　x 你好 😀 <s> ", "▁under▁ ▁", "don't stop. e.g. www.x.com", "a" * 3000, "ab" * 150 + " " + "́e", "x" * 250 + "y", "\n", "The end", "The end", "the   end    of" + " " * 100 + "it", "-" * 200 + "=" * 33 + "𝔸b", "éà" * 70, "   "]


def test_encoding_equals_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)]
    rows += [(100 + r.doc_id, r.text, "") for r in read_table(spark, "/root/testdata/sf0.001", "documents").filter("doc_id < 60").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = sorted(((i, lib.encode(t or "")) for i, t, _ in rows), key=str)
    for most in (sp.TABLE_SEGMENTS, 40):
        assert sorted(((r.doc_id, r.ids) for r in sp.encode(docs, table_segments=most).collect()), key=str) == want
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(docs)).collect()}
    assert all(back[i] == lib.decode(lib.encode(t or "")) for i, t, _ in rows)
    assert all(back[i] == (t or "") for i, t, _ in rows if "▁" not in (t or ""))
    assert sp.encode(docs.limit(0)).count() == 0


def test_the_fold_equals_the_library_on_random_words(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeinorst.,-=*/#éñ▁你x0") for _ in range(rnd.choice([3, 8, 20, 61, 62, 63, 150, 400]))) for _ in range(400)]
    words += ["".join(rnd.choice("ab") for _ in range(n)) for n in (59, 60, 61, 62, 5000)] + ["aaaa" * 15, "ababab" * 30]
    got = sp.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.ids for r in got} == {i: lib.encode(w) for i, w in enumerate(words)}
    assert [p for p in sp.Pieces.load(sp.default_model()).irregular if p.strip("▁")] == []


def test_long_segments_merge_alike():
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    model, rnd = sp.Pieces.load(sp.default_model()), random.Random(3)
    for _ in range(200):
        word = "".join(rnd.choice("etaoinshré你.,") for _ in range(rnd.randrange(1, 60)))
        assert sp.encode_long("▁" + word, model) == lib.encode(word)


def test_segments_of_any_length(spark):
    """Segments beyond the fold, alone and among others, by the table and beside it."""
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    rnd = random.Random(9)
    texts = ["ab" * 500_000, "".join(rnd.choice("etaoinsh,.é你") for _ in range(200_000)), "a" * 255, "ab" * 128, "ba" * 129, "x y", "ab" * 500_000, None]
    want = {i: lib.encode(t or "") for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows, most in ((docs, sp.TABLE_SEGMENTS), (docs, 2), (docs.filter("doc_id = 0"), sp.TABLE_SEGMENTS)):
        for r in sp.encode(rows, table_segments=most, back=True).collect():
            assert r.ids == want[r.doc_id] and r.equals_text


def test_long_unigram_segments():
    pieces = ["▁", "a", "b", "ab", "aba", "bb"]
    model = sp.Pieces.of(sp.UNIGRAM, [("<unk>", 0.0, 2)] + [(p, -1.5 - k / 7, 1) for k, p in enumerate(pieces)])
    rnd = random.Random(2)
    word = "".join(rnd.choice("ab") for _ in range(300))
    assert sp.encode_long(word, model) == best(word, model)
    assert len(sp.encode_long("ab" * 200_000, model)) == 200_000


def test_a_segment_whose_hash_is_taken(spark, tmp_path):
    """Where a segment beside the table, or another one in it, has the hash of one in it, the next key of the hash is used."""
    rows = spark.createDataFrame([("ab", [1]), ("cd", [2, 3]), ("e", [4])], "segment string, ids array<int>")
    table = sp.Table.of(rows, np.dtype("<u2"), spark.createDataFrame([("zz",), ("q",)], "segment string"))
    assert table.turn == 0 and table.look_up(pa.array(["cd", "zz", "ab"])) == [np.array([2, 3], "<u2").tobytes(), None, np.array([1], "<u2").tobytes()]
    assert table.taken(spark.createDataFrame([("cd",), ("q",), ("e",)], "segment string")) == 2
    tried = []

    class Other(sp.Table):
        def taken(self, others):
            tried.append(self.turn)
            return len(tried) < 3

    assert Other.of(rows, np.dtype("<u2"), rows).turn == 2 and tried == [0, 1, 2]


def test_copies_of_a_text_with_rare_segments(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    rows = [(None if i % 2 else i, "rare zyxq words" if i % 3 else None) for i in range(4000)] + [(5, "other text")]
    got = sp.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), table_segments=1).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(((i, lib.encode(t or "")) for i, t in rows), key=str)


def best(text, model):
    ways = {0: (0.0, [])}
    floor = min(model.scores[i] for i in model.ids.values()) - 10
    for i in range(1, len(text) + 1):
        ways[i] = max(((ways[k][0] + (model.scores[model.ids[text[k:i]]] if text[k:i] in model.ids else floor), ways[k][1] + [text[k:i]]) for k in range(i) if text[k:i] in model.ids or i - k == 1), key=lambda w: w[0])
    return [model.ids.get(p, model.unknown) for p in ways[len(text)][1]]


def test_unigram_fold_is_viterbi(spark):
    rnd = random.Random(8)
    pieces = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(40)} | {"▁", "▁a"})
    model = sp.Pieces.of(sp.UNIGRAM, [("<unk>", 0.0, 2)] + [(p, -rnd.random() * 5 * len(p) ** 0.5, 1) for p in pieces])
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))) for _ in range(40)]
    got = {r.segment: r.ids for r in sp.lattice(spark.createDataFrame([(w,) for w in set(words)], "segment string"), model).collect()}
    for w in words:
        assert got[w] == best(w, model) == sp.encode_long(w, model)


def test_decoding_of_odd_ids():
    model = sp.Pieces.load(sp.default_model())
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    for ids in ([], [3], [1, 2], [model.bytes[0xE4], model.bytes[0xBD]], [29900]):
        assert sp.decode_ids(np.array(ids, np.int32), model).rstrip("�") == lib.decode(ids).rstrip("�")


def test_the_query_decodes_every_document(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + r.doc_id, r.text) for r in read_table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = {r.doc_id: (r.ids, r.decoded_md5, r.equals_text) for r in sp.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        ids = lib.encode(t or "")
        back = lib.decode(ids)
        assert got[i] == (ids, md5(back.encode()).hexdigest(), back == (t or ""))
    assert len(got) == len(rows) and not all(same for _, _, same in got.values())


def test_the_driver_holds_the_table_in_parts(spark, monkeypatch):
    """Held as one, the table took more than 1500 MB of the driver's memory on 0.51 GB."""
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    rnd, sent, broadcast = random.Random(6), [], spark.sparkContext.broadcast
    words = sorted({"".join(rnd.choice("aeinorst") for _ in range(rnd.randrange(2, 9))) for _ in range(1500)})
    monkeypatch.setattr(sp, "PART_BYTES", 5000)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: (sent.append(value), broadcast(value))[1])
    got = sp.encode(spark.createDataFrame([(i, " ".join(words[i::50])) for i in range(50)], "doc_id long, text string"), back=True).collect()
    assert {r.doc_id: r.ids for r in got} == {i: lib.encode(" ".join(words[i::50])) for i in range(50)} and all(r.equals_text for r in got)
    held = [len(v.hashes) * sp.ROW_BYTES + len(v.ids) for v in sent if isinstance(v, sp.Part)]
    assert len(held) > 5 and max(held) < 6500 and sum(map(len, (v.hashes for v in sent if isinstance(v, sp.Part)))) >= len(words)
