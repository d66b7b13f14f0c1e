"""SentencePiece encoding by a relational lattice, and decoding.

1. Texts become segments: ``▁`` counts as a blank (one more stands in front), and a text is cut before each run of blanks and
   wherever the two characters at a place stand side by side in no piece, since no piece can cross there. Every task hands on
   the distinct segments it met, so the table of segments is far smaller than the texts.
2. Each segment's substrings of at most the longest piece's length are exploded and equi-joined to the piece table; the
   edges are grouped by segment and folded with a higher-order aggregate. For a unigram model the fold is Viterbi: the best
   sum of scores that ends at each place. The pieces of a BPE model do not maximise any sum, so Viterbi would not give its
   encoding. For such a model the fold goes over the same edges in the order of their scores, from the left among equals, and
   keeps a mark for each place where two symbols meet: an edge joins its span where both its ends are marked and one place
   within. That is the model's own encoding, because a piece always comes after its two parts in that order. A few pieces
   (runs of blanks) do not; segments that hold one of them are merged step by step in a task, and so are segments above
   ``LONG`` characters, as a fold's work on one grows by the square: the same ids in a time that grows with the length and
   its logarithm, in some 100 bytes a character.
   Characters that no piece covers become their UTF-8 bytes' pieces, or unknown.
3. The segments' ids, sorted by a 64-bit hash of the segment, go to the tasks, which look up their texts' segments; the
   hash's key is changed until no segment of the texts has the hash of another in the table. Only segments above a frequency,
   at most ``TABLE_SEGMENTS`` and ``TABLE_BYTES``, are broadcast, in parts by ranges of the hash, of which the driver holds one
   at a time; others are joined to the texts that hold them, frequent texts in several parts.

Normalisation must be the identity, as in the model used here; other models are refused. Null and empty texts have no ids. Null ids and repeated rows stay, other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbforge.functions.storage import materialize
from kbforge.llm.token_words import bounds, column_slices, gathered, runs, thrifty
from kbforge.operators.components import join_spread

SPACE = "▁"
#: Segments, and bytes of a table of segments, that may be broadcast.
TABLE_SEGMENTS, TABLE_BYTES = 4_000_000, 160_000_000
#: Bytes of that table that the driver holds at a time, about.
PART_BYTES = 8 << 20
#: Bytes of a segment in that table, besides those of its ids.
ROW_BYTES = 24
#: Characters of a segment that is folded; longer ones are encoded step by step.
LONG = 256
#: Segments of a task of the lattice, about.
PART_SEGMENTS = 16_000
#: Rows of segments that a task gathers before it hands them on.
HELD = 1_000_000
#: Marks of a segment's places that one number holds; longer segments keep them as bytes.
MARKS = 62
#: Bits of an edge's number. Segments beyond ``START_BITS`` are encoded in a task, step by step.
START_BITS, LENGTH_BITS, ID_BITS = 24, 5, 17
#: Places of a segment that are exploded from one window.
WINDOW = 48
UNIGRAM, BPE = 1, 2


@dataclass
class Pieces:
    """What is needed of a model file."""

    kind: int
    pieces: list[str]
    scores: list[float]
    types: list[int]
    ids: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Pieces":
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only unigram and BPE models with identity normalisation and a dummy prefix are read")
        return cls.of(model.trainer_spec.model_type, [(p.piece, p.score, p.type) for p in model.pieces])

    @classmethod
    def of(cls, kind: int, rows: list[tuple[str, float, int]]) -> "Pieces":
        out = cls(kind, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        out.ids = {p: i for i, (p, t) in enumerate(zip(out.pieces, out.types)) if t == 1}
        out.unknown = next((i for i, t in enumerate(out.types) if t == 2), 0)
        own = {p: i for i, (p, t) in enumerate(zip(out.pieces, out.types)) if t == 6}
        out.bytes = [own.get(f"<0x{b:02X}>", -1) for b in range(256)]
        out.longest = max(map(len, out.ids), default=1)
        out.pairs = {p[i : i + 2] for p in out.ids for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in out.ids):
            raise ValueError("pieces that cross white space are not read")
        scores = np.array(out.scores)[list(out.ids.values())] if out.ids else np.zeros(0)
        out.ranks = dict(zip(out.ids, np.unique(-scores, return_inverse=True)[1].tolist()))
        if kind == BPE and (out.longest >= 1 << LENGTH_BITS or len(out.pieces) >= 1 << ID_BITS):
            raise ValueError("only BPE models of pieces up to 31 characters and ids up to 131071 are read")
        out.irregular = [p for p in out.ids if len(p) > 1 and not out.in_order(p)] if kind == BPE else []
        letters = sorted({c for pair in out.pairs for c in pair})
        #: The number of each character below 2^16 that stands in a pair; all others share the last one, which stands in none.
        out.letters = np.full((1 << 16) + 1, len(letters), np.int32)
        out.letters[[min(ord(c), 1 << 16) for c in letters]] = np.arange(len(letters))
        out.joint = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        at = {c: k for k, c in enumerate(letters)}
        for a, b in out.pairs:
            out.joint[at[a], at[b]] = True
        if any(ord(c) >> 16 for c in letters):
            raise ValueError("pieces of several characters beyond the first plane are not read")
        return out

    def in_order(self, piece: str) -> bool:
        """Whether the two parts that the piece is merged from come before it."""
        symbols = list(piece)
        while len(symbols) > 1:
            ways = [(-self.scores[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.ids]
            if not ways:
                return True
            k = min(ways)[1]
            parts, symbols[k : k + 2] = symbols[k : k + 2], [symbols[k] + symbols[k + 1]]
        return all(len(x) == 1 or self.scores[self.ids[x]] > self.scores[self.ids[piece]] for x in parts)

    def table(self, spark: SparkSession) -> DataFrame:
        """``piece, id, score, rank`` (from the highest score), with blanks for ``▁``: as many rows as the model has pieces."""
        ids = np.array(list(self.ids.values()), np.int32)
        frame = pa.table({"piece": pa.array([p.replace(SPACE, " ") for p in self.ids], pa.string()), "id": ids, "score": np.array(self.scores)[ids], "rank": np.array(list(self.ranks.values()), np.int64)})
        # An Arrow table goes to the JVM as it is; for other rows each executor would start Python workers of another kind.
        return spark.createDataFrame(frame)

    def spelt(self, char: str) -> list[int]:
        if self.bytes[0] < 0:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (runs of blanks with what follows) of texts without nulls, and where each text's begin (one more for the end)."""
    texts = pc.replace_substring(texts, SPACE, " ")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
    starts, data = spans(texts)
    blank = data == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[starts[:-1][starts[1:] > starts[:-1]]] = True
    at = np.flatnonzero(first)
    return strings(np.append(at, len(data)), data), np.searchsorted(at, starts)


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes of each text begin (one more for the end), and the bytes."""
    _, starts, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    starts = np.frombuffer(starts, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return starts - starts[0], np.frombuffer(data or b"", np.uint8)[starts[0] : starts[-1]]


def strings(starts: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])


def cut(words: pa.Array, model: Pieces) -> tuple[pa.Array, np.ndarray]:
    """The segments of words, and where each word's begin (one more for the end)."""
    starts, data = spans(words)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    points = model.letters[np.minimum(np.where(points == 32, ord(SPACE), points), 1 << 16)]
    first = np.flatnonzero((data & 0xC0) != 0x80)
    apart = np.ones(len(points), bool)
    apart[1:] = ~model.joint[points[:-1], points[1:]]
    apart[np.searchsorted(first, starts[:-1])] = True
    at = first[apart]
    return strings(np.append(at, len(data)), data), np.searchsorted(at, starts)


@dataclass
class Parsed:
    """Texts as codes: of each text its words, of each word its segments."""

    text_at: np.ndarray
    words: pa.Array
    word_at: np.ndarray
    parts: pa.Array
    segments: pa.Array

    @classmethod
    def of(cls, texts: pa.Array, model: Pieces) -> "Parsed":
        words, text_at = words_of(texts)
        words = words.dictionary_encode()
        parts, word_at = cut(words.dictionary, model)
        parts = parts.dictionary_encode()
        return cls(text_at, words.indices, word_at, parts.indices, parts.dictionary)

    def counts(self) -> np.ndarray:
        """Occurrences of each segment."""
        uses = np.bincount(self.words.to_numpy(), minlength=len(self.word_at) - 1)
        return np.bincount(self.parts.to_numpy(), np.repeat(uses, np.diff(self.word_at)), len(self.segments)).astype(np.int64)

    def texts_with(self, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each text with a wanted segment, and its wanted segments' numbers."""
        parts = self.parts.to_numpy()
        marked = np.add.reduceat(np.append(wanted[parts], False), self.word_at[:-1], dtype=np.int64) if len(parts) else np.zeros(0)
        words = self.words.to_numpy()
        at = np.flatnonzero(marked[words] > 0)
        text = np.searchsorted(self.text_at, at, side="right") - 1
        for t in np.unique(text).tolist():
            own = np.concatenate([parts[self.word_at[w] : self.word_at[w + 1]] for w in np.unique(words[at[text == t]])])
            yield t, np.unique(own[wanted[own]])


def segments(docs: DataFrame, model: Pieces) -> DataFrame:
    """``segment, n``: every distinct segment with its number of occurrences; ``▁`` is a blank in it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> list[pa.RecordBatch]:
            found = pa.Table.from_batches(held).group_by("segment", use_threads=False).aggregate([("n", "sum")])
            return found.select(["segment", "n_sum"]).rename_columns(["segment", "n"]).combine_chunks().to_batches()

        for batch in batches:
            for part in column_slices(batch.column(0)):
                parsed = Parsed.of(part, shared.value)
                held.append(pa.RecordBatch.from_arrays([parsed.segments, pa.array(parsed.counts())], names=["segment", "n"]))
                if sum(map(len, held)) >= HELD:
                    yield from rows()
                    held = []
        if held:
            yield from rows()

    return docs.select("text").mapInArrow(thrifty(run), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


#: An edge is one number, which sorts as the model merges: rank, start, length and id. These read it.
_START = f"cast(shiftright(e, {LENGTH_BITS + ID_BITS}) & {(1 << START_BITS) - 1} as int)"
_LENGTH, _ID = f"cast(shiftright(e, {ID_BITS}) & {(1 << LENGTH_BITS) - 1} as int)", f"cast(e & {(1 << ID_BITS) - 1} as int)"
#: The marks from an edge's start to its end, the marks of just these two, and one mark more than two.
_SEEN = f"(shiftright(m, {_START}) & (shiftleft(2L, {_LENGTH}) - 1))"
_OUTER = f"(1L + shiftleft(1L, {_LENGTH}))"
_SEEN_BYTES = f"cast(substring(m, {_START} + 1, {_LENGTH} + 1) as string)"
_OUTER_BYTES = f"concat('1', repeat('0', {_LENGTH} - 1), '1')"


def _merged() -> Column:
    """The edges that a BPE model keeps, of the sorted ``edges`` of ``segment``."""
    join = f"CASE WHEN bit_count({_SEEN}) = 3 AND {_SEEN} & {_OUTER} = {_OUTER} THEN m - shiftleft({_SEEN} - {_OUTER}, {_START}) ELSE m END"
    marks = f"aggregate(edges, shiftleft(1L, length(segment) + 1) - 1, (m, e) -> {join})"
    join = f"CASE WHEN {_SEEN_BYTES} RLIKE '^10*10*1$' THEN overlay(m PLACING cast({_OUTER_BYTES} AS binary) FROM {_START} + 1) ELSE m END"
    long = f"aggregate(edges, cast(repeat('1', length(segment) + 1) AS binary), (m, e) -> {join})"
    keep = f"flatten(transform(array({marks}), m -> filter(edges, e -> {_SEEN} = {_OUTER})))"
    keep_long = f"flatten(transform(array({long}), m -> filter(edges, e -> {_SEEN_BYTES} = {_OUTER_BYTES})))"
    return F.expr(f"CASE WHEN length(segment) <= {MARKS - 1} THEN {keep} ELSE {keep_long} END")


def _ids(model: Pieces) -> Column:
    """The ids of the edges ``kept``, from left to right; characters without an edge are spelt."""
    whole = f"transform(array_sort(transform(kept, e -> shiftleft(cast({_START} AS bigint), {ID_BITS}) + {_ID})), x -> cast(x & {(1 << ID_BITS) - 1} AS int))"
    spelt = f"array({model.unknown})"
    if model.bytes[0] >= 0:
        own = f"array({', '.join(map(str, model.bytes))})"
        spelt = f"transform(sequence(1, length(hex(encode(c, 'UTF-8'))), 2), k -> element_at({own}, cast(conv(substring(hex(encode(c, 'UTF-8')), k, 2), 16, 10) AS int) + 1))"
    at = f"filter(kept, e -> {_START} = i)"
    inside = f"exists(kept, e -> {_START} < i AND i < {_START} + {_LENGTH})"
    one = f"CASE WHEN size({at}) > 0 THEN transform({at}, e -> {_ID}) WHEN {inside} THEN array() ELSE flatten(transform(array(substring(segment, i + 1, 1)), c -> {spelt})) END"
    slow = f"flatten(transform(sequence(0, length(segment) - 1), i -> {one}))"
    return F.expr(f"CASE WHEN aggregate(kept, 0, (n, e) -> n + {_LENGTH}) = length(segment) THEN {whole} ELSE {slow} END")


def _viterbi(edges: Column, chars: Column, longest: int, unknown_score: float) -> Column:
    """The pieces of a segment: for each end the best way from the start; the way is kept with its score."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("s")))

    def step(state: Column, char: Column) -> Column:
        i = F.size(state)
        text = F.array_join(F.slice(chars, F.greatest(i - longest + 1, F.lit(1)), F.least(i, F.lit(longest))), "")

        def way(n: Column) -> Column:
            piece = F.substring(text, F.length(text) - n + 1, n)
            edge, before = F.element_at(edges, piece), F.element_at(state, i - n + 1)
            score = F.coalesce(edge["score"], F.when(n == 1, F.lit(unknown_score)))
            return F.when(score.isNotNull() & before.isNotNull(), F.struct((before["score"] + score).alias("score"), n.alias("n"), F.concat(before["s"], F.array(piece)).alias("s")))

        ways = F.transform(F.sequence(F.lit(1), F.length(text)), way)
        top = F.array_max(ways)
        return F.concat(state, F.array(F.struct(top["score"].alias("score"), top["s"].alias("s"))))

    return F.aggregate(chars, first, step, lambda state: F.element_at(state, -1)["s"])


def lattice(found: DataFrame, model: Pieces, parts: int | None = None) -> DataFrame:
    """``segment, ids`` of each distinct segment; those of a BPE model hold none of its irregular pieces.

    The segments are dealt out once; exploding and the join keep them where they are, so their edges are grouped in place.
    """
    spark = found.sparkSession
    found = found.select("segment").repartition("segment") if parts is None else found.select("segment").repartition(parts, "segment")
    # Places and lengths are exploded by turns, which stays in generated code; windows keep the substrings of long segments cheap.
    windows = found.select("segment", F.explode(F.sequence(F.lit(0), F.length("segment") - 1, F.lit(WINDOW))).alias("base"))
    windows = windows.select("segment", "base", F.substring("segment", F.col("base") + 1, F.lit(WINDOW + model.longest - 1)).alias("text"))
    places = windows.select("segment", "base", "text", F.explode(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(WINDOW)))).alias("i"))
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.length("text") - F.col("i") + 1, F.lit(model.longest))))
    subs = places.select("segment", (F.col("base") + F.col("i") - 1).alias("start"), "text", "i", lengths.alias("n"))
    subs = subs.select("segment", "start", "n", F.substring("text", F.col("i"), F.col("n")).alias("piece"))
    # The piece table has as many rows as the model, whatever the corpus. Characters without a piece keep their segment.
    known = subs.join(F.broadcast(model.table(spark)), "piece", "left").filter("id IS NOT NULL OR n = 1")
    if model.kind == BPE:
        edge = (F.col("rank") * (1 << START_BITS) + F.col("start")) * (1 << LENGTH_BITS + ID_BITS) + F.col("n") * (1 << ID_BITS) + F.col("id")
        edges = known.groupBy("segment").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
        return edges.select("segment", _merged().alias("kept")).select("segment", _ids(model).alias("ids"))
    entry = F.when(F.col("id").isNotNull(), F.struct("piece", F.struct("score", "id")))
    edges = known.groupBy("segment").agg(F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("edges"))
    chars = F.transform(F.sequence(F.lit(1), F.length("segment")), lambda i: F.substring("segment", i, F.lit(1)))
    least = min((model.scores[i] for i in model.ids.values()), default=0.0)
    fold = _viterbi(F.col("edges"), chars, model.longest, least - 10.0)
    byte_ids = F.array(*map(F.lit, model.bytes))

    def spelt(symbol: Column) -> Column:
        if model.bytes[0] < 0:
            return F.array(F.lit(model.unknown))
        digits = F.hex(F.encode(symbol, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda k: F.element_at(byte_ids, F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int") + 1))

    ids = F.flatten(F.transform(fold, lambda s: F.when(F.element_at(F.col("edges"), s).isNotNull(), F.array(F.element_at(F.col("edges"), s)["id"])).otherwise(spelt(s))))
    return edges.select("segment", ids.alias("ids"))


def encode_long(segment: str, model: Pieces) -> list[int]:
    """One segment, step by step, in time that grows as its length times a logarithm."""
    segment = segment.replace(" ", SPACE)
    cuts = _viterbi_cuts(segment, model) if model.kind == UNIGRAM else _merged_cuts(segment, model)
    out: list[int] = []
    for a, b in zip(cuts, cuts[1:]):
        piece = model.ids.get(segment[a:b])
        out += [piece] if piece is not None else [i for c in segment[a:b] for i in model.spelt(c)]
    return out


def _viterbi_cuts(segment: str, model: Pieces) -> list[int]:
    n, floor = len(segment), min((model.scores[i] for i in model.ids.values()), default=0.0) - 10.0
    best, lead = array("d", [-1e300]) * (n + 1), array("i", [0]) * (n + 1)
    best[0] = 0.0
    for i in range(1, n + 1):
        for k in range(1, min(i, model.longest) + 1):
            piece = model.ids.get(segment[i - k : i])
            score = model.scores[piece] if piece is not None else floor if k == 1 else None
            if score is not None and best[i - k] + score >= best[i]:
                best[i], lead[i] = best[i - k] + score, k
    cuts = [n]
    while cuts[-1]:
        cuts.append(cuts[-1] - lead[cuts[-1]])
    return cuts[::-1]


def _merged_cuts(segment: str, model: Pieces) -> array:
    """Symbols are merged in the order of the pieces' ranks, from the left among equals; an offer is one number."""
    n, ranks, longest = len(segment), model.ranks, model.longest
    #: Where the symbol at a place ends, and where the one before begins; a symbol that was merged away ends at -1.
    ends, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    offers: list[int] = []

    def offer(a: int) -> None:
        b = ends[a]
        if b < n and ends[b] - a <= longest:
            rank = ranks.get(segment[a : ends[b]])
            if rank is not None:
                heapq.heappush(offers, (rank << START_BITS + 8 | a) << 8 | ends[b] - a)

    for a in range(n - 1):
        offer(a)
    while offers:
        found = heapq.heappop(offers)
        a = found >> 8 & (1 << START_BITS + 8) - 1
        b = ends[a]
        if not 0 <= b < n or ends[b] != a + (found & 255):
            continue
        ends[a], ends[b] = ends[b], -1
        if ends[a] < n:
            before[ends[a]] = a
            offer(a)
        if before[a] >= 0:
            offer(before[a])
    return array("i", [a for a in range(n) if ends[a] >= 0]) + array("i", [n])


def vocabulary(docs: DataFrame, model: Pieces) -> tuple[DataFrame, DataFrame]:
    """``segment, n`` and ``segment, ids`` of every distinct segment of the texts."""
    found = materialize(segments(docs, model), "segments")
    odd = F.col("segment").rlike("|".join(re.escape(p.replace(SPACE, " ")) for p in model.irregular)) if model.irregular else F.lit(False)
    odd |= F.length("segment") > LONG
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in column_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([part, pa.array([encode_long(s, shared.value) for s in part.to_pylist()], pa.list_(pa.int32()))], names=["segment", "ids"])

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // PART_SEGMENTS + 1)
    rows = lattice(found.filter(~odd), model, parts).unionByName(found.filter(odd).select("segment").mapInArrow(thrifty(run), "segment string, ids array<int>"))
    # The groups of a task fit in memory, so they need no sort.
    limit = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(4 * PART_SEGMENTS))
    try:
        return found, materialize(rows, "vocabulary")
    finally:
        spark.conf.set(limit, before)


def _hash(segments_: pa.Array, turn: int) -> np.ndarray:
    return pd.util.hash_array(segments_.to_numpy(zero_copy_only=False).astype(object), hash_key=f"{turn:016d}", categorize=False)


def packed(rows: DataFrame, kind: np.dtype, turn: int, parts: int) -> DataFrame:
    """``part, hashes, sizes, ids``: the table's rows as runs of bytes, dealt into parts by ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                h = _hash(batch.column(0), turn)
                order = np.argsort(h)
                ids = batch.column(1).take(pa.array(order))
                at, sizes, flat = _ends(h[order], parts), ids.value_lengths().to_numpy().astype("<u4"), ids.flatten().to_numpy().astype(kind)
                ids_at = np.append(0, np.cumsum(sizes, dtype=np.int64))[at]
                own = [k for k in range(parts) if at[k] < at[k + 1]]
                columns = [[v[x[k] : x[k + 1]].tobytes() for k in own] for v, x in ((h[order], at), (sizes, at), (flat, ids_at))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "hashes", "sizes", "ids"])

    return rows.select("segment", "ids").mapInArrow(thrifty(run), "part int, hashes binary, sizes binary, ids binary")


def _ends(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted hashes (one more for the end); a part is an equal share of the hash's range."""
    first = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, first), [len(hashes)]]).astype(np.int64)


class Part:
    """One range of hashes, sorted, and where each one's ids stand in one run; some 24 bytes a segment."""

    def __init__(self, rows: list, kind: np.dtype):
        self.ids = b"".join(r["ids"] for r in rows)
        hashes = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint64)
        sizes = np.frombuffer(b"".join(r["sizes"] for r in rows), "<u4")
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.sizes = (sizes[order] * kind.itemsize).astype(np.uint32)
        self.starts = ((np.cumsum(sizes, dtype=np.int64) - sizes)[order] * kind.itemsize).astype(np.int64)

    def clashes(self) -> bool:
        return bool((self.hashes[1:] == self.hashes[:-1]).any())

    def look_up(self, hashes: np.ndarray) -> list[bytes | None]:
        if not len(hashes) or not len(self.hashes):
            return [None] * len(hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        first = np.where(self.hashes[at] == hashes, self.starts[at], -1).tolist()
        return [self.ids[a : a + n] if a >= 0 else None for a, n in zip(first, self.sizes[at].tolist())]


class Table:
    """The frequent segments, in parts that are broadcast one by one: the driver holds one part at a time."""

    def __init__(self, rows: DataFrame, kind: np.dtype, turn: int, parts: int = 1):
        self.kind, self.turn, self.clashes = kind, turn, False
        self.parts: list[Broadcast[Part]] = []
        context = rows.sparkSession.sparkContext
        stored = materialize(packed(rows, kind, turn, parts).repartition(parts, "part"), "table")
        for k in range(parts):
            part = Part(stored.filter(F.col("part") == k).collect(), kind)
            self.clashes |= part.clashes()
            self.parts.append(context.broadcast(part))

    @classmethod
    def of(cls, rows: DataFrame, kind: np.dtype, others: DataFrame | None = None, parts: int = 1) -> "Table":
        """With another key of the hash where two segments have one hash, be both in the table or one among ``others``."""
        turn = 0
        while True:
            table = cls(rows, kind, turn, parts)
            if not table.clashes and (others is None or not table.taken(others)):
                return table
            turn += 1

    def taken(self, others: DataFrame) -> int:
        """How many segments that are not in the table have the hash of one that is."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([sum(got is not None for got in self.look_up(batch.column(0)))], pa.int64())], names=["n"])

        return others.select("segment").mapInArrow(thrifty(run), "n long").agg(F.sum("n")).first()[0] or 0

    def look_up(self, segments_: pa.Array) -> list[bytes | None]:
        h = _hash(segments_, self.turn)
        order = np.argsort(h)
        at = _ends(h[order], len(self.parts))
        out: list[bytes | None] = [None] * len(h)
        for part, a, b in zip(self.parts, at, at[1:]):
            if a < b:
                own = order[a:b]
                for k, got in zip(own.tolist(), part.value.look_up(h[own])):
                    out[k] = got
        return out


def ids_of(texts: pa.Array, model: Pieces, table: Table, more: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts without nulls, and where each text's begin (one more for the end)."""
    parsed = Parsed.of(texts, model)
    known = table.look_up(parsed.segments)
    for k, got in enumerate(known):
        if got is None:
            known[k] = more[parsed.segments[k].as_py()]
    data, starts = gathered(pa.array(known, pa.large_binary()), parsed.parts)
    data, starts = gathered(runs(data, starts[parsed.word_at]), parsed.words)
    starts = starts[parsed.text_at] // table.kind.itemsize
    return np.frombuffer(data, table.kind, int(starts[-1])), starts


def encode(docs: DataFrame, model: Pieces | None = None, table_segments: int = TABLE_SEGMENTS, back: bool = False) -> DataFrame:
    """``doc_id, ids`` of each document; with ``back`` also what the ids decode to: its md5, and whether it equals the text."""
    spark = docs.sparkSession
    model = model or Pieces.load(default_model())
    counts, vocab = vocabulary(docs, model)
    # How many segments there are by the power of two of their frequency, and their bytes in the table: at most 64 rows. A segment has
    # no more ids than bytes.
    width = np.dtype("<u2" if len(model.pieces) <= 1 << 16 else "<u4")
    taken = F.sum(ROW_BYTES + width.itemsize * F.octet_length("segment"))
    levels = {r["level"]: (r["n"], r["bytes"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n"), taken.alias("bytes")).collect()}
    least, room, bytes_ = max(levels, default=0) + 1, table_segments, TABLE_BYTES
    while least > 0 and levels.get(least - 1, (0, 0))[0] <= room and levels.get(least - 1, (0, 0))[1] <= bytes_:
        least -= 1
        room, bytes_ = room - levels.get(least, (0, 0))[0], bytes_ - levels.get(least, (0, 0))[1]
    head = vocab if least == 0 else vocab.join(counts.filter(F.floor(F.log2("n")) >= least).select("segment"), "segment")
    rare = counts.filter(F.floor(F.log2("n")) < least) if least > 0 else None
    held = sum(size for level, (_, size) in levels.items() if level >= least)
    table = Table.of(head, width, rare, held // PART_BYTES + 1)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail_type = "array<struct<segment:string,ids:array<int>>>"
    if least > 0:

        def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in column_slices(batch.column(1)):
                    parsed = Parsed.of(part, shared.value)
                    missing = np.array([got is None for got in table.look_up(parsed.segments)], bool)
                    for text, own in parsed.texts_with(missing):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at + text] * len(own))), parsed.segments.take(pa.array(own))], names=["_t", "segment"])
                    at += len(part)

        # Equal texts ask once; the lists are as long as a text has rare segments.
        keyed = rows.withColumn("_t", F.xxhash64("text"))
        asks = materialize(keyed.select("_t", "text").mapInArrow(thrifty(unknown), "_t long, segment string").distinct(), "asks")
        tails = join_spread(asks, vocab.select("segment", "ids"), "segment").groupBy("_t").agg(F.collect_list(F.struct("segment", "ids")).alias("tail"))
        rows = join_spread(keyed, tails, "_t", "left").select("doc_id", "text", "tail")
    else:
        rows = rows.withColumn("tail", F.lit(None).cast(tail_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(shared.value) if back else None
        for batch in batches:
            at = 0
            for part in column_slices(batch.column(1)):
                tails = batch.column(2).slice(at, len(part)).drop_null().to_pylist()
                more = {s["segment"]: np.array(s["ids"], width).tobytes() for tail in tails for s in tail}
                ids, starts = ids_of(part, shared.value, table, more)
                columns = [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                if dec:
                    texts = list(dec.checked(ids, starts, part))
                    columns += [pa.array([t[0] for t in texts], pa.string()), pa.array([t[1] for t in texts], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(part)

    names = ["doc_id", "ids"] + ["decoded_md5", "equals_text"] * back
    return rows.mapInArrow(thrifty(run), f"doc_id {kind}, ids array<int>" + ", decoded_md5 string, equals_text boolean" * back)


class Decoder:
    """Ids to texts; bytes that are no UTF-8 become the replacement character, unknown pieces a spaced ``⁇``."""

    def __init__(self, model: Pieces):
        pieces = [" ⁇ ".encode() if t == 2 else b"" if t == 3 else p.replace(SPACE, " ").encode() for p, t in zip(model.pieces, model.types)]
        for b, i in enumerate(model.bytes):
            if i >= 0:
                pieces[i] = bytes([b])
        self.pieces = pa.array(pieces, pa.large_binary())

    def raw(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
        data, at = gathered(self.pieces, pa.array(ids))
        data, at = bytes(data), at[starts].tolist()
        return (data[a:b] for a, b in zip(at, at[1:]))

    @staticmethod
    def text(raw: bytes) -> str:
        return raw.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")

    def checked(self, ids: np.ndarray, starts: np.ndarray, texts: pa.Array) -> Iterator[tuple[str, bool]]:
        """The md5 of what each text's ids decode to, and whether that is the text."""
        at, data = spans(texts)
        data, at = data.tobytes(), at.tolist()
        for raw, a, b in zip(self.raw(ids, starts), at, at[1:]):
            same = raw.removeprefix(b" ") == data[a:b]
            yield hashlib.md5(data[a:b] if same else self.text(raw).encode()).hexdigest(), same


def decode_ids(ids: np.ndarray, model: Pieces) -> str:
    return Decoder.text(next(Decoder(model).raw(ids, np.array([0, len(ids)]))))


def decode(encoded: DataFrame, model: Pieces | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null counts as no ids; map-only."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or Pieces.load(default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(shared.value)
        for batch in batches:
            column = pc.fill_null(batch.column(1), pa.scalar([], pa.list_(pa.int32())))
            texts = list(map(dec.text, dec.raw(column.flatten().to_numpy(), bounds(column))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(thrifty(run), f"doc_id {kind}, text string")


def encoded(docs: DataFrame) -> DataFrame:
    """``doc_id, n_pieces, ids, decoded_md5, equals_text``; a text with ``▁`` does not come back, as in the library."""
    return encode(docs, back=True).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_md5", "equals_text")
