"""Token-ID output: one wavelet matrix per shard, with access, counting and occurrence look-up from one file.

A shard holds whole documents in ascending ``doc_id`` order. Its file is

    magic ``WMX1`` | header length (u32) | header JSON | zstd frames, one for each part

The parts are the document table (ids, token counts) and, for each bit of a token from the highest down, the
bit-plane with its rank directory (set bits before every 512th position). A level's order is the stable
partition of the level above by that level's bit, so that rank on ``width`` planes answers all queries.

Null texts count as empty; empty texts hold just the end id. Ids are cast to long; rows whose id is null or no number come
first. Rows with equal ids lie side by side (ordered by the first 32 characters of the text, then by a hash of it), repeated
rows stay, other columns are ignored, an empty table gives no shard.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kbforge.functions.storage import materialize
from kbforge.llm.token_words import WordEncoder, default_tokenizer, encoder

MAGIC = b"WMX1"
#: A rank directory entry for so many bits.
RANK_STEP = 512
#: A shard is closed at the first document that brings it to so many tokens; a document is never split.
SHARD_TOKENS = 1 << 18
END_ID = 1
#: Characters by which texts of equal ids are ordered; a hash orders those that begin alike.
HEAD = 32
NULL_ID = -(1 << 63)


def _filtered(values: np.ndarray, packed: np.ndarray) -> np.ndarray:
    column = pa.Array.from_buffers(pa.from_numpy_dtype(values.dtype), len(values), [None, pa.py_buffer(values)])
    mask = pa.Array.from_buffers(pa.bool_(), len(values), [None, pa.py_buffer(packed)])
    return column.filter(mask).to_numpy()


def pack(tokens: np.ndarray, doc_ids: list[int], counts: list[int], width: int) -> bytes:
    """The file of a shard. ``tokens`` is the run of all its documents' ids, ``width`` the bits of a token."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(np.asarray(doc_ids, "<i8").tobytes()), squeeze(np.asarray(counts, "<i8").tobytes())]
    zeros, level = [], np.ascontiguousarray(tokens)
    for bit in range(width - 1, -1, -1):
        bits = ((level >> level.dtype.type(bit)) & level.dtype.type(1)).astype(np.uint8)
        packed = np.packbits(bits, bitorder="little")
        steps = np.add.reduceat(bits, np.arange(0, len(bits), RANK_STEP), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(steps)]).astype("<u4")
        low = _filtered(level, ~packed)
        zeros.append(len(low))
        level = np.concatenate([low, _filtered(level, packed)])
        parts += [squeeze(packed.tobytes()), squeeze(directory.tobytes())]
    header = json.dumps({"n": len(tokens), "width": width, "dtype": tokens.dtype.str, "zeros": zeros, "parts": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(parts)


class WaveletMatrix:
    """A shard read back. Planes are opened when a query first needs them."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", blob[4:8])
        self.header = json.loads(blob[8 : 8 + size])
        ends = np.cumsum([8 + size, *self.header["parts"]]).tolist()
        self._frames = [blob[a:b] for a, b in zip(ends, ends[1:])]
        self.n, self.width, self.zeros = (self.header[k] for k in ("n", "width", "zeros"))
        self._open: dict[int, bytes] = {}

    def _part(self, k: int) -> bytes:
        import zstandard

        if k not in self._open:
            self._open[k] = zstandard.ZstdDecompressor().decompress(self._frames[k])
        return self._open[k]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self._part(0), "<i8"), np.frombuffer(self._part(1), "<i8")

    def _plane(self, level: int) -> np.ndarray:
        return np.frombuffer(self._part(2 + 2 * level), np.uint8)

    def _rank1(self, level: int, i: int) -> int:
        """Set bits before position ``i``."""
        block = i // RANK_STEP
        base = int(np.frombuffer(self._part(3 + 2 * level), "<u4")[block])
        head = np.unpackbits(self._plane(level)[block * RANK_STEP // 8 : (i + 7) // 8], bitorder="little")
        return base + int(head[: i - block * RANK_STEP].sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) such bit, by bisection on the directory, then in one block."""
        directory = np.frombuffer(self._part(3 + 2 * level), "<u4").astype(np.int64)
        if not bit:
            directory = np.minimum(np.arange(len(directory), dtype=np.int64) * RANK_STEP, self.n) - directory
        block = int(np.searchsorted(directory, k, side="right")) - 1
        bits = np.unpackbits(self._plane(level)[block * RANK_STEP // 8 : (block + 1) * RANK_STEP // 8], bitorder="little")
        bits = bits[: min(RANK_STEP, self.n - block * RANK_STEP)]
        return block * RANK_STEP + int(np.flatnonzero(bits == bit)[k - directory[block]])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.width):
            bit = int(self._plane(level)[i >> 3]) >> (i & 7) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if token >> (self.width - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences in positions ``start`` to ``stop``, end exclusive."""
        if token < 0 or token >> self.width:
            return 0
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence, -1 if there is none."""
        if token < 0 or token >> self.width:
            return -1
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes are merged from the lowest bit up."""
        kind = np.dtype(self.header["dtype"])
        values = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            bits = np.unpackbits(self._plane(level), count=self.n, bitorder="little")
            ones = np.cumsum(bits, dtype=np.int64 if self.n >> 31 else np.int32)
            kind_of = ones.dtype.type
            child = np.where(bits, ones + kind_of(self.zeros[level] - 1), np.arange(self.n, dtype=ones.dtype) - ones)
            values = values[child] | bits.astype(kind) << kind.type(self.width - 1 - level)
        return values


def ended(enc: WordEncoder, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text, with the end id."""
    for ids, starts in enc.encode(texts):
        ids = np.insert(ids, starts[1:], end_id)
        starts = (starts + np.arange(len(starts))).tolist()
        yield from (ids[a:b] for a, b in zip(starts, starts[1:]))


def ordered(docs: DataFrame) -> DataFrame:
    """``doc_id`` (null as the lowest value) and text, dealt out by ranges of ascending ``doc_id``.

    Equal ids (or nulls) may be many, so their texts' beginnings and hashes count too, and the number of the row for copies.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.substring("text", 1, HEAD), F.xxhash64("text")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, "_row")
    return dealt.sortWithinPartitions(*order, "text").drop("_row").withColumn("part", F.spark_partition_id())


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode and write: one row for each shard, ``part, seq, n_tokens, file``, kept in the shared folder."""
    path = tokenizer or default_tokenizer()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = max(1, (max(enc.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
        ids: list[int] = []
        runs: list[np.ndarray] = []
        held, seq, part = 0, 0, 0

        def shard() -> pa.RecordBatch:
            tokens = np.concatenate(runs)
            blob = pack(tokens, ids, list(map(len, runs)), width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "n_tokens", "file"])

        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            for doc_id, run in zip(batch.column(0).to_pylist(), ended(enc, batch.column(1), end_id)):
                ids.append(doc_id)
                runs.append(run)
                held += len(run)
                if held >= shard_tokens:
                    yield shard()
                    ids, runs, held, seq = [], [], 0, seq + 1
        if runs:
            yield shard()

    return materialize(ordered(docs).mapInArrow(build, "part int, seq long, n_tokens long, file binary"), "wavelet")


def read_shards(shards: DataFrame) -> DataFrame:
    """``part, seq, at, doc_id, n_tokens, ids_crc32`` of each document, from the files alone; ``at`` counts in its shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                wm = WaveletMatrix(blob)
                ids, counts = wm.documents()
                stops = np.cumsum(counts)
                raw = wm.tokens().astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stops - counts).tolist(), stops.tolist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int64()), pa.array(stops - counts), pa.array(ids), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["part", "seq", "at", "doc_id", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "seq", "file").mapInArrow(read, "part int, seq long, at long, doc_id long, n_tokens long, ids_crc32 long")


def starts(shards: DataFrame) -> DataFrame:
    """Tokens before each shard. A prefix scan in two steps: over the parts' sums (as many rows as write tasks), then within a part."""
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("part").orderBy("seq")
    inner = shards.select("part", "seq", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("inner"))
    return inner.join(before, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents as shards, read them back, and describe each: ``doc_id, start, n_tokens, ids_crc32``."""
    shards = write_shards(docs, tokenizer)
    found = read_shards(shards).join(starts(shards), ["part", "seq"])
    return found.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
