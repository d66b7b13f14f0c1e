"""Token counts from flat token files that have no index: a scan for the end-of-document identifier.

A file is a run of little-endian ids, cut into blocks of ``BLOCK_TOKENS`` wherever they fall. Each block is searched by itself
and gives the lengths between its separators, what lies before its first and after its last. A prefix scan over the blocks'
sums (separators and tokens before a block, end of the last document before it) stitches the documents that cross blocks
and numbers them. Ids after the last separator are a document that is not terminated.

``documents_of`` works on any such files; ``token_counts`` first writes the documents as such files, a file a task, with
a separate list of ids that the counts do not come from. Null texts count as empty, empty texts have 0 tokens, null ids
and repeated rows stay, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kbforge.functions.storage import materialize
from kbforge.llm.token_words import default_tokenizer, encoder
from kbforge.llm.wavelet import NULL_ID, ended

BLOCK_TOKENS = 1 << 17
#: Fixed value: <|endoftext|> of the default tokenizer, which no text encodes to.
SEPARATOR = 49407


def write_flat(docs: DataFrame, tokenizer: str | None = None, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, block, tokens`` of each block, and ``ended``, the ids of the documents that end in it, in order."""
    path = tokenizer or default_tokenizer()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, plain_specials=True)
        size = block_tokens * enc.dtype.itemsize
        held, block, part = bytearray(), 0, 0
        closed: list[tuple[int, int]] = []
        written = 0

        def row(data: bytes, ids: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ended"])

        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            for doc_id, run in zip(batch.column(0).to_pylist(), ended(enc, batch.column(1), separator)):
                held += run.tobytes()
                closed.append((doc_id, written + len(held)))
                while len(held) >= size:
                    written += size
                    last = next((k for k, (_, at) in enumerate(closed) if at > written), len(closed))
                    yield row(bytes(held[:size]), [i for i, _ in closed[:last]])
                    closed, block = closed[last:], block + 1
                    del held[:size]
        if held:
            yield row(bytes(held), [i for i, _ in closed])

    # No order is asked for, so the texts are not moved: each task writes a file of what it reads.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    return materialize(rows.mapInArrow(build, "file int, block long, tokens binary, ended array<long>"), "flat-tokens")


def read_flat(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat files (each below 2 GB) in a folder that Spark can read: ``file, block, tokens``."""
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length").filter("length > 0")
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))
    return files.withColumn("block", F.explode(cut)).select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("tokens"))


def documents_of(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """``file, ordinal, start, n_tokens, terminated`` of each document; ``start`` counts in the file, separators included."""
    kind = blocks.schema["file"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = np.frombuffer(batch.column(2)[i].as_py(), f"<u{width}")
                at = np.flatnonzero(ids == separator)
                n = len(at)
                lengths = np.diff(at, prepend=-1) - 1
                # The last row is the block's own: what lies after its last separator.
                lengths = np.append(lengths, len(ids) - (at[-1] + 1 if n else 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * (n + 1))), batch.column(1).take(pa.array([i] * (n + 1))), pa.array(np.arange(n + 1)), pa.array(lengths.astype(np.int64)), pa.array(np.append(at, len(ids)).astype(np.int64)), pa.array([False] * n + [True])],
                    names=["file", "block", "k", "length", "stop", "rest"],
                )

    found = materialize(blocks.select("file", "block", "tokens").mapInArrow(scan, f"file {kind}, block long, k long, length long, stop long, rest boolean"), "separators")
    by = Window.partitionBy("file").orderBy("block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.filter("rest").select("file", "block", F.col("k").alias("seps"), F.col("stop").alias("tokens"), F.col("length").alias("tail"))
    placed = sums.select("*", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    ends = placed.withColumn("end", F.when(F.col("seps") > 0, F.col("base") + F.col("tokens") - F.col("tail")))
    stitched = ends.select(
        "file", "block", "docs", "base", F.coalesce(F.max("end").over(before), F.lit(0)).alias("open"), F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))).alias("from_end")
    )
    each = found.join(stitched, ["file", "block"])
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.col("stop") - F.col("length"))
    rows = each.select("file", (F.col("docs") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("stop") - start).alias("n_tokens"), (~F.col("rest")).alias("terminated"), "from_end")
    return rows.filter("terminated OR (from_end = 1 AND n_tokens > 0)").drop("from_end")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of each document, without the separator."""
    flat = write_flat(docs, tokenizer)
    width = encoder(tokenizer or default_tokenizer(), plain_specials=True).dtype.itemsize
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = flat.select("file", "ended", F.coalesce(F.sum(F.size("ended")).over(before), F.lit(0)).alias("base"))
    ids = named.select("file", "base", F.posexplode("ended").alias("k", "doc_id")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "doc_id")
    return documents_of(flat, SEPARATOR, width).join(ids, ["file", "ordinal"]).select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_tokens")
