"""N-gram Jaccard join: which documents share most of their five-word shingles.

1. A text's shingle set and its MinHash values (16 bits each) are computed where the text lies; texts with equal sets
   become one class with a count, so copies never meet each other.
2. Classes that agree on a band of 4 MinHash values meet (32 bands: a pair at the threshold is missed once in 10^7). They
   compare further values 16 at a time; a pair leaves once the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below ``TOLERANCE``. What stays gives candidate clusters.
3. Within a cluster the sets themselves are compared, all pairs, exactly. Only the number of links of each class and a
   spanning forest leave a task, never a row for each pair.

Large bands and clusters are cut into blocks of about ``BLOCK`` classes, and each pair of blocks is a task's group of its
own, so no group grows with the data.

Words are runs of letters, digits and underscores, lower-cased; a text of one to four words has its words as its single
shingle. Texts without a word (null, empty) are alike to nothing: a class of their own, no links. Null ids are kept; a
class is named by its least id. Repeated rows count as copies. Other columns are ignored by ``links`` and kept by
``first_of_each``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbforge.functions.storage import materialize
from kbforge.llm.token_words import slices, texts_of, thrifty
from kbforge.operators.components import connected_components, join_counted

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BAND, STEP = 128, 4, 16
TOLERANCE = 1e-6
BLOCK = 256
#: Shingles of a block, about.
BLOCK_SHINGLES = 500_000
#: Rows of a list of 64-bit keys that may be broadcast: 2 million take some 50 MB.
BROADCAST_KEYS = 2_000_000
_WORD = re.compile(r"\w+")
_ODD = np.random.default_rng(20240).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's shingles."""
    for part in slices(texts):
        words = [_WORD.findall(t.lower()) for t in part]
        sizes = [len(w) for w in words]
        codes, known = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
        hashes = _mix(pd.util.hash_array(known, categorize=False))[codes] if len(known) else np.zeros(0, np.uint64)
        ends = np.cumsum(sizes).tolist()
        whole = hashes
        if len(hashes) >= SHINGLE:
            whole = hashes[: -(SHINGLE - 1)]
            for k in range(1, SHINGLE):
                whole = _mix(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - SHINGLE + 1 + k])
        for n, end in zip(sizes, ends):
            if n >= SHINGLE:
                yield np.unique(whole[end - n : end - SHINGLE + 1])
            elif n:
                own = np.full(1, n, np.uint64)
                for h in hashes[end - n : end]:
                    own = _mix(own * np.uint64(0x9E3779B97F4A7C15) + h)
                yield own
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> bytes:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[None, k : k + 2048] * _ODD[:, None]).min(axis=1))
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _described(docs: DataFrame) -> DataFrame:
    """``doc_id, row, fp, n, sig``: a hash of id and text, the set's fingerprint (null without words), size, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, sigs = [], [], []
            for s in shingle_sets(texts_of(batch.column(2))):
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "row", "fp", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _row().alias("row"), "text").mapInArrow(thrifty(run), f"doc_id {kind}, row struct<a:bigint,b:bigint>, fp binary, n long, sig binary")


def _row() -> Column:
    """128 bits of hashes that stand for id and text."""
    return F.struct(F.xxhash64("text", "doc_id").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... compared values the fewest matches that keep a pair.

    Given m matches of n, the similarity is Beta(m + 1, n - m + 1), and it reaches t with the probability that of n + 1
    draws with chance t at most m succeed.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _spanning(near: np.ndarray, names: list[bytes]) -> list[int]:
    """For each row of a symmetric matrix the row of the least name in its component, -1 for that row itself.

    Blocks that share classes then mostly give the same edges, which are kept once.
    """
    lead = [-2] * len(near)
    for root in sorted(range(len(near)), key=names.__getitem__):
        if lead[root] != -2:
            continue
        lead[root] = -1
        queue = [root]
        while queue:
            for k in np.flatnonzero(near[queue.pop()]).tolist():
                if lead[k] == -2:
                    lead[k] = root
                    queue.append(k)
    return lead


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal leading ``keys`` columns, from batches sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _probably_near(rows: list[tuple], least: list[int]) -> np.ndarray:
    sig = np.frombuffer(b"".join(r[5] for r in rows), "<u2").reshape(len(rows), HASHES)
    block = np.array([r[3] for r in rows])
    a, b = np.triu_indices(len(rows), 1)
    if rows[0][1] != rows[0][2]:
        cross = block[a] != block[b]
        a, b = a[cross], b[cross]
    matches = np.zeros(len(a), np.int64)
    for k, enough in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (sig[a, part] == sig[b, part]).sum(axis=1)
        stay = matches >= enough
        a, b, matches = a[stay], b[stay], matches[stay]
    near = np.zeros((len(rows), len(rows)), bool)
    near[a, b] = near[b, a] = True
    return near


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Shingles of few sets are counted pair by pair, those of many by matrix products."""
    n = len(sets)
    if n == 2:
        return np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n), [len(s) for s in sets])[order]
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(first, len(flat)))
    out = np.zeros(n * n, np.int64)
    for k in range(2, 9):
        own = owner[first[count == k, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                out += np.bincount(own[:, i] * n + own[:, j], minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    many = np.flatnonzero(count > 8)
    for k in range(0, len(many), 4096):
        some = many[k : k + 4096]
        table = np.zeros((n, len(some)), np.float32)
        at = np.repeat(first[some] - np.concatenate([[0], np.cumsum(count[some])[:-1]]), count[some]) + np.arange(count[some].sum())
        table[owner[at], np.repeat(np.arange(len(some)), count[some])] = 1
        out += (table @ table.T).astype(np.int64)
    return out


def _surely_near(rows: list[tuple], threshold: float) -> np.ndarray:
    sets = [np.frombuffer(r[6], "<u8") for r in rows]
    sizes = np.array([len(s) for s in sets])
    both = _overlaps(sets)
    near = both * (1 + threshold) >= threshold * (sizes[:, None] + sizes) - 1e-9
    np.fill_diagonal(near, False)
    if rows[0][1] != rows[0][2]:
        block = np.array([r[3] for r in rows])
        near &= block[:, None] != block
    return near


def _blocked(members: DataFrame, key: str, blocks: str, columns: list[str]) -> DataFrame:
    """``key, bi, bj, own`` and ``columns``: each member once for each pair of blocks that its own block is in."""
    own = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col(blocks)).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    pairs = other.select(key, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", *columns)
    return pairs.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def _pick(docs: DataFrame, keys: DataFrame, how: str, key: str = "row") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is, or is not, a ``row`` of the written table ``keys``; broadcast only below a counted size."""
    own = keys.withColumnRenamed("row", key)
    return docs.join(F.broadcast(own) if keys.count() <= BROADCAST_KEYS else own, key, how)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, row, fp, component, class_id, n_links`` of each document; ``component`` tells classes apart whatever their ids are."""
    rows = materialize(_described(docs), "described")
    worded = rows.filter("fp IS NOT NULL")
    reps = materialize(worded.groupBy("fp").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    width = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * width + 1, F.lit(width))))
    meet = reps.select("fp", F.explode(bands).alias("band")).withColumn("met", F.count("*").over(Window.partitionBy("band"))).filter("met > 1")
    members = meet.join(reps.select("fp", "sig"), "fp").withColumn("blocks", F.ceil(F.col("met") / BLOCK))
    least = least_matches(threshold)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, 3):
            if len(group) > 1:
                for row, lead in zip(group, _spanning(_probably_near(group, least), [r[4] for r in group])):
                    if lead >= 0:
                        a.append(row[4])
                        b.append(group[lead][4])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    clusters = connected_components(_blocked(members, "band", "blocks", ["fp", "sig"]).mapInArrow(thrifty(candidates), "a binary, b binary"))
    known = materialize(clusters.join(reps.select("fp", "copies", "n", "row"), clusters["node"] == F.col("fp")).select("component", "fp", "copies", "n", "row"), "clusters")
    size = known.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"), F.count("*").alias("n"))
    of_cluster = join_counted(known, size, "component", reps.count())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(texts_of(batch.column(0))):
                found = [s.astype("<u8").tobytes() for s in shingle_sets(part)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in found], pa.binary()), pa.array(found, pa.binary())], names=["fp", "shingles"])

    texts = _pick(docs.select(_row().alias("row"), "text"), known.select("row"), "left_semi").select("text")
    shingled = texts.mapInArrow(thrifty(sets), "fp binary, shingles binary").dropDuplicates(["fp"])
    compared = _blocked(of_cluster.join(shingled, "fp"), "component", "blocks", ["fp", "copies", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            if len(group) < 2:
                continue
            near = _surely_near(group, threshold)
            links = near @ np.array([r[5] for r in group], np.int64)
            lead = [group[k][4] if k >= 0 else None for k in _spanning(near, [r[4] for r in group])]
            yield pa.RecordBatch.from_arrays([pa.array([r[4] for r in group], pa.binary()), pa.array(links, pa.int64()), pa.array(lead, pa.binary())], names=["fp", "links", "lead"])

    verified = materialize(compared.mapInArrow(thrifty(verify), "fp binary, links long, lead binary").filter("links > 0"), "links")
    links = verified.groupBy("fp").agg(F.sum("links").alias("links"))
    joined = connected_components(verified.filter("lead IS NOT NULL").select(F.col("fp").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "fp")
    named = reps.select("fp", "copies", "doc_id").join(joined, "fp", "left").join(links, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Written, as it meets its own groups' names, of frequent and of other groups.
    named = materialize(named, "named")
    name = named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    each = join_counted(named, name, "component", reps.count()).select("fp", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = rows.filter("fp IS NULL").select("doc_id", "row", "fp", F.col("fp").alias("component"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.join(each, "fp").select("doc_id", "row", "fp", "component", "class_id", "n_links").unionByName(alone)


def links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links``: the least id among the documents joined to this one by links, and how many it is linked to."""
    return classes(docs, threshold).select("doc_id", "class_id", "n_links")


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, without those that a smaller row of their class stands for.

    The row that stays has the least id, of equal ids the least hash; of rows that agree in both, one stays. Texts without
    words all stay.
    """
    found = materialize(classes(docs, threshold).filter("fp IS NOT NULL"), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row"))
    best = found.groupBy("component").agg(F.min(rank).alias("best"))
    stay = best.select(F.col("best.row").alias("row"))
    gone = materialize(found.select("row").distinct().join(stay, "row", "left_anti"), "gone")
    twice = materialize(found.groupBy("row").count().filter("count > 1").select("row").join(stay, "row"), "twice")
    key = "row"
    while key in {c.lower() for c in docs.columns}:
        key = f"_{key}"
    kept = _pick(docs.withColumn(key, _row()), gone, "left_anti", key)
    one = _pick(kept, twice, "left_semi", key).dropDuplicates([key])
    return _pick(kept, twice, "left_anti", key).unionByName(one).select(*(f"`{c}`" for c in docs.columns))
