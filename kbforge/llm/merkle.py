"""Merkle manifest of a dataset: a tree of SHA-256 digests, proofs, and roots folded anew from a changed leaf.

A tree's nodes stand in an order; every 16 neighbours are the children of one parent, whose digest is the hash of theirs
(as lower-case hex, one after the other), until one node is left. Each group of leaves (a source) has such a tree, and the
groups' roots, ordered by group, are the leaves of one more.

Trees are climbed and descended in blocks: a block is the subtree over 4096 neighbours (three levels), which one task holds.
A group's rows are numbered by ranges of (group, order), so no group, however large, comes into one task; the 4096 neighbours
of a block do. Upwards, each block gives its root, which is a node of the block above. Downwards, each node gets the way above
it: per level the digests to its left and right. There are 4096 times fewer ways than nodes, and each meets its block in
a shuffle.

In a task the parents of a block retain a copy of the hash state before each child's slot. A fold resumes the state of its
slot with the replacement and the right siblings only; nothing on the left is hashed again. A state cannot leave the process
that made it, so a task makes those of its block once and uses them for all folds of the block.

Null values are encoded as ``-``. Null ids come first, equal ids lie side by side in the order of their leaves, repeated rows
stay rows of their own; a null group is the first group. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbforge.functions.storage import materialize

#: Children of a parent, levels of a block, and nodes that a block spans.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A table of parts with no more rows is broadcast.
PARTS_ROWS = 100_000
#: Characters of a digest as text.
HEX = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "tree string, total long, pos long, digest binary"
_WAY = "tree string, pos long, way array<struct<left:binary,right:binary>>, subroot binary, root binary"


class Block:
    """The subtree over at most 4096 nodes, given as hex digests; ``levels`` of it are built from below."""

    def __init__(self, digests: list[bytes], levels: int):
        self.joined: list[list[bytes]] = []
        self.states: list[list[list]] = []
        for _ in range(levels):
            runs = [digests[k : k + FAN] for k in range(0, len(digests), FAN)]
            parents = [_parent(run) for run in runs]
            self.joined.append([b"".join(run) for run in runs])
            self.states.append([states for _, states in parents])
            digests = [digest for digest, _ in parents]
        self.root = digests[0]

    def siblings(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        """On each level the digests to the left and right of node ``k`` and of its ancestors."""
        for joined in self.joined:
            k, slot = divmod(k, FAN)
            yield joined[k][: HEX * slot], joined[k][HEX * (slot + 1) :]

    def folded(self, k: int, digest: bytes) -> bytes:
        """The block's root if node ``k`` were ``digest``."""
        for joined, states in zip(self.joined, self.states):
            k, slot = divmod(k, FAN)
            digest = _resumed(states[k][slot], digest, joined[k][HEX * (slot + 1) :])
        return digest


def _parent(children: list[bytes]) -> tuple[bytes, list]:
    """A parent's digest, and its hash state before each child's slot."""
    state, states = sha256(), []
    for child in children:
        states.append(state.copy())
        state.update(child)
    return state.hexdigest().encode(), states


def _resumed(state, digest: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(digest)
    state.update(right)
    return state.hexdigest().encode()


def levels_of(total: int) -> int:
    """Levels of a block of a tree of so many nodes: three, or as many as lead to one node."""
    levels = 0
    while levels < LEVELS and total > 1:
        total, levels = -(-total // FAN), levels + 1
    return levels


def field(value: Column) -> Column:
    """A value as bytes that end where it says: ``-`` for null, else the number of its UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the unsigned CRC-32 of the id in decimal digits; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, id, digest, other``: the leaf of each row, and where the row is tampered with the leaf that it has then."""
    given = [F.col(c) for c in FIELDS]
    other = [*given[:-1], F.translate(given[-1], _UPPER, _LOWER)]
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), F.unhex(leaf(given)).alias("digest"), F.when(tampered(given[0]), F.unhex(leaf(other))).alias("other"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their number in their tree by ``order``, and ``total``, the number of the tree's rows.

    Rows are dealt out by ranges; a row's number is its place in its range, less where its tree begins there, and the
    numbers of the tree's rows in ranges before. That table has a row for each tree and each border of ranges.
    """
    keys = ["tree", *order]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    dealt = materialize(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "numbered")
    parts = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part")
    parts = parts.select("tree", "_part", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy("tree")).alias("total"))
    parts = materialize(parts, "parts")
    if parts.count() <= PARTS_ROWS:
        parts = F.broadcast(parts)
    return dealt.join(parts, ["tree", "_part"]).withColumn("pos", F.col("_base") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_base")


def _by_block(nodes: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Nodes, each block's in one task in their order, after the way above the block if these are given."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    if ways is not None:
        rows = rows.unionByName(ways.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block; a block may begin in one batch and end in another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        trees, blocks = batch.column("tree").dictionary_encode(), batch.column("block").to_numpy()
        codes = trees.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            key = (batch.column("tree")[a].as_py(), blocks[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _hexed(digests: pa.ChunkedArray) -> list[bytes]:
    return [d.hex().encode() for d in digests.to_pylist()]


def _opened(rows: pa.Table) -> Block:
    return Block(_hexed(rows["digest"]), levels_of(rows["total"][0].as_py()))


def roots(nodes: DataFrame) -> DataFrame:
    """``tree, total, pos, digest`` of each block's root, which are the nodes of the trees one block higher."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            total = -(-rows["total"][0].as_py() // BLOCK)
            yield _batch([(rows["tree"][0].as_py(), total, rows["block"][0].as_py(), bytes.fromhex(_opened(rows).root.decode()))], _NODE)

    return _by_block(nodes.select("tree", "total", "pos", "digest")).mapInArrow(run, _NODE)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their blocks' roots, those of the blocks above, and so on, until each tree has one."""
    stages, most = [nodes], nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        stages.append(materialize(roots(stages[-1]), "roots"))
        most = -(-most // BLOCK)
    return stages


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_STEPS = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ", 1) for f in schema.replace("left:binary,right:binary", "").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values, _KINDS.get(kind, _STEPS)) for values, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


def ways(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The way above each of ``nodes``, given the ways above their blocks' roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            tree, upper, subroot, root = (rows[c][0].as_py() for c in ("tree", "way", "subroot", "root"))
            rows = rows.slice(1)
            block = _opened(rows)
            found = [(tree, pos, [{"left": a, "right": b} for a, b in block.siblings(k)] + upper, subroot, root) for k, pos in enumerate(rows["pos"].to_pylist())]
            for k in range(0, len(found), 256):
                yield _batch(found[k : k + 256], _WAY)

    return _by_block(nodes.select("tree", "total", "pos", "digest"), above).mapInArrow(run, _WAY)


def descend(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """The way above each block of the lowest of ``stages``, from those above the trees' roots."""
    return reduce(lambda upper, nodes: materialize(ways(nodes, upper), "ways"), reversed(stages[1:-1]), above)


_PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def folded(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """For each row of ``nodes`` (``tree, total, pos, digest, id, other``) its proof, and the root folded from ``other``, else ``digest``."""
    kind = nodes.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            upper, subroot, root = (rows[c][0].as_py() for c in ("way", "subroot", "root"))
            # States of the parents above the block, before the slot that leads to it, and what lies right of it.
            higher = [(sha256(step["left"]), step["right"]) for step in upper]
            beside = b"".join(step["left"] + step["right"] for step in upper)
            rows, subroot, root = rows.slice(1), subroot.hex(), root.hex()
            block, out = _opened(rows), []
            for k, (own, other) in enumerate(zip(_hexed(rows["digest"]), rows["other"].to_pylist())):
                digest = block.folded(k, other.hex().encode() if other is not None else own)
                for state, right in higher:
                    digest = _resumed(state, digest, right)
                proof = sha256()
                for left, right in block.siblings(k):
                    proof.update(left)
                    proof.update(right)
                proof.update(beside)
                out.append((own.decode(), subroot, root, proof.hexdigest(), digest.decode(), digest.decode() == root))
            ids = rows["id"].combine_chunks()
            columns = [pa.array(values, pa.bool_() if k == 5 else pa.string()) for k, values in enumerate(zip(*out))]
            yield from pa.Table.from_arrays([ids, *columns], ["doc_id", *(f.split(" ")[0] for f in _PROOF.split(", "))]).to_batches()

    return _by_block(nodes.select("tree", "total", "pos", "digest", "id", "other"), above).mapInArrow(run, f"doc_id {kind.simpleString()}, {_PROOF}")


class Manifest:
    """The trees of a dataset: ``stages`` of the groups' trees, ``top`` of the tree over their roots; all but the leaves are written."""

    def __init__(self, found: DataFrame):
        """``found``: rows of ``tree, id, digest`` and what is to be kept of a leaf."""
        self.stages = climb(numbered(materialize(found, "leaves"), ["id", "digest"]))
        groups = self.stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        self.groups = materialize(numbered(groups, ["name"]), "groups")
        self.top = climb(self.groups)
        self.root = self.top[-1].select("digest")

    def ways(self) -> DataFrame:
        """The way above each block of leaves."""
        start = self.top[-1].select("tree", "pos", F.expr("cast(array() AS array<struct<left:binary,right:binary>>)").alias("way"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
        upper = descend(self.top, start)
        if len(self.top) > 1:
            upper = materialize(ways(self.top[0], upper), "ways")
        named = self.groups.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
        upper = upper.drop("tree", "subroot").join(named, "pos").select("tree", F.lit(0).cast("long").alias("pos"), "way", "subroot", "root")
        return descend(self.stages, upper)

    def folded(self) -> DataFrame:
        return folded(self.stages[0], self.ways())


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row."""
    return Manifest(leaves(docs)).folded()


def sql(levels: int = 6) -> str:
    """The same rows from DuckDB, for groups of up to 16 to the power ``levels`` rows."""

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    step = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {step})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(i::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), {byte}), 4294967295)"
    text = [f"d AS (SELECT row_number() OVER () AS rid, doc_id AS i, {' || '.join(map(field, FIELDS[:-1]))} AS head, text AS t, coalesce('s' || source, '') AS g FROM documents)",
            f"l AS (SELECT rid, i, g, sha256(head || {field('t')}) AS leaf, sha256(head || {field('translate(t, ' + repr(_UPPER) + ', ' + repr(_LOWER) + ')')}) AS low, coalesce({crc} % 5 = 0, false) AS bad FROM d)",
            "a0 AS (SELECT g AS tree, row_number() OVER (PARTITION BY g ORDER BY i NULLS FIRST, leaf) - 1 AS pos, leaf AS h, rid, i, leaf, low, bad FROM l)"]

    def climbed(name: str) -> None:
        for k in range(levels):
            alone = "any_value(n) = 1"
            rows = f"(SELECT tree, count(*) OVER (PARTITION BY tree) AS n, pos, h FROM {name}{k}) GROUP BY tree, pos // {FAN}"
            text.append(f"{name}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, CASE WHEN {alone} THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {rows})")

    climbed("a")
    text.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS name FROM a{levels})")
    climbed("b")
    text.append("f0 AS (SELECT a0.rid, a0.i, a0.leaf, a0.tree, a0.pos AS p, CASE WHEN bad THEN low ELSE leaf END AS x, '' AS proof FROM a0)")

    def fold(n: int, rows: str, nodes: str) -> None:
        beside = [f"coalesce(string_agg(k.h, '' ORDER BY k.pos) FILTER (k.pos {sign} f.p), '') AS {side}" for sign, side in (("<", "le"), (">", "ri"))]
        own = ", ".join(f"any_value(f.{c}) AS {c}" for c in ("i", "leaf", "tree", "p", "x", "proof"))
        sizes = f"(SELECT tree, count(*) AS n FROM {nodes} GROUP BY tree) c"
        runs = f"SELECT f.rid, {own}, any_value(c.n) = 1 AS one, {', '.join(beside)} FROM {rows} f JOIN {nodes} k ON k.tree = f.tree AND k.pos // {FAN} = f.p // {FAN} JOIN {sizes} ON c.tree = f.tree GROUP BY f.rid"
        text.append(f"f{n} AS (SELECT rid, i, leaf, tree, p // {FAN} AS p, CASE WHEN one THEN x ELSE sha256(le || x || ri) END AS x, CASE WHEN one THEN proof ELSE proof || le || ri END AS proof FROM ({runs}))")

    for k in range(levels):
        fold(k + 1, f"f{k}", f"a{k}")
    text.append(f"f{levels + 1} AS (SELECT rid, i, leaf, '' AS tree, b0.pos AS p, x, proof FROM f{levels} f JOIN b0 ON b0.name = f.tree)")
    for k in range(levels):
        fold(levels + 2 + k, f"f{levels + 1 + k}", f"b{k}")
    return "WITH " + ",\n".join(text) + f"\nSELECT f.i AS doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = r.h AS verified FROM f{2 * levels + 1} f JOIN a0 ON a0.rid = f.rid JOIN a{levels} s ON s.tree = a0.tree, b{levels} r"
