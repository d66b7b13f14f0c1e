"""Nearest vectors by cosine similarity over an index of cells that is kept as a table.

The index: centroids are fitted on a bounded sample, every vector is put into the cell of its nearest centroid and written
with it, and of each cell the greatest angle to its centroid is known. A search sends each query to cells by a join; a group
of a cell's vectors and queries is a product of two matrices of bounded size. Large cells and many queries of one cell are
cut into parts, so no group grows with the data; a part hands on the best ``k`` of each query.

* The exact way: the queries' nearest cells give each a score that its ``k``-th neighbour has at least. By the angles, other
  cells either cannot hold a better one, or are searched too.
* With ``probes`` only so many nearest cells are searched, or that share of the cells. How many are needed hangs on how much the
  vectors gather: two thirds find 0.95 of the best ten of vectors spread at random in 64 dimensions.

Vectors without a direction (all zeros) score 0 and have a cell of their own; null vectors are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kbforge.functions.storage import materialize

#: Vectors that centroids are fitted on, and the most centroids.
SAMPLE, MOST_CELLS = 20_000, 2048
#: Vectors and queries of a group.
PART, QUERIES = 16_384, 2048
#: Numbers of a matrix of vectors and cells, or of vectors and queries, that a task works on at once.
MATRIX = 500_000
#: The cell of vectors without a direction.
NOWHERE = -1
#: Scores are rounded to six places, so bounds are kept wider by more than that.
SLACK = 2e-6


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The unit vectors of a column of lists of one length."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return unit(flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def few(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose rows times ``cells`` are no more than ``MATRIX``, one row at least."""
    rows = max(1, MATRIX // max(1, cells))
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


class Best:
    """The ``k`` highest scores of each query over batches, of equal ones the least ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, 0), -np.inf), np.zeros((queries, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.shape[1] > 4 * self.k:
            # Only what reaches the k-th score can stay; columns that no query wants go before the sort.
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            wanted = np.flatnonzero((scores >= least[:, None]).any(axis=0))
            scores, ids = scores[:, wanted], ids[wanted]
        scores = np.hstack([self.scores, scores])
        ids = np.hstack([self.ids, np.broadcast_to(ids, (len(scores), len(ids)))])
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def rows(self, queries: np.ndarray) -> pa.Table:
        held = self.scores > -np.inf
        return pa.table({"query_id": pa.array(np.repeat(queries, held.sum(axis=1)), pa.int64()), "vec_id": pa.array(self.ids[held], pa.int64()), "score": pa.array(self.scores[held], pa.float64())})


def centroids(vectors: DataFrame, cells: int, rounds: int = 8) -> np.ndarray:
    """Directions that a sample of the vectors gathers around; as many as asked for, or as the sample has unlike ones."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    points = matrix(sample["embedding"])
    points = points[np.linalg.norm(points, axis=1) > 0] if len(points) else points
    points = np.unique(points, axis=0)
    if not len(points):
        return np.zeros((0, points.shape[1] if points.ndim == 2 else 0))
    found = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(rounds):
        own = (points @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, points)
        found = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-12, unit(sums), found)
    return np.unique(found, axis=0)


@dataclass
class Index:
    """``table``: ``cell, vec_id, embedding``, written; of each cell its centroid, greatest angle and number of vectors."""

    table: DataFrame
    centers: np.ndarray
    angles: np.ndarray
    sizes: dict[int, int]


def bounds(centers: np.ndarray, angles: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query and cell a score that no vector of the cell exceeds; the last column is the cell of zeros."""
    apart = np.arccos(np.clip(queries @ centers.T, -1, 1)) if len(centers) else np.zeros((len(queries), 0))
    apart = np.where(np.linalg.norm(queries, axis=1, keepdims=True) > 0, apart, 0.0)
    return np.hstack([np.cos(np.maximum(0, apart - angles)), np.zeros((len(queries), 1))])


def build(vectors: DataFrame, cells: int | None = None) -> Index:
    """The index of ``vec_id, embedding``; by default about as many cells as a cell has vectors."""
    rows = vectors.select("vec_id", "embedding").filter("embedding IS NOT NULL")
    centers = centroids(rows, cells or min(MOST_CELLS, max(1, int(rows.count() ** 0.5))))
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in few(batches, len(centers)):
            v = matrix(batch.column(1))
            cell, angle = np.full(len(batch), NOWHERE), np.zeros(len(batch))
            if len(batch) and len(centers):
                near = v @ centers.T
                some = np.linalg.norm(v, axis=1) > 0
                cell[some] = near[some].argmax(axis=1)
                angle[some] = np.arccos(np.clip(near[some].max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), *batch.columns], names=["cell", "angle", "vec_id", "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    table = materialize(rows.mapInArrow(placed, f"cell int, angle double, vec_id long, embedding {kind}"), "vectors")
    # As many rows as there are cells.
    found = {r["cell"]: (r["angle"], r["n"]) for r in table.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()}
    angles = np.array([found.get(c, (0.0, 0))[0] for c in range(len(centers))])
    return Index(table.select("cell", "vec_id", "embedding"), centers, angles, {c: n for c, (_, n) in found.items()})


def _asks(index: Index, queries: DataFrame, probes: float | None, wide: bool) -> DataFrame:
    """``query_id, embedding, cell``: each query once for each cell that it is to be searched in.

    The nearest ``probes`` cells, or with ``wide`` all others whose bound reaches the query's score ``least`` (null: all).
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.centers, index.angles, sorted(index.sizes)))
    near = 1 if probes is None else int(probes) if probes >= 1 else max(1, -(-int(1000 * probes * len(index.centers)) // 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, angles, there = shared.value
        # A query is given out with its vector once for each cell, so few of them are held.
        for batch in few(batches, len(centers)):
            q = matrix(batch.column(1))
            first = np.argsort(-(q @ centers.T), axis=1, kind="stable")[:, :near] if len(centers) else np.zeros((len(q), 0), int)
            if wide:
                least = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
                wanted = bounds(centers, angles, q) + SLACK >= least[:, None]
                np.put_along_axis(wanted, first, False, axis=1)
            else:
                wanted = np.zeros((len(q), len(centers) + 1), bool)
                np.put_along_axis(wanted, first, True, axis=1)
            who, cell = np.nonzero(wanted)
            cell = np.where(cell == len(centers), NOWHERE, cell)
            held = np.isin(cell, there)
            who = pa.array(who[held])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(cell[held], pa.int32())], names=["query_id", "embedding", "cell"])

    kind = queries.schema["embedding"].dataType.simpleString()
    rows = queries.select("query_id", "embedding", *(["least"] if wide else []))
    return rows.mapInArrow(run, f"query_id long, embedding {kind}, cell int")


def _searched(index: Index, asks: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of each query in each part of each cell that it asks for."""
    spark = asks.sparkSession
    asks = materialize(asks, "asks")
    asked = dict(asks.groupBy("cell").count().collect())
    parts = [(c, -(-n // PART), -(-asked[c] // QUERIES)) for c, n in index.sizes.items() if c in asked]
    # A row for each cell, at most.
    cut = F.broadcast(spark.createDataFrame(parts, "cell int, parts int, blocks int"))
    spread = lambda column, count: F.pmod(F.xxhash64(column), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = index.table.join(cut, "cell").select("cell", spread("vec_id", "parts").alias("part"), each("blocks").alias("block"), "vec_id", "embedding")
    right = asks.join(cut, "cell").select("cell", spread("query_id", "blocks").alias("block"), each("parts").alias("part"), "query_id", "embedding")

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = Best(len(queries), k)
        if len(queries):
            q, ids = matrix(queries["embedding"]), vectors["vec_id"].to_numpy()
            step = max(256, MATRIX // len(q))
            for at in range(0, len(vectors), step):
                found.add(np.round(q @ matrix(vectors["embedding"].slice(at, step)).T, 6) + 0.0, ids[at : at + step])
        return found.rows(queries["query_id"].to_numpy())

    keys = ["cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int = 10, probes: float | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the best ``k`` vectors of each query (``query_id, embedding``): all of them that there
    are, or with ``probes`` those in so many nearest cells (below 1: in that share of them)."""
    from kbforge.operators.retrieval import top_k

    rows = materialize(queries.select("query_id", "embedding").filter("embedding IS NOT NULL"), "queries")
    found = materialize(_searched(index, _asks(index, rows, probes, False), k), "near")
    if probes is None:
        least = top_k(found, k, key="vec_id").filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        wide = rows.join(least, "query_id", "left")
        found = found.unionByName(_searched(index, _asks(index, wide, None, True), k))
    return top_k(found, k, key="vec_id")
