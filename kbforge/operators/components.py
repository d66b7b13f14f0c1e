"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kbforge.functions.storage import materialize


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each ``key`` with their number ``n`` at least.

    ``count`` is at least half the number of ``rows``. Keys of more than a thousandth of it are broadcast: there are at most
    two thousand. All others meet theirs in a shuffle, in which no key is large.
    """
    limit = max(100, count // 1000)
    heavy = F.broadcast(table.filter(F.col("n") > limit).drop("n"))
    light = table.filter(F.col("n") <= limit).drop("n")
    return rows.join(heavy, key).unionByName(rows.join(heavy, key, "left_anti").join(light, key))


def join_spread(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", share: int = 1000, hint: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each ``key`` at most; no key's rows meet in one task.

    Keys of more than a ``share``-th of the rows, fewer than ``share`` of them, are cut into parts of that size by the rows'
    numbers, and their row of ``table`` is repeated for each part. ``rows`` are read twice and must come alike each time.
    ``hint`` names the kind of join; Spark chooses if there is none.
    """
    counts = materialize(rows.groupBy(key).agg(F.count("*").alias("n")), "counts")
    limit = max(1000, (counts.agg(F.sum("n")).first()[0] or 0) // share)
    heavy = F.broadcast(counts.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("long").alias("_parts")))
    cut = rows.withColumn("_row", F.monotonically_increasing_id()).join(heavy, key, "left")
    cut = cut.withColumn("_cut", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_row"), "_parts")).otherwise(0)).drop("_row", "_parts")
    repeated = table.join(heavy, key, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return cut.join(repeated.hint(hint) if hint else repeated, [key, "_cut"], how).drop("_cut")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of ``edges (a, b)``; a component is named by its least node.

    Large-star and small-star rounds: in each, a node's neighbours are hung on the least of them, so that a component
    of n nodes settles to a star in about log n rounds. The least neighbour is a partial aggregate and reaches the edges
    of a node with many of them by a broadcast, so no node makes a large group. Each round is written to the shared folder. Edges with a null end are dropped.
    """
    current = materialize(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, count = None, current.count()
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("n"))
        large = join_counted(both.filter("b > a"), least, "a", count).select(F.col("b").alias("a"), F.col("least").alias("b"))
        # Written, as what follows reads it several times: plans stay small, and so do the driver's.
        stars = materialize(large.filter("a <> b").distinct(), "stars")
        down = stars.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
        small = join_counted(stars, down, "a", count).select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        current = materialize(small.unionByName(down.select("a", F.col("least").alias("b"))).distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            break
        before, count = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
