"""A knowledge graph as node and edge tables.

``nodes(label, key, props map, human_edited, updated_at)``, ``edges(source_type, source_key, rel_type, target_type,
target_key, props map)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kbforge.functions.storage import materialize
from kbforge.operators import retrieval

EDGE = ["source_type", "source_key", "rel_type", "target_type", "target_key"]
#: Labels whose properties a person's edit protects, and labels of which empty new values leave old ones.
#: Rows of a front that may be broadcast, some 50 bytes each.
BROADCAST_FRONT = 500_000
PROTECTED, COALESCED = ("Camera", "Product"), ("Protocol", "Port", "Control", "Firmware")


def upsert_nodes(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by label and key. Incoming rows of one key count once, the latest.

    Items and products keep what a person edited, else take the new properties; protocols, ports, controls and firmware
    take new values over old ones; other labels are overwritten.
    """
    latest = incoming.groupBy("label", "key").agg(F.max_by(F.struct("props", "updated_at"), F.struct("updated_at", F.to_json("props"))).alias("n"))
    both = nodes.join(latest, ["label", "key"], "full_outer")
    old, new = F.col("props"), F.col("n.props")
    merged = F.map_from_entries(F.array_distinct(F.transform(F.array_distinct(F.concat(F.map_keys(old), F.map_keys(new))), lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(new, k), F.element_at(old, k)).alias("value")))))
    props = (
        F.when(new.isNull(), old)
        .when(old.isNull(), new)
        .when(F.col("label").isin(*PROTECTED) & F.coalesce("human_edited", F.lit(False)), old)
        .when(F.col("label").isin(*COALESCED), merged)
        .otherwise(new)
    )
    return both.select("label", "key", props.alias("props"), F.coalesce("human_edited", F.lit(False)).alias("human_edited"), F.coalesce("n.updated_at", "updated_at").alias("updated_at"))


def upsert_edges(edges: DataFrame, incoming: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges of which both ends exist and the types are allowed; of one edge given twice later properties win, key by key.

    ``incoming`` has ``at``, its order; ``allowed`` is the small table of types. Old edges come first.
    """
    known = nodes.select("label", "key").distinct()
    new = incoming.join(F.broadcast(allowed), ["source_type", "rel_type", "target_type"], "left_semi")
    for side in ("source", "target"):
        new = new.join(known.select(F.col("label").alias(f"{side}_type"), F.col("key").alias(f"{side}_key")), [f"{side}_type", f"{side}_key"], "left_semi")
    rows = edges.select(*EDGE, "props", F.lit(-1).cast("long").alias("at")).unionByName(new.select(*EDGE, "props", F.col("at").cast("long").alias("at")))
    flat = rows.select(*EDGE, "at", F.explode_outer("props").alias("k", "v"))
    last = flat.groupBy(*EDGE, "k").agg(F.max_by("v", "at").alias("v"))
    entries = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
    return last.groupBy(*EDGE).agg(F.map_from_entries(entries).alias("props"))


def rewrite_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends pointed to their new keys (``type, old_key, new_key``) after a merge; loops and repeats go."""
    out = edges
    for side in ("source", "target"):
        m = mapping.select(F.col("type").alias(f"{side}_type"), F.col("old_key").alias(f"{side}_key"), F.col("new_key").alias("moved"))
        out = out.join(m, [f"{side}_type", f"{side}_key"], "left").withColumn(f"{side}_key", F.coalesce("moved", f"{side}_key")).drop("moved")
    return out.filter("NOT (source_type = target_type AND source_key = target_key)").select(*EDGE).distinct()


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n")))


def both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("source_type").alias("type"), F.col("source_key").alias("key"), "rel_type", F.lit("out").alias("direction"), F.col("target_type").alias("other_type"), F.col("target_key").alias("other_key"))
    b = edges.select(F.col("target_type").alias("type"), F.col("target_key").alias("key"), "rel_type", F.lit("in").alias("direction"), F.col("source_type").alias("other_type"), F.col("source_key").alias("other_key"))
    return a.unionByName(b)


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 2, relations: list[str] | None = None) -> DataFrame:
    """``seed, type, key, hop``: nodes within ``hops`` of each seed (``seed, type, key``), any direction, nearest hop.

    A front of counted size goes to the edges by a broadcast, so that a hub's edges stay dealt out; beyond, both are shuffled
    and skewed keys are split as the query runs. Only edges of a type that stands in the front go there.
    """
    used = edges if relations is None else edges.filter(F.col("rel_type").isin(*relations))
    steps = both_ways(used).select("type", "key", "other_type", "other_key")
    if hops > 1:
        steps = materialize(steps, "steps")
    seen = materialize(seeds.select("seed", "type", "key", F.lit(0).alias("hop")).distinct(), "hops")
    front = seen
    for hop in range(1, hops + 1):
        near = F.broadcast(front) if front.count() <= BROADCAST_FRONT else front
        # As many as there are labels.
        types = [r[0] for r in front.select("type").distinct().collect()]
        reached = steps.filter(F.col("type").isin(types)).join(near, ["type", "key"]).select("seed", F.col("other_type").alias("type"), F.col("other_key").alias("key")).distinct()
        front = materialize(reached.join(seen, ["seed", "type", "key"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def graph_context(hits: DataFrame, around: DataFrame, names: DataFrame, first: int = 10, most: int = 3) -> DataFrame:
    """``query_id, label, names``: what lies around a query's first hits, by label, at most ``most`` names in order.

    A name that is not among a hit's own first ``most`` has as many before it in the query too; so hits meet just those.
    """
    order = Window.partitionBy("seed", "type").orderBy("hop", "name")
    named = around.join(names, ["type", "key"]).groupBy("seed", "type", F.substring("name", 1, 50).alias("name")).agg(F.min("hop").alias("hop"))
    own = materialize(named.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).groupBy("seed").agg(F.collect_list(F.struct("type", "hop", "name")).alias("near")), "near")
    top = hits.filter(F.col("rank") <= first).select("query_id", F.col("doc_key").alias("seed"))
    found = top.join(own, "seed").select("query_id", F.explode("near").alias("x")).select("query_id", "x.*").groupBy("query_id", "type", "name").agg(F.min("hop").alias("hop"))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "type").orderBy("hop", "name"))).filter(F.col("r") <= most)
    return ranked.groupBy("query_id", F.col("type").alias("label")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("names"))


def item_compatibility(edges: DataFrame, item_type: str, types: list[str]) -> DataFrame:
    """Per item the distinct neighbours of each type, sorted and joined by a comma."""
    rows = edges.filter(F.col("source_type") == item_type)
    return rows.groupBy("source_key").pivot("target_type", types).agg(F.array_join(F.array_sort(F.collect_set("target_key")), ","))


def issues_with_solutions(edges: DataFrame, affects: str = "AFFECTS", resolved: str = "RESOLVED_BY") -> DataFrame:
    issues = edges.filter(F.col("rel_type") == affects).select(F.col("target_key").alias("product"), F.col("source_key").alias("issue")).distinct()
    fixes = edges.filter(F.col("rel_type") == resolved).select(F.col("source_key").alias("issue"), F.col("target_key").alias("solution"))
    return issues.join(fixes, "issue", "left").groupBy("product", "issue").agg(F.array_join(F.array_sort(F.collect_set("solution")), ",").alias("solutions"))


def list_entities(nodes: DataFrame, edges: DataFrame, label: str, contains: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a label's nodes by name, with degree and the total."""
    degree = both_ways(edges.select(*EDGE).distinct()).filter(F.col("type") == label).groupBy("key").agg(F.count("*").alias("degree"))
    rows = nodes.filter((F.col("label") == label) & F.lower("key").contains(contains.lower()))
    total = rows.agg(F.count("*").alias("total"))
    return rows.join(degree, "key", "left").select("key", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy("key").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def entity_edges(edges: DataFrame, type_: str, key: str) -> DataFrame:
    return both_ways(edges.select(*EDGE).distinct()).filter((F.col("type") == type_) & (F.col("key") == key)).select("direction", "rel_type", "other_type", "other_key")


def normalize_entities(entities: DataFrame, names: DataFrame, least: int = 10, most: int = 500) -> DataFrame:
    """``entities (label, name)`` under their usual names; those without a name go.

    ``names`` (``label, variant, name``) is the small table of usual names, met case aside. Of the rest, products are
    written in capitals and controls with capitals at their words. Issues and solutions keep ``most`` characters, and go
    if they have ``least`` or fewer.
    """
    rows = entities.withColumn("name", F.trim("name")).filter("name <> ''")
    long = F.col("label").isin("Issue", "Solution")
    rows = rows.filter(~long | (F.length("name") > least)).withColumn("_v", F.lower("name"))
    known = names.select(F.col("label").alias("_l"), F.lower("variant").alias("_v"), F.col("name").alias("_usual")).dropDuplicates(["_l", "_v"])
    met = rows.join(known, (F.col("label") == F.col("_l")) & (rows["_v"] == known["_v"]), "left")
    other = F.when(F.col("label") == "Product", F.upper("name")).when(F.col("label") == "Control", F.initcap("name")).when(long, F.substring("name", 1, most)).otherwise(F.col("name"))
    return met.withColumn("name", F.coalesce("_usual", other)).select(entities.columns)


def entity_search(nodes: DataFrame, queries: DataFrame, limit: int = 10, labels: tuple[str, ...] = ("Issue", "Solution")) -> DataFrame:
    """``query_id, label, key, score, rank``: the nodes of ``labels`` whose text (``key``) fits a query best, by BM25; equal scores
    rank by label and text.

    Texts are written once under a number, and only numbers stand in the postings; of a query's best nodes, with all that score
    like the last, the texts are met again.
    """
    rows = materialize(nodes.filter(F.col("label").isin(*labels)).select("label", "key", F.monotonically_increasing_id().alias("doc_id")), "entities")
    scored = retrieval.bm25_scores(rows.select("doc_id", F.col("key").alias("text")), queries)
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("place") <= limit).drop("place")
    named = rows.join(retrieval.bounded(materialize(near, "near")), "doc_id").select("query_id", "label", "key", "score", F.concat_ws(":", "label", "key").alias("name"))
    return retrieval.top_k(named, limit, key="name").drop("name")


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """The first of each entity (``label, name, manufacturer, at``): items by maker and name, others by name, issues and the like all stay."""
    free = F.col("label").isin("Issue", "Solution", "Firmware")
    key = F.when(F.col("label").isin("Camera"), F.concat_ws(":", F.lower(F.coalesce("manufacturer", F.lit("unknown"))), F.lower("name"))).when(free, F.concat(F.lit("#"), F.col("at").cast("string"))).otherwise(F.lower("name"))
    rows = entities.withColumn("k", key)
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("label", "k").orderBy("at"))).filter("r = 1").drop("r", "k")


def extract_mentions(chunks: DataFrame, dictionary: DataFrame, least: int = 50) -> DataFrame:
    """``chunk_id, label, key`` of dictionary names (one to three words, lower case) that a chunk's text holds.

    Word n-grams of the text are equi-joined to the dictionary; texts of fewer than ``least`` characters are left out.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    longest = dictionary.agg(F.coalesce(F.max(F.size(F.split("name", " "))), F.lit(1))).first()[0]
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i + n - 1 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " "))))
    cut = chunks.filter(F.length("text") >= least).select("chunk_id", words.alias("w")).select("chunk_id", F.explode(F.array_distinct(grams)).alias("name"))
    return cut.join(dictionary, "name").select("chunk_id", "label", "key").distinct()
