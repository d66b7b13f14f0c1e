"""A graph of parts, suppliers, orders, customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions.storage import read_table
from kbforge.operators import graph as ops
from kbforge.plans import retrieval

SQL_EDGES = """edges AS (
  SELECT DISTINCT 'Part' AS source_type, l_partkey::VARCHAR AS source_key, 'SUPPLIED_BY' AS rel_type, 'Supplier' AS target_type, l_suppkey::VARCHAR AS target_key FROM lineitem
  UNION ALL SELECT 'Order', o_orderkey::VARCHAR, 'PLACED_BY', 'Customer', o_custkey::VARCHAR FROM orders
  UNION ALL SELECT 'Customer', c_custkey::VARCHAR, 'LIVES_IN', 'Nation', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR, 'LIVES_IN', 'Nation', s_nationkey::VARCHAR FROM supplier)"""
SQL_NODES = """nodes AS (SELECT 'Part' AS label, p_partkey::VARCHAR AS key, p_name AS name FROM part UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR, s_name FROM supplier
  UNION ALL SELECT 'Customer', c_custkey::VARCHAR, c_name FROM customer UNION ALL SELECT 'Nation', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'Order', o_orderkey::VARCHAR, o_orderpriority FROM orders)"""
SQL_STEPS = "steps AS (SELECT source_type AS type, source_key AS key, target_type AS other_type, target_key AS other_key FROM edges UNION SELECT target_type, target_key, source_type, source_key FROM edges)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: read_table(spark, d, name)
    e = lambda df, a, ac, r, b, bc: df.select(F.lit(a).alias("source_type"), F.col(ac).cast("string").alias("source_key"), F.lit(r).alias("rel_type"), F.lit(b).alias("target_type"), F.col(bc).cast("string").alias("target_key"))
    parts = e(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "Part", "l_partkey", "SUPPLIED_BY", "Supplier", "l_suppkey")
    return parts.unionByName(e(t("orders"), "Order", "o_orderkey", "PLACED_BY", "Customer", "o_custkey")).unionByName(e(t("customer"), "Customer", "c_custkey", "LIVES_IN", "Nation", "c_nationkey")).unionByName(e(t("supplier"), "Supplier", "s_suppkey", "LIVES_IN", "Nation", "s_nationkey"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for label, table, key, name in (("Part", "part", "p_partkey", "p_name"), ("Supplier", "supplier", "s_suppkey", "s_name"), ("Customer", "customer", "c_custkey", "c_name"), ("Nation", "nation", "n_nationkey", "n_name"), ("Order", "orders", "o_orderkey", "o_orderpriority")):
        one = read_table(spark, d, table).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), F.col(name).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("seed"), F.lit("Order").alias("type"), F.col("o_orderkey").cast("string").alias("key"))


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    old = nodes(spark, d).select("label", "key", F.create_map(F.lit("name"), "name").alias("props"), (F.pmod(F.col("key").cast("long"), F.lit(3)) == 0).alias("human_edited"), day.alias("updated_at"))
    new = nodes(spark, d).filter("CAST(key AS BIGINT) % 2 = 0").select(F.when(F.col("label") == "Part", "Camera").otherwise(F.col("label")).alias("label"), "key", F.create_map(F.lit("name"), F.upper("name"), F.lit("new"), F.lit("1")).alias("props"), day.alias("updated_at"))
    old = old.withColumn("label", F.when(F.col("label") == "Part", "Camera").when(F.col("label") == "Supplier", "Port").otherwise(F.col("label")))
    new = new.withColumn("label", F.when(F.col("label") == "Supplier", "Port").otherwise(F.col("label")))
    return ops.upsert_nodes(old, new).select("label", "key", F.element_at("props", "name").alias("name"), F.coalesce(F.element_at("props", "new"), F.lit("0")).alias("new"))


def _upserted_edges(spark: SparkSession, d: str) -> DataFrame:
    old = edges(spark, d).filter("rel_type = 'LIVES_IN'").withColumn("props", F.create_map(F.lit("w"), F.lit("old")))
    new = edges(spark, d).withColumns({"props": F.create_map(F.lit("w"), F.lit("new")), "at": F.lit(1)})
    known = nodes(spark, d).filter("NOT (label = 'Customer' AND CAST(key AS BIGINT) % 2 = 1)")
    allowed = spark.createDataFrame([("Order", "PLACED_BY", "Customer"), ("Customer", "LIVES_IN", "Nation")], "source_type string, rel_type string, target_type string")
    return ops.upsert_edges(old, new, known, allowed).select(*ops.EDGE, F.element_at("props", "w").alias("w"))


def _rewritten(spark: SparkSession, d: str) -> DataFrame:
    moved = read_table(spark, d, "customer").filter("c_custkey % 4 = 1").select(F.lit("Customer").alias("type"), F.col("c_custkey").cast("string").alias("old_key"), (F.col("c_custkey") - 1).cast("string").alias("new_key"))
    return ops.rewrite_edges(edges(spark, d), moved)


def _context(spark: SparkSession, d: str) -> DataFrame:
    hits = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").cast("string").alias("doc_key"), F.col("l_linenumber").alias("rank"))
    seeds = hits.select(F.col("doc_key").alias("seed"), F.lit("Part").alias("type"), F.col("doc_key").alias("key")).distinct()
    return ops.graph_context(hits, ops.k_hop(edges(spark, d), seeds, 1), nodes(spark, d).select(F.col("label").alias("type"), "key", "name"))


WORDS = ("the", "der", "les", "que", "and the", "in the", "est de")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(w, "Product" if " " in w else "Protocol", w.upper()) for w in WORDS], "name string, label string, key string")
    return ops.extract_mentions(retrieval.docs(spark, d).withColumnRenamed("doc_id", "chunk_id"), names)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "part").select(F.element_at(F.array(F.lit("Camera"), F.lit("Port"), F.lit("Issue")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("manufacturer"), F.col("p_partkey").alias("at"))
    return ops.dedupe_entities(rows)


NAMES = (("Product", "RED RING", "Red Ring"), ("Protocol", "blue bolt", "BLUE bolt"), ("Control", "GREEN WIDGET", "green Widget"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("Product"), F.lit("Protocol"), F.lit("Control"), F.lit("Issue"), F.lit("Port")), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), label.alias("label"), F.when(F.col("p_partkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"))
    return ops.normalize_entities(rows, spark.createDataFrame(NAMES, "label string, variant string, name string"))


def _searched(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.docs(spark, d).select(F.when(F.col("doc_id") % 2 == 0, "Issue").otherwise("Solution").alias("label"), F.col("text").alias("key")).filter("key <> ''").distinct()
    return ops.entity_search(rows, retrieval.questions(spark, d)).select("query_id", "label", F.md5("key").alias("digest"), "score", "rank")


def _solved(s: SparkSession, d: str) -> DataFrame:
    """Orders as issues of their customers, of which every third has a solution and every sixth two."""
    orders = read_table(s, d, "orders")
    issue = F.concat(F.lit("o"), "o_orderkey")
    affects = orders.select(issue.alias("source_key"), F.lit("AFFECTS").alias("rel_type"), F.col("o_custkey").cast("string").alias("target_key"))
    solved = lambda every, name: orders.filter(F.col("o_orderkey") % every == 0).select(issue.alias("source_key"), F.lit("RESOLVED_BY").alias("rel_type"), name.alias("target_key"))
    return ops.issues_with_solutions(affects.unionByName(solved(3, F.concat(F.lit("fix"), F.col("o_orderkey") % 5))).unionByName(solved(6, F.lit("again"))))


QUERIES = {
    "normalize_entities": _normalized,
    "entity_search": _searched,
    "upsert_nodes": _upserted,
    "upsert_edges": _upserted_edges,
    "rewrite_edges": _rewritten,
    "graph_counts": lambda s, d: ops.graph_counts(nodes(s, d), edges(s, d)),
    "k_hop": lambda s, d: ops.k_hop(edges(s, d), _seeds(s, d), 2),
    "graph_context": _context,
    "item_compatibility": lambda s, d: ops.item_compatibility(edges(s, d), "Part", ["Supplier"]),
    "issues_with_solutions": _solved,
    "list_entities": lambda s, d: ops.list_entities(nodes(s, d), edges(s, d), "Customer", "1", 10, 40),
    "entity_edges": lambda s, d: ops.entity_edges(edges(s, d), "Nation", "3"),
    "dedupe_entities": _entities,
    "extract_mentions": _mentions,
}

ORACLES = {
    "normalize_entities": """WITH e AS (SELECT p_partkey AS id, ['Product','Protocol','Control','Issue','Port'][1 + p_partkey % 5] AS label, p_name AS n FROM part WHERE p_partkey % 11 <> 0)
        SELECT id, label, CASE WHEN label = 'Product' AND lower(n) = 'red ring' THEN 'Red Ring' WHEN label = 'Product' THEN upper(n) WHEN label = 'Protocol' AND lower(n) = 'blue bolt' THEN 'BLUE bolt' WHEN label = 'Control' AND lower(n) = 'green widget' THEN 'green Widget'
        WHEN label = 'Control' THEN array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE n END AS name FROM e WHERE label <> 'Issue' OR length(n) > 10""",
    "entity_search": f"""WITH source AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'Issue' ELSE 'Solution' END AS label, text FROM main.documents WHERE text <> ''), documents AS (SELECT label || ':' || text AS doc_id, text FROM source), {retrieval.SQL_BM25.replace(f"rank <= {retrieval.K}", "rank <= 10")}
        SELECT query_id, CASE WHEN starts_with(doc_id, 'Issue:') THEN 'Issue' ELSE 'Solution' END AS label, md5(substring(doc_id, instr(doc_id, ':') + 1)) AS digest, score, rank FROM bm""",
    "upsert_nodes": f"WITH {SQL_NODES}, n AS (SELECT CASE label WHEN 'Part' THEN 'Camera' WHEN 'Supplier' THEN 'Port' ELSE label END AS label, key, name, key::BIGINT % 2 = 0 AS again, label = 'Part' AND key::BIGINT % 3 = 0 AS kept FROM nodes) SELECT label, key, CASE WHEN again AND NOT kept THEN upper(name) ELSE name END AS name, CASE WHEN again AND NOT kept THEN '1' ELSE '0' END AS new FROM n",
    "upsert_edges": f"WITH {SQL_EDGES} SELECT *, CASE WHEN source_type = 'Customer' AND source_key::BIGINT % 2 = 0 THEN 'new' ELSE 'old' END AS w FROM edges WHERE rel_type = 'LIVES_IN' UNION ALL SELECT *, 'new' FROM edges WHERE rel_type = 'PLACED_BY' AND target_key::BIGINT % 2 = 0",
    "rewrite_edges": f"WITH {SQL_EDGES} SELECT DISTINCT source_type, CASE WHEN source_type = 'Customer' AND source_key::BIGINT % 4 = 1 THEN (source_key::BIGINT - 1)::VARCHAR ELSE source_key END AS source_key, rel_type, target_type, CASE WHEN target_type = 'Customer' AND target_key::BIGINT % 4 = 1 THEN (target_key::BIGINT - 1)::VARCHAR ELSE target_key END AS target_key FROM edges",
    "graph_counts": f"WITH {SQL_EDGES}, {SQL_NODES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type",
    "k_hop": f"""WITH {SQL_EDGES}, {SQL_STEPS}, s AS (SELECT o_orderkey AS seed, 'Order' AS type, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey % 20 = 0),
        h1 AS (SELECT DISTINCT seed, other_type AS type, other_key AS key, 1 AS hop FROM s JOIN steps USING (type, key)), h2 AS (SELECT DISTINCT seed, other_type AS type, other_key AS key, 2 AS hop FROM h1 JOIN steps USING (type, key))
        SELECT * FROM h1 UNION ALL SELECT * FROM h2 ANTI JOIN (SELECT seed, type, key FROM s UNION ALL SELECT seed, type, key FROM h1) x USING (seed, type, key)""",
    "graph_context": f"""WITH {SQL_EDGES}, {SQL_NODES}, f AS (SELECT DISTINCT l_orderkey AS query_id, s_name AS name FROM lineitem l JOIN edges ON source_type = 'Part' AND source_key = l_partkey::VARCHAR JOIN supplier ON s_suppkey::VARCHAR = target_key WHERE l_linenumber <= 10),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name) AS r FROM f) SELECT query_id, 'Supplier' AS label, string_agg(name, ', ' ORDER BY r) AS names FROM r WHERE r <= 3 GROUP BY query_id""",
    "item_compatibility": f"WITH {SQL_EDGES} SELECT source_key, string_agg(target_key, ',' ORDER BY target_key) AS \"Supplier\" FROM edges WHERE source_type = 'Part' GROUP BY source_key",
    "issues_with_solutions": "SELECT o_custkey::VARCHAR AS product, 'o' || o_orderkey AS issue, CASE WHEN o_orderkey % 6 = 0 THEN 'again,fix' || (o_orderkey % 5) WHEN o_orderkey % 3 = 0 THEN 'fix' || (o_orderkey % 5) ELSE '' END AS solutions FROM orders",
    "list_entities": f"WITH {SQL_EDGES}, {SQL_NODES}, g AS (SELECT key, count(*) AS degree FROM (SELECT source_key AS key FROM edges WHERE source_type = 'Customer' UNION ALL SELECT target_key FROM edges WHERE target_type = 'Customer') GROUP BY key) SELECT key, coalesce(degree, 0) AS degree, (SELECT count(*) FROM nodes WHERE label = 'Customer' AND contains(key, '1')) AS total FROM nodes LEFT JOIN g USING (key) WHERE label = 'Customer' AND contains(key, '1') ORDER BY key LIMIT 40 OFFSET 10",
    "entity_edges": f"WITH {SQL_EDGES} SELECT 'in' AS direction, rel_type, source_type AS other_type, source_key AS other_key FROM edges WHERE target_type = 'Nation' AND target_key = '3'",
    "dedupe_entities": "WITH e AS (SELECT ['Camera','Port','Issue'][1 + p_partkey % 3] AS label, p_name AS name, p_brand AS manufacturer, p_partkey AS \"at\" FROM part) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY label, CASE label WHEN 'Camera' THEN lower(manufacturer) || ':' || lower(name) WHEN 'Issue' THEN \"at\"::VARCHAR ELSE lower(name) END ORDER BY \"at\") = 1",
    "extract_mentions": r"WITH w AS (SELECT doc_id AS chunk_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents WHERE length(text) >= 50), n(name) AS (VALUES "
    + ", ".join(f"('{w}')" for w in WORDS)
    + ") SELECT chunk_id, CASE WHEN contains(name, ' ') THEN 'Product' ELSE 'Protocol' END AS label, upper(name) AS key FROM w JOIN n ON contains(t, ' ' || name || ' ')",
}
