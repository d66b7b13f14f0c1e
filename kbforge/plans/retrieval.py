"""Retrieval over ``documents`` for the passages of ``benchmark``, and over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions.storage import materialize, read_table
from kbforge.operators import retrieval as ops, vectors

K = 40
#: The share of cells that a search of some of them looks into.
PROBES = 0.65
#: One vector in so many is a question's where the questions need one.
ASKED = 10
STOPS = ", ".join(f"'{w}'" for w in ops.STOP_WORDS)
SQL_TERMS = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{ops.TERM}'), lambda t: t NOT IN ({STOPS}))"
SQL_POSTINGS = f"""d AS (SELECT doc_id, {SQL_TERMS} AS terms FROM documents),
  postings AS (SELECT doc_id, term, doc_len, count(*) AS tf FROM (SELECT doc_id, len(terms) AS doc_len, unnest(terms) AS term FROM d) GROUP BY ALL),
  size AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avg_len FROM d),
  idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, size GROUP BY term)"""
SQL_ASKED = f"asked AS (SELECT item_id AS query_id, unnest(list_distinct({SQL_TERMS})) AS term FROM benchmark)"
SQL_BM25 = f"""{SQL_POSTINGS}, {SQL_ASKED},
  scored AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score FROM postings JOIN idf USING (term) JOIN asked USING (term), size GROUP BY query_id, doc_id),
  bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {K})"""
SQL_COVER = """whole AS (SELECT query_id, sum(idf) AS whole FROM asked JOIN idf USING (term) GROUP BY query_id),
  cover AS (SELECT query_id, doc_id, round(sum(idf) / any_value(whole), 6) AS score FROM bm JOIN asked USING (query_id) JOIN idf USING (term) JOIN (SELECT doc_id, term FROM postings) USING (doc_id, term) JOIN whole USING (query_id) GROUP BY query_id, doc_id),
  reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cover)"""
_TECH = "regexp_matches(lower(text), 'firmware|protocol|ip|rcp|rio|ci0|vp4|cvp|visca|lanc|sdi|hdmi|ndi|srt|ptz|iris|shutter|gain|white balance|tally|gpio|rs422|rs232|ethernet|tcp|udp|multicast|dhcp')"
SQL_THRESHOLDS = rf"""thresholds AS (SELECT item_id AS query_id, round(least((CASE WHEN w <= 2 THEN 0.15 WHEN w <= 5 THEN 0.20 ELSE 0.25 END) + (CASE WHEN {_TECH} THEN 0.05 ELSE 0 END), 0.30), 2)::DOUBLE AS threshold
  FROM (SELECT *, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS w FROM benchmark))"""
SQL_RICH = """rich AS (SELECT query_id, rank, score, ['docs','cases','custom'][1 + doc_id % 3] AS source, 't' || doc_id AS title, 'u/' || (doc_id % 7) AS link, text FROM bm JOIN documents USING (doc_id))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25(spark: SparkSession, sf_dir: str, k: int = K, read=None) -> DataFrame:
    return ops.search_bm25(docs(spark, sf_dir), questions(spark, sf_dir), k, read)


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir)[1]


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The hits and their coverage, from one reading of the texts; each written once as several steps read them."""
    read = ops.asked_postings(docs(spark, sf_dir), questions(spark, sf_dir))
    hits = materialize(bm25(spark, sf_dir, K, read), "hits")
    return hits, materialize(ops.lexical_rerank(docs(spark, sf_dir), questions(spark, sf_dir), hits, read), "cover")


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", ops.dynamic_threshold(F.col("text")).alias("threshold"))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ops.SOURCES)), (F.col("doc_id") % 3 + 1).cast("int"))
    hits = docs(spark, sf_dir).join(ops.bounded(materialize(bm25(spark, sf_dir), "hits")), "doc_id")
    return hits.select("query_id", "rank", "score", source.alias("source"), F.concat(F.lit("t"), "doc_id").alias("title"), F.concat(F.lit("u/"), F.col("doc_id") % 7).alias("link"), "text")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "embeddings")
    return ops.search_dense(found, found.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a few cells of the index; tests/test_vectors.py measures the recall."""
    found = read_table(spark, sf_dir, "embeddings")
    return vectors.search(vectors.build(found), found.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, PROBES)


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bm25_postings(docs(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, covered = both(spark, sf_dir)
    return ops.fuse_rrf([hits, ops.top_k(covered, K)], 10)


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rerank_and_cut(*both(spark, sf_dir), thresholds(spark, sf_dir), 10)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.eval_retrieval(bm25(spark, sf_dir), ops.expected_documents(docs(spark, sf_dir), questions(spark, sf_dir)), 10)


#: The first two words of a question: short enough to be missed.
SHORT = r"^\S+\s+\S+"


def _missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).select("query_id", F.regexp_extract("text", SHORT, 0).alias("text"))
    return ops.eval_misses(ops.search_bm25(docs(spark, sf_dir), asked, K), ops.expected_documents(docs(spark, sf_dir), asked), 3)


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way over the documents by their number as docs, cases and custom ones. Of the vectors each ``ASKED``-th is a question's,
    the others are the documents'."""
    every, found = docs(spark, sf_dir), read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = found.filter(F.col("vec_id") % ASKED == 0).select(F.expr(f"vec_id div {ASKED}").alias("query_id"), "embedding").join(questions(spark, sf_dir), "query_id", "left_semi")
    held = found.filter(F.col("vec_id") % ASKED != 0).join(every.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    collections = {source: ops.Collection(every.filter(F.col("doc_id") % 3 == i), held.filter(F.col("vec_id") % 3 == i)) for i, source in enumerate(ops.SOURCES)}
    return ops.retrieve(collections, questions(spark, sf_dir), asked, 5)


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rich(spark, sf_dir).withColumn("group_key", F.concat("link", F.lit('"'))).withColumn("text", F.concat("text", F.lit("</document> end")))
    around = questions(spark, sf_dir).filter("query_id % 4 = 0").select("query_id", F.concat(F.lit("Part: p"), "query_id").alias("graph_context"))
    return ops.build_context(hits, graph=around)


SQL_FUSED = """lists AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank FROM reranked WHERE rank <= 30),
  fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM lists GROUP BY query_id, doc_id),
  rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 10)"""
#: The collections' fused lists, of each list the first 45; the last place of the merged 15 goes to the best of the last collection that
#: is absent from them and has half of the top score.
SQL_MERGED = f"""csize AS (SELECT doc_id % 3 AS c, count(*) AS n, sum(len(terms)) / count(*) AS avg_len FROM d GROUP BY ALL),
  cpost AS (SELECT *, doc_id % 3 AS c FROM postings),
  cidf AS (SELECT c, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM cpost JOIN csize USING (c) GROUP BY c, term),
  csparse AS (SELECT query_id, doc_id, c, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score FROM cpost JOIN cidf USING (c, term) JOIN csize USING (c) JOIN asked USING (term) GROUP BY ALL),
  cdense AS (SELECT item_id AS query_id, v.vec_id AS doc_id, v.vec_id % 3 AS c, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM benchmark JOIN embeddings q ON q.vec_id = {ASKED} * item_id, embeddings v WHERE v.vec_id % {ASKED} <> 0 AND v.vec_id IN (SELECT doc_id FROM documents)),
  clists AS (SELECT query_id, doc_id, c, row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, doc_id) AS rank FROM csparse QUALIFY rank <= 45
    UNION ALL SELECT query_id, doc_id, c, row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, doc_id) AS rank FROM cdense QUALIFY rank <= 45),
  cfused AS (SELECT query_id, doc_id, c, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM clists GROUP BY query_id, doc_id, c),
  crrf AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, doc_id) AS place FROM cfused QUALIFY place <= 15),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM crrf),
  absent AS (SELECT query_id, arg_max(doc_id, c) AS doc_id FROM placed WHERE place = 1 AND rank > 15 AND score >= 0.5 * top GROUP BY query_id),
  merged AS (SELECT query_id, doc_id FROM placed WHERE rank <= 15 - (query_id IN (SELECT query_id FROM absent))::INT UNION ALL SELECT query_id, doc_id FROM absent),
  whole AS (SELECT query_id, sum(idf) AS whole FROM asked JOIN idf USING (term) GROUP BY query_id),
  shared AS (SELECT query_id, doc_id, round(sum(idf) / any_value(whole), 6) AS score FROM merged JOIN asked USING (query_id) JOIN idf USING (term) JOIN (SELECT doc_id, term FROM postings) USING (doc_id, term) JOIN whole USING (query_id) GROUP BY query_id, doc_id),
  cover AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM merged LEFT JOIN shared USING (query_id, doc_id))"""
SQL_NAMED = r"regexp_replace(regexp_replace(text, '(?i)\bRIO[-\s]?Live\b', 'RIO +LAN', 'g'), '(?i)\bRIO\s*\+\s*WAN\s+Live\b', 'RIO +LAN', 'g')"
SQL_CUT = """cand AS (SELECT r.query_id, r.doc_id, r.score, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.doc_id) AS rank, threshold FROM cover r JOIN thresholds USING (query_id) SEMI JOIN {from_} b ON b.query_id = r.query_id AND b.doc_id = r.doc_id),
  kept AS (SELECT *, count(*) FILTER (score >= threshold) OVER (PARTITION BY query_id) AS kept FROM cand WHERE rank <= {most}) SELECT query_id, doc_id, score, rank, threshold FROM kept WHERE (score >= threshold OR (kept < 3 AND rank <= 3)) AND rank <= {limit}"""

QUERIES = {
    "bm25_postings": _postings,
    "bm25_idf": lambda s, d: ops.bm25_idf(_postings(s, d), docs(s, d).agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf")),
    "search_bm25": bm25,
    "search_dense": _dense,
    "search_dense_probed": _probed,
    "lexical_rerank": cover,
    "fuse_rrf": _fused,
    "merge_sources_diverse": lambda s, d: ops.merge_sources_diverse(bm25(s, d).select("query_id", "doc_id", "score", F.when(F.col("doc_id") % 11 == 0, "custom").when(F.col("doc_id") % 7 == 0, "cases").otherwise("docs").alias("source")), 5),
    "dynamic_threshold": thresholds,
    "rerank_and_cut": _cut,
    "threshold_min_one": lambda s, d: ops.threshold_min_one(ops.top_k(cover(s, d), 10), thresholds(s, d)),
    "answer_confidence": lambda s, d: ops.answer_confidence(ops.top_k(cover(s, d), 10).withColumn("score", F.when(F.col("query_id") % 3 != 0, F.col("score"))).filter("query_id % 6 <> 0 OR rank <= query_id % 7 + 1")),
    "source_links": lambda s, d: ops.source_links(rich(s, d)),
    "format_context": lambda s, d: ops.format_context(rich(s, d)),
    "build_context": _context,
    "retrieve_batch": _retrieved,
    "eval_retrieval": _evaluated,
    "eval_misses": _missed,
    "sample_eval_chunks": lambda s, d: ops.sample_eval_chunks(docs(s, d), 60).select("doc_id"),
}

ORACLES = {
    "bm25_postings": f"WITH {SQL_POSTINGS} SELECT doc_id, term, doc_len, tf FROM postings",
    "bm25_idf": f"WITH {SQL_POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "search_bm25": f"WITH {SQL_BM25} SELECT * FROM bm",
    "search_dense": "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10",
    "lexical_rerank": f"WITH {SQL_BM25}, {SQL_COVER} SELECT * FROM cover",
    "fuse_rrf": f"WITH {SQL_BM25}, {SQL_COVER}, {SQL_FUSED} SELECT * FROM rrf",
    "dynamic_threshold": f"WITH {SQL_THRESHOLDS} SELECT * FROM thresholds",
    "rerank_and_cut": f"WITH {SQL_BM25}, {SQL_COVER}, {SQL_THRESHOLDS}, {SQL_CUT.format(from_='bm', most=30, limit=10)}",
    "threshold_min_one": f"WITH {SQL_BM25}, {SQL_COVER}, {SQL_THRESHOLDS} SELECT query_id, doc_id, score, rank, threshold FROM reranked JOIN thresholds USING (query_id) WHERE rank <= 10 AND (score >= threshold OR rank = 1)",
    "answer_confidence": f"WITH {SQL_BM25}, {SQL_COVER}, m AS (SELECT query_id, CASE WHEN query_id % 3 <> 0 THEN avg(score) FILTER (rank <= 3) END AS a, count(*) AS n FROM reranked WHERE rank <= 10 AND (query_id % 6 <> 0 OR rank <= query_id % 7 + 1) GROUP BY query_id) SELECT query_id, round(CASE WHEN a IS NULL THEN CASE WHEN n >= 6 THEN 0.8 WHEN n >= 4 THEN 0.65 WHEN n >= 2 THEN 0.5 ELSE 0.35 END WHEN a >= 0.7 THEN least(0.95, a) WHEN a >= 0.4 THEN 0.6 + (a - 0.4) * 0.5 WHEN a >= 0.2 THEN 0.3 + (a - 0.2) * 1.5 ELSE greatest(0.1, a) END, 4) AS confidence FROM m",
    "source_links": f"WITH {SQL_BM25}, {SQL_RICH}, f AS (SELECT query_id, link, min(rank) AS rank FROM rich GROUP BY query_id, link) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, link FROM f QUALIFY place <= 3",
    "format_context": rf"""WITH {SQL_BM25}, {SQL_RICH}, e AS (SELECT query_id, rank, format('[{{}}] {{}} [Source: {{}}] [Score: {{:.3f}}]' || chr(10) || '{{}}' || chr(10), rank, title, source, score, text) AS entry FROM rich),
        u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM e) SELECT query_id, string_agg(entry, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM u WHERE used <= 8000 GROUP BY query_id""",
    "build_context": rf"""WITH {SQL_BM25}, {SQL_RICH}, g AS (SELECT query_id, link || chr(39) AS ref, min(rank) AS place, max(score) AS score, arg_min(source, rank) AS source, string_agg(text || '</document> end', chr(10) || chr(10) ORDER BY rank) AS t FROM rich WHERE rank <= 8 GROUP BY query_id, link),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n, CASE WHEN length(t) > 4000 THEN t[1:4000] || '...' ELSE t END AS body FROM g),
        w AS (SELECT query_id, n, '<document index="' || n || '" source="' || source || '" ref="' || ref || '" relevance="' || format('{{:.2f}}', score) || '">' || chr(10) || replace(body, '</document>', '<\/document>') || chr(10) || '</document>' AS doc FROM n),
        b AS (SELECT *, (12000 - (sum(length(doc)) OVER (PARTITION BY query_id ORDER BY n) - length(doc)))::BIGINT AS room FROM w),
        p AS (SELECT query_id, n, CASE WHEN length(doc) <= room THEN doc WHEN room > 200 THEN doc[1:room] || '...' END AS doc FROM b UNION ALL SELECT item_id, 0, '[Knowledge Graph Relationships]' || chr(10) || 'Part: p' || item_id FROM benchmark WHERE item_id % 4 = 0)
        SELECT query_id, coalesce(string_agg(doc, chr(10) ORDER BY n), '') AS context FROM p GROUP BY query_id""",
    "retrieve_batch": f"WITH benchmark AS (SELECT item_id, {SQL_NAMED} AS text FROM benchmark), {SQL_POSTINGS}, {SQL_ASKED}, {SQL_MERGED}, {SQL_THRESHOLDS}, {SQL_CUT.format(from_='merged', most=15, limit=5)}",
    "eval_retrieval": f"""WITH {SQL_BM25}, expected AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        hits AS (SELECT query_id, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS gain FROM bm JOIN expected USING (query_id, doc_id) GROUP BY query_id)
        SELECT count(*) AS queries, round(avg(coalesce((first <= 10)::INT, 0)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(coalesce(gain, 0)), 6) AS ndcg FROM (SELECT DISTINCT query_id FROM expected) LEFT JOIN hits USING (query_id)""",
    "eval_misses": rf"WITH benchmark AS (SELECT item_id, regexp_extract(text, '{SHORT}') AS text FROM benchmark), {SQL_BM25}, expected AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), hits AS (SELECT query_id, min(rank) AS best FROM bm JOIN expected USING (query_id, doc_id) GROUP BY query_id) SELECT query_id, best FROM (SELECT DISTINCT query_id FROM expected) LEFT JOIN hits USING (query_id) WHERE best IS NULL OR best > 3",
    "sample_eval_chunks": "SELECT doc_id FROM documents WHERE length(text) > 100 ORDER BY md5(doc_id || ':7'), doc_id LIMIT 60",
}
