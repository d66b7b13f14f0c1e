"""Case tables, mail bodies and full-text search over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions.storage import read_table
from kbforge.operators import cases as ops, fulltext
from kbforge.plans import corpus, retrieval
from kbforge.plans.corpus import docs

ITEM_TEXT = "concat_ws(' ', p_name, p_brand, p_type)"


def _cases(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").selectExpr("doc_id AS thread_id", "lang AS category", "source AS product", "CASE WHEN doc_id % 2 = 0 THEN doc_id END AS created_at", "CASE WHEN doc_id % 3 = 0 THEN 'raw' END AS raw_thread", "doc_id AS ingested_at")


def _new(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").filter("doc_id % 4 = 0").selectExpr("doc_id * 2 AS thread_id", "'new' AS category", "source AS product", "doc_id AS created_at", "CASE WHEN doc_id % 8 = 0 THEN 'newer' END AS raw_thread", "-1L AS ingested_at")


def _messages(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "conversations").selectExpr("conv_id AS thread_id", "turn AS at", "text")


def _searched(s: SparkSession, d: str) -> DataFrame:
    items = read_table(s, d, "part").selectExpr("p_partkey AS doc_id", f"{ITEM_TEXT} AS text")
    words = s.createDataFrame([(1, "ri"), (2, "widg economy"), (3, "brand red"), (4, "zzz")], "query_id long, text string")
    return fulltext.search(fulltext.build(items), words, 20)


def _found_cases(s: SparkSession, d: str) -> DataFrame:
    return fulltext.search(fulltext.build(retrieval.docs(s, d), stem=True), retrieval.questions(s, d), 20)


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return ops.rank_urls(read_table(s, d, "pages").select((F.col("page_id") % 40).alias("item_id"), "url"), ["example.net", "example.org", "example.com"])


def _dense(s: SparkSession, d: str) -> DataFrame:
    v = read_table(s, d, "embeddings")
    return ops.search_dense_merged({"docs": v.filter("vec_id % 2 = 0"), "cases": v.filter("vec_id % 2 = 1")}, v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 8)


def _mail(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("From: x\nOn Monday Y wrote:\n> q\n"), "text", F.lit("\n\n\n\nend\n--\nsig"))
    return read_table(s, d, "conversations").select("conv_id", "turn", F.md5(ops.clean_email_text(body)).alias("digest"))


QUERIES = {
    "upsert_cases": lambda s, d: ops.upsert_cases(_cases(s, d), _new(s, d)),
    "backfill_cases": lambda s, d: ops.backfill_cases(_cases(s, d), _messages(s, d)).select("thread_id", "created_at", F.md5("raw_thread").alias("digest")),
    "list_cases": lambda s, d: ops.list_cases(_cases(s, d), "en", None, 3, 30).select("thread_id", "product", "total"),
    "fts_search_catalog": _searched,
    "rank_urls": _ranked,
    "fts_search_cases": _found_cases,
    "stem_terms": lambda s, d: fulltext.stemmed(retrieval.docs(s, d)).select("doc_id", "term", "tf"),
    "list_fixes": lambda s, d: ops.list_fixes(corpus.fixes(s, d).withColumn("created_at", F.col("id")), "pending", 5, 30).select("id", "original_text", "total"),
    "search_dense_merged": _dense,
    "clean_email_text": _mail,
    "bm25_text": lambda s, d: docs(s, d).select("doc_id", F.md5(ops.bm25_text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("k1"), F.lit("k2"))))).alias("digest")),
}

_C = "c AS (SELECT doc_id AS thread_id, lang AS category, source AS product, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS created_at, CASE WHEN doc_id % 3 = 0 THEN 'raw' END AS raw_thread, doc_id AS ingested_at FROM documents)"
ORACLES = {
    "upsert_cases": f"WITH {_C}, n AS (SELECT doc_id * 2 AS thread_id, 'new' AS category, source AS product, doc_id AS created_at, CASE WHEN doc_id % 8 = 0 THEN 'newer' END AS raw_thread, -1 AS ingested_at FROM documents WHERE doc_id % 4 = 0) SELECT thread_id, CASE WHEN n.category IS NOT NULL THEN n.category ELSE c.category END AS category, CASE WHEN n.category IS NOT NULL THEN n.product ELSE c.product END AS product, CASE WHEN n.category IS NOT NULL THEN n.created_at ELSE c.created_at END AS created_at, coalesce(n.raw_thread, c.raw_thread) AS raw_thread, coalesce(c.ingested_at, n.ingested_at) AS ingested_at FROM c FULL JOIN n USING (thread_id)",
    "backfill_cases": f"WITH {_C}, m AS (SELECT conv_id AS thread_id, min(turn) AS first, string_agg(text, chr(10) ORDER BY turn) AS raw FROM conversations GROUP BY conv_id) SELECT thread_id, coalesce(created_at, first) AS created_at, md5(coalesce(raw_thread, raw)) AS digest FROM c LEFT JOIN m USING (thread_id)",
    "list_cases": f"WITH {_C} SELECT thread_id, product, (SELECT count(*) FROM c WHERE category = 'en') AS total FROM c WHERE category = 'en' ORDER BY created_at DESC NULLS LAST, thread_id LIMIT 30 OFFSET 3",
    "fts_search_catalog": f"""WITH documents AS (SELECT p_partkey AS doc_id, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part), {retrieval.SQL_POSTINGS}, q(query_id, t) AS (VALUES (1, 'ri'), (2, 'widg'), (2, 'economy'), (3, 'brand'), (3, 'red'), (4, 'zzz')),
        p AS (SELECT DISTINCT query_id, term FROM q JOIN (SELECT DISTINCT term FROM postings) ON starts_with(term, t)),
        s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score FROM postings JOIN idf USING (term) JOIN p USING (term), size GROUP BY query_id, doc_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20""",
    "rank_urls": "WITH u AS (SELECT page_id % 40 AS item_id, url, lower(url) AS l FROM pages), s AS (SELECT item_id, url, (CASE WHEN contains(l, 'example.net') THEN 10 WHEN contains(l, 'example.org') THEN 9.5 WHEN contains(l, 'example.com') THEN 9 ELSE 0 END + CASE WHEN regexp_matches(l, 'spec|product|detail|feature|overview') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(l, 'professional|broadcast|cinema|pro[.]') THEN 1.5 ELSE 0 END - CASE WHEN regexp_matches(l, 'review|forum|blog|news|video|youtube') THEN 5 ELSE 0 END)::DOUBLE AS score FROM u) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, url) <= 2",
    "search_dense_merged": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, CASE WHEN v.vec_id % 2 = 0 THEN 'docs' ELSE 'cases' END AS source FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, source) AS rank FROM s WHERE score >= 0.25 QUALIFY rank <= 8",
    "list_fixes": "SELECT doc_id AS id, substring(text, 5, 6) AS original_text, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS total FROM documents WHERE doc_id % 2 = 0 ORDER BY doc_id DESC LIMIT 30 OFFSET 5",
    "clean_email_text": r"""WITH b AS (SELECT conv_id, turn, string_split('From: x' || chr(10) || 'On Monday Y wrote:' || chr(10) || '> q' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'end' || chr(10) || '--' || chr(10) || 'sig', chr(10)) AS l FROM conversations),
        c AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '^\s*--\S?\s*$')), true) AS sign FROM b),
        k AS (SELECT conv_id, turn, list_filter(l[1:sign - 1], lambda x: NOT regexp_matches(trim(x), '^>|^(On|Le) .+ wrote:$|^(From|To|Cc|Date|Subject):|(?i:^(Sent from my|Envoyé de mon|Get Outlook for|_+$|\*{3,}|This email and any|Ce message et toutes|Confidential))')) AS l FROM c)
        SELECT conv_id, turn, md5(trim(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM k""",
    "bm25_text": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || 'k1 k2' ELSE text END) AS digest FROM documents",
}
