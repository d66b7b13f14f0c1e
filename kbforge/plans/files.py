"""Readers and writers of files over files that Spark writes from the standard tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge import sources as ops
from kbforge.functions.storage import read_table, shared_dir
from kbforge.plans import catalog, corpus


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _one_a_file(rows: DataFrame, path: str) -> None:
    """Each row of ``value`` as a file of its own. All cores write, however few the bytes, and tasks give their files the last names
    themselves; else the driver would rename one after the other."""
    rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def _talks(s: SparkSession, d: str) -> DataFrame:
    """``conv_id, text``: a row for each conversation."""
    turns = read_table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def _front(s: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("---\ntitle: T"), F.col("doc_id"), F.lit("\n# note: none\nkind: 'a: b'\nempty:\nkind: \"c\"\n---\n"), "text")
    front, body = ops.front_matter(head)
    return read_table(s, d, "documents").select("doc_id", F.element_at(front, "title").alias("title"), F.element_at(front, "kind").alias("kind"), F.element_at(front, "empty").alias("empty"), F.md5(body).alias("digest"))


def _markdown(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "markdown")
    head = F.concat(F.lit("---\ntitle: Talk "), F.col("conv_id"), F.lit("\nslug: /talks/"), F.col("conv_id"), F.lit("\nkeywords: [k"), F.col("conv_id") % 7, F.lit(", 'talk']\n---\n"), "text")
    _one_a_file(_talks(s, d).select(head.alias("value")), path)
    rows = ops.read_markdown_corpus(s, path, "https://host/", 100, ("txt",))
    return rows.select("title", "url", F.array_join("keywords", ",").alias("keywords"), F.length("text").alias("n_chars"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "texts")
    _one_a_file(_talks(s, d).select(F.col("text").alias("value")), path)
    return ops.read_text_folder(s, path, "talks", ["a", "b"]).select(F.md5("text").alias("digest"), "category", F.array_join("tags", ",").alias("tags"))


def _sitemap(s: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit("<url>\n<loc> "), "url", F.lit("</loc>"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    xml = read_table(s, d, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("k")).agg(F.array_join(F.collect_list(block), "\n").alias("value"))
    return ops.parse_sitemap(xml)


def _items(s: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return catalog.items(s, d).withColumns({"protocols": F.array(F.lit("p q"), F.concat(F.lit("x"), F.col("id") % 3)), "controls": none, "notes": none, "doc_url": F.lit("https://h/?a=1,2"), "manufacturer_url": F.lit(None).cast("string")})


def _sheet(s: SparkSession, d: str, maker: str | None) -> DataFrame:
    path = _folder(s, "sheet")
    ops.write_catalog_csv(_items(s, d), path, maker)
    rows, _ = ops.read_catalog_csv(s, path, ["STANDARD BRASS", "ECONOMY TIN"])
    return rows.select("name", "manufacturer", "code_model", "device_type", F.array_join("ports", ",").alias("ports"), F.array_join("protocols", ",").alias("protocols"), "doc_url")


def _mails(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "mails")
    head = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("From", F.concat("role", F.lit("@x.org"))), ("Date", F.concat(F.lit("d"), "turn")), ("Subject", F.concat(F.lit("S"), "conv_id")))))
    data = F.struct(F.translate(F.base64(F.encode("text", "UTF-8")), "+/", "-_").alias("data"))
    part = F.array(F.struct(F.lit("text/plain").alias("mimeType"), data.alias("body")))
    payload = F.struct(head.alias("headers"), F.when(F.col("turn") % 2 == 0, data).alias("body"), F.when(F.col("turn") % 2 == 1, part).alias("parts"))
    turns = read_table(s, d, "conversations").select("conv_id", F.struct("turn", payload.alias("payload")).alias("m"))
    threads = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("m"), lambda a, b: F.signum(a["turn"] - b["turn"]).cast("int")), lambda m: F.struct(m["payload"].alias("payload"))).alias("messages"))
    threads.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("thread_id"), "messages")).alias("value")).write.text(path)
    return ops.read_mail_threads(s, path).select("thread_id", "subject", F.md5("text").alias("digest"), "message_count")


def _terms(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "fixes")
    ops.write_fixes(corpus.fixes(s, d).select(F.col("id").cast("string").alias("id"), "original_text", "suggested_text", "confidence", F.when(F.col("id") % 3 != 0, F.col("status")).alias("status")), path)
    return ops.read_fixes(s, path, lines=True).select("id", "original_text", "confidence", "status", "reasoning")


QUERIES = {
    "parse_front_matter": _front,
    "read_markdown_corpus": _markdown,
    "read_text_folder": _texts,
    "parse_sitemap": _sitemap,
    "read_catalog_csv": lambda s, d: _sheet(s, d, None),
    "write_catalog_csv": lambda s, d: _sheet(s, d, "brand#3"),
    "read_mail_threads": _mails,
    "terminology_json_io": _terms,
}

_TALKS = "talks AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"
_SHEET = f"WITH {catalog.SQL_ITEMS} SELECT trim(name) AS name, manufacturer, code_model, CASE WHEN device_type IN ('STANDARD BRASS', 'ECONOMY TIN') THEN device_type END AS device_type, array_to_string(ports, ',') AS ports, 'p q,x' || (id % 3) AS protocols, 'https://h/?a=1,2' AS doc_url FROM items"
ORACLES = {
    "parse_front_matter": "SELECT doc_id, 'T' || doc_id AS title, 'c' AS kind, NULL::VARCHAR AS empty, md5(text) AS digest FROM documents",
    "read_markdown_corpus": f"WITH {_TALKS} SELECT 'Talk ' || conv_id AS title, 'https://host/talks/' || conv_id AS url, 'k' || (conv_id % 7) || ',talk' AS keywords, length(t) + 1 AS n_chars FROM talks WHERE length(t) >= 99",
    "read_text_folder": f"WITH {_TALKS} SELECT md5(ltrim(t) || chr(10)) AS digest, 'talks' AS category, 'a,b' AS tags FROM talks WHERE length(ltrim(t)) >= 9",
    "parse_sitemap": "SELECT url AS loc, CASE WHEN page_id % 3 = 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS lastmod FROM pages WHERE url <> '' AND NOT regexp_matches(url, '/(tags|search|download)')",
    "read_catalog_csv": _SHEET,
    "write_catalog_csv": _SHEET + " WHERE lower(manufacturer) = 'brand#3'",
    "read_mail_threads": "SELECT conv_id::VARCHAR AS thread_id, 'S' || conv_id AS subject, md5('# Support Case: S' || conv_id || chr(10) || chr(10) || string_agg('**From:** ' || role || '@x.org' || chr(10) || '**Date:** d' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS message_count FROM conversations GROUP BY conv_id",
    "terminology_json_io": "SELECT doc_id::VARCHAR AS id, substring(text, 5, 6) AS original_text, doc_id % 10 / 10.0::DOUBLE AS confidence, CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN 'pending' ELSE 'approved' END AS status, '' AS reasoning FROM documents",
}
