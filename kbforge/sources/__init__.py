"""Readers and writers of files: markdown, text folders, sitemaps, catalog sheets, mail threads, terminology."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbforge.functions.text import term_transforms

FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n"
MESSAGE = "struct<headers:array<struct<name:string,value:string>>,body:struct<data:string>,parts:array<struct<mimeType:string,body:struct<data:string>,parts:array<struct<mimeType:string,body:struct<data:string>>>>>>"
THREAD = f"thread_id string, messages array<struct<id:string,snippet:string,payload:{MESSAGE}>>"


def front_matter(text: Column) -> tuple[Column, Column]:
    """The keys and values before a text, and the text. Comments, lines without a colon and empty values are left out."""
    lines = F.split(F.regexp_extract(text, FRONT, 1), r"\r?\n")
    used = F.filter(lines, lambda x: x.contains(":") & ~F.startswith(F.trim(x), F.lit("#")))
    pairs = F.transform(used, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"""^["']|["']$""", "").alias("value")))
    kept = F.filter(pairs, lambda p: p["value"] != "")
    # Of a key given twice the last value counts.
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last), F.regexp_replace(text, FRONT, "")


def read_markdown_corpus(spark: SparkSession, path: str, base_url: str = "", least: int = 100, endings: tuple[str, ...] = ("md", "mdx")) -> DataFrame:
    """``path, title, url, keywords, text`` of all files with the given endings whose names do not begin with ``_``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(endings) + "}")
    ending = r"\.(?:" + "|".join(map(re.escape, endings)) + ")$"
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value").filter(~F.startswith("name", F.lit("_")))
    front, body = front_matter(F.col("value"))
    rows = rows.select("path", F.regexp_replace("name", ending, "").alias("stem"), front.alias("front"), F.trim(body).alias("body")).filter(F.length("body") >= least)
    head = lambda p: F.nullif(F.trim(F.regexp_extract("body", p, 1)), F.lit(""))
    title = F.coalesce(F.element_at("front", "title"), head(r"(?m)^#\s+(.+)$"), head(r"(?m)^##\s+(.+)$"), "stem")
    under = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", ending, ""), "^.*" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/", ""), r"/index$", "")
    url = F.concat(F.lit(base_url), F.regexp_replace(F.coalesce(F.element_at("front", "slug"), under), "^/", ""))
    listed = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.element_at("front", "keywords"), F.lit("")), r"[\[\]\"']", ""), ","), lambda k: F.trim(k)), lambda k: k != "")
    return rows.select("path", title.alias("title"), url.alias("url"), listed.alias("keywords"), term_transforms(F.col("body")).alias("text"))


def read_text_folder(spark: SparkSession, path: str, category: str, tags: list[str]) -> DataFrame:
    """Text and markdown files as documents titled by their names; those of fewer than 10 characters are left out."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}")
    title = F.initcap(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]+$", ""), "[_-]", " "))
    rows = files.select(title.alias("title"), F.trim("value").alias("text"), F.lit(category).alias("category"), F.array(*map(F.lit, tags)).alias("tags"))
    return rows.filter(F.length("text") >= 10)


def parse_sitemap(xml: DataFrame) -> DataFrame:
    """``loc, lastmod`` of the ``url`` blocks in ``value``; tag, search and download pages are left out."""
    blocks = xml.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("b"))
    take = lambda t: F.nullif(F.trim(F.regexp_extract("b", f"(?s)<{t}>(.*?)</{t}>", 1)), F.lit(""))
    return blocks.select(take("loc").alias("loc"), take("lastmod").alias("lastmod")).filter("loc IS NOT NULL").filter(~F.col("loc").rlike("/(tags|search|download)"))


SHEET = {"Name": "name", "Manufacturer": "manufacturer", "Code Model": "code_model", "Device Type": "device_type", "Ports": "ports", "Protocols": "protocols", "Supported Controls": "controls", "Notes": "notes", "Doc URL": "doc_url", "Manufacturer URL": "manufacturer_url"}
SHEET_LISTS = ("ports", "protocols", "controls", "notes")


def read_catalog_csv(spark: SparkSession, path: str, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Catalog rows, and the rows that are refused for want of a name."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in SHEET)).csv(path, header=True).withColumnsRenamed(SHEET)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    rows = raw.select(*(cut(F.col(c)).alias(c) if c in SHEET_LISTS else blank(F.col(c)).alias(c) for c in SHEET.values()))
    rows = rows.withColumn("device_type", F.when(F.col("device_type").isin(*types), F.col("device_type")))
    return rows.filter("name IS NOT NULL"), rows.filter("name IS NULL")


def write_catalog_csv(items: DataFrame, path: str, maker: str | None = None) -> None:
    rows = items.filter(F.lower("manufacturer") == maker.lower()) if maker else items
    shown = [(F.array_join(c, "|") if c in SHEET_LISTS else F.coalesce(c, F.lit(""))).alias(h) for h, c in SHEET.items()]
    rows.orderBy("manufacturer", "name").select(*shown).write.csv(path, header=True, emptyValue="")


def read_mail_threads(spark: SparkSession, path: str) -> DataFrame:
    """``thread_id, subject, text, message_count`` of exported threads; the body is the message's, else its first plain part."""

    def plain(parts: Column) -> Column:
        return F.get(F.filter(parts, lambda p: p["mimeType"] == "text/plain"), F.lit(0))["body"]["data"]

    def decoded(data: Column) -> Column:
        return F.decode(F.unbase64(F.translate(data, "-_", "+/")), "UTF-8")

    def header(m: Column, name: str) -> Column:
        return F.get(F.filter(m["payload"]["headers"], lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]

    def shown(m: Column) -> Column:
        parts = m["payload"]["parts"]
        inner = F.flatten(F.transform(parts, lambda p: F.coalesce(p["parts"], F.array().cast("array<struct<mimeType:string,body:struct<data:string>>>"))))
        body = F.coalesce(decoded(m["payload"]["body"]["data"]), decoded(plain(parts)), decoded(plain(inner)), F.lit(""))
        return F.concat(F.lit("**From:** "), F.coalesce(header(m, "from"), F.lit("")), F.lit("\n**Date:** "), F.coalesce(header(m, "date"), F.lit("")), F.lit("\n\n"), body)

    rows = spark.read.schema(THREAD).json(path)
    subject = F.coalesce(header(F.get("messages", F.lit(0)), "subject"), F.lit("No Subject"))
    text = F.concat(F.lit("# Support Case: "), subject, F.lit("\n\n"), F.array_join(F.transform("messages", shown), "\n\n---\n\n"))
    return rows.select("thread_id", subject.alias("subject"), text.alias("text"), F.size("messages").alias("message_count"))


def read_fixes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Terminology fixes from an export, with defaults for what is missing; ``lines`` for exports of ``write_fixes``."""
    fix = "struct<id:string,chunk_id:string,collection:string,original_text:string,suggested_text:string,suggestion_type:string,confidence:double,reasoning:string,status:string>"
    rows = spark.read.schema(f"exported_at string, total long, fixes array<{fix}>").json(path, multiLine=not lines)
    return rows.select(F.inline("fixes")).withColumns({"reasoning": F.coalesce("reasoning", F.lit("")), "status": F.coalesce("status", F.lit("pending"))})


def write_fixes(fixes: DataFrame, path: str) -> None:
    """One JSON object a line; an export that is read back by Spark needs no single document."""
    fixes.select(F.array(F.struct(*fixes.columns)).alias("fixes")).write.json(path)
