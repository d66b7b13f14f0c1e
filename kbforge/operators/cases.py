"""Support-case tables, mail bodies, and full-text search over catalogs and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbforge.operators import retrieval

#: Lines of a mail body that are no content.
FOOTERS = (r"^Sent from my", r"^Envoyé de mon", r"^Get Outlook for", r"^_+$", r"^\*{3,}", r"^This email and any", r"^Ce message et toutes", r"^Confidential", r"^CONFIDENTIAL")
HEADS = (r"^(On|Le) .+ wrote:$", r"^From:|^To:|^Cc:|^Date:|^Subject:")


def clean_email_text(body: Column) -> Column:
    """The body up to the first signature mark, without quoted lines, heads and footers, blank lines collapsed."""
    lines = F.split(body, "\n")
    marks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*--\S?\s*$"), i)), lambda i: i.isNotNull())
    kept = F.slice(lines, F.lit(1), F.coalesce(F.get(marks, F.lit(0)), F.size(lines)))
    dropped = "|".join([f"(?i:{p})" for p in FOOTERS] + ["^>", *HEADS])
    lines = F.filter(kept, lambda x: ~F.regexp_replace(x, r"^\s+|\s+$", "").rlike(dropped))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def bm25_text(text: Column, keywords: Column) -> Column:
    """A chunk's text for the index: the document's keywords follow on a line of their own."""
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, F.concat(text, F.lit("\n"), F.array_join(keywords, " "))).otherwise(text)


def upsert_cases(cases: DataFrame, incoming: DataFrame) -> DataFrame:
    """By ``thread_id``: new values stand, the thread's raw text is kept where none comes, so is ``ingested_at``."""
    new = incoming.select("thread_id", *(F.col(c).alias(f"_{c}") for c in incoming.columns if c != "thread_id"), F.lit(True).alias("_hit"))
    both = cases.join(new, "thread_id", "full_outer")
    pick = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cases.columns if c not in ("thread_id", "raw_thread", "ingested_at")}
    return both.withColumns(pick | {"raw_thread": F.coalesce("_raw_thread", "raw_thread"), "ingested_at": F.coalesce("ingested_at", "_ingested_at")}).select(cases.columns)


def backfill_cases(cases: DataFrame, messages: DataFrame) -> DataFrame:
    """First message's time and the thread's text, only where a case lacks them; ``messages`` has ``thread_id, at, text``."""
    order = F.array_sort(F.collect_list(F.struct("at", "text")))
    found = messages.groupBy("thread_id").agg(F.min("at").alias("_at"), F.array_join(F.transform(order, lambda m: m["text"]), "\n").alias("_raw"))
    return cases.join(found, "thread_id", "left").withColumns({"created_at": F.coalesce("created_at", "_at"), "raw_thread": F.coalesce("raw_thread", "_raw")}).drop("_at", "_raw")


def page_of(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page with the total of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def list_cases(cases: DataFrame, category: str | None = None, product: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    rows = cases.filter(F.col("category") == category) if category else cases
    rows = rows.filter(F.col("product") == product) if product else rows
    return page_of(rows, [F.desc("created_at"), "thread_id"], offset, limit)


def list_fixes(fixes: DataFrame, status: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    return page_of(fixes.filter(F.col("status") == status) if status else fixes, [F.desc("created_at"), "id"], offset, limit)


#: Shops behind the makers' own sites, and words in an address with what they add.
SHOPS = ("bhphotovideo.com", "adorama.com", "fullcompass.com")
URL_WORDS = ((2.0, ("spec", "product", "detail", "feature", "overview")), (1.5, ("professional", "broadcast", "cinema", "pro.")), (-5.0, ("review", "forum", "blog", "news", "video", "youtube")))


def rank_urls(urls: DataFrame, makers: list[str], most: int = 2) -> DataFrame:
    """``item_id, url, score``: the best urls of an item by the order of domains (makers', then shops) and words in the address."""
    low = F.lower("url")
    score = F.lit(0.0)
    for i, domain in reversed(list(enumerate([*makers, *SHOPS]))):
        score = F.when(low.contains(domain), 10 - 0.5 * i).otherwise(score)
    for more, words in URL_WORDS:
        some = F.lit(False)
        for word in words:
            some = some | low.contains(word)
        score = score + F.when(some, more).otherwise(0.0)
    ranked = urls.filter("url <> ''").withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "url")))
    return ranked.filter(F.col("r") <= most).select("item_id", "url", "score")


def search_dense_merged(parts: dict[str, DataFrame], queries: DataFrame, limit: int = 10, least: float = 0.25) -> DataFrame:
    """Dense hits of several tables with their source, best first over all."""
    out = None
    for source, vectors in parts.items():
        one = retrieval.search_dense(vectors, queries, limit, least).select("query_id", "vec_id", "score", F.lit(source).alias("source"))
        out = one if out is None else out.unionByName(one)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "source")))
    return ranked.filter(F.col("rank") <= limit)
