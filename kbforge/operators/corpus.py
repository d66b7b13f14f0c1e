"""Documents to chunk tables, upserts, rebuilt documents, support cases and terminology fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbforge.functions import helpers
from kbforge.functions.storage import materialize
from kbforge.functions.text import found_pii, uuid5_dns
from kbforge.operators import retrieval

SIZES = {"support_case": 350, "documentation": 450}
CATEGORY_TYPES = {"troubleshooting": "support_case", "configuration": "support_case", "faq": "faq", "release_notes": "release_notes"}
#: Phrases of returns in subjects and bodies, case aside.
RMA_SUBJECT = (r"\bRMA\b", r"\breturn\s+(request|authorization|merchandise)\b", r"\brefund\s+(request|processing)\b", r"\breplacement\s+(request|unit|device)\b")
RMA_BODY = (
    r"\bRMA\s*(number|#|:)?\s*\d+", r"\breturn\s+(shipping\s+)?label\b", r"\breplacement\s+shipment\b", r"\breturn\s+the\s+(defective|faulty)\s+(unit|device)\b",
    r"\bship\s+(back|to\s+us)\b", r"\breturn\s+address\b",
)


def chunk_rows(docs: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    """A row for each chunk: deterministic id, parent, index, number of chunks; map-only."""
    # An inner explode would put a filter by the array's size below, which works all chunks out once more.
    rows = docs.select(key, chunks.alias("c")).select(key, F.size("c").alias("total_chunks"), F.posexplode_outer("c").alias("chunk_index", "c")).filter("chunk_index IS NOT NULL")
    name = F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string"))
    return rows.select(uuid5_dns(name).alias("chunk_id"), key, "chunk_index", "total_chunks", "c.text", "c.section", "c.kind")


def content_type(category: Column) -> Column:
    """The type of content that a custom document's category stands for."""
    table = F.create_map(*(F.lit(x) for pair in CATEGORY_TYPES.items() for x in pair))
    return F.coalesce(F.element_at(table, category), F.lit("generic"))


def chunk_size(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SIZES.items() for x in pair))
    return F.coalesce(F.element_at(table, kind), F.lit(400))


def upsert_chunks(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows by ``collection, chunk_id``; of one id the latest ``batch`` stays."""
    order = Window.partitionBy("collection", "chunk_id").orderBy(F.desc("batch"))
    return table.unionByName(incoming).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def replace_by_field(table: DataFrame, incoming: DataFrame, field: str) -> DataFrame:
    """All rows whose ``field`` is among the incoming ones' give way to them."""
    return table.join(incoming.select(field).distinct(), field, "left_anti").unionByName(incoming)


def scan_new_pages(site: DataFrame, indexed: DataFrame) -> DataFrame:
    known = indexed.select("url").distinct().withColumn("known", F.lit(True))
    return site.select("url").distinct().join(known, "url", "left").select("url", F.when(F.col("known"), "indexed").otherwise("new").alias("status"))


def allowed_urls(pages: DataFrame, suffixes: list[str]) -> DataFrame:
    """http(s) urls on an allowed host or below it; loopback names and raw addresses go."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | (host == s) | F.endswith(host, F.lit("." + s))
    return pages.filter(fits & ~host.rlike(r"^(localhost|\d{1,3}(\.\d{1,3}){3})$"))


def rebuild_documents(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts in the order of their chunks; null and empty texts are passed over."""
    rows = chunks.filter(F.col(key).isNotNull())
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("chunk_index", "text"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(texts, lambda c: c["text"]), "\n\n").alias("text"), F.count("*").alias("chunks"))


def list_documents(docs: DataFrame, as_of: Column, category: str | None = None, expired: bool = False, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page, newest first, with a preview and the total; expired ones only if asked for."""
    rows = docs.withColumn("is_expired", F.coalesce(F.col("expires") < as_of, F.lit(False)))
    rows = rows if expired else rows.filter("NOT is_expired")
    rows = rows.filter(F.col("category") == category) if category else rows
    total = rows.agg(F.count("*").alias("total"))
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    page = rows.orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)
    return page.select("doc_id", "is_expired", preview.alias("preview")).crossJoin(F.broadcast(total))


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"), F.count_distinct("url").alias("urls"))


#: Terms that may be broadcast with their idf.
KNOWN_TERMS = 500_000


def document_keywords(docs: DataFrame, n: int = 6, custom: int = 10) -> DataFrame:
    """``doc_id, keywords``: the ``n`` terms of the highest TF-IDF, joined by commas.

    Where ``docs`` has ``tags`` and they are not null, a document is a user's own: its tags come first, trimmed and in lower
    case, then up to ``custom`` terms, each word once.
    """
    tagged = docs if "tags" in docs.columns else docs.withColumn("tags", F.lit(None).cast("array<string>"))
    postings = retrieval.bm25_postings(docs).filter(F.length("term") > 3)
    idf = retrieval.bm25_idf(postings, docs.agg(F.count("*").alias("n")))
    # Frequent terms, which make up most postings, meet their idf by a broadcast; if there are no more terms than that, all do.
    known = materialize(idf.select("term", "idf", "df"), "idf")
    if known.count() > KNOWN_TERMS:
        often = known.orderBy(F.desc("df"), "term").limit(KNOWN_TERMS).select("term", "idf")
        often = F.broadcast(materialize(often, "often"))
        seldom = postings.join(often.select("term"), "term", "left_anti").join(known.select("term", "idf"), "term")
        met = postings.join(often, "term").unionByName(seldom)
    else:
        met = postings.join(F.broadcast(known.select("term", "idf")), "term")
    scored = met.withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))).filter(F.col("r") <= max(n, custom))
    top = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    tags, none = F.transform("tags", lambda t: F.trim(F.lower(t))), F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(tags, none), F.slice(F.coalesce("terms", none), F.lit(1), F.when(F.col("tags").isNotNull(), custom).otherwise(n))))
    return tagged.select("doc_id", "tags").join(top, "doc_id", "left").filter("terms IS NOT NULL OR tags IS NOT NULL").select("doc_id", F.array_join(both, ",").alias("keywords"))


def pii_counts(turns: DataFrame, thread: str = "conv_id") -> DataFrame:
    """Distinct serials, addresses and phone numbers of each thread."""
    serials, emails, phones = found_pii(F.col("text"))
    size = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    return turns.groupBy(thread).agg(size(serials).alias("serials"), size(emails).alias("emails"), size(phones).alias("phones"))


def _numbered(keys: DataFrame, group: list[str], first: str) -> DataFrame:
    """``number`` of each row within its group in the order of ``first``; a large group is cut into ranges."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(keys.repartitionByRange(parts, *group, first).withColumn("block", F.spark_partition_id()), "ranges")
    blocks = dealt.groupBy(*group, "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*group, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = dealt.withColumn("r", F.row_number().over(Window.partitionBy("block", *group).orderBy(first)))
    return own.join(offsets, [*group, "block"]).withColumn("number", F.col("offset") + F.col("r")).drop("r", "offset", "block")


def anonymize_threads(turns: DataFrame, thread: str = "conv_id", order: str = "turn", own_domain: str = "") -> DataFrame:
    """Turns with placeholders that are shared within a thread, numbered by first appearance.

    Placeholders are found turn by turn; only their distinct keys meet by thread. Of turns at one place the order is that of
    a hash of the text.
    """

    def cut_up(text: str | None) -> dict:
        parts, tail = helpers.pii_parts(text, own_domain)
        return {"parts": [{"literal": a, "label": b, "key": c} for a, b, c in parts], "tail": tail}

    found = helpers.text_column(F.col("text"), "struct<parts:array<struct<literal:string,label:string,key:string>>,tail:string>", cut_up)
    place = [F.col(order).isNull().alias("late"), F.col(order).alias("order"), F.xxhash64("text").alias("hash")]
    named = F.coalesce(F.concat(F.lit("="), F.col(thread).cast("string")), F.lit(""))
    rows = turns.select(F.monotonically_increasing_id().alias("_id"), thread, order, named.alias("_thread"), F.struct(*place).alias("_place"), found.alias("f"))
    cut = materialize(rows.select("_id", thread, order, "_thread", "_place", "f.parts", "f.tail"), "turns")
    refs = cut.select("_id", "_thread", "_place", F.posexplode(F.transform("parts", lambda x: F.struct(x["label"].alias("label"), x["key"].alias("key")))).alias("pos", "ref"))
    refs = refs.select("_id", "_thread", "pos", F.substring_index("ref.label", ":", 1).alias("kind"), "ref.key", F.struct("_place", "pos").alias("at"))
    keys = refs.groupBy("_thread", "kind", "key").agg(F.min("at").alias("first"))
    numbers = _numbered(keys, ["_thread", "kind"], "first").select("_thread", "kind", "key", "number")
    listed = refs.join(numbers, ["_thread", "kind", "key"]).groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"]).alias("numbers"))
    whole = cut.join(listed, "_id", "left")
    heads = F.zip_with("parts", F.coalesce("numbers", F.array().cast("array<bigint>")), lambda p, n: F.concat(p["literal"], F.lit("["), p["label"], F.lit("-"), n.cast("string"), F.lit("]")))
    return whole.select(thread, order, F.concat(F.array_join(heads, ""), F.col("tail")).alias("text"))


def flag_rma(threads: DataFrame) -> DataFrame:
    holds = lambda c, patterns: F.coalesce(F.col(c).rlike("(?i)" + "|".join(patterns)), F.lit(False))
    hit = holds("subject", RMA_SUBJECT) | holds("text", RMA_BODY)
    return threads.withColumn("is_rma", hit)


def curate_cases(threads: DataFrame, analyses: DataFrame, qc: DataFrame, least: float = 0.7) -> DataFrame:
    """Threads that are no returns, are solved with enough confidence, and passed quality control, with a subject."""
    good = analyses.filter(F.col("is_resolved") & (F.col("confidence") >= least))
    approved = qc.filter("approved")
    rows = threads.filter("NOT is_rma").join(good, "thread_id").join(approved, "thread_id")
    return rows.withColumn("subject", F.coalesce("qc_title", "analysis_subject", F.lit("Support Case")))


def case_document(cases: DataFrame) -> DataFrame:
    """The text of a case for the index; a missing product is ``N/A``, other missing parts are empty."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keywords = F.coalesce(F.array_join("keywords", ", "), F.lit(""))
    lines = [
        F.concat(F.lit("# Support Case: "), given("subject")), F.lit(""), F.concat(F.lit("**Category:** "), given("category")),
        F.concat(F.lit("**Product:** "), F.when(F.col("product") != "", F.col("product")).otherwise("N/A")), F.concat(F.lit("**Status:** "), given("status")), F.concat(F.lit("**Keywords:** "), keywords),
        F.lit(""), F.lit("## Problem"), given("problem"), F.lit(""), F.lit("## Solution"), given("solution"),
    ]
    return cases.withColumn("document", F.concat_ws("\n", *lines))


def case_stats(cases: DataFrame) -> DataFrame:
    """``facet, key, n`` by category, product and quality and in all, in one pass over grouping sets; ``dated`` has the first and the
    last day and the number of cases with a time."""
    day = F.to_date("created_at")
    span = F.concat_ws("/", F.min(day).cast("string"), F.max(day).cast("string"))
    sets = cases.groupingSets([["category"], ["product"], ["quality"], []], "category", "product", "quality").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count("created_at").alias("dated"), span.alias("days"))
    facet = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "product").when(F.col("g") == 6, "quality").otherwise("total")
    key = F.coalesce("category", "product", F.col("quality").cast("string"))
    own = F.array(F.struct(facet.alias("facet"), F.when(F.col("g") == 7, "").otherwise(key).alias("key"), F.col("n").alias("n")))
    more = F.when(F.col("g") == 7, F.array(F.struct(F.lit("dated").alias("facet"), F.col("days").alias("key"), F.col("dated").alias("n"))))
    rows = sets.select(F.explode(F.concat(own, F.coalesce(more, F.array().cast("array<struct<facet:string,key:string,n:bigint>>")))).alias("x")).select("x.*")
    return rows.filter("facet <> 'product' OR key IS NOT NULL")


def pending_threads(turns: DataFrame, drafts: DataFrame, limit: int = 50) -> DataFrame:
    """Threads without a draft in which no staff has answered, newest first."""
    per = turns.groupBy("conv_id").agg(F.max((F.col("role") == "assistant").cast("int")).alias("answered"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("n"))
    return per.filter("answered = 0").join(drafts, "conv_id", "left_anti").orderBy(F.desc("conv_id")).limit(limit).select("conv_id", "last_turn", "last_role", "n")


def scan_terms(chunks: DataFrame, patterns: list[str]) -> DataFrame:
    """``chunk_id, term``: the distinct matches of the patterns."""
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in patterns))))
    return chunks.select("chunk_id", F.explode(found).alias("term"))


def term_counts(chunks: DataFrame, patterns: list[str]) -> DataFrame:
    """``collection, term, chunks``: in how many chunks of each collection a match stands."""
    found = scan_terms(chunks.select("chunk_id", "text", "collection").withColumn("chunk_id", F.struct("collection", "chunk_id")), patterns)
    return found.groupBy("chunk_id.collection", "term").agg(F.count("*").alias("chunks"))


def auto_apply_fixes(chunks: DataFrame, fixes: DataFrame, least: float = 0.85) -> DataFrame:
    """Chunks with their confident fixes applied in order, each at its first occurrence."""
    sure = fixes.filter((F.col("confidence") >= least) & (F.col("suggestion_type") != "needs_human_review"))
    listed = sure.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "original_text", "suggested_text"))), lambda x: F.struct(x["original_text"].alias("a"), x["suggested_text"].alias("b"))).alias("fixes"))

    rows = chunks.join(listed, "chunk_id", "left").withColumn("r", helpers.fixed_column(F.col("text"), F.col("fixes")))
    return rows.select("chunk_id", "r.text", "r.applied")


#: Old names that give way to the suggested one in lists of keywords.
LEGACY_KEYWORDS = ("rio-live", "rio live", "rio +wan live", "rio+wan live")


def fix_keywords(keywords: Column, original: Column, suggested: Column) -> Column:
    """Old names and the original become the suggested term, which does not come twice through this; no keyword left gives null."""

    def add(acc: Column, word: Column) -> Column:
        old = F.lower(word).isin(*LEGACY_KEYWORDS) | (F.lower(word) == F.lower(original))
        there = F.exists(acc, lambda x: F.lower(x) == F.lower(suggested))
        return F.when(~old, F.concat(acc, F.array(word))).when(there, acc).otherwise(F.concat(acc, F.array(suggested)))

    out = F.aggregate(F.coalesce(keywords, F.array().cast("array<string>")), F.array().cast("array<string>"), add)
    return F.when(F.size(out) > 0, out)


def apply_approved_fixes(chunks: DataFrame, fixes: DataFrame, parent: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """Chunks and fixes after all approved fixes: texts and subjects by each fix's first place, keywords by term.

    ``chunks`` has ``chunk_id, parent, text, subject, keywords``; in the result ``changed`` says that the chunk's own fields
    changed and ``reindex`` that a fix fell to its document, whose chunks are then embedded anew. Fixes of a chunk are
    applied in the order of ``at``; those whose chunk exists become ``applied``.
    """
    good = fixes.filter("status = 'approved'")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "original_text", "suggested_text"))), lambda x: F.struct(x["original_text"].alias("a"), x["suggested_text"].alias("b")))
    listed = good.groupBy("chunk_id").agg(pairs.alias("fixes"))

    fixed = lambda c: F.when(F.col(c).isNotNull(), helpers.fixed_column(F.col(c), F.col("fixes"))["text"]).alias(c)
    none = F.array().cast("array<struct<a:string,b:string>>")
    words = F.aggregate(F.coalesce("fixes", none), F.col("keywords"), lambda acc, f: fix_keywords(acc, f["a"], f["b"]))
    rows = chunks.join(listed, "chunk_id", "left").withColumn("r", F.struct(fixed("text"), fixed("subject"))).withColumn("words", words)
    same = F.col("text").eqNullSafe(F.col("r.text")) & F.col("subject").eqNullSafe(F.col("r.subject")) & F.col("keywords").eqNullSafe(F.col("words"))
    touched = chunks.join(listed.select("chunk_id"), "chunk_id", "left_semi").select(parent).distinct().withColumn("reindex", F.lit(True))
    done = rows.join(touched, parent, "left").select("chunk_id", parent, "r.text", "r.subject", F.col("words").alias("keywords"), (~same).alias("changed"), F.coalesce("reindex", F.lit(False)).alias("reindex"))
    known = chunks.select("chunk_id").distinct().withColumn("there", F.lit(True))
    applied = F.when((F.col("status") == "approved") & F.col("there"), "applied").otherwise(F.col("status"))
    return done, fixes.join(known, "chunk_id", "left").withColumn("status", applied).drop("there")


def chunks_of_documents(chunks: DataFrame, wanted: DataFrame, field: str = "doc_id", most: int = 100) -> DataFrame:
    """The first ``most`` chunks, in order, of each document whose ``field`` is wanted."""
    own = chunks.join(wanted.select(field).distinct(), field, "left_semi")
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy(field).orderBy("chunk_index", "chunk_id")))
    return ranked.filter(F.col("r") <= most).drop("r")


def set_fix_status(fixes: DataFrame, ids: DataFrame, status: str, at: Column) -> DataFrame:
    hit = fixes.join(ids.withColumn("hit", F.lit(True)), "id", "left")
    new = F.when(F.col("hit"), F.lit(status)).otherwise(F.col("status"))
    when = F.when(F.col("hit") & F.lit(status == "applied"), at).otherwise(F.col("applied_at"))
    return hit.withColumns({"status": new, "applied_at": when}).drop("hit")


def fix_stats(fixes: DataFrame) -> DataFrame:
    """``facet, key, n`` by status, collection and type and in all, in one pass."""
    sets = fixes.groupingSets([["status"], ["collection"], ["suggestion_type"], []], "status", "collection", "suggestion_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    facet = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "collection").when(F.col("g") == 6, "type").otherwise("total")
    return sets.select(facet.alias("facet"), F.when(F.col("g") == 7, "").otherwise(F.coalesce("status", "collection", "suggestion_type")).alias("key"), "n")
