"""Corpus building over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions import helpers, text as T
from kbforge.functions.storage import read_table, scratch
from kbforge.operators import corpus as ops, store
from kbforge.plans import retrieval

CHUNKS = {"size": 1000, "overlap": 100, "separator": "\n"}


def docs(s: SparkSession, d: str) -> DataFrame:
    return retrieval.docs(s, d)


def chunks(s: SparkSession, d: str) -> DataFrame:
    return ops.chunk_rows(docs(s, d), helpers.chunk_column(F.col("text"), "plain", **CHUNKS))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "pages")


def _turns(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "conversations")


def _main(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", helpers.html_column(F.col("html")).alias("p")).select("page_id", F.col("p.title").alias("title"), F.col("p.text").alias("text"))


def _cases(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("## "), "role", F.lit("\n"), "text")
    turns = _turns(s, d).select("conv_id", "turn", body.alias("b"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]), "\n").alias("text"))


def _stored(s: SparkSession, d: str, batch: int) -> DataFrame:
    """The chunks of all documents as the first batch; later batches bring a part of them anew."""
    rows = docs(s, d) if batch == 1 else docs(s, d).filter(F.col("doc_id") % (batch + 1) == 0)
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(CHUNKS["size"]))
    windows = F.transform(starts, lambda i: F.struct(F.substring("text", i, F.lit(CHUNKS["size"])).alias("text"), F.lit(None).cast("string").alias("section"), F.lit("text").alias("kind")))
    cut = ops.chunk_rows(rows, windows)
    return cut.select((F.element_at(F.array(F.lit("docs"), F.lit("cases")), (F.col("doc_id") % 2 + 1).cast("int"))).alias("collection"), "chunk_id", F.concat(F.lit(f"{batch}:"), "text").alias("text"), F.lit(batch).alias("batch"))


def _kept(s: SparkSession, d: str, batch: int) -> store.Store:
    """A store of the first batch's chunks into which a later one is put: by their ids, or by their value of a field."""
    by = ["collection", "chunk_id"] if batch == 2 else ["chunk_id"]
    kept = store.Store(s, scratch(s, "store"), {"chunks": "collection string, chunk_id string, text string, batch int"}, by, 16)
    store.upsert(kept, _stored(s, d, 1), ["batch"], "first")
    if batch == 2:
        store.upsert(kept, _stored(s, d, 2), ["batch"], "second")
    else:
        store.replace(kept, _stored(s, d, 3), "second")
    return kept


def _in_step(s: SparkSession, d: str) -> DataFrame:
    """Postings as a store keeps them beside documents of which a third were written anew."""
    kept = store.Store(s, scratch(s, "store"), {"chunks": "doc_id long, text string, batch int", "postings": f"doc_id long, {store.POSTINGS}"}, ["doc_id"], 16, {"postings": ["term", "doc_id"]})
    rows = docs(s, d).withColumn("batch", F.lit(1))
    store.upsert(kept, rows, ["batch"], "all")
    store.upsert(kept, rows.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("Again: "), "text").alias("text"), F.lit(2).alias("batch")), ["batch"], "a third")
    return kept.read("postings")


def _sizes(s: SparkSession, d: str) -> DataFrame:
    category = F.element_at(F.array(*map(F.lit, ("troubleshooting", "configuration", "faq", "release_notes", "other", None))), (F.col("doc_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 7 == 0, "documentation").otherwise(ops.content_type(category))
    return docs(s, d).select("doc_id", kind.alias("kind"), ops.chunk_size(kind).alias("size"))


def _keywords(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "documents").selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN array(concat(' ', upper(lang), ' '), source, lang) END AS tags")
    return ops.document_keywords(rows)


def _digests(rows: DataFrame) -> DataFrame:
    return rows.select("collection", "chunk_id", F.md5("text").alias("digest"), "batch")


def _curated(s: SparkSession, d: str) -> DataFrame:
    lab = read_table(s, d, "labels")
    threads = docs(s, d).select(F.col("doc_id").alias("thread_id"), (F.col("doc_id") % 10 == 0).alias("is_rma"))
    analyses = lab.select(F.col("doc_id").alias("thread_id"), (F.col("quality") == 1).alias("is_resolved"), (F.col("doc_id") % 10 / 10.0).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a"), "doc_id")).alias("analysis_subject"))
    qc = lab.select(F.col("doc_id").alias("thread_id"), (F.col("toxic") == 0).alias("approved"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("q"), "doc_id")).alias("qc_title"))
    return ops.curate_cases(threads, analyses, qc).select("thread_id", "subject")


def _case_rows(s: SparkSession, d: str) -> DataFrame:
    docs_ = read_table(s, d, "documents").join(read_table(s, d, "labels"), "doc_id")
    return docs_.selectExpr("doc_id", "lang AS category", "source AS product", "quality", "concat('S', doc_id) AS subject", "array(lang, source) AS keywords", "substring(text, 1, 40) AS problem", "substring(text, 41) AS solution", "CASE WHEN quality = 1 THEN 'resolved' ELSE 'open' END AS status", "CASE WHEN doc_id % 4 <> 0 THEN date_add(DATE'2024-01-01', cast(doc_id % 200 AS INT)) END AS created_at")


def fixes(s: SparkSession, d: str) -> DataFrame:
    e = docs(s, d)
    return e.selectExpr("doc_id AS id", "doc_id AS chunk_id", "substring(text, 5, 6) AS original_text", "'<FIX>' AS suggested_text", "CASE WHEN doc_id % 5 = 0 THEN 'needs_human_review' ELSE 'spelling' END AS suggestion_type", "doc_id % 10 / 10.0D AS confidence", "1 AS at", "CASE WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'approved' END AS status", "CAST(NULL AS STRING) AS applied_at", "element_at(array('docs','cases','custom'), cast(doc_id % 3 + 1 AS INT)) AS collection")


def _listed(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "documents").selectExpr("doc_id", "text", "lang AS category", "CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 END AS expires", "doc_id AS created_at")
    return ops.list_documents(rows, F.lit(50), "en", False, 5, 25)


def _variants(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("rio live "), "text")
    rewritten = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("plain "), "text"))
    normalized, effective = T.query_variants(raw, rewritten)
    return read_table(s, d, "benchmark").select("item_id", F.md5(normalized).alias("normalized"), F.md5(effective).alias("effective"))


def _dates(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events")
    mail = F.concat(F.lit("Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    value = F.when(F.col("event_id") % 20 == 0, mail).when(F.col("event_id") % 30 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", F.date_format(T.parse_mail_date(value), "yyyy-MM-dd HH:mm:ss").alias("at"))


def _json(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events")
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"k": '), k, F.lit("}"))
    answer = F.when(F.col("event_id") % 4 == 0, body).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("It is "), body, F.lit(" ok"))).otherwise("none")
    return e.select("event_id", T.parse_model_json(answer, "struct<k:int>")["k"].alias("k"))


def _age(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events")
    later = F.col("ts") + F.make_dt_interval(secs=F.col("event_id") * 104729 % 36000000)
    return e.select("event_id", T.relative_time(F.col("ts"), later).alias("age"))


SUBJECTS = ("other", "my rma", "Return  request", "refund processing", "replacement Device", "returning", "armada")
BODIES = ("", "RMA #12", "the return shipping label", "a replacement shipment", "return the faulty unit", "please SHIP to us", "the return address", "RMA only", "ship it back")


def _returns(s: SparkSession, d: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    rows = docs(s, d).select("doc_id", pick(SUBJECTS).alias("subject"), F.concat("text", F.lit(" "), pick(BODIES)).alias("text"))
    return ops.flag_rma(rows).select("doc_id", "is_rma")


def _paragraphed(s: SparkSession, d: str) -> DataFrame:
    """The documents with an empty line behind each seventh sentence or so.

    Seven sentences can only begin at the end of the last seven, or behind a point that no blank follows; looked for at all other
    places too, a text's work would grow by the square.
    """
    return docs(s, d).withColumn("text", F.regexp_replace("text", r"(?:\G|(?<=\.)(?! ))((?:[^.]*+\. ){7})", "$1\n\n"))


def _senders(s: SparkSession, d: str) -> DataFrame:
    i = F.col("conv_id") % 5
    name = F.concat(F.lit("P"), F.col("conv_id"))
    sender = F.when(i == 0, F.concat(F.lit('"'), name, F.lit(' via Help" <help@acme.example>'))).when(i == 1, F.concat(name, F.lit(" <p@example.org>"))).when(i == 2, "plain@example.org").when(i == 3, "Team <t@acme.example>")
    original = F.when((i == 0) & (F.col("turn") % 2 == 0), "orig@example.org")
    reply = F.when(F.col("turn") % 3 == 0, "R <r@example.org>").when(F.col("turn") % 3 == 1, "help@acme.example")
    rows = _turns(s, d).select("conv_id", "turn", helpers.sender_column(sender, original, reply, "acme.example").alias("s"))
    return rows.select("conv_id", "turn", "s.name", "s.address", "s.staff")


def _approved(s: SparkSession, d: str) -> DataFrame:
    lab = F.array(F.lit("rio live"), F.lit("kept"), F.lit("RIO-Live"), F.col("lang"))
    rows = read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 3).alias("parent_id"), "text", F.concat(F.lit("About "), F.lower(F.substring("text", 5, 6))).alias("subject"), lab.alias("keywords"))
    done, after = ops.apply_approved_fixes(rows, fixes(s, d))
    state = after.select("chunk_id", "status")
    return done.join(state, "chunk_id").select("chunk_id", F.md5("text").alias("digest"), "subject", F.array_join("keywords", ",").alias("keywords"), "changed", "reindex", "status")


QUERIES = {
    "chunk_plain": lambda s, d: chunks(s, d).select("doc_id", "chunk_index", "total_chunks", F.md5("text").alias("digest")),
    "chunk_paragraphs": lambda s, d: ops.chunk_rows(_paragraphed(s, d), helpers.chunk_column(F.col("text"), "paragraphs")).select("doc_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest")),
    "chunk_size_by_type": _sizes,
    "chunks_of_document": lambda s, d: ops.chunks_of_documents(chunks(s, d), docs(s, d).filter("doc_id % 20 = 0").select("doc_id"), "doc_id", 4).select("doc_id", "chunk_index", F.md5("text").alias("digest")),
    "markdown_title": lambda s, d: docs(s, d).select("doc_id", T.markdown_title(F.concat(F.when(F.col("doc_id") % 3 == 0, "## Second\n# First ").when(F.col("doc_id") % 3 == 1, "##  Only second \n").otherwise(""), "text")).alias("title")),
    "parse_sender": _senders,
    "token_estimate": lambda s, d: docs(s, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens")),
    "apply_approved_fixes": _approved,
    "chunk_rows": lambda s, d: ops.chunk_rows(docs(s, d), F.array(F.struct("text", F.lit(None).cast("string").alias("section"), F.lit("text").alias("kind")))).select("chunk_id", "doc_id", "chunk_index"),
    "chunk_semantic": lambda s, d: ops.chunk_rows(_main(s, d), helpers.chunk_column(F.col("text"), "semantic"), "page_id").select("page_id", "chunk_index", "kind", "section", F.md5("text").alias("digest")),
    "chunk_support_case": lambda s, d: ops.chunk_rows(_cases(s, d), helpers.chunk_column(F.col("text"), "support_case"), "conv_id").select("conv_id", "chunk_index", "section", F.md5("text").alias("digest")),
    "rebuild_documents": lambda s, d: ops.rebuild_documents(_turns(s, d).withColumnsRenamed({"conv_id": "doc_id", "turn": "chunk_index"})).select("doc_id", "chunks", F.md5("text").alias("digest")),
    "document_keywords": _keywords,
    "list_documents": _listed,
    "collection_stats": lambda s, d: ops.collection_stats(_pages(s, d).select(F.regexp_extract("url", r"/(en|de|fr|es)/", 1).alias("collection"), "url")),
    "upsert_chunks": lambda s, d: _digests(_kept(s, d, 2).read("chunks")),
    "replace_by_field": lambda s, d: _digests(_kept(s, d, 3).read("chunks")),
    "stored_postings": _in_step,
    "scan_new_pages": lambda s, d: ops.scan_new_pages(_pages(s, d), _pages(s, d).filter("page_id % 3 = 0")),
    "allowed_urls": lambda s, d: ops.allowed_urls(_pages(s, d), ["example.net", "example.org"]).select("page_id", "url"),
    "html_to_text": lambda s, d: _main(s, d).filter(F.length("text") >= 100).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest")),
    "html_title": lambda s, d: _main(s, d).select("page_id", "title"),
    "strip_html_fast": lambda s, d: _pages(s, d).select("page_id", F.md5(T.strip_html_fast(F.col("html"))).alias("digest")),
    "anonymize_threads": lambda s, d: ops.anonymize_threads(docs(s, d).select(F.floor(F.col("doc_id") / 50).alias("conv_id"), F.col("doc_id").alias("turn"), "text")).select("conv_id", "turn", F.md5("text").alias("digest")),
    "anonymize_conversations": lambda s, d: ops.anonymize_threads(_turns(s, d)).select("conv_id", "turn", F.md5("text").alias("digest")),
    "pii_counts": lambda s, d: ops.pii_counts(docs(s, d).withColumnRenamed("doc_id", "conv_id")),
    "clean_thread_quotes": lambda s, d: _turns(s, d).select("conv_id", "turn", F.md5(helpers.text_column(F.concat(F.lit("> old\n"), "text", F.lit("\n--\nme")), "string", helpers.clean_thread_quotes)).alias("digest")),
    "term_transforms": lambda s, d: docs(s, d).select("doc_id", F.md5(T.term_transforms(F.concat(F.lit("the RIO-live and rio + wan live "), "text"))).alias("digest")),
    "snippet": lambda s, d: docs(s, d).select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.token_estimate(F.col("text")).alias("tokens")),
    "answer_preview": lambda s, d: docs(s, d).select("doc_id", T.answer_preview(F.concat(F.lit("# Head\n* "), "text")).alias("preview")),
    "normalize_doc_url": lambda s, d: _pages(s, d).select("page_id", T.normalize_doc_url(F.when(F.col("page_id") % 4 == 0, None).when(F.col("page_id") % 4 == 1, F.concat(F.lit(T.DOCS_HOST), "page_id")).when(F.col("page_id") % 4 == 2, F.concat(F.lit(T.DOCS_HOST + "docs/"), "page_id")).otherwise(F.col("url"))).alias("url")),
    "relative_time": _age,
    "query_variants": _variants,
    "parse_mail_date": _dates,
    "parse_model_json": _json,
    "flag_rma_threads": _returns,
    "curate_cases": _curated,
    "case_document": lambda s, d: ops.case_document(_case_rows(s, d)).select("doc_id", F.md5("document").alias("digest")),
    "case_stats": lambda s, d: ops.case_stats(_case_rows(s, d)),
    "pending_threads": lambda s, d: ops.pending_threads(_turns(s, d).withColumn("role", F.when(F.col("conv_id") % 3 == 0, "user").otherwise(F.col("role"))), _turns(s, d).filter("conv_id % 4 = 0").select("conv_id").distinct(), 40),
    "scan_terms": lambda s, d: ops.scan_terms(docs(s, d).withColumnRenamed("doc_id", "chunk_id"), [r"[A-Z]{3,}", r"the [a-z]{10,}"]),
    "auto_apply_fixes": lambda s, d: ops.auto_apply_fixes(docs(s, d).withColumnRenamed("doc_id", "chunk_id"), fixes(s, d)).select("chunk_id", F.md5("text").alias("digest"), F.col("applied").cast("long").alias("applied")),
    "set_fix_status": lambda s, d: ops.set_fix_status(fixes(s, d), fixes(s, d).filter("id % 7 = 0").select("id"), "applied", F.lit("2024-01-31")).select("id", "status", "applied_at"),
    "fix_stats": lambda s, d: ops.fix_stats(fixes(s, d)),
    "scan_terms_by_collection": lambda s, d: ops.term_counts(docs(s, d).withColumnRenamed("doc_id", "chunk_id").join(read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("collection")), "chunk_id"), [r"[A-Z]{3,}", r"the [a-z]{10,}"]),
}


SQL_LABELLED = "c AS (SELECT doc_id, text, lang AS category, source AS product, quality, toxic FROM documents JOIN labels USING (doc_id))"
SQL_STORED = """WITH c AS (SELECT doc_id, text, unnest(range(greatest(1, (length(text) + 999) // 1000))) AS i FROM documents),
  k AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '_' || i)) AS h FROM c)
  SELECT ['docs','cases'][1 + doc_id % 2] AS collection, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8','9','a','b'][1 + ('0x' || h[17])::INT % 4] || h[18:20] || '-' || h[21:32] AS chunk_id,
  md5((CASE WHEN doc_id % {n} = 0 THEN '{batch}:' ELSE '1:' END) || substring(text, 1000 * i + 1, 1000)) AS digest, CASE WHEN doc_id % {n} = 0 THEN {batch} ELSE 1 END AS batch FROM k"""
_RIO = r"regexp_replace(regexp_replace({x}, '(?i)\bRIO[-\s]?Live\b', 'RIO +LAN', 'g'), '(?i)\bRIO\s*\+\s*WAN\s+Live\b', 'RIO +LAN', 'g')"
# Chunks so far and the one that is held, apart by chr(1), are folded over the paragraphs.
def plain_sql(rows: str, key: str, separator: str, size: int, overlap: int) -> str:
    """SQL of ``c (key, cs)``: the chunks of the texts of ``rows``; each fold step marks a new chunk by the character 1."""
    last, sep = "string_split(acc, chr(1))[-1]", "chr(10)" if separator == "\n" else f"'{separator}'"
    end = f"instr(reverse(right(acc, {overlap})), ' .')"
    tail = f"CASE WHEN length({last}) <= {overlap} THEN {last} WHEN {end} BETWEEN 1 AND {overlap // 2 - 2} THEN right(acc, {end} - 1) ELSE right(acc, {overlap}) END"
    bare = r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')"
    return rf"""p AS (SELECT {key}, list_filter(list_transform(string_split(text, {sep}), {bare}), lambda x: x <> '') AS paras FROM {rows}),
        f AS (SELECT {key}, list_reduce(paras, lambda acc, x: CASE WHEN length({last}) + length(x) + {len(separator)} > {size} THEN acc || chr(1) || {tail} || {sep} || x ELSE acc || {sep} || x END) AS folded FROM p WHERE len(paras) > 0),
        c AS (SELECT {key}, list_transform(string_split(folded, chr(1)), {bare}) AS cs FROM f)"""


def page_text_sql(html: str) -> str:
    """SQL of the main text of a standard page: the pieces between the tags of its article."""
    pieces = rf"regexp_split_to_array(regexp_extract({html}, '<article>(.*?)(?:</article>|$)', 1, 's'), '<[^>]*>')"
    decoded = "lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g')"
    return rf"array_to_string(list_filter(list_transform(list_transform({pieces}, {decoded}), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ')"


def paragraphs_sql(rows: str, key: str, tokens: int = 400, overlap: int = 50, whole: int = 200) -> str:
    """SQL of ``c (key, cs)``: paragraphs packed up to ``tokens``; a new chunk begins with the last sentences of the one before."""
    bare, nn, last = r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')", "chr(10) || chr(10)", "string_split(acc, chr(1))[-1]"
    sentences = f"list_reverse(list_transform(list_filter(list_transform(ps, {bare}), lambda x: x <> ''), lambda x: CASE WHEN ends_with(x, '.') THEN x ELSE x || '.' END))"
    enough = f"list_min(list_filter(range(1, len(ss) + 1), lambda k: k = len(ss) OR list_sum(list_transform(ss[1:k], lambda x: length(x) // 4)) >= {overlap} OR list_sum(list_transform(ss[1:k + 1], lambda x: length(x) // 4)) > {1.5 * overlap}))"
    end = f"list_transform([{sentences}], lambda ss: array_to_string(list_reverse(ss[1:{enough}]), ' '))[1]"
    rest = f"list_transform([string_split(replace(h, '.' || chr(10), '. '), '. ')], lambda ps: CASE WHEN length(h) // 4 <= {overlap} THEN h WHEN len(ps) = 1 THEN right(h, {5 * overlap}) ELSE {end} END)[1]"
    step = f"list_transform([{last}], lambda h: CASE WHEN (length(h) + 2 + length(x)) // 4 > {tokens} THEN list_transform([{rest}], lambda r: acc || chr(1) || CASE WHEN r <> '' THEN r || {nn} ELSE '' END || x)[1] ELSE acc || {nn} || x END)[1]"
    return rf"""b AS (SELECT {key}, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM {rows}),
        p AS (SELECT {key}, body, list_filter(list_transform(string_split(body, {nn}), {bare}), lambda x: x <> '') AS paras FROM b WHERE body <> ''),
        f AS (SELECT {key}, CASE WHEN length(body) // 4 <= {whole} THEN body ELSE list_reduce(paras, lambda acc, x: {step}) END AS folded FROM p),
        c AS (SELECT {key}, list_transform(string_split(folded, chr(1)), {bare}) AS cs FROM f)"""


SQL_PARAGRAPHS = rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '((?:[^.]*\. ){{7}})', '\1' || chr(10) || chr(10), 'g') AS text FROM documents), {paragraphs_sql('t', 'doc_id')}
        SELECT doc_id, unnest(range(len(cs))) AS chunk_index, unnest(list_transform(cs, lambda x: length(x))) AS n_chars, unnest(list_transform(cs, lambda x: md5(x))) AS digest FROM c"""
SQL_PLAIN = f"WITH {plain_sql('documents', 'doc_id', chr(10), 1000, 100)} SELECT doc_id, unnest(range(len(cs))) AS chunk_index, len(cs) AS total_chunks, unnest(list_transform(cs, lambda x: md5(x))) AS digest FROM c"
ORACLES = {
    "chunk_rows": "SELECT doc_id, 0 AS chunk_index, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8','9','a','b'][1 + ('0x' || h[17])::INT % 4] || h[18:20] || '-' || h[21:32] AS chunk_id FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '_0')) AS h FROM documents)",
    "rebuild_documents": "SELECT conv_id AS doc_id, count(*) AS chunks, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> ''), '')) AS digest FROM conversations GROUP BY conv_id",
    "document_keywords": f"WITH d AS (SELECT doc_id, {retrieval.SQL_TERMS} AS terms FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) WHERE length(term) > 3 GROUP BY ALL), i AS (SELECT term, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term), r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * idf, 6) DESC, term) AS r FROM p JOIN i USING (term)), t AS (SELECT doc_id, list(term ORDER BY r) AS terms FROM r WHERE r <= CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 6 END GROUP BY doc_id), k AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [] END AS tags, coalesce(terms, []) AS terms FROM documents LEFT JOIN t USING (doc_id)) SELECT doc_id, array_to_string(list_concat(tags, list_filter(terms, lambda x: NOT list_contains(tags, x))), ',') AS keywords FROM k WHERE len(tags) + len(terms) > 0",
    "list_documents": "WITH r AS (SELECT doc_id, text, coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 END < 50, false) AS is_expired FROM documents WHERE lang = 'en') SELECT doc_id, is_expired, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview, (SELECT count(*) FROM r WHERE NOT is_expired) AS total FROM r WHERE NOT is_expired ORDER BY doc_id DESC LIMIT 25 OFFSET 5",
    "collection_stats": "SELECT regexp_extract(url, '/(en|de|fr|es)/', 1) AS collection, count(*) AS chunks, count(DISTINCT url) AS urls FROM pages GROUP BY 1",
    "upsert_chunks": SQL_STORED.format(n=3, batch=2),
    "stored_postings": f"WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Again: ' || text ELSE text END AS text FROM documents), {retrieval.SQL_POSTINGS} SELECT doc_id, term, doc_len, tf FROM postings",
    "replace_by_field": SQL_STORED.format(n=4, batch=3),
    "scan_new_pages": "SELECT url, CASE WHEN bool_or(page_id % 3 = 0) THEN 'indexed' ELSE 'new' END AS status FROM pages GROUP BY url",
    "allowed_urls": "SELECT page_id, url FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '(^|\\.)example\\.(net|org)$')",
    "html_title": "SELECT page_id, trim(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&')) AS title FROM pages",
    "strip_html_fast": r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))[1:8000]) AS digest FROM pages",
    "term_transforms": "SELECT doc_id, md5(" + _RIO.format(x="'the RIO-live and rio + wan live ' || text") + ") AS digest FROM documents",
    "snippet": "SELECT doc_id, CASE WHEN length(text) > 300 THEN text[1:297] || '...' ELSE text END AS snippet, length(text) // 4 AS tokens FROM documents",
    "normalize_doc_url": f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 3 THEN url ELSE '{T.DOCS_HOST}docs/' || page_id END AS url FROM pages",
    "relative_time": "WITH e AS (SELECT event_id, ts, event_id * 104729 % 36000000 AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s // 86400 < 7 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' WHEN s // 86400 < 35 THEN (s // 604800) || ' week' || CASE WHEN s // 604800 = 1 THEN '' ELSE 's' END || ' ago' WHEN s // 86400 < 360 THEN (s // 2592000) || ' month' || CASE WHEN s // 2592000 = 1 THEN '' ELSE 's' END || ' ago' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM e",
    "chunk_plain": SQL_PLAIN,
    "chunk_paragraphs": SQL_PARAGRAPHS,
    "html_to_text": f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {page_text_sql('html')} AS t FROM pages) WHERE length(t) >= 100",
    "chunks_of_document": f"SELECT doc_id, chunk_index, digest FROM ({SQL_PLAIN}) WHERE doc_id % 20 = 0 AND chunk_index < 4",
    "pii_counts": r"""SELECT doc_id AS conv_id, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bCY-[A-Z][A-Z0-9]{1,3}-\d{1,3}-\d{1,3}\b'), lambda x: upper(x)))) AS serials,
        len(list_distinct(list_transform(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'), lambda x: lower(x)))) AS emails,
        len(list_distinct(list_filter(regexp_extract_all(text, '(?:\+\d{1,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}'), lambda x: length(regexp_replace(x, '\D', '', 'g')) >= 7))) AS phones FROM documents""",
    "answer_preview": r"""WITH o AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[>\-*•\s]+', '') AS o FROM documents), h AS (SELECT doc_id, o, o[1:240] AS head FROM o),
        s AS (SELECT *, regexp_extract(head, '^(.*[.!?]) ', 1) AS sentence, regexp_extract(head, '^(.*) ', 1) AS word FROM h)
        SELECT doc_id, CASE WHEN o = '' THEN NULL WHEN length(o) <= 240 THEN o WHEN length(sentence) > 120 THEN sentence || ' …' WHEN word <> '' THEN word || '…' ELSE head || '…' END AS preview FROM s""",
    "chunk_size_by_type": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'documentation' ELSE ['support_case', 'support_case', 'faq', 'release_notes', 'generic', 'generic'][1 + doc_id % 6] END AS kind, CASE WHEN doc_id % 7 = 0 THEN 450 WHEN doc_id % 6 < 2 THEN 350 ELSE 400 END AS size FROM documents",
    "markdown_title": r"WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '## Second' || chr(10) || '# First ' WHEN 1 THEN '##  Only second ' || chr(10) ELSE '' END || text AS t FROM documents) SELECT doc_id, coalesce(nullif(trim(regexp_extract(t, '(?m)^#\s+(.+)$', 1)), ''), nullif(trim(regexp_extract(t, '(?m)^##\s+(.+)$', 1)), '')) AS title FROM t",
    "parse_sender": """WITH t AS (SELECT conv_id, turn, conv_id % 5 AS i, 'P' || conv_id AS n, turn % 2 = 0 AND conv_id % 5 = 0 AS orig, turn % 3 = 0 AS reply FROM conversations)
        SELECT conv_id, turn, CASE WHEN i = 0 AND orig THEN n WHEN reply THEN 'R' WHEN i < 2 THEN n WHEN i = 3 THEN 'Team' ELSE '' END AS name,
        CASE WHEN orig THEN 'orig@example.org' WHEN reply THEN 'r@example.org' ELSE ['help@acme.example', 'p@example.org', 'plain@example.org', 't@acme.example', 'Unknown'][1 + i] END AS address, i IN (0, 3) AS staff FROM t""",
    "token_estimate": "SELECT doc_id, length(text) // 4 AS tokens FROM documents",
    "apply_approved_fixes": """WITH f AS (SELECT doc_id, lang, text, doc_id % 2 = 1 AS good, substring(text, 5, 6) AS old, 'About ' || lower(substring(text, 5, 6)) AS subject FROM documents),
        r AS (SELECT *, good AND length(old) > 0 AS hit, instr(lower(text), lower(old)) AS p, instr(lower(subject), lower(old)) AS q FROM f),
        o AS (SELECT *, CASE WHEN hit THEN substring(text, 1, p - 1) || '<FIX>' || substring(text, p + length(old)) ELSE text END AS new, CASE WHEN hit THEN substring(subject, 1, q - 1) || '<FIX>' || substring(subject, q + length(old)) ELSE subject END AS about FROM r)
        SELECT doc_id AS chunk_id, md5(new) AS digest, about AS subject, CASE WHEN NOT good THEN 'rio live,kept,RIO-Live,' || lang WHEN lower(lang) = lower(old) THEN '<FIX>,kept' ELSE '<FIX>,kept,' || lang END AS keywords, good AS changed,
        bool_or(good) OVER (PARTITION BY doc_id // 3) AS reindex, CASE WHEN good THEN 'applied' ELSE 'pending' END AS status FROM o""",
    "query_variants": "WITH q AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'plain ' ELSE 'rio live ' END || text AS base FROM benchmark), v AS (SELECT *, " + _RIO.format(x="base") + " AS changed FROM q) SELECT item_id, CASE WHEN changed <> base THEN md5(changed) END AS normalized, md5(changed) AS effective FROM v",
    "parse_mail_date": "SELECT event_id, CASE WHEN event_id % 20 <> 0 AND event_id % 30 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events",
    "parse_model_json": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM events",
    "flag_rma_threads": r"""SELECT doc_id, doc_id % 7 IN (1, 2, 3, 4) OR doc_id % 9 IN (1, 2, 3, 4, 5, 6)
        OR regexp_matches(text, '(?i)\bRMA\s*(number|#|:)?\s*\d+|\breturn\s+(shipping\s+)?label\b|\breplacement\s+shipment\b|\breturn\s+the\s+(defective|faulty)\s+(unit|device)\b|\bship\s+(back|to\s+us)\b|\breturn\s+address\b') AS is_rma FROM documents""",
    "curate_cases": "SELECT doc_id AS thread_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'q' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id END, 'Support Case') AS subject FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 >= 7 AND quality = 1 AND toxic = 0",
    "case_document": f"WITH {SQL_LABELLED} SELECT doc_id, md5('# Support Case: S' || doc_id || chr(10) || chr(10) || '**Category:** ' || category || chr(10) || '**Product:** ' || product || chr(10) || '**Status:** ' || CASE quality WHEN 1 THEN 'resolved' ELSE 'open' END || chr(10) || '**Keywords:** ' || category || ', ' || product || chr(10) || chr(10) || '## Problem' || chr(10) || substring(text, 1, 40) || chr(10) || chr(10) || '## Solution' || chr(10) || substring(text, 41)) AS digest FROM c",
    "case_stats": f"WITH {SQL_LABELLED} SELECT 'category' AS facet, category AS key, count(*) AS n FROM c GROUP BY category UNION ALL SELECT 'product', product, count(*) FROM c GROUP BY product UNION ALL SELECT 'quality', quality::VARCHAR, count(*) FROM c GROUP BY quality UNION ALL SELECT 'total', '', count(*) FROM c UNION ALL SELECT 'dated', strftime(min(DATE '2024-01-01' + (doc_id % 200)::INT), '%Y-%m-%d') || '/' || strftime(max(DATE '2024-01-01' + (doc_id % 200)::INT), '%Y-%m-%d'), count(*) FROM c WHERE doc_id % 4 <> 0",
    "pending_threads": "WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'user' ELSE role END AS role FROM conversations) SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) AS n FROM t WHERE conv_id % 4 <> 0 GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') = 0 ORDER BY conv_id DESC LIMIT 40",
    "scan_terms": r"SELECT DISTINCT doc_id AS chunk_id, unnest(list_concat(regexp_extract_all(text, '[A-Z]{3,}'), regexp_extract_all(text, 'the [a-z]{10,}'))) AS term FROM documents",
    "scan_terms_by_collection": r"WITH t AS (SELECT source AS collection, doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '[A-Z]{3,}'), regexp_extract_all(text, 'the [a-z]{10,}')))) AS term FROM documents) SELECT collection, term, count(*) AS chunks FROM t GROUP BY collection, term",
    "auto_apply_fixes": "WITH f AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 9 AND length(text) > 4 THEN substring(text, 5, 6) END AS old FROM documents), p AS (SELECT *, CASE WHEN old IS NULL THEN 0 ELSE instr(lower(text), lower(old)) END AS p FROM f) SELECT doc_id AS chunk_id, md5(CASE WHEN p > 0 THEN substring(text, 1, p - 1) || '<FIX>' || substring(text, p + length(old)) ELSE text END) AS digest, (p > 0)::BIGINT AS applied FROM p",
    "set_fix_status": "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'applied' WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'approved' END AS status, CASE WHEN doc_id % 7 = 0 THEN '2024-01-31' END AS applied_at FROM documents",
    "fix_stats": "SELECT 'status' AS facet, CASE WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'approved' END AS key, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'type', CASE WHEN doc_id % 5 = 0 THEN 'needs_human_review' ELSE 'spelling' END, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'collection', ['docs','cases','custom'][1 + doc_id % 3], count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM documents",
}
