"""Batch retrieval: postings, BM25, dense search, rank fusion, source diversity, reranking, contexts, evaluation.

Scores are rounded to six places before they are ranked, and equal scores rank by id, so that results do not hang on the
order of additions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbforge.functions.chunking import bound
from kbforge.functions.storage import materialize
from kbforge.functions.text import term_transforms
from kbforge.operators import vectors

TERM = r"[\p{L}\p{N}_]+"
#: Fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Terms that ask for precision.
TECHNICAL_TERMS = (
    "firmware", "protocol", "ip", "rcp", "rio", "ci0", "vp4", "cvp", "visca", "lanc", "sdi", "hdmi", "ndi", "srt", "ptz", "iris",
    "shutter", "gain", "white balance", "tally", "gpio", "rs422", "rs232", "ethernet", "tcp", "udp", "multicast", "dhcp", "static ip",
)
K1, B = 1.2, 0.75
RRF_K = 60
#: Words of a run by which documents that hold a text are found.
GRAM = 5


def terms_of(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def counted(values: Column) -> Column:
    """``term, tf`` of each distinct value of an array, in order: sorted, equal ones are neighbours, so a long array's work does not
    grow by the square; null for an empty one."""

    def runs(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
        return bound(starts, lambda s: F.transform(s, lambda i, j: F.struct(F.get(own, i).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(own)) - i).cast("long").alias("tf"))))

    return bound(F.sort_array(values), lambda own: F.when(F.size(own) > 0, runs(own)))


def bm25_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", only: DataFrame | None = None, stems: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key, term, tf, doc_len`` of each term of each document, counted where its text is read; only counts of a key that several
    rows have are shuffled. ``docs`` are read twice, the keys alone first.

    With ``only`` (``term``) just these terms are counted; ``stems`` makes of an array of terms that of what is counted.
    """
    terms = terms_of(F.col(text))
    words = docs.select(key, (stems(terms) if stems else terms).alias("terms")).select(key, F.size("terms").cast("long").alias("doc_len"), F.explode(counted(F.col("terms"))).alias("p")).select(key, "p.term", "p.tf", "doc_len")
    if only is not None:
        words = words.join(only.distinct(), "term", "left_semi")
    if _alone(docs, key):
        return words.select(key, "term", "tf", "doc_len")
    return words.groupBy(key, "term", "doc_len").agg(F.sum("tf").alias("tf")).select(key, "term", "tf", "doc_len")


def bm25_idf(postings: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``term, df, idf``; ``n_docs`` is one row with the column ``n``."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))


def top_k(hits: DataFrame, k: int, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k)


def _alone(rows: DataFrame, key: str) -> bool:
    return rows.groupBy(key).count().filter("count > 1").isEmpty()


#: Distinct terms asked for that may stand in a plan.
LISTED_TERMS = 10_000


def asked_postings(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of the terms that ``queries`` ask for, written once, and one row ``n, total``: the documents and their terms.

    Terms asked for go to the texts, up to ``LISTED_TERMS`` of them; texts are then read once, and no posting is shuffled.
    """
    asked = query_terms(queries).select("term").distinct()
    listed = [r[0] for r in asked.limit(LISTED_TERMS + 1).collect()]
    if len(listed) > LISTED_TERMS:
        return materialize(bm25_postings(docs, only=asked), "postings"), docs.agg(F.count("*").alias("n"), F.sum(F.size(terms_of(F.col("text")))).alias("total"))
    split = docs.select("doc_id", terms_of(F.col("text")).alias("terms"))
    rows = materialize(split.select("doc_id", F.size("terms").cast("long").alias("doc_len"), counted(F.filter("terms", lambda t: t.isin(listed))).alias("found")), "postings")
    useful = rows.select("doc_id", "doc_len", F.explode("found").alias("p")).select("doc_id", "p.term", "p.tf", "doc_len")
    if not _alone(rows, "doc_id"):
        useful = useful.groupBy("doc_id", "term", "doc_len").agg(F.sum("tf").alias("tf"))
    return useful, rows.agg(F.count("*").alias("n"), F.sum("doc_len").alias("total"))


def _weights(postings: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, term, idf, avg_len`` of the queries' terms that a document has, broadcast if they are few."""
    idf = bm25_idf(postings, sizes).select("term", "idf")
    asked = query_terms(queries).join(idf, "term").crossJoin(F.broadcast(sizes))
    return bounded(materialize(asked.select("query_id", "term", "idf", (F.col("total") / F.col("n")).alias("avg_len")), "weights"))


def bm25_scores(docs: DataFrame, queries: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``query_id, doc_id, score`` of all documents that have one of a query's terms; ``read`` is what ``asked_postings`` gives of both."""
    useful, sizes = read or asked_postings(docs, queries)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return useful.join(_weights(useful, sizes, queries), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))


def search_bm25(docs: DataFrame, queries: DataFrame, k: int = 10, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: postings are cut to the queries' terms and written before anything is joined."""
    return top_k(bm25_scores(docs, queries, read), k)


def lexical_rerank(docs: DataFrame, queries: DataFrame, candidates: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``query_id, doc_id, score``: the share of the query's idf weight that a candidate's terms cover.

    Postings are cut to the terms asked for where they are made.
    """
    postings, sizes = read or asked_postings(docs, queries)
    weights = _weights(postings, sizes, queries)
    whole = weights.groupBy("query_id").agg(F.sum("idf").alias("whole"))
    wanted = bounded(materialize(candidates.select("query_id", "doc_id").join(weights.select("query_id", "term", "idf"), "query_id"), "wanted"))
    pairs = postings.select("doc_id", "term").join(wanted, ["doc_id", "term"])
    return pairs.groupBy("query_id", "doc_id").agg(F.sum("idf").alias("hit")).join(whole, "query_id").select("query_id", "doc_id", F.round(F.col("hit") / F.col("whole"), 6).alias("score"))


def search_dense(found: DataFrame, queries: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank`` by cosine similarity, exactly, by an index of cells (``vectors``); a zero vector scores 0."""
    hits = vectors.search(vectors.build(found), queries, k)
    return hits if least is None else hits.filter(F.col("score") >= least)


def fuse_rrf(lists: list[DataFrame], limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``query_id, doc_id, rank``, each cut to ``min(3 * limit, 50)``."""
    cut = None
    for one in lists:
        part = one.filter(F.col("rank") <= min(3 * limit, 50)).select("query_id", "doc_id", "rank")
        cut = part if cut is None else cut.unionByName(part)
    fused = cut.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 8).alias("score"))
    return top_k(fused, limit)


SOURCES = ("docs", "cases", "custom")


def merge_sources_diverse(hits: DataFrame, limit: int = 10) -> DataFrame:
    """The best ``limit`` of ``query_id, doc_id, source, score``, with each source that has a good hit among them.

    Which sources are absent is found once, from the best ``limit`` rows. In the order of ``SOURCES`` the best hit of an
    absent one takes the last place if it has half of the top score, and the places are sorted anew; so a later source may
    take the place of an earlier one. A query has at most ``limit`` rows a source here.
    """
    per = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "doc_id"))).filter(F.col("r") <= limit)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc_id"], ascending=[False, True])
        top = rows.head(limit)
        if limit >= 3 and len(rows) > limit:
            for source in (s for s in SOURCES if s not in set(top["source"])):
                best = rows[rows["source"] == source].head(1)
                if len(best) and best["score"].iloc[0] >= 0.5 * top["score"].iloc[0]:
                    top = pd.concat([top.iloc[:-1], best]).sort_values(["score", "doc_id"], ascending=[False, True])
        return top.assign(rank=np.arange(1, len(top) + 1))[["query_id", "doc_id", "source", "score", "rank"]]

    return per.groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, source string, score double, rank int")


@dataclass
class Collection:
    """Texts (``doc_id, text``) and their vectors (``vec_id, embedding``, named by the documents); one without a vector is found by its
    words alone."""

    docs: DataFrame
    found: DataFrame


def search_hybrid_rrf(one: Collection, queries: DataFrame, asked: DataFrame, limit: int = 10, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of one collection: its BM25 list for ``queries (query_id, text)`` and its dense list for
    ``asked (query_id, embedding)``, fused."""
    most = min(3 * limit, 50)
    dense = search_dense(one.found, asked, most).withColumnRenamed("vec_id", "doc_id")
    return fuse_rrf([search_bm25(one.docs, queries, most, read), dense], limit)


def retrieve(collections: dict[str, Collection], queries: DataFrame, asked: DataFrame, limit: int = 5) -> DataFrame:
    """``query_id, doc_id, score, rank, threshold``, the whole way: product names in their usual form, the fused lists of each of
    ``SOURCES``, these merged, the merged rows reranked by coverage, cut at the query's threshold.

    No document is in two collections. The threshold holds for the rerank's scores, as fused ones mean nothing by themselves; a
    row that shares no term with its query has the score 0. Each text is read once.
    """
    queries = queries.select("query_id", term_transforms(F.col("text")).alias("text"))
    fetch = max(3 * limit, 15)
    reads = {source: asked_postings(one.docs, queries) for source, one in collections.items()}
    lists = [search_hybrid_rrf(one, queries, asked, fetch, reads[source]).withColumn("source", F.lit(source)) for source, one in collections.items()]
    merged = materialize(merge_sources_diverse(reduce(DataFrame.unionByName, lists), fetch), "merged").select("query_id", "doc_id")
    postings, sizes = (reduce(DataFrame.unionByName, parts) for parts in zip(*reads.values()))
    docs = reduce(DataFrame.unionByName, (one.docs for one in collections.values()))
    covered = lexical_rerank(docs, queries, merged, (postings, sizes.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))))
    scores = merged.join(covered, ["query_id", "doc_id"], "left").fillna(0.0, ["score"])
    return rerank_and_cut(merged, scores, queries.select("query_id", dynamic_threshold(F.col("text")).alias("threshold")), limit)


def dynamic_threshold(query: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))
    base = F.when(words <= 2, 0.15).when(words <= 5, 0.20).otherwise(0.25)
    low = F.lower(query)
    technical = F.lit(False)
    for term in TECHNICAL_TERMS:
        technical = technical | low.contains(term)
    return F.round(F.least(base + F.when(technical, 0.05).otherwise(0.0), F.lit(0.30)), 2)


def rerank_and_cut(candidates: DataFrame, scores: DataFrame, thresholds: DataFrame, limit: int = 10) -> DataFrame:
    """Candidates by relevance: those at the query's threshold or above, or the first three if fewer reach it."""
    ranked = top_k(candidates.select("query_id", "doc_id").join(scores, ["query_id", "doc_id"]), max(3 * limit, 15)).join(thresholds, "query_id")
    kept = F.sum((F.col("score") >= F.col("threshold")).cast("int")).over(Window.partitionBy("query_id"))
    stay = (F.col("score") >= F.col("threshold")) | ((kept < 3) & (F.col("rank") <= 3))
    return ranked.withColumn("stay", stay).filter("stay").filter(F.col("rank") <= limit).drop("stay")


def threshold_min_one(ranked: DataFrame, thresholds: DataFrame) -> DataFrame:
    rows = ranked.join(thresholds, "query_id")
    return rows.filter((F.col("score") >= F.col("threshold")) | (F.col("rank") == 1))


def answer_confidence(ranked: DataFrame) -> DataFrame:
    """``query_id, confidence`` from the mean of the three best scores, or where none has a score from the number of rows."""
    a, n = F.col("a"), F.col("n")
    by_number = F.when(n >= 6, 0.8).when(n >= 4, 0.65).when(n >= 2, 0.5).otherwise(0.35)
    level = F.when(a.isNull(), by_number).when(a >= 0.7, F.least(F.lit(0.95), a)).when(a >= 0.4, 0.6 + (a - 0.4) * 0.5).when(a >= 0.2, 0.3 + (a - 0.2) * 1.5).otherwise(F.greatest(F.lit(0.1), a))
    best = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 3)
    each = ranked.groupBy("query_id").agg(best.alias("best"), F.count("*").alias("n"))
    mean = F.aggregate("best", F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size("best"), F.lit(0))
    return each.select("query_id", mean.alias("a"), "n").select("query_id", F.round(level, 4).alias("confidence"))


def source_links(hits: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` distinct links of each query in rank order; ``hits`` has ``query_id, rank, link``."""
    first = hits.filter("link IS NOT NULL").groupBy("query_id", "link").agg(F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= most).select("query_id", "place", "link")


def fixed(value: Column, places: int) -> Column:
    """A number with ``places`` decimals, rounded by its exact value, as C does: ``format_string`` rounds the shortest decimals that
    stand for it, so 1.0005 gives 1.001 there, though it lies below the middle."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def format_context(hits: DataFrame, most: int = 8000) -> DataFrame:
    """``query_id, context``: numbered hits until the next would pass ``most`` characters."""
    order = Window.partitionBy("query_id").orderBy("rank")
    entry = F.format_string("[%d] %s [Source: %s] [Score: %s]\n%s\n", F.col("rank").cast("int"), F.col("title"), F.col("source"), fixed(F.col("score"), 3), F.col("text"))
    sized = hits.withColumn("entry", entry).withColumn("used", F.sum(F.length("entry")).over(order))
    return sized.filter(F.col("used") <= most).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n---\n").alias("context"))


def build_context(hits: DataFrame, first: int = 8, group_most: int = 4000, most: int = 12000, graph: DataFrame | None = None) -> DataFrame:
    """``query_id, context``: the first hits grouped by ``group_key`` in first-seen order, within a budget of characters.

    The first wrapped group that passes the budget is cut to what is left if that is over 200, else left out, and ends the
    context. ``graph`` (``query_id, graph_context``) goes in front and does not count.
    """
    top = hits.filter(F.col("rank") <= first)
    groups = top.groupBy("query_id", "group_key").agg(
        F.min("rank").alias("at"), F.max("score").alias("score"), F.min_by("source", "rank").alias("source"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("text")
    )
    cut = groups.withColumn("text", F.when(F.length("text") > group_most, F.concat(F.substring("text", 1, group_most), F.lit("..."))).otherwise(F.col("text")))
    order = Window.partitionBy("query_id").orderBy("at")
    safe = F.replace(F.col("text"), F.lit("</document>"), F.lit("<\\/document>"))
    ref = F.replace(F.col("group_key"), F.lit('"'), F.lit("'"))
    wrapped = F.format_string('<document index="%d" source="%s" ref="%s" relevance="%s">\n%s\n</document>', F.col("n").cast("int"), F.col("source"), ref, fixed(F.col("score"), 2), safe)
    placed = cut.withColumn("n", F.row_number().over(order)).withColumn("doc", wrapped)
    room = F.lit(most) - F.sum(F.length("doc")).over(order) + F.length("doc")
    body = F.when(F.length("doc") <= F.col("room"), F.col("doc")).when(F.col("room") > 200, F.concat(F.substring(F.col("doc"), F.lit(1), F.col("room").cast("int")), F.lit("...")))
    shown = placed.withColumn("room", room).select("query_id", "n", body.alias("doc"))
    if graph is not None:
        shown = shown.unionByName(graph.select("query_id", F.lit(0).alias("n"), F.concat(F.lit("[Knowledge Graph Relationships]\n"), "graph_context").alias("doc")))
    parts = F.array_sort(F.collect_list(F.when(F.col("doc").isNotNull(), F.struct("n", "doc"))))
    return shown.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["doc"]), "\n").alias("context"))


def expected_documents(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id`` of documents whose text holds a query's text, case and marks included.

    The words of a query but its first and last are whole words of such a document, one after the other. So texts meet by an
    equi-join on runs of up to ``GRAM`` of them, the first of the query's. Queries of one or two words have none: the first
    ends a word of the document, the last begins one, a single word lies within one; they meet the vocabulary by parts of
    words as long as theirs. What meets is compared. A query without a word expects no document.
    """
    words = lambda text: F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    asked = materialize(queries.select("query_id", "text", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0"), "asked")
    gram = F.slice("words", F.lit(2), F.least(F.col("n") - 2, F.lit(GRAM)))
    runs = asked.filter("n > 2").select("query_id", F.size(gram).alias("size"), F.xxhash64(gram).alias("gram"))
    # At most ``GRAM`` sizes.
    sizes = sorted(r[0] for r in runs.select("size").distinct().collect())
    split = docs.select("doc_id", words(F.col("text")).alias("words"))

    def grams(size: int) -> Column:
        count = F.size("words") - size + 1
        own = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice("words", i, F.lit(size))))
        return F.transform(F.array_distinct(F.when(count > 0, own).otherwise(F.array().cast("array<bigint>"))), lambda g: F.struct(F.lit(size).alias("size"), g.alias("gram")))

    pairs = asked.select("query_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id")).limit(0)
    if sizes:
        held = split.select("doc_id", F.explode(F.concat(*map(grams, sizes))).alias("g")).select("doc_id", "g.*")
        pairs = held.join(bounded(runs), ["size", "gram"]).select("query_id", "doc_id")
    short = asked.filter("n <= 2")
    if not short.isEmpty():
        pairs = pairs.unionByName(_by_parts(split, short))
    pairs = materialize(pairs.distinct(), "pairs")
    met = docs.select("doc_id", "text").join(bounded(pairs), "doc_id").join(bounded(asked.select("query_id", F.col("text").alias("wanted"))), "query_id")
    return met.filter(F.col("text").contains(F.col("wanted"))).select("query_id", "doc_id").distinct()


def bounded(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows``, which are written or cheap to count, broadcast if there are no more than ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _by_parts(split: DataFrame, short: DataFrame) -> DataFrame:
    """``query_id, doc_id`` where a word of the document ends, begins or holds what a query of one or two words asks for."""
    postings = materialize(split.select("doc_id", F.explode(F.array_distinct("words")).alias("word")), "words")
    vocabulary = postings.groupBy("word").agg(F.count("*").alias("df"))
    one, first, last = F.col("n") == 1, F.element_at("words", 1), F.element_at("words", -1)
    part = lambda kind, word: F.struct(F.lit(kind).alias("kind"), word.alias("part"))
    parts = F.when(one, F.array(part("in", first))).otherwise(F.array(part("end", first), part("begin", last)))
    asked = materialize(short.select("query_id", F.explode(parts).alias("p")).select("query_id", "p.*"), "parts")
    # As many as there are lengths of words.
    lengths = asked.select("kind", F.length("part").alias("size")).distinct().collect()
    word, size = F.col("word"), F.length("word")

    def cut(kind: str, n: int) -> Column:
        if kind == "in":
            own = F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(word, i, F.lit(n))))
        else:
            own = F.array(F.substring(word, 1, n) if kind == "begin" else F.substring(word, -n, n))
        return F.when(size >= n, F.transform(own, lambda x: part(kind, x))).otherwise(F.array().cast("array<struct<kind:string,part:string>>"))

    known = vocabulary.select("word", "df", F.explode(F.concat(*(cut(r["kind"], r["size"]) for r in lengths))).alias("p")).select("word", "df", "p.*")
    fits = materialize(known.join(asked, ["kind", "part"]), "fits")
    # Of two words the one that fewer documents have.
    rare = fits.groupBy("query_id", "kind").agg(F.sum("df").alias("df")).groupBy("query_id").agg(F.min(F.struct("df", "kind"))["kind"].alias("kind"))
    return fits.join(rare, ["query_id", "kind"]).select("query_id", "word").join(postings, "word").select("query_id", "doc_id")


def eval_retrieval(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """One row: number of evaluated queries, Recall@k, MRR and NDCG@k over queries with an expected document."""
    asked = expected.select("query_id").distinct()
    hits = ranked.join(expected, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0))).alias("gain"))
    per = asked.join(hits, "query_id", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return per.agg(F.count("*").alias("queries"), mean((F.col("first") <= k).cast("double")).alias("recall"), mean(1.0 / F.col("first")).alias("mrr"), mean(F.col("gain")).alias("ndcg"))


def eval_misses(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, best``: the asked queries without an expected document among the first ``k``, and where the first stands."""
    first = ranked.join(expected, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    return expected.select("query_id").distinct().join(first, "query_id", "left").filter(F.col("best").isNull() | (F.col("best") > k))


def sample_eval_chunks(chunks: DataFrame, n: int, seed: int = 7, least: int = 100) -> DataFrame:
    """``n`` chunks of more than ``least`` characters, by a hash of id and seed."""
    return chunks.filter(F.length("text") > least).orderBy(F.md5(F.concat_ws(":", "doc_id", F.lit(seed))), "doc_id").limit(n)
