"""Full-text search with prefixes over a stored index: sorted postings, and a sorted dictionary of their terms.

Postings lie in ranges of (term, document), so a frequent term may fill several; the dictionary lies in ranges of terms, and of
each the first and the last one are known. A prefix is an interval of the dictionary: it meets the ranges that it overlaps, of
which only these are opened, and in them its terms by equality with their beginnings. A term names the ranges of its postings,
so only those are opened. There are as many ranges as shuffle partitions, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions.storage import scratch
from kbforge.functions.stemming import stem_column, stems_column
from kbforge.operators import retrieval

#: Words that combine terms in a search and are no terms.
SEARCH_WORDS = ("near", "not", "or", "and")
#: Terms that more than one in so many of the asked postings have are broadcast: fewer than that.
OFTEN = 50_000


def stemmed(docs: DataFrame) -> DataFrame:
    """The postings of ``docs`` by stems, counted where texts are read."""
    return retrieval.bm25_postings(docs, stems=stems_column).select("doc_id", "term", "doc_len", "tf")


@dataclass
class TextIndex:
    """An index in the folder ``root``; ``stem`` tells whether its terms are stems."""

    spark: SparkSession
    root: str
    stem: bool

    def _folders(self, table: str, column: str, numbers: list[int], schema: str) -> DataFrame:
        paths = [f"{self.root}/{table}/{column}={n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def terms(self, prefixes: DataFrame) -> DataFrame:
        """``prefix, term, df, low, high`` of the terms that begin with one of ``prefixes (prefix)``, with their postings' ranges."""
        bounds = self.spark.read.parquet(f"{self.root}/bounds")
        overlaps = (F.col("last") >= F.col("prefix")) & (F.expr("substring(first, 1, length(prefix))") <= F.col("prefix"))
        # As many bounds as ranges; their numbers, and the lengths of words, come to the driver.
        parts = sorted(r[0] for r in prefixes.join(F.broadcast(bounds), overlaps).select("part").distinct().collect())
        sizes = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
        own = self._folders("dictionary", "part", parts, "term string, df long, low int, high int")
        begin = F.filter(F.array(*(F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sizes)), lambda x: x.isNotNull()) if sizes else F.array().cast("array<string>")
        return own.withColumn("prefix", F.explode(begin)).join(retrieval.bounded(prefixes), "prefix")

    def ranges(self, terms: DataFrame) -> DataFrame:
        """``doc_id, term, tf, doc_len`` of the ranges that hold some of the dictionary's terms (``term, low, high``)."""
        ranges = sorted(r[0] for r in terms.select(F.explode(F.sequence("low", "high"))).distinct().collect())
        kind = self.spark.read.parquet(f"{self.root}/kind").schema["doc_id"].dataType.simpleString()
        return self._folders("postings", "range", ranges, f"doc_id {kind}, term string, tf long, doc_len long")

    def postings(self, terms: DataFrame) -> DataFrame:
        """``doc_id, term, tf, doc_len`` of some of the dictionary's terms (``term, low, high``)."""
        return self.ranges(terms).join(retrieval.bounded(terms.select("term").distinct()), "term", "left_semi")


def build(docs: DataFrame, stem: bool = False, root: str | None = None) -> TextIndex:
    """Write the index of ``doc_id, text``."""
    spark = docs.sparkSession
    root = root or scratch(spark, "fulltext")
    found = stemmed(docs) if stem else retrieval.bm25_postings(docs)
    dealt = found.select("doc_id", "term", "tf", "doc_len").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    dealt.withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{root}/postings")
    docs.select("doc_id").limit(0).coalesce(1).write.parquet(f"{root}/kind")
    written = spark.read.schema("term string, range int").parquet(f"{root}/postings")
    terms = written.groupBy("term").agg(F.count("*").alias("df"), F.min("range").alias("low"), F.max("range").alias("high"))
    terms.repartitionByRange("term").sortWithinPartitions("term").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{root}/dictionary")
    listed = spark.read.schema("term string, part int").parquet(f"{root}/dictionary")
    listed.groupBy("part").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.parquet(f"{root}/bounds")
    docs.agg(F.count("*").alias("n"), F.sum(F.size(retrieval.terms_of(F.col("text")))).alias("total")).write.parquet(f"{root}/sizes")
    return TextIndex(spark, root, stem)


def search(index: TextIndex, queries: DataFrame, k: int = 100) -> DataFrame:
    """``query_id, doc_id, score, rank``: BM25 in which a query's term stands for every term that begins with it; the words that
    combine terms are none here.

    Of a term only the longest prefix asked for is kept: which others begin it, and so which queries ask for it, follows from that
    one. So a posting stays one row until those of its document are together; only there it meets the queries, and no pair of a query
    and a document is shuffled but the best of each task. The ``OFTEN`` most frequent terms at most are broadcast to their postings,
    which then are shuffled by their document alone.
    """
    asked = retrieval.query_terms(queries).filter(~F.col("term").isin(*SEARCH_WORDS))
    if index.stem:
        asked = asked.select("query_id", stem_column(F.col("term")).alias("term")).distinct()
    asked = retrieval.materialize(asked.withColumnRenamed("term", "prefix"), "asked")
    prefixes = retrieval.materialize(asked.select("prefix").distinct().withColumn("no", F.monotonically_increasing_id()), "prefixes")
    starts = F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda i: F.substring(F.col("prefix"), F.lit(1), i))
    asking = prefixes.select("no", F.explode(starts).alias("prefix")).join(asked, "prefix").select("no", "query_id").distinct()
    asking = retrieval.bounded(retrieval.materialize(asking, "asking"))
    # Of prefixes of one term the longest is the last in order.
    longest = index.terms(prefixes.select("prefix")).groupBy("term", "df", "low", "high").agg(F.max("prefix").alias("prefix"))
    terms = retrieval.materialize(longest.join(retrieval.bounded(prefixes), "prefix").drop("prefix"), "terms")
    sizes = index.spark.read.parquet(f"{index.root}/sizes")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.crossJoin(F.broadcast(sizes)).select("term", "df", "no", idf.alias("idf"), (F.col("total") / F.col("n")).alias("avg_len"))
    limit = (terms.agg(F.sum("df")).first()[0] or 0) // OFTEN
    own, often = index.ranges(terms), F.broadcast(weights.filter(F.col("df") > limit))
    met = own.join(often, "term").unionByName(own.join(often, "term", "left_anti").join(weights.filter(F.col("df") <= limit).hint("merge"), "term"))
    weight = F.col("idf") * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("doc_len") / F.col("avg_len")))
    gathered = met.select("doc_id", "no", weight.alias("weight")).repartition("doc_id").groupBy("doc_id", "no").agg(F.sum("weight").alias("weight"))
    scored = gathered.join(asking, "no").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return retrieval.top_k(scored, k)
