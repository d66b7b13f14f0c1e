"""URL filters by a sort-merge range join of reversed-host keys, in DataFrame operations only.

A rule ``host + path prefix`` becomes the key ``labels of the host, last first, "/" + path``; the urls that it fits have
keys that begin with it, an interval of the sort order. A url asks once for its host and once for each parent domain
(as many labels as the longest rule has, at most). Rules and asks are sorted together; intervals of prefixes nest, so at
each rule start the stack of rules that are still open is known, and an ask takes the deepest rule of the last stack
that begins its key. Each key is swept once, however many urls ask for it; ranges of the sort order run apart, each starts with
the last rule before it. Frequent keys meet the urls that ask for them, and frequent urls their pages, by bounded broadcasts,
so neither one url, one domain nor the pages without a host make a large group.

Hosts and paths: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#``
or the end. A null url or one without ``://`` has an empty host and path, fits no rule and gets the default verdict. Of
rules that fit, the longest (host and path) wins, of equally long ones that of the longer host. The same rule given twice
counts once, ``block`` before ``allow`` if the verdicts differ. Null ids and repeated rows stay, other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbforge.functions.storage import materialize
from kbforge.operators.components import join_counted

#: Verdict, host, path prefix.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"
#: Between labels and between host and path; below every character that a url may hold.
_SEP = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _SEP), F.lit(_SEP + _SEP), path)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def stacks(rules: DataFrame) -> DataFrame:
    """``key`` and the stack of rules open at it, outermost first, the rule itself last.

    Found by equi-joins of each key with its own prefixes, so that the list of rules may be long.
    """
    own = rules.filter("host IS NOT NULL AND path IS NOT NULL").withColumn("host", F.translate("host", _UPPER, _LOWER))
    own = own.withColumn("key", _key(F.col("host"), F.col("path")))
    one = own.groupBy("key").agg(
        F.max("verdict").alias("verdict"), F.concat(F.first("host"), F.first("path")).alias("rule"), F.first(F.length("host") + F.length("path")).alias("size"), F.first(F.length("host")).alias("host_size")
    )
    cuts = one.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", 1, n))).alias("open"))
    entry = F.struct(F.length("key").alias("depth"), F.col("key").alias("at"), "size", "host_size", "rule", "verdict")
    return cuts.join(one.select(F.col("key").alias("open"), entry.alias("entry")), "open").groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page."""
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    starts = stacks(rules)
    labels = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("most")).first()["most"]

    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = ["host", "path"]
    texts = materialize(seen.filter("host <> ''").groupBy(*urls).agg(F.count("*").alias("n")), "urls")
    parts = F.split("host", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels)))), lambda n: F.array_join(F.slice(F.reverse(parts), F.lit(1), n), _SEP))
    asks = texts.select("host", "path", F.explode(heads).alias("head")).select("host", "path", F.concat("head", F.lit(_SEP + _SEP), "path").alias("key"))

    # Many urls ask for one key (all hosts below a domain for the domain), so keys are swept once each.
    keys = materialize(asks.groupBy("key").agg(F.count("*").alias("n")), "url-keys")
    # A rule sorts before the ask of the same key, since its count is null.
    both = starts.select("key", F.lit(None).cast("long").alias("n"), "stack").unionByName(keys, allowMissingColumns=True)
    # Written, so that both readers below see the same ranges.
    dealt = materialize(both.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "url-ranges")
    last = dealt.groupBy("range").agg(F.max(F.when(F.col("stack").isNotNull(), F.struct("key", "stack"))).alias("last"))
    # One row for each range: as many as there are shuffle partitions.
    carried = last.select("range", F.last("last", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))["stack"].alias("carried"))
    sweep = Window.partitionBy("range").orderBy("key", F.col("n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.coalesce(F.last("stack", ignorenulls=True).over(sweep), F.col("carried"))
    held = dealt.join(F.broadcast(carried), "range").withColumn("open", open_).filter("n IS NOT NULL")
    fits = F.filter("open", lambda r: F.col("key").startswith(r["at"]))
    top = F.get(F.sort_array(F.transform(fits, lambda r: F.struct(r["size"], r["host_size"], r["rule"], r["verdict"])), asc=False), F.lit(0))
    found = materialize(held.select("key", "n", top.alias("top")).filter("top IS NOT NULL"), "url-hits")
    asked = keys.agg(F.sum("n")).first()[0] or 0
    best = join_counted(asks, found, "key", asked).groupBy(*urls).agg(F.max("top").alias("top"))
    best = materialize(best, "judged")
    # Urls of more than a thousandth of the pages, at most a thousand, are met by a broadcast; pages without a host by none.
    often = texts.filter(F.col("n") > max(1000, (texts.agg(F.sum("n")).first()[0] or 0) // 1000)).select(*urls)
    by_often = seen.join(F.broadcast(often.join(best.hint("merge"), urls, "left")), urls)
    by_shuffle = seen.filter("host <> ''").join(F.broadcast(often), urls, "left_anti").join(best.hint("merge"), urls, "left")
    without = seen.filter("host = ''").withColumn("top", F.lit(None).cast(best.schema["top"].dataType))
    each = by_often.unionByName(by_shuffle).unionByName(without)
    return each.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT row_number() OVER () AS rid, page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT rid, h || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC) AS k
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
"""
