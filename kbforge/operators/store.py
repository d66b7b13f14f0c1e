"""Tables kept in buckets: a commit rewrites the buckets that it touches, and a manifest written last makes it count.

A store holds some tables that are bucketed by the same columns, so that what belongs together (documents, their chunks, the
chunks' postings) changes in one commit. Rows lie at ``data/<table>/<commit>/bucket=<n>``. A manifest is one small table: for
each table and bucket the commit whose rows count. Readers take the newest whole manifest, so a commit is seen whole or not at
all; a lost executor or driver leaves files that no manifest names. A commit has a name, and one that was made before is
not made again. One writer at a time; ``vacuum`` deletes what the last manifests do not name.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbforge.functions.storage import materialize
from kbforge.operators.retrieval import bm25_postings

POSTINGS = "term string, tf long, doc_len long"
#: Changed keys that are broadcast at once.
BROADCAST_KEYS = 500_000


class Store:
    """``tables``: a schema for each name; ``by``: the columns that rows are bucketed by, which all tables have."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], by: list[str], buckets: int = 64, order: dict[str, list[str]] | None = None):
        self.spark, self.root, self.tables, self.by, self.buckets, self.order = spark, root.rstrip("/"), tables, by, buckets, order or {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``: as many numbers as the store has buckets, at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def _names(self) -> list[str]:
        """The whole manifests, oldest first."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in found if fs.exists(marker(p, "_SUCCESS")))

    def committed(self, name: str) -> bool:
        return any(n.split("-", 1)[1] == quote(name, safe="") for n in self._names())

    def files(self) -> dict[tuple[str, int], tuple[str, int]]:
        """For each table and bucket that has rows the commit that wrote them, and their number."""
        names = self._names()
        if not names:
            return {}
        rows = self.spark.read.parquet(f"{self.root}/manifest/{names[-1]}").collect()
        return {(r["name"], r["bucket"]): (r["written"], r["n"]) for r in rows if r["n"]}

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a bucket's together; where there are more partitions than buckets, a bucket is cut into parts."""
        parts = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        return rows.repartition(self.bucket(), F.pmod(F.xxhash64(F.lit(1), *self.by), F.lit(parts)))

    def read(self, table: str, buckets: list[int] | None = None, files: dict | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets; no other file is opened. ``files``: what ``files()`` gave before."""
        wanted = set(range(self.buckets) if buckets is None else buckets)
        known = self.files() if files is None else files
        paths = [f"{self.root}/data/{table}/{written}/bucket={b}" for (name, b), (written, _) in sorted(known.items()) if name == table and b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.tables[table])
        return self.spark.read.schema(self.tables[table]).parquet(*paths)

    def others(self, table: str, touched: list[int], changed: DataFrame, files: dict) -> DataFrame:
        """The rows of the ``touched`` buckets whose keys are not in the written table ``changed``; they stay where they lie.

        The changed keys are broadcast, those of so many buckets at once that about ``BROADCAST_KEYS`` are held.
        """
        there = [b for b in touched if (table, b) in files]
        count = max(1, min(len(there), -(-changed.count() // BROADCAST_KEYS)))
        out = None
        for k in range(count):
            some = there[k::count]
            keys = changed if count == 1 else changed.filter(self.bucket().isin(some))
            part = self.read(table, some, files).join(F.broadcast(keys), self.by, "left_anti")
            out = part if out is None else out.unionByName(part)
        return out

    def commit(self, name: str, touched: list[int], rows: dict[str, DataFrame]) -> bool:
        """Replace the ``touched`` buckets of all tables by ``rows``; false if a commit of that name was made before.

        Rows are written by the tasks that have them, so new ones should be ``dealt``.
        """
        if self.committed(name):
            return False
        safe, files = quote(name, safe=""), {k: v for k, v in self.files().items() if k[1] not in set(touched)}
        for table, new in rows.items():
            folder = f"{self.root}/data/{table}/{safe}"
            placed = new.select(*self.spark.createDataFrame([], self.tables[table]).columns).withColumn("bucket", self.bucket())
            placed.sortWithinPartitions("bucket", *self.order.get(table, self.by)).write.mode("overwrite").partitionBy("bucket").parquet(folder)
            counts = self.spark.read.schema(f"{self.tables[table]}, bucket int").parquet(folder).groupBy("bucket").count().collect()
            files |= {(table, r["bucket"]): (safe, r["count"]) for r in counts}
        names = self._names()
        number = int(names[-1].split("-", 1)[0]) + 1 if names else 0
        kept = [(table, bucket, written, n) for (table, bucket), (written, n) in files.items()] or [("", 0, "", 0)]
        manifest = self.spark.createDataFrame(kept, "name string, bucket int, written string, n long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{number:010d}-{safe}")
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the rows of commits that none of the last ``keep`` manifests names; returns their folders."""
        jvm, named = self.spark.sparkContext._jvm, set()
        for n in self._names()[-keep:]:
            named |= {(r["name"], r["written"]) for r in self.spark.read.parquet(f"{self.root}/manifest/{n}").collect()}
        gone = []
        for table in self.tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{table}")
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for s in fs.listStatus(path) if fs.exists(path) else ():
                if (table, s.getPath().getName()) not in named:
                    fs.delete(s.getPath(), True)
                    gone.append(s.getPath().toString())
        return gone


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by ``order``, of equal ones by a hash of the rest."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order, F.xxhash64(*others))).alias("v")).select(*keys, "v.*")


def _with_postings(store: Store, touched: list[int], fresh: DataFrame, changed: DataFrame, files: dict) -> dict[str, DataFrame]:
    """The tables after rows of the keys in ``changed`` gave way to ``fresh``; postings of these rows alone are counted anew, where
    the dealt texts lie, so no posting is shuffled."""
    dealt = store.dealt(fresh)
    out = {"chunks": store.others("chunks", touched, changed, files).unionByName(dealt)}
    if "postings" in store.tables:
        key = [c for c in store.tables["postings"].replace(",", " ").split()[::2] if c not in ("term", "tf", "doc_len")]
        counted = bm25_postings(dealt.withColumn("_key", F.struct(*key)), "_key").select("_key.*", "term", "tf", "doc_len")
        out["postings"] = store.others("postings", touched, changed, files).unionByName(counted)
    return out


def upsert(store: Store, incoming: DataFrame, order: list[str], name: str) -> bool:
    """Rows of the table ``chunks`` by the store's columns: of each key the greatest by ``order`` stays, of equal ones the incoming one."""
    if store.committed(name):
        return False
    latest = materialize(incoming, "incoming")
    # Texts are grouped only if a key comes twice.
    if not latest.groupBy(*store.by).count().filter("count > 1").isEmpty():
        latest = materialize(_latest(latest, store.by, order), "latest")
    touched, files = store.touched(latest), store.files()
    # Keys meet without their texts.
    before = store.read("chunks", touched, files).select(*store.by, F.struct(*order).alias("_before"))
    late = materialize(latest.select(*store.by, F.struct(*order).alias("_own")).join(before, store.by).filter("_own < _before").select(*store.by), "late")
    count = late.count()
    fresh = latest if not count else materialize(latest.join(F.broadcast(late) if count <= BROADCAST_KEYS else late, store.by, "left_anti"), "fresh")
    changed = fresh.select(*store.by).distinct()
    return store.commit(name, touched, _with_postings(store, touched, fresh, changed, files))


def replace(store: Store, incoming: DataFrame, name: str) -> bool:
    """All rows of the table ``chunks`` whose value of the store's columns is among the incoming ones' give way to these."""
    if store.committed(name):
        return False
    fresh = materialize(incoming, "incoming")
    changed = fresh.select(*store.by).distinct()
    touched, files = store.touched(changed), store.files()
    return store.commit(name, touched, _with_postings(store, touched, fresh, changed, files))


#: Tables of ingested pages; a page without text keeps its row of ``documents``, so that an older version cannot come back.
PAGES = {
    "documents": "page_id long, version long, url string, title string, n_chunks int",
    "chunks": "chunk_id string, page_id long, chunk_index int, total_chunks int, text string, section string, kind string",
    "postings": f"page_id long, chunk_id string, {POSTINGS}",
}


def page_store(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    return Store(spark, root, PAGES, ["page_id"], buckets, {"postings": ["term", "chunk_id"], "chunks": ["page_id", "chunk_index"]})


def ingest_pages(store: Store, pages: DataFrame, read: Callable[[DataFrame], DataFrame], name: str) -> bool:
    """Pages (``page_id, version, url, html``) into a ``page_store``: read, cut, counted and stored in one commit.

    Of a page the greatest version counts, and one that the store has already (or a newer one) changes nothing. All chunks of
    a page give way to those of its new version, so none is left over from a longer one. ``read`` gives ``chunks``' columns
    with ``title`` for each chunk of ``page_id, url, html``, one row with a null text for a page without any. Rows without a
    ``page_id`` or ``version`` are not ingested.
    """
    if store.committed(name):
        return False
    latest = _latest(pages.select("page_id", "version", "url", "html").filter("page_id IS NOT NULL AND version IS NOT NULL"), ["page_id"], ["version"])
    latest = materialize(latest, "pages")
    touched, files = store.touched(latest), store.files()
    known = store.read("documents", touched, files).select("page_id", F.col("version").alias("known"))
    fresh = latest.join(known, "page_id", "left").filter("known IS NULL OR version > known").drop("known")
    cut = materialize(read(fresh), "cut")
    chunks = cut.filter("text IS NOT NULL").select(*store.spark.createDataFrame([], PAGES["chunks"]).columns)
    titles = cut.groupBy("page_id").agg(F.max("title").alias("title"), F.count("text").cast("int").alias("n_chunks"))
    documents = fresh.select("page_id", "version", "url").join(titles, "page_id")
    changed = materialize(titles.select("page_id"), "changed")
    chunks = store.dealt(chunks)
    counted = bm25_postings(chunks.withColumn("_key", F.struct("page_id", "chunk_id")), "_key").select("_key.*", "term", "tf", "doc_len")
    new = {"documents": store.dealt(documents), "chunks": chunks, "postings": counted}
    stay = {table: store.others(table, touched, changed, files) for table in new}
    return store.commit(name, touched, {table: stay[table].unionByName(new[table].select(*stay[table].columns)) for table in new})
