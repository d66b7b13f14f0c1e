"""The search log and its feedback as tables in a folder a day, from which old days go without being read.

Feedback lies under the day of its search, so what is to go with a search lies under one day. Only the day in which the
cutoff falls is read; its rest replaces it by a dynamic partition overwrite. Rows without a time, and feedback on searches
that are not in the log, lie in a partition of their own and stay.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions.storage import materialize


class DayLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, log: DataFrame, feedback: DataFrame) -> None:
        """``log`` has ``id`` and ``created_at``, ``feedback`` a ``search_id``."""
        placed = log.withColumn("day", F.to_date("created_at"))
        self._write("searches", placed)
        days = placed.select(F.col("id").alias("search_id"), "day").filter("id IS NOT NULL")
        self._write("feedback", feedback.join(days, "search_id", "left"))

    def _write(self, table: str, rows: DataFrame) -> None:
        rows.limit(0).coalesce(1).write.parquet(f"{self.root}/{table}-schema")
        rows.write.partitionBy("day").parquet(f"{self.root}/{table}")

    def _read(self, table: str) -> DataFrame:
        """A table's rows; its schema lies beside it, as all days may be gone."""
        return self.spark.read.schema(self.spark.read.parquet(f"{self.root}/{table}-schema").schema).parquet(f"{self.root}/{table}")

    def searches(self) -> DataFrame:
        return self._read("searches").drop("day")

    def feedback(self) -> DataFrame:
        return self._read("feedback").drop("day")

    def days(self, table: str) -> dict[date, str]:
        """The folder of each day, from the file system."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = {}
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("day=") and name != "day=__HIVE_DEFAULT_PARTITION__":
                found[date.fromisoformat(name[4:])] = status.getPath().toString()
        return found

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def purge(self, as_of: str, days: int = 90) -> None:
        """Searches of more than ``days`` before ``as_of`` go, and the feedback on them; 0 days turns it off.

        Feedback goes first, so what a lost run leaves is found by the next one.
        """
        if days <= 0:
            return
        cutoff = datetime.fromisoformat(as_of) - timedelta(days=days)
        edge, tables = cutoff.date(), {t: self.days(t) for t in ("feedback", "searches")}
        if edge in tables["searches"]:
            rows = self._read("searches").filter(F.col("day") == F.lit(edge))
            old = F.col("created_at") < F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz" if dict(rows.dtypes)["created_at"] == "timestamp_ntz" else "timestamp")
            gone = materialize(rows.filter(old).select(F.col("id").alias("search_id")), "gone")
            if edge in tables["feedback"]:
                self._rewrite("feedback", tables["feedback"][edge], self._read("feedback").filter(F.col("day") == F.lit(edge)).join(gone, "search_id", "left_anti"))
            self._rewrite("searches", tables["searches"][edge], rows.filter(~old))
        for folders in tables.values():
            for day, folder in folders.items():
                if day < edge:
                    self._delete(folder)

    def _rewrite(self, table: str, folder: str, rest: DataFrame) -> None:
        """Put ``rest`` in the place of its day."""
        rest = materialize(rest, "rest")
        if rest.isEmpty():
            self._delete(folder)
        else:
            rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.root}/{table}")
