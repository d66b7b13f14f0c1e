"""Ingestion of pages as a stream: files of page versions in, a store of documents, chunks and postings out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions import helpers
from kbforge.operators.corpus import chunk_rows
from kbforge.operators.store import Store, ingest_pages

VERSIONS = "page_id long, version long, url string, html string"


def page_chunks(size: int = 1000, overlap: int = 100, separator: str = ". ") -> Callable[[DataFrame], DataFrame]:
    """Pages (``page_id, url, html``) to their main text's chunks, with title; a page without text gives one row without a chunk."""

    def read(pages: DataFrame) -> DataFrame:
        main = pages.select("page_id", helpers.html_column(F.col("html")).alias("p")).select("page_id", "p.title", "p.text")
        cut = chunk_rows(main, helpers.chunk_column(F.col("text"), "plain", size=size, overlap=overlap, separator=separator), "page_id")
        return main.select("page_id", "title").join(cut, "page_id", "left")

    return read


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The page versions of a folder's Parquet files, as they come in."""
    return spark.readStream.schema(VERSIONS).parquet(folder)


def into(store: Store, run: str = "0", read: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that ingests a batch in one commit; ``run`` names the checkpoint.

    A batch that is delivered again finds its commit made, and pages that come again in another batch their version stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        ingest_pages(store, batch, read or page_chunks(), f"{run}.{number}")

    return write
