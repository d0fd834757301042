"""Rendered pages: a table or a stream of `page_id, url, html`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.html import html_title, html_to_text
from shelfspark.session import with_computed

PAGE_DDL = "page_id bigint, url string, html string"


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_DDL).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGE_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_content(pages: DataFrame) -> DataFrame:
    """Replaces the HTML by the page's title and visible text."""
    read = with_computed(pages, title=html_title(F.col("html")), content=html_to_text(F.col("html")))
    return read.drop("html")
