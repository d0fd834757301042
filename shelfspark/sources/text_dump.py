"""Append-only text files, one folder per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.templates import page_record
from shelfspark.functions.urls import site_name


def page_records(pages: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """`site, value`: the formatted block of every page."""
    return pages.select(site_name(F.col(url)).alias("site"), page_record(F.col(url), F.col(content)).alias("value"))


def append_text_dump(pages: DataFrame, path: str, url: str = "url", content: str = "content") -> None:
    """Appends every page's block to its site. No shuffle: each task writes what it holds."""
    page_records(pages, url, content).write.partitionBy("site").mode("append").option("lineSep", "\n").text(path)
