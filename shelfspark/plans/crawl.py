"""Crawl jobs: discover product URLs on pages, extract products from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.answers import with_parsed_answer, with_product_columns
from shelfspark.functions.html import html_title, links
from shelfspark.functions.templates import EXTRACT_TEMPLATE, fill
from shelfspark.functions.urls import PRODUCT_PATH, is_product_url, resolve_link
from shelfspark.operators.keyed_writes import absent_rows, mark_done, upsert
from shelfspark.operators.models import TextModel, apply_text_model
from shelfspark.operators.rows import split_bad_rows
from shelfspark.sources.pages import with_content


def extract_links(pages: DataFrame, inside: str = "/p/") -> DataFrame:
    """`page_id, url, href`: one row per matching anchor."""
    return pages.select("page_id", "url", F.explode(links(F.col("html"), inside)).alias("href"))


def found_urls(pages: DataFrame, inside: str = "/p/", path_pattern: str = PRODUCT_PATH) -> DataFrame:
    """`url, already_scraped, first_seen`: every distinct product URL on the pages."""
    absolute = extract_links(pages, inside).select(resolve_link(F.col("url"), F.col("href")).alias("url"), "page_id")
    return (
        absolute.where(is_product_url(F.col("url"), path_pattern))
        .groupBy("url")
        .agg(F.min("page_id").alias("first_seen"))
        .select("url", F.lit(False).alias("already_scraped"), "first_seen")
    )


def discover_urls(
    pages: DataFrame, frontier: DataFrame, inside: str = "/p/", path_pattern: str = PRODUCT_PATH
) -> DataFrame:
    """Frontier rows for product URLs it does not hold yet."""
    return absent_rows(found_urls(pages, inside, path_pattern), frontier, "url", ["first_seen"])


def ask_for_answers(pages: DataFrame, factory: Callable[[], TextModel]) -> DataFrame:
    """`page_id, answer` from a model that reads the extraction prompt; a failed call leaves a null answer."""
    asked = with_content(pages).withColumn("prompt", fill(EXTRACT_TEMPLATE, content=F.col("content")))
    return apply_text_model(asked, "prompt", "answer", factory).select("page_id", "answer")


def judged(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Each page's title beside its parsed answer, with ``error`` where that is unusable."""
    titled = pages.select("page_id", "url", html_title(F.col("html")).alias("title"))
    # Answers are long texts that Spark's estimate by type takes for short ones, so it would send a large table of them through the driver.
    return with_parsed_answer(titled.join(answers.hint("merge"), "page_id", "left"))


def extracted(pages: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed products with `page_id`, and the pages whose answer is unusable (with ``error``)."""
    return split_judged(judged(pages, answers))


def split_judged(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = split_bad_rows(pages)
    return with_product_columns(good).drop("answer", "json"), bad.select("page_id", "url", "answer", "error")


@dataclass(frozen=True)
class Extraction:
    products: DataFrame
    frontier: DataFrame
    quarantine: DataFrame


def extract_products(pages: DataFrame, answers: DataFrame, products: DataFrame, frontier: DataFrame) -> Extraction:
    """One pass over fetched pages: store products by url, mark every page done, keep failures for review."""
    good, bad = extracted(pages, answers)
    return Extraction(upsert(products, good, "url", ["page_id"]), mark_done(frontier, pages), bad)
