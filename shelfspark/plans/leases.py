"""The crawl from pending URL to stored product, over a frontier that hands out leases.

A round takes some pending URLs, oldest first, and marks them as leased until a time. It reads
their pages, asks a model, stores products, keeps failures for review, and marks all of them done.
If a job dies in between, its leases run out and the URLs are taken again, a bounded number of
times. Storing the same products twice changes nothing, so a round may be repeated.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.models import TextModel
from shelfspark.plans.crawl import ask_for_answers, extracted
from shelfspark.schema import EXTRACTED, QUARANTINE
from shelfspark.session import kept
from shelfspark.sources.keyed_tables import KeyedTable
from shelfspark.sources.tables import write_changes

#: Times a URL is handed out before it is given up.
MAX_TRIES = 3


def open_frontier(frontier: DataFrame, path: str, buckets: int = 64) -> KeyedTable:
    """The frontier as a keyed table with `tries` and `leased_until` (seconds since 1970, null if free)."""
    rows = frontier.select("*", F.lit(0).alias("tries"), F.lit(None).cast("double").alias("leased_until"))
    return KeyedTable.create(rows, path, "url", buckets)


def take(frontier: KeyedTable, spark: SparkSession, n: int, now: float, seconds: float, max_tries: int = MAX_TRIES) -> DataFrame:
    """`url, tries`: up to ``n`` free pending URLs, leased for so many seconds from ``now``."""
    free = F.col("leased_until").isNull() | (F.col("leased_until") <= now)
    pending = frontier.read(spark).where(~F.col("already_scraped") & free & (F.col("tries") < max_tries))
    taken = kept(pending.orderBy("first_seen", "url").limit(n).select("url", (F.col("tries") + 1).alias("tries")), "leased")
    frontier.update(taken.withColumn("leased_until", F.lit(now + seconds)), ["tries", "leased_until"], ["tries"])
    return taken


def settle(frontier: KeyedTable, urls: DataFrame) -> None:
    """Marks URLs done, whatever came of them."""
    done = urls.select("url", F.lit(True).alias("already_scraped"), F.lit(None).cast("double").alias("leased_until"))
    frontier.update(done, ["already_scraped", "leased_until"], ["already_scraped"])


def given_up(frontier: KeyedTable, spark: SparkSession, now: float, max_tries: int = MAX_TRIES) -> DataFrame:
    """URLs whose every lease ran out."""
    return frontier.read(spark).where(~F.col("already_scraped") & (F.col("tries") >= max_tries) & (F.col("leased_until") <= now))


def crawl_round(
    frontier: KeyedTable, taken: DataFrame, pages: DataFrame, model: Callable[[], TextModel], products: KeyedTable, quarantine: str, run: str, batch_id: int
) -> None:
    """One round over leased URLs: page text, prompt, answer, product; what fails goes to ``quarantine`` with its reason."""
    fetched = kept(pages.join(taken.select("url"), "url", "left_semi").select(pages.columns), "fetched")
    answers = kept(ask_for_answers(fetched, model), "answers")
    good, bad = extracted(fetched, answers)
    products.upsert(good.select(*EXTRACTED.names), ["page_id"])
    absent = taken.join(fetched.select("url").distinct(), "url", "left_anti")
    absent = absent.select(F.lit(None).cast("long").alias("page_id"), "url", F.lit(None).cast("string").alias("answer"), F.lit("no page").alias("error"))
    write_changes(bad.select(*QUARANTINE.names).unionByName(absent), quarantine, batch_id, run)
    settle(frontier, taken)


def crawl(
    frontier: KeyedTable,
    pages: DataFrame,
    model: Callable[[], TextModel],
    products: KeyedTable,
    quarantine: str,
    batch: int = 1000,
    lease_seconds: float = 3600.0,
    max_tries: int = MAX_TRIES,
    clock: Callable[[], float] = time.time,
) -> int:
    """Rounds until no URL is free; returns their number. ``pages`` holds fetched pages (`page_id, url, html`)."""
    spark, run, rounds = pages.sparkSession, f"crawl-{uuid.uuid4().hex[:12]}", 0
    while True:
        taken = take(frontier, spark, batch, clock(), lease_seconds, max_tries)
        if taken.isEmpty():
            return rounds
        crawl_round(frontier, taken, pages, model, products, quarantine, run, rounds)
        rounds += 1
