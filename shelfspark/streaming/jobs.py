"""Structured Streaming jobs over pages and products.

State lives in change tables: each micro-batch adds one folder named after its run
(the stream and its checkpoint) and batch id, so a batch that is replayed replaces
its own rows and nothing else. Streams share a frontier, and a stream that starts
with a new checkpoint keeps what was there. No operator state grows without bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from shelfspark.functions.urls import PRODUCT_PATH
from shelfspark.operators.models import TextEncoder
from shelfspark.operators.rows import needs_embedding, nonempty_text
from shelfspark.plans.crawl import discover_urls, judged, split_judged
from shelfspark.schema import EXTRACTED, FRONTIER, QUARANTINE
from shelfspark.session import BROADCAST_ROWS, at_most, over_all_cores
from shelfspark.sources.tables import read_changes, read_current, write_changes

EMBEDDED = StructType([StructField("url", StringType()), StructField("description_embedding", ArrayType(FloatType()))])


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    """One row per URL: done if any change says so, first seen at the earliest change."""
    changes = read_changes(spark, path, FRONTIER)
    return changes.groupBy("url").agg(
        F.bool_or("already_scraped").alias("already_scraped"), F.min("first_seen").alias("first_seen")
    )


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return read_current(spark, path, EXTRACTED, "url", ["page_id"]).drop("page_id")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return read_current(spark, path, EMBEDDED, "url", [])


def run_name(job: str, checkpoint: str) -> str:
    """The folder name of a job's run: a new checkpoint is a new run."""
    return f"{job}-{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"


def _run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_frontier(
    pages: DataFrame, frontier_path: str, checkpoint: str, inside: str = "/p/", path_pattern: str = PRODUCT_PATH, available_now: bool = True
) -> StreamingQuery:
    """Product URLs on arriving pages, each stored once."""
    run = run_name("discover", checkpoint)

    def work(batch: DataFrame, batch_id: int) -> None:
        # The urls alone decide; the history isn't folded for that. Its files are much smaller than its rows, so it is never broadcast.
        known = read_changes(batch.sparkSession, frontier_path, FRONTIER, (run, batch_id)).select("url").hint("merge")
        fresh = discover_urls(batch, known, inside, path_pattern).select(*FRONTIER.names)
        write_changes(fresh, frontier_path, batch_id, run)

    return _run(pages, work, checkpoint, available_now)


def stream_upsert_products(
    pages: DataFrame, answers: DataFrame, paths: dict[str, str], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Products of arriving pages into ``paths['products']``, failures into ``paths['quarantine']``,
    done marks into ``paths['frontier']``, which the discovering stream may share."""
    run = run_name("extract", checkpoint)

    def work(batch: DataFrame, batch_id: int) -> None:
        asked = answers
        if at_most(batch, BROADCAST_ROWS):
            # Only this batch's answers go on, so a small batch doesn't move the whole table of them.
            asked = answers.join(F.broadcast(batch.select("page_id").distinct()), "page_id", "left_semi")
        read = judged(batch, asked).persist()
        try:
            good, bad = split_judged(read)
            write_changes(good.select(*EXTRACTED.names), paths["products"], batch_id, run)
            write_changes(bad.select(*QUARANTINE.names), paths["quarantine"], batch_id, run)
            done = batch.select("url", F.lit(True).alias("already_scraped"), F.col("page_id").alias("first_seen"))
            write_changes(done, paths["frontier"], batch_id, run)
        finally:
            read.unpersist()

    return _run(pages, work, checkpoint, available_now)


def stream_backfill_embeddings(
    products: DataFrame, encoder: TextEncoder, path: str, checkpoint: str, text: str = "product_context", available_now: bool = True
) -> StreamingQuery:
    """Vectors for arriving products that lack one and have text."""
    run = run_name("embed", checkpoint)

    def work(batch: DataFrame, batch_id: int) -> None:
        # A batch is often a single file, which one task would read and encode.
        pending = over_all_cores(nonempty_text(needs_embedding(batch), text).select("url", text))
        encoded = encoder.encode(pending, text, "description_embedding").select(*EMBEDDED.names)
        write_changes(encoded, path, batch_id, run)

    return _run(products, work, checkpoint, available_now)
