"""Catalog jobs: load, summarize, refresh contexts, backfill embeddings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.functions.fields import price_error
from shelfspark.operators.keyed_writes import partial_update, put_by_id, upsert
from shelfspark.operators.metrics import observed, run_record
from shelfspark.operators.models import ModelEncoder, TextEncoder, generate_context, summarize_title
from shelfspark.operators.rows import (
    needs_embedding,
    nonempty_text,
    product_projection,
    scan_projected,
    split_bad_rows,
    stamp_updated_at,
)
from shelfspark.schema import RAW_CATALOG, RAW_CATALOG_NO_SUMMARY
from shelfspark.sources.catalog_csv import MALFORMED, scan_catalog_csv, scan_with_malformed, write_catalog_csv


def with_row_id(df: DataFrame, name: str = "id", place: str | None = None) -> DataFrame:
    """A number for each row of files just read, from the file's name and the row's place in it.

    ``place`` names a column of text that sorts rows by file and place.

    The same files give the same numbers, however Spark packs them into tasks. Only
    the first place of each file part is gathered, by a join, and no row is moved for it.
    """
    placed = df.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    placed = placed.withColumn("_m", F.monotonically_increasing_id())
    first = placed.groupBy("_f", "_b").agg(F.min("_m").alias("_m0"))
    number = F.xxhash64("_f", "_b", F.col("_m") - F.col("_m0"))
    sortable = F.format_string("%s:%020d:%020d", "_f", "_b", F.col("_m") - F.col("_m0"))
    added = [number.alias(name), *([sortable.alias(place)] if place else [])]
    return placed.join(first, ["_f", "_b"]).select(*added, *df.columns)


def load_errors(raw: DataFrame) -> DataFrame:
    """Adds ``error``: why a raw row cannot be loaded."""
    reasons = [price_error(F.col(c), c) for c in ("price_without_discount", "price")]
    if MALFORMED in raw.columns:
        reasons.insert(0, F.when(F.col(MALFORMED).isNotNull(), F.lit("malformed row")))
    return raw.withColumn("error", F.coalesce(*reasons))


@dataclass(frozen=True)
class Loaded:
    documents: DataFrame
    nodes: DataFrame
    outcomes: DataFrame
    refused: DataFrame


def load_catalog(
    spark: SparkSession, path: str, documents: DataFrame | None = None, nodes: DataFrame | None = None
) -> Loaded:
    """Reads the file and puts every good row into both stores: documents by place in the file, nodes by url.

    Refused rows carry the reason, and rows with too few or too many cells their text.
    """
    raw = with_row_id(scan_with_malformed(spark, path, RAW_CATALOG), place="_place")
    good, refused = split_bad_rows(load_errors(raw))
    rows = product_projection(good, keep=["id", "_place"])
    no_rows = rows.drop("_place").limit(0)
    documents, outcomes = put_by_id(no_rows if documents is None else documents, rows, "id", ["_place"])
    target = no_rows.drop("id") if nodes is None else nodes
    return Loaded(documents, upsert(target, rows, "url", ["_place"]), outcomes, refused.drop("_place"))


def refused_rows(spark: SparkSession, path: str, schema: StructType = RAW_CATALOG) -> DataFrame:
    """`id, place, malformed_row`: rows of a catalog file whose cells don't fit its header."""
    raw = with_row_id(scan_with_malformed(spark, path, schema), place="place")
    return raw.where(F.col(MALFORMED).isNotNull()).select("id", "place", MALFORMED)


def summarize_catalog(
    spark: SparkSession, source: str, target: str, nodes: DataFrame | None = None, refused: str | None = None
) -> DataFrame:
    """Adds short summaries to a catalog file, writes it, and returns the node store with its rows.

    Malformed rows can't be summarized; they are written to ``refused``, if it is named.
    """
    if refused:
        refused_rows(spark, source, RAW_CATALOG_NO_SUMMARY).write.mode("overwrite").parquet(refused)
    raw = scan_catalog_csv(spark, source, RAW_CATALOG_NO_SUMMARY)
    write_catalog_csv(raw.withColumn("resumen_producto", summarize_title(F.col("title"))), target)
    read = with_row_id(scan_catalog_csv(spark, target), place="_place")
    rows = product_projection(read, keep=["_place"]).drop("product_context")
    return upsert(rows.limit(0).drop("_place") if nodes is None else nodes, rows, "url", ["_place"])


def refresh_context(
    products: DataFrame,
    at: datetime | None = None,
    context: Column | None = None,
    invalidate_embedding: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """A new context for every product, with its time; old embeddings stay unless invalidated."""
    source = scan_projected(products, ["url", "title", "description"], limit)
    made = generate_context(F.col("title"), F.col("description")) if context is None else context
    updates = stamp_updated_at(source.select("url", made.alias("product_context")), at)
    columns = ["product_context", "context_updated_at"]
    if invalidate_embedding:
        updates = updates.withColumn(
            "description_embedding", F.lit(None).cast(products.schema["description_embedding"].dataType)
        )
        columns.append("description_embedding")
    return partial_update(products, updates, "url", columns, ["context_updated_at", "product_context"])[0]


def backfill_embeddings(
    products: DataFrame, encoder: TextEncoder | ModelEncoder, path: str, text: str = "product_context"
) -> DataFrame:
    """Embeds products that lack a vector, writes the new table to ``path``, returns the run record.

    The vectors are counted by the job that writes them. A text that the encoder fails on
    stays pending; a failure of the job ends the run and is kept in its record.
    """
    started = datetime.now(timezone.utc)
    element = products.schema["description_embedding"].dataType.elementType.simpleString()
    pending = nonempty_text(needs_embedding(products), text).select("url", text)
    if pending.isEmpty():
        # Nothing to encode or to count: the table goes on as it is.
        return _backfilled(products, path, started, lambda: 0)
    encoded = encoder.encode(pending, text, "description_embedding", element).select("url", "description_embedding")
    counted, watch = observed(encoded, n=F.count("description_embedding"))
    embedded = partial_update(products, counted, "url", ["description_embedding"], ["url", "description_embedding"])[0]
    return _backfilled(embedded, path, started, lambda: watch.get["n"])


def _backfilled(products: DataFrame, path: str, started: datetime, counted: Callable[[], int]) -> DataFrame:
    try:
        products.write.mode("overwrite").parquet(path)
        return run_record(products.sparkSession, "backfill_embeddings", started, counted())
    except Exception as exc:
        return run_record(products.sparkSession, "backfill_embeddings", started, 0, f"{type(exc).__name__}: {exc}"[:500])
