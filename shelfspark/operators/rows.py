"""Filters, projections, limits and hit shapes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import fields
from shelfspark.schema import LIST_FIELDS

#: Scores are compared at this many decimals; equal scores are ordered by id.
SCORE_DECIMALS = 6


def pending_urls(frontier: DataFrame, n: int = 100) -> DataFrame:
    """The next ``n`` unscraped URLs, oldest first."""
    return frontier.where(~F.col("already_scraped")).orderBy("first_seen", "url").limit(n)


def needs_embedding(products: DataFrame) -> DataFrame:
    return products.where(F.col("description_embedding").isNull() & F.col("description").isNotNull())


def nonempty_text(df: DataFrame, text: str = "product_context") -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.col(text) != ""))


def scan_projected(products: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    out = products.select(*columns)
    return out if limit is None else out.limit(limit)


def split_bad_rows(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the rows to look at."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def limit_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def topk(df: DataFrame, k: int | Column, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark cuts to ``k`` before the shuffle as well."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def topk_by_score(df: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    return topk(df, k, [by], [F.col(score).desc(), F.col(tie)])


def product_projection(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The twelve product columns; lists stay text, prices become numbers or null."""
    return raw.select(
        *(keep or []),
        "url",
        "title",
        "description",
        fields.to_number(F.col("price_without_discount")).alias("price_without_discount"),
        fields.to_number(F.col("price")).alias("price"),
        *LIST_FIELDS,
        F.col("resumen_producto").alias("product_resume"),
        F.lit("").alias("product_context"),
    )


def stamp_updated_at(df: DataFrame, at: datetime | None = None) -> DataFrame:
    """Adds ``context_updated_at``: one time for the whole batch."""
    return df.withColumn("context_updated_at", F.current_timestamp() if at is None else F.lit(at).cast("timestamp"))


def standardize_hits(hits: DataFrame, source: str, score: str) -> DataFrame:
    """Hits of any source in one shape. A column the source lacks takes its default; nulls stay."""

    def column(name: str, default: Column) -> Column:
        return (F.col(name) if name in hits.columns else default).alias(name)

    return hits.select(
        "query_id",
        "id",
        "title",
        column("description", F.lit("")),
        column("price", F.lit(0.0)),
        column("url", F.lit(None).cast("string")),
        column("resumen", F.lit("") if source == "elastic" else F.lit(None).cast("string")),
        F.lit(source).alias("source"),
        F.col(score).alias("original_score"),
        F.col("rank").alias("source_rank"),
    )


def limit_per_query(hits: DataFrame, queries: DataFrame, default: int = 100) -> DataFrame:
    """Each query's first ``limit`` hits, from the ``limit`` column of the query table (null: ``default``).

    The search before it takes the largest limit as its size. Hits carry their rank, so no row is sorted again.
    """
    limits = queries.select("query_id", F.coalesce("limit", F.lit(default)).alias("_limit"))
    return hits.join(limits, "query_id").where(F.col("rank") <= F.col("_limit")).select(*hits.columns)


def merge_products(hits: DataFrame) -> DataFrame:
    """One row per query and product, from standard hits of several sources: all sources, best score and rank, first known texts."""
    texts = ["title", "description", "price", "url", "resumen"]
    return hits.groupBy("query_id", "id").agg(
        *[F.min(c).alias(c) for c in texts],
        F.array_join(F.sort_array(F.collect_set("source")), "+").alias("source"),
        F.max("original_score").alias("original_score"),
        F.min("source_rank").alias("source_rank"),
    )


def union_hits(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both hit lists, nothing merged."""
    return lexical.unionByName(semantic, allowMissingColumns=True)


def format_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answer columns of a semantic search; rows with a missing text go to the second frame."""
    texts = ["title", "url", "description"]
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in texts]), lambda c: c.isNotNull())
    shaped = hits.select(
        "query_id",
        "id",
        *texts,
        F.col("similarity").alias("similarity_score"),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))).alias("error"),
    )
    return split_bad_rows(shaped)


def attach(hits: DataFrame, table: DataFrame, columns: list[str], hit_bound: int | None, key: str = "id") -> DataFrame:
    """Stored columns for the hits, with the hits broadcast only if their number is known to be low."""
    from shelfspark.session import small_side

    return small_side(hits, hit_bound).join(table.select(key, *columns), key)
