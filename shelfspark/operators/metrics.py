"""Counts taken while rows pass by, and the run record."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfspark.schema import RUN


def load_metrics(df: DataFrame, error: str = "error") -> DataFrame:
    """One row: rows read, succeeded, failed."""
    return df.agg(
        F.count("*").alias("rows_read"),
        F.count_if(F.col(error).isNull()).alias("succeeded"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Counts taken by the job that writes the frame, without a pass of their own."""
    watch = Observation()
    return df.observe(watch, *[m.alias(name) for name, m in metrics.items()]), watch


def count_pending_embeddings(products: DataFrame) -> DataFrame:
    from shelfspark.operators.rows import needs_embedding

    return needs_embedding(products).agg(F.count("*").alias("pending"))


def run_record(spark, job: str, started_at: datetime, processed: int, error: str | None = None) -> DataFrame:
    row = (job, started_at, datetime.now(timezone.utc), processed, error)
    return spark.createDataFrame([row], RUN)


def bulk_load(df: DataFrame, path: str, error: str = "error") -> dict[str, int]:
    """Writes the good rows and returns how many went in and how many were refused."""
    counted, watch = observed(
        df,
        rows_read=F.count("*"),
        succeeded=F.count_if(F.col(error).isNull()),
        failed=F.count_if(F.col(error).isNotNull()),
    )
    counted.where(F.col(error).isNull()).drop(error).write.mode("append").parquet(path)
    return watch.get
