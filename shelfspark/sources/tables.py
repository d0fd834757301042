"""Table life cycle, several sinks at once, and change tables on plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from shelfspark.operators.keyed_writes import latest_by_key


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create_table_if_absent(
    spark: SparkSession,
    name: str,
    schema: StructType,
    bucket_by: str | None = None,
    buckets: int = 64,
    path: str | None = None,
) -> bool:
    """True if the table was created. ``bucket_by`` co-locates later joins on that key; ``path`` keeps it outside the warehouse."""
    if table_exists(spark, name):
        return False
    writer = spark.createDataFrame([], schema).write.format("parquet").mode("ignore")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return True


def drop_table(spark: SparkSession, name: str) -> bool:
    """True if there was a table to drop."""
    if not table_exists(spark, name):
        return False
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return True


def fan_out_write(df: DataFrame, paths: dict[str, str], formats: dict[str, str] | None = None) -> None:
    """The same rows to several sinks, in order; computed once and spilled to disk if large."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for sink, path in paths.items():
            df.write.mode("overwrite").format((formats or {}).get(sink, "parquet")).save(path)
    finally:
        df.unpersist()


def write_changes(df: DataFrame, path: str, batch_id: int, run: str = "load") -> None:
    """Adds one batch of a writer's run. Writing a batch again replaces it and nothing else, so retries are harmless.

    ``run`` names the writer and its checkpoint: several writers share a table, and one
    that starts anew with batch 0 leaves the earlier run's rows alone.
    """
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def read_changes(
    spark: SparkSession, path: str, schema: StructType, without: tuple[str, int] | None = None
) -> DataFrame:
    """All changes, or all but one batch of one run (which is being written); an absent or empty table reads as no rows."""
    full = StructType(list(schema.fields)).add("run", "string").add("batch_id", "long")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], full)
    out = spark.read.schema(full).option("basePath", path).parquet(path)
    return out if without is None else out.where(~((F.col("run") == without[0]) & (F.col("batch_id") == without[1])))


def read_current(spark: SparkSession, path: str, schema: StructType, key: str, order: list[str]) -> DataFrame:
    """The newest row per key over all batches of changes; equal rows in ``order`` go by batch, then run."""
    return latest_by_key(read_changes(spark, path, schema), [key], [*order, "batch_id", "run"]).drop("batch_id", "run")


def compact(spark: SparkSession, path: str, target: str, schema: StructType, key: str, order: list[str]) -> None:
    """Folds all changes into one batch of a new change table."""
    write_changes(read_current(spark, path, schema, key, order), target, 0, "compacted")
