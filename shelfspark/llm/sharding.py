"""Contiguous shards of equal bytes, from prefix sums over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.batches import quoted
from shelfspark.session import scratch_path


def prefix_sums(rows: DataFrame, order: list[str], value: str, before: str, position: str) -> DataFrame:
    """Adds the sum of ``value`` and the number of rows before each row, in the order of ``order``.

    The rows are dealt out by range. Each partition is summed for itself; the sums of
    the partitions (a row each) give every partition its start. Rows equal in
    ``order`` are told apart by a number of their place in the input, so that one key
    with any share of the rows is still spread over partitions. No broadcast is asked
    for and no row passes through the driver.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, "_tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "prefix")
    # Written once: both passes below must see the same partitions.
    dealt.repartitionByRange(parts, *[quoted(k) for k in keys]).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    totals = dealt.groupBy("_part").agg(F.sum(quoted(value)).alias("_sum"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
    )
    inside = Window.partitionBy("_part").orderBy(*[quoted(k) for k in keys])
    to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.withColumn("_here", F.sum(quoted(value)).over(to_here) - quoted(value))
        .withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, "_part")
        .withColumn(before, F.col("_sum0") + F.col("_here"))
        .withColumn(position, (F.col("_rows0") + F.col("_at")).cast("long"))
        .drop("_part", "_tie", "_here", "_at", "_sum0", "_rows0")
    )


def byte_size(text: Column, overhead: int) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def balanced_shards(
    rows: DataFrame, order: list[str], size: str = "size", shards: int = 40, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """Puts rows into ``shards`` contiguous runs (in the order of ``order``) of nearly equal size.

    A row belongs to the shard in whose share of all bytes its middle lies, so a
    boundary is off its target by half a row at most. ``slot`` counts a shard's rows
    from 0. Null sizes count as 0; nulls in ``order`` come first; an empty table gives
    an empty result. Repeated rows are rows of their own. A row larger than a share
    leaves shards empty.
    """
    sized = rows.withColumn(size, F.coalesce(quoted(size).cast("long"), F.lit(0)))
    placed = prefix_sums(sized, order, size, "_before", "_position")
    # Decimals, as the products pass the range of a long at some 100 PB.
    total = sized.agg(F.sum(quoted(size)).cast("decimal(38,0)")).first()[0]
    middle = (F.col("_before") * 2 + quoted(size)).cast("decimal(38,0)") * shards
    cut = F.least(F.floor(middle / F.lit(2 * total)).cast("int"), F.lit(shards - 1)) if total else F.lit(0)
    placed = placed.withColumn(shard, cut.cast("int"))
    # At most one row for each shard.
    first = placed.groupBy(shard).agg(F.min("_position").alias("_first"))
    return placed.join(F.broadcast(first), shard).withColumn(slot, F.col("_position") - F.col("_first")).drop(
        "_before", "_position", "_first"
    )
