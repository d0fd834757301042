"""Upserts, inserts and updates as joins on a key.

New rows are reduced to one per key before they meet the table, so neither side
of a join repeats a key and a key that fills a third of the input is a single
row by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key. The limit is applied before the shuffle too (WindowGroupLimit)."""
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(newest_first)).where("_n = 1").drop("_n")


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    oldest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(oldest_first)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Insert or overwrite whole rows on an equal key; the last update wins."""
    new = latest_by_key(updates, [key], order).select(*target.columns)
    return target.join(new.select(key), key, "left_anti").unionByName(new)


def put_by_id(target: DataFrame, updates: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Overwrite by id. Returns the new table and `key, outcome` (created / updated)."""
    new = latest_by_key(updates, [key], order)
    known = target.select(key, F.lit(True).alias("_known"))
    outcome = new.select(key).join(known, key, "left").select(
        key, F.when(F.col("_known"), F.lit("updated")).otherwise(F.lit("created")).alias("outcome")
    )
    return upsert(target, updates, key, order), outcome


def absent_rows(arrivals: DataFrame, table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First arrival of every key the table does not hold yet."""
    return first_by_key(arrivals, [key], order).join(table.select(key), key, "left_anti")


def insert_if_absent(arrivals: DataFrame, table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table plus its new keys; rows already there stay as they are."""
    return table.unionByName(absent_rows(arrivals, table, key, order).select(*table.columns))


def key_exists(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Adds ``found``: does the table hold this key? ``table`` must not repeat keys."""
    return keys.join(table.select(key, F.lit(True).alias("_f")), key, "left").select(
        *keys.columns, F.coalesce("_f", F.lit(False)).alias("found")
    )


def partial_update(
    target: DataFrame, updates: DataFrame, key: str, columns: list[str], order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Sets some columns on matching rows. Returns the new table and the unmatched updates.

    A matched row takes the update's value as it is, null included.
    """
    new = latest_by_key(updates, [key], order).select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = target.join(new, key, "left")

    def value(c: str) -> Column:
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    out = joined.select(*[value(c) if c in columns else F.col(c) for c in target.columns])
    return out, updates.join(target.select(key), key, "left_anti")


def mark_done(frontier: DataFrame, processed: DataFrame, key: str = "url") -> DataFrame:
    """Sets ``already_scraped`` on every processed key, failed ones included."""
    done = processed.select(key).distinct().withColumn("_done", F.lit(True))
    flag = F.col("already_scraped") | F.coalesce("_done", F.lit(False))
    return frontier.join(done, key, "left").select(
        *[flag.alias(c) if c == "already_scraped" else F.col(c) for c in frontier.columns]
    )
