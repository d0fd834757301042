"""Tables by key in buckets, where a merge rewrites the buckets it touches and no other.

A row's bucket is a hash of its key, and each bucket is a folder. Updates name the
buckets they fall into; only these are read, joined and replaced (dynamic partition
overwrite). What the merge costs follows the updates, not the table, as long as they
touch few buckets; so the number of buckets should follow the table's size
(a bucket of about a gigabyte), and small batches of a crawl stay cheap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from shelfspark.operators.keyed_writes import latest_by_key, partial_update, upsert
from shelfspark.session import kept

BUCKET = "key_bucket"


@dataclass(frozen=True)
class Merged:
    """What a merge did: the buckets it replaced, and updates that matched no row (none of an upsert)."""

    buckets: list[int]
    unmatched: DataFrame


@dataclass(frozen=True)
class KeyedTable:
    path: str
    key: str
    buckets: int
    schema: StructType

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        """Writes ``rows``, which must not repeat keys, as a new table."""
        table = KeyedTable(path, key, buckets, rows.schema)
        table._write(table._bucketed(rows), "errorifexists")
        return table

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).select(*self.schema.names)

    def upsert(self, updates: DataFrame, order: list[str]) -> Merged:
        """Inserts or overwrites whole rows on an equal key; the last update wins."""
        new = kept(self._bucketed(latest_by_key(updates, [self.key], order).select(*self.schema.names)), "updates")
        touched = self._touched(new)
        rows = upsert(self._part(new.sparkSession, touched), new, self.key, [self.key])
        self._replace(rows, touched)
        return Merged(touched, new.limit(0).drop(BUCKET))

    def update(self, updates: DataFrame, columns: list[str], order: list[str]) -> Merged:
        """Sets ``columns`` on rows of an equal key; buckets without such a row are left as they are."""
        new = latest_by_key(updates, [self.key], order).select(self.key, *columns)
        new = kept(self._bucketed(new), "updates")
        spark = new.sparkSession
        known = self._part(spark, self._touched(new)).select(BUCKET, self.key)
        matched = kept(new.join(known, [BUCKET, self.key], "left_semi"), "matched")
        touched = self._touched(matched)
        rows, _ = partial_update(self._part(spark, touched), matched.drop(BUCKET), self.key, columns, [self.key])
        self._replace(rows, touched)
        return Merged(touched, new.join(matched, [BUCKET, self.key], "left_anti").drop(BUCKET))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType(list(self.schema.fields)).add(BUCKET, IntegerType())).parquet(self.path)

    def _part(self, spark: SparkSession, touched: list[int]) -> DataFrame:
        return self._stored(spark).where(F.col(BUCKET).isin(touched))

    def _touched(self, rows: DataFrame) -> list[int]:
        """Numbers of buckets, at most as many as there are."""
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        # First beside the table: a job that fails half-way has replaced nothing, and the rows
        # of a bucket are on disk twice while its folder is exchanged.
        if touched:
            self._write(kept(rows.select(*self.schema.names, BUCKET), "merged"), "overwrite")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.repartition(BUCKET).sortWithinPartitions(BUCKET, self.key)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
