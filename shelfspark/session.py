"""Session defaults, shared scratch space and the size checks behind broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row bound under which a side may be broadcast. A bound must be known before
#: the hint is given; past it the plain (shuffled, AQE-managed) join is used.
BROADCAST_ROWS = 200_000


def build_session(cores: str | int = "*", app: str = "shelfspark", **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # One shuffle partition per core; merging them by size would idle cores, as
        # the work per row (scoring, comparing) outweighs its bytes.
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # Test files have one row group each, so only one core could read them; see suite/derive.py.
        .config("spark.shelfspark.scanPartitions", str(os.cpu_count() if cores == "*" else cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="shelfspark-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, however often it is used."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns that are computed once per row.

    Spark copies a projected expression into every filter above it. It does not
    look into the output of a generator, so a one-element array keeps each
    expression in a single place.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(values)).alias("_computed")).select(
        *kept, *[F.col(f"_computed.{name}").alias(name) for name in columns]
    )


def over_all_cores(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to at least as many tasks as there are cores: for work that costs more than moving a row.

    How many tasks read a table doesn't tell how many get rows: a row group goes to one task, whatever its file is split into.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` holds at most ``rows`` rows. A plain count: only numbers are moved."""
    return df.count() <= rows


def small_side(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Hint a broadcast if the row bound is known and low, else leave it to AQE."""
    if row_bound is not None and row_bound <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df
