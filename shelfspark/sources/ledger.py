"""Several sinks at once, with a record of what became of each row in each of them.

A batch of rows is stored once and written to every sink. A sink that fails leaves the others
alone: its failure is recorded, and when the batch is run again only the sinks without a
complete record are written.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from shelfspark.schema import RUN
from shelfspark.session import kept

RECORD = "run string, batch_id long, sink string, status string, written long, refused long, error string, at timestamp"
REFUSED = "run string, batch_id long, sink string, row string, error string"

Sink = Callable[[DataFrame], None]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    """The last record of each run, batch and sink."""
    last = F.row_number().over(Window.partitionBy("run", "batch_id", "sink").orderBy(F.desc("at")))
    return _read(spark, f"{ledger}/records", RECORD).withColumn("_n", last).where("_n = 1").drop("_n")


def refused(spark: SparkSession, ledger: str) -> DataFrame:
    """Every row that a sink did not take, as JSON text, with the reason."""
    return _read(spark, f"{ledger}/refused", REFUSED)


def fan_out(rows: DataFrame, sinks: dict[str, Sink], ledger: str, run: str, batch_id: int, refuse: dict[str, Column] | None = None) -> DataFrame:
    """Writes ``rows`` to every sink that has no complete record of this run and batch; returns the batch's outcomes.

    ``refuse`` gives, for a sink, why it can't take a row (null if it can).
    """
    spark, refuse = rows.sparkSession, refuse or {}
    mine = outcomes(spark, ledger).where((F.col("run") == run) & (F.col("batch_id") == batch_id))
    complete = {r["sink"] for r in mine.where("status = 'done'").collect()}  # as many as sinks
    rows = kept(rows, "fan-out")
    for sink, write in sinks.items():
        if sink in complete:
            continue
        reason = refuse.get(sink, F.lit(None).cast("string"))
        counts = rows.agg(F.count_if(reason.isNull()).alias("good"), F.count_if(reason.isNotNull()).alias("bad")).first()
        status, error, written = "done", None, counts["good"]
        try:
            if counts["bad"]:
                text = F.to_json(F.struct(*rows.columns))
                keys = [F.lit(v).alias(n) for n, v in (("run", run), ("batch_id", batch_id), ("sink", sink))]
                bad = rows.where(reason.isNotNull()).select(*keys, text.alias("row"), reason.alias("error"))
                # A folder for each sink and batch, so that writing it again replaces it.
                bad.write.mode("overwrite").parquet(f"{ledger}/refused/part={run}-{batch_id}-{sink}")
            write(rows.where(reason.isNull()))
        except Exception as exc:
            status, error, written = "failed", f"{type(exc).__name__}: {exc}"[:500], 0
        record = (run, batch_id, sink, status, written, counts["bad"], error, datetime.now(timezone.utc))
        spark.createDataFrame([record], RECORD).write.mode("append").parquet(f"{ledger}/records")
    return outcomes(spark, ledger).where((F.col("run") == run) & (F.col("batch_id") == batch_id))


class StreamRuns(StreamingQueryListener):
    """Run records of streams: name, start, end, rows read, and the error that ended a stream."""

    def __init__(self) -> None:
        self.running: dict[str, dict] = {}
        self.ended: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        self.running[str(event.id)] = {"name": event.name or "stream", "started": datetime.now(timezone.utc), "rows": 0}

    def onQueryProgress(self, event) -> None:
        if run := self.running.get(str(event.progress.id)):
            run["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if run := self.running.pop(str(event.id), None):
            error = event.exception[:4000] if event.exception else None
            self.ended.append((run["name"], run["started"], datetime.now(timezone.utc), run["rows"], error))

    def records(self, spark: SparkSession) -> DataFrame:
        """Streams that ended, then those still running (without an end)."""
        now = [(r["name"], r["started"], None, r["rows"], None) for r in self.running.values()]
        return spark.createDataFrame([*self.ended, *now], RUN)


__all__ = ["StreamRuns", "fan_out", "outcomes", "refused"]
