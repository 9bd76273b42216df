"""Two-lane delivery: a stream's hot lane, and an hourly reconcile of what it missed.

Both lanes deliver (lead, state) once. What was delivered is the ledger: a table
with a folder for each batch of a lane. A batch leaves out what other folders of
the ledger have as delivered, and then overwrites its own folder; so a batch that
is run again gives the same rows, and either lane may come first, twice, or never.
A failed delivery stays in the ledger as failed and is tried by the next batch or
reconcile that has its state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

LEDGER = "lead_id long, state string, ok boolean, lane string, batch long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All deliveries so far; none if nothing was delivered yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def deliver(states: DataFrame, path: str, lane: str, batch: int, sent: Column) -> None:
    """Delivers ``states`` (lead_id, state, ...) that are not in the ledger; ``sent`` says of a row if it went well."""
    spark = states.sparkSession
    known = ledger(spark, path).where("ok").where((F.col("lane") != lane) | (F.col("batch") != batch)).select("lead_id", "state").distinct()
    due = states.where("lead_id IS NOT NULL AND state IS NOT NULL").groupBy("lead_id", "state").agg(F.max(F.coalesce(sent, F.lit(False))).alias("ok"))
    due = due.join(known, ["lead_id", "state"], "left_anti")
    due.select(F.col("lead_id").cast("long"), "state", "ok").write.mode("overwrite").parquet(f"{path}/lane={lane}/batch={batch}")


def hot_lane(changes: DataFrame, path: str, checkpoint: str, sent: Column, read: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataStreamWriter:
    """The stream of state changes; each micro-batch is a batch of the lane."""
    return changes.writeStream.foreachBatch(lambda rows, k: deliver(read(rows), path, "hot", k, sent)).option("checkpointLocation", checkpoint)


def reconcile(current: DataFrame, path: str, run: int, sent: Column) -> None:
    """The cold lane: of all current states those that the ledger lacks."""
    deliver(current, path, "reconcile", run, sent)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """``(lead_id, state, lane)``: each delivery that went well."""
    return ledger(spark, path).where("ok").select("lead_id", "state", "lane")
