"""Lead events as a stream: the batch rules on micro-batches, with state.

Event time is ``occurred_at``; late events are never dropped (reads order by
event time), so exact deduplication is a merge into the stored table in
``foreachBatch``; where a bounded state is wanted instead, keys are dropped
within a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.keyed import insert_ignore


def event_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events as a stream."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """One event per key within a watermark: bounded state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def merge_into(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str) -> DataStreamWriter:
    """Exactly once by key, without a bound in time: each batch's new keys are appended to the table at ``path``.

    A batch that is run again finds its keys there and adds nothing.
    """
    names = stream.columns

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = insert_ignore(batch, key, order)
        try:
            known = spark.read.schema(batch.schema).parquet(path).where(F.col(key).isNotNull()).select(key)
            fresh = fresh.join(known, key, "left_anti").select(*names)
        except Exception as e:  # noqa: BLE001  no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.select(*names).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def enriched(stream: DataFrame, leads: DataFrame, phone: str = "phone") -> DataFrame:
    """Stream-static join: events with the lead of their phone; null for orphans."""
    own = leads.groupBy(phone).agg(F.min("id").alias("lead_id"))
    return stream.drop("lead_id").join(own, phone, "left")


def windowed_counts(stream: DataFrame, at: str, kind: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Counts by window and kind (an extension: the reference has no windows)."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size, slide) if slide else F.window(at, size), kind).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions by gap (an extension)."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))




def merged_leads(stream: DataFrame, fields: tuple[str, ...] = ("name", "email", "project"), order: str = "seq") -> DataFrame:
    """Keyed state per phone: the first non-empty value of each field in arrival order, and the number of touches.

    State is one small row per phone. ``update`` output mode.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = list(state.get) if state.exists else [None] * len(fields) + [0]
        rows = pd.concat(list(batches)).sort_values(order)
        for k, f in enumerate(fields):
            if not values[k]:
                values[k] = next((v for v in rows[f] if isinstance(v, str) and v), None)
        values[-1] += len(rows)
        state.update(tuple(values))
        yield pd.DataFrame([[key[0], *values]], columns=["phone", *fields, "touches"])

    out = T.StructType([T.StructField("phone", T.StringType()), *(T.StructField(f, T.StringType()) for f in fields), T.StructField("touches", T.LongType())])
    kept = T.StructType([*(T.StructField(f, T.StringType()) for f in fields), T.StructField("touches", T.LongType())])
    return stream.groupBy("phone").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)
