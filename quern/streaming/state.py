"""State per phone: leads and their events in one stream, in any order.

A phone's state is the lead (the first non-empty value of each field, by arrival)
and, as long as there is none, the list of its events. An event of a known lead
leaves at once; others wait in the list state and leave when the lead's row
comes. So events are neither lost nor late, whatever came first, and what is kept
of a phone is its lead and what waits for it.

``run`` takes a feed by joins, a batch at a time, so a batch of millions of phones
is a few shuffles. Its state is tables with a folder for each batch (changed leads,
new waiting events), a whole one every ``WHOLE`` batches, when older ones go. A
batch reads the folders before it and overwrites its own, so one that runs again
gives the same rows. ``tracked`` is the same rule as one operator of a stream, with
a call for each phone: it suits small batches, which ``run`` makes read all leads.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.sources.shared import _path, _system

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of the stream: ``event_id`` is null for a lead's row, ``lead_id`` for an event's.
ARRIVALS = "phone string, seq long, lead_id long, event_id long, name string, email string, project string"
#: ``event_id`` is null in a lead's own row, which has the fields so far and the number of touches.
OUT = "phone string, event_id long, lead_id long, waited boolean, name string, email string, project string, touches long"
FIELDS = ("name", "email", "project")


class Leads(StatefulProcessor):
    """Keeps the lead of a phone, or the events that wait for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lead = handle.getValueState("lead", "lead_id long, name string, email string, project string, touches long")
        self.waiting = handle.getListState("waiting", "event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802
        now = pd.concat(list(rows)).sort_values("seq", kind="stable")
        touches, events = now[now["event_id"].isna()], now[now["event_id"].notna()]["event_id"].astype("int64").tolist()
        lead = list(self.lead.get()) if self.lead.exists() else None
        out = []
        if len(touches):
            known = lead is not None
            lead = lead or [int(touches["lead_id"].min()), None, None, None, 0]
            for k, f in enumerate(FIELDS, 1):
                lead[k] = lead[k] or next((v for v in touches[f] if isinstance(v, str) and v), None)
            lead[4] += len(touches)
            self.lead.update(tuple(lead))
            if not known:
                out += [(key[0], int(e), lead[0], True, None, None, None, None) for (e,) in self.waiting.get()]
                self.waiting.clear()
            out.append((key[0], None, *lead[:1], None, *lead[1:]))
        if lead is not None:
            out += [(key[0], e, lead[0], False, None, None, None, None) for e in events]
        elif events:
            self.waiting.appendList([(e,) for e in events])
        frame = pd.DataFrame(out, columns=["phone", "event_id", "lead_id", "waited", *FIELDS, "touches"])
        yield frame.astype({"event_id": "Int64", "lead_id": "Int64", "waited": "boolean", "touches": "Int64"})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """List state needs the RocksDB store; the session's own setting comes back after the query has started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def arrivals(leads: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Rows of leads (phone, seq, lead_id and fields) and of events (phone, seq, event_id) as ``ARRIVALS``."""
    parts = [x for x in (leads, events) if x is not None]
    names = [x.split() for x in ARRIVALS.split(", ")]
    ready = [x.select(*((F.col(n) if n in x.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names)) for x in parts]
    return ready[0] if len(ready) == 1 else ready[0].unionByName(ready[1])


def tracked(stream: DataFrame) -> DataFrame:
    """A stream of ``ARRIVALS`` to one of ``OUT``. Rows without phone belong to no lead and are left out."""
    return stream.where("phone IS NOT NULL").groupBy("phone").transformWithStateInPandas(Leads(), OUT, "Append", "none")


#: What is kept between batches: leads by phone, and events whose phone had no lead when they came.
LEADS = "phone string, lead_id long, name string, email string, project string, touches long"
WAITING = "phone string, event_id long"
WHOLE = 16


def folders(spark: SparkSession, path: str, batch: int) -> list[tuple[int, str]]:
    """(batch, folder) of what earlier batches kept, from the last whole one on; older ones go."""
    system, home = _system(spark, path), _path(spark, path)
    found = sorted((int(n.split("-")[1]), n) for n in (x.getPath().getName() for x in system.listStatus(home))) if system.exists(home) else []
    found = [(k, n) for k, n in found if k < batch]
    base = max((k for k, n in found if n.startswith("whole")), default=-1)
    for k, n in found:
        if k < base:
            system.delete(_path(spark, f"{path}/{n}"), True)
    return [(k, f"{path}/{n}") for k, n in found if k >= base]


def kept(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """The rows that earlier batches kept, with their ``batch``."""
    out = spark.createDataFrame([], f"{schema}, batch long")
    for k, folder in folders(spark, path, batch):
        out = out.unionByName(spark.read.schema(schema).parquet(folder).withColumn("batch", F.lit(k).cast("long")))
    return out


def first_filled(f: str) -> Column:
    """The first non-empty value by ``seq``, of equal ones the least."""
    return F.min_by(f, F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct(F.col("seq").isNull(), "seq", f)))


def take(rows: DataFrame, batch: int, out: str, home: str) -> None:
    """A batch of ``ARRIVALS`` to its folder of the table at ``out`` (``OUT``), with the state at ``home``."""
    spark, whole = rows.sparkSession, batch % WHOLE == 0
    rows, touch = rows.where("phone IS NOT NULL"), F.col("event_id").isNull()
    versions = kept(spark, f"{home}/leads", LEADS, batch)
    leads = versions.groupBy("phone").agg(F.max_by(F.struct("lead_id", *FIELDS, "touches"), "batch").alias("l")).select("phone", "l.*")
    waiting = kept(spark, f"{home}/waiting", WAITING, batch).drop("batch")
    now = rows.where(touch).groupBy("phone").agg(F.min("lead_id").alias("lead_id"), *(first_filled(f).alias(f) for f in FIELDS), F.count("*").alias("touches"), F.lit(True).alias("now"))
    before = leads.select("phone", F.struct("lead_id", *FIELDS, "touches").alias("was"))
    both = now.join(before, "phone", "outer" if whole else "left").select(
        "phone", F.when(F.col("was").isNull(), F.col("lead_id")).otherwise(F.col("was.lead_id")).alias("lead_id"), *(F.coalesce(f"was.{f}", f).alias(f) for f in FIELDS),
        (F.coalesce("was.touches", F.lit(0)) + F.coalesce("touches", F.lit(0))).alias("touches"), F.col("now").isNotNull().alias("now"), F.col("was").isNull().alias("fresh"),
    )
    path = f"{home}/leads/{'whole' if whole else 'part'}-{batch}"
    both.write.mode("overwrite").parquet(path)
    both = spark.read.schema(f"{LEADS}, now boolean, fresh boolean").parquet(path)
    fresh = both.where("fresh").select("phone", "lead_id")
    known = both.select("phone", "lead_id", F.lit(True).alias("known")) if whole else leads.select("phone", "lead_id").unionByName(fresh).withColumn("known", F.lit(True))
    events = rows.where(~touch).select("phone", "event_id").join(known, "phone", "left")
    orphans = events.where("known IS NULL").select("phone", "event_id")
    if whole:
        orphans = orphans.unionByName(waiting.join(both, "phone", "left_anti"))
    orphans.write.mode("overwrite").parquet(f"{home}/waiting/{'whole' if whole else 'part'}-{batch}")
    parts = (both.where("now").withColumn("event_id", F.lit(None)), waiting.join(fresh, "phone").withColumn("waited", F.lit(True)), events.where("known").withColumn("waited", F.lit(False)))
    names = [x.split() for x in OUT.split(", ")]
    first, *more = (x.select(*((F.col(n) if n in x.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names)) for x in parts)
    for x in more:
        first = first.unionByName(x)
    first.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def run(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Takes what is new in the folder of arrivals to the table at ``out`` (``OUT``, in folders by ``batch``); goes on where the last run ended."""
    stream = spark.readStream.schema(ARRIVALS).parquet(folder)
    query = stream.writeStream.foreachBatch(lambda rows, k: take(rows, k, out, f"{checkpoint}/kept")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
