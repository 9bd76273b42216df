"""Queries that run streams to their end over the supplied tables: state, delivery, cursors.

Each works in a folder of its own among the shared steps, which goes with the application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.queries import query, t
from quern.sources import cursor
from quern.sources.shared import new_folder
from quern.streaming import delivery, state


@query("""SELECT event_id, c_custkey AS lead_id, event_type IN ('signup', 'error') AS waited FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal >= 0""")
def orphan_events_stream(spark: SparkSession, d: str) -> DataFrame:
    """Signups and errors come before the leads (customers in credit), all other events after; the stream stops and starts again between."""
    home = new_folder(spark, "orphans")
    events, early = t(spark, d, "events").select(F.col("user_id").cast("string").alias("phone"), F.col("event_id").alias("seq"), "event_id", "event_type"), F.col("event_type").isin("signup", "error")
    leads = t(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("phone"), F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("lead_id"), F.col("c_name").alias("name"))
    for part in (state.arrivals(events=events.where(early)), state.arrivals(leads=leads), state.arrivals(events=events.where(~early))):
        part.write.mode("append").parquet(f"{home}/in")
        state.run(spark, f"{home}/in", f"{home}/out", f"{home}/checkpoint")
    return spark.read.schema(state.OUT).parquet(f"{home}/out").where("event_id IS NOT NULL").select("event_id", "lead_id", "waited")


@query("""WITH q AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS name, CASE WHEN o_totalprice > 200000 THEN 'mail' || o_orderkey ELSE '' END AS email, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS project FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS phone, count(*) AS touches, arg_min(name, o_orderkey) FILTER (name <> '') AS name, arg_min(email, o_orderkey) FILTER (email <> '') AS email, arg_min(project, o_orderkey) FILTER (project <> '') AS project FROM q GROUP BY o_custkey""")
def lead_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders as touches of leads, in two runs by their number; the last state of each phone."""
    home = new_folder(spark, "lead-state")
    orders = t(spark, d, "orders")
    touches = orders.select(
        F.col("o_custkey").cast("string").alias("phone"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("lead_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("name"),
        F.when(F.col("o_totalprice") > 200_000, F.concat(F.lit("mail"), F.col("o_orderkey").cast("string"))).otherwise("").alias("email"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("project"),
    )
    middle = orders.agg(F.max("o_orderkey") / 2).first()[0] or 0
    for part in (touches.where(F.col("seq") <= middle), touches.where(F.col("seq") > middle)):
        state.arrivals(leads=part).write.mode("append").parquet(f"{home}/in")
        state.run(spark, f"{home}/in", f"{home}/out", f"{home}/checkpoint")
    states = spark.read.schema(state.OUT).parquet(f"{home}/out").where("event_id IS NULL")
    return states.groupBy("phone").agg(F.max("touches").alias("touches"), *(F.max_by(f, "touches").alias(f) for f in state.FIELDS))


@query("""WITH q AS (SELECT o_custkey AS lead_id, o_orderstatus AS state, max(o_orderpriority < '3' AND o_orderstatus <> 'P') AS hot FROM orders GROUP BY 1, 2)
SELECT lead_id, state, CASE WHEN hot THEN 'hot' ELSE 'reconcile' END AS lane FROM q""")
def two_lane_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders go by the stream, which fails for one state and is run twice; the reconcile, run twice too, brings the rest."""
    home = new_folder(spark, "delivery")
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("lead_id"), F.col("o_orderstatus").alias("state"), "o_orderpriority")
    orders.where(F.col("o_orderpriority") < "3").write.parquet(f"{home}/in")
    urgent = spark.read.parquet(f"{home}/in")
    for attempt in "ab":
        stream = spark.readStream.schema(urgent.schema).parquet(f"{home}/in")
        delivery.hot_lane(stream, f"{home}/ledger", f"{home}/checkpoint-{attempt}", F.col("state") != "P").trigger(availableNow=True).start().awaitTermination()
    for k in range(2):
        delivery.reconcile(orders, f"{home}/ledger", k, F.lit(True))
    return delivery.delivered(spark, f"{home}/ledger")


EXPORTED = "event_id long, user_id long, event_type string, created long"


def exported(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("created"))


@query("SELECT event_id, user_id, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def cursor_pull(spark: SparkSession, d: str) -> DataFrame:
    """Events exported in two parts by time; the stream runs after each, and each event is taken once."""
    home = new_folder(spark, "cursor")
    rows = exported(spark, d)
    middle = rows.agg(((F.min("created") + F.max("created")) / 2).cast("long")).first()[0] or 0
    for part in (rows.where(F.col("created") <= middle), rows.where(F.col("created") > middle)):
        cursor.export(part, f"{home}/pages", "created")
        cursor.pull(spark, f"{home}/pages", EXPORTED, "created", f"{home}/out", f"{home}/checkpoint")
    return spark.read.schema(EXPORTED).parquet(f"{home}/out").groupBy("event_id", "user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events)
SELECT event_id, user_id, event_type FROM events, m WHERE epoch_us(ts) > a + (b - a) // 4 AND epoch_us(ts) <= a + (b - a) // 2""")
def cursor_window(spark: SparkSession, d: str) -> DataFrame:
    """A window in time of an export; pages outside are not opened."""
    home = new_folder(spark, "cursor")
    rows = exported(spark, d)
    first, last = rows.agg(F.min("created"), F.max("created")).first()
    cursor.export(rows, f"{home}/pages", "created", page_rows=500)
    found = cursor.window(spark, f"{home}/pages", EXPORTED, "created", first + (last - first) // 4, first + (last - first) // 2)
    return found.select("event_id", "user_id", "event_type")
