import random

from pyspark.sql import functions as F

from quern.operators import keyed
from quern.sources import cursor
from quern.streaming import delivery, events, state

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    parts = tmp_path / "in"
    batch.repartition(4).write.parquet(str(parts))
    out = str(tmp_path / "out")
    for run in ("a", "b"):  # a new checkpoint: all batches again, nothing new
        stream = events.event_stream(spark, str(parts), batch.schema, 1)
        events.merge_into(stream, out, "key", ["ts", "event_id"], str(tmp_path / run)).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == keyed.insert_ignore(batch, "key", ["ts", "event_id"]).count() == got.select("key").distinct().count()


def test_keyed_state_keeps_first_values(spark, tmp_path):
    rows = [(1, "9", None, "a@x", None), (2, "9", "Asha", "b@x", "Sky"), (3, "8", "Ravi", None, None)]
    df = spark.createDataFrame(rows, "seq long, phone string, name string, email string, project string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    q = events.merged_leads(events.event_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("update").format("memory").queryName("merged").start()
    q.processAllAvailable()
    q.stop()
    assert {r.phone: (r.name, r.email, r.touches) for r in spark.table("merged").collect()} == {"9": ("Asha", "a@x", 2), "8": ("Ravi", None, 1)}


def test_windows(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    q = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"), batch.schema), "ts", "event_type", "1 day").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == batch.count()


def test_events_wait_for_their_lead_over_restarts(spark, tmp_path):
    home = str(tmp_path)
    events_of = lambda *x: state.arrivals(events=spark.createDataFrame(x, "phone string, seq long, event_id long"))
    leads_of = lambda *x: state.arrivals(leads=spark.createDataFrame(x, "phone string, seq long, lead_id long, name string, email string"))
    feeds = [events_of(("1", 1, 10), ("2", 2, 11), (None, 3, 12)), leads_of(("1", 4, 7, None, "a@x")), events_of(("1", 5, 13), ("2", 6, 14)), leads_of(("1", 7, 7, "Asha", "b@x"), ("3", 8, 9, "Ravi", None))]
    for feed in feeds:
        feed.write.mode("append").parquet(f"{home}/in")
        state.run(spark, f"{home}/in", f"{home}/out", f"{home}/checkpoint")
    rows = spark.read.schema(state.OUT).parquet(f"{home}/out").collect()
    assert sorted((r.event_id, r.lead_id, r.waited) for r in rows if r.event_id) == [(10, 7, True), (13, 7, False)]
    assert sorted((r.phone, r.touches, r.name, r.email) for r in rows if r.event_id is None) == [("1", 1, None, "a@x"), ("1", 2, "Asha", "a@x"), ("3", 1, "Ravi", None)]
    assert spark.conf.get(state.PROVIDER, None) is None or "Rocks" not in spark.conf.get(state.PROVIDER)


def test_lanes_in_any_order_deliver_once(spark, tmp_path):
    rows = [(k % 20, "abc"[k % 3]) for k in range(60)] + [(None, "a"), (1, None)]
    states = spark.createDataFrame(rows, "lead_id long, state string").withColumn("lane", F.lit("clash"))
    good = F.col("state") != "c"
    for order in ("hrhr", "rh", "hh", "rrhh"):
        path = str(tmp_path / order)
        for k, lane in enumerate(order):
            if lane == "h":
                delivery.deliver(states, path, "hot", 0, good)  # the same batch each time
            else:
                delivery.reconcile(states, path, k, F.lit(True))
        got = delivery.delivered(spark, path)
        want = {(k % 20, "abc"[k % 3]) for k in range(60)}
        assert got.count() == got.select("lead_id", "state").distinct().count() == len(want if "r" in order else [x for x in want if x[1] != "c"])


def test_cursor_reads_each_record_once_and_opens_few_pages(spark, tmp_path):
    home, schema = str(tmp_path), "id long, created long"
    rows = lambda a, b: spark.range(a, b).select("id", (F.col("id") * 10).alias("created"))
    for k in range(3):
        cursor.export(rows(100 * k, 100 * k + 100).repartition(3), f"{home}/pages", "created", page_rows=20)
        for _ in range(2):  # the second run finds nothing new
            cursor.pull(spark, f"{home}/pages", schema, "created", f"{home}/out", f"{home}/checkpoint")
    assert sorted(r.id for r in spark.read.schema(schema).parquet(f"{home}/out").collect()) == list(range(300))
    reader = cursor.CursorStream(spark.createDataFrame([], schema).schema, {"path": f"{home}/pages"})
    assert reader.latestOffset() == {"after": 2990} and reader.initialOffset() == {"after": -1}
    some = reader.partitions({"after": 990}, {"after": 1490})
    assert 0 < len(some) <= 6 < len(reader.client.pages())
    again = [sorted(r for p in reader.partitions({"after": 990}, {"after": 1490}) for r in reader.read(p)) for _ in range(2)]  # a replay
    assert again[0] == again[1] == [(k, 10 * k) for k in range(100, 150)]
    assert cursor.window(spark, f"{home}/pages", schema, "created", 2000, 2100).count() == 10
    assert cursor.window(spark, f"{home}/none", schema, "created").count() == 0


def test_state_by_joins_equals_rules_row_by_row_in_any_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "WHOLE", 3)
    draw, home, seen, want, schema = random.Random(4), str(tmp_path), {}, [], state.ARRIVALS
    for batch in range(8):
        rows = []
        for seq in range(60):
            phone, event = draw.choice([None, *"abcdefghijklmnopqrstuvwxyz"[: 10 + 2 * batch]]), draw.random() < 0.6
            rows.append((phone, 100 * batch + seq // 2, None if event or draw.random() < 0.2 else seq, 1000 * batch + seq if event else None, *(None if event else draw.choice([None, "", f"{f}{seq}"]) for f in "nep")))
        own, early = [r for r in rows if r[0]], {p: dict(x) for p, x in seen.items()}
        for p in {r[0] for r in own}:
            lead, touches = seen.setdefault(p, {"waiting": []}), [r for r in own if r[0] == p and r[3] is None]
            if touches and "id" not in lead:
                lead["id"], lead["n"] = min((r[2] for r in touches if r[2] is not None), default=None), 0
                want += [(p, e, lead["id"], True, None, None, None, None) for e in lead["waiting"]]
            if touches:
                for k in (4, 5, 6):
                    lead[k] = lead.get(k) or min(((r[1], r[k]) for r in touches if r[k]), default=(0, None))[1]
                lead["n"] += len(touches)
                want.append((p, None, lead["id"], None, lead[4], lead[5], lead[6], lead["n"]))
            events = [r[3] for r in own if r[0] == p and r[3] is not None]
            if "id" in lead:
                want += [(p, e, lead["id"], False, None, None, None, None) for e in events]
            else:
                lead["waiting"] = early.get(p, {"waiting": []})["waiting"] + events
        feed = spark.createDataFrame(rows, schema)
        for _ in range(1 + batch % 2):  # a batch that runs again
            state.take(feed, batch, f"{home}/out", f"{home}/kept")
        got = [tuple(r) for r in spark.read.schema(state.OUT).parquet(f"{home}/out").drop("batch").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(list((tmp_path / "kept" / "leads").glob("*-*"))) <= 5  # older ones have gone
    assert any(r[3] for r in want)


def test_a_feed_of_many_phones_is_taken_by_joins_as_by_one_operator(spark, tmp_path):
    events_of = spark.range(300).selectExpr("cast(id % 70 as string) AS phone", "id AS seq", "id AS event_id")
    leads_of = spark.range(100).selectExpr("cast(id % 50 as string) AS phone", "id + 150 AS seq", "id AS lead_id", "if(id % 3 = 0, '', concat('n', id)) AS name")
    for k, feed in enumerate((state.arrivals(events=events_of.where("seq < 100")), state.arrivals(leads_of, events_of.where("seq >= 100")))):
        feed.write.mode("append").parquet(f"{tmp_path}/in")
        state.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        with state.rocks(spark):
            query = state.tracked(spark.readStream.schema(state.ARRIVALS).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/one").option("checkpointLocation", f"{tmp_path}/steps").trigger(availableNow=True).start()
        query.awaitTermination()
        both = [sorted(map(tuple, spark.read.schema(state.OUT).parquet(f"{tmp_path}/{x}").drop("batch").collect()), key=repr) for x in ("out", "one")]
        assert both[0] == both[1] and len(both[0]) == (0, 270)[k]
