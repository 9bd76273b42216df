import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import catalog, entity, evidence, gazetteer, geo, keyed, leads
from quern.sources import paged, stores


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lead_sources(frame):
    meta = frame([([("full_name", ["Asha"]), ("Phone_Number", ["+91 98765 43210"]), ("bhk", ["3bhk"])], "Sky Park", "L1")], "field_data array<struct<name:string,values:array<string>>>, form_name string, leadgen_id string")
    site = frame([("Ravi", "09876543210", "hello")], "fullName string, mobile string, message string")
    portal = frame([("undefined (Owner)", "9876543211", 7_500_000, 15_000_000, "Malad", "Mumbai", "P1", 1700000000, "about Sky Park")], "lead_name string, lead_phone string, min_price long, max_price long, locality_name string, city_name string, project_id string, lead_date long, enquiry string")
    out = {r.source: r for r in leads.normalized({"meta": meta, "website": site, "housing": portal}, frame([("Sky Park",)], "name string")).collect()}
    assert out["meta"].configuration == "3 BHK" and out["meta"].project == "Sky Park" and out["meta"].phone == "9876543210"
    assert out["website"].name == "Ravi" and out["website"].notes == "hello"
    assert out["housing"].name is None and out["housing"].budget == "₹75 L - ₹1.5 Cr" and out["housing"].project == "Sky Park" and out["housing"].source_lead_id == "P1-1700000000"


def test_intake_merges_and_flags(frame):
    touches = frame(
        [(1, "9", "", "a@x", "meta", "7"), (2, "9", "Asha", "b@x", "meta", "7"), (3, "9", "Other", None, "web", None), (4, None, "No", None, "web", None)],
        "seq long, phone string, name string, email string, source string, source_lead_id string",
    )
    lead, kept = leads.intake(touches)
    row = lead.first()
    assert (row.name, row.email, row.primary_source, row.n_touches) == ("Asha", "a@x", "meta", 3)
    assert sorted((r.seq, r.is_duplicate) for r in kept.collect()) == [(1, 0), (3, 1)]


def test_events_validate_ingest_and_adopt(frame):
    now = F.lit("2026-01-01").cast("timestamp")
    raw = frame(
        [("9876543210", "whatsapp", "delivered", None, "2025-01-01T00:00:00"), ("9876543210", "whatsapp", "delivered", None, "2025-01-01T00:00:00"), ("1", "voice", "call_busy", None, None), ("9876543210", "fax", "x", None, None), ("9876543210", "voice", "delivered", None, "bad")],
        "phone string, channel string, checkpoint string, idempotency_key string, occurred_at string",
    )
    good, bad = leads.validated_events(raw, now)
    assert sorted(r.reason for r in bad.collect()) == ["invalid_channel", "invalid_checkpoint", "invalid_phone"]
    new = good.withColumn("lead_id", F.lit(None).cast("long"))
    none = new.limit(0)
    people = frame([(5, "9876543210")], "id long, phone string")
    once = leads.ingest(none, new, people)
    assert [r.lead_id for r in once.collect()] == [5]
    assert leads.ingest(once, new, people).count() == 1


def test_update_fields_audits(frame):
    now = frame([(1, "a", "b"), (2, "c", None)], "id long, name string, notes string")
    edits = [(1, "name", "y", 1), (1, "name", "z", 2), (1, "notes", "", 3), (2, "phone", "9", 4), (2, "name", "c", 5)]
    for own in (edits, edits[::-1]):
        after, audit = keyed.update_fields(now, frame(own, "id long, field string, value string, seq long"), "id", ["name", "notes"], "seq")
        assert rows(after) == [(1, "z", None), (2, "c", None)]
        assert rows(audit) == [(1, "name", "a", "z"), (1, "notes", "b", None)]


def test_radius_over_the_meridian(frame):
    import math
    import random

    rng = random.Random(1)
    spots = [(k, rng.uniform(-60, 60) if k % 2 else rng.uniform(10, 11), (rng.uniform(179, 181) + 180) % 360 - 180) for k in range(150)] + [(200, 0.0, 179.999), (201, 0.0, -179.999), (202, 0.0, -180.0), (203, 0.0, 180.0)]
    a = frame(spots, "id long, lat double, lon double")
    b = frame([(k, x, y) for k, x, y in spots], "place long, plat double, plon double")

    def km(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    for radius in (3.0, 40.0):
        got = sorted((r.id, r.place) for r in geo.within(a, b, radius).collect())
        assert got == sorted((p[0], q[0]) for p in spots for q in spots if km(p, q) <= radius)


def test_collapse_keeps_rows_without_key(frame):
    df = frame([("a", 2), ("a", 1), (None, 3), ("", 4)], "k string, seq long")
    assert sorted(r.seq for r in keyed.collapse_first(df, F.col("k"), [F.col("seq")]).collect()) == [1, 3, 4]


def test_retention_is_per_key(frame):
    df = frame([(k, s) for k in range(10) for s in ("a", "b")], "id long, source string")
    assert rows(keyed.retain_newest(df, 2, ["id"], ["source"])) == [(8, "a"), (8, "b"), (9, "a"), (9, "b")]


def test_null_keys_are_never_duplicates(frame):
    df = frame([("a", 1), ("a", 2), (None, 3), (None, 4)], "key string, seq long")
    assert rows(keyed.insert_ignore(df, "key", ["seq"])) == [("a", 1), (None, 3), (None, 4)]


def evidence_rows(frame):
    data = [
        (1, "Sky Park", "Malad West", "Rivali", "P51800012345", "u1", "portal", 1.0),
        (2, "Sky Park Price List", "Malad West", None, None, "u2", "web", None),
        (3, "Skypark Tower A", "Goregaon", None, "P51800012345", "u3", "web", None),
        (4, "Green Hill", "Kandivali", "Sheth", "PENDING", "u4", "portal", None),
        (5, "Blue Hill", "Borivali", "Nova", "PENDING", "u5", "portal", None),
        (6, "Green Hill Heights", "Kandivali East", "Sheth", None, "u4", "web", None),
    ]
    return frame(data, "seq long, name string, location string, developer string, rera string, source_url string, source_type string, price_max_inr double")


def test_entity_resolution_is_order_free(frame, spark):
    df = evidence_rows(frame)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
    got = {r.seq: r.group for r in entity.resolve(df).collect()}
    assert got == want
    data = df.collect()
    random.Random(3).shuffle(data)
    again = {r.seq: r.group for r in entity.resolve(spark.createDataFrame(data, df.schema)).collect()}
    assert again == want
    greedy = {r.seq: r.group for r in entity.greedy_groups(df.withColumn("b", F.lit(1)), "b").collect()}
    assert greedy == want


def test_merge_fills_gaps_in_order(frame):
    merged = {r.group: r for r in entity.merge_groups(entity.resolve(evidence_rows(frame))).collect()}
    assert (merged[1].name, merged[1].developer, merged[1].rera, merged[1].evidence_count) == ("Sky Park", "Rivali", "P51800012345", 3)
    entries = entity.field_entries(entity.resolve(evidence_rows(frame)).withColumn("source", F.col("source_type")))
    state = {(r.group, r.field): r.state for r in evidence.verification(entries, "group").collect()}
    assert state[1, "location"] == "conflict" and state[4, "developer"] == "single"


def test_external_score_caps(frame):
    schema = "id string, name string, city string, location string, community string, configuration string, bedrooms int, budget_min long, budget_max long, handover_date string, possession_date string, source_quality string, last_seen_at string"
    df = frame([("1", "New Launch", "Mumbai", "Borivali East", None, "3 BHK", 3, None, 12_000_000, None, None, "high", None), ("2", "Park", "Mumbai", "Borivali East", None, "2 BHK", 2, None, 12_000_000, None, None, "high", "2026-01-01")], schema)
    want = catalog.Wanted(locations=["Borivali East"], bedrooms=2)
    got = {r.id: (r.confidence, r.tier) for r in catalog.external_score(df, want, F.lit("2026-01-02").cast("timestamp")).collect()}
    assert got["1"] == (55, "TERTIARY") and got["2"] == (100, "PRIMARY")


def test_python_and_js_rounding_differ(frame):
    df = frame([("in borivali somewhere",)], "hay string")
    js = catalog.place_points(F.col("hay"), ["Borivali East"])
    py = evidence.place_points(F.col("hay"), [{"query_term": "Borivali East", "canonical": "Borivali East"}])
    assert tuple(df.select(js, py).first()) == (11, 10)


def test_unpriced_project_passes_an_upper_limit_only(frame):
    df = frame([("1", None, None), ("2", 80.0, 90.0), ("3", 20.0, 30.0)], "id string, budget_min_l double, budget_max_l double")
    ids = {b: sorted(r.id for r in catalog.client_filter(df, catalog.from_buckets(budget=b)).collect()) for b in ("Under 75L", "75L–1.5Cr", "Above 1.5Cr")}
    assert ids == {"Under 75L": ["1", "3"], "75L–1.5Cr": ["2"], "Above 1.5Cr": []}


def test_gazetteer(frame, spark, tmp_path):
    data = {"cities": {"Mumbai": ["Borivali West", "Malad West"], "Thane": ["Kalwa"]}, "aliases": {"Chikuwadi": {"canonical": "Chikuwadi", "parent": "Borivali West", "city": "Mumbai"}, "Samata Nagar": [{"canonical": "Samata Nagar", "parent": "Kandivali East", "city": "Mumbai"}, {"canonical": "Samata Nagar", "parent": "Pokhran", "city": "Thane"}]}}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(data))
    places, aliases = gazetteer.read_gazetteer(spark, str(path), "home")
    got = {r.term: r for r in gazetteer.resolve_terms(frame([("Chikuwadi",), ("Samata Nagar",), ("malad west",), ("Zzz",)], "term string"), places, aliases, "home").collect()}
    assert got["Chikuwadi"].parent == "Borivali West" and not got["Chikuwadi"].alternatives
    assert got["Samata Nagar"].parent == "Kandivali East" and got["Samata Nagar"].alternatives[0].city == "Thane"
    assert got["malad west"].city == "Mumbai" and not got["Zzz"].known
    known = frame([("samata nagar",), ("borivali west",), ("malad west",), ("malad east",)], "name string")
    out = {r.term: r.match for r in gazetteer.near_misses(frame([("Sampta Nagar",), ("Borivli West",), ("Zzzzzz Nagar",)], "t string"), known, term="t").collect()}
    assert out == {"sampta nagar": "samata nagar", "borivli west": "borivali west"}


def test_range_join_equals_brute_force(frame):
    rng = random.Random(5)
    pts = [(k, rng.uniform(-60, 75), rng.uniform(-179.9, 179.9)) for k in range(150)]
    pts += [(k, 19 + rng.random() / 5, 72.8 + rng.random() / 5) for k in range(150, 300)]
    a, b = frame(pts[::2], "id long, lat double, lon double"), frame(pts[1::2], "pid long, plat double, plon double")
    for km in (3.0, 40.0):
        got = {(r.id, r.pid) for r in geo.within(a, b, km).collect()}
        every = a.crossJoin(b).where(geo.haversine_km("lat", "lon", "plat", "plon") <= km)
        assert got == {(r.id, r.pid) for r in every.collect()}


def test_reasons_of_the_gate(frame):
    schema = "name string, description string, lifecycle_status string, is_aggregator boolean, city string, location string"
    df = frame(
        [("Sky", "", "NEW_LAUNCH", False, "Navi Mumbai", "Nerul"), ("Park", "", "NEW_LAUNCH", False, "Mumbai", "Borivali West"), ("Old", "", "READY_TO_MOVE", False, "Mumbai", "Borivali West"), ("Cart", "add to cart now", "NEW_LAUNCH", False, "", ""), ("Re", "", "RESALE", False, "", "")],
        schema,
    )
    every, narrow = evidence.geography_terms(["Chikuwadi"], [{"parent": "Borivali West", "city": "Mumbai"}])
    first = {r.name: r.reason for r in df.withColumn("reason", evidence.reject_reason(final=False, terms=every, specific=narrow, cities=["Mumbai"])).collect()}
    last = {r.name: r.reason for r in df.withColumn("reason", evidence.reject_reason(final=True, terms=every, specific=narrow, cities=["Mumbai"])).collect()}
    assert first == {"Sky": "other area", "Park": None, "Old": None, "Cart": "unrelated commerce", "Re": "resale"}
    assert last["Old"] == "ready to move" and last["Park"] is None


def test_paged_source(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"page-{k:04d}.jsonl").write_text("".join(json.dumps({"id": f"{k}-{j}", "n": j}) + "\n" for j in range(3)))
    df = paged.paged(spark, str(tmp_path), "id string, n long", 5)
    assert df.count() == 6 and sorted(r.id for r in df.where("n >= 2").collect()) == ["1-2", "2-2"]


def test_stores(frame, spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{broken\n{"id": 2}\n')
    assert rows(stores.read_json(spark, str(tmp_path / "a.json"), "id long")) == [(1,), (2,)]
    snaps = frame([(1, [(1, "x")]), (2, [(2, "y"), (3, "z")])], "id long, items array<struct<a:long,b:string>>")
    assert rows(stores.latest_snapshot(snaps, "id", "items")) == [(2, "y"), (3, "z")]
    first, second = frame([(1, "a")], "k long, v string"), frame([(1, "b"), (2, "c")], "k long, v string")
    assert rows(stores.fallback(first, second, "k")) == [(1, "a"), (2, "c")]
    assert rows(stores.first_source([first, second], "k")) == [(1, "a", 0), (2, "c", 1)]


@pytest.mark.parametrize("n", [1, 2, 7])
def test_components_of_a_path(frame, n):
    nodes, edges = frame([(k,) for k in range(2 * n)], "seq long"), frame([(k, k + 1) for k in range(n)], "a long, b long")
    got = {r.seq: r.group for r in entity.label_components(nodes, edges).collect()}
    assert got == {k: 0 if k <= n else k for k in range(2 * n)}


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_hubs_and_large_components(frame, monkeypatch, heavy):
    monkeypatch.setattr(entity, "heavy_of", lambda n: heavy)
    edges = [(5, k) for k in range(6, 200)] + [(200 + k, 6 + k) for k in range(50)] + [(k, k + 1) for k in range(1000, 1040)] + [(9000, 9001)]
    nodes = frame([(k,) for k in {x for e in edges for x in e} | {1, 2}], "seq long")
    got = {r.seq: r.group for r in entity.label_components(nodes, frame(edges, "a long, b long")).collect()}
    assert got == {k: 5 for k in range(5, 250)} | {k: 1000 for k in range(1000, 1041)} | {9000: 9000, 9001: 9000, 1: 1, 2: 2}
    assert {r.seq: r.group for r in entity.label_components(nodes, frame([], "a long, b long")).collect()} == {r.seq: r.seq for r in nodes.collect()}


@pytest.mark.parametrize("others", [False, True])
def test_nearest_in_dense_and_sparse_surroundings(spark, frame, monkeypatch, others):
    draw, most, radius = random.Random(7), 3, 8.0
    spot = lambda wide: (round(19 + draw.random() * wide, 4), round(73 + draw.random() * wide, 4))
    places = [(k, *spot(0.02 if k % 3 else 0.3), draw.choice(["a", "b", None]) if k % 100 else "rare") for k in range(3000)]
    places += [(k + 5000, *places[k][1:]) for k in range(0, 3000, 10)]  # equal positions
    points = [(p[0], p[1], p[2]) for p in places[::25] if p[3]] if others else [(k, *spot(0.3)) for k in range(60)] + [(99, 19.01, 73.01), (98, 19.01, 73.01), (97, 10.0, 10.0)]
    radii, real = [], geo.within
    monkeypatch.setattr(geo, "within", lambda a, b, r, **k: radii.append(r) or real(a, b, r, **k))
    got = geo.nearest_places(frame(points, "id long, lat double, lon double"), frame(places, "place long, plat double, plon double, kind string"), radius, most=most, others=others)
    got = sorted((r.id, r.pos, r.place) for r in got.collect())
    assert len(radii) > 1 and radii[-1] == radius
    monkeypatch.undo()
    near = geo.nearest_per_type(geo.within(frame(points, "id long, lat double, lon double"), frame(places, "place long, plat double, plon double, kind string"), radius).where("id <> place" if others else "true").withColumn("km", F.round("km", 6)), "id", "kind", "place", most)
    assert got == sorted((r.id, r.pos, r.place) for r in near.collect()) and len(got) > 100


def test_rows_within_a_radius_in_chunks(frame):
    points = frame([(k, 19 + k % 4 / 100, 73 + k % 3 / 100) for k in range(200)] + [(500, None, 73.0)], "id long, lat double, lon double")
    places = frame([(k, 19 + k % 5 / 100, 73.0) for k in range(100)] + [(100, 19.0, None)], "place long, plat double, plon double")
    want = sorted((r.id, r.place, r.km) for r in geo.within(points, places, 3.0).collect())
    for chunk in (3, 512):
        assert sorted(map(tuple, geo.within_rows(points, places, 3.0, "id", "place", F.col("km"), chunk=chunk, task=1000).collect())) == want
