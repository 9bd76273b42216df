import base64
import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import classify, extract, nl, scalar
from quern.operators import json_walk, page_facts


def values(frame, column, rows, schema="x string"):
    return [r[0] for r in frame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column.alias("y")).collect()]


@pytest.mark.parametrize(
    ("raw", "cc", "want"),
    [
        ("+91 98765 43210", "", "9876543210"),
        ("09876543210", "", "9876543210"),
        ("12345", "", None),
        ("5876543210", None, None),
        ("50 123 4567", "971", "+971501234567"),
        ("123456", "971", None),
        (None, None, None),
    ],
)
def test_phone_key(frame, raw, cc, want):
    assert values(frame, scalar.phone_key("x", "c"), [(raw, cc)], "x string, c string") == [want]


def test_rounding_rules(frame):
    assert values(frame, scalar.half_up("x"), [10.5, 7.5, 2.5, -2.5], "x double") == [11, 8, 3, -2]
    assert values(frame, scalar.half_even("x"), [10.5, 7.5, 2.5, -2.5], "x double") == [10, 8, 2, -2]


def test_budgets(frame):
    texts = ["75L-1.5Cr", "1.2 cr", "90 lakh", "80-95 lakhs", "under 1.5cr", "none"]
    assert values(frame, nl.budget_max_cr("x"), texts) == [1.5, 1.2, 0.9, 0.95, 1.5, None]
    assert values(frame, nl.budget_max("x", "AED"), ["2m aed", "AED 900k", "aed 5000", "2 cr"]) == [2_000_000, 900_000, 5000, None]


def test_configurations(frame):
    assert values(frame, scalar.bhk_list("x"), ["2 & 3 BHK", "2bhk", "Studio", "1, 2 and 3.5 BHK"]) == [["2 BHK", "3 BHK"], ["2 BHK"], ["Studio"], ["1 BHK", "2 BHK", "3.5 BHK"]]
    assert values(frame, nl.configuration("x"), ["2 & 3 bhk", "3 bed", "studio flat", ""]) == ["2 BHK & 3 BHK", "3 BHK", "Studio", ""]


def test_money_and_dates(frame):
    assert values(frame, scalar.format_inr("x"), [15_000_000.0, 7_500_000.0, 20_000_000.0, 900.0], "x double") == ["₹1.5 Cr", "₹75 L", "₹2 Cr", "₹900"]
    assert values(frame, scalar.possession_label("x"), ["Ready to move in", "Dec 2027", "Q3 2026", "by 2028", ""]) == ["Ready to Move", "Dec 2027", "Q3 2026", "2028", ""]
    assert values(frame, scalar.possession_month("x"), ["2027-06-01", "December 2027", "soon"]) == ["2027-06", "2027-12", None]


def test_url_keys_are_one_line(frame):
    urls = ["http://a.example/" + "x" * n for n in (1, 39, 40, 41, 57, 300)] + ["http://a.example/?>~" + "\u00ff" * 60, ""]
    assert values(frame, scalar.url_key("x"), urls) == [base64.urlsafe_b64encode(u.encode()).decode().rstrip("=") for u in urls]


def test_keys_and_hmac(frame):
    assert values(frame, scalar.core_name_key("x"), ["Sky Park - Price List", "Sky Park"]) == ["skypark", "skypark"]
    want = hmac.new(b"secret", b"payload", hashlib.sha256).hexdigest()
    assert values(frame, scalar.hmac_sha256(F.lit("secret"), "x"), ["payload"]) == [want]


def test_chunks_cover_the_text(frame):
    text = "".join(chr(97 + k % 26) for k in range(9000))
    got = values(frame, scalar.chunks("x", 4000, 200), [text, "", "ab"])
    assert got[1:] == [[], ["ab"]]
    assert got[0][0] + "".join(c[200:] for c in got[0][1:]) == text


LIFECYCLES = [
    ("Resale 2 BHK Flat in Borivali West", "Owner posted, ready to move, contact for resale price", "RESALE"),
    ("2 BHK for Rent in Malad West", "Rental ₹35,000/month, immediate move-in", "RENTAL"),
    ("Nucleus", "Under construction, possession by December 2027", "UNDER_CONSTRUCTION"),
    ("Oasis Phase 2", "Near possession, handover expected shortly", "NEAR_POSSESSION"),
    ("New launch: Horizon", "Newly launched residential project", "NEW_LAUNCH"),
    ("Skyline", "Pre-launch offer — register your interest now", "PRE_LAUNCH"),
    ("Phase 1 — Ready to Move", "Phase 1 is ready to move with immediate possession. Phase 2 is still under construction.", "READY_TO_MOVE"),
    ("Some Random Listing Title", "Nice apartment with good amenities", "UNKNOWN"),
    ("Horizon", "On a 99-year lease deed, under construction", "UNDER_CONSTRUCTION"),
    ("2 BHK available on lease", "Lease: ₹25,000/month, immediate move-in", "RENTAL"),
    ("", "", "UNKNOWN"),
]


def test_lifecycle(frame):
    rows = [(a, b) for a, b, _ in LIFECYCLES]
    got = values(frame, classify.lifecycle("a", "b", F.lit("2026-01-01").cast("date"))["status"], rows, "a string, b string")
    assert got == [c for _, _, c in LIFECYCLES]


def test_lifecycle_by_date(frame):
    as_of = F.lit("2026-01-15").cast("date")
    found = classify.lifecycle(F.lit("A tower"), F.lit(""), as_of, "y", "d")["status"]
    rows = [(None, "Dec 2025"), (None, "May 2026"), (None, "Dec 2027"), (2029, None), (2026, None), (2020, None), (None, None)]
    assert values(frame, found, rows, "y int, d string") == ["READY_TO_MOVE", "NEAR_POSSESSION", "UNDER_CONSTRUCTION", "UNDER_CONSTRUCTION", "NEAR_POSSESSION", "READY_TO_MOVE", "UNKNOWN"]


def test_page_types(frame):
    rows = [
        ("2 BHK flats for sale in Malad", ""), ("Page 3 of results", ""), ("Sky Park by Rivali", ""), ("Malad West, Mumbai", ""),
        ("Rivali Park", "https://instagram.com/p/1"), ("All projects of the builder", ""), ("", ""), ("Complete guide to Malad", ""),
    ]
    none = F.lit("")
    got = values(frame, classify.page_type("t", none, "u", none, none), rows, "t string, u string")
    assert got == ["CATEGORY_PAGE", "SEARCH_RESULTS_PAGE", "INDIVIDUAL_LISTING", "CATEGORY_PAGE", "SOCIAL_POST", "DEVELOPER_DIRECTORY", "UNKNOWN", "CATEGORY_PAGE"]


def test_names(frame):
    assert values(frame, classify.invalid_name("x"), ["Security Alert", "Instagram", "notice", "Rivali Park", None, "View details"]) == [True, True, True, False, True, True]
    assert values(frame, classify.valid_developer("x"), ["Sheth Group", "Owner", "May 2026", "", "12345 AB", "Rivali"]) == [True, False, False, False, False, True]


def test_qualification(frame):
    assert values(frame, classify.qualification("x"), ["Won", "Lost", "New"]) == ["qualified", "disqualified", "unknown"]
    assert values(frame, classify.valid_sub_status("s", "u"), [("Lost", "Just browsing"), ("Lost", "Booked"), ("New", ""), ("Odd", "x")], "s string, u string") == [True, False, True, False]
    got = values(frame, classify.qualification_update(F.lit("Won"), "s", "l", F.lit(None).cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))["applied"], [("auto", 1), ("auto", 0), ("human", 1)], "s string, l int")
    assert got == [False, True, True]


def test_page_facts(frame):
    text = "Sky Park by Rivali Group near Metro Mall. Carpet 758 sq ft, built up 900 sq ft. G+22, 3 towers. Metro station 2 km. Possession by Dec 2027. P51800012345. ₹1.2 Cr"
    df = frame([(text,)], "x string")
    row = df.select(
        extract.floors("x"), extract.towers("x"), extract.developer("x"), extract.possession_in_context("x"), scalar.rera_of("x"), extract.price_cr("x")["display"]
    ).first()
    assert list(row) == ["G+22", 3, "Rivali Group", "Dec 2027", "P51800012345", "₹1.2 Cr"]
    areas = {r[2]: r[3] for r in page_facts.rows_of([text], [None]) if r[2].endswith("area")}
    assert areas == {"carpet_area": "758 sq ft", "built_up_area": "900 sq ft"}


def test_structured_data(frame):
    block = '{"@graph":[{"@type":"Residence","name":"Sky","floorSize":{"value":758,"unitText":"SQFT"},"brand":{"name":"Rivali"},"geo":{"latitude":19.2,"longitude":72.8},"amenityFeature":[{"name":"Gym"},{"name":"Pool","value":false}]}]}'
    rows = [(1, block), (2, "{broken"), (3, None), (4, '[1, "x"]'), (5, '{"@type": ["http://schema.org/AggregateOffer"], "lowPrice": 5, "highPrice": 7, "name": "no"}'), (None, block), (1, block)]
    got = {}
    for r in json_walk.structured_facts(frame(rows, "k long, j string").withColumn("path", F.lit("x")), id_col="k", json_col="j").collect():
        got.setdefault(r.id, {})[r.field] = r.value
    assert got[1]["carpet_area"] == "758 sq ft" and got[1]["developer"] == "Rivali" and got[1]["latitude"] == "19.2" and got[1]["amenities"] == "Gym"
    assert got[None] == got[1] and got[5] == {"price": "5 - 7"} and set(got) == {1, 5, None}


def naive_nodes(value, depth=0):
    if isinstance(value, dict):
        yield value
    if depth < 8:
        for x in [value[k] for k in sorted(value)] if isinstance(value, dict) else value if isinstance(value, list) else ():
            yield from naive_nodes(x, depth + 1)


def test_walk_equals_recursion(frame):
    rng = random.Random(3)

    def made(depth):
        kind = rng.random()
        if depth > 11 or kind < 0.3:
            return rng.choice([1, "x", None, True, 2.5])
        return {rng.choice("abcde"): made(depth + 1) for _ in range(rng.randint(0, 3))} if kind < 0.7 else [made(depth + 1) for _ in range(rng.randint(0, 3))]

    values = [{"a": made(1), "b": [made(2)]} for _ in range(40)] + [{"a": [[[[[[[[{"deep": 1}]]]]]]]]}]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(100, "{"), (101, None)]
    got = {}
    for r in json_walk.nodes(frame(rows, "k long, j string"), id_col="k", json_col="j").select("id", "path", F.to_json("node").alias("node")).orderBy("id", "path").collect():
        got.setdefault(r.id, []).append(json.loads(r.node))
    assert got == {k: list(naive_nodes(v)) for k, v in enumerate(values)}


def test_project_objects(frame):
    state = {"x": {"list": [{"name": "Sky Park", "id": 1}, {"name": "ab"}, {"project_name": "Hill"}, 5], "other": [{"id": 3, "in": [{"ProjectName": "Deep One"}]}], "names": ["name"], "empty": []}, "name": "no"}
    rows = json_walk.project_objects(frame([(1, json.dumps(state)), (2, "{"), (3, None)], "k long, j string"), id_col="k", json_col="j").collect()
    assert sorted((r.id, r.name, json.loads(r.item).get("id")) for r in rows) == [(1, "Deep One", None), (1, "Hill", None), (1, "Sky Park", 1)]


def test_scopes_and_sub_listings(frame):
    df = frame([("Each apartment has a private deck. " + "x" * 80 + " The podium of the tower has parking.",), (None,), ("",)], "x string")
    rows = {(r.field, r.scope) for r in df.select(F.inline(page_facts.placed("x", F.lit(None).cast("string")))).collect()}
    assert rows == {("deck", "unit"), ("parking", "project")}
    got = frame([("Sky Park P51800012345 2 BHK. Green Hill P51800054321 3 BHK",), (None,)], "x string").select(F.inline(page_facts.sub_listings("x"))).collect()
    assert [(r.rera, r.name) for r in got] == [("P51800012345", "Sky Park"), ("P51800054321", "Green Hill")]


def naive_scope(text, start, end):
    window = [(m.start(), m.end(), m[0].lower()) for m in page_facts.BUILDING_SCOPE.finditer(text) if m.start() >= start - 60 and m.end() <= end + 60][:1]
    unit = [m.start() for m in page_facts.UNIT_SCOPE.finditer(text) if m.start() >= start - 60 and m.end() <= end + 60][:1]
    if unit and window:
        return "unit" if abs(unit[0] - start) < abs(window[0][0] - start) else "project"
    if unit:
        return "unit"
    if window:
        return next((w for w in ("tower", "building") if w in window[0][2]), "project")
    return "unknown"


def naive_label(text, at):
    before = [m for m in page_facts.BHK.finditer(text) if m.start() >= at - 100 and m.end() <= at]
    after = [m for m in page_facts.BHK.finditer(text) if m.start() >= at and m.end() <= at + 100]
    return f"{(before[-1:] or after[:1])[0][1]} BHK" if before or after else None


def naive_nearest(text, name, pattern):
    hits = list(pattern.finditer(text))
    spots = [m.start() for m in re.finditer(re.escape(name), text, re.I)] if name and len(hits) > 1 else []
    return min(hits, key=lambda m: min((abs(m.start() - s) for s in spots), default=0)) if hits else None


def test_facts_by_place_equal_brute_force(frame):
    rng = random.Random(8)
    words = "2 BHK;3bhk;1 Bhk;643 sq ft;900 sq.ft.;1,064 sq ft;carpet;built-up;super  built;Rs. 85 L;₹1.7 Cr;rs 2 crore;deck;private decks;balconies;parking;own;each flat;tower;building;podium;amenities;P51800012345;p99999999999;Sky Park;sky park;é ß 日本;of the day;and;so".split(";")
    texts = [None, "", *("".join(rng.choice(words) + rng.choice([" ", ". ", " - ", " " * 30]) for _ in range(rng.randint(1, 60))) for _ in range(150))]
    rows = [(k, t, rng.choice(["Sky Park", None, "", "Nowhere"])) for k, t in enumerate(texts)]
    got = {}
    for r in page_facts.facts(frame(rows, "page_id long, text string, name string").withColumn("_t", F.lit("x")), name_col="name").where("place is not null").collect():
        got.setdefault(r.page_id, []).append((r.place, r.field, r.value, r.configuration, r.scope))
    for k, text, name in rows:
        text, want = text or "", []
        if m := naive_nearest(text, name, page_facts.RERA):
            want.append((m.start(), "rera_number", m[1].upper(), None, None))
        crores, lakhs = naive_nearest(text, name, page_facts.CRORES), naive_nearest(text, name, page_facts.LAKHS)
        if m := crores or lakhs:
            want.append((m.start(), "price", f"₹{m[1]} Cr" if crores else f"₹{m[1]}L", None, None))
        carpet = built = None
        for m in page_facts.AREA.finditer(text):
            around = [p for p in (page_facts.CARPET, page_facts.BUILT_UP) if any(x.start() >= m.start() - 20 and x.end() <= m.end() + 20 for x in p.finditer(text))]
            if page_facts.CARPET in around and not carpet:
                carpet = m
            elif page_facts.BUILT_UP in around and not built:
                built = m
            elif not carpet:
                carpet = m
        want += [(m.start(), f, f"{m[1]} sq ft", None, None) for f, m in (("carpet_area", carpet), ("built_up_area", built)) if m]
        for f, p in (("carpet_area", page_facts.SCOPED_AREA), ("price", page_facts.SCOPED_PRICE)):
            for m in p.finditer(text):
                if own := naive_label(text, m.start()):
                    want.append((m.start(), f, f"{m[1]} sq ft" if f == "carpet_area" else f"₹{m[1]} {'Cr' if m[2].lower().startswith('cr') else 'L'}", own, None))
        for f, p in page_facts.FEATURES.items():
            want += [(m.start(), f, m[0], naive_label(text, m.start()), naive_scope(text, *m.span())) for m in p.finditer(text)]
        assert sorted(got.get(k, []), key=repr) == sorted(want, key=repr), text


class Counted:
    """A pattern that counts the characters it is led over."""

    def __init__(self, pattern):
        self.pattern, self.read = pattern, 0

    def finditer(self, text, low=0, high=None):
        self.read += (len(text) if high is None else high) - low
        return self.pattern.finditer(text, low, len(text) if high is None else high)


def test_scopes_are_looked_for_around_features_only(monkeypatch):
    rng = random.Random(3)
    words = "deck;balcony;parking;own;private;in unit;each flat;5th floor 6;level 2 floor;tower;podium;3 bhk;900 sq ft;carpet;built up;super  built;and;so;é".split(";")
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ". ", ".", ", "]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    axis = page_facts.Axis(texts)
    spots = [axis.places(p) for p in page_facts.FEATURES.values()]
    for pattern in (page_facts.UNIT_SCOPE, page_facts.BUILDING_SCOPE, page_facts.CARPET, page_facts.BUILT_UP):
        near, everywhere = axis.near(pattern, spots, 60), axis.places(pattern)
        for p in spots:
            low, reach = p.starts - 60, p.ends - p.starts + 120
            a, b = near.after(low, reach), everywhere.after(low, reach)
            assert (a >= 0).tolist() == (b >= 0).tolist()
            assert [near.found[k].span() for k in a if k >= 0] == [everywhere.found[k].span() for k in b if k >= 0]
    for name in ("UNIT_SCOPE", "BUILDING_SCOPE", "CARPET", "BUILT_UP"):
        monkeypatch.setattr(page_facts, name, Counted(getattr(page_facts, name)))
    found = page_facts.rows_of(["A tower of prose. " * 5000 + "Own deck in the tower, 900 sq ft carpet. " + "A built up word. " * 5000], [None])
    assert len(found) == 2 and all(0 < getattr(page_facts, n).read < 500 for n in ("UNIT_SCOPE", "BUILDING_SCOPE", "CARPET", "BUILT_UP"))


def test_patterns_that_begin_with_a_set_find_the_same():
    plain = {
        "RERA": r"\b(P[A-Z]{0,2}\d{9,13})\b", "CRORES": r"(\d+\.?\d*)\s*(?:cr|crore)\b", "LAKHS": r"(\d+\.?\d*)\s*(?:l|lakh|lakhs)\b",
        "AREA": r"(?<![\d,.])(\d{3,5})\s*sq\.?\s*\.?\s*ft\.?", "SCOPED_AREA": r"(\d{3,5})\s*sq\.?\s*\.?\s*ft\.?",
    }
    rng, parts, n = random.Random(1), "cr;crore;l;lakhs;sq ft;sq. . ft;P;pq;51800012345;9.5;1,064;p99999999999;12;123;12345;123456;.;,; ;\n;x;\u212a;\u0661\u0662\u0663;\u017f".split(";"), 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        for name, pattern in plain.items():
            got, want = ([(m.span(), m[1]) for m in p.finditer(text)] for p in (getattr(page_facts, name), re.compile(pattern, re.I)))
            assert got == want, (name, text)
            n += len(want)
    assert n > 1000


def test_amenities_in_the_name_do_not_count_in_any_case(frame):
    rows = [(1, "\u00e9clat pool has a gym", "\u00c9CLAT Pool"), (2, "a Swimming Pool", None), (3, "pool", ""), (4, None, "Spa")]
    got = page_facts.facts(frame(rows, "page_id long, text string, name string"), name_col="name").where("field = 'amenities'").collect()
    assert sorted((r.page_id, r.value) for r in got) == [(1, "gym"), (2, "swimming pool"), (3, "pool")]


def test_parse_query(frame):
    q = nl.parse_query("x", ["Malad West", "Malad", "Liberty Garden"])
    df = frame([("2 bhk on Liberty Garden Malad West under 1.5 cr with sea view and gym by 2027",), ("3 bhk near Powai with pool",)], "x string").select(q.alias("q")).select("q.*")
    a, b = df.collect()
    assert a.locations == ["Liberty Garden", "Malad West"] and a.bedrooms == 2 and a.budget_max == 15_000_000 and a.possession == "2027" and set(a.amenities) == {"gym", "sea view"}
    assert b.locations == ["Powai"] and b.amenities == ["pool"]
