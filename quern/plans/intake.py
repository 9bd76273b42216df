"""Queries of lead intake, syncs, tiers of sources and what research reads next; stand-ins as in ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import nl, scalar
from quern.operators import catalog, evidence, gazetteer, geo, keyed, leads, secondary
from quern.plans.queries import query, t
from quern.sources import stores
from quern.sources.shared import new_folder


def s(c: str | F.Column) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---- leads by source


def answers(**values: F.Column) -> F.Column:
    """Form answers as an ad platform gives them."""
    return F.array(*(F.struct(F.lit(k.replace("_q", "?")).alias("name"), F.array(v, F.lit("second")).alias("values")) for k, v in values.items()))


@query("""WITH c AS (SELECT *, '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ph FROM customer),
w AS (SELECT ph AS phone, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_nationkey END AS project, NULL AS configuration, NULL AS budget, 'w' || c_custkey AS source_lead_id, 'site' AS source FROM c WHERE c_mktsegment = 'BUILDING'),
m AS (SELECT ph, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'q' || c_nationkey ELSE 'Form ' || c_nationkey END, CASE WHEN c_custkey % 3 = 0 THEN 'any' ELSE (c_nationkey % 4 + 1) || ' BHK' END, NULL, 'm' || c_custkey, 'meta' FROM c WHERE c_mktsegment = 'MACHINERY'),
h AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN ph ELSE '+1' || substr(ph, 1, 10) END, CASE WHEN c_custkey % 5 > 0 THEN c_name END, 't' || c_nationkey, NULL, NULL, c_nationkey || '-2024-01-0' || (c_nationkey % 9 + 1), 'housing' FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))
SELECT * FROM w UNION ALL SELECT * FROM m UNION ALL SELECT * FROM h""")
def leads_of_all_sources(spark: SparkSession, d: str) -> DataFrame:
    """A site's flat fields, an ad platform's answers, a portal's records, by market segment; one record for all."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = t(spark, d, "customer").withColumn("ph", F.concat(F.lit("98"), F.lpad(s("c_custkey"), 8, "0")))
    site = c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("w"), s(k)).alias("id"), F.lit("").alias("name"), F.col("c_name").alias("fullName"), F.concat(F.lit("+91 "), "ph").alias("mobile"), F.when(k % 2 == 0, F.concat(F.lit("p"), s(n))).alias("projectName"))
    form = c.where("c_mktsegment = 'MACHINERY'").select(
        F.concat(F.lit("m"), s(k)).alias("leadgen_id"),
        F.concat(F.lit("Form "), s(n)).alias("form_name"),
        answers(FULL_NAME=F.col("c_name"), phone_number=F.concat(F.lit("0"), "ph"), project=F.when(k % 2 == 0, F.concat(F.lit("q"), s(n))).otherwise(""), bhk=F.when(k % 3 == 0, "any").otherwise(F.concat(s(n % 4 + 1), F.lit("bhk flat")))).alias("field_data"),
    )
    portal = c.where("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')").select(
        F.when(k % 5 == 0, "(Owner)").otherwise(F.concat(F.lit("undefined "), "c_name")).alias("lead_name"),
        F.col("ph").alias("lead_phone"),
        F.when(k % 2 == 0, "91").otherwise("1").alias("country_code"),
        F.concat(F.lit("t"), s(n)).alias("project_name"),
        n.alias("project_id"),
        F.concat(F.lit("2024-01-0"), s(n % 9 + 1)).alias("lead_date"),
    )
    out = leads.normalized({"site": site, "meta": form, "housing": portal})
    return out.select("phone", "name", "project", "configuration", "budget", "source_lead_id", "source")


WEBHOOK_SQL = """l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN '<Test Lead: dummy data>' ELSE o_orderpriority END AS answer FROM orders WHERE o_orderstatus <> 'P')"""


def payloads(spark: SparkSession, d: str) -> DataFrame:
    value = F.struct(F.col("o_orderkey").alias("leadgen_id"), F.col("o_custkey").alias("form_id"), answers(full_name=F.when(F.col("o_orderpriority").startswith("1"), "<Test Lead: dummy data>").otherwise(F.col("o_orderpriority"))).alias("field_data"))
    change = F.struct(F.when(F.col("o_orderstatus") == "P", "feed").otherwise("leadgen").alias("field"), value.alias("value"))
    entry = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(change).alias("changes"))
    return entry.select(F.array(F.struct("id", "changes")).alias("entry"))


@query(f"WITH {WEBHOOK_SQL} SELECT o_custkey AS entry_id, o_orderkey AS leadgen_id, answer LIKE '<Test%' AS is_test FROM l")
def webhook_leads(spark: SparkSession, d: str) -> DataFrame:
    rows = leads.webhook_changes(payloads(spark, d))
    return rows.select("entry_id", "value.leadgen_id", leads.test_lead("value.field_data").alias("is_test"))


@query(f"WITH {WEBHOOK_SQL} SELECT o_custkey AS form_id, count(*) FILTER (answer LIKE '<Test%') AS test_leads, count(*) FILTER (answer NOT LIKE '<Test%') AS real_leads FROM l GROUP BY 1")
def test_and_real_leads(spark: SparkSession, d: str) -> DataFrame:
    return secondary.form_counts(leads.webhook_changes(payloads(spark, d)).select("value.form_id", "value.field_data"))


@query("""WITH c AS (SELECT event_id, user_id, ts, CAST(floor(abs(value)) AS BIGINT) AS secs, CASE event_type WHEN 'click' THEN 'call_connected' WHEN 'view' THEN 'call_no_answer' WHEN 'error' THEN 'call_failed' WHEN 'signup' THEN 'call_busy' END AS state FROM events)
SELECT CAST(user_id AS VARCHAR) AS phone, state AS checkpoint, 'call:' || event_id AS idempotency_key, epoch_us(ts) // 1000 AS at_ms FROM c WHERE state IS NOT NULL
UNION ALL SELECT CAST(user_id AS VARCHAR), 'call_attempted', 'call:' || event_id || ':attempted', epoch_us(ts) // 1000 - 1000 * coalesce(secs, 0) FROM c WHERE state IS NOT NULL""")
def voice_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Each call's result, and the attempt as long before it as the call took."""
    kind = F.create_map(*(F.lit(x) for p in {"click": "Completed", "view": "no-answer", "error": "FAILED", "signup": "busy", "purchase": "ringing"}.items() for x in p))
    calls = t(spark, d, "events").select(s("user_id").alias("phone"), s("event_id").alias("attempt_id"), kind[F.col("event_type")].alias("status"), F.floor(F.abs("value")).alias("duration"), F.col("ts").cast("timestamp").alias("at"))
    return leads.with_attempts(calls).select("phone", "checkpoint", "idempotency_key", F.unix_millis("occurred_at").alias("at_ms"))


# ---- CRM rows and logs


@query("""WITH r AS (SELECT o_custkey AS id, arg_min(CASE WHEN o_orderstatus = 'F' THEN '-' WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE ' ' END, o_orderkey) AS project_name FROM orders GROUP BY 1)
SELECT id, c_name AS name, upper(substr(c_name, 1, 1)) || CASE WHEN c_name LIKE '% %' THEN upper(substr(split_part(c_name, ' ', 2), 1, 1)) ELSE '' END AS initials FROM r JOIN customer ON c_custkey = id WHERE trim(project_name) NOT IN ('', '-')""")
def crm_portal_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each id, those of the portal's class, with names by their form answers."""
    project = F.when(F.col("o_orderstatus") == "F", "-").when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise(" ")
    first = keyed.collapse_first(t(spark, d, "orders").select(s("o_custkey").alias("id"), "o_orderkey", project.alias("project_name")), F.col("id"), [F.col("o_orderkey")])
    rows = secondary.crm_rows(first.select("id", "project_name"), "housing")
    named = rows.join(t(spark, d, "customer"), F.col("c_custkey") == F.col("id").cast("long")).select("id", F.lit("").alias("name"), answers(full_name=F.col("c_name")).alias("field_data"))
    fields = secondary.crm_fields(named.withColumn("project", s("id")))
    return fields.select(F.col("project").cast("long").alias("id"), "name", secondary.initials(F.col("name")).alias("initials"))


@query("SELECT c_custkey AS id FROM customer ORDER BY c_custkey DESC LIMIT 100 OFFSET 200")
def crm_third_page(spark: SparkSession, d: str) -> DataFrame:
    return secondary.crm_page(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), 3, 500)


@query("SELECT count(*) AS fetched, count(*) FILTER (event_type = 'signup') AS created, count(*) FILTER (event_type = 'view') AS duplicates, count(*) FILTER (event_type = 'error') AS skipped FROM events")
def sync_totals(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "duplicate").when(F.col("event_type") == "error", "skipped")
    return secondary.sync_summary(t(spark, d, "events").select(outcome.alias("outcome")), "outcome")


@query("""SELECT * FROM (SELECT 'touch' AS what, o_orderkey AS id, o_orderdate::DATE AS day, o_orderpriority AS note FROM orders UNION ALL SELECT 'edit', l_orderkey, l_shipdate::DATE, NULL FROM lineitem) ORDER BY day DESC""")
def feed_of_logs(spark: SparkSession, d: str) -> DataFrame:
    touches = t(spark, d, "orders").select(F.lit("touch").alias("what"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("note"))
    edits = t(spark, d, "lineitem").select(F.lit("edit").alias("what"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("date").alias("day"))
    return secondary.feed(touches, edits, at="day")


# ---- tiers of sources


@query("""WITH m AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1)
SELECT c_custkey AS key, CASE WHEN seen > now - INTERVAL 24 HOUR THEN kind END AS kind, NOT coalesce(seen > now - INTERVAL 24 HOUR, false) AS missing FROM customer LEFT JOIN c ON user_id = c_custkey, m""")
def intel_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their newest event as cache, where it is under 24 hours old (by seconds)."""
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cache = events.groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("fetched_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    now = events.agg(F.max("ts")).first()[0]
    asked = t(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return secondary.tiered_intel(asked, cache, "key", F.lit(now)).select("key", "kind", "missing")


@query("""WITH c AS (SELECT p_partkey, p_name, p_type, s_suppkey, p_name || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' ' || s_name END AS found, p_name || ' ' || p_brand AS asked, s_suppkey % 5 AS prio FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey),
w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(asked), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS a, list_distinct(list_filter(string_split_regex(lower(CASE WHEN s_suppkey % 3 = 0 THEN p_type ELSE found END), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS f FROM c)
SELECT p_partkey, min(prio) AS prio FROM w WHERE len(a) = 0 OR len(f) = 0 OR len(list_intersect(a, f)) >= 1 AND len(list_intersect(a, f)) / len(a) >= 0.34 GROUP BY 1""")
def intel_of_first_source(spark: SparkSession, d: str) -> DataFrame:
    """For each part the first of its suppliers, as sources, whose name for it fits."""
    pairs = t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    found = F.when(F.col("s_suppkey") % 3 == 0, F.col("p_type")).when(F.col("s_suppkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "s_name"))
    rows = pairs.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("asked"), found.alias("found"), (F.col("s_suppkey") % 5).alias("prio"))
    return secondary.dispatched(rows, "p_partkey", "asked", "found", "prio").select("p_partkey", "prio")


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'first' WHEN s_suppkey % 2 = 0 THEN 'second' ELSE 'third' END AS said, CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS source_rank FROM supplier""")
def geocoded_by_first_source(spark: SparkSession, d: str) -> DataFrame:
    """Three geocoders; what the first has not comes from the next."""
    rows = t(spark, d, "supplier")
    parts = [rows.where("s_acctbal > 5000").select("s_suppkey", F.lit("first").alias("said")), rows.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("second").alias("said")), rows.select("s_suppkey", F.lit("third").alias("said"))]
    return stores.first_source(parts, "s_suppkey")


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_size > 25) AS r FROM part), c AS (SELECT count(*) AS n, count(*) FILTER (p_size > 25) AS r FROM part WHERE p_retailprice < 1000)
SELECT p_partkey FROM part, n, c WHERE p_retailprice < 1000 OR c.n < 0.6 * n.n OR c.r < 0.5 * n.r""")
def seed_or_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The cheap parts as the current catalog, all as the seed."""
    seed = t(spark, d, "part").withColumn("rera", F.when(F.col("p_size") > 25, "P1"))
    return stores.better_seed(seed.where("p_retailprice < 1000"), seed).select("p_partkey")


@query("""WITH o AS (SELECT count(*) AS n FROM part), w AS (SELECT count(*) AS n FROM part WHERE p_size > 40) SELECT p_partkey FROM part, o, w WHERE p_size > 40 OR (o.n >= 20 AND w.n < 0.5 * o.n)""")
def refresh_or_keep(spark: SparkSession, d: str) -> DataFrame:
    """The large parts as a new catalog that is too small to replace all of them."""
    old = t(spark, d, "part").select("p_partkey", "p_size")
    return stores.guarded_refresh(old, old.where("p_size > 40")).select("p_partkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 3")
def json_rows_that_parse(spark: SparkSession, d: str) -> DataFrame:
    """Stored JSON; what is cut off is no row."""
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 3, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props"))
    return stores.parsed(rows, "props", "k long").where("props.k IS NOT NULL").select("event_id", "props.k")


# ---- places and what is read next


@query("""WITH q AS (SELECT s_suppkey, ['Airport', 'Metro/Rail', 'Hospital', 'School', 'Mall', 'Bank', 'Place'][s_suppkey % 7 + 1] AS kind FROM supplier)
SELECT CASE kind WHEN 'School' THEN 'Schools' WHEN 'Hospital' THEN 'Hospitals' WHEN 'Mall' THEN 'Shopping' WHEN 'Bank' THEN 'Banking' ELSE 'Other' END AS bucket, count(*) AS n FROM q GROUP BY 1""")
def infrastructure_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as places with map tags; their kinds by bucket."""
    tags = [("aeroway", "aerodrome"), ("station", "subway"), ("amenity", "hospital"), ("amenity", "school"), ("shop", "mall"), ("amenity", "bank"), ("highway", "stop")]
    own = F.element_at(F.array(*(F.create_map(F.lit(a), F.lit(b)) for a, b in tags)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    empty = F.create_map(*(x for k in ("aeroway", "railway", "station", "amenity", "shop") for x in (F.lit(k), F.lit(""))))
    full = F.map_zip_with(own, empty, lambda k, a, b: F.coalesce(a, b))
    return geo.infrastructure_counts(t(spark, d, "supplier").select(geo.tag_kind(full).alias("kind")), "kind")


@query("""WITH p AS (SELECT s_nationkey AS key, s_suppkey, s_name AS name, s_acctbal AS km, s_suppkey % 3 = 0 AS main FROM supplier)
SELECT key, name, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY main DESC, km, name) AS pos FROM p) WHERE pos <= 6""")
def nearest_main_first(spark: SparkSession, d: str) -> DataFrame:
    pairs = t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("km"))
    return secondary.nearest_places(pairs, "key", F.col("s_suppkey") % 3 == 0, 6).select("key", "name", F.col("pos").cast("long").alias("pos"))


@query("""WITH q AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS pos, p_name AS name FROM part), s AS (SELECT lower(p_name) AS n, arg_min(CASE WHEN p_size % 4 = 0 THEN 'CLOSED_PERMANENTLY' ELSE 'OPEN' END, p_partkey) AS status FROM part WHERE p_size > 10 GROUP BY 1)
SELECT id, q.pos <= 12 AND s.n IS NOT NULL AS places_verified FROM q LEFT JOIN s ON s.n = lower(name) AND q.pos <= 12 WHERE coalesce(status, '') <> 'CLOSED_PERMANENTLY'""")
def places_of_first_twelve(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve parts get their place, unless it is closed: then they go."""
    parts = t(spark, d, "part")
    first = parts.select("p_partkey").orderBy("p_partkey").limit(12).select("p_partkey", F.lit(True).alias("_first"))
    rows = parts.join(F.broadcast(first), "p_partkey", "left").select(F.col("p_partkey").alias("id"), F.when(F.col("_first"), 1).otherwise(99).alias("pos"), F.col("p_name").alias("name"))
    places = parts.where("p_size > 10").groupBy(F.lower("p_name").alias("name")).agg(F.min_by(F.when(F.col("p_size") % 4 == 0, "CLOSED_PERMANENTLY").otherwise("OPEN"), "p_partkey").alias("status"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    return secondary.with_places(rows, places).select("id", "places_verified")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Location: ' || p_brand WHEN p_size % 3 = 1 THEN (p_size % 4 + 1) || ' BHK fits' ELSE 'Rated ' || p_brand END AS reason,
  CASE WHEN p_size % 4 = 0 THEN 'b' || p_brand WHEN p_size % 4 = 1 THEN 'c' || p_brand ELSE '' END AS peers FROM part""")
def reasons_and_peers(spark: SparkSession, d: str) -> DataFrame:
    """The reason that is shown of several, and the first list of peers that has any."""
    n = F.col("p_size")
    rated, bhk, place = F.concat(F.lit("Rated "), "p_brand"), F.concat(s(n % 4 + 1), F.lit(" BHK fits")), F.concat(F.lit("Location: "), "p_brand")
    said = F.when(n % 3 == 0, F.array(rated, bhk, place)).when(n % 3 == 1, F.array(rated, bhk)).otherwise(F.array(rated, F.lit("Other")))
    none = F.array().cast("array<string>")
    lists = [F.when(n % 4 == 0, F.array(F.concat(F.lit("b"), "p_brand"))).otherwise(none), F.when(n % 4 == 1, F.array(F.concat(F.lit("c"), "p_brand"))), none]
    return t(spark, d, "part").select("p_partkey", catalog.primary_reason(said).alias("reason"), F.array_join(secondary.competitors(*lists), ",").alias("peers"))


@query("""WITH q AS (SELECT p_partkey, p_retailprice * 10000 AS price, p_size % 3 AS k FROM part)
SELECT p_partkey, CAST(CASE WHEN price IS NULL THEN 0 WHEN (price - 1.2 * 1e7) / (1.2 * 1e7) <= 0 THEN 15 WHEN (price - 1.2 * 1e7) / (1.2 * 1e7) <= 0.15 THEN 6 ELSE 0 END AS INTEGER) AS budget,
  CAST(CASE k WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END AS INTEGER) AS amenity FROM q""")
def points_of_research(spark: SparkSession, d: str) -> DataFrame:
    """Budget with its band of 15 percent, and amenities of which a deck counts in the unit only."""
    k = F.col("p_size") % 3
    feature = F.struct(F.lit("deck").alias("feature"), F.when(k == 0, "unit").otherwise("project").alias("scope"), F.lit("2 BHK").alias("configuration"))
    have = F.when(k < 2, F.array(F.lit("Gym"))).otherwise(F.array(F.lit("Pool")))
    return t(spark, d, "part").select("p_partkey", evidence.budget_points(F.col("p_retailprice") * 10_000, 1.2).alias("budget"), evidence.amenity_points(have, F.lit("by the sea"), F.array(feature), ["gym", "deck"], "2 bhk").alias("amenity"))


@query("""SELECT p_partkey FROM part ORDER BY p_size % 2 DESC, (p_retailprice < 1200) DESC, p_size DESC, p_partkey LIMIT 40""")
def research_next(spark: SparkSession, d: str) -> DataFrame:
    """Rows that can be fetched, then those undetermined, then by priority."""
    rows = t(spark, d, "part").select("p_partkey", (F.col("p_size") % 2 == 1).alias("fetchable"), (F.col("p_retailprice") < 1200).alias("undetermined"), F.col("p_size").alias("priority"))
    return evidence.research_order(rows, "fetchable", "undetermined", "priority", "p_partkey").limit(40).select("p_partkey")


@query("""SELECT string_agg('- ' || p_name || ' in ' || p_brand || ', from ' || p_size || ' (' || CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END || ').', chr(10) ORDER BY p_partkey) AS text FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 8)""")
def brief_of_eight(spark: SparkSession, d: str) -> DataFrame:
    best = t(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(8)
    line = evidence.brief(F.col("p_name"), F.col("p_brand"), F.lit(""), s("p_size"), F.when(F.col("p_size") > 25, "high").otherwise("low"))
    return evidence.markdown(best, "p_partkey", line)


@query("""WITH n AS (SELECT p_name AS name, count(*) AS weight FROM part GROUP BY 1) SELECT name, weight FROM n WHERE contains(lower(name), 'wi') ORDER BY weight DESC, name LIMIT 10""")
def suggested_by_weight(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("weight"))
    return catalog.suggest_by_weight(rows, " WI ")


@query("""SELECT p_partkey FROM part WHERE (contains(lower(p_brand || ' ' || p_type || ' ' || p_name), 'blue') OR contains(lower(p_brand || ' ' || p_type || ' ' || p_name), 'gear')) AND p_size + 10 >= 20 AND p_size <= 60 AND p_partkey % 3 = 1 AND 2026 + p_size % 5 <= 2029 AND 2026 + p_size % 5 >= 2027""")
def index_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The search index's filter: places, budget, configurations, years."""
    rows = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("city"), F.col("p_type").alias("location"), F.lit(None).cast("string").alias("nearby_locality"), F.col("p_name").alias("name"), F.col("p_size").alias("budget_min_l"), (F.col("p_size") + 10).alias("budget_max_l"), F.array(s(F.col("p_partkey") % 3 + 1)).alias("config"), (2026 + F.col("p_size") % 5).alias("possession_year"))
    want = catalog.Wanted(locations=["Blue", "gear"], budget_min=20, budget_max=60, configs=["2"], year_min=2027, year_max=2029)
    return catalog.index_filter(rows, want).select("p_partkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 1 WHEN o_orderkey % 4 = 2 THEN 2 ELSE 3 END AS tier FROM orders ORDER BY tier, o_totalprice DESC, o_orderkey LIMIT 30""")
def tiers_then_score(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("Primary"), F.lit("secondary"), F.lit("TERTIARY"), F.lit("Low Match")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = t(spark, d, "orders").withColumn("label", label).withColumn("tier", catalog.tier_order("label"))
    return rows.orderBy("tier", F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "tier")


@query("""SELECT c_custkey, count(DISTINCT x) AS n_words FROM (SELECT c_custkey, unnest([c_mktsegment, n_name, r_name, c_mktsegment]) AS x FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY 1""")
def united_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    both = secondary.primary_then_fallback(F.array("c_mktsegment", "n_name"), F.array("r_name", "c_mktsegment"), 10)
    return rows.select("c_custkey", F.size(both).cast("long").alias("n_words"))


# ---- catalog rows, places, evidence


@query("""WITH a AS (SELECT DISTINCT lower(p_brand) AS alias, p_size AS seq, 'C' || p_size AS canonical, 'P' || (p_size % 4) AS parent, 'X' || (p_size % 3) AS city, CASE WHEN p_size % 2 = 0 THEN 'home' ELSE 'far' END AS market FROM part WHERE p_size % 5 < 2),
l AS (SELECT n_name AS name, r_name AS city, CASE WHEN n_nationkey % 2 = 0 THEN 'home' ELSE 'far' END AS market FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT DISTINCT p_brand, 'Brandville', 'home' FROM part WHERE p_size > 48),
terms AS (SELECT DISTINCT p_brand AS term FROM part UNION SELECT upper(n_name) FROM nation UNION SELECT 'nowhere'),
ma AS (SELECT alias, market, list(struct_pack(c := canonical, p := parent, t := city) ORDER BY seq) AS e FROM a GROUP BY 1, 2),
ba AS (SELECT alias, arg_min(e, CASE market WHEN 'home' THEN 0 ELSE 1 END) AS e, min(CASE market WHEN 'home' THEN 0 ELSE 1 END) AS o FROM ma GROUP BY 1),
bl AS (SELECT lower(name) AS name, arg_min(city, CASE market WHEN 'home' THEN 0 ELSE 1 END) AS city, min(CASE market WHEN 'home' THEN 0 ELSE 1 END) AS o FROM l GROUP BY 1),
j AS (SELECT term, e, bl.city, e IS NOT NULL AND (bl.o IS NULL OR ba.o <= bl.o) AS use, e IS NOT NULL OR bl.name IS NOT NULL AS known FROM terms LEFT JOIN ba ON ba.alias = lower(trim(term)) LEFT JOIN bl ON bl.name = lower(trim(term)))
SELECT term, CASE WHEN use THEN e[1].c ELSE term END AS canonical, CASE WHEN use THEN e[1].p END AS parent, CASE WHEN use THEN e[1].t ELSE city END AS city, use AS is_micro_alias, CASE WHEN use THEN len(e) - 1 ELSE 0 END AS n_alternatives, known FROM j""")
def places_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Brands and nations as terms, against aliases made of brands and localities made of nations, in two markets."""
    n = F.col("p_size")
    part, nation = t(spark, d, "part"), t(spark, d, "nation").join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    market = lambda k: F.when(k % 2 == 0, "home").otherwise("far")
    aliases = part.where("p_size % 5 < 2").select(F.lower("p_brand").alias("alias"), n.alias("seq"), F.concat(F.lit("C"), s(n)).alias("canonical"), F.concat(F.lit("P"), s(n % 4)).alias("parent"), F.concat(F.lit("X"), s(n % 3)).alias("city"), market(n).alias("market")).distinct()
    places = nation.select(F.col("n_name").alias("name"), F.col("r_name").alias("city"), market(F.col("n_nationkey")).alias("market")).union(part.where("p_size > 48").select("p_brand", F.lit("Brandville"), F.lit("home")).distinct())
    terms = part.select(F.col("p_brand").alias("term")).union(nation.select(F.upper("n_name"))).union(spark.range(1).select(F.lit("nowhere"))).distinct()
    found = gazetteer.resolve_terms(terms, places, aliases, "home")
    return found.select("term", "canonical", "parent", "city", "is_micro_alias", F.greatest(F.coalesce(F.size("alternatives"), F.lit(0)), F.lit(0)).cast("long").alias("n_alternatives"), "known")


@query("""WITH l AS (SELECT *, (l_linenumber % 3 + 1) || ' BHK' AS kind, CASE WHEN l_quantity < 5 THEN 0.0 ELSE floor(l_extendedprice) * 100 END AS price FROM lineitem),
g AS (SELECT l_partkey, min(price) FILTER (price > 0) AS low, max(price) FILTER (price > 0) AS high, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS available, count(*) AS units FROM l GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, floor(low / 1e5 + 0.5) AS budget_min_l, floor(high / 1e5 + 0.5) AS budget_max_l, CASE WHEN p_size % 3 = 0 THEN 'Unknown Developer' ELSE p_brand END AS developer, available, units FROM g JOIN part ON p_partkey = l_partkey""")
def catalog_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as the inventory of their part."""
    item = F.struct(F.concat(s(F.col("l_linenumber") % 3 + 1), F.lit(" BHK")).alias("type"), F.when(F.col("l_quantity") < 5, 0.0).otherwise(F.floor("l_extendedprice") * 100).alias("price"), F.col("l_quantity").cast("long").alias("available"))
    raw = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_list(item).alias("inventory")).join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    raw = raw.select(F.col("p_partkey").alias("id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), F.col("p_type").alias("location"), F.lit("x").alias("city"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("developer"), "inventory")
    return catalog.normalized_projects(raw).select("id", "name", F.col("budget_min_l").cast("double").alias("budget_min_l"), F.col("budget_max_l").cast("double").alias("budget_max_l"), "developer", "available", F.size("inventory").cast("long").alias("units"))


@query("""SELECT p_partkey, unnest([1, 2]) AS pos, unnest([(p_size % 4 + 1) || ' BHK', (p_size % 3 + 2) || ' BHK']) AS type, CAST(unnest([p_size + 400, p_size * 20 + 1000]) AS INTEGER) AS carpet_min, CAST(unnest([p_size + 450, p_size * 20 + 1100]) AS INTEGER) AS carpet_max, CAST(unnest([p_size * 10000000, p_size * 100000]) AS BIGINT) AS price FROM part""")
def unit_mixes(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions with two unit types each, as rows."""
    n = F.col("p_size")
    said = F.concat(
        F.col("p_name"), F.lit(". "), s(n % 4 + 1), F.lit(" BHK homes, Carpet Area: Approx. **"), s(n + 400), F.lit(" to "), s(n + 450), F.lit(" sq. ft.**. Starting Price: **₹"), s(n), F.lit(" Crore. "),
        s(n % 3 + 2), F.lit("bhk Carpet Area "), F.format_number(n * 20 + 1000, 0), F.lit(" - "), F.format_number(n * 20 + 1100, 0), F.lit(" sqft by the "), "p_type", F.lit(". Starting price ₹ "), s(n), F.lit(" Lakh"),
    )
    rows = t(spark, d, "part").select("p_partkey", F.posexplode(secondary.unit_mix(said)).alias("pos", "u"))
    return rows.select("p_partkey", (F.col("pos") + 1).alias("pos"), "u.*")


@query("""SELECT p_partkey AS seq, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS developer, CASE p_size % 3 WHEN 0 THEN (p_size % 4 + 1) || ' BHK,' || (p_size % 4 + 2) || ' BHK' WHEN 1 THEN '2 BHK' ELSE '' END AS configuration,
  CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 1000000 WHEN p_size % 3 = 2 THEN round_even(1.5 * 1e7, 0) END AS BIGINT) AS price_max_inr, CASE WHEN p_size % 2 = 0 THEN 'P' || p_size WHEN p_size % 3 = 2 THEN '₹1.5 Cr' END AS price_display,
  CASE WHEN p_size % 5 = 0 THEN 2027 WHEN p_size % 5 = 1 THEN 2026 END AS possession_year, CASE WHEN p_size % 5 = 0 THEN 'Dec 2027' WHEN p_size % 5 = 1 THEN 'Ready to Move' END AS possession_display, 'Gym,Pool' AS amenities FROM part""")
def properties_of_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of evidence: what is given stays, what is missing is read from the text."""
    n, none = F.col("p_size"), F.lit(None).cast("string")
    price = F.struct(F.lit(None).cast("long").alias("min_inr"), F.when(n % 2 == 0, n * 1_000_000).cast("long").alias("max_inr"), F.when(n % 2 == 0, F.concat(F.lit("P"), s(n))).alias("display"))
    rows = t(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.when(n % 3 == 1, "homes of 2 BHK").when(n % 3 == 2, "all at 1.5 Cr").otherwise("by the sea").alias("description"), F.when(n % 2 == 0, F.col("p_brand")).otherwise(" ").alias("developer"),
        F.col("p_type").alias("location"), none.alias("city"), F.when(n % 3 == 0, F.array(F.concat(s(n % 4 + 1), F.lit(" & "), s(n % 4 + 2), F.lit(" BHK")))).otherwise(F.array().cast("array<string>")).alias("configuration"), price.alias("price"),
        F.struct(F.lit(None).cast("double").alias("value_sqft"), none.alias("display")).alias("carpet_area"), F.when(n % 5 == 0, "Dec 2027").when(n % 5 == 1, "ready").alias("possession"), none.alias("rera"), F.array(F.lit(" Gym"), F.lit(""), F.lit("Pool ")).alias("amenities"),
        F.lit("web").alias("source"), F.lit("https://a.b/c").alias("source_url"), F.lit("web").alias("source_type"), F.lit("2026-01-01").alias("captured_at"),
    )
    out = evidence.to_properties(rows, F.lit("2026-06-01").cast("date"))
    return out.select("seq", "name", "developer", F.array_join("configuration", ",").alias("configuration"), "price_max_inr", "price_display", "possession_year", "possession_display", F.array_join("amenities", ",").alias("amenities"))


@query("""SELECT CASE WHEN o_orderpriority < '3' THEN 'urgent' ELSE 'later' END AS log, count(*) * 2 AS rows, CAST(sum(o_orderkey) * 2 AS BIGINT) AS keys FROM orders GROUP BY 1
UNION ALL SELECT 'index', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders""")
def logs_and_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Orders appended twice to a log by priority, and once uploaded in batches of a thousand; both read back."""
    home = new_folder(spark, "logs")
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") < "3", "urgent").otherwise("later").alias("log"))
    for _ in range(2):
        stores.append(rows, f"{home}/log", "log")
    stores.upload_batches(rows, f"{home}/index")
    log = spark.read.schema("o_orderkey long, log string").parquet(f"{home}/log").groupBy("log").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))
    index = stores.read_json(spark, f"{home}/index", "o_orderkey long, log string").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))
    return log.unionByName(index.select(F.lit("index").alias("log"), "rows", "keys"))


@query("""WITH w AS (SELECT c_custkey, list_filter(string_split_regex(lower(c_mktsegment || ' of ' || n_name), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS a, list_filter(string_split_regex(lower(r_name || '-' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS b
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) SELECT c_custkey, len(list_intersect(a, b)) > 0 AS same FROM w""")
def registered_name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether a registered name shares any word of weight with the one that is claimed."""
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.select("c_custkey", F.concat_ws(" of ", "c_mktsegment", "n_name").alias("a"), F.concat(F.col("r_name"), F.lit("-"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("")).alias("b"))
    return rows.select("c_custkey", leads.tokens_overlap("a", "b").alias("same"))


@query("""SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 6) AS rank,
  count(*) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate::TIMESTAMP)::BIGINT // 86400 RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS in_90_days FROM orders""")
def ext_window_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Quarters, percent ranks and a range of days (extensions)."""
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    own = Window.partitionBy("o_custkey")
    return t(spark, d, "orders").select(
        "o_orderkey",
        F.ntile(4).over(own.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("quarter"),
        F.round(F.percent_rank().over(own.orderBy("o_orderdate")), 6).alias("rank"),
        F.count("*").over(own.orderBy(day).rangeBetween(-90, Window.currentRow)).alias("in_90_days"),
    )


# ---- questions with places


@query("""WITH q AS (SELECT c_custkey, c_custkey % 4 AS k, n_nationkey % 4 + 1 AS n, c_custkey % 9 + 1 AS cr, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS place, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE k WHEN 0 THEN place WHEN 1 THEN seg || '|' || place WHEN 3 THEN seg || '|' || place ELSE '' END AS locations, CASE k WHEN 0 THEN n || ' BHK' WHEN 3 THEN 'Studio' ELSE '' END AS configuration, CASE k WHEN 0 THEN CAST(n AS INTEGER) END AS bedrooms,
  CASE k WHEN 0 THEN cr * 10000000 END::DOUBLE AS budget_max, CASE k WHEN 1 THEN '2027' WHEN 3 THEN '2028' ELSE '' END AS possession, CASE k WHEN 0 THEN 'gym' WHEN 1 THEN 'sea view' WHEN 2 THEN 'pool' ELSE '' END AS amenities, true AS wanted FROM q""")
def questions_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Questions that name nations and market segments, which are the gazetteer (two dimensions of a few names each)."""
    nation, customer = t(spark, d, "nation"), t(spark, d, "customer")
    names = [r[0] for r in nation.select("n_name").union(customer.select("c_mktsegment")).distinct().collect()]
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    said = (
        F.when(k % 4 == 0, F.concat(s(F.col("n_nationkey") % 4 + 1), F.lit(" BHK in "), F.lower("n_name"), F.lit(" under "), s(k % 9 + 1), F.lit(" cr with gym")))
        .when(k % 4 == 1, F.concat(F.lit("flats near "), F.lower(seg), F.lit(" and "), "n_name", F.lit(", with a sea view, by 2027")))
        .when(k % 4 == 2, F.concat("n_name", F.lit("x or x"), seg, F.lit(" pool")))
        .otherwise(F.concat(F.lit("studio "), seg, F.lit(" "), F.lower(seg), F.lit(" "), "n_name", F.lit(" possession 2028")))
    )
    rows = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", said.alias("said"))
    parsed = rows.withColumn("q", nl.parse_query("said", names))
    return parsed.select(
        "c_custkey", F.array_join("q.locations", "|").alias("locations"), "q.configuration", "q.bedrooms", F.col("q.budget_max").cast("double").alias("budget_max"), "q.possession", F.array_join("q.amenities", "|").alias("amenities"),
        nl.is_property_query("said", F.col("q"), names).alias("wanted"),
    )


# ---- texts of many rows


LINES_SQL = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, CAST(l_quantity AS BIGINT) % 5 + 1 AS n FROM lineitem)"


def lines_of(spark: SparkSession, d: str, text: F.Column, key: str = "l_orderkey") -> DataFrame:
    """(key, parts): a text for each line, in their order."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", text.alias("x")))), lambda r: r["x"]).alias("parts"))


@query(f"""WITH {LINES_SQL}, x AS (SELECT l_orderkey, pos, unnest(CASE l_returnflag WHEN 'A' THEN [CAST(l_linenumber AS VARCHAR), CAST(n AS VARCHAR)] WHEN 'N' THEN [n || '.5'] ELSE [] END) AS u, unnest(CASE l_returnflag WHEN 'A' THEN [1, 2] WHEN 'N' THEN [1] ELSE [] END) AS k FROM l),
f AS (SELECT l_orderkey, u, min(pos * 10 + k) AS at FROM x GROUP BY 1, 2), g AS (SELECT l_orderkey, string_agg(u || ' BHK', ',' ORDER BY at) AS units FROM f GROUP BY 1)
SELECT o.l_orderkey, coalesce(units, 'Studio') AS units FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN g USING (l_orderkey)""".replace("AS at FROM x", "AS place FROM x").replace("ORDER BY at)", "ORDER BY place)"))
def configurations_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Configurations in texts of all lines of an order: shared units, halves, studios where there is nothing else."""
    n = s(F.col("l_quantity").cast("long") % 5 + 1)
    said = F.when(F.col("l_returnflag") == "A", F.concat(s("l_linenumber"), F.lit(" & "), n, F.lit(" BHK flats"))).when(F.col("l_returnflag") == "N", F.concat(n, F.lit(".5bhk"))).otherwise("a Studio")
    rows = lines_of(spark, d, said)
    return rows.select("l_orderkey", F.array_join(scalar.bhk_list(F.array_join("parts", "; ")), ",").alias("units"))


@query(f"""WITH {LINES_SQL}, c AS (SELECT l_partkey, 'P518' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS code, min(struct_pack(a := l_linenumber, b := l_orderkey, c := l_suppkey, d := l_quantity)) AS f FROM l GROUP BY 1, 2)
SELECT l_partkey, string_agg(code, '|' ORDER BY f) AS codes, (SELECT count(*) FROM lineitem i WHERE i.l_partkey = c.l_partkey) AS n_entries FROM c GROUP BY 1""")
def registrations_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Registration numbers in a text of all lines of a part, and the entries of the same as a list."""
    code = F.concat(F.lit("p518"), F.lpad(s("l_suppkey"), 8, "0"))
    rows = t(spark, d, "lineitem").select("l_partkey", F.struct("l_linenumber", "l_orderkey", "l_suppkey", "l_quantity", code.alias("x")).alias("r"))
    texts = rows.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]).alias("parts"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: F.concat(p, F.lit("|2026-01-01|Phase 1"))), " , "), F.lit("]"))
    return texts.select("l_partkey", F.array_join(scalar.rera_list(F.array_join("parts", " and ")), "|").alias("codes"), F.size(F.filter(scalar.rera_entries(listed), lambda e: e["phase"] == "Phase 1")).cast("long").alias("n_entries"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey, unnest([p_name, split_part(p_name, ' ', 1), p_brand]) AS w FROM lineitem JOIN part ON p_partkey = l_partkey), k AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.l_orderkey = a.l_orderkey AND length(b.w) > length(a.w) AND contains(b.w, a.w)))
SELECT l_orderkey, (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) FROM x WHERE x.l_orderkey = o.l_orderkey) AS longest, (SELECT string_agg(w, '|' ORDER BY w) FROM k WHERE k.l_orderkey = o.l_orderkey) AS kept FROM (SELECT DISTINCT l_orderkey FROM lineitem) o""")
def terms_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Names, first words and brands of an order's parts: longest first, and without those inside a longer one."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    terms = rows.groupBy("l_orderkey").agg(F.array_distinct(F.flatten(F.collect_list(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand")))).alias("terms"))
    return terms.select("l_orderkey", F.array_join(scalar.longest_first("terms"), "|").alias("longest"), F.array_join(F.array_sort(scalar.drop_contained("terms")), "|").alias("kept"))
