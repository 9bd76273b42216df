"""More queries over the supplied tables: labels, names, merges, gates and events, each with its oracle.

Stand-ins as in ``queries``; texts are made of keys, alike in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import classify, scalar
from quern.operators import catalog, evidence, keyed, leads, secondary
from quern.operators.entity import splice
from quern.plans.queries import joined, query, t


def one_of(k: Column, values: list) -> Column:
    """The value at ``k`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_of(key: str, values: list) -> str:
    return f"{sql_list(values)}[{key} % {len(values)} + 1]"


# ---- labels and names

RAW_PHONES = ["+91 98-00 ", "call 12", "none ", "0091-(22) 4455-"]


@query(rf"""WITH q AS (SELECT c_custkey, {sql_of('c_custkey', RAW_PHONES)} || CASE WHEN c_custkey % 4 = 2 THEN '' ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS raw FROM customer)
SELECT c_custkey, CASE WHEN regexp_replace(raw, '\D', '', 'g') <> '' THEN right(regexp_replace(raw, '\D', '', 'g'), 10) END AS phone FROM q""")
def crm_phone_last10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.concat(one_of(k, RAW_PHONES), F.when(k % 4 == 2, "").otherwise(F.lpad(k.cast("string"), 7, "0")))
    return t(spark, d, "customer").select(k, scalar.phone_last10(raw).alias("phone"))


UNIT_TEXTS = ["2 & 3 BHK", "1bhk and 1 BHK, 4-BHK", "Studio flats", "plots", "2.5 / 3 / 4 bhk", "3 BHK villas, studio too"]
UNIT_LISTS = ["2 BHK,3 BHK", "1 BHK,4 BHK", "Studio", "", "2.5 BHK,3 BHK,4 BHK", "3 BHK"]
UNIT_MIXES = ["2 BHK,3 BHK,Studio", "1 BHK,4 BHK,Studio", "Studio", "Studio", "2.5 BHK,3 BHK,4 BHK,Studio", "3 BHK,Studio"]


@query(f"SELECT p_partkey, {sql_of('p_partkey', UNIT_LISTS)} AS units, {sql_of('p_partkey', UNIT_MIXES)} AS atomic FROM part")
def configuration_lists(spark: SparkSession, d: str) -> DataFrame:
    said = one_of(F.col("p_partkey"), UNIT_TEXTS)
    return t(spark, d, "part").select("p_partkey", joined(scalar.bhk_list(said)).alias("units"), joined(scalar.atomic_configs(F.array(said, F.lit("studio")))).alias("atomic"))


LONG_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


@query(f"""WITH q AS (SELECT o_orderkey AS k, 2020 + o_orderkey % 15 AS y, o_orderkey % 12 + 1 AS m FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 3 < 2 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') END AS month, CASE WHEN k % 3 < 2 THEN left({sql_list(LONG_MONTHS)}[m], 3) || ' ' || y END AS shown FROM q""")
def possession_months(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    year, month = (2020 + k % 15).cast("string"), k % 12 + 1
    said = F.when(k % 3 == 0, F.concat(F.lit("due "), year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-15"))).when(k % 3 == 1, F.concat(F.lit("handover in "), one_of(k, LONG_MONTHS), F.lit(" "), year)).otherwise("soon")
    return t(spark, d, "orders").select(k, scalar.possession_month(said).alias("month")).select(k, "month", scalar.possession_display("month").alias("shown"))


@query(r"""WITH q AS (SELECT p_partkey, '  ' || (p_size + 1) || '+   ' || p_name || ' Tower ABC  |  site.com photos' AS s FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '(?i)\s*[|\-–]\s*(?:[a-z0-9.]+\.(?:com|in|net)).*$', ''), '^\d+\+?\s+', '')) AS name FROM q)
SELECT p_partkey, name, regexp_replace(lower(regexp_replace(name || ' Price List', '(?i)\bprice(?:\s*sheet|\s*list)?\b', '', 'g')), '[^a-z0-9]', '', 'g') AS core,
  array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN regexp_full_match(w, '[A-Z]{2,5}') THEN w ELSE upper(w[1]) || lower(substr(w, 2)) END), ' ') AS title FROM c""")
def project_names(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("  "), (F.col("p_size") + 1).cast("string"), F.lit("+   "), "p_name", F.lit(" Tower ABC  |  site.com photos"))
    rows = t(spark, d, "part").select("p_partkey", scalar.project_name(said).alias("name"))
    return rows.select("p_partkey", "name", scalar.core_name_key(F.concat("name", F.lit(" Price List"))).alias("core"), scalar.title_case_keep_caps("name").alias("title"))


RERA_TEXTS = ["P51800012345, pr123456789 and P51800012345", "none", "[P51800000001|2025-01-01|Phase 1, P51800000002|2026]", "P5180001234567890"]
RERA_LISTS = ["P51800012345|PR123456789", "", "P51800000001|P51800000002", ""]
RERA_PARTS = ["P51800012345/-/-;pr123456789 and P51800012345/-/-", "none/-/-", "P51800000001/2025-01-01/Phase 1;P51800000002/2026/-", "P5180001234567890/-/-"]


@query(f"SELECT c_custkey, {sql_of('c_custkey', RERA_LISTS)} AS codes, {sql_of('c_custkey', RERA_PARTS)} AS entries FROM customer")
def registration_lists(spark: SparkSession, d: str) -> DataFrame:
    said = one_of(F.col("c_custkey"), RERA_TEXTS)
    entries = F.transform(scalar.rera_entries(said), lambda e: F.concat_ws("/", *(F.coalesce(e[n], F.lit("-")) for n in ("code", "date", "phase"))))
    return t(spark, d, "customer").select("c_custkey", joined(scalar.rera_list(said), "|").alias("codes"), joined(entries, ";").alias("entries"))


@query("""SELECT c_custkey, CASE WHEN k >= 5 THEN 'high' WHEN k >= 2 THEN 'medium' ELSE 'low' END AS quality, s AS state,
  CASE s WHEN 'verified' THEN 'High' WHEN 'mismatch' THEN 'Caution' WHEN 'not_found' THEN 'Low' ELSE 'Unverified' END AS trust
FROM (SELECT c_custkey, c_custkey % 8 AS k, CASE WHEN c_custkey % 5 = 0 THEN 'no_number' WHEN c_custkey % 5 = 1 THEN 'unavailable' WHEN c_custkey % 5 = 2 THEN 'verified' WHEN c_custkey % 5 = 3 THEN 'mismatch' ELSE 'not_found' END AS s FROM customer)""")
def quality_and_trust(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    state = classify.register_status((k % 5).isin(2, 3), k % 5 == 2, F.when(k % 5 != 0, "P51800012345"), k % 5 != 1)
    return t(spark, d, "customer").select(k, classify.quality_label(k % 8).alias("quality"), state.alias("state"), classify.trust_tier(state).alias("trust"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN CAST(floor(u * (1 - s / 100.0) + 0.5) AS BIGINT) END AS unsold, CASE WHEN p_partkey % 9 > 0 THEN CASE WHEN s >= 70 THEN 'Fast-moving' WHEN s >= 40 THEN 'Steady' ELSE 'Slow-moving' END END AS pace
FROM (SELECT p_partkey, p_partkey % 101 AS s, p_size * 10 AS u FROM part)""")
def sales_movement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pace = secondary.sales_pace(F.when(k % 9 > 0, k % 101), F.col("p_size") * 10)
    return t(spark, d, "part").select(k, pace.alias("p")).select(k, "p.unsold", "p.pace")


AREAS = [" Malad East", "borivali west.", "Powai", "North Goa", "Vashi NORTH "]
AREA_BASES = ["malad", "borivali", "powai", "north goa", "vashi"]


@query(f"SELECT s_suppkey, {sql_of('s_suppkey', AREA_BASES)} AS base, s_suppkey % 10 BETWEEN 2 AND 5 AND s_suppkey % 7 BETWEEN 1 AND 3 AS inside FROM supplier")
def localities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select(k, scalar.base_locality(one_of(k, AREAS)).alias("base"), scalar.in_box(k % 10, k % 7, 2, 1, 5, 3).alias("inside"))


@query("""SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'swimming pool|rooftop|pool|gym' ELSE 'sea view|deck|gym' END AS longest, CASE n_nationkey % 2 WHEN 0 THEN 'swimming pool|gym|rooftop' ELSE 'gym|sea view|deck' END AS kept FROM nation""")
def term_arrays(spark: SparkSession, d: str) -> DataFrame:
    terms = F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, ["pool", "swimming pool", "gym", "rooftop"]))).otherwise(F.array(*map(F.lit, ["gym", "sea view", "deck"])))
    return t(spark, d, "nation").select("n_nationkey", joined(scalar.longest_first(terms), "|").alias("longest"), joined(scalar.drop_contained(terms), "|").alias("kept"))


@query("""SELECT c_custkey, upper(substr(n, 1, 1)) || upper(substr(split_part(n, ' ', 2), 1, 1)) AS initials, CASE WHEN c_custkey % 3 = 0 THEN 'meta' ELSE 'housing' END AS class
FROM (SELECT c_custkey, replace(c_name, '#', ' ') || ' x' AS n FROM customer)""")
def crm_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" x"))
    return t(spark, d, "customer").select(k, secondary.initials(name).alias("initials"), secondary.crm_class(F.when(k % 3 == 0, one_of(k, ["-", "", None])).otherwise("Rivali")).alias("class"))


# ---- keyed rows


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def delete_lead_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = t(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return keyed.delete_cascade(gone, "o_custkey", t(spark, d, "orders"))[0].select("o_orderkey", "o_custkey")


@query("""WITH e AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(v, c_mktsegment) AS segment, v IS NOT NULL AND v <> c_mktsegment AS audited FROM customer LEFT JOIN e ON c_custkey = o_custkey""")
def field_edits(spark: SparkSession, d: str) -> DataFrame:
    edits = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("c_mktsegment").alias("field"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    after, audit = keyed.update_fields(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), edits.unionByName(edits.withColumn("field", F.lit("c_acctbal"))), "c_custkey", ["c_mktsegment"], "seq")
    return after.join(audit.select("c_custkey", F.lit(True).alias("a")), "c_custkey", "left").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.coalesce("a", F.lit(False)).alias("audited"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'updated' ELSE p_name END AS p_name, CASE WHEN p_size > 40 THEN -1 ELSE p_size END AS p_size FROM part")
def splice_by_id(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return splice(rows, rows.where("p_size > 40").select("p_partkey", F.lit("updated").alias("p_name"), F.lit(-1).alias("p_size")), "p_partkey")


@query("""WITH q AS (SELECT *, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '::' || regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS key, ['portal', 'web', 'official'][p_partkey % 3 + 1] AS source FROM part)
SELECT key, count(*) AS n, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, arg_min(p_type, p_partkey) AS name FROM q GROUP BY key""")
def merged_by_developer(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select(k.alias("seq"), F.when(k % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("developer"), F.col("p_type").alias("name"), one_of(k, ["portal", "web", "official"]).alias("source"))
    counts = rows.groupBy(F.concat_ws("::", scalar.alnum_key("developer"), scalar.alnum_key("name")).alias("key")).agg(F.count("*").alias("n"))
    return secondary.merged_by_developer(rows, "seq").join(counts, "key").select("key", "n", "sources", "name")


@query("""SELECT s_nationkey, string_agg(b || '=' || v, ',' ORDER BY b) AS buckets FROM (SELECT s_nationkey, ['parks', 'schools', 'transit'][s_suppkey % 3 + 1] AS b, min(s_name) AS v FROM supplier GROUP BY 1, 2) GROUP BY 1""")
def bucket_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "supplier").withColumn("b", one_of(F.col("s_suppkey"), ["parks", "schools", "transit"]))
    found = secondary.group_buckets(rows, "s_nationkey", "b", "s_name")
    return found.select("s_nationkey", joined(F.transform(F.map_entries("buckets"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("buckets"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ',A,B' WHEN n_nationkey % 3 = 1 THEN 'A,B,C' ELSE 'B,' || n_name || ',A' END AS names FROM nation")
def fallback_lists(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    first = F.when(k % 3 == 0, F.array(name)).when(k % 3 == 2, F.array(F.lit("B"), name))
    return t(spark, d, "nation").select(k, joined(secondary.primary_then_fallback(first, F.array(F.lit("A"), F.lit("B"), F.lit("C")), 3)).alias("names"))


@query("SELECT s_suppkey, n_nationkey AS code FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2")
def name_to_code(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.initcap("n_name").alias("asked"))
    codes = t(spark, d, "nation").where("n_regionkey <> 2").select(F.upper("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    return secondary.code_of(t(spark, d, "supplier").join(names, "s_nationkey"), codes, "asked").select("s_suppkey", "code")


# ---- evidence

KINDS = ["portal", "web", "official", "developer", "category_page_extract"]


@query(f"""WITH q AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, {sql_of('l_linenumber', KINDS)} AS kind FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY list_position(['official', 'developer', 'portal', 'web', 'category_page_extract'], kind), seq) AS pos FROM q) SELECT * FROM r WHERE pos <= 3""")
def pages_to_read(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), one_of(F.col("l_linenumber"), KINDS).alias("source_type"))
    return evidence.pages_to_read(rows, "l_partkey").select("l_partkey", "seq", F.col("source_type").alias("kind"), F.col("pos").cast("long").alias("pos"))


@query("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
SELECT p_partkey, p_brand, p_retailprice FROM q WHERE r = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 8""")
def curated_eight(spark: SparkSession, d: str) -> DataFrame:
    return evidence.curated(t(spark, d, "part"), rera="p_brand", score="p_retailprice", tie="p_partkey").select("p_partkey", "p_brand", "p_retailprice")


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS high, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evidence.metrics(t(spark, d, "events"), {"failed": F.col("event_type") == "error", "high": F.col("value") > 50}, "event_type")


@query("""SELECT 'name' AS "check", count(*) FILTER (p_name <> '') AS passed, count(*) FILTER (NOT p_name <> '') AS failed FROM part
UNION ALL SELECT 'price', count(*) FILTER (p_retailprice > 1000), count(*) FILTER (p_retailprice <= 1000) FROM part WHERE p_size <= 30""")
def quality_assertions(spark: SparkSession, d: str) -> DataFrame:
    return evidence.quality_checks(t(spark, d, "part"), {"name": F.col("p_name") != "", "price": F.when(F.col("p_size") <= 30, F.col("p_retailprice") > 1000)})


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE CAST(round_even(10 * least(1.0, round(CASE p_partkey % 3 WHEN 2 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0 END
  + CASE WHEN p_partkey % 5 = 0 THEN 0.25 ELSE 0 END + CASE WHEN p_size <= 7 THEN 0.25 WHEN p_size <= 30 THEN 0.1 ELSE 0 END, 9)), 0) AS INT) END AS points FROM part""")
def evidence_quality(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, d, "part").select(k, evidence.evidence_points(k % 3, F.when(k % 2 == 0, "P51800012345"), k % 5 == 0, F.col("p_size"), k % 10 == 0).alias("points"))


@query("SELECT p_partkey, p_name || ' carpet area Thane|' || p_name || ' rera Thane' || CASE WHEN p_size > 25 THEN '|' || p_name || ' price Thane' ELSE '' END AS queries FROM part")
def gap_query_templates(spark: SparkSession, d: str) -> DataFrame:
    missing = F.when(F.col("p_size") > 25, F.array(*map(F.lit, ["carpet_area", "rera", "price"]))).otherwise(F.array(F.lit("carpet_area"), F.lit("rera")))
    rows = t(spark, d, "part").select("p_partkey", "p_name", missing.alias("missing_fields"))
    return evidence.gap_queries(rows, "p_name", "Thane").select("p_partkey", joined("queries", "|").alias("queries"))


WORDS_A, WORDS_B = ["rivali", "park", "tower"], ["rivali", "greens"]


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS same FROM part""")
def name_correspondence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    asked = F.when(k == 0, F.array(F.lit("sunteck"), F.lit("city"))).when(k == 1, F.array(F.lit("rivali"), F.lit("park"))).when(k == 2, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ["rivali", "one", "two", "three"])))
    return t(spark, d, "part").select("p_partkey", leads.name_overlap(asked, F.array(*map(F.lit, WORDS_B))).alias("same"))


# ---- events

CHANNELS = ["voice", "whatsapp", "pigeon", None]


@query("""WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '12' ELSE '+91 98' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS phone, o_orderkey % 3 AS c FROM orders)
SELECT k, CASE WHEN k % 5 = 0 THEN 'invalid_phone' WHEN c = 1 THEN 'invalid_channel' WHEN c = 2 THEN 'invalid_checkpoint' ELSE 'valid' END AS reason,
  CASE WHEN k % 5 <> 0 AND c = 0 THEN CASE WHEN k % 2 = 0 THEN 'key-' || k ELSE right(phone, 10) || ':voice:call_attempted:' || CASE WHEN k % 7 = 0 THEN '1767225600000' ELSE '1764547200000' END END END AS key FROM q""")
def event_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "12").otherwise(F.concat(F.lit("+91 98"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))).alias("phone"))
    raw = rows.select(
        k, "phone", F.when(k % 3 == 1, one_of(k, ["pigeon", None])).otherwise("voice").alias("channel"), F.when(k % 3 == 2, "flown").otherwise("call_attempted").alias("checkpoint"),
        F.when(k % 2 == 0, F.concat(F.lit("key-"), k.cast("string"))).alias("idempotency_key"), F.when(k % 7 == 0, "someday").otherwise("2025-12-01T00:00:00Z").alias("occurred_at"),
    )
    good, bad = leads.validated_events(raw, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return good.select(k, F.lit("valid").alias("reason"), F.col("idempotency_key").alias("key")).unionByName(bad.select(k, "reason", F.lit(None).cast("string").alias("key")))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'QualifiedLead' WHEN 1 THEN 'DisqualifiedLead' ELSE 'Lead' END AS event_name, CAST(1767225600 AS BIGINT) AS event_time,
  sha256(lower(trim(c_name || '@X.com '))) AS email_sha256, sha256('98' || c_custkey) AS phone_sha256, c_custkey || '-' || CASE c_custkey % 3 WHEN 0 THEN 'QualifiedLead' WHEN 1 THEN 'DisqualifiedLead' ELSE 'Lead' END AS event_id FROM customer""")
def conversion_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select(k.alias("id"), F.concat("c_name", F.lit("@X.com ")).alias("email"), F.concat(F.lit("98"), k.cast("string")).alias("phone"), one_of(k, ["qualified", "disqualified", "unknown"]).alias("qualification"))
    return leads.conversion_rows(rows, F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query("""SELECT c_custkey AS id, '{"name":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"phone":"98' || c_custkey || '"' ELSE '' END || ',"user_type":"buyer","source":"' || CASE WHEN c_custkey % 3 = 0 THEN 'Housing.com' ELSE 'Website' END || '"}' AS row FROM customer""")
def crm_push_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("98"), k.cast("string"))).otherwise("").alias("phone"), *(F.lit("").alias(f) for f in ("email", "project", "budget", "configuration", "location", "notes")), F.when(k % 3 == 0, "housing").otherwise("website").alias("primary_source"))
    return leads.push_rows(rows, {"housing": "Housing.com"})


@query("""SELECT label, n, names FROM (SELECT label, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS names FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY p_retailprice DESC, p_partkey) AS r FROM (SELECT *, CASE WHEN p_size >= 40 THEN 'PRIMARY' WHEN p_size >= 30 THEN 'SECONDARY' WHEN p_size >= 20 THEN 'TERTIARY' ELSE 'LOW' END AS label FROM part)) GROUP BY label)""")
def tier_buckets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.by_bucket(t(spark, d, "part").withColumn("label", classify.tier(F.col("p_size") * 2, "LOW")), "label", "p_retailprice", "p_partkey", 3)


TITLES = ["12+ flats", "Rivali Park", "Lodha Group Mumbai", "Godrej Horizon", "Buy 2 BHK", "Tata", "Sunteck unveils tower", "The end."]


@query("SELECT p_partkey, p_partkey % 8 IN (0, 4, 6, 7) AS generic, p_partkey % 8 IN (2, 5) AS company FROM part")
def title_filters(spark: SparkSession, d: str) -> DataFrame:
    title = one_of(F.col("p_partkey"), TITLES)
    return t(spark, d, "part").select("p_partkey", secondary.generic_title(title).alias("generic"), secondary.corporate_name(title).alias("company"))


# ---- results of several sources


@query("""WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'http://x.com/' || l_partkey END AS url, l_returnflag AS source, 'Tower ' || l_suppkey AS name FROM lineitem)
SELECT seq, url, source, name FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url <> '' THEN url ELSE source || ':' || name END ORDER BY seq) AS r FROM q) WHERE r = 1""")
def cross_connector_dedup(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("l_partkey")
    rows = t(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(part % 3 == 0, "").otherwise(F.concat(F.lit("http://x.com/"), part.cast("string"))).alias("url"),
        F.col("l_returnflag").alias("source"), F.concat(F.lit("Tower "), F.col("l_suppkey").cast("string")).alias("name"),
    )
    return secondary.once_by_url(rows, "seq")


PLACE_KINDS = ["Railway/Metro Station", "Village", "Street", "Palace", "City"]


@query(f"""WITH q AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'Place ' || (c_custkey % 97) END AS name, {sql_of('c_custkey', PLACE_KINDS)} AS kind, 'Area ' || (c_nationkey % 5) AS area,
    18.0 + c_custkey % 20 / 10.0 AS lat, 72.5 + c_custkey % 7 / 10.0 AS lon FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(name || '|' || area) ORDER BY seq) AS r FROM q WHERE name <> '')
SELECT seq, name, area, CASE WHEN lat BETWEEN 18.2 AND 19.6 AND lon BETWEEN 72.6 AND 74.3 THEN 0 ELSE 10 END + CASE kind WHEN 'Railway/Metro Station' THEN 0 WHEN 'Village' THEN 5 WHEN 'Street' THEN 3 WHEN 'City' THEN 1 ELSE 6 END AS rank FROM f WHERE r = 1""")
def location_results(spark: SparkSession, d: str) -> DataFrame:
    from quern.operators import geo

    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select(
        k.alias("seq"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("Place "), (k % 97).cast("string"))).alias("name"), one_of(k, PLACE_KINDS).alias("type"),
        F.concat(F.lit("Area "), (F.col("c_nationkey") % 5).cast("string")).alias("area"), (18.0 + k % 20 / 10.0).alias("lat"), (72.5 + k % 7 / 10.0).alias("lon"),
    )
    return geo.location_results(rows, "seq").select("seq", "name", "area", "rank")


@query("""WITH p AS (SELECT o_orderkey AS k, nullif(o_custkey % 500, 7) AS id FROM orders WHERE o_orderstatus = 'O'), n AS (SELECT o_orderkey AS k, nullif(o_custkey % 900, 7) AS id FROM orders WHERE o_orderstatus <> 'O')
SELECT * FROM p UNION ALL SELECT * FROM n WHERE id IS NULL OR id NOT IN (SELECT id FROM p WHERE id IS NOT NULL)""")
def append_page(spark: SparkSession, d: str) -> DataFrame:
    def page(open_: bool, n: int) -> DataFrame:
        rows = t(spark, d, "orders").where((F.col("o_orderstatus") == "O") == open_)
        return rows.select(F.col("o_orderkey").alias("k"), F.nullif(F.col("o_custkey") % n, F.lit(7).cast("long")).alias("id"))

    return keyed.append_page(page(True, 500), page(False, 900), "id")


@query("""WITH g AS (SELECT p_brand AS candidate, arg_max(p_type, p_partkey) AS missing, max(p_partkey) AS seq FROM part WHERE p_size > 48 GROUP BY 1)
SELECT p_partkey, missing, seq FROM part JOIN g ON p_brand = candidate""")
def gap_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part")
    gaps = rows.where("p_size > 48").select(F.col("p_brand").alias("candidate"), F.col("p_type").alias("missing"), F.col("p_partkey").alias("seq"))
    return evidence.gap_candidates(rows, gaps, "p_brand", "candidate", "seq").select("p_partkey", "missing", "seq")
