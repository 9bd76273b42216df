"""Queries of facts from texts, gates and places, each with its oracle; stand-ins as in ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import classify, extract, names, nl, scalar
from quern.operators import catalog, evidence, gazetteer, secondary
from quern.plans.listings import one_of, sql_of
from quern.plans.queries import joined, query, t
from quern.sources import stores

# ---- facts

PAGE_SQL = """SELECT p_partkey, p_name || '. ' || CASE p_partkey % 3 WHEN 0 THEN (p_size / 4.0) || ' crore, ' WHEN 1 THEN p_size || ' lakh, ' ELSE '' END || 'Rs. ' || p_size || ',500 per sq ft. '
  || CASE WHEN p_partkey % 2 = 0 THEN 'G+' || p_size ELSE p_size || ' floors' END || ' in ' || (p_partkey % 9) || ' towers. Metro is ' || p_size || ' min away. It is near City Mall ' || (p_partkey % 5) || ', close to Lake Park.' AS s FROM part"""


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    price = F.when(k % 3 == 0, F.concat((F.col("p_size") / 4.0).cast("string"), F.lit(" crore, "))).when(k % 3 == 1, F.concat(n, F.lit(" lakh, "))).otherwise("")
    high = F.when(k % 2 == 0, F.concat(F.lit("G+"), n)).otherwise(F.concat(n, F.lit(" floors")))
    said = ["p_name", F.lit(". "), price, F.lit("Rs. "), n, F.lit(",500 per sq ft. "), high, F.lit(" in "), (k % 9).cast("string"), F.lit(" towers. Metro is "), n, F.lit(" min away. It is near City Mall "), (k % 5).cast("string"), F.lit(", close to Lake Park.")]
    return t(spark, d, "part").select(k, F.concat(*said).alias("s"))


@query(rf"""WITH q AS ({PAGE_SQL}), n AS (SELECT *, regexp_extract(s, '(?i)(\d+\.?\d*)\s*(?:cr|crore)\b', 1) AS cr, regexp_extract(s, '(?i)(\d+\.?\d*)\s*(?:l|lakh|lakhs)\b', 1) AS lakh FROM q)
SELECT p_partkey, CASE WHEN cr <> '' THEN CAST(cr AS DOUBLE) WHEN lakh <> '' THEN CAST(lakh AS DOUBLE) / 100 END AS crores, CASE WHEN cr <> '' THEN '₹' || cr || ' Cr' WHEN lakh <> '' THEN '₹' || lakh || 'L' END AS shown,
  CAST(replace(regexp_extract(s, 'Rs\. ([\d,]+) per', 1), ',', '') AS BIGINT) AS per_sqft, CASE WHEN s LIKE '%G+%' THEN regexp_extract(s, 'G\+\d+') ELSE regexp_extract(s, '(\d+) floors', 1) || ' floors' END AS floors,
  CAST(regexp_extract(s, '(\d+) towers', 1) AS INT) AS towers, regexp_extract(s, 'Metro is \d+ min') AS connectivity, regexp_extract(s, 'near (City Mall \d)', 1) || '|Lake Park.' AS landmarks FROM n""")
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = page_texts(spark, d).withColumn("price", extract.price_cr("s"))
    return rows.select("p_partkey", "price.crores", F.col("price.display").alias("shown"), extract.price_per_sqft("s").alias("per_sqft"), extract.floors("s").alias("floors"), extract.towers("s").alias("towers"), extract.connectivity("s").alias("connectivity"), joined(extract.landmarks("s"), "|").alias("landmarks"))


@query("""WITH q AS (SELECT o_orderkey, o_orderkey % 5 AS k, 2026 + o_orderkey % 4 AS y FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'Ready to Move' WHEN 1 THEN 'Dec ' || y WHEN 2 THEN '' || y END AS possession FROM q""")
def possession_in_context(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    year = (2026 + k % 4).cast("string")
    far = F.concat(F.lit("handover of keys and papers to all owners of the flats in both towers "), year)
    said = F.when(k % 5 == 0, "Immediate possession").when(k % 5 == 1, F.concat(F.lit("Possession: by December "), year)).when(k % 5 == 2, F.concat(F.lit("completion in "), year)).when(k % 5 == 3, far).otherwise(F.concat(F.lit("since "), year))
    return t(spark, d, "orders").select(k, extract.possession_in_context(said).alias("possession"))


DEVELOPER_TEXTS = ["Homes by Lodha Group, Thane", "sold by Dec 2027. Developer: Rustomjee", "Developer: Cloudflare Privacy", "by the sea", "Developer- Oberoi Realty"]
DEVELOPERS = ["Lodha Group", "Rustomjee", None, None, "Oberoi Realty"]


@query(f"SELECT c_custkey, {sql_of('c_custkey', DEVELOPERS)} AS developer FROM customer")
def developer_names(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", extract.developer(one_of(F.col("c_custkey"), DEVELOPER_TEXTS)).alias("developer"))


@query("""WITH q AS (SELECT p_partkey, p_partkey % 4 AS v, p_partkey % 3 AS a, p_partkey % 2 * 2 AS p, p_partkey % 5 = 0 AS long FROM part)
SELECT p_partkey, CASE WHEN v > greatest(a, p) AND v >= CASE WHEN long THEN 2 ELSE 1 END THEN 'Villa' WHEN a > greatest(v, p) AND a >= CASE WHEN long THEN 2 ELSE 1 END THEN 'Apartment' WHEN p > greatest(v, a) THEN 'Plot' END AS kind FROM q""")
def property_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    said = F.concat(F.repeat(F.lit("Villas "), (k % 4).cast("int")), F.repeat(F.lit("flat "), (k % 3).cast("int")), F.repeat(F.lit("plots "), (k % 2 * 2).cast("int")), F.when(k % 5 == 0, "by the sea " * 40).otherwise(""))
    return t(spark, d, "part").select(k, extract.property_type(said).alias("kind"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS label, CASE WHEN c_custkey % 3 = 1 THEN '{"id": ' || c_custkey || '}' END AS json, 'Rivali Park ' || (c_custkey % 7) || 'b' AS slug FROM customer""")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lines = F.concat(F.when(k % 3 == 0, " Developer \n").otherwise("Builder\n"), "c_name", F.lit("\nend"))
    json = F.concat(F.lit("Here: ```json\n{\"id\": "), k.cast("string"), F.when(k % 3 == 1, "}\n```").when(k % 3 == 2, ",}").otherwise(""))
    url = F.concat(F.lit("https://x.com/new/rivali-park-"), (k % 7).cast("string"), F.lit("b-mumbai-west/?page=2"))
    return t(spark, d, "customer").select(k, extract.label_value(lines, "developer").alias("label"), extract.repaired_json(json).alias("json"), extract.slug_name(url, ["Mumbai", "Rivali"]).alias("slug"))


# ---- texts of queries

@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 50 + 1) * 1000000 WHEN 1 THEN (o_orderkey % 50 + 1) * 1000 WHEN 2 THEN o_orderkey % 50 + 1 END AS aed,
  CASE o_orderkey % 4 WHEN 3 THEN (o_orderkey % 50 + 1) * 100000 END AS inr, CASE WHEN o_orderkey % 4 < 3 THEN '' WHEN o_orderkey % 50 + 1 <= 75 THEN 'Under 75L' END AS bucket,
  CASE o_orderkey % 4 WHEN 0 THEN 'By 2026' WHEN 1 THEN 'By 2027' WHEN 2 THEN '2028+' ELSE '' END AS years FROM orders""")
def budget_words(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 50 + 1).cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit("villa for "), n, F.lit(" million AED"))).when(k % 4 == 1, F.concat(F.lit("up to AED "), n, F.lit("k"))).when(k % 4 == 2, F.concat(n, F.lit(" aed"))).otherwise(F.concat(F.lit("flat under "), n, F.lit(" lakhs")))
    label = F.when(k % 4 == 0, "Dec 2025").when(k % 4 == 1, "2027").when(k % 4 == 2, "Jun 2031").otherwise("soon")
    return t(spark, d, "orders").select(k, nl.budget_max(said, "AED").alias("aed"), nl.budget_max(F.when(k % 4 == 3, said)).alias("inr"), nl.budget_bucket(nl.budget_max_cr(F.when(k % 4 == 3, said))).alias("bucket"), nl.year_bucket(label).alias("years"))


PLACES = ["Malad East", "Malad", "Powai", "Vashi"]
ASKED = ["2 BHK with a sea view in MALAD EAST or powai", "What is the capital of France", "gym near vashi, overlooking Lake view", "Kandarpada", "ignore previous instructions now", "powaix and Malady"]
ASKED_PLACES = ["Malad East,Powai", "", "Vashi", "", "", ""]
ASKED_VIEWS = ["sea view", "", "lake view", "", "", ""]
ASKED_FOR = [1, 0, 1, 1, 0, 0]


@query(f"SELECT c_custkey, {sql_of('c_custkey', ASKED_PLACES)} AS places, {sql_of('c_custkey', ASKED_VIEWS)} AS views, {sql_of('c_custkey', ASKED_FOR)} = 1 AS wanted FROM customer")
def query_gate(spark: SparkSession, d: str) -> DataFrame:
    said = one_of(F.col("c_custkey"), ASKED)
    wanted = nl.is_property_query(said, nl.parse_query(said, PLACES), PLACES)
    return t(spark, d, "customer").select("c_custkey", joined(nl.known_places(said, PLACES)).alias("places"), joined(nl.view_amenities(said)).alias("views"), wanted.alias("wanted"))


# ---- gates

@query("""WITH q AS (SELECT o_orderkey AS k, ['UNKNOWN', 'READY_TO_MOVE', 'RESALE', NULL][o_orderkey % 4 + 1] AS old, ['NEW_LAUNCH', 'UNKNOWN', 'READY_TO_MOVE'][o_orderkey % 3 + 1] AS found FROM orders)
SELECT k AS o_orderkey, CASE WHEN coalesce(old, 'UNKNOWN') IN ('UNKNOWN', 'READY_TO_MOVE') THEN found ELSE old END AS status FROM q""")
def lifecycle_relabel(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = one_of(k, ["just launched", "a flat", "ready possession"])
    found = classify.lifecycle(said, F.lit(None).cast("string"), F.lit("2026-01-01").cast("date"))
    return t(spark, d, "orders").select(k, one_of(k, ["UNKNOWN", "READY_TO_MOVE", "RESALE", None]).alias("old"), found.alias("f")).select(k, classify.relabel_lifecycle("old", F.col("f")).alias("status"))


@query("""WITH q AS (SELECT p_partkey, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN rpad(p_name, 40, 'x') || ' now: add to cart, free shipping today' WHEN 1 THEN 'US$ 5 ' || rpad(p_name, 40, 'x') END AS s,
  CASE p_partkey % 4 WHEN 0 THEN 'add to cart' ELSE 'US$ 5' END AS hit FROM part)
SELECT p_partkey, trim(substr(s, greatest(strpos(s, hit) - 25, 1), strpos(s, hit) - greatest(strpos(s, hit) - 25, 1) + length(hit) + 25)) AS commerce, k IN (2, 3) AS bad_name FROM q""")
def unrelated_pages(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.rpad("p_name", 40, "x")
    said = F.when(k % 4 == 0, F.concat(name, F.lit(" now: add to cart, free shipping today"))).when(k % 4 == 1, F.concat(F.lit("US$ 5 "), name)).otherwise("in-stock houses")
    title = F.when(k % 4 == 2, "News update").when(k % 4 == 3, F.concat(name, F.lit(" view detail"))).otherwise("Newsworthy Towers")
    return t(spark, d, "part").select(k, classify.unrelated_commerce(said).alias("commerce"), classify.invalid_name(title).alias("bad_name"))


GATE_NAMES = ["Rivali Park", "", "ab", "12345", "Why: the best", "Malad East, Powai", "Station Road", "Swimming Pool", "Rivali Park | 2 BHK flats"]
GATE_REASONS = [None, "empty", "too short", "no words", "headline", "place name", "road or station", "amenity", None]


@query(f"SELECT p_partkey, {sql_of('p_partkey', GATE_REASONS)} AS reason, CASE WHEN p_partkey % 9 IN (0, 8) THEN 'Rivali Park' END AS name FROM part")
def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    said = one_of(F.col("p_partkey"), GATE_NAMES)
    return t(spark, d, "part").select("p_partkey", names.candidate_reason(said, PLACES).alias("reason"), names.candidate_name(said, PLACES).alias("name"))


def _listed_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TITLE_CITIES = ["navi mumbai", "thane", "china", "japan"]
#: Titles of all pages, and names of parts and of customers' nations with what portals add to them.
TITLES_SQL = """q AS (SELECT 'page' || page_id AS id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS s FROM pages
  UNION ALL SELECT 'part' || p_partkey, ['', 'New ', 'The ', 'Buy ', '12 '][p_size % 5 + 1] || p_name || [' Park', ' - Price & Review | Site', ': floor plan of it', ' - Avenue 2', ', Thane', ' – x.com', ' road', ' of', ' on Facebook', ' sq ft', ' - portal.com'][p_partkey % 11 + 1] FROM part
  UNION ALL SELECT 'customer' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'gym and ' ELSE '' END || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' - ' ELSE ' ' END || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def titles(spark: SparkSession, d: str) -> DataFrame:
    def pick(k: F.Column, values: list[str]) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))

    a = t(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("id"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("s"))
    ends = [" Park", " - Price & Review | Site", ": floor plan of it", " - Avenue 2", ", Thane", " – x.com", " road", " of", " on Facebook", " sq ft", " - portal.com"]
    b = t(spark, d, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")), F.concat(pick(F.col("p_size"), ["", "New ", "The ", "Buy ", "12 "]), "p_name", pick(F.col("p_partkey"), ends)))
    k = F.col("c_custkey")
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.concat(F.lit("customer"), k.cast("string")), F.concat(F.when(k % 3 == 0, "gym and ").otherwise(""), F.lower("c_mktsegment"), F.when(k % 2 == 0, " - ").otherwise(" "), "n_name"))
    return a.union(b).union(c)


@query(rf"""WITH RECURSIVE {TITLES_SQL},
h AS (SELECT id, trim(coalesce(s, '')) AS n, trim(regexp_replace(trim(coalesce(s, '')), '(?s)\s*[|—–].*$', '')) AS f FROM q),
p AS (SELECT id, trim(regexp_replace(CASE WHEN f = '' THEN n ELSE f END, '\s+[-–—]\s+[A-Za-z0-9][\w-]*\.[A-Za-z]{{2,5}}\s*$', '')) AS h FROM h),
c AS (SELECT id, h, trim(regexp_extract(h, '(?s)^(.*?)(?::|\s-\s|\s–\s)(.*)$', 1)) AS a, lower(regexp_extract(h, '(?s)^(.*?)(?::|\s-\s|\s–\s)(.*)$', 2)) AS b FROM p),
cut AS (SELECT id, 0 AS k, CASE WHEN length(a) >= 4 AND len(list_filter({_listed_sql(names.TAIL)}, lambda m: contains(b, m))) > 0 THEN a ELSE h END AS h FROM c
  UNION ALL SELECT id, k + 1, CASE WHEN ends_with(lower(h), ', ' || x) AND length(h) > length(x) + 5 THEN rtrim(rtrim(h[:length(h) - length(x) - 2]), ',-–—') WHEN ends_with(lower(h), ' - ' || x) AND length(h) > length(x) + 6 THEN rtrim(rtrim(h[:length(h) - length(x) - 3]), ',-–—')
    WHEN ends_with(lower(h), ' ' || x) AND length(h) > length(x) + 4 THEN rtrim(rtrim(h[:length(h) - length(x) - 1]), ',-–—') ELSE h END FROM (SELECT *, {_listed_sql(TITLE_CITIES)}[k + 1] AS x FROM cut WHERE k < {len(TITLE_CITIES)})),
n AS (SELECT id, trim(trim(trim(h), ',-–—')) AS n FROM cut WHERE k = {len(TITLE_CITIES)}),
w AS (SELECT id, n, lower(n) AS low, regexp_extract_all(lower(n), '[a-z]+') AS w FROM n),
r AS (SELECT id, n, CASE WHEN n = '' THEN 'empty' WHEN length(n) < 3 THEN 'too short' WHEN length(n) > 90 THEN 'too long' WHEN len(w) = 0 THEN 'no words' WHEN len(w) > 10 THEN 'too many words' WHEN contains(n, ':') THEN 'headline'
  WHEN len(list_filter({_listed_sql(names.FURNITURE)}, lambda m: contains(low, m))) > 0 THEN 'page furniture' WHEN len(list_filter({_listed_sql(names.SOCIAL)}, lambda m: contains(low, m))) > 0 THEN 'social platform'
  WHEN len(list_filter({_listed_sql([*names.LISTING, "portal.com"])}, lambda m: contains(low, m))) > 0 THEN 'listing title' WHEN list_contains({_listed_sql(names.ROADS)}, w[-1]) THEN 'road or station'
  WHEN w[-1] IN ('the', 'a', 'an', 'of', 'in', 'at', 'and') THEN 'fragment' WHEN len(list_filter(w, lambda x: NOT list_contains({_listed_sql([*names.AMENITY_WORDS, *names.SMALL_WORDS, *classify.FILLER])}, x))) = 0 THEN 'amenity' END AS reason FROM w)
SELECT id, reason, CASE WHEN reason IS NULL THEN n END AS name FROM r""")
def candidate_names_of_titles(spark: SparkSession, d: str) -> DataFrame:
    said = F.col("s")
    return titles(spark, d).select("id", names.candidate_reason(said, [], TITLE_CITIES, ["portal.com"]).alias("reason"), said).select("id", "reason", F.when(F.col("reason").isNull(), names.title_head(said, TITLE_CITIES)).alias("name"))


GATE_PLACES = ["Malad East", "malad", "Powai", "MALAD West", "Vashi"]


@query(f"""WITH q AS (SELECT p_partkey, lower({sql_of('p_partkey', GATE_PLACES)}) AS l FROM part)
SELECT p_partkey, l LIKE '%malad%' AS inside, l LIKE '%malad east%' AS narrow, CASE WHEN l LIKE '%malad east%' THEN 30 WHEN l LIKE '%malad%' THEN 18 ELSE 0 END AS points, CASE WHEN l LIKE '%powai%' THEN 10 ELSE 0 END AS other FROM q""")
def place_gate(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), one_of(F.col("p_partkey"), GATE_PLACES).alias("location"), none.alias("city"), none.alias("description"))
    micro = [{"query_term": "Malad East", "canonical": "Malad East", "parent": "Malad", "is_micro_alias": True}]
    other = [{"query_term": "Powai East", "canonical": "Powai East"}]
    return rows.select(
        "p_partkey", evidence.in_area(["Malad East", "MALAD"], []).alias("inside"), evidence.in_area(["Malad East", "MALAD"], ["malad east"]).alias("narrow"),
        evidence.place_points(F.lower("location"), micro).alias("points"), evidence.place_points(F.lower("location"), other).alias("other"),
    )


@query("""SELECT c_custkey, CASE k WHEN 0 THEN 'P51800012345' WHEN 1 THEN 'AB/12-34' WHEN 2 THEN 'PR123456789' WHEN 3 THEN 'P51800054321' END AS rera,
  CASE k WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 95 ELSE 60 END WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 90 ELSE 50 END WHEN 2 THEN 100 WHEN 3 THEN 60 END AS confidence FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)""")
def registration_choice(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    found = secondary.rera_choice(one_of(k, [" p51800012345", "AB/12-34", "none", None, None]), k % 2 == 0, one_of(k, ["PR123456789", "PR123456789", "pr123456789", None, "?"]), one_of(k, [None, None, None, "P51800054321", "x"]), F.lit(False))
    return t(spark, d, "customer").select(k, found.alias("r")).select(k, "r.rera", "r.confidence")


# ---- places and look-ups

@query("""SELECT * FROM (SELECT a.n_name AS src, b.n_name AS dst, CAST(b.n_nationkey AS BIGINT) AS pos, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) AS r
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_name = 'NATION_3') WHERE r <= 3""")
def neighbour_suggestions(spark: SparkSession, d: str) -> DataFrame:
    a, b = (t(spark, d, "nation").select(F.col("n_nationkey").alias(f"{x}_key"), F.col("n_name").alias(x), "n_regionkey") for x in ("src", "dst"))
    edges = a.join(b, "n_regionkey").where("src_key <> dst_key").select("src", "dst", F.col("dst_key").cast("bigint").alias("pos"))
    return catalog.neighbours(edges, "Nation_3", 3).withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("pos")).cast("long"))


@query("""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ' ' || lower(n_name) WHEN s_suppkey % 3 = 1 THEN n_name || ' towers' ELSE '' END AS asked FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, coalesce(min(n_name) FILTER (lower(trim(asked)) = lower(n_name)), min(n_name)) AS found, bool_or(lower(trim(asked)) = lower(n_name)) AS exact
FROM n JOIN nation ON trim(asked) <> '' AND (contains(lower(n_name), lower(trim(asked))) OR contains(lower(trim(asked)), lower(n_name))) GROUP BY 1""")
def names_looked_up(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    asked = F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower("n_name"))).when(k % 3 == 1, F.concat("n_name", F.lit(" towers"))).otherwise("")
    return secondary.by_name(t(spark, d, "supplier").join(nation, "s_nationkey").select(k, asked.alias("n_name")), nation, "s_suppkey", "n_name")


@query("""SELECT s_suppkey, r_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def cities_of_places(spark: SparkSession, d: str) -> DataFrame:
    named = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    rows = t(spark, d, "supplier").join(named, "s_nationkey")
    place = F.concat(one_of(F.col("s_suppkey"), ["Plot 4, ", "Nowhere, "]), F.lower("n_name"), F.lit(", NATION_0"))
    return gazetteer.city_of(place, named.select(F.col("n_name").alias("name"), F.col("r_name").alias("city")), rows, "s_suppkey")


@query("""SELECT p_partkey, contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') AS wanted FROM part""")
def amenity_matches(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", scalar.contains_any(F.lower("p_name"), F.array(F.lit("RED"), F.lit("blue"))).alias("wanted"))


# ---- caches, snapshots and sources


@query("""WITH n AS (SELECT max(o_orderkey) AS k FROM orders)
SELECT CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS part FROM lineitem JOIN n ON l_orderkey = k""")
def snapshot_newest(spark: SparkSession, d: str) -> DataFrame:
    """Orders as snapshots of their lines: the lines of the newest."""
    items = F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").cast("long").alias("part")))
    snapshots = t(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    newest = t(spark, d, "orders").agg(F.max("o_orderkey").alias("l_orderkey"))
    return stores.latest_snapshot(newest.join(snapshots, "l_orderkey"), "l_orderkey", "items")


@query("""WITH s AS (SELECT p_brand AS id, count(*) AS n, count(*) FILTER (p_size > 25) AS n_rera FROM part GROUP BY 1) SELECT * FROM s ORDER BY n DESC, n_rera DESC, id DESC LIMIT 1""")
def snapshot_best(spark: SparkSession, d: str) -> DataFrame:
    stats = t(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("n_rera"))
    return stores.best_snapshot(stats)


@query("""SELECT o_orderkey, o_orderdate < DATE '1995-05-31' AS stale FROM orders""")
def cache_staleness(spark: SparkSession, d: str) -> DataFrame:
    return stores.fresh(t(spark, d, "orders").select("o_orderkey", F.to_timestamp(F.col("o_orderdate").cast("date")).alias("at")), "at", F.lit("1995-06-01").cast("timestamp"), 24).select("o_orderkey", "stale")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'c' END AS place, CASE WHEN c_custkey % 2 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS source_rank FROM customer""")
def geocode_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").select("c_custkey")
    parts = [rows.where("c_custkey % 2 = 0").withColumn("place", F.lit("a")), rows.where("c_custkey % 3 = 0").withColumn("place", F.lit("b")), rows.withColumn("place", F.lit("c"))]
    return stores.first_source(parts, "c_custkey")


@query("""SELECT s_suppkey, CASE WHEN n_regionkey <> 1 THEN n_name END AS registered_name, n_regionkey <> 1 AS registered FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def register_lookup(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("p5180000000"), F.col("s_nationkey").cast("string"))
    register = t(spark, d, "nation").where("n_regionkey <> 1").select(F.concat(F.lit("P5180000000"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), F.lit("x").alias("promoter"))
    return stores.register_check(t(spark, d, "supplier").select("s_suppkey", code.alias("rera")), register).select("s_suppkey", "registered_name", "registered")


@query("""WITH r AS (SELECT o_custkey, max(o_orderpriority) AS tip FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN coalesce(tip, 'TBD') ELSE c_mktsegment END AS status FROM customer LEFT JOIN r ON c_custkey = o_custkey""")
def intel_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    intel = t(spark, d, "customer").select(k, F.when(k % 3 == 0, "TBD").otherwise(F.col("c_mktsegment")).alias("status"))
    research = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("status"))
    return secondary.merged_intel(intel, research, "c_custkey", ["status"], {"status": "TBD"})


@query("""SELECT l_orderkey, 'P518' || lpad(CAST(arg_min(l_partkey, (l_linenumber, l_partkey)) AS VARCHAR), 8, '0') AS rera FROM lineitem WHERE l_linenumber <= 3 AND l_partkey % 2 = 0 GROUP BY 1""")
def registration_first_hit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    said = F.when(k % 2 == 0, F.concat(F.lit("registered as P518"), F.lpad(k.cast("string"), 8, "0"), F.lit("."))).otherwise("no number")
    return secondary.first_hit(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", said.alias("text")), "l_orderkey", "text", "l_linenumber")


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)
SELECT p_partkey, peer, pos FROM (SELECT a.p_partkey, b.p_partkey AS peer, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.r) AS pos FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) WHERE pos <= 5""")
def peers_of_source(spark: SparkSession, d: str) -> DataFrame:
    return secondary.other_rows(t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("source")), "p_partkey").withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT p_partkey AS id, 'https://www.portal.com/' || p_partkey AS listing_url FROM part WHERE p_size > 10 AND p_partkey % 4 = 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 10 = 0) ORDER BY 1 LIMIT 6""")
def enrichment_queue(spark: SparkSession, d: str) -> DataFrame:
    def url(k: str) -> F.Column:
        return F.concat(F.when(F.col(k) % 2 == 1, "https://www.portal.com/").otherwise("https://x.org/"), F.col(k).cast("string"))

    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when((F.col("p_size") <= 10) | (F.col("p_partkey") % 4 == 3), "P51800012345").alias("rera"), url("p_partkey").alias("listing_url"))
    tried = t(spark, d, "lineitem").where("l_linenumber = 1 AND l_orderkey % 10 = 0").select(url("l_partkey").alias("listing_url"))
    return secondary.enrichment_batch(rows, tried, ["portal.com"]).select("id", "listing_url")


@query("""SELECT count(*) AS total, count(*) FILTER (c_custkey % 3 > 0) AS housing_total, count(*) FILTER (c_custkey % 3 = 0) AS meta_total FROM customer""")
def crm_totals(spark: SparkSession, d: str) -> DataFrame:
    return secondary.crm_summary(t(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise("-").alias("project_name")))
