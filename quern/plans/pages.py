"""Queries of page facts: listings of parts behind the texts of documents, facts by the places of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import json_walk, page_facts
from quern.plans.queries import query, t

#: A page: a document's text and the listing of the part of its number, whose words stand at distances that differ by part.
LISTED = """SELECT doc_id AS k, p_name AS name, coalesce(text, '') || chr(10) || coalesce(
  p_name || repeat(' on', p_size % 5) || ' is P51800' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '. Rest is p51700' || lpad(CAST(p_size AS VARCHAR), 6, '0') || ' at 9.' || p_size || ' cr. '
  || (p_size % 4 + 1) || ' BHK' || repeat(' -', p_partkey % 60) || ' ' || (p_size * 10 + 300) || ' sq ft' || repeat(' .', p_size % 9) || CASE p_partkey % 3 WHEN 0 THEN ' carpet' WHEN 1 THEN ' super built' ELSE '' END || ' - Rs. ' || p_size || '.5 L. '
  || CASE p_partkey % 4 WHEN 0 THEN '' ELSE (p_partkey % 5) || ' bhk; ' END || (p_size * 20 + 400) || ' sq.ft. built-up ₹' || (p_partkey % 7 + 1) || ' crore. '
  || 'Each apartment has' || repeat(' a', p_partkey % 40) || ' deck' || repeat(' a', p_size % 45) || ' in the ' || CASE p_partkey % 3 WHEN 0 THEN 'tower' WHEN 1 THEN 'building' ELSE 'podium' END || '. '
  || repeat('x', p_partkey % 150) || ' Private decks and ' || CASE p_partkey % 2 WHEN 0 THEN 'own parking' ELSE 'a balcony on floor 3' END || repeat(' so', p_size % 30) || ' for ' || p_name || '. It has ' || (p_size % 9 + 1)
  || ' towers, a gym and a swimming pool at Rs. ' || p_size || ',500 per sq ft.', '') AS s FROM documents LEFT JOIN part ON p_partkey = doc_id"""


def listed(spark: SparkSession, d: str) -> DataFrame:
    k, n, text = F.col("p_partkey"), F.col("p_size"), F.lit

    def times(x: str, c: F.Column) -> F.Column:
        return F.repeat(text(x), c.cast("int"))

    def digits(c: F.Column) -> F.Column:
        return F.lpad(c.cast("string"), 6, "0")

    parts = [
        F.col("p_name"), times(" on", n % 5), text(" is P51800"), digits(k), text(". Rest is p51700"), digits(n), text(" at 9."), n.cast("string"), text(" cr. "),
        (n % 4 + 1).cast("string"), text(" BHK"), times(" -", k % 60), text(" "), (n * 10 + 300).cast("string"), text(" sq ft"), times(" .", n % 9), F.when(k % 3 == 0, " carpet").when(k % 3 == 1, " super built").otherwise(""), text(" - Rs. "), n.cast("string"), text(".5 L. "),
        F.when(k % 4 == 0, "").otherwise(F.concat((k % 5).cast("string"), text(" bhk; "))), (n * 20 + 400).cast("string"), text(" sq.ft. built-up ₹"), (k % 7 + 1).cast("string"), text(" crore. "),
        text("Each apartment has"), times(" a", k % 40), text(" deck"), times(" a", n % 45), text(" in the "), F.when(k % 3 == 0, "tower").when(k % 3 == 1, "building").otherwise("podium"), text(". "),
        times("x", k % 150), text(" Private decks and "), F.when(k % 2 == 0, "own parking").otherwise("a balcony on floor 3"), times(" so", n % 30), text(" for "), F.col("p_name"), text(". It has "), (n % 9 + 1).cast("string"),
        text(" towers, a gym and a swimming pool at Rs. "), n.cast("string"), text(",500 per sq ft."),
    ]
    rows = t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "part"), F.col("p_partkey") == F.col("doc_id"), "left")
    return rows.select(F.col("doc_id").alias("k"), F.col("p_name").alias("name"), F.concat(F.coalesce("text", text("")), text("\n"), F.coalesce(F.concat(*parts), text(""))).alias("s"))


def places_sql(name: str, pattern: str, of: str = "q") -> str:
    """A table of all matches of a pattern in ``q``: page, number, start, end (from 0), the match, its groups."""
    return f"""{name} AS MATERIALIZED (SELECT k, i, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b, m, g FROM (
  SELECT k, i, m, g, sum(length(gap)) OVER (PARTITION BY k ORDER BY i) + sum(length(m)) OVER (PARTITION BY k ORDER BY i) - length(m) AS a FROM (
    SELECT k, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(gs) AS g
    FROM (SELECT k, regexp_extract_all(s, '{pattern}') AS ms, string_split_regex(s, '{pattern}') AS gaps, regexp_extract_all(s, '{pattern}', 1) AS gs FROM {of} WHERE regexp_matches(s, '{pattern}')))))"""


UNIT_SQL = r"(?i)(\bprivate\b|\bpersonal\b|\bown\b|\battached\b|\bin-unit\b|\bin\s+unit\b|\beach\s+(?:unit|apartment|home|residence|flat)\b|\bevery\s+(?:unit|apartment|home|residence|flat)\b|\bwithin\s+(?:the\s+)?(?:unit|apartment|flat|residence)\b|\d\s*bhk)"
BUILDING_SQL = r"(?i)(\blevel\s*\d+\b|\bfloor\s*\d+\b|\d+\s*(?:st|nd|rd|th)\s*(?:level|floor)\b|\beco\s*deck\b|\brooftop\b|\bpodium\b|\bclubhouse\b|\bcommon\s+area\b|\bshared\b|\btower\b|\bbuilding\b|\bproject\b|\bdevelopment\b|\bcomplex\b|\bamenit)"


AMENITIES_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in page_facts.AMENITIES) + "]"


def nearest_sql(places: str) -> str:
    """Of each page the match nearest to a place of the page's name."""
    return f"(SELECT k, a, m, g FROM (SELECT p.*, row_number() OVER (PARTITION BY p.k ORDER BY coalesce((SELECT min(abs(p.a - n.a)) FROM named n WHERE n.k = p.k), 0), p.a) AS r FROM {places} p) WHERE r = 1)"


def owner_sql(places: str) -> str:
    """The configuration that owns each match."""
    return f"""(SELECT p.k, p.a, p.b, p.m, p.g, coalesce((SELECT arg_max(l.g, l.b) FROM bhk l WHERE l.k = p.k AND l.b <= p.a AND l.a >= p.a - 100), (SELECT arg_min(l.g, l.a) FROM bhk l WHERE l.k = p.k AND l.a >= p.a AND l.b <= p.a + 100)) || ' BHK' AS own FROM {places} p)"""


def first_in(places: str, what: str) -> str:
    return f"(SELECT arg_min(struct_pack(a := x.a, m := lower(x.m)), x.a){what} FROM {places} x WHERE x.k = f.k AND x.a >= f.a - 60 AND x.b <= f.b + 60)"


def around_sql(reach: int) -> str:
    return f"trim(substr(s, CAST(greatest(o.a - {reach}, 0) + 1 AS BIGINT), CAST(o.b + {reach} - greatest(o.a - {reach}, 0) AS BIGINT)), chr(10) || ' ')"


FACTS_SQL = rf"""WITH q AS MATERIALIZED ({LISTED}),
{places_sql('bhk', r'(?i)(\d)\s*bhk')},
{places_sql('rera', r'(?i)\b(P[A-Z]{0,2}\d{9,13})\b')},
{places_sql('cr', r'(?i)(\d+\.?\d*)\s*(?:cr|crore)\b')},
{places_sql('lakh', r'(?i)(\d+\.?\d*)\s*(?:l|lakh|lakhs)\b')},
{places_sql('area', r'(?i)(\d{3,5})\s*sq\.?\s*\.?\s*ft\.?')},
{places_sql('price', r'(?i)(?:₹|rs\.?)\s*(\d+\.?\d*)\s*(?:cr|crore|l|lakh|lakhs)\b')},
{places_sql('deck', r'(?i)(\b(?:private\s+)?decks?\b)')},
{places_sql('balcony', r'(?i)(\bbalcon(?:y|ies)\b)')},
{places_sql('parking', r'(?i)(\bparking\b)')},
{places_sql('unit', UNIT_SQL)},
{places_sql('building', BUILDING_SQL)},
named AS MATERIALIZED (SELECT k, a FROM (SELECT k, unnest(range(length(s))) AS a, lower(s) AS s, lower(name) AS name FROM q WHERE name <> '') WHERE substr(s, a + 1, 1) = substr(name, 1, 1) AND substr(s, a + 1, length(name)) = name),
near AS (SELECT p.k, p.a, p.g, row_number() OVER (PARTITION BY p.k ORDER BY p.a) AS r, regexp_matches(lower(w), 'carpet') AS c, regexp_matches(lower(w), 'built[\s-]?up|super\s*built') AS b
  FROM (SELECT p.*, substr(s, CAST(greatest(a - 20, 0) + 1 AS BIGINT), CAST(b + 20 - greatest(a - 20, 0) AS BIGINT)) AS w, substr(s, CAST(a AS BIGINT), 1) AS last FROM area p JOIN q USING (k)) p WHERE a = 0 OR NOT regexp_matches(last, '[\d,.]')),
kinds AS (
  SELECT k, 'carpet_area' AS field, arg_min(struct_pack(a := a, g := g), r) AS v FROM (SELECT *, max(r = 1 AND b AND NOT c) OVER (PARTITION BY k) AS off FROM near) WHERE r = 1 AND NOT off OR off AND r = 2 GROUP BY k
  UNION ALL SELECT k, 'built_up_area', arg_min(struct_pack(a := a, g := g), r) FROM near WHERE r = 1 AND b AND NOT c OR r > 1 AND b GROUP BY k
), built AS (  -- what is built-up has not been taken for carpet
  SELECT * FROM kinds WHERE field = 'carpet_area' OR NOT EXISTS (SELECT 1 FROM near n WHERE n.k = kinds.k AND n.r = 2 AND n.a = kinds.v.a AND EXISTS (SELECT 1 FROM near m WHERE m.k = n.k AND m.r = 1 AND m.b AND NOT m.c))
), scoped AS (
  SELECT f.*, {first_in('unit', '')} AS u, {first_in('building', '')} AS w FROM (
    SELECT 'deck' AS field, * FROM {owner_sql('deck')} UNION ALL SELECT 'balcony', * FROM {owner_sql('balcony')} UNION ALL SELECT 'parking', * FROM {owner_sql('parking')}) f
), one AS (
  SELECT k, '₹' || replace(regexp_extract(s, '(?i)(?:₹|rs\.?)\s*(\d[\d,]*)\s*(?:/|per)\s*sq\.?\s*\.?\s*ft', 1), ',', '') || '/sq ft' AS per_sqft, regexp_extract(s, '(?i)(\d{{1,2}})\s*towers?\b', 1) AS towers FROM q WHERE name IS NOT NULL
), facts AS (
  SELECT k, 'rera_number' AS field, upper(g) AS value, NULL AS configuration, NULL AS scope, NULL AS evidence, a AS place FROM {nearest_sql('rera')}
  UNION ALL SELECT k, 'price', '₹' || g || ' Cr', NULL, NULL, NULL, a FROM {nearest_sql('cr')}
  UNION ALL SELECT k, 'price', '₹' || g || 'L', NULL, NULL, NULL, a FROM {nearest_sql('lakh')} WHERE k NOT IN (SELECT k FROM cr)
  UNION ALL SELECT k, field, v.g || ' sq ft', NULL, NULL, NULL, v.a FROM built
  UNION ALL SELECT o.k, 'carpet_area', g || ' sq ft', own, NULL, {around_sql(40)}, o.a FROM {owner_sql('area')} o JOIN q USING (k) WHERE own IS NOT NULL
  UNION ALL SELECT o.k, 'price', '₹' || g || CASE WHEN regexp_matches(m, '(?i)cr') THEN ' Cr' ELSE ' L' END, own, NULL, {around_sql(40)}, o.a FROM {owner_sql('price')} o JOIN q USING (k) WHERE own IS NOT NULL
  UNION ALL SELECT o.k, field, m, own, CASE WHEN u IS NULL AND w IS NULL THEN 'unknown' WHEN w IS NULL THEN 'unit' WHEN u IS NOT NULL THEN CASE WHEN abs(u.a - o.a) < abs(w.a - o.a) THEN 'unit' ELSE 'project' END
    WHEN contains(w.m, 'tower') THEN 'tower' WHEN contains(w.m, 'building') THEN 'building' ELSE 'project' END, {around_sql(60)}, o.a FROM scoped o JOIN q USING (k)
  UNION ALL SELECT k, 'price_per_sqft', per_sqft, NULL, NULL, NULL, NULL FROM one WHERE per_sqft <> '₹/sq ft'
  UNION ALL SELECT k, 'tower_count', towers, NULL, NULL, NULL, NULL FROM one WHERE towers <> ''
  UNION ALL SELECT k, 'amenities', array_to_string(list_filter(h, lambda x: len(list_filter(h, lambda y: y <> x AND contains(y, x))) = 0), '; '), NULL, NULL, NULL, NULL
    FROM (SELECT k, list_filter({AMENITIES_SQL}, lambda x: contains(replace(lower(s), coalesce(name, chr(0)), ' '), x)) AS h FROM q) WHERE len(h) > 0
)"""


@query(FACTS_SQL + " SELECT k AS doc_id, field, value, configuration, scope, evidence, CAST(place AS INTEGER) AS place FROM facts")
def page_facts_by_place(spark: SparkSession, d: str) -> DataFrame:
    return page_facts.facts(listed(spark, d), id_col="k", text_col="s", name_col="name").withColumnRenamed("k", "doc_id")


NAME_SQL = r"([A-Z][A-Za-z0-9&''-]+(?:[ \t]+[A-Z0-9][A-Za-z0-9&''-]*){0,5})"


@query(rf"""WITH q AS MATERIALIZED ({LISTED.replace("p_name || repeat(", "'Reg. No. ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || repeat(")}),
{places_sql('bhk', r'(?i)(\d)\s*bhk')},
{places_sql('rera', r'(?i)\b(P[A-Z]{0,2}\d{9,13})\b')},
masked AS (SELECT k, regexp_replace(s, '(?i)\bP[A-Z]{{0,2}}\d{{10}}\b', repeat(chr(10), 12), 'g') AS s FROM q),
{places_sql('names', NAME_SQL, 'masked')},
codes AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY k ORDER BY i), 0) AS last, row_number() OVER (PARTITION BY k, upper(g) ORDER BY i) AS r FROM rera)
SELECT k AS doc_id, upper(g) AS rera, (SELECT arg_max(n.m, n.a) FROM names n WHERE n.k = o.k AND n.b <= o.a AND NOT regexp_full_match(n.m, '(?i)rera|maharera|no\.?|reg\.?|registration') HAVING max(n.a) >= greatest(o.a - 200, o.last)) AS name,
  coalesce((SELECT string_agg(c || ' BHK', ',' ORDER BY a) FROM (SELECT l.g AS c, min(l.a) AS a FROM bhk l WHERE l.k = o.k AND l.a >= o.a - 300 AND l.b <= o.b + 300 GROUP BY l.g)), '') AS configurations, {around_sql(300)} AS snippet
FROM codes o JOIN q USING (k) WHERE r = 1""")
def sub_listings_of_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = listed(spark, d)
    name = F.concat(F.lit("\nReg. No. "), F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    said = F.when(F.col("name").isNull(), F.col("s")).otherwise(F.replace(F.col("s"), F.concat(F.lit("\n"), F.col("name"), F.lit(" ")), F.concat(name, F.lit(" "))))
    found = rows.select(F.col("k").alias("doc_id"), F.inline(page_facts.sub_listings(said)))
    return found.withColumn("configurations", F.array_join("configurations", ","))


# ---- JSON of unknown shape


def linked(spark: SparkSession, d: str) -> DataFrame:
    """A JSON-LD block for each part, of a shape that differs by its key; every eleventh is broken."""
    k = F.col("p_partkey")
    size = F.struct(F.col("p_size").alias("value"), F.when(k % 3 == 0, "SQFT").when(k % 3 == 1, "MTK").otherwise("Acre").alias("unitText"))
    home = F.struct(
        F.when(k % 2 == 0, F.array(F.lit("http://schema.org/Residence"))).otherwise(F.array(F.lit("WebPage"), F.lit("Apartment"))).alias("@type"),
        F.col("p_name").alias("name"),
        F.struct(F.when(k % 4 > 0, F.col("p_brand")).alias("addressLocality"), F.col("p_type").alias("streetAddress")).alias("address"),
        size.alias("floorSize"),
        F.array(F.struct(F.lit("Gym").alias("name"), (k % 2 == 0).alias("value")), F.struct(F.col("p_type").alias("name"), F.lit(None).cast("boolean").alias("value"))).alias("amenityFeature"),
        F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("p_brand").alias("value"))).alias("brand"),
        F.struct(F.lit("Offer").alias("@type"), F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), F.when(k % 5 == 0, F.lit("top")).alias("highPrice")).alias("offers"),
    )
    page = F.struct(F.lit("WebSite").alias("@type"), F.lit("A site").alias("name"))
    block = F.when(k % 3 == 0, F.to_json(F.struct(F.array(F.to_variant_object(page), F.to_variant_object(home)).alias("@graph")))).when(k % 3 == 1, F.to_json(home)).otherwise(F.to_json(F.array(F.array(home))))
    return t(spark, d, "part").select(k, F.when(k % 11 == 0, F.concat(F.lit("{"), block)).otherwise(block).alias("block"))


@query("""WITH q AS (SELECT * FROM part WHERE p_partkey % 11 <> 0)
SELECT p_partkey, field, value FROM (
  SELECT p_partkey, 'project_name' AS field, p_name AS value FROM q
  UNION ALL SELECT p_partkey, 'location', CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE p_type END FROM q
  UNION ALL SELECT p_partkey, 'carpet_area', p_size || ' ' || ['sq ft', 'sq m', 'Acre'][p_partkey % 3 + 1] FROM q
  UNION ALL SELECT p_partkey, 'amenities', CASE WHEN p_partkey % 2 = 0 THEN 'Gym; ' ELSE '' END || p_type FROM q
  UNION ALL SELECT p_partkey, 'developer', p_brand FROM q
  UNION ALL SELECT p_partkey, 'price', CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN ' - top' ELSE '' END FROM q
)""")
def structured_facts_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return json_walk.structured_facts(linked(spark, d), id_col="p_partkey", json_col="block").withColumnRenamed("id", "p_partkey")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name, l_quantity) - 1 AS pos FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [0, 0, 0] ELSE [0] END::VARCHAR || '[' || pos || ']' AS path, p_name AS name, l_quantity AS quantity
FROM l WHERE l_orderkey % 7 <> 0 AND l_orderkey % 3 < 2""")
def project_objects_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Page states with the lines of an order: a list of projects at a place that differs by order, or a list of other things."""
    k = F.col("l_orderkey")
    lines = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    item = F.struct("l_linenumber", F.col("p_name").alias("name"), F.col("l_quantity").alias("quantity"))
    state = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["name"].alias("projectName"), x["quantity"].alias("quantity"))).alias("items"))
    other = F.transform("items", lambda x: F.struct(x["projectName"].alias("title"), x["quantity"].alias("quantity")))
    one = F.to_json(F.struct(F.struct(F.lit(1).alias("a"), F.col("items").alias("list")).alias("data")))
    two = F.to_json(F.struct(F.array(F.struct(F.col("items").alias("results"))).alias("page")))
    block = F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise(F.to_json(F.struct(other.alias("list"))))
    found = json_walk.project_objects(state.select("l_orderkey", F.when(k % 7 == 0, F.substring(block, 1, 30)).otherwise(block).alias("block")), id_col="l_orderkey", json_col="block")
    shown = F.concat(F.lit("["), F.array_join(F.slice(F.col("path"), 1, F.size("path") - 1).cast("array<string>"), ", "), F.lit("]["), F.element_at("path", -1).cast("string"), F.lit("]"))
    return found.select(F.col("id").alias("l_orderkey"), shown.alias("path"), "name", F.get_json_object("item", "$.quantity").cast("double").alias("quantity"))
