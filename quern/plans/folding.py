"""Queries of facts folded into properties, and of research priorities; lines of orders are the facts, parts the properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import classify
from quern.operators import assertions, folds
from quern.plans.queries import query, t

#: A line as a fact of its part, in the order of orders; a tenth of the lines tell of a configuration.
FACTS_SQL = """f AS MATERIALIZED (SELECT l_partkey AS property_id, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r,
  CASE WHEN l_returnflag = 'R' THEN 'lifecycle_status_from_page' WHEN l_linenumber % 4 = 0 THEN 'project_name' WHEN l_linenumber % 4 = 1 THEN 'carpet_area' WHEN l_linenumber % 4 = 2 THEN 'amenities' ELSE 'developer' END AS field,
  CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity < 30 THEN 'UNKNOWN' WHEN l_quantity < 40 THEN 'READY_TO_MOVE' ELSE 'RESALE' END WHEN l_linenumber % 4 = 0 THEN CASE WHEN l_quantity < 25 THEN 'Instagram' ELSE 'Tower ' || l_suppkey END
    WHEN l_linenumber % 4 = 1 THEN CASE WHEN l_quantity < 20 THEN 'large' ELSE CAST(l_suppkey % 900 + 100 AS VARCHAR) || ' sq ft' END WHEN l_linenumber % 4 = 2 THEN 'a' || (l_suppkey % 5) || '; b' || (l_suppkey % 3) ELSE CASE WHEN l_quantity < 10 THEN '' ELSE 'D' || l_suppkey END END AS value,
  CASE WHEN l_discount >= 0.09 THEN (l_linenumber % 3 + 1) || ' BHK' END AS configuration, CASE WHEN l_tax > 0.02 THEN 'u' || (l_suppkey % 7) END AS source_url, CASE WHEN l_quantity > 20 THEN 'said in ' || l_orderkey END AS evidence_text
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber ORDER BY l_suppkey, l_quantity, l_extendedprice) AS d FROM lineitem) WHERE d = 1)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    n, q, k = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_suppkey")
    once = t(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.min_by(F.struct("*"), F.struct("l_suppkey", "l_quantity", "l_extendedprice")).alias("x")).select("x.*")
    page = F.col("l_returnflag") == "R"
    field = F.when(page, "lifecycle_status_from_page").when(n % 4 == 0, "project_name").when(n % 4 == 1, "carpet_area").when(n % 4 == 2, "amenities").otherwise("developer")
    value = (
        F.when(page, F.when(q < 30, "UNKNOWN").when(q < 40, "READY_TO_MOVE").otherwise("RESALE"))
        .when(n % 4 == 0, F.when(q < 25, "Instagram").otherwise(F.concat(F.lit("Tower "), k.cast("string"))))
        .when(n % 4 == 1, F.when(q < 20, "large").otherwise(F.concat((k % 900 + 100).cast("string"), F.lit(" sq ft"))))
        .when(n % 4 == 2, F.concat(F.lit("a"), (k % 5).cast("string"), F.lit("; b"), (k % 3).cast("string")))
        .otherwise(F.when(q < 10, "").otherwise(F.concat(F.lit("D"), k.cast("string"))))
    )
    return once.select(
        F.col("l_partkey").alias("property_id"), (F.col("l_orderkey") * 10 + n).alias("seq"), field.alias("field"), value.alias("value"),
        F.when(F.col("l_discount") >= 0.09, F.concat((n % 3 + 1).cast("string"), F.lit(" BHK"))).alias("configuration"), F.when(F.col("l_tax") > 0.02, F.concat(F.lit("u"), (k % 7).cast("string"))).alias("source_url"),
        F.when(q > 20, F.concat(F.lit("said in "), F.col("l_orderkey").cast("string"))).alias("evidence_text"),
    )


@query(f"""WITH RECURSIVE {FACTS_SQL},
own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY seq) AS k FROM f WHERE configuration IS NULL),
p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Instagram' ELSE p_name END AS name, CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE '' END AS developer, CASE p_partkey % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'READY_TO_MOVE' WHEN 2 THEN 'NEW_LAUNCH' END AS status,
  CASE p_partkey % 5 WHEN 0 THEN 700.0 END AS sqft, CASE p_partkey % 2 WHEN 0 THEN 'p' END AS evidence, CASE p_partkey % 3 WHEN 1 THEN ['a1', 'pool'] END AS amenities FROM part),
step AS (  -- one fact after the other
  SELECT id, CAST(0 AS BIGINT) AS k, name, developer, status, sqft::DOUBLE AS sqft, evidence, coalesce(amenities, []) AS amenities FROM p
  UNION ALL
  SELECT id, s.k + 1, CASE WHEN field = 'project_name' AND s.name = 'Instagram' THEN value ELSE s.name END, CASE WHEN field = 'developer' AND s.developer = '' THEN value ELSE s.developer END,
    CASE WHEN field = 'lifecycle_status_from_page' AND coalesce(s.status, 'UNKNOWN') IN ('UNKNOWN', 'READY_TO_MOVE') THEN value ELSE s.status END,
    CASE WHEN field = 'carpet_area' AND s.sqft IS NULL THEN try_cast(nullif(regexp_extract(value, '\\d{{3,5}}'), '') AS DOUBLE) ELSE s.sqft END,
    CASE WHEN field = 'lifecycle_status_from_page' AND coalesce(s.status, 'UNKNOWN') IN ('UNKNOWN', 'READY_TO_MOVE') THEN coalesce(evidence_text, s.evidence) ELSE s.evidence END,
    CASE WHEN field = 'amenities' THEN list_concat(s.amenities, list_filter(string_split(value, '; '), lambda x: NOT list_contains(s.amenities, x))) ELSE s.amenities END
  FROM step s JOIN own o ON o.property_id = s.id AND o.k = s.k + 1
), last AS (SELECT id, max(k) AS k FROM step GROUP BY id), n AS (SELECT property_id AS id, count(DISTINCT source_url) AS n FROM f WHERE source_url <> '' GROUP BY 1)
SELECT id, name, nullif(developer, '') AS developer, status AS lifecycle_status, sqft AS carpet_area_sqft, evidence AS lifecycle_evidence_text, array_to_string(amenities, ',') AS amenities, CAST(1 + coalesce(n, 0) AS BIGINT) AS evidence_count
FROM step JOIN last USING (id, k) LEFT JOIN n USING (id)""")
def facts_folded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    properties = t(spark, d, "part").select(
        k.alias("id"),
        F.when(k % 3 == 0, "Instagram").otherwise(F.col("p_name")).alias("name"),
        F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("developer"),
        F.when(k % 4 == 0, "UNKNOWN").when(k % 4 == 1, "READY_TO_MOVE").when(k % 4 == 2, "NEW_LAUNCH").alias("lifecycle_status"),
        F.when(k % 5 == 0, 700.0).alias("carpet_area_sqft"),
        F.when(k % 2 == 0, "p").alias("lifecycle_evidence_text"),
        F.when(k % 3 == 1, F.array(F.lit("a1"), F.lit("pool"))).alias("amenities"),
        F.lit(1).cast("long").alias("evidence_count"),
    )
    out = folds.fold(properties, facts(spark, d), lambda n: classify.invalid_name(n))
    return out.withColumn("amenities", F.array_join("amenities", ","))


@query(f"WITH {FACTS_SQL} SELECT property_id, configuration, field, arg_min(value, seq) AS value, count(DISTINCT value) AS n_values FROM f WHERE configuration IS NOT NULL AND value <> '' GROUP BY 1, 2, 3")
def facts_by_configuration(spark: SparkSession, d: str) -> DataFrame:
    return folds.configuration_buckets(facts(spark, d))


@query(f"WITH {FACTS_SQL} SELECT property_id, field, value, min(seq) AS seq, arg_min(source_url, seq) FILTER (true) AS source_url FROM (SELECT property_id, field, value, seq, coalesce(source_url, '-') AS source_url FROM f WHERE configuration IS NULL AND value <> '') GROUP BY 1, 2, 3")
def fact_provenance(spark: SparkSession, d: str) -> DataFrame:
    return folds.provenance(facts(spark, d)).withColumn("source_url", F.coalesce("source_url", F.lit("-")))


@query(f"""WITH {FACTS_SQL} SELECT property_id, feature, scope, configuration, source_url, min(seq) AS seq, arg_min(evidence, seq) AS evidence FROM (
  SELECT property_id, field AS feature, CASE WHEN seq % 2 = 0 THEN 'unit' ELSE 'project' END AS scope, coalesce(configuration, '-') AS configuration, coalesce(source_url, '-') AS source_url, seq, value AS evidence FROM f) GROUP BY 1, 2, 3, 4, 5""")
def feature_union(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).select("property_id", "seq", F.col("field").alias("feature"), F.when(F.col("seq") % 2 == 0, "unit").otherwise("project").alias("scope"), "configuration", "source_url", F.col("value").alias("evidence"))
    return folds.feature_union(rows).withColumns({c: F.coalesce(c, F.lit("-")) for c in ("configuration", "source_url")})


@query("""WITH q AS MATERIALIZED (SELECT p_partkey AS seq, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Heights' ELSE ' ' || p_brand END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS developer, CASE WHEN p_partkey % 5 > 0 THEN p_type ELSE '' END AS location, p_size * 2.5 AS match_score,
  CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE 0.5 END END AS place, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS life, p_partkey FROM part),
n AS MATERIALIZED (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')), lambda x: x <> 'heights') AS w, regexp_replace(lower(developer), '[^a-z0-9]', '', 'g') AS dev, regexp_replace(lower(location), '[^a-z0-9]', '', 'g') AS loc FROM q),
hit AS (SELECT DISTINCT a.seq FROM n a JOIN n b ON a.seq <> b.seq AND (a.dev <> '' AND a.dev = b.dev OR a.loc <> '' AND b.loc <> '' AND (contains(a.loc, b.loc) OR contains(b.loc, a.loc))) WHERE len(list_intersect(a.w, b.w)) * 2 >= len(list_distinct(list_concat(a.w, b.w)))),
c AS (SELECT n.*, CASE WHEN hit.seq IS NOT NULL THEN 0.5 ELSE 1.0 END AS penalty, ((developer <> '')::INT + (seq % 2)::INT + 1) / 5.0 AS complete FROM n LEFT JOIN hit USING (seq))
SELECT seq, penalty, round_even((0.30 * 1.0 + 0.20 * place + 0.20 * least(1.0, match_score / 100) + 0.15 * life + 0.15 * complete)::DOUBLE * penalty::DOUBLE, 4) AS priority FROM c""")
def research_priorities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    rows = t(spark, d, "part").select(
        k.alias("seq"),
        F.concat("p_name", F.when(k % 3 == 0, " Heights").otherwise(F.concat(F.lit(" "), "p_brand"))).alias("name"),
        F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("developer"),
        F.when(k % 5 > 0, F.col("p_type")).otherwise("").alias("location"),
        (F.col("p_size") * 2.5).alias("match_score"),
        F.when(k % 4 == 0, F.array(F.lit("budget"), F.lit("location"))).otherwise(none).alias("matched_requirements"),
        F.when(k % 4 == 1, F.array(F.lit("place not independently verified"))).when(k % 4 == 2, F.array(F.lit("Nearby locality: x"))).otherwise(none).alias("match_reasons"),
        F.when(k % 7 == 0, F.array(F.lit("Location Does not match"))).alias("mismatches"),
        F.when(k % 3 == 0, "said").alias("lifecycle_evidence_text"),
        F.when(k % 3 == 1, "READY_TO_MOVE").alias("lifecycle_status"),
        F.when(k % 2 == 1, F.concat(F.lit("odd"), k.cast("string"))).alias("rera"),
        F.lit("2027").alias("possession_display"),
        F.lit(None).cast("string").alias("carpet_area_display"),
        F.lit("").alias("price_display"),
    )
    return folds.prioritized(rows).select("seq", "penalty", "priority")


# ---- rules of data quality


@query("""WITH l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
p AS MATERIALIZED (SELECT o_orderkey AS run, o_orderstatus AS market, pos, CASE WHEN o_orderkey % 2 = 0 THEN '2 BHK in Brand#1' ELSE 'homes' END AS q, p_name || CASE WHEN l_quantity > 45 THEN ': the best' ELSE '' END AS name, p_brand AS location, l_returnflag AS life,
  CASE l_linenumber % 3 WHEN 0 THEN 'P51800' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') WHEN 1 THEN 'bad' END AS rera, l_linenumber % 2 = 0 AS twice, CASE WHEN l_quantity < 10 THEN 'Villa' WHEN l_quantity < 20 THEN 'Flat' END AS kind, l_linenumber % 4 AS pr, l_discount > 0.05 AS claim, l_tax > 0.04 AS placed, l_quantity > 20 AS b1, l_quantity > 40 AS b2 FROM l),
v AS (
  SELECT market, 'V2 locality' AS rule, contains(lower(location || '  ' || name), 'brand#1') AS ok FROM p WHERE contains(q, 'Brand#1')
  UNION ALL SELECT market, 'V3 lifecycle', life = 'N' FROM p UNION ALL SELECT market, 'V4 name', NOT contains(name, ':') FROM p UNION ALL SELECT market, 'V5 registration', rera <> 'bad' FROM p WHERE rera IS NOT NULL
  UNION ALL SELECT market, 'V6 configuration', NOT twice FROM p UNION ALL SELECT market, 'V7 kind', NOT (q LIKE '2%' AND kind = 'Villa') FROM p WHERE kind IS NOT NULL UNION ALL SELECT market, 'V8 price', pr > 1 FROM p UNION ALL SELECT market, 'V9 place', placed FROM p WHERE claim
), d AS (SELECT market, (rera IS NOT NULL AND row_number() OVER (PARTITION BY run, rera ORDER BY pos) > 1)::INT + (row_number() OVER (PARTITION BY run, regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(location), '[^a-z0-9]', '', 'g') ORDER BY pos) > 1)::INT AS n FROM p)
SELECT market, rule, CAST(count(*) FILTER (ok) AS BIGINT) AS passed, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed FROM v GROUP BY 1, 2
UNION ALL SELECT o_orderstatus, 'V1 answer', count(*) FILTER (o_orderpriority < '4'), count(*) FILTER (o_orderpriority >= '4') FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1
UNION ALL SELECT market, 'V10 panels', CAST(sum(1 + b1::INT + b2::INT) AS BIGINT), CAST(sum(2 - b1::INT - b2::INT) AS BIGINT) FROM p WHERE pos = 0 GROUP BY 1
UNION ALL SELECT market, 'V11 ledger', CAST(sum(1 + b1::INT) AS BIGINT), CAST(sum(1 + (NOT b1)::INT) AS BIGINT) FROM p WHERE pos = 0 GROUP BY 1
UNION ALL SELECT market, 'V12 duplicates', CAST(sum(1 - n) AS BIGINT), CAST(sum(n) AS BIGINT) FROM d GROUP BY 1""")
def rules_by_market(spark: SparkSession, d: str) -> DataFrame:
    """Orders as searches, their lines as the properties that were returned, nested; twelve rules by market."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    pick = lambda k, *v: F.element_at(F.array(*(F.lit(x).cast("string") for x in v)), (k + 1).cast("int"))
    item = F.struct(
        n.alias("o1"), F.col("l_partkey").alias("o2"), F.col("l_suppkey").alias("o3"), q.alias("o4"),
        F.concat("p_name", F.when(q > 45, ": the best").otherwise("")).alias("name"), F.col("p_brand").alias("location"), F.lit("").alias("city"), pick(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2), "RESALE", "NEW_LAUNCH", "READY_TO_MOVE").alias("lifecycle_status"),
        F.when(n % 3 == 0, F.concat(F.lit("P51800"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))).when(n % 3 == 1, "bad").alias("rera"), pick(n % 2, "2 BHK & 2 BHK", "2 BHK, 3 BHK").alias("config"), F.when(q < 10, "Villa").when(q < 20, "Flat").alias("property_type"),
        pick(n % 4, "₹2 Cr - ₹1 Cr", " ₹ ", "₹1 Cr - ₹2 Cr", None).alias("price"), F.when(F.col("l_discount") > 0.05, "by the sea").alias("nearby_landmarks"), F.lit("").alias("connectivity"), F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0).alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.array(F.lit(True), q > 20, q > 40).alias("panels"), F.create_map(F.lit("a"), F.lit("filled"), F.lit("b"), F.when(q > 20, "filled").otherwise("never_researched"), F.lit("c"), F.lit("searched_not_found")).alias("ledger"),
    )
    lines = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", item.alias("item"))
    key = lambda x: F.struct(x["o1"], x["o2"], x["o3"], x["o4"])
    nested = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item"), lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)).alias("properties"))
    orders = t(spark, d, "orders").join(nested, F.col("l_orderkey") == F.col("o_orderkey"))
    searches = orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("market"), F.when(F.col("o_orderkey") % 2 == 0, "2 BHK in Brand#1").otherwise("homes").alias("query"), F.lit("agent").alias("pipeline"), F.when(F.col("o_orderpriority") < "4", 200).otherwise(500).alias("http_status"), "properties")
    return assertions.assertions(searches, ["Brand#1"])
