"""Facts folded into properties in their order, and what research does next.

The fold of a sequence of facts into one property has a closed form, so no task
walks through a property's facts and a property of any number of them is summed up
in each task first:

* a field stays if it has a value, else it takes its first fact's;
* a generic name takes the first name that is not generic, or, if all are, the last;
* a lifecycle that is not settled takes the first settled one, or else the last; its
  evidence is the last there was up to that fact;
* lists of values are united, the property's own first, then by fact;
* facts of a configuration never reach the property's own fields: each (configuration,
  field) has a bucket with its first value and the number of different ones;
* each source that is named counts once as evidence.

Facts are (property_id, seq, field, value, configuration, source_url, evidence_text).
``seq`` is unique within a property.

Defined results: '' and null are no value; facts of unknown properties are left out;
properties without facts stay as they are; null configurations are none; of features
that are equal in feature, scope, configuration and source the first stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.classify import identity_quality, research_priority
from quern.operators.entity import near_duplicate_penalty

# Fields of facts and the properties' fields that they fill; lifecycles that are not settled.
TOP_LEVEL = {
    "rera_number": "rera", "developer": "developer", "possession": "possession_display", "price": "price_display", "carpet_area": "carpet_area_display", "built_up_area": "built_up_area_display",
    "location_from_structured_data": "location",
}
UNSETTLED = ["UNKNOWN", "READY_TO_MOVE"]
LISTS = ["amenities", "nearby_landmarks"]
COMPLETE = ["developer", "rera", "possession_display", "carpet_area_display", "price_display"]


def _some(c: str | Column) -> Column:
    return F.nullif(F.col(c).cast("string") if isinstance(c, str) else c, F.lit(""))


def fold(properties: DataFrame, facts: DataFrame, generic: Callable[[Column], Column], *, key: str = "id") -> DataFrame:
    """``properties`` with their facts: same columns, those of them that facts can tell filled or upgraded."""
    have = set(properties.columns)
    own = facts.where("configuration IS NULL AND property_id IS NOT NULL")
    field, value, seq = F.col("field"), _some("value"), F.col("seq")
    fills = {c: [f for f in {field for field, top in TOP_LEVEL.items() if top == c} | ({c} - set(TOP_LEVEL))] for c in have - {key, "name", "lifecycle_status", "lifecycle_evidence_text", "evidence_count", "carpet_area_sqft", *LISTS}}
    square = F.regexp_extract(value, r"(\d{3,5}(?:\.\d+)?)", 1).try_cast("double")
    named, told, settled = field == "project_name", field == "lifecycle_status_from_page", ~F.col("value").isin(UNSETTLED)
    sums = [F.min_by(value, F.when(field.isin(fs) & value.isNotNull(), seq)).alias(f"_{c}") for c, fs in sorted(fills.items()) if fs]
    sums += [F.min_by(value, F.when(named & value.isNotNull() & ~generic(value), seq)).alias("_good"), F.max_by(value, F.when(named & value.isNotNull(), seq)).alias("_last")]
    sums += [F.min_by(value, F.when(told & settled, seq)).alias("_settled"), F.max_by(value, F.when(told & value.isNotNull(), seq)).alias("_told"), F.min(F.when(told & settled, seq)).alias("_stop")]
    sums += [F.min_by(square, F.when((field == "carpet_area") & square.isNotNull(), seq)).alias("_square")]
    sums += [F.transform(F.array_sort(F.collect_set(F.when((field == c) & value.isNotNull(), F.struct("seq", F.split("value", "; ").alias("v"))))), lambda x: x["v"]).alias(f"_{c}") for c in LISTS if c in have]
    first = own.groupBy("property_id").agg(*sums).withColumnRenamed("property_id", "_id")
    sources = facts.where("source_url <> ''").groupBy(F.col("property_id").alias("_sid")).agg(F.count_distinct("source_url").alias("_sources"))
    told_by = own.where(told & _some("evidence_text").isNotNull()).join(first.select("_id", "_stop"), F.col("property_id") == F.col("_id")).where(F.col("_stop").isNull() | (seq <= F.col("_stop")))
    evidence = told_by.groupBy(F.col("property_id").alias("_eid")).agg(F.max_by("evidence_text", "seq").alias("_evidence"))
    out = properties.join(first, F.col(key) == F.col("_id"), "left").join(sources, F.col(key) == F.col("_sid"), "left").join(evidence, F.col(key) == F.col("_eid"), "left")
    open_ = F.coalesce(_some("lifecycle_status"), F.lit("UNKNOWN")).isin(UNSETTLED) if "lifecycle_status" in have else F.lit(False)

    def column(c: str) -> Column:
        if c == "name":
            return F.when(generic(F.col("name")), F.coalesce("_good", "_last", "name")).otherwise(F.col("name"))
        if c == "lifecycle_status":
            return F.when(open_, F.coalesce("_settled", "_told", "lifecycle_status")).otherwise(F.col(c))
        if c == "lifecycle_evidence_text":
            return F.when(open_, F.coalesce("_evidence", c)).otherwise(F.col(c))
        if c == "evidence_count":
            return (F.coalesce(F.col(c), F.lit(0)) + F.coalesce("_sources", F.lit(0))).cast(properties.schema[c].dataType)
        if c == "carpet_area_sqft":
            return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col("_square")).cast(properties.schema[c].dataType)
        if c in LISTS:
            return F.array_distinct(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(F.flatten(f"_{c}"), F.array().cast("array<string>"))))
        if fills.get(c):
            return F.coalesce(_some(c), F.col(f"_{c}")).cast(properties.schema[c].dataType)
        return F.col(c)

    return out.select(*(column(c).alias(c) for c in properties.columns))


def configuration_buckets(facts: DataFrame) -> DataFrame:
    """(property_id, configuration, field, value, n_values): the first value of each bucket, and how many different ones it has."""
    rows = facts.where("configuration IS NOT NULL AND value <> ''")
    return rows.groupBy("property_id", "configuration", "field").agg(F.min_by("value", "seq").alias("value"), F.count_distinct("value").alias("n_values"))


def provenance(facts: DataFrame) -> DataFrame:
    """(property_id, field, value, seq, source_url): each different value of a property's field, by the fact that told it first."""
    rows = facts.where("configuration IS NULL AND value <> ''")
    return rows.groupBy("property_id", "field", "value").agg(F.min("seq").alias("seq"), F.min_by("source_url", "seq").alias("source_url"))


def feature_union(features: DataFrame) -> DataFrame:
    """Features (property_id, seq, feature, scope, configuration, source_url, ...) without later ones of an equal key."""
    key = ["property_id", "feature", "scope", "configuration", "source_url"]
    rest = [c for c in features.columns if c not in (*key, "seq")]
    return features.groupBy(*key).agg(F.min("seq").alias("seq"), *(F.min_by(c, "seq").alias(c) for c in rest))


# ---- priority


def location_strength(matched: str, reasons: str, mismatches: str) -> Column:
    """From the matched requirements, reasons and mismatches (arrays) of a ranked row."""
    said = F.coalesce(F.array_join(reasons, " "), F.lit(""))
    return (
        F.when(F.coalesce(F.array_contains(matched, "location"), F.lit(False)), 1.0)
        .when(F.contains(said, F.lit("not independently verified")), 0.6)
        .when(F.contains(said, F.lit("Nearby locality")), 0.3)
        .when(F.coalesce(F.exists(mismatches, lambda m: F.contains(F.lower(m), F.lit("does not match"))), F.lit(False)), 0.0)
        .otherwise(0.5)
    )


def lifecycle_presence(evidence: str, status: str) -> Column:
    return F.when(_some(evidence).isNotNull(), 1.0).when(F.coalesce(F.col(status), F.lit("UNKNOWN")) == "READY_TO_MOVE", 0.5).otherwise(0.0)


def completeness(fields: list[str] = COMPLETE) -> Column:
    return sum((_some(f).isNotNull().cast("int") for f in fields), F.lit(0)) / len(fields)


def prioritized(rows: DataFrame) -> DataFrame:
    """Ranked rows (seq, name, location, developer, match_score and the fields above) with ``penalty`` and ``priority``.

    The penalty is by a semi join: a row that has a near duplicate in the batch, whichever.
    """
    keyed = rows.withColumns({c: F.lit(None).cast("string") for c in ("source_url", "source_type") if c not in rows.columns})
    out = near_duplicate_penalty(keyed)
    strength = location_strength("matched_requirements", "match_reasons", "mismatches")
    score = research_priority(identity_quality("name"), strength, "match_score", lifecycle_presence("lifecycle_evidence_text", "lifecycle_status"), completeness(), "penalty")
    return out.select(*rows.columns, "penalty", score.alias("priority"))
