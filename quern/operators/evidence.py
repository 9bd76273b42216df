"""Evidence rows to ranked properties: projection, checks, gates, gaps, curation, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.classify import NEW_STOCK, NON_CANDIDATE_PAGES, invalid_name, lifecycle, page_type, tier, unrelated_commerce
from quern.functions.extract import price_cr
from quern.functions.nl import configuration
from quern.functions.scalar import atomic_configs, base_locality, half_even, possession_label, possession_year, project_name

# Fields whose gaps count; words of scopes that must be the unit's.
GAP_FIELDS = {"developer": "developer", "rera": "rera", "possession_display": "possession", "carpet_area_display": "carpet_area", "price_display": "price"}
DISPLAY_FIELDS = {"developer": "developer", "carpet_area_display": "carpet_area", "amenities": "amenities", "possession_display": "possession", "connectivity": "connectivity", "nearby_landmarks": "nearby_landmarks", "tower_count": "tower_count", "property_type": "property_type"}
UNIT_FEATURES = ["deck", "balcony", "parking"]


def to_properties(evidence: DataFrame, as_of: Column, terms: list[str] = ()) -> DataFrame:
    """One normalized property per evidence row (schema EVIDENCE)."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    said = price_cr(text)
    configs = atomic_configs("configuration")
    found = F.nullif(configuration(text), F.lit(""))
    shown = F.coalesce(F.nullif(F.col("possession"), F.lit("")), F.nullif(possession_label(text), F.lit("")))
    year = possession_year(shown, as_of)
    display = F.when(shown.rlike("(?i)ready"), "Ready to Move").otherwise(shown)
    unpriced = F.col("price.min_inr").isNull() & F.col("price.max_inr").isNull()
    own = evidence.select(
        "seq",
        project_name("title").alias("name"),
        F.nullif(F.trim("developer"), F.lit("")).alias("developer"),
        F.nullif(F.trim("location"), F.lit("")).alias("location"),
        F.col("city"),
        F.when(F.size(configs) > 0, configs).when(found.isNotNull(), atomic_configs(F.array(found))).otherwise(F.array().cast("array<string>")).alias("configuration"),
        F.col("price.min_inr").alias("price_min_inr"),
        F.when(unpriced, half_even(said["crores"] * 1e7).cast("long")).otherwise(F.col("price.max_inr")).alias("price_max_inr"),
        F.when(unpriced, F.coalesce(F.col("price.display"), said["display"])).otherwise(F.col("price.display")).alias("price_display"),
        F.col("carpet_area.value_sqft").alias("carpet_area_sqft"),
        F.col("carpet_area.display").alias("carpet_area_display"),
        year.alias("possession_year"),
        display.alias("possession_display"),
        F.nullif(F.col("rera"), F.lit("")).alias("rera"),
        F.filter(F.transform("amenities", lambda a: F.trim(a)), lambda a: a != "").alias("amenities"),
        F.nullif(F.trim("description"), F.lit("")).alias("description"),
        "source",
        "source_url",
        "source_type",
        "captured_at",
        page_type("title", "description", "source_url", "source_type", "developer", terms).isin(NON_CANDIDATE_PAGES).alias("is_aggregator"),
        "title",
    )
    status = lifecycle("title", "description", as_of, "possession_year", "possession_display")
    return own.withColumn("_l", status).select("*", F.col("_l.status").alias("lifecycle_status"), F.col("_l.evidence").alias("lifecycle_evidence")).drop("_l", "title")


def geography_terms(locations: list[str], resolved: list[dict]) -> tuple[list[str], list[str]]:
    """(all terms, specific terms) of a query: names, parents and alternatives; cities only in the first."""
    every = [*locations, *(r.get(k) for r in resolved for k in ("city", "parent"))]
    narrow = [*locations, *(r.get("parent") for r in resolved), *(a.get(k) for r in resolved for a in r.get("alternatives") or [] for k in ("parent", "canonical"))]
    return tuple(list(dict.fromkeys(t for t in terms if t and len(t) >= 3)) for terms in (every, narrow))


def in_area(terms: list[str], specific: list[str], columns: tuple[str, ...] = ("name", "location", "city", "description")) -> Column:
    """Whether the row's text holds one of the specific terms, or, without any, one of all."""
    use = specific or terms
    if not terms:
        return F.lit(True)
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
    out = F.lit(False)
    for t in use:
        out = out | F.contains(text, F.lit(t.lower()))
    return out


def reject_reason(*, final: bool, terms: list[str] = (), specific: list[str] = (), cities: list[str] = ()) -> Column:
    """Why a property is no candidate, or null; the rules in order, some on the final pass only."""
    name, status = F.coalesce(F.col("name"), F.lit("")), F.coalesce(F.col("lifecycle_status"), F.lit("UNKNOWN"))
    out = (
        F.when(F.coalesce(F.col("is_aggregator"), F.lit(False)), "category page")
        .when(unrelated_commerce(F.concat_ws(" ", name, F.coalesce(F.col("description"), F.lit("")))).isNotNull(), "unrelated commerce")
        .when(status == "RESALE", "resale")
        .when(status == "RENTAL", "rental")
    )
    unknown = ~status.isin(NEW_STOCK)
    if final:
        out = out.when(unknown & (status == "READY_TO_MOVE"), "ready to move").when(unknown, "status not confirmed")
        none = F.lit(None).cast("string")
        out = out.when(page_type("name", none, none, none, none).isin(NON_CANDIDATE_PAGES), "no project name").when(invalid_name("name"), "invalid name")
    else:
        out = out.when(unknown, F.lit(None))  # kept for research, whatever the place
    if terms:
        away = ~in_area(list(terms), list(specific))
        city = F.lower(F.coalesce(F.col("city"), F.lit("")))
        other = (city != "") & ~city.isin([c.lower() for c in cities])
        out = out.when(away & other, "other area")
        if final:
            out = out.when(away, "no match to the area")
    return out.otherwise(F.lit(None))


def split_by_reason(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def verification(entries: DataFrame, key: str, field: str = "field", value: str = "value") -> DataFrame:
    """(key, field, state, values): ``conflict`` if sources differ, ``corroborated`` if two or more agree."""
    grouped = entries.groupBy(key, field).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.col(value).cast("string"))).alias("_v"))
    state = F.when(F.size("_v") > 1, "conflict").when(F.col("n") >= 2, "corroborated").otherwise("single")
    return grouped.select(key, field, state.alias("state"), F.array_join("_v", "|").alias("values"), "n")


def evidence_points(sources: Column, rera: Column, verified: Column, age_days: Column, aggregator: Column, weight: int = 10) -> Column:
    """Half even of the weight times: sources 0.5 or 0.25, registration 0.25, verified 0.25, fresh 0.25 or 0.1."""
    p = F.when(sources >= 2, 0.5).when(sources == 1, 0.25).otherwise(0.0) + F.when(F.coalesce(rera, F.lit("")) != "", 0.25).otherwise(0.0)
    p = p + F.when(verified, 0.25).otherwise(0.0) + F.when(age_days <= 7, 0.25).when(age_days <= 30, 0.1).otherwise(0.0)
    return F.when(aggregator, 0).otherwise(half_even(weight * F.least(F.lit(1.0), F.round(p, 9))).cast("int"))


def place_points(hay: Column, resolved: list[dict], weight: int = 30) -> Column:
    """Four tiers: the place itself, its parent (0.6), another direction of it (0.35), nothing; half to even."""
    if not resolved:
        return F.lit(None).cast("int")
    import re

    parents = {r["parent"].lower() for r in resolved if r.get("is_micro_alias") and r.get("parent")}
    exact = [t for r in resolved if not (r["query_term"].lower() in parents and not r.get("is_micro_alias")) for t in (r["query_term"].lower(), r["canonical"].lower()) if t]
    up = [r["parent"].lower() for r in resolved if r.get("is_micro_alias") and r.get("parent")]
    bases = {r["query_term"].lower(): re.sub(r"\s+(east|west|north|south)\.?$", "", r["query_term"].strip().lower()).strip() for r in resolved}

    def any_of(terms: list[str]) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(hay, F.lit(t))
        return out

    near = [b for t, b in bases.items() if len(b) > 2 and b != t]
    return (
        F.when(any_of(exact), weight)
        .when(any_of(up), half_even(F.lit(weight * 0.6)).cast("int"))
        .when(any_of(near), half_even(F.lit(weight * 0.35)).cast("int"))
        .otherwise(0)
    )


def budget_points(price: Column, budget_cr: float | None, weight: int = 15) -> Column:
    if budget_cr is None:
        return F.lit(None).cast("int")
    over = (price - budget_cr * 1e7) / (budget_cr * 1e7)
    return F.when(price.isNull(), 0).when(over <= 0, weight).when(over <= 0.15, half_even(F.lit(weight * 0.4)).cast("int")).otherwise(0)


def amenity_points(amenities: Column, description: Column, features: Column, wanted: list[str], config: str | None, weight: int = 10) -> Column:
    """Share of what is wanted; decks, balconies and parking count only as features of the unit (of its configuration)."""
    if not wanted:
        return F.lit(None).cast("int")
    hay = F.lower(F.concat_ws(" ", F.array_join(F.coalesce(amenities, F.array().cast("array<string>")), " "), F.coalesce(description, F.lit(""))))
    n = F.lit(0)
    for w in wanted:
        if w.lower() in UNIT_FEATURES:
            fits = _in_unit(features, w.lower(), config)
        else:
            fits = F.contains(hay, F.lit(w.lower()))
        n = n + F.when(F.coalesce(fits, F.lit(False)), 1).otherwise(0)
    nothing = (F.coalesce(F.size(amenities), F.lit(0)) <= 0) & (F.coalesce(description, F.lit("")) == "") & (F.coalesce(F.size(features), F.lit(0)) <= 0)
    return F.when((n == 0) & nothing, F.lit(None)).otherwise(half_even(weight * n / len(wanted)).cast("int"))


def _in_unit(features: Column, name: str, config: str | None) -> Column:
    return F.exists(features, lambda f: (f["feature"] == name) & (f["scope"] == "unit") & (F.lit(config is None) | f["configuration"].isNull() | (F.lower(f["configuration"]) == (config or "").lower())))


def gaps(properties: DataFrame, key: str, wanted: list[str] = (), weak: Column | None = None) -> DataFrame:
    """``missing_fields`` of each property that has some: unknown status, empty fields, amenities that nothing names."""
    status = F.coalesce(F.col("lifecycle_status"), F.lit("UNKNOWN")) if "lifecycle_status" in properties.columns else F.lit("KNOWN")

    def empty(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""

    fields = [F.when(status.isin("UNKNOWN", "READY_TO_MOVE"), "lifecycle"), *(F.when(empty(c), n) for c, n in GAP_FIELDS.items() if c in properties.columns)]
    hay = F.lower(F.concat_ws(" ", *(F.array_join(c, " ") if properties.schema[c].dataType.typeName() == "array" else F.col(c) for c in ("amenities", "description") if c in properties.columns)))
    fields += [F.when(~F.contains(F.coalesce(hay, F.lit("")), F.lit(w.lower())), w) for w in wanted]
    out = properties.select(key, F.array_compact(F.array(*fields)).alias("missing_fields"))
    return out.where(F.size("missing_fields") > 0)


def gap_candidates(candidates: DataFrame, gap_rows: DataFrame, name: str, candidate: str, order: str) -> DataFrame:
    """Candidates that have a gap row of their name, with its columns; of several the last by ``order`` counts."""
    last = gap_rows.groupBy(F.col(candidate).alias("_name")).agg(F.max_by(F.struct(*(c for c in gap_rows.columns if c != candidate)), order).alias("_g"))
    return candidates.join(last, F.col(name) == F.col("_name")).select(*candidates.columns, "_g.*")


def gap_queries(gap_rows: DataFrame, name: str, area: str = "", most: int = 5) -> DataFrame:
    """Research queries of a candidate's gaps: name, gap, area; five at most."""
    words = F.transform("missing_fields", lambda f: F.trim(F.concat_ws(" ", F.col(name), F.replace(f, F.lit("_"), F.lit(" ")), F.lit(area))))
    return gap_rows.select("*", F.slice(words, 1, most).alias("queries"))


def ledger(properties: DataFrame, entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, filled, sources, status) of every property and field."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias("filled")) for f in fields))
    grid = properties.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.filled")
    counts = entries.groupBy(key, "field").agg(F.count_distinct("source").alias("sources"), F.count_distinct("value").alias("_values"))
    out = grid.join(counts, [key, "field"], "left").withColumn("sources", F.coalesce("sources", F.lit(0).cast("long")))
    status = F.when(~F.col("filled"), "missing").when(F.col("_values") > 1, "conflict").when(F.col("sources") >= 2, "corroborated").otherwise("single")
    return out.withColumn("status", status).drop("_values")


def curated(ranked: DataFrame, n: int = 8, *, rera: str = "rera", score: str = "match_score", tie: str = "id") -> DataFrame:
    """The first n by score after one row per registration number."""
    from quern.operators.keyed import collapse_first

    return collapse_first(ranked, F.upper(rera), [F.desc(score), F.asc(tie)]).orderBy(F.desc(score), F.asc(tie)).limit(n)


def citations(rows: DataFrame, url: str = "source_url", order: str = "seq") -> DataFrame:
    """The first row of each URL."""
    rank = F.row_number().over(Window.partitionBy(url).orderBy(order))
    return rows.where(F.coalesce(F.col(url), F.lit("")) != "").withColumn("_r", rank).where("_r = 1").drop("_r")


def source_order(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in {"official": 0, "developer": 1, "portal": 2, "web": 3, "category_page_extract": 4}.items() for x in p)), kind), F.lit(9))


def pages_to_read(rows: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The first n sources of each property, official ones first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(source_order(F.col("source_type")), "seq"))
    return rows.withColumn("pos", rank).where(F.col("pos") <= n)


def research_order(rows: DataFrame, fetchable: str, undetermined: str, priority: str, seq: str) -> DataFrame:
    return rows.orderBy(F.desc(fetchable), F.desc(undetermined), F.desc(priority), F.asc(seq))


def metrics(rows: DataFrame, classes: dict[str, Column], sources: str | None = None) -> DataFrame:
    """One row: counts of each class, and the distinct sources."""
    extra = [F.array_join(F.sort_array(F.collect_set(sources)), ",").alias("sources")] if sources else []
    return rows.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in classes.items()), *extra)


def quality_checks(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed, failed): rows that meet each rule; null does not apply."""
    n = rows.agg(*(x for k, c in checks.items() for x in (F.count_if(c).alias(f"{k}_p"), F.count_if(~c).alias(f"{k}_f"))))
    return n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(f"{k}_p").alias("passed"), F.col(f"{k}_f").alias("failed")) for k in checks))).alias("c")).select("c.*")


def brief(name: Column, place: Column, config: Column, price: Column, label: Column) -> Column:
    """A sentence about a property of what is known."""
    head = F.concat_ws(" in ", F.nullif(name, F.lit("")), F.nullif(place, F.lit("")))
    return F.concat(F.concat_ws(", ", head, F.nullif(config, F.lit("")), F.when(F.coalesce(price, F.lit("")) != "", F.concat(F.lit("from "), price))), F.lit(" ("), label, F.lit(")."))


def markdown(rows: DataFrame, order: str, line: Column) -> DataFrame:
    """One Markdown text of all rows (a brief: call it on a curated few)."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: F.concat(F.lit("- "), x["l"])), "\n").alias("text"))


def match_tier(score: Column) -> Column:
    return tier(score)


def same_place(a: Column, b: Column) -> Column:
    return base_locality(a) == base_locality(b)
