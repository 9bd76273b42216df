"""Catalog search: filters, scores with reasons, tiers, facets, suggestions.

Two families of scores differ in rounding and credits, as in the systems that
they stand for: ``catalog_score`` and ``external_score`` round half up,
``evidence_score`` (see ``evidence``) half to even. A part that was not asked
for is null: it leaves numerator and denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.classify import tier
from quern.functions.scalar import age_days, bhk_number, clean, half_up

# The points of each part.
WEIGHTS = {"location": 30, "config": 25, "possession": 20, "budget": 15, "completeness": 10, "amenity": 10, "quality": 10}
NEARBY, PARENT, CLOSE = 0.35, 0.6, 0.05
BUDGETS = {"Under 75L": (0.0, 75.0), "75L–1.5Cr": (75.0, 150.0), "75L-1.5Cr": (75.0, 150.0), "Above 1.5Cr": (150.0, None)}
POSSESSIONS = {"By 2026": (None, 2026), "By 2027": (None, 2027), "2028+": (2028, None)}


class Wanted(dict):
    """What a search asks for: ``locations``, ``configs``, ``amenities``; budget in lakhs; possession years."""

    def __getattr__(self, name: str):  # noqa: ANN204
        return self.get(name)


def from_buckets(*, locations: list[str] = (), budget: str = "", configs: list[str] = (), possession: str = "", amenities: list[str] = ()) -> Wanted:
    low, high = BUDGETS.get(budget, (None, None))
    first, last = POSSESSIONS.get(possession, (None, None))
    return Wanted(locations=[x for x in locations if x], configs=[x for x in configs if x], amenities=[x for x in amenities if x], budget_min=low, budget_max=high, year_min=first, year_max=last)


def from_params(*, area: str = "", flat_type: str = "", budget_min: float | None = None, budget_max: float | None = None, possession_date: str = "") -> Wanted:
    """Rupees to lakhs, ``3BHK`` to ``3 BHK``, a date to its year."""
    import math
    import re

    year = re.match(r"\d{1,4}", possession_date or "")
    return Wanted(
        locations=[area] if area else [],
        configs=[re.sub(r"(?i)^(\d)BHK$", r"\1 BHK", flat_type)] if flat_type else [],
        amenities=[],
        budget_min=None if budget_min is None else math.floor(budget_min / 1e5 + 0.5),
        budget_max=None if budget_max is None else math.floor(budget_max / 1e5 + 0.5),
        year_max=int(year[0]) if year else None,
    )


def _any(hay: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(hay, F.lit(t.lower()))
    return out


def expanded(term: str, aliases: dict[str, list[tuple[str, str, str]]] | None = None) -> list[str]:
    """A place name and, where it is an alias, its canonical names, parents and cities."""
    key = term.strip().lower()
    return list(dict.fromkeys([key, *(x.lower() for entry in (aliases or {}).get(key, []) for x in entry if x)]))


def place_points(hay: Column, locations: list[str], weight: int = 30, aliases: dict | None = None) -> Column:
    """Full for a place, part for another direction of the same place, else 0; null if none was asked for."""
    if not locations:
        return F.lit(None).cast("int")
    exact = _any(hay, [t for x in locations for t in expanded(x, aliases)])
    import re

    bases = [re.sub(r"(?i)\s+(?:east|west|north|south)\.?$", "", x.strip()).strip().lower() for x in locations]
    near = _any(hay, [b for b, x in zip(bases, locations, strict=True) if len(b) > 2 and b != x.strip().lower()])
    return F.when(exact, weight).when(near, half_up(F.lit(weight * NEARBY)).cast("int")).otherwise(0)


def budget_points(low: Column, high: Column, want: Wanted, weight: int = 15) -> Column:
    """Full where ranges overlap, up to half by closeness, 0 without a price."""
    if want.budget_min is None and want.budget_max is None:
        return F.lit(None).cast("int")
    p_low, p_high = F.coalesce(low, high).cast("double"), F.coalesce(high, low).cast("double")
    f_low, f_high = float(want.budget_min or 0), float("inf") if want.budget_max is None else float(want.budget_max)
    lo, hi = F.greatest(p_low, F.lit(f_low)), F.least(p_high, F.lit(f_high))
    gap = lo - hi
    span = F.coalesce(F.nullif(p_high - p_low, F.lit(0.0)), F.lit(1.0))
    reach = F.greatest(span, gap * 2 if f_high == float("inf") else F.lit(f_high - f_low), F.lit(1.0))
    near = half_up(weight * F.greatest(F.lit(0.0), 1 - gap / reach) * 0.5).cast("int")
    return F.when(p_low.isNull(), 0).when(hi >= lo, weight).otherwise(near)


def config_points(config: Column, configs: list[str], weight: int = 25) -> Column:
    """By substring, white space aside."""
    if not configs:
        return F.lit(None).cast("int")
    hay = F.regexp_replace(F.lower(F.coalesce(config, F.lit(""))), r"\s+", "")
    return F.when(_any(hay, ["".join(c.split()) for c in configs]), weight).otherwise(0)


def possession_points(year: Column, want: Wanted, weight: int = 20, close: float = CLOSE) -> Column:
    if want.year_min is None and want.year_max is None:
        return F.lit(None).cast("int")
    fits = (year <= want.year_max if want.year_max is not None else F.lit(False)) | (year >= want.year_min if want.year_min is not None else F.lit(False))
    target = want.year_max if want.year_max is not None else want.year_min
    return F.when(year.isNull(), 0).when(fits, weight).when(F.abs(year - target) <= 1, half_up(F.lit(weight * close)).cast("int")).otherwise(0)


def amenity_points(amenities: Column, wanted: list[str], weight: int = 10) -> Column:
    """The share of wanted ones that are there; null where nothing is known."""
    if not wanted:
        return F.lit(None).cast("int")
    hay = F.lower(F.array_join(amenities, " "))
    n = sum((F.when(F.contains(hay, F.lit(w.lower())), 1).otherwise(0) for w in wanted), F.lit(0))
    return F.when(F.coalesce(F.size(amenities), F.lit(0)) > 0, half_up(weight * n / len(wanted)).cast("int"))


def completeness_points(present: Column, of: int, weak: Column, weight: int = 10) -> Column:
    """By the share of fields that are filled, times 0.6 for cached or stale rows."""
    points = half_up(weight * present / of)
    return F.when(weak, half_up(points * 0.6)).otherwise(points).cast("int")


def total(parts: dict[str, Column], weights: dict[str, int], quality: Column, quality_weight: int = 10, *, round_up: bool = True) -> Column:
    """100 * (earned + quality) / (applicable + its weight); by quality alone if nothing was asked for."""
    rounded = half_up if round_up else lambda x: F.bround(x.cast("double"), 0)
    earned = sum((F.coalesce(p, F.lit(0)) for p in parts.values()), F.lit(0))
    applicable = sum((F.when(p.isNull(), 0).otherwise(weights[k]) for k, p in parts.items()), F.lit(0))
    score = F.when(applicable == 0, rounded(100.0 * quality / quality_weight)).otherwise(rounded(100.0 * (earned + quality) / (applicable + quality_weight)))
    return F.least(F.greatest(score.cast("int"), F.lit(0)), F.lit(100))


def capped_score(score: Column, *misses: Column, cap: int = 55) -> Column:
    """At most ``cap`` where something essential was asked for and missed."""
    miss = F.lit(False)
    for m in misses:
        miss = miss | F.coalesce(m, F.lit(False))
    return F.when(miss, F.least(score, F.lit(cap))).otherwise(score)


def catalog_score(projects: DataFrame, want: Wanted, as_of: Column, aliases: dict | None = None) -> DataFrame:
    """``projects`` (schema PROJECT) with points by part, ``score``, ``label`` and ``reasons``."""
    from quern.functions.scalar import possession_year

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    hay = F.lower(F.concat_ws(" ", text("location"), text("city"), text("nearby_locality"), text("name")))
    parts = {
        "budget": budget_points(F.col("budget_min_l"), F.col("budget_max_l"), want),
        "location": place_points(hay, want.locations or [], aliases=aliases),
        "config": config_points(F.col("config"), want.configs or []),
        "possession": possession_points(possession_year("possession", as_of, "possession_date"), want),
        "amenity": amenity_points(F.col("amenities"), want.amenities or []),
    }
    there = [text("rera") != "", F.coalesce(F.size("media"), F.lit(0)) > 0, F.length(text("description")) > 20, text("brochure_url") != "", text("developer") != "", text("possession_date") != ""]
    present = sum((F.when(x, 1).otherwise(0) for x in there), F.lit(0))
    complete = completeness_points(present, len(there), F.coalesce(F.col("from_cache"), F.lit(False)) | F.coalesce(F.col("stale"), F.lit(False)))
    out = projects.withColumns({f"pts_{k}": p for k, p in parts.items()} | {"pts_completeness": complete})
    own = {k: F.col(f"pts_{k}") for k in parts}
    score = total(own, WEIGHTS, F.col("pts_completeness"))
    out = out.withColumn("score", capped_score(score, own["location"] == 0)).withColumn("label", F.initcap(tier("score", "low match")))
    return out.withColumn("reasons", reasons(own))


# Sentences by part: full, partial, missed.
SENTENCES = {
    "location": ("Exact location match", "Nearby locality — not the exact requested locality", "Location does not match your selected area(s)"),
    "config": ("Requested configuration available", "Requested configuration available", "Requested configuration not listed"),
    "possession": ("Possession is within your requested window", "Possession is outside your preferred window (close)", "Possession is outside your requested window"),
    "budget": ("Budget fits your range", "Budget slightly outside range", "Budget outside your range"),
    "amenity": ("Requested amenities available", "Some requested amenities available", "Requested amenities not listed"),
}


def reasons(points: dict[str, Column]) -> Column:
    """Structured reasons of the parts that count: field, sentence, credit, points."""

    def one(k: str, p: Column) -> Column:
        full, some, none = SENTENCES[k]
        said = F.when(p >= WEIGHTS[k] * 0.99, full).when(p > 0, some).otherwise(none)
        credit = F.when(p >= WEIGHTS[k] * 0.99, "full").when(p > 0, "partial").otherwise("none")
        return F.when(p.isNotNull(), F.struct(F.lit(k).alias("field"), said.alias("reason"), credit.alias("credit"), p.cast("int").alias("points")))

    return F.array_compact(F.array(*(one(k, p) for k, p in points.items())))


def primary_reason(said: Column) -> Column:
    """The first reason about the place, else about the configuration, else the first."""
    place = F.filter(said, lambda r: r.rlike(r"(?i)\blocation\b|\blocality\b|\blocated\b|area\)"))
    config = F.filter(said, lambda r: r.rlike(r"(?i)\bBHK\b|\bconfiguration\b"))
    return F.coalesce(F.get(place, F.lit(0)), F.get(config, F.lit(0)), F.get(said, F.lit(0)))


def external_score(items: DataFrame, want: Wanted, as_of: Column, aliases: dict | None = None) -> DataFrame:
    """``items`` (schema EXTERNAL; budgets in currency) with ``confidence`` and ``tier``; wants: locations, bedrooms, budget_max, possession."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    hay = F.lower(F.concat_ws(" ", text("city"), text("location"), text("community"), text("name")))
    price = F.coalesce("budget_max", "budget_min")
    over = (price - F.lit(want.budget_max)) / F.lit(want.budget_max) if want.budget_max else None
    budget = F.lit(None).cast("int") if want.budget_max is None else F.when(price.isNull(), 0).when(over <= 0, 15).when(over <= 0.15, half_up(F.lit(7.5)).cast("int")).otherwise(0)
    bhk = bhk_number("configuration", "bedrooms")
    config = F.lit(None).cast("int") if want.bedrooms is None else F.when(bhk == want.bedrooms, 25).otherwise(0)
    said = F.lower(F.coalesce(F.nullif(F.col("handover_date"), F.lit("")), F.col("possession_date"), F.lit("")))
    if want.possession:
        year = F.regexp_extract(said, r"20\d\d", 0).try_cast("int")
        target = F.regexp_extract(F.lit(want.possession), r"20\d\d", 0).try_cast("int")
        ready = F.lit("ready" in want.possession.lower()) & said.contains("ready")
        possession = F.when(ready | (year == target), 20).when(F.abs(year - target) <= 1, half_up(F.lit(20 * 0.15)).cast("int")).otherwise(0)
    else:
        possession = F.lit(None).cast("int")
    age = age_days(F.try_to_timestamp("last_seen_at"), as_of)
    quality = F.when(F.col("source_quality") == "high", 0.80).when(F.col("source_quality") == "medium", 0.55).when(F.col("source_quality") == "low", 0.30).otherwise(0.45)
    quality = quality + F.when(age.isNull(), -0.15).when(age > 90, -0.25).when(age > 30, -0.10).otherwise(0.0)
    quality = quality + F.when(text("configuration") != "", 0.10).otherwise(0.0) + F.when(price.isNotNull(), 0.10).otherwise(0.0)
    quality = quality - F.when(F.lower(text("name")).rlike(r"\bmap\b|property rates|photos\s*&?\s*video|video tour|: overview"), 0.20).otherwise(0.0)
    parts = {"budget": budget, "location": place_points(hay, want.locations or [], aliases=aliases), "config": config, "possession": possession}
    out = items.withColumns({f"pts_{k}": p for k, p in parts.items()} | {"pts_quality": half_up(10 * F.least(F.greatest(F.round(quality, 9), F.lit(0.0)), F.lit(1.0))).cast("int")})
    own = {k: F.col(f"pts_{k}") for k in parts}
    score = capped_score(total(own, WEIGHTS, F.col("pts_quality")), own["location"] == 0, own["config"] == 0)
    return out.withColumn("confidence", score).withColumn("tier", tier("confidence"))


def client_filter(projects: DataFrame, want: Wanted, *, aliases: dict | None = None) -> DataFrame:
    """By place (any term or base name) and budget bucket; configuration and possession only score.

    An unpriced project is below any upper limit and above none.
    """
    out = projects
    if want.locations:
        hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("location", "city", "nearby_locality", "name"))))
        terms = [t for x in want.locations for t in (*expanded(x, aliases), " ".join(x.lower().split()[:-1]) if x.lower().split()[-1] in ("east", "west", "north", "south") else "")]
        out = out.where(_any(hay, [t for t in terms if t]))
    if want.budget_min or want.budget_max is not None:
        low, high = F.col("budget_min_l"), F.coalesce("budget_max_l", "budget_min_l")
        keep = F.lit(True)
        if want.budget_min:
            keep = keep & F.coalesce(high >= want.budget_min, F.lit(False))
        if want.budget_max is not None:
            keep = keep & F.coalesce(low < want.budget_max if not want.budget_min else low <= want.budget_max, F.lit(not want.budget_min))
        out = out.where(keep)
    return out


def index_filter(items: DataFrame, want: Wanted, *, config: str = "config", year: str = "possession_year") -> DataFrame:
    """The search index's filter: place match, budget ranges, any configuration, possession year."""
    out = items
    if want.locations:
        hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("city", "location", "nearby_locality", "name"))))
        out = out.where(_any(hay, want.locations))
    if want.budget_max is not None and not want.budget_min:
        out = out.where(F.col("budget_max_l") < want.budget_max)
    elif want.budget_min and want.budget_max is not None:
        out = out.where((F.col("budget_max_l") >= want.budget_min) & (F.col("budget_min_l") <= want.budget_max))
    elif want.budget_min:
        out = out.where(F.col("budget_max_l") >= want.budget_min)
    if want.configs:
        out = out.where(F.arrays_overlap(config, F.array(*map(F.lit, want.configs))))
    if want.year_max is not None:
        out = out.where(F.col(year) <= want.year_max)
    if want.year_min is not None:
        out = out.where(F.col(year) >= want.year_min)
    return out


def if_any(df: DataFrame, condition: Column, least: int = 1) -> DataFrame:
    """Rows that meet a condition if at least so many do, else all.

    One pass decides (a count), one filters: no window over the whole table.
    """
    n = df.agg(F.count_if(condition).alias("_n"))
    return df.crossJoin(F.broadcast(n)).where((F.col("_n") < least) | F.coalesce(condition, F.lit(False))).drop("_n")


def ranked(df: DataFrame, score: str, tie: str, n: int | None = None) -> DataFrame:
    """By score, then by tie; the top n as a distributed top-k."""
    out = df.orderBy(F.desc(score), F.asc(tie))
    return out if n is None else out.limit(n)


def tier_order(label: str) -> Column:
    return F.when(F.col(label).ilike("primary"), 0).when(F.col(label).ilike("secondary"), 1).when(F.col(label).ilike("tertiary"), 2).otherwise(3)


def by_bucket(df: DataFrame, label: str, score: str, name: str, most: int) -> DataFrame:
    """For each label its names by score, ``most`` at most (as a text), and how many there are."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(score), F.asc(name)))
    top = df.withColumn("_rank", rank).groupBy(label).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= most, F.struct("_rank", name)))).alias("_top"))
    return top.select(label, "n", F.array_join(F.transform("_top", lambda x: x[name].cast("string")), ",").alias("names"))


def _tagged(values: Column, facet: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))


def facets(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(facet, value, n): the most frequent values of each column (arrays are exploded), ties by value.

    One pass: each row gives its facets' values, counted together.
    """
    pairs = []
    for c in columns:
        values = F.col(c).cast("array<string>") if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("string"))
        pairs.append(_tagged(values, c))
    counts = df.select(F.explode(F.concat(*pairs)).alias("p")).where("p.value IS NOT NULL").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))
    most = F.create_map(*(F.lit(x) for p in columns.items() for x in p))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= F.element_at(most, F.col("facet"))).drop("_rank")


def interval_facets(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(upto, n, cumulative): rows below each edge and from the last on, with running sums."""
    place = F.lit(0)
    for e in edges:
        place = place + F.when(value >= e, 1).otherwise(0)
    counts = df.where(value.isNotNull()).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(k,) for k in range(len(edges) + 1)], "bucket int")
    out = grid.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return out.withColumn("cumulative", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))  # one row per edge


def suggest_weights(df: DataFrame, kinds: dict[str, str], aliases: DataFrame | None = None) -> DataFrame:
    """(type, name, weight): how many rows stand behind each value of each column; an alias takes its parent's."""
    pairs = F.array(*(F.struct(F.lit(k).alias("type"), F.col(c).cast("string").alias("name")) for c, k in kinds.items()))
    counts = df.select(F.explode(pairs).alias("p")).where("p.name IS NOT NULL AND p.name <> ''").groupBy("p.type", F.lower("p.name").alias("_key")).agg(F.min("p.name").alias("name"), F.count("*").alias("weight"))
    if aliases is not None:
        own = aliases.select(F.lit("LOCALITY").alias("type"), F.lower("canonical").alias("_key"), F.col("canonical").alias("name"), F.lower("parent").alias("_parent")).dropDuplicates(["_key"])
        new = own.join(counts, ["type", "_key"], "left_anti")
        parents = counts.where("type = 'LOCALITY'").select(F.col("_key").alias("_parent"), "weight")
        counts = counts.unionByName(new.join(parents, "_parent", "left").select("type", "_key", "name", F.coalesce("weight", F.lit(0).cast("long")).alias("weight")))
    return counts.select("type", "name", "weight")


def suggest(rows: DataFrame, name: str, typed: str, n: int = 8) -> DataFrame:
    """Names with the typed text: exact, then prefix, then inside; shorter first."""
    t = typed.strip().lower()
    low = F.lower(name)
    rank = F.when(low == t, 0).when(F.startswith(low, F.lit(t)), 1).when(F.contains(low, F.lit(t)), 2)
    return rows.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", F.length(name), name).limit(n)


def suggest_by_weight(rows: DataFrame, typed: str, n: int = 10) -> DataFrame:
    """By weight; at least two characters."""
    t = typed.strip().lower()
    if len(t) < 2:
        return rows.limit(0)
    return rows.where(F.contains(F.lower("name"), F.lit(t))).orderBy(F.desc("weight"), "name").limit(n)


def synonym_join(rows: DataFrame, term: str, groups: DataFrame) -> DataFrame:
    """Rows by all terms of their term's group (``groups``: group, term)."""
    g = groups.select(F.col("group").alias("_g"), F.lower("term").alias("_t"))
    pairs = g.alias("a").join(g.alias("b"), "_g").select(F.col("a._t").alias("_from"), F.col("b._t").alias("synonym")).distinct()
    return rows.join(pairs, F.lower(term) == F.col("_from")).drop("_from")


def neighbours(edges: DataFrame, place: str, n: int = 8) -> DataFrame:
    """The first n neighbours of each place of an adjacency table (src, dst, pos)."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst"))
    return edges.where(F.lower("src") == place.lower()).withColumn("_r", rank).where(F.col("_r") <= n).select("src", "dst", "pos")


def text_search(docs: DataFrame, key: str, text: str, query: str, n: int = 20) -> DataFrame:
    """Top n by the sum of inverse document frequencies of the query's words in a text (ties by key).

    The reference leaves relevance to a service; this is our own, stated score.
    Texts are matched by word, once each; frequencies come from the same pass.
    """
    import re

    words = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    if not words:
        return docs.limit(0).select(key, F.lit(0.0).alias("score"))
    own = docs.select(key, F.array_intersect(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), F.array(*map(F.lit, words))).alias("_w"))
    stats = own.agg(F.count("*").alias("_n"), *(F.count_if(F.array_contains("_w", w)).alias(f"_df{k}") for k, w in enumerate(words)))
    score = sum((F.when(F.array_contains("_w", w), F.log1p(F.col("_n") / F.greatest(F.col(f"_df{k}"), F.lit(1)))).otherwise(0.0) for k, w in enumerate(words)), F.lit(0.0))
    return own.where(F.size("_w") > 0).crossJoin(F.broadcast(stats)).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(n)


def normalized_projects(raw: DataFrame) -> DataFrame:
    """Catalog rows (rupees, nested inventory) to PROJECT: lakhs, ranges over the inventory, defaults."""
    units = F.col("inventory")
    prices = F.filter(F.transform(units, lambda u: u["price"].cast("double")), lambda p: p > 0)
    return raw.select(
        F.col("id").cast("string").alias("id"),
        clean("name").alias("name"),
        clean("location").alias("location"),
        clean("city").alias("city"),
        F.array_join(F.array_distinct(F.transform(units, lambda u: u["type"])), ", ").alias("config"),
        half_up(F.array_min(prices) / 1e5).alias("budget_min_l"),
        half_up(F.array_max(prices) / 1e5).alias("budget_max_l"),
        F.coalesce(F.nullif(F.col("developer"), F.lit("")), F.lit("Unknown Developer")).alias("developer"),
        F.aggregate(units, F.lit(0).cast("long"), lambda a, u: a + F.coalesce(u["available"], F.lit(0))).alias("available"),
        units.alias("inventory"),
    )


