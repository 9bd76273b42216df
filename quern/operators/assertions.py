"""Rules of data quality over searches and the properties that they returned, rolled up by rule and market.

``RULES`` is a table: each rule says of a property (a struct of the array ``properties``)
and its search whether it holds; null means that it does not apply. A search's
properties are exploded once with all their verdicts, and counted in each task.

Defined results: null or empty arrays of properties have only the rule of the search
itself; a null field is no value; rows repeat as searches do; duplicates are later
properties of one search (by place in the array) with a registration, or a name
and place, that an earlier one has, each counted for itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import candidate_reason
from quern.functions.scalar import alnum_key, rera_valid

# Lifecycles that a search must not return; kinds that contradict a search for rooms; states of the ledger.
DISALLOWED = ["RESALE", "RENTAL", "READY_TO_MOVE"]
NO_ROOMS = ["villa", "plot", "land", "bungalow"]
FILLED, NOT_FOUND = "filled", ["searched_not_found", "never_researched"]


def _some(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def _locality(p: Column, asked: Column, terms: list[str]) -> Column:
    named = F.filter(F.array(*(F.lit(t.lower()) for t in terms)).cast("array<string>"), lambda t: F.contains(F.lower(asked), t))
    hay = F.lower(F.concat_ws(" ", p["location"], p["city"], p["name"]))
    return F.when(F.size(named) > 0, F.exists(named, lambda t: F.contains(hay, t)))


def _atomic(p: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(p["config"], F.lit("")), "[&,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.size(F.array_distinct(parts)) == F.size(parts)


def _price(p: Column) -> Column:
    shown = F.coalesce(p["price"], F.lit(""))
    numbers = F.transform(F.regexp_extract_all(shown, F.lit(r"[\d,.]+"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    turned = F.contains(shown, F.lit("-")) & (F.get(numbers, 0) > F.get(numbers, 1))
    return ~F.trim(shown).isin("₹", "0", "NaN") & ~F.coalesce(turned, F.lit(False))


def _placed(p: Column) -> Column:
    def at(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0)) != 0

    return F.when(_some(p["nearby_landmarks"]) | _some(p["connectivity"]), at(p["lat"]) | at(p["lon"]))


#: Rules of one property: (property, what was asked, place names) to a verdict.
RULES: dict[str, Callable[[Column, Column, list[str]], Column]] = {
    "V2 locality": _locality,
    "V3 lifecycle": lambda p, q, t: ~F.coalesce(p["lifecycle_status"].isin(DISALLOWED), F.lit(False)),
    "V4 name": lambda p, q, t: candidate_reason(p["name"]).isNull(),
    "V5 registration": lambda p, q, t: F.when(_some(p["rera"]), rera_valid(p["rera"])),
    "V6 configuration": lambda p, q, t: _atomic(p),
    "V7 kind": lambda p, q, t: F.when(_some(p["property_type"]), ~(q.rlike(r"(?i)\d\s*bhk|studio") & F.lower(p["property_type"]).isin(NO_ROOMS))),
    "V8 price": lambda p, q, t: _price(p),
    "V9 place": lambda p, q, t: _placed(p),
}


def assertions(searches: DataFrame, terms: list[str] = (), market: str = "market") -> DataFrame:
    """``(market, rule, passed, failed)`` of searches (run, market, query, pipeline, http_status, properties)."""
    own = searches.select("run", F.col(market).alias("market"), "query", (F.col("pipeline").eqNullSafe(F.lit("agent")) & (F.col("http_status") == 200)).alias("_valid"), "properties")
    run_rule = own.select("market", F.lit("V1 answer").alias("rule"), F.coalesce("_valid", F.lit(False)).cast("long").alias("p"), (~F.coalesce("_valid", F.lit(False))).cast("long").alias("f"))
    each = own.select("run", "market", "query", F.posexplode("properties").alias("pos", "x"))
    x, asked = F.col("x"), F.coalesce("query", F.lit(""))
    verdicts = F.array(*(F.struct(F.lit(r).alias("rule"), rule(x, asked, list(terms)).alias("ok")) for r, rule in RULES.items()))
    single = each.select("market", F.explode(verdicts).alias("v")).where("v.ok IS NOT NULL").select("market", "v.rule", F.col("v.ok").cast("long").alias("p"), (~F.col("v.ok")).cast("long").alias("f"))
    # The first property: panels that are filled, and the states of its ledger.
    top = each.where("pos = 0")
    panels = F.coalesce(x["panels"], F.array().cast("array<boolean>"))
    full = F.size(F.filter(panels, lambda b: F.coalesce(b, F.lit(False)))).cast("long")
    states = F.map_values(F.coalesce(x["ledger"], F.create_map().cast("map<string,string>")))
    counted = lambda some: F.size(F.filter(states, lambda s: s.isin(some))).cast("long")
    tops = top.select("market", F.explode(F.array(F.struct(F.lit("V10 panels").alias("rule"), full.alias("p"), (F.size(panels) - full).alias("f")), F.struct(F.lit("V11 ledger").alias("rule"), counted([FILLED]).alias("p"), counted(NOT_FOUND).alias("f")))).alias("v")).select("market", "v.*")
    seen = each.select("run", "market", "pos", x["rera"].alias("rera"), F.concat_ws("::", alnum_key(x["name"]), alnum_key(x["location"])).alias("key"))
    again = lambda *by: F.row_number().over(Window.partitionBy("run", *by).orderBy("pos")) > 1
    twice = seen.select("market", (_some(F.col("rera")) & again("rera")).cast("long").alias("a"), again("key").cast("long").alias("b"))
    twice = twice.select("market", F.lit("V12 duplicates").alias("rule"), (1 - F.col("a") - F.col("b")).alias("p"), (F.col("a") + F.col("b")).alias("f"))
    every = run_rule.unionByName(single).unionByName(tops).unionByName(twice)
    return every.groupBy("market", "rule").agg(F.sum("p").alias("passed"), F.sum("f").alias("failed"))
