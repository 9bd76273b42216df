"""Walks over JSON of unknown shape, level by level.

A document becomes a VARIANT; ``variant_explode`` gives the children of all
objects and arrays of a level at once, and the next level is a table of its own
(the frontier), written and read again. So the depth of a document is a number of
steps of the job, not a recursion of a worker, and a level's rows are spread like
any others.

A node's ``path`` is the array of its places on the way down, so the order of paths
is that of a walk in depth first. An object's keys are in alphabetical order, as
VARIANT keeps them; where "the first" of two values counts, that is the order.

Defined results: null and malformed JSON has no nodes; repeated rows have equal
nodes each; nodes deeper than ``most`` are left out; an empty table has no levels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import clean
from quern.sources.shared import written

# Kinds of schema.org nodes that say something of a property, and unit codes of quantities.
PROPERTY_KINDS = [
    "residence", "apartment", "apartmentcomplex", "singlefamilyresidence", "house", "product", "place", "realestatelisting", "accommodation", "offer", "aggregateoffer", "localbusiness", "realestateagent",
]
SQ_FT = ["sqft", "ft2", "foot", "square foot", "square feet", "sq ft", "fte"]
SQ_M = ["mtk", "sqm", "m2", "square metre", "square meter"]
#: Names of project-like objects in scraped page states.
PROJECT_NAMES = ["projectName", "ProjectName", "name", "project_name"]


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return kind_of(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return kind_of(v).startswith("ARRAY")


def at(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def text_of(v: Column, depth: int = 2) -> Column:
    """A string, a number, the first such of a list, or an object's ``@value, name, value, text``; to a depth."""
    kind, s = kind_of(v), F.try_variant_get(v, "$", "string")
    out = F.when(kind == "STRING", F.nullif(clean(s), F.lit(""))).when(kind.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), s)
    if depth:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: text_of(x, depth - 1))
        out = out.when(is_array(v), F.get(F.filter(items, lambda x: x.isNotNull()), 0))
        out = out.when(is_object(v), F.coalesce(*(text_of(at(v, k), depth - 1) for k in ("@value", "name", "value", "text"))))
    return out


def quantity_of(v: Column) -> Column:
    """A QuantitativeValue as "650 sq ft", else its text."""
    number = F.coalesce(at(v, "value", "string"), at(v, "@value", "string"))
    unit = F.coalesce(text_of(at(v, "unitText"), 0), text_of(at(v, "unitCode"), 0), F.lit(""))
    shown = F.when(F.lower(unit).isin(SQ_FT), "sq ft").when(F.lower(unit).isin(SQ_M), "sq m").otherwise(unit)
    return F.when(is_object(v) & number.isNotNull(), clean(F.concat_ws(" ", number, shown))).otherwise(text_of(v, 1))


def walk(docs: DataFrame, id_col: str, json_col: str, descend: Callable[[Column], Column], most: int) -> list[DataFrame]:
    """Levels (id, path, v) of objects and arrays, from the outside in; the children of those that ``descend`` go on."""
    spark = docs.sparkSession
    levels = [docs.select(F.col(f"`{id_col}`").alias("id"), F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(f"`{json_col}`").cast("string")).alias("v"))]
    levels[0] = written(levels[0].where(is_object(F.col("v")) | is_array(F.col("v"))), "json-0")
    for depth in range(1, most + 1):
        inner = levels[-1].where(descend(F.col("v"))).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        inner = inner.select("id", F.array_append("path", F.col("pos")).alias("path"), F.col("value").alias("v"))
        level = written(inner.where(is_object(F.col("v")) | is_array(F.col("v"))), f"json-{depth}")
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def nodes(docs: DataFrame, *, id_col: str, json_col: str, most: int = 8) -> DataFrame:
    """``(id, path, node)``: all objects of each document down to a depth."""
    levels = walk(docs, id_col, json_col, lambda v: F.lit(True), most)
    return reduce(DataFrame.unionByName, levels).where(is_object(F.col("v"))).withColumnRenamed("v", "node")


def _kinds(node: Column) -> Column:
    raw = F.coalesce(at(node, "@type"), at(node, "type"))
    listed = F.when(is_array(raw), F.try_variant_get(raw, "$", "array<string>")).otherwise(F.array(F.try_variant_get(raw, "$", "string")))
    return F.transform(F.filter(listed, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(F.element_at(F.split(x, "/"), -1))))


def structured_facts(docs: DataFrame, *, id_col: str, json_col: str) -> DataFrame:
    """``(id, field, value)`` of JSON-LD: of each field the first value on the walk.

    Nodes of no known kind count only where a document has none of a known kind.
    Offers tell a price only.
    """
    node = F.col("node")
    found = written(nodes(docs, id_col=id_col, json_col=json_col).withColumn("kinds", _kinds(node)), "json-nodes")
    known = F.arrays_overlap("kinds", F.array(*map(F.lit, PROPERTY_KINDS)))
    known = F.coalesce(known, F.lit(False))
    some = found.groupBy(F.col("id").alias("_of")).agg(F.max(known).alias("_some"))
    found = found.join(some, F.col("id").eqNullSafe(F.col("_of"))).where(known | ~F.col("_some"))
    low, high = F.coalesce(text_of(at(node, "lowPrice"), 0), text_of(at(node, "price"), 0)), text_of(at(node, "highPrice"), 0)
    offered = F.array(F.struct(F.lit("price").alias("field"), F.when(high.isNotNull(), F.concat(low, F.lit(" - "), high)).otherwise(low).alias("value")))
    address, geo = at(node, "address"), at(node, "geo")
    place = F.when(is_object(address), F.coalesce(*(text_of(at(address, k), 1) for k in ("addressLocality", "addressRegion", "streetAddress")))).otherwise(text_of(address, 1))
    spot = is_object(geo) & at(geo, "latitude").isNotNull() & at(geo, "longitude").isNotNull()
    raw = F.coalesce(at(node, "amenityFeature"), at(node, "amenities"))
    items = F.when(is_array(raw), F.try_variant_get(raw, "$", "array<variant>")).otherwise(F.array(raw))
    absent = lambda x: is_object(x) & F.coalesce(~at(x, "value", "boolean"), F.lit(False))
    named = F.filter(F.transform(F.filter(items, lambda x: ~F.coalesce(absent(x), F.lit(False))), lambda x: F.coalesce(text_of(at(x, "name"), 0), text_of(x, 1))), lambda x: x.isNotNull())
    description = text_of(at(node, "description"), 1)
    values = {
        "project_name": text_of(at(node, "name")),
        "location": place,
        "latitude": F.when(spot, text_of(at(geo, "latitude"), 0)),
        "longitude": F.when(spot, text_of(at(geo, "longitude"), 0)),
        "carpet_area": quantity_of(at(node, "floorSize")),
        "built_up_area": quantity_of(at(node, "builtUpArea")),
        "configuration": quantity_of(F.coalesce(at(node, "numberOfBedrooms"), at(node, "numberOfRooms"))),
        "total_floors": text_of(F.coalesce(at(node, "numberOfFloors"), at(node, "floorLevel")), 1),
        "price": text_of(F.coalesce(at(node, "price"), at(node, "priceRange")), 1),
        "amenities": F.nullif(F.array_join(F.array_distinct(named), "; "), F.lit("")),
        "developer": F.coalesce(*(text_of(at(node, k)) for k in ("brand", "provider", "author", "developer", "builder"))),
        "description": F.when(F.length(description) > 40, description),
    }
    told = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()))
    is_offer = F.arrays_overlap("kinds", F.array(F.lit("offer"), F.lit("aggregateoffer")))
    rows = found.select("id", "path", F.inline(F.when(F.coalesce(is_offer, F.lit(False)), offered).otherwise(told))).where("value is not null")
    return rows.groupBy("id", "field").agg(F.min_by("value", "path").alias("value"))


def project_objects(docs: DataFrame, *, id_col: str, json_col: str, most: int = 10) -> DataFrame:
    """``(id, path, name, item)``: items of arrays whose first item has a project's name, with names of three characters or more.

    Such an array is not looked into any further.
    """
    def name_of(v: Column) -> Column:
        return F.coalesce(*(F.nullif(at(v, k, "string"), F.lit("")) for k in PROJECT_NAMES))

    def listed(v: Column) -> Column:
        return is_array(v) & F.coalesce(is_object(F.try_variant_get(v, "$[0]", "variant")) & name_of(F.try_variant_get(v, "$[0]", "variant")).isNotNull(), F.lit(False))

    levels = walk(docs, id_col, json_col, lambda v: ~listed(v), most)
    arrays = reduce(DataFrame.unionByName, levels).where(listed(F.col("v")))
    items = arrays.select("id", "path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "node"))
    return items.select("id", F.array_append("path", F.col("pos")).alias("path"), clean(name_of(F.col("node"))).alias("name"), F.to_json("node").alias("item")).where(F.length("name") >= 3)
