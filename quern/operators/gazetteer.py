"""Place names: dimension tables, look-ups with priority, near misses."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.schemas import GAZETTEER_ALIAS, GAZETTEER_LOCALITY


def read_gazetteer(spark: SparkSession, path: str, market: str) -> tuple[DataFrame, DataFrame]:
    """(localities, aliases) of a JSON file ``{cities: {city: [locality]}, aliases: {alias: entry or [entry]}}``.

    An alias of several entries becomes rows with ``seq``.
    """
    import json

    data = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one dimension file
    places = [(name, city, market) for city, names in data.get("cities", {}).items() for name in names]
    aliases = [(a.lower(), k, e.get("canonical"), e.get("parent"), e.get("city"), market) for a, x in data.get("aliases", {}).items() for k, e in enumerate(x if isinstance(x, list) else [x])]
    return spark.createDataFrame(places, GAZETTEER_LOCALITY), spark.createDataFrame(aliases, GAZETTEER_ALIAS)


def resolve_terms(terms: DataFrame, localities: DataFrame, aliases: DataFrame, market: str, term: str = "term") -> DataFrame:
    """``terms`` with ``canonical, parent, city, is_micro_alias, alternatives``: alias first, then locality; the own market first."""
    own = F.when(F.col("market") == market, 0).otherwise(1)
    entry = F.struct("canonical", "parent", "city")
    alias = aliases.groupBy("alias", "market").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))), lambda x: x["e"]).alias("_entries"))
    alias = alias.groupBy(F.col("alias").alias("_a")).agg(F.min_by("_entries", F.struct(own, "market")).alias("_entries"), F.min(own).alias("_ao"))
    place = localities.groupBy(F.lower("name").alias("_l")).agg(F.min_by("city", F.struct(own, "market")).alias("_city"), F.min(own).alias("_lo"))
    key = F.lower(F.trim(F.col(term)))
    out = terms.join(alias, key == F.col("_a"), "left").join(place, key == F.col("_l"), "left")
    use = F.col("_entries").isNotNull() & (F.col("_lo").isNull() | (F.col("_ao") <= F.col("_lo")))
    first = F.get("_entries", F.lit(0))
    return out.select(
        *terms.columns,
        F.when(use, first["canonical"]).otherwise(F.col(term)).alias("canonical"),
        F.when(use, first["parent"]).alias("parent"),
        F.when(use, first["city"]).otherwise(F.col("_city")).alias("city"),
        use.alias("is_micro_alias"),
        F.when(use, F.slice("_entries", 2, F.greatest(F.size("_entries") - 1, F.lit(1)))).alias("alternatives"),
        (F.col("_a").isNotNull() | F.col("_l").isNotNull()).alias("known"),
    )


# Names that differ in one of these are other places.
DIRECTIONS = ["east", "west", "north", "south"]


def _grams(s: Column, size: int) -> Column:
    """Parts of ``size`` characters, each with the number of its kind so far: equal ones count apart."""
    parts = F.when(F.length(s) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - size + 1, F.lit(1))), lambda k: F.substring(s, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.transform(parts, lambda x, k: F.concat(x, F.size(F.filter(F.slice(parts, 1, k + 1), lambda y: y == x)).cast("string")))


def _rarest(words: DataFrame, often: DataFrame, cutoff: float) -> DataFrame:
    """(w, n, gram): as many of a word's rarest pairs of characters as one of them has to be shared by any word that is similar enough.

    With M characters matched, in at most 1 + (a - M) + (b - M) blocks, 3 M - a - b - 1
    neighbouring pairs are shared; M is at least cutoff / 2 of both lengths together,
    and b at least cutoff / (2 - cutoff) of a.
    """
    grams = words.select("w", F.length("w").alias("n"), F.explode(_grams(F.col("w"), 2)).alias("gram")).join(often, "gram", "left")
    shared = F.greatest(F.lit(1), F.ceil((1.5 * cutoff - 1) * F.col("n") * (1 + cutoff / (2 - cutoff)) - 1 - 1e-9))
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.coalesce("often", F.lit(0)), "gram"))
    return grams.withColumn("_r", place).where(F.col("_r") <= F.col("n") - 1 - shared + 1).select("w", "n", "gram")


def near_pairs(terms: DataFrame, names: DataFrame, cutoff: float = 0.86) -> DataFrame:
    """``(term, name)`` that can reach the cutoff: they share a rare pair of characters, and enough characters at all."""
    often = names.select(F.explode(_grams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    a, b = (_rarest(x, often, cutoff).select("gram", F.col("w").alias(w), F.col("n").alias(n)) for x, w, n in ((terms, "term", "a"), (names, "name", "b")))
    close = 2 * F.least("a", "b") >= cutoff * (F.col("a") + F.col("b")) - 1e-9
    pairs = a.join(b, "gram").where(close).select("term", "name").distinct()
    both = F.size(F.array_intersect(_grams(F.col("term"), 1), _grams(F.col("name"), 1)))
    return pairs.where(2 * both >= cutoff * (F.length("term") + F.length("name")) - 1e-9)


@F.pandas_udf(T.DoubleType())
def similarity(terms: pd.Series, names: pd.Series) -> pd.Series:
    """The difflib ratio of each name and term."""
    out, matcher = [], difflib.SequenceMatcher()
    for term, name in zip(terms, names, strict=True):
        matcher.set_seqs(name, term)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def near_misses(terms: DataFrame, names: DataFrame, *, term: str = "term", name: str = "name", cutoff: float = 0.86, least: int = 5) -> DataFrame:
    """``(term, match, ratio)``: of each distinct term, in lower case, the most similar name, if that is near enough and may be meant.

    Terms of fewer than ``least`` characters and terms that are names have none. The
    most similar name (the last by alphabet of equal ones) has to have the same
    direction, and a word in common or the same first four letters. Null terms and
    names are left out; rows that repeat count once.
    """
    own = names.select(F.lower(F.trim(F.col(f"`{name}`"))).alias("w")).where("w <> ''").distinct()
    asked = terms.select(F.lower(F.trim(F.col(f"`{term}`"))).alias("w")).where(F.length("w") >= least).distinct().join(own, "w", "left_anti")
    rated = near_pairs(asked, own, cutoff).withColumn("ratio", similarity("term", "name")).where(F.col("ratio") >= cutoff)
    best = rated.groupBy("term").agg(F.max(F.struct("ratio", "name")).alias("b")).select("term", F.col("b.name").alias("match"), F.col("b.ratio").alias("ratio"))
    a, b = (F.split(F.col(c), r"\s+") for c in ("term", "match"))
    way = lambda x: F.coalesce(F.get(F.filter(x, lambda y: y.isin(DIRECTIONS)), 0), F.lit(""))
    stem = F.startswith(a[0], F.substring(b[0], 1, 4)) | F.startswith(b[0], F.substring(a[0], 1, 4))
    return best.where((way(a) == way(b)) & (F.arrays_overlap(a, b) | stem))


def city_of(location: Column, localities: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, city): the city of the first part of a comma list that is a known locality."""
    parts = rows.select(key, F.posexplode(F.split(location, r"\s*,\s*")).alias("_pos", "_part"))
    known = localities.select(F.lower("name").alias("_n"), F.col("city")).dropDuplicates(["_n"])
    return parts.join(known, F.lower(F.trim("_part")) == F.col("_n")).groupBy(key).agg(F.min_by("city", "_pos").alias("city"))
