"""Snapshots, caches, seeds and JSON stores; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; bad rows become nulls and are dropped."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt IS NULL").drop("_corrupt")


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``rows`` with a JSON text column parsed; rows that do not parse go."""
    out = rows.withColumn(column, F.from_json(column, schema))
    return out.where(F.col(column).isNotNull())


def json_field(column: str, path: str) -> Column:
    return F.get_json_object(column, path)


def latest_snapshot(snapshots: DataFrame, order: str, items: str) -> DataFrame:
    """The items (an array) of the newest snapshot, as rows."""
    return snapshots.orderBy(F.desc(order)).limit(1).select(F.explode(items).alias("item")).select("item.*")


def better_seed(current: DataFrame, seed: DataFrame, rera: str = "rera") -> DataFrame:
    """The seed where the current catalog is weak: under 0.6 of its rows or half its registered rows."""

    def numbers(df: DataFrame) -> tuple[int, int]:
        return tuple(df.agg(F.count("*"), F.count_if(F.coalesce(F.col(rera), F.lit("")) != "")).first())

    (n, r), (seed_n, seed_r) = numbers(current), numbers(seed)
    return seed if n < 0.6 * seed_n or r < 0.5 * seed_r else current


def best_snapshot(stats: DataFrame, n: str = "n", rera: str = "n_rera", key: str = "id") -> DataFrame:
    """The snapshot with most rows, then most registered rows."""
    return stats.agg(F.max_by(F.struct(*stats.columns), F.struct(n, rera, key)).alias("s")).select("s.*")


def guarded_refresh(old: DataFrame, new: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """The old catalog if it has ``least`` rows and the new one under ``share`` of them."""
    n_old, n_new = old.count(), new.count()
    return old if n_old >= least and n_new < share * n_old else new


def fresh(cache: DataFrame, at: str, as_of: Column, hours: float) -> DataFrame:
    """Cache rows within their time to live; ``stale`` marks what a last-good read may still serve."""
    return cache.withColumn("stale", F.unix_timestamp(at) < F.unix_timestamp(as_of) - F.lit(int(hours * 3600)))


def first_source(parts: list[DataFrame], key: str) -> DataFrame:
    """For each key the row of the first source that has it."""
    out = None
    for k, df in enumerate(parts):
        tagged = df.withColumn("_prio", F.lit(k))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    names = [c for c in out.columns if c not in (key, "_prio")]
    best = out.groupBy(key).agg(F.min_by(F.struct(*names), "_prio").alias("_r"), F.min("_prio").alias("source_rank"))
    return best.select(key, "_r.*", "source_rank")


def fallback(primary: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of the primary source, and of the second what the first has not."""
    return primary.unionByName(second.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def append(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def upload_batches(df: DataFrame, path: str, rows: int = 1000) -> None:
    """JSON files of at most so many rows, as an index takes them."""
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").json(path)


def empty_source(spark: SparkSession, schema: str) -> DataFrame:
    """A connector that is not configured."""
    return spark.createDataFrame([], schema)


def register_check(rows: DataFrame, register: DataFrame, code: str = "rera") -> DataFrame:
    """``rows`` with the registered name and promoter of their number, and whether the number is there."""
    known = register.select(F.upper("code").alias("_code"), F.col("name").alias("registered_name"), F.col("promoter")).dropDuplicates(["_code"])
    return rows.join(known, F.upper(F.trim(F.col(code))) == F.col("_code"), "left").withColumn("registered", F.col("_code").isNotNull()).drop("_code")
