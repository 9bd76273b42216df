"""Keyed state as relations: latest, retention, merges, flags, audits, anti joins.

Everything that is "the n newest per key" is a ranked window (Spark keeps only
n rows per key and task before the shuffle); everything that is "the first value
per key" is one aggregation with map-side combine, without a sort.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(columns: Iterable[str]) -> Column:
    return F.struct(*columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest ``order``: last write wins."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of equal keys, the latest of them; columns that one side lacks are null."""
    both = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, ["_side", *order]).drop("_side")


def retain_newest(df: DataFrame, n: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The n newest rows (of each key)."""
    if not keys:
        return df.orderBy(*(F.desc(c) for c in order)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def pruned(df: DataFrame, n: int, order: list[str], key: str) -> DataFrame:
    """What ``retain_newest`` leaves out: an anti join with the newest n."""
    return df.join(retain_newest(df, n, order).select(key), key, "left_anti")


def first_values(df: DataFrame, keys: list[str], fields: list[str], order: list[str], *extra: Column) -> DataFrame:
    """The first non-empty value of each field in ``order``, and other aggregates, by key."""
    at = order_key(order)
    values = [F.min_by(f, F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", at)).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*values, *extra)


def duplicate_flags(df: DataFrame, keys: list[str], order: list[str], flag: str = "is_duplicate") -> DataFrame:
    """0 for the first row of a key, 1 for the others."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(flag, F.when(rank > 1, 1).otherwise(0))


def insert_ignore(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = df.where(F.col(key).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return keyed.unionByName(df.where(F.col(key).isNull()))


def counts_of(df: DataFrame, column: str, vocabulary: list[str], name: str = "n") -> DataFrame:
    """Rows of each word of a vocabulary, 0 where there is none."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{column} string")
    found = df.groupBy(column).agg(F.count("*").alias(name))
    return words.join(found, column, "left").select(column, F.coalesce(name, F.lit(0).cast("long")).alias(name))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of every changed field; '' is null, unchanged ones are left out."""

    def text(side: str, f: str) -> Column:
        return F.nullif(F.col(f"{side}.{f}").cast("string"), F.lit(""))

    pairs = F.array(*(F.struct(F.lit(f).alias("field"), text("a", f).alias("old_value"), text("b", f).alias("new_value")) for f in fields))
    joined = before.alias("a").join(after.alias("b"), key).select(key, F.explode(pairs).alias("c"))
    return joined.select(key, "c.field", "c.old_value", "c.new_value").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def update_fields(current: DataFrame, edits: DataFrame, key: str, allowed: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(updated rows, audit rows) of edits (key, field, value); other fields than ``allowed`` are ignored, '' sets null.

    Of several edits of a field the last by ``order`` counts, of equal ones the largest value.
    """
    wanted = edits.where(F.col("field").isin(allowed)).groupBy(key).pivot("field", allowed).agg(F.max_by(F.struct(F.nullif(F.col("value"), F.lit("")).alias("v")), F.struct(order, "value")))
    wanted = wanted.select(key, *(F.col(f).alias(f"_new_{f}") for f in allowed))
    after = current.join(wanted, key, "left")
    for f in allowed:
        if f in current.columns:
            after = after.withColumn(f, F.when(F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}.v").cast(current.schema[f].dataType)).otherwise(F.col(f)))
    after = after.select(*current.columns)
    return after, changed_fields(current, after, key, [f for f in allowed if f in current.columns])


def delete_cascade(ids: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of these keys."""
    return [t.join(ids.select(key).distinct(), key, "left_anti") for t in tables]


def adopt_orphans(events: DataFrame, leads: DataFrame, *, phone: str = "phone", lead: str = "lead_id", lead_key: str = "id") -> DataFrame:
    """Events without a lead get the smallest lead of their phone, if there is one."""
    own = leads.where(F.col(phone).isNotNull()).groupBy(phone).agg(F.min(lead_key).alias("_own"))
    return events.join(own, phone, "left").withColumn(lead, F.coalesce(lead, "_own")).drop("_own").select(*events.columns)


def not_sent(rows: DataFrame, log: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Rows whose keys have no success in the log."""
    return rows.join(log.where(ok).select(*keys).distinct(), keys, "left_anti")


def last_runs(runs: DataFrame, key: str, order: str, status: str = "status") -> DataFrame:
    """By key: the last run, the last success and the last failure (their ``order``), and the five newest."""
    newest = F.slice(F.sort_array(F.collect_list(F.when(F.col("_rank") <= 5, F.col(order))), asc=False), 1, 5)
    ranked = runs.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.groupBy(key).agg(
        F.max(order).alias("last"),
        F.max(F.when(F.col(status) == "success", F.col(order))).alias("last_success"),
        F.max(F.when(F.col(status) == "failure", F.col(order))).alias("last_failure"),
        F.array_join(newest.cast("array<string>"), ",").alias("recent"),
    )


def exists_flags(left: DataFrame, events: DataFrame, left_key: str, event_key: str, flags: dict[str, Column]) -> DataFrame:
    """A 0/1 column for each condition: whether any event of the row's key meets it.

    One aggregation of the events carries all flags, instead of a semi join each.
    """
    found = events.groupBy(F.col(event_key).alias("_key")).agg(*(F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()))
    out = left.join(found, F.col(left_key) == F.col("_key"), "left").drop("_key")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in flags})


def activity(events: DataFrame, key: str, at: str, groups: dict[str, Column]) -> DataFrame:
    """By key and group: whether it happened, and when last."""
    columns = []
    for name, condition in groups.items():
        last = F.max(F.when(condition, F.col(at)))
        columns += [last.isNotNull().alias(name), last.alias(f"{name}_at")]
    return events.groupBy(key).agg(*columns)


def journey(leads: DataFrame, events: DataFrame, ladder: list[tuple[str, str, bool]], *, lead_key: str, event_key: str, checkpoint: str, at: str, payload: str | None = None) -> DataFrame:
    """Every step of a ladder (key, label, carries a payload) for every lead, with its first event."""
    steps = leads.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(ladder)], "pos int, step string, label string, info boolean")
    first = events.groupBy(F.col(event_key).alias("_lead"), F.col(checkpoint).alias("_step")).agg(
        F.min(at).alias("occurred_at"), *([F.min_by(payload, at).alias("_payload")] if payload else [])
    )
    grid = leads.select(lead_key).distinct().withColumn("_s", F.explode(F.lit([s[0] for s in ladder]))).withColumnRenamed("_s", "step").join(F.broadcast(steps), "step")
    out = grid.join(first, (F.col(lead_key) == F.col("_lead")) & (F.col("step") == F.col("_step")), "left").drop("_lead", "_step")
    out = out.withColumn("reached", F.col("occurred_at").isNotNull())
    return out.withColumn("payload", F.when(F.col("info"), F.col("_payload"))).drop("_payload") if payload else out


def collapse_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key (by ``order``); rows whose key is null or '' all stay."""
    marked = df.withColumn("_key", F.nullif(key, F.lit("")))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    first = marked.where("_key IS NOT NULL").withColumn("_rank", rank).where("_rank = 1").drop("_key", "_rank")
    return first.unionByName(marked.where("_key IS NULL").drop("_key"))


def append_page(previous: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """The rows so far and those of a page whose key is not among them; rows of the page without key all come."""
    known = previous.where(F.col(key).isNotNull()).select(key).distinct()
    return previous.unionByName(page.join(known, key, "left_anti").select(*previous.columns))


def load_more(rows: DataFrame, seen: DataFrame, key: Column, seen_key: Column, order: list[Column], offset: int, n: int) -> DataFrame:
    """The next n rows that were not seen (keys compared in lower case)."""
    known = seen.select(F.lower(seen_key).alias("_seen")).distinct()
    return rows.join(known, F.lower(key) == F.col("_seen"), "left_anti").orderBy(*order).offset(offset).limit(n)


def bounded(n: int | None, default: int, most: int) -> int:
    """A requested limit between 1 and ``most``."""
    return min(max(n if n is not None else default, 1), most)
