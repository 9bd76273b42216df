"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of the tokens to the power ``alpha``, normalised.
Entropy falls as alpha grows, and so does the largest repetition (how often a
source's tokens are used); so alpha, between 0 (all sources alike) and 1 (as
they are), is bisected for what is asked: a target entropy (in nats), a limit of
repetition, or both: the entropy as far as the limit allows.

A weight and a budget of tokens give each source a quota: whole passes over the
source, and a part of one. Documents are dealt into blocks of about
``block_tokens`` by a hash of their id, and each pass permutes the blocks by a
hash of the pass. The part takes blocks in the order of its permutation, and of
the block in which the quota ends those documents whose hash is at most a cut. So
a source's part is three numbers: the hash at which it ends in the permutation,
the block that is cut, and the cut. Documents look at their source's row only.
The place in the permutation is found by sums over the blocks in 1024 ranges of
their hash, then over the blocks of one range, then over the documents of one
block: no task holds a source, however large it is.

Sources may be many. They stay in a table; alpha is bisected over their distinct
totals on the driver, or, beyond ``max_totals`` of them, by sums over the table for
31 exponents at a time, which gives the same alpha; weights and quotas are columns. The table is broadcast up to ``max_sources``
rows and joined beyond.

With ``budget=None`` it is the smallest with which each source is used whole at
least once: nothing is lost, and smaller sources come again.

Defined results: a null source is the source ''; null or empty texts have no
tokens; a source without tokens has weight 0 and no copies; documents of equal id
are chosen alike; a document of any length is one unit, in or out; an empty table
gives no rows. Own columns start with ``_mix_``: columns of the input whose names do
so too are left out of a plan; ``mixed`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._io import stored


@dataclass(frozen=True)
class Mix:
    """Parameters of a mixture."""

    entropy: float | None = None
    evenness: float | None = None
    max_repeat: float | None = None
    budget: float | None = None
    block_tokens: int = 1_000_000
    seed: int = 17
    max_sources: int = 200_000
    max_totals: int = 200_000


def word_count(text: Column) -> Column:
    """Words of a text, as its number of tokens where no count is at hand."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(tokens: np.ndarray, alpha: float, times: np.ndarray | None = None) -> np.ndarray:
    """Shares to the power alpha, normalised over sources of which each total stands for ``times``."""
    tokens = np.asarray(tokens, dtype=np.float64)
    times = np.ones_like(tokens) if times is None else times
    out = np.zeros_like(tokens)
    some = tokens > 0
    if some.any():
        logs = alpha * np.log(tokens[some] / (tokens * times).sum())
        out[some] = np.exp(logs - logs.max())
        out /= (out * times).sum()
    return out


def entropy_of(w: np.ndarray, times: np.ndarray | None = None) -> float:
    some = w > 0
    times = np.ones_like(w) if times is None else times
    return float(-(times[some] * w[some] * np.log(w[some])).sum())


def budget_of(tokens: np.ndarray, w: np.ndarray, mix: Mix) -> float:
    some = w > 0
    if not some.any():
        return 0.0
    return float(mix.budget) if mix.budget is not None else float((np.asarray(tokens)[some] / w[some]).max())


def repeat_of(tokens: np.ndarray, w: np.ndarray, mix: Mix) -> float:
    """The largest number of times that a source is used."""
    some = w > 0
    return float((budget_of(tokens, w, mix) * w[some] / np.asarray(tokens)[some]).max()) if some.any() else 0.0


class Totals:
    """Sums over sources that an exponent's entropy and repetition follow from."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray | None = None) -> None:
        self.tokens, self.times = np.asarray(tokens, dtype=np.float64), np.ones(len(tokens)) if times is None else times
        self.low, self.high, self.count = (self.tokens.min(), self.tokens.max(), float(self.times.sum())) if len(self.tokens) else (1.0, 1.0, 0.0)

    def sums(self, alphas: list[float]) -> list[tuple[float, float]]:
        """For each exponent the sum of (total / largest) ** alpha, and of that times the log of total / largest."""
        logs = np.log(self.tokens / self.high)
        return [(float((p := self.times * np.exp(a * logs)).sum()), float((p * logs).sum())) for a in alphas]


class SparkTotals(Totals):
    """The same over a table (_mix_own, n) of any size."""

    def __init__(self, distinct: DataFrame) -> None:
        self.table = distinct
        row = distinct.agg(F.min("_mix_own"), F.max("_mix_own"), F.sum("n")).first()
        self.low, self.high, self.count = (float(x) for x in row)

    def sums(self, alphas: list[float]) -> list[tuple[float, float]]:
        log = F.log(F.col("_mix_own").cast("double")) - float(np.log(self.high))
        parts = [F.col("n") * F.exp(F.lit(a) * log) for a in alphas]
        row = self.table.agg(*(x for p in parts for x in (F.sum(p), F.sum(p * log)))).first()
        return [(row[2 * k], row[2 * k + 1]) for k in range(len(alphas))]


def target_entropy(totals: Totals, mix: Mix) -> float | None:
    if mix.entropy is not None or mix.evenness is None:
        return mix.entropy
    own = _entropy(*totals.sums([1.0])[0], 1.0)
    return own + mix.evenness * (float(np.log(totals.count)) - own)


def _entropy(z: float, logs: float, alpha: float) -> float:
    return float(np.log(z)) - alpha * logs / z


def solve(totals: Totals | np.ndarray, mix: Mix, at_once: int = 31, steps: int = 10) -> float:
    """Alpha for the target; the nearest end of [0, 1] where the target is out of reach.

    Each step halves [low, high] five times: it looks at 31 exponents between.
    """
    if not isinstance(totals, Totals):
        totals = Totals(np.asarray(totals)[np.asarray(totals) > 0])
    if mix.entropy is None and mix.evenness is None and mix.max_repeat is None or not totals.count:
        return 1.0
    entropy = target_entropy(totals, mix)

    def holds(alpha: float, z: float, logs: float) -> bool:  # it does from the least such alpha on
        if entropy is not None and _entropy(z, logs, alpha) > entropy + 1e-12:
            return False
        if mix.max_repeat is None:
            return True
        # The smallest source is repeated most; a budget of None is that with which the largest is used once.
        ratio = totals.low / totals.high
        repeat = ratio ** (alpha - 1) if mix.budget is None else mix.budget * ratio ** (alpha - 1) / (z * totals.high)
        return repeat <= mix.max_repeat * (1 + 1e-9)

    low, high = 0.0, 1.0
    if holds(low, *totals.sums([low])[0]):
        return low
    for _ in range(steps):
        grid = [low + (high - low) * k / (at_once + 1) for k in range(1, at_once + 1)]
        found = [holds(a, *s) for a, s in zip(grid, totals.sums(grid), strict=True)]
        k = found.index(True) if any(found) else at_once
        low, high = ([low, *grid][k], [*grid, high][k])
    return high


def quotas(totals: DataFrame, mix: Mix) -> DataFrame:
    """``totals`` (_mix_source, _mix_own) with ``_mix_weight, _mix_n, _mix_passes, _mix_rest``: blocks, whole passes, tokens of the part."""
    some = totals.where("_mix_own > 0")
    distinct = some.groupBy("_mix_own").agg(F.count("*").alias("n"))
    n = distinct.count()
    if n > mix.max_totals:
        of = SparkTotals(stored(distinct, "mix-distinct"))
    else:
        found = distinct.orderBy("_mix_own").collect()
        of = Totals(*(np.array([r[k] for r in found], dtype=np.float64) for k in (0, 1)))
    alpha = solve(of, mix)
    power = F.when(F.col("_mix_own") > 0, F.exp(alpha * (F.log(F.col("_mix_own").cast("double")) - float(np.log(of.high))))).otherwise(0.0)
    norm = totals.agg(F.coalesce(F.sum(power), F.lit(1.0))).first()[0] or 1.0
    weighted = totals.withColumn("_mix_weight", power / norm)
    budget = mix.budget
    if budget is None:
        budget = weighted.where("_mix_weight > 0").agg(F.coalesce(F.max(F.col("_mix_own") / F.col("_mix_weight")), F.lit(0.0))).first()[0]
    quota = F.col("_mix_weight") * float(budget)
    passes = F.when(F.col("_mix_own") > 0, F.floor(quota / F.col("_mix_own") + 1e-9)).otherwise(0).cast("long")
    return (
        weighted.withColumn("_mix_n", F.greatest(F.lit(1), F.ceil(F.col("_mix_own") / mix.block_tokens)).cast("long"))
        .withColumn("_mix_passes", passes)
        .withColumn("_mix_rest", F.greatest(F.lit(0.0), quota - F.col("_mix_passes") * F.col("_mix_own")))
        .select("_mix_source", "_mix_weight", "_mix_n", "_mix_passes", "_mix_rest")
    )


def _with_sources(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if small else sources, "_mix_source")


def _last(rows: DataFrame, own: str, *order: str) -> DataFrame:
    """``rows`` (a few of each source) with ``_before``, the ``own`` of those before it in ``order``, where the rest ends in the row."""
    upto = F.sum(own).over(Window.partitionBy("_mix_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_before", upto - F.col(own)).where((F.col("_before") < F.col("_mix_rest")) & (F.col("_mix_rest") <= F.col("_before") + F.col(own)))


def plan(docs: DataFrame, mix: Mix, *, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """``docs`` with ``_mix_tokens, _mix_weight, _mix_block, _mix_copies`` (0 or more)."""
    tokens = word_count(F.col("text")) if tokens is None else tokens
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if not c.startswith("_mix_")))
    ready = docs.select("*", tokens.cast("long").alias("_mix_tokens"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_mix_source"), F.xxhash64(F.col(id_col), F.lit(mix.seed)).alias("_mix_hash"))
    narrow = stored(ready.select("_mix_source", "_mix_tokens", "_mix_hash"), "mix-rows")  # texts are read once for all sums
    totals = stored(narrow.groupBy("_mix_source").agg(F.sum("_mix_tokens").alias("_mix_own")), "mix-totals")
    sources = stored(quotas(totals, mix), "mix-sources")
    small = sources.count() <= mix.max_sources
    block = F.pmod(F.xxhash64("_mix_hash"), F.col("_mix_n")).alias("_mix_block")
    key = F.xxhash64("_mix_source", "_mix_passes", F.col("_mix_block"), F.lit(mix.seed))

    # Where the part ends: in which range of the permutation, which block, which document.
    parts = sources.where("_mix_rest > 0")
    blocks = _with_sources(narrow, parts.drop("_mix_weight"), small).groupBy("_mix_source", block, "_mix_passes", "_mix_rest").agg(F.sum("_mix_tokens").alias("n"))
    blocks = stored(blocks.withColumn("_mix_key", key).withColumn("_range", F.shiftright("_mix_key", 54).cast("int")), "mix-blocks")
    ranges = _last(blocks.groupBy("_mix_source", "_range", "_mix_rest").agg(F.sum("n").alias("n")), "n", "_range")
    inside = blocks.join(ranges.select("_mix_source", "_range", F.col("_before").alias("_skip")), ["_mix_source", "_range"])
    cut = _last(inside.withColumn("_mix_rest", F.col("_mix_rest") - F.col("_skip")), "n", "_mix_key", "_mix_block")
    cut = stored(cut.select("_mix_source", F.col("_mix_key").alias("_mix_end"), F.col("_mix_block").alias("_mix_last"), (F.col("_mix_rest") - F.col("_before")).alias("_mix_left")), "mix-cuts")
    ended = sources.join(cut, "_mix_source", "left")
    of_block = _with_sources(narrow, sources.join(cut, "_mix_source").select("_mix_source", "_mix_n", "_mix_last", "_mix_left"), small).where(block == F.col("_mix_last"))
    run = Window.partitionBy("_mix_source").orderBy("_mix_hash").rowsBetween(Window.unboundedPreceding, 0)
    of_block = of_block.groupBy("_mix_source", "_mix_hash", "_mix_left").agg(F.sum("_mix_tokens").alias("n")).withColumn("upto", F.sum("n").over(run))
    cuts = of_block.where("upto <= _mix_left + 0.5").groupBy("_mix_source").agg(F.max("_mix_hash").alias("_mix_cut"))
    table = stored(ended.join(cuts, "_mix_source", "left"), "mix-table")

    here = key.alias("_mix_key")
    part = F.when(F.col("_mix_end").isNull(), F.lit(False))
    part = part.when(F.col("_mix_block") == F.col("_mix_last"), F.coalesce(F.col("_mix_hash") <= F.col("_mix_cut"), F.lit(False)))
    part = part.otherwise((F.col("_mix_key") < F.col("_mix_end")) | ((F.col("_mix_key") == F.col("_mix_end")) & (F.col("_mix_block") < F.col("_mix_last"))))
    out = _with_sources(ready, table, small).withColumn("_mix_block", block).select("*", here)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "_mix_source", "_mix_tokens", "_mix_weight", "_mix_block", (F.col("_mix_passes") + part.cast("long")).alias("_mix_copies"))


def mixed(docs: DataFrame, mix: Mix, **options: str) -> DataFrame:
    """``docs`` with each row as often as the mixture uses it; columns stay as they are."""
    safe = docs.toDF(*(f"_of{c}" if c.startswith("_mix_") else c for c in docs.columns))
    planned = plan(safe, mix, **options).where("_mix_copies > 0")
    copies = planned.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return copies.select(*(F.col(f"`{a}`").alias(b) for a, b in zip(safe.columns, docs.columns, strict=True)))


def schedule(planned: DataFrame, mix: Mix, *, id_col: str = "doc_id") -> DataFrame:
    """The training order of a plan: a row per use with ``_mix_pass`` and ``_mix_key``.

    Passes come one after the other, blocks of all sources in the order of their
    permutation for the pass, documents of a block by a hash of the pass; sort
    by (``_mix_pass``, ``_mix_key``, ``_mix_order``).
    """
    used = planned.where("_mix_copies > 0").withColumn("_mix_pass", F.explode(F.sequence(F.lit(0), (F.col("_mix_copies") - 1).cast("int"))))
    return used.withColumn("_mix_key", F.xxhash64("_mix_source", F.col("_mix_pass").cast("long"), "_mix_block", F.lit(mix.seed))).withColumn("_mix_order", F.xxhash64(F.col(id_col), "_mix_pass", F.lit(mix.seed)))
