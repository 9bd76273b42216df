"""Connected components of an edge table (Kiveris et al. 2014, large-star / small-star).

Each round is grouped minima and joins; nothing is collected but a count and a
checksum, and each round is written to the shared folder, so plans stay short
and a lost executor costs a read. A minimum is pre-aggregated before its shuffle.
A node of very many edges would bring all of them to the task of its minimum; so
the minima of nodes with more than ``heavy`` edges are broadcast, in rounds that
have such nodes. ``heavy`` is 10,000 or, if that is more, a ten-thousandth of the
edges, so by count at most 20,000 nodes have so many (each edge has two ends).

Defined results: an empty table has no components; edges may repeat, stand in
both directions and join a node with itself; a null end is no edge. Columns other
than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._io import drop, stored


def heavy_of(rows: int) -> int:
    return max(10_000, rows // 10_000)


def join_dealt(rows: DataFrame, table: DataFrame, keys: list[str], number: str, heavy: int) -> DataFrame:
    """``rows`` joined with ``table`` (a row for each key, ``number`` of rows of the key in ``rows``).

    Rows of keys with more than ``heavy`` rows stay where they are: their keys are broadcast.
    """
    few = F.broadcast(table.where(F.col(number) > heavy))
    light = rows.join(few.select(keys), keys, "left_anti").join(table.where(F.col(number) <= heavy), keys)
    return rows.join(few, keys).unionByName(light)


def _star(edges: DataFrame, large: bool, heavy: int | None) -> DataFrame:
    """``edges`` (u, v), u > v, after one star step; no node has more than ``heavy`` edges if that is None."""
    own, all_ = F.min("v").alias("m"), edges
    if large:
        all_ = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        own = F.least(F.min("v"), F.min("u")).alias("m")
    least = all_.groupBy("u").agg(own, F.count("*").alias("n"))
    rows = all_.where("v > u") if large else edges
    out = (rows.join(least, "u") if heavy is None else join_dealt(rows, least, ["u"], "n", heavy)).select("v", "m")
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of ends of edges, a checksum of the edges, and the most edges of a node."""
    both = edges.select("u", F.xxhash64("u", "v").alias("h")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("h")))
    nodes = both.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    return tuple(nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 200) -> DataFrame:
    """(node, component): for each node with an edge to another, the smallest node it reaches.

    Rounds grow with the logarithm of the number of nodes, so ``max_rounds`` is
    only there to end a fault.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"u <> v AND `{a}` IS NOT NULL AND `{b}` IS NOT NULL").distinct()
    now = stored(now, "edges")
    seen = _mark(now)
    for _ in range(max_rounds):
        heavy = heavy_of(seen[0] // 2)
        heavy = heavy if seen[2] > heavy else None
        before, now = now, stored(_star(_star(now, True, heavy), False, heavy), "edges")
        drop(before)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
