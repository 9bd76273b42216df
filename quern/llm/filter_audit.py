"""Audit of filters that act one after the other, in every order.

Each document gets a mask: bit k says that it fails filter k. What any order of
filters does to a document depends on its mask alone, so a part of the corpus is
a histogram over masks (2 ** n numbers for n filters), and its outcomes under all
orders are one product with an integer matrix of as many rows and a column for
each order and step: 32 by 600 for five filters. There are four matrices: a mask
is *kept* after a step if no filter up to it fails it; *removed* by the first one
that fails it; *redundant* at a later filter that fails it too; *unique* if the
step's filter is the only one that fails it.

Parts are rows: for each part three histograms (all documents, those of good
quality, toxic ones) are stacked and multiplied by the matrices, many parts at a
time. Texts are read once; a mask, a digest and the part are kept of each, and a
part's documents are counted by mask in each task before they meet.

A copy fails the filter of copies if its text is that of any document of smaller
id. Texts are compared by SHA-256. The least id of each digest comes from one
aggregation; the rows that pass are those that have both the digest and its least
id, so no task holds a group of copies.

Defined results: a null text is empty, a null part is ''; rows of equal text and
equal least id all pass; a null id is smaller than no other and passes itself;
repeated labels count once, as good or toxic if any says so, and labels of other
values or other documents not at all; a very long text is one piece of memory and
its words; an empty table gives no rows; clashing column names do no harm, for
only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._io import frugal, per_batch, stored

_UPPER = bytes(range(65, 91))


@dataclass(frozen=True)
class Facts:
    """What filters look at: the text as UTF-8, its code points, its words, its distinct words."""

    data: bytes
    chars: int
    words: int
    distinct: int

    def count(self, some: bytes) -> int:
        """How many bytes are among ``some`` (ASCII)."""
        return len(self.data) - len(self.data.translate(None, some))


@dataclass(frozen=True)
class Filter:
    """A filter's letter, and when a text fails it. Without ``fails`` it is that of copies."""

    letter: str
    fails: Callable[[Facts], bool] | None


#: Few words, few distinct words, many capitals, symbols, copies.
FILTERS = (
    Filter("A", lambda x: x.words < 50),
    Filter("B", lambda x: 100 * x.distinct < 65 * x.words),
    Filter("C", lambda x: 100 * x.count(_UPPER) > 5 * x.chars),
    Filter("D", lambda x: x.count(b"#$%&*|") > 0),
    Filter("E", None),
)


def facts_of(text: str | None) -> Facts:
    data = (text or "").encode("utf-8")
    words = data.split()
    return Facts(data, len(text or ""), len(words), len(set(words)))


def masks(docs: DataFrame, filters: tuple[Filter, ...] = FILTERS, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(id, part, mask)``, a row for each of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask, digest = [], []
        for text in batch.column(2):
            x = facts_of(text.as_py())
            mask.append(sum(1 << k for k, f in enumerate(filters) if f.fails and f.fails(x)))
            digest.append(hashlib.sha256(x.data).digest())
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], names=["id", "part", "mask", "digest"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = stored(per_batch(rows, run, "id long, part string, mask int, digest binary"), "audit-rows")
    bit = sum(1 << k for k, f in enumerate(filters) if f.fails is None)
    if not bit:
        return rows.drop("digest")
    least = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("least", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("least").isNull()
    return rows.join(least, ["digest", "id"], "left").select("id", "part", F.when(copy, F.col("mask") + bit).otherwise(F.col("mask")).alias("mask"))


def histograms(masked: DataFrame, labels: DataFrame, n: int, *, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``(part, bins)`` with 3 * 2 ** n numbers: all documents by mask, good ones, toxic ones."""
    known = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("id"))
    known = known.agg(*(F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).cast("int")).alias(a) for c, a in ((good_col, "good"), (toxic_col, "toxic"))))
    rows = masked.join(known, "id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("h0"), F.coalesce(F.sum("good"), F.lit(0)).alias("h1"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("h2"))
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.array("h0", "h1", "h2"))))  # at most 2 ** n
    bins = F.flatten(F.transform(F.array(*(F.lit(h) for h in range(3))), lambda h: F.transform(F.sequence(F.lit(0), F.lit(2**n - 1)), lambda m: F.coalesce(F.try_element_at("by", m)[h], F.lit(0).cast("long")))))
    return counts.groupBy("part").agg(by_mask.alias("by")).select("part", bins.alias("bins"))


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def matrices(letters: str) -> dict[str, np.ndarray]:
    """Of each outcome the matrix of masks by (order, step)."""
    n, found = len(letters), orders(letters)
    steps = np.array([[letters.index(c) for c in o] for o in found])  # filter by order and step
    mask = np.arange(2**n)[:, None, None]
    fails = (mask >> steps) & 1
    before = np.cumsum(fails, axis=2) - fails  # how many earlier filters fail it
    out = {"kept": before + fails == 0, "removed": (fails == 1) & (before == 0), "redundant": (fails == 1) & (before > 0), "unique_fails": mask == 1 << steps}
    return {k: v.reshape(2**n, -1).astype(np.int64) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUTCOMES = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def outcomes(bins: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step: the product of histograms and matrices."""
    by, found, n = matrices(letters), orders(letters), len(letters)
    column = np.array([letters.index(c) for o in found for c in o])  # the filter of each column
    one_filter = (column[:, None] == np.arange(n)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                rows = batch.slice(i, 100)
                h = np.asarray(rows.column(1).flatten()).reshape(-1, 3, 2**n)
                every, good, toxic = h[:, 0], h[:, 1], h[:, 2]
                removed = every @ by["removed"]
                shapley = (removed @ one_filter)[:, column]
                values = (every @ by["kept"], removed, every @ by["redundant"], every @ by["unique_fails"], good @ by["removed"], toxic @ by["removed"], shapley)
                k = len(column)
                yield pa.record_batch(
                    [
                        rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), k))),
                        pa.array([o for o in found for _ in range(n)] * rows.num_rows),
                        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), rows.num_rows * len(found))),
                        *(pa.array(v.ravel()) for v in values),
                    ],
                    names=[x.split()[0] for x in OUTCOMES.split(", ")],
                )

    return bins.mapInArrow(frugal(run), OUTCOMES)


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, **columns: str) -> DataFrame:
    """What each filter keeps and removes at each step of each order, for each part of ``docs``."""
    letters = "".join(f.letter for f in filters)
    return outcomes(histograms(masks(docs, filters, **columns), labels, len(filters)), letters)
