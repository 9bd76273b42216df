"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

A profile is the list of the most frequent n-grams (one to three characters;
letters in lower case, a word's edges count as a character) from most to least
frequent, ties in the order of code points. A language's profile is made of all
training texts; a text's language is that whose profile is nearest to the
text's own by out-of-place distance: for each n-gram of the text the number of
places between its two ranks, or ``size`` where the language's profile lacks it.

Counts of all training texts are summed in Spark; only the profiles (``size``
n-grams of each language) come to the driver and go to the executors.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any training text all are ``und``; of equally near languages the first
in alphabetical order is taken; repeated rows are judged each; an empty table
gives no rows. A text is one piece of memory: some 40 bytes for each of its
characters while it is counted, so a text of 20 MB needs about a gigabyte. Only the named columns are read; a prediction reads the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._io import frugal, per_batch

#: Profiles' length; n-grams of 1 to 3 characters fit 63 bits.
SIZE = 400
_EDGE = 1
_BITS = 21
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Flags of the code points that are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, sorted; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = letters()[points]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first of what follows a word is its edge
    c = np.where(inside, points, _EDGE)[keep].astype(np.int64)
    if not len(c):
        return c
    c = np.pad(c, (1, int(c[-1] != _EDGE)), constant_values=_EDGE)
    pairs = (c[:-1] << _BITS) | c[1:]
    out = np.concatenate((c[c != _EDGE], pairs, (pairs[:-1] << _BITS) | c[2:]))
    out.sort()
    return out


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a sorted array, ascending, and their counts."""
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[edge], np.diff(np.append(edge, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of all profile n-grams in each language; ``size`` where it lacks one."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.size, self.names = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            own = np.array(profiles[name], dtype=np.int64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the distance, as a share of the largest there can be."""
        own = ranked(*counted(grams(text or "")), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = len(self.codes) - 1
        ranks = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def train(docs: DataFrame, *, size: int = SIZE, text_col: str = "text", lang_col: str = "lang", hold: int = 1 << 21) -> Profiles:
    """Profiles of all rows of ``docs`` that have a language and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        waiting = 0
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold() -> None:
            for name, parts in held.items():
                codes, counts = counted(np.sort(np.concatenate(parts)))
                if name in sums:
                    both = np.concatenate((sums[name][0], codes))
                    order = np.argsort(both, kind="stable")
                    counts = np.concatenate((sums[name][1], counts))[order]
                    edge = np.flatnonzero(np.concatenate(([True], both[order][1:] != both[order][:-1])))
                    codes, counts = both[order][edge], np.add.reduceat(counts, edge)
                sums[name] = codes, counts
            held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            for name, (codes, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "code", "n"])
            sums.clear()

        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = grams(text.as_py())
                if len(own):
                    held.setdefault(name, []).append(own)
                    waiting += len(own)
                if waiting > hold:
                    fold()
                    waiting = 0
                    if sum(len(c) for c, _ in sums.values()) > hold:
                        yield from rows()
        fold()
        yield from rows()

    some = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    sums = some.mapInArrow(frugal(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for row in sums.withColumn("place", place).where(F.col("place") <= size).select("lang", "code", "place").orderBy("lang", "place").collect():
        out.setdefault(row["lang"], []).append(row["code"])
    return Profiles(out, size)


SCHEMA = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = held.value
        rows = [p.judge(x.as_py()) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return per_batch(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")), run, SCHEMA)
