"""Quality by nearest neighbours in a latent-semantic space.

Terms of a text are hashed words, trigrams of character classes (how it is
written: capitals, symbols, bars, digits) and words that repeat the word before
them or come again. Counts are damped by a logarithm, weighted by inverse
document frequency and projected by the singular vectors of the labelled texts
(latent semantic analysis). Labelled vectors are broadcast; for every document
the cosines to all of them are exact matrix products in blocks, and its nearest
``k`` labelled texts vote with their similarity to the power ``sharp``.

Labelled texts: for each label the ``per_label`` rows (a documented bound) with
the smallest hash of their id, so the sample does not depend on partitions or
order. What is broadcast has at most ``2 * per_label * dims`` numbers and the
projection ``TERMS * dims``.

Defined results: null and empty texts have no terms and get ``prior`` (the share
of label 1 in the sample), as do all texts if nothing is labelled; labels that
are null or not 0 or 1 are not used; an id that is labelled more than once uses
its largest label; repeated rows are scored each; an empty table gives no rows. Of
labelled texts that are equally near at the k-th place those of the smaller hash count
(the sample is in that order), so a tie is decided alike everywhere. A very long text
is hashed a megabyte at a time, 24 bytes for each byte of that; only its counts of terms
(``TERMS`` numbers) are kept. Only the named columns are read; a score reads the text
only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._io import frugal
from quern.llm._words import SPACED, Words, words_of

_CLASSES = 13
_STYLE = _CLASSES**3
_WORDS = 1 << 12
#: Steps of a share: a text with a share of 0.4 has the terms of 1/8, 2/8 and 3/8.
_STEPS = 8
#: Style trigrams, hashed words, steps of the shares of words that repeat the word before and of words that come again.
TERMS = _STYLE + _WORDS + 2 * _STEPS
#: What a step counts; so many words are long enough for full counts.
_STEP_COUNT, _FULL = 20.0, 20


def _class_table() -> np.ndarray:
    """0 lower case, 1 capitals, 2 digits, 3 blanks, 4 line ends, 5 stops, 6 ! and ?, 7 symbols, 8 bars, 9 brackets and slashes, 10 quotes and dashes, 11 beyond ASCII, 12 others."""
    table = np.full(256, 12, dtype=np.int32)
    table[128:] = 11
    kinds = {3: " \t", 4: "\n\r", 5: ".,;:", 6: "!?", 7: "#$%&*+=@^~", 8: "|", 9: "<>{}[]()/\\", 10: "\"'`-_"}
    for k, chars in kinds.items():
        table[list(chars.encode())] = k
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    return table


_TABLE = _class_table()


def counts(words: Words) -> np.ndarray:
    """Term counts of a run of texts, one row each."""
    n = words.texts
    out = np.zeros((n, TERMS), dtype=np.float32)
    kinds = _TABLE[words.data]
    if len(kinds) > 2:
        codes = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:]
    bounds = words.bounds
    slots = (words.hashes >> np.uint64(52)).astype(np.int64)
    at = words.offsets
    for i in range(n):
        lo, hi = int(at[i]), int(at[i + 1])
        if hi - lo > 2:
            out[i, :_STYLE] = np.bincount(codes[lo : hi - 2], minlength=_STYLE)
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b > a:
            out[i, _STYLE : _STYLE + _WORDS] = np.bincount(slots[a:b], minlength=_WORDS)
            own = words.hashes[a:b]
            again = np.count_nonzero(own[1:] == own[:-1]), b - a - len(np.unique(own))
            for k, n in enumerate(again):
                at_least = _STYLE + _WORDS + k * _STEPS
                out[i, at_least : at_least + int(n * _STEPS / (b - a))] = _STEP_COUNT * min(1.0, (b - a) / _FULL)
    return out


def _runs(texts: pa.Array, most: int = 128) -> Iterator[np.ndarray]:
    """Count matrices of all texts in order, of at most ``most`` rows."""
    for at in range(0, len(texts), most):
        for words in words_of(texts.slice(at, most), SPACED, fold=True):
            yield counts(words)


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int
    sharp: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(x) * self.idf) @ self.axes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of term counts."""
        out = np.full(len(x), self.prior)
        some = x.any(axis=1)
        if not len(self.labels) or not some.any():
            return out
        near = self.latent(x[some]) @ self.vectors.T
        k = min(self.k, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** self.sharp
        total = weight.sum(axis=1)
        out[some] = np.where(total > 0, (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = 1000, dims: int = 48, k: int = 15, sharp: float = 4.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the labelled rows; rows to hold out are not in ``labels``."""
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("i")).distinct(), "i", "left_semi")
    # The smallest hashes of each label. About twice as many as wanted are below a cut, so few
    # rows meet to be ranked, however many there are.
    known = known.withColumn("u", F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / float(1 << 40))
    cuts = {r["y"]: 2.0 * per_label / r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    below = F.col("u") < F.when(F.col("y") == 1, cuts.get(1, 1.0)).otherwise(cuts.get(0, 1.0))
    place = F.row_number().over(Window.partitionBy("y").orderBy("u", "i"))

    def sample(rows: DataFrame) -> dict[int, int]:
        return {r["i"]: r["y"] for r in rows.withColumn("r", place).where(F.col("r") <= per_label).select("i", "y").collect()}

    chosen = sample(known.where(below))
    if any(sum(y == k for y in chosen.values()) < per_label and cut < 1 for k, cut in cuts.items()):
        chosen = sample(known)  # a very uneven draw
    ids = list(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in _runs(batch.column(1)):
                for own in x:
                    at = np.flatnonzero(own)
                    rows.append((at.astype("<i4").tobytes(), own[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["i", "at", "n"])

    # Rows of one id may be many: one text of each goes on, that of the smallest hash.
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("i").isin(ids))
    found = texts.groupBy("i").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = {r["i"]: r for r in found.mapInArrow(frugal(run), "i long, at binary, n binary").toLocalIterator()} if ids else {}
    order = sorted(rows)
    x = np.zeros((len(order), TERMS), dtype=np.float32)
    for r, i in enumerate(order):
        x[r, np.frombuffer(rows[i]["at"], "<i4")] = np.frombuffer(rows[i]["n"], "<f4")
    y = np.array([chosen[i] for i in order], dtype=np.float64)
    if not len(order):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, k, sharp)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
    a = _unit(np.log1p(x) * idf)
    values, left = np.linalg.eigh((a @ a.T).astype(np.float64))  # the singular vectors by the smaller side
    top = np.argsort(-values)[: min(dims, len(values))]
    top = top[values[top] > 1e-6]
    axes = (a.T @ (left[:, top] / np.sqrt(values[top]))).astype(np.float32)
    model = Model(idf, axes, np.zeros((0, 1), np.float32), y, float(y.mean()), k, sharp)
    return model._replace(vectors=model.latent(x).astype(np.float32))


SCHEMA = "doc_id long, score double"


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for batch in batches:
            scores = [m.score(x) for x in _runs(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(frugal(run), SCHEMA)
