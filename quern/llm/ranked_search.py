"""Ranked lexical search by a two-level quantised index.

``build`` cuts the documents into blocks of some megabytes and writes a row for
each: its terms, and of each term the documents that hold it, at two levels. The
first level is a byte for each posting, the impact rounded *up* to units of
``UNIT``; the second is the exact count. Blocks are made where their rows lie:
no shuffle, and no task holds a term, however common it is.

``search`` takes a query set. One pass over the terms sums up in how many
documents each query term is. A pass over the first level adds up bytes: the sum
over a query's terms bounds a document's score from above, and less a unit for
each term from below; each query's kth largest lower bound is a threshold. The
last pass adds up the bytes again and scores, with exact integers, every document
whose upper bound reaches its query's threshold; each task hands on its k best of
a query, and a ranked window takes the k best of all. So results are exact; the
bytes only decide what is scored.

A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a document with n
terms has ``m = 25 + 75 n N div L``, and a term that it holds tf times scores
``w * (1000000000 tf div (1000 tf + 8 m))``. N is the number of documents with a
term, L all their terms.

Queries go to the tasks in sets of about ``query_bytes`` of text each, so neither
the driver nor a task holds more, however many queries there are; each set costs
three passes over the index.

Defined results: a null or empty text has no terms and is never found; a query
without terms, or whose terms no document holds, has no rows; a very long text is a
block of its own; equal scores rank by ascending id, null ids last, and rows of one
id are documents of their own; queries of equal id and text are one, of equal id and
other text are ranked each; an empty table gives no rows; only the named columns are
read, so clashing names do no harm. The query's id keeps its type.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._io import frugal, per_batch, stored
from quern.llm._words import ALNUM, words_of

#: Of impacts, which are at most 1,000,000: they fit a byte.
UNIT = 3922
SCALE = 1_000_000_000

#: Bytes of terms in lower case, all others blanks.
_TERMS = np.where(ALNUM, np.arange(256), 32).astype(np.uint8)
_TERMS[65:91] += 32

BLOCK = "ids array<long>, lengths binary, terms binary, starts binary, docs binary, impacts binary, counts binary"


@dataclass
class Index:
    blocks: DataFrame
    n_docs: int  #: with a term, N
    n_terms: int  #: of all of them, L


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TERMS.tobytes()).split()


def _size(docs: DataFrame) -> tuple[int, int]:
    """N and L."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.concatenate([np.diff(w.bounds) for w in words_of(batch.column(0), ALNUM, True, hashed=False)] or [np.zeros(0, int)])
        return pa.record_batch([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["n", "l"])

    return tuple(per_batch(docs.select("_text"), run, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first())


def lengths_to_m(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return np.array([25 + 75 * n * n_docs // max(n_terms, 1) for n in lengths.tolist()], dtype=np.int64)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting scores for a weight of 1."""
    return (SCALE * counts) // (1000 * counts + 8 * m)


def _cut(texts: pa.Array, most: int, rows: int = 50_000) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = min(len(texts), i + rows, max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right"))))
        yield i, j
        i = j


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms; the number in these of each token; the text of each token."""
    texts = pc.fill_null(texts.take(pa.array(range(len(texts)))).cast(pa.large_string()), "")  # a copy from its own start on
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    blank = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(_TERMS[data])])
    split = pc.ascii_split_whitespace(blank)
    coded = split.flatten().dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    some = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[at]
    text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    return coded.dictionary, at[some], text[some]


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 21) -> Index:
    """The index of all rows of ``docs``, written."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    n_docs, n_terms = _size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for i, j in _cut(texts, block_bytes):
                d = j - i
                words, at, text = _split(texts[i:j])
                pair, counts = np.unique(at * d + text, return_counts=True)
                term, doc = pair // d, pair % d
                there, begin = np.unique(term, return_index=True)
                lengths = np.bincount(text, minlength=d)
                own = impacts(counts, lengths_to_m(lengths, n_docs, n_terms)[doc])
                columns = (
                    lengths.astype(np.int64),
                    b" ".join(words.take(pa.array(there)).cast(pa.large_binary()).to_pylist()),
                    np.append(begin, len(pair)).astype(np.int32),
                    doc.astype(np.uint16),
                    (-(-own // UNIT)).astype(np.uint8),
                    counts.astype(np.uint32),
                )
                lists = pa.ListArray.from_arrays(pa.array([0, d], pa.int32()), ids[i:j])
                yield pa.record_batch([lists, *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in columns)], names=[x.split()[0] for x in BLOCK.split(", ")])

    return Index(stored(docs.mapInArrow(frugal(run), BLOCK), "search-index"), n_docs, n_terms)


@dataclass
class _Queries:
    """A set of queries: their distinct terms, and of each query its terms and how often it has them."""

    ids: list
    terms: list[bytes]
    own: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list) -> _Queries:
        counted = [(q, c) for q, text in rows if (c := Counter(terms_of(text)))]
        terms = sorted({t for _, c in counted for t in c})
        number = {t: k for k, t in enumerate(terms)}
        return cls([q for q, _ in counted], terms, [(np.array([number[t] for t in c]), np.array(list(c.values()), dtype=np.int64)) for _, c in counted])


class _Postings:
    """The postings of the queries' terms in one block."""

    def __init__(self, row: dict, terms: pa.Array) -> None:
        own = pa.array(row["terms"].split(b" ") if row["terms"] else [], pa.binary())
        self.at = pc.fill_null(pc.index_in(terms, own), -1).to_numpy(zero_copy_only=False)
        starts = np.frombuffer(row["starts"], dtype=np.int32)
        self.begin = np.where(self.at >= 0, starts[self.at], 0)
        self.end = np.where(self.at >= 0, starts[self.at + 1], 0) if len(own) else self.begin
        self.docs = np.frombuffer(row["docs"], dtype=np.uint16) if "docs" in row else None

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of some terms, and how many each has."""
        begin, size = self.begin[terms], self.end[terms] - self.begin[terms]
        total = int(size.sum())
        return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(total), size


def _bounds(block: _Postings, levels: np.ndarray, weights: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all n documents' scores from above and from below; whole numbers under 2 ** 53."""
    at, size = block.of(terms)
    w, doc, level = np.repeat(weights, size).astype(np.float64), block.docs[at], levels[at]
    above = np.bincount(doc, w * level, n) * UNIT
    return above, above - np.bincount(doc, w * (level > 0), n) * (UNIT - 1)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(j)[k].as_py() if c != "ids" else batch.column(j)[k].values for j, c in enumerate(columns)}


def _document_counts(index: Index, queries: _Queries) -> np.ndarray:
    """In how many documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = pa.array(queries.terms, pa.binary()), np.zeros(len(queries.terms), dtype=np.int64)
        for row in _rows(batches, ["terms", "starts"]):
            block = _Postings(row, terms)
            total += block.end - block.begin
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["k", "n"])

    out = np.zeros(len(queries.terms), dtype=np.int64)
    for r in index.blocks.select("terms", "starts").mapInArrow(frugal(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def _thresholds(index: Index, queries: _Queries, weights: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth largest lower bound; 1 where there are fewer."""
    columns = ["lengths", "terms", "starts", "docs", "impacts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, best = pa.array(queries.terms, pa.binary()), np.zeros((len(queries.ids), k))
        for row in _rows(batches, columns):
            block, n, levels = _Postings(row, terms), len(row["lengths"]) // 8, np.frombuffer(row["impacts"], dtype=np.uint8)
            for q, (own, times) in enumerate(queries.own):
                _, below = _bounds(block, levels, weights[own] * times, own, n)
                both = np.concatenate((best[q], below))
                best[q] = np.partition(both, len(both) - k)[-k:]
        q, j = np.nonzero(best > 0)
        yield pa.record_batch([pa.array(q), pa.array(best[q, j].astype(np.int64))], names=["q", "bound"])

    found = index.blocks.select(*columns).mapInArrow(frugal(run), "q long, bound long")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"))))
    out = np.ones(len(queries.ids))
    for r in ranked.where(F.col("r") <= k).where(F.col("r") == k).collect():
        out[r["q"]] = r["bound"]
    return out


def _ranked(index: Index, queries: _Queries, weights: np.ndarray, thresholds: np.ndarray, k: int) -> DataFrame:
    """``(q, rank, doc_id, score)``: each query's k best of the documents whose upper bound reaches its threshold."""
    columns = [x.split()[0] for x in BLOCK.split(", ")]
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(queries.terms, pa.binary())
        best = [np.zeros((0, 3), dtype=np.int64)] * len(queries.ids)  # score, if without id, id
        for row in _rows(batches, columns):
            block, lengths, levels = _Postings(row, terms), np.frombuffer(row["lengths"], dtype=np.int64), np.frombuffer(row["impacts"], dtype=np.uint8)
            counts, m = np.frombuffer(row["counts"], dtype=np.uint32), lengths_to_m(lengths, n_docs, n_terms)
            none = pc.is_null(row["ids"]).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(row["ids"], 0).to_numpy()
            for q, (own, times) in enumerate(queries.own):
                weight = weights[own] * times
                above, _ = _bounds(block, levels, weight, own, len(lengths))
                reach = above >= thresholds[q]
                if not reach.any():
                    continue
                at, size = block.of(own)
                w, kept = np.repeat(weight, size), reach[block.docs[at]]
                doc, count = block.docs[at[kept]], counts[at[kept]].astype(np.int64)
                score = np.bincount(doc, w[kept] * impacts(count, m[doc]), len(lengths)).astype(np.int64)
                some = np.flatnonzero(score > 0)
                both = np.concatenate((best[q], np.stack((score[some], none[some], ids[some]), axis=1)))
                best[q] = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[:k]]
        q = np.repeat(np.arange(len(best)), [len(x) for x in best])
        rows = np.concatenate([np.zeros((0, 3), dtype=np.int64), *best])
        yield pa.record_batch([pa.array(q), pa.array(rows[:, 2], mask=rows[:, 1] > 0), pa.array(rows[:, 0])], names=["q", "doc_id", "score"])

    found = index.blocks.mapInArrow(frugal(run), "q long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text", query_bytes: int = 1 << 22) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each query."""
    spark = items.sparkSession
    items = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    sets = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for s in range(sets):
        queries = _Queries.of([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == s).collect()])
        if not queries.ids:
            continue
        df = _document_counts(index, queries)
        weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
        ranked = _ranked(index, queries, weights, _thresholds(index, queries, weights, k), k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"q long, item_id {kind}")
        ranked = ranked.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        ranked = stored(ranked, "search-ranked") if sets > 1 else ranked
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
