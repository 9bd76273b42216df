"""Quality rules by compression bands.

A text is compressed by zstandard, whole and in fixed chunks. Text that says
the same thing again and again shrinks far more than prose does; keys, hashes
and encoded blobs hardly shrink at all. How far prose shrinks depends on how
much of it there is, so each band of lengths has its own limits. Chunks find
what a long text hides: a few kilobytes of filler inside good prose.

Limits are of two kinds, and both hold. Those in ``Bands`` are absolute. Those of
``fit`` come from the corpus: the ratios of all distinct texts that pass the base rules are counted in
bands of a quarter of an octave of length (chunks, being of one length, are one
band), and a ratio beyond the fences of its band's quartiles is out of its length.
A band of fewer than ``least_texts`` texts takes in its neighbours, one further on
either side at a time, until there are so many; as longer texts shrink more, theirs
are moved by the slope of the bands' medians over these neighbours. If all bands
together have fewer (or there are fewer chunks), all are used and the fences stand
wider, by the root of how many times fewer. So fences exist at every size, and
hardly depend on it. A text of a length that was not seen has its nearest band's.

No limit of the ratio parts hex and base32 from prose: their few symbols alone
shrink by 1.5 to 2, as prose does. What parts them is repetition. A chunk is a
blob if it is nearly all ASCII, has few spaces, and zstandard needs no less than
the entropy of its single bytes, so it found nothing that comes twice. A text
with a blob chunk goes.

Base rules come first: a text needs ``min_words`` words and at most a share
``max_repeat`` of them in 3-word windows that occur more than once.

Defined results: null is an empty text; an empty text has no words and fails
the base rules. A very long text is held once as words, with 16 bytes for each of
their 3-word windows, and compressed in chunks. Copies of a text count once in
``fit``, and rows are judged one by one, so ties and repeated rows need nothing
special; an empty table has no fences. ``score`` returns only ``id`` and its own columns;
``keep`` returns its input's columns unchanged, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._io import per_batch, small_batches

_WHITE = " \t\n\x0b\x0c\r"
_SPACES = (b" ", b"\n", b"\t", b"\r")
_SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_ratio_min double, chunk_ratio_max double, reason string"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio (bytes before / bytes after).

    ``whole`` lists (from this many bytes, least ratio, largest ratio); the last
    that fits holds, and shorter texts have no limits. Chunks of ``chunk_bytes``
    (the last one begins earlier, so that it is full too; a shorter text is its
    only chunk) have limits of their own,
    and ``max_bad_chunks`` is the share of them that may fail.

    A chunk of ``blob_bytes`` or more is a blob if at most ``blob_spaces`` of its
    bytes are whitespace, at most ``blob_other`` are not ASCII, and its compressed
    size is at least ``blob_gain`` times the entropy of its bytes. (At 4096 bytes:
    base64, hex, base32 and random ASCII 1.016 or more, licenses, Markdown and the
    prose of ``documents`` 0.98 or less.) More than ``max_blob_chunks`` fail a text.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = field(
        default=((256, 1.10, 3.2), (512, 1.20, 3.4), (1024, 1.30, 3.6), (4096, 1.35, 4.0), (16384, 1.40, 5.0), (131072, 1.40, 7.0))
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.30, 4.0)
    max_bad_chunks: float = 0.25
    blob_bytes: int = 2048
    blob_spaces: float = 0.12
    blob_other: float = 0.125
    blob_gain: float = 1.0
    max_blob_chunks: int = 0
    min_words: int = 50
    max_repeat: float = 0.5
    #: Fences: so many quartile distances above and below the quartiles of log ratio, and at least ``fence_least``.
    fence_high: float = 1.5
    fence_low: float = 3.0
    fence_least: float = 0.05
    least_texts: int = 100
    #: What ``fit`` found: (band, least ratio, largest ratio); band -1 is that of chunks.
    fitted: tuple[tuple[int, float, float], ...] = ()


STEP = 0.0025  # of log ratio, in which ratios are counted
CHUNKS = -1


def length_band(n_bytes: int) -> int:
    """Quarters of an octave."""
    return int(np.floor(np.log2(n_bytes) * 4))


def fit(df: DataFrame, bands: Bands = Bands(), *, text_col: str = "text") -> Bands:
    """``bands`` with fences from all texts of ``df``.

    One pass that compresses each text, one shuffle of a few numbers for each, and
    at most a row for each band and step of the ratio to the driver.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows: list[tuple[int, int, int, int]] = []
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            data = text.encode("utf-8")
            if len(data) < bands.whole[0][0] or base_failed(base_counts(text), bands):
                continue
            whole, chunks, _ = ratios(data, bands, compressor, blobs=False)
            rows.append((h, length_band(len(data)), int(np.floor(np.log(whole) / STEP)), 1))
            if len(chunks) > 1:
                at, n = np.unique(np.floor(np.log(chunks) / STEP).astype(np.int64), return_counts=True)
                rows += [(h, CHUNKS, a, c) for a, c in zip(at.tolist(), n.tolist(), strict=True)]
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["h", "band", "step", "n"])

    text = F.col(f"`{text_col}`").cast("string")
    found = per_batch(df.select(F.xxhash64(text).alias("h"), text.alias("t")), run, "h long, band long, step long, n long")
    once = found.groupBy("h", "band", "step").agg(F.max("n").alias("n"))
    counts: dict[int, list[tuple[int, int]]] = {}
    with small_batches(df.sparkSession):
        steps_of = once.groupBy("band", "step").agg(F.sum("n").alias("n")).collect()
    for r in steps_of:
        counts.setdefault(r["band"], []).append((r["step"], r["n"]))
    return replace(bands, fitted=fences(counts, bands))


def _quantile(at: np.ndarray, n: np.ndarray, q: float) -> float:
    order = np.argsort(at, kind="stable")
    return float(at[order][np.searchsorted(np.cumsum(n[order]), q * n.sum())])


def fences(counts: dict[int, list[tuple[int, int]]], bands: Bands) -> tuple[tuple[int, float, float], ...]:
    """(band, least ratio, largest ratio) from the (step, texts) of each band."""
    logs = {b: tuple(np.array(x, dtype=np.float64) for x in zip(*pairs, strict=True)) for b, pairs in counts.items()}
    logs = {b: ((steps + 0.5) * STEP, n) for b, (steps, n) in logs.items()}
    size = {b: n.sum() for b, (_, n) in logs.items()}
    median = {b: _quantile(*x, 0.5) for b, x in logs.items()}
    lengths = sorted(b for b in logs if b != CHUNKS)
    out = []
    for band in sorted(logs):
        reach, pool = 0, [band]
        while band != CHUNKS and sum(size[b] for b in pool) < bands.least_texts and len(pool) < len(lengths):
            reach += 1
            pool = [b for b in lengths if abs(b - band) <= reach]
        weight, at, mid = (np.array([x(b) for b in pool], dtype=np.float64) for x in (size.get, float, median.get))
        away = at - np.average(at, weights=weight)
        slope = float((weight * away * mid).sum() / (weight * away**2).sum()) if len(pool) > 1 else 0.0
        ratio = np.concatenate([logs[b][0] + slope * (band - b) for b in pool])
        n = np.concatenate([logs[b][1] for b in pool])
        low, high = _quantile(ratio, n, 0.25), _quantile(ratio, n, 0.75)
        wider = max(1.0, np.sqrt(bands.least_texts / n.sum()))
        below, above = (wider * max(k * (high - low), bands.fence_least) for k in (bands.fence_low, bands.fence_high))
        out.append((band, float(np.exp(low - below)), float(np.exp(high + above))))
    return tuple(out)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows."""
    words = text.encode("utf-8").split()  # bytes are split at ASCII white space
    chars = len(text) - sum(map(text.count, _WHITE))
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes], long: int = 20_000) -> int:
    """Words in 3-word windows that occur more than once."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n <= long:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        again = np.fromiter((counts[x] > 1 for x in windows), dtype=bool, count=n)
    else:  # by numbers of 8 bytes, not tuples
        codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        _, pairs = np.unique(codes[:-1] * (codes.max() + 1) + codes[1:], return_inverse=True)
        _, at, numbers = np.unique(pairs[:-1] * (codes.max() + 1) + codes[2:], return_inverse=True, return_counts=True)
        again = numbers[at] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def base_failed(counts: tuple[int, int, int, int, int], bands: Bands) -> bool:
    return counts[0] < bands.min_words or counts[4] > bands.max_repeat * counts[0]


def is_blob(chunk: bytes, compressed: int, bands: Bands) -> bool:
    """If a chunk is an encoded blob, keys or hashes; ``compressed`` is its size in zstandard."""
    n = len(chunk)
    if n < bands.blob_bytes or sum(map(chunk.count, _SPACES)) > bands.blob_spaces * n:
        return False
    counts = np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)
    if counts[128:].sum() > bands.blob_other * n:
        return False
    counts = counts[counts > 0]
    return compressed >= bands.blob_gain * float((counts * np.log2(n / counts)).sum()) / 8


def ratios(data: bytes, bands: Bands, compressor: zstandard.ZstdCompressor, blobs: bool = True) -> tuple[float, list[float], int]:
    """Of the whole text and of its chunks, and how many chunks are blobs (0 if that isn't asked)."""
    if not data:
        return 1.0, [], 0
    size = bands.chunk_bytes
    whole = len(compressor.compress(data))
    if len(data) <= size:
        return len(data) / whole, [len(data) / whole], int(blobs and is_blob(data, whole, bands))
    chunks = [data[i : i + size] for i in range(0, len(data) - size + 1, size)]
    if len(data) % size:
        chunks.append(data[-size:])
    sizes = [len(compressor.compress(x)) for x in chunks]
    return len(data) / whole, [size / x for x in sizes], sum(is_blob(x, k, bands) for x, k in zip(chunks, sizes, strict=True)) if blobs else 0


def verdict(n_bytes: int, whole: float, chunks: list[float], blobs: int, bands: Bands) -> str | None:
    """Why the bands reject a text, or None."""
    limits = None
    for least_bytes, low, high in bands.whole:
        if n_bytes >= least_bytes:
            limits = (low, high)
    if limits and whole > limits[1]:
        return "repetitive"
    if limits and whole < limits[0]:
        return "incompressible"
    fitted = {band: limits for band, *limits in bands.fitted}
    lengths = [b for b in fitted if b != CHUNKS]
    if n_bytes >= bands.whole[0][0] and lengths:
        own = fitted[min(lengths, key=lambda b: abs(b - length_band(n_bytes)))]
        if whole > own[1]:
            return "repetitive for its length"
        if whole < own[0]:
            return "incompressible for its length"
    if n_bytes > bands.chunk_bytes and chunks:
        low, high = bands.chunk
        if own := fitted.get(CHUNKS):
            low, high = max(low, own[0]), min(high, own[1])
        if sum(x > high for x in chunks) > bands.max_bad_chunks * len(chunks):
            return "repetitive chunks"
        if sum(x < low for x in chunks) > bands.max_bad_chunks * len(chunks):
            return "incompressible chunks"
    if blobs > bands.max_blob_chunks:
        return "blob chunks"
    return None


def judge(text: str | None, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """The columns of SCHEMA after ``doc_id``."""
    text = text or ""
    counts = base_counts(text)
    failed = base_failed(counts, bands)
    data = text.encode("utf-8")
    whole, chunks, blobs = ratios(data, bands, compressor)
    why = verdict(len(data), whole, chunks, blobs, bands)
    reason = "base rules" if failed else why
    return *counts, failed, reason is None, whole, min(chunks, default=1.0), max(chunks, default=1.0), reason


def score(df: DataFrame, bands: Bands | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: counts, ratios, the verdict and its reason; limits fitted to ``df`` if none are given."""
    bands = fit(df, text_col=text_col) if bands is None else bands

    def run(batch: pa.RecordBatch) -> pa.Table:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(x.as_py(), bands, compressor) for x in batch.column(1)]
        names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
        columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
        return pa.table([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", *names])

    return per_batch(df.select(id_col, text_col), run, SCHEMA)


def keep(df: DataFrame, bands: Bands | None = None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, with all its columns; limits fitted to ``df`` if none are given."""
    bands = fit(df, text_col=text_col) if bands is None else bands
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        return batch.filter(pa.array([judge(x.as_py(), bands, compressor)[6] for x in batch.column(at)], type=pa.bool_()))

    return per_batch(df, run, df.schema)
