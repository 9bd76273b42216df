"""Scoring of texts by a hidden Markov language model.

Tokens are words (ASCII letters in lower case) and one end. A state emits a
*class*, a class a token. Common words, those with at least one of
``common_share`` training tokens, are classes of their own, and so is the end;
all others share the class of their ending (a hash of the last three bytes, modulo
``endings``). So there are at most ``common_share + endings + 1`` classes however
large the vocabulary is, and the model that goes to the executors has a proven
size; what is counted of words is never collected, but joined.

A shared class with n tokens and v words gives a word of c occurrences
``(c + 1) / (n + v + 1)``; the one left over is for a word that training lacks.
Emissions shrink to the classes' own shares by ``prior`` pseudo counts, at which
the model is nearly the add-one unigram. It is a distribution over token sequences.

Training is Baum-Welch over all training texts, ``rounds`` times: each task sums
expected counts by class, state and pair of states, Spark adds them up, and the
driver divides a table of fixed size. The scaled forward recursion is exact, also
for the longest text: sequences are cut into segments that run side by side, and
a segment that is not its text's only one gives the product of its steps as a
matrix, by which the state before it is carried on.

One pass counts words and one encodes: each text becomes two bytes a token, and
some megabytes of texts at a time a list of their words that are not common. Such a
word is joined with its count once for these texts, not for each row that holds it;
a common word is never shuffled.

Defined results: a null text is empty; an empty text has its end only; a very long
one is split by Arrow, into no Python objects, and goes through the model by segments;
repeated rows and rows of equal or null id are scored each (the key of a row is its
own, written once); without training rows no word is known, ``base_score`` is
0, and the model gives all classes nearly the same share; an empty table gives no
rows; columns that are not named are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._io import frugal, stored

END = 0
_MIX = 2_654_435_761


@dataclass(frozen=True)
class Shape:
    """Parameters of the model; at most 65,536 classes."""

    states: int = 8
    common_share: int = 10_000
    endings: int = 4096
    rounds: int = 4
    prior: float = 100.0
    segment: int = 512
    seed: int = 11


@dataclass
class Vocabulary:
    """The classes: what encodes a word and what is known of its class."""

    shape: Shape
    tokens: int  #: of training, N
    types: int  #: of training, V
    common: dict[bytes, int]  #: the class of each common word
    counts: np.ndarray  #: of the end and the common words; 0 for shared classes
    weights: np.ndarray  #: (count + words + 1) of shared classes, (count + 1) of the others

    @property
    def shares(self) -> np.ndarray:
        return self.weights / self.weights.sum()

    @property
    def first_shared(self) -> int:
        return 1 + len(self.common)

    @property
    def base_total(self) -> int:
        return self.tokens + self.types + 1


@dataclass
class Model:
    """Probabilities of a first state, of the next state, and of classes (one row a state)."""

    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    #: Log likelihood of the training texts' classes before each round.
    history: list[float] = field(default_factory=list)


@dataclass
class Corpus:
    encoded: DataFrame
    counts: DataFrame
    vocabulary: Vocabulary


def words_of(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Words of some megabytes of consecutive texts at a time.

    The first text's index, distinct words, the number in these of each token, and
    where each text's tokens end. A longer text is taken whole.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, n = 0, len(texts)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right"))))
        own = texts.take(pa.array(range(i, j))).cast(pa.large_string())  # a copy: ascii_lower is wrong on slices
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own, "")))
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        some = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[at]  # white space at a text's edges leaves empty words
        ends = np.concatenate(([0], np.cumsum(some)))[np.asarray(split.offsets)[1:] - split.offsets[0].as_py()]
        yield i, coded.dictionary, at[some], ends
        i = j


def endings_of(words: pa.Array, endings: int) -> np.ndarray:
    """The class, from 0 on, of each word's last three bytes."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    key = np.zeros(len(words), dtype=np.int64)
    for k in (1, 2, 3):
        there = ends[1:] - k >= ends[:-1]
        key[there] |= data[ends[1:][there] - k].astype(np.int64) << (8 * (k - 1))
    return ((key * _MIX) & 0xFFFFFFFF) % endings


def ending_column(word: str, endings: int) -> Column:
    """``endings_of`` in SQL."""
    key = F.coalesce(F.conv(F.hex(F.expr(f"substring({word}, -3, 3)")), 16, 10).cast("long"), F.lit(0))
    return ((key * _MIX).bitwiseAND(0xFFFFFFFF) % endings).cast("int")


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of a table of one column; the empty word stands for ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, at, ends in words_of(batch.column(0)):
                n = np.bincount(at, minlength=len(words))
                there = np.flatnonzero(n)
                words = pa.concat_arrays([words.take(pa.array(there)).cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
                yield pa.record_batch([words.cast(pa.binary()), pa.array(np.append(n[there], len(ends)))], names=["word", "n"])

    return texts.mapInArrow(frugal(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, shape: Shape) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    is_common = F.col("n") * shape.common_share >= n
    rows = counts.where(is_common | (F.octet_length("word") == 0)).collect()  # at most common_share + 1
    ends = sum(r["n"] for r in rows if not r["word"])
    common = sorted(((bytes(r["word"]), r["n"]) for r in rows if r["word"]), key=lambda x: (-x[1], x[0]))
    rest = counts.where(~is_common & (F.octet_length("word") > 0))
    shared = rest.groupBy(ending_column("word", shape.endings).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    own = np.zeros(1 + len(common) + shape.endings)
    own[0] = ends
    own[1 : 1 + len(common)] = [c for _, c in common]
    weights = own + 1
    for r in shared:
        weights[1 + len(common) + r["k"]] += r["n"] + r["v"]
    return Vocabulary(shape, n, v, {w: k + 1 for k, (w, _) in enumerate(common)}, own, weights)


ENCODED = (
    "row long, id long, training boolean, n_tokens long, n_known long, log_common double, log_shared double, "
    "codes binary, rare array<struct<words: array<binary>, rows: binary, numbers: binary, at: binary>>"
)
#: Words of a part of ``rare``: places in it are two bytes.
PART = 1 << 16


def encode(docs: DataFrame, v: Vocabulary, training: Column, id_col: str, text_col: str) -> DataFrame:
    """A row for each of ``docs``: its classes; with the first of some megabytes of texts, their words that are not common.

    These are in parts of ``PART`` distinct words. A part tells the texts' keys (``rows``), how many of
    its words each has (``numbers``), and the words' places in it, text by text (``at``).
    """
    logs = np.log10(v.counts + 1)
    known = (v.counts > 0).astype(np.int64)
    shared = np.zeros(len(v.weights))
    shared[v.first_shared :] = np.log10(v.weights[v.first_shared :])

    names = [x.split()[0] for x in ENCODED.split(", ")[:8]] + ["rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.array(list(v.common), pa.large_binary())  # in the order of their classes
        for batch in batches:
            for i, words, at, ends in words_of(batch.column(3)):
                words = words.cast(pa.large_binary())
                own = pc.index_in(words, common)
                rare = pc.is_null(own).to_numpy(zero_copy_only=False)
                kind = np.where(rare, v.first_shared + endings_of(words, v.shape.endings), 1 + pc.fill_null(own, 0).to_numpy(zero_copy_only=False))
                begin = np.concatenate(([0], ends[:-1]))
                codes = np.insert(kind[at], ends, END)  # an end after each text
                bounds = np.concatenate(([0], ends + 1 + np.arange(len(ends))))
                text = np.repeat(np.arange(len(ends)), ends - begin)
                kept = rare[at]
                lists = _parts(words, at[kept], text[kept], batch.column(0).slice(i, len(ends)))
                per_text = [np.add.reduceat(x[codes], bounds[:-1]) for x in (known, logs, shared)]
                data = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(2 * bounds), pa.py_buffer(codes.astype(np.uint16))])
                own = [pa.array(np.diff(bounds)), *map(pa.array, per_text), data.cast(pa.binary()), lists]
                yield pa.record_batch([*(x.slice(i, len(ends)) for x in batch.columns[:3]), *own], names=names)

    key = F.monotonically_increasing_id().alias("row")  # of the written table, so it stays
    ready = docs.select(key, F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return ready.mapInArrow(frugal(run), ENCODED)


def _parts(words: pa.Array, at: np.ndarray, text: np.ndarray, rows: pa.Array) -> pa.Array:
    """``rare`` of consecutive texts, of which token k is word ``at[k]`` of text ``text[k]``: all of it stands with the first text."""
    used = np.flatnonzero(np.bincount(at, minlength=len(words)))
    place = np.zeros(len(words), dtype=np.int64)
    place[used] = np.arange(len(used))
    place, cuts = place[at], np.append(np.arange(0, len(used), PART), len(used))
    chosen = [(place >= cut) & (place < cut + PART) for cut in cuts[:-1]]
    parts = pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), words.take(pa.array(used)).cast(pa.binary())),
            pa.array([rows.to_numpy().tobytes()] * len(chosen), pa.binary()),
            pa.array([np.bincount(text[x], minlength=len(rows)).tobytes() for x in chosen], pa.binary()),
            pa.array([(place[x] % PART).astype(np.uint16).tobytes() for x in chosen], pa.binary()),
        ],
        names=["words", "rows", "numbers", "at"],
    )
    return pa.ListArray.from_arrays(pa.array([0] + [len(chosen)] * len(rows), pa.int32()), parts)


def _log_rare(known: pa.Table, parts: pa.Table) -> pa.Table:
    """(row, n, log_rare) of a part's texts, by the counts ``c`` of its known words."""
    logs, some = np.zeros(PART), np.zeros(PART)
    at = known.column("place").to_numpy()
    logs[at], some[at] = np.log10(known.column("c").to_numpy() + 1.0), 1.0
    made = []
    for part in parts.select(["rows", "numbers", "at"]).to_pylist():
        rows, numbers = (np.frombuffer(part[x], dtype=np.int64) for x in ("rows", "numbers"))
        words = np.frombuffer(part["at"], dtype=np.uint16)
        text = np.repeat(np.arange(len(rows)), numbers)
        n, log_rare = (np.bincount(text, x[words], len(rows)) for x in (some, logs))
        made.append(pa.table({"row": rows, "n": n.astype(np.int64), "log_rare": log_rare}))
    return pa.concat_tables(made) if made else pa.table({"row": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "log_rare": pa.array([], pa.float64())})


def prepare(docs: DataFrame, training: Column, shape: Shape = Shape(), *, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    """Word counts of the training rows, and all rows encoded; both written."""
    texts = docs.where(training).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = stored(count_words(texts), "hmm-counts")
    v = vocabulary_of(counts, shape)
    return Corpus(stored(encode(docs, v, training, id_col, text_col), "hmm-encoded"), counts, v)


class _Block:
    """Sequences of some texts cut into segments, their tokens in the order of steps.

    Segments are sorted from long to short, so those that have a step t are the
    first ``active[t]``, and their tokens of that step lie side by side.
    """

    def __init__(self, sequences: list[np.ndarray], segment: int) -> None:
        lengths = np.array([len(x) for x in sequences])
        codes = np.concatenate(sequences)
        parts = -(-lengths // segment)
        text = np.repeat(np.arange(len(lengths)), parts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(lengths) - lengths, parts) + place * segment
        size = np.minimum(segment, lengths[text] - place * segment)
        order = np.argsort(-size, kind="stable")
        self.text, self.place, self.n_texts = text[order], place[order], len(lengths)
        size, begin = size[order], begin[order]
        self.active = np.searchsorted(-size, -np.arange(int(size.max())), side="left")
        self.offsets = np.concatenate(([0], np.cumsum(self.active)))
        step = np.repeat(np.arange(len(self.active)), self.active)
        slot = np.arange(len(step)) - self.offsets[step]
        self.codes, self.slot = codes[begin[slot] + step].astype(np.int64), slot
        self.last = self.offsets[size - 1] + np.arange(len(size))  # where the last token of each segment lies
        where = np.empty(len(text), dtype=np.int64)
        where[order] = np.arange(len(text))
        head = np.cumsum(parts) - parts
        self.chains = [where[head[parts > k] + k] for k in range(int(parts.max()))]  # k-th segments
        self.many = (parts > 1)[self.text]


def _steps(block: _Block, model: Model, emitted: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the chosen segments the product of their steps, as matrices, and the logs of their scales.

    The first step of a text's first segment has no transition.
    """
    s = len(model.start)
    at = np.flatnonzero(chosen)
    x = np.zeros((s, s, len(at)))  # from, to, segment
    x[np.arange(s), np.arange(s)] = 1.0
    scale = np.zeros(len(at))
    first = block.place[at] == 0
    for t, n in enumerate(block.active):
        m = int(np.searchsorted(at, n))
        if not m:
            break
        y = np.matmul(model.trans.T, x[:, :, :m])  # over `to`
        if t == 0:
            y[:, :, first] = x[:, :, first]
        y *= emitted[:, block.offsets[t] + at[:m]]
        x[:, :, :m] = y
        if t % 8 == 7:  # eight steps are far from the least number there is
            c = y.sum(axis=(0, 1))
            x[:, :, :m] /= c
            scale[:m] += np.log(c)
    c = x.sum(axis=(0, 1))
    return x / c, scale + np.log(c)


def _entries(block: _Block, model: Model, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State after the segment before each one; state and log likelihood after each text of many; (matrices by segment)."""
    s, n = len(model.start), len(block.text)
    before = np.repeat(model.start[:, None], n, axis=1)
    likely = np.zeros(block.n_texts)
    matrices = np.zeros((s, s, 0))
    index = np.full(n, -1)
    if block.many.any():
        matrices, scale = _steps(block, model, emitted, block.many)
        index[block.many] = np.arange(matrices.shape[2])
        state = np.zeros((s, block.n_texts))
        for k, segments in enumerate(block.chains):
            segments = segments[block.many[segments]]
            if not len(segments):
                break
            of = block.text[segments]
            own = before[:, segments] if k == 0 else state[:, of]
            before[:, segments] = own
            after = np.einsum("in,ijn->jn", own, matrices[:, :, index[segments]])
            c = after.sum(axis=0)
            likely[of] += np.log(c) + scale[index[segments]]
            state[:, of] = after / c
    return before, likely, matrices, index


def log_likelihoods(sequences: list[np.ndarray], model: Model, segment: int) -> np.ndarray:
    """Natural log of the probability of each sequence of classes, by the scaled forward recursion."""
    block = _Block(sequences, segment)
    emitted = model.emit[:, block.codes]
    _, likely, _, _ = _entries(block, model, emitted)
    single = ~block.many
    scale = np.zeros(len(block.codes))
    state = np.empty((len(model.start), 0))
    slots = np.flatnonzero(single)
    for t, n in enumerate(block.active):
        m = int(np.searchsorted(slots, n))
        if not m:
            break
        at = block.offsets[t] + slots[:m]
        x = (np.repeat(model.start[:, None], m, axis=1) if t == 0 else model.trans.T @ state[:, :m]) * emitted[:, at]
        c = x.sum(axis=0)
        scale[at] = np.log(c)
        state = x / c
    likely += np.bincount(block.text[block.slot], scale, block.n_texts)
    return likely


def expected(sequences: list[np.ndarray], model: Model, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected first states, pairs of states, classes by state; log likelihood (forward and backward pass)."""
    block = _Block(sequences, segment)
    s, total = len(model.start), len(block.codes)
    emitted = model.emit[:, block.codes]
    before, likely, matrices, index = _entries(block, model, emitted)
    first = block.place == 0
    alpha, scale = np.empty((s, total)), np.empty(total)
    pred = np.where(first, before, model.trans.T @ before)
    for t, n in enumerate(block.active):
        o = block.offsets[t]
        x = pred[:, :n] * emitted[:, o : o + n]
        c = x.sum(axis=0)
        x /= c
        alpha[:, o : o + n], scale[o : o + n] = x, c
        pred = model.trans.T @ x
    # What follows each segment, in the scale at which states after it times this is 1.
    follow = np.ones((s, len(block.text)))
    for segments, later in zip(reversed(block.chains[:-1]), reversed(block.chains[1:]), strict=True):
        ahead = {int(block.text[x]): int(x) for x in later}
        own = np.array([x for x in segments if int(block.text[x]) in ahead], dtype=np.int64)
        after = np.array([ahead[int(block.text[x])] for x in own], dtype=np.int64)
        f = np.einsum("ijn,jn->in", matrices[:, :, index[after]], follow[:, after])
        follow[:, own] = f / (alpha[:, block.last[own]] * f).sum(axis=0)
    pairs, gamma = np.zeros((s, s)), alpha  # alpha is read before it is overwritten
    beta = np.empty((s, 0))
    for t in range(len(block.active) - 1, -1, -1):
        n, o = int(block.active[t]), block.offsets[t]
        beta = np.concatenate((beta, follow[:, beta.shape[1] : n]), axis=1)
        y = emitted[:, o : o + n] * beta / scale[o : o + n]
        gamma[:, o : o + n] *= beta
        if t:
            p = block.offsets[t - 1]
            pairs += alpha[:, p : p + n] @ y.T
            beta = model.trans @ y
        else:
            pairs += before[:, ~first[:n]] @ y[:, ~first[:n]].T
    begun = gamma[:, : block.active[0]][:, first].sum(axis=1)
    classes = np.stack([np.bincount(block.codes, g, model.emit.shape[1]) for g in gamma])
    return begun, pairs * model.trans, classes, float(np.log(scale).sum())


def _sequences(codes: Iterator[tuple[int, bytes]], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and their classes, at least ``most`` tokens at a time (but for the last)."""
    rows: list[int] = []
    held: list[np.ndarray] = []
    n = 0
    for row, data in codes:
        rows.append(row)
        held.append(np.frombuffer(data, dtype=np.uint16))
        n += len(held[-1])
        if n >= most:
            yield rows, held
            rows, held, n = [], [], 0
    if rows:
        yield rows, held


def first_model(v: Vocabulary) -> Model:
    """States that differ by chance, and stay."""
    s = v.shape.states
    chance = np.random.Generator(np.random.PCG64(v.shape.seed)).normal(0, 0.5, (s, len(v.weights)))
    emit = v.shares * np.exp(chance)
    trans = np.full((s, s), 0.1 / max(s - 1, 1)) + np.eye(s) * (0.9 - 0.1 / max(s - 1, 1)) if s > 1 else np.ones((1, 1))
    return Model(np.full(s, 1 / s), trans / trans.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def next_model(v: Vocabulary, begun: np.ndarray, pairs: np.ndarray, classes: np.ndarray) -> Model:
    """The likeliest parameters, with pseudo counts."""
    emit = classes + v.shape.prior * v.shares
    pairs, begun = pairs + 1.0, begun + 1.0
    return Model(begun / begun.sum(), pairs / pairs.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def train(corpus: Corpus, tokens_at_once: int = 400_000) -> Model:
    """Baum-Welch over all training rows; a table of classes by states is what comes to the driver each round."""
    v = corpus.vocabulary
    model = first_model(v)
    s, shape = v.shape.states, v.shape
    names = [f"s{k}" for k in range(s)]
    schema = "k int, " + ", ".join(f"{x} double" for x in names)

    def job(model: Model):  # noqa: ANN202  a function for mapInArrow
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, held in _sequences(((0, x.as_py()) for b in batches for x in b.column(0)), tokens_at_once):
                own = expected(held, model, shape.segment)
                total = own if total is None else tuple(a + b for a, b in zip(total, own, strict=True))
            if total is not None:
                begun, pairs, classes, likely = total
                some = np.flatnonzero(classes.any(axis=0))
                k = np.concatenate((some, -1 - np.arange(s), [-1 - s, -2 - s]))
                rows = np.concatenate((classes[:, some].T, pairs, begun[None], np.full((1, s), likely)))
                yield pa.record_batch([pa.array(k, pa.int32()), *(pa.array(rows[:, j]) for j in range(s))], names=["k", *names])

        return run

    rows = corpus.encoded.where("training").select("codes")
    for _ in range(shape.rounds):
        found = rows.mapInArrow(frugal(job(model)), schema).groupBy("k").agg(*(F.sum(x).alias(x) for x in names)).collect()
        if not found:
            break
        k, values = np.array([r[0] for r in found]), np.array([r[1:] for r in found])
        classes = np.zeros((s, len(v.weights)))
        classes[:, k[k >= 0]] = values[k >= 0].T
        by = {int(a): b for a, b in zip(k, values, strict=True) if a < 0}
        after = next_model(v, by[-1 - s], np.stack([by[-1 - j] for j in range(s)]), classes)
        after.history = [*model.history, float(by[-2 - s][0])]
        model = after
    return model


SCORED = "row long, hmm double"


def score(corpus: Corpus, model: Model, tokens_at_once: int = 400_000) -> DataFrame:
    """``(id, training, n_tokens, n_known, train_tokens, base_score, score)``, a row for each that was encoded.

    ``base_score`` is the add-one unigram's, ``score`` the model's log10 probability.
    """
    v = corpus.vocabulary
    segment = v.shape.segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in _sequences(zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True), tokens_at_once):
                yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(log_likelihoods(held, model, segment) / np.log(10))], names=["row", "hmm"])

    hmm = corpus.encoded.select("row", "codes").mapInArrow(frugal(run), SCORED)
    parts = corpus.encoded.select("row", F.posexplode("rare").alias("part", "r")).select("row", "part", "r.*")
    words = parts.select("row", "part", F.posexplode("words").alias("place", "word"))
    known = words.join(corpus.counts.withColumnRenamed("n", "c"), "word").select(F.col("row").alias("of"), F.col("part").alias("of_part"), "place", "c")
    known = known.groupBy("of", "of_part").cogroup(parts.drop("words").groupBy("row", "part")).applyInArrow(_log_rare, "row long, n long, log_rare double")
    known = known.groupBy("row").agg(F.sum("n").alias("n"), F.sum("log_rare").alias("log_rare"))
    flat = corpus.encoded.drop("codes", "rare")
    joined = flat.join(hmm, "row").join(known, "row", "left")
    log_rare = F.coalesce(F.col("log_rare"), F.lit(0.0))
    return joined.select(
        "id",
        "training",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("n"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("log_common") + log_rare - F.col("n_tokens") * float(np.log10(v.base_total))).alias("base_score"),
        (F.col("hmm") + log_rare - F.col("log_shared")).alias("score"),
    )
