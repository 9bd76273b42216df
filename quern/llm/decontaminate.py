"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton (Blumer et
al.; one automaton for many strings). Training words are streamed through it:
after each word the state tells the longest suffix of the words so far that
occurs in any item. Where that length reaches ``window``, the last ``window``
words are an occurrence of an item's window and are marked; states that end a
whole short item (fewer than ``window`` words) mark that item's words.

Streaming every word through Python dictionaries would cost more than reading
the corpus. A match of ``m`` words is ``m - 1`` adjacent word pairs that items
have, so a table of the items' word pairs (by hash, one look-up for each word,
vectorised) leaves the stretches where such a match is possible, and only those
go through the automaton, by the words themselves. The table can only keep too
much, never lose a match.

Automata go to executors by broadcast, and their size is bound: items are dealt
into shards of at most ``shard_words`` words. The driver builds one shard at a
time. With one shard, texts stream through it. With more, a task takes about
``hold_bytes`` of texts and leads them through one automaton after the other, each
loaded from the executor's disk and dropped again, so a worker never has two.

Defined results: null or empty texts have no words and no hits; null or empty
items have no windows; items of equal text all count, rows of one item_id are one
item with the windows of all of them, and rows without item_id are one item
without a name: it counts, and the digest leaves it out. A very long text is
one run of words (some 40 bytes for each). Rows are judged one by one, so
repeated rows and ties need nothing special; an empty table of items marks
nothing, an empty table of documents gives no rows. Only the named columns are
read, other columns never clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._io import frugal, release
from quern.llm._words import ALNUM, mix, words_of

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PAIR = np.uint64(0xA24BAED4963EE407)
_BITS = 22  # of the pair table: 4 MB


def normalise(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8").lower())


class Automaton:
    """A generalised suffix automaton over words.

    ``items_of[state]`` names the items with an occurrence of the window that
    the state stands for; ``short[state]`` lists (words, item) of whole short
    items that are suffixes of what the state stands for.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        self.ids: list[object] = []
        self.shortest = window
        whole: list[tuple[int, int, list[bytes]]] = []
        for item_id, words in items:
            if not words:
                continue
            own = len(self.ids)
            self.ids.append(item_id)
            self.shortest = min(self.shortest, len(words))
            last = 0
            for w in words:
                last = self._extend(last, w, ends)
                ends[last].add(own)
            if len(words) < window:
                whole.append((own, len(words), words))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:  # an occurrence of a string is one of its suffixes
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.items_of = {s: sorted(ends[s]) for s in order if self.length[self.link[s]] < window <= self.length[s]}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for own, n, words in whole:
            state = 0
            for w in words:
                state = self.next[state][w]
            self.short.setdefault(state, []).append((n, own))

    def _extend(self, last: int, w: bytes, ends: list[set[int]]) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w, ends)
        new = self._state(self.length[last] + 1, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w, ends)
        return new

    def _state(self, length: int, ends: list[set[int]]) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: bytes, ends: list[set[int]]) -> int:
        new = self._state(self.length[p] + 1, ends)
        self.next[new] = dict(self.next[q])
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (half open, merged, ascending) and the items that occur."""
        window, nxt, link, length = self.window, self.next, self.link, self.length
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = matched = 0
        for i, w in enumerate(words, 1):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(w, 0)
            matched = matched + 1 if state else 0
            reach, s = 0, state
            while s > 0:  # the suffixes of what is matched, longest first
                have = min(matched, length[s])
                if s in self.items_of and have >= window:
                    found.update(self.items_of[s])
                    reach = window
                for n, own in self.short.get(s, ()):
                    if n <= have:
                        found.add(own)
                        reach = max(reach, n)
                if not self.short and have <= window:
                    break
                s = link[s]
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, found

    def pair_table(self) -> np.ndarray:
        """Flags by hash of the word pairs (of the words, if an item has only one) of all items."""
        table = np.zeros(1 << _BITS, dtype=bool)
        words = sorted({w for s in self.next for w in s})
        if not words:
            return table
        hashed = dict(zip(words, next(words_of(pa.array([b" ".join(words).decode()]), ALNUM, fold=False)).hashes, strict=True))
        if self.shortest < 2:
            table[np.array([h for h in hashed.values()], dtype=np.uint64) >> np.uint64(64 - _BITS)] = True
            return table
        pairs = {(a, b) for s in self.next for a, t in s.items() for b in self.next[t]}
        left, right = (np.array([hashed[p[k]] for p in pairs], dtype=np.uint64) for k in (0, 1))
        table[pair_slot(left, right)] = True
        return table


def pair_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _PAIR + right) >> np.uint64(64 - _BITS)


@dataclass
class Marks:
    """Hits of one text: its number of words, merged word spans, items."""

    n_words: int
    spans: list[tuple[int, int]]
    items: set[int]
    at: list[tuple[int, int]]  #: byte spans in the text's UTF-8


class Matcher:
    """Marks all texts of an Arrow array against one automaton."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.table = automaton, automaton.pair_table()

    def marks(self, texts: pa.Array) -> list[Marks]:
        a, out = self.automaton, []
        single = a.shortest < 2
        for words in words_of(texts, ALNUM, fold=True):
            h, bounds = words.hashes, words.bounds
            own = [Marks(int(hi - lo), [], set(), []) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            out += own
            if not a.ids or not len(h):
                continue
            if single:
                fit = self.table[h >> np.uint64(64 - _BITS)]
            else:
                fit = np.zeros(len(h), dtype=bool)
                fit[:-1] = self.table[pair_slot(h[:-1], h[1:])]
                inner = bounds[1:-1]
                fit[inner[inner > 0] - 1] = False  # pairs over two texts
            edge = np.flatnonzero(np.diff(np.concatenate(([False], fit, [False])).astype(np.int8)))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if single:  # a run of words may go over several texts
                    cuts = [lo, *bounds[(bounds > lo) & (bounds < hi)].tolist(), hi]
                else:
                    hi += 1
                    cuts = [lo, hi]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if y - x >= a.shortest:
                        spans, found = a.stream([words.word(i, True) for i in range(x, y)])
                        if spans:
                            text = int(np.searchsorted(bounds, x, side="right")) - 1
                            m, first = own[text], int(bounds[text])
                            m.spans += [(x + s - first, x + e - first) for s, e in spans]
                            m.items |= found
        return out


def word_bytes(text: str) -> list[tuple[int, int]]:
    """Where the words of a text are, in its UTF-8."""
    return [m.span() for m in _WORD.finditer(text.encode("utf-8").lower())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def shards(items: DataFrame, window: int, shard_words: int, *, id_col: str = "item_id", text_col: str = "text") -> Iterator[Automaton]:
    """Automata of at most ``shard_words`` words each (or of one item), one after the other.

    Items come to the driver one partition after the other, and each shard is
    built from at most ``shard_words`` words.
    """
    own, size = [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = normalise(row["t"])
        if own and size + len(words) > shard_words:
            yield Automaton(own, window)
            own, size = [], 0
        own.append((row["i"], words))
        size += len(words)
    yield Automaton(own, window)


class Shards:
    """Broadcast automata, and how a task leads its batches through them."""

    def __init__(self, docs: DataFrame, automata: Iterable[Automaton], hold_bytes: int) -> None:
        send = docs.sparkSession.sparkContext.broadcast
        self.held = [(uuid.uuid4().hex, send(a)) for a in automata]
        self.hold_bytes = hold_bytes

    def over(self, at: int, f: Callable[[pa.RecordBatch, list[tuple[list[object], list[Marks]]]], pa.RecordBatch | pa.Table]) -> Callable:
        """A function for ``mapInArrow``: ``f`` of each batch and, for each automaton, its ids and its marks of the texts in column ``at``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: list[pa.RecordBatch] = []
            size = 0
            for batch in batches:
                own.append(batch)
                size += batch.column(at).nbytes
                if len(self.held) == 1 or size >= self.hold_bytes:
                    yield from self._judged(own, at, f)
                    own, size = [], 0
            if own:
                yield from self._judged(own, at, f)

        return frugal(run)

    def _judged(self, batches: list[pa.RecordBatch], at: int, f: Callable) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[] for _ in batches]
        for key, automaton in self.held:
            m = matcher(key, automaton, keep=len(self.held) == 1)
            for marks, batch in zip(found, batches, strict=True):
                marks.append((m.automaton.ids, m.marks(batch.column(at))))
            del m
        if len(self.held) > 1:
            release()
        for batch, marks in zip(batches, found, strict=True):
            out = f(batch, marks)
            if out.num_rows:
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)


_MATCHERS: dict[str, Matcher] = {}


def matcher(key: str, broadcast, keep: bool) -> Matcher:  # noqa: ANN001
    """The matcher of a broadcast automaton; a worker keeps that of a benchmark of one shard, and else none."""
    if key in _MATCHERS:
        return _MATCHERS[key]
    _MATCHERS.clear()
    made = Matcher(broadcast.value)
    broadcast.__dict__.pop("_value", None)  # it can be read from disk again
    if keep:
        _MATCHERS[key] = made
    return made


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,stop:long>>, items array<string>"


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    shard_words: int = 1_000_000,
    hold_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: hit words, the spans of words, the items."""
    held = Shards(docs, shards(items, window, shard_words, id_col=item_id, text_col=item_text), hold_bytes)

    def judged(batch: pa.RecordBatch, parts: list[tuple[list[object], list[Marks]]]) -> pa.Table:
        rows = []
        for i in range(batch.num_rows):
            spans = merged([s for _, m in parts for s in m[i].spans])
            found = {names[k] for names, m in parts for k in m[i].items}
            ids = sorted(str(x) for x in found if x is not None)
            digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
            rows.append((parts[0][1][i].n_words, sum(e - s for s, e in spans), len(found), digest, bool(spans), [{"start": s, "stop": e} for s, e in spans], ids))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), span, pa.list_(pa.string())]
        return pa.table([batch.column(0).cast(pa.int64()), *(pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types))], names=names)

    return docs.select(id_col, text_col).mapInArrow(held.over(1, judged), SCHEMA)


def clean(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    max_span: int = 0,
    max_coverage: float = 0.5,
    shard_words: int = 1_000_000,
    hold_bytes: int = 32 << 20,
    text_col: str = "text",
    length_col: str | None = "n_chars",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` without the benchmark's passages.

    A span of more than ``max_span`` hit words is cut out of its text, from its
    first word to its last; a text with more than ``max_coverage`` of its words
    hit is dropped. Other texts stay as they are. ``length_col``, if the table
    has it, follows the new text.
    """
    columns = docs.columns
    held = Shards(docs, shards(items, window, shard_words, id_col=item_id, text_col=item_text), hold_bytes)
    at = columns.index(text_col)
    count_at = columns.index(length_col) if length_col in columns else None

    def judged(batch: pa.RecordBatch, found: list[tuple[list[object], list[Marks]]]) -> pa.RecordBatch:
        texts, parts = batch.column(at), [m for _, m in found]
        stays, new = [True] * len(texts), {}
        for i in range(len(texts)):
            spans = merged([s for m in parts for s in m[i].spans])
            if not spans:
                continue
            if sum(e - s for s, e in spans) > max_coverage * parts[0][i].n_words:
                stays[i] = False
            elif spans := [(s, e) for s, e in spans if e - s > max_span]:
                text = texts[i].as_py()
                where, data, out, done = word_bytes(text), text.encode("utf-8"), [], 0
                for s, e in spans:
                    out.append(data[done : where[s][0]])
                    done = where[e - 1][1]
                new[i] = b"".join([*out, data[done:]]).decode("utf-8")
        out = list(batch.columns)
        if new:
            out[at] = pa.array([new.get(i, x.as_py()) for i, x in enumerate(texts)], type=texts.type)
            if count_at is not None:
                out[count_at] = pa.array([len(new[i]) if i in new else x.as_py() for i, x in enumerate(batch.column(count_at))], type=batch.column(count_at).type)
        return pa.RecordBatch.from_arrays(out, schema=batch.schema).filter(pa.array(stays, type=pa.bool_()))

    return docs.mapInArrow(held.over(at, judged), docs.schema)
