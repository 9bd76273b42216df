"""Token ids in directly addressable codes (Brisaboa, Ladra, Navarro 2009).

Format. A store is a Parquet folder (Spark commits its tasks, on any file
system; a lost executor leaves no half-written file). Each row is a block of
whole documents in ascending order of ``doc_id`` (then of a hash of the text), with about
``block_tokens`` ids in four parts, all little-endian:

* ``doc_ids`` int64[] and ``doc_offsets`` int64[] (documents + 1): where each
  document's ids begin in the block;
* ``levels``: an id is cut into chunks of 8 bits, lowest first. Level k has one
  ``codes`` byte for each id that has a k-th chunk, a ``more`` bitmap that says
  which of these have another, and ``ranks`` uint32[], the number of set bits
  before each 512 of ``more``;
* ``part``, ``seq``, ``before``: where the block stands in the order of the store,
  and the number of ids before it in its part.

The k-th id of a block is read by ``get(k)``: one byte and one bit on each level
and one rank (a directory entry and at most 64 bytes) between levels; nothing
is decoded. ``tokens`` decodes whole blocks, vectorised.

Encoding uses the tokenizers library. A text is cut before each single blank
between two characters that are not white space; byte-level BPE never joins
over such a place, so the ids of the pieces, one after the other, are those of
the text. Each Python worker keeps the ids of words that it has seen (at most
``MEMORY`` of them, those used last), and hands only new ones to the tokenizer.
A text that holds the string of an added token is left to the tokenizer whole.

Defined results: null and empty texts have only the end id; repeated rows and
equal ``doc_id`` stay (ordered by a hash of the text); a null ``doc_id`` comes
first and reads back as null; a text longer than a block is a block of its own; an
empty table gives an empty store. Only the two named columns are read, so other
columns never clash.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._io import frugal, per_batch, shared_dir

MEMORY = 1_500_000
# A blank beside white space or at an end, or white space that only Unicode knows.
_ODD = r"  | [\t\n\v\f\r]|[\t\n\v\f\r] |^ | $|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INNER = re.compile(r"(?<=\S)(?= \S)")

BLOCK_SCHEMA = (
    "part int, seq int, before long, n_tokens long, doc_ids binary, null_ids binary, doc_offsets binary, "
    "levels array<struct<codes: binary, more: binary, ranks: binary>>"
)
_LEVEL = pa.struct([("codes", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_BLOCK = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("doc_offsets", pa.binary()), ("levels", pa.list_(_LEVEL))]
)


# ---- codes


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of an array of unsigned ids below 2**32."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), 64), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.zeros(len(counts), dtype="<u4")
        np.cumsum(counts[:-1], out=ranks[1:])
        levels.append({"codes": rest.astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def decode_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids."""
    out: np.ndarray | None = None
    for level in reversed(levels):
        codes = np.frombuffer(level["codes"], dtype=np.uint8).astype(np.uint32)
        if out is not None and len(out):
            more = np.unpackbits(np.frombuffer(level["more"], dtype=np.uint8), count=len(codes), bitorder="little").view(bool)
            codes[more] |= out << np.uint32(8)
        out = codes
    return out if out is not None else np.zeros(0, dtype=np.uint32)


def get(levels: list[dict[str, bytes]], k: int) -> int:
    """The k-th id, by one byte, one bit and one rank on each level."""
    value = shift = 0
    for level in levels:
        value |= level["codes"][k] << shift
        more = level["more"]
        if not more[k >> 3] >> (k & 7) & 1:
            return value
        block = k >> 9
        before = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        before += int.from_bytes(more[64 * block : k >> 3], "little").bit_count()
        k = before + (more[k >> 3] & ((1 << (k & 7)) - 1)).bit_count()
        shift += 8
    raise ValueError("a level is missing")


# ---- encoding


class Encoder:
    """Ids of texts by a tokenizers file, with a bounded memory of words.

    The memory is an Arrow array of words and, for each, its ids as they follow a
    blank. A word that ends in one stop after a letter is that word and the stop:
    " word," is " word" and ",". New words are encoded many at a time as one text;
    as each token stands for a known number of bytes, and none crosses a word, its
    ids are cut by length. (The vocabulary must be byte-level.) Beyond ``MEMORY``
    words the half that was used last stays.
    """

    def __init__(self, path: str, end_id: int | None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.size[k] = len(token)  # byte-level: one character stands for one byte
        self.stops = [(c, self._plain(c)[0]) for c in ".,;:!?"]
        self.firsts: dict[str, np.ndarray] = {}
        self.words = pa.array([], pa.large_string())
        self.ids, self.at, self.used = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.calls = 0

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " word" for each word, one after the other, and how many each has."""
        n = len(words)
        heads = np.append(np.arange(0, n, 500), n)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(heads, pa.int32()), words), pa.scalar(" ", pa.large_string())).to_pylist()
        ids = [np.array(self.tokenizer.encode_batch_fast([" " + t], add_special_tokens=False)[0].ids, dtype=np.uint32) for t in texts]
        ids = np.concatenate(ids)
        ends = np.cumsum(self.size[ids])
        cuts = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        last = np.searchsorted(ends, cuts)
        if not np.array_equal(ends[last], cuts):
            raise ValueError("a token crosses a place where texts are cut")
        return ids, np.diff(last + 1, prepend=0)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of ``words`` is in memory; those that are not there are learnt."""
        self.calls += 1
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        lost = at < 0
        self.used[at[~lost]] = self.calls
        if lost.any():
            new = words.filter(pa.array(lost)).dictionary_encode()
            if len(self.words) + len(new.dictionary) > MEMORY:
                at[~lost] = self._forget()[at[~lost]]
            at[lost] = len(self.words) + new.indices.to_numpy()
            ids, n = self._new(new.dictionary)
            self.words = pa.concat_arrays([self.words, new.dictionary])
            self.ids = np.concatenate((self.ids, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(n)))
            self.used = np.concatenate((self.used, np.full(len(n), self.calls, np.int32)))
        return at

    def _forget(self) -> np.ndarray:
        """Keep the words of this call and of those before it, at most half of all; the new places."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: max(MEMORY // 2, np.count_nonzero(self.used == self.calls))])
        moved = np.full(len(self.words), -1, np.int64)
        moved[keep] = np.arange(len(keep))
        self.words = self.words.take(pa.array(keep))
        n = np.diff(self.at)[keep]
        self.ids = self.ids[_ranges(self.at[keep], n)]
        self.at = np.concatenate(([0], np.cumsum(n)))
        self.used = self.used[keep]
        return moved

    def _first(self, word: str) -> np.ndarray:
        if word not in self.firsts:
            if len(self.firsts) > MEMORY // 16:
                self.firsts.clear()
            if len(word) > 1000:
                return self._plain(word)
            self.firsts[word] = self._plain(word)
        return self.firsts[word]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned, 32 bits) of all texts, with end ids, and where each text's begin (one more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = np.zeros(len(texts), dtype=bool)  # with the string of an added token: left to the tokenizer
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) | whole
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        values, at = split.values, split.offsets.to_numpy()
        lo, n = at[:-1].copy(), np.diff(at)
        own = [[t] if is_whole else _INNER.split(t) for t, is_whole in zip(texts.filter(pa.array(odd)).to_pylist(), whole[odd].tolist(), strict=True)]
        if own:  # their words (without the blank) stand after those of the others
            n[odd] = list(map(len, own))
            lo[odd] = len(values) + np.cumsum(n[odd]) - n[odd]
            values = pa.concat_arrays([values, pa.array([x[1:] if k else x for t in own for k, x in enumerate(t)], pa.large_string())])
        firsts = [self._first(w) for w in values.take(pa.array(lo)).to_pylist()]
        # A text's first word follows no blank: it is an entry of its own.
        words = pc.if_else(pa.array(_flags(len(values), lo)), "", values).dictionary_encode()
        codes, words = words.indices.to_numpy().astype(np.int64), words.dictionary
        stop = np.full(len(words), -1, np.int64)
        stopped = pc.match_substring_regex(words, "[A-Za-z][.,;:!?]$").to_numpy(zero_copy_only=False)
        for c, token in self.stops:
            stop[stopped & pc.ends_with(words, c).to_numpy(zero_copy_only=False)] = token
        place = self.places(pc.if_else(pa.array(stopped), pc.utf8_slice_codeunits(words, 0, -1), words))
        # A table of entries: the words, the firsts, the end.
        plain = np.diff(self.at)[place]
        sizes = np.concatenate((plain + stopped, np.fromiter(map(len, firsts), np.int64, len(firsts)), [len(self.end)]))
        starts = np.cumsum(sizes) - sizes
        table = np.zeros(int(sizes.sum()), np.uint32)
        table[_ranges(starts[: len(words)], plain)] = self.ids[_ranges(self.at[place], plain)]
        table[(starts[: len(words)] + plain)[stopped]] = stop[stopped]
        table[starts[len(words)] :] = np.concatenate((*firsts, self.end))
        codes[lo] = len(words) + np.arange(len(firsts))
        entries = np.full(int((n + 1).sum()), len(sizes) - 1, np.int64)
        begin = np.cumsum(n + 1) - n - 1
        entries[_ranges(begin, n)] = codes[_ranges(lo, n)]
        ends = np.cumsum(sizes[entries])
        return table[_ranges(starts[entries], sizes[entries])], np.concatenate(([0], ends[begin + n]))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...``, as many as its size, for each start."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _flags(n: int, where: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[where] = True
    return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


# ---- writing and reading


def slice_of(texts: pa.Array, at: int, most: int = 8 << 20) -> pa.Array:
    """The texts from ``at`` on that take about ``most`` bytes together; one at least."""
    sizes = pc.fill_null(pc.binary_length(texts.slice(at, 16384)), 0).to_numpy(zero_copy_only=False)
    return texts.slice(at, max(1, int(np.searchsorted(np.cumsum(sizes), most, side="right"))))


def write(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    *,
    end_id: int | None = 2,
    block_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode ``docs`` into a store at ``path`` (by default a new folder in the shared one).

    ``tokenizer_path`` must be readable on the executors. Texts, not ids, are
    shuffled (once, by ranges of ``doc_id``): they are the smaller of the two.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = [i for i, _ in held]
            row = {
                "part": part,
                "seq": seq,
                "before": before,
                "n_tokens": size,
                "doc_ids": np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
                "null_ids": np.packbits([i is None for i in ids], bitorder="little").tobytes(),
                "doc_offsets": np.cumsum([0, *(len(x) for _, x in held)], dtype="<i8").tobytes(),
                "levels": encode_levels(np.concatenate([x for _, x in held])),
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        enc = encoder(tokenizer_path, end_id)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                few = slice_of(texts, at)
                tokens, ends = enc.encode(few)
                for doc_id, lo, hi in zip(ids[at : at + len(few)], ends.tolist(), ends[1:].tolist(), strict=False):
                    if held and size + hi - lo > block_tokens:
                        yield block()
                        seq, before, size = seq + 1, before + size, 0
                        held.clear()
                    held.append((doc_id, tokens[lo:hi]))
                    size += hi - lo
                at += len(few)
        if held:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    # Rows of one id may be many: they are dealt, and ordered, by a hash of the text.
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("i", "h").sortWithinPartitions("i", "h").drop("h")
    ordered.mapInArrow(frugal(run), BLOCK_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_blocks(spark: SparkSession, path: str, most_parts: int = 1_000_000) -> DataFrame:
    """Blocks with ``first``: the number of ids in the store before the block.

    The sums go over one row per part. Parts are as many as the tasks that wrote
    the store; up to ``most_parts`` their places are broadcast, beyond they are joined.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_own"))
    first = F.coalesce(F.sum("_own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = parts.select("part", first.alias("_first"))
    if parts.count() <= most_parts:
        places = F.broadcast(places)
    return blocks.join(places, "part").withColumn("first", F.col("_first") + F.col("before")).drop("_first")


DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the store: place, number and checksum of its ids."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        out: list[tuple] = []
        for row in batch.to_pylist():
            ids = np.frombuffer(row["doc_ids"], dtype="<i8").tolist()
            null = np.unpackbits(np.frombuffer(row["null_ids"], dtype=np.uint8), count=len(ids), bitorder="little").tolist()
            offsets = np.frombuffer(row["doc_offsets"], dtype="<i8").tolist()
            tokens = memoryview(decode_levels(row["levels"]).astype("<u4").tobytes())
            for i, is_null, lo, hi in zip(ids, null, offsets, offsets[1:], strict=False):
                out.append((None if is_null else i, row["first"] + lo, hi - lo, zlib.crc32(tokens[4 * lo : 4 * hi])))
        return pa.table([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return per_batch(read_blocks(spark, path).select("first", "doc_ids", "null_ids", "doc_offsets", "levels"), run, DOC_SCHEMA)


def tokens(spark: SparkSession, path: str, where: list[int]) -> dict[int, int]:
    """The ids at these places of the whole store, by ``get``; for point reads.

    Blocks are pruned by their first place and size before their bytes are read.
    """
    wanted = sorted(set(where))
    blocks = read_blocks(spark, path)
    hit = F.lit(False)
    for k in wanted:
        hit = hit | ((F.col("first") <= k) & (F.col("first") + F.col("n_tokens") > k))
    out: dict[int, int] = {}
    for row in blocks.where(hit).select("first", "n_tokens", "levels").toLocalIterator():
        levels = [x.asDict() for x in row["levels"]]
        out |= {k: get(levels, k - row["first"]) for k in wanted if row["first"] <= k < row["first"] + row["n_tokens"]}
    return out
