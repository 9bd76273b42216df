"""N-gram Jaccard self-join by signature trees, exact.

Documents are sets of word shingles; two link when the Jaccard similarity of
their sets reaches a threshold t. The result is each document's component of
links. Steps:

1. Shingles are hashed (64 bits; hashes stand for shingles, a digest of 128 bits
   for a set). Equal sets become one node, whatever the number of copies.
2. Blocks. Sets that reach t differ in at most H shingles (those in one of the
   two only), H being (1 - t) / t of the smaller's size. Sizes are in geometric
   bands of ratio 1 / t, so two such sets are in one band or in neighbours; a
   band and the next share one random deal of all shingles into G > H parts. At
   least G - H parts of the two sets are then equal. Each set gives a signature
   (a hash of the part) for each part of two shingles or more; parts of fewer
   say little, so they are given only by sets that have at least G - H of them:
   if all equal parts are small, both sets have so many (Arasu et al. 2006, with
   this refinement). Nodes that share a signature are joined to the smallest of
   them; the components of these unproven edges are blocks. Linked nodes are
   always in one block, and each node is in one. Parts have three to six shingles,
   so passages that many texts share chain texts that are not alike into blocks
   that grow with the table (at 0.5 GB and t = 0.8 one of 95,943 nodes).
   A block larger than a task is therefore split by prefixes: shingles are
   ordered by the number of nodes of such blocks that hold them, and sets that
   reach t share one of their (1 - t) * n + 1 rarest shingles (Chaudhuri et al.
   2006). Components of nodes that share a shingle of these prefixes take the
   block's place; a node that shares none has no link.
3. Only texts of nodes in blocks are read again. A block is one task, or, if it
   holds more than ``task_shingles`` or ``task_docs``, chunks by size band and
   hash, and a task for each pair of chunks whose sizes fit. In a task a
   signature tree holds, for each tree node, the OR of its documents' token
   bitmaps and its range of sizes. Dual traversal goes down pairs of tree nodes
   and leaves a pair as soon as its largest possible overlap is too small for
   its sizes. Pairs of documents that are left, and not in one component of the
   task already, are compared by their sets. Tasks return spanning links. A
   bitmap of W bits can merge tokens, so a tree node also keeps its ``excess``,
   the most that a set is larger than its bitmap's bits; an overlap is at most
   ``popcount(A & B) + min(excess)``. No link is lost.
4. Components of the links, then of all copies.

Hot groups, in two steps: before the shuffle each task brings a signature that
many of its sets share down to one row and local edges to a leader, and keeps the
leader for the batches that follow; the minimum over tasks comes after the shuffle.
So a hot signature has about a row for each task, however many copies there are.

Cost: shingles of nodes in large blocks are shuffled once, and once more those
that two nodes share. A block that is large after its prefixes too, and in which
many chunks have fitting sizes (a huge group of near copies, not of exact ones),
needs the pairs of these chunks.

Defined results: a document without words (null or empty text too) has no
shingles and links with nothing. Rows of the same id are one document of the
result (each row is returned, in one component). A row without id is returned
with the component of its copies, or null. Ties need nothing special: the
result is a set of components. A very long text is one set, held by one task (eight
bytes for each shingle). An empty table gives no rows. Only the named columns are
read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._io import drop, frugal, small_batches, stored, tidy
from quern.llm._words import SPACED, mix, shingle_sets, words_of
from quern.llm.components import connected_components, heavy_of, join_dealt

_U = np.uint64


# ---- sets


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for words in words_of(texts, SPACED, fold=True):
        yield from shingle_sets(words, k)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers."""
    if not len(s):
        return 0, 0
    a = mix(s * _U(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64)
    b = mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, own_id, n, d1, d2) of each row of (_i, _t, _own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *_digest(s)) for s in _sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(3))], names=["doc_id", "own_id", "n", "d1", "d2"])

    return docs.mapInArrow(frugal(run), "doc_id long, own_id long, n long, d1 long, d2 long")


# ---- blocks


class Deals:
    """How shingles are dealt into parts, by size band."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.log = np.log(den / num) * (1 + 1e-9)
        self.known: dict[int, tuple[int, int]] = {}

    def band(self, n: int) -> int:
        return int(np.floor(np.log(n) / self.log))

    def parts(self, band: int) -> tuple[int, int]:
        """(G, H) for pairs of which the smaller set is in ``band``."""
        if band not in self.known:
            low, high = np.exp(band * self.log), int(np.exp((band + 1) * self.log)) + 1
            most = high * (self.den - self.num) // self.num
            g = most + 1
            for _ in range(4 if most else 0):  # parts of fewer than two shingles are to be fewer than g - most
                mean = low / g
                small = g * np.exp(-mean) * (1 + mean)
                g = most + 1 + int(np.ceil(small + 2 * np.sqrt(small)))
            self.known[band] = g, most
        return self.known[band]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Of a set that is not empty. Sets that only equal ones reach have none."""
        out = []
        own = self.band(len(s))
        for band in (own - 1, own):
            if band < 0:
                continue
            g, most = self.parts(band)
            if not most:
                continue
            salt = mix(np.array([band], dtype=np.uint64))
            dealt = mix(s ^ salt)
            part = ((dealt >> _U(32)) * _U(g)) >> _U(32)
            order = np.argsort(part, kind="stable")
            part, dealt = part[order], dealt[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            count = np.diff(np.append(first, len(part)))
            sums = mix(np.add.reduceat(dealt, first) + (part[first] + _U(1)) * _U(0x9E3779B97F4A7C15) + salt)
            empty = g - len(first)
            if empty + np.count_nonzero(count < 2) >= g - most:
                out.append(sums)
                if empty:
                    there = np.ones(g, dtype=bool)
                    there[part[first].astype(np.int64)] = False
                    out.append(mix((np.flatnonzero(there).astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15) + salt))
            else:
                out.append(sums[count > 1])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


class Leaders:
    """Leaders of signatures that many sets of a task have shared (a bounded number of them)."""

    def __init__(self, shared: int = 4, most: int = 200_000) -> None:
        self.shared, self.most = shared, most
        self.keys, self.nodes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which signatures have a leader, and the leaders of those."""
        if not len(self.keys):
            return np.zeros(len(signatures), bool), self.nodes
        at = np.minimum(np.searchsorted(self.keys, signatures), len(self.keys) - 1)
        known = self.keys[at] == signatures
        return known, self.nodes[at[known]]

    def add(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.most:
            self.keys, self.nodes = self.keys[:0], self.nodes[:0]
        keys, nodes = np.concatenate((self.keys, keys[: self.most])), np.concatenate((self.nodes, nodes[: self.most]))
        order = np.argsort(keys, kind="stable")
        self.keys, self.nodes = keys[order], nodes[order]


def _local(signatures: np.ndarray, nodes: np.ndarray, leaders: Leaders) -> tuple[np.ndarray, np.ndarray]:
    """A batch of (signature, node) with one row for each signature that has no leader yet; other nodes are joined to the leader by rows of their own."""
    known, leader = leaders.of(signatures)
    a, b = [nodes[known]], [leader]
    signatures, nodes = signatures[~known], nodes[~known]
    order = np.lexsort((nodes, signatures))
    signatures, nodes = signatures[order], nodes[order]
    first = np.flatnonzero(np.concatenate(([True], signatures[1:] != signatures[:-1]))) if len(signatures) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(signatures)))
    a.append(nodes)
    b.append(np.repeat(nodes[first], count))
    leaders.add(signatures[first[count >= leaders.shared]], nodes[first[count >= leaders.shared]])
    left, right = np.concatenate(a), np.concatenate(b)
    left, right = left[left != right], right[left != right]
    made, at = np.unique(mix(left.view(np.uint64) * _U(0xA24BAED4963EE407) + mix(right.view(np.uint64))), return_index=True)
    return np.concatenate((signatures[first], made, made)), np.concatenate((nodes[first], left[at], right[at]))


def _block_edges(docs: DataFrame, k: int, num: int, den: int, hold: int = 500_000, copies: int = 100_000) -> DataFrame:
    """(a, b): digests of sets that share a signature, each with the smallest that does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deals, leaders = Deals(num, den), Leaders()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def rows() -> pa.RecordBatch:
            keys, nodes = _local(np.concatenate(held), np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in held]), leaders)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes)], names=["key", "node"])

        for batch in batches:
            for s in _sets(batch.column(0), k):
                node = _digest(s)[0]
                if not len(s) or node in seen:  # a copy's signatures are there already
                    continue
                seen.add(node)
                held.append(deals.signatures(s))
                owners.append(node)
                size += len(held[-1])
                if size >= hold:
                    yield rows()
                    held, owners, size = [], [], 0
                    if len(seen) > copies:
                        seen.clear()
        if size:
            yield rows()

    shared = Window.partitionBy("key")
    rows = docs.select("_t").mapInArrow(frugal(run), "key long, node long")
    return rows.select(F.min("node").over(shared).alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


# ---- signature trees


class Level:
    """Tree nodes: bitmaps, least and largest size, excess."""

    def __init__(self, maps: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray) -> None:
        self.maps, self.low, self.high, self.excess = maps, low, high, excess

    def above(self, fan: int) -> Level:
        cuts = np.arange(0, len(self.maps), fan)
        return Level(np.bitwise_or.reduceat(self.maps, cuts), np.minimum.reduceat(self.low, cuts), np.maximum.reduceat(self.high, cuts), np.maximum.reduceat(self.excess, cuts))


class Tree:
    """Documents in the order of the tree, and its levels from documents upwards.

    Node i of a level has nodes ``FAN * i`` to ``FAN * i + FAN - 1`` of the level below.
    """

    FAN = 8

    def __init__(self, ids: list[int], sets: list[np.ndarray], bits: int) -> None:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        lead = np.array([s[0] for s in sets], dtype=np.uint64)
        order = np.lexsort((lead, sizes // 8))
        self.ids, self.sizes, self.sets = np.array(ids, dtype=np.int64)[order], sizes[order], [sets[i] for i in order]
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for i, s in enumerate(self.sets):
            at = s & _U(bits - 1)
            np.bitwise_or.at(maps[i], (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        self.levels = [Level(maps, self.sizes, self.sizes, self.sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1].maps) > 1:
            self.levels.append(self.levels[-1].above(self.FAN))


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], dtype=np.int64)


def traverse(left: Tree, right: Tree, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links between the documents of two trees (or of one: ``left is right``)."""
    same = left is right
    shift = 0 if same else len(left.ids)
    union = Union(shift + len(right.ids))
    links: list[tuple[int, int]] = []
    batch = max(256, (1 << 20) // left.levels[0].maps.shape[1])
    work = [(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        x, y, i, j = work.pop()
        if len(i) > batch:
            work.append((x, y, i[batch:], j[batch:]))
            i, j = i[:batch], j[:batch]
        a, b = left.levels[x], right.levels[y]
        fit = (den * a.high[i] >= num * b.low[j]) & (den * b.high[j] >= num * a.low[i])
        i, j = i[fit], j[fit]
        if x == y == 0:
            roots = union.roots()
            fit = roots[i] != roots[shift + j]
            if same:
                fit &= i < j
            i, j = i[fit], j[fit]
        if not len(i):
            continue
        shared = np.bitwise_count(a.maps[i] & b.maps[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(shared + np.minimum(a.excess[i], b.excess[j]), a.high[i]), b.high[j])
        fit = (num + den) * most >= num * (a.low[i] + b.low[j])
        i, j = i[fit], j[fit]
        if x == y == 0:
            for c, d in zip(i.tolist(), j.tolist(), strict=True):
                rc, rd = union.find(c), union.find(shift + d)
                if rc != rd:
                    s, t = left.sets[c], right.sets[d]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if den * both >= num * (len(s) + len(t) - both):
                        union.up[max(rc, rd)] = min(rc, rd)
                        links.append((int(left.ids[c]), int(right.ids[d])))
            continue
        down_x, down_y = x >= y and x > 0, y >= x and y > 0
        for down, level, which in ((down_x, x, 0), (down_y, y, 1)):
            if down:
                below = len((left, right)[which].levels[level - 1].maps)
                child = (i, j)[which][:, None] * Tree.FAN + np.arange(Tree.FAN)
                there = child < below
                i, j = (np.repeat(v, there.sum(axis=1)) for v in (i, j))
                if which:
                    j = child[there]
                else:
                    i = child[there]
        if same and x == y:
            there = i <= j
            i, j = i[there], j[there]
        work.append((x - down_x, y - down_y, i, j))
    return links


def _task(sides: list[tuple[list[int], list[np.ndarray]]], num: int, den: int) -> list[tuple[int, int]]:
    """Links of a task: within side 0, or between 0 and 1 if both are there."""
    largest = max((len(s) for _, sets in sides for s in sets), default=1)
    bits = min(1 << 15, max(256, 1 << (2 * largest - 1).bit_length()))
    trees = [Tree(ids, sets, bits) for ids, sets in sides if ids]
    return traverse(trees[0], trees[-1], num, den) if trees else []


# ---- the join


def _flagged(df: DataFrame, id_col: str, ids: DataFrame, node: str) -> DataFrame:
    """``df`` with ``_near_flag``: true for all rows whose id is in ``ids``, and for a few others.

    Hashes of ids are flags of a bitmap of 128 KB to 16 MB, by the number of ids,
    which is broadcast in rows of 4 KB. (Of more ids it lets more through.)
    """
    bits = min(27, max(20, (16 * ids.count()).bit_length()))

    def at(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits)) + 1  # bit v of bucket 1 stands for v + 1

    maps = ids.groupBy(F.bitmap_bucket_number(at(node)).alias("_near_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(node))).alias("_near_bits"))
    place = F.bitmap_bit_position(at(id_col))
    octet = F.conv(F.hex(F.substring(F.col("_near_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    flag = F.coalesce(F.getbit(octet, (place % 8).cast("int")) == 1, F.lit(False)) & F.col(id_col).isNotNull()
    return df.join(F.broadcast(maps), F.bitmap_bucket_number(at(id_col)) == F.col("_near_bucket"), "left").select(*(F.col(f"`{c}`") for c in df.columns), flag.alias("_near_flag"))


def _refined(docs: DataFrame, members: DataFrame, k: int, num: int, den: int, task_shingles: int, task_docs: int) -> DataFrame:
    """``members`` (node, n, d1, block) as (node, n, block): blocks larger than a task are split by prefixes of rare shingles."""
    of_block = members.groupBy("block").agg(F.sum("n").alias("_w"), F.count("*").alias("_c"))
    large = stored(of_block.where((F.col("_w") > task_shingles) | (F.col("_c") > task_docs)).select("block"), "large")  # each is more than a task
    if large.isEmpty():
        return members.select("node", "n", "block")
    wide = members.join(F.broadcast(large), "block", "left_semi")
    texts = _flagged(docs, "_i", wide, "node").where("_near_flag").select("_t")

    def run(batches: Iterator[pa.RecordBatch], hold: int = 500_000) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            for s in _sets(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size >= hold:
                    yield _members_of(held)
                    held, size = [], 0
            if size:
                yield _members_of(held)

    rows = stored(texts.mapInArrow(frugal(run), "d1 long, s long"), "shingles")
    numbers = stored(rows.groupBy("s").agg(F.count("*").alias("f")).where("f > 1"), "shared-shingles")
    # From the most frequent on, a set's prefix begins at place t * n; sets that reach t share a shingle of their prefixes.
    place = F.dense_rank().over(Window.partitionBy("d1").orderBy(F.desc("f"), F.desc("s")))
    ranked = rows.join(numbers, "s").join(wide.groupBy("d1").agg(F.min("n").alias("n")), "d1").withColumn("_r", place)
    prefixes = stored(ranked.where(F.col("_r") * den >= F.col("n") * num).select("d1", "s"), "prefixes")
    drop(rows)
    least = prefixes.groupBy("s").agg(F.min("d1").alias("a"), F.max("d1").alias("z")).where("a <> z").select("s", "a")
    blocks = connected_components(prefixes.join(least, "s").select("a", F.col("d1").alias("b")))
    split = wide.select("node", "n", "d1").join(blocks.select(F.col("node").alias("d1"), F.col("component").alias("block")), "d1")
    whole = members.join(F.broadcast(large), "block", "left_anti")
    return stored(whole.select("node", "n", "block").unionByName(split.select("node", "n", "block")), "refined")


def _members_of(sets: list[np.ndarray]) -> pa.RecordBatch:
    d1 = np.repeat(np.array([_digest(s)[0] for s in sets], dtype=np.int64), [len(s) for s in sets])
    return pa.RecordBatch.from_arrays([pa.array(d1), pa.array(np.concatenate(sets).view(np.int64))], names=["d1", "s"])


def _tasks(members: DataFrame, num: int, den: int, task_shingles: int, task_docs: int) -> DataFrame:
    """(node, key_a, key_b, side): the tasks of each of ``members`` (node, n, block)."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)) * (1 + 1e-9))).cast("int")
    members = members.withColumn("_band", band)
    sizes = stored(members.groupBy("block", "_band").agg(F.sum("n").alias("_w"), F.count("*").alias("_c")), "bands")
    of_block = sizes.groupBy("block").agg((F.sum("_w") <= task_shingles).alias("_light"), (F.sum("_c") <= task_docs).alias("_few"))
    whole = F.col("_light") & F.col("_few")
    count = F.when(whole, 1).otherwise(F.greatest(F.ceil(F.col("_w") / task_shingles), F.ceil(F.col("_c") / task_docs)))
    sizes = sizes.join(of_block, "block").select("block", "_band", "_c", F.when(whole, -9).otherwise(F.col("_band")).alias("band"), count.alias("_k"))
    most = sizes.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.max("_c"), F.lit(0))).first()
    heavy = heavy_of(most[0])
    dealt = members.join(sizes, ["block", "_band"]) if most[1] <= heavy else join_dealt(members, sizes, ["block", "_band"], "_c", heavy)
    chunk = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")
    members = stored(dealt.select("node", "block", "band", chunk.alias("chunk")), "members")
    chunks = members.groupBy("block", "band", "chunk").agg(F.min("node").alias("key"))
    a, b = (chunks.select("block", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "chunk", "key"))) for s in "ab")
    pairs = a.join(b, "block").where((F.abs(F.col("band_a") - F.col("band_b")) <= 1) & (F.col("key_a") <= F.col("key_b")))
    one, two = (F.struct(F.lit(k).alias("side"), F.col(f"band_{s}").alias("band"), F.col(f"chunk_{s}").alias("chunk")) for k, s in enumerate("ab"))
    sides = F.when(F.col("key_a") == F.col("key_b"), F.array(one)).otherwise(F.array(one, two))
    tasks = pairs.select("block", "key_a", "key_b", F.explode(sides).alias("s")).select("block", "key_a", "key_b", "s.side", "s.band", "s.chunk")
    return members.join(tasks, ["block", "band", "chunk"]).select("node", "key_a", "key_b", "side")


def _tree_join(dealt: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """(a, b): spanning links of each task of ``dealt`` (key_a, key_b, side, node, n, text)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task: tuple | None = None
        sides: list[tuple[list[int], list[np.ndarray]]] = [([], []), ([], [])]
        out: list[tuple[int, int]] = []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)
            for (key_a, key_b, side, node, n), s in zip(keys, _sets(batch.column(5), k), strict=True):
                if (key_a, key_b) != task:
                    out += _task(sides, num, den)
                    task, sides = (key_a, key_b), [([], []), ([], [])]
                if n == len(s):  # else the text of another row of this id
                    sides[side][0].append(node)
                    sides[side][1].append(s)
            if out:
                yield _edges(out)
                out = []
        out += _task(sides, num, den)
        if out:
            yield _edges(out)

    keys = ["key_a", "key_b"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(frugal(link), "a long, b long")


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], names=["a", "b"])


def components(
    df: DataFrame,
    *,
    k: int = 4,
    threshold: tuple[int, int] = (85, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
    task_shingles: int = 2_000_000,
    task_docs: int = 4096,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_shingles, component_id`` (the smallest id reached)."""
    num, den = threshold
    own = F.col(f"`{id_col}`").cast("long")
    docs = df.select(own.alias("_i"), F.col(f"`{text_col}`").cast("string").alias("_t"), own.alias("_own"))
    with small_batches(df.sparkSession):
        return _components(docs, k, num, den, task_shingles, task_docs).drop("own_id")


def _components(docs: DataFrame, k: int, num: int, den: int, task_shingles: int, task_docs: int) -> DataFrame:
    """All but the last, narrow joins are run here."""
    with tidy(docs.sparkSession):
        profiles = stored(_profiles(docs, k), "profiles")
        nodes = profiles.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"))
        blocks = connected_components(_block_edges(docs.where("_i IS NOT NULL"), k, num, den)).select(F.col("node").alias("d1"), F.col("component").alias("block"))
        members = stored(nodes.join(blocks, "d1").select("node", "n", "d1", "block"), "nodes")
        members = _refined(docs, members, k, num, den, task_shingles, task_docs)
        texts = _flagged(docs, "_i", members, "node").where("_near_flag").select("_i", "_t")
        tasks = _tasks(members, num, den, task_shingles, task_docs)
        dealt = texts.join(tasks.join(members.select("node", "n"), "node"), F.col("_i") == F.col("node")).select("key_a", "key_b", "side", "node", "n", "_t")
        found = connected_components(_tree_join(dealt, num, den, k)).withColumnRenamed("component", "_c")
    reps = nodes.select("d1", "d2", "node").join(found, "node", "left").select("d1", "d2", F.coalesce("_c", "node").alias("_c"))
    return (
        profiles.select("doc_id", "own_id", "n", "d1", "d2")
        .join(reps, ["d1", "d2"], "left")
        .select("doc_id", "own_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(df: DataFrame, *, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (null is the largest). Columns stay as they are.

    What is compared are texts, whatever their ids: rows that are equal in id and
    text are one document, of which one stays; rows of one id and other texts are
    documents of their own, and so are rows without id. A document without words stays.
    """
    # A document is known by a hash of id and text; whatever two documents of one hash could be, both are kept or go by what links they have.
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    key = F.xxhash64(own.isNull(), own, text.isNull(), text).alias("_near_key")
    with small_batches(df.sparkSession):
        found = stored(_components(df.select(key.alias("_i"), text.alias("_t"), own.alias("_own")), k, *threshold, options.get("task_shingles", 2_000_000), options.get("task_docs", 4096)), "near-found")
    # What goes and what comes again is told by keys alone; only rows of such keys are shuffled with their texts.
    times = found.groupBy("doc_id").agg(F.count("*").alias("_n"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("_none"), "own_id", "doc_id"))["doc_id"].alias("doc_id"))
    told = times.join(first.select("doc_id", F.lit(True).alias("_near_stays")), "doc_id", "left")
    odd = stored(told.where("_n > 1 OR _near_stays IS NULL").select(F.col("doc_id").alias("_near_id"), F.col("_near_stays").isNotNull().alias("_near_stays")), "odd-ids")
    rows = _flagged(df.withColumn("_near_key", key), "_near_key", odd, "_near_id")
    columns = [F.col(f"`{c}`") for c in df.columns]
    close = rows.where("_near_flag").join(odd, F.col("_near_key") == F.col("_near_id"), "left").where(F.coalesce("_near_stays", F.lit(True)))
    return rows.where("NOT _near_flag").select(columns).unionByName(close.select(columns).dropDuplicates([id_col, text_col]))
