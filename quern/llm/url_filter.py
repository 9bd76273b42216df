"""URL filters over a sorted digest array.

Rules are strings ``host + path``. Their 64-bit xxhash keys are sorted in one
array, beside it the verdicts and the full strings. A worker maps the array
into memory (an unlinked temporary file of its own, in the executor's temporary
folder), so the array may be larger than what a worker touches or holds. A URL's candidates (every suffix of its host at a
label, with every prefix of its path that has the length of some rule's path)
are hashed and probed together by vectorised binary search; a key that is found
is confirmed by its full string, so equal keys of different strings never
decide. The longest rule that fits wins (then the longest host).

A rule table is measured first. Beyond ``max_bytes`` it is dealt, by a hash of
host and path, into arrays of about that size; the driver fetches and packs one at a time,
each is broadcast (Spark keeps it on the executors' disks) and mapped, and URLs
are probed against one after the other. A worker drops the bytes once they are
mapped, so its memory does not grow with the rules. It keeps 256 maps; of more arrays
(beyond 16 GB of rules) it maps all again for each batch: slow, but the same result.

Defined results: a null URL or one without ``://`` has empty host and path, and
no rule but an empty host's fits; an empty table gives no rows; repeated rows
are judged each; of rules that are equal the first verdict (in order of their
text) counts; a rule with a null in it is none; a very long URL has as many candidates as its host
has labels, times the lengths of rule paths. Only the two named columns are read,
so other columns never clash.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._io import per_batch

SCHEMA = "page_id long, host string, path string, rule string, verdict string"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parts(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower case) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def suffixes(host: str) -> list[str]:
    """The host and the hosts above it."""
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def pack(rules: Iterable[Rule]) -> bytes:
    """The file of a rule set: number, sorted keys, ends of strings, host lengths, verdicts, strings."""
    unique: dict[str, Rule] = {}
    for r in sorted(rules, key=lambda r: (r.host, r.path, r.verdict)):
        unique.setdefault(r.host + r.path, r)
    keyed = sorted((xxhash.xxh64_intdigest(s.encode()), s.encode(), r) for s, r in unique.items())
    names = sorted({r.verdict for r in unique.values()})
    head = "\n".join(names).encode()
    lengths = sorted({len(r.path) for r in unique.values()})
    return b"".join(
        [
            np.array([len(keyed), len(head), len(lengths)], "<u8").tobytes(),
            np.array([k for k, _, _ in keyed], "<u8").tobytes(),
            np.cumsum([0, *(len(s) for _, s, _ in keyed)], dtype="<u8").tobytes(),
            np.array([len(r.host.encode()) for _, _, r in keyed], "<u8").tobytes(),
            np.array([names.index(r.verdict) for _, _, r in keyed], "<u8").tobytes(),
            np.array(lengths, "<u8").tobytes(),
            head,
            *(s for _, s, _ in keyed),
        ]
    )


class DigestArray:
    """A mapped rule file."""

    def __init__(self, data: bytes) -> None:
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  unlinked; lives as long as the map
        self.file.write(data)
        self.file.flush()
        n, head, lengths = np.memmap(self.file, "<u8", "r", 0, (3,)).tolist() if data else (0, 0, 0)
        at = 24

        def part(count: int) -> np.ndarray:
            nonlocal at
            out = np.memmap(self.file, "<u8", "r", at, (count,)) if count else np.zeros(0, "<u8")
            at += 8 * count
            return out

        self.keys, self.ends, self.hosts, self.verdicts = part(n), part(n + 1), part(n), part(n)
        self.lengths = part(lengths).tolist()
        self.names = data[at : at + head].decode().split("\n")
        self.text = np.memmap(self.file, "u1", "r", at + head, (int(self.ends[-1]),)) if n and int(self.ends[-1]) else np.zeros(0, "u1")

    def rule(self, k: int) -> bytes:
        return self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """For each candidate the place of the rule that it equals, or -1."""
        out = np.full(len(candidates), -1, dtype=np.int64)
        if not len(self.keys) or not candidates:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), dtype="<u8", count=len(candidates))
        at = np.searchsorted(self.keys, keys)
        open_ = np.arange(len(candidates))
        while len(open_):  # equal keys stand side by side
            open_ = open_[at[open_] < len(self.keys)]
            open_ = open_[self.keys[at[open_]] == keys[open_]]
            for c in open_.tolist():
                if self.rule(int(at[c])) == candidates[c]:
                    out[c] = at[c]
            open_ = open_[out[open_] < 0]
            at[open_] += 1
        return out

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
        """(host, path, rule, verdict) of each; the last two None where no rule fits."""
        split = [parts(u) for u in urls]
        owners: list[int] = []
        candidates: list[bytes] = []
        for k, (host, path) in enumerate(split):
            heads = [path[:n] for n in self.lengths if n <= len(path)]
            for s in suffixes(host):
                candidates += [(s + p).encode() for p in heads]
            owners += [k] * (len(candidates) - len(owners))
        found = self.find(candidates)
        best: dict[int, tuple[int, int, int]] = {}
        for c in np.flatnonzero(found >= 0).tolist():
            rule = int(found[c])
            rank = (len(candidates[c].decode()), int(self.hosts[rule]), rule)
            best[owners[c]] = max(best.get(owners[c], rank), rank)
        out = []
        for k, (host, path) in enumerate(split):
            rule = best[k][2] if k in best else None
            out.append((host, path, None, None) if rule is None else (host, path, self.rule(rule).decode(), self.names[int(self.verdicts[rule])]))
        return out


_MAPPED: dict[str, DigestArray] = {}


def mapped(key: str, broadcast) -> DigestArray:  # noqa: ANN001
    """The array of a broadcast file; mapped once in each Python worker, and only the map is kept."""
    if key not in _MAPPED:
        if len(_MAPPED) >= 256:
            _MAPPED.clear()
        _MAPPED[key] = DigestArray(broadcast.value)
        broadcast.__dict__.pop("_value", None)  # it can be read from disk again
    return _MAPPED[key]


def _packed(rules: DataFrame | Iterable[Rule], max_bytes: int) -> Iterator[bytes]:
    """Rule files of about ``max_bytes`` each; equal strings are in one of them."""
    if not isinstance(rules, DataFrame):
        yield pack(rules)
        return
    rules = rules.select("verdict", "host", "path").dropna()
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]
    count = max(1, -(-size // max(1, max_bytes)))
    dealt = F.pmod(F.xxhash64(F.concat("host", "path")), F.lit(count))
    for k in range(count):
        yield pack(Rule(*r) for r in (rules if count == 1 else rules.where(dealt == k)).collect())


def judge(pages: DataFrame, rules: DataFrame | list[Rule], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``pages``: host, path, the longest rule that fits, its verdict or ``default``.

    ``rules`` is a list or a table ``verdict, host, path``.
    """
    held = [(uuid.uuid4().hex, pages.sparkSession.sparkContext.broadcast(x)) for x in _packed(rules, max_bytes)]

    def run(batch: pa.RecordBatch) -> pa.Table:
        urls = batch.column(1).to_pylist()
        rows = None
        for key, data in held:
            found = mapped(key, data).judge(urls)
            rows = found if rows is None else [_longer(a, b) for a, b in zip(rows, found, strict=True)]
        text = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
        verdicts = pa.array([r[3] if r[3] is not None else default for r in rows], pa.string())
        return pa.table([batch.column(0), *text, verdicts], names=["page_id", "host", "path", "rule", "verdict"])

    return per_batch(pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u")), run, SCHEMA)


def _longer(a: tuple, b: tuple) -> tuple:
    """Of the answers of two arrays that of the longer rule (of equal length, of the longer host: the later start of the path)."""
    if a[2] is None or b[2] is None:
        return a if b[2] is None else b
    return max(a, b, key=lambda x: (len(x[2]), (x[2] + "/").index("/"), x[2]))
