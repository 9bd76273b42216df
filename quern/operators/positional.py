"""Text search by positional postings: words, phrases, fields, AND, OR, NOT.

An index is a table (key, field, term, positions): a row for each word of each
field of each document. A query is a tree of ``Term``, ``Phrase``, ``All``, ``Any``
and ``Not``; ``match`` makes one pass over the postings of the query's words. Each
document's postings of those words meet in one row (a map from word and field to
positions), on which the tree is one Catalyst expression: a phrase holds where the
positions of its words, each less its place in the phrase, have one in common.

``search`` ranks the documents that match by the sum over the query's words (not those
under NOT) of ``(1 + ln tf) * ln(1 + N / df)``, ties by key.

What is shuffled are postings of the query's words only. No document without any of
them can match (a query of nothing but NOT is refused), so none is read twice.

Defined results: null and empty fields have no words; a query without words matches
nothing; repeated words of a query count once; rows of one key are one document;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Term:
    """A word, in a field or in any."""

    word: str
    field: str | None = None


@dataclass(frozen=True)
class Phrase:
    """Words that stand one after the other in a field."""

    words: tuple[str, ...]
    field: str | None = None


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def leaves(q: object, under_not: bool = False) -> list[tuple[str, bool]]:
    """Words of a query, and whether they stand under NOT."""
    if isinstance(q, Term):
        return [(q.word.lower(), under_not)]
    if isinstance(q, Phrase):
        return [(w.lower(), under_not) for w in q.words]
    if isinstance(q, Not):
        return leaves(q.part, not under_not)
    return [x for p in q.parts for x in leaves(p, under_not)]


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    fields: tuple[str, ...]
    n_docs: int


def index(docs: DataFrame, key: str, fields: list[str], path: str | None = None) -> Index:
    """Postings (key, field, term, positions; positions are those in the field, from 0).

    With a path they are written there, sorted by term within tasks, so a search reads
    few row groups; without one they are worked out by each search.
    """
    named = F.array(*(F.struct(F.lit(f).alias("field"), F.split(F.lower(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))), WORD).alias("words")) for f in fields))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.explode(named).alias("f")).select("key", "f.field", F.posexplode("f.words").alias("pos", "term")).where("term <> ''")
    out = rows.groupBy("key", "field", "term").agg(F.array_distinct(F.array_sort(F.collect_list("pos"))).alias("positions"))
    if path:
        out.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(path)
        out = docs.sparkSession.read.parquet(path)
    return Index(out, tuple(fields), docs.select(F.col(f"`{key}`")).distinct().count())


def _slots(q: object, fields: tuple[str, ...]) -> tuple[str, ...]:
    own = getattr(q, "field", None)
    return (own,) if own else fields


def _at(word: str, field: str) -> Column:
    return F.coalesce(F.try_element_at("by", F.lit(f"{field}\x00{word.lower()}")), F.array().cast("array<int>"))


def condition(q: object, fields: tuple[str, ...]) -> Column:
    """The tree as an expression over ``by``: a map from field and word to positions."""
    if isinstance(q, Term):
        return reduce(Column.__or__, (F.size(_at(q.word, f)) > 0 for f in _slots(q, fields)))
    if isinstance(q, Phrase):
        def begins(word: str, field: str, k: int) -> Column:
            return F.transform(_at(word, field), lambda p: p - k)

        def inside(field: str) -> Column:
            return F.size(reduce(F.array_intersect, (begins(w, field, k) for k, w in enumerate(q.words)))) > 0

        return reduce(Column.__or__, (inside(f) for f in _slots(q, fields))) if q.words else F.lit(False)
    if isinstance(q, Not):
        return ~condition(q.part, fields)
    parts = [condition(p, fields) for p in q.parts]
    if isinstance(q, All):
        return reduce(Column.__and__, parts, F.lit(True))
    return reduce(Column.__or__, parts, F.lit(False))


def needs_a_word(q: object) -> bool:
    """If no document without any word of the query can match."""
    if isinstance(q, Not):
        return False
    if isinstance(q, All):
        return any(map(needs_a_word, q.parts))
    if isinstance(q, Any):
        return all(map(needs_a_word, q.parts))
    return True


def _held(index: Index, q: object) -> DataFrame:
    """A row for each document that has a word of the query: (key, by)."""
    if not needs_a_word(q):
        raise ValueError("a query needs a word that is not under NOT")
    own = index.postings.where(F.col("term").isin(sorted({w for w, _ in leaves(q)})))
    return own.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("field", F.lit("\x00"), "term"), "positions"))).alias("by"))


def match(index: Index, q: object) -> DataFrame:
    """``(key)`` of all documents that match."""
    return _held(index, q).where(condition(q, index.fields)).select("key")


def search(index: Index, q: object, n: int = 20) -> DataFrame:
    """``(key, score)`` of the n best that match."""
    held = _held(index, q)
    scored = sorted({w for w, off in leaves(q) if not off})
    tf = {w: reduce(Column.__add__, (F.size(_at(w, f)) for f in index.fields)) for w in scored}
    stats = held.agg(*(F.count_if(tf[w] > 0).alias(f"_df{k}") for k, w in enumerate(scored)))
    found = held.where(condition(q, index.fields)).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k, w in enumerate(scored):
        score = score + F.when(tf[w] > 0, (1 + F.log(tf[w].cast("double"))) * F.log1p(index.n_docs / F.col(f"_df{k}"))).otherwise(0.0)
    return found.select("key", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "key").limit(n)
