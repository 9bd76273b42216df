"""Positional search and near-miss look-ups against brute force."""

import difflib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import gazetteer, positional
from quern.operators.positional import All, Any, Not, Phrase, Term

WORDS = "sky park hill road of the and west gate new".split()
QUERIES = [
    Term("sky"), Term("SKY", "title"), Phrase(("the", "park")), Phrase(("the", "the")), Phrase(("sky", "park", "hill"), "body"), All((Term("sky"), Not(Term("park")))),
    Any((Phrase(("of", "the")), All((Term("gate", "title"), Term("new", "body"))))), All((Any((Term("hill"), Term("road"))), Not(Phrase(("west", "gate"))), Not(Not(Term("sky"))))), Term("unheard"), Phrase(()),
]


def tokens(text):
    return [w for w in re.split(r"[^a-z0-9]+", (text or "").lower())]


def holds(q, doc):
    if isinstance(q, Term):
        return any(q.word.lower() in tokens(doc[f]) for f in ([q.field] if q.field else doc))
    if isinstance(q, Phrase):
        w = [x.lower() for x in q.words]
        return bool(w) and any(tokens(doc[f])[i : i + len(w)] == w for f in ([q.field] if q.field else doc) for i in range(len(tokens(doc[f]))))
    if isinstance(q, Not):
        return not holds(q.part, doc)
    return (all if isinstance(q, All) else any)(holds(p, doc) for p in q.parts)


def test_search_equals_brute_force(frame, tmp_path):
    rng = random.Random(1)
    docs = [{"title": rng.choice([None, "", " ".join(rng.choices(WORDS, k=3))]), "body": rng.choice([None, "", "é; ", *(", ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(6))])} for _ in range(120)]
    df = frame([(k, d["title"], d["body"]) for k, d in enumerate(docs)], "k long, title string, body string").withColumns({c: F.lit("x") for c in ("term", "positions", "field")})
    for path in (None, str(tmp_path / "index")):
        index = positional.index(df, "k", ["title", "body"], path)
        for q in QUERIES:
            want = {k for k, d in enumerate(docs) if holds(q, d)}
            assert {r.key for r in positional.match(index, q).collect()} == want, q
    q = QUERIES[7]
    tf = [{w: sum(tokens(d[f]).count(w) for f in d) for w in ("hill", "road", "sky")} for d in docs]
    df_ = {w: sum(x[w] > 0 for x in tf) for w in ("hill", "road", "sky")}
    score = {k: round(sum((1 + math.log(x[w])) * math.log1p(len(docs) / df_[w]) for w in x if x[w]), 6) for k, x in enumerate(tf) if holds(q, docs[k])}
    got = [(r.key, r.score) for r in positional.search(index, q, 5).collect()]
    assert [k for k, _ in got] == sorted(score, key=lambda k: (-score[k], k))[:5] and all(s == pytest.approx(score[k]) for k, s in got)
    assert positional.match(positional.index(df.limit(0), "k", ["title"]), Term("sky")).count() == 0
    for q in (Not(Term("sky")), Any((Term("sky"), Not(Term("park")))), All((Not(Term("a")),))):
        with pytest.raises(ValueError, match="needs a word"):
            positional.match(index, q)


def naive_near(term, names):
    if len(term) < 5 or term in names:
        return None
    hit = difflib.get_close_matches(term, names, n=1, cutoff=0.86)
    if not hit:
        return None
    a, b = term.split(), hit[0].split()
    way = [next((w for w in x if w in gazetteer.DIRECTIONS), None) for x in (a, b)]
    return hit[0] if way[0] == way[1] and (set(a) & set(b) or a[0].startswith(b[0][:4]) or b[0].startswith(a[0][:4])) else None


def test_near_misses_equal_brute_force(frame):
    rng = random.Random(2)
    names = {"malad west", "malad east", "kandivali west", "borivali", "chembur", "aaaaa aaaa", "é日本語 town"}
    names |= {"".join(rng.choice("abcdeilmnr") for _ in range(rng.randint(4, 14))) + rng.choice(["", "", " west", " east", " road"]) for _ in range(400)}
    terms = {"maladd west", "malad wst", "kandiwali west", "borivli", "chmbur", "aaaa aaaaa", "é日本語 towm", "abc", ""}
    for n in list(names)[:300]:
        s = list(n)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [s[k], rng.choice("abcde")], [rng.choice("abcde")], [s[k], s[k]]])
        terms.add("".join(s).strip())
    left = frame([(x,) for x in [*terms, None, "Malad Wst "]], "term string").withColumn("name", F.lit("x"))
    right = frame([(x.title() if x.isascii() else x,) for x in [*names, *list(names)[:5]]] + [(None,)], "name string")
    got = {r.term: r.match for r in gazetteer.near_misses(left, right).collect()}
    want = {t: m for t in terms if (m := naive_near(t, sorted(names)))}
    assert got == want and len(want) > 100
    pairs = gazetteer.near_pairs(left.select(F.col("term").alias("w")).where("length(term) > 4").distinct(), right.select(F.lower("name").alias("w")).where("name is not null").distinct()).count()
    assert pairs < 0.05 * len(terms) * len(names)
    assert gazetteer.near_misses(left.limit(0), right).count() == 0 and gazetteer.near_misses(left, right.limit(0)).count() == 0
