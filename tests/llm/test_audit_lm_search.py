"""The filter audit, the hidden Markov model and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import filter_audit, hmm_lm, ranked_search

WORDS = "the of and to in is that for it on with as was at by this be from or are which had not but what all were when".split()
ODD = [None, "", "   \n", "a", "A b", "x " * 40_000, "é ß 日本 😀 A", "same text here now", "same text here now", " \tlead\x0b and\x0ctrail \n", "a b \x85 c\x0bd"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS).upper() if rng.random() < 0.1 else rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", str(rng.randint(0, 99))]) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [*ODD, *(prose(rng, rng.randint(0, 120)) + rng.choice(["", "", " # *", " $5"]) for _ in range(n))]
    texts += rng.sample(texts, 20)  # copies
    rows = [(i, t, "en", rng.choice([None, "s0", "s1", "s1", "s1"]), 0) for i, t in enumerate(texts)]
    rows += [(3, texts[20], "en", "s0", 0), (3, texts[20], "en", "s0", 0), (None, texts[21], "en", "s1", 0), (None, texts[21], "en", "s1", 0)]
    return rows


def clashing(df, *names):
    return df.withColumns({c: F.lit("x") for c in names})


# ---- 11


def naive_audit(rows, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in range(2))
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, _, s, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        fails.append((s or "", d, f))
    out = {}
    for part in {p for p, *_ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for p, d, f in fails if p == part]
            gone = []
            for k, c in enumerate(order):
                removed = [(d, f) for d, f in left if f[c]]
                left = [(d, f) for d, f in left if not f[c]]
                row = [len(left), len(removed), sum(f[c] for _, f in gone), sum(f[c] and sum(f.values()) == 1 for p, _, f in fails if p == part), sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)]
                gone += removed
                out[part, order, k + 1] = row
    shapley = Counter()
    for (part, order, k), row in out.items():
        shapley[part, order[k - 1]] += row[1]
    return {(p, o, k): (*row, shapley[p, o[k - 1]]) for (p, o, k), row in out.items()}


def test_audit_equals_brute_force(frame):
    rows = corpus()
    labels = [(i, i % 3 == 0 and 1 or 0, i % 5 == 0 and 1 or 0) for i in range(0, 80, 2)] + [(6, 0, 1), (6, None, None), (None, 1, 1), (9999, 1, 1)]
    df, known = frame(rows, DOC), frame(labels, "doc_id long, quality int, toxic int")
    want = naive_audit(rows, [x for x in labels if x[0] is not None])
    for own in (df, clashing(df, "id", "part", "mask", "digest", "least", "good", "bins")):
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(own, clashing(known, "id", "mask")).collect()}
        assert got == want
    assert filter_audit.audit(df.limit(0), known).count() == 0
    assert sum(r.good_lost + r.toxic_lost for r in filter_audit.audit(df, known.limit(0)).collect()) == 0


def test_audit_of_other_filters(frame):
    two = (filter_audit.Filter("X", lambda x: x.words < 4), filter_audit.Filter("Y", lambda x: x.words < 6))
    df = frame([(k, "w " * k, "en", "s", 0) for k in range(10)], DOC)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(df, frame([], "doc_id long, quality int, toxic int"), two).collect()}
    assert got == {("XY", 1): (6, 4, 0, 0, 4), ("XY", 2): (4, 2, 4, 2, 8), ("YX", 1): (4, 6, 0, 2, 8), ("YX", 2): (4, 0, 4, 0, 4)}


def test_audit_matrices():
    by = filter_audit.matrices("ABCDE")
    assert all(m.shape == (32, 600) and m.dtype == np.int64 for m in by.values())
    assert (by["kept"].reshape(32, 120, 5)[:, :, -1] == (np.arange(32) == 0)[:, None]).all()
    assert (by["removed"].reshape(32, 120, 5).sum(axis=2) == (np.arange(32) > 0)[:, None]).all()


# ---- 12


def some_model(s, c, seed=0):
    rng = np.random.default_rng(seed)
    return hmm_lm.Model(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(c), s))


def naive_expected(q, m):
    s = len(m.start)
    a = [m.start * m.emit[:, q[0]]]
    for c in q[1:]:
        a.append((a[-1] @ m.trans) * m.emit[:, c])
    b = [np.ones(s)]
    for c in q[:0:-1]:
        b.append(m.trans @ (m.emit[:, c] * b[-1]))
    b, z = b[::-1], a[-1].sum()
    classes, pairs = np.zeros_like(m.emit), np.zeros((s, s))
    for t, c in enumerate(q):
        classes[:, c] += a[t] * b[t] / z
        if t:
            pairs += np.outer(a[t - 1], m.emit[:, c] * b[t]) * m.trans / z
    return a[0] * b[0] / z, pairs, classes, math.log(z)


@pytest.mark.parametrize("segment", [1, 4, 8, 512])
def test_forward_and_backward_equal_brute_force(segment):
    m, rng = some_model(3, 12), np.random.default_rng(3)
    seqs = [rng.integers(0, 12, n).astype(np.uint16) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 40, 5, 5, 33)]
    want = [naive_expected(q, m) for q in seqs]
    assert np.allclose(hmm_lm.log_likelihoods(seqs, m, segment), [x[3] for x in want])
    for k, got in enumerate(hmm_lm.expected(seqs, m, segment)):
        assert np.allclose(got, sum(x[k] for x in want))


def test_very_long_sequences_neither_underflow_nor_drift():
    m = some_model(4, 50)
    q = np.random.default_rng(5).integers(0, 50, 60_000).astype(np.uint16)
    one, cut = hmm_lm.log_likelihoods([q], m, 1 << 20)[0], hmm_lm.log_likelihoods([q], m, 100)[0]
    assert math.isfinite(one) and one == pytest.approx(cut, rel=1e-12)


def test_words_are_those_of_the_rule():
    texts = [t if t is None else t for _, t, *_ in corpus()]
    for column in (pa.array(texts), pa.array(["before", *texts])[1:]):
        for most in (1, 1000, 1 << 23):
            got = []
            for i, words, at, ends in hmm_lm.words_of(column, most):
                assert i == len(got)
                begin = 0
                for end in ends:
                    got.append([words[int(k)].as_py() for k in at[begin:end]])
                    begin = end
            lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]


SMALL = hmm_lm.Shape(states=2, common_share=60, endings=16, rounds=6, prior=5.0, segment=16)


def fold(d):
    return -1 if d is None else zlib.crc32(str(d).encode()) % 7


def test_scores_equal_brute_force(frame):
    rows = corpus(2)
    df = frame(rows, DOC)
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(-1)) != 2
    made = hmm_lm.prepare(clashing(df, "row", "id", "word", "n", "training", "codes"), training, SMALL)
    model, v = hmm_lm.train(made), made.vocabulary
    assert 0 < len(v.common) <= 60 and v.first_shared + 16 == len(v.weights)
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")), None]) for d, t, *_ in rows]
    counts = Counter(w for d, ws in tokens if fold(d) != 2 for w in ws)
    n, types = sum(counts.values()), len(counts)
    assert (v.tokens, v.types) == (n, types)

    def ending(w):
        return int(hmm_lm.endings_of(pa.array([w.encode()]), 16)[0])

    def kind(w):
        return 0 if w is None else v.common.get(w.encode(), v.first_shared + ending(w))

    weights = Counter({kind(w): 1 for w in [None, *(x.decode() for x in v.common)]} | {v.first_shared + k: 1 for k in range(16)})
    for w, c in counts.items():
        weights[kind(w)] += c + (kind(w) >= v.first_shared)
    assert [weights[k] for k in range(len(v.weights))] == v.weights.tolist()
    want = []
    for d, ws in tokens:
        base = sum(math.log10((counts[w] + 1) / (n + types + 1)) for w in ws)
        inside = sum(math.log10((counts[w] + 1) / weights[kind(w)]) for w in ws if kind(w) >= v.first_shared)
        score = naive_expected([kind(w) for w in ws], model)[3] / math.log(10) + inside if len(ws) < 200 else None
        want.append((d, fold(d) != 2, len(ws), sum(w in counts for w in ws), n, base, score))
    got = sorted(map(tuple, hmm_lm.score(made, model).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and (b[6] is None or a[6] == pytest.approx(b[6]))


def test_endings_in_sql_are_those_in_tasks(spark, frame):
    words = ["", "a", "ab", "abc", "abcd", "é", "日本", "😀x", "\x00", "zz\xff"]
    df = frame([(w,) for w in words], "w string").select(F.col("w").cast("binary").alias("word"))
    got = {bytes(r.word): r.k for r in df.select("word", hmm_lm.ending_column("word", 97).alias("k")).collect()}
    assert [got[w.encode()] for w in words] == hmm_lm.endings_of(pa.array([w.encode() for w in words]), 97).tolist()


def test_training_climbs_and_the_model_is_a_distribution(frame):
    rng = random.Random(4)
    kinds = [[f"{c}{k}" for k in range(60)] for c in "ab"]
    rows = [(i, " ".join(rng.choices(kinds[i % 2], k=rng.randint(5, 60))), "en", "s", 0) for i in range(300)]
    made = hmm_lm.prepare(frame(rows, DOC), F.col("doc_id") % 5 != 0, hmm_lm.Shape(states=2, rounds=12))
    model = hmm_lm.train(made)
    assert all(b > a for a, b in zip(model.history, model.history[1:], strict=False))
    for p in (model.start, model.trans, model.emit):
        assert np.allclose(p.sum(axis=-1), 1) and (p > 0).all()
    held = hmm_lm.score(made, model).where("not training").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert held[1] > held[0] + 0.25 * held[2]  # nearly the log10(2) that telling two vocabularies apart gains


def test_no_training_rows_and_no_rows(frame):
    df = frame(corpus()[:20], DOC)
    made = hmm_lm.prepare(df, F.lit(False), SMALL)
    rows = hmm_lm.score(made, hmm_lm.train(made)).collect()
    assert len(rows) == 20 and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
    made = hmm_lm.prepare(df.limit(0), F.lit(True), SMALL)
    assert hmm_lm.score(made, hmm_lm.train(made)).count() == 0


# ---- 13


def naive_search(rows, items, k):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))

    docs = [(d, Counter(terms(t))) for d, t, *_ in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in set(items):
        found = []
        for d, c in docs:
            m = 100 - 75 + 75 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(q, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block_bytes", "query_bytes", "k"), [(1 << 21, 1 << 22, 10), (300, 400, 3)])
def test_search_equals_brute_force(frame, block_bytes, query_bytes, k):
    rows, rng = corpus(3, 80), random.Random(9)
    items = [(i, prose(rng, rng.randint(1, 25))) for i in range(15)] + [(50, None), (51, "..."), (52, "unheard"), (53, "the THE the, it's"), (53, "was"), (53, "was"), (54, "é 日本"), (None, "of and")]
    df, queries = frame(rows, DOC), frame(items, "item_id long, text string")
    index = ranked_search.build(clashing(df, "ids", "terms", "_id2", "docs"), block_bytes=block_bytes)
    found = ranked_search.search(index, clashing(queries, "q", "rank", "score", "doc_id"), k=k, query_bytes=query_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == naive_search(rows, items, k)


def test_search_of_nothing(frame):
    df, items = frame(corpus(3, 12), DOC), frame([(1, "the of")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build(df.limit(0)), items).count() == 0
    assert ranked_search.search(ranked_search.build(df), items.limit(0)).count() == 0
    assert ranked_search.search(ranked_search.build(frame([(1, None, "", "", 0), (2, " .", "", "", 0)], DOC)), items).count() == 0


def test_bytes_bound_impacts():
    rng = np.random.default_rng(1)
    counts, m = rng.integers(1, 10_000, 5000), rng.integers(25, 1_000_000_000, 5000)
    own = ranked_search.impacts(counts, m)
    level = -(-own // ranked_search.UNIT)
    assert level.max() <= 255 and (own <= level * ranked_search.UNIT).all() and (own >= np.where(level > 0, (level - 1) * ranked_search.UNIT + 1, 0)).all()


def test_rare_words_are_joined_once_for_many_texts(frame):
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(300)]
    texts = [" ".join(words[k % 7 :]) for k in range(200)]
    made = hmm_lm.prepare(frame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").coalesce(1), F.lit(True), SMALL)
    joined = made.encoded.select(F.explode("rare").alias("r")).select(F.explode("r.words")).count()
    assert joined <= len(words)  # not one for each of 200 rows
    n = Counter(w for x in texts for w in x.split())
    total = sum(n.values()) + len(texts) + len(n) + 1 + 1
    for r in hmm_lm.score(made, hmm_lm.first_model(made.vocabulary)).collect():
        own = texts[r.id].split()
        assert r.n_known == len(own) + 1
        assert math.isclose(r.base_score, sum(math.log10((n[w] + 1) / total) for w in own) + math.log10((len(texts) + 1) / total), rel_tol=1e-9)


def test_parts_of_rare_words(monkeypatch):
    monkeypatch.setattr(hmm_lm, "PART", 64)
    rng = np.random.default_rng(9)
    text, at = np.sort(rng.integers(0, 20, 900)), rng.integers(0, 300, 900)
    parts = hmm_lm._parts(pa.array([b"w%d" % k for k in range(300)], pa.large_binary()), at, text, pa.array(range(100, 120)))
    assert len(parts) == 20 and len(parts[0]) > 3 and not any(len(x) for x in parts[1:])
    total, want = np.zeros((2, 20)), np.zeros((2, 20))
    for part in parts[0].as_py():
        known = [(k, int(w[1:])) for k, w in enumerate(part["words"]) if int(w[1:]) % 3]
        got = hmm_lm._log_rare(pa.table({"place": [k for k, _ in known], "c": [c for _, c in known]}), pa.Table.from_pylist([part]))
        assert got["row"].to_pylist() == list(range(100, 120))
        total += [got["n"].to_numpy(), got["log_rare"].to_numpy()]
    for t, w in zip(text, at):
        want[:, t] += [1, math.log10(w + 1)] if w % 3 else [0, 0]
    assert np.allclose(total, want)
