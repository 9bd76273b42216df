"""Operators of ``quern.llm`` against brute force, round trips and planted cases."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import chat_format, decontaminate, html_text, language_id, mixing, ngram_join, quality_knn, quality_rules, token_store, url_filter
from quern.llm.components import connected_components

WORDS = "the of and to in is that for it on with as was at by this be from or are which had not but what all were when".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n", "a", "a b", "x " * 40_000, "é ß 日本 😀", "same text here now", "same text here now"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


def vocabulary_prose(rng, n):
    """About n bytes of words that come again as often as in real prose."""
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    out = rng.choices(words, [1 / (k + 3) for k in range(600)], k=n // 4)
    return " ".join(out)[:n]


def docs(frame, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = frame(rows, DOC)
    return df.withColumn("_mix_copies", F.lit("x")).withColumn("kept", F.lit("y")) if extra else df


# ---- 1


def naive_rule(url, rules):
    host, path = url_filter.parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return (host, path, best and best.host + best.path, best.verdict if best else "allow")


def test_url_rules(frame):
    from quern.llm.queries import URL_RULES

    urls = [
        None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "http://example.com/de/1", "http://sub.example.com/de/", "http://notexample.com/de/", "http://x.net", "http://x.net/",
        "http://net/", "ftp://a.org/fr/#t", "http://a.org/FR/", "http://u:p@h.net:80/q", "http://a.org?/fr/", "x://y://net/", "http://ünï.net/é", "http://" + "a." * 300 + "net/" + "p" * 5000,
    ]
    df = frame(list(enumerate(urls * 2)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, URL_RULES).collect()}
    assert got == {i: naive_rule(u, URL_RULES) for i, u in enumerate(urls * 2)}
    table = df.sparkSession.createDataFrame(URL_RULES, "verdict string, host string, path string")
    for most in (1, 100, 1 << 20):  # dealt into several arrays
        assert len(list(url_filter._packed(table, most))) > (most < 200)
        assert {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, table, max_bytes=most).collect()} == got
    clash = df.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict")})
    assert {r.page_id: tuple(r)[1:] for r in url_filter.judge(clash, table).collect()} == got
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


def test_equal_keys_are_told_apart_by_their_strings():
    a = url_filter.DigestArray(url_filter.pack([url_filter.Rule("block", f"h{k}.net", "/") for k in range(50)]))
    a.keys = np.full(50, a.keys[0])  # all keys alike
    want = a.rule(37)
    real = url_filter.xxhash.xxh64_intdigest
    try:
        url_filter.xxhash.xxh64_intdigest = lambda s: int(a.keys[0])
        assert a.find([want, b"other/"]).tolist() == [37, -1]
    finally:
        url_filter.xxhash.xxh64_intdigest = real
    assert url_filter.DigestArray(url_filter.pack([])).judge(["http://a/b"]) == [("a", "/b", None, None)]


# ---- 2


def test_codes_round_trip_and_point_reads():
    rng = np.random.default_rng(7)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        ids[::2] %= 60000
        ids[::3] %= 200
        levels = token_store.encode_levels(ids)
        assert (token_store.decode_levels(levels) == ids).all()
        assert [token_store.get(levels, k) for k in range(n)] == ids.tolist()


def test_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [*ODD[:5], "it's 'll 'quoted' <|endoftext|> a.b, c!? d.", "<|endoftext|>", "x<|endoftext|>  y, z.", "it's, we'll. a1, b!? é. ß,", "\x1c \x85 a  b\n c \n"]
    texts += ["".join(rng.choice("ab .,'\n\t éß1!\u00a0\u2003\u200b😀") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    enc = token_store.Encoder(path, 2)
    for _ in range(2):
        ids, at = enc.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], repr(t)


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(token_store, "MEMORY", 40)
    rng = random.Random(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, enc = Tokenizer.from_file(path), token_store.Encoder(path, None)
    for _ in range(30):
        texts = [prose(rng, rng.randint(0, 12)) + rng.choice([".", ", and", "  x"]) for _ in range(5)]
        ids, at = enc.encode(pa.array(texts, pa.string()))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(5)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_of_equal_and_null_ids(frame, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "b"), (5, "x"), (5, "x"), (5, "y z"), (None, None), (-1, "w" * 3000)]
    got = [tuple(r)[:3] for r in token_store.documents(spark, token_store.write(frame(rows, "doc_id long, text string").repartition(3), path, block_tokens=2)).orderBy("start").collect()]
    assert [i for i, _, _ in got] == [None, None, -1, 5, 5, 5] and [s for _, s, _ in got] == np.cumsum([0, *(n for _, _, n in got)])[:-1].tolist()


def test_token_store(frame, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs(frame, ODD, True).repartition(3)
    store = token_store.write(df, path, end_id=2, block_tokens=100)
    got = {r.doc_id: r for r in token_store.documents(spark, store).collect()}
    tok, start, every = Tokenizer.from_file(path), 0, []
    for i, t in enumerate(ODD):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        every += ids
    where = [0, 1, len(every) // 2, len(every) - 1]
    assert token_store.tokens(spark, store, where) == {k: every[k] for k in where}
    assert token_store.documents(spark, token_store.write(df.limit(0), path)).count() == 0


# ---- 3


def test_quality_separates_and_is_exact(frame, spark):
    rng = random.Random(1)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(30)] + ["same same " * 60 for _ in range(5)]
    df = docs(frame, good + bad + ODD)
    labels = frame([(i, 1 if i < 60 else 0) for i in range(95) if i % 5] + [(1, None), (2, 7)], "doc_id long, quality int")
    model = quality_knn.fit(df, labels)
    got = {r.doc_id: r.score for r in quality_knn.predict(df, model).collect()}
    assert all((got[i] >= 0.3) == (i < 60) for i in range(0, 95, 5))
    assert got[95] == got[96] == model.prior and all(0 <= s <= 1 for s in got.values())
    x = next(quality_knn._runs(pa.array([good[0], bad[0]])))
    v = model.latent(x)
    for row, score in zip(v, model.score(x), strict=True):
        sims = sorted(((float(row @ w), y) for w, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: model.k]
        weights = [max(s, 0) ** model.sharp for s, _ in sims]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weights, sims, strict=True)) / sum(weights), abs=1e-3)
    assert quality_knn.predict(df.limit(0), model).count() == 0 and not len(quality_knn.fit(df.limit(0), labels).labels)
    twice = df.unionByName(df.withColumn("text", F.lit("other words " * 9))).withColumns({c: F.lit("x") for c in ("i", "t", "score", "y")})
    a, b = quality_knn.fit(twice, labels), quality_knn.fit(twice.repartition(5), labels)
    assert np.array_equal(a.labels, b.labels) and np.allclose(np.abs(a.vectors), np.abs(b.vectors), atol=1e-3)
    assert {r.score for r in quality_knn.predict(frame([(None, "a b c d")], "doc_id long, text string"), model).collect()} != {None}
    empty = quality_knn.fit(df, labels.limit(0))
    assert {r.score for r in quality_knn.predict(df, empty).collect()} == {0.5}


# ---- 4


def test_alpha_meets_its_target():
    tokens = np.array([1000.0, 100.0, 10.0, 0.0])
    for target in (0.5, 0.9, 1.05):
        mix = mixing.Mix(entropy=target)
        assert mixing.entropy_of(mixing.weights(tokens, mixing.solve(tokens, mix))) == pytest.approx(min(target, 1.0986), abs=1e-6) or target < mixing.entropy_of(mixing.weights(tokens, 1.0))
    for part in (0.1, 0.5, 0.9):
        own, alpha = mixing.entropy_of(mixing.weights(tokens, 1.0)), mixing.solve(tokens, mixing.Mix(evenness=part))
        assert 0 < alpha < 1 and mixing.entropy_of(mixing.weights(tokens, alpha)) == pytest.approx(own + part * (math.log(np.count_nonzero(tokens)) - own), abs=1e-6)
    mix = mixing.Mix(max_repeat=2.0)
    assert mixing.repeat_of(tokens, mixing.weights(tokens, mixing.solve(tokens, mix)), mix) == pytest.approx(2.0, rel=1e-6)


@pytest.mark.parametrize("mix", [mixing.Mix(max_repeat=1.5, block_tokens=400), mixing.Mix(entropy=1.0, budget=3000, block_tokens=200), mixing.Mix(budget=500, block_tokens=100), mixing.Mix(max_repeat=1.5)])
def test_mixture_meets_quotas_and_loses_nothing_it_should_keep(frame, mix):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 30)), "en", "big" if i % 4 else f"small{i % 3}", 0) for i in range(400)]
    df = frame(rows + [(900, None, "en", None, 0), (901, "", "en", "big", 0)], DOC)
    plan = mixing.plan(df, mix).select("doc_id", "_mix_source", "_mix_tokens", "_mix_weight", "_mix_copies").toPandas()
    own = plan.groupby("_mix_source")._mix_tokens.sum()
    w = plan.groupby("_mix_source")._mix_weight.first()
    budget = mixing.budget_of(own.to_numpy(float), w.to_numpy(), mix)
    used = (plan._mix_tokens * plan._mix_copies).groupby(plan._mix_source).sum()
    for s in own.index:
        assert used[s] <= budget * w[s] + 1 and used[s] >= budget * w[s] - 31
        assert plan[plan._mix_source == s]._mix_copies.max() - plan[(plan._mix_source == s)]._mix_copies.min() <= 1
    if mix.budget is None:
        assert (plan[plan._mix_tokens > 0]._mix_copies >= 1).all()
    assert mixing.mixed(df, mix).count() == plan._mix_copies.sum() and mixing.mixed(df, mix).columns == df.columns
    assert mixing.mixed(df.limit(0), mix).count() == 0


def naive_plan(rows, mix, hashed, keyed):
    """Copies of each row by walking through each source's permutation. ``hashed``: hash and block hash by id; ``keyed``: of (source, pass, block)."""
    own = Counter()
    for i, text, source in rows:
        own[source or ""] += len((text or "").split())
    names = sorted(own)
    tokens = np.array([own[s] for s in names], dtype=float)
    w = mixing.weights(tokens, mixing.solve(tokens, mix))
    budget, copies = mixing.budget_of(tokens, w, mix), {}
    for s, have, weight in zip(names, tokens, w):
        mine = [(i, len((t or "").split())) for i, t, x in rows if (x or "") == s]
        if not have:
            copies |= {i: 0 for i, _ in mine}
            continue
        n, left = max(1, math.ceil(have / mix.block_tokens)), budget * weight
        passes = math.floor(left / have + 1e-9)
        left = max(0.0, left - passes * have)
        dealt = {}
        for i, size in mine:
            dealt.setdefault(hashed[i][1] % n, []).append((hashed[i][0], i, size))
        copies |= {i: passes for i, _ in mine}
        for b in sorted(dealt, key=lambda b: (keyed(s, passes, b), b)):
            for _, i, size in sorted(dealt[b]):
                if size > left + 0.5:
                    left = -1
                    break
                copies[i] += left > 0.5
                left -= size
            if left < 0.5:
                break
    return copies


@pytest.mark.parametrize("mix", [mixing.Mix(max_repeat=1.5, block_tokens=100), mixing.Mix(entropy=1.2, budget=4000, block_tokens=60), mixing.Mix(max_repeat=1.5, block_tokens=100, max_sources=0, max_totals=0), mixing.Mix(evenness=0.4, max_repeat=3.0, block_tokens=80, max_totals=0)])
def test_mixture_equals_a_walk_through_the_permutation(frame, mix):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 30)), rng.choices(["a", "b", "c", None, "d"], [60, 20, 10, 5, 5])[0]) for i in range(300)] + [(900, None, "e")]
    df = frame(rows, "doc_id long, text string, source string")
    hashed = {r[0]: (r[1], r[2]) for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(mix.seed)).alias("h")).select("doc_id", "h", F.xxhash64("h")).collect()}
    keys = {tuple(r)[:3]: r[3] for r in df.select(F.coalesce("source", F.lit("")).alias("s")).distinct().crossJoin(df.sparkSession.range(4).toDF("p")).crossJoin(df.sparkSession.range(200).toDF("b")).select("s", "p", "b", F.xxhash64("s", "p", "b", F.lit(mix.seed))).collect()}
    planned = mixing.plan(df, mix).collect()
    assert {r.doc_id: r._mix_copies for r in planned} == naive_plan(rows, mix, hashed, lambda *k: keys[k])
    assert len({(r._mix_source, r._mix_block) for r in planned if r._mix_source == "a"}) > 10 and len({r._mix_weight for r in planned}) > 3


def test_the_target_of_the_queries_binds(spark):
    from quern.llm.queries import MIX

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    totals = docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("_mix_own"))
    tokens = np.array([r[1] for r in totals.collect()])
    alpha = mixing.solve(tokens, MIX)
    table = mixing.SparkTotals(totals.groupBy("_mix_own").agg(F.count("*").alias("n")))
    assert 0 < alpha < 1 and mixing.solve(table, MIX) == pytest.approx(alpha, abs=1e-9)
    assert mixing.entropy_of(mixing.weights(tokens, 1.0)) < mixing.entropy_of(mixing.weights(tokens, alpha)) < math.log(len(tokens))


# ---- 5


def naive_hits(text, items, window=10):
    words = decontaminate.normalise(text)
    hit, found = set(), set()
    for item_id, t in items:
        own = decontaminate.normalise(t)
        k = min(window, len(own))
        for j in range(len(own) - k + 1 if own else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == own[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(item_id)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("shard_words", "hold_bytes"), [(1_000_000, 1), (30, 1), (60, 1 << 20)])
def test_decontamination_equals_brute_force(frame, shard_words, hold_bytes):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 40]))) for i in range(25)] + [(50, None), (51, "..."), (52, "Zebra"), (53, prose(rng, 12)), (54, "É É é")]
    texts = list(ODD)
    for _ in range(60):
        t = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1] or ""
            t += [own.upper() if rng.random() < 0.5 else own.replace(" ", ", "), prose(rng, rng.randint(0, 5))]
        texts.append(" ".join(t))
    df = docs(frame, texts, True)
    bench = frame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find(df, bench, shard_words=shard_words, hold_bytes=hold_bytes).collect()}
    assert got == {i: naive_hits(t, items) for i, t in enumerate(texts)}
    assert not any(r.contaminated for r in decontaminate.find(df, bench.limit(0)).collect())
    assert decontaminate.find(df.limit(0), bench).count() == 0 and decontaminate.clean(df.limit(0), bench).count() == 0


def test_cleaning_cuts_passages_and_keeps_clean_texts(frame):
    rng = random.Random(6)
    item = " ".join(f"word{k}" for k in range(15))
    clean = [prose(rng, 60) for _ in range(5)]
    df = docs(frame, [*clean, f"{clean[0]} {item}. {clean[1]}", item, None])
    out = {r.doc_id: r for r in decontaminate.clean(df, frame([(1, item)], "item_id long, text string")).collect()}
    assert all(out[i].text == clean[i] for i in range(5)) and 6 not in out and out[7].text is None
    assert out[5].text == f"{clean[0]} . {clean[1]}" and out[5].n_chars == len(out[5].text)


# ---- 6


def naive_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_quality_rules(frame):
    rng = random.Random(8)
    texts = [*ODD, *(prose(rng, rng.randint(0, 200)) + rng.choice(["", "\n" + "dup line\n" * 3, " # * | <>"]) for _ in range(40)), "a\u00a0b \x85 c\x0bd", "one two three " * 3]
    df = docs(frame, texts, True)
    bands = quality_rules.Bands()
    assert quality_rules.score(df.limit(0)).count() == 0 and quality_rules.keep(df.limit(0)).count() == 0
    rows = {r.doc_id: r for r in quality_rules.score(df).collect()}
    zstd = zstandard.ZstdCompressor(level=bands.level)
    for i, t in enumerate(texts):
        want = naive_counts(t)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        data = (t or "").encode()
        assert r.ratio == pytest.approx(len(data) / len(zstd.compress(data)) if data else 1.0)
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_repeated_windows_of_long_texts():
    rng = random.Random(13)
    for n in (0, 1, 2, 3, 4, 50, 400):
        words = [rng.choice("abcdefgh").encode() for _ in range(n)]
        assert quality_rules._repeated(words) == quality_rules._repeated(words, long=0) == naive_counts(" ".join(w.decode() for w in words))[4]


def naive_verdict(text, bands, fences):
    """Kept or not, step by step from the definition."""
    data, zstd = (text or "").encode(), zstandard.ZstdCompressor(level=bands.level)
    counts = naive_counts(text)
    if counts[0] < bands.min_words or counts[4] > bands.max_repeat * counts[0]:
        return False
    ratio = len(data) / len(zstd.compress(data))
    limits = [(low, high) for least, low, high in bands.whole if len(data) >= least][-1:]
    limits += [fences[k] for k in [math.floor(4 * math.log2(len(data)))] if k in fences and len(data) >= bands.whole[0][0]]
    if any(not low <= ratio <= high for low, high in limits):
        return False
    pieces = [data[i : i + 4096] for i in range(0, len(data) - 4095, 4096)] + ([data[-4096:]] if len(data) % 4096 else []) if len(data) > 4096 else [data]
    sizes = [len(zstd.compress(x)) for x in pieces]
    if len(data) > 4096:
        low, high = bands.chunk
        if -1 in fences:
            low, high = max(low, fences[-1][0]), min(high, fences[-1][1])
        for bad in (sum(len(x) / n > high for x, n in zip(pieces, sizes)), sum(len(x) / n < low for x, n in zip(pieces, sizes))):
            if bad > bands.max_bad_chunks * len(pieces):
                return False
    for x, n in zip(pieces, sizes):
        share = [c / len(x) for c in Counter(x).values()]
        bits = -sum(p * math.log2(p) for p in share) * len(x)
        if len(x) >= 2048 and sum(x.count(c) for c in b" \n\t\r") <= 0.12 * len(x) and sum(b > 127 for b in x) <= 0.125 * len(x) and n >= bits / 8:
            return False
    return True


def naive_fences(texts, bands):
    logs, zstd = {}, zstandard.ZstdCompressor(level=bands.level)
    step = 0.0025
    for text in set(texts):
        data, counts = (text or "").encode(), naive_counts(text)
        if len(data) < 256 or counts[0] < 50 or counts[4] > 0.5 * counts[0]:
            continue
        logs.setdefault(math.floor(4 * math.log2(len(data))), []).append(math.floor(math.log(len(data) / len(zstd.compress(data))) / step))
        if len(data) > 4096:
            pieces = [data[i : i + 4096] for i in range(0, len(data) - 4095, 4096)] + ([data[-4096:]] if len(data) % 4096 else [])
            logs.setdefault(-1, []).extend(math.floor(math.log(4096 / len(zstd.compress(x))) / step) for x in pieces)
    def quantile(values, q):
        return sorted(values)[math.ceil(q * len(values)) - 1]

    logs = {b: [(v + 0.5) * step for v in values] for b, values in logs.items()}
    lengths, out = [b for b in logs if b >= 0], {}
    for band, values in logs.items():
        reach, near = 0, [band]
        while band >= 0 and sum(len(logs[b]) for b in near) < bands.least_texts and len(near) < len(lengths):
            reach += 1
            near = [b for b in lengths if band - reach <= b <= band + reach]
        each = [(b, quantile(logs[b], 0.5)) for b in near for _ in logs[b]]
        slope = float(np.polyfit(*zip(*each), 1)[0]) if len(near) > 1 else 0.0
        moved = [v + slope * (band - b) for b in near for v in logs[b]]
        a, b = quantile(moved, 0.25), quantile(moved, 0.75)
        wider = max(1, math.sqrt(bands.least_texts / len(moved)))
        out[band] = math.exp(a - wider * max(3 * (b - a), 0.05)), math.exp(b + wider * max(1.5 * (b - a), 0.05))
    return out


def test_fences_come_from_the_corpus_and_decide(frame):
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=rng.randint(180, 210))) for _ in range(160)] + [" ".join(rng.choices(words, k=rng.randint(800, 2500))) for _ in range(40)]
    texts += [texts[0]] * 60 + ["same same " * 40] * 50  # copies and rejected texts move no fence
    symbols = [" ".join(w + c * 3 for w, c in zip(rng.choices(words, k=135), rng.choices("*#%", k=135))) for _ in range(8)]
    some = rng.sample(words, 95)
    filler = [" ".join(rng.sample(some, 95) + some) for _ in range(4)]
    noise = ["".join(chr(rng.randint(33, 126)) + " " * (k % 7 == 6) for k in range(1100)) for _ in range(4)]
    texts += symbols + filler + noise
    df = docs(frame, texts, True)
    bands = quality_rules.fit(df)
    fences = naive_fences(texts, bands)
    assert {b: pytest.approx((low, high)) for b, low, high in bands.fitted} == fences and -1 in fences and len(fences) > 1
    got = {r.doc_id: r for r in quality_rules.score(df).collect()}
    assert {i: r.kept for i, r in got.items()} == {i: naive_verdict(t, bands, fences) for i, t in enumerate(texts)}
    assert all(got[i].kept for i in range(260)) and not any(got[i].kept for i in range(310, len(texts)))
    assert sum(not r.kept and not r.base_failed for r in got.values()) == 16


def test_bands_reject_filler_and_noise_and_keep_prose():
    rng, zstd, bands = random.Random(9), zstandard.ZstdCompressor(level=3), quality_rules.Bands()
    real = " ".join("".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(2, 9))) for _ in range(900))
    noise = bytes(rng.randrange(256) for _ in range(6000)).hex()[:4000] + "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000))

    def why(t):
        data = t.encode()
        return quality_rules.verdict(len(data), *quality_rules.ratios(data, bands, zstd), bands)

    assert why("buy now cheap " * 400) == "repetitive" and why(real) is None and why("short text") is None
    assert why("".join(chr(rng.randint(0x20, 0x7E)) for _ in range(5000))) == "incompressible" and why(noise) is not None
    assert why(real + "spam spam " * 1300) in ("repetitive", "repetitive chunks")


def why_of(text):
    bands = quality_rules.Bands()
    return quality_rules.judge(text, bands, zstandard.ZstdCompressor(level=bands.level))[-1]


def test_blobs_in_long_prose_are_found():
    rng = random.Random(10)
    good = [vocabulary_prose(rng, n) for n in (1500, 6000, 30_000, 100_000)]
    blobs = {
        "base64": base64.b64encode(rng.randbytes(75_000)).decode(),
        "base64 lines": base64.encodebytes(rng.randbytes(9_000)).decode(),
        "hex": " ".join(rng.randbytes(32).hex() for _ in range(900)),
        "random ASCII": "".join(chr(rng.randint(0x20, 0x7E)) for _ in range(8192)),
    }
    assert [why_of(x) for x in good] == [None] * 4
    for name, blob in blobs.items():
        for text in (good[2] + "\n" + blob, good[2][:15_000] + blob + good[2][15_000:], "\n".join(good[2:]) + blob[:8192] + good[1]):
            assert why_of(text) is not None, name
    assert why_of(blobs["hex"]) is not None and why_of(blobs["hex"][:3900]) is not None


def test_junk_at_the_end_is_in_a_chunk():
    rng, bands = random.Random(11), quality_rules.Bands()
    zstd = zstandard.ZstdCompressor(level=bands.level)
    for n_good, n_bad in ((4200, 3900), (3300, 3900), (2300, 4000)):
        good = vocabulary_prose(rng, n_good)
        for junk in ("".join(chr(rng.randint(0x21, 0x7E)) + " " * (k % 6 == 5) for k in range(n_bad))[:n_bad], base64.b64encode(rng.randbytes(n_bad)).decode()[:n_bad]):
            assert why_of(good) is None and why_of(good + junk) is not None and why_of(junk + good) is not None, (n_good, n_bad)
    for n in (4096, 4097, 8191, 8192, 8193):
        assert len(quality_rules.ratios(bytes(n), bands, zstd)[1]) == -(-n // 4096)
        assert why_of(vocabulary_prose(rng, n)) is None


def test_fences_hardly_depend_on_the_number_of_texts(frame):
    rng = random.Random(33)
    texts = []
    for k in range(3000):
        t = vocabulary_prose(rng, int(2 ** rng.uniform(9, 13)))
        texts.append(t if k % 20 else t[:100] + t[100:400] * (len(t) // 300))
    bands = [quality_rules.fit(docs(frame, some)) for some in (texts, texts[::7], texts[::61], texts[1:2])]
    assert all(b.fitted for b in bands)
    zstd = zstandard.ZstdCompressor(level=3)

    def out(t, b):
        data = t.encode()
        return quality_rules.verdict(len(data), *quality_rules.ratios(data, b, zstd), b) is not None

    everywhere = [out(t, bands[0]) for t in texts]
    for b, step, alike in zip(bands[1:3], (7, 61), (0.9, 0.8)):
        own = [out(t, b) for t in texts[::step]]
        want = everywhere[::step]
        assert sum(a == c for a, c in zip(own, want)) >= alike * len(own) and sum(a and c for a, c in zip(own, want)) >= 0.9 * sum(want)


# ---- 7

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page sidebar-left">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this site for you.</div>
<article><header><h1>Title of it</h1><p class="byline">By X</p></header><p>The first <b>bold</b>&nbsp;paragraph of the article &amp; it is long enough to count here.<br>Next line.
<p>Short.</p><div class="ad">Buy it now at the shop, the best of all.</div><p>Another paragraph with the words that it has and <a href="/x">one link</a>.<form><p>Subscribe to it</p></form></p></article>
<aside><p>Related story that is in the side bar of the page.</p></aside><section id="comments"><article class="comment"><p>I think that this is the best article of the year.</p></article></section>
<footer>&copy; the site and all of its rights.</footer></body></html>"""


def test_main_text():
    got = html_text.main_text(PAGE)
    assert got.split("\n") == [
        "Title of it", "The first bold paragraph of the article & it is long enough to count here. Next line.", "Short.", "Another paragraph with the words that it has and one link.",
    ]
    rng = random.Random(4)
    body = [prose(rng, 60) for _ in range(4)]
    plain = "<html><body><div><a href=1>One</a> <a href=2>Two</a></div>" + "".join(f"<p>{p}</p>" for p in body) + "<div><a href=3>" + "link " * 30 + "</a></div></body>"
    assert html_text.main_text(plain).split("\n") == body
    for odd in (None, "", "<", "<p", "text only", "<a" * 2000, "<script>x", "<!-- open", "<div>" * 500, "</p></div>", '<p class="x>broken</p>'):
        assert isinstance(html_text.main_text(odd), str)


def test_other_languages_and_marked_paragraphs():
    russian = ["Москва является столицей страны, и каждый год сюда приезжают миллионы людей из разных областей, чтобы увидеть старый город, музеи, парки и реку. " * 2 + str(k) for k in range(4)]
    chinese = ["北京是一座历史悠久的城市每年都有很多人来到这里参观古老的宫殿公园和博物馆了解这座城市的过去与现在。" * 5 + str(k) for k in range(4)]
    for body in (russian, chinese):
        for holder in ("div", "article"):
            page = f"<body><div><a href=1>Новости</a> <a href=2>Спорт</a></div><{holder}>" + "".join(f"<p>{x}</p>" for x in body) + f"</{holder}><footer>© 2024</footer></body>"
            assert html_text.main_text(page).split("\n") == body
    price = "The share price of the firm went up by a tenth on the day that it said it would sell all of its shops."
    page = f'<article><h1>News of it</h1><p class="share-price">{price}</p><p class="share">Share this</p><p class="ad-label">Advertisement</p><p style="display:none">{price} hidden</p><p>The end of it is here and it is not so long as that.</p></article>'
    assert html_text.main_text(page).split("\n") == ["News of it", price, "The end of it is here and it is not so long as that."]


def naive_second_pass(found, labels):
    """From the definition, looking left and right of each block."""
    out = []
    for k, b in enumerate(found):
        label, inside = labels[k], b.place == "in"
        sides = []
        for step in (-1, 1):
            j, chars = k + step, 0
            while 0 <= j < len(found):
                x = found[j]
                if labels[j] != html_text.OPEN and x.place != "out" and (x.place == "in" or not inside):
                    sides.append((labels[j], chars))
                    break
                chars += len(x.text)
                j += step
            else:
                sides.append(None)
        if label == html_text.OPEN:
            left, right = sides
            if b.heading and not inside:
                label = right[0] if right and right[1] < 200 else html_text.BAD
            elif left and right:
                label = left[0] if left[0] == right[0] else html_text.BAD if left[1] == right[1] else (left if left[1] < right[1] else right)[0]
            else:
                label = (left or right or (html_text.GOOD if inside else html_text.BAD, 0))[0]
        out.append(label == html_text.GOOD)
    return out


def test_second_pass_equals_brute_force():
    rng = random.Random(14)
    for _ in range(400):
        found = [html_text.Block("x" * rng.choice([5, 20, 90, 220]), 0, rng.choice(["", "", "in", "out"]), rng.random() < 0.2) for _ in range(rng.randint(0, 14))]
        labels = [html_text.BAD if b.place == "out" else rng.choice([html_text.GOOD, html_text.BAD, html_text.OPEN, html_text.OPEN]) for b in found]
        assert html_text.second_pass(found, labels) == naive_second_pass(found, labels)


def test_suspect_containers_by_density():
    p = [
        "The old town of the region was built in the years after the war, and it is known for all of the houses that are in the streets by the river, which was the way of trade for it.",
        "It is said that the people who lived there had been of the sea, and that they came with the ships from the south to this place, where they were to stay for most of their lives.",
    ]
    body, want = "".join(f"<p>{x}</p>" for x in p), "\n".join(p)
    more = "<p>I think that this is the best of all the texts that I have read on this site, and I will be back for more of it when it is there for us to read in the week.</p>"
    nav, side = '<nav><a href="/">Home</a></nav>', f'<div class="sidebar">{more}</div>'
    holders = {
        '<div class="wrapper no-sidebar">': "</div>", '<div class="layout has-sidebar">': "</div>", '<div class="widget-content">': "</div>", '<section class="share-story">': "</section>",
        '<form id="aspnetForm">': "</form>", '<div class="promo-layout"><div class="related-wrap">': "</div></div>",
    }
    for start, end in holders.items():
        for inner in (body, f"<article>{body}</article>", f'<div class="ad">{more}</div><article>{body}</article>', body + side, body + f'<div id="comments">{more}{more}{more}</div>'):
            assert html_text.main_text(f"<body>{nav}{start}{inner}{end}<footer>x</footer></body>") == want, (start, inner)
    card = f"<a href='/x'><h3>Another story that you will like</h3><p>{p[0]}</p></a>"
    for holder in ("article", "div"):
        for after in (f"<div id='discussion'>{more}{more}{more}</div>", f"<div class='feedback-thread'>{more}</div>", card, f"<div class=card>{card}</div>", f"<div class='promo'>{more}</div>", f"<section class='advert box'>{more}</section>"):
            assert html_text.main_text(f"<body><{holder}>{body}</{holder}>{after}</body>") == want, (holder, after)
    assert html_text.main_text(f"<body><article>{body}<div class='promo'>{more}</div></article></body>") == want
    assert html_text.main_text(f"<body><article><header><h1>Title</h1><p class=byline>By A B</p><p>{p[0]}</p></header><p>{p[1]}</p></article></body>") == f"Title\n{want}"
    assert html_text.main_text(f"<body><div><p>{p[0]} <a href=x>is it</p><p>{p[1]}</p></div></body>") == f"{p[0]} is it\n{p[1]}"
    assert html_text.main_text(f"<body><div><a name=top><p>{p[0]}</p><p>{p[1]}</p></div></body>") == want
    short = ["It was the best of the times that we had in all of the years of the war there.", "And it is known to all of us that they were not to be there when it was the end of it."]
    assert html_text.main_text("<body><div>" + "".join(f"<p>{x}</p>" for x in short) + "</div></body>") == "\n".join(short)
    assert html_text.main_text("<div class=promo>" * 30_000 + body) == want


def naive_cleared(found, dense, least):
    """From the definition, for each suspect container by itself."""
    size = [len(b.text) if d else 0 for b, d in zip(found, dense)]
    out = {}
    for b in found:
        for k, own in enumerate(b.suspects):
            around = b.suspects[:k]
            near = [(x, n) for x, n in zip(found, size) if x.suspects[:k] == around]
            held = sum(n for x, n in near if x.suspects[k : k + 1] == (own,))
            plain = [(x, n) for x, n in near if len(x.suspects) == k]
            out[own] = held >= least and held > sum(n for _, n in near) / 2 and sum(n for _, n in plain) <= held / 4 and (b.place == "in" or not any(x.place == "in" for x, n in plain))
    return [all(out[x] for x in b.suspects) for b in found]


def test_suspects_equal_brute_force():
    rng = random.Random(15)
    for _ in range(300):
        chains = [()]
        for k in range(1, 8):
            chains.append((*rng.choice(chains), k))
        some = [rng.choice(chains) for _ in range(rng.randint(0, 14))]
        found = [html_text.Block("x" * rng.choice([5, 20, 90, 220]), 0, "in" if rng.random() < 0.1 and not c or c and c[0] == 3 else "", False, False, c) for c in some]
        dense = [rng.random() < 0.6 for _ in found]
        assert html_text.cleared(found, dense, 160) == naive_cleared(found, dense, 160)


def naive_first_pass(b, rules, stop):
    """The rules as a table: the first line that fits decides."""
    size = len(b.text)
    links, short, long, low, high = b.links / size, size < rules.short, size >= rules.long, rules.stop_low, rules.stop_high
    s = stop if stop is not None else 0.0 if short else high
    head, inside = b.place == "head", b.place == "in"
    lines = [
        (b.place == "out", "bad"), (head and b.heading, "good"), (head and short, "bad"), (links > rules.links_inside, "bad"), (not inside and links > rules.links, "bad"),
        (b.marked and (short or s < high), "bad"), (head, "good" if s >= low else "bad"), (inside and (not short or s >= low or b.heading), "good"), (inside, "open"),
        (short or b.heading, "bad" if b.links else "open"), (s >= high and long, "good"), (s >= high, "open"), (s >= low and size >= 2 * rules.long, "good"), (s >= low, "open"), (long, "bad"), (True, "open"),
    ]
    return next(label for fits, label in lines if fits)


def test_first_pass_equals_its_table():
    rng, rules = random.Random(16), html_text.Rules()
    for _ in range(4000):
        size = rng.choice([1, 59, 60, 159, 160, 319, 320, 900])
        b = html_text.Block("x" * size, int(size * rng.choice([0, 0, 0.3, 0.5, 0.7])), rng.choice(["", "in", "out", "head"]), rng.random() < 0.2, rng.random() < 0.2)
        stop = rng.choice([None, 0.0, 0.05, 0.1, 0.15, 0.22, 0.4])
        assert html_text.first_pass(b, rules, stop) == naive_first_pass(b, rules, stop)

def test_broken_pages_take_linear_time():
    import time

    for piece, end in (("<div>", "</section>"), ('<a href="', ""), ("<a href='x ", ">"), ("<p class=x", ""), ("<div class=comment><article>", ""), ("<!-- ", ""), ("<a '\">", "")):
        took = []
        for n in (4000, 32_000):
            page = piece * n + end * n
            began = time.perf_counter()
            html_text.main_text(page)
            took.append(time.perf_counter() - began)
        assert took[1] < 24 * took[0] + 0.3, piece


def test_html_frame(frame):
    df = frame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert html_text.extract(df.limit(0)).count() == 0
    rows = {r.page_id: r for r in html_text.extract(df).collect()}
    assert rows[1].n_chars == len(rows[1].text) and rows[2].text == "" and rows[2].n_chars == 0


# ---- 8


def naive_profile(texts, size):
    counts = Counter()
    for t in texts:
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f"_{word}_"
            counts.update(word)
            counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
            counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return counts


def test_profiles_count_all_ngrams():
    for text in ("ab, cde", "The Of é", "a", "x1y"):
        codes, counts = language_id.counted(language_id.grams(text))
        mine = Counter()
        for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
            chars = []
            while c:
                chars.append(c & ((1 << 21) - 1))
                c >>= 21
            mine["".join("_" if x == 1 else chr(x) for x in reversed(chars))] += n
        want = naive_profile([text], 0)
        extra = {k: mine[k] - want[k] for k in mine | want if mine[k] != want[k]}
        assert all("_" in k[1:-1] for k in extra), extra  # n-grams over a gap of two words are ours alone


def test_distance_equals_brute_force(frame):
    """Out-of-place distance and its ties, from the definition."""
    rng = random.Random(15)
    texts = [(" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(25)), rng.choice(["x", "y", "z"])) for _ in range(30)]
    df = frame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string").withColumns({c: F.lit("q") for c in ("l", "t", "code", "lang_pred")})
    size = 60
    model = language_id.train(df, size=size)
    ranked = {}
    for lang in ("x", "y", "z"):
        n = Counter()
        for t, own in texts:
            if own == lang:
                for c, k in zip(*(v.tolist() for v in language_id.counted(language_id.grams(t)))):
                    n[c] += k
        ranked[lang] = [c for c, _ in sorted(n.items(), key=lambda p: (-p[1], p[0]))[:size]]
    for t in [*(t for t, _ in texts), "a", "éé bb", "zzzz"]:
        codes, counts = language_id.counted(language_id.grams(t))
        own = [c for c, _ in sorted(zip(codes.tolist(), counts.tolist()), key=lambda p: (-p[1], p[0]))[:size]]
        away = {lang: sum(abs(r.index(c) - k) if c in r else size for k, c in enumerate(own)) for lang, r in ranked.items()}
        name, score = model.judge(t)
        assert away[name] == min(away.values()) and name == min(x for x in away if away[x] == min(away.values())) and score == pytest.approx(1 - away[name] / (size * len(own)))


def test_language(frame):
    rng = random.Random(11)
    fr = "le la les de des un une et que qui pour dans avec est sur pas plus".split()
    de = "der die das und nicht mit von zu ein eine auf ist im den dem".split()
    texts = [" ".join(rng.choice(v) for _ in range(30)) for v in (WORDS, fr, de) for _ in range(30)]
    rows = [(i, t, ("en", "fr", "de")[i // 30], "s", 0) for i, t in enumerate(texts)]
    df = frame(rows + [(900, None, "en", "s", 0), (901, "12 34 !!", "en", "s", 0), (902, "x", None, "s", 0)], DOC)
    model = language_id.train(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert all(got[i].lang_pred == ("en", "fr", "de")[i // 30] for i in range(90)) and got[900].lang_pred == got[901].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[902].lang_pred in ("en", "fr", "de")
    assert language_id.predict(df.limit(0), model).count() == 0
    again = language_id.train(df.where("doc_id % 4 <> 2").repartition(7), hold=100)
    assert (again.ranks == model.ranks).all() and (again.codes == model.codes).all()
    assert {r.lang_pred for r in language_id.predict(df, language_id.train(df.limit(0))).collect()} == {"und"}


# ---- 9


def test_chat_round_trip(frame):
    rng = random.Random(12)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<|", "|>", "\n", "\\|", "<\\|", "é😀", "ok", ""]
    rows = [(c, k, rng.choice(["user", "assistant", "system", None, "odd\nrole", "x\\n"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(6))])) for c in range(40) for k in range(5)]
    df = frame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat_format.format_chats(df)
    out = chats.select("conv_id", "n_turns", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        want = [(role or "", text or "") for c, _, role, text in sorted(rows, key=lambda x: x[1]) if c == r.conv_id]
        assert [tuple(t) for t in r.t] == want and r.n_turns == 5
        assert r.loss == "".join(t for role, t in want if role == "assistant")
    plan = chats._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_typed_parts(frame):
    parts = [("text", "see <|x|>", None, None), ("image", None, "i.png", None), ("document", None, "d.pdf", 9), ("unknown", "z", None, None), ("image", None, "j.png", 7)]
    df = frame([(1, 0, "user", parts), (1, 1, "assistant", [("audio", None, "a.wav", None), ("text", None, None, None)])], f"conv_id long, turn long, role string, content {chat_format.PARTS}")
    r = chat_format.format_chats(df, content=F.col("content")).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|x|><|image_1|><|document_2|><|image_3|><|im_end|>\n<|im_start|>assistant\n<|audio_4|><|im_end|>\n"
    assert [(a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "i.png", 576), (2, "document", "d.pdf", 9), (3, "image", "j.png", 7), (4, "audio", "a.wav", 750)]
    assert r.expanded_tokens == 576 + 9 + 7 + 750


# ---- 10


def naive_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts(rng):
    texts = [*ODD, *(prose(rng, rng.randint(0, 8)) for _ in range(60))]
    passage = prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.randint(5, 120)).split()
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["new"], [own[at], "more"]])
            texts.append(" ".join(own))
        if rng.random() < 0.5:
            texts.append(passage + " " + prose(rng, 100))
    big = prose(rng, 90).split()
    texts += [" ".join(w if rng.random() > 0.01 else "edit" + str(rng.randrange(50)) for w in big) for _ in range(120)]
    rng.shuffle(texts)
    return texts


def test_join_of_hot_blocks(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "heavy_of", lambda n: 3)
    test_join_equals_brute_force(frame, 5, (80, 100), {"task_docs": 8})


@pytest.mark.parametrize(("k", "threshold", "options"), [(4, (85, 100), {}), (5, (80, 100), {"task_docs": 8, "task_shingles": 900})])
def test_join_equals_brute_force(frame, k, threshold, options):
    texts = near_texts(random.Random(k))
    df = docs(frame, texts, True)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, k=k, threshold=threshold, **options).collect()}
    want = naive_components(texts, k, *threshold)
    assert got == want
    if options:
        kept = {r.doc_id for r in ngram_join.keep_one(df, k=k, threshold=threshold).collect()}
        assert kept == {i for i, (_, c) in want.items() if i == c}


def test_blocks_by_shared_passages_are_split(frame, monkeypatch):
    rng, seen = random.Random(31), []
    passages = [prose(rng, 50) for _ in range(81)]
    texts = [f"{a} {prose(rng, 50)} {b}" for a, b in itertools.pairwise(passages)]  # each shares a passage with the next: a chain, but no link
    texts += [t + " more" for t in texts[::10]]
    join = ngram_join._tree_join
    monkeypatch.setattr(ngram_join, "_tree_join", lambda dealt, *a: seen.append(dealt.count()) or join(dealt, *a))
    df = docs(frame, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, k=5, threshold=(80, 100), task_docs=2).collect()}
    assert got == naive_components(texts, 5, 80, 100)
    assert 16 <= seen[0] < 20  # hardly any texts but those that are alike, once each


def test_keep_one_tells_documents_by_id_and_text(frame):
    rng = random.Random(21)
    base = [prose(rng, 40) for _ in range(12)]
    rows = [(rng.choice([None, *range(8)]), rng.choice([t, t, t.upper(), t + " more", None, ""])) for t in base * 6]
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(frame(rows, "doc_id long, text string"), k=5, threshold=(80, 100)).collect())
    documents = sorted(set(rows), key=repr)
    parts = naive_components([t for _, t in documents], 5, 80, 100)
    groups = {}
    for k, d in enumerate(documents):
        groups.setdefault(parts[k][1], []).append(d)
    assert set(kept.values()) == {1}
    for group in groups.values():
        stays = [d for d in group if d in kept]
        least = min(group, key=lambda d: (d[0] is None, d[0] or 0))
        assert len(stays) == 1 and stays[0][0] == least[0]
    two = frame([(1, base[0]), (1, base[1]), (1, base[1])], "doc_id long, text string")
    assert sorted(r.text for r in ngram_join.keep_one(two).collect()) == sorted(base[:2])


def test_signatures_never_miss_a_link():
    rng = np.random.default_rng(3)
    for num, den in ((85, 100), (80, 100), (50, 100)):
        deals = ngram_join.Deals(num, den)
        for _ in range(1500):
            n = int(rng.integers(1, 120))
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate((a[: n - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 2**64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(deals.signatures(a), deals.signatures(b)))


def test_join_of_odd_tables(frame):
    df = docs(frame, ODD)
    assert ngram_join.components(df.limit(0)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, None), (3, ""), (3, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.components(frame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 1, 3, 1), (False, 1, 3, 1), (False, 2, 3, 1), (False, 3, 0, 3), (False, 3, 0, 3), (True, 0, 0, None), (True, 0, 3, 1)]
    assert ngram_join.keep_one(frame(rows, "doc_id long, text string")).count() == 4


def test_hot_signatures_have_a_row_for_each_task():
    rng, leaders = np.random.default_rng(5), ngram_join.Leaders()
    edges, rows = set(), Counter()
    for batch in range(6):
        nodes = np.arange(100 * batch, 100 * batch + 100, dtype=np.int64)
        keys = np.where(nodes % 2 == 0, np.uint64(7), rng.integers(10, 40, 100, dtype=np.uint64))
        got, owners = ngram_join._local(keys, nodes, leaders)
        by = {}
        for k, n in zip(got.tolist(), owners.tolist()):
            by.setdefault(k, []).append(n)
            rows[k] += 1
        edges |= {tuple(v) for v in by.values() if len(v) == 2}
        for key in set(keys.tolist()):  # all nodes of a key hang together, over batches too
            rows[key, "seen"] += 1
    assert rows[7] == 1 and all(rows[k] <= 6 for k in range(10, 40))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    assert len({find(n) for n in range(0, 600, 2)}) == 1


def test_keep_one_with_clashing_names(frame):
    texts = ["a b c d e f g h"] * 3 + ["x y z w v u t s r"] * 2 + [None, ""]
    df = docs(frame, texts).withColumns({c: F.lit("clash") for c in ("node", "_near_flag2", "component_id", "_n", "_c", "n", "block")})
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6]


@pytest.mark.parametrize("heavy", [100, 10_000])
def test_components_of_hot_nodes(frame, monkeypatch, heavy):
    import quern.llm.components as own

    monkeypatch.setattr(own, "heavy_of", lambda n: heavy)
    edges = [(5, k) for k in range(6, 3000)] + [(3000 + k, 6 + k) for k in range(50)] + [(9000, 9001), (9001, None), (4, 4)]
    got = {r.node: r.component for r in connected_components(frame(edges, "a long, b long")).collect()}
    assert got == {n: 5 for n in range(5, 3050)} | {9000: 9000, 9001: 9000}
    assert connected_components(frame([], "a long, b long")).count() == 0


def test_components_settle(frame):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(1, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(frame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


# ---- pipeline


def test_pipeline(frame, spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(20)

    def unique(n):
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))

    item, texts = unique(30), [unique(120) for _ in range(30)]
    texts += [texts[0], texts[1] + " tail", "buy now cheap " * 200, texts[2] + " " + item + " " + unique(60), item, None, "short"]
    docs(frame, texts).write.parquet(str(tmp_path / "documents.parquet"))
    frame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == DOC.replace(" long", "").replace(" string", "").split(", "), name
        seen.append({r.doc_id: r.text for r in df.collect()})
    assert set(seen[0]) == set(range(32)) | {33} and set(seen[1]) == set(range(30)) | {33}
    assert all(seen[2][i] == texts[i] for i in range(30)) and item not in seen[2][33] and set(seen[3]) == set(seen[2])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(seen[3]) and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
