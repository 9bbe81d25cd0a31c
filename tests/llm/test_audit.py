"""Collocations, exact search and source divergence against brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from docketry.llm import collocations, source_audit, threshold_search
from tests.llm.helpers import ODD, documents


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- collocations -----------------------------------------------------------


def brute_collocations(rows, longest=3, least=10, top=2000, covered=50):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i:i + m])] += 1
    often = {k: v for k, v in counts.items() if v >= least}
    out = {}
    for (lang, phrase), a in often.items():
        if len(phrase) == 1:
            continue
        inside = any(
            lang == other and len(p) > len(phrase) and 100 * f >= covered * a and any(p[i:i + len(phrase)] == phrase for i in range(len(p)))
            for (other, p), f in often.items()
        )
        if not inside:
            cuts = [(1_000_000 * a * a // (often[lang, phrase[:k]] * often[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), often[lang, phrase[:k]], often[lang, phrase[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def collocated(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_texts(seed=3, n=300):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "new", "york", "city", "of", "é", " x", "a.b", "stop!", "go,", "\x00", "ÀB", "n\tm", "end\r\nnext"]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(0, 25)), p=weights / weights.sum()))
        rows.append((i, text if i % 9 else text + " new york city " * 3, [None, "en", "und", ""][i % 4], "s"))
    return rows


@pytest.mark.parametrize("longest,shards", [(3, 4), (4, 2), (2, 1), (15, 1)])
def test_collocations_equal_brute_force(spark, longest, shards):
    """The longest phrases need keys beyond 64 bits, which are numbered anew."""
    rows = some_texts()
    want = brute_collocations([(lang, t) for _, t, lang, _ in rows], longest, top=25)
    assert len(want) > 30
    got = collocated(documents(spark, rows).repartition(6), longest=longest, shards=shards, top=25)
    assert got == want


def test_phrases_activate_late(spark):
    """Words that reach the threshold only in the last shard still give whole counts of their phrases."""
    texts = [f"rare pair here {i}" for i in range(10)] + ["filler words " * 30] * 3
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for shards in (1, 3, 9):
        counts, total = collocations.frequent_phrases(df, 3, 10, shards)
        found = {r["phrase"]: r["f"] for r in counts.collect()}
        assert found["rare pair here"] == 10 and found["pair here"] == 10 and found["filler words filler"] == 87
        assert total.first()["n"] == 40 + 180


def test_activation_skips_phrases_of_rare_words():
    sieves = [np.full(collocations.SLOTS, collocations.NEVER, np.int16) for _ in range(2)]
    names = [b"a", b"b", b"c"]
    slots = collocations.word_hash("en", names) % np.uint64(collocations.SLOTS)
    sieves[0][slots[:2]] = 0
    found = {(m, p): (s, c) for m, phrases, start, count in collocations.counted("en", [b"a b c a b"], 1, 4, 3, sieves)
             for p, s, c in zip(phrases.to_pylist(), start.tolist(), count.tolist())}
    assert found[2, b"a b"] == (1, 2) and (2, b"b c") not in found and found[1, b"c"] == (0, 1)
    assert not [p for m, p in found if m == 3]
    later = [x for x in collocations.counted("en", [b"a b c a b"], 5, 4, 3, sieves)]
    assert not later  # activated in scan 1, so its cycle ended with scan 4


def test_collocations_bear_odd_rows(spark):
    rows = ODD + [(9, "Ab, Ab " * 50_000, None, None)]
    got = collocated(documents(spark, rows), shards=2)
    want = brute_collocations([(r[2], r[1]) for r in rows])
    assert got == want and got
    assert collocated(documents(spark, [])) == []
    assert collocated(documents(spark, [(1, None, None, None), (2, "one two", "en", "a")])) == []


def test_score_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "x", 1, 4 * 10**9), ("en", "y", 1, 5 * 10**9), ("en", "x y", 2, 3 * 10**9)], "lang string, phrase string, length int, f long")
    total = spark.createDataFrame([("en", 10**10)], "lang string, n long")
    held = collocations.frequent_phrases
    try:
        collocations.frequent_phrases = lambda *_: (counts, total)
        row = collocations.collocations(counts).first()
    finally:
        collocations.frequent_phrases = held
    assert row["score"] == 1_000_000 * (3 * 10**9) ** 2 // (20 * 10**18)


# --- exact search -----------------------------------------------------------


def whole(x, scale=1024):
    return [max(-2**63, min(2**63 - 1, int(np.floor(float(c) * scale)))) for c in x]


def brute_top(rows, asked, k=10):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            v = whole(v)
            best[i] = max(best.get(i, v), v)
    out = []
    for q in sorted(best):
        if asked(q):
            within = lambda s: max(-2**63, min(2**63 - 1, s))
            scored = sorted((-within(sum(a * b for a, b in zip(best[q], v))), i) for i, v in best.items() if i != q and len(v) == len(best[q]))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def searched(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")
    return sorted(tuple(r) for r in threshold_search.top_k(df, df.where("vec_id % 100 = 0"), k).collect())


@pytest.mark.parametrize("kind", ["normal", "ties", "long tails", "one spot"])
def test_search_equals_brute_force_in_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(threshold_search, "ROWS", 150)
    monkeypatch.setattr(threshold_search, "QUERIES", 4)
    monkeypatch.setattr(threshold_search, "FIRST", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6))
    if kind == "ties":
        x = np.round(x)
    if kind == "long tails":
        x = x ** 7
    if kind == "one spot":
        x[100:600] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert searched(spark, rows) == brute_top(rows, lambda i: i % 100 == 0)


def test_walk_stops_early():
    """With one strong dimension few rows are scored before the bound falls below the kth score."""
    rng = np.random.default_rng(2)
    values = np.floor(rng.normal(size=(5000, 8)) * np.array([1000, 1, 1, 1, 1, 1, 1, 1])).astype(np.int64)
    lists = threshold_search.SortedLists(np.arange(5000), values)
    ids, scores, seen = lists.top(-1, values[0], 10, None)
    want = sorted((-(values[i] @ values[0]), i) for i in range(5000))[:10]
    assert [(-s, i) for s, i in zip(scores, ids.tolist())] == want
    assert seen < 2500
    assert lists.top(-1, values[0], 10, int(1e15))[2] == 0  # no row can reach the score that is asked for


def test_search_bears_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, []), (201, []), (300, None), (400, [1.0, None]), (500, [nan, 1.0]), (600, [inf, 1.0]),
        (None, [1.0, 1.0]), (None, None), (7, [1.0]), (700, [-3.0]), (800, [0.5, -0.25]), (800, [0.5, -0.125]), (9, [1.0, 2.0]), (10, [1.0, 2.0]),
        (900, [1e300, -1e300]), (11, [1e300, 1.0]),
    ]
    assert searched(spark, rows) == brute_top(rows, lambda i: i % 100 == 0)
    assert searched(spark, []) == []
    assert searched(spark, [(1, [1.0])]) == []


# --- divergence -------------------------------------------------------------


def brute_divergence(rows, least=30, top=50):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, total = Counter(), Counter()
        own = {}
        for _, source, words in (r for r in rows if r[0] == lang):
            df.update(set(words))
            own.setdefault(source, Counter()).update(words)
        kept = sorted(t for t, n in df.items() if n >= least)
        for c in own.values():
            total.update(c)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(total), {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in source_audit.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("sources,width", [(64, 4096), (2, 8), (3, 16)])
def test_divergence_equals_brute_force(spark, monkeypatch, sources, width):
    monkeypatch.setattr(source_audit, "SOURCES", sources)
    monkeypatch.setattr(source_audit, "RANGE", width)
    rng = np.random.default_rng(5)
    words = [a + b for a, b in itertools.product(["Ab", "é", "z", "日本", "x-y"], ["", "1", "c", "'d", "à"])]
    rows = []
    for i in range(400):
        weights = rng.dirichlet(np.full(len(words), 0.3))
        rows.append((i, " ".join(rng.choice(words, int(rng.integers(0, 30)), p=weights)), ["en", None, "de"][i % 3], [None, "", "s1", "s2", "s3", "s4", "ß"][i % 7]))
    want = brute_divergence([(lang, s, t) for _, t, lang, s in rows], 12, 5)
    assert len(want) > 60
    assert audited(documents(spark, rows).repartition(5), least_docs=12, top=5) == want


def test_divergence_bears_odd_rows(spark):
    rows = ODD * 3
    assert audited(documents(spark, rows), least_docs=3) == brute_divergence([(r[2], r[3], r[1]) for r in rows], 3)
    plain = audited(documents(spark, rows))  # no kept terms: pairs of value 0
    assert plain == brute_divergence([(r[2], r[3], r[1]) for r in rows]) and all(r[4] == 0 for r in plain) and plain
    assert audited(documents(spark, [])) == []


def test_equal_subtrees_are_one_node():
    counts = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0]])
    trees = source_audit.Trees(counts)
    assert len(trees.leaves) == 3 and [len(c[0]) for c in trees.children] == [2, 3, 2]
    a, b, below = trees.facing(0, 1)
    assert len(a) <= 5 and [x.shape[1] for x in below] == [1, 2, 4]
    p = source_audit.shares(trees.leaves, 6, 8)
    q = source_audit.shares(trees.leaves, 9, 8)
    want = sum(abs(int(p[np.searchsorted(trees.leaves, x)]) - int(q[np.searchsorted(trees.leaves, y)])) for x, y in zip(*counts))
    assert source_audit.apart(trees, 0, 1, p, q) == want
    same = source_audit.Trees(np.zeros((2, 4096), np.int64))
    assert all(x.shape[1] == 1 for x in same.facing(0, 1)[2])  # one pair of nodes on every level


def test_shares_beyond_64_bits():
    got = source_audit.shares(np.array([-1, 0, 10**13]), 10**14, 10**6)
    assert got.tolist() == [0, 1 + 10**9 * 5 // (10**14 + 5 * 10**6), 1 + 10**9 * (10**13 + 5) // (10**14 + 5 * 10**6)]


def test_queries_name_the_contract_columns(spark):
    from docketry.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES["op12_threshold_search"](spark, sf).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert QUERIES["op13_source_audit"](spark, sf).dtypes == [
        ("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert QUERIES["op11_collocations"](spark, sf).dtypes == [
        ("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]


def test_reached_slots_come_to_the_driver_as_bits(spark):
    """A row for every 32,768 slots, however many phrases reach the threshold."""
    from pyspark.sql import functions as F

    sieves = [np.full(collocations.SLOTS, collocations.NEVER, np.int16) for _ in range(2)]
    words = [f"w{i}" for i in range(20_000)]
    slots = (collocations.word_hash("en", [w.encode() for w in words]) % np.uint64(collocations.SLOTS)).astype(np.int64)
    sieves[0][slots[:500]] = 0  # reached before
    sent = spark.sparkContext.broadcast(sieves)
    reached = spark.range(20_000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), "id").alias("phrase"), F.lit(1).alias("mark"))
    reached = reached.union(reached.withColumns({"phrase": F.concat_ws(" ", "phrase", "phrase"), "mark": F.lit(2)}))
    rows, taken = [], type(reached).collect
    try:
        type(reached).collect = lambda df: rows.append(taken(df)) or rows[-1]
        found = dict(collocations.fresh_slots(reached, sent))
    finally:
        type(reached).collect = taken
    assert len(rows) == 1 and len(rows[0]) <= 2 * collocations.SLOTS // 32_768
    assert set(found[1].tolist()) == set(slots.tolist()) - set(slots[:500].tolist()) and 19_000 < len(found[2]) <= 20_000
    assert len(found[1]) == len(set(found[1].tolist()))
