"""Restoration, the byte network and the trees: held-out accuracy and exact rules."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import byte_cnn, deobfuscate, url_trees
from docketry.llm.queries import URL_RULES
from tests.llm.helpers import ODD, documents

CLEAN = "the house and river of a green valley where people walk under tall trees near water reading books about history music stars".split()
BAD = "idiot loser moron stupid trash clown".split()


def toxic_rows(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(bad), "other"))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, _ = toxic_rows(400)
    return deobfuscate.character_model(documents(spark, rows))


@pytest.mark.parametrize("seen,meant", [
    ("1d10t", "idiot"), ("l0ser", "loser"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("$tupid", "stupid"),
    ("i.d.i.o.t", "idiot"), ("c-l-o-w-n", "clown"), ("lo$er", "loser"), ("idiot!!", "idiot"), ("house", "house"), ("(river)", "river"), ("water***", "water"),
])
def test_restored_words(model, seen, meant):
    assert deobfuscate.Restorer(model).clean(seen) == meant


@pytest.mark.parametrize("seen,meant", [
    ("idiiot", "idiot"), ("stuupid", "stupid"), ("cllown", "clown"), ("morron", "moron"), ("traash", "trash"),
    ("8!90+", "bigot"), ("@$$", "ass"), ("green", "green"), ("valley", "valley"), ("trees", "trees"), ("tall", "tall"),
    ("2024", "2024"), ("7301", "7301"), ("$50", "$50"), ("1,000", "1000"), ("длинный", "длинный"), ("...", ""),
])
def test_doubled_letters_and_words_of_lookalikes(spark, seen, meant, model_with_numbers):
    assert deobfuscate.Restorer(model_with_numbers).clean(seen) == meant


@pytest.fixture(scope="module")
def model_with_numbers(spark):
    rng = random.Random(5)
    rows, _ = toxic_rows(400)
    number = lambda: rng.choice(["", "", "", "$"]) + str(rng.randrange(10 ** rng.randrange(1, 6)))
    more = [(400 + i, f"bigot {number()} ass {number()} river", "en", "a") for i in range(400)]
    return deobfuscate.character_model(documents(spark, rows + more))


def test_figures_in_disguised_words_are_not_counted(spark):
    rows = [(1, "a1b 22 l0", "en", "a")]
    got = {r["trigram"]: r["n"] for r in deobfuscate.trigram_counts(documents(spark, rows), "text").collect()}
    a, b, l, f = 1, 2, 12, deobfuscate.FIGURE
    key = lambda x, y, z: (x * 64 + y) * 64 + z
    assert got == {key(*k): 1 for k in [
        (0, 0, a), (0, a, 0), (a, 0, b), (0, b, 0), (b, 0, f), (0, f, f), (f, f, 0), (f, 0, l), (0, l, 0)]}


def test_doubled_letters_are_scored(spark):
    rows, labels = toxic_rows(1500)
    double = lambda t: " ".join(w[:2] + w[1:] if w in BAD else w for w in t.split())
    texts = [(i, t if i % 5 else double(t), lang, s) for i, t, lang, s in rows]
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = {r["id"]: r["score"] for r in deobfuscate.toxicity(documents(spark, texts), labelled, F.col("doc_id") % 5 != 0).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y, _ in labels if i % 5 == 0]) > 0.97


def test_long_words_are_read_whole(model, monkeypatch):
    """A disguised word reads the same wherever it stands, and however often the lattice is settled."""
    restorer = deobfuscate.Restorer(model)
    for before in range(55, 75):
        assert restorer.restore("s" * before + "tup1d").endswith("stupid")
    rng = random.Random(4)
    words = ["".join(rng.choice("stupidmoron15$.- é") * rng.choice([1, 1, 2, 70]) for _ in range(80)) for _ in range(20)]
    usual = [restorer.restore(w) for w in words]
    for settled_after in (1, 10**9):
        monkeypatch.setattr(deobfuscate, "SETTLED", settled_after)
        assert [restorer.restore(w) for w in words] == usual
    assert restorer.restore("") == ""


def test_viterbi_finds_the_best_path(model):
    """Every way to read a short word, scored one by one."""
    restorer = deobfuscate.Restorer(model)

    def readings(word, at=0):
        if at == len(word):
            yield "", 0.0
            return
        seen, run = word[at], 1
        while at + run < len(word) and word[at + run] == seen:
            run += 1
        hidden = [(c, deobfuscate.ALIKE) for c in deobfuscate.LOOKALIKES.get(seen, "")]
        if seen in deobfuscate.LETTERS:
            hidden.append((seen, deobfuscate.SELF))
        elif seen not in deobfuscate.SEPARATORS:
            hidden.append((seen, deobfuscate.LITERAL))
        steps = [(c, p, at + 1) for c, p in hidden]
        steps += [(c, p + deobfuscate.STRETCHED, at + run) for c, p in hidden if run > 1]
        steps += [("", deobfuscate.PUT_IN, at + run)] if seen in deobfuscate.SEPARATORS else []
        for text, p, to in steps:
            for rest, q in readings(word, to):
                yield text + rest, p + q

    def total(text, channel):
        symbols = [0, 0, *(deobfuscate._NUMBER.get(c, 0) for c in text), 0]
        return channel + sum(float(model[a, b, c]) for a, b, c in zip(symbols, symbols[1:], symbols[2:]))

    for word in ("1d10t", "m00n", "l.o-5er", "aaa1", "6o0d", "t--r4sh", "+00ls"):
        best = max(total(*r) for r in readings(word))
        found = restorer.restore(word)
        assert max(total(t, c) for t, c in readings(word) if t == found) == pytest.approx(best)


def test_words_apart():
    restorer = deobfuscate.Restorer(np.zeros((64, 64, 64), np.float32))
    assert "idiot" in restorer.words("you i d i o t here") and "i.d.i.o.t" in restorer.words("an i.d.i.o.t!".replace("!", ""))
    assert "ab" not in restorer.words("a b")


@pytest.mark.parametrize("seen", [
    "$ t u p ! d", "s  t  u  p  i  d", "s - t - u - p - i - d", "s\tt\nu\u00a0p i d", "s . t/u~p * i d", '"s t u p i d"', "$ . 7 u   p _ 1 - d !",
])
def test_words_apart_with_lookalikes_and_wide_gaps(model, seen):
    assert "stupid" in deobfuscate.Restorer(model).words(f"you {seen} here")


def test_words_between_wider_gaps(model):
    found = deobfuscate.Restorer(model).words("so i d i o t   c l o w n here")
    assert {"idiot", "clown", "idiotclown"} <= found
    assert "stupidhouse" not in deobfuscate.Restorer(model).words("s t u p i d house")


def test_toxicity_of_words_apart(spark):
    rows, labels = toxic_rows(1500)
    wide = lambda t: " ".join(" - ".join(w.replace("s", "$").replace("i", "!")) if w in BAD else w for w in t.split())
    texts = [(i, t if i % 5 else wide(t), lang, s) for i, t, lang, s in rows]
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = {r["id"]: r["score"] for r in deobfuscate.toxicity(documents(spark, texts), labelled, F.col("doc_id") % 5 != 0).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y, _ in labels if i % 5 == 0]) > 0.97


def test_character_counts(spark):
    got = {r["trigram"]: r["n"] for r in deobfuscate.trigram_counts(documents(spark, [(1, "ab", "en", "a"), (2, "Ab", "en", "a"), (3, None, "en", "a")]), "text").collect()}
    a, b = 1, 2
    assert got == {a: 2, a * 64 + b: 2, a * 4096 + b * 64: 2}


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(1500)
    disguised = [(i, t.replace("o", "0").replace("i", "1") if i % 2 else t, lang, s) for i, t, lang, s in rows if i % 5 == 0]
    texts = [r for r in rows if r[0] % 5] + disguised
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = {r["id"]: r["score"] for r in deobfuscate.toxicity(documents(spark, texts), labelled, F.col("doc_id") % 5 != 0).collect()}
    truth = {i: y for i, y, _ in labels}
    right = [(got[i] >= 0.5) == bool(truth[i]) for i in got if i % 5 == 0]
    assert np.mean(right) > 0.97 and all(0 <= s <= 1 for s in got.values())
    kept = deobfuscate.without_toxic(documents(spark, texts), labelled, F.col("doc_id") % 5 != 0)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_odd_toxicity(spark):
    df = documents(spark, ODD)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    got = deobfuscate.toxicity(df, nothing, F.lit(True)).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.5}
    assert deobfuscate.without_toxic(df, nothing, F.lit(True)).count() == len(ODD)  # nothing learned, nothing rejected
    one = spark.createDataFrame([(i, 0) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in deobfuscate.toxicity(df, one, F.lit(True)).collect())
    assert len(deobfuscate.without_toxic(df, one, F.lit(True)).collect()) == len(ODD)
    assert deobfuscate.toxicity(documents(spark, []), one, F.lit(True)).collect() == []


def quality_rows(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 200))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(["$$$", "###", "%%%"]) for w in words] if kind == 1 else words[:2] * 60
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(good), "other"))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = quality_rows(900)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = {r["id"]: r["score"] for r in byte_cnn.quality(documents(spark, rows), labelled, F.col("doc_id") % 4 != 2).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y, _ in labels if i % 4 == 2]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in got.values())


def plain_score(net, text):
    """The network position by position."""
    data = list(text)
    n = max(1, -(-(len(data) + byte_cnn.WIDTH - 1) // byte_cnn.BLOCK)) * byte_cnn.BLOCK
    padded = data + [byte_cnn.PAD] * (n - len(data) + byte_cnn.WIDTH)
    logits = []
    for begin in range(0, max(1, n // byte_cnn.BLOCK - 1) * byte_cnn.BLOCK, byte_cnn.BLOCK):
        stop = min(begin + 2 * byte_cnn.BLOCK, n - byte_cnn.WIDTH + 1)
        responses = [sum(net.taps[j, padded[p + j]] for j in range(byte_cnn.WIDTH)) + net.bias for p in range(begin, stop)]
        filled = min(1, max(0, (len(data) - begin) / (2 * byte_cnn.BLOCK)))
        logits.append(net.head(np.append(np.maximum(np.max(responses, axis=0), 0), filled)[None])[1][0])
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_network_against_plain_loops(monkeypatch):
    net = byte_cnn.Network.fresh(np.random.default_rng(3))
    net.bias = np.random.default_rng(4).normal(size=byte_cnn.FILTERS)
    rng = random.Random(6)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 120, 123, 124, 128, 250, 256, 260, 300, 1000, 3000)]
    for size in (128, 384, 1 << 17):
        monkeypatch.setattr(byte_cnn, "SLICE", size)
        got = byte_cnn.Judge(net).scores(texts)
        assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)
        assert byte_cnn.Judge(net).scores(texts[::-1])[::-1] == pytest.approx(got, abs=1e-6)


def test_odd_quality(spark):
    df = documents(spark, ODD)
    for labels in ([], [(1, 1), (4, 1), (5, 1)], [(1, None), (None, 0), (5, 0), (5, 1)]):
        labelled = spark.createDataFrame(labels, "doc_id long, quality int")
        got = byte_cnn.quality(df, labelled, F.lit(True)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        scores = {r["id"]: r["score"] for r in got}
        assert scores[5] == scores[6] and scores[1] == scores[2]
    assert byte_cnn.quality(documents(spark, []), labelled, F.lit(True)).collect() == []


def plain_host(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG/", "http://org", "http://a.ORG/x", "http://xorg/", "http://example.org/es/1",
    "http://www.example.org/es", "https://m.example.org/en/1?x=1", "http://example.org/en/2", "a://b.com/fr/x", "a://b.com/de/x://org/",
    "http://x.com?/fr/", "http://x.com#/fr/", "http://é.net/Ü?a=1&b=2&&c#f", "http://1.2.3.4/%20/a.html", "x\ny://h.com\n/de/", "http://b.com/" + "d" * 100_000,
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, id string, host string, verdict string")


def test_rules_and_trees(spark):
    rng = random.Random(12)
    urls = URLS + ["http://" + rng.choice(["good", "fine"]) + f"{i}.example.net/a/{i}" for i in range(80)]
    urls += [f"http://b{i}.example.com/{rng.choice(['fr', 'de', 'en'])}/{i}" for i in range(200)] + [f"http://c{i}.org/{i}" for i in range(40)]
    got = {r["id"]: r for r in url_trees.judged(pages(spark, urls), URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain_host(url)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text)) if fits else None
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.text if best else None), url
        assert r["verdict"] == (best.verdict if best else "block" if r["score"] >= 0.5 else "allow")
        assert (r["score"] is None) == bool(best)


def test_trees_learn_from_labels(spark):
    rng = random.Random(13)
    urls = ["http://" + "".join(rng.choices("abcdefghij", k=8)) + (f"{rng.randrange(10**6)}" if i % 2 else "") + f".net/{i}" for i in range(600)]
    df = pages(spark, urls).withColumn("spam", F.when(F.col("page_id") < 400, (F.col("page_id") % 2).cast("int")))
    got = {r["id"]: r["verdict"] for r in url_trees.judged(df, (), F.col("spam")).collect()}
    assert np.mean([(got[i] == "block") == bool(i % 2) for i in range(400, 600)]) > 0.95


def test_entropy(spark):
    got = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",)], "x string").select(url_trees.entropy(F.col("x")).alias("e")).collect()
    assert [r["e"] for r in got] == pytest.approx([0, 0, 1, 2])


def test_odd_pages(spark):
    assert url_trees.judged(pages(spark, []), URL_RULES).collect() == []
    got = url_trees.judged(pages(spark, [None, "", "http://x.net/"]), URL_RULES).collect()
    assert {r["verdict"] for r in got} == {"allow"} and len(got) == 3
    one = url_trees.judged(pages(spark, ["http://x.com/de/", "http://x.net/"] * 2), URL_RULES).collect()
    assert {r["verdict"] for r in one} == {"block"} and len(one) == 4


def test_all_rule_orders_agree(spark):
    urls = [u for u in URLS if u]
    want = None
    for rules in itertools.islice(itertools.permutations(URL_RULES), 0, 120, 40):
        host, path = url_trees.host_and_path(F.col("url"))
        got = [r["r"] for r in pages(spark, urls).select("page_id", url_trees.fitting_rule(host, path, rules, lambda r: r.text).alias("r")).orderBy("page_id").collect()]
        want = want or got
        assert got == want
