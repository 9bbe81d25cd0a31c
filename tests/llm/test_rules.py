"""Distribution divergence and mixing against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from docketry.llm import divergence, mixing
from docketry.llm.mixing import Target
from tests.llm.helpers import LONG, ODD, documents

SPACES = r"[\x20\x09-\x0D]+"


def counted(text):
    text = text or ""
    words = [w for w in re.split(SPACES, text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def shape(text):
    sizes = [len(text)]
    for pattern in divergence.CLASSES:
        text = re.sub(pattern, "", text)
        sizes.append(len(text))
    return [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]


def jsd(a, b):
    if not sum(a) or not sum(b):
        return None
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    return sum((x * math.log2(2 * x / (x + y)) if x else 0) / 2 + (y * math.log2(2 * y / (x + y)) if y else 0) / 2 for x, y in zip(p, q))


def sample():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "fr", None])
        common = {"en": "the of and to", "fr": "le la et de", None: "x y"}[lang].split()
        words = [rng.choice(common) if rng.random() < 0.4 else "w" + "abcdefgh"[rng.randrange(8)] * rng.randrange(1, 6) for _ in range(rng.randrange(0, 200))]
        if i % 7 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 9 == 0:
            words = words[:5] * 30
        text = " ".join(w + rng.choice(["", "", "\n", "\t", ".", " $%"]) for w in words)
        rows.append((i, text, lang, "a"))
    return rows


def test_against_plain_python(spark):
    rows = sample()
    got = {r["doc_id"]: r for r in divergence.judged(documents(spark, rows)).collect()}
    lower = {lang: Counter() for lang in {r[2] for r in rows}}
    shapes = {lang: [0] * 7 for lang in lower}
    for _, text, lang, _ in rows:
        lower[lang].update(w.lower() for w in re.split(SPACES, text) if w)
        shapes[lang] = [a + b for a, b in zip(shapes[lang], shape(text))]
    top = {lang: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:divergence.COMMON] for lang, c in lower.items()}
    merged = sum(lower.values(), Counter())
    pooled_top = sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:divergence.COMMON]
    for i, text, lang, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(text)
        words = Counter(w.lower() for w in re.split(SPACES, text) if w)
        known = top[lang] if lang else pooled_top
        total = sum(lower[lang].values()) if lang else sum(sum(c.values()) for c in lower.values())
        reference = [n for _, n in known] + [total - sum(n for _, n in known)]
        own = [words[w] for w, _ in known] + [sum(words.values()) - sum(words[w] for w, _ in known)]
        shapes_of = shapes[lang] if lang else [sum(s[k] for s in shapes.values()) for k in range(7)]
        assert r["word_distance"] == (pytest.approx(jsd(own, reference)) if r["n_words"] >= 50 else None)
        assert r["class_distance"] == (pytest.approx(jsd(shape(text), shapes_of)) if len(text) >= 200 else None)
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and (r["class_distance"] or 0) <= 0.07 and (r["word_distance"] or 0) <= 0.14)


def test_every_language_has_a_reference(spark, monkeypatch):
    """600 languages, a null one and one without words, with references sent to all tasks or joined with salts."""
    rows = [(i, f"alpha{i % 600} beta gamma " * 20, f"l{i % 600}", "a") for i in range(700)]
    rows += [(900, "alpha0 beta gamma " * 20, None, "a"), (901, " " * 300, "empty", "a")]
    df = documents(spark, rows)
    lists = {r["key"]: (r["words"], r["counts"]) for r in divergence.common_words(df).collect()}
    assert len(lists) == 601
    assert lists["language l5"] == (["alpha5", "beta", "gamma"], [40, 40, 40])
    assert lists["pooled"][0][:3] == ["beta", "gamma", "alpha0"] and lists["pooled"][1][:3] == [14020, 14020, 60]
    sent = {r["doc_id"]: tuple(r) for r in divergence.judged(df).collect()}
    monkeypatch.setattr(divergence, "fits_broadcast", lambda _: False)
    joined = {r["doc_id"]: tuple(r) for r in divergence.judged(df).collect()}
    assert sent == joined and len(sent) == len(rows)
    assert sent[5][-1] == 0.0 and sent[900][-1] > 0.1 and sent[901][-1] is None  # own histogram; pooled; no words


def test_odd_rows(spark):
    got = divergence.judged(documents(spark, ODD)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted(
        (str(i), *counted(t)) for i, t, _, _ in ODD)
    assert not any(r["kept"] for r in got if r["n_words"] < 50)
    assert divergence.judged(documents(spark, [])).collect() == []


def mixture_rows():
    rng = random.Random(8)
    return [(i, "w " * rng.randrange(1, 60), "en", rng.choice(["big"] * 12 + ["mid"] * 4 + ["low", None])) for i in range(3000)]


@pytest.mark.parametrize("target", [Target(0.9, 10.0), Target(None, 1.0), Target(0.999, 1.5), Target(1.0, 3.0, 5000), Target(0.5, 9.0, 10**6)])
def test_mixture_meets_its_target(spark, target):
    rows = mixture_rows()
    df = documents(spark, rows)
    tokens = {i: len(t.split()) for i, t, _, _ in rows}
    of = {i: s for i, _, _, s in rows}
    totals = Counter()
    for i in tokens:
        totals[of[i]] += tokens[i]
    whole = sum(totals.values())
    sources = mixing.plan(mixing.slim_rows(df, "doc_id", "text", "source"), target, "mix").collect()
    quota = {r["source"]: r["quota"] for r in sources}
    alpha = sources[0]["alpha"]
    size = min(target.tokens or whole, target.repeats * whole)
    shares = {s: (n / whole) ** alpha for s, n in totals.items()}
    for s, n in shares.items():
        assert quota["none" if s is None else "source " + s] == pytest.approx(n / sum(shares.values()) * size, abs=1.01)
    weights = [n / sum(shares.values()) for n in shares.values()]
    entropy = -sum(w * math.log2(w) for w in weights) / math.log2(len(weights))
    repeats = max(n / sum(shares.values()) * size / totals[s] for s, n in shares.items())
    natural = -sum(n / whole * math.log2(n / whole) for n in totals.values()) / math.log2(len(totals))
    if repeats < target.repeats * 0.999 and target.entropy:  # then the entropy decides
        assert alpha == 1.0 and natural >= target.entropy or entropy == pytest.approx(target.entropy, abs=1e-4)
    assert repeats <= target.repeats * 1.0001
    dealt = mixing.mixture(df, target).collect()
    used, copies = Counter(), Counter()
    for r in dealt:
        used[r["source"]] += tokens[r["doc_id"]]
        copies[r["doc_id"]] += 1
    for s in totals:
        own = [copies[i] for i in tokens if of[i] == s]
        assert max(own) - min(own) <= 1  # whole permutations and a part of one
        q = quota["none" if s is None else "source " + s]
        assert q - 60 < used[s] <= q  # the next row would pass the quota
    assert len({(r["source"], r["mix_copy"], r["mix_order"]) for r in dealt}) == len(dealt)


def test_last_pass_is_a_prefix(spark):
    df = documents(spark, mixture_rows())
    first = Target(None, 1.0)
    order = sorted((r["source"] or "", r["mix_order"], r["doc_id"]) for r in mixing.mixture(df, first).collect())
    part = mixing.mixture(df, Target(None, 1.0, 20_000)).collect()
    for source in {r["source"] for r in part}:
        want = [i for s, _, i in order if s == (source or "")]
        got = [r["doc_id"] for r in sorted(part, key=lambda r: r["mix_order"]) if r["source"] == source]
        assert got == want[:len(got)] and got


def test_odd_mixture(spark):
    df = documents(spark, ODD).withColumnRenamed("score", "mix_copy")
    dealt = mixing.mixture(df, Target(None, 1.0))
    assert set(dealt.columns) == {"doc_id", "text", "lang", "source", "n_chars", "mix_copy", "mix_order"}
    assert max(len(r["text"]) for r in dealt.collect() if r["text"]) in (len(LONG), 300_000)
    assert mixing.mixture(documents(spark, [])).collect() == []
    assert mixing.mixture(documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect() == []
    one = mixing.mixture(documents(spark, [(1, "a b", "en", "a"), (2, "c", "en", "a")])).collect()
    assert sorted(r["doc_id"] for r in one) == [1, 2]
