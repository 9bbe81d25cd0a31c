"""Near-duplicate texts and vectors against all pairs."""

import math
import random

import numpy as np
import pytest

from docketry.llm import bbit_minhash, rotation_codes
from tests.llm.helpers import ODD, documents


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def classes(rows, linked):
    """Smallest reachable id of each id."""
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(rows)
    for k, a in enumerate(names):
        for b in names[:k]:
            if linked(rows[a], rows[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in rows}


def family(rng, words, copies, changes):
    out = []
    for _ in range(copies):
        copy = list(words)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_texts_against_all_pairs(spark, monkeypatch, width, percent):
    rng = random.Random(width)
    texts = []
    for size in (12, 40, 150, 400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts += family(rng, words, 25, max(2, size // 15))
    texts += ["A b C d e f g"] * 4 + ["a B c D e f g"] * 3 + ["one", "One", "one two", "TWO one", ""]
    rng.shuffle(texts)
    monkeypatch.setattr(bbit_minhash, "BUCKET_PART", 8)  # large groups fall into many parts
    monkeypatch.setattr(bbit_minhash, "CLUSTER_PART", 6)
    df = documents(spark, [(i * 3, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["id"]: r for r in bbit_minhash.near_duplicates(df, width, percent).collect()}
    sets = {i * 3: shingles(t, width) for i, t in enumerate(texts)}
    want = classes(sets, lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        errors = []
        for _ in range(60):
            both, own = rng.integers(0, 2**63, 1000, dtype=np.uint64), rng.integers(0, 2**63, 2000, dtype=np.uint64)
            n = int(500 * share)
            a, b = np.concatenate([both[:n], own[:500 - n]]), np.concatenate([both[:n], own[1000:1500 - n]])
            s = bbit_minhash.packed(bbit_minhash.minima_of([np.unique(a), np.unique(b)]))
            errors.append(bbit_minhash.estimates(s[0], s[1:])[0] - n / (1000 - n))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_odd_texts(spark):
    df = documents(spark, ODD)
    got = bbit_minhash.near_duplicates(df).collect()
    assert len(got) == len(ODD)
    by = {r["id"]: r for r in got if r["id"] is not None}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[5]["kept"]
    assert all(r["kept"] for r in got if r["id"] in (None, 1, 2, 3, 4, 7, 8))
    assert all(r["component_id"] is None for r in got if r["id"] is None)
    rows = bbit_minhash.one_of_each(df)
    assert rows.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in rows.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "None", "None"])
    empty = documents(spark, [])
    assert bbit_minhash.near_duplicates(empty).collect() == [] and bbit_minhash.one_of_each(empty).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, unit string")


def test_vectors_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for width in (3, 24, 64):
        for label in (0, 1, None):
            for centre in rng.standard_normal((4, width)):
                for _ in range(9):
                    noise = rng.standard_normal(width) * np.linalg.norm(centre) / math.sqrt(width)
                    v = centre + rng.choice([0, 0.1, 0.2, 0.3]) * noise
                    rows.append((n, [float(np.float32(x)) for x in v * rng.choice([1, 1, 5])], label, "x", "y"))
                    n += 1
    rows += [(n + k, rows[0][1], rows[0][2], "x", "y") for k in range(3)]
    monkeypatch.setattr(rotation_codes, "PART", 7)
    got = {r["id"]: r for r in rotation_codes.near_vectors(vectors(spark, rows)).collect()}

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98

    by = {r[0]: r for r in rows}
    want = classes(by, linked)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(linked(by[i], by[j]) for j in by if j != i) for i in by}


def test_confidence_bound_holds():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factor, _ = rotation_codes.encoded(x, 27)
    error = rotation_codes.estimates(x, codes, factor) - x @ x.T
    off = ~np.eye(300, dtype=bool)
    assert (np.abs(error) <= rotation_codes.bound(factor, 432, 64)[None, :])[off].all()
    assert abs(error[off].mean()) < 1e-3 and np.abs(np.diag(error)).max() < 1e-9
    _, exact = rotation_codes.linked(x, codes, factor, 0.98)
    assert exact < 300  # the codes rule out nearly all pairs


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 0, "", ""), (2, [2.0, 4.0], 0, "", ""), (3, None, 0, "", ""), (4, [], 0, "", ""), (5, [0.0, 0.0], 0, "", ""),
        (6, [1.0, None], 0, "", ""), (7, [nan, 1.0], 0, "", ""), (8, [inf, 1.0], 0, "", ""), (9, [1.0, 2.0], None, "", ""),
        (10, [1.0, 2.0], None, "", ""), (None, [1.0, 2.0], 0, "", ""), (None, None, None, None, None), (1, [1.0, 2.0], 0, "", ""),
        (11, [1.0, 2.0, 0.0], 0, "", ""),
    ]
    got = rotation_codes.near_vectors(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    assert by[1]["n_links"] == 2 and by[2]["n_links"] == 2  # row 1 comes twice
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["id"] not in (1, 2))
    assert rotation_codes.near_vectors(vectors(spark, [])).collect() == []


@pytest.mark.parametrize("percent", [10, 30, 50, 60, 70, 74, 80, 85, 95, 100])
def test_bands_keep_the_promised_chance(percent):
    bands, rows = bbit_minhash.bands_for(percent)
    assert bands * rows <= bbit_minhash.MINIMA
    assert (1 - min(1 - 1e-9, (percent / 100) ** rows)) ** bands <= bbit_minhash.MISS * 1.0001
    if percent >= 80:
        assert rows == bbit_minhash.ROWS


def test_too_low_a_threshold_is_an_error():
    with pytest.raises(ValueError):
        bbit_minhash.bands_for(2)


def test_half_similar_texts_are_found(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(2 * g + side, " ".join(f"g{g}{w}" for w in (words[:300] if side == 0 else words[100:])), "en", "s") for g in range(40) for side in (0, 1)]
    found = {r["id"]: r["component_id"] for r in bbit_minhash.near_duplicates(documents(spark, rows), width=1, percent=50).collect()}
    assert all(found[2 * g + 1] == 2 * g for g in range(40))
