from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from docketry import kernels
from docketry.operators import retrieval as R


def counted(rows, ngrams):
    """Total and number of rows of every term."""
    total, held = Counter(), Counter()
    for words in rows:
        terms = [" ".join(words[i:i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
        total.update(terms)
        held.update(set(terms))
    return {t: (total[t], held[t]) for t in total}


@pytest.fixture(scope="module")
def lists():
    rng = np.random.default_rng(3)
    return [[f"w{int(30 * x * x)}" for x in rng.random(int(rng.integers(0, 12)))] for _ in range(300)]


@pytest.mark.parametrize("ngrams,least,most", [(1, 1.0, None), (3, 2.0, None), (2, 10.0, 0.3)])
def test_common_terms_equal_brute_force(spark, lists, ngrams, least, most):
    df = spark.createDataFrame([(r,) for r in lists], "words array<string>").repartition(5)
    n, got = R.common_terms(df, "words", 40, ngrams, least, most)
    want = {t: c for t, c in counted(lists, ngrams).items() if least <= c[1] <= (most or 1) * len(lists)}
    assert n == len(lists) and len(got) == min(40, len(want))
    assert all(want[t][1] == rows for t, rows in got)
    totals = [want[t][0] for t, _ in got]
    assert totals == sorted((c[0] for c in want.values()), reverse=True)[:40]


def test_rare_terms_are_not_told_apart(spark, lists, monkeypatch):
    """Only terms of full buckets leave the tasks by themselves; the floor is lowered where it was too high."""
    marked = []

    def bound(fn, **given):
        if "wanted" in given:
            marked.append(int(np.unpackbits(given["wanted"]).sum()))
        return partial(fn, **given)

    monkeypatch.setattr(R, "partial", bound)
    df = spark.createDataFrame([(r,) for r in lists], "words array<string>").repartition(3)
    want = counted(lists, 3)
    for size, most in ((5, None), (5, 0.05)):  # with the second, all terms of the first buckets are too frequent
        marked.clear()
        _, got = R.common_terms(df, "words", size, 3, 1.0, most)
        totals = sorted((c[0] for c in want.values() if most is None or c[1] <= most * len(lists)), reverse=True)[:size]
        assert [want[t][0] for t, _ in got] == totals and marked[0] < len(want) / 10
        assert len(marked) == 1 if most is None else len(marked) > 1 and marked == sorted(marked)


def test_terms_at_the_cut_do_not_depend_on_partitions(spark, lists):
    df = spark.createDataFrame([(" ".join(r) + " zz",) for r in lists], "text string")
    found = [R.vocabulary(R.fit_tfidf(df.repartition(k), "text", "v", 60, 3)) for k in (1, 3, 7)]
    assert found[0] == found[1] == found[2]


def test_words_that_share_a_hash_are_told_apart(spark, lists):
    few = lambda word, seed: F.crc32(word.cast("binary")) % 7 if seed < 2 else F.xxhash64(word)
    df = spark.createDataFrame([(r,) for r in lists], "words array<string>")
    _, got = R.common_terms(df, "words", 25, 2, word_hash=few)
    want = counted(lists, 2)
    assert all(want[t][1] == rows for t, rows in got)
    assert [want[t][0] for t, _ in got] == sorted((c[0] for c in want.values()), reverse=True)[:25]


def test_sparse_pairs_of_both_kinds_of_vector(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(5, [1, 4], [2.0, 0.0])), (2, Vectors.dense([0.0, 3.0, 0.5]))], ["id", "v"])
    got = {r["id"]: [(e["index"], e["value"]) for e in r["e"]] for r in df.select("id", R.sparse_pairs("v").alias("e")).collect()}
    assert got == {1: [(1, 2.0)], 2: [(1, 3.0), (2, 0.5)]}


def test_term_counts_weigh_as_the_vectors(spark, lists):
    texts = [(i, " ".join(r) + " the zz") for i, r in enumerate(lists)] + [(-1, ""), (-2, "unseen words"), (-3, "Alpha, alpha; ALPHA")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    model = R.fit_tfidf(df.where("id <> -2"), "text", "v", 60, 3, 2.0)
    assert {len(t.split(" ")) for t in R.vocabulary(model)} == {1, 2, 3}
    want = {r["id"]: r["x"] for r in R.with_tfidf(model, df).select("id", vector_to_array("v").alias("x")).collect()}
    got = R.with_term_counts(model, df).select("id", "_e.index", "_e.count").toArrow().combine_chunks()
    rows = kernels.dense_rows(got["index"].chunk(0), got["count"].chunk(0), R.term_weights(model))
    assert all(np.abs(rows[i] - want[x]).max() < 1e-14 for i, x in enumerate(got["id"].to_pylist())) and not rows[got["id"].to_pylist().index(-1)].any()


def test_runs_of_rows_go_by_words():
    lists = pa.array([[1] * 10, None, [], [1] * 400, [1] * 30, [1] * 30])
    sizes = [(len(s), int(s.value_lengths().fill_null(0).to_numpy().sum())) for s in kernels.slices(lists, 60)]
    assert sizes == [(3, 10), (1, 400), (2, 60)]


def test_overlaps_bear_long_names():
    """Memory goes with the characters of the names, not with the longest one times their number."""
    lists = pa.array([["x" * 1_000_000, "a"]] + [["a", f"b{i}"] for i in range(9_999)], pa.list_(pa.string()))
    assert kernels.overlaps(lists[:2], lists)[1, 0] == 1 / 3


def test_tables_of_hashes_do_not_stay(spark, lists, monkeypatch):
    """And the words are read once: the second pass of the tokens names the vocabulary."""
    gone, made = [], []
    monkeypatch.setattr(R, "delete_folder", lambda s, p: gone.append(p))
    real = R.scratch_path
    monkeypatch.setattr(R, "scratch_path", lambda s, name: made.append(real(s, name)) or made[-1])
    df = spark.createDataFrame([(r,) for r in lists], "words array<string>")
    R.common_terms(df, "words", 25, 2)
    assert gone == made and len(made) == 2


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    from docketry.session import small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    seen = []
    real = R.codes_and_words
    monkeypatch.setattr(R, "_common_terms", lambda lists, *a: seen.append(lists.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]) or (0, []))
    R.common_terms(spark.range(0, 9000, 1, 1).select(F.array(F.lit("ab")).alias("words")), "words", 5)
    assert seen == [1000] and spark.conf.get(name) == before and real
    with small_batches(spark, 10):
        with small_batches(spark, 500):
            assert spark.conf.get(name) == "10"
