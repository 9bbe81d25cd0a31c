import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import cleaning as C
from docketry.operators import office_actions as O
from docketry.operators import sampling as S
from docketry.operators import statistics as ST
from docketry.operators import trends as T
from docketry.operators.scaling import exact_quantiles, global_rank, neighbours, prefix_sums, top_per_key


def test_repair_misaligned(spark):
    rows = [(0, "a"), (1, None), (2, "b"), (3, None), (4, None), (5, "c"), (6, "d"), (7, None)]
    df = spark.createDataFrame(rows, "row_no int, full_text string")
    got = {r["row_no"]: r["full_text"] for r in C.repair_misaligned(df, "full_text", "row_no").collect()}
    assert got == {0: "a", 1: "b", 4: "c", 6: "d"}


def test_small_blocks_see_their_neighbours(spark):
    df = spark.range(23).select(F.lit(0).alias("f"), F.col("id").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("f", "_block").orderBy("n")
    rows = neighbours(df, "f", "n", block=5).withColumn("next", F.lead("n").over(w)).where("_own").collect()
    assert sorted((r["n"], r["next"]) for r in rows) == [(i, i + 1 if i < 22 else None) for i in range(23)]


def test_keep_most_complete_with_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}", "x" if i == 50 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, text string, extra string")
    got = {r["text"]: r["id"] for r in C.keep_most_complete(df, "text", "id").collect()}
    assert got["hot"] == 50 and len(got) == 31


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0], list(range(101)), [0.0] * 60 + [1e-9, 5.0, -2.0, 1e12]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for bins in (4, 1024):
        got = exact_quantiles(df, "v", (0.0, 0.2, 0.5, 0.77, 1.0), bins)
        assert np.allclose(got, np.quantile(values, (0.0, 0.2, 0.5, 0.77, 1.0)))


def test_quantile_labels(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, score double")
    got = [r["c"] for r in C.quantile_labels(df, "score", "c").orderBy("id").collect()]
    assert got == ["Very Low"] * 2 + ["Low"] * 2 + ["Medium"] * 2 + ["High"] * 2 + ["Very High"] * 2
    same = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.5)], "id int, score double")
    assert {r["c"] for r in C.quantile_labels(same, "score", "c").collect()} == {"Unknown"}


def test_prefix_sums_and_rank(spark):
    random.seed(1)
    rows = [(i, random.choice([1, 1, 1, 2, 9]), random.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(5)
    got = {r["id"]: (r["s"], r["n"]) for r in prefix_sums(
        df, [F.asc("k"), F.asc("id")], {"s": F.col("v").cast("long"), "n": F.lit(1).cast("long")}).collect()}
    running = 0
    for place, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        running += v
        assert got[i] == (running, place)
    ranks = sorted(r["p"] for r in global_rank(df, [F.desc("id")], "p").collect())
    assert ranks == list(range(1, 301))


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    kept = top_per_key(df, ["k"], [F.desc("id")], 2)
    assert sorted((r["k"], r["id"]) for r in kept.collect()) == [(0, 96), (0, 98), (1, 97), (1, 99)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_statuses(spark):
    df = spark.createDataFrame(
        [(1, "Unpublished", 0), (2, "Published", 0), (3, "Non-Precedential", 9), (4, None, 6), (5, None, 1)], "id int, s string, n int")
    got = [r["r"] for r in df.select(C.normalised_status("s", "n", F.lit("X")).alias("r")).collect()]
    assert got == ["Unpublished", "Published", "Unpublished", "Published", "Not Available"]


def test_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None)], "n int, v string")
    first = {r["v"]: r["code"] for r in C.first_appearance_codes(df, "v", "n").collect()}
    assert first == {"b": 0, "a": 1, None: 2}
    coded = C.with_codes(df, "v", C.sorted_codes(df, "v"), "c", missing=-1).orderBy("n").collect()
    assert [r["c"] for r in coded] == [1, 0, 1, -1]


def test_unknown_center_is_an_error(spark):
    df = spark.createDataFrame([(2100,)], "techCenter int")
    with pytest.raises(ValueError):
        O.require_center(df, "9999")


SERIES = [("gap", 2000, 3), ("gap", 2002, 5), ("one", 2001, 4), ("zero", 2000, 0), ("zero", 2003, 0)] + [
    ("long", 1990 + i, 10 + 2 * i) for i in range(12)]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(SERIES, "keyword string, year int, count long")


def test_zero_fill_and_runs(series):
    filled = {(r["keyword"], r["year"]): r["count"] for r in T.zero_filled(series).collect()}
    assert filled[("gap", 2001)] == 0 and len([k for k in filled if k[0] == "zero"]) == 4
    runs = {r["keyword"]: r["longest_run"] for r in T.longest_run(series).collect()}
    assert runs == {"gap": 1, "one": 1, "zero": 0, "long": 12}


def test_damped_forecast(series):
    rows = {(r["keyword"], r["year"]): r for r in T.damped_forecast(series).collect()}
    base = (np.mean([24, 26, 28, 30, 32]) + 32) / 2
    assert math.isclose(rows[("long", 2002)]["value"], base)
    assert math.isclose(rows[("long", 2004)]["value"], base + 2 * 2 / 1.4)
    assert rows[("one", 2002)]["value"] == 4.0 and rows[("one", 2002)]["upper"] is None


def test_sparse_regimes(series):
    rows = {(r["keyword"], r["year"]): (r["regime"], r["value"]) for r in T.sparse_forecast(series).collect()}
    assert rows[("zero", 2005)] == ("ramp", 1.0)
    assert rows[("one", 2002)] == ("line", 4.0)
    assert not any(k == "long" for k, _ in rows)
    slope, cut = np.polyfit([2000, 2001, 2002], [3, 0, 5], 1)
    assert math.isclose(rows[("gap", 2004)][1], max(1, slope * 2004 + cut), rel_tol=1e-6)


def test_smoothing(series):
    rows = {(r["keyword"], r["year"]): r["value"] for r in T.smoothing_forecast(series).collect()}
    assert rows[("one", 2002)] == 4.0 and rows[("zero", 2004)] == 0.0 and rows[("long", 2002)] > 30
    regime = {(r["keyword"], r["year"]): r["value"] for r in T.regime_forecast(series).collect()}
    assert 32 < regime[("long", 2002)] < 36
    folds = {r["keyword"]: r for r in T.smoothing_validation(series).collect()}
    assert folds["long"]["folds"] == 3 and folds["long"]["mse"] < 1.0 and folds["one"]["mse"] is None


def test_multilabel_report(spark):
    rows = [(1, "p", ["a"], ["a", "c"]), (2, "p", ["a", "b"], []), (3, "q", [], ["a"])]
    df = spark.createDataFrame(rows, "id int, period string, truth array<string>, predicted array<string>")
    got = {(r["label"], r["period"]): (r["precision"], r["recall"], r["support"]) for r in
           ST.multilabel_report(df, "truth", "predicted", "period").collect()}
    assert got[("a", "all")] == (0.5, 0.5, 2) and got[("b", "all")] == (0.0, 0.0, 1) and got[("c", "all")] == (0.0, 0.0, 0)
    assert got[("a", "p")] == (1.0, 0.5, 2)


def test_precision_recall_with_hot_score(spark):
    random.seed(3)
    rows = [(random.randint(0, 1), random.choice([0.5, 0.5, 0.5, 0.1, 0.9, 0.7])) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, score double")
    curve = {r["threshold"]: (r["precision"], r["recall"]) for r in ST.precision_recall_curve(df, "label", "score").collect()}
    total = sum(y for y, _ in rows)
    for cut in {s for _, s in rows}:
        chosen = [y for y, s in rows if s >= cut]
        assert np.allclose(curve[cut], (sum(chosen) / len(chosen), sum(chosen) / total))


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, "hot" if i % 10 else "rare") for i in range(200)], "id int, label string")
    got = ST.stratified_split(df, "id", "label").where("is_test").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"hot": 36, "rare": 4}


def test_augmentation_fills_thin_periods(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(10))
    rows = [(i, text, 10, "thin") for i in range(4)] + [(100 + i, text, 10, "full") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, full_text string, citation_count long, period string")
    out = S.augmented_cases(df, "id", "full_text", "period", ["citation_count"], minimum=10).collect()
    made = [r for r in out if r["augmented"]]
    assert len(out) == 22 and len(made) == 6 and {r["period"] for r in made} == {"thin"}
    assert all(9.0 <= r["citation_count"] <= 11.0 and r["full_text"].count(".") == 8 for r in made)
    again = S.augmented_cases(df.repartition(3), "id", "full_text", "period", ["citation_count"], minimum=10).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_moved_text_is_found_over_gaps_and_block_edges(spark, monkeypatch):
    from docketry.operators import scaling

    real = scaling.neighbours
    monkeypatch.setattr("docketry.operators.cleaning.neighbours", lambda df, file, row: real(df, file, row, 10))
    rows = [(9, None), (12, "moved"), (35, "whole"), (47, None), (58, "last")]
    df = spark.createDataFrame(rows, "row_no long, text string")
    from docketry.operators.cleaning import repair_misaligned

    got = {r["row_no"]: r["text"] for r in repair_misaligned(df, "text", "row_no").collect()}
    assert got == {9: "moved", 35: "whole", 47: "last"}
