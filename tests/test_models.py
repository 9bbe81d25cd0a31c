from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from docketry.operators import forests
from docketry.operators import learn as L
from docketry.plans import learning
from docketry.session import scratch_path, scratch_root, scratch_scope
from tests.test_search import TEXTS


def test_rejection_model_survives_saving(spark):
    rng = np.random.default_rng(3)
    rows = [(f"US{i}A", float(rng.normal() + (i % 3 == 0)), float(rng.normal()), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, a double, b double, label int")
    for boosted in (False, True):
        model, scores = L.fit_rejection_model(df, "id", "label", ["a", "b"], boosted=boosted, trees=3, folds=3)
        assert scores.count() == 3
        held = model.held.collect()
        assert sorted(r["id"] for r in held) == sorted(r[0] for r in rows)
        curve = sorted((r["score"], r["calibrated"]) for r in L.calibrated(model.held, model.calibration).collect())
        steps = np.diff([c for _, c in curve])
        assert (steps >= -1e-12).all() or (steps <= 1e-12).all()
        again = L.load_model(spark, L.save_model(spark, model, scratch_path(spark, "model")))
        assert again.columns == ["a", "b"] and again.held is None
        first, second = (
            {r["id"]: r["rejection_probability"] for r in m.transform(df).select("id", "rejection_probability").collect()} for m in (model, again))
        assert first == second


def test_issue_models_survive_saving(spark):
    rows = [(i, TEXTS[i % 5] + f" extra{i}", f"{1996 + 5 * (i % 6)}-01-01", []) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, d string, c array<struct<cite:string,date:string>>")
    features = L.case_features(df, "id", "t", "d", "c")
    options = {"trees": 2, "depth": 3, "max_features": 50, "ngrams": 1}
    for model in (L.fit_issue_models(features, **options), L.fit_period_blend(features, minimum=5, **options)):
        again = L.load_model(spark, L.save_model(spark, model, scratch_path(spark, "model")))
        assert type(again) is type(model)
        scored = [{r["id"]: (r["predicted"], r["scores"]) for r in m.predict(features).collect()} for m in (model, again)]
        assert scored[0] == scored[1] and len(scored[0]) == 40


def test_scratch_scope_deletes_its_tables(spark, tmp_path):
    import os

    from docketry.session import cut_lineage

    with scratch_scope(spark):
        table = cut_lineage(spark.range(5))
        folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
        assert table.agg(F.sum("id")).first()[0] == 10 and os.path.isdir(folder)
    assert not os.path.exists(os.path.dirname(folder)) and scratch_root(spark)


class Called(Exception):
    pass


@pytest.mark.parametrize("query,fit", [
    ("ml1", "fit_feature_pipeline"), ("ml2", "fit_issue_models"), ("ml3", "fit_issue_models"), ("ml4", "fit_period_blend"),
    ("ml5", "fit_relevance_model"), ("ml5_folds", "fit_relevance_model"), ("ml6", "tuned_forest"), ("ml7", "fit_relevance_model"),
    ("ml8", "fit_outcome_model"), ("ml9", "fit_status_model"), ("ml11", "fit_rejection_model"), ("ml11_boosted", "fit_rejection_model"),
    ("ml13", "fit_rejection_model"), ("ml14", "fit_rejection_model"), ("ml15", "fit_issue_models"), ("snk3", "fit_status_model"),
])
def test_model_queries_use_the_defaults(monkeypatch, query, fit):
    def spy(*given, **options):
        data = {"tuned_forest": 2, "fit_rejection_model": 4}.get(fit, 1)  # rows, and columns of them
        assert len(given) == data and options.keys() <= {"boosted"}
        raise Called

    for rows in ("issue_rows", "outcome_rows", "rejection_rows"):
        monkeypatch.setattr(learning, rows, lambda t: MagicMock())
    monkeypatch.setattr(learning, "F", MagicMock())
    monkeypatch.setattr(learning, "scratch_path", MagicMock())
    for name in ("relevance_rows", "fit_relevance_features"):
        monkeypatch.setattr(L, name, MagicMock())
    monkeypatch.setattr(L, fit, spy)
    with pytest.raises(Called):
        getattr(learning, query)(MagicMock())


def forest_rows(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 6)), 2)
    label = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n)) > 0.3).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(label[i])) for i in range(n)], "id long, v array<double>, label double")
    return df.select("id", array_to_vector("v").alias("features"), "label", F.lit(1.0).alias("weight")).repartition(1)


def test_node_tables_score_as_the_forest(spark):
    rows = forest_rows(spark).cache()
    model = L.forest(7, 6, 2).fit(rows)
    x = np.array([r["features"].toArray() for r in rows.collect()])
    got = forests.nodes_of(model, rows).scores(x, [7], [6])[:, 0, 0]
    want = [r["rawPrediction"][1] for r in model.transform(rows).collect()]
    assert np.allclose(got, want)


def test_shallower_forests_are_cut_deep_ones(spark):
    """A forest cut at a depth is the forest fitted to that depth with the same number of trees and seed."""
    rows = forest_rows(spark).cache()
    x = np.array([r["features"].toArray() for r in rows.collect()])
    deep = forests.nodes_of(L.forest(5, 8, 1).fit(rows), rows)
    for depth in (1, 3):
        small = L.forest(5, depth, 1).fit(rows)
        want = [r["rawPrediction"][1] for r in small.transform(rows).collect()]
        assert np.allclose(deep.scores(x, [5], [depth])[:, 0, 0], want), depth


def test_grid_from_one_fit_per_fold_and_leaf(spark):
    rows = forest_rows(spark).cache()
    model, table = L.tuned_forest(rows.drop("weight"), "id", (3, 9), (2, 6), (1, 4), folds=3)
    got = {(r["trees"], r["depth"], r["leaf"]): r["f1"] for r in table.collect()}
    assert len(got) == 8 and all(0.4 < v <= 1 for v in got.values())
    best = max(got.values())
    assert got[model.getNumTrees, model.getOrDefault("maxDepth"), model.getOrDefault("minInstancesPerNode")] == best
    folded = L.balanced_weights(rows.drop("weight"), "label").withColumn("_fold", L.fold_of("id", 3))
    f1 = []
    for i in range(3):
        scored = L.forest(9, 6, 4).fit(folded.where(F.col("_fold") != i)).transform(folded.where(F.col("_fold") == i))
        f1.append(L.binary_scores(scored)["f1"])
    assert abs(got[9, 6, 4] - np.mean(f1)) < 0.05  # the same fits, but for the order in which rows are read
