"""Classifiers over cases and office actions, built from Spark ML pipelines."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import lexicons
from docketry.functions import patent as P
from docketry.functions import text as X
from docketry.operators.cleaning import court_level, numeric_features
from docketry.operators.graph import with_node_metrics
from docketry.operators import bagging, boosting, deep_forests, forests
from docketry.operators.pruned import pruned_nearest
from docketry.operators.retrieval import fit_tfidf, vocabulary
from docketry.operators.scaling import broadcast_if_small, global_rank
from docketry.operators.statistics import split_bucket
from docketry.session import cut_lineage

SEED = 42


def probability(vector: str = "probability", index: int = 1) -> Column:
    return F.get(vector_to_array(vector), F.lit(index))


def fold_of(key: str | Column, folds: int = 5) -> Column:
    """Fold number from the key's text alone."""
    return F.floor(split_bucket(key) * folds).cast("int")


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight each row by n / (classes x rows of its class)."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    weights = counts.select("_label", (F.lit(float(total["n"])) / (F.lit(float(total["k"])) * F.col("_n"))).alias(name))
    return df.join(broadcast_if_small(weights), F.col(label) == F.col("_label")).drop("_label")


def binary_scores(scored: DataFrame, label: str = "label", predicted: str = "prediction") -> dict[str, float]:
    """Precision, recall and F1 of class 1 from one aggregate."""
    hit = lambda t: F.count(F.when(t, 1))
    y, p = F.col(label) == 1, F.col(predicted) == 1
    row = scored.agg(hit(y & p).alias("tp"), hit(~y & p).alias("fp"), hit(y & ~p).alias("fn")).first()
    precision = row["tp"] / (row["tp"] + row["fp"]) if row["tp"] + row["fp"] else 0.0
    recall = row["tp"] / (row["tp"] + row["fn"]) if row["tp"] + row["fn"] else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return {"precision": precision, "recall": recall, "f1": f1}


def cross_validated(df: DataFrame, key: str, fit: Callable[[DataFrame], Transformer], folds: int = 5) -> DataFrame:
    """Scores ``(fold, precision, recall, f1)`` of a fit over held-out folds."""
    rows = []
    folded = df.withColumn("_fold", fold_of(key, folds))
    for i in range(folds):
        model = fit(folded.where(F.col("_fold") != i).drop("_fold"))
        scores = binary_scores(model.transform(folded.where(F.col("_fold") == i)))
        rows.append((i, scores["precision"], scores["recall"], scores["f1"]))
    return df.sparkSession.createDataFrame(rows, "fold int, precision double, recall double, f1 double")


def fold_scores(held: DataFrame, folds: int) -> DataFrame:
    """Scores ``(fold, precision, recall, f1)`` of held-out rows ``(_fold, label, prediction)``."""
    rows = []
    for i in range(folds):
        scores = binary_scores(held.where(F.col("_fold") == i))
        rows.append((i, scores["precision"], scores["recall"], scores["f1"]))
    return held.sparkSession.createDataFrame(rows, "fold int, precision double, recall double, f1 double")


# --- legal issues of a case -------------------------------------------------

CASE_NUMBERS = ("citation_count", "avg_citation_age", "citation_span")
ALL_ISSUES = tuple(sorted(lexicons.ISSUE_PATTERNS))


def case_features(cases: DataFrame, key: str, text: str | Column, date: str, citations: str | Column) -> DataFrame:
    """Text, period, issues and citation numbers of each case with any text."""
    base = cases.select(
        F.col(key).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"), F.col(date).alias("date_filed"),
        X.time_period(date).alias("time_period"), X.citation_date_features(citations, date).alias("_c"),
    ).where(F.col("text") != "")
    return base.select(
        "id", "text", "date_filed", "time_period", X.legal_issues("text", "time_period").alias("issues"),
        *[F.col(f"_c.{c}").cast("double").alias(c) for c in CASE_NUMBERS],
    )


def fit_feature_pipeline(features: DataFrame, max_features: int = 5000, min_df: float = 2.0, ngrams: int = 3) -> PipelineModel:
    """Term weights, scaled citation numbers and one-hot period in one vector."""
    terms = fit_tfidf(features, "text", "terms", max_features, ngrams, min_df)
    numbers = VectorAssembler(inputCols=list(CASE_NUMBERS), outputCol="_numbers")
    scaler = StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True).fit(numbers.transform(features))
    index = StringIndexer(inputCol="time_period", outputCol="_period", stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(features)
    onehot = OneHotEncoder(inputCol="_period", outputCol="_onehot", dropLast=False).fit(index.transform(features))
    parts = VectorAssembler(inputCols=["terms", "_scaled", "_onehot"], outputCol="features")
    return PipelineModel([*terms.stages, numbers, scaler, index, onehot, parts])


def feature_names(pipeline: PipelineModel) -> list[str]:
    """Names of the entries of ``features``, in order."""
    labels = next(s.labels for s in pipeline.stages if isinstance(s, StringIndexerModel))
    return [*vocabulary(pipeline), *CASE_NUMBERS, *[f"period={x}" for x in [*labels, "other"]]]


def period_weight(period: str | Column = "time_period") -> Column:
    weights = F.create_map(*[F.lit(v) for kv in lexicons.TRAINING_PERIOD_WEIGHT.items() for v in kv])
    return F.element_at(weights, F.col(period) if isinstance(period, str) else period)


@dataclass
class IssueModel:
    """A feature pipeline and one forest per issue seen in training."""

    pipeline: PipelineModel
    forests: dict[str, Transformer]

    def scores(self, features: DataFrame) -> DataFrame:
        """``(id, time_period, scores)`` with scores as a map of issue to probability."""
        out = self.pipeline.transform(features)
        for i, forest in enumerate(self.forests.values()):
            out = forest.transform(out).withColumn(f"_p{i}", probability(f"_prob{i}"))
        pairs = [v for i, name in enumerate(self.forests) for v in (F.lit(name), F.col(f"_p{i}"))]
        scores = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        return out.select("id", "time_period", scores.alias("scores"))

    def predict(self, features: DataFrame, recent: float = 0.35, older: float = 0.4) -> DataFrame:
        """Scores and the issues at or above the period's threshold."""
        scored = self.scores(features)
        limit = F.when(F.col("time_period").isin("post_2020", "2010_2020"), recent).otherwise(older)
        chosen = F.map_keys(F.map_filter("scores", lambda _, p: p >= limit))
        return scored.withColumn("predicted", F.array_sort(chosen))


def fit_issue_models(features: DataFrame, weight: Column | None = None, trees: int = 200, depth: int = 30,
                     max_features: int = 5000, min_df: float = 2.0, ngrams: int = 3, issues: Sequence[str] = ALL_ISSUES) -> IssueModel:
    """One weighted forest per issue; weight is the period weight times (1 + label)."""
    features = cut_lineage(features)
    pipeline = fit_feature_pipeline(features, max_features, min_df, ngrams)
    ready = cut_lineage(
        pipeline.transform(features.withColumn("_w", weight if weight is not None else period_weight()))
        .select("issues", "features", "_w")
    )
    counts = ready.agg(*[F.count(F.when(F.array_contains("issues", i), 1)).alias(i) for i in issues]).first()
    forests = {}
    for issue in issues:
        if not counts[issue]:
            continue
        y = F.array_contains("issues", issue).cast("double")
        labelled = ready.select("features", y.alias("label"), (F.col("_w") * (1.0 + y)).alias("weight"))
        n = len(forests)
        forests[issue] = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, minInstancesPerNode=1, seed=SEED, weightCol="weight",
            rawPredictionCol=f"_raw{n}", probabilityCol=f"_prob{n}", predictionCol=f"_pred{n}",
        ).fit(labelled)
    return IssueModel(pipeline, forests)


@dataclass
class PeriodBlend:
    """A base model with models of single periods, blended by their precision."""

    base: IssueModel
    periods: dict[str, IssueModel] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def predict(self, features: DataFrame) -> DataFrame:
        base = self.base.predict(features)
        own = None
        for period, model in self.periods.items():
            scored = model.predict(features.where(F.col("time_period") == period)).select(
                "id", F.col("scores").alias("_s"), F.col("predicted").alias("_p"), F.lit(self.weights[period]).alias("_c")
            )
            own = scored if own is None else own.unionByName(scored)
        if own is None:
            return base
        joined = base.join(own, "id", "left")
        limit = F.when(F.col("time_period").isin("post_2020", "2010_2020"), 0.4).otherwise(0.5)
        named = F.array_union("predicted", "_p")
        score = lambda m, i: F.coalesce(F.element_at(F.col(m), i), F.lit(0.0))
        blended = F.map_from_entries(
            F.transform(named, lambda i: F.struct(i, score("scores", i) * (1.0 - F.col("_c")) + score("_s", i) * F.col("_c")))
        )
        joined = joined.withColumn("_blend", F.when(F.col("_c").isNotNull(), blended))
        chosen = F.array_sort(F.map_keys(F.map_filter("_blend", lambda _, p: p >= limit)))
        return joined.select(
            "id", "time_period", F.coalesce("_blend", "scores").alias("scores"),
            F.when(F.col("_c").isNotNull(), chosen).otherwise(F.col("predicted")).alias("predicted"),
        )


def fit_period_blend(features: DataFrame, minimum: int = 20, **options) -> PeriodBlend:
    """Base model plus a model for every period with at least ``minimum`` cases."""
    features = cut_lineage(features)
    blend = PeriodBlend(fit_issue_models(features, **options))
    counts = features.groupBy("time_period").agg(F.count("*").alias("n")).collect()  # one row per period name
    for row in sorted(counts, key=lambda r: r["time_period"]):
        if row["n"] < minimum:
            continue
        period = row["time_period"]
        own = features.where(F.col("time_period") == period)
        model = fit_issue_models(own, **options)
        checked = model.predict(own).join(own.select("id", "issues"), "id")
        found = checked.agg(
            F.sum(F.size(F.array_intersect("predicted", "issues"))).alias("right"), F.sum(F.size("predicted")).alias("made")
        ).first()
        blend.periods[period] = model
        blend.weights[period] = found["right"] / found["made"] if found["made"] else 0.5
    return blend


def classify_report(cases: DataFrame, key: str, text: str, date: str, citations: str | Column, model: IssueModel | PeriodBlend,
                    minimum: int = 10) -> DataFrame:
    """Predictions, scores, period, text features and matched patterns per case."""
    long = cases.where(F.length(X.strip_space(F.col(text))) >= minimum)
    features = cut_lineage(case_features(long, key, text, date, citations))
    extra = features.select(
        "id", X.enhanced_features("text", "time_period").alias("features"), F.col("issues").alias("patterns"),
        *CASE_NUMBERS, F.length("text").alias("text_length"),
    )
    return model.predict(features).join(extra, "id")


# --- relevance of a case ----------------------------------------------------

RELEVANCE_NUMBERS = ("court_level", "text_length", "title_length", "citation_count", "year")


def relevance_rows(cases: DataFrame, key: str, threshold: float = 0.2) -> DataFrame:
    """Letters-only text, court level, numbers and the 0/1 target."""
    text = X.letters_only(F.concat(X.text_or_empty("text_excerpt"), F.lit(" "), X.text_or_empty("case_name")))
    rows = numeric_features(cases).withColumns({"_text": text, "court_level": court_level("court_id")})
    return rows.select(
        F.col(key).alias("id"), F.col("_text").alias("text"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in RELEVANCE_NUMBERS],
        F.coalesce((F.col("tech_relevance_score") >= threshold).cast("double"), F.lit(0.0)).alias("label"),
    )


def fit_relevance_features(rows: DataFrame, max_features: int = 500, min_df: float = 10.0, max_df: float = 0.9) -> PipelineModel:
    terms = fit_tfidf(rows, "text", "terms", max_features, 2, min_df, max_df)
    parts = VectorAssembler(inputCols=["terms", *RELEVANCE_NUMBERS], outputCol="features")
    return PipelineModel([*terms.stages, parts])


def forest(trees: int, depth: int, leaf: int, weight: str | None = "weight") -> RandomForestClassifier:
    options = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=SEED, **options)


def fit_relevance_model(rows: DataFrame, trees: int = 200, depth: int = 15, leaf: int = 4, folds: int = 5):
    """Fitted feature pipeline, balanced forest, and held-out scores per fold.

    The forests of all folds and the final one grow together while a task can hold the
    binned rows (``deep_forests``); beyond that Spark fits them one after another.
    """
    rows = cut_lineage(rows)
    pipeline = fit_relevance_features(rows)
    ready = cut_lineage(pipeline.transform(rows).select("id", "features", "label"))
    if deep_forests.fits_task(ready.count(), len(vocabulary(pipeline)) + len(RELEVANCE_NUMBERS)):
        folded = ready.select(fold_of("id", folds).alias("_fold"), vector_to_array("features").alias("x"), "label")
        model, held = deep_forests.fit_folds(folded, "_fold", folds, "x", "label", trees, depth, leaf)
        held = cut_lineage(held.select(F.col("fold").alias("_fold"), "label", (F.col("score") > 0.5).cast("double").alias("prediction")))
        return pipeline, model, fold_scores(held, folds)
    fit = lambda part: forest(trees, depth, leaf).fit(balanced_weights(part, "label"))
    return pipeline, fit(ready), cross_validated(ready, "id", fit, folds)


def tuned_forest(ready: DataFrame, key: str, trees: Sequence[int] = (100, 200, 300), depths: Sequence[int] = (10, 20, 30),
                 leaves: Sequence[int] = (1, 2, 4), folds: int = 5, parallelism: int = 4):
    """Grid search on the F1 of class 1; returns the best model and ``(trees, depth, leaf, f1)`` rows.

    Smaller numbers of trees and depths are read off the largest forest of each
    fold and leaf size, so the fits number folds * leaf sizes. F1 is the mean of
    the folds' values; equal values go to the smaller forest.
    """
    folded = cut_lineage(balanced_weights(ready, "label").withColumn("_fold", fold_of(key, folds)))

    def held_out(point: tuple[int, int]) -> dict[tuple[int, int, int], float]:
        """F1 of every grid point with this leaf size, on this fold."""
        leaf, fold = point
        model = forest(max(trees), max(depths), leaf).fit(folded.where(F.col("_fold") != fold))
        counts = forests.grid_counts(folded.where(F.col("_fold") == fold), forests.nodes_of(model, ready), trees, depths)
        return {(r["trees"], r["depth"], leaf): 2 * r["tp"] / max(1, 2 * r["tp"] + r["fp"] + r["fn"]) for r in counts.collect()}  # a row per point

    sums = {(t, d, leaf): 0.0 for t in trees for d in depths for leaf in leaves}
    with ThreadPoolExecutor(parallelism) as pool:
        for found in pool.map(held_out, [(leaf, i) for leaf in leaves for i in range(folds)]):
            for point, f1 in found.items():
                sums[point] += f1
    rows = [(*point, total / folds) for point, total in sorted(sums.items())]
    best = max(rows, key=lambda r: (round(r[3], 12), -r[0], -r[1], -r[2]))
    table = ready.sparkSession.createDataFrame(rows, "trees int, depth int, leaf int, f1 double")
    return forest(*best[:3]).fit(folded), table


def feature_importance(df: DataFrame, model, names: Sequence[str], top: int = 20) -> DataFrame:
    """The most important named features; the vector is as long as the vocabulary."""
    weights = model.featureImportances
    pairs = sorted(((float(weights[int(i)]), names[int(i)]) for i in weights.indices), key=lambda x: (-x[0], x[1]))[:top]
    return df.sparkSession.createDataFrame([(n, w) for w, n in pairs], "feature string, importance double")


# --- outcome and status of a case -------------------------------------------


def fit_outcome_model(rows: DataFrame, max_features: int = 5000, rounds: int = 200, depth: int = 5, rate: float = 0.1) -> PipelineModel:
    """Boosted trees over text, court, judge and citation counts.

    ``rows`` is ``(text, court, judge, citing_count, cited_count, label)``. A court
    or judge not seen in training takes code 0.
    """
    rows = cut_lineage(rows)
    stages = list(fit_tfidf(rows, "text", "terms", max_features).stages)
    for c in ("court", "judge"):
        index = StringIndexer(inputCol=c, outputCol=f"_{c}", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
        unseen = len(index.labels)
        code = SQLTransformer(statement=f"SELECT *, IF(_{c} >= {unseen}, 0D, _{c}) AS {c}_code FROM __THIS__")
        stages += [index, code]
    stages.append(VectorAssembler(
        inputCols=["terms", "court_code", "judge_code", "citing_count", "cited_count"], outputCol="features"))
    ready = cut_lineage(PipelineModel(stages).transform(rows).select("features", "label"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED).fit(ready)
    return PipelineModel([*stages, model])


def fit_status_model(rows: DataFrame, max_features: int = 5000, trees: int = 100, depth: int = 30) -> PipelineModel:
    """Forest over term weights that predicts ``status`` from ``text``."""
    rows = cut_lineage(rows)
    terms = fit_tfidf(rows, "text", "features", max_features)
    index = StringIndexer(inputCol="status", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    ready = cut_lineage(PipelineModel([*terms.stages, index]).transform(rows).select("features", "label"))
    return PipelineModel([*terms.stages, index, forest(trees, depth, 1, None).fit(ready)])


# --- rejection of a claim ---------------------------------------------------

PATENT_FEATURES = (
    "is_examiner_cited", "is_applicant_cited", "is_npl", "tech_center", "num_passages", "num_claims_cited",
    "num_paragraphs_cited", "num_figures_cited", "has_spec_support",
)


def patent_features(actions: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Flags, centre, passage features and, when given, node metrics of the publication."""
    out = actions.withColumns(
        {"is_examiner_cited": P.flag("examinerCitedReferenceIndicator"),
         "is_applicant_cited": P.flag("applicantCitedExaminerReferenceIndicator"), "is_npl": P.flag("nplIndicator"),
         "tech_center": F.coalesce(F.col("techCenter").try_cast("long"), F.lit(0).cast("long")),
         "_p": P.passage_features("passageLocationText")}
    )
    out = out.withColumns({c: F.col(f"_p.{c}") for c in PATENT_FEATURES[4:]}).drop("_p")
    return with_node_metrics(out, "publicationNumber", metrics) if metrics is not None else out


def synthetic_minority(rows: DataFrame, key: str = "id", vector: str = "vector", label: str = "label", neighbours: int = 5,
                       seed: int = SEED) -> DataFrame:
    """Balance two classes with points between minority rows and their neighbours.

    ``rows`` has a ``key`` of any type, an ``array<double>`` vector and a 0/1 label.
    Neighbours are the exactly nearest other minority rows at every size. Rows with
    equal vectors are searched once and count as often as they occur.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two classes
    if len(counts) < 2:
        return rows.select(key, vector, label).withColumn("synthetic", F.lit(False))
    small = min(counts, key=lambda c: (counts[c], c))
    need, n = max(counts.values()) - counts[small], counts[small]
    least = rows.where(F.col(label) == small).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    order = F.xxhash64(F.col("key"), F.lit(seed))
    ranked = cut_lineage(global_rank(least.withColumn("_h", order), [F.col("_h"), F.col("key")], "pos"))
    points = cut_lineage(ranked.groupBy("vector").agg(F.min("pos").alias("id"), F.count("*").alias("m")))
    near = pruned_nearest(points.select("id", "vector"), points.select("id", "vector"), neighbours + 1).join(
        points.select("id", "m"), "id")
    own = F.col("id") == F.col("query_id")
    times = F.least(F.lit(neighbours).cast("long"), F.col("m") - F.when(own, 1).otherwise(0)).cast("int")
    listed = F.sort_array(F.collect_list(F.struct("distance", (~own).alias("other"), "id", times.alias("times"))))
    # At most neighbours + 1 points of at most ``neighbours`` rows each.
    near = near.groupBy("query_id").agg(listed.alias("found")).select(
        F.col("query_id").alias("point"),
        F.slice(F.flatten(F.transform("found", lambda x: F.array_repeat(x["id"], x["times"]))), 1, neighbours).alias("near"),
    )
    copies = F.lit(need // n) + F.when(F.col("pos") <= need % n, 1).otherwise(0)
    draw = lambda what: F.xxhash64(F.lit(what), F.col("pos"), F.col("copy"), F.lit(seed))
    wanted = (
        ranked.select("key", "vector", "pos", copies.alias("copies")).where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
        .join(points.select("vector", F.col("id").alias("point")), "vector").join(near, "point")
        .withColumn("partner", F.when(F.size("near") > 0, F.get("near", F.pmod(draw("row"), F.size("near")).cast("int"))).otherwise(F.col("point")))
        .withColumn("way", F.pmod(draw("way"), F.lit(1 << 53)) / F.lit(float(1 << 53)))
    )
    made = wanted.join(points.select(F.col("id").alias("partner"), F.col("vector").alias("target")), "partner").select(
        F.col("key").alias(key),
        F.zip_with("vector", "target", lambda x, y: x + F.col("way") * (y - x)).alias(vector),
        F.lit(small).alias(label), F.lit(True).alias("synthetic"),
    )
    return rows.select(key, vector, label).withColumn("synthetic", F.lit(False)).unionByName(made)


@dataclass
class RejectionModel:
    """Scaler, classifier and Platt calibration; probabilities come from the last."""

    columns: list[str]
    scaler: Transformer
    classifier: bagging.BaggedTrees | boosting.BoostedTrees
    calibration: Transformer
    held: DataFrame | None = None  # (id, label, score) of every training row, scored outside its fold; not saved

    def transform(self, features: DataFrame) -> DataFrame:
        scaled = _scaled(features, self.columns, self.scaler)
        scored = self.classifier.transform(scaled).withColumn("_score", probability())
        scored = scored.drop("rawPrediction", "probability", "prediction")
        one = VectorAssembler(inputCols=["_score"], outputCol="_platt").transform(scored)
        out = self.calibration.transform(one).withColumn("rejection_probability", probability())
        return out.drop("_vector", "_scaled", "_platt", "rawPrediction", "probability", "prediction")


def _scaled(features: DataFrame, columns: Sequence[str], scaler: Transformer | None = None):
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    vectors = features.withColumn("_vector", array_to_vector(F.array(*numbers)))
    return vectors if scaler is None else scaler.transform(vectors)


def fit_rejection_model(features: DataFrame, key: str, label: str, columns: Sequence[str], boosted: bool = False,
                        trees: int = 100, folds: int = 5) -> tuple[RejectionModel, DataFrame]:
    """Impute 0, scale, balance, classify and calibrate; also held-out scores per fold.

    Balancing runs on training folds only. The out-of-fold scores train the
    calibration, and the final classifier sees all rows. The models of all folds
    and the final one grow together (``bagging``, ``boosting``).
    """
    columns = list(columns)
    base = cut_lineage(_scaled(features, columns).select(
        F.col(key).alias("id"), F.col(label).cast("double").alias("label"), "_vector"))
    scaler = StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True).fit(base)
    ready = cut_lineage(scaler.transform(base).select("id", "label", "_scaled", vector_to_array("_scaled").alias("vector")))

    def balanced(rows: DataFrame) -> DataFrame:
        return synthetic_minority(rows, "id", "vector", "label").select("vector", "label")

    folded = ready.withColumn("_fold", fold_of("id", folds))
    parts = [ready.where(fold_of("id", folds) != i) for i in range(folds)] + [ready]  # the last is the final model's
    # The sets of rows are independent until they meet in one table, so their neighbours are searched side by side.
    with ThreadPoolExecutor(folds + 1) as pool:
        tables = list(pool.map(lambda p: cut_lineage(balanced(p[1]).withColumn("_set", F.lit(p[0]))), enumerate(parts)))
    method, grow = (boosting, boosting.fit_boosted) if boosted else (bagging, bagging.fit_forests)
    models = grow(reduce(DataFrame.unionByName, tables), "_set", folds + 1, "vector", "label", trees, features="_scaled")
    chance = method.together(models[:folds], folded, F.col("_fold"))
    scored = folded.select("id", "label", "_fold", chance.alias("_score")).withColumn("prediction", (F.col("_score") > 0.5).cast("double"))
    held, final = cut_lineage(scored), models[-1]
    calibration = fit_platt(held, "_score", "label")
    model = RejectionModel(columns, scaler, final, calibration, held.select("id", "label", F.col("_score").alias("score")))
    return model, fold_scores(held, folds)


def fit_platt(scored: DataFrame, score: str, label: str) -> Transformer:
    """Logistic curve from raw scores to probabilities."""
    rows = VectorAssembler(inputCols=[score], outputCol="_platt").transform(scored.select(score, label))
    return LogisticRegression(featuresCol="_platt", labelCol=label, standardization=False).fit(rows)


def calibrated(scored: DataFrame, calibration: Transformer, score: str = "score") -> DataFrame:
    """Raw scores with the calibrated probability beside them."""
    ready = VectorAssembler(inputCols=[score], outputCol="_platt").transform(scored)
    out = calibration.transform(ready).withColumn("calibrated", probability())
    return out.select(*scored.columns, "calibrated")


def scored_questions(questions: DataFrame, model: RejectionModel) -> DataFrame:
    """Probability, level, advice and explanations for structured patent questions.

    ``questions`` holds office-action columns and the parsed tags of a question;
    a question has no place in the citation graph, so node metrics are 0.
    """
    features = patent_features(questions)
    missing = {c: F.lit(0.0) for c in model.columns if c not in features.columns}
    out = model.transform(features.withColumns(missing))
    out = out.withColumn("_c", P.claim_features(
        "examinerCitedReferenceIndicator", "applicantCitedExaminerReferenceIndicator", "nplIndicator", "techCenter",
        "passageLocationText"))
    advice = P.context_recommendations(
        P.question_recommendations("rejection_probability", "sections"), "query_type", "refs", "technical_field")
    return out.withColumns(
        {"confidence_level": P.confidence_level("rejection_probability"), "recommendations": advice,
         "summary": P.summary_text("rejection_probability", "query_type"), "technical_analysis": P.technical_analysis("_c")}
    ).drop("_c")


# --- saving fitted models ---------------------------------------------------

SAVED = {c.__name__: c for c in (IssueModel, PeriodBlend, RejectionModel, bagging.BaggedTrees, boosting.BoostedTrees)}


def save_model(spark: SparkSession, model: IssueModel | PeriodBlend | RejectionModel, path: str) -> str:
    """Write a fitted model: its Spark ML parts in folders, and a JSON text that says how they belong together."""

    def part(value, place: str):
        if isinstance(value, Transformer):
            PipelineModel([value]).write().overwrite().save(f"{path}/{place}")
            return {"transformer": place}
        if type(value).__name__ in SAVED:
            names = [f.name for f in fields(value) if not isinstance(getattr(value, f.name), DataFrame)]
            return {"model": type(value).__name__, "fields": {n: part(getattr(value, n), f"{place}-{n}") for n in names}}
        if isinstance(value, dict):
            return {"entries": [[k, part(v, f"{place}-{i}")] for i, (k, v) in enumerate(value.items())]}
        return {"value": value}

    text = json.dumps(part(model, "part"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parts")
    return path


def load_model(spark: SparkSession, path: str) -> IssueModel | PeriodBlend | RejectionModel:
    """Read a model that ``save_model`` wrote."""

    def build(part: dict):
        if "transformer" in part:
            return PipelineModel.load(f"{path}/{part['transformer']}").stages[0]
        if "model" in part:
            return SAVED[part["model"]](**{n: build(p) for n, p in part["fields"].items()})
        if "entries" in part:
            return {k: build(p) for k, p in part["entries"]}
        return part["value"]

    return build(json.loads(spark.read.text(f"{path}/parts").first()["value"]))
