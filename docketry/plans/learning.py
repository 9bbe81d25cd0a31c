"""Model queries. Fits use the operators' defaults."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from docketry.functions import patent as P
from docketry.operators import graph as G
from docketry.operators import learn as L
from docketry.operators import office_actions as O
from docketry.plans.aggregates import r6
from docketry.plans.registry import query
from docketry.plans.retrieval import PATENT_EDGES, sql_pagerank
from docketry.plans.text import _PARTS, SQL_FLAG, sql_parts, structured_questions
from docketry.session import cut_lineage, scratch_path


def cites(t):
    """Two dated citations per case."""
    year = F.year("date_filed") - F.col("row_no") % 30
    one = lambda name, date: F.struct(F.lit(name).alias("cite"), date.alias("date"))
    return F.array(one("a", F.concat(year.cast("string"), F.lit("-03-04"))), one("b", F.lit("1990-12-31")))


def issue_rows(t):
    return L.case_features(t.cases, "row_no", "full_text", "date_filed", cites(t))


@query("ml1_feature_vectors")
def ml1(t):
    rows = issue_rows(t)
    model = L.fit_feature_pipeline(rows)
    dense = vector_to_array("features")
    return model.transform(rows).select("id", "time_period", F.size(dense).alias("width"),
                                        F.size(F.filter(dense, lambda v: v != 0)).alias("filled"))


def flat_scores(predicted):
    return predicted.select("id", "time_period", F.array_join("predicted", ",").alias("predicted"),
                            F.explode("scores").alias("issue", "score")).withColumn("score", F.round("score", 6))


@query("ml2_issue_forests")
def ml2(t):
    return flat_scores(L.fit_issue_models(issue_rows(t)).predict(issue_rows(t)))


@query("ml3_thresholded_labels")
def ml3(t):
    out = L.fit_issue_models(issue_rows(t)).predict(issue_rows(t))
    return out.select("id", "time_period", F.explode("predicted").alias("issue"))


@query("ml4_period_blend")
def ml4(t):
    return flat_scores(L.fit_period_blend(issue_rows(t)).predict(issue_rows(t)))


@query("ml5_relevance_model")
def ml5(t):
    rows = L.relevance_rows(t.cases, "row_no", 0.5)
    pipeline, model, _ = L.fit_relevance_model(rows)
    return model.transform(pipeline.transform(rows)).select("id", "label", "prediction", F.round(L.probability(), 6).alias("p"))


@query("ml5_relevance_folds")
def ml5_folds(t):
    return L.fit_relevance_model(L.relevance_rows(t.cases, "row_no", 0.5))[2]


@query("ml6_grid_search")
def ml6(t):
    rows = L.relevance_rows(t.cases, "row_no", 0.5)
    ready = L.fit_relevance_features(rows).transform(rows).select("id", "features", "label")
    return L.tuned_forest(ready, "id")[1]


@query("ml7_feature_importance")
def ml7(t):
    rows = L.relevance_rows(t.cases, "row_no", 0.5)
    pipeline, model, _ = L.fit_relevance_model(rows)
    names = [*L.vocabulary(pipeline), *L.RELEVANCE_NUMBERS]
    return L.feature_importance(rows, model, names)


def outcome_rows(t):
    return t.cases.where(F.col("tech_relevance_score").isNotNull()).select(
        F.col("row_no").alias("id"), F.col("full_text").alias("text"), "court", "judge",
        (F.col("row_no") % 5).cast("double").alias("citing_count"), F.col("citation_count").cast("double").alias("cited_count"),
        (F.col("tech_relevance_score") >= 0.5).cast("double").alias("label"))


@query("ml8_outcome_model")
def ml8(t):
    rows = outcome_rows(t)
    return L.fit_outcome_model(rows).transform(rows).select(
        "id", "label", "prediction", F.round(L.probability(), 6).alias("p"))


@query("ml9_status_model")
def ml9(t):
    rows = t.cases.where(F.col("precedential_status").isNotNull()).select(
        F.col("row_no").alias("id"), F.col("full_text").alias("text"), F.col("precedential_status").alias("status"))
    return L.fit_status_model(rows).transform(rows).select("id", "status", "label", "prediction")


NODE_METRICS = ("in_degree", "out_degree", "pagerank")


@query(
    "ml10_patent_features",
    views=("office_actions",),
    sql=PATENT_EDGES + sql_pagerank("e", "nodes") + f""", p AS (SELECT *, {_PARTS} AS parts FROM office_actions)
      SELECT publicationNumber, {SQL_FLAG.format('examinerCitedReferenceIndicator')} AS is_examiner_cited,
        {SQL_FLAG.format('applicantCitedExaminerReferenceIndicator')} AS is_applicant_cited, {SQL_FLAG.format('nplIndicator')} AS is_npl,
        techCenter::BIGINT AS tech_center, coalesce(len(parts), 0) AS num_passages, {sql_parts('claim')} AS num_claims_cited,
        {sql_parts('paragraph', 'par.')} > 0 AS has_spec_support, coalesce(in_degree, 0)::BIGINT AS in_degree,
        coalesce(out_degree, 0)::BIGINT AS out_degree, round(coalesce(score, 0) * 10000, 4) AS pagerank
      FROM p LEFT JOIN deg ON deg.id = publicationNumber LEFT JOIN pr ON pr.id = publicationNumber""",
)
def ml10(t):
    edges = cut_lineage(O.citation_edges(t.office_actions))  # used twice
    metrics = G.degrees(edges).join(G.pagerank(edges, tolerance=1e-9).withColumnRenamed("score", "pagerank"), "id")
    out = L.patent_features(t.office_actions, metrics)
    return out.select(
        "publicationNumber", "is_examiner_cited", "is_applicant_cited", "is_npl", "tech_center", "num_passages", "num_claims_cited",
        "has_spec_support", F.col("citation_network_in_degree").alias("in_degree"),
        F.col("citation_network_out_degree").alias("out_degree"),
        F.round(F.col("citation_network_pagerank") * 10000, 4).alias("pagerank"))


@query("ml10_network_features")
def ml10_network(t):
    """The network columns of the feature matrix, betweenness among them."""
    out = L.patent_features(t.office_actions, G.node_metrics(O.citation_edges(t.office_actions), tolerance=1e-9))
    columns = [F.col(f"citation_network_{c}").alias(c) for c in ("in_degree", "out_degree")]
    scaled = [F.round(F.col(f"citation_network_{c}") * 10000, 4).alias(c) for c in ("pagerank", "betweenness")]
    return out.select("publicationNumber", *columns, *scaled)


def rejection_rows(t):
    """Office actions with a row number, features, network scores of the publication, and the label."""
    rows = L.patent_features(t.office_actions, G.node_metrics(O.citation_edges(t.office_actions)))
    key = F.xxhash64("publicationNumber", "citedDocumentIdentifier", "officeActionDate", "relatedClaimNumberText", "groupArtUnitNumber",
                     "passageLocationText")
    return rows.withColumns({"id": key, "label": P.has_rejection("passageLocationText")})


REJECTION_COLUMNS = ("is_examiner_cited", "is_applicant_cited", "is_npl", "tech_center", "num_claims_cited",
                     "citation_network_in_degree", "citation_network_out_degree", "citation_network_pagerank", "citation_network_betweenness")


def rejection_model(t, boosted=False):
    return L.fit_rejection_model(rejection_rows(t), "id", "label", REJECTION_COLUMNS, boosted=boosted)


@query("ml11_rejection_model")
def ml11(t):
    return rejection_model(t)[1]


@query("ml11_boosted_rejection_model")
def ml11_boosted(t):
    return rejection_model(t, boosted=True)[1]


def balanced_rows(t):
    rows = rejection_rows(t)
    vector = F.array(*[F.col(c).cast("double") for c in REJECTION_COLUMNS])
    return L.synthetic_minority(rows.select("id", vector.alias("vector"), F.col("label").cast("double").alias("label")))


@query("ml12_synthetic_minority")
def ml12(t):
    return balanced_rows(t).where("synthetic").select("id", "label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(
    "ml12_class_counts",
    views=("office_actions",),
    sql=""", y AS (SELECT CASE WHEN regexp_matches(coalesce(passageLocationText, ''), 'c[.] ?10[23]') THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM office_actions),
      n AS (SELECT label, count(*) AS rows FROM y GROUP BY 1)
      SELECT label, false AS synthetic, rows FROM n
      UNION ALL SELECT label, true, (SELECT max(rows) FROM n) - rows FROM n WHERE rows < (SELECT max(rows) FROM n)""",
)
def ml12_counts(t):
    return balanced_rows(t).groupBy("label", "synthetic").agg(F.count("*").alias("rows"))


@query("ml13_calibration")
def ml13(t):
    model, _ = rejection_model(t)
    return L.calibrated(model.held, model.calibration).select("id", "label", *r6("score", "calibrated"))


@query("ml14_scored_questions")
def ml14(t):
    fitted, _ = rejection_model(t)
    model = L.load_model(t.spark, L.save_model(t.spark, fitted, scratch_path(t.spark, "rejection-model")))
    out = L.scored_questions(structured_questions(t), model)
    return out.select("conv_id", "turn", "query_type", *r6("rejection_probability"), "confidence_level", "summary",
                      F.array_join("recommendations", "|").alias("recommendations"))


@query("ml15_classify_report")
def ml15(t):
    model = L.fit_issue_models(issue_rows(t))
    out = L.classify_report(t.cases, "row_no", "full_text", "date_filed", cites(t), model)
    return out.select("id", "time_period", F.array_join("predicted", ",").alias("predicted"),
                      F.array_join("patterns", ",").alias("patterns"), "features.*", "text_length")


@query("snk3_saved_model")
def snk3(t):
    rows = t.cases.where(F.col("precedential_status").isNotNull()).select(
        F.col("row_no").alias("id"), F.col("full_text").alias("text"), F.col("precedential_status").alias("status"))
    path = scratch_path(t.spark, "model")
    L.fit_status_model(rows).write().overwrite().save(path)
    return PipelineModel.load(path).transform(rows).select("id", "status", "prediction")
