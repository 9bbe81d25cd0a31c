"""Counting, window, top-k and set queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators import cleaning as C
from docketry.operators import office_actions as O
from docketry.operators import sampling as S
from docketry.operators import statistics as ST
from docketry.operators import trends as T
from docketry.operators.scaling import global_rank, neighbours
from docketry.plans.registry import query
from docketry.plans.text import PERIOD, SQL_ISSUES, _PARSED

r6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]

KC = f""", k AS (SELECT year(date_filed)::INT AS year, unnest({_PARSED}) AS keyword FROM keyword_rows),
  kc AS (SELECT year, keyword, count(*) AS count FROM k GROUP BY year, keyword)"""
STATS = KC + """, ks AS (SELECT keyword, sum(count)::BIGINT AS total_mentions, count(*) AS years_present, min(year) AS first_year,
  max(year) AS last_year, max(count) AS max_count, avg(count) AS mean_count, max(year) >= 2000 AS has_recent_data,
  coalesce(regr_slope(count, year), 0) AS trend FROM kc GROUP BY keyword)"""
REC = "mean_count, trend"


def counted(t):
    return T.keyword_counts(t.keyword_rows, "raw")


def stats(t):
    return T.keyword_stats(counted(t), recent_year=2000)


# --- keyword trends ---------------------------------------------------------


@query("agg1_cases_per_year", views=("cases",),
       sql="SELECT year(date_filed)::INT AS year, count(*) AS count FROM cases GROUP BY 1")
def agg1(t):
    return T.cases_per_year(t.cases)


@query("agg2_citations_per_year", views=("cases",),
       sql="SELECT year(date_filed)::INT AS year, sum(citation_count)::BIGINT AS citation_count FROM cases GROUP BY 1")
def agg2(t):
    return T.citations_per_year(t.cases)


@query("agg3_keyword_counts", views=("keyword_rows",), sql=KC + " SELECT * FROM kc")
def agg3(t):
    return counted(t)


@query("agg4_available_keywords", views=("keyword_rows",), sql=KC + " SELECT DISTINCT keyword FROM kc ORDER BY keyword")
def agg4(t):
    return T.available_keywords(counted(t))


@query("agg5_keyword_stats", views=("keyword_rows",),
       sql=STATS + " SELECT * REPLACE (round(mean_count, 6) AS mean_count, round(trend, 6) AS trend) FROM ks")
def agg5(t):
    return stats(t).withColumns({"mean_count": F.round("mean_count", 6), "trend": F.round("trend", 6)})


@query(
    "agg6_keyword_summary",
    views=("keyword_rows",),
    sql=STATS + """ SELECT count(*) AS total_keywords, count(*) FILTER (has_recent_data AND years_present >= 3) AS active_keywords,
      min(first_year) FILTER (has_recent_data AND years_present >= 3) || ' - ' ||
      max(last_year) FILTER (has_recent_data AND years_present >= 3) AS time_range FROM ks""",
)
def agg6(t):
    return T.keyword_summary(stats(t))


@query(
    "top1_top_keywords",
    views=("keyword_rows",),
    sql=STATS + """ SELECT keyword, total_mentions, years_present, round(trend, 6) AS trend FROM ks
      WHERE has_recent_data AND years_present >= 3 ORDER BY total_mentions DESC, keyword LIMIT 10""",
)
def top1(t):
    best = T.top_keywords(T.relevant_keywords(stats(t)), 10)
    return best.select("keyword", "total_mentions", "years_present", *r6("trend"))


# --- office actions ---------------------------------------------------------

REJ = r""", r AS (SELECT techCenter, unnest(list_sort(list_distinct(regexp_extract_all(lower(coalesce(passageLocationText, '')),
  '(?:section|§|\bc\.?\s*)(101|102|103|112)\b', 1)))) AS rejection FROM office_actions),
  rc AS (SELECT rejection, count(*) AS count FROM r GROUP BY 1),
  rct AS (SELECT techCenter, rejection, count(*) AS count FROM r GROUP BY 1, 2)"""
CLAIMS = """list_sort(list_distinct(list_concat(
  generate_series(split_part(relatedClaimNumberText, '-', 1)::INT, split_part(split_part(relatedClaimNumberText, '-', 2), ',', 1)::INT),
  [trim(split_part(relatedClaimNumberText, ',', 2))::INT])))"""
CLM = f""", cl AS (SELECT techCenter, unnest({CLAIMS})::INT AS claim FROM office_actions),
  clt AS (SELECT techCenter, claim, count(*) AS count FROM cl GROUP BY 1, 2)"""


@query(
    "agg7_rejections",
    views=("office_actions",),
    sql=REJ + """ SELECT rejection, count, (SELECT sum(count)::BIGINT FROM rc) AS total_rejections,
      rejection = (SELECT rejection FROM rc ORDER BY count DESC, rejection LIMIT 1) AS most_common FROM rc""",
)
def agg7(t):
    counts = O.rejection_counts(t.office_actions)  # one row per statute section
    summary = O.rejection_summary(t.office_actions)
    return counts.select(
        "rejection", "count", summary.select("total_rejections").scalar().alias("total_rejections"),
        (F.col("rejection") == summary.select("most_common").scalar()).alias("most_common"))


@query(
    "agg8_claims",
    views=("office_actions",),
    sql=CLM + f""", ct AS (SELECT claim, sum(count)::BIGINT AS count FROM clt GROUP BY 1),
      m AS (SELECT round(avg(len({CLAIMS})), 6) AS avg_claims FROM office_actions)
      SELECT claim, count, row_number() OVER (ORDER BY count DESC, claim) <= 5 AS in_top_5, avg_claims FROM ct, m""",
)
def agg8(t):
    top = O.most_rejected_claims(t.office_actions, 5).select("claim", F.lit(True).alias("in_top_5"))
    mean = O.mean_claims(t.office_actions).select(F.round("avg_claims_per_rejection", 6).alias("avg_claims")).scalar()
    counts = O.claim_counts(t.office_actions).join(F.broadcast(top), "claim", "left")
    return counts.select("claim", "count", F.coalesce("in_top_5", F.lit(False)).alias("in_top_5"), mean.alias("avg_claims"))


@query(
    "agg9_time_patterns",
    views=("office_actions",),
    sql="""SELECT 'year' AS kind, year(officeActionDate)::VARCHAR AS label, count(*) AS count FROM office_actions GROUP BY 2
      UNION ALL (SELECT 'month', strftime(officeActionDate, '%Y-%m') AS label, count(*) FROM office_actions GROUP BY 2
      ORDER BY label DESC LIMIT 12)""",
)
def agg9(t):
    years = O.yearly_counts(t.office_actions).select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("label"), "count")
    months = O.monthly_counts(t.office_actions).select(F.lit("month").alias("kind"), F.col("month").alias("label"), "count")
    return years.unionByName(months)


@query(
    "agg10_top_citations",
    views=("office_actions",),
    sql="""SELECT citedDocumentIdentifier, count(*) AS count, (SELECT count(citedDocumentIdentifier) FROM office_actions) AS total_citations
      FROM office_actions WHERE citedDocumentIdentifier IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def agg10(t):
    total = t.office_actions.agg(F.count("citedDocumentIdentifier").alias("n")).scalar()
    return O.top_citations(t.office_actions, 10).withColumn("total_citations", total)


REPORT = REJ + CLM + f""", base AS (SELECT techCenter, count(*) AS applications, count(citedDocumentIdentifier) AS citations,
    avg(len({CLAIMS})) AS mean_claims FROM office_actions GROUP BY 1),
  cited AS (SELECT techCenter, citedDocumentIdentifier AS d, count(*) AS n FROM office_actions WHERE citedDocumentIdentifier IS NOT NULL GROUP BY 1, 2),
  months AS (SELECT techCenter, strftime(officeActionDate, '%Y-%m') AS m, count(*) AS n FROM office_actions GROUP BY 1, 2),
  best AS (SELECT techCenter, rejection, count, row_number() OVER (PARTITION BY techCenter ORDER BY count DESC, rejection) AS rn FROM rct),
  claims_ranked AS (SELECT *, row_number() OVER (PARTITION BY techCenter ORDER BY count DESC, claim) AS rn FROM clt),
  report AS (
  SELECT techCenter, 'rejection_count' AS section, rejection AS key, count::DOUBLE AS value FROM rct
  UNION ALL SELECT techCenter, 'most_common_rejection', rejection, count FROM best WHERE rn = 1
  UNION ALL SELECT techCenter, 'total_rejections', 'all', sum(count) FROM rct GROUP BY 1
  UNION ALL SELECT techCenter, 'most_rejected_claim', claim::VARCHAR, count FROM claims_ranked WHERE rn <= 5
  UNION ALL SELECT techCenter, 'claim_count', claim::VARCHAR, count FROM clt
  UNION ALL SELECT techCenter, 'avg_claims_per_rejection', 'all', mean_claims FROM base
  UNION ALL SELECT techCenter, 'year', year(officeActionDate)::VARCHAR, count(*) FROM office_actions GROUP BY 1, 3
  UNION ALL SELECT techCenter, 'month', m, n FROM (SELECT *, row_number() OVER (PARTITION BY techCenter ORDER BY m DESC) AS rn FROM months) WHERE rn <= 12
  UNION ALL SELECT techCenter, 'top_citation', d, n FROM (SELECT *, row_number() OVER (PARTITION BY techCenter ORDER BY n DESC, d) AS rn FROM cited) WHERE rn <= 10
  UNION ALL SELECT techCenter, 'total_applications', 'all', applications FROM base
  UNION ALL SELECT techCenter, 'total_citations', 'all', citations FROM base)"""


@query("agg11_center_report", views=("office_actions",),
       sql=REPORT + " SELECT techCenter, section, key, round(value, 6) AS value FROM report")
def agg11(t):
    return O.center_report(t.office_actions).withColumn("value", F.round("value", 6))


@query(
    "agg12_center_summary",
    views=("office_actions",),
    sql=REPORT + """, lm AS (SELECT techCenter, arg_max(value, key) AS newest, arg_min(value, key) AS oldest, count(*) AS n
        FROM report WHERE section = 'month' GROUP BY 1),
      c1 AS (SELECT techCenter, key AS claim, value AS n FROM (SELECT *, row_number() OVER (PARTITION BY techCenter ORDER BY value DESC, key::INT) AS rn
        FROM report WHERE section = 'most_rejected_claim') WHERE rn = 1),
      tr AS (SELECT techCenter, sum(count)::BIGINT AS n FROM rct GROUP BY 1)
      SELECT base.techCenter, 'Technology Center ' || base.techCenter || '; total rejections: ' || tr.n || '; most common: Section '
        || best.rejection || ' (' || best.count || ' instances); average claims per rejection: ' || printf('%.2f', mean_claims)
        || '; most frequently rejected claim: ' || c1.claim || ' (' || c1.n::BIGINT || ' times); total applications: ' || applications
        || '; recent trend: ' || CASE WHEN lm.n >= 2 AND newest > oldest THEN 'Increasing' ELSE 'Decreasing' END AS summary,
        lm.n >= 2 AND newest > oldest AS increasing
      FROM base JOIN tr USING (techCenter) JOIN best ON best.techCenter = base.techCenter AND best.rn = 1
        JOIN c1 ON c1.techCenter = base.techCenter JOIN lm ON lm.techCenter = base.techCenter""",
)
def agg12(t):
    return O.center_summary(t.office_actions)


@query(
    "agg13_success_rate",
    views=("office_actions",),
    sql=REJ + """, n AS (SELECT techCenter, count(*) AS total_applications FROM office_actions GROUP BY 1),
      x AS (SELECT techCenter, sum(count)::BIGINT AS total_rejections FROM rct GROUP BY 1)
      SELECT techCenter, total_rejections, total_applications,
        floor((1.0::DOUBLE - total_rejections::DOUBLE / total_applications) * 100.0::DOUBLE + 0.5)::BIGINT AS success_rate FROM n JOIN x USING (techCenter)""",
)
def agg13(t):
    return O.success_rate(t.office_actions, ["techCenter"])


@query(
    "agg14_yearly_direction",
    views=("office_actions",),
    sql=""", y AS (SELECT techCenter, year(officeActionDate)::INT AS year, count(*) AS count FROM office_actions GROUP BY 1, 2),
      l AS (SELECT *, lag(count) OVER (PARTITION BY techCenter ORDER BY year) AS prev FROM y)
      SELECT techCenter, year, count, CASE WHEN prev IS NULL THEN NULL WHEN count > prev THEN 'increased' ELSE 'decreased' END AS direction FROM l""",
)
def agg14(t):
    return T.yearly_direction(O.yearly_counts(t.office_actions, ["techCenter"]), by=["techCenter"])


# --- periods, profiles, measures --------------------------------------------

ISSUES = f""", p AS (SELECT id, full_text, citation_count, {PERIOD} AS period FROM cases),
  i AS (SELECT id, period, list_filter(string_split({SQL_ISSUES}, ','), lambda x: x <> '') AS issues FROM p)"""


def tagged_cases(t):
    return t.cases.select("id", "full_text", X.time_period("date_filed").alias("period")).select(
        "id", "period", X.legal_issues("full_text", "period").alias("issues")
    )


@query(
    "agg15_issue_distribution",
    views=("cases",),
    sql=ISSUES + """, n AS (SELECT period, count(*) AS cases FROM i GROUP BY 1),
      u AS (SELECT period, unnest(issues) AS issue FROM i), c AS (SELECT period, issue, count(*) AS count FROM u GROUP BY 1, 2)
      SELECT period, issue, count, cases, round(count::DOUBLE / cases * 100, 6) AS percentage FROM c JOIN n USING (period)""",
)
def agg15(t):
    return ST.issue_distribution(tagged_cases(t)).withColumn("percentage", F.round("percentage", 6))


PROFILED = ("publicationNumber", "citedDocumentIdentifier", "passageLocationText", "inventorNameText", "nplIndicator")


@query(
    "agg18_column_profile",
    views=("office_actions",),
    sql=" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, round(count({c}) * 100.0::DOUBLE / count(*), 6) AS coverage FROM office_actions"""
        for c in PROFILED
    ).replace("SELECT", " SELECT", 1),
)
def agg18(t):
    return ST.column_profile(t.office_actions, PROFILED).withColumn("coverage", F.round("coverage", 6))


_HASH = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"
_STAT_COLUMNS = ("id", "court_id", "precedential_status", "suit_nature")


@query(
    "agg19_dataset_statistics",
    views=("cases",),
    sql=f""", h AS (SELECT *, {_HASH.format('id')} AS h FROM cases)
      SELECT 'total' AS kind, 'rows' AS name, NULL::VARCHAR AS value, count(*) AS count FROM h
      UNION ALL SELECT 'split', 'train', NULL, count(*) FILTER (h >= 0.2) FROM h
      UNION ALL SELECT 'split', 'test', NULL, count(*) FILTER (h < 0.2) FROM h
      """ + " ".join(f"UNION ALL SELECT 'missing', '{c}', NULL, count(*) - count({c}) FROM h" for c in _STAT_COLUMNS)
    + " " + " ".join(f"UNION ALL SELECT 'value', '{c}', {c}, count(*) FROM h GROUP BY {c}" for c in _STAT_COLUMNS[1:]),
)
def agg19(t):
    return ST.dataset_statistics(t.cases.select(*_STAT_COLUMNS), "id", _STAT_COLUMNS[1:])


@query(
    "agg20_describe",
    sql=" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
          quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS q50, quantile_cont({c}, 0.75)::DOUBLE AS q75,
          max({c})::DOUBLE AS max FROM lineitem""" for c in ("l_quantity", "l_extendedprice")
    ),
)
def agg20(t):
    out = ST.describe(t.lineitem.select("l_quantity", "l_extendedprice"), ("l_quantity", "l_extendedprice"))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "agg21_value_counts",
    views=("cases",),
    sql="""SELECT 'court' AS kind, court AS value, count(*) AS count FROM cases GROUP BY 2
      UNION ALL SELECT 'year', year(date_filed)::VARCHAR, count(*) FROM cases GROUP BY 2""",
)
def agg21(t):
    courts = ST.value_counts(t.cases, "court", "value").select(F.lit("court").alias("kind"), "value", "count")
    years = ST.value_counts(t.cases, X.filed_year("date_filed").cast("string"), "value")
    return courts.unionByName(years.select(F.lit("year").alias("kind"), "value", "count"))


@query(
    "agg23_vector_statistics",
    sql="""SELECT vec_id, round(list_min(v), 6) AS min, round(list_max(v), 6) AS max, round(list_avg(v), 6) AS mean,
      round(list_stddev_pop(v), 6) AS std FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
)
def agg23(t):
    return ST.vector_statistics(t.embeddings, "embedding").select("vec_id", *r6("min", "max", "mean", "std"))


def multilabel(t):
    """True and predicted label sets of the labelled documents."""
    d = t.documents.join(t.labels, "doc_id")
    truth = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    guess = F.array_compact(F.array(F.when(F.col("n_chars") > 500, "quality"), F.when(F.contains("text", F.lit("worthless")), "toxic"),
                                    F.when(F.col("n_chars") < 50, "short")))
    return d.select("doc_id", truth.alias("truth"), guess.alias("predicted"), F.col("lang").alias("period"))


@query(
    "agg24_multilabel_report",
    sql="""WITH d AS (SELECT doc_id, lang, quality = 1 AS tq, n_chars > 500 AS pq, toxic = 1 AS tt, contains(text, 'worthless') AS pt, n_chars < 50 AS ps
        FROM documents JOIN labels USING (doc_id)),
      m AS (SELECT lang AS period, 'quality' AS label, tq AS t, pq AS p FROM d WHERE tq OR pq
        UNION ALL SELECT lang, 'toxic', tt, pt FROM d WHERE tt OR pt UNION ALL SELECT lang, 'short', false, ps FROM d WHERE ps),
      a AS (SELECT period, label, t, p FROM m UNION ALL SELECT 'all', label, t, p FROM m),
      c AS (SELECT period, label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM a GROUP BY 1, 2),
      r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM c)
      SELECT label, period, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, tp + fn AS support FROM r""",
)
def agg24(t):
    out = ST.multilabel_report(multilabel(t), "truth", "predicted", "period")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def scored(t):
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 97).cast("double").alias("score"),
        (F.col("n_chars") > 500).cast("int").alias("predicted"))


@query(
    "agg25_ranking_measures",
    sql="""WITH d AS (SELECT quality AS label, (n_chars % 97)::DOUBLE AS score, (n_chars > 500)::INT AS predicted FROM documents JOIN labels USING (doc_id)),
      s AS (SELECT score, sum(label) AS pos, count(*) AS n FROM d GROUP BY 1),
      c AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM s),
      t AS (SELECT sum(label)::DOUBLE AS total FROM d),
      curve AS (SELECT score, tp::DOUBLE / k AS precision, tp::DOUBLE / total AS recall, pos::DOUBLE / total AS gain FROM c, t)
      SELECT 'curve' AS kind, score AS key, round(precision, 6) AS precision, round(recall, 6) AS recall, NULL::DOUBLE AS value FROM curve
      UNION ALL SELECT 'average_precision', NULL, NULL, NULL, round(sum(gain * precision), 6) FROM curve
      UNION ALL SELECT 'accuracy', NULL, NULL, NULL, round(avg((label = predicted)::INT::DOUBLE), 6) FROM d
      UNION ALL SELECT 'confusion', label * 10 + predicted, NULL, NULL, count(*)::DOUBLE FROM d GROUP BY label, predicted""",
)
def agg25(t):
    rows = scored(t)
    curve = ST.precision_recall_curve(rows, "label", "score")
    none = F.lit(None).cast("double")
    parts = [
        curve.select(F.lit("curve").alias("kind"), F.col("threshold").alias("key"), *r6("precision", "recall"), none.alias("value")),
        ST.average_precision(curve).select(F.lit("average_precision").alias("kind"), none.alias("key"), none.alias("precision"),
                                           none.alias("recall"), F.round("average_precision", 6).alias("value")),
        ST.accuracy(rows, "label", "predicted").select(F.lit("accuracy").alias("kind"), none.alias("key"), none.alias("precision"),
                                                       none.alias("recall"), F.round("accuracy", 6).alias("value")),
        ST.confusion_matrix(rows, "label", "predicted").select(
            F.lit("confusion").alias("kind"), (F.col("label") * 10 + F.col("predicted")).cast("double").alias("key"),
            none.alias("precision"), none.alias("recall"), F.col("count").cast("double").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "agg26_case_weights",
    views=("cases",),
    sql=ISSUES + """, n AS (SELECT period, count(*) AS n FROM i GROUP BY 1)
      SELECT id, period, round((SELECT max(n) FROM n)::DOUBLE / n * CASE WHEN len(issues) > 0 THEN 1.0 ELSE 0.8 END, 6) AS weight
      FROM i JOIN n USING (period)""",
)
def agg26(t):
    return ST.case_weights(tagged_cases(t)).select("id", "period", *r6("weight"))


# --- windows ----------------------------------------------------------------

@query(
    "win1_next_row",
    sql="""WITH s AS (SELECT doc_id, lead(lang) OVER (ORDER BY doc_id) AS next_lang, lead(n_chars) OVER (ORDER BY doc_id) AS next_chars FROM documents)
      SELECT * FROM s""",
)
def win1(t):
    rows = neighbours(t.documents.select("doc_id", "lang", "n_chars").withColumn("_f", F.lit(0)), "_f", "doc_id")
    w = Window.partitionBy("_f", "_block").orderBy("doc_id")
    looked = rows.withColumns({"next_lang": F.lead("lang").over(w), "next_chars": F.lead("n_chars").over(w)})
    return looked.where(F.col("_own")).select("doc_id", "next_lang", "next_chars")


@query(
    "win2_rolling_std",
    views=("keyword_series",),
    sql=""", w AS (SELECT keyword, stddev_samp(count) OVER (PARTITION BY keyword ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM keyword_series)
      SELECT keyword, round(avg(s), 6) AS rolling_std FROM w GROUP BY 1""",
)
def win2(t):
    return T.rolling_std(t.keyword_series).groupBy("keyword").agg(F.round(F.avg("rolling_std"), 6).alias("rolling_std"))


@query(
    "win3_recent_trend",
    views=("keyword_series",),
    sql=""", w AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY year DESC) AS rn FROM keyword_series)
      SELECT keyword, round(coalesce(regr_slope(count, year), 0), 6) AS recent_trend, round(avg(count), 6) AS recent_mean,
        arg_max(count, year)::DOUBLE AS last_value FROM w WHERE rn <= 5 GROUP BY 1""",
)
def win3(t):
    return T.recent_trend(t.keyword_series).select("keyword", *r6("recent_trend", "recent_mean"), "last_value")


@query(
    "win4_longest_run",
    views=("gappy_series",),
    sql=""", r AS (SELECT keyword, year - row_number() OVER (PARTITION BY keyword ORDER BY year) AS g FROM gappy_series WHERE count > 0),
      c AS (SELECT keyword, g, count(*) AS n FROM r GROUP BY 1, 2) SELECT keyword, max(n) AS longest_run FROM c GROUP BY 1""",
)
def win4(t):
    return T.longest_run(t.gappy_series)


ZERO = """, sp AS (SELECT keyword, unnest(generate_series(min(year), max(year)))::INT AS year FROM gappy_series GROUP BY keyword),
  z AS (SELECT sp.keyword, sp.year, coalesce(g.count, 0)::BIGINT AS count FROM sp LEFT JOIN gappy_series g ON g.keyword = sp.keyword AND g.year = sp.year)"""


@query("win5_zero_filled", views=("gappy_series",), sql=ZERO + " SELECT keyword, year, count FROM z")
def win5(t):
    return T.zero_filled(t.gappy_series)


@query(
    "win6_neighbourhood",
    sql=r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n+'), lambda x: x <> '') AS s FROM documents),
      u AS (SELECT doc_id, unnest(generate_series(1, len(s))) AS i, s FROM l)
      SELECT doc_id, (i - 1)::INT AS position, array_to_string(list_slice(s, greatest(i - 1, 1), i + 1), ' ') AS context FROM u""",
)
def win6(t):
    lines = t.documents.select("doc_id", X.words_kept(F.split("text", r"\n+")).alias("s"))
    around = F.transform("s", lambda x, i: X.neighbourhood(F.col("s"), i))
    return lines.select("doc_id", F.posexplode(around).alias("position", "context"))


@query(
    "win7_persistence_error",
    views=("keyword_series",),
    sql=""", e AS (SELECT keyword, (count - lag(count) OVER (PARTITION BY keyword ORDER BY year))::DOUBLE AS e FROM keyword_series)
      SELECT keyword, round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY 1""",
)
def win7(t):
    return T.persistence_error(t.keyword_series).select("keyword", *r6("mse", "mae", "rmse"))


@query(
    "win8_rank",
    sql="""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""",
)
def win8(t):
    return global_rank(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "rank").select(
        "o_orderkey", "rank")


# --- top-k, splits, sets ----------------------------------------------------


@query(
    "top2_most_cited",
    views=("office_actions",),
    sql=""", e AS (SELECT DISTINCT publicationNumber AS src, citedDocumentIdentifier AS dst FROM office_actions WHERE citedDocumentIdentifier IS NOT NULL)
      SELECT dst AS id, count(*) AS in_degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top2(t):
    edges = O.citation_edges(t.office_actions)
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).orderBy(
        F.desc("in_degree"), F.asc("id")).limit(10)


@query("top3_sorted_cases", views=("cases",),
       sql="SELECT id, round(tech_relevance_score, 6) AS score, citation_count FROM cases ORDER BY 2 DESC, 3 DESC, 1")
def top3(t):
    return t.cases.select("id", F.round("tech_relevance_score", 6).alias("score"), "citation_count").orderBy(
        F.desc("score"), F.desc("citation_count"), F.asc("id"))


@query(
    "top4_record_cap",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 5000""",
)
def top4(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return t.lineitem.select(*cols).orderBy(*cols).limit(5000)


@query(
    "top5_splits",
    sql=f"""WITH h AS (SELECT o_orderkey, o_orderstatus, {_HASH.format('o_orderkey')} AS h FROM orders),
      r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM h)
      SELECT o_orderkey, h < 0.2 AS is_test, rn - 1 < round(n * 0.2) AS is_stratified_test FROM r""",
)
def top5(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    both = ST.stratified_split(ST.hash_split(rows, "o_orderkey"), "o_orderkey", "o_orderstatus", name="is_stratified_test")
    return both.select("o_orderkey", "is_test", "is_stratified_test")


@query("top6_augmented_cases")
def top6(t):
    cases = t.cases.select("id", "full_text", "citation_count", F.concat(F.lit("y"), X.filed_year("date_filed"), F.lit("-"),
                           F.col("court_id")).alias("period"))
    return S.augmented_cases(cases, "id", "full_text", "period", ["citation_count"])


@query(
    "set1_yearly_batches",
    views=("cases",),
    sql="""SELECT DISTINCT id, year(date_filed)::INT AS batch_year, CASE court_id WHEN 'cafc' THEN 0 ELSE 1 END AS court_group FROM cases
      WHERE court_id IN ('cafc', 'cand', 'nysd', 'txed') AND year(date_filed) BETWEEN 1996 AND 1999""",
)
def set1(t):
    rows = t.cases.select("id", "date_filed", "court_id")
    return S.yearly_court_batches(S.append_batches([rows, rows.drop("date_filed")]), 1996, 1999).select(
        "id", "batch_year", "court_group")


@query(
    "set2_union_distinct",
    views=("office_actions",),
    sql="""SELECT publicationNumber, citedDocumentIdentifier, techCenter FROM office_actions WHERE techCenter IN (2100, 2400)
      UNION SELECT publicationNumber, citedDocumentIdentifier, techCenter FROM office_actions WHERE techCenter = 2400 AND citationCategoryCode = 'X'""",
)
def set2(t):
    cols = ["publicationNumber", "citedDocumentIdentifier", "techCenter"]
    a = t.office_actions.where(F.col("techCenter").isin(2100, 2400)).select(*cols)
    b = t.office_actions.where(C.patent_predicate(None, 2400, "X")).select(*cols)
    return S.union_distinct(a, b)


@query(
    "set3_array_sets",
    sql=r"""WITH w AS (SELECT d.doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda w: w <> '')) AS a,
        ['the', 'of', d.lang, d.source] AS b FROM documents d)
      SELECT doc_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS joined, len(a) AS words FROM w""",
)
def set3(t):
    a = X.word_set(F.col("text"))
    rows = t.documents.select("doc_id", a.alias("a"), F.array(F.lit("the"), F.lit("of"), "lang", "source").alias("b"))
    return rows.select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"),
                       F.size(F.array_union("a", "b")).cast("long").alias("joined"), F.size("a").cast("long").alias("words"))


# --- forecasts --------------------------------------------------------------

FC = """, lt AS (SELECT keyword, coalesce(regr_slope(count, year), 0) AS long_trend, max(year) AS last_year FROM keyword_series GROUP BY 1),
  rw AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY year DESC) AS rn FROM keyword_series),
  rt AS (SELECT keyword, coalesce(regr_slope(count, year), 0) AS recent_trend, avg(count) AS recent_mean, arg_max(count, year)::DOUBLE AS last_value
    FROM rw WHERE rn <= 5 GROUP BY 1),
  sd AS (SELECT keyword, avg(s) AS spread FROM (SELECT keyword, stddev_samp(count) OVER (PARTITION BY keyword ORDER BY year
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM keyword_series) GROUP BY 1),
  tm AS (SELECT *, 0.7::DOUBLE * recent_trend + 0.3::DOUBLE * long_trend AS weighted_trend, (recent_mean + last_value) / 2 AS base
    FROM lt JOIN rt USING (keyword) JOIN sd USING (keyword)),
  st AS (SELECT *, unnest(generate_series(0, 4)) AS i FROM tm),
  fv AS (SELECT keyword, (last_year + i + 1)::INT AS year, greatest(base * 0.5::DOUBLE, base + weighted_trend * i / (1 + 0.2::DOUBLE * i)) AS value,
    spread * (1 + 0.1::DOUBLE * i) AS w FROM st),
  fc AS (SELECT keyword, year, value, greatest(0, value - w) AS lower, value + w AS upper FROM fv)"""
_LABEL = """CASE WHEN abs(weighted_trend) < 0.5 THEN 'stable' WHEN weighted_trend > 0 THEN
  CASE WHEN recent_trend > 0 THEN 'increasing' ELSE 'mixed but generally increasing' END
  ELSE CASE WHEN recent_trend < 0 THEN 'decreasing' ELSE 'mixed but generally decreasing' END END"""
BAND = ("value", "lower", "upper")


@query("fct1_damped_forecast", views=("keyword_series",),
       sql=FC + " SELECT keyword, year, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper FROM fc")
def fct1(t):
    return T.damped_forecast(t.keyword_series).select("keyword", "year", *r6(*BAND))


@query("fct2_trend_label", views=("keyword_series",),
       sql=FC + f" SELECT keyword, round(weighted_trend, 6) AS weighted_trend, {_LABEL} AS trend FROM tm")
def fct2(t):
    return T.trend_metrics(t.keyword_series).select(
        "keyword", *r6("weighted_trend"), F.col("trend_interpretation").alias("trend"))


@query(
    "fct3_floor_projection",
    views=("keyword_series",),
    sql=""", e AS (SELECT keyword, arg_min(count, year) AS first, arg_max(count, year) AS last, min(count) AS floor, count(*) AS n, max(year) AS y
        FROM keyword_series GROUP BY 1),
      s AS (SELECT *, unnest(generate_series(1, 5)) AS i, CASE WHEN n > 1 THEN (last - first)::DOUBLE / (n - 1) ELSE 0 END AS slope FROM e),
      v AS (SELECT keyword, (y + i)::INT AS year, floor, greatest(greatest(floor, last)::DOUBLE, greatest(floor, last) + slope * i) AS value FROM s)
      SELECT keyword, year, round(value, 6) AS value, round(greatest(floor::DOUBLE, value * 0.8::DOUBLE), 6) AS lower, round(value * 1.2::DOUBLE, 6) AS upper FROM v""",
)
def fct3(t):
    return T.floor_projection(t.keyword_series).select("keyword", "year", *r6(*BAND))


@query("fct4_smoothing_forecast")
def fct4(t):
    return T.smoothing_forecast(t.keyword_series)


@query("fct5_smoothing_validation")
def fct5(t):
    return T.smoothing_validation(t.keyword_series)


@query("fct6_regime_forecast")
def fct6(t):
    return T.regime_forecast(t.keyword_series)


@query(
    "fct6_sparse_regimes",
    views=("keyword_series",),
    sql=""", gs AS (SELECT keyword, year, CASE WHEN keyword LIKE 'small %' THEN 0 ELSE count END AS count FROM keyword_series),
      sp AS (SELECT keyword, unnest(generate_series(min(year), max(year)))::INT AS year FROM gs GROUP BY keyword),
      z AS (SELECT sp.keyword, sp.year, coalesce(g.count, 0)::BIGINT AS count FROM sp LEFT JOIN gs g ON g.keyword = sp.keyword AND g.year = sp.year),
      f AS (SELECT keyword, sum(count) AS total, count(*) AS n, max(year) AS y, avg(count) AS m, avg(year) AS mid, coalesce(regr_slope(count, year), 0) AS b FROM z GROUP BY 1),
      s AS (SELECT *, unnest(generate_series(1, 5)) AS i FROM f WHERE total = 0 OR n < 8)
      SELECT keyword, (y + i)::INT AS year, CASE WHEN total = 0 THEN 'ramp' ELSE 'line' END AS regime,
        round(CASE WHEN total = 0 THEN i * 0.5::DOUBLE ELSE greatest(1.0::DOUBLE, m + b * (y + i - mid)) END, 6) AS value FROM s""",
)
def fct6s(t):
    none = F.when(F.col("keyword").startswith("small "), F.lit(0).cast("long")).otherwise(F.col("count"))
    return T.sparse_forecast(t.keyword_series.withColumn("count", none), enough=8).withColumn("value", F.round("value", 6))


@query(
    "fct7_trend_bundle",
    views=("keyword_series",),
    sql=FC + """ SELECT keyword, year, 'history' AS kind, count::DOUBLE AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM keyword_series
        WHERE keyword IN ('red bolt', 'blue gear', 'small ring')
      UNION ALL SELECT keyword, year, 'forecast', round(value, 6), round(lower, 6), round(upper, 6) FROM fc WHERE keyword IN ('red bolt', 'blue gear', 'small ring')""",
)
def fct7(t):
    return T.trend_bundle(t.keyword_series, ["red bolt", "blue gear", "small ring"]).select(
        "keyword", "year", "kind", *r6(*BAND))


@query(
    "jn7_history_with_forecast",
    views=("keyword_series",),
    sql=FC + """ SELECT coalesce(s.keyword, f.keyword) AS keyword, coalesce(s.year, f.year) AS year, s.count::DOUBLE AS history,
      round(f.value, 6) AS forecast, round(f.lower, 6) AS lower, round(f.upper, 6) AS upper
      FROM keyword_series s FULL JOIN fc f ON s.keyword = f.keyword AND s.year = f.year""",
)
def jn7(t):
    out = T.aligned_history_forecast(t.keyword_series, T.damped_forecast(t.keyword_series))
    return out.select("keyword", "year", "history", *r6("forecast", "lower", "upper"))
