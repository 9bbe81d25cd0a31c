"""Sources, sinks, cleaning and projection queries."""

from pyspark.sql import functions as F

from docketry import lexicons, schemas
from docketry.functions import patent as P
from docketry.functions import text as X
from docketry.operators import cleaning as C
from docketry.plans.registry import query
from docketry.session import scratch_path
from docketry.sources import files

PRIMARY = ", ".join(f"'{t}'" for t in lexicons.TECH.primary)


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def sql_in(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


def sql_hits(text: str, terms) -> str:
    """Phrases as 0/1, single words as whole-word counts."""
    phrases = [t for t in terms if " " in t]
    single = [t for t in terms if " " not in t]
    tokens = rf"regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}\p{{M}}_]+')"
    parts = [f"len(list_filter({sql_list(phrases)}, lambda p: contains({text}, p)))"] if phrases else []
    return " + ".join([*parts, f"len(list_filter({tokens}, lambda w: w IN {sql_in(single)}))"])


def sql_relevance(text: str) -> str:
    t = lexicons.TECH
    return (
        f"least(1.0::DOUBLE, (5.0 * ({sql_hits(text, t.primary)}) + 3.0 * ({sql_hits(text, t.secondary)})"
        f" + ({sql_hits(text, t.context)}))::DOUBLE / {3 * len(t.primary)}.0::DOUBLE)"
    )


def sql_matches(text: str) -> str:
    tagged = [f"primary:{t}" for t in lexicons.TECH.primary] + [f"secondary:{t}" for t in lexicons.TECH.secondary]
    return (
        f"array_to_string(list_filter({sql_list(tagged)}, "
        f"lambda k: contains({text}, split_part(k, ':', 2))), ',')"
    )


# --- sources and sinks ------------------------------------------------------


@query(
    "src1_csv_cases",
    views=("cases",),
    sql="""SELECT id, case_name, strftime(date_filed, '%Y-%m-%d') AS date_filed, court_id, precedential_status,
      citation_count, length(full_text) AS text_length, md5(full_text) AS text_md5,
      round(tech_relevance_score, 6) AS tech_relevance_score FROM cases""",
)
def src1(t):
    path = scratch_path(t.spark, "cases-csv")
    raw = t.cases
    raw.select([F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
                for c in schemas.CASES.names]).write.options(header="true", escape='"', quote='"').csv(path)
    back = files.read_cases(t.spark, path)
    return back.select(
        "id", "case_name", F.date_format(C.to_day("date_filed"), "yyyy-MM-dd").alias("date_filed"), "court_id",
        "precedential_status", F.col("citation_count").try_cast("long").alias("citation_count"),
        F.length("full_text").cast("long").alias("text_length"), F.md5("full_text").alias("text_md5"),
        F.round(F.col("tech_relevance_score").try_cast("double"), 6).alias("tech_relevance_score"),
    )


@query(
    "src2_csv_office_actions",
    views=("office_actions",),
    sql="""SELECT publicationNumber, techCenter, strftime(officeActionDate, '%Y-%m-%d') AS action_day,
      relatedClaimNumberText, passageLocationText FROM office_actions""",
)
def src2(t):
    path = scratch_path(t.spark, "actions-csv")
    raw = t.office_actions
    raw.select([F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
                for c in schemas.OFFICE_ACTIONS.names]).write.options(header="true", escape='"', quote='"').csv(path)
    back = files.read_office_actions(t.spark, path)
    return back.select(
        "publicationNumber", F.col("techCenter").try_cast("int").alias("techCenter"),
        F.date_format("officeActionDate", "yyyy-MM-dd").alias("action_day"),
        "relatedClaimNumberText", "passageLocationText",
    )


def api_results(t):
    """Nested search results built from the case view."""
    c = t.cases
    n = F.col("row_no")
    html = F.concat(F.lit("<p>"), F.col("full_text"), F.lit("</p>"))
    opinion = F.struct(
        F.when(n % 3 == 0, F.col("full_text")).when(n % 3 == 1, F.lit("  ")).alias("plain_text"),
        F.lit(None).cast("string").alias("html_with_citations"),
        F.when(n % 3 == 1, html).alias("html"),
        F.col("text_excerpt"),
        F.col("syllabus").alias("snippet"),
        F.concat(F.lit("https://example.com/"), "id").alias("download_url"),
        F.md5("id").alias("sha1"),
        F.lit("010combined").alias("type"),
        F.when(n % 2 == 0, F.concat(F.lit("author "), "court_id")).alias("author_id"),
        F.array("docket_id").alias("cites"),
    )
    return c.select(
        F.col("id").alias("cluster_id"), F.col("case_name").alias("caseName"),
        F.col("case_name_full").alias("caseNameFull"), F.date_format("date_filed", "yyyy-MM-dd").alias("dateFiled"),
        "court", "court_id", F.col("docket_number").alias("docketNumber"), "docket_id", "judge",
        F.when(n % 5 == 0, F.concat(F.lit("counsel "), "source")).alias("attorney"), F.array("judge", "court_id").alias("panel_names"),
        F.when(n % 7 == 0, F.concat(F.lit("s"), "id")).alias("scdb_id"),
        F.when(n % 2 == 1, F.date_format("date_terminated", "yyyy-MM-dd")).alias("dateArgued"),
        F.lit(None).cast("string").alias("dateReargued"),
        F.when(n % 4 == 2, F.date_format("date_terminated", "yyyy-MM-dd")).alias("dateReargumentDenied"),
        "procedural_history", "syllabus", F.when(n % 3 == 2, F.concat(F.lit("posture "), "source")).alias("posture"),
        F.col("precedential_status").alias("status"), F.col("suit_nature").alias("suitNature"),
        F.col("citation_count").alias("citeCount"), F.array("docket_number").alias("citation"),
        F.when(n % 17 == 3, F.array().cast(T_OPINIONS)).otherwise(F.array(opinion)).alias("opinions"),
    )


T_OPINIONS = schemas.API_RESULT["opinions"].dataType


@query(
    "src3_json_pages",
    views=("cases",),
    sql="""SELECT id AS cluster_id, case_name AS "caseName", court_id, citation_count AS "citeCount",
      CASE WHEN row_no % 17 = 3 THEN 0 ELSE 1 END::BIGINT AS opinions FROM cases""",
)
def src3(t):
    path = scratch_path(t.spark, "result-pages")
    page = F.struct(F.lit("https://example.com/?cursor=x").alias("next"),
                    F.array(F.struct("*")).alias("results"))
    api_results(t).select(page.alias("page")).select("page.*").write.json(path)
    return files.read_result_pages(t.spark, path).select(
        "cluster_id", "caseName", "court_id", "citeCount", F.size("opinions").cast("long").alias("opinions")
    )


@query(
    "src4_patent_json_pages",
    views=("office_actions",),
    sql="""SELECT publicationNumber, citedDocumentIdentifier, CAST(techCenter AS STRING) AS techCenter,
      relatedClaimNumberText FROM office_actions""",
)
def src4(t):
    path = scratch_path(t.spark, "patent-pages")
    raw = t.office_actions.select(
        "publicationNumber", "citedDocumentIdentifier", F.col("techCenter").cast("string").alias("techCenter"),
        "relatedClaimNumberText",
    )
    docs = F.struct(F.lit(0).alias("start"), F.lit(1).alias("numFound"), F.array(F.struct("*")).alias("docs"))
    raw.select(docs.alias("response")).write.json(path)
    rows = files.read_patent_pages(t.spark, path)
    return rows.select("publicationNumber", "citedDocumentIdentifier", "techCenter", "relatedClaimNumberText")


@query("snk1_csv_sink", views=("office_actions",),
       sql="SELECT techCenter::VARCHAR AS \"techCenter\", count(*) AS rows FROM office_actions GROUP BY 1")
def snk1(t):
    folder = scratch_path(t.spark, "csv-sink")
    path = files.write_csv(t.office_actions.withColumn("claims", P.claim_numbers("relatedClaimNumberText")), folder, "all")
    return t.spark.read.options(header="true", escape='"').csv(path).groupBy("techCenter").agg(F.count("*").alias("rows"))


@query("snk2_relevance_sink", views=("cases",),
       sql="SELECT coalesce(tech_relevance_score >= 0.2, false) AS high_relevance, count(*) AS rows FROM cases GROUP BY 1")
def snk2(t):
    path = files.write_by_relevance(
        t.cases.select("id", "tech_relevance_score", "court_id"), scratch_path(t.spark, "relevance")
    )
    back = t.spark.read.parquet(path).withColumn("high_relevance", F.col("high_relevance").cast("boolean"))
    return back.groupBy("high_relevance").agg(F.count("*").alias("rows"))


@query("snk4_saved_tables", views=("office_actions",),
       sql=""" SELECT 'cases' AS "table", count(DISTINCT text) AS rows FROM documents UNION ALL SELECT 'edges', count(*) FROM office_actions""")
def snk4(t):
    paths = files.save_tables(
        {"cases": C.keep_most_complete(t.documents, "text", "doc_id").drop("text"),
         "edges": t.office_actions.select("publicationNumber", "citedDocumentIdentifier")},
        scratch_path(t.spark, "saved"),
    )
    back = files.load_tables(t.spark, paths)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in back.items()]
    return counts[0].unionByName(counts[1])


@query(
    "snk5_json_rows",
    views=("cases",),
    sql="""SELECT to_json(struct_pack(id := id, date_filed := strftime(date_filed, '%Y-%m-%d'),
      citation_count := citation_count, status := precedential_status))::VARCHAR AS json FROM cases""",
)
def snk5(t):
    return files.json_rows(
        t.cases.select("id", F.date_format("date_filed", "yyyy-MM-dd").alias("date_filed"), "citation_count",
                       F.col("precedential_status").alias("status"))
    )


# --- cleaning ---------------------------------------------------------------


@query(
    "cln1_repair_misaligned",
    sql="""WITH src AS (SELECT doc_id AS row_no, source,
        CASE WHEN doc_id % 5 IN (1, 2) OR doc_id % 7 = 3 THEN NULL ELSE text END AS full_text FROM documents),
      n AS (SELECT *, lead(full_text) OVER (ORDER BY row_no) AS nxt, lag(full_text) OVER (ORDER BY row_no) AS prv,
        row_number() OVER (ORDER BY row_no) AS rn FROM src),
      m AS (SELECT row_no, source, CASE WHEN full_text IS NULL THEN nxt
        WHEN prv IS NULL AND rn > 1 THEN NULL ELSE full_text END AS full_text FROM n)
      SELECT * FROM m WHERE full_text IS NOT NULL""",
)
def cln1(t):
    n = F.col("doc_id")
    src = t.documents.select(
        n.alias("row_no"), "source", F.when((n % 5).isin(1, 2) | (n % 7 == 3), None).otherwise(F.col("text")).alias("full_text")
    )
    return C.repair_misaligned(src, "full_text", "row_no")


@query(
    "cln2_keep_most_complete",
    sql="""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang,
        CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS source FROM documents),
      r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY
        (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT DESC, doc_id) AS rn FROM d)
      SELECT doc_id, text, lang, source FROM r WHERE rn = 1""",
)
def cln2(t):
    n = F.col("doc_id")
    d = t.documents.select(
        "doc_id", "text", F.when(n % 3 == 0, None).otherwise(F.col("lang")).alias("lang"),
        F.when(n % 2 == 0, None).otherwise(F.col("source")).alias("source"),
    )
    return C.keep_most_complete(d, "text", "doc_id")


@query(
    "cln3_keep_first",
    sql="""SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderpriority FROM orders
      GROUP BY o_custkey, o_orderpriority""",
)
def cln3(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return C.keep_first(rows, ["o_custkey", "o_orderpriority"], [F.asc("o_orderkey")])


@query("cln4_distinct_rows", sql="SELECT DISTINCT text, lang, n_chars FROM documents")
def cln4(t):
    return C.distinct_rows(t.documents.select("text", "lang", "n_chars"))


@query(
    "cln5_case_table",
    views=("cases",),
    sql="""SELECT id, case_name, strftime(date_filed, '%Y-%m-%d') AS date_filed, NULL::VARCHAR AS text_excerpt,
      '["' || docket_id || '"]' AS opinion_cites, citation_count FROM cases ORDER BY id""",
)
def cln5(t):
    raw = t.cases.select(
        "id", "case_name", F.date_format("date_filed", "yyyy-MM-dd").alias("date_filed"), "court", "court_id",
        F.array("docket_id").alias("opinion_cites"), "citation_count",
    )
    return C.case_table(raw).select(
        "id", "case_name", F.date_format("date_filed", "yyyy-MM-dd").alias("date_filed"), "text_excerpt",
        "opinion_cites", "citation_count",
    )


@query(
    "cln6_validated_cases",
    views=("cases",),
    sql="""SELECT id, CASE WHEN row_no % 9 = 0 THEN '' ELSE case_name END AS case_name, court_id,
      coalesce(precedential_status, '') AS precedential_status, coalesce(suit_nature, '') AS suit_nature,
      coalesce(text_excerpt, '') AS text_excerpt, round(coalesce(tech_relevance_score, 0), 6) AS tech_relevance_score,
      docket_id, NULL::VARCHAR AS cluster_id, date_filed, coalesce(tech_keywords_found, '[]') AS tech_keywords_found,
      0 AS opinion_cites, 0 AS citing_cases, 0 AS cited_by
      FROM cases WHERE row_no % 9 <> 0""",
)
def cln6(t):
    raw = t.cases.withColumn("case_name", F.when(F.col("row_no") % 9 != 0, F.col("case_name")))
    return C.validated_cases(raw).select(
        "id", "case_name", "court_id", "precedential_status", "suit_nature", "text_excerpt",
        F.round("tech_relevance_score", 6).alias("tech_relevance_score"), "docket_id", "cluster_id", "date_filed",
        "tech_keywords_found", *[F.size(c).alias(c) for c in ("opinion_cites", "citing_cases", "cited_by")],
    )


@query(
    "cln7_processed_raw",
    views=("cases",),
    sql=f""", b AS (SELECT row_no, id, strftime(date_filed, '%Y-%m-%d') AS date_filed, court,
        coalesce(suit_nature, 'Not Available') AS nature_of_suit,
        coalesce(precedential_status, 'Not Available') AS precedential_status,
        citation_count::DOUBLE AS citation_count, full_text FROM cases),
      c1 AS (SELECT court, row_number() OVER (ORDER BY min(row_no)) - 1 AS court_encoded FROM b GROUP BY 1),
      c2 AS (SELECT nature_of_suit, row_number() OVER (ORDER BY min(row_no)) - 1 AS nature_of_suit_encoded FROM b GROUP BY 1),
      c3 AS (SELECT precedential_status, row_number() OVER (ORDER BY min(row_no)) - 1 AS precedential_status_encoded FROM b GROUP BY 1)
      SELECT id, date_filed, nature_of_suit, precedential_status, citation_count, court_encoded,
        nature_of_suit_encoded, precedential_status_encoded, 0::BIGINT AS jurisdiction_type_encoded,
        round(ln(1 + citation_count), 6) AS citation_count_log,
        len(list_filter({sql_list(lexicons.TECH.primary)}, lambda k: contains(lower(full_text), k)))::INT AS tech_keyword_count
      FROM b JOIN c1 USING (court) JOIN c2 USING (nature_of_suit) JOIN c3 USING (precedential_status)""",
)
def cln7(t):
    raw = t.cases.select(
        "row_no", "id", "date_filed", "court", F.col("suit_nature").alias("nature_of_suit"), "precedential_status",
        "citation_count", "tech_relevance_score", F.col("full_text").alias("opinion_text"),
    )
    return C.processed_raw(raw, "row_no").select(
        "id", "date_filed", "nature_of_suit", "precedential_status", "citation_count", "court_encoded",
        "nature_of_suit_encoded", "precedential_status_encoded", "jurisdiction_type_encoded",
        F.round("citation_count_log", 6).alias("citation_count_log"), "tech_keyword_count",
    )


@query(
    "cln8_prepared_cases",
    views=("cases",),
    sql="""SELECT id, coalesce(text_excerpt, '') AS text_excerpt, coalesce(procedural_history, '') AS procedural_history,
      syllabus, CASE WHEN row_no % 6 = 0 THEN 0 WHEN row_no % 6 = 1 THEN 0 ELSE 2 END::BIGINT AS n_citations,
      CASE WHEN row_no % 6 IN (0, 1) THEN NULL ELSE docket_number END AS first_cite
      FROM cases WHERE trim(coalesce(text_excerpt, '') || syllabus || coalesce(procedural_history, '')) <> ''""",
)
def cln8(t):
    n = F.col("row_no")
    text = F.concat(F.lit("[{'cite': '"), "docket_number", F.lit("', 'date': '2001-02-03'}, {'cite': 'x', 'date': ''}]"))
    raw = t.cases.withColumn("citations", F.when(n % 6 == 0, None).when(n % 6 == 1, "[{broken").otherwise(text))
    out = C.prepared_cases(raw.drop("full_text"))
    return out.select(
        "id", "text_excerpt", "procedural_history", "syllabus", F.size("citations").cast("long").alias("n_citations"),
        F.get("citations", F.lit(0))["cite"].alias("first_cite"),
    )


_FLAT = """, o AS (SELECT *, CASE WHEN row_no % 17 = 3 THEN NULL WHEN row_no % 3 IN (0, 1) THEN full_text
        WHEN trim(coalesce(text_excerpt, '')) <> '' THEN text_excerpt WHEN trim(syllabus) <> '' THEN syllabus END AS chosen,
      concat_ws(' ', case_name, case_name_full, suit_nature,
        CASE WHEN row_no % 17 = 3 THEN NULL ELSE nullif(syllabus, '') END,
        CASE WHEN row_no % 17 = 3 THEN NULL WHEN row_no % 3 = 1 THEN full_text END) AS early FROM cases),
    p AS (SELECT *, coalesce(trim(regexp_replace(
      regexp_replace(chosen, '<![^>]*>|</?[a-zA-Z][^>]*>', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g')), 'Not Available') AS body FROM o)
"""


@query(
    "cln9_flattened_results",
    views=("cases",),
    sql=_FLAT + f""", s AS (SELECT *, concat_ws(' ', case_name, nullif(syllabus, ''), procedural_history, body) AS content FROM p)
      SELECT id, case_name, coalesce(precedential_status, '') AS precedential_status, citation_count,
      CASE WHEN row_no % 5 = 0 THEN 'counsel ' || source ELSE '' END AS attorney, judge || ',' || court_id AS panel_names,
      CASE WHEN row_no % 7 = 0 THEN 's' || id ELSE '' END AS scdb_id,
      CASE WHEN row_no % 2 = 1 THEN strftime(date_terminated, '%Y-%m-%d') ELSE '' END AS date_argued, '' AS date_reargued,
      CASE WHEN row_no % 4 = 2 THEN strftime(date_terminated, '%Y-%m-%d') ELSE '' END AS date_reargument_denied,
      coalesce(procedural_history, '') AS procedural_history, coalesce(syllabus, '') AS syllabus,
      CASE WHEN row_no % 3 = 2 THEN 'posture ' || source ELSE '' END AS posture,
      CASE WHEN row_no % 17 <> 3 AND row_no % 2 = 0 THEN 'author ' || court_id ELSE '' END AS opinion_author_id,
      body AS full_text, round({sql_relevance("lower(content)")}, 6) AS tech_relevance_score,
      {sql_matches("lower(content)")} AS tech_keywords_found
      FROM s WHERE {sql_relevance("lower(early)")} >= 0.05""",
)
def cln9(t):
    return C.flattened_results(api_results(t)).select(
        "id", "case_name", "precedential_status", "citation_count", "attorney", F.array_join("panel_names", ",").alias("panel_names"),
        "scdb_id", "date_argued", "date_reargued", "date_reargument_denied", "procedural_history", "syllabus", "posture",
        "opinion_author_id", "full_text",
        F.round("tech_relevance_score", 6).alias("tech_relevance_score"),
        F.array_join("tech_keywords_found", ",").alias("tech_keywords_found"),
    )


@query("cln10_opinion_text", views=("cases",), sql=_FLAT + "SELECT id, body AS opinion_text FROM p")
def cln10(t):
    first = api_results(t).select(F.col("cluster_id").alias("id"), F.get("opinions", F.lit(0)).alias("opinion"))
    return first.select("id", C.opinion_text("opinion").alias("opinion_text"))


@query(
    "cln11_cleaned_patents",
    views=("office_actions",),
    sql="""SELECT publicationNumber, coalesce(citedDocumentIdentifier, '') AS citedDocumentIdentifier,
      coalesce(inventorNameText, '') AS inventorNameText, coalesce(passageLocationText, '') AS passageLocationText,
      strftime(officeActionDate, '%Y-%m-%d') AS action_day,
      coalesce(upper(examinerCitedReferenceIndicator) = 'TRUE', false) AS examiner,
      coalesce(upper(applicantCitedExaminerReferenceIndicator) = 'TRUE', false) AS applicant,
      coalesce(upper(nplIndicator) = 'TRUE', false) AS npl FROM office_actions""",
)
def cln11(t):
    return C.cleaned_patents(t.office_actions).select(
        "publicationNumber", "citedDocumentIdentifier", "inventorNameText", "passageLocationText",
        F.date_format("officeActionDate", "yyyy-MM-dd").alias("action_day"),
        F.col("examinerCitedReferenceIndicator").alias("examiner"),
        F.col("applicantCitedExaminerReferenceIndicator").alias("applicant"), F.col("nplIndicator").alias("npl"),
    )


@query(
    "cln12_patent_predicate",
    views=("office_actions",),
    sql="""SELECT publicationNumber, citedDocumentIdentifier FROM office_actions
      WHERE officeActionDate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31' AND techCenter = 2400
      AND citationCategoryCode = 'X'""",
)
def cln12(t):
    test = C.patent_predicate(("1997-01-01", "1999-12-31"), "2400", "X")
    return t.office_actions.where(test).select("publicationNumber", "citedDocumentIdentifier")


@query(
    "cln13_tech_patents",
    views=("office_actions",),
    sql="""SELECT publicationNumber, techCenter FROM office_actions
      WHERE officeActionDate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30 23:59:59'
      AND techCenter IN (2100, 2400)""",
)
def cln13(t):
    return C.tech_patents(t.office_actions, "1997-01-01", "1998-06-30", (2100, 2400)).select(
        "publicationNumber", "techCenter"
    )


@query(
    "cln14_relevant_cases",
    views=("cases",),
    sql="""SELECT id, case_name FROM cases WHERE tech_relevance_score >= 0.4
      AND date_filed BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
)
def cln14(t):
    return C.relevant_cases(t.cases, "1996-01-01", "1999-12-31", 0.4).select("id", "case_name")


@query("cln15_long_enough", sql="SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) >= 50")
def cln15(t):
    return C.long_enough(t.documents, "text", 50).select("doc_id", "n_chars")


@query(
    "cln16_search_groups",
    views=("cases",),
    sql=", hits AS (" + " UNION ALL ".join(
        f"SELECT id, {i} AS group_id FROM cases WHERE "
        + " OR ".join(f"contains(lower(full_text), '{term}')" for term in terms)
        for i, terms in enumerate(lexicons.SEARCH_GROUPS)
    ) + ") SELECT id, group_id FROM hits",
)
def cln16(t):
    return C.search_groups(t.cases, "full_text").select("id", "group_id")


# --- projections ------------------------------------------------------------


@query(
    "prj1_combined_text",
    views=("cases",),
    sql="""SELECT id, coalesce(case_name, '') || ' ' || coalesce(text_excerpt, '') || ' ' ||
      coalesce(tech_keywords_found, '') || ' ' || coalesce(suit_nature, '') AS combined_text FROM cases""",
)
def prj1(t):
    return t.cases.select(
        "id", C.combined_text("case_name", "text_excerpt", "tech_keywords_found", "suit_nature").alias("combined_text")
    )


@query(
    "prj2_joined_text",
    views=("cases",),
    sql="""SELECT id, concat_ws(' ', nullif(full_text, ''), nullif(syllabus, ''), nullif(text_excerpt, ''),
      nullif(procedural_history, '')) AS text FROM cases""",
)
def prj2(t):
    return t.cases.select(
        "id", C.joined_text("full_text", "syllabus", "text_excerpt", "procedural_history").alias("text")
    )


@query(
    "prj3_quantile_labels",
    sql="""WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem)
      SELECT CASE WHEN l_extendedprice <= e[1] THEN 'Very Low' WHEN l_extendedprice <= e[2] THEN 'Low'
        WHEN l_extendedprice <= e[3] THEN 'Medium' WHEN l_extendedprice <= e[4] THEN 'High' ELSE 'Very High' END AS category,
        count(*) AS rows, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
      FROM lineitem, q GROUP BY 1""",
)
def prj3(t):
    labelled = C.quantile_labels(t.lineitem.select("l_extendedprice"), "l_extendedprice", "category")
    return labelled.groupBy("category").agg(
        F.count("*").alias("rows"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest")
    )


@query(
    "prj4_derived_features",
    views=("cases",),
    sql="""SELECT id, date_diff('day', date_filed, date_terminated) AS case_duration, citation_count > 0 AS has_citations,
      round(ln(1 + citation_count), 6) AS citation_score, court_id = 'cafc' AS is_appellate,
      length(text_excerpt) AS opinion_length, dense_rank() OVER (ORDER BY court_id) - 1 AS court_id_encoded,
      CASE WHEN precedential_status IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY precedential_status NULLS LAST) - 1 END AS precedential_status_encoded
      FROM cases""",
)
def prj4(t):
    return C.derived_features(t.cases, ("court_id", "precedential_status")).select(
        "id", "case_duration", "has_citations", F.round("citation_score", 6).alias("citation_score"), "is_appellate",
        "opinion_length", "court_id_encoded", "precedential_status_encoded",
    )


@query(
    "prj5_category_codes",
    sql="""WITH f AS (SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS first_code FROM part GROUP BY p_type),
      s AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS sorted_code FROM (SELECT DISTINCT p_type FROM part))
      SELECT p_partkey, first_code, sorted_code FROM part JOIN f USING (p_type) JOIN s USING (p_type)""",
)
def prj5(t):
    rows = t.part.select("p_partkey", "p_type")
    rows = C.with_codes(rows, "p_type", C.first_appearance_codes(rows, "p_type", "p_partkey"), "first_code")
    rows = C.with_codes(rows, "p_type", C.sorted_codes(rows, "p_type"), "sorted_code")
    return rows.select("p_partkey", "first_code", "sorted_code")


_LEVEL = "CASE court_id WHEN 'scotus' THEN 3 WHEN 'cafc' THEN 2 ELSE 1 END::BIGINT"


@query("prj6_court_level", views=("cases",), sql=f"SELECT id, court_id, {_LEVEL} AS court_level FROM cases")
def prj6(t):
    return t.cases.select("id", "court_id", C.court_level("court_id").alias("court_level"))


@query(
    "prj7_numeric_features",
    views=("cases",),
    sql="""SELECT id, length(text_excerpt) AS text_length, length(case_name) AS title_length,
      citation_count::DOUBLE AS citation_count, year(date_filed)::BIGINT AS year FROM cases""",
)
def prj7(t):
    return C.numeric_features(t.cases).select("id", "text_length", "title_length", "citation_count", "year")


@query(
    "prj8_inferred_status",
    views=("cases",),
    sql="""SELECT id, CASE WHEN court_id = 'cafc' OR precedential_status = 'Published' OR citation_count > 5
      THEN 'Precedential' ELSE 'Non-Precedential' END AS status FROM cases""",
)
def prj8(t):
    return t.cases.select("id", C.inferred_status().alias("status"))


@query(
    "prj9_normalised_status",
    views=("cases",),
    sql="""SELECT id, CASE WHEN lower(precedential_status) LIKE '%non-precedential%' THEN 'Unpublished'
      WHEN lower(precedential_status) LIKE '%published%' THEN 'Published' WHEN citation_count > 5 THEN 'Published'
      ELSE 'Not Available' END AS status FROM cases""",
)
def prj9(t):
    return t.cases.select(
        "id", C.normalised_status("precedential_status", "citation_count", "source").alias("status")
    )


@query(
    "prj10_time_period",
    views=("cases",),
    sql="""SELECT id, CASE WHEN row_no % 10 = 4 THEN '2010_2020' WHEN date_filed < DATE '2000-01-01' THEN 'pre_2000'
      WHEN date_filed < DATE '2010-01-01' THEN '2000_2010' WHEN date_filed < DATE '2020-01-01' THEN '2010_2020'
      ELSE 'post_2020' END AS time_period FROM cases""",
)
def prj10(t):
    raw = F.when(F.col("row_no") % 10 == 4, "unknown").otherwise(F.date_format("date_filed", "yyyy-MM-dd"))
    return t.cases.select("id", X.time_period(raw).alias("time_period"))


@query(
    "prj11_response_rows",
    views=("cases",),
    sql="""SELECT id, substr(text_excerpt, 1, 300) AS excerpt, round(tech_relevance_score * 100, 1) AS relevance_pct,
      substr(full_text, 1, 200) AS preview FROM cases""",
)
def prj11(t):
    return t.cases.select(
        "id", C.excerpt("text_excerpt").alias("excerpt"), C.percentage("tech_relevance_score").alias("relevance_pct"),
        C.excerpt("full_text", 200).alias("preview"),
    )
