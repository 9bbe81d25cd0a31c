"""Text, date and advice queries."""

from pyspark.sql import functions as F

from docketry import lexicons
from docketry.functions import patent as P
from docketry.functions import text as X
from docketry.operators import near_lists as N
from docketry.operators.gazetteer import name_matches
from docketry.plans.cleaning import sql_in, sql_list, sql_matches, sql_relevance
from docketry.plans.registry import query

PERIOD = """CASE WHEN date_filed < DATE '2000-01-01' THEN 'pre_2000' WHEN date_filed < DATE '2010-01-01' THEN '2000_2010'
  WHEN date_filed < DATE '2020-01-01' THEN '2010_2020' ELSE 'post_2020' END"""

WS = r"[\s\p{Z}]"


# The HTML entities that the supplied pages may hold. The semicolon is
# optional for the second group; ``amp`` comes last so that an escaped entity
# is decoded once only.
HTML_ENTITIES = {
    "apos;": "'", "hellip;": "\u2026", "ndash;": "\u2013", "mdash;": "\u2014", "lsquo;": "\u2018", "rsquo;": "\u2019",
    "ldquo;": "\u201c", "rdquo;": "\u201d",
    "nbsp;?": "\u00a0", "lt;?": "<", "gt;?": ">", "quot;?": '"', "sect;?": "\u00a7", "para;?": "\u00b6",
    "copy;?": "\u00a9", "reg;?": "\u00ae", "middot;?": "\u00b7", "amp;?": "&",
}


def sql_html(column: str) -> str:
    """Visible text of HTML in DuckDB, step by step."""
    out = rf"regexp_replace({column}, '<!--.*?(?:-->|\z)', '', 'gs')"
    for tag in ("script", "style"):
        out = rf"regexp_replace({out}, '<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)', '', 'gis')"
    out = rf"regexp_replace({out}, '<![^>]*>|</?[a-zA-Z][^>]*>', '', 'g')"
    for name, char in HTML_ENTITIES.items():
        out = "regexp_replace({}, '&{}', '{}', 'g')".format(out, name, char.replace("'", "''"))
    return rf"trim(regexp_replace({out}, '{WS}+', ' ', 'g'))"


@query("txt1_html_text", sql=f"SELECT page_id, url, {sql_html('html')} AS text FROM pages")
def txt1(t):
    return t.pages.select("page_id", "url", X.strip_html("html").alias("text"))


@query(
    "txt2_clean_boilerplate",
    sql=rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(
      CASE WHEN doc_id % 3 = 0 THEN 'Case: 12-345 Document: 67 Page 1 Filed: ' ELSE '' END || text,
      'Case:\s*\d+-\d+\s*Document:\s*\d+.*?Filed:', '', 'g'), '{WS}+', ' ', 'g'),
      '[^\p{{L}}\p{{N}}_\s.,;:\-''"()]', ' ', 'g')) AS text FROM documents""",
)
def txt2(t):
    stamp = F.when(F.col("doc_id") % 3 == 0, "Case: 12-345 Document: 67 Page 1 Filed: ").otherwise("")
    return t.documents.select("doc_id", X.clean_boilerplate(F.concat(stamp, "text")).alias("text"))


@query("txt3_letters_only", sql=r"SELECT doc_id, regexp_replace(lower(text), '[^a-zA-Z\s]', ' ', 'g') AS text FROM documents")
def txt3(t):
    return t.documents.select("doc_id", X.letters_only("text").alias("text"))


@query(
    "txt4_tech_related",
    views=("cases",),
    sql=f"""SELECT id, len(list_filter({sql_list(lexicons.TECH.primary)}, lambda k: contains(lower(full_text), k))) > 0
      OR len(list_filter({sql_list(lexicons.TECH.secondary)}, lambda k: contains(lower(full_text), k))) >= 2 AS tech_related
      FROM cases""",
)
def txt4(t):
    return t.cases.select("id", X.is_tech_related("full_text").alias("tech_related"))


@query("txt5_tech_relevance", views=("cases",),
       sql=f"SELECT id, round({sql_relevance('lower(full_text)')}, 6) AS relevance FROM cases")
def txt5(t):
    return t.cases.select("id", F.round(X.tech_relevance("full_text"), 6).alias("relevance"))


@query("txt6_matching_keywords", views=("cases",),
       sql=f"SELECT id, {sql_matches('lower(full_text)')} AS keywords FROM cases")
def txt6(t):
    return t.cases.select("id", F.array_join(X.matching_keywords("full_text"), ",").alias("keywords"))


_PARSED = r"""list_filter(list_transform(regexp_extract_all(raw, '''([^'']*)''', 1),
  lambda k: trim(lower(regexp_replace(k, '^[^:]*:', '')))), lambda k: k <> '')"""


@query("txt7_parse_keywords", views=("keyword_rows",),
       sql=f"SELECT id, array_to_string({_PARSED}, ',') AS keywords FROM keyword_rows")
def txt7(t):
    return t.keyword_rows.select("id", F.array_join(X.parse_keywords("raw"), ",").alias("keywords"))


@query(
    "txt8_keyword_count",
    views=("cases",),
    sql=f"""SELECT id, len(list_filter({sql_list(lexicons.TECH.primary)}, lambda k: contains(lower(full_text), k)))::INT AS n
      FROM cases""",
)
def txt8(t):
    return t.cases.select("id", X.keyword_count("full_text").alias("n"))


def sql_issue(issue: str) -> str:
    tests = [f"regexp_matches(full_text, '(?i){'|'.join(lexicons.ISSUE_PATTERNS[issue])}')"]
    for periods, (extra, pattern) in lexicons.PERIOD_ISSUE_PATTERNS.items():
        if extra == issue:
            tests.append(f"(period IN {sql_in(periods)} AND regexp_matches(full_text, '(?i){pattern}'))")
    return f"CASE WHEN {' OR '.join(tests)} THEN '{issue}' END"


SQL_ISSUES = "concat_ws(',', " + ", ".join(sql_issue(i) for i in sorted(lexicons.ISSUE_PATTERNS)) + ")"


@query(
    "txt9_legal_issues",
    views=("cases",),
    sql=f", p AS (SELECT id, full_text, {PERIOD} AS period FROM cases) SELECT id, period, {SQL_ISSUES} AS issues FROM p",
)
def txt9(t):
    cases = t.cases.select("id", "full_text", X.time_period("date_filed").alias("period"))
    return cases.select("id", "period", F.array_join(X.legal_issues("full_text", "period"), ",").alias("issues"))


# A year is bounded by characters that are not letters, digits or underscores.
_YEARS = r"""list_transform(list_filter(regexp_split_to_array(full_text, '[^\p{L}\p{N}\p{M}_]+'),
  lambda w: regexp_full_match(w, '(?:19|20)[0-9]{2}')), lambda w: w::INT)"""
_START = "CASE period WHEN 'post_2020' THEN 2020 WHEN '2010_2020' THEN 2010 WHEN '2000_2010' THEN 2000 ELSE 1990 END"


@query(
    "txt10_citation_recency",
    views=("cases",),
    sql=f""", p AS (SELECT id, {_YEARS} AS years, {PERIOD} AS period FROM cases)
      SELECT id, round(CASE WHEN len(years) = 0 THEN 0.0
        ELSE len(list_filter(years, lambda y: y >= {_START}))::DOUBLE / len(years) END, 6) AS recency FROM p""",
)
def txt10(t):
    cases = t.cases.select("id", "full_text", X.time_period("date_filed").alias("period"))
    return cases.select("id", F.round(X.citation_recency("full_text", "period"), 6).alias("recency"))


_WORDS = r"len(regexp_extract_all(full_text, '[^\s\p{Z}]+'))"
_INFLUENCE = "(" + " + ".join(
    f"len(regexp_extract_all(full_text, '(?i){p}'))" for p in lexicons.PRECEDENT_PATTERNS
) + ")"


SQL_INFLUENCE = f"least(1.0::DOUBLE, coalesce({_INFLUENCE} * 1000.0::DOUBLE / nullif({_WORDS}, 0), 0) / 10.0::DOUBLE)"


@query("txt11_precedent_influence", views=("cases",), sql=f"SELECT id, round({SQL_INFLUENCE}, 6) AS influence FROM cases")
def txt11(t):
    return t.cases.select("id", F.round(X.precedent_influence("full_text"), 6).alias("influence"))


_PHRASES = "(" + " + ".join(
    f"(length(lower(full_text)) - length(replace(lower(full_text), '{p}', ''))) // {len(p)}" for p in lexicons.LEGAL_PHRASES
) + ")"
SQL_COMPLEXITY = rf"""least(1.0::DOUBLE, (coalesce({_PHRASES}::DOUBLE / nullif({_WORDS}, 0), 0) * 100.0::DOUBLE
  + len(regexp_extract_all(full_text, '[^\s\p{{Z}}.]+'))::DOUBLE
  / (length(full_text) - length(replace(full_text, '.', '')) + 1) / 50.0::DOUBLE) / 10.0::DOUBLE)"""


@query("txt12_legal_complexity", views=("cases",), sql=f"SELECT id, round({SQL_COMPLEXITY}, 6) AS complexity FROM cases")
def txt12(t):
    return t.cases.select("id", F.round(X.legal_complexity("full_text"), 6).alias("complexity"))


def _sql_ratio() -> str:
    whens = " ".join(
        f"WHEN '{name}' THEN len(list_filter({sql_list(own)}, lambda k: contains(lower(full_text), k)))::DOUBLE / {len(own)}"
        for name, own in lexicons.PERIOD_TERMS.items()
    )
    return f"CASE period {whens} END"


@query(
    "txt13_enhanced_features",
    views=("cases",),
    sql=f""", p AS (SELECT id, full_text, {_YEARS} AS years, {PERIOD} AS period FROM cases)
      SELECT id, round(CASE WHEN len(years) = 0 THEN 0.0
          ELSE len(list_filter(years, lambda y: y >= {_START}))::DOUBLE / len(years) END, 6) AS recent_citation_ratio,
        round({SQL_INFLUENCE}, 6) AS precedent_influence, round({_sql_ratio()}, 6) AS period_term_ratio,
        round({SQL_COMPLEXITY}, 6) AS legal_complexity FROM p""",
)
def txt13(t):
    cases = t.cases.select("id", "full_text", X.time_period("date_filed").alias("period"))
    rows = cases.select("id", X.enhanced_features("full_text", "period").alias("f"))
    return rows.select("id", *[F.round(f"f.{c}", 6).alias(c) for c in (
        "recent_citation_ratio", "precedent_influence", "period_term_ratio", "legal_complexity")])


@query(
    "txt14_citation_dates",
    views=("cases",),
    sql="""SELECT id, CASE WHEN row_no % 6 = 0 THEN 0 ELSE 3 END::BIGINT AS citation_count,
      round(CASE WHEN row_no % 6 = 0 THEN 0.0 ELSE year(date_filed)
        - ((year(date_filed) - row_no % 30) + 1990) / 2.0::DOUBLE END, 6) AS avg_citation_age,
      CASE WHEN row_no % 6 = 0 THEN 0 ELSE abs(year(date_filed) - row_no % 30 - 1990) END::BIGINT AS citation_span
      FROM cases""",
)
def txt14(t):
    n = F.col("row_no")
    cite = lambda name, date: F.struct(F.lit(name).alias("cite"), date.alias("date"))
    dates = F.array(
        cite("a", F.concat((F.year("date_filed") - n % 30).cast("string"), F.lit("-03-04"))),
        cite("b", F.lit("1990-12-31")),
        cite("c", F.lit("unknown")),
    )
    cites = F.when(n % 6 != 0, dates)
    rows = t.cases.select("id", X.citation_date_features(cites, "date_filed").alias("f"))
    return rows.select("id", "f.citation_count", F.round("f.avg_citation_age", 6).alias("avg_citation_age"), "f.citation_span")


def _sql_sentences(column: str) -> str:
    marked = rf"regexp_replace(trim({column}), '([.!?])({WS}+)', '\1' || chr(1) || '\2' || chr(2), 'g')"
    for a in X.ABBREVIATIONS:
        known = a.replace(".", r"\.")
        marked = rf"regexp_replace({marked}, '\b({known}\.)' || chr(1) || '([^' || chr(2) || ']*)' || chr(2), '\1\2', 'g')"
    return rf"list_filter(regexp_split_to_array({marked}, chr(1) || '[^' || chr(2) || ']*' || chr(2)), lambda s: s <> '')"


@query(
    "txt15_sentences",
    views=("cases",),
    sql=f""", s AS (SELECT id, {_sql_sentences("full_text")} AS s FROM cases)
      SELECT id, (i - 1)::INT AS position, s[i] AS sentence FROM (SELECT id, s, unnest(generate_series(1, len(s))) AS i FROM s)""",
)
def txt15(t):
    return t.cases.select("id", F.posexplode(X.sentences("full_text")).alias("position", "sentence"))


@query("txt16_strategic_insights")
def txt16(t):
    base = t.cases.select("id", X.time_period("date_filed").alias("time_period"), X.sentences("full_text").alias("s"))
    found = base.select("id", "time_period", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("category"), X.insights("s", patterns).alias("found"))
        for kind, patterns in lexicons.INSIGHT_PATTERNS.items()])).alias("x"))
    return found.select("id", "time_period", "x.category", F.explode("x.found").alias("f")).select(
        "id", "time_period", "category", "f.text", "f.context")


_POINTS = " UNION ALL ".join(
    f"SELECT id, '{kind}' AS type, unnest(regexp_extract_all(sentence, '(?i){p}', 1)) AS raw FROM u"
    for kind, p in lexicons.KEY_POINT_PATTERNS.items()
)


@query(
    "txt17_key_points",
    views=("cases",),
    sql=rf""", u AS (SELECT id, unnest({_sql_sentences("full_text")}) AS sentence FROM cases), f AS ({_POINTS}),
      g AS (SELECT id, type, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS text FROM f) SELECT id, type, text FROM g WHERE length(text) > 10""",
)
def txt17(t):
    points = t.cases.select("id", F.explode(X.key_points(X.sentences("full_text"))).alias("p"))
    return points.select("id", "p.type", "p.text")


_FINDINGS = "list_concat(" + ", ".join(f"regexp_extract_all(full_text, '(?i){p}', 1)" for p in lexicons.FINDING_PATTERNS) + ")"


@query(
    "txt18_key_findings",
    views=("cases",),
    sql=rf""", f AS (SELECT id, unnest({_FINDINGS}) AS raw FROM cases),
      g AS (SELECT id, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS finding FROM f) SELECT id, finding FROM g WHERE length(finding) > 10""",
)
def txt18(t):
    return t.cases.select("id", F.explode(X.key_findings("full_text")).alias("finding"))


_CITES = "list_concat(" + ", ".join(f"regexp_extract_all(full_text, '{p}')" for p in lexicons.CITATION_PATTERNS) + ")"


@query(  # no supplied text has a reference list, so the inline formats are the whole result
    "txt19_citations",
    views=("cases",),
    sql=rf""", f AS (SELECT id, unnest(list_distinct(list_transform({_CITES}, lambda c: regexp_replace(c, '^{WS}+|{WS}+$', '', 'g')))) AS citation FROM cases)
      SELECT id, citation FROM f WHERE citation <> ''""",
)
def txt19(t):
    return t.cases.select("id", F.explode(X.citations("full_text")).alias("citation"))


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[\s\p{{Z}}]+'), lambda w: w <> ''))"


@query(  # the greedy pass, as a fold over the indices of each list
    "txt20_near_duplicates",
    sql=rf"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n+'), lambda x: x <> '') AS s FROM documents),
      w AS (SELECT doc_id, s, list_transform(s, lambda x: {_TOKENS.format("x")}) AS t FROM l WHERE len(s) > 0),
      k AS (SELECT doc_id, s, list_reduce(list_transform(generate_series(1, len(s)), lambda i: [i]), lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda j: len(list_intersect(t[j], t[x[1]]))::DOUBLE / nullif(len(list_distinct(list_concat(t[j], t[x[1]]))), 0) > 0.7)) > 0
          THEN acc ELSE list_concat(acc, x) END) AS kept FROM w)
      SELECT doc_id, (i - 1)::INT AS position, s[i] AS line FROM (SELECT doc_id, s, unnest(kept) AS i FROM k)""",
)
def txt20(t):
    lines = t.documents.select("doc_id", X.words_kept(F.split("text", r"\n+")).alias("lines"))
    return N.lists_without_near_duplicates(lines, "lines", 0.7, "position", "line")


@query(
    "txt21_text_similarity",
    views=("cases",),
    sql=rf""", w AS (SELECT id, {_TOKENS.format("full_text")} AS a, {_TOKENS.format("case_name || ' ' || coalesce(text_excerpt, '')")} AS b FROM cases)
      SELECT id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM w""",
)
def txt21(t):
    other = F.concat("case_name", F.lit(" "), X.text_or_empty("text_excerpt"))
    return t.cases.select("id", F.round(X.text_similarity("full_text", other), 6).alias("similarity"))


@query("txt22_point_similarity")
def txt22(t):
    points = t.cases.select("id", X.key_points(X.sentences("full_text")).alias("a"),
                            X.key_points(X.sentences("text_excerpt")).alias("b"))
    return points.select("id", F.round(X.point_similarity("a", "b"), 6).alias("similarity"))


@query(
    "txt23_claim_numbers",
    views=("office_actions",),
    sql="""SELECT publicationNumber, array_to_string(list_sort(list_distinct(list_concat(
      generate_series(split_part(relatedClaimNumberText, '-', 1)::INT, split_part(split_part(relatedClaimNumberText, '-', 2), ',', 1)::INT),
      [trim(split_part(relatedClaimNumberText, ',', 2))::INT]))), ',') AS claims FROM office_actions""",
)
def txt23(t):
    return t.office_actions.select(
        "publicationNumber", F.array_join(P.claim_numbers("relatedClaimNumberText").cast("array<string>"), ",").alias("claims")
    )


@query(
    "txt24_rejection_types",
    views=("office_actions",),
    sql=r"""SELECT publicationNumber, array_to_string(list_sort(list_distinct(regexp_extract_all(
      lower(coalesce(passageLocationText, '')), '(?:section|§|\bc\.?\s*)(101|102|103|112)\b', 1))), ',') AS rejections
      FROM office_actions""",
)
def txt24(t):
    return t.office_actions.select(
        "publicationNumber", F.array_join(P.rejection_types("passageLocationText"), ",").alias("rejections")
    )


_PARTS = """list_transform(string_split(trim(passageLocationText, '[]'''), '|'), lambda p: lower(trim(p)))"""


def sql_parts(*terms: str) -> str:
    test = " OR ".join(f"contains(p, '{t}')" for t in terms)
    return f"coalesce(len(list_filter(parts, lambda p: {test})), 0)"


@query(
    "txt25_passage_features",
    views=("office_actions",),
    sql=f""", p AS (SELECT publicationNumber, {_PARTS} AS parts FROM office_actions)
      SELECT publicationNumber, coalesce(len(parts), 0) AS num_passages, {sql_parts('claim')} AS num_claims_cited,
        {sql_parts('paragraph', 'par.')} AS num_paragraphs_cited, {sql_parts('figure', 'fig.')} AS num_figures_cited,
        {sql_parts('paragraph', 'par.')} > 0 AS has_spec_support FROM p""",
)
def txt25(t):
    return t.office_actions.select("publicationNumber", P.passage_features("passageLocationText").alias("f")).select(
        "publicationNumber", "f.*")


SQL_FLAG = "coalesce(upper({}) = 'TRUE', false)"


@query(
    "txt26_claim_features",
    views=("office_actions",),
    sql=f""", p AS (SELECT *, {_PARTS} AS parts FROM office_actions)
      SELECT publicationNumber, 1::BIGINT AS num_citations, coalesce(len(parts), 0) AS num_passage_locations,
        {SQL_FLAG.format('examinerCitedReferenceIndicator')} AS has_examiner_citation,
        {SQL_FLAG.format('applicantCitedExaminerReferenceIndicator')} AS has_applicant_citation,
        {SQL_FLAG.format('nplIndicator')} AS is_npl, techCenter::BIGINT AS tech_center,
        {sql_parts('103')} > 0 AS has_103_rejection, {sql_parts('102')} > 0 AS has_102_rejection,
        {sql_parts('112')} > 0 AS has_112_rejection, {sql_parts('claim')} AS num_claim_citations,
        {sql_parts('paragraph', 'par.')} AS num_paragraph_citations, {sql_parts('figure', 'fig.')} AS num_figure_citations
      FROM p""",
)
def txt26(t):
    f = claim_feature_column()
    return t.office_actions.select("publicationNumber", f.alias("f")).select("publicationNumber", "f.*")


def claim_feature_column():
    return P.claim_features(
        "examinerCitedReferenceIndicator", "applicantCitedExaminerReferenceIndicator", "nplIndicator", "techCenter",
        "passageLocationText",
    )


@query(
    "txt27_has_rejection",
    views=("office_actions",),
    sql="""SELECT publicationNumber, coalesce(contains(passageLocationText, 'c. 103') OR contains(passageLocationText, 'c.103')
      OR contains(passageLocationText, 'c. 102') OR contains(passageLocationText, 'c.102'), false) AS rejected FROM office_actions""",
)
def txt27(t):
    return t.office_actions.select("publicationNumber", P.has_rejection("passageLocationText").alias("rejected"))


def sql_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


SQL_TYPE = "CASE " + " ".join(
    f"WHEN {sql_any('q', terms)} THEN '{kind}'" for kind, terms in lexicons.QUERY_TYPES
) + " ELSE 'general' END"
SQL_SECTIONS = "list_filter([" + ", ".join(
    f"CASE WHEN {sql_any('q', terms)} THEN '{s}' END" for s, terms in lexicons.SECTION_PATTERNS
) + "], lambda s: s IS NOT NULL)"


def _sql_position(terms) -> str:
    return "list_min([" + ", ".join(f"nullif(coalesce(list_position(tokens, '{t}'), 0), 0)" for t in terms) + "])"


SQL_QUESTION = rf""", a AS (SELECT conv_id, turn, lower(question) AS q FROM patent_questions),
  b AS (SELECT *, regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS tokens FROM a),
  c AS (SELECT *, {SQL_TYPE} AS query_type, {SQL_SECTIONS} AS sections,
    {_sql_position(lexicons.FIELD_INDICATORS)} AS field_at, {_sql_position(lexicons.CLAIM_INDICATORS)} AS claim_at FROM b),
  d AS (SELECT *, CASE WHEN field_at IS NOT NULL THEN nullif(array_to_string(list_slice(tokens, field_at + 1, field_at + 3), ' '), '') END AS technical_field,
    CASE WHEN claim_at IS NOT NULL THEN array_to_string(list_slice(tokens, greatest(claim_at - 2, 1), claim_at + 14), ' ') END AS claim_text,
    regexp_extract_all(q, '{lexicons.PATENT_NUMBER}') AS refs FROM c),
  e AS (SELECT *, CASE """ + " ".join(
    f"WHEN contains(technical_field, '{term}') THEN '{center}'" for term, center in lexicons.TECH_CENTER_BY_FIELD
) + " ELSE '2100' END AS tech_center FROM d) "


def parsed_questions(t):
    q = t.patent_questions.withColumn("tokens", P.question_tokens("question"))
    return q.withColumns(
        {"query_type": P.question_type("question"), "sections": P.question_rejections("question"),
         "technical_field": P.technical_field("tokens"), "claim_text": P.claim_span("tokens"),
         "refs": P.cited_patents("question")}
    ).withColumn("tech_center", P.tech_center_of("technical_field"))


@query(
    "txt28_question_tags",
    views=("patent_questions",),
    sql=SQL_QUESTION + """SELECT conv_id, turn, query_type, array_to_string(sections, ',') AS sections, tech_center,
      array_to_string(refs, ',') AS refs FROM e""",
)
def txt28(t):
    return parsed_questions(t).select(
        "conv_id", "turn", "query_type", F.array_join("sections", ",").alias("sections"), "tech_center",
        F.array_join("refs", ",").alias("refs"),
    )


@query("txt29_question_windows", views=("patent_questions",),
       sql=SQL_QUESTION + "SELECT conv_id, turn, technical_field, claim_text FROM e")
def txt29(t):
    return parsed_questions(t).select("conv_id", "turn", "technical_field", "claim_text")


def structured_questions(t):
    """Questions as office-action rows with neutral defaults."""
    return parsed_questions(t).withColumns(
        {"examinerCitedReferenceIndicator": F.lit("FALSE"), "applicantCitedExaminerReferenceIndicator": F.lit("FALSE"),
         "nplIndicator": F.lit("FALSE"), "techCenter": F.col("tech_center"),
         "passageLocationText": P.quoted_list("sections", "c. "), "publicationNumber": F.lit(None).cast("string"),
         "citedDocumentIdentifier": F.lit(None).cast("string")}
    )


@query(
    "txt30_structured_questions",
    views=("patent_questions",),
    sql=SQL_QUESTION + """SELECT conv_id, turn, 'FALSE' AS examinerCitedReferenceIndicator, tech_center AS techCenter,
      '[' || array_to_string(list_transform(sections, lambda s: '''c. ' || s || ''''), ', ') || ']' AS passageLocationText,
      NULL::VARCHAR AS publicationNumber FROM e""",
)
def txt30(t):
    return structured_questions(t).select(
        "conv_id", "turn", "examinerCitedReferenceIndicator", "techCenter", "passageLocationText", "publicationNumber"
    )


_ENTITIES = " UNION ALL ".join(
    "SELECT id, '{0}' AS kind, unnest(list_distinct(list_concat(regexp_extract_all(full_text, '{1}', 1), {2}))) AS name FROM cases".format(
        kind, pattern, "CASE WHEN contains(full_text, 'Federal Circuit') THEN ['Federal Circuit'] ELSE []::VARCHAR[] END" if kind == "ORG" else "[]::VARCHAR[]")
    for kind, pattern in X.ENTITY_PATTERNS.items()
)


@query("txt31_entities", views=("cases",), sql=f", f AS ({_ENTITIES}) SELECT id, kind, name FROM f")
def txt31(t):
    found = t.cases.select("id", X.entities("full_text", {"ORG": ("Federal Circuit",)}).alias("e"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"e.{k}").alias("names")) for k in X.ENTITY_PATTERNS])
    return found.select("id", F.explode(kinds).alias("k")).select("id", "k.kind", F.explode("k.names").alias("name"))


@query(
    "txt31_name_table",
    sql=r"""WITH names AS (SELECT DISTINCT lang AS kind, regexp_extract(text, '^[^ \n]+ [^ \n]+ [^ \n]+') AS name FROM documents)
      SELECT doc_id, kind, name FROM documents JOIN names ON name <> '' AND contains(text, name)""",
)
def txt31_names(t):
    """The first three words of every document as a table of names, looked for in all documents."""
    opening = F.regexp_extract("text", r"^[^ \n]+ [^ \n]+ [^ \n]+", 0)
    names = t.documents.select(F.col("lang").alias("kind"), opening.alias("name"))
    return name_matches(t.documents, "doc_id", "text", names).select("doc_id", "kind", "name")


@query(
    "txt32_parties",
    views=("cases",),
    sql="""SELECT id, CASE WHEN len(string_split(case_name, ' v. ')) = 2 THEN trim(split_part(case_name, ' v. ', 1)) ELSE '' END AS plaintiff,
      CASE WHEN len(string_split(case_name, ' v. ')) = 2 THEN trim(split_part(case_name, ' v. ', 2)) ELSE '' END AS defendant FROM cases""",
)
def txt32(t):
    return t.cases.select("id", X.parties("case_name").alias("p")).select("id", "p.*")


@query(
    "txt33_procedural_events",
    views=("cases",),
    sql="""SELECT id, strftime(date_filed, '%Y-%m-%d') || ' filed' || CASE WHEN row_no % 3 = 0 THEN '' ELSE ','
      || strftime(date_terminated, '%Y-%m-%d') || ' terminated' END AS events FROM cases""",
)
def txt33(t):
    ended = F.when(F.col("row_no") % 3 != 0, F.col("date_terminated"))
    events = X.procedural_events(filed="date_filed", terminated=ended, argued=F.lit(None).cast("date"))
    flat = F.transform(events, lambda e: F.concat_ws(" ", F.date_format(e["date"], "yyyy-MM-dd"), e["event_type"]))
    return t.cases.select("id", F.array_join(flat, ",").alias("events"))


@query(
    "txt34_party_records",
    sql="""SELECT c_custkey, c_name AS name, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, 'Not Available') AS role,
      'Not Available' AS type, c_mktsegment || ',' || c_name AS attorneys FROM customer""",
)
def txt34(t):
    lawyers = F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.col("c_name").alias("name")))
    record = X.party_record(
        "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), F.lit(None).cast("string"), lawyers
    )
    return t.customer.select("c_custkey", record.alias("r")).select(
        "c_custkey", "r.name", "r.role", "r.type", F.array_join("r.attorneys", ",").alias("attorneys")
    )


@query(
    "txt35_normalised_name",
    views=("cases",),
    sql="SELECT id, lower(trim(regexp_replace('  ' || case_name || ' ', '\\s+', ' ', 'g'))) AS name FROM cases",
)
def txt35(t):
    return t.cases.select("id", X.normalised_name(F.concat(F.lit("  "), "case_name", F.lit(" "))).alias("name"))


@query(
    "dat1_filed_year",
    views=("cases",),
    sql="SELECT id, year(date_filed)::INT AS year FROM cases WHERE row_no % 10 <> 4",
)
def dat1(t):
    raw = F.when(F.col("row_no") % 10 == 4, "not a date").otherwise(F.date_format("date_filed", "yyyy-MM-dd"))
    return t.cases.select("id", X.filed_year(raw).alias("year")).where(F.col("year").isNotNull())


@query(
    "dat2_date_relevance",
    views=("cases",),
    sql="""SELECT id, round(CASE WHEN row_no % 10 = 4 THEN 0.5::DOUBLE ELSE date_diff('day', DATE '2000-01-01', date_filed)::DOUBLE
      / date_diff('day', DATE '2000-01-01', DATE '2025-01-01') END, 6) AS relevance FROM cases""",
)
def dat2(t):
    raw = F.when(F.col("row_no") % 10 == 4, "unknown").otherwise(F.date_format("date_filed", "yyyy-MM-dd"))
    return t.cases.select("id", F.round(X.date_relevance(raw), 6).alias("relevance"))


SQL_LEVEL = "CASE WHEN p > 0.8 THEN 'High' WHEN p > 0.6 THEN 'Medium' ELSE 'Low' END"


@query(
    "mth1_risk_advice",
    views=("office_actions",),
    sql=f""", x AS (SELECT publicationNumber, l_p AS p, {_PARTS} AS parts FROM
        (SELECT *, (CAST(substr(publicationNumber, 3) AS BIGINT) % 100)::DOUBLE / 100 AS l_p FROM office_actions))
      SELECT publicationNumber, p, {SQL_LEVEL} AS level, concat_ws('|',
        CASE WHEN p > 0.7 THEN 'High risk of rejection. Consider reviewing prior art thoroughly.' END,
        CASE WHEN p > 0.7 AND {sql_parts('103')} > 0 THEN 'Potential obviousness issues detected. Consider strengthening non-obviousness arguments.' END,
        CASE WHEN p > 0.7 AND {sql_parts('102')} > 0 THEN 'Potential novelty issues detected. Review cited prior art carefully.' END,
        CASE WHEN {sql_parts('claim')} > 5 THEN 'Multiple claim citations detected. Consider narrowing claim scope.' END,
        CASE WHEN {sql_parts('paragraph', 'par.')} = 0 THEN 'No paragraph citations found. Consider adding more detailed support from specification.' END
        ) AS claim_advice, concat_ws('|',
        CASE WHEN p > 0.7 THEN 'High risk of rejection - detailed review recommended' WHEN p > 0.5 THEN 'Moderate risk - consider strengthening claim language' END,
        CASE WHEN {sql_parts('paragraph', 'par.')} = 0 THEN 'Add more detailed support from specification' END,
        CASE WHEN {sql_parts('claim')} > 5 THEN 'High number of claim citations - consider narrowing scope' END) AS passage_advice FROM x""",
)
def mth1(t):
    p = (F.substring("publicationNumber", 3, 20).cast("long") % 100).cast("double") / 100
    rows = t.office_actions.select("publicationNumber", p.alias("p"), claim_feature_column().alias("c"),
                                   P.passage_features("passageLocationText").alias("f"))
    return rows.select(
        "publicationNumber", "p", P.confidence_level("p").alias("level"),
        F.array_join(P.claim_recommendations("p", "c"), "|").alias("claim_advice"),
        F.array_join(P.passage_recommendations("p", "f"), "|").alias("passage_advice"),
    )


@query(
    "mth2_explanations",
    views=("patent_questions",),
    sql=SQL_QUESTION + """, f AS (SELECT *, (conv_id * 7 + turn) % 100 / 100.0::DOUBLE AS p FROM e)
      SELECT conv_id, turn, CASE WHEN query_type <> 'patentability' THEN 'Analysis complete. See detailed results below.'
        WHEN p > 0.7 THEN 'Based on the analysis, this invention may face significant patentability challenges.'
        WHEN p > 0.4 THEN 'The invention shows promise but may need refinement to improve patentability.'
        ELSE 'Initial analysis suggests favorable patentability prospects.' END AS summary,
      coalesce(nullif(concat_ws(' ', CASE WHEN list_contains(sections, '103') THEN 'Potential obviousness concerns identified.' END,
        CASE WHEN list_contains(sections, '102') THEN 'Novelty issues may need to be addressed.' END,
        CASE WHEN list_contains(sections, '112') THEN 'Clarity or written description issues detected.' END), ''),
        'No significant technical issues identified.') AS technical_analysis,
      concat_ws('|', CASE WHEN p > 0.7 THEN 'High risk of rejection - detailed review recommended' END,
        CASE WHEN p > 0.7 AND list_contains(sections, '103') THEN 'Potential obviousness issues - consider strengthening non-obviousness arguments' END,
        CASE WHEN p > 0.7 AND list_contains(sections, '102') THEN 'Potential novelty issues - review prior art carefully' END,
        CASE WHEN p > 0.5 AND p <= 0.7 THEN 'Moderate risk - consider strengthening claim language' END,
        CASE WHEN query_type = 'patentability' AND len(refs) = 0 THEN 'Consider conducting a thorough prior art search.' END,
        CASE WHEN technical_field IS NOT NULL THEN 'Review recent patents in ' || technical_field || ' for potential prior art.' END) AS advice
      FROM f""",
)
def mth2(t):
    rows = structured_questions(t).withColumn("p", (F.col("conv_id") * 7 + F.col("turn")) % 100 / 100.0)
    rows = rows.withColumn("c", claim_feature_column())
    advice = P.context_recommendations(
        P.question_recommendations("p", "sections"), "query_type", "refs", "technical_field"
    )
    return rows.select(
        "conv_id", "turn", P.summary_text("p", "query_type").alias("summary"),
        P.technical_analysis("c").alias("technical_analysis"), F.array_join(advice, "|").alias("advice"),
    )
