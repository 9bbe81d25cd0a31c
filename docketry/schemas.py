"""Explicit schemas; nothing is inferred from files."""

from pyspark.sql import types as T

_S, _L, _I, _D, _DATE, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.DateType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CASES = _struct(
    id=_S, case_name=_S, case_name_full=_S, date_filed=_DATE, date_argued=_DATE, date_reargued=_DATE,
    date_terminated=_DATE, court=_S, court_id=_S, docket_number=_S, docket_id=_S, judge=_S,
    precedential_status=_S, suit_nature=_S, procedural_history=_S, syllabus=_S, citation_count=_L,
    text_excerpt=_S, full_text=_S, tech_relevance_score=_D, tech_keywords_found=_S,
)

# Raw files hold every field as text; operators coerce with try_* functions.
CASES_RAW = T.StructType([T.StructField(f.name, _S) for f in CASES.fields])

OFFICE_ACTIONS = _struct(
    publicationNumber=_S, patentApplicationNumber=_S, citedDocumentIdentifier=_S, countryCode=_S, kindCode=_S,
    techCenter=_I, groupArtUnitNumber=_I, workGroupNumber=_I, officeActionDate=_TS, createDateTime=_TS,
    relatedClaimNumberText=_S, passageLocationText=_S, citationCategoryCode=_S, officeActionCategory=_S,
    qualitySummaryText=_S, inventorNameText=_S, examinerCitedReferenceIndicator=_S,
    applicantCitedExaminerReferenceIndicator=_S, nplIndicator=_S,
)

OFFICE_ACTIONS_RAW = T.StructType([T.StructField(f.name, _S) for f in OFFICE_ACTIONS.fields])

OPINION = _struct(
    plain_text=_S, html_with_citations=_S, html=_S, text_excerpt=_S, snippet=_S, download_url=_S, sha1=_S,
    type=_S, author_id=_S, cites=T.ArrayType(_S),
)

API_RESULT = _struct(
    cluster_id=_S, caseName=_S, caseNameFull=_S, dateFiled=_S, court=_S, court_id=_S, docketNumber=_S,
    docket_id=_S, judge=_S, attorney=_S, panel_names=T.ArrayType(_S), scdb_id=_S, dateArgued=_S, dateReargued=_S,
    dateReargumentDenied=_S, procedural_history=_S, syllabus=_S, posture=_S, status=_S, suitNature=_S, citeCount=_L,
    citation=T.ArrayType(_S), opinions=T.ArrayType(OPINION),
)

API_PAGE = _struct(next=_S, results=T.ArrayType(API_RESULT))

PATENT_PAGE = _struct(
    response=_struct(start=_L, numFound=_L, docs=T.ArrayType(OFFICE_ACTIONS_RAW)),
)

REQUIRED_CASE_COLUMNS = [
    "id", "case_name", "date_filed", "court", "court_id", "docket_number", "judge", "precedential_status",
    "citation_count", "text_excerpt", "full_text", "tech_relevance_score", "tech_keywords_found",
]
