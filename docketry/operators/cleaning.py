"""Cleaning, filtering and projection of case and patent tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry import lexicons, schemas
from docketry.functions import patent as P
from docketry.functions import text as X
from docketry.functions.text import any_contains, blank_to_null, col, strip_space, text_or_empty
from docketry.lexicons import NOT_AVAILABLE, TECH, TechLexicon
from docketry.session import cut_lineage
from docketry.operators.scaling import (
    broadcast_if_small, exact_quantiles, global_rank, neighbours, top_per_key,
)


def to_day(value: str | Column) -> Column:
    """A date from text, date or timestamp; unreadable becomes null."""
    return F.try_to_timestamp(col(value).cast("string")).cast("date")


# --- repair and duplicates --------------------------------------------------


def repair_misaligned(df: DataFrame, text: str, row_no: str, file: str | None = None) -> DataFrame:
    """Move text that slipped one row down back up, then drop rows without text."""
    source = df if file else df.withColumn("_file", F.lit(0))
    group = file or "_file"
    w = Window.partitionBy(group, "_block").orderBy(row_no)
    here = F.col(text)
    after, before = F.lead(text).over(w), F.lag(text).over(w)
    first = F.lag(F.lit(1)).over(w).isNull()
    moved = (
        F.when(here.isNull(), after)  # take the next row's text
        .when(before.isNull() & ~first, F.lit(None))  # gave its text to the row above
        .otherwise(here)
    )
    out = (
        neighbours(source, group, row_no)
        .withColumn("_moved", moved)
        .where(F.col("_own"))
        .withColumn(text, F.col("_moved"))
        .where(F.col(text).isNotNull())
    )
    return out.select(*df.columns)


def keep_most_complete(df: DataFrame, key: str, tie: str) -> DataFrame:
    """One row per key: the one with the most non-null columns."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return top_per_key(df.withColumn("_filled", filled), [key], [F.desc("_filled"), F.asc(tie)]).drop("_filled")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key combination, the first in ``order``."""
    return top_per_key(df, keys, order)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


# --- case tables ------------------------------------------------------------


def case_table(df: DataFrame, required: Sequence[str] = schemas.REQUIRED_CASE_COLUMNS,
               dates: Sequence[str] = ("date_filed", "date_argued", "date_reargued"),
               lists: Sequence[str] = ("tech_keywords_found", "opinion_cites", "citing_cases"),
               sort: str | None = "id") -> DataFrame:
    """Add missing columns, coerce dates, write lists as text, sort."""
    out = df.withColumns({c: F.lit(None).cast("string") for c in required if c not in df.columns})
    out = out.withColumns({c: to_day(c) for c in dates if c in out.columns})
    as_text = {}
    for c in lists:
        if c in out.columns:
            kind = out.schema[c].dataType
            as_text[c] = F.coalesce(F.to_json(c) if isinstance(kind, T.ArrayType) else F.col(c), F.lit("[]"))
    out = out.withColumns(as_text)
    return out.orderBy(sort) if sort else out


def _default(df: DataFrame, column: str, value: object) -> Column:
    """The column with ``value`` for nulls; a list becomes ``[]`` in a text column."""
    kind = df.schema[column].dataType if column in df.columns else None
    if isinstance(value, list):
        text = isinstance(kind, T.StringType)
        empty = F.lit(json.dumps(value)) if text else F.array(*map(F.lit, value)).cast(kind or T.ArrayType(T.StringType()))
    else:
        empty = F.lit(value).cast(kind or "string") if value is None else F.lit(value)
    return F.coalesce(F.col(column), empty) if kind else empty


def validated_cases(df: DataFrame, defaults: Mapping[str, object] = lexicons.CASE_DEFAULTS) -> DataFrame:
    """Fill defaults, then keep rows with a case name and a court."""
    return df.withColumns({c: _default(df, c, v) for c, v in defaults.items()}).where(
        (F.col("case_name") != "") & (F.col("court_id") != ""))


def first_appearance_codes(df: DataFrame, value: str, row_no: str) -> DataFrame:
    """Code table (value, code): 0 for the value seen first, and so on."""
    firsts = df.groupBy(value).agg(F.min(row_no).alias("_first"))
    return _coded(firsts, value, [F.col("_first")]).drop("_first")


def sorted_codes(df: DataFrame, value: str) -> DataFrame:
    """Code table (value, code) in value order; null has no code."""
    return _coded(df.where(F.col(value).isNotNull()).select(value).distinct(), value, [F.col(value)])


def _coded(values: DataFrame, value: str, order: list[Column]) -> DataFrame:
    values = cut_lineage(values)  # one row per distinct value; read again by every lookup
    return global_rank(values, order, "code").withColumn("code", F.col("code") - 1)


def with_codes(df: DataFrame, value: str, codes: DataFrame, name: str, missing: int | None = None) -> DataFrame:
    """Look codes up; the table is broadcast only after it was measured."""
    table = broadcast_if_small(codes.select(F.col(value).alias("_value"), F.col("code").alias(name)))
    out = df.join(table, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")
    return out if missing is None else out.withColumn(name, F.coalesce(F.col(name), F.lit(missing)))


def processed_raw(df: DataFrame, row_no: str, text: str = "opinion_text",
                  dates: Sequence[str] = ("date_filed", "date_created", "date_modified"),
                  categories: Sequence[str] = ("court", "nature_of_suit", "precedential_status", "jurisdiction_type"),
                  lexicon: TechLexicon = TECH, sort: bool = True) -> DataFrame:
    """Normalise collected rows: sentinel text, ISO dates, codes, log count, keyword count."""
    wanted = [c for c in (*categories, text) if c not in df.columns]
    out = df.withColumns({c: F.lit(None).cast("string") for c in wanted})
    out = out.withColumns({c: F.date_format(to_day(c), "yyyy-MM-dd") for c in dates if c in out.columns})
    out = out.na.fill(NOT_AVAILABLE)
    base = out
    for c in categories:
        if c in df.columns:
            out = with_codes(out, c, first_appearance_codes(base, c, row_no), f"{c}_encoded")
        else:  # a missing column holds one value only
            out = out.withColumn(f"{c}_encoded", F.lit(0).cast("long"))
    count = F.coalesce(F.col("citation_count").cast("string").try_cast("double"), F.lit(0.0))
    out = out.withColumn("citation_count", count).withColumn("citation_count_log", F.log1p("citation_count"))
    if sort:
        out = out.orderBy(F.desc("tech_relevance_score"), F.desc("citation_count"), F.asc(row_no))
    # After the sort, whose sampling pass would otherwise read every text too.
    return out.withColumn("tech_keyword_count", X.keyword_count(text, lexicon.primary))


TEXT_COLUMNS = ("full_text", "text_excerpt", "syllabus", "procedural_history")


def prepared_cases(df: DataFrame, texts: Sequence[str] = TEXT_COLUMNS,
                   dates: Sequence[str] = ("date_filed", "date_argued", "date_reargued"),
                   citations: str = "citations") -> DataFrame:
    """Coerce dates, blank null texts, read citation lists, keep rows with any text."""
    out = df.withColumns({c: to_day(c) for c in dates if c in df.columns})
    present = [c for c in texts if c in df.columns]
    out = out.withColumns({c: text_or_empty(c) for c in present})
    if citations in df.columns and isinstance(df.schema[citations].dataType, T.StringType):
        parsed = F.from_json(citations, "array<struct<cite:string,date:string>>", {"allowSingleQuotes": "true"})
        out = out.withColumn(citations, F.coalesce(parsed, F.array().cast("array<struct<cite:string,date:string>>")))
    return out.where(strip_space(F.concat(*present)) != "")


OPINION_TEXTS = ("plain_text", "html_with_citations", "html", "text_excerpt", "snippet")


def opinion_text(opinion: str | Column, fields: Sequence[str] = OPINION_TEXTS) -> Column:
    """The first non-blank text of an opinion, cleaned; the sentinel when there is none."""
    opinion = col(opinion)
    chosen = F.coalesce(*[blank_to_null(opinion[f]) for f in fields])
    return F.coalesce(X.strip_html(chosen), F.lit(NOT_AVAILABLE))


def flattened_results(results: DataFrame, lexicon: TechLexicon = TECH, min_early: float = 0.05) -> DataFrame:
    """One case row per nested result; rows with little early relevance are dropped.

    Early relevance reads names and opinion snippets; the final score reads the
    name, the syllabus, the procedural history and the selected opinion text.
    """
    first = F.get("opinions", F.lit(0))
    opinion_texts = F.flatten(
        F.transform(
            F.coalesce(F.col("opinions"), F.array().cast(results.schema["opinions"].dataType)),
            lambda o: F.array(F.nullif(o["snippet"], F.lit("")), X.strip_html(F.nullif(o["html"], F.lit("")))),
        )
    )
    early = F.concat_ws(
        " ",
        *[F.nullif(F.col(c), F.lit("")) for c in ("caseName", "caseNameFull", "suitNature")],
        opinion_texts,
    )
    kept = (
        results.withColumn("_early", X.tech_relevance(early, lexicon))
        .where(F.col("_early") >= min_early)
        .withColumn("_opinion", first)
        .withColumn("full_text", opinion_text("_opinion"))
    )
    content = F.concat_ws(
        " ", *[F.nullif(F.col(c), F.lit("")) for c in ("caseName", "syllabus", "procedural_history", "full_text")])
    kept = kept.withColumn("_content", content)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return kept.select(
        blank("cluster_id").alias("id"),
        blank("caseName").alias("case_name"),
        blank("caseNameFull").alias("case_name_full"),
        blank("dateFiled").alias("date_filed"),
        blank("court").alias("court"),
        blank("court_id").alias("court_id"),
        blank("docketNumber").alias("docket_number"),
        blank("docket_id").alias("docket_id"),
        blank("judge").alias("judge"),
        blank("attorney").alias("attorney"),
        F.coalesce("panel_names", F.array().cast("array<string>")).alias("panel_names"),
        blank("scdb_id").alias("scdb_id"),
        blank("dateArgued").alias("date_argued"),
        blank("dateReargued").alias("date_reargued"),
        blank("dateReargumentDenied").alias("date_reargument_denied"),
        blank("procedural_history").alias("procedural_history"),
        blank("syllabus").alias("syllabus"),
        blank("posture").alias("posture"),
        blank("status").alias("precedential_status"),
        F.coalesce("citeCount", F.lit(0)).cast("long").alias("citation_count"),
        F.coalesce("citation", F.array().cast("array<string>")).alias("citations"),
        blank("suitNature").alias("suit_nature"),
        blank("_opinion.download_url").alias("opinion_url"),
        blank("_opinion.sha1").alias("opinion_sha1"),
        blank("_opinion.type").alias("opinion_type"),
        blank("_opinion.author_id").alias("opinion_author_id"),
        F.coalesce("_opinion.cites", F.array().cast("array<string>")).alias("opinion_cites"),
        blank("_opinion.snippet").alias("snippet"),
        "full_text",
        X.tech_relevance("_content", lexicon).alias("tech_relevance_score"),
        X.matching_keywords("_content", lexicon).alias("tech_keywords_found"),
    )


# --- patents ----------------------------------------------------------------


def cleaned_patents(df: DataFrame) -> DataFrame:
    """Timestamps, boolean flags, and blank instead of null text."""
    stamps = {c: F.try_to_timestamp(F.col(c).cast("string"))
              for c in ("officeActionDate", "createDateTime") if c in df.columns}
    flags = {c: P.flag(c) for c in ("applicantCitedExaminerReferenceIndicator", "examinerCitedReferenceIndicator",
                                    "nplIndicator") if c in df.columns}
    texts = {c: text_or_empty(c) for c in ("inventorNameText", "citedDocumentIdentifier", "passageLocationText")
             if c in df.columns}
    return df.withColumns({**stamps, **flags, **texts})


def loaded_patents(df: DataFrame) -> DataFrame:
    """Coerce dates and add parsed claim numbers and rejection types."""
    stamps = {c: F.try_to_timestamp(F.col(c).cast("string"))
              for c in ("officeActionDate", "createDateTime") if c in df.columns}
    return df.withColumns(
        {**stamps, "claim_numbers": P.claim_numbers("relatedClaimNumberText"),
         "rejection_types": P.rejection_types("passageLocationText")}
    )


def patent_predicate(date_range: tuple[str, str] | None = None, tech_center: int | str | None = None,
                     citation_category: str | None = None, inventor: str | None = None) -> Column:
    """The conditions given, joined by AND; none given selects every row.

    Bounds stay plain comparisons on stored columns so that they reach the scan.
    """
    test = F.lit(True)
    if date_range:
        start, end = date_range
        test = test & (F.col("officeActionDate") >= F.lit(start).cast("timestamp_ntz"))
        test = test & (F.col("officeActionDate") <= F.lit(end).cast("timestamp_ntz"))
    if tech_center is not None:
        test = test & (F.col("techCenter") == int(tech_center))
    if citation_category:
        test = test & (F.col("citationCategoryCode") == citation_category)
    if inventor:
        test = test & (F.col("inventorNameText") == inventor)
    return test


def tech_patents(df: DataFrame, start: str, end: str,
                 centers: Sequence[int] = lexicons.TECH_CENTERS) -> DataFrame:
    """Office actions of a date range in the given tech centres."""
    in_range = patent_predicate((f"{start} 00:00:00", f"{end} 23:59:59"))
    return df.where(in_range & F.col("techCenter").isin(*[int(c) for c in centers]))


# --- filters ----------------------------------------------------------------


def relevant_cases(df: DataFrame, start: str | None = None, end: str | None = None,
                   min_relevance: float = 0.2) -> DataFrame:
    test = F.col("tech_relevance_score") >= min_relevance
    if start:
        test = test & (F.col("date_filed") >= F.lit(start).cast("date"))
    if end:
        test = test & (F.col("date_filed") <= F.lit(end).cast("date"))
    return df.where(test)


def long_enough(df: DataFrame, text: str, minimum: int) -> DataFrame:
    return df.where(F.length(strip_space(F.col(text))) >= minimum)


def search_groups(df: DataFrame, text: str, groups: Sequence[Sequence[str]] = lexicons.SEARCH_GROUPS) -> DataFrame:
    """One row per case and matching group; groups are read in a single pass."""
    hits = X.let(
        F.lower(text_or_empty(text)),
        lambda t: F.array_compact(
            F.array(*[F.when(any_contains(t, terms), F.lit(i)) for i, terms in enumerate(groups)])
        ),
    )
    return df.withColumn("group_id", F.explode(hits))


# --- projections ------------------------------------------------------------


def combined_text(*columns: str) -> Column:
    """Columns joined by one space each; null counts as empty text."""
    return F.concat_ws(" ", *[text_or_empty(c) for c in columns])


def joined_text(*columns: str) -> Column:
    """Non-empty columns joined by a space."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns])


def quantile_labels(df: DataFrame, column: str, name: str,
                    labels: Sequence[str] = lexicons.QUINTILE_LABELS, fallback: str = "Unknown") -> DataFrame:
    """Right-closed quantile bins; null counts as 0, repeated edges give the fallback."""
    value = F.coalesce(F.col(column), F.lit(0.0))
    q = len(labels)
    edges = exact_quantiles(df.select(value.alias("_v")), "_v", [i / q for i in range(q + 1)])
    if len(set(edges)) < len(edges):
        return df.withColumn(name, F.lit(fallback))
    out = F.lit(None).cast("string")
    for upper, label in reversed(list(zip(edges[1:], labels))):
        out = F.when(value <= F.lit(upper), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


def derived_features(df: DataFrame, categories: Sequence[str] = ("court_id", "precedential_status", "suit_nature")) -> DataFrame:
    """Duration, citation and court features, excerpt length, sorted category codes."""
    out = df.withColumns(
        {
            "case_duration": F.datediff("date_terminated", "date_filed").cast("long"),
            "has_citations": F.col("citation_count") > 0,
            "citation_score": F.log1p(F.col("citation_count").cast("double")),
            "is_appellate": F.col("court_id").isin(*lexicons.CIRCUIT_COURTS),
            "opinion_length": F.length("text_excerpt").cast("long"),
        }
    )
    for c in categories:
        out = with_codes(out, c, sorted_codes(df, c), f"{c}_encoded", missing=-1)
    return out


def court_level(court: str | Column) -> Column:
    """Court level from a fixed table of under twenty courts; unknown courts are 1."""
    levels = F.create_map(*[F.lit(v) for kv in lexicons.COURT_LEVELS.items() for v in kv])
    return F.coalesce(F.element_at(levels, col(court)), F.lit(1)).cast("long")


def court_levels(df: DataFrame, levels: DataFrame, court: str = "court_id") -> DataFrame:
    """Court level from a table (court_id, level)."""
    side = broadcast_if_small(levels.select(F.col("court_id").alias("_court"), F.col("level").alias("court_level")))
    out = df.join(side, F.col(court) == F.col("_court"), "left").drop("_court")
    return out.withColumn("court_level", F.coalesce("court_level", F.lit(1)).cast("long"))


def numeric_features(df: DataFrame) -> DataFrame:
    year = F.coalesce(X.filed_year("date_filed"), F.lit(2020)).cast("long")
    return df.withColumns(
        {
            "text_length": F.length("text_excerpt").cast("long"),
            "title_length": F.length("case_name").cast("long"),
            "citation_count": F.coalesce(F.col("citation_count").cast("string").try_cast("double"), F.lit(0.0)),
            "year": year,
        }
    )


def inferred_status(court: str = "court_id", status: str = "precedential_status", count: str = "citation_count") -> Column:
    precedential = (F.col(court) == "cafc") | (F.col(status) == "Published") | (F.col(count) > 5)
    return F.when(precedential, "Precedential").otherwise("Non-Precedential")


def normalised_status(status: str | Column, count: str | Column, source: str | Column) -> Column:
    """Published or Unpublished; the negative wording is tested first."""
    lowered = F.lower(col(status))
    return (
        F.when(any_contains(lowered, ("unpublished", "non-precedential")), "Unpublished")
        .when(any_contains(lowered, ("published", "precedential")), "Published")
        .when(F.coalesce(col(count), F.lit(0)) > 5, "Published")
        .when(col(source) == "C", "Published")
        .otherwise(NOT_AVAILABLE)
    )


def excerpt(value: str | Column, length: int = 300) -> Column:
    return F.substring(col(value), 1, length)


def percentage(value: str | Column) -> Column:
    return F.round(col(value) * 100.0, 1)
