"""Office-action and patent-question features as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import lexicons
from docketry.functions.text import any_contains, col, let, strip_space, text_or_empty


def flag(value: str | Column) -> Column:
    """Text or boolean flag: true only for TRUE in any case."""
    return F.coalesce(F.upper(col(value).cast("string")) == "TRUE", F.lit(False))


def claim_numbers(value: str | Column) -> Column:
    """``1-3, 7`` to sorted distinct numbers.

    A malformed range empties the whole list; a malformed single is skipped.
    """
    empty = F.array().cast("array<int>")

    def expand(part: Column) -> Column:
        ends = F.transform(F.split(part, "-"), lambda e: e.try_cast("int"))
        low, high = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        # A null list marks a malformed range, and makes the flattened list null.
        spanned = F.when(F.size(ends) == 2, F.when(low <= high, F.sequence(low, high)).when(low > high, empty))
        single = part.try_cast("int")
        return F.when(F.contains(part, F.lit("-")), spanned).when(single.isNotNull(), F.array(single)).otherwise(empty)

    parts = F.transform(F.split(text_or_empty(value), ","), expand)
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(parts))), empty)


def rejection_types(value: str | Column, allow_space: bool = False) -> Column:
    """Statute sections named in the text, sorted and distinct.

    By default ``section 103`` with a space does not count, ``section103`` does.
    """
    pattern = lexicons.REJECTION_REFERENCE_SPACED if allow_space else lexicons.REJECTION_REFERENCE
    return F.array_sort(
        F.array_distinct(
            F.regexp_extract_all(F.lower(text_or_empty(value)), F.lit("(?U)" + pattern), F.lit(1))
        )
    )


def passages(value: str | Column) -> Column:
    """Passage text to its parts; null gives none, empty text one empty part."""
    parts = F.transform(F.split(F.btrim(col(value), F.lit("[]'")), r"\|"), strip_space)
    return F.coalesce(parts, F.array().cast("array<string>"))


def _count_any(parts: Column, terms: Sequence[str]) -> Column:
    return F.size(F.filter(parts, lambda p: any_contains(F.lower(p), terms))).cast("long")


def passage_features(value: str | Column) -> Column:
    parts = passages(value)
    paragraphs = _count_any(parts, ("paragraph", "par."))
    return F.struct(
        F.size(parts).cast("long").alias("num_passages"),
        _count_any(parts, ("claim",)).alias("num_claims_cited"),
        paragraphs.alias("num_paragraphs_cited"),
        _count_any(parts, ("figure", "fig.")).alias("num_figures_cited"),
        (paragraphs > 0).alias("has_spec_support"),
    )


def claim_features(examiner: str | Column, applicant: str | Column, npl: str | Column, center: str | Column,
                   location: str | Column) -> Column:
    parts = passages(location)

    def mentions(section: str) -> Column:
        return F.exists(parts, lambda p: F.contains(p, F.lit(section)))

    return F.struct(
        F.lit(1).cast("long").alias("num_citations"),
        F.size(parts).cast("long").alias("num_passage_locations"),
        flag(examiner).alias("has_examiner_citation"),
        flag(applicant).alias("has_applicant_citation"),
        flag(npl).alias("is_npl"),
        F.coalesce(col(center).try_cast("long"), F.lit(0).cast("long")).alias("tech_center"),
        mentions("103").alias("has_103_rejection"),
        mentions("102").alias("has_102_rejection"),
        mentions("112").alias("has_112_rejection"),
        _count_any(parts, ("claim",)).alias("num_claim_citations"),
        _count_any(parts, ("paragraph", "par.")).alias("num_paragraph_citations"),
        _count_any(parts, ("figure", "fig.")).alias("num_figure_citations"),
    )


def has_rejection(value: str | Column, sections: Sequence[str] = ("103", "102")) -> Column:
    """Training label: a ``c. 103`` or ``c.103`` style mark."""
    return any_contains(text_or_empty(value), [f"c.{gap}{s}" for s in sections for gap in (" ", "")])


# --- questions --------------------------------------------------------------


def question_type(question: str | Column) -> Column:

    def kind_of(lowered: Column) -> Column:
        out = F.lit("general")
        for kind, terms in reversed(lexicons.QUERY_TYPES):
            out = F.when(any_contains(lowered, terms), F.lit(kind)).otherwise(out)
        return out

    return let(F.lower(text_or_empty(question)), kind_of)


def question_rejections(question: str | Column) -> Column:
    return let(
        F.lower(text_or_empty(question)),
        lambda q: F.array_compact(
            F.array(*[F.when(any_contains(q, terms), F.lit(s)) for s, terms in lexicons.SECTION_PATTERNS])
        ),
    )


def question_tokens(question: str | Column) -> Column:
    """Words and single punctuation marks, lower case."""
    return F.regexp_extract_all(
        F.lower(text_or_empty(question)), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)
    )


def _first_position(tokens: Column, terms: Sequence[str]) -> Column:
    """Position, from 1, of the first token that is one of the terms; null if none."""
    return F.array_min(
        F.array_compact(F.array(*[F.nullif(F.array_position(tokens, t), F.lit(0)) for t in terms]))
    ).cast("int")


def technical_field(tokens: str | Column, window: int = 3) -> Column:
    """The tokens that follow the first field indicator."""

    def following(t: Column) -> Column:
        at = _first_position(t, lexicons.FIELD_INDICATORS)
        return F.when(at.isNotNull(), F.nullif(F.concat_ws(" ", F.slice(t, at + 1, window)), F.lit("")))

    return let(col(tokens), following)


def claim_span(tokens: str | Column, before: int = 2, after: int = 15) -> Column:
    """Tokens around the first claim indicator."""

    def around(t: Column) -> Column:
        at = _first_position(t, lexicons.CLAIM_INDICATORS)
        first = F.greatest(at - before, F.lit(1))
        return F.when(at.isNotNull(), F.concat_ws(" ", F.slice(t, first, at + after - first)))

    return let(col(tokens), around)


def tech_center_of(field: str | Column, default: str = "2100") -> Column:
    lowered = F.lower(col(field))
    out = F.lit(default)
    for term, center in reversed(lexicons.TECH_CENTER_BY_FIELD):
        out = F.when(F.contains(lowered, F.lit(term)), F.lit(center)).otherwise(out)
    return out


def cited_patents(question: str | Column) -> Column:
    """Patent numbers in the lower-cased question, in order."""
    return F.regexp_extract_all(
        F.lower(text_or_empty(question)), F.lit(lexicons.PATENT_NUMBER), F.lit(0)
    )


def quoted_list(items: str | Column, prefix: str = "") -> Column:
    """A list as bracketed, single-quoted text."""
    quoted = F.transform(col(items), lambda x: F.concat(F.lit("'" + prefix), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


# --- advice -----------------------------------------------------------------


def confidence_level(probability: str | Column) -> Column:
    p = col(probability)
    return F.when(p > 0.8, "High").when(p > 0.6, "Medium").otherwise("Low")


def _notes(*pairs: tuple[Column, str | Column]) -> Column:
    return F.array_compact(
        F.array(*[F.when(test, note if isinstance(note, Column) else F.lit(note)) for test, note in pairs])
    )


def claim_recommendations(probability: str | Column, features: str | Column) -> Column:
    """Advice from claim features and the probability of rejection."""
    p, f, said = col(probability), col(features), lexicons.CLAIM_ADVICE
    risky = p > 0.7
    return _notes(
        (risky, said["risk"]),
        (risky & f["has_103_rejection"], said["103"]),
        (risky & f["has_102_rejection"], said["102"]),
        (f["num_claim_citations"] > 5, said["claims"]),
        (f["num_paragraph_citations"] == 0, said["support"]),
    )


def passage_recommendations(probability: str | Column, features: str | Column) -> Column:
    """Advice from passage features and the probability of rejection."""
    p, f, said = col(probability), col(features), lexicons.PASSAGE_ADVICE
    return _notes(
        (p > 0.7, said["risk"]),
        ((p > 0.5) & (p <= 0.7), said["moderate"]),
        (~f["has_spec_support"], said["support"]),
        (f["num_claims_cited"] > 5, said["claims"]),
    )


def question_recommendations(probability: str | Column, sections: str | Column) -> Column:
    """Advice for a question from its named sections."""
    p, sections, said = col(probability), col(sections), lexicons.QUESTION_ADVICE
    risky = p > 0.7
    return _notes(
        (risky, said["risk"]),
        (risky & F.array_contains(sections, "103"), said["103"]),
        (risky & F.array_contains(sections, "102"), said["102"]),
        ((p > 0.5) & (p <= 0.7), said["moderate"]),
    )


def summary_text(probability: str | Column, kind: str | Column) -> Column:
    p, asked, said = col(probability), col(kind) == "patentability", lexicons.SUMMARIES
    return (
        F.when(asked & (p > 0.7), said["high"]).when(asked & (p > 0.4), said["middle"]).when(asked, said["low"])
        .otherwise(said["other"])
    )


def technical_analysis(features: str | Column) -> Column:
    f, said = col(features), lexicons.TECHNICAL_NOTES
    notes = _notes(*[(f[f"has_{section}_rejection"], said[section]) for section in ("103", "102", "112")])
    return F.when(F.size(notes) > 0, F.array_join(notes, " ")).otherwise(said["none"])


def context_recommendations(base: str | Column, kind: str | Column, references: str | Column,
                            field: str | Column) -> Column:
    """Advice extended by what the question asks for."""
    field = col(field)
    extra = _notes(
        ((col(kind) == "patentability") & (F.size(col(references)) == 0),
         lexicons.QUESTION_ADVICE["search"]),
        (field.isNotNull() & (field != ""),
         F.format_string(lexicons.QUESTION_ADVICE["field"].replace("{}", "%s"), field)),
    )
    return F.concat(col(base), extra)
