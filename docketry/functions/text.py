"""Text features as column expressions. No Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import lexicons
from docketry.lexicons import TECH, TechLexicon

# Unicode-aware white space and word characters, spelled out so that the same
# class means the same in Java and RE2 patterns.
SPACE = r"[\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# Markup of a page, as one scan reads it: comments, scripts and styles with their content, declarations, and
# tags whose quoted values may hold ``>``. The last form takes a tag with a quote that never closes.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))"""
_ATTRIBUTES = rf"(?:[^>=]++|=\s*+{_VALUE})*+"
MARKUP = (
    r"(?is)<!--.*?(?:--!?>|\z)"
    rf"|<(script|style)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    rf"|<!(?!--)[^>]*>|<\?[^>]*>|</(?![a-z])[^>]*>|</?[a-z]{_ATTRIBUTES}>|</?[a-z][^>]*>"
)
# Names with a semicolon, common ones first because a lookup reads the map in order; and the old names that need none.
_COMMON = ("amp;", "quot;", "lt;", "gt;", "nbsp;", "apos;", "copy;", "middot;", "ndash;", "mdash;", "rsquo;", "lsquo;", "hellip;")
_NAMED = {name: html5[name] for name in (*_COMMON, *(n for n in html5 if n.endswith(";") and n not in _COMMON))}
_BARE = {name: char for name, char in html5.items() if not name.endswith(";")}
# Numbers that stand for Windows-1252 characters, by that code page; five of them have none and stay controls.
_WINDOWS = {str(n): bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0)}


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Filters and conditional branches do not share repeated sub-expressions, so
    an expression such as ``lower(text)`` would run again for every term.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(value: str | Column) -> Column:
    return F.coalesce(col(value), F.lit(""))


def strip_space(value: Column) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(value: str | Column) -> Column:
    value = col(value)
    return F.when(F.length(strip_space(value)) > 0, value)


def word_count(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"[^\s\p{Z}]+"))


def words(value: Column) -> Column:
    """White-space separated tokens, without blanks."""
    return F.filter(F.split(value, rf"{SPACE}+"), lambda w: w != "")


def word_set(value: Column) -> Column:
    return F.array_distinct(words(F.lower(value)))


def occurrences(value: Column, phrase: str) -> Column:
    """How often ``phrase`` occurs, without overlaps."""
    left_out = F.length(value) - F.length(F.replace(value, F.lit(phrase), F.lit("")))
    return (left_out / F.lit(len(phrase))).cast("long")


def any_contains(value: Column, terms: Iterable[str]) -> Column:
    """True when any term is a substring."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(value, F.lit(term))
    return found


def count_contains(value: Column, terms: Iterable[str]) -> Column:
    """How many of the terms are substrings."""
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(value, F.lit(term)).cast("int")
    return total


def present_labels(value: Column, labelled: Iterable[tuple[str, str]]) -> Column:
    """Labels of the terms that are substrings, in the given order."""
    return F.array_compact(F.array(*[F.when(F.contains(value, F.lit(t)), F.lit(label)) for t, label in labelled]))


# --- cleaning ---------------------------------------------------------------


def strip_html(html: str | Column, separator: str = "") -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, references decoded once.

    ``separator`` stands in place of each piece of markup. Null stays null.
    """
    text = F.regexp_replace(col(html), MARKUP, separator)
    return strip_space(F.regexp_replace(let(text, decode_references), rf"{SPACE}+", " "))


def decode_references(text: Column) -> Column:
    """Named, decimal and hexadecimal character references replaced in one pass.

    What a reference yields is not read again, so ``&#38;lt;`` becomes ``&lt;``.
    Unknown names stay as they are; old names such as ``&amp`` need no semicolon.
    """
    parts = F.split(text, "&")
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _after_ampersand), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _constant_map(entries: Mapping[str, str]) -> Column:
    """A map that the optimizer folds from one literal, so that a long table adds three nodes to a plan."""
    text = "\x02".join(f"{key}\x01{value}" for key, value in entries.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def _after_ampersand(part: Column) -> Column:
    named, bare = _constant_map(_NAMED), _constant_map(_BARE)
    name = F.regexp_extract(part, r"^[A-Za-z][A-Za-z0-9]*;", 0)
    old = F.regexp_extract(part, "^(?:" + "|".join(sorted(_BARE, key=len, reverse=True)) + ")", 0)

    def rest(token: Column) -> Column:
        return F.substring(part, F.length(token) + 1, F.length(part))

    by_old = let(old, lambda o: F.when(o != "", F.concat(F.element_at(bare, o), rest(o))).otherwise(F.concat(F.lit("&"), part)))
    by_name = let(name, lambda n: F.coalesce(F.when(n != "", F.concat(F.element_at(named, n), rest(n))), by_old))
    number = F.regexp_extract(part, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
    by_number = let(number, lambda n: F.concat(let(_code_point(n), _character), rest(n)))
    return F.when(F.rlike(part, F.lit(r"^#(?:[0-9]|[xX][0-9a-fA-F])")), by_number).otherwise(by_name)


def _code_point(reference: Column) -> Column:
    """The number of a reference such as ``#233;`` or ``#xE9``; one past the last character when it is longer than 7 digits."""
    digits = F.regexp_extract(reference, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    base = F.when(F.rlike(reference, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(digits)
    return F.when(F.length(digits) > 7, F.lit(0x110000)).when(digits == "", F.lit(0)).otherwise(base.try_cast("long"))


def _character(code: Column) -> Column:
    """The character of a number; nothing for controls and for numbers that are no characters."""
    unknown = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    nothing = (
        code.between(0x1, 0x8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(unknown, "\ufffd").when(nothing, "").when(code.between(0x80, 0x9F), F.element_at(_constant_map(_WINDOWS), code.cast("string"))).otherwise(plain)


def clean_boilerplate(value: str | Column) -> Column:
    """Drop docket stamps, collapse white space, keep ordinary punctuation."""
    text = F.regexp_replace(text_or_empty(value), lexicons.DOCKET_STAMP, "")
    text = F.regexp_replace(text, rf"{SPACE}+", " ")
    text = F.regexp_replace(text, r"""[^\p{L}\p{N}_\s.,;:\-'"()]""", " ")
    return strip_space(text)


def letters_only(value: str | Column) -> Column:
    """Lower-case, with everything but ASCII letters and white space blanked."""
    return F.regexp_replace(F.lower(col(value)), r"[^a-zA-Z\s]", " ")


def normalised_name(value: str | Column) -> Column:
    return F.lower(strip_space(F.regexp_replace(col(value), rf"{SPACE}+", " ")))


# --- technology vocabulary --------------------------------------------------


def term_hits(lowered: Column, terms: Sequence[str]) -> Column:
    """Phrases count once when present; single words count at word boundaries.

    Plain words share one alternation, so a tier costs one regex pass: a match
    bounded on both sides is a whole word and equals exactly one term. Terms
    with punctuation could overlap and are counted one by one.
    """
    phrases = [t for t in terms if " " in t]
    plain = [t for t in terms if " " not in t and re.fullmatch(r"\w+", t)]
    other = [t for t in terms if " " not in t and t not in plain]
    total = count_contains(lowered, phrases)
    if plain:
        total = total + F.regexp_count(lowered, F.lit(rf"(?U)\b(?:{'|'.join(plain)})\b"))
    for term in other:
        total = total + F.regexp_count(lowered, F.lit(rf"(?U)\b\Q{term}\E\b"))
    return total


def tech_relevance(value: str | Column, lexicon: TechLexicon = TECH) -> Column:
    """Weighted term hits over the three tiers, scaled to at most 1."""

    def score(lowered: Column) -> Column:
        weighted = F.lit(0.0)
        for terms, weight in zip((lexicon.primary, lexicon.secondary, lexicon.context), lexicon.weights):
            weighted = weighted + term_hits(lowered, terms) * F.lit(weight)
        return F.least(F.lit(1.0), weighted / F.lit(lexicon.denominator))

    return let(F.lower(F.nullif(text_or_empty(value), F.lit(lexicons.NOT_AVAILABLE))), lambda t: score(text_or_empty(t)))


def is_tech_related(value: str | Column, lexicon: TechLexicon = TECH) -> Column:
    """One primary term, or two secondary terms."""
    return let(
        F.lower(text_or_empty(value)),
        lambda t: any_contains(t, lexicon.primary) | (count_contains(t, lexicon.secondary) >= 2),
    )


def matching_keywords(value: str | Column, lexicon: TechLexicon = TECH) -> Column:
    """``tier:term`` for every primary and secondary term found, in lexicon order."""
    tagged = [(t, f"primary:{t}") for t in lexicon.primary] + [(t, f"secondary:{t}") for t in lexicon.secondary]
    return let(F.lower(text_or_empty(value)), lambda t: present_labels(t, tagged))


def keyword_count(value: str | Column, terms: Sequence[str] = TECH.primary) -> Column:
    """Distinct terms present; the sentinel text counts as empty."""
    known = F.nullif(text_or_empty(value), F.lit(lexicons.NOT_AVAILABLE))
    return let(F.lower(text_or_empty(known)), lambda t: count_contains(t, terms))


def parse_string_list(raw: str | Column) -> Column:
    """A list stored as text, with single or double quotes; broken text is empty."""
    parsed = F.from_json(
        col(raw),
        "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def parse_keywords(raw: str | Column) -> Column:
    """Keyword list text to clean keywords: tier prefix off, lower case, no blanks."""
    cleaned = F.transform(
        parse_string_list(raw), lambda k: strip_space(F.lower(F.regexp_replace(k, r"^[^:]*:", "")))
    )
    return F.filter(cleaned, lambda k: k != "")


# --- legal features ---------------------------------------------------------


# A pattern that begins a word with one of some fixed texts.
_WORDS_FIRST = re.compile(r"\\b\(([a-zA-Z0-9][\w -]*(?:\|[a-zA-Z0-9][\w -]*)*)\)(?![?*{])[^|]*", re.ASCII)


def any_pattern(patterns: Sequence[str]) -> str:
    """One pattern that is found where any of them is.

    When all begin a word with fixed texts, a place is tried only at one of their first letters.
    """
    begins = [_WORDS_FIRST.fullmatch(p) for p in patterns]
    if not all(begins):
        return "|".join(patterns)
    letters = "".join(sorted({text[0] for b in begins for text in b[1].split("|")}))
    return rf"(?=[{letters}])\b(?:" + "|".join(p[2:] for p in patterns) + ")"


def has_text(value: Column) -> Column:
    """Whether anything but white space is there; null for null."""
    return value.rlike(rf"[^{SPACE[1:-1]}]")


def legal_issues(
    value: str | Column,
    period: str | Column,
    patterns: Mapping[str, Sequence[str]] = lexicons.ISSUE_PATTERNS,
    period_patterns: Mapping[tuple, tuple] = lexicons.PERIOD_ISSUE_PATTERNS,
) -> Column:
    """Issue names in alphabetical order."""
    text, period = text_or_empty(value), col(period)
    hits = {issue: text.rlike("(?iU)" + any_pattern(ps)) for issue, ps in patterns.items()}
    for periods, (issue, pattern) in period_patterns.items():
        extra = period.isin(*periods) & text.rlike("(?iU)" + any_pattern([pattern]))
        hits[issue] = hits[issue] | extra if issue in hits else extra
    return F.array_compact(F.array(*[F.when(hits[i], F.lit(i)) for i in sorted(hits)]))


def citation_recency(value: str | Column, period: str | Column) -> Column:
    """Share of the years named in the text that fall in or after the period."""
    years = F.transform(
        F.regexp_extract_all(text_or_empty(value), F.lit(r"(?U)\b((?:19|20)\d{2})\b"), F.lit(1)),
        lambda y: y.cast("int"),
    )
    start = F.coalesce(
        F.element_at(
            F.create_map(*[F.lit(v) for kv in lexicons.PERIOD_START_YEAR.items() for v in kv]), col(period)
        ),
        F.lit(2010),
    )
    recent = F.size(F.filter(years, lambda y: y >= start))
    return F.coalesce(F.try_divide(recent.cast("double"), F.size(years).cast("double")), F.lit(0.0))


def precedent_influence(value: str | Column, patterns: Sequence[str] = lexicons.PRECEDENT_PATTERNS) -> Column:
    """Precedent wording per thousand words, a tenth of it, at most 1."""
    text = text_or_empty(value)
    hits = F.lit(0)
    for pattern in patterns:
        hits = hits + F.regexp_count(text, F.lit("(?i)" + pattern))
    per_thousand = F.try_divide(hits.cast("double") * 1000.0, word_count(text).cast("double"))
    return F.least(F.lit(1.0), F.coalesce(per_thousand, F.lit(0.0)) / 10.0)


def legal_complexity(value: str | Column, phrases: Sequence[str] = lexicons.LEGAL_PHRASES) -> Column:
    """Formal phrase density plus mean sentence length, scaled to at most 1."""
    text = text_or_empty(value)

    def phrase_hits(lowered: Column) -> Column:
        total = F.lit(0)
        for phrase in phrases:
            total = total + occurrences(lowered, phrase)
        return total

    hits = let(F.lower(text), phrase_hits)
    density = F.coalesce(F.try_divide(hits.cast("double"), word_count(text).cast("double")), F.lit(0.0)) * 100.0
    sentence_words = F.regexp_count(text, F.lit(r"[^\s\p{Z}.]+")).cast("double")
    sentences = (occurrences(text, ".") + 1).cast("double")
    return F.least(F.lit(1.0), (density + sentence_words / sentences / 50.0) / 10.0)


def period_term_ratio(
    value: str | Column, period: str | Column, terms: Mapping[str, Sequence[str]] = lexicons.PERIOD_TERMS
) -> Column:
    """Share of the period's own terms that occur; null for an unknown period."""

    def ratio(lowered: Column) -> Column:
        out = F.lit(None).cast("double")
        for name, own in terms.items():
            out = F.when(col(period) == name, count_contains(lowered, own) / F.lit(float(len(own)))).otherwise(out)
        return out

    return let(F.lower(text_or_empty(value)), ratio)


def enhanced_features(value: str | Column, period: str | Column) -> Column:
    return F.struct(
        citation_recency(value, period).alias("recent_citation_ratio"),
        precedent_influence(value).alias("precedent_influence"),
        period_term_ratio(value, period).alias("period_term_ratio"),
        legal_complexity(value).alias("legal_complexity"),
    )


def citation_date_features(citations: str | Column, date_filed: str | Column) -> Column:
    """Count, mean age and year span of ``array<struct<cite,date>>``."""
    citations, filed = col(citations), col(date_filed)
    years = F.filter(
        F.transform(citations, lambda c: F.year(F.try_to_date(c["date"], "yyyy-MM-dd"))), lambda y: y.isNotNull()
    )
    total = F.aggregate(years, F.lit(0).cast("long"), lambda acc, y: acc + y)
    age = F.year(filed) - F.try_divide(total.cast("double"), F.size(years).cast("double"))
    return F.struct(
        F.coalesce(F.greatest(F.size(citations), F.lit(0)), F.lit(0)).cast("long").alias("citation_count"),
        F.coalesce(age, F.lit(0.0)).alias("avg_citation_age"),
        F.when(F.size(years) > 1, F.array_max(years) - F.array_min(years))
        .otherwise(F.lit(0))
        .cast("long")
        .alias("citation_span"),
    )


# --- sentences, arguments, key points ---------------------------------------

# Abbreviations that do not end a sentence.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Jr", "Sr", "St", "v", "vs", "No", "Nos", "Inc", "Corp", "Co", "Ltd", "Fed",
    "Cir", "Cf", "cf", "Id", "id", "Art", "Sec", "U.S", "S.Ct", "U.S.C", "e.g", "i.e",
)


def sentences(value: str | Column) -> Column:
    """Sentences of the whole text, in order."""
    guard = "".join(rf"(?<!\b{re.escape(a)}\.)" for a in ABBREVIATIONS)
    return words_kept(F.split(strip_space(text_or_empty(value)), rf"(?<=[.!?]){guard}{SPACE}+"))


def words_kept(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def neighbourhood(sents: Column, index: Column) -> Column:
    """The sentence at ``index`` (from 0) with the one before and the one after."""
    first = F.greatest(index, F.lit(1))
    return F.concat_ws(" ", F.slice(sents, first, index + 2 - first + 1))


def token_jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 when both are empty."""
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")),
        F.lit(0.0),
    )


def text_similarity(a: str | Column, b: str | Column) -> Column:
    return token_jaccard(word_set(text_or_empty(a)), word_set(text_or_empty(b)))


def drop_near_duplicates(items: Column, threshold: float, empty_type: str, field: str | None = None) -> Column:
    """Keep an item when no kept item before it is more similar than ``threshold``.

    The fold runs inside one row over that row's own list.
    """

    def tokens(x: Column) -> Column:
        return word_set(x[field] if field else x)

    kept = F.array().cast(f"array<struct<item:{empty_type},tokens:array<string>>>")
    folded = F.aggregate(
        F.transform(items, lambda x: F.struct(x.alias("item"), tokens(x).alias("tokens"))),
        kept,
        lambda acc, x: F.when(
            F.exists(acc, lambda k: token_jaccard(k["tokens"], x["tokens"]) > threshold), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(folded, lambda k: k["item"])


INSIGHT_TYPE = "struct<text:string,context:string>"


def insights(
    sents: str | Column, patterns: Sequence[str], within: float = 0.8, threshold: float = 0.7
) -> Column:
    """Pattern captures with their neighbouring sentences, near duplicates removed.

    ``sents`` is an array of sentences. Captures come in sentence order, then
    pattern order; similar ones are dropped while collecting (``within``) and
    once more over the collected list (``threshold``).
    """
    sents = col(sents)

    def captures(sentence: Column, index: Column) -> Column:
        found = F.flatten(
            F.array(*[F.regexp_extract_all(sentence, F.lit("(?i)" + p), F.lit(1)) for p in patterns])
        )
        return F.transform(
            found, lambda t: F.struct(strip_space(t).alias("text"), neighbourhood(sents, index).alias("context"))
        )

    raw = F.flatten(F.transform(sents, captures))
    once = drop_near_duplicates(raw, within, INSIGHT_TYPE, "text")
    return drop_near_duplicates(once, threshold, INSIGHT_TYPE, "text")


def key_points(sents: str | Column, patterns: Mapping[str, str] = lexicons.KEY_POINT_PATTERNS) -> Column:
    """Typed captures longer than ten characters, in sentence order."""

    def typed(sentence: Column, kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(sentence, F.lit("(?i)" + pattern), F.lit(1))
        return F.transform(found, lambda t: F.struct(F.lit(kind).alias("type"), strip_space(t).alias("text")))

    def captures(sentence: Column) -> Column:
        return F.flatten(F.array(*[typed(sentence, kind, p) for kind, p in patterns.items()]))

    return F.filter(F.flatten(F.transform(col(sents), captures)), lambda p: F.length(p["text"]) > 10)


def key_findings(value: str | Column, patterns: Sequence[str] = lexicons.FINDING_PATTERNS) -> Column:
    """Captures over the whole text, longer than ten characters."""
    text = text_or_empty(value)
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in patterns]))
    return F.filter(F.transform(found, strip_space), lambda t: F.length(t) > 10)


def point_similarity(a: str | Column, b: str | Column) -> Column:
    """Highest token overlap between two lists of points of the same type.

    Both lists are bound once, and each point's words are split once, not once for every pair.
    """

    def worded(points: str | Column) -> Column:
        return F.transform(col(points), lambda p: F.struct(p["type"].alias("type"), word_set(p["text"]).alias("words")))

    def overlap(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y))
        return let(shared, lambda n: F.try_divide(n.cast("double"), (F.size(x) + F.size(y) - n).cast("double")))

    def scored(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda p: F.transform(
            F.filter(right, lambda q: q["type"] == p["type"]), lambda q: overlap(p["words"], q["words"]))))

    scores = let(worded(b), lambda right: scored(worded(a), right))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def citations(
    value: str | Column,
    patterns: Sequence[str] = lexicons.CITATION_PATTERNS,
    entries: Sequence[tuple[str, int]] = lexicons.REFERENCE_ENTRY_PATTERNS,
) -> Column:
    """Distinct citation strings, then the entries of a reference list."""
    text = text_or_empty(value)
    inline = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    block = F.regexp_extract(text, lexicons.REFERENCE_SECTION, 1)
    listed = [F.regexp_extract_all(block, F.lit(p), F.lit(group)) for p, group in entries]
    found = F.transform(F.flatten(F.array(*inline, *listed)), strip_space)
    return F.array_distinct(F.filter(found, lambda c: c != ""))


# Surface patterns per entity class.
ENTITY_PATTERNS = {
    "PERSON": r"(?:Judge|Justice|Mr\.|Ms\.|Mrs\.|Dr\.)\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)",
    "ORG": r"((?:[A-Z][A-Za-z&]+\s){1,4}(?:Inc|Corp|LLC|Ltd|Company|Court)\b\.?)",
    "LAW": r"(\d+\s+U\.S\.C\.\s+(?:§\s*|section\s+)?\d+|[Ss]ection\s+\d+|§\s*\d+)",
    "DATE": r"((?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},\s+\d{4}|\b(?:19|20)\d{2}\b)",
}


def entities(value: str | Column, gazetteer: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Distinct entity strings per class, from patterns and an optional name list."""
    text = text_or_empty(value)
    fields = []
    for kind, pattern in ENTITY_PATTERNS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        names = (gazetteer or {}).get(kind, ())
        if names:
            listed = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in names]))
            found = F.concat(found, listed)
        fields.append(F.array_distinct(found).alias(kind))
    return F.struct(*fields)


# --- names, dates, records --------------------------------------------------


def parties(name: str | Column) -> Column:
    """Plaintiff and defendant; both blank unless the name has exactly two sides."""
    sides = F.split(text_or_empty(name), r" v\. ")
    two = F.size(sides) == 2
    return F.struct(
        F.when(two, strip_space(F.get(sides, F.lit(0)))).otherwise(F.lit("")).alias("plaintiff"),
        F.when(two, strip_space(F.get(sides, F.lit(1)))).otherwise(F.lit("")).alias("defendant"),
    )


def procedural_events(**dates: str | Column) -> Column:
    """Dated events in order: one per non-null date."""
    events = F.array(
        *[
            F.struct(
                col(c).cast("date").alias("date"),
                F.lit(kind).alias("event_type"),
                F.lit(f"Case {kind}").alias("description"),
            )
            for kind, c in dates.items()
        ]
    )
    return F.array_sort(F.filter(events, lambda e: e["date"].isNotNull()))


def party_record(name: str | Column, role: str | Column, kind: str | Column, attorneys: str | Column) -> Column:
    missing = F.lit(lexicons.NOT_AVAILABLE)
    return F.struct(
        F.coalesce(col(name), missing).alias("name"),
        F.coalesce(col(role), missing).alias("role"),
        F.coalesce(col(kind), missing).alias("type"),
        F.coalesce(F.transform(col(attorneys), lambda a: a["name"]), F.array().cast("array<string>")).alias("attorneys"),
    )


def time_period(
    date: str | Column,
    periods: Sequence[tuple] = lexicons.PERIODS,
    default: str = lexicons.DEFAULT_PERIOD,
) -> Column:
    """Named period of a date; text is coerced, anything unreadable is the default."""
    day = F.try_to_timestamp(col(date).cast("string")).cast("date")
    out = F.lit(default)
    for name, start, end in reversed(periods):
        inside = F.lit(True)
        if start:
            inside = inside & (day >= F.lit(start).cast("date"))
        if end:
            inside = inside & (day < F.lit(end).cast("date"))
        out = F.when(day.isNotNull() & inside, F.lit(name)).otherwise(out)
    return out


def filed_year(date: str | Column) -> Column:
    return F.year(F.try_to_timestamp(col(date).cast("string")))


def date_relevance(date: str | Column, first: str = "2000-01-01", last: str = "2025-01-01") -> Column:
    """Position of a date between two days, on a line; 0.5 when unreadable."""
    day = F.try_to_timestamp(col(date).cast("string")).cast("date")
    span = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date"))
    return F.coalesce(
        F.datediff(day, F.lit(first).cast("date")).cast("double") / span.cast("double"), F.lit(0.5)
    )
