"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of a text are compared with those of its language: the shares of
character classes, and the shares of the language's most common words with one
bin for all other words. The Jensen-Shannon distance of either must stay within
its limit. Texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import let
from docketry.llm.common import SPACES
from docketry.operators.scaling import fits_broadcast
from docketry.session import cut_lineage

# The character classes, each counted in what the ones before leave.
CLASSES = ("[a-z]+", SPACES, "[A-Z]+", "[0-9]+", r"[.,;:!?'\"()-]+", r"[\x00-\x7F]+")
SYMBOLS = "#*$%&|<>"
COMMON = 20  # most common words in a language's histogram
# Parts of each language's rows when the references are too many for a broadcast.
SALTS = 64
POOLED = "pooled"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def class_counts(text: Column) -> Column:
    """Characters by class, as an array; the last entry counts the rest."""
    def counts(*columns: Column) -> Column:
        sizes = [F.length(c) for c in columns]
        return F.array(*[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1])

    def bind(done: Sequence[Column], rest: Sequence[str]) -> Column:
        if not rest:
            return counts(*done)
        return let(F.regexp_replace(done[-1], rest[0], ""), lambda c: bind([*done, c], rest[1:]))

    return let(text, lambda t: bind([t], CLASSES))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of the hashes of their words.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(
            starts, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - x, F.lit(width)))
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeated(ordered: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        starts = F.transform(
            ordered,
            lambda x, j: F.when(same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1)), x["i"]),
        )
        return let(F.sort_array(F.array_compact(starts)), covered)

    def windows(hashes: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - width),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]),
        )
        ordered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(each, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered(h), repeated)).otherwise(0))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= width, let(hashes, windows)).otherwise(F.lit(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance in bits (0 to 1) of two histograms given as counts; null when one is empty."""

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(sums: Column) -> Column:
        both = F.zip_with(
            counts, reference,
            lambda a, b: let(
                F.struct((a / sums["a"]).alias("p"), (b / sums["b"]).alias("q")),
                lambda s: (term(s["p"], (s["p"] + s["q"]) / 2) + term(s["q"], (s["p"] + s["q"]) / 2)) / 2,
            ),
        )
        return F.when((sums["a"] > 0) & (sums["b"] > 0), total(both))

    return let(F.struct(total(counts).alias("a"), total(reference).alias("b")), of)


def keyed(df: DataFrame, language: str, text: str) -> DataFrame:
    return df.select(
        F.coalesce(F.concat(F.lit("language "), F.col(language).cast("string")), F.lit("none")).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def common_words(df: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """``(key, words, counts)``: the most common lower-case words of each language, over all rows, and of all pooled.

    ``key`` is ``"language "`` and the language, for every language with words. The
    pooled list ranks the words by their counts over all rows; rows without a
    language count in it alone.
    """
    counted = cut_lineage(
        keyed(df, language, text).select("key", F.explode(words_of(F.col("text"))).alias("word"))
        .groupBy("key", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    lists = counted.where("key <> 'none'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= COMMON)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "word", "n")))  # COMMON entries
    known = lists.groupBy("key").agg(ranked.alias("top"))
    pooled = (
        counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON)
        .select(F.lit(POOLED).alias("key"), "word", "n", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("rank"))
    )
    empty = F.expr("cast(array() as array<struct<rank:int,word:string,n:bigint>>)")
    both = known.union(pooled.agg(ranked.alias("top")).select(F.lit(POOLED), F.coalesce("top", empty)))
    return both.select(
        "key", F.transform("top", lambda x: x["word"]).alias("words"), F.transform("top", lambda x: x["n"]).alias("counts")
    )


def with_reference(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Join references by ``key``: sent to all tasks when counted small, otherwise against salted rows.

    With salts a language that holds most rows is dealt to ``SALTS`` tasks, each
    with a copy of its reference.
    """
    if fits_broadcast(found):
        return rows.join(F.broadcast(found), "key")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "n_chars"), F.lit(SALTS)).cast("int"))
    return dealt.join(found.withColumn("_salt", salts), ["key", "_salt"]).drop("_salt")


def references(measured: DataFrame, lists: DataFrame) -> DataFrame:
    """``(key, word_counts, class_counts)`` of the keys of ``lists``, from the counts of every row.

    A row that is compared with the pooled histograms adds to them alone, all
    others to their language's and the pooled ones.
    """
    places = range(len(CLASSES) + 1)
    totals = ["total", *[f"c{i}" for i in places]]
    sums = cut_lineage(measured.groupBy("key").agg(
        F.sum("n_words").alias("total"), *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in places]
    ))
    pooled = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals]).select(F.lit(POOLED).alias("key"), *totals)
    every = sums.where(F.col("key") != POOLED).union(pooled)
    others = F.col("total") - F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    return every.join(lists, "key").select(
        "key", F.concat("counts", F.array(others)).alias("word_counts"), F.array(*[F.col(f"c{i}") for i in places]).alias("class_counts")
    )


def common_counts(words: Column, common: Column) -> Column:
    """How often each common word occurs, lower-cased, and how many words are others."""

    def count(places: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(1), F.lit(COMMON)),
            lambda k: F.size(F.filter(places, lambda p: p == k)).cast("long"),
        )
        return F.concat(F.slice(each, F.lit(1), F.size(common)), F.array((F.size(words) - F.size(places)).cast("long")))

    found = F.transform(words, lambda w: F.array_position(common, F.lower(w)).cast("int"))
    return let(F.filter(found, lambda p: p > 0), count)


def judged(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang",
           class_limit: float = 0.07, word_limit: float = 0.14, least_chars: int = 200, least_words: int = 50) -> DataFrame:
    """Counts, distances and verdict of every row.

    Columns: the id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``class_distance``, ``word_distance``,
    ``kept``. A null text has no words. A text with fewer than ``least_chars``
    characters or ``least_words`` words has a null distance and passes that test.
    Every language with words is compared with its own histograms; rows without a
    language, and those of a language without words, with all rows pooled. Rows
    are judged one by one and whole, so long texts, repeated rows and ties need
    no rule; an empty table gives an empty result. Only the named columns are read.
    """
    lists = cut_lineage(common_words(df, language_column, text_column))
    own = F.concat(F.lit("language "), F.col(language_column).cast("string"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(F.col(id_column).alias("id"), text.alias("text"), F.length(text).alias("n_chars"), F.coalesce(own, F.lit(POOLED)).alias("key"))
    known = lists.select("key").withColumn("_known", F.lit(True))
    if fits_broadcast(lists):
        rows = rows.join(F.broadcast(known), "key", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "n_chars"), F.lit(SALTS)).cast("int"))
        rows = rows.join(known.withColumn("_salt", salts), ["key", "_salt"], "left").drop("_salt")
    rows = rows.withColumn("key", F.when(F.col("_known"), F.col("key")).otherwise(F.lit(POOLED))).drop("_known")
    rows = with_reference(rows, lists.select("key", "words"))

    def measure(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            common_counts(words, F.col("words")).alias("common"),
        )

    text = F.col("text")
    measured = cut_lineage(rows.select(
        "id", "key", let(words_of(text), measure).alias("m"),
        F.length(without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"), class_counts(text).alias("classes"), "n_chars",
    ).select("id", "key", "m.*", "word_chars", "n_symbols", "n_dup_lines", "classes", "n_chars"))  # counts only
    compared = with_reference(measured, cut_lineage(references(measured, lists)))
    flat = compared.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("n_chars") >= least_chars, distance(F.col("classes"), F.col("class_counts"))).alias("class_distance"),
        F.when(F.col("n_words") >= least_words, distance(F.col("common"), F.col("word_counts"))).alias("word_distance"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= class_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return flat.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "word_distance",
    )
