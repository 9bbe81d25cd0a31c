"""Appending batches and filling thin periods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import lexicons
from docketry.functions.text import filed_year, sentences
from docketry.operators.scaling import broadcast_if_small, global_rank


def append_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """All batches under one another; columns a batch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def yearly_court_batches(cases: DataFrame, first_year: int, last_year: int,
                         groups: Sequence[Sequence[str]] = lexicons.COURT_GROUPS) -> DataFrame:
    """Cases of each year and court group, tagged, duplicates removed.

    One pass tags every row with the groups its court belongs to, instead of one
    scan per year and group.
    """
    member = F.array_compact(
        F.array(*[F.when(F.col("court_id").isin(*g), F.lit(i)) for i, g in enumerate(groups)])
    )
    year = filed_year("date_filed")
    return (
        cases.where(year.between(first_year, last_year))
        .withColumns({"batch_year": year, "court_group": F.explode(member)})
        .distinct()
    )


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def augmented_cases(cases: DataFrame, key: str, text: str, period: str, numbers: Sequence[str] = (),
                    minimum: int = 50, share: float = 0.8, jitter: float = 0.1, min_sentences: int = 6,
                    seed: int = 42) -> DataFrame:
    """Original rows plus resampled copies for periods with fewer than ``minimum`` cases.

    Draw ``i`` of a period picks the case at a seeded position, keeps a seeded
    ``share`` of its sentences, and scales its numbers by up to ``jitter``. Cases
    with too few sentences are picked but give no copy. Only thin periods, at
    most ``minimum`` rows each, are numbered.
    """
    sizes = cases.groupBy(F.col(period).alias("_p")).agg(F.count("*").alias("_n")).where(F.col("_n") < minimum)
    sizes = broadcast_if_small(sizes)
    thin = cases.join(sizes, F.col(period) == F.col("_p"))
    ranked = global_rank(thin, [F.col(period), F.col(key)], "_g")
    starts = ranked.groupBy(F.col("_p").alias("_q")).agg(F.min("_g").alias("_g0"))
    numbered = ranked.join(broadcast_if_small(starts), F.col("_p") == F.col("_q")).withColumn("_pos", F.col("_g") - F.col("_g0"))
    draws = (
        sizes.withColumn("_draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(minimum) - F.col("_n"))))
        .withColumn("_pick", F.pmod(F.xxhash64("_p", "_draw", F.lit(seed)), F.col("_n")))
        .select(F.col("_p").alias("_dp"), "_draw", "_pick")
    )
    picked = numbered.join(draws, (F.col("_p") == F.col("_dp")) & (F.col("_pos") == F.col("_pick")))
    parts = F.transform(
        F.col("_s"),
        lambda s, i: F.struct(F.xxhash64(F.col(key), F.col("_draw"), i, F.lit(seed)).alias("h"), s.alias("s")),
    )
    kept = F.slice(F.array_sort(parts), F.lit(1), F.greatest(F.floor(F.size("_s") * share), F.lit(1)).cast("int"))
    noise = lambda c: (
        F.lit(1.0 - jitter) + F.lit(2 * jitter) * F.pmod(F.xxhash64(F.col(key), F.col("_draw"), F.lit(c)), F.lit(10_001)) / 10_000.0
    )
    copies = (
        picked.withColumn("_s", sentences(text))
        .where(F.size("_s") >= min_sentences)
        .withColumn(text, F.concat_ws(" ", F.transform(kept, lambda x: x["s"])))
        .withColumns({c: F.col(c) * noise(c) for c in numbers})
        .withColumn("augmented", F.lit(True))
    )
    original = cases.withColumns({c: F.col(c).cast("double") for c in numbers}).withColumn("augmented", F.lit(False))
    return original.unionByName(copies.select(original.columns))
