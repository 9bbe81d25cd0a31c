"""Profiles, descriptions and evaluation measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import col
from docketry.operators.scaling import broadcast_if_small, exact_quantiles, global_rank, prefix_sums


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null count and coverage of every column, from one aggregate."""
    names = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in names])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in names]))
    return counts.select("_rows", stacked.alias("x")).select(
        "x.column", "x.non_null",
        F.coalesce(F.try_divide(F.col("x.non_null").cast("double") * 100.0, F.col("_rows").cast("double")), F.lit(0.0)).alias("coverage"),
    )


def split_bucket(key: str | Column) -> Column:
    """A number in [0, 1) that depends on the key's text alone."""
    digest = F.substring(F.md5(col(key).cast("string")), 1, 8)
    return F.conv(digest, 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def hash_split(df: DataFrame, key: str, test_share: float = 0.2, name: str = "is_test") -> DataFrame:
    """Stable split by key: the same key is always on the same side."""
    return df.withColumn(name, split_bucket(key) < test_share)


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, name: str = "is_test") -> DataFrame:
    """Exact share per label: the rows with the lowest key hash of each label.

    Ranks come from a range-partitioned running count, so a label holding most
    rows is still spread over all tasks.
    """
    hashed = df.withColumn("_h", split_bucket(key))
    ranked = global_rank(hashed, [F.col(label), F.col("_h"), F.col(key)], "_rank")
    sizes = ranked.groupBy(F.col(label).alias("_label")).agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    joined = ranked.join(broadcast_if_small(sizes), F.col(label).eqNullSafe(F.col("_label")))
    test = F.col("_rank") - F.col("_first") < F.round(F.col("_n") * test_share)
    return joined.withColumn(name, test).select(*df.columns, name)


def dataset_statistics(df: DataFrame, key: str, values_of: Sequence[str], test_share: float = 0.2) -> DataFrame:
    """Rows, split sizes, missing values per column and value counts, as ``(kind, name, value, count)``."""
    test = split_bucket(key) < test_share
    facts = [("total", "rows", F.count("*")), ("split", "train", F.count(F.when(~test, 1))),
             ("split", "test", F.count(F.when(test, 1)))]
    facts += [("missing", c, F.count(F.when(F.col(c).isNull(), 1))) for c in df.columns]
    row = df.agg(*[value.alias(f"_{i}") for i, (_, _, value) in enumerate(facts)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("value"),
                 F.col(f"_{i}").alias("count")) for i, (kind, name, _) in enumerate(facts)]))
    totals = row.select(stacked.alias("x")).select("x.*")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in values_of]))
    spread = df.select(pairs.alias("x")).groupBy("x.name", "x.value").agg(F.count("*").alias("count"))
    return totals.unionByName(spread.select(F.lit("value").alias("kind"), "name", "value", "count"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    spark = df.sparkSession
    rows = None
    for c in columns:
        q = exact_quantiles(df, c, (0.25, 0.5, 0.75))
        one = df.agg(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"), F.lit(q[0]).alias("q25"), F.lit(q[1]).alias("q50"),
            F.lit(q[2]).alias("q75"), F.max(F.col(c).cast("double")).alias("max"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def value_counts(df: DataFrame, column: str | Column, name: str) -> DataFrame:
    return df.groupBy(col(column).alias(name)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc(name))


def vector_statistics(df: DataFrame, vector: str) -> DataFrame:
    """Minimum, maximum, mean and population deviation of each vector."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.size(vector).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    with_mean = df.withColumns({"min": F.array_min(v), "max": F.array_max(v), "mean": mean})
    spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n
    return with_mean.withColumn("std", F.sqrt(spread))


def multilabel_report(df: DataFrame, truth: str, predicted: str, period: str) -> DataFrame:
    """Precision, recall, F1 and support per label, overall and per period.

    Row-level marks are summed by (label, period) before the overall rows form.
    """
    labels = F.array_union(F.col(truth), F.col(predicted))
    marks = df.select(
        period, F.explode(F.transform(labels, lambda x: F.struct(
            x.alias("label"), F.array_contains(truth, x).alias("t"), F.array_contains(predicted, x).alias("p")))).alias("m")
    ).select(period, "m.*")
    hit = lambda test: F.count(F.when(test, 1))
    counts = marks.groupBy("label", period).agg(
        hit(F.col("t") & F.col("p")).alias("tp"), hit(~F.col("t") & F.col("p")).alias("fp"),
        hit(F.col("t") & ~F.col("p")).alias("fn"),
    )
    total = counts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn(period, F.lit("all"))
    both = counts.unionByName(total)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = both.withColumns(
        {"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    return out.select(
        "label", F.col(period).alias("period"), "precision", "recall",
        ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("count"))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def precision_recall_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at every distinct score, highest first.

    Rows are counted per score, then running totals go over range partitions.
    """
    per_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"), F.count("*").alias("_n")
    )
    running = prefix_sums(per_score, [F.desc("threshold")], {"tp": F.col("_pos"), "flagged": F.col("_n")})
    positives = df.agg(F.sum(F.col(label).cast("long")).alias("n")).first()["n"] or 0
    total = F.lit(float(positives))
    return running.select(
        "threshold", (F.col("tp") / F.col("flagged")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), total).alias("recall"),
        F.try_divide(F.col("_pos").cast("double"), total).alias("recall_gain"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """Area under the step curve: recall gained times precision."""
    return curve.agg(F.sum(F.col("recall_gain") * F.col("precision")).alias("average_precision"))


def period_distribution(cases: DataFrame, period: str = "period") -> DataFrame:
    return cases.groupBy(period).agg(F.count("*").alias("cases"))


def issue_distribution(cases: DataFrame, issues: str = "issues", period: str = "period") -> DataFrame:
    """Cases per period and issue, with the share of the period's cases."""
    counts = cases.select(period, F.explode(issues).alias("issue")).groupBy(period, "issue").agg(F.count("*").alias("count"))
    totals = period_distribution(cases, period)
    return counts.join(broadcast_if_small(totals), period).withColumn(
        "percentage", F.col("count") / F.col("cases") * 100.0
    )


def period_weights(cases: DataFrame, period: str = "period") -> DataFrame:
    """Weight per period: the largest period's count over its own.

    The period table has one row per period name.
    """
    counts = period_distribution(cases, period)
    return counts.withColumn("weight", F.max("cases").over(Window.partitionBy()) / F.col("cases"))


def case_weights(cases: DataFrame, issues: str = "issues", period: str = "period") -> DataFrame:
    """Period weight of each case, times 0.8 when it has no issue."""
    weights = period_weights(cases, period).select(period, "weight")
    modifier = F.when(F.size(issues) > 0, 1.0).otherwise(0.8)
    return cases.join(broadcast_if_small(weights), period).withColumn("weight", F.col("weight") * modifier)
