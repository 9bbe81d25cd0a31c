"""Yearly counts, keyword statistics and forecasts.

Series operators take long rows ``(keyword, year, count)``. A keyword's series
has one row per year, so windows and groups over a keyword stay small however
many mentions were counted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import filed_year, parse_keywords
from docketry.kernels import fit_and_forecast, level_fit


def _by_year():
    return Window.partitionBy("keyword").orderBy("year")


# --- counts -----------------------------------------------------------------


def cases_per_year(cases: DataFrame, date: str = "date_filed") -> DataFrame:
    dated = cases.select(filed_year(date).alias("year")).where(F.col("year").isNotNull())
    return dated.groupBy("year").agg(F.count("*").alias("count"))


def citations_per_year(cases: DataFrame, date: str = "date_filed", citations: str = "citation_count") -> DataFrame:
    dated = cases.select(filed_year(date).alias("year"), F.col(citations).alias("_n"))
    return dated.where(F.col("year").isNotNull()).groupBy("year").agg(F.sum("_n").alias("citation_count"))


def keyword_counts(cases: DataFrame, keywords: str | Column = "tech_keywords_found",
                   date: str = "date_filed") -> DataFrame:
    """Mentions per year and keyword, from keyword list text."""
    rows = cases.select(filed_year(date).alias("year"), F.explode(parse_keywords(keywords)).alias("keyword"))
    return rows.where(F.col("year").isNotNull()).groupBy("year", "keyword").agg(F.count("*").alias("count"))


def available_keywords(counts: DataFrame) -> DataFrame:
    return counts.select("keyword").distinct().orderBy("keyword")


def keyword_stats(counts: DataFrame, recent_year: int = 2020) -> DataFrame:
    """Totals, years, extremes and least-squares slope per keyword."""
    return counts.groupBy("keyword").agg(
        F.sum("count").alias("total_mentions"),
        F.count("*").alias("years_present"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.max("count").alias("max_count"),
        F.avg("count").alias("mean_count"),
        (F.max("year") >= recent_year).alias("has_recent_data"),
        F.coalesce(F.regr_slope(F.col("count").cast("double"), F.col("year").cast("double")), F.lit(0.0)).alias("trend"),
    )


def relevant_keywords(stats: DataFrame, min_years: int = 3) -> DataFrame:
    return stats.where((F.col("total_mentions") > 0) & F.col("has_recent_data") & (F.col("years_present") >= min_years))


def top_keywords(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("total_mentions"), F.asc("keyword")).limit(n)


def keyword_summary(stats: DataFrame) -> DataFrame:
    """Number of keywords, of relevant ones, and the years the relevant ones span."""
    live = F.col("has_recent_data") & (F.col("total_mentions") > 0) & (F.col("years_present") >= 3)
    first, last = F.min(F.when(live, F.col("first_year"))), F.max(F.when(live, F.col("last_year")))
    return stats.agg(
        F.count("*").alias("total_keywords"),
        F.count(F.when(live, 1)).alias("active_keywords"),
        F.concat(first.cast("string"), F.lit(" - "), last.cast("string")).alias("time_range"),
    )


# --- series windows ---------------------------------------------------------


def rolling_std(series: DataFrame, size: int = 5) -> DataFrame:
    """Sample standard deviation over the last ``size`` rows; null for the first row."""
    return series.withColumn("rolling_std", F.stddev_samp("count").over(_by_year().rowsBetween(1 - size, 0)))


def recent_trend(series: DataFrame, size: int = 5) -> DataFrame:
    """Slope and mean of the last ``size`` rows per keyword."""
    newest = Window.partitionBy("keyword").orderBy(F.desc("year"))
    tail = series.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= size)
    return tail.groupBy("keyword").agg(
        F.coalesce(F.regr_slope(F.col("count").cast("double"), F.col("year").cast("double")), F.lit(0.0)).alias("recent_trend"),
        F.avg("count").alias("recent_mean"),
        F.max_by("count", "year").cast("double").alias("last_value"),
    )


def longest_run(series: DataFrame) -> DataFrame:
    """Longest run of consecutive years with a count above zero."""
    runs = (
        series.where(F.col("count") > 0)
        .withColumn("_run", F.col("year") - F.row_number().over(_by_year()))
        .groupBy("keyword", "_run")
        .agg(F.count("*").alias("_n"))
    )
    found = runs.groupBy("keyword").agg(F.max("_n").alias("longest_run"))
    return series.select("keyword").distinct().join(found, "keyword", "left").withColumn(
        "longest_run", F.coalesce("longest_run", F.lit(0).cast("long"))
    )


def zero_filled(series: DataFrame) -> DataFrame:
    """One row for every year between a keyword's first and last, 0 where none was counted."""
    spans = series.groupBy("keyword").agg(F.min("year").alias("_lo"), F.max("year").alias("_hi"))
    years = spans.select("keyword", F.explode(F.sequence("_lo", "_hi")).alias("year"))
    return years.join(series, ["keyword", "year"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("long"))
    )


def persistence_error(series: DataFrame) -> DataFrame:
    """Errors of predicting each value by the one before; null under three points."""
    error = F.col("count") - F.lag("count").over(_by_year())
    stats = series.withColumn("_e", error.cast("double")).groupBy("keyword").agg(
        F.count("*").alias("_n"), F.avg(F.col("_e") * F.col("_e")).alias("_mse"), F.avg(F.abs("_e")).alias("_mae")
    )
    enough = F.col("_n") >= 3
    return stats.select(
        "keyword", F.when(enough, F.col("_mse")).alias("mse"), F.when(enough, F.col("_mae")).alias("mae"),
        F.when(enough, F.sqrt("_mse")).alias("rmse"),
    )


def yearly_direction(counts: DataFrame, year: str = "year", value: str = "count", by: Sequence[str] = ()) -> DataFrame:
    """Increased or decreased against the year before, null for the first year.

    A count per year and group is small, so the window is too.
    """
    w = Window.partitionBy(*by).orderBy(year) if by else Window.orderBy(year)
    before = F.lag(value).over(w)
    return counts.withColumn(
        "direction", F.when(before.isNull(), None).when(F.col(value) > before, "increased").otherwise("decreased")
    )


# --- closed-form forecasts --------------------------------------------------


def trend_label(weighted: str | Column, recent: str | Column) -> Column:
    w = F.col(weighted) if isinstance(weighted, str) else weighted
    r = F.col(recent) if isinstance(recent, str) else recent
    return (
        F.when(F.abs(w) < 0.5, "stable")
        .when(w > 0, F.when(r > 0, "increasing").otherwise("mixed but generally increasing"))
        .otherwise(F.when(r < 0, "decreasing").otherwise("mixed but generally decreasing"))
    )


def trend_metrics(series: DataFrame) -> DataFrame:
    """Long and recent trend, baseline and mean rolling deviation per keyword."""
    long_term = series.groupBy("keyword").agg(
        F.sum("count").alias("total_mentions"), F.avg("count").alias("mean_count"),
        F.max("count").cast("double").alias("max_count"), F.count("*").alias("years_with_mentions"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.coalesce(F.regr_slope(F.col("count").cast("double"), F.col("year").cast("double")), F.lit(0.0)).alias("long_term_trend"),
    )
    spread = rolling_std(series).groupBy("keyword").agg(F.avg("rolling_std").alias("rolling_std"))
    joined = long_term.join(recent_trend(series), "keyword").join(spread, "keyword")
    weighted = 0.7 * F.col("recent_trend") + 0.3 * F.col("long_term_trend")
    return joined.withColumns(
        {"weighted_trend": weighted, "baseline": (F.col("recent_mean") + F.col("last_value")) / 2.0}
    ).withColumn("trend_interpretation", trend_label("weighted_trend", "recent_trend"))


def damped_forecast(series: DataFrame, periods: int = 5) -> DataFrame:
    """Forecast every keyword at once: damped trend from a recent baseline.

    One row per keyword and future year with lower and upper bounds; bounds are
    null when a single point leaves no deviation.
    """
    step = F.col("step").cast("double")
    value = F.greatest(
        F.col("baseline") * 0.5, F.col("baseline") + F.col("weighted_trend") * step / (1.0 + 0.2 * step)
    )
    width = F.col("rolling_std") * (1.0 + 0.1 * step)
    steps = trend_metrics(series).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    return (
        steps.withColumns({"value": value, "_w": width})
        .select(
            "keyword", (F.col("last_year") + F.col("step") + 1).alias("year"), "value",
            F.when(F.col("_w").isNotNull(), F.greatest(F.lit(0.0), F.col("value") - F.col("_w"))).alias("lower"),
            (F.col("value") + F.col("_w")).alias("upper"),
        )
    )


def trend_bundle(series: DataFrame, keywords: Sequence[str] | None = None, periods: int = 5) -> DataFrame:
    """History and forecast as long rows ``(keyword, year, kind, value, lower, upper)``."""
    chosen = series.where(F.col("keyword").isin(*keywords)) if keywords else series
    empty = F.lit(None).cast("double")
    past = chosen.select(
        "keyword", "year", F.lit("history").alias("kind"), F.col("count").cast("double").alias("value"),
        empty.alias("lower"), empty.alias("upper"),
    )
    future = damped_forecast(chosen, periods).withColumn("kind", F.lit("forecast"))
    return past.unionByName(future.select(past.columns))


def aligned_history_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast side by side per keyword and year."""
    past = history.select("keyword", "year", F.col("count").cast("double").alias("history"))
    future = forecast.select("keyword", "year", F.col("value").alias("forecast"), "lower", "upper")
    return past.join(future, ["keyword", "year"], "full")


def floor_projection(series: DataFrame, periods: int = 5) -> DataFrame:
    """Straight projection that never falls below the smallest count, with a 20 % band."""
    ends = series.groupBy("keyword").agg(
        F.min_by("count", "year").alias("_first"), F.max_by("count", "year").alias("_last"),
        F.min("count").alias("_floor"), F.count("*").alias("_n"), F.max("year").alias("_year"),
    )
    slope = F.when(F.col("_n") > 1, (F.col("_last") - F.col("_first")) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    base = F.greatest("_floor", "_last").cast("double")
    steps = ends.withColumns({"_slope": slope, "_base": base}).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(periods)))
    )
    value = F.greatest(F.col("_base"), F.col("_base") + F.col("_slope") * F.col("step"))
    return steps.withColumn("value", value).select(
        "keyword", (F.col("_year") + F.col("step")).alias("year"), "value",
        F.greatest(F.col("_floor").cast("double"), F.col("value") * 0.8).alias("lower"),
        (F.col("value") * 1.2).alias("upper"),
    )


def sparse_forecast(series: DataFrame, periods: int = 5, enough: int = 5) -> DataFrame:
    """Keywords with an all-zero series (small ramp) or under ``enough`` years (line, at least 1)."""
    filled = zero_filled(series)
    fit = filled.groupBy("keyword").agg(
        F.sum("count").alias("_sum"), F.count("*").alias("_n"), F.max("year").alias("_year"),
        F.avg("count").alias("_mean"), F.avg("year").alias("_mid"),
        F.coalesce(F.regr_slope(F.col("count").cast("double"), F.col("year").cast("double")), F.lit(0.0)).alias("_slope"),
    )
    steps = fit.where((F.col("_sum") == 0) | (F.col("_n") < enough)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(periods)))
    )
    line = F.col("_mean") + F.col("_slope") * (F.col("_year") + F.col("step") - F.col("_mid"))
    value = F.when(F.col("_sum") == 0, F.col("step") * 0.5).otherwise(F.greatest(F.lit(1.0), line))
    regime = F.when(F.col("_sum") == 0, "ramp").otherwise("line")
    return steps.select("keyword", (F.col("_year") + F.col("step")).alias("year"), regime.alias("regime"), value.alias("value"))


# --- exponential smoothing --------------------------------------------------
# One keyword's yearly series per group; NumPy does the small fit.


def smoothing_forecast(series: DataFrame, periods: int = 5) -> DataFrame:
    """Simple exponential smoothing, bias removed, with a band of 1.96 deviations."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("year")
        y = rows["count"].to_numpy(float)
        fitted, level = level_fit(y)
        value = max(0.0, level + float((y - fitted).mean()))
        error = float(y.std()) if len(y) > 1 else y[0] * 0.1
        return pd.DataFrame(
            {"keyword": rows["keyword"].iloc[0], "year": int(rows["year"].iloc[-1]) + np.arange(1, periods + 1),
             "value": value, "lower": max(0.0, value - 1.96 * error), "upper": value + 1.96 * error}
        )

    filled = zero_filled(series).select("keyword", "year", "count")
    return filled.groupBy("keyword").applyInPandas(one, "keyword string, year int, value double, lower double, upper double")


def smoothing_validation(series: DataFrame, min_samples: int = 2, max_splits: int = 3) -> DataFrame:
    """Errors of the damped fit on held-out years: expanding folds, or one split for short series."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("year")["count"].to_numpy(float)
        n = len(y)
        if n < min_samples * 2:
            cut = max(1, n - min_samples)
            folds = [(cut, n)] if cut < n else []
        else:
            splits = min(max_splits, n // min_samples - 1)
            size = n // (splits + 1)
            folds = [(n - size * (splits - i), n - size * (splits - i - 1)) for i in range(splits)]
        errors = [y[a:b] - fit_and_forecast(y[:a], b - a) for a, b in folds]
        mse = [float((e ** 2).mean()) for e in errors]
        return pd.DataFrame(
            {"keyword": [rows["keyword"].iloc[0]], "folds": [len(folds)],
             "mse": [np.mean(mse) if mse else None],
             "mae": [np.mean([np.abs(e).mean() for e in errors]) if mse else None],
             "rmse": [np.mean(np.sqrt(mse)) if mse else None]}
        )

    filled = zero_filled(series).select("keyword", "year", "count")
    return filled.groupBy("keyword").applyInPandas(one, "keyword string, folds int, mse double, mae double, rmse double")


def regime_forecast(series: DataFrame, periods: int = 5, enough: int = 5) -> DataFrame:
    """Ramp, line or damped smoothing, by what the series allows."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("year")
        y = rows["count"].to_numpy(float)
        value = fit_and_forecast(y, periods)
        value = np.where(value <= 0, max(1.0, float(y.mean()) * 0.1), value)
        return pd.DataFrame(
            {"keyword": rows["keyword"].iloc[0], "year": int(rows["year"].iloc[-1]) + np.arange(1, periods + 1),
             "regime": "smoothing", "value": value}
        )

    filled = zero_filled(series).select("keyword", "year", "count")
    spans = filled.groupBy("keyword").agg(F.sum("count").alias("_sum"), F.count("*").alias("_n"))
    rich = spans.where((F.col("_sum") > 0) & (F.col("_n") >= enough)).select("keyword")
    smooth = filled.join(rich, "keyword", "left_semi").groupBy("keyword").applyInPandas(
        one, "keyword string, year int, regime string, value double"
    )
    return sparse_forecast(series, periods, enough).unionByName(smooth)
