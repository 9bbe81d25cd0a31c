"""Rejection, claim, citation and timing reports over office actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import patent as P
from docketry.operators.scaling import top_per_key
from docketry.session import cut_lineage


def rejection_counts(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = actions.select(*by, F.explode(P.rejection_types("passageLocationText")).alias("rejection"))
    return rows.groupBy(*by, "rejection").agg(F.count("*").alias("count"))


def rejection_summary(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most common section, its count, and the total; ties go to the lower section."""
    first = F.min_by(F.struct("rejection", "count"), F.struct(-F.col("count"), F.col("rejection")))
    return (
        rejection_counts(actions, by)
        .groupBy(*by)
        .agg(first.alias("_m"), F.sum("count").alias("total_rejections"))
        .select(*by, F.col("_m.rejection").alias("most_common"), F.col("_m.count").alias("most_common_count"),
                "total_rejections")
    )


def claim_counts(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = actions.select(*by, F.explode(P.claim_numbers("relatedClaimNumberText")).alias("claim"))
    return rows.groupBy(*by, "claim").agg(F.count("*").alias("count"))


def most_rejected_claims(actions: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most frequent claims; with ``by``, per group over already counted rows."""
    counts = claim_counts(actions, by)
    order = [F.desc("count"), F.asc("claim")]
    return top_per_key(counts, by, order, n) if by else counts.orderBy(*order).limit(n)


def mean_claims(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    size = F.size(P.claim_numbers("relatedClaimNumberText"))
    return actions.groupBy(*by).agg(F.avg(size).alias("avg_claims_per_rejection"))


def yearly_counts(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    dated = actions.where(F.col("officeActionDate").isNotNull())
    return dated.groupBy(*by, F.year("officeActionDate").alias("year")).agg(F.count("*").alias("count"))


def monthly_counts(actions: DataFrame, last: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the newest ``last`` months that occur."""
    month = F.date_format("officeActionDate", "yyyy-MM").alias("month")
    counts = actions.where(F.col("officeActionDate").isNotNull()).groupBy(*by, month).agg(F.count("*").alias("count"))
    if by:
        return top_per_key(counts, by, [F.desc("month")], last)
    return counts.orderBy(F.desc("month")).limit(last)


def top_citations(actions: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    cited = actions.where(F.col("citedDocumentIdentifier").isNotNull())
    counts = cited.groupBy(*by, "citedDocumentIdentifier").agg(F.count("*").alias("count"))
    order = [F.desc("count"), F.asc("citedDocumentIdentifier")]
    return top_per_key(counts, by, order, n) if by else counts.orderBy(*order).limit(n)


def require_center(actions: DataFrame, center: int | str) -> DataFrame:
    """Rows of one tech centre; an unknown centre is an error."""
    rows = actions.where(F.col("techCenter") == int(center))
    if rows.limit(1).count() == 0:
        raise ValueError(f"tech center {center} not found")
    return rows


def section_counts(actions: DataFrame, by: Sequence[str]) -> DataFrame:
    """All counts of the reports, ``(by..., section, key, n)``, from one pass over the rows."""
    entry = lambda section, key, n=F.lit(1).cast("long"): F.struct(
        F.lit(section).alias("section"), key.cast("string").alias("key"), n.alias("n"))
    each = lambda section, keys: F.transform(
        F.coalesce(keys.cast("array<string>"), F.array().cast("array<string>")), lambda k: entry(section, k))
    claims, day, cited = P.claim_numbers("relatedClaimNumberText"), F.col("officeActionDate"), F.col("citedDocumentIdentifier")
    some = F.array(
        entry("rows", F.lit("all")),
        entry("claim_rows", F.lit("all"), F.size(claims).isNotNull().cast("long")),
        entry("claims", F.lit("all"), F.coalesce(F.size(claims), F.lit(0)).cast("long")),
        F.when(day.isNotNull(), entry("year", F.year(day))), F.when(day.isNotNull(), entry("month", F.date_format(day, "yyyy-MM"))),
        F.when(cited.isNotNull(), entry("citation", cited)),
    )
    every = F.concat(F.array_compact(some), each("rejection", P.rejection_types("passageLocationText")), each("claim", claims))
    return actions.select(*by, F.explode(every).alias("e")).groupBy(*by, "e.section", "e.key").agg(F.sum("e.n").alias("n"))


def _of(counts: DataFrame, section: str) -> DataFrame:
    return counts.where(F.col("section") == section).drop("section")


def center_report(actions: DataFrame, center: int | str | None = None) -> DataFrame:
    """All reports as long rows ``(techCenter, section, key, value)``, for one or every centre.

    Rows are read once and counted per centre, section and key; totals and tops
    come from those counts, so a large centre costs no more than a small one.
    """
    by = ["techCenter"]
    counts = cut_lineage(section_counts(actions if center is None else require_center(actions, center), by))

    def part(section: str, rows: DataFrame, key: Column | str = "key", value: Column | str = "n") -> DataFrame:
        key = F.col(key) if isinstance(key, str) else key
        value = F.col(value) if isinstance(value, str) else value
        return rows.select("techCenter", F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))

    rejections, claims, total = _of(counts, "rejection"), _of(counts, "claim"), F.lit("all")
    common = top_per_key(rejections, by, [F.desc("n"), F.asc("key")], 1)
    parts = [
        part("rejection_count", rejections),
        part("most_common_rejection", common),
        part("total_rejections", rejections.groupBy(*by).agg(F.sum("n").alias("n")), total),
        part("most_rejected_claim", top_per_key(claims, by, [F.desc("n"), F.col("key").cast("int").asc()], 5)),
        part("claim_count", claims),
        part("avg_claims_per_rejection", _mean_claims(counts, by), total),
        part("year", _of(counts, "year")),
        part("month", top_per_key(_of(counts, "month"), by, [F.desc("key")], 12)),
        part("top_citation", top_per_key(_of(counts, "citation"), by, [F.desc("n"), F.asc("key")], 10)),
        part("total_applications", _of(counts, "rows")),
        part("total_citations", counts.groupBy(*by).agg(
            F.coalesce(F.sum(F.when(F.col("section") == "citation", F.col("n"))), F.lit(0)).alias("n")), total),
    ]
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return out


def _mean_claims(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = {s: F.sum(F.when(F.col("section") == s, F.col("n"))) for s in ("claims", "claim_rows")}
    return counts.groupBy(*by).agg(F.try_divide(sums["claims"].cast("double"), sums["claim_rows"].cast("double")).alias("n"))


def center_summary(actions: DataFrame, last: int = 12) -> DataFrame:
    """A sentence list per centre, with the direction of the newest months."""
    by = ["techCenter"]
    counts = cut_lineage(section_counts(actions, by))
    months = top_per_key(_of(counts, "month"), by, [F.desc("key")], last).groupBy(*by).agg(
        F.max_by("n", "key").alias("_newest"), F.min_by("n", "key").alias("_oldest"), F.count("*").alias("_n")
    )
    claims = top_per_key(_of(counts, "claim"), by, [F.desc("n"), F.col("key").cast("int").asc()], 1).select(
        *by, F.col("key").alias("claim"), F.col("n").alias("claim_count"))
    rejections = _of(counts, "rejection")
    common = top_per_key(rejections, by, [F.desc("n"), F.asc("key")], 1).select(
        *by, F.col("key").alias("most_common"), F.col("n").alias("most_common_count"))
    sums = rejections.groupBy(*by).agg(F.sum("n").alias("total_rejections"))
    rows = (
        _of(counts, "rows").select(*by, F.col("n").alias("applications")).join(sums, by, "left").join(common, by, "left")
        .join(claims, by, "left").join(_mean_claims(counts, by).withColumnRenamed("n", "avg_claims_per_rejection"), by, "left")
        .join(months, by, "left")
    )
    rising = F.coalesce((F.col("_n") >= 2) & (F.col("_newest") > F.col("_oldest")), F.lit(False))
    text = F.concat_ws(
        "; ",
        F.concat(F.lit("Technology Center "), F.col("techCenter")),
        F.concat(F.lit("total rejections: "), F.coalesce("total_rejections", F.lit(0).cast("long"))),
        F.concat(F.lit("most common: Section "), F.col("most_common"), F.lit(" ("), F.col("most_common_count"), F.lit(" instances)")),
        F.concat(F.lit("average claims per rejection: "), F.format_string("%.2f", "avg_claims_per_rejection")),
        F.concat(F.lit("most frequently rejected claim: "), F.col("claim"), F.lit(" ("), F.col("claim_count"), F.lit(" times)")),
        F.concat(F.lit("total applications: "), F.col("applications")),
        F.concat(F.lit("recent trend: "), F.when(rising, "Increasing").otherwise("Decreasing")),
    )
    return rows.select("techCenter", text.alias("summary"), rising.alias("increasing"))


def success_rate(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent of applications without a rejection mark, rounded half up."""
    rejections = F.sum(F.size(P.rejection_types("passageLocationText")).cast("long"))
    share = F.try_divide(F.col("total_rejections").cast("double"), F.col("total_applications").cast("double"))
    return (
        actions.groupBy(*by)
        .agg(rejections.alias("total_rejections"), F.count("*").alias("total_applications"))
        .withColumn("success_rate", F.floor((1.0 - share) * 100.0 + 0.5).cast("long"))
    )


def citation_edges(actions: DataFrame, src: str = "publicationNumber", dst: str = "citedDocumentIdentifier") -> DataFrame:
    """Distinct citing and cited pairs with both ends present."""
    both = F.col(src).isNotNull() & F.col(dst).isNotNull()
    return actions.where(both).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
