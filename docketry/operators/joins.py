"""Enriching cases from docket, party and cluster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import lexicons
from docketry.functions import text as X


def enriched_cases(cases: DataFrame, dockets: DataFrame, parties: DataFrame, clusters: DataFrame) -> DataFrame:
    """Left-join dockets, party counts and clusters; found values replace the old ones.

    Parties are counted per docket before the join, so a docket with many parties
    sends one row per input partition; ``party_details`` lists them. The dates of
    the docket, those of the columns in ``lexicons.DOCKET_EVENTS`` that it has,
    become ``procedural_events``.
    """
    d = dockets.select(
        F.col("id").alias("_docket"), F.col("assignedTo").alias("_judge"), F.col("nature_of_suit").alias("case_type"),
        F.col("jurisdiction_type").alias("jurisdiction"), F.col("appellate_fee_status").alias("appellate_status"),
        procedural_events(dockets).alias("procedural_events"),
    )
    p = parties.groupBy(F.col("docket_id").alias("_party")).agg(F.count("*").alias("party_count"))
    c = clusters.select(
        F.col("id").alias("_cluster"), F.col("precedential_status").alias("_status"),
        F.col("citing").alias("citing_cases"), F.col("cited_by").alias("cited_by_cases"),
    )
    joined = (
        cases.join(d, F.col("docket_id") == F.col("_docket"), "left")
        .join(p, F.col("docket_id") == F.col("_party"), "left")
        .join(c, F.col("cluster_id") == F.col("_cluster"), "left")
    )
    return joined.withColumns(
        {"assigned_judge": F.coalesce("_judge", "judge"),
         "precedential_status": F.coalesce("_status", "precedential_status"),
         "party_count": F.coalesce("party_count", F.lit(0)),
         "parties_in_name": X.parties("case_name")}
    ).drop("_docket", "_party", "_cluster", "_judge", "_status")


def procedural_events(dockets: DataFrame) -> Column:
    """Dated events of a docket in order of date, each with its kind and a description."""
    events = [
        F.when(F.col(column).isNotNull(), F.struct(
            F.col(column).cast("string").alias("date"), F.lit(i).alias("_at"), F.lit(kind).alias("event_type"),
            F.lit(lexicons.EVENT_DESCRIPTION.format(kind)).alias("description")))
        for i, (kind, column) in enumerate(lexicons.DOCKET_EVENTS) if column in dockets.columns
    ]
    if not events:
        return F.array().cast("array<struct<date:string,event_type:string,description:string>>")
    ordered = F.sort_array(F.array_compact(F.array(*events)))  # by date, then in the order of the kinds
    return F.transform(ordered, lambda e: F.struct(e["date"].alias("date"), e["event_type"].alias("event_type"), e["description"].alias("description")))


def party_details(cases: DataFrame, parties: DataFrame) -> DataFrame:
    """One row per case and party of its docket, with the party's attorneys."""
    p = parties.select(
        F.col("docket_id").alias("_docket"),
        X.party_record("name", "role", "type", "attorneys").alias("party"),
    )
    return cases.join(p, F.col("docket_id") == F.col("_docket")).select("id", "party.*")
