"""Collects the registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.sources.views import VIEWS, table, view, view_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables and views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` may use the named views.

    ``sql`` is the text after the view definitions: either a plain SELECT or
    ``, more AS (...) SELECT ...``.
    """

    def wrap(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            heads = ", ".join(f"{v} AS ({view_sql(v)})" for v in views)
            body = sql.strip()
            ORACLES[name] = f"WITH {heads} {body}" if heads else body
        return fn

    return wrap
