"""Reading landed files and writing results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry import schemas
from docketry.operators.cleaning import loaded_patents

_CSV = {"header": "true", "escape": '"', "quote": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with quoted line breaks. A file is read by one task, so keep files moderate."""
    return spark.read.schema(schema).options(**_CSV, multiLine="true").csv(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CASES_RAW)


def read_office_actions(spark: SparkSession, path: str) -> DataFrame:
    """Office actions with coerced dates, claim numbers and rejection types."""
    return loaded_patents(read_csv(spark, path, schemas.OFFICE_ACTIONS_RAW))


def read_result_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved search pages, one JSON object per line, to one row per result."""
    return spark.read.schema(schemas.API_PAGE).json(path).select(F.inline("results"))


def read_patent_pages(spark: SparkSession, path: str, max_records: int | None = None,
                      order: tuple[str, ...] = ("publicationNumber", "citedDocumentIdentifier")) -> DataFrame:
    """Saved patent pages to one row per record; with ``max_records``, the first so many in ``order``."""
    rows = spark.read.schema(schemas.PATENT_PAGE).json(path).select(F.inline("response.docs"))
    if max_records is None:
        return rows
    return rows.orderBy(*order, *[c for c in rows.columns if c not in order]).limit(max_records)


def lists_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, so that CSV can hold them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)})


def write_csv(df: DataFrame, folder: str, name: str, stamp: datetime | None = None) -> str:
    """Write CSV parts under a time-stamped folder and return its path."""
    when = (stamp or datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{folder}/patent_data_{when}_{name}"
    lists_as_json(df).write.options(**_CSV).csv(path)
    return path


def write_by_relevance(df: DataFrame, path: str, threshold: float = 0.2) -> str:
    """All rows in one write, split by relevance; the high part prunes on read."""
    high = F.coalesce(F.col("tech_relevance_score") >= threshold, F.lit(False))
    df.withColumn("high_relevance", high).write.partitionBy("high_relevance").parquet(path)
    return path


def save_tables(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Write derived tables for reuse; returns the path of each."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def load_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; dates in ISO form, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
