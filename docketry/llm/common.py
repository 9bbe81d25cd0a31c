"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import cut_lineage

# Words of the shared contract: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces_of(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose values hold about ``limit`` bytes.

    A run has one row at least, so memory is bounded by ``limit`` plus one value.
    """
    begin, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_texts(df: DataFrame, id_column: str, text_column: str, schema: str, make: Callable[[], Callable],
              limit: int = 4_000_000, raw: bool = False) -> DataFrame:
    """Apply ``fn(ids, texts) -> dict of columns`` to runs of rows.

    ``make`` runs once per task and returns ``fn``. Null texts arrive as empty.
    With ``raw`` texts are UTF-8 bytes. Only the two named columns are read, so
    extra columns of any name do no harm.
    """
    want = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    fields = df.sparkSession.createDataFrame([], schema).schema
    names = fields.names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in pieces_of(batch, 1, limit):
                texts = part.column(1).cast(pa.binary()) if raw else part.column(1)
                out = fn(part.column(0).to_pylist(), texts.to_pylist())
                if len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], f.type) for n, f in zip(names, arrow)], names)

    return want.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node: ``(node, component)`` from ``(src, dst)``; roots are left out.

    Rounds of a large-star and a small-star step, until every node points at a
    root and no root points further; their number is logarithmic in the path
    lengths. A node's least neighbour is an aggregate with partial results in the
    map tasks and returns to the edges by a join, so a node with very many edges
    is never gathered. The edges are written after every round.
    """
    now = cut_lineage(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, and leads to a node without one."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("n"), F.min("e.out").alias("root"))
    return nodes.where("n > 1 OR (n > 0 AND root = 0)").limit(1).count() == 0
