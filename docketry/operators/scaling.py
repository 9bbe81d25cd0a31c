"""Building blocks that stay bounded when one key, or the whole table, is large."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import cut_lineage

# A side is broadcast only when its counted rows and their size as text stay below these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key.

    The limit on ``row_number`` runs once before the shuffle, so a hot key sends
    at most ``k`` rows per input partition.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a table stays within the limits; at most ``rows + 1`` rows are read."""
    rows = BROADCAST_ROWS if rows is None else rows
    width = F.octet_length(F.to_json(F.struct("*")))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return seen["n"] <= rows and seen["size"] <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write a result once, and mark it for broadcast when it stays within the limits.

    Measuring and joining both read the written table, so ``df`` is computed once.
    """
    written = cut_lineage(df)
    return F.broadcast(written) if fits_broadcast(written, rows) else written


def running_sums(names: Sequence[str]):
    """Arrow batches of one sorted partition to the same batches with running totals in place of the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = dict.fromkeys(names, 0)
        for batch in batches:
            for name in names:
                at = batch.schema.get_field_index(name)
                values = pc.fill_null(batch.column(at), 0).to_numpy(zero_copy_only=False)
                totals = np.cumsum(values) + before[name]
                before[name] = totals[-1] if len(totals) else before[name]
                batch = batch.set_column(at, name, pa.array(totals, batch.column(at).type))
            yield batch

    return run


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column],
                partitions: int | None = None) -> DataFrame:
    """Running totals over the whole table in ``order``, without a one-task window.

    Rows are range-partitioned and sorted, and each task adds up its own range as
    it writes; the totals of the ranges before, one number per range, are added
    on reading. ``order`` should end in a unique key; equal keys land in one range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [f"_v_{name}" for name in sums]
    values = df.select("*", *[v.alias(c) for v, c in zip(sums.values(), columns)], *[v.alias(f"_own{c}") for v, c in zip(sums.values(), columns)])
    ranged = values.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged.mapInArrow(running_sums(columns), ranged.schema))
    totals = (
        ranged.groupBy("_range").agg(*[F.sum(f"_own{c}").alias(c) for c in columns]).orderBy("_range")
        .collect()  # one row per range, at most n
    )
    before, running = [], [0] * len(sums)
    for row in totals:
        before.append((row["_range"], *running))
        running = [r + (row[c] or 0) for r, c in zip(running, columns)]
    kinds = [ranged.schema[c].dataType.simpleString() for c in columns]
    offsets = spark.createDataFrame(before, "_range int, " + ", ".join(f"`_b{c}` {k}" for c, k in zip(columns, kinds)))
    out = ranged.join(F.broadcast(offsets), "_range")  # one row per range
    out = out.withColumns({name: F.col(c) + F.col(f"_b{c}") for name, c in zip(sums, columns)})
    return out.drop("_range", *columns, *[f"_own{c}" for c in columns], *[f"_b{c}" for c in columns])


def global_rank(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Position from 1 over the whole table, in ``order``."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")}, partitions)


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], bins: int = 1024) -> list[float]:
    """Exact interpolated quantiles, found by narrowing histograms.

    Each pass counts values per bin inside the brackets that still hold a wanted
    rank and keeps the bin's own minimum and maximum. Brackets shrink about a
    thousandfold per pass until one distinct value is left. The driver sees
    counts per bin only.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    head = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = head["n"]
    if n == 0:
        return [float("nan")] * len(probabilities)
    wanted = {}
    for p in probabilities:
        exact = (n - 1) * p
        low = int(exact)
        wanted[p] = (low, min(low + 1, n - 1), exact - low)
    ranks = sorted({r for low, high, _ in wanted.values() for r in (low, high)})
    bracket = {r: (head["lo"], head["hi"], 0) for r in ranks}  # value range, rows below it
    while True:
        open_ = sorted({b for b in bracket.values() if b[0] < b[1]})
        if not open_:
            break
        lists = []
        for i, (lo, hi, _) in enumerate(open_):
            # Scaled before subtracting, so the width cannot overflow.
            share = (F.col("v") / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
            cell = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
            lists.append(F.when(F.col("v").between(lo, hi), F.struct(F.lit(i).alias("b"), cell.alias("c"))))
        rows = (
            values.select("v", F.explode(F.array_compact(F.array(*lists))).alias("x"))
            .groupBy("x.b", "x.c")
            .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()  # at most bins rows per open bracket
        )
        cells: dict[int, list] = {}
        for row in sorted(rows, key=lambda r: (r["b"], r["c"])):
            cells.setdefault(row["b"], []).append(row)
        for r in ranks:
            if bracket[r] not in open_:
                continue
            below = bracket[r][2]
            for cell in cells[open_.index(bracket[r])]:
                if r < below + cell["n"]:
                    bracket[r] = (cell["lo"], cell["hi"], below)
                    break
                below += cell["n"]
    return [
        bracket[low][0] + (bracket[high][0] - bracket[low][0]) * part for low, high, part in wanted.values()
    ]


def neighbours(df: DataFrame, file: str, row_no: str, block: int = 100_000) -> DataFrame:
    """Give each row its block and the rows next to the block's edges.

    Rows are numbered without gaps in the order of (file, row_no) first, so
    ``row_no`` may have gaps anywhere. Rows at an edge are copied into the block
    beside them with ``_own`` false, so ``lead`` and ``lag`` over (file, block) see
    across edges while no window holds more than ``block + 2`` rows.
    """
    ranked = global_rank(df, [F.col(file), F.col(row_no)], "_pos")
    n = F.col("_pos")
    own = F.floor(n / block).cast("long")
    blocks = F.array_distinct(F.array(own, F.floor((n - 1) / block).cast("long"), F.floor((n + 1) / block).cast("long")))
    return (
        ranked.withColumn("_home", own)
        .withColumn("_block", F.explode(blocks))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home", "_pos")
    )
