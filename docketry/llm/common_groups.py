"""Groups of rows streamed through Arrow tasks, and splitting of large groups into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups with the row numbers where groups begin, and the end.

    Rows come sorted by the first ``keys`` columns, which are integers without
    nulls. The last group of a batch waits for the next batch, so memory is one
    batch plus one group.
    """
    waiting = None
    for batch in batches:
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        changed = np.zeros(batch.num_rows - 1 if batch.num_rows else 0, bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            changed |= values[1:] != values[:-1]
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1]).astype(np.int64)
        if len(starts) > 1:
            yield batch.slice(0, int(starts[-1])), starts
        waiting = batch.slice(int(starts[-1])) if batch.num_rows else None
    if waiting is not None and waiting.num_rows:
        yield waiting, np.array([0, waiting.num_rows])


def block_pairs(part: Column, parts: Column) -> Column:
    """The pairs of parts ``(a <= b)`` in which a row of ``part`` is compared, as an array of structs.

    A group of any size is cut into ``parts``; every two parts meet once, so no
    task holds more than two parts and every two rows of the group meet.
    """
    return F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda other: F.struct(F.least(part, other).alias("a"), F.greatest(part, other).alias("b")),
    )


def near_ids(df: DataFrame, id_column: str, ids: DataFrame, name: str) -> DataFrame:
    """Rows whose id may be among ``ids``: those whose hash bucket holds one.

    The buckets, at most 2^20 integers whatever the input, are broadcast, so rows
    that cannot match leave the plan before any shuffle. An exact join follows.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    used = ids.select(bucket(F.col(name)).alias("_bucket")).distinct()
    return df.withColumn("_bucket", bucket(F.col(id_column))).join(F.broadcast(used), "_bucket", "left_semi").drop("_bucket")


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component in a symmetric boolean matrix."""
    n = len(linked)
    out = np.full(n, -1)
    for i in range(n):
        if out[i] < 0:
            reach = linked[i].copy()
            reach[i] = True
            edge = reach
            while edge.any():
                found = linked[edge].any(axis=0) & ~reach
                reach |= found
                edge = found
            out[reach] = i
    return out
