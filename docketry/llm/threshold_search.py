"""Exact top-k search by the threshold algorithm.

Rows are dealt to blocks by the hash of their id. In each block every dimension
has a list of the rows sorted by their value. A query walks the lists of its
dimensions side by side, from the top where its own component is positive and
from the bottom where it is negative; each row met is scored in full at once. The
values at the next places of the lists bound the score of every row not met yet,
and the walk stops when that bound cannot beat the kth result so far. The blocks
of a first wave give each query a kth score that the other blocks start from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common_groups import sorted_groups
from docketry.operators.scaling import top_per_key
from docketry.session import cut_lineage

# Rows and queries of a block: what a task holds.
ROWS, QUERIES = 16_384, 4_096
# One in so many blocks of rows belongs to the first wave.
FIRST = 8
# Places of each list that the first step of a walk reads; each further step reads twice as many.
STEP = 4
LONG = 2**63 - 1


def within_long(scores: np.ndarray) -> np.ndarray:
    """Python integers beyond the range of long as its ends; others as they are."""
    return scores if scores.dtype != object else np.array([max(-LONG - 1, min(LONG, s)) for s in scores], object)


class SortedLists:
    """The rows of a block, and for each dimension their order by value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.up = np.argsort(self.values, axis=0, kind="stable")  # rows of each dimension's list, least value first
        self.most = max(-int(self.values.min()), int(self.values.max())) if self.values.size else 0
        self.plain = self.values.astype(np.float64)
        self.met = np.zeros(len(ids), bool)

    def top(self, query_id: int, query: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, list[int], int]:
        """``(ids, scores, rows scored)`` of the k best rows that reach ``least``; the query's own row is left out."""
        n, width = self.values.shape
        size = max((abs(int(x)) for x in query), default=0)
        exact = size * self.most * max(1, width) < 2**53  # float64 holds every partial sum
        weights = query.astype(np.float64) if exact else query.astype(object)
        values = self.plain if exact else self.values.astype(object)
        used = np.flatnonzero(query)
        down = query[used] > 0
        met, found, scores = self.met, np.zeros(0, np.int64), np.zeros(0, weights.dtype)
        met[:] = False
        depth, step, seen = 0, STEP, 0
        while depth < n:
            if len(used):
                # The best value that a row not met can have in each dimension stands at the next place.
                edge = self.up[np.where(down, n - 1 - depth, depth), used]
                bound = within_long((weights[used] * values[edge, used]).sum(keepdims=True))[0]
                kth = scores[k - 1] if len(scores) >= k else None
                if (kth is not None and bound < kth) or (least is not None and bound < least):
                    break
                upto = min(n, depth + step)
                fresh = np.concatenate([self.up[n - upto:n - depth, used[down]].ravel(), self.up[depth:upto, used[~down]].ravel()])
                fresh = np.flatnonzero(np.bincount(fresh, minlength=n).astype(bool) & ~met) if upto - depth > 8 else np.unique(fresh[~met[fresh]])
            else:  # every row scores zero
                upto, fresh = n, np.arange(n)
            met[fresh] = True
            seen += len(fresh)
            fresh = fresh[self.ids[fresh] != query_id]
            found = np.concatenate([found, fresh])
            scores = np.concatenate([scores, within_long(values[fresh] @ weights) if len(fresh) else np.zeros(0, weights.dtype)])
            if len(found) > k:
                best = np.argpartition(-scores, k - 1)[:k] if exact else np.argsort(-scores, kind="stable")[:k]
                keep = np.flatnonzero(scores >= scores[best].min())
                found, scores = found[keep], scores[keep]
            # Rows stand in the order of their ids, so equal scores keep the smaller ids.
            order = np.lexsort((found, -scores)) if exact else np.array(sorted(range(len(found)), key=lambda i: (-scores[i], found[i])), np.int64)
            found, scores = found[order][:k], scores[order][:k]
            depth, step = upto, step * 2
        if least is not None:
            keep = np.flatnonzero(scores >= least)
            found, scores = found[keep], scores[keep]
        return self.ids[found], [int(s) for s in scores], seen


def numbers(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``(id, v)``: usable rows with floor(scale * component) as integers."""
    x = F.col(vector_column)
    wrong = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    usable = df.where(F.col(id_column).isNotNull() & x.isNotNull()).where(~wrong)
    return usable.select(F.col(id_column).cast("long").alias("id"), whole.alias("v"))


def _matrix(lists: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    """Rows ``at`` of a list column, all of one width."""
    begin = lists.offsets.to_numpy()[:-1][at]
    flat = lists.values.to_numpy()
    return flat[begin[:, None] + np.arange(width)] if width else np.zeros((len(at), 0), np.int64)


def one_of_each_id(ids: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Row numbers with one row of each id: that with the greatest vector."""
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    if not len(same):
        return order
    best: dict[int, tuple] = {}
    for i in order.tolist():
        vector = tuple(lists[i].as_py())
        if ids[i] not in best or vector > best[ids[i]][0]:
            best[ids[i]] = (vector, i)
    return np.array(sorted(i for _, i in best.values()), np.int64)


def _searched(placed: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best of each block for each query in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, 2):
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                group = batch.slice(lo, hi - lo)
                lists = pa.concat_arrays([group.column(4)])
                ids, asks = group.column(2).to_numpy(), group.column(3).to_numpy(zero_copy_only=False).astype(bool)
                least = group.column(5).to_pylist()
                widths = np.diff(lists.offsets.to_numpy())
                rows = np.flatnonzero(~asks)
                rows = rows[one_of_each_id(ids[rows], lists.take(pa.array(rows)))]
                out: list[list] = [[], [], []]
                for width in np.unique(widths[asks]).tolist():
                    mine = rows[widths[rows] == width]
                    queries = np.flatnonzero(asks & (widths == width))
                    block = SortedLists(ids[mine], _matrix(lists, mine, width))
                    for q, vector in zip(queries.tolist(), _matrix(lists, queries, width)):
                        found, scores, _ = block.top(int(ids[q]), vector, k, least[q])
                        out[0] += [int(ids[q])] * len(scores)
                        out[1] += found.tolist()
                        out[2] += scores
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return placed.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of ``df`` with the greatest integer inner product with each query.

    Components x become floor(scale * x), with x as double; beyond the range of
    long they become its ends, as do scores. The result is exact. Equal scores go
    to the smaller id. A query's own id is no result. Vectors that are null or
    hold null or non-finite components take no part, nor do rows without an id.
    Of rows that share an id the one with the greatest vector takes part. A query
    meets rows of its own length only; empty vectors score 0 with each other.
    Fewer than k rows are all returned; an empty table gives no rows. Only the
    two named columns are read.
    """
    rows = cut_lineage(numbers(df, id_column, vector_column, scale))
    asked = cut_lineage(numbers(queries, id_column, vector_column, scale).groupBy("id").agg(F.max("v").alias("v")))
    row_blocks, query_blocks = -(-rows.count() // ROWS), -(-asked.count() // QUERIES)
    block = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(1, n))).cast("int")
    all_of = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
    placed_rows = rows.withColumn("rb", block(1, row_blocks))
    first = max(1, row_blocks // FIRST)

    def wave(lo: int, hi: int, asked: DataFrame) -> DataFrame:
        """The best of the row blocks from ``lo`` to below ``hi``."""
        mine = placed_rows.where(F.col("rb").between(lo, hi - 1)).select(
            "rb", all_of(0, max(1, query_blocks)).alias("qb"), "id", F.lit(False).alias("asks"), "v", F.lit(None).cast("long").alias("least")
        )
        theirs = asked.withColumn("qb", block(2, query_blocks)).select(
            all_of(lo, hi).alias("rb"), "qb", "id", F.lit(True).alias("asks"), "v", "least"
        )
        met = mine.unionByName(theirs).repartition("rb", "qb").sortWithinPartitions("rb", "qb")
        best = _searched(met, k)
        return cut_lineage(top_per_key(best, ["query_id"], [F.desc("score"), F.asc("vec_id")], k))

    out = wave(0, first, asked.withColumn("least", F.lit(None).cast("long")))
    if first < row_blocks:
        kth = out.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        bounded = asked.join(kth.select(F.col("query_id").alias("id"), "least"), "id", "left")
        out = out.unionByName(wave(first, row_blocks, bounded))
    ranked = top_per_key(out, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
