"""Mixing sources to target weights, in DataFrame functions only.

A source's weight is its share of all tokens raised to an exponent between 0
(all sources equal) and 1 (as found). Bisection finds the exponent that meets a
target entropy or a limit on repetition. Weights become token quotas. Every source
is dealt in passes; a pass is a permutation of blocks of rows and of the rows in
each block, and the last pass ends where the quota does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import WORD
from docketry.operators.scaling import broadcast_if_small
from docketry.session import cut_lineage

BLOCK_ROWS = 1024
# Halvings of the exponent's interval per pass over the source totals, and passes.
LEVELS, PASSES = 4, 6


@dataclass(frozen=True)
class Target:
    """What the mixture must meet.

    ``entropy``: share of the largest possible entropy, which all sources equal
    would have. ``repeats``: how often a source may be dealt. ``tokens``: size of
    the mixture, by default that of the input.
    """

    entropy: float | None = 0.97
    repeats: float = 4.0
    tokens: int | None = None


def source_key(source: Column) -> Column:
    """Sources as text; a missing source is a source of its own."""
    return F.coalesce(F.concat(F.lit("source "), source.cast("string")), F.lit("none"))


def slim_rows(df: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return df.select(
        F.col(id_column).cast("string").alias("id"), source_key(F.col(source_column)).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )


def _bisect(totals: DataFrame, total: int, meets) -> float:
    """The largest exponent in [0, 1], to within 16^-6, that ``meets(sum, log_sum, least)`` accepts.

    ``sum`` is that of the powered shares, ``log_sum`` that of powered shares times
    their logarithm, ``least`` the smallest share. One pass over the totals
    evaluates all points of ``LEVELS`` halvings.
    """
    share = F.col("tokens") / F.lit(float(total))

    def evaluate(points: list[float]) -> list[bool]:
        sums = []
        for i, a in enumerate(points):
            power = F.pow(share, F.lit(a))
            sums += [F.sum(power).alias(f"s{i}"), F.sum(power * F.log2(share)).alias(f"l{i}")]
        row = totals.agg(F.min(share).alias("least"), *sums).first()
        return [meets(a, row[f"s{i}"], row[f"l{i}"], row["least"]) for i, a in enumerate(points)]

    if evaluate([1.0])[0]:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        cells = 2**LEVELS
        points = [low + (high - low) * k / cells for k in range(1, cells)]
        accepted = evaluate(points)
        last = max((k + 1 for k, ok in enumerate(accepted) if ok), default=0)
        low, high = low + (high - low) * last / cells, low + (high - low) * (last + 1) / cells
    return low


def exponent(totals: DataFrame, total: int, sources: int, target: Target) -> float:
    """The exponent, rounded down (for entropy) or up (for repetition) to six places."""
    alpha = 1.0
    if target.entropy is not None and sources > 1:
        wanted = target.entropy * math.log2(sources)
        alpha = _bisect(totals, total, lambda a, s, l, _: math.log2(s) - a * l / s >= wanted)
        alpha = math.floor(alpha * 1e6) / 1e6
    size = float(target.tokens or total)

    def too_often(a: float, s: float, least: float) -> bool:
        return least ** (a - 1) / s * (size / total) > target.repeats

    row = totals.agg(F.min("tokens").alias("least"), F.sum(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))).alias("s")).first()
    if too_often(alpha, row["s"], row["least"] / total):
        found = _bisect(totals, total, lambda a, s, _, least: too_often(a, s, least))
        alpha = min(1.0, math.ceil((found + 16.0**-PASSES) * 1e6) / 1e6)
    return alpha


def _hex(*parts: Column | str) -> Column:
    """Sixteen hexadecimal digits that depend on the parts."""
    return F.substring(F.md5(F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 16)


def _block(id_: Column, blocks: Column, seed: str) -> Column:
    return F.pmod(F.conv(F.substring(_hex(seed, "block", id_), 1, 15), 16, 10).cast("long"), blocks)


def plan(slim: DataFrame, target: Target, seed: str) -> DataFrame:
    """One row per source that has tokens: weight, quota, full passes, and where the last pass ends.

    ``slim`` has ``(id, source, tokens)`` and is read several times. The last pass
    holds the blocks whose key is below ``cut_block``, and of that block the rows
    whose key is ``cut_row`` or below.
    """
    totals = cut_lineage(
        slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).where("tokens > 0")
    )
    whole = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total, sources = whole["t"] or 0, whole["n"]
    if not total:
        alpha, size, norm = 1.0, 0.0, 1.0
    else:
        alpha = exponent(totals, total, sources, target)
        size = min(float(target.tokens or total), target.repeats * total)
        norm = totals.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))).alias("s")).first()["s"]
    weight = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(alpha)) / F.lit(norm)
    quotas = (
        totals.withColumn("weight", weight)
        .withColumn("quota", F.round(F.col("weight") * F.lit(size)).cast("long"))
        .withColumn("passes", F.expr("quota div tokens").cast("int"))
        .withColumn("rest", F.expr("quota % tokens"))
        .withColumn("blocks", F.ceil(F.col("rows") / F.lit(float(BLOCK_ROWS))).cast("long"))
        .withColumn("alpha", F.lit(alpha))
    )
    quotas = broadcast_if_small(quotas)
    placed = slim.join(quotas.select("source", "passes", "rest", "blocks"), "source").withColumn("block", _block(_id(), F.col("blocks"), seed))
    keyed = placed.groupBy("source", "passes", "rest", "block").agg(F.sum("tokens").alias("tokens")).withColumn(
        "block_key", block_key(F.col("passes") + 1, F.col("source"), F.col("block"), seed)
    )
    up_to = Window.partitionBy("source").orderBy("block_key").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        keyed.withColumn("sum", F.sum("tokens").over(up_to)).where(F.col("sum") > F.col("rest"))
        .groupBy("source").agg(F.min(F.struct("block_key", "block", (F.col("rest") - F.col("sum") + F.col("tokens")).alias("left"))).alias("cut"))
        .select("source", "cut.block_key", "cut.block", "cut.left")
    )
    crossing = broadcast_if_small(crossing)  # a row per source
    rows = placed.select("id", "source", "tokens", "passes", "block").join(crossing, ["source", "block"]).withColumn(
        "row_key", row_key(F.col("passes") + 1, _id(), seed)
    )
    # Rows of one id share a key and are summed together.
    in_block = Window.partitionBy("source").orderBy("row_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        rows.withColumn("sum", F.sum("tokens").over(in_block))
        .where(F.col("sum") <= F.col("left")).groupBy("source").agg(F.max("row_key").alias("cut_row"))
    )
    return (
        quotas.join(crossing.select("source", F.col("block_key").alias("cut_block")), "source", "left")
        .join(last, "source", "left")
        .select("source", "tokens", "rows", "weight", "quota", "passes", "blocks", "alpha",
                F.coalesce("cut_block", F.lit("")).alias("cut_block"), F.coalesce("cut_row", F.lit("")).alias("cut_row"))
    )


def _id() -> Column:
    return F.coalesce("id", F.lit("none"))


def block_key(number: Column, source: Column, block: Column, seed: str) -> Column:
    """Place of a block in a pass, unlike that of any other block."""
    return F.concat_ws("/", _hex(seed, "order", number, source, block), F.lpad(block.cast("string"), 12, "0"))


def row_key(number: Column, id_: Column, seed: str) -> Column:
    return F.concat_ws("/", _hex(seed, "row", number, id_), id_)


def mixture(df: DataFrame, target: Target = Target(), id_column: str = "doc_id", text_column: str = "text",
            source_column: str = "source", seed: str = "mix") -> DataFrame:
    """The dealt rows: the input's columns, ``mix_copy`` (the pass, from 1) and ``mix_order``.

    Tokens are words between white space. Reading a source by ``(mix_copy,
    mix_order)`` gives its permutations in turn. Null texts have no tokens; a row
    without tokens is dealt with its block; a source without tokens has weight 0
    and is not dealt. A null source is a source of its own, a null id counts as
    the id ``none``. Rows that share an id share their place, and are dealt or
    left out together, so ties need no rule. When the target asks for more
    repetition than allowed at any exponent, the mixture is cut to the limit. An
    empty table gives an empty result. Input columns called ``mix_copy`` or
    ``mix_order`` are replaced; all others are carried along.
    """
    df = df.drop("mix_copy", "mix_order")
    slim = cut_lineage(slim_rows(df, id_column, text_column, source_column))
    return deal(df, plan(slim, target, seed), id_column, F.col(source_column), seed)


def deal(df: DataFrame, sources: DataFrame, id_column: str, source: Column, seed: str, keyed: bool = False) -> DataFrame:
    """Repeat and leave out rows of ``df`` as ``sources`` (from ``plan``) says."""
    names = df.columns
    sources = broadcast_if_small(sources.select(F.struct("source", "passes", "blocks", "cut_block", "cut_row").alias("_mix_plan"), F.col("source").alias("_mix_source")))
    key = source if keyed else source_key(source)
    rows = df.withColumn("_mix_source", key).withColumn("_mix_id", F.coalesce(F.col(id_column).cast("string"), F.lit("none")))
    rows = rows.join(sources, "_mix_source")
    p, id_ = F.col("_mix_plan"), F.col("_mix_id")
    rows = rows.withColumn("_mix_block", _block(id_, p["blocks"], seed))
    final = p["passes"] + 1
    place = block_key(final, p["source"], F.col("_mix_block"), seed)
    part = (place < p["cut_block"]) | ((place == p["cut_block"]) & (row_key(final, id_, seed) <= p["cut_row"]))
    copies = p["passes"] + F.when(part, 1).otherwise(0)
    rows = rows.withColumn("_mix_copies", copies).where("_mix_copies > 0")
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    order = F.concat_ws(
        "/", block_key(F.col("mix_copy"), p["source"], F.col("_mix_block"), seed), row_key(F.col("mix_copy"), id_, seed)
    )
    return rows.withColumn("mix_order", order).select(*[F.col(f"`{n}`") for n in names], "mix_copy", "mix_order")


def report(df: DataFrame, target: Target = Target(), id_column: str = "doc_id", text_column: str = "text",
           source_column: str = "source", seed: str = "mix") -> DataFrame:
    """The mixture without texts: ``(id, source, tokens, mix_copy, mix_order)``, one count per text."""
    slim = cut_lineage(slim_rows(df, id_column, text_column, source_column))
    return deal(slim, plan(slim, target, seed), "id", F.col("source"), seed, keyed=True)
