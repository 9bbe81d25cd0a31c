"""Ordered near-duplicate removal in lists of any length.

Lists that lie in a row each and are short are judged where they lie; all others travel
with one row per item.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import token_jaccard, word_set
from docketry.operators.scaling import broadcast_if_small
from docketry.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

# Items and characters of a list that is judged within its row; longer ones are told apart item by item.
ROW_ITEMS, ROW_CHARS = 1000, 200_000
# The characters of ``functions.text.SPACE``; those of \p{Z} end at U+3000.
BLANKS = "".join({*" \t\n\x0b\f\r", *(chr(c) for c in range(0x3001) if unicodedata.category(chr(c))[0] == "Z")})
# What ``str.split`` takes for blank and the pattern does not.
_APART = re.compile("[\x1c-\x1f\x85]")


def similar_items(items: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """``(keys, a, b)``: items ``a`` before ``b`` of one list whose token sets overlap by more than ``threshold``.

    ``items`` holds ``(keys, position, tokens)`` with distinct token sets per list.
    Two sets that overlap that much share a token among the rarest of each, as
    many as the threshold leaves open, and differ little in size. Only items that
    share such a token are compared, so common words pair nothing.
    """
    # Words travel as hashes; the sets themselves decide in the end.
    hashed = F.transform("tokens", lambda t: F.xxhash64(t))
    tokens = items.select(*keys, "position", F.size("tokens").alias("n"), F.explode(hashed).alias("token"))
    counts = tokens.groupBy(*keys, "token").agg(F.count("*").alias("_items"))
    # A token of one item pairs nothing, but it takes a place among the rarest.
    order = Window.partitionBy(*keys, "position").orderBy("_items", "token")
    ranked = tokens.join(counts, [*keys, "token"]).withColumn("_place", F.row_number().over(order))
    # Sets with overlap j have at least j * n tokens in common; the small amount guards against rounding.
    open_places = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    rare = cut_lineage(ranked.where((F.col("_place") <= open_places) & (F.col("_items") > 1)).select(*keys, "position", "n", "token"))
    left = rare.select(*keys, "token", F.col("position").alias("a"), F.col("n").alias("_na"))
    right = rare.select(*keys, "token", F.col("position").alias("b"), F.col("n").alias("_nb"))
    near_size = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * threshold - 1e-9
    pairs = left.join(right, [*keys, "token"]).where((F.col("a") < F.col("b")) & near_size).select(*keys, "a", "b").distinct()
    sets = items.select(*keys, "position", "tokens")
    return (
        pairs.join(sets.withColumnsRenamed({"position": "a", "tokens": "_x"}), [*keys, "a"])
        .join(sets.withColumnsRenamed({"position": "b", "tokens": "_y"}), [*keys, "b"])
        .where(token_jaccard(F.col("_x"), F.col("_y")) > threshold).select(*keys, "a", "b")
    )


def dropped_in_order(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, position)`` of the items that one pass in order would drop, given the links between items.

    In each round the undecided items without an undecided one before them among
    their links stay, and the items linked after those go. A round settles at
    least the first item of every list that has links; most lists need two or three.
    """
    open_links = cut_lineage(links)
    dropped = None
    while not open_links.isEmpty():
        waiting = open_links.select(*keys, F.col("b").alias("a")).distinct()
        stay = open_links.select(*keys, "a").distinct().join(waiting, [*keys, "a"], "left_anti")
        gone = cut_lineage(open_links.join(stay, [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("position")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        for end in ("a", "b"):
            open_links = open_links.join(gone.withColumnRenamed("position", end), [*keys, end], "left_anti")
        open_links = cut_lineage(open_links)
    return links.select(*keys, F.col("a").alias("position")).limit(0) if dropped is None else dropped


def without_near_duplicates(items: DataFrame, keys: Sequence[str], threshold: float, position: str = "position",
                            text: str = "text") -> DataFrame:
    """The items of each list that are not near duplicates of a kept item before them, with all their columns.

    The result of one greedy pass over every list (``functions.text.drop_near_duplicates``),
    without a row that holds a list. Null texts count as empty; items without
    words are like nothing and stay. Positions are distinct within a list, null keys
    are a list of their own, and the threshold lies in [0, 1); a list may be of any length.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold lies in [0, 1)")
    # In a struct, null keys join as a value of their own.
    names = ["_list"]
    keyed = [F.struct(*keys)]
    whole = cut_lineage(items.withColumns({n: c for n, c in zip(names, keyed)}).withColumnRenamed(position, "_position"))
    sets = whole.select(*names, F.col("_position").alias("position"), F.array_sort(word_set(F.coalesce(F.col(text), F.lit("")))).alias("tokens"))
    sets = sets.where(F.size("tokens") > 0)
    # Items with equal sets are judged by the first of them; the others always go.
    first = cut_lineage(sets.groupBy(*names, "tokens").agg(F.min("position").alias("position")))
    gone = dropped_in_order(similar_items(first, names, threshold), names)
    kept = first.join(gone, [*names, "position"], "left_anti").select(*names, F.col("position").alias("_position"))
    worded = F.size(word_set(F.coalesce(F.col(text), F.lit("")))) > 0
    stay = whole.where(worded).join(broadcast_if_small(kept), [*names, "_position"], "left_semi")
    return stay.unionByName(whole.where(~worded)).drop(*names).withColumnRenamed("_position", position).select(*items.columns)


def words_of(item: str) -> frozenset[str]:
    """The distinct words of a lower-case item, as ``functions.text.word_set`` finds them."""
    return frozenset(w for w in re.split(f"[{BLANKS}]+", item) if w) if _APART.search(item) else frozenset(item.split())


def kept_places(items: Sequence[str], threshold: float) -> list[int]:
    """Places that one greedy pass over a list of lower-case items keeps; see ``without_near_duplicates``.

    An item is compared with the kept ones that share one of the rarest words of both, as in ``similar_items``.
    """
    first, alone = {}, []
    for place, item in enumerate(items):
        words = words_of(item)
        if words:
            first.setdefault(words, place)
        else:
            alone.append(place)
    once, shared = set(), set()
    for words in first:
        shared |= words & once
        once |= words
    # An item that shares fewer words with all others than a near duplicate must is like none of them.
    sets = []
    for words, place in first.items():
        common = words & shared
        if common and len(common) >= len(words) * threshold - 1e-9:
            sets.append((place, words, common))
        else:
            alone.append(place)
    counts = Counter(w for _, _, common in sets for w in common)
    rank = {w: i for i, w in enumerate(sorted(counts, key=counts.__getitem__))}
    index, kept = defaultdict(list), alone
    for place, words, common in sets:
        n = len(words)
        # Words of no other item come first and pair nothing.
        open_places = n - math.ceil(n * threshold - 1e-9) + 1 - (n - len(common))
        rare = sorted(common, key=rank.__getitem__)[:open_places]
        near = {other for w in rare for other in index[w]}
        if any(len(words & other) / len(words | other) > threshold for other in near
               if min(n, len(other)) >= max(n, len(other)) * threshold - 1e-9):
            continue
        kept.append(place)
        for w in rare:
            index[w].append(words)
    return sorted(kept)


def lists_without_near_duplicates(df: DataFrame, lists: str, threshold: float, position: str = "position", text: str = "text") -> DataFrame:
    """The other columns, ``position`` (from 0) and ``text`` of the items that are not near duplicates of a kept item before them.

    Each row of ``df`` holds a list in the ``array<string>`` column ``lists``, and is a list of its own.
    Lists of at most ``ROW_ITEMS`` items and ``ROW_CHARS`` characters stay in their row and cause no
    shuffle; longer ones go through ``without_near_duplicates``, with the same result.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold lies in [0, 1)")
    others = [c for c in df.columns if c != lists]

    @F.arrow_udf("array<int>")
    def places(column: pa.Array) -> pa.Array:
        return pa.array([None if items is None else kept_places(items, threshold) for items in column.to_pylist()], pa.list_(pa.int32()))

    short = (F.size(lists) <= ROW_ITEMS) & (F.length(F.array_join(lists, "")) <= ROW_CHARS)
    kept = places(F.transform(lists, lambda x: F.lower(F.coalesce(x, F.lit("")))))
    item = lambda p: F.struct(p.alias(position), F.get(F.col(lists), p).alias(text))
    out = df.where(short).withColumn("_kept", kept).select(*others, F.inline(F.transform("_kept", item)).alias(position, text))
    long = cut_lineage(df.where(~short))
    if long.isEmpty():
        return out
    items = long.withColumn("_row", F.monotonically_increasing_id()).select(*others, "_row", F.posexplode(lists).alias(position, text))
    return out.unionByName(without_near_duplicates(items, ["_row"], threshold, position, text).drop("_row"))
