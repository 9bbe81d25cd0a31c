"""Divergence of sources by hash-consed segment trees over term ids.

Terms of a language are numbered in byte order and cut into ranges. For a range,
each source has a segment tree whose leaves are its counts; trees are built level
by level, and equal subtrees, within one tree or across trees, are one node. Two
trees are walked side by side: each level keeps the distinct pairs of nodes that
face each other, so an equal pair of nodes is priced once however often it occurs,
and prices are passed up through the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import pieces_of
from docketry.llm.common_groups import block_pairs
from docketry.operators.scaling import broadcast_if_small, global_rank, top_per_key
from docketry.session import cut_lineage

# Terms of a range, and sources of a language that one task holds from each side.
RANGE, SOURCES = 4096, 64
# Prices are shares of this.
UNIT = 10**9
# Added to every count.
PRIOR = 5
# Bytes of text that one count in a task covers.
RUN = 10_000_000

# Every byte of a term to itself with A-Z lower-cased, all others to a blank.
_TERMS = bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def term_counts(df: DataFrame) -> DataFrame:
    """``(lang, source, term, count, docs)`` from ``(lang, source, text)``: occurrences, and rows that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 2, RUN):
                numbers: dict[bytes, int] = {}
                groups: dict[tuple[str, str], int] = {}
                owner, words = [], []
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                    found = terms_of(text)
                    owner.append(groups.setdefault((lang, source), len(groups)))
                    words.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found)))
                if not numbers:
                    continue
                size = len(numbers)
                doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
                pair, times = np.unique(doc * size + np.concatenate(words), return_counts=True)
                del doc, words
                key, place = np.unique(np.array(owner)[pair // size] * size + pair % size, return_inverse=True)
                count = np.bincount(place, times, len(key)).astype(np.int64)
                docs = np.bincount(place, minlength=len(key))
                names = pa.array(list(numbers), pa.binary()).cast(pa.string())
                langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
                for i in range(0, len(key), 100_000):
                    own = pa.array(key[i:i + 100_000] // size)
                    yield pa.RecordBatch.from_arrays([
                        langs.take(own), sources.take(own), names.take(pa.array(key[i:i + 100_000] % size)),
                        pa.array(count[i:i + 100_000]), pa.array(docs[i:i + 100_000].astype(np.int64)),
                    ], ["lang", "source", "term", "count", "docs"])

    found = df.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


class Trees:
    """Segment trees over the columns of a matrix of counts, one for each row, with equal subtrees shared.

    Columns are filled up to a power of two with -1, which stands for no term.
    ``children[i]`` holds the left and right child of each distinct node of level
    ``i``, counted from the leaves; ``roots`` is each row's topmost node.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        full = np.full((len(counts), width), -1, np.int64)
        full[:, :counts.shape[1]] = counts
        self.leaves, nodes = np.unique(full, return_inverse=True)
        nodes = nodes.reshape(full.shape)
        size = len(self.leaves)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            pairs, upper = np.unique(nodes[:, 0::2] * size + nodes[:, 1::2], return_inverse=True)
            self.children.append((pairs // size, pairs % size))
            nodes, size = upper.reshape(len(nodes), -1), len(pairs)
        self.roots = nodes[:, 0]

    def facing(self, one: int, two: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct pairs of leaves that face each other in two trees, and for each level from the top the pairs below a pair."""
        a, b = self.roots[[one]], self.roots[[two]]
        below = []
        for level in range(len(self.children) - 1, -1, -1):
            left, right = self.children[level]
            size = len(self.children[level - 1][0]) if level else len(self.leaves)
            pairs, place = np.unique(np.concatenate([left[a] * size + left[b], right[a] * size + right[b]]), return_inverse=True)
            below.append(place.reshape(2, -1))
            a, b = pairs // size, pairs % size
        return a, b, below


def shares(leaves: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)) of each count; 0 where there is no term."""
    whole = total + PRIOR * terms
    return np.array([1 + UNIT * (c + PRIOR) // whole if c >= 0 else 0 for c in leaves.tolist()], np.int64)


def apart(trees: Trees, one: int, two: int, p: np.ndarray, q: np.ndarray) -> int:
    """Sum of |p - q| over all terms, from prices of distinct node pairs."""
    a, b, below = trees.facing(one, two)
    price = np.abs(p[a] - q[b])
    for left, right in reversed(below):
        price = price[left] + price[right]
    return int(price[0])


def above(trees: Trees, one: int, whole: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """p - q of every term whose count in the first tree is over 0, else 0; equal pairs of counts are priced once."""
    a, b, below = trees.facing(one, whole)
    price = np.where(trees.leaves[a] > 0, np.maximum(p[a] - q[b], 0), 0)
    at = np.zeros(1, np.int64)
    for left, right in below:  # from the top: which pair stands at each place
        at = np.stack([left[at], right[at]], axis=1).ravel()
    return price[at]


def audited_range(table: pa.Table, number: int, top: int) -> Iterator[tuple[str, str, str, int]]:
    """``(source, part, item, value)`` of the ``number``-th range of terms and two parts of a language's sources."""
    source, whole, side, total, terms, term = (table.column(n).to_pylist() for n in ("source", "whole", "side", "total", "terms", "term"))
    ids, counts = (table.column(n).to_numpy() for n in ("id", "count"))
    heads = {}  # row of the matrix, part and shares of each group; the language's own tree has no name
    for i in np.flatnonzero(ids < 0).tolist():
        heads[None if whole[i] else source[i]] = (len(heads), side[i], total[i])
    width = min(RANGE, terms[0] - number * RANGE)
    matrix = np.full((len(heads), max(1, width)), 0 if width else -1, np.int64)
    names = [None] * width
    for i in np.flatnonzero(ids >= 0).tolist():
        place = int(ids[i]) % RANGE
        matrix[heads[None if whole[i] else source[i]][0], place] = counts[i]
        if whole[i]:
            names[place] = term[i]
    trees = Trees(matrix)
    p = {row: shares(trees.leaves, n, terms[0]) for row, _, n in heads.values()}
    sources = sorted((s, row, part) for s, (row, part, _) in heads.items() if s is not None)
    left, right = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    for i, (s, row, part) in enumerate(sources):
        for t, other, across in sources[i + 1:]:
            if left == right or part != across:
                value = apart(trees, row, other, p[row], p[other])
                yield s, "pair", t, value
                yield t, "pair", s, value
        if left == right and width:
            language = heads[None][0]
            value = above(trees, row, language, p[row], p[language])[:width]
            some = np.flatnonzero(value)
            for k in some[np.argsort(-value[some], kind="stable")[:top]].tolist():
                yield s, "term", names[k], int(value[k])


def divergence(df: DataFrame, least_docs: int = 30, top: int = 50, lang_column: str = "lang", source_column: str = "source",
               text_column: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language lies from the others, and by which terms.

    A language keeps the terms in at least ``least_docs`` of its rows. Each
    (lang, source) group that occurs, and each language, gives a kept term
    p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)). Part ``pair`` sums |p - q| over
    the kept terms for each other source of the language; part ``term`` lists the
    ``top`` kept terms that the group holds and whose p exceeds the language's.
    Ranks count from 1 in each group and part by falling value, then by the
    item's bytes. All arithmetic is exact.

    Null languages, sources and texts read as empty strings. A language without
    kept terms has pairs of value 0 and no terms; a language with one source has
    no pairs. An empty table gives no rows. Repeated rows count each time; very
    long texts are read whole; other columns are not read.
    """
    empty = F.lit("")
    docs = df.select(
        F.coalesce(F.col(lang_column), empty).alias("lang"), F.coalesce(F.col(source_column), empty).alias("source"),
        F.coalesce(F.col(text_column), empty).alias("text"),
    )
    counts = cut_lineage(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    placed = global_rank(kept.select("lang", "term", "count"), [F.col("lang"), F.col("term")], "_place")
    placed = cut_lineage(placed)
    begins = placed.groupBy("lang").agg(F.min("_place").alias("begin"), F.count("*").alias("terms"), F.sum("count").alias("total"))
    begins = broadcast_if_small(begins)
    numbered = cut_lineage(placed.join(begins.select("lang", "begin"), "lang").select(
        "lang", "term", "count", (F.col("_place") - F.col("begin")).alias("id")
    ))
    known = cut_lineage(counts.select("lang", "source", "term", "count").join(numbered.select("lang", "term", "id"), ["lang", "term"]).select(
        "lang", "source", "id", "count"
    ))
    totals = known.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = cut_lineage(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(begins, "lang", "left").select(
        "lang", F.ceil(F.col("sources") / F.lit(float(SOURCES))).cast("int").alias("parts"),
        F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"),
    )
    langs = broadcast_if_small(langs)

    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(terms - 1) div {RANGE}")))).alias("range")
    side = F.pmod(F.xxhash64("source"), F.col("parts").cast("long")).cast("int").alias("side")
    nothing = {"id": F.lit(-1).cast("long"), "count": F.lit(0).cast("long"), "term": F.lit(None).cast("string")}
    in_langs = lambda rows: rows.join(langs.select("lang", "parts", "terms"), "lang")
    heads = in_langs(groups).select(
        "lang", ranges, "parts", "source", F.lit(False).alias("whole"), side, F.coalesce("total", F.lit(0)).alias("total"), "terms"
    ).withColumns(nothing)
    leaves = in_langs(known).select(
        "lang", F.expr(f"id div {RANGE}").alias("range"), "parts", "source", F.lit(False).alias("whole"), side,
        F.lit(0).cast("long").alias("total"), "terms", "id", "count", F.lit(None).cast("string").alias("term"),
    )
    own = heads.unionByName(leaves).withColumn("pair", F.explode(block_pairs(F.col("side"), F.col("parts"))))
    diagonal = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("a"), i.alias("b")))).alias("pair")
    mark = [F.lit("").alias("source"), F.lit(True).alias("whole"), F.lit(-1).alias("side")]
    language = langs.select("lang", ranges, "parts", *mark, "total", "terms").withColumns(nothing).unionByName(
        in_langs(numbered).select("lang", F.expr(f"id div {RANGE}").alias("range"), "parts", *mark, F.lit(0).cast("long").alias("total"), "terms", "id", "count", "term")
    ).select("*", diagonal)
    rows = own.unionByName(language).select("*", "pair.a", "pair.b").drop("pair", "parts")

    def run(key, table):
        found = list(audited_range(table, key[1].as_py(), top))
        columns = list(zip(*found)) if found else [[], [], [], []]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        arrays = [pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(found)), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
        return pa.table(arrays, ["lang", "source", "part", "item", "value"])

    priced = cut_lineage(rows.groupBy("lang", "range", "a", "b").applyInArrow(run, "lang string, source string, part string, item string, value long"))
    summed = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    by_pair = top_per_key(summed, ["lang", "source", "part"], order, 2**31 - 1, "rank")
    by_term = top_per_key(priced.where("part = 'term'"), ["lang", "source", "part"], order, top, "rank")
    return by_pair.unionByName(by_term).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
