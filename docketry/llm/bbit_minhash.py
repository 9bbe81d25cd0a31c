"""Near-duplicate texts by b-bit MinHash.

One pass over the texts gives each one's number of distinct shingles, a digest of
its shingle set, band hashes of its minima, and a packed signature of the low
bits of all minima. Texts with equal sets form a class, of which one member goes
on. Inside a band bucket, similarity is estimated from the signatures by bit
counts, corrected for the equal low bits of unequal minima; classes whose
estimate reaches the lower confidence bound form coarse clusters. The full sets
of a cluster's members are then compared, which decides every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import components, map_texts
from docketry.llm.common_groups import block_pairs, near_ids, roots, sorted_groups
from docketry.operators.scaling import broadcast_if_small
from docketry.session import cut_lineage

MINIMA = 128
BITS = 4
ROWS = 4  # minima per band
# Chance that a pair at the threshold meets in no band.
MISS = 1e-5
# Standard errors that the estimate may fall short of the threshold.
SLACK = 4.5
# Rows in a part of a large bucket, and rows and shingles in a part of a large cluster.
BUCKET_PART, CLUSTER_PART, CLUSTER_SHINGLES = 512, 256, 2_000_000

_SEEDS = np.random.default_rng(20240607)
_MASKS = _SEEDS.integers(0, 2**64, MINIMA, dtype=np.uint64)
_FACTORS = _SEEDS.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_NIBBLE_ONES = np.uint64(0x1111111111111111)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased, words are runs without ASCII white space. A text with
    fewer words than ``width`` has one shingle, its whole word sequence; a text
    without words has none.
    """
    numbers: dict[bytes, int] = {}
    words = [text.lower().split() for text in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    place = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, int(lengths.sum()))
    del words
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[place]
    total = len(codes)
    shingles = np.zeros(max(0, total - width + 1), np.uint64)
    for k in range(width):
        shingles = mixed(shingles * _PRIMES[0] + codes[k:k + len(shingles)] + np.uint64(k))
    out, begin = [], 0
    for n in lengths.tolist():
        if n >= width:
            out.append(np.unique(shingles[begin:begin + n - width + 1]))
        elif n:
            short = np.uint64(n) * _PRIMES[1:2]
            for c in codes[begin:begin + n]:
                short = mixed(short * _PRIMES[2] + c)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        begin += n
    return out


def minima_of(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each permutation over each non-empty set, one row per set."""
    joined = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), MINIMA), np.uint64)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat((joined ^ _MASKS[k]) * _FACTORS[k], begin)
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of scrambled minima, 16 to a 64-bit word."""
    low = (mixed(minima) & np.uint64(2**BITS - 1)).reshape(len(minima), MINIMA * BITS // 64, 64 // BITS)
    shift = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low << shift, axis=2)


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(minima), b + 1, np.uint64)
        for r in range(rows):
            key = mixed(key * _PRIMES[0] + minima[:, b * rows + r])
        out[:, b] = key
    return out


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of a signature to others, by counting equal low-bit groups."""
    apart = many ^ one
    apart |= apart >> np.uint64(1)
    apart |= apart >> np.uint64(2)
    equal = MINIMA - np.bitwise_count(apart & _NIBBLE_ONES).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands, and minima of a band, after which a pair at the threshold stays unmet with probability ``MISS`` at most.

    Low thresholds take fewer minima to a band, so that the bands fit the minima.
    """
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-min(1 - 1e-9, (percent / 100) ** rows)))
        if bands * rows <= MINIMA:
            return bands, rows
    raise ValueError(f"{MINIMA} minima are too few for a threshold of {percent} %")


def least_estimate(percent: int) -> float:
    """Lower confidence bound of the estimate for a pair at the threshold."""
    chance = 2.0**-BITS
    p = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - SLACK * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


def signatures(df: DataFrame, width: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """``(id, n_shingles, set_key, signature, bands)`` of every row; texts without words have an id of their own as key."""

    def make():
        def run(ids, texts):
            sets = shingle_sets(texts, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = [b"row " + str(i).encode() for i in ids]
            signature, hashes = [None] * len(ids), [None] * len(ids)
            if full:
                minima = minima_of([sets[i] for i in full])
                for i, p, h in zip(full, packed(minima), band_hashes(minima, bands, rows).view(np.int64)):
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    signature[i], hashes[i] = p.tobytes(), h
            return {"id": ids, "n_shingles": [len(s) for s in sets], "set_key": keys, "signature": signature, "bands": hashes}

        return run

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_shingles long, set_key binary, signature binary, bands array<long>"
    return map_texts(df, id_column, text_column, schema, make, raw=True)


def coarse_links(classes: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)`` links, linear in the rows, whose components hold all pairs that may be similar enough."""
    rows = classes.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(float(BUCKET_PART))).cast("int")
    part = F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    placed = (
        rows.join(shared, "key").withColumn("parts", parts).withColumn("part", part)
        .withColumn("pair", F.explode(block_pairs(F.col("part"), F.col("parts"))))
        .select("id", "key", "pair.a", "pair.b", "part")
        .join(classes.select("id", "n_shingles", "signature"), "id")
        .select("key", "a", "b", "part", "id", "n_shingles", "signature")
        .repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    )
    least, ratio = least_estimate(percent), percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, 3):
            first, second = (batch.column(i).to_numpy() for i in (1, 2))
            part, ids, sizes = (batch.column(i).to_numpy() for i in (3, 4, 5))
            signature = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, MINIMA * BITS // 64)
            src, dst = [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                n = hi - lo
                linked = np.zeros((n, n), bool)
                across = first[lo] != second[lo]
                s, z = signature[lo:hi], sizes[lo:hi]
                for i in range(n):
                    if across and part[lo + i] != first[lo]:
                        continue
                    begin = 0 if across else i + 1
                    near = estimates(s[i], s[begin:]) >= least
                    near &= np.minimum(z[begin:], z[i]) >= ratio * np.maximum(z[begin:], z[i])
                    if across:
                        near &= part[lo:hi] == second[lo]
                    linked[i, begin:] = near
                linked |= linked.T
                top = roots(linked)
                moved = np.flatnonzero(top != np.arange(n))
                src.append(ids[lo + moved])
                dst.append(ids[lo + top[moved]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return placed.mapInArrow(run, "src long, dst long")


def confirmed_links(df: DataFrame, clusters: DataFrame, width: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """``(src, dst)`` links between cluster members that full sets confirm; linear in the rows.

    ``clusters`` has ``(id, cluster, n_shingles)``. Pairs that earlier links already
    connect inside a block are not compared again.
    """
    sized = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    parts = F.greatest(
        F.ceil(F.col("n") / F.lit(float(CLUSTER_PART))), F.ceil(F.col("weight") / F.lit(float(CLUSTER_SHINGLES)))
    ).cast("int")
    members = (
        clusters.join(sized, "cluster").withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
        .select("id", "cluster", "parts", "part")
    )
    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text")).where("text IS NOT NULL")
    placed = (
        near_ids(texts, "id", clusters, "id").join(members, "id")
        .withColumn("pair", F.explode(block_pairs(F.col("part"), F.col("parts"))))
        .select("cluster", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "part", "id", "text")
        .repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, 3):
            src, dst = [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                group = batch.slice(lo, hi - lo)
                a, b = group.column(1)[0].as_py(), group.column(2)[0].as_py()
                part, ids = group.column(3).to_numpy(), group.column(4).to_numpy()
                top = exact_roots(shingle_sets(group.column(5).to_pylist(), width), part == a, part == b, percent)
                moved = np.flatnonzero(top != np.arange(len(top)))
                src.append(ids[moved])
                dst.append(ids[top[moved]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return placed.mapInArrow(run, "src long, dst long")


def exact_roots(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Component of each set, linking a left and a right one when 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    full = np.flatnonzero(sizes)
    if len(full) < 2:
        return root
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    seen = np.zeros(len(values), np.int32)
    for i in full[left[full]].tolist():
        others = full[right[full] & (full > i if left[i] and right[i] else full != i) & (root[full] != root[i])]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * small >= percent * large]
        if not len(others):
            continue
        own = place[begin[i]:begin[i + 1]]
        seen[own] = 1
        low, high = int(others[0]), int(others[-1]) + 1
        common = np.cumsum(np.concatenate([[0], seen[place[begin[low]:begin[high]]]]))
        both = common[begin[others + 1] - begin[low]] - common[begin[others] - begin[low]]
        seen[own] = 0
        for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)].tolist():
            if root[j] != root[i]:
                one, two = sorted((root[i], root[j]))
                root[root == two] = one
    return root


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row.

    Two texts are linked when 100 * intersection >= percent * union of their sets
    of ``width``-word shingles. ``component_id`` is the smallest id reachable by
    links; the row with that id is kept. Ids are integers. Null and empty texts
    and texts of white space have no shingles, link with nothing and are kept.
    Equal texts are one class, however many rows hold them. A row with a null id
    links with nothing, has a null component and is kept; rows that share an id
    count as one node. Only the two named columns are read. Every link found is
    exact; a pair at the threshold is missed with probability ``MISS`` plus that
    of an estimate ``SLACK`` standard errors low. An empty table gives an empty
    result; very long texts are read whole. Sets are compared by 64-bit hashes of
    their shingles.
    """
    bands, rows = bands_for(percent)
    signed = cut_lineage(signatures(df, width, bands, rows, id_column, text_column).withColumn("id", F.col("id").cast("long")))
    usable = signed.where("n_shingles > 0 AND id IS NOT NULL")
    least = usable.groupBy("set_key").agg(F.min("id").alias("id"))
    classes = cut_lineage(
        usable.join(least, ["set_key", "id"], "left_semi").dropDuplicates(["id", "set_key"])
    )
    rough = components(coarse_links(classes, percent))
    named = rough.union(rough.select("component", "component")).distinct().toDF("id", "cluster")
    clusters = cut_lineage(named.join(classes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), "id"))
    found = components(confirmed_links(df, clusters, width, percent, id_column, text_column))
    of_set = classes.select("set_key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component")
    ).groupBy("set_key").agg(F.min("component").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return (
        signed.select("id", "n_shingles", "set_key").join(of_set, "set_key", "left")
        .select("id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(df: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that with the smallest id.

    Rows without words or without an id all stay. Rows that share an id stay once
    when they are equal in every column.
    """
    marks = cut_lineage(near_duplicates(df, width, percent, id_column, text_column))
    dropped = broadcast_if_small(marks.where("NOT kept").select(F.col("id").alias("_dropped")).distinct())
    rows = df.join(dropped, df[id_column].cast("long") == dropped["_dropped"], "left_anti")
    often = marks.where("kept AND id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    often = broadcast_if_small(often.select(F.col("id").alias("_often")))
    same = rows[id_column].cast("long") == often["_often"]
    return rows.join(often, same, "left_anti").unionByName(rows.join(often, same, "left_semi").dropDuplicates())
