"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is scaled to length one and turned by several random rotations. The
signs of its coordinates are its code; the length of its projection on the code's
direction is the stored correction factor. For a vector q and a code c of x, the
quotient <q, c> / <x, c> estimates <q, x> without bias, and its error stays below
a known bound but for a stated chance. Runs of code bits are bucket keys. Inside a
bucket the estimate rules out what lies below the threshold by more than the
bound, and the rest is computed exactly in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import components
from docketry.llm.common_groups import block_pairs, sorted_groups
from docketry.session import cut_lineage

BITS = 16  # code bits in a bucket key
# Chance that a pair at the threshold meets in no bucket.
MISS = 1e-5
# Standard deviations in the confidence bound of an estimate.
SLACK = 5.0
# Rows in a part of a large bucket.
PART = 512
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def keys_for(threshold: float) -> int:
    """Bucket keys after which a pair at the threshold stays unmet with probability ``MISS`` at most."""
    agree = 1 - math.acos(threshold) / math.pi  # of one bit
    return math.ceil(math.log(MISS) / math.log1p(-(agree**BITS)))


def rotations(width: int, bits: int) -> np.ndarray:
    """The first ``bits`` rows of a stack of random rotations of ``width`` dimensions."""
    key = (width, bits)
    if key not in _ROTATIONS:
        if len(_ROTATIONS) > 8:
            _ROTATIONS.clear()
        rng = np.random.default_rng([20240521, width])
        turns = []
        while sum(map(len, turns)) < bits:
            q, r = np.linalg.qr(rng.standard_normal((width, width)))
            turns.append((q * np.sign(np.diag(r))).T)
        _ROTATIONS[key] = np.concatenate(turns)[:bits]
    return _ROTATIONS[key]


def encoded(units: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, correction factors and bucket keys of unit vectors."""
    turned = units @ rotations(units.shape[1], keys * BITS).T
    signs = turned > 0
    factor = np.abs(turned).sum(axis=1) / turned.shape[1]
    packed = np.packbits(signs, axis=1, bitorder="little")
    hashes = packed.view(f"<u{BITS // 8}").astype(np.int64)
    return packed, factor, hashes


def bound(factor: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Half width of the confidence interval of an estimate made with a code.

    A unit vector leaves, beside its own direction, a residue in each rotated
    code; ``factor`` is the mean of absolute coordinates, at most 1 / sqrt(width).
    """
    rest = np.maximum(0.0, 1.0 / width - factor**2)
    return SLACK * np.sqrt(rest / rows) / factor


def estimates(queries: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of unit vectors (rows) with coded unit vectors (columns)."""
    bits = codes.shape[1] * 8
    signs = 2.0 * np.unpackbits(codes, axis=1, bitorder="little") - 1.0
    return (queries @ rotations(queries.shape[1], bits).T) @ signs.T / (bits * factor)


def linked(units: np.ndarray, codes: np.ndarray, factor: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Boolean matrix of pairs with inner product >= threshold, and how many were computed exactly."""
    n, width = units.shape
    open_ = estimates(units, codes, factor) + bound(factor, codes.shape[1] * 8, width) >= threshold
    open_ |= open_.T
    np.fill_diagonal(open_, False)
    out = np.zeros((n, n), bool)
    i, j = np.nonzero(np.triu(open_))
    for k in range(0, len(i), 65536):
        a, b = i[k:k + 65536], j[k:k + 65536]
        out[a, b] = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
    return out | out.T, len(i)


def _unit_rows(lists: pa.Array) -> tuple[list[np.ndarray | None], list]:
    """Unit vectors in double precision, None where the vector is unusable."""
    out: list[np.ndarray | None] = []
    for values in lists.to_pylist():
        if not values or any(v is None for v in values):
            out.append(None)
            continue
        x = np.asarray(values, float)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(x).max()
            ok = np.isfinite(x).all() and top > 0
            out.append((x / top) / np.linalg.norm(x / top) if ok else None)
    return out


def coded(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(id, label, unit, width, code, factor, keys)``; unusable vectors and null labels have null codes."""
    keys = keys_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                units = _unit_rows(batch.column(2))
                n = len(units)
                unit, code, factor, hashes, width = ([None] * n for _ in range(5))
                by_width: dict[int, list[int]] = {}
                for i, u in enumerate(units):
                    if u is not None:
                        by_width.setdefault(len(u), []).append(i)
                for w, rows in by_width.items():
                    matrix = np.stack([units[i] for i in rows])
                    for i, c, f, h in zip(rows, *encoded(matrix, keys)):
                        unit[i], code[i], factor[i], hashes[i], width[i] = units[i].tobytes(), c.tobytes(), f, h, w
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(unit, pa.binary()), pa.array(width, pa.int32()),
                     pa.array(code, pa.binary()), pa.array(factor, pa.float64()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["id", "label", "unit", "width", "code", "factor", "keys"])

    return vectors.mapInArrow(
        run, "id long, label string, unit binary, width int, code binary, factor double, keys array<long>"
    )


def near_vectors(df: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding",
                 label_column: str | None = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Two rows are linked when their labels are equal and not null, their vectors
    have equal lengths, and their cosine in double precision is ``threshold`` or
    more. ``n_links`` counts other rows linked directly; ``component_id`` is the
    smallest id reachable; the row with that id is kept. Null, empty and zero
    vectors and those with null or non-finite components link with nothing and
    are kept, as are rows without a label; a row with a null id is treated so
    too and has a null component. Equal vectors under one label are one class,
    however many rows hold them. A pair at the threshold is missed with
    probability ``MISS``; every link found is exact.
    """
    label = F.col(label_column).cast("string") if label_column else F.lit("")
    vectors = df.select(
        F.col(id_column).cast("long").alias("id"), label.alias("label"), F.col(vector_column).cast("array<double>").alias("v")
    )
    codes = cut_lineage(coded(vectors, threshold))
    usable = codes.where("unit IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    sized = usable.groupBy("label", "unit").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    kinds = codes.where("unit IS NOT NULL").select("id", "label", "unit", "width", "code", "factor", "keys")
    classes = cut_lineage(kinds.join(sized, ["label", "unit", "id"]).dropDuplicates(["label", "unit"]))
    keyed = classes.select(
        "id", F.posexplode("keys").alias("slot", "value"), F.xxhash64("label", "width").alias("space")
    ).withColumn("key", F.xxhash64("space", "slot", "value"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(float(PART))).cast("int")
    placed = (
        keyed.join(shared, "key").withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
        .withColumn("pair", F.explode(block_pairs(F.col("part"), F.col("parts"))))
        .select("id", "key", "slot", "pair.a", "pair.b", "part")
        .join(classes.select("id", "label", "unit", "width", "code", "factor", "keys", "copies"), "id")
        .select("key", "a", "b", "part", "slot", "id", "width", "copies", "factor", "unit", "code", "keys", "label")
        .repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "label", "width", "slot", "id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, 3):
            ids, links, tops = [], [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                group = batch.slice(lo, hi - lo)
                for found in _bucket(group, threshold):
                    for out, values in zip((ids, links, tops), found):
                        out.append(values)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (ids, links, tops)], ["id", "links", "top"]
                )

    found = cut_lineage(placed.mapInArrow(run, "id long, links long, top long"))
    others = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("src"), F.col("top").alias("dst")))
    of_class = (
        classes.select("label", "unit", "id", "copies").join(others, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component"))
    )
    # Rows outside any class join on a key of their own, so that nulls do not meet in one task.
    own = F.when(F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("unit"))
    side = codes.select("id", "label", F.coalesce(own, F.concat(F.lit(b"row "), F.col("id").cast("string").cast("binary")), F.lit(b"")).alias("unit"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return (
        side.withColumn("label", F.coalesce("label", F.lit(""))).join(
            of_class, ["label", "unit"], "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )


def _bucket(group: pa.RecordBatch, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links inside one bucket: ids, number of linked rows, smallest id of the bucket's own component.

    A pair counts only in the first slot where its keys agree, so that every link
    is counted once over all buckets. Rows whose key collides from another label,
    width or slot form groups of their own.
    """
    a, b = group.column(1)[0].as_py(), group.column(2)[0].as_py()
    spaces: dict[tuple, list[int]] = {}
    for i, space in enumerate(zip(group.column(12).to_pylist(), group.column(6).to_pylist(), group.column(4).to_pylist())):
        spaces.setdefault(space, []).append(i)
    for (_, width, slot), rows in spaces.items():
        if len(rows) < 2:
            continue
        g = group.take(pa.array(rows))
        n = len(rows)
        units = np.frombuffer(b"".join(g.column(9).to_pylist()), float).reshape(n, width)
        codes = np.frombuffer(b"".join(g.column(10).to_pylist()), np.uint8).reshape(n, -1)
        factor, ids, copies, part = (g.column(k).to_numpy() for k in (8, 5, 7, 3))
        matrix, _ = linked(units, codes, factor, threshold)
        if a != b:
            matrix &= part[:, None] != part[None, :]
        if slot:
            keys = np.stack([np.asarray(k) for k in g.column(11).to_pylist()])[:, :slot]
            i, j = np.nonzero(matrix)
            before = np.zeros(len(i), bool)
            for k in range(0, len(i), 65536):
                before[k:k + 65536] = (keys[i[k:k + 65536]] == keys[j[k:k + 65536]]).any(axis=1)
            matrix[i[before], j[before]] = False
        if not matrix.any():
            continue
        links = matrix @ copies
        least = ids.copy()
        while True:  # the smallest id spreads over the links
            spread = np.where(matrix, least[None, :], np.iinfo(np.int64).max).min(axis=1)
            spread = np.minimum(least, spread)
            if (spread == least).all():
                break
            least = spread
        touched = links > 0
        yield ids[touched], links[touched].astype(np.int64), least[touched]
