"""Names of a table found in texts by a multi-pattern automaton, however long the table."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

# Bytes of the names in one automaton; a task holds one, at some 50 bytes a character.
AUTOMATON_BYTES = 4_000_000


def name_matches(texts: DataFrame, key: str, text: str, names: DataFrame, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``(key, kind, name, n)``: how often each name of ``names`` (kind, name) is a substring of each text.

    Overlapping matches all count, upper and lower case differ, and a name may have
    several kinds. Null or empty names and null texts match nothing; repeated names
    count once; ``key`` comes through as it is, so rows with equal keys stay apart.
    Names are dealt by hash into blocks of about ``block_bytes``; each block is one
    automaton and one pass over the texts, so every name is looked for at any size.
    """
    wanted = cut_lineage(names.select(F.col("kind").cast("string"), F.col("name").cast("string")).where("name <> ''").distinct())
    total = wanted.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    schema = T.StructType([texts.schema[key], T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
                           T.StructField("n", T.LongType())])
    own = texts.select(F.col(key), F.col(text).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    if not blocks:
        return own.sparkSession.createDataFrame([], schema)
    part = lambda i: wanted.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i)
    return reduce(DataFrame.unionByName, [own.mapInArrow(_finder(part(i)), schema) for i in range(blocks)])


def _finder(names: DataFrame):
    """A function over Arrow batches ``(key, text)`` that finds the names of one block."""
    kinds: dict[str, list[str | None]] = {}
    for r in names.collect():  # one block: about ``block_bytes``
        kinds.setdefault(r["name"], []).append(r["kind"])
    sent = names.sparkSession.sparkContext.broadcast(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in sent.value:
            automaton.add_word(name, name)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows, found_kinds, found, counts = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                seen: dict[str, int] = {}
                for _, name in automaton.iter(value) if len(automaton) else ():
                    seen[name] = seen.get(name, 0) + 1
                for name, n in seen.items():
                    for kind in sent.value[name]:
                        rows.append(i)
                        found_kinds.append(kind)
                        found.append(name)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found_kinds, pa.string()), pa.array(found, pa.string()),
                 pa.array(counts, pa.int64())], [batch.schema.names[0], "kind", "name", "n"])

    return run
