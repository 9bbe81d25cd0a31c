"""Phrase collocations by dynamic itemset counting.

The texts are dealt to shards, which are scanned in a cycle. Words are counted
from the first scan on. A longer phrase becomes active at the scan after both of
its subphrases (all words but the last, all words but the first) have reached the
threshold, so phrases of all lengths are counted side by side, and each is counted
for one full cycle from its activation. Which scan activated a phrase is read
from a sieve of fixed size that holds, for a hash of each subphrase, the scan in
which it reached the threshold. Two subphrases with one hash can only activate a
phrase early, which costs a counter and changes no count: a phrase is counted
exactly once in every shard, and those below the threshold leave at the end of
their cycle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import pieces_of
from docketry.operators.scaling import broadcast_if_small, top_per_key
from docketry.session import cut_lineage, delete_folder, scratch_path

# Slots of the sieve for each phrase length; its size does not depend on the input.
SLOTS = 1 << 22
# Shards of the cycle. More of them activate phrases sooner, and carry counters over more scans.
SHARDS = 2
# Not reached so far.
NEVER = np.int16(2**15 - 1)
# Scans are numbered below this; there are at most ``shards`` for each phrase length.
MOST_SCANS = 1 << 12
# Phrase lengths lie below this.
LENGTHS = 1 << 10
# Bytes of text that one count in a task covers.
RUN = 12_000_000

_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(
    _ENDS + b"\t" + bytes(range(ord("A"), ord("Z") + 1)), b"." * len(_ENDS) + b" " + bytes(range(ord("a"), ord("z") + 1))
)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def longer_hash(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all its words but the last, and that of its last word."""
    return _mixed(head * _PRIME + word)


def word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def words_and_breaks(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, and ``b"."`` for each border of a piece."""
    return text.translate(_FOLD).replace(b".", b" . ").split(b" ")


def counted(lang: str, texts: list[bytes], scan: int, shards: int, longest: int,
            sieves: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """``(length, phrases, activating scan, count)`` of the phrases active in this scan of a shard."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    for mark in (b".", b""):  # 0: a border; 1: nothing, between two blanks
        numbers[mark]
    parts = [np.zeros(1, np.int64)]
    for text in texts:
        words = words_and_breaks(text)
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
    codes = np.concatenate(parts)
    codes = codes[codes != 1]
    names = list(numbers)
    words = pa.array(names, pa.binary())
    if scan < shards:
        counts = np.bincount(codes, minlength=len(names))[2:]
        yield 1, words.slice(2), np.zeros(len(counts), np.int16), counts
    size = len(names)
    hashes = word_hash(lang, names)[codes]
    whole = codes != 0
    key, key_size, phrase_hash = codes, size, hashes
    reached = np.where(whole, sieves[0][hashes % np.uint64(SLOTS)], NEVER)  # scan in which the phrase from here reached the threshold
    for length in range(2, longest + 1):
        n = len(codes) - length + 1
        if n <= 0:
            return
        start = np.maximum(reached[:-1], reached[1:]).astype(np.int32) + 1
        alive = (start <= scan) & whole[length - 1:]
        if key_size * size >= 2**62 // MOST_SCANS:  # number the distinct phrases so far, to keep the next key within 64 bits
            key = np.unique(key, return_inverse=True)[1]
            key_size = int(key.max()) + 1
        key, key_size = key[:n] * size + codes[length - 1:], key_size * size
        at = np.flatnonzero(alive & (start > scan - shards))
        if len(at):
            # The activating scan belongs to the phrase, so it can ride along in the key.
            ids, counts = np.unique(key[at] * MOST_SCANS + start[at], return_counts=True)
            if key_size == size**length:
                rest, spelled = ids // MOST_SCANS, []
                for _ in range(length):
                    spelled.append(rest % size)
                    rest = rest // size
                parts = spelled[::-1]
            else:
                first = np.unique(key[at] * MOST_SCANS + start[at], return_index=True)[1]
                parts = [codes[at[first] + k] for k in range(length)]
            yield length, pc.binary_join_element_wise(*[words.take(pa.array(p)) for p in parts], b" "), ids % MOST_SCANS, counts
        if length == longest or not alive.any():
            return
        phrase_hash = longer_hash(phrase_hash[:n], hashes[length - 1:])
        reached = np.where(alive, sieves[length - 1][phrase_hash % np.uint64(SLOTS)], NEVER)


def scanned(docs: DataFrame, scan: int, shards: int, longest: int, sieves) -> DataFrame:
    """``(lang, phrase, mark, count)`` of one scan, summed within runs of rows; ``mark`` is activating scan * LENGTHS + length."""
    names = ["lang", "phrase", "mark", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sieves.value
        for batch in batches:
            for part in pieces_of(batch, 1, RUN):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    for length, phrases, start, count in counted(lang, texts, scan, shards, longest, held):
                        for i in range(0, len(phrases), 100_000):
                            some = phrases.slice(i, 100_000).cast(pa.string())
                            marks = start[i:i + 100_000].astype(np.int32) * LENGTHS + length
                            yield pa.RecordBatch.from_arrays(
                                [pa.repeat(lang, len(some)), some, pa.array(marks, pa.int32()), pa.array(count[i:i + 100_000].astype(np.int64))], names)

    return docs.mapInArrow(run, "lang string, phrase string, mark int, count long")


def fresh_slots(reached: DataFrame, sieves) -> Iterator[tuple[int, np.ndarray]]:
    """``(length, slots)`` newly reached by phrases ``(lang, phrase, mark)``, a length at a time.

    Slots meet as bits, so the driver gets ``SLOTS / 8`` bytes of each length at most, in
    one row for every 32,768 slots, however many phrases reached the threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sieves.value
        for batch in batches:
            lengths, slots = [], []
            for lang, phrase, mark in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                hashes = word_hash(lang, phrase.encode().split(b" "))
                whole = hashes[:1]
                for k in range(1, len(hashes)):
                    whole = longer_hash(whole, hashes[k:k + 1])
                slot = int(whole[0] % np.uint64(SLOTS))
                if held[mark % LENGTHS - 1][slot] == NEVER:
                    lengths.append(mark % LENGTHS)
                    slots.append(slot)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(slots, pa.int32())], ["length", "slot"])

    found = reached.select("lang", "phrase", "mark").mapInArrow(run, "length int, slot int").withColumn("at", F.col("slot") + 1)
    bits = found.groupBy("length", F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    parts = defaultdict(list)
    for row in bits.collect():
        parts[row["length"]].append((row["part"] - 1, row["bits"]))
    for length, some in sorted(parts.items()):
        yield length, np.concatenate([np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) + part * 8 * len(b) for part, b in some])


def frequent_phrases(df: DataFrame, longest: int = 3, least: int = 10, shards: int = SHARDS, lang_column: str = "lang",
                     text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences in their language, and all words' number.

    Gives ``(lang, phrase, length, f)`` with exact counts, and ``(lang, n)``. After
    each scan one table holds the counters of the phrases whose cycle has not
    ended; the driver sees the sieve slots newly reached as bits, ``SLOTS / 8`` bytes
    of each length at most whatever the input.
    """
    if longest * shards >= MOST_SCANS or longest >= LENGTHS:
        raise ValueError(f"{longest} lengths over {shards} shards take too many scans")
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    dealt = scratch_path(spark, "shards")
    texts.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(dealt)
    docs = spark.read.schema("lang string, text string, shard int").parquet(dealt)
    sieves = [np.full(SLOTS, NEVER, np.int16) for _ in range(longest - 1)]
    length, start = F.col("mark") % LENGTHS, F.expr(f"mark div {LENGTHS}")
    state, state_path, total, done = None, None, None, []
    scan, last_reached = 0, -1
    while scan < shards or scan <= last_reached + shards:
        sent = spark.sparkContext.broadcast(sieves)
        found = scanned(docs.where(F.col("shard") == scan % shards).select("lang", "text"), scan, shards, longest, sent)
        both = found if state is None else found.unionByName(state)
        summed = both.groupBy("lang", "phrase").agg(F.min("mark").alias("mark"), F.sum("count").alias("count"))
        path = scratch_path(spark, "counters")
        summed.write.parquet(path)
        if state_path:
            delete_folder(spark, state_path)
        now = spark.read.schema(summed.schema).parquet(path)
        ended = now.where(start == scan - shards + 1)
        if scan == shards - 1:
            total = cut_lineage(ended.where(length == 1).groupBy("lang").agg(F.sum("count").alias("n")))
        if scan >= shards - 1:
            done.append(cut_lineage(ended.where(F.col("count") >= least).select("lang", "phrase", length.alias("length"), F.col("count").alias("f"))))
        for size, slots in fresh_slots(now.where((F.col("count") >= least) & (length < longest)), sent):
            sieves[size - 1][slots] = scan
            last_reached = scan
        sent.destroy()
        state, state_path = now.where(start > scan - shards + 1), path
        scan += 1
    delete_folder(spark, state_path)
    delete_folder(spark, dealt)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, total


def collocations(df: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50, shards: int = SHARDS,
                 lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best phrases of 2 to ``longest`` words.

    ``a`` is the phrase's number of occurrences within pieces, overlaps included;
    ``l`` and ``r`` are those of its two parts at the lowest-scoring cut, with the
    score floor(1000000 * a * a / (l * r)), exact at any size; of equal scores the
    cut after fewer words counts. A phrase that lies inside a longer one with at
    least ``covered`` percent of its occurrences is left out. Equal scores go by
    ``a``, then by the phrase's bytes. ``n`` counts all words of the language.

    A null language is ``und``; null and empty texts have no words; an empty table,
    or one without frequent phrases, gives no rows. Repeated rows count each time.
    Very long texts are read whole. Other columns are not read.
    """
    counts, total = frequent_phrases(df, longest, least, shards, lang_column, text_column)
    counts = cut_lineage(counts)
    candidates = counts.where("length > 1")
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "length", F.col("f").alias("a"), cut).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("length")), " ").alias("right"),
    )
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    priced = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  exact products of up to 38 digits
    whole = priced.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a"))).withColumn("below", big("l") * big("r"))
    scored = whole.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"), F.min("a").alias("a")
    )
    spans = candidates.where("length > 2").select("lang", "length", F.col("f").alias("outer"), words.alias("words")).select(
        "lang", "outer", "words", "length", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("m")
    ).select("lang", "outer", "words", "m", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)).alias("i"))
    inside = spans.groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("outer").alias("outer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (F.lit(100) * F.col("outer") < F.lit(covered) * F.col("a"))
    ).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    ranked = top_per_key(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return ranked.join(broadcast_if_small(total), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
