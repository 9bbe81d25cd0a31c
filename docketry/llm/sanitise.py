"""Information-theoretic sanitisation of personal data.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers.
The corpus then tells which other terms reveal them. For a term t and a kind c of
personal data, PMI(t, c) = log2(P(t near c) / (P(t) P(c))) is what t discloses
about c, of the IC(c) = -log2 P(c) that there is to disclose. A term that stands
near enough different values of a kind is generalised when its share PMI / IC
reaches one threshold, and removed when it reaches a second.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import pieces_of
from docketry.session import cut_lineage

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that does not begin its run of digits could only begin where a longer one does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")
TERM = "term"
# Terms on either side of a span that stand near it, within so many characters.
WINDOW, REACH = 4, 200
# Different values that a term must stand near, and the thresholds of its disclosed share.
VALUES, GENERALISE, REMOVE = 5, 0.7, 0.9
SIEVE_BITS = 22  # a sieve has 2^22 bits whatever the input
FLUSH = 100_000
PIECE = 4_000_000  # bytes of text that a task turns into Python objects at a time
PLACEHOLDER = "[{}]"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of personal data, by start and kind.

    Matches of a kind are leftmost and do not overlap; those that fail the kind's
    test are dropped without another try. Time is linear in the text.
    """
    found: list[tuple[int, int, int]] = []
    before = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > before and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, m.end()))
                before = m.end()
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) < 256 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def value_of(text: str, kind: int) -> int:
    """Hash of a span's value; numbers without their punctuation."""
    plain = text.lower() if kind < 2 else re.sub("[^0-9]", "", text)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}".encode()) - 2**63


def terms_near(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """``(term, kind, value)`` for the terms beside each span that lie in no span."""
    for start, kind, end in spans:
        low = max(0, start - REACH)
        left = [m for m in _TERM.finditer(text, low, start) if m.start() > low or low == 0][-WINDOW:]
        high = min(len(text), end + REACH)
        right = [m for m in _TERM.finditer(text, end, high) if m.end() < high or high == len(text)][:WINDOW]
        value = value_of(text[start:end], kind)
        for m in left + right:
            if not any(s < m.end() and m.start() < e for s, _, e in spans):
                yield m.group().lower(), kind, value


class Sieve:
    """Tells quickly that a term is not in a set; may be wrong when it says it is."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.empty = not words.any()
        self.known: dict[str, bool] = {}

    def may_hold(self, term: str) -> bool:
        found = self.known.get(term)
        if found is None:
            if len(self.known) > FLUSH:
                self.known.clear()
            h = xxhash.xxh64_intdigest(term.lower().encode(), seed=42)
            found = all(
                int(self.words[p >> 5]) >> (p & 31) & 1
                for p in (h & (2**SIEVE_BITS - 1), h >> SIEVE_BITS & (2**SIEVE_BITS - 1))
            )
            self.known[term] = found
        return found


def sieve_of(terms: DataFrame) -> Sieve:
    """The sieve of a table's ``term`` column; the driver sees at most 2^17 integers."""
    h = F.xxhash64("term")
    mask = F.lit(2**SIEVE_BITS - 1)
    places = F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, SIEVE_BITS).bitwiseAND(mask)))
    rows = (
        terms.select(places.alias("p"))
        .groupBy(F.shiftright("p", 5).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("bits")).collect()
    )
    words = np.zeros(2 ** (SIEVE_BITS - 5), np.int64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return Sieve(words)


def near_counts(texts: DataFrame) -> DataFrame:
    """``(term, kind, near, values)``: positions of a term near a kind, and different values it stands near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for part in pieces_of(batch, 0, PIECE):
                for text in part.column(0).to_pylist():
                    if spans := base_spans(text):
                        tally.update(terms_near(text, spans))
            if tally:
                term, kind, value = zip(*tally)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term), pa.array(kind, pa.int32()), pa.array(value, pa.int64()), pa.array(tally.values(), pa.int64())],
                    ["term", "kind", "value", "n"])

    each = texts.mapInArrow(run, "term string, kind int, value long, n long").groupBy("term", "kind", "value").agg(F.sum("n").alias("n"))
    return each.groupBy("term", "kind").agg(F.sum("n").alias("near"), F.count("*").alias("values"))


def term_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, n)`` over the corpus for the ``wanted`` terms and a few others; the empty term counts all."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, tally, every = shared.value, Counter(), 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["term", "n"])
        for batch in batches:
            for part in pieces_of(batch, 0, PIECE):
                for text in part.column(0).to_pylist():
                    found = _TERM.findall(text)
                    every += len(found)
                    tally.update([t for t in found if sieve.may_hold(t)])
            if len(tally) > FLUSH:
                yield out()
                tally.clear()
        lowered: Counter = Counter({"": every})
        for t, n in tally.items():
            lowered[t.lower()] += n
        tally = lowered
        yield out()

    return texts.mapInArrow(run, "term string, n long").groupBy(F.lower("term").alias("term")).agg(F.sum("n").alias("n"))


def risky_terms(texts: DataFrame, values: int = VALUES, generalise: float = GENERALISE) -> DataFrame:
    """``(term, kind, share)`` of the terms whose disclosed share reaches ``generalise``, over all texts.

    ``texts`` has one text column and is read twice.
    """
    near = cut_lineage(near_counts(texts))
    kinds = near.groupBy("kind").agg(F.sum("near").alias("of_kind"))  # a row per kind
    often = near.where(F.col("values") >= values)
    counts = cut_lineage(term_counts(texts, often.select("term").distinct()))
    row = counts.where("term = ''").first()  # one number
    total = F.lit(float(row["n"] if row else 0))
    joined = often.join(F.broadcast(kinds), "kind").join(counts, "term")
    disclosed = F.log2(F.col("near") * total / (F.col("n") * F.col("of_kind")))
    content = F.log2(total / F.col("of_kind"))
    shares = joined.withColumn("share", F.when(content > 0, disclosed / content)).where(F.col("share") >= generalise)
    best = shares.groupBy("term").agg(F.max(F.struct("share", (-F.col("kind")).alias("k"))).alias("best"))
    return cut_lineage(best.select("term", (-F.col("best.k")).alias("kind"), F.col("best.share").alias("share")))


def spans_of(df: DataFrame, text_column: str, risky: DataFrame, carry: list[Column], keep_text: bool = False) -> DataFrame:
    """``(c0, c1, ..., base, terms)`` of every row: the carried columns, personal data, and risky terms outside of it.

    A sieve of fixed size picks the terms that may be risky; a join decides, so
    the table of risky terms may have any size. ``keep_text`` adds ``text``.
    """
    shared = df.sparkSession.sparkContext.broadcast(sieve_of(risky))
    text = F.coalesce(F.col(text_column), F.lit(""))
    source = df.select(text.alias("text"), *[c.alias(f"c{i}") for i, c in enumerate(carry)])
    kept = source.columns[0 if keep_text else 1:]
    schema = source.select(kept).withColumns({
        "base": F.expr("cast(null as array<struct<start:int,kind:int,end:int>>)"),
        "maybe": F.expr("cast(null as array<struct<start:int,end:int,term:string>>)"),
    }).schema
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    maybe_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for whole in batches:
            for batch in pieces_of(whole, 0, PIECE):
                base, maybe = [], []
                for text in batch.column(0).to_pylist():
                    spans = base_spans(text)
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                    found = []
                    if not sieve.empty and any(map(sieve.may_hold, set(_TERM.findall(text)))):
                        found = [
                            {"start": m.start(), "end": m.end(), "term": m.group().lower()} for m in _TERM.finditer(text)
                            if sieve.may_hold(m.group()) and not any(s < m.end() and m.start() < e for s, _, e in spans)
                        ]
                    maybe.append(found)
                columns = [batch.column(i) for i in range(0 if keep_text else 1, batch.num_columns)]
                columns += pa.array(base, base_type), pa.array(maybe, maybe_type)
                yield pa.RecordBatch.from_arrays(columns, [*kept, "base", "maybe"])

    found = cut_lineage(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    sure = (
        found.where("size(maybe) > 0").select("row", F.explode("maybe").alias("m"))
        .select("row", "m.start", "m.end", F.col("m.term").alias("term"))
        .join(risky, "term").groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))  # of one text
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,share:double>>)")
    return found.join(sure, "row", "left").withColumn("terms", F.coalesce("terms", none)).drop("row", "maybe")


def described(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of sorted ``(start, kind, end)`` structs."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def all_spans() -> Column:
    """Base and term spans as one sorted array."""
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
    return F.sort_array(F.concat("base", terms))


def report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms)`` of every row.

    Null and empty texts have no spans. Repeated rows each get a row. Only the
    two named columns are read; an empty table gives an empty result.
    """
    texts = df.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = spans_of(df, text_column, risky_terms(texts), [F.col(id_column)])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("c0").alias("id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(all_spans()).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )


def sanitised(df: DataFrame, text_column: str = "text", remove: float = REMOVE) -> DataFrame:
    """The rows with sanitised texts and all other columns as they were.

    Personal data becomes ``[email]``, ``[ip]``, ``[card]`` or ``[phone]``, a risky
    term ``[term]``, or nothing when its share reaches ``remove``. Where base spans
    overlap, the first is replaced and the rest of the others goes with it. Null
    texts stay null and empty texts empty; a row is never dropped. Repeated rows
    are treated alike. The corpus statistics are over all rows; a term near
    copies of one value counts once for it. An empty table gives an empty result.
    """
    carry = [c for c in df.columns if c != text_column]
    texts = df.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    columns = [*(F.col(f"`{c}`") for c in carry), F.col(text_column).isNull()]
    found = spans_of(df, text_column, risky_terms(texts), columns, keep_text=True)
    flat = F.transform(all_spans(), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    gone = F.transform(F.filter("terms", lambda t: t["share"] >= remove), lambda t: t["start"])
    rows = found.select("*", flat.alias("spans"), gone.alias("gone"))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces_of(whole, at, PIECE)):
            spans, gone_ = batch.column("spans").to_pylist(), batch.column("gone").to_pylist()
            texts = [replaced(t, [tuple(s.values()) for s in x], set(g)) if x else t
                     for t, x, g in zip(batch.column(at).to_pylist(), spans, gone_)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    done = rows.mapInArrow(run, rows.schema)
    text = F.when(~F.col(f"c{len(carry)}"), F.col("text"))
    named = {text_column: text} | {c: F.col(f"c{i}") for i, c in enumerate(carry)}
    return done.select(*[named[c].alias(c) for c in df.columns])


def replaced(text: str, spans: list[tuple[int, int, int]], gone: set[int]) -> str:
    """The text with sorted ``(start, end, kind)`` spans replaced."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out.append(text[at:start])
            if kind < len(KINDS):
                out.append(PLACEHOLDER.format(KINDS[kind]))
            elif start not in gone:
                out.append(PLACEHOLDER.format(TERM))
        at = max(at, end)
    return "".join([*out, text[at:]])
