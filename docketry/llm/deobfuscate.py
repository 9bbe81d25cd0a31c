"""Toxicity of texts behind a noisy channel.

Words that may be disguised (digits or symbols for letters, doubled or stretched
letters, letters set apart by spaces or dots) are restored first: every observed character
spans a lattice of intended ones, and Viterbi's algorithm finds the path that a
character model of the whole corpus and the channel together make most likely.
The restored words are then scored with weights learned from labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import map_texts, pieces_of
from docketry.session import cut_lineage

# Letters of the character model (0 is the border of a word) and look-alikes.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*~'`^/\\,:;#%&="
FIGURES = "0123456789$£"  # one symbol of the character model, in words without letters
# Channel: log probabilities that a letter shows as itself, as a look-alike, or
# stretched, that a look-alike stands for itself, and that a separator was put in.
SELF, ALIKE, STRETCHED, LITERAL, PUT_IN = (math.log(p) for p in (0.9, 0.05, 0.03, 0.01, 0.02))
AS_FIGURE = SELF - math.log(len(FIGURES))  # a figure meant as itself, which is one of several with one symbol
SYMBOLS = 64
SETTLED = 64  # after at least this many characters of a word the part that is decided leaves the memory
REMEMBERED_LENGTH = 64  # longer words are decoded anew each time
NGRAM = 5
FIT_ROWS = 20_000  # labelled rows used to fit, a documented bound of the model
REMEMBERED = 150_000

FIGURE = len(LETTERS) + 1
_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)} | dict.fromkeys(FIGURES, FIGURE)
_LETTERS, _READABLE = frozenset(LETTERS), frozenset(LETTERS) | frozenset(LOOKALIKES)
# Letters or look-alikes set apart: three at least, with any white space or separators between two.
_UNIT, _BETWEEN = rf"[^\W_]|[{re.escape(''.join(LOOKALIKES))}]", rf"[\s{re.escape(SEPARATORS)}]++"
_APART = re.compile(rf"(?<![^\s{re.escape(SEPARATORS)}\"(\[{{<>])(?:{_UNIT})(?:{_BETWEEN}(?:{_UNIT})){{2,}}(?=[\s{re.escape(SEPARATORS)}\")\]}}>!?]|$)")
_GAP = re.compile(_BETWEEN)
_EDGES = re.compile(r"^(?:[\"'(\[{<>#%&*.,;:?)\]}~_=-]+|([$!|+@])\1\1+)+|(?:[\"'(\[{<>#%&*.,;:?!)\]}~_=-]+|([$|+@])\2\2+)+$")
# Two equal letters of the character model, or three of any alphabet.
_STRETCH = re.compile(rf"([{LETTERS}])\1|([^\W\d_])\2\2")


def symbol_table() -> np.ndarray:
    """Symbol of each code point up to U+024F; everything else is a border."""
    table = np.zeros(0x250, np.int64)
    for c in range(0x250):
        table[c] = _NUMBER.get(chr(c).lower(), 0)
    return table


def without_mixed_figures(symbols: np.ndarray) -> np.ndarray:
    """Symbols with a border for each figure whose run touches a letter: disguised words teach no numbers."""
    framed = np.concatenate([[0], symbols, [0]])
    turns = np.flatnonzero(np.diff((framed == FIGURE).astype(np.int8)))
    begins, ends = turns[::2], turns[1::2]  # the places before a run and of its last figure
    letter = (framed > 0) & (framed != FIGURE)
    mixed = np.repeat(letter[begins] | letter[ends + 1], ends - begins)
    out = symbols.copy()
    out[np.flatnonzero(symbols == FIGURE)[mixed]] = 0
    return out


def trigram_counts(df: DataFrame, text_column: str) -> DataFrame:
    """``(trigram, n)`` over all texts: at most 64^3 rows, summed in each task before the shuffle."""
    table = symbol_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in pieces_of(batch, 0, 1_000_000):
                codes = np.frombuffer(" ".join(part.column(0).to_pylist()).encode("utf-32-le"), np.uint32)
                symbols = table[np.where(codes < len(table), codes, 0)]
                symbols = np.concatenate([[0, 0], without_mixed_figures(symbols), [0]])
                keys = symbols[:-2] * SYMBOLS**2 + symbols[1:-1] * SYMBOLS + symbols[2:]
                total += np.bincount(keys[(symbols[1:-1] > 0) | (symbols[2:] > 0)], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["trigram", "n"])

    texts = df.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: list[tuple[int, int]]) -> np.ndarray:
    """Log probability of a symbol after two others, interpolated with shorter contexts."""
    n = np.zeros(SYMBOLS**3)
    for key, value in counts:
        n[key] = value
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = n.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((n + 5 * two) / (n.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def chain_links(chain: tuple | None) -> list[tuple]:
    """The links of a chain, first text first."""
    links = []
    while chain is not None:
        links.append(chain)
        chain = chain[0]
    links.reverse()
    return links


def chain_texts(chain: tuple | None) -> list[str]:
    return [link[1] for link in chain_links(chain)]


def settled(columns: dict[int, dict]) -> tuple[list[str], int]:
    """Take the texts that all open chains begin with off these chains; those texts, and the longest chain left."""
    entries = [(column, state, score, chain_links(chain)) for column in columns.values() for state, (score, chain) in column.items()]
    first = entries[0][3]
    shared = min(len(links) for *_, links in entries)
    for *_, links in entries[1:]:
        # Chains are built from one tree, so equal beginnings are the same objects.
        low = 0
        while low < shared and links[low] is first[low]:
            low += 1
        shared = low
    if shared:
        remade: dict[int, tuple] = {}
        for column, state, score, links in entries:
            chain = None
            for link in links[shared:]:  # the tree is kept, as later calls compare links by identity
                chain = remade.setdefault(id(link), (chain, link[1]))
            column[state] = (score, chain)
    return [link[1] for link in first[:shared]], max(len(links) for *_, links in entries) - shared


class Restorer:
    """Viterbi decoding of disguised words."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def restore(self, word: str) -> str:
        """The likeliest intended word, whatever its length.

        A state is a pair of symbols; it holds its score and a chain of the texts
        added so far. From time to time the beginning that all open chains share
        is put out, so memory grows with the part still open.
        """
        model, n = self.model, len(word)
        ends = [n] * n  # where the run of equal characters at each place ends
        for k in range(n - 2, -1, -1):
            ends[k] = ends[k + 1] if word[k] == word[k + 1] else k + 1
        # Open places -> (symbol before, last symbol) -> (score, (chain before, text added)).
        columns: dict[int, dict] = {0: {(0, 0): (0.0, None)}}
        out: list[str] = []
        check = SETTLED - 1
        for at in range(n):
            column = columns.pop(at, None)
            if column is None:  # inside a run that every path leaves out
                continue
            seen = word[at]
            run = ends[at] - at
            hidden = [(c, _NUMBER[c], ALIKE) for c in LOOKALIKES.get(seen, "")]
            if seen in _LETTERS:
                hidden.append((seen, _NUMBER[seen], SELF))
            elif seen not in SEPARATORS and seen not in FIGURES and not seen.isspace():
                hidden.append((seen, 0, LITERAL))  # left as it is
            following = columns.setdefault(at + 1, {})
            steps = [(c, symbol, p, following) for c, symbol, p in hidden]
            if seen in FIGURES:
                steps.append((seen, FIGURE, AS_FIGURE, following))  # numbers are not stretched
            left_out = seen in SEPARATORS or seen.isspace()
            beyond = columns.setdefault(at + run, {}) if run > 1 else following
            if run > 1:
                steps += [(c, symbol, p + STRETCHED, beyond) for c, symbol, p in hidden]
            for state, (score, chain) in column.items():
                before, last = state
                row = model[before][last]
                for text, symbol, channel, reached in steps:
                    total, target = score + channel + row[symbol], (last, symbol)
                    known = reached.get(target)
                    if known is None or total > known[0]:
                        reached[target] = (total, (chain, text))
                if left_out:
                    known = beyond.get(state)
                    if known is None or score + PUT_IN > known[0]:
                        beyond[state] = (score + PUT_IN, chain)
            if not following:
                del columns[at + 1]
            if at >= check:
                texts, open_links = settled(columns)
                out += texts
                check = at + max(SETTLED, open_links)
        best, chain = None, None
        for (before, last), (score, ending) in columns[n].items():
            total = score + model[before][last][0]
            if best is None or total > best:
                best, chain = total, ending
        out += chain_texts(chain)
        return "".join(out)

    def clean(self, word: str) -> str:
        """A lower-case word without edge punctuation, restored unless it can only be read as it stands."""
        if word.isalpha() and not _STRETCH.search(word):
            return word
        core = _EDGES.sub("", word)
        if core.isalpha() and not _STRETCH.search(core) or _READABLE.isdisjoint(core):
            return core
        return self.restore(core)

    def words(self, text: str) -> set[str]:
        """Distinct lower-case words of a text, with letters and look-alikes set apart restored besides."""
        lowered = text.lower()
        out = set(lowered.split())
        for m in _APART.finditer(lowered):
            out.update(self.apart(m.group()))
        return out

    def apart(self, run: str) -> set[str]:
        """Readings of a run: as one word, and as the words between its wider gaps.

        The lattice leaves out every gap as put-in separators. A gap counts as one
        separator, which adds the same to all paths.
        """
        gaps = _GAP.findall(run)
        least = min(map(len, gaps))
        parts = {run}
        if any(len(g) > least for g in gaps):
            units, word = _GAP.split(run), []
            for unit, gap in zip(units, [*gaps, None]):
                word.append(unit)
                if gap is None or len(gap) > least:
                    if len(word) > 2:
                        parts.add(" ".join(word))
                    word = []
        return {self.restore(_GAP.sub(" ", _EDGES.sub("", p))) for p in parts}


def features_of(word: str) -> set[str]:
    """The word itself and its letter 5-grams, the first with its border."""
    framed = "^" + word
    return {"=" + word, *(framed[k:k + NGRAM] for k in range(max(1, len(framed) - NGRAM + 1)))}


@dataclass
class Weights:
    """Feature weights and a logistic curve over a text's strongest words."""

    features: dict[str, float]
    curve: np.ndarray

    def of_word(self, word: str) -> float:
        get = self.features.get
        return max(get(f, 0.0) for f in features_of(word))


class Scorer:
    """Scores texts in a task; remembers the weights of words."""

    def __init__(self, restorer: Restorer, weights: Weights):
        self.restorer, self.weights = restorer, weights
        self.known: dict[str, float] = {}

    def strongest(self, text: str) -> list[float]:
        """The three largest word weights of a text, largest first."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        for word in self.restorer.words(text):
            weight = known.get(word)
            if weight is None:
                weight = self.weights.of_word(self.restorer.clean(word))
                if len(word) <= REMEMBERED_LENGTH:
                    known[word] = weight
            if weight:
                found.append(weight)
        found.sort(reverse=True)
        return (found[:3] + [0.0, 0.0, 0.0])[:3]


def curve_inputs(strongest: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(strongest)), strongest])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bounded_sample(df: DataFrame, labels: DataFrame, label: str, use: Column, rows: int, id_column: str, text_column: str) -> DataFrame:
    """Texts of at most ``rows`` labelled rows that ``use`` allows: those with the smallest hash of the id.

    The chosen ids, at most ``rows``, are broadcast to the scan of the texts.
    """
    chosen = (
        labels.where(use & F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(id_column).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64(F.col(id_column)), id_column).limit(rows)
        .select(F.col(id_column).alias("_id"), "_label")
    )
    texts = df.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id")


def fit(df: DataFrame, labels: DataFrame, use: Column, model: np.ndarray, label: str = "toxic", id_column: str = "doc_id",
        text_column: str = "text", rows: int = FIT_ROWS) -> Weights:
    """Learn weights from labelled texts.

    Three quarters of the sample give a log-odds weight to each feature, lowered
    by two standard errors; every feature clearly above none is kept, so ``rows``
    alone bounds the model. The rest fits the curve from strong words to a
    probability. Without both labels in the sample every text scores the share
    of label 1, or one half when there is no label at all.
    """
    sample = bounded_sample(df, labels, label, use, rows, id_column, text_column)
    table = df.sparkSession.sparkContext.broadcast(model)
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("_id")), F.lit(4))
    first, second = sample.where(part > 0), sample.where(part == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(table.value)
        for batch in batches:
            for piece in pieces_of(batch, 1, 2_000_000):
                tallies = (Counter(), Counter())
                for y, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    found: set[str] = set()
                    for word in restorer.words(text):
                        found |= features_of(restorer.clean(word))
                    found.add("")  # counts texts
                    tallies[y > 0].update(found)
                names = list(tallies[0].keys() | tallies[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), *(pa.array([t[f] for f in names], pa.int64()) for t in tallies)],
                    ["feature", "n0", "n1"])

    counted = cut_lineage(
        first.select("_label", "_text").mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n1 >= 3 OR feature = ''")
    )
    texts = counted.where("feature = ''").first()  # one row
    t0, t1 = (texts["n0"], texts["n1"]) if texts else (0, 0)
    odds = F.log((F.col("n1") + 0.5) / F.lit(t1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(t0 + 1.0))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    scored = (
        counted.where("feature <> ''").withColumn("weight", odds - 2 * error).where("weight > 0.5").select("feature", "weight")
    )
    weights = Weights({r["feature"]: r["weight"] for r in scored.collect()}, np.array([0.0, 0.0, 0.0, 0.0]))  # of ``rows`` texts at most
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Restorer(table.value), shared.value)
        for batch in batches:
            strongest = [scorer.strongest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(strongest, pa.list_(pa.float64()))], ["y", "s"])

    measured = second.select("_label", "_text").mapInArrow(measure, "y int, s array<double>").collect()  # a quarter of ``rows``
    if measured:
        y = np.array([min(1, max(0, r["y"])) for r in measured], float)
        if 0 < y.sum() < len(y):
            weights.curve = fit_logistic(curve_inputs(np.array([r["s"] for r in measured])), y)
        else:
            share = (y.sum() + 0.5) / (len(y) + 1)
            weights.curve = np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    return weights


def character_model(df: DataFrame, text_column: str = "text") -> np.ndarray:
    """The language model of all texts; the driver sees at most 64^3 counts."""
    return language_model([(r["trigram"], r["n"]) for r in trigram_counts(df, text_column).collect()])


def scores(df: DataFrame, model: np.ndarray, weights: Weights, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, score)`` of every row; null texts are scored as empty ones."""
    context = df.sparkSession.sparkContext
    table, shared = context.broadcast(model), context.broadcast(weights)

    def make():
        scorer = Scorer(Restorer(table.value), shared.value)
        curve = shared.value.curve

        def run(ids, texts):
            x = curve_inputs(np.array([scorer.strongest(t) for t in texts]).reshape(-1, 3))
            return {"id": ids, "score": 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))}

        return run

    return map_texts(df, id_column, text_column, f"id {df.schema[id_column].dataType.simpleString()}, score double", make)


def toxicity(df: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", id_column: str = "doc_id",
             text_column: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """``(id, score)`` with the character model of all texts and weights from labelled ones.

    ``use`` says which label rows may be learned from. Null and empty texts get the
    score of a text without strong words. Repeated rows each get a row, equal
    texts equal scores; an id labelled more than once counts as 1 when any label
    is. Words of any length are read whole. Only the named columns are read, so
    others may have any name. An empty table gives an empty one; without labelled
    rows, or with too few to fit the curve, every text scores one half.
    """
    model = character_model(df, text_column)
    return scores(df, model, fit(df, labels, use, model, label, id_column, text_column, rows), id_column, text_column)


def without_toxic(df: DataFrame, labels: DataFrame, use: Column, threshold: float = 0.5, label: str = "toxic",
                  id_column: str = "doc_id", text_column: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns, in one pass without a shuffle.

    Null and empty texts have no strong words and are judged by that score; equal
    rows stay or go together; a null id or other null values change nothing. Without
    labelled rows, or with too few to fit the curve, nothing is known and all rows stay.
    An empty table gives an empty one.
    """
    model = character_model(df, text_column)
    weights = fit(df, labels, use, model, label, id_column, text_column, rows)
    if not weights.curve.any():
        return df
    context = df.sparkSession.sparkContext
    table, shared = context.broadcast(model), context.broadcast(weights)
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, curve = Scorer(Restorer(table.value), shared.value), shared.value.curve
        for batch in batches:
            for piece in pieces_of(batch, at, 4_000_000):
                texts = [t or "" for t in piece.column(at).to_pylist()]
                x = curve_inputs(np.array([scorer.strongest(t) for t in texts]).reshape(-1, 3))
                score = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
                yield piece.filter(pa.array(score < threshold))

    return df.mapInArrow(run, df.schema)
