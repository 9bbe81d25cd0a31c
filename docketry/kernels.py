"""NumPy helpers that run inside tasks.

The module is pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALPHAS = np.linspace(0.02, 1.0, 50)
BETAS = np.linspace(0.0, 0.9, 10)
PHIS = (0.80, 0.85, 0.90, 0.95, 0.98)


# --- exponential smoothing of one short series ------------------------------


def level_fit(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Simple smoothing: the best start level per alpha in closed form, then the best alpha.

    Returns the one-step fit and the level after the last value.
    """
    best = None
    for a in ALPHAS:
        weight = (1 - a) ** np.arange(len(y))  # share of the start level in each fitted value
        known = np.zeros(len(y))
        for i in range(1, len(y)):
            known[i] = a * y[i - 1] + (1 - a) * known[i - 1]
        start = np.dot(weight, y - known) / np.dot(weight, weight)
        fitted = known + weight * start
        sse = float(((y - fitted) ** 2).sum())
        if best is None or sse < best[0] - 1e-12:
            best = (sse, fitted, a * y[-1] + (1 - a) * fitted[-1])
    return best[1], float(best[2])


def trend_fit(y: np.ndarray, steps: int) -> np.ndarray:
    """Damped additive trend: start level and slope by least squares on a parameter grid."""
    n, best = len(y), None
    for a in ALPHAS[4::5]:
        for b in BETAS:
            for phi in PHIS:
                # The state is linear in (1, start level, start slope).
                level, slope = np.array([0.0, 1.0, 0.0]), np.array([0.0, 0.0, 1.0])
                rows = np.empty((n, 3))
                for i in range(n):
                    ahead = level + phi * slope
                    rows[i] = ahead
                    new = (1 - a) * ahead
                    new[0] += a * y[i]
                    slope = b * (new - level) + (1 - b) * phi * slope
                    level = new
                start, *_ = np.linalg.lstsq(rows[:, 1:], y - rows[:, 0], rcond=None)
                full = np.concatenate([[1.0], start])
                sse = float(((y - rows @ full) ** 2).sum())
                if best is None or sse < best[0] - 1e-12:
                    best = (sse, level @ full, slope @ full, phi)
    _, level, slope, phi = best
    return level + slope * np.cumsum(phi ** np.arange(1, steps + 1))


def fit_and_forecast(y: np.ndarray, steps: int) -> np.ndarray:
    """Damped trend when there are at least three points, else a level."""
    return trend_fit(y, steps) if len(y) > 2 else np.repeat(level_fit(y)[1], steps)


# --- nearest neighbours -----------------------------------------------------


def keep_nearest(query: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` nearest per query, ties by id."""
    order = np.lexsort((ids, distance, query))
    query, distance, ids = query[order], distance[order], ids[order]
    first = np.searchsorted(query, query, side="left")
    kept = np.arange(len(query)) - first < k
    return query[kept], distance[kept], ids[kept]


def cells_of(column: pa.ListArray, width: int) -> np.ndarray:
    """One line of marks per list of cell numbers; numbers from ``width`` on are left out."""
    marks = np.zeros((len(column), width), bool)
    line, cell = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), column.flatten().to_numpy()
    marks[line[cell < width], cell[cell < width]] = True
    return marks


def nearest_in_rows(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, limit: np.ndarray, k: int,
                    block: int = 256, marks: np.ndarray | None = None, cell: np.ndarray | None = None):
    """Squared distances of the rows that can be among the ``k`` nearest of a query.

    With ``marks``, a line of wanted cells per query, only rows whose ``cell`` is marked count.

    A matrix product selects with a small margin; the distances kept are summed
    directly, so equal vectors tie exactly. ``limit`` holds the k-th distance
    found so far per query.
    """
    out = []
    norms = (rows ** 2).sum(axis=1)
    for at in range(0, len(queries), block):
        q = queries[at:at + block]
        rough = q @ rows.T
        rough *= -2.0
        rough += norms[None, :]
        rough += (q ** 2).sum(axis=1)[:, None]
        if marks is not None:
            rough[~marks[at:at + block][:, cell]] = np.inf
        bound = limit[at:at + block]
        if rough.shape[1] > k and np.isinf(bound).any():  # a known limit leaves few rows without it
            bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1])
        near = rough <= (bound + 1e-9 * (1.0 + np.abs(np.where(np.isinf(bound), 0.0, bound))))[:, None]
        qi, ri = np.nonzero(near & (rough < np.inf) if marks is not None else near)
        exact = ((q[qi] - rows[ri]) ** 2).sum(axis=1)
        out.append((qi + at, exact, ids[ri]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def nearest_task(k: int, schema: pa.Schema):
    """Arrow batches of ``(space, a, b, is_row, id, vector[, cells])`` to each query's ``k`` nearest rows of its group.

    Rows come sorted by the first four columns, so a group's queries precede its
    rows. The task holds one block of queries and ``k`` rows for each of them.
    """

    def matrix(column):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def keys(column):
        return np.array(column.to_pylist())

    def run(batches):
        group, queries, names, wanted = None, [], [], []
        found, limit, marks, cell = None, None, None, None

        def result():
            if found is None or not len(found[0]):
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(names[0][found[0]], schema.field(0).type), pa.array(found[2], schema.field(1).type),
                 pa.array(found[1], pa.float64())], schema=schema)

        for batch in batches:
            kinds = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64)
            cuts = np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)]):
                if lo == hi:
                    continue
                key, part = tuple(kinds[lo, :3]), batch.slice(lo, hi - lo)
                if key != group:
                    if (done := result()) is not None:
                        yield done
                    group, queries, names, wanted, found, limit = key, [], [], [], None, None
                if not kinds[lo, 3]:
                    queries.append(matrix(part.column(5)))
                    names.append(keys(part.column(4)))
                    if part.num_columns > 6:
                        wanted.append(part.column(6))
                    continue
                if not queries:
                    continue
                if found is None:
                    queries, names = [np.concatenate(queries)], [np.concatenate(names)]
                    limit = np.full(len(queries[0]), np.inf)
                    if wanted:
                        lists = pa.concat_arrays(wanted)
                        marks = cells_of(lists, int(pc.max(lists.flatten()).as_py()) + 2)  # the last column stays unmarked
                    found = (np.empty(0, np.int64), np.empty(0), names[0][:0])
                for at in range(0, hi - lo, 4096):
                    some = part.slice(at, 4096)
                    if wanted:
                        cell = np.minimum(some.column(6).flatten().to_numpy(), marks.shape[1] - 1)
                    q, d, i = nearest_in_rows(queries[0], matrix(some.column(5)), keys(some.column(4)), limit, k, marks=marks if wanted else None, cell=cell)
                    found = keep_nearest(
                        np.concatenate([found[0], q]), np.concatenate([found[1], d]), np.concatenate([found[2], i]), k
                    )
                    number, count = np.unique(found[0], return_counts=True)
                    last = np.searchsorted(found[0], number, side="right") - 1
                    full = count >= k
                    limit[number[full]] = found[1][last[full]]
        if (done := result()) is not None:
            yield done

    return run


# --- counts of terms --------------------------------------------------------


def term_hashes(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``n`` words within a row, from the words' hashes; a single word keeps its own."""
    start = np.arange(max(0, len(codes) - n + 1))
    start = start[row[start] == row[start + n - 1]]
    hashed = codes[start].view(np.uint64)
    for i in range(1, n):
        hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[start + i].view(np.uint64)
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return start, hashed.view(np.int64)


# Buckets of a sieve of terms.
SIEVE_BITS = 19


def buckets(hashed: np.ndarray) -> np.ndarray:
    return (hashed.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def slices(lists, words: int = 250_000):
    """Runs of rows of a list column that hold about so many words, so memory does not go with the length of the texts."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(lists):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + words, side="right")))
        yield lists.slice(at, end - at)
        at = end


def term_runs(batches, ngrams: int):
    """Of Arrow batches of one list column of word hashes: the hashes, each one's row, and ``term_hashes`` per length."""
    for batch in batches:
        for lists in slices(batch.column(0)):
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            codes = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
            yield codes, row, [term_hashes(codes, row, n) for n in range(1, ngrams + 1)]


def term_sieve(batches, ngrams: int = 1):
    """Occurrences ``(bucket, total)`` of all terms by bucket of their hash, which no term of a bucket exceeds."""
    total = np.zeros(1 << SIEVE_BITS, np.int64)
    for _, _, runs in term_runs(batches, ngrams):
        for _, hashed in runs:
            total += np.bincount(buckets(hashed), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "total"])


def term_counts(batches, wanted: np.ndarray, ngrams: int = 1):
    """Arrow batches of one list column of word hashes to ``(h, words' hashes, total, rows)`` of the terms in wanted buckets.

    ``wanted`` holds the marks of all buckets, packed. A partition may give a term several times.
    """
    marks = np.unpackbits(wanted).astype(bool)
    for codes, row, runs in term_runs(batches, ngrams):
        begin, hashed, size = [], [], []
        for n, (start, own) in enumerate(runs, 1):
            hit = np.flatnonzero(marks[buckets(own)])
            begin.append(start[hit])
            hashed.append(own[hit])
            size.append(np.full(len(hit), n))
        begin, hashed, size = (np.concatenate(x) for x in (begin, hashed, size))
        # The words' hashes, 0 beyond a term's end.
        words = [np.where(i < size, codes[np.minimum(begin + i, len(codes) - 1)], 0) if len(begin) else hashed for i in range(ngrams)]
        order = np.argsort(hashed, kind="stable")  # rows of equal terms stay in order
        fresh_key = lambda keys: np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[:len(hashed)]
        keys = [k[order] for k in (hashed, size, *words)]
        start = fresh_key(keys)
        if (start != fresh_key(keys[:1])).any():  # different terms share a hash
            order = np.lexsort((row[begin], *reversed(words), size, hashed))
            keys = [k[order] for k in (hashed, size, *words)]
            start = fresh_key(keys)
        held = row[begin][order]
        fresh = start.copy()
        fresh[1:] |= held[1:] != held[:-1]
        first = np.flatnonzero(start)
        total = np.diff(np.append(first, len(held)))
        rows = np.add.reduceat(fresh, first, dtype=np.int64) if len(first) else total
        inside = [pa.array(w[first], mask=keys[1][first] <= i) for i, w in enumerate(keys[2:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0][first]), *inside, pa.array(total), pa.array(rows)],
            ["h", *(f"w{i}" for i in range(ngrams)), "total", "rows"])


def codes_and_words(batches):
    """Arrow batches of ``(words, codes)`` to ``(codes, fresh)``; a batch's first row lists its different words with their codes."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("word", pa.string())]))
    for batch in batches:
        if not batch.num_rows:
            continue
        words, codes = batch.column(0).flatten().dictionary_encode(), batch.column(1).flatten()
        place = words.indices.to_numpy()
        first = np.zeros(len(words.dictionary), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        pairs = pa.StructArray.from_arrays([codes.take(pa.array(first)), words.dictionary], ["h", "word"])
        ends = np.full(batch.num_rows + 1, len(first), np.int32)
        ends[0] = 0
        fresh = pa.ListArray.from_arrays(pa.array(ends), pairs).cast(kind)
        yield pa.RecordBatch.from_arrays([batch.column(1), fresh], ["codes", "fresh"])


class TermTable:
    """A vocabulary of terms of one or more words as a tree of words."""

    def __init__(self, terms):
        split = [t.split(" ") for t in terms]
        names = sorted({w for t in split for w in t})
        number = {w: i for i, w in enumerate(names)}
        self.words, self.size, self.levels = pa.array(names, pa.string()), len(split), []
        below = {(): 0}  # a term's beginning, and its place on its level
        for n in range(1, max(map(len, split), default=0) + 1):
            keys = sorted({(below[tuple(t[:n - 1])] * len(names) + number[t[n - 1]], tuple(t[:n])) for t in split if len(t) >= n})
            below = {begin: i for i, (_, begin) in enumerate(keys)}
            term = np.full(len(keys), -1, np.int64)
            for i, t in enumerate(split):
                if len(t) == n:
                    term[below[tuple(t)]] = i
            self.levels.append((np.array([k for k, _ in keys], np.int64), term))

    def counted(self, lists):
        """Row, term and number of the terms in each row of a list column of words, in this order."""
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy().astype(np.int64)
        start, node, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
        for n, (keys, term) in enumerate(self.levels):
            here = np.flatnonzero(start + n < len(code))
            start, node = start[here], node[here]
            word = code[start + n]
            here = np.flatnonzero((word >= 0) & (row[start + n] == row[start]))
            start, node, word = start[here], node[here], word[here]
            key = node * len(self.words) + word
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            here = np.flatnonzero(keys[at] == key)
            start, node = start[here], at[here]
            whole = term[node] >= 0
            found.append(row[start[whole]] * self.size + term[node[whole]])
        each, count = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
        return *np.divmod(each, max(1, self.size)), count

    def listed(self, lists):
        """``(index, count)`` lists of each row, by index."""
        starts, index, times = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in slices(lists):
            row, term, count = self.counted(some)
            starts.append(starts[-1][-1] + np.cumsum(np.bincount(row, minlength=len(some))))
            index.append(term)
            times.append(count)
        ends = pa.array(np.concatenate(starts).astype(np.int32))
        parts = [np.concatenate(x).astype(np.int32) for x in (index, times)]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(p)) for p in parts], ["index", "count"])


# --- similarity of cases to a block of queries ------------------------------


def overlaps(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Jaccard overlap of every left list with every right list; 0 when both are empty."""
    place = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode().indices.to_numpy()
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in (left, right)])
    held = np.zeros((len(sizes), int(place.max()) + 1 if len(place) else 1), np.float32)
    held[np.repeat(np.arange(len(sizes)), sizes), place] = 1.0
    one, two = held[:len(left)], held[len(left):]
    both = (one @ two.T).astype(float)
    either = one.sum(axis=1)[:, None] + two.sum(axis=1)[None, :] - both
    return np.divide(both, either, out=np.zeros_like(both), where=either > 0)


def dense_rows(indices: pa.ListArray, counts: pa.ListArray, scale: np.ndarray) -> np.ndarray:
    """Counts of terms times ``scale``, a row at unit length."""
    out = np.zeros((len(indices), len(scale)))
    rows, index = np.repeat(np.arange(len(indices)), np.diff(indices.offsets.to_numpy())), indices.flatten().to_numpy()
    weight = counts.flatten().to_numpy() * scale[index]
    out[rows, index] = weight / np.sqrt(np.bincount(rows, weight * weight, len(out)))[rows]
    return out


def similarity_task(scale: np.ndarray, weights: tuple, threshold: float, schema: pa.Schema, step: int = 256):
    """Score groups of queries and cases; pairs above the threshold go out.

    Batches hold ``(space, a, b, is_row, id, indices, counts, issues, rank,
    citations)``, sorted by the first four columns, so that a group's queries,
    one block of them, precede its cases.
    """
    w_text, w_issue, w_time, w_cite = weights

    def run(batches):
        group, waiting, asked, vectors = None, [], None, None
        for batch in batches:
            marks = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)]):
                if lo == hi:
                    continue
                if tuple(marks[lo, :3]) != group:
                    group, waiting, asked = tuple(marks[lo, :3]), [], None
                if not marks[lo, 3]:
                    waiting.append(batch.slice(lo, hi - lo))
                    continue
                if asked is None:
                    if not waiting:
                        continue
                    asked = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    vectors = dense_rows(asked.column(5), asked.column(6), scale)
                for at in range(lo, hi, step):
                    some = batch.slice(at, min(step, hi - at))
                    text = vectors @ dense_rows(some.column(5), some.column(6), scale).T
                    issue, cite = (overlaps(asked.column(c), some.column(c)) for c in (7, 9))
                    ranks = (c.column(8).to_numpy(zero_copy_only=False).astype(float) for c in (asked, some))
                    time = 1.0 - np.abs(np.subtract.outer(*ranks)) / 3.0
                    total = w_text * text + w_issue * issue + w_time * time + w_cite * cite
                    q, c = np.nonzero(total > threshold)
                    yield pa.RecordBatch.from_arrays(
                        [asked.column(4).take(pa.array(q)), some.column(4).take(pa.array(c)),
                         *(pa.array(x[q, c]) for x in (total, text, issue, time, cite))], schema=schema)

    return run
