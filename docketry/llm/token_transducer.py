"""Token counts by finite-state transducers.

Two transducers run in a row, both over NumPy arrays of many texts at once.

The first cuts text into pieces. Its input symbol is a character's class with the
classes of the next characters folded in, so it needs no look-ahead of its own.
Eight states are enough. The text is cut into chunks; each chunk's map from entry
state to exit state is worked out independently, the maps are composed by a
parallel prefix scan, and a second pass with the known entry states marks where
pieces begin.

The second reads the bytes of a piece and annotates every transition with the
change in the number of tokens. Its state is the longest suffix that can still
grow into a longer token, with the merges that could cross a border and the
relative count at each position inside that suffix. The last token of a prefix is
the only one that merging leaves beside the token before it, so the next state
follows from the state alone. States are compiled when a text first needs them, and start anew at
every piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import regex
from pyspark.sql import DataFrame

from docketry.llm.byte_pair import Codec, codec, load
from docketry.llm.common import map_texts

CHUNK = 256
# Compiled states that a worker keeps (1.3 KB each); pieces beyond are merged directly.
MOST_STATES = 110_000
# Input symbols of the first transducer.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LAST_SPACE, LAST_BLANK, STOP = range(9)
# Its states: between pieces, in a run of letters, numbers or others, after a
# leading space, in white space, and with one or two letters of a contraction to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LED, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)
_STOP_CODE = 0x110000
_MACHINES: dict[str, PieceMachine] = {}
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point: letter, number, other, or white space (BLANK)."""
    if not _CLASSES:
        kinds = np.full(_STOP_CODE + 1, OTHER, np.uint8)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        everything = "".join(map(chr, points))
        skip = lambda i: i if i < 0xD800 else i + 0x800
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
            for m in regex.finditer(pattern, everything):
                kinds[skip(m.start()):skip(m.end() - 1) + 1] = kind
        kinds[0x1C:0x20] = OTHER  # separators that are not White_Space
        kinds[_STOP_CODE] = STOP
        _CLASSES.append(kinds)
    return _CLASSES[0]


def piece_table() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by (state, symbol)."""
    step, begins = np.zeros((8, 9), np.uint8), np.zeros((8, 9), bool)
    home = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS}
    opens = {SHORT: ONE_LEFT, LONG: TWO_LEFT, BLANK: IN_BLANKS, LAST_SPACE: LED, LAST_BLANK: FREE, STOP: FREE}
    for state in range(8):
        for symbol in range(9):
            run = home.get(symbol)
            if state == ONE_LEFT and symbol == LETTER:
                step[state, symbol] = FREE
            elif state == TWO_LEFT and symbol == LETTER:
                step[state, symbol] = ONE_LEFT
            elif run is not None and state in (run, LED):
                step[state, symbol] = run
            elif state == IN_BLANKS and symbol == BLANK:
                step[state, symbol] = IN_BLANKS
            else:
                step[state, symbol] = opens.get(symbol, run)
                begins[state, symbol] = True
    return step, begins


_STEP, _BEGINS = piece_table()


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """Input symbols of the first transducer for an array of code points that ends with a stop."""
    kinds = classes()[codes]
    symbols = kinds.copy()
    blank = kinds == BLANK
    following = np.append(kinds[1:], STOP)
    last = blank & (following != BLANK) & (following != STOP)
    symbols[last] = np.where(codes[last] == 0x20, LAST_SPACE, LAST_BLANK)
    quotes = np.flatnonzero(codes == 0x27)
    padded = np.append(codes, [_STOP_CODE, _STOP_CODE])
    for q in quotes:
        one, two = int(padded[q + 1]), int(padded[q + 2])
        if one < 128 and chr(one) in "stmd":
            symbols[q] = SHORT
        elif one < 128 and two < 128 and chr(one) + chr(two) in ("re", "ve", "ll"):
            symbols[q] = LONG
    return symbols


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of chunk maps, by doubling steps."""
    done, gap = maps.copy(), 1
    while gap < len(done):
        done[gap:] = np.take_along_axis(done[gap:], done[:-gap].astype(np.intp), axis=1)
        gap *= 2
    return done


def piece_starts(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece begins at each character."""
    n = len(symbols)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, STOP, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)  # one row per step
    step = _STEP.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        maps = step[maps * np.uint8(9) + column[:, None]]
    state = np.empty(rows, np.uint8)
    state[0] = FREE
    state[1:] = compose(maps)[:-1, FREE]
    begins, flags = _BEGINS.ravel(), np.empty((chunk, rows), bool)
    for i, column in enumerate(grid):
        at = state * np.uint8(9) + column
        flags[i] = begins[at]
        state = step[at]
    return flags.T.ravel()[:n]


class PieceMachine:
    """Transducer from the bytes of a piece to its number of tokens.

    A token may follow another when no merge crosses the border between them: no
    symbol that stands at the left token's end at some time and no symbol that
    stands at the right token's start merge before either is used up. So a mark
    needs of its token only the crossing merges, by right symbol, that agree
    with the bytes read since; tokens that agree on those share states.
    """

    def __init__(self, source: Codec):
        self.codec = source
        specials = set(source.added.values())
        self.tokens = {s for i, s in source.strings.items() if i not in specials}
        self.grows = {s[:k] for s in self.tokens for k in range(len(s))}  # what a longer token starts with
        self.partners: dict[int, list[tuple[int, int]]] = {}
        for (left, right), (rank, _) in source.merges.items():
            self.partners.setdefault(left, []).append((right, rank))
        self.reset()

    def reset(self) -> None:
        self.borders: dict[bytes, tuple[dict, int] | None] = {}
        self.crossings: list[dict[int, int]] = [{}]
        self.crossing_ids = {frozenset(): 0}
        self.narrowed: dict[tuple[int, bytes], int] = {}
        self.states = {(b"", ((0, 0),)): 0}
        self.known = [(b"", ((0, 0),))]
        self.next = np.full(1024 * 256, -1, np.int32)
        self.change = np.zeros(1024 * 256, np.int8)

    def _crossing_id(self, crossing: dict[int, int]) -> int:
        key = frozenset(crossing.items())
        found = self.crossing_ids.get(key)
        if found is None:
            found = self.crossing_ids[key] = len(self.crossings)
            self.crossings.append(crossing)
        return found

    def _border(self, token: bytes) -> tuple[dict, int] | None:
        """Symbols at a token's start with the rank that uses them up, and the merges that can cross its end.

        None for a vocabulary entry that merging never makes.
        """
        if token in self.borders:
            return self.borders[token]
        merges, of_byte, never = self.codec.merges, self.codec.of_byte, len(self.codec.merges)
        # A node: its symbol, what stood at its start before, what stood at its end before.
        nodes = [(of_byte[b], {}, {}) for b in token]
        while len(nodes) > 1:
            rank, i = min((merges.get((nodes[i][0], nodes[i + 1][0]), (never,))[0], i) for i in range(len(nodes) - 1))
            if rank == never:
                break
            left, right = nodes[i], nodes[i + 1]
            joined = merges[left[0], right[0]][1]
            nodes[i:i + 2] = [(joined, left[1] | {left[0]: rank}, right[2] | {right[0]: rank})]
        out = None
        if len(nodes) == 1:
            symbol, starts, ends = nodes[0]
            crossing: dict[int, int] = {}
            for end, limit in (ends | {symbol: never}).items():
                for partner, rank in self.partners.get(end, ()):
                    if rank < limit and rank < crossing.get(partner, never):
                        crossing[partner] = rank
            out = (starts | {symbol: never}, self._crossing_id(crossing))
        self.borders[token] = out
        return out

    def _narrow(self, crossing: int, suffix: bytes) -> int:
        """The crossing merges that agree with the bytes after the border."""
        key = (crossing, suffix)
        if key not in self.narrowed:
            strings = self.codec.strings
            self.narrowed[key] = self._crossing_id({
                y: r for y, r in self.crossings[crossing].items()
                if strings[y].startswith(suffix) or suffix.startswith(strings[y])
            })
        return self.narrowed[key]

    def _fits(self, crossing: int, starts: dict[int, int]) -> bool:
        merges = self.crossings[crossing]
        return not any(merges.get(symbol, limit + 1) <= limit for symbol, limit in starts.items())

    def compile(self, state: int, byte: int) -> bool:
        """Add one transition; False when there is no room for its target."""
        suffix, marks = self.known[state]
        text = suffix + bytes((byte,))
        for size in range(len(text), 0, -1):
            token, mark = text[len(text) - size:], marks[size - 1]
            if mark and token in self.tokens and (border := self._border(token)) and self._fits(mark[0], border[0]):
                break
        change = 1 - mark[1]
        cut = 0
        while text[cut:] not in self.grows:
            cut += 1
        kept = text[cut:]
        # Entry d: crossing merges d bytes back, and how many tokens have come since; none where no token can start.
        here = [(border[1], 0)]
        for d, old in enumerate(marks[:len(kept)], 1):
            tail = kept[len(kept) - d:]
            here.append((self._narrow(old[0], tail), old[1] + change) if old and tail in self.grows else None)
        key = (kept, tuple(here))
        target = self.states.get(key)
        if target is None:
            if len(self.known) >= MOST_STATES:
                return False
            target = self.states[key] = len(self.known)
            self.known.append(key)
            if len(self.known) * 256 > len(self.next):
                self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
                self.change = np.concatenate([self.change, np.zeros(len(self.change), np.int8)])
        self.next[state * 256 + byte] = target
        self.change[state * 256 + byte] = change
        return True

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[begin:begin + size]``; all pieces advance by a byte per step."""
        if len(self.known) >= MOST_STATES:
            self.reset()
        order = np.argsort(-size, kind="stable")
        at, left = begin[order], size[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
        direct: set[int] = set()
        longest = int(left[0]) if len(left) else 0
        active = np.searchsorted(-left, -np.arange(longest), side="left")
        for k in range(longest):
            n = active[k]
            if n <= 4:
                for lane in range(n):
                    total[lane] += self._rest(data[at[lane] + k:at[lane] + left[lane]].tolist(), int(state[lane]), direct, lane)
                break
            edge = state[:n] * 256 + data[at[:n] + k]
            target = self.next[edge]
            if (target < 0).any():
                for e in np.unique(edge[target < 0]).tolist():
                    self.compile(e >> 8, e & 255)
                target = self.next[edge]
                if (target < 0).any():
                    lost = np.flatnonzero(target < 0)
                    direct.update(lost.tolist())
                    target[lost] = 0
            total[:n] += self.change[edge]
            state[:n] = target
        for lane in direct:
            total[lane] = len(self.codec.merge(data[at[lane]:at[lane] + left[lane]].tobytes()))
        out = np.empty(len(at), np.int32)
        out[order] = total
        return out

    def _rest(self, tail: list[int], state: int, direct: set[int], lane: int) -> int:
        """The same steps for one long piece."""
        added, jump, change = 0, self.next, self.change
        for byte in tail:
            edge = state * 256 + byte
            if jump[edge] < 0:
                if not self.compile(state, byte):
                    direct.add(lane)
                    return 0
                jump, change = self.next, self.change
            added += int(change[edge])
            state = int(jump[edge])
        return added


def machine(raw: str) -> PieceMachine:
    """The transducer of a vocabulary file, kept for the life of a worker process."""
    key = hashlib.sha256(raw.encode()).hexdigest()
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = PieceMachine(codec(raw))
    return _MACHINES[key]


def count_tokens(pieces: PieceMachine, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    special = pieces.codec.special
    parts, owner = [], []
    added = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        cuts = special.split(text) if special else [text]
        added[i] = len(cuts) - 1
        parts += cuts
        owner += [i] * len(cuts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    stops = np.cumsum(lengths + 1) - 1
    codes = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le"), np.uint32).copy()
    codes[stops] = _STOP_CODE
    starts = np.flatnonzero(piece_starts(symbols_of(codes)))
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    width[stops] = 1
    place = np.concatenate([[0], np.cumsum(width)])
    data = np.frombuffer(("\0".join(parts) + "\0").encode(), np.uint8)
    real = codes[starts] != _STOP_CODE
    ends = np.append(starts[1:], len(codes))
    begin, end = place[starts[real]], place[ends[real]]
    tokens = pieces.counts(data, begin, end - begin)
    text_of = np.asarray(owner, np.int64)[np.searchsorted(stops, starts[real])]
    return added + np.bincount(text_of, tokens, len(texts)).astype(np.int64)


def token_counts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row, as the vocabulary's own library counts.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows each give a row.
    Texts are read whole; a task holds a few MB of texts at a time, or one text
    if that is longer. Added tokens inside a text count one each.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        pieces = machine(shared.value)

        def run(ids, texts):
            return {"id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": count_tokens(pieces, texts)}

        return run

    kind = df.schema[id_column].dataType.simpleString()
    return map_texts(df, id_column, text_column, f"id {kind}, n_bytes long, n_tokens long", make, limit=2_000_000)
