"""Byte-pair encoding and decoding.

A piece of text starts as a doubly linked list of byte symbols. A priority queue
holds the rank of every adjacent pair that can merge; an entry whose symbols have
changed since it was pushed is stale and is skipped. Decoding joins the
vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import regex
from pyspark.sql import DataFrame

from docketry.llm.common import map_texts

# Fixed value: the pattern that cuts text into pieces before merging.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces whose codes a task remembers; a full memory is emptied.
REMEMBERED = 200_000
_LOADED: dict[str, Codec] = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files.

    Printable Latin-1 bytes stand for themselves; the others follow from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """Codes of pieces, worked out when a piece is first asked for; emptied when full."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        codes = b"".join(i.to_bytes(4, "little") for i in self.merge(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = codes
        return codes


class Codec:
    """Merge ranks and byte strings of one vocabulary file."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model, kind = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are read")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not read")
        letters = byte_letters()
        vocab = model["vocab"]
        self.strings = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if all(c in letters for c in s)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.piece = regex.compile(PIECE)
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.known = Remembered(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.of_byte[b] for b in piece]
        end = len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        merges, queue = self.merges, []
        for i in range(end - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= end or symbols[j] != right:
                continue  # stale
            joined = merges[left, right][1]
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if found := merges.get((joined, symbols[k])):
                    heapq.heappush(queue, (found[0], i, joined, symbols[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbols[h], joined))):
                heapq.heappush(queue, (found[0], h, symbols[h], joined))
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.piece.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; added tokens inside the text are matched first."""
        if not self.special:
            return self._plain(text)
        out, begin = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[begin:m.start()]), self.added[m.group()].to_bytes(4, "little")
            begin = m.end()
        return b"".join([*out, self._plain(text[begin:] if begin else text)])

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in a row; bytes that are not UTF-8 become U+FFFD, unknown ids vanish."""
        strings = self.strings
        try:
            joined = b"".join(map(strings.__getitem__, ids))
        except KeyError:
            joined = b"".join(strings.get(i, b"") for i in ids)
        return joined.decode("utf-8", "replace")


def codec(raw: str) -> Codec:
    """The codec of a vocabulary file, built once per worker process."""
    key = hashlib.sha256(raw.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(raw)
    return _LOADED[key]


def load(path: str) -> str:
    """Text of a vocabulary file. The driver reads it and sends it to the tasks (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def unpack(codes: bytes) -> list[int]:
    return memoryview(codes).cast("I").tolist() if codes else []


def encode_texts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` for every row.

    A null text counts as empty and has no ids. Repeated rows each give a row.
    Texts of any length are encoded whole; memory in a task holds a few MB of
    texts, or one text if that is longer.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        c = codec(shared.value)

        def run(ids, texts):
            codes = [unpack(c.encode(t)) for t in texts]
            return {"id": ids, "ids": codes, "decoded": [c.decode(x) for x in codes]}

        return run

    kind = df.schema[id_column].dataType.simpleString()
    return map_texts(df, id_column, text_column, f"id {kind}, ids array<int>, decoded string", make)


def encoded_rows(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``: as ``encode_texts``, with a flag in place of the decoded text."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        c = codec(shared.value)

        def run(ids, texts):
            codes = [unpack(c.encode(t)) for t in texts]
            same = [c.decode(x) == t for x, t in zip(codes, texts)]
            return {"doc_id": ids, "n_tokens": [len(x) for x in codes], "ids": codes, "round_trip": same}

        return run

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean"
    return map_texts(df, id_column, text_column, schema, make, limit=2_000_000)


def round_trip_digests(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: as ``encode_texts``, with digests in place of the values."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        c = codec(shared.value)

        def run(ids, texts):
            codes = [c.encode(t) for t in texts]
            back = [c.decode(unpack(x)) for x in codes]
            return {
                "id": ids, "n_tokens": [len(x) // 4 for x in codes],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in codes],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back],
            }

        return run

    kind = df.schema[id_column].dataType.simpleString()
    return map_texts(df, id_column, text_column, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
