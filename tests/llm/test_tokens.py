"""Encoding, decoding and counting against the vocabulary's own library."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docketry.llm import byte_pair, token_transducer
from tests.llm.helpers import ODD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = byte_pair.codec(byte_pair.load(PATH))
MACHINE = token_transducer.machine(byte_pair.load(PATH))


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check(texts):
    for text, n in zip(texts, token_transducer.count_tokens(MACHINE, texts).tolist()):
        want = ids(text)
        codes = byte_pair.unpack(CODEC.encode(text))
        assert codes == want and n == len(want), text[:80]
        assert CODEC.decode(codes) == LIBRARY.decode(want, skip_special_tokens=False) == text


FIXED = [
    "", " ", "  ", "\n\n x", "don't I'll we've 'tis ''s 's's  's\n's", "it's'", "a" * 3000, " " * 500 + "b", "'re" * 200,
    "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "éèê ñ ß 漢字 😀😀 　 \x85\x1c1²Ⅷ", "ab" * 2000 + "c", "9" * 100,
]


def test_fixed_texts():
    check(FIXED)


def test_every_character_class():
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xFE00, 0x10400)]
    check(["".join(f"a{c}a1{c} {c}" for c in points[k:k + 50]) for k in range(0, len(points), 50)])


def test_random_texts():
    rng = random.Random(3)
    letters = "ab re'sTvelLdm \n\t\r\x0b\x1c\x85 019²é漢😀.,!?<|endoftext|>-_$%"
    check(["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(400)])
    check(["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 200))) for _ in range(200)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    check([t.encode("utf-8", "ignore").decode() for t in texts])


def test_full_table_of_states(monkeypatch):
    """Pieces for which no state is left are merged directly, with the same count."""
    small = token_transducer.PieceMachine(CODEC)
    monkeypatch.setattr(token_transducer, "MOST_STATES", 40)
    for _ in range(2):
        assert token_transducer.count_tokens(small, FIXED).tolist() == [len(ids(t)) for t in FIXED]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 256])
def test_chunks_do_not_matter(chunk):
    codes = np.frombuffer(("it's  a\n\n 'test' of 12 x" * 3).encode("utf-32-le"), np.uint32)
    symbols = token_transducer.symbols_of(np.append(codes, 0x110000))
    assert (token_transducer.piece_starts(symbols, chunk) == token_transducer.piece_starts(symbols, 4096)).all()


def test_stale_entries_and_unknown_ids():
    assert CODEC.decode([10**9]) == ""
    assert CODEC.decode([CODEC.of_byte[0xC3]]) == "�"
    assert byte_pair.byte_letters()["Ġ"] == 0x20


def test_odd_rows(spark):
    df = documents(spark, ODD)
    want = sorted((str(i), len(ids(t or ""))) for i, t, _, _ in ODD)
    counts = token_transducer.token_counts(df, PATH).collect()
    assert sorted((str(r["id"]), r["n_tokens"]) for r in counts) == want
    assert all(r["n_bytes"] == 0 for r in counts if r["id"] in (1, 2))
    done = byte_pair.round_trip_digests(df, PATH).collect()
    assert sorted((str(r["id"]), r["n_tokens"]) for r in done) == want
    texts = {i: t or "" for i, t, _, _ in ODD}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["id"]].encode()).hexdigest() for r in done if r["id"] is not None)
    rows = byte_pair.encoded_rows(df, PATH).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in rows) == want and all(r["round_trip"] for r in rows)
    assert {r["decoded"] for r in byte_pair.encode_texts(df, PATH).collect()} == {t or "" for _, t, _, _ in ODD}


def test_empty_table(spark):
    df = documents(spark, [])
    assert token_transducer.token_counts(df, PATH).collect() == []
    assert byte_pair.round_trip_digests(df, PATH).collect() == []
