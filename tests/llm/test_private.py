"""Personal data against plain patterns, and disclosed shares against plain counting."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import sanitise
from tests.llm.helpers import ODD, documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(x) for x in digits(m.group())][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


FIXED = [
    "", "a@b.c", "x a@b@c.d y", "a@b.c@d.e.f", "@b.c", ".@-.-", "1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.02.3.4", "4539 1488 0343 6467",
    "4539-1488-0343-6467 4539148803436468", "+1 (212) 555-0100. +49 30 1234567 +1", "+1 (2) 3", "é 4111111111111111 ü me@x.org",
    "mail a.b%c+d-e_f@g-h.i-j.co.uk.", "1" * 5000, "9" * 400 + ".1.1.1", "a" * 5000 + "@", "+1" + " " * 3000 + "2", "1.1.1." * 2000,
]


def test_fixed_texts():
    for text in FIXED:
        assert sanitise.base_spans(text) == plain_spans(text), text[:60]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+%_ ()0123456789é\n", max_size=60))
def test_any_text(text):
    assert sanitise.base_spans(text) == plain_spans(text)


def corpus():
    rows = []
    for i in range(300):
        filler = " ".join(f"w{'abcdefghij'[(i * k) % 10]}{'klmnopqrst'[(i + k) % 10]}" for k in range(1, 40))
        text = filler
        if i % 3 == 0:
            text += f" Schreibmir {'nun ' if i % 2 else ''}user{i}@mail{i % 7}.example.org bitte {filler[:40]}"
        if i % 5 == 0:
            text = f"Anschluss +1 (212) 555-{1000 + i} heute. {text}"
        if i % 10 == 1:
            text += " nun nun bitte"
        if i % 50 == 2:
            text += " seltenes Kopie copy@one.example.org"
        rows.append((i, text, "en", "a"))
    return rows


def plain_shares(texts, values, least):
    near, seen, total = Counter(), defaultdict(set), Counter()
    for text in texts:
        total.update(m.group().lower() for m in sanitise._TERM.finditer(text))
        spans = plain_spans(text)
        for start, kind, end in spans:
            low = max(0, start - sanitise.REACH)
            words = list(sanitise._TERM.finditer(text))
            left = [m for m in words if m.end() <= start and m.start() > low or m.end() <= start and low == 0][-4:]
            right = [m for m in words if m.start() >= end and m.end() < min(len(text), end + sanitise.REACH) or m.start() >= end and end + sanitise.REACH >= len(text)][:4]
            value = text[start:end].lower() if kind < 2 else digits(text[start:end])
            for m in left + right:
                if not any(s < m.end() and m.start() < e for s, _, e in spans):
                    near[m.group().lower(), kind] += 1
                    seen[m.group().lower(), kind].add(value)
    kinds, every = Counter(), sum(total.values())
    for (_, kind), n in near.items():
        kinds[kind] += n
    out = {}
    for (term, kind), n in near.items():
        if len(seen[term, kind]) >= values:
            share = math.log2(n * every / (total[term] * kinds[kind])) / math.log2(every / kinds[kind])
            if share >= least:
                out[term] = max(out.get(term, -9), share)
    return out


def test_shares_against_plain_counting(spark):
    rows = corpus()
    df = documents(spark, rows)
    got = {r["term"]: r["share"] for r in sanitise.risky_terms(df.select("text"), values=5, generalise=0.3).collect()}
    want = plain_shares([r[1] for r in rows], 5, 0.3)
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t]) for t in got)
    assert got["schreibmir"] > 0.95 and got["anschluss"] > 0.95
    assert "kopie" not in got  # beside copies of a single address


def test_report_and_texts(spark):
    rows = corpus()
    df = documents(spark, rows)
    risky = {r["term"]: r["share"] for r in sanitise.risky_terms(df.select("text")).collect()}
    assert "schreibmir" in risky
    clean = {r["doc_id"]: r for r in sanitise.sanitised(df).collect()}
    for r in sanitise.report(df).collect():
        text = rows[r["id"]][1]
        base = plain_spans(text)
        names = [f"{sanitise.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        terms = [(m.start(), 4, m.end()) for m in sanitise._TERM.finditer(text)
                 if m.group().lower() in risky and not any(s < m.end() and m.start() < e for s, _, e in base)]
        every = sorted(base + terms)
        assert r["spans"] == ",".join(f"{[*sanitise.KINDS, 'term'][k]}:{s}:{e}" for s, k, e in every) and r["n_terms"] == len(terms)
        gone = {s for s, _, e in terms if risky[text[s:e].lower()] >= sanitise.REMOVE}
        assert clean[r["id"]]["text"] == sanitise.replaced(text, [(s, e, k) for s, k, e in every], gone)
    assert "@" not in "".join(r["text"] for r in clean.values()) and "Schreibmir" not in "".join(r["text"] for r in clean.values())
    assert all(clean[i]["score"] == "mine" and clean[i]["n_chars"] == len(t) for i, t, _, _ in rows)


def test_overlapping_spans():
    assert sanitise.replaced("abcdefgh", [(1, 4, 1), (2, 6, 2), (7, 8, 4)], {7}) == "a[ip]g"


def test_odd_rows(spark):
    df = documents(spark, ODD + [(9, "call +1 212 555 0100 now", "en", "a")] * 2)
    got = sanitise.report(df).collect()
    assert len(got) == len(ODD) + 2 and sum(r["n_phone"] for r in got) == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in got if r["id"] in (1, 2, 3, 4, 5, 7))
    clean = sanitise.sanitised(df)
    assert clean.columns == df.columns
    by = defaultdict(list)
    for r in clean.collect():
        by[r["doc_id"]].append(r["text"])
    assert by[1] == [None] and by[2] == [""] and by[9] == ["call [phone] now"] * 2 and by[5] == [ODD[7][1]]
    assert sanitise.report(documents(spark, [])).collect() == [] and sanitise.sanitised(documents(spark, [])).collect() == []
