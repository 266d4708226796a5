import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SMALL

from loomdown.llm import personal_data as D

from .conftest import EDGES

STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    """The contract's patterns as they stand, with plain checks."""
    out = []
    for kind, pattern in STRICT.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()] if kind in ("card", "phone") else []
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], D.KINDS.index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_strict_spans_against_plain_patterns():
    rng = random.Random(11)
    parts = list("0159. -()+@a_é\n") + ["4465758382889437", "255", "256", "1.2.3.4", "x@y.z", "@", "a.b", "+1 (263) 555-5869", "0000", ".com"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert D.strict_spans(text)[0] == brute_base(text)


def test_long_runs_take_little_time():
    import time

    began = time.process_time()
    for unit in ("1", "a", "a.", "1.", "1 ", "@", "+1", "a@", "(at)", "1-", "+1 ", "12.34.", "4465758382889437 ", "(12)", "a(at)b"):
        D.spans_of(unit * (300_000 // len(unit)))
    assert time.process_time() - began < 60


def test_query_over_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = D.op11_personal_data(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in D.KINDS]
        assert r.base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(filter(None, r.spans.split(",")))


PLANTED = [
    ("card", "4465758382889437 4465758382889437", ["4465758382889437", "4465758382889437"]),
    ("phone", "+1 (263) 555-5869 190.137.223.14", ["+1 (263) 555-5869"]),
    ("phone", "call +1 (263) 555-5869 4465758382889437 now", ["+1 (263) 555-5869"]),
    ("card", "call +1 (263) 555-5869 4465758382889437 now", ["4465758382889437"]),
]


def test_what_the_patterns_miss_is_added_and_clean_texts_stay(spark, frame):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    filler = lambda n: " ".join(word() for _ in range(n))
    number = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    def card():
        stem = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(stem + c for c in "0123456789" if D.luhn(stem + c))

    rows = [(i, f"{filler(8)} {(number, card, lambda: f'{word()}.{i}@mail.example.com', lambda: f'10.{i % 250}.3.4')[i % 4]()} {filler(8)}") for i in range(400)]
    rows += [(1000 + i, f"{filler(6)} {t} {filler(5)}") for i, (_, t, _) in enumerate(PLANTED)]
    clean = ["a 1234567890123456 b", "version 3.4.5", "in 1999 and 2004, 12 of 300", "sha 0641917ea4e9feb9cda83477b57ac2654884f485", "2024-01-02 10:20", "1 2 3 4 5 6 7 8 9 10 11 12", "page 12.5.1.300", "at dot com", "100 200 3000"]
    rows += [(2000 + i, f"{filler(4)} {t} {filler(4)}") for i, t in enumerate(clean)]
    texts = dict(rows)
    found = {r.doc_id: r for r in D.personal_data(frame(rows)).collect()}
    for i, (kind, _, want) in enumerate(PLANTED):
        assert [texts[1000 + i][s["start"] : s["end"]] for s in found[1000 + i].added if s["kind"] == kind] == want
    assert not [s for i in range(len(clean)) for s in (*found[2000 + i].base, *found[2000 + i].added)]


@pytest.mark.parametrize("extra", [False, True])
def test_edge_cases(spark, frame, extra):
    rows = [(r[0], r[1]) for r in EDGES] + [(30, "🧠é a@b.c 1.2.3.4"), (31, "x" * 50_000 + " a@b.cd"), (30, "a@b.c")]
    got = sorted(((r.doc_id, digest([tuple(s) for s in r.base])) for r in D.personal_data(frame(rows, extra)).collect()), key=repr)
    assert got == sorted(((i, digest(brute_base(t))) for i, t in rows), key=repr)
    assert D.personal_data(frame([])).count() == 0


def test_expectation_maximisation_against_plain_loops():
    patterns = {"++?": 40.0, "+--": 7.0, "---": 25.0, "?+-": 5.0, "-?+": 3.0}
    share, chance, post = D.reliabilities(patterns, rounds=7)
    p = {k: (k.count("+") + 1) / (k.count("+") + 2 * k.count("-") + 2) for k in patterns}
    for _ in range(7):
        table = [[[1.0 + (v == "-+"[c]) for v in "-?+"] for c in (0, 1)] for _ in range(3)]
        for k, n in patterns.items():
            for i, v in enumerate(k):
                for c in (0, 1):
                    table[i][c]["-?+".index(v)] += n * (p[k] if c else 1 - p[k])
        table = [[[x / sum(row) for x in row] for row in labeler] for labeler in table]
        prior = (sum(n * p[k] for k, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        for k in patterns:
            odds = [prior if c else 1 - prior for c in (0, 1)]
            for i, v in enumerate(k):
                odds = [o * table[i][c]["-?+".index(v)] for c, o in enumerate(odds)]
            p[k] = odds[1] / sum(odds)
    assert np.allclose([post[k] for k in patterns], [p[k] for k in patterns])
    assert np.isclose(share, prior) and np.allclose(chance, table)
    assert post["++?"] > 0.9 > 0.1 > post["---"]
