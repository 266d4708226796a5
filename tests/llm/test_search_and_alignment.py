import hashlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SMALL
from oracle import connect, same

from loomdown.llm import lexical_search as L
from loomdown.llm import token_alignment as T

from .conftest import EDGES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# Ranked lexical search


def brute_search(docs, items, k):
    """Scores by plain loops over dictionaries."""
    import math
    import re

    def terms(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)

    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m, tf = 100 - 25 + (25 * len(bag) * n) // total, Counter(bag)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_search_against_sql(spark):
    same(L.op12_lexical_search(spark, SMALL), connect(SMALL), L.ORACLE_SQL)


@pytest.mark.parametrize("block_chars", [40, 1_000_000])
def test_search_edge_cases(spark, frame, block_chars):
    rows = [(r[0], r[1]) for r in EDGES] + [(20 + i, f"tie a b{i % 3} c{i % 5} " + "Ünï " * (i % 4)) for i in range(60)]
    items = [(1, "TIE a c1 c1 b2"), (2, None), (3, ""), (4, "ünï Ünï word"), (4, "no id"), (5, "x-y_z")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    for extra in (False, True):
        found = L.search(frame(rows, extra).repartition(5), queries, k=4, block_chars=block_chars, segment_postings=20, seed_segments=2)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == brute_search(rows, items, 4)
    assert L.search(frame([]), queries).count() == 0
    assert L.search(frame(rows), queries.where("false")).count() == 0


def test_windows_cut_no_term():
    text = ("aa bb " * 30 + "x" * 50 + " c").encode()
    data = np.frombuffer(text, np.uint8)
    offsets = np.array([0, len(text)])
    found = [text[a + s : a + e] for a, b in L.windows(data, offsets, 16) for s, e in zip(*L.term_spans(data[a:b], offsets[:0]), strict=True)]
    assert found == text.split()


def random_segment(rng, n_docs, n_terms):
    lists = [np.flatnonzero(rng.random(n_docs) < rng.choice([0.1, 0.3, 0.8])) for _ in range(n_terms)]
    impacts = [rng.integers(1, 1000, len(x)) for x in lists]
    pairs = {(t, t + 1): t for t in range(n_terms - 1)}
    met = [(k, *L.joint(np.concatenate([lists[a], lists[b]]), np.concatenate([impacts[a], impacts[b]]), slice(0, len(lists[a])), slice(len(lists[a]), None))) for (a, b), k in pairs.items() if len(lists[a]) and len(lists[b])]
    met = [x for x in met if len(x[1])]
    held = [t for t in range(n_terms) if len(lists[t])]
    row = {
        "ids": list(range(n_docs)), "terms": np.array(held), "lengths": np.array([len(lists[t]) for t in held]), "docs": np.concatenate([lists[t] for t in held]), "impacts": np.concatenate([impacts[t] for t in held]),
        "pairs": np.array([x[0] for x in met]), "pair_lengths": np.array([len(x[1]) for x in met]), "joint_maxima": np.array([(x[2] + x[3]).max() for x in met]),
        "pair_docs": np.concatenate([x[1] for x in met]), "first_impacts": np.concatenate([x[2] for x in met]), "second_impacts": np.concatenate([x[3] for x in met]),
    }
    full = np.zeros((n_terms, n_docs), np.int64)
    for t in held:
        full[t, lists[t]] = impacts[t]
    return L.Segment(row), full, pairs


def test_pair_bounds_lose_nothing_and_skip_more():
    rng = np.random.default_rng(3)
    work = {True: Counter(), False: Counter()}
    for _ in range(150):
        n_terms = int(rng.integers(3, 9))
        seg, full, pairs = random_segment(rng, 400, n_terms)
        query = L.Query(0, list(range(n_terms)), rng.integers(1, 3, n_terms).tolist())
        scores = (full * np.array(query.times)[:, None]).sum(axis=0)
        needed = max(1, int(np.sort(scores)[-10]))
        want = {(int(d), int(scores[d])) for d in np.flatnonzero(scores >= needed)}
        for use in (True, False):
            docs, got = L.best_of_segment(seg, query, pairs, 10, needed, use, work[use])
            assert set(zip(docs.tolist(), got.tolist(), strict=True)) == want
    assert work[True]["scanned"] < 0.97 * work[False]["scanned"]


def test_prefix_bounds_are_the_least_pairing():
    bound, paired = L.prefix_bounds([5, 4, 6, 3], [None, 7, None, 6])
    assert bound == [0, 5, 7, 13, 13] and paired == [False, False, True, False, True]


# Cross-tokenizer alignment


@pytest.fixture(scope="module")
def pair():
    return T.Pair(A, B)


def brute_alignment(pair, rows):
    """Each text encoded whole, its ends compared in sets, pairs by plain loops."""
    made = []
    for _, text in rows:
        found = pair.whole(text) if text else None
        if not found:
            made.append(None)
            continue
        ends = [np.cumsum([len(size[i]) for i in ids]).tolist() for ids, size in zip(found, (pair.a_bytes, pair.b_bytes), strict=True)]
        shared, groups, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for e in shared:
            upto = [ends[k].index(e) + 1 for k in (0, 1)]
            groups.append(tuple(found[k][at[k] : upto[k]] for k in (0, 1)))
            at = upto
        made.append((len(found[0]), len(found[1]), groups))
    df = Counter(p for m in made if m for p in {q for a, b in m[2] for q in product(a, b)})
    most = {}
    for (a, _), n in df.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (i, _), m in zip(rows, made, strict=True):
        if not m:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [q for a, b in m[2] for q in product(a, b)]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in m[2])
        out.append((i, m[0], m[1], len(m[2]), len(links), sum(df[q] == most[q[0]] for q in links), sum(df[q] for q in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = ["a  b\tc\n d é x<s></s> <|endoftext|>", " lead", "trail ", "\n\n x", "nbsp\xa0here \xa0 there", "wide　space  x", "can't we'll I'd", "▁ piece", "ﬁ² ½ x\x00y", "日本語 テキスト mixed 中", "🧠🧠 🧠", "a —b c", "é é ñ", "\x1c \x1f a", "1234567 890", "...!? ,a", " ", "  ", "á b́", "x" * 3000, "word " * 5000, "\r\n", "tab\there"]


def test_alignment_against_brute_force(spark, frame, pair):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, T.op13_token_alignment(spark, SMALL).collect()), key=repr) == brute_alignment(pair, rows)


@pytest.mark.parametrize("sent", [0, 10_000_000])
def test_alignment_edge_cases(spark, frame, pair, sent):
    rows = [(r[0], r[1]) for r in EDGES] + list(enumerate(ODD, 100)) + [(200, ODD[0])]
    for extra in (False, True):
        found = T.alignment(frame(rows, extra), A, B, sent_pairs=sent, memory=2000)
        assert sorted(map(tuple, found.collect()), key=repr) == brute_alignment(pair, rows)
    assert T.alignment(frame([]), A, B, sent_pairs=sent).count() == 0


def test_random_texts_by_units(pair):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    alphabet = list("ab  \t\n'’é ñ—x1.,<\xa0 ▁🧠\x85\x1c") + ["<|endoftext|>", "</s>", " the", "ing ", "'ll", "ß ", " 中"]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(1500)]
    memory = T.Memory(pair, 100_000)
    got = T.aligned(memory, pa.array(texts), window=200)
    want = brute_alignment(pair, list(enumerate(texts)))
    assert sorted(((i, *g[:4], g[4]) for i, g in enumerate(got)), key=repr) == sorted(((*w[:5], w[7]) for w in want), key=repr)


def test_galloping_finds_what_halving_finds():
    rng = np.random.default_rng(7)
    for _ in range(300):
        x = np.unique(rng.integers(0, 500, rng.integers(1, 200)))
        wanted = rng.integers(-5, 510, 50)
        start = rng.integers(-3, len(x) + 3, 50)
        assert (T.gallop(x, wanted, start) == np.searchsorted(x, wanted)).all()
