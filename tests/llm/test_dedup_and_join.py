import hashlib
import random

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, same

from loomdown.llm import jaccard_join as J
from loomdown.llm import line_dedup as L
from loomdown.llm import queries
from loomdown.llm.graph import components

from .conftest import EDGES, LONG


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    same(queries.queries()[name](spark, SMALL), duck, queries.oracle_sql()[name])


# Lines


def brute_lines(rows, least=10):
    keys = {}
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                keys.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or len(keys[key(x)]) < 2 or min(keys[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_share", [2e-5, 0.9])
def test_lines_against_brute_force(frame, monkeypatch, hot_share):
    rng = random.Random(3)
    pool = [f"  Line number {i} IS long enough " for i in range(30)] + ["short", "", "ÄÖÜ äöü ß line of text"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(300)] + [(r[0], r[1]) for r in EDGES]
    rows += [(i, "a line that every document holds\nown line of number %d" % i) for i in range(1000, 2600)]
    out = L.dedup_lines(frame(rows, extra=True), hot_share=hot_share)
    assert sorted(map(tuple, out.collect()), key=repr) == brute_lines(rows)


def test_hot_lines_take_the_same_way(frame):
    rows = [(i, f"the same first line for all\nline {i % 7} of seven kinds\nunique {i:09d}") for i in range(1500)]
    out = {r.doc_id: r for r in L.dedup_lines(frame(rows)).collect()}
    assert sum(r.n_dropped for r in out.values()) == 1499 + 1493
    assert out[0].n_dropped == 0


def test_lines_of_an_empty_table(frame):
    assert L.dedup_lines(frame([])).collect() == []


def test_digest(spark, frame, tmp_path):
    frame([(1, "a\nb"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept_sha256 for r in L.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"a\nb").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    f = L.PerfectHash.from_bytes(L.PerfectHash.build(keys).to_bytes())
    assert sorted(f.slots(keys)) == list(range(len(keys)))


# Jaccard join


def brute_components(rows, width, percent):
    sets = {i: set(map(int, J.shingle_set(t, width))) for i, t in rows}
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    for i, w in words.items():  # the sets are those of the texts themselves
        n = min(width, len(w))
        assert len({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else ()) == len(sets[i])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_against_brute_force(frame, width, percent):
    rng = random.Random(width)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 8, 11, 12, 25, 60, 130, 300]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    rows += [(1000 + i, t) for i, (_, t, *_) in enumerate(EDGES[:-1])] + [(1004, LONG)]
    rows = [*dict(rows).items()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(frame(rows, extra=True), width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_chains_of_near_copies(frame):
    """Links whose ends are far apart, in one component only by the links between."""
    words = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(words)))
        words[4 * i % 100] = f"x{i}"
    got = {r.doc_id: r.component_id for r in J.jaccard_components(frame(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 90).items()}


def test_repeated_rows_and_null_ids(frame):
    got = J.jaccard_components(frame([(6, "tie a b c"), (6, "tie a b c"), (5, "TIE a b\tc"), (None, "tie a b c"), (8, None)])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(6, 2, 5), (6, 2, 5), (5, 2, 5), (None, 2, None), (8, 0, 8)], key=repr)


def test_join_of_an_empty_table(frame):
    assert J.jaccard_components(frame([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.integers(0, 40), st.integers(0, 2**32))
def test_linking_sets_share_a_signature(n, cut, seed):
    rng = np.random.default_rng(seed)
    scheme = J.Scheme(90, {300: 10**9, 10: 10**9}, 500)
    a = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64))
    b = np.unique(np.concatenate([a[min(cut, len(a) - 1) :], rng.integers(0, 2**64 - 1, cut // 2, np.uint64)]))
    if J.linked(a, b, 90):
        assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))
        bits = np.unpackbits((J.sketch(a) ^ J.sketch(b)).view(np.uint8)).sum()
        assert 19 * bits <= len(a) + len(b)


def test_components_of_a_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 430)] + [(500, i) for i in range(501, 700)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
