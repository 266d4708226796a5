import lzma
import re
import time
import zlib
from functools import cache
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdown.llm import codec, decontaminate, html_extract, quality, token_counts, token_files, tokens

from .conftest import EDGES

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


# Token ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abÉ \n\t\x0b́'\".!1<|>endoftxİßΣ中\x85​", max_size=40)), max_size=6))
def test_words_encode_as_texts_do(texts):
    ids, sizes = tokens.encoder(WORDS).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in texts] if texts else not len(ids)


MARKED = ["T̈,", "ẗ", "ẘ. ẘ", "J̌!", "İ", "İ,", "A̸=", "≠", "don't,", "it'S.", "'s,t", "a'", "x.'s", "a1,b2.", "<|endoftext|>,", "<|ENDOFTEXT|>", "A<|endoftext|>b!", "<|", "|>", "ÀÉ...", "ß;", "×÷,", "Straße,\n", "K,", "ﬁ.", "a\x85,b", "a\u00a0B,", "µ,", "ª."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*MARKED, "And,", "and", "and.", "AND...", "$$$"]), max_size=5), max_size=5), st.sampled_from([" ", "", "\n", "́"]))
def test_letters_and_signs_are_taken_apart_as_the_tokenizer_does(words, between):
    texts = [between.join(w) for w in words]
    ids, sizes = tokens.WordEncoder(WORDS).encode(texts) if len(texts) == 5 else tokens.encoder(WORDS).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in texts] if texts else not len(ids)


def test_letters_are_encoded_once_whatever_signs_and_case():
    encoder = tokens.WordEncoder(WORDS)
    encoder.encode(["table, Table. tABLE... table;"])
    asked = []
    encoder.word_ids = lambda words, together=200: asked.extend(words) or tokens.WordEncoder.word_ids(encoder, words, together)
    encoder.plain_ids = lambda words, together=200: asked.extend(words) or tokens.WordEncoder.plain_ids(encoder, words, together)
    encoder.encode(["Table; TABLE, table"])
    assert asked == []


def test_tokenizers_that_keep_blanks_are_refused():
    with pytest.raises(ValueError, match="white space"):
        tokens.WordEncoder(P.path("byte_bpe_50k.json"))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9000), st.integers(1, 300)), min_size=1, max_size=5), st.integers(0, 2**32))
def test_codec_round_trip(shapes, seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, spread, n) ** 2 // spread for n, spread in shapes]
    codes = codec.encode(blocks, 300)
    decoded = codec.decode([c for _, c in codes], list(map(len, blocks)), [a for a, _ in codes])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decoded, strict=True))
    for block, (alphabet, code) in zip(blocks, codes, strict=True):  # blocks are coded independently
        alone = codec.encode([block], 300)[0]
        assert np.array_equal(alone[0], alphabet) and alone[1] == code


def test_codec_learns_and_checks():
    bits = lambda block: 8 * sum(map(len, codec.encode([block], 49408)[0][1])) / len(block)
    assert bits(np.tile(np.arange(50), 60)) < 2
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4000, rng.integers(1, 5)) for _ in range(2000)]
    text = np.concatenate([words[min(1999, int(k))] for k in rng.pareto(0.7, 30_000) * 3])
    counts = np.bincount(text)[np.bincount(text) > 0]
    order0 = -(counts * np.log2(counts / len(text))).sum() / len(text)
    packed = np.mean([8 * len(lzma.compress(part.astype("<u2").tobytes(), preset=9)) / len(part) for part in np.array_split(text, 8)])
    assert bits(text) < 0.8 * order0 and bits(text) < 0.9 * packed
    with pytest.raises(ValueError, match="vocabulary"):
        codec.encode([np.array([9])], 9)


def test_frequent_pairs_are_coded_as_one_symbol():
    block = np.tile(np.arange(8), 3000)
    ((table, code),) = codec.encode([block], 99)
    assert codec.opened(table)[0] <= len(block) / 2 + 1  # symbols that the range coder takes
    assert np.array_equal(codec.decode([code], [len(block)], [table])[0], block)


def test_codec_of_few_and_of_many_different_ids():
    blocks = [np.array([], int), np.array([7]), np.arange(49408), np.repeat(5, 30_000), np.arange(60_000) % 17_000]
    codes = codec.encode(blocks, 49408)
    decoded = codec.decode([c for _, c in codes], list(map(len, blocks)), [a for a, _ in codes])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decoded, strict=True))


def test_carries_run_through_words():
    rng = np.random.default_rng(2)
    # Intervals at the very top of the range make long runs of full words that a late carry must pass.
    size = rng.choice([1, 2, 65535], 4000)
    start = np.where(rng.random(4000) < 0.9, 65536 - size, 0)
    (code,) = codec.encode_ranges(np.zeros(4000, np.int64), start, size, 1)
    words = [*np.frombuffer(code, "<u2").tolist(), 0, 0, 0]
    value, span, at = int.from_bytes(b"".join(w.to_bytes(2, "big") for w in words[:3]), "big"), (1 << 48) - 1, 3
    for a, n in zip(start.tolist(), size.tolist(), strict=True):
        unit = span >> 16
        assert a <= min(value // unit, 65535) < a + n
        value, span = value - unit * a, unit * n
        if span < 1 << 32:
            value, span, at = value << 16 | (words[at] if at < len(words) else 0), span << 16, at + 1


def test_damaged_records_are_found():
    data = bytearray(token_files.records([np.array([5, 6, 1])], [np.array([(1, 0, 1, 3)], token_files.DOC)], 99)[0] + b"\n")
    assert [x.tolist() for _, x in token_files.parse(bytes(data))] == [[5, 6, 1]]
    data[-2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.parse(bytes(data)))


def expected(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*ids_of(t), 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


EDGE_ROWS = [(r[0], r[1]) for r in EDGES]


def test_token_files_of_edge_cases(frame):
    got = token_files.token_table(frame(EDGE_ROWS, extra=True), WORDS, block_ids=64, least_chars=1000)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(EDGE_ROWS)
    assert token_files.token_table(frame([]), WORDS).count() == 0


def test_token_files_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, token_files.op5_token_files(spark, SMALL).collect()), key=repr) == expected(rows)


def test_token_counts(spark, frame):
    got = token_counts.op4_token_counts(spark, SMALL).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(x[0], x[2]) for x in sorted(expected(rows))]
    assert [r.start for r in sorted(got, key=lambda r: r.start)][1:] == list(np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)]))[:-1]
    small = token_counts.count_tokens(frame(EDGE_ROWS, extra=True), WORDS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in small) == sorted((x[0] or 0, x[2]) for x in expected(EDGE_ROWS))
    assert sum(r.n_tokens for r in small) == max(r.start + r.n_tokens for r in small)
    assert token_counts.count_tokens(frame([]), WORDS).count() == 0


@pytest.mark.parametrize("block_ids", [1, 2, 3, 64])
def test_boundaries_across_blocks_and_files(spark, tmp_path, block_ids):
    ids = [7, 0, 0, 8, 9, 9, 9, 0, 5, 0, 4, 4]
    for k, part in enumerate((ids[:2], [], ids[2:5], ids[5:6], ids[6:])):
        (tmp_path / f"part-{k}").write_bytes(np.array(part, "<u4").tobytes())
    got = sorted((r.doc_no, r.start, r.n_tokens, r.closed) for r in token_counts.scan_token_files(spark, str(tmp_path), 0, block_ids).collect())
    assert got == [(0, 0, 2, True), (1, 2, 1, True), (2, 3, 5, True), (3, 8, 2, True), (4, 10, 2, False)]


def test_files_go_by_their_numbers(spark, tmp_path):
    names = ["part-00002-x-c000.txt", "part-00010-x-c0999.txt", "part-00010-x-c1000.txt", "part-100000-x-c000.txt"]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(np.array([k + 1] * (k + 1) + [0], "<u4").tobytes())
    got = sorted((r.doc_no, r.n_tokens, r.path[-8:]) for r in token_counts.scan_token_files(spark, str(tmp_path)).collect())
    assert got == [(k, k + 2, name[-8:]) for k, name in enumerate(names)]


# Decontamination

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil purple soup under a pale moon tonight in march"


def test_tiling_finds_moved_and_changed_passages(spark, frame):
    w = ITEM.split()
    filler = " ".join(f"filler{i}" for i in range(400))
    rows = [
        (1, f"{filler} {ITEM} {filler}"),
        (2, " ".join(w[12:] + ["and"] + w[:12])),
        (3, " ".join(w[:6] + ["x"] + w[7:15] + ["y"] + w[16:]).upper() + "!"),
        (4, " ".join(w[:9]) + filler),
        (5, " ".join(sorted(w))),
        (6, "Short item, here."),
        *((10 + i, r[1]) for i, r in enumerate(EDGES)),
        (None, ITEM),
    ]
    benchmark = spark.createDataFrame([(1, ITEM, "x"), (2, "short ITEM here", "x"), (3, None, "x"), (4, "", "x"), (5, "...", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(rows, extra=True), benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (6, 2), (None, 1)}
    assert got[1, 1].coverage == 1
    assert (got[2, 1].n_tiles, got[2, 1].coverage) == (2, 1)
    assert decontaminate.contaminated(frame([]), benchmark).count() == 0
    assert decontaminate.contaminated(frame(rows), benchmark.limit(0)).count() == 0


def test_benchmark_in_blocks(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole, parts = (sorted(map(tuple, decontaminate.contaminated(docs, items, block_chars=n).collect())) for n in (10**7, 3000))
    assert whole == parts
    assert whole


def test_tiles_do_not_overlap():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, 30).astype(np.uint64), rng.integers(0, 4, 60).astype(np.uint64)
        fa, fb = decontaminate.fingerprints(a, 3), decontaminate.fingerprints(b, 3)
        i, j = np.nonzero(fa[:, None] == fb[None, :])
        if len(i):
            found = decontaminate.tiles(i, j, 3, 30, 60)
            ours, theirs = [p for x, _, n in found for p in range(x, x + n)], [p for _, y, n in found for p in range(y, y + n)]
            assert len(set(ours)) == len(ours) == len(set(theirs))
            assert all((a[x : x + n] == b[y : y + n]).all() and n >= 3 for x, y, n in found)


def naive_tiles(a, b, width):
    """Greedy string tiling as it is defined: all pairs of places for each tile."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (width - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < width:
            return out
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append((i, j, n))


def test_tilings_against_brute_force():
    rng = np.random.default_rng(11)
    for words, n, m, width in ((2, 14, 30, 2), (3, 20, 40, 3), (5, 25, 40, 2), (1, 9, 40, 5), (40, 30, 60, 1)):
        for _ in range(12):
            a, b = (decontaminate.word_hashes(" ".join(f"w{k}" for k in rng.integers(0, words, size))) for size in (n, m))
            i, j = np.nonzero(decontaminate.fingerprints(a, width)[:, None] == decontaminate.fingerprints(b, width)[None, :])
            naive = naive_tiles(a.tolist(), b.tolist(), width)
            assert decontaminate.tiles(i, j, width, len(a), len(b)) == naive if len(i) else naive == []
            assert decontaminate.tiles_by_length(a, b, width) == naive


def test_contamination_against_brute_force(spark, frame):
    rng = np.random.default_rng(12)
    text = lambda n, kinds: " ".join(f"w{k}" for k in rng.integers(0, kinds, n))
    items = [(k, text(int(rng.integers(2, 30)), 12)) for k in range(12)]
    docs = [(i, text(40, 12) + " " + (items[i % 12][1] if i % 3 else "")) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(frame(docs), bench, min_match=4).collect()}
    want = {}
    for i, t in docs:
        for k, item in items:
            a, b = item.split(), t.split()
            share = sum(n for _, _, n in naive_tiles(a, b, min(4, len(a)))) / len(a)
            if share >= 0.6:
                want[i, k] = share
    assert got == pytest.approx(want)


def test_one_word_over_and_over():
    seeds = decontaminate.Seeds([(1, "na " * 1000), (2, "na na hey " * 300)], 5)
    began = time.process_time()
    found = dict((i, (share, count)) for i, share, count, _ in decontaminate.best_tilings(seeds, "na " * 60_000, 0.6))
    assert found == {1: (1.0, 1)}
    assert next(decontaminate.best_tilings(seeds, "na na hey " * 20_000, 0.6))[:3] == (2, 1.0, 1)
    assert time.process_time() - began < 20


# Pages

PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
    "<div><div class=teaser>Read our guide</div><article><h1>Title {0} &amp; more</h1><p>First  para\n<b>bold {0}<p>Second<br>line {0}<script>x</script></p><form><input>Subscribe</form></article></div>"
    "<section id=comments><p>I disagree {0}</p></section><aside>Also</aside><footer>&copy; {0}</footer>"
)


def test_main_text(spark):
    pages = [(i, f"https://h.example/{i}", PAGE.replace("{0}", str(i))) for i in range(8)]
    pages += [(50, None, None), (51, "https://h.example/x", ""), (52, "nohost", "<p>a<p>b"), (52, "nohost", "<p>a<p>b"), (53, "https://other.example/", "<div>" * 500 + "deep"), (54, "https://h.example/", "<article><p>x</article></b></div>" + "y" * 10)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert all(got[i] == f"Title {i} & more\n\nFirst para bold {i}\n\nSecond line {i}" for i in range(8))
    assert (got[50], got[51], got[52], got[53], got[54]) == ("", "", "a\n\nb", "deep", "x")
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_constant_nodes_are_template(spark):
    page = "<body><div><p>Every page of this site says so</p><p>Own text number {0} which goes on for a while</p><p>More own text {0}</p></div>"
    df = spark.createDataFrame([(i, f"http://h/{i}", page.replace("{0}", str(i))) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract_pages(df).where("page_id = 3").collect()} == {"Own text number 3 which goes on for a while\n\nMore own text 3"}


def texts_of(spark, *pages):
    df = spark.createDataFrame([(i, f"http://host{i}/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text.split("\n\n") for r in html_extract.extract_pages(df).orderBy("page_id").collect()]


def test_no_part_of_an_article_is_cut(spark):
    long = "Long text of the body, which goes on. " * 20
    page = f"<body><nav>Menu</nav><div id=content><h1>Title</h1><p>Lead</p><div class=body><p>{long}</p><p>End</p></div><p><a href=/>  More   here </a> ok</p></div><div><a href=/>Link</a></div><footer>f</footer>"
    parts = f"<body><article><h1>One</h1></article><div><article><p>{long}</p><article>inner</article></article></div><aside><article>ad</article></aside><article>Three</article>"
    main = f"<body><div>x</div><main><h1>Title</h1><article>{long}</article></main>"
    assert texts_of(spark, page)[0] == ["Title", "Lead", long.strip(), "End", "More here ok"]
    assert texts_of(spark, parts)[0] == ["One", long.strip(), "inner", "Three"]
    assert texts_of(spark, main)[0] == ["Title", long.strip()]


def plain_page(i):
    """No element or name says what is what: a fixed notice, a menu whose links vary, then text of varying length, then a fixed end."""
    links = "".join(f"<p><a href=/{k}>Link {i} {k}</a></p>" for k in range(3 + i % 4))
    text = "".join(f"<p>Page {i} says its own sentence number {k}.</p>" for k in range(2 + i % 5))
    return f"<body><div><div>Welcome to this site</div><div>{links}</div><div><h2>Head {i}</h2>{text}</div><div><p>Call us</p><p>Write to us</p></div></div>"


def test_slots_without_names(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", plain_page(i)) for i in range(20)], "page_id long, url string, html string")
    for r in html_extract.extract_pages(df).collect():
        i = r.page_id
        assert r.text.split("\n\n") == [f"Head {i}", *(f"Page {i} says its own sentence number {k}." for k in range(2 + i % 5))]


def test_one_article_under_changing_menus_stays(spark):
    page = "<body><div><a href=/{0}>menu {0}</a></div><div><h2>The same article</h2><p>with the same long text on each of these pages</p></div>"
    df = spark.createDataFrame([(i, f"http://h/{i}", page.replace("{0}", str(i))) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract_pages(df).collect()} == {"The same article\n\nwith the same long text on each of these pages"}


def brute_pages(rows, per_host=6, least=3):
    """The same wrappers by plain loops over all pages and slots."""
    host = lambda u: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", u or "") or ["", ""])[1].lower()
    key = lambda p: xxhash.xxh3_64_intdigest(p.encode()) >> 1
    pages = {}
    for _, u, p in rows:
        if p:
            pages.setdefault(host(u), set()).add(p)
    firsts = {h: sorted(ps, key=key)[:per_host] for h, ps in pages.items()}
    big = {h: ps for h, ps in firsts.items() if h and len(ps) >= least}
    rest = sorted((p for h, ps in firsts.items() if h not in big for p in ps), key=key)[:per_host]
    templates = {h: html_extract.Template.of(*html_extract.template_row(ps)) for h, ps in {**big, "": rest}.items()}
    read = [(i, host(u) if host(u) in big else "", html_extract.read_page(p or "", templates[host(u) if host(u) in big else ""])) for i, u, p in rows]
    seen = {}
    for _, w, (slots, hashes, chars, links, bits, *_, identity) in read:
        for slot, h, c, a, b in zip(slots, hashes, chars, links, bits, strict=True):
            if b & html_extract.WITHIN_MAIN and not b & (html_extract.NAMED | html_extract.MAIN):
                continue
            one = seen.setdefault((w, slot), {}).setdefault(identity, [0, 0, 0, 0])
            one[:] = max(one[0], h), max(one[1], c), max(one[2], a), one[3] | b
    noise, menus, mains = {}, {}, {}
    for (w, slot), by_page in seen.items():
        values = list(by_page.values())
        top = max(sum(v[0] == h for v in values) for h in {v[0] for v in values})
        chars, links = sum(v[1] for v in values), sum(v[2] for v in values)
        often = lambda bit: 2 * sum(v[3] & bit > 0 for v in values) >= len(values)  # noqa: E731, B023
        constant = top >= 3 and 2 * top >= len(values) and chars + links > 0 and slot != 0
        outside = not often(html_extract.WITHIN_MAIN)
        if often(html_extract.NAMED) or (outside and constant):
            noise.setdefault(w, set()).add(slot)
        elif outside and often(html_extract.HOLDER) and links > 0.6 * (chars + links):
            menus.setdefault(w, set()).add(slot)
        elif often(html_extract.MAIN):
            mains.setdefault(w, set()).add(slot)
    out = []
    for i, w, (slots, _, _, _, _, last, at, blocks, _) in read:
        in_any = lambda b, chosen: any(s in chosen.get(w, ()) and k <= b <= last[k] for k, s in enumerate(slots))  # noqa: E731, B023
        kept = [(b, t) for b, t in zip(at, blocks, strict=True) if not in_any(b, noise)]
        kept = [(b, t) for b, t in kept if not in_any(b, menus)] or kept
        main = [t for b, t in kept if in_any(b, mains)]
        out.append((i, "\n\n".join(main or [t for _, t in kept])))
    return sorted(out)


def test_wrappers_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        parts = [f"<div class='{c}'>{t}</div>" for c, t in (("top", "fixed"), ("ad", f"buy {rng.integers(9)}"), ("x", f"<a>l{i}</a>"), ("body", f"<p>own {i}</p><p>{'fixed end' if rng.random() < 0.6 else i}</p>"), ("note", f"n{rng.integers(3)}"))]
        chosen = [p for p in parts if rng.random() < 0.8] + [f"<article><p>art {i}</p><div class=share>s</div></article>"] * (rng.random() < 0.3)
        rng.shuffle(chosen)
        rows.append((i, ["http://a/x", "http://b/", "http://c", None, f"http://d{i}/"][rng.integers(5)], "<body>" + "".join(chosen)))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_extract.extract_pages(df).collect()) == brute_pages(rows)


HOSTS = {
    "promo": [f"<body><div class=story><h2>Head {i}</h2><p>Story number {i} goes on for some words.</p></div>" for i in range(5)] + ["<body><div class=promo><p>The only text of this page, which is long enough.</p></div>"],
    "compound": [f"<body><div class='content with-sidebar'><p>Text of page {i}, in a box beside others.</p></div>" for i in range(5)],
    "layout": [f"<body><div class='layout no-sidebar'><main><p>Main text of page {i} is here.</p></main></div>" for i in range(5)],
    "topic": [f"<body><div id='menu-engineering'><p>How menus are made, part {i}, with prose.</p></div>" for i in range(5)],
    "title": [f"<body><article><div class='entry-header'><h1>Title {i}</h1></div><p>Body {i}</p></article>" for i in range(5)],
    "links": [f"<body><div class=post><h2>Picks {i}</h2>{''.join(f'<p><a href=/{k}>A linked story title {i} {k}</a></p>' for k in range(5))}<p>Some words of {i} about these.</p></div>" for i in range(5)],
}


def test_articles_stay_whatever_their_boxes_are_called(spark):
    rows = [(f"{name} {i}", f"http://{name}.example/{i}", page) for name, pages in HOSTS.items() for i, page in enumerate(pages)]
    df = spark.createDataFrame([(k, u, p) for k, (_, u, p) in enumerate(rows)], "page_id long, url string, html string")
    got = {rows[r.page_id][0]: r.text.split("\n\n") for r in html_extract.extract_pages(df).collect()}
    for i in range(5):
        assert got[f"promo {i}"] == [f"Head {i}", f"Story number {i} goes on for some words."]
        assert got[f"compound {i}"] == [f"Text of page {i}, in a box beside others."]
        assert got[f"layout {i}"] == [f"Main text of page {i} is here."]
        assert got[f"topic {i}"] == [f"How menus are made, part {i}, with prose."]
        assert got[f"title {i}"] == [f"Title {i}", f"Body {i}"]
        assert got[f"links {i}"] == [f"Picks {i}", *(f"A linked story title {i} {k}" for k in range(5)), f"Some words of {i} about these."]
    assert got["promo 5"] == ["The only text of this page, which is long enough."]


class Part:
    def __init__(self, kind, text, kids=()):
        self.kind, self.name, self.text_hash, self.kids = kind, kind.split(" ")[0], text, list(kids)
        self.under = {k.kind for k in self.kids}


def worth(a, b):
    return 0 if a.name != b.name else 2 + 4 * (a.kind == b.kind) + 3 * (a.text_hash == b.text_hash) + min(3, sum(k.kind in a.under for k in b.kids))


def test_alignment_is_the_best_at_every_size():
    rng = np.random.default_rng(9)
    kids = [[Part(str(c), 0) for c in rng.choice(["a", "b", "c"], rng.integers(5))] for _ in range(5)]  # equal texts have equal children
    some = lambda n: [Part(f"{rng.choice(['li', 'p'])} {rng.choice(['x', 'y', 'z'])}", t, kids[t]) for t in rng.integers(0, 5, n).tolist()]
    for m, n in [(rng.integers(1, 7), rng.integers(1, 7)) for _ in range(300)] + [(50, 50), (51, 50), (70, 3), (120, 90)]:
        a, b = some(m), some(n)

        @cache
        def best(i, j):
            return 0 if i == len(a) or j == len(b) else max(best(i + 1, j), best(i, j + 1), worth(a[i], b[j]) + best(i + 1, j + 1))  # noqa: B023

        for cells in (4_000_000, 200):
            pairs = html_extract.matched(a, b, cells)
            assert all(x < y and u < v for (x, u), (y, v) in pairwise(pairs)) and all(a[i].name == b[j].name for i, j in pairs)
            assert sum(worth(a[i], b[j]) for i, j in pairs) == best(0, 0)


def test_fifty_and_more_items_are_aligned():
    for n in (50, 51, 3000):
        a, b = ([Part(f"li {c}", 0) for _ in range(n)] for c in "xy")
        assert html_extract.matched(a, b) == [(i, i) for i in range(n)]


def test_the_wrapper_decides(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    texts = {r.page_id: r.text for r in html_extract.op10_html_extraction(spark, SMALL).collect()}
    bare = html_extract.Template()
    for r in pages.limit(40).collect():
        slots, _, _, _, _, last, at, blocks, _ = html_extract.read_page(r.html, bare)
        assert len(html_extract.chosen_text(slots, last, at, blocks, set(), set())) > len(texts[r.page_id])


@pytest.mark.parametrize("page", ["<a " * 200_000, "<div>" * 60_000 + "x", "<div>" * 30_000 + "</p>" * 60_000, "<a \"'>" * 60_000, "<script>" * 60_000, "<ul>" + "<li>x" * 60_000, "<li><ul>" + "<div>" * 30_000 + "<li></li>" * 30_000, "<" * 300_000, "".join(f"<div class=c{i % 7}x>t{i}</div>" for i in range(20_000))])
def test_long_broken_pages_end(page):
    began = time.process_time()
    template = html_extract.Template.of(*html_extract.template_row([page]))
    slots, _, _, _, _, last, at, blocks, _ = html_extract.read_page(page, template)
    html_extract.chosen_text(slots, last, at, blocks, {0}, set())
    assert time.process_time() - began < 15


# Pipeline


def test_pipeline_against_its_parts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .test_dedup_and_join import brute_components

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.id for r in quality.judge(docs).where("kept").select(F.col("row")["doc_id"].alias("id")).collect()}
    groups = brute_components([(i, texts[i]) for i in good], 5, 80)
    first = {i for i, (_, c) in groups.items() if c == i}
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    clean = first - {r.doc_id for r in found.collect()}
    stage = docs
    seen = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SMALL)
        assert stage.columns == docs.columns
        seen.append(sorted(r.doc_id for r in stage.collect()))
    assert seen[0] == sorted(good)
    assert seen[1] == sorted(first)
    assert seen[2] == sorted(clean)
    assert set(seen[3]) <= clean
    assert all(seen[3].count(i) <= 3 for i in clean)
    out = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
    assert [r[0] for r in out] == seen[3]
    assert [x[2:] for x in out] == [x[2:] for x in sorted(expected([(i, texts[i]) for i in seen[3]]), key=lambda x: (x[0], x[1]))]


def test_pipeline_stages_take_edge_cases(spark, frame):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for rows in (EDGES, []):
        df = frame(rows, extra=True)
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, df, SMALL)
            assert out.count() <= 3 * len(rows)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == df.columns


def test_rows_without_an_id_are_judged_by_their_text(spark, frame):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 200").first().text
    own = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(None, own[0]), (7, own[0]), (3, own[0] + " more"), (None, own[1]), (None, own[1]), (None, item), (5, own[2]), (5, own[2]), (5, own[1] + " end")]
    df = frame(rows, extra=True)
    kept = sorted((r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, df, SMALL).where("doc_id is not null").collect())
    assert kept == [(3, own[0] + " more"), (5, own[1] + " end"), (5, own[2])]
    assert [r.text for r in stages["n-gram Jaccard join"](spark, df, SMALL).where("doc_id is null").collect()] == [item]
    clean = stages["benchmark decontamination"](spark, df, SMALL).collect()
    assert len(clean) == len(rows) - 1 and all(r.text != item for r in clean)
