import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomdown.llm import language_id, lm_score, mixing, quality

from .conftest import EDGES, LONG

EN = "the of and to in is that for it with as was on be at by this are from or an have not which"
DE = "der die und das ist ein nicht zu den mit sich auf für von dem eine auch als an es im wird noch über"


def sentences(words, n, seed=0):
    rng = random.Random(f"{words} {seed}")
    return [" ".join(rng.choice(words.split()) for _ in range(30)) + "." for _ in range(n)]


# Quality rules


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules_against_brute_force(frame):
    texts = [r[1] for r in EDGES] + sentences(EN, 40) + ["a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h", "x\nx\n \n\nx #*$ |", "a " * 9, "\n".join(sentences(EN, 3) * 2)]
    rows = [(i, t) for i, t in enumerate(texts)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality.judge(frame(rows, extra=True)).select(F.col("row")["doc_id"].alias("id"), *names).collect()
    assert {r.id: tuple(r[n] for n in names) for r in out} == {i: brute_quality(t) for i, t in rows}


def test_junk_goes_and_prose_stays(frame):
    prose = [(i, " ".join(sentences(EN, 8, i)), "en") for i in range(60)] + [(100 + i, " ".join(sentences(DE, 8, i)), "de") for i in range(60)]
    junk = [(200, " ".join(w + "###" for w in " ".join(sentences(EN, 8)).split()), "en"), (201, " ".join(sentences(EN, 8, 3)).upper(), "en"), (202, " ".join(f"q{i}x |" for i in range(300)), "en")]
    kept = {r.id: r.kept for r in quality.judge(frame(prose + junk)).select(F.col("row")["doc_id"].alias("id"), "kept").collect()}
    assert all(kept[i] for i in kept if i < 200)
    assert not any(kept[i] for i in (200, 201, 202))


def test_rules_keep_rows_as_they_are(frame):
    df = frame(EDGES, extra=True)
    out = quality.judge(df).select("row.*")
    assert out.columns == df.columns
    assert out.count() == len(EDGES)
    assert quality.judge(frame([])).count() == 0


def test_small_languages_are_judged_by_their_own_words(frame):
    rare = "sana talo vesi puu tie kala lintu metsä järvi kesä talvi aika maa kuu päivä"
    rows = [(i, " ".join(sentences(EN, 40, i)), "en") for i in range(450)]
    small = [(1000 + i, " ".join(sentences(DE, 8, i)), "de") for i in range(20)]  # 4800 words, under 1 % of all
    odd = [(2000, " ".join(sentences(rare, 8)), "fi"), (2001, " ".join(sentences(rare, 8)), None), (2002, " ".join(sentences("это слово здесь было тогда между нами всегда", 8)), "ru")]
    junk = [(3000, " ".join(f"q{i}x" for i in range(300)), "de"), (3001, " ".join(w + "###" for w in " ".join(sentences(EN, 8)).split()), None)]
    kept = {r.id: r.kept for r in quality.judge(frame(rows + small + odd + junk)).select(F.col("row")["doc_id"].alias("id"), "kept").collect()}
    assert {i for i in kept if not kept[i]} == {3000, 3001}


# Mixing


def brute_mix(rows, weights=(5, 2, 1), most=3):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in zip(rows, size) if r[3] == s) for s in sources}
    w = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        rest = sum(total.values()) - sum(most * total[s] for s in full)
        free = [s for s in sources if s not in full]
        target = {s: most * total[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in sources}
        above = {s for s in free if target[s] > most * total[s]}
        if not above:
            return size, total, target
        full |= above


def test_mix_against_brute_force(frame):
    rows = [(i, "w " * (i * 37 % 91), "en", [None, "a", "b", "c", "é", ""][i % 6 if i < 200 else 1]) for i in range(600)]
    rows += [(900, None, None, None), (901, LONG, "en", "big"), (902, "x", "en", "tiny"), (902, "x", "en", "tiny")]
    size, total, target = brute_mix(rows)
    out = mixing.plan_mix(frame(rows, extra=True), buckets=16).select(F.col("row")["doc_id"].alias("id"), F.col("row")["source"].alias("s"), "size", "source_size", "target", "times").collect()
    taken = Counter()
    for r in out:
        assert r.source_size == total[r.s]
        assert r.target == pytest.approx(target[r.s])
        assert 0 <= r.times <= 3
        taken[r.s] += r["size"] * r.times
    largest = {s: max((n for r, n in zip(rows, size) if r[3] == s), default=0) for s in total}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)
    assert sorted(r["size"] for r in out) == sorted(size)


def test_order_follows_the_curriculum(frame):
    rows = [(i, "w " * 20, "en", "abc"[i % 3]) for i in range(900)]
    df = frame(rows, extra=True)
    out = mixing.training_order(df, partitions=3)
    assert out.columns == df.columns
    order = [r.source for r in out.collect()]
    first, last = Counter(order[: len(order) // 3]), Counter(order[-len(order) // 3 :])
    assert first["a"] > last["a"]  # a falls over time, c rises
    assert first["c"] < last["c"]
    again = [r.doc_id for r in mixing.training_order(df.repartition(5), partitions=3).collect()]
    assert again == [r.doc_id for r in out.collect()]


def test_schedules_are_inverted(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("t"))
    for slope in (-0.5, 0.0, 0.5, 1.0):
        u = F.col("t") + slope * (F.col("t") - F.col("t") * F.col("t"))
        assert all(abs(r.t - r.p) < 1e-6 for r in df.select("t", mixing.position_of(u, F.lit(slope)).alias("p")).collect())


def test_mix_of_nothing(frame):
    assert mixing.training_order(frame([])).count() == 0
    assert [r.times for r in mixing.plan_mix(frame([(1, None), (2, "")])).collect()] == [0, 0]


# Language


def test_languages(frame):
    rows = [(i, t, "en") for i, t in enumerate(sentences(EN, 80))] + [(100 + i, t, "de") for i, t in enumerate(sentences(DE, 80))]
    df = frame(rows, extra=True)
    model = language_id.fit(df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    edges = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(frame([*EDGES, (8, "12 34 !")]), model).collect()]
    assert {(i, lang) for i, lang, s in edges if s == 0} >= {(1, "und"), (2, "und"), (3, "und"), (8, "und")}
    assert len(edges) == len(EDGES) + 1


def test_copies_take_no_places_in_the_fit(frame):
    few, many = sentences(DE, 10), sentences(EN, 150)
    rows = [(i, few[i % 10], "de") for i in range(3000)] + [(3000 + i, many[0], "en") for i in range(2000)] + [(5000 + i, t, "en") for i, t in enumerate(many[1:])]
    got = [(r["text"], r["lang"]) for r in language_id.sample_of(frame(rows).select("text", "lang"), 200)]
    assert len(got) == len(set(got)) == 110
    assert {t for t, lang in got if lang == "de"} == set(few)
    assert {t for t, lang in got if lang == "en"} <= set(many)


def test_languages_without_labels(frame):
    assert language_id.fit(frame([(1, "abc", None)]), F.lit(True)) is None
    assert language_id.fit(frame([]), F.lit(True)) is None
    assert [r.lang_pred for r in language_id.identify(frame([(1, "abc")]), None).collect()] == ["und"]


def test_classifier_against_the_formula():
    """Nyström features and ridge regression by kernels of plain sets, without folding them into one matrix."""
    import numpy as np

    texts = sentences(EN, 20) + sentences(DE, 20) + sentences("le la les des une est dans pour qui sur par avec", 9)
    labels = ["en"] * 20 + ["de"] * 20 + ["fr"] * 9
    dims, longest, landmarks, ridge = 512, 3, 12, 0.05
    model = language_id.Classifier.fit(texts, labels, dims, longest, landmarks, ridge)

    def places(text):
        codes = [32 if c < 128 and not 97 <= c <= 122 else c for c in map(ord, text.lower())]
        out = set()
        for i in range(len(codes)):
            gram = 0
            for n in range(1, longest + 1):
                if i + n <= len(codes):
                    gram = codes[i] if n == 1 else (gram * 0x9E3779B97F4A7C15 + codes[i + n - 1]) % 2**64
                    out.add((((gram ^ (gram >> 31)) * ((0xBF58476D1CE4E5B9 + 2 * n) % 2**64)) % 2**64 >> 40) % dims)
        return out

    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    sets = [places(t) for t in texts]
    marks = [sets[i] for lang in ("en", "de", "fr") for i in [k for k, x in enumerate(labels) if x == lang][: landmarks // 3]]
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = lambda s: np.append(np.array([kernel(s, m) for m in marks]) @ root, 1)
    features = np.array([phi(s) for s in sets])
    for k, lang in enumerate(model.languages):
        y = np.array([x == lang for x in labels], float)
        weights = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ y)
        new = sentences(EN, 5, 1) + sentences(DE, 5, 1) + ["une est dans la"]
        ours = language_id.presence(new, dims, longest) @ model.matrix[:-1, k] + model.matrix[-1, k]
        assert ours == pytest.approx([float(phi(places(t)) @ weights) for t in new], abs=2e-4)


def test_nul_in_a_text():
    both = language_id.presence(["ab\0cd", "xy"], 512, 3)
    assert (both[1] == language_id.presence(["xy"], 512, 3)[0]).all()


# Scoring


def test_scores_against_brute_force(frame):
    rows = [(i, t) for i, t in enumerate(sentences(EN, 60) + sentences(DE, 60))] + [(200 + k, r[1]) for k, r in enumerate(EDGES)] + [(300, "the unseenword")]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    df = frame(rows, extra=True)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = lm_score.score_texts(df, train, known_share=0.01, warm_docs=50).select("row.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score <= 0
    short = [r for r in got if r.doc_id < 120 and held[r.doc_id]]
    assert sum(r.score for r in short) > sum(r.base_score for r in short)


def test_the_model_is_normalised():
    import numpy as np

    of = np.array([0, 0, 0, 1, 1])
    model = lm_score.LogBilinear(np.array([0.5, 0.3, 0.2]), 2, 4, of, np.array([5.0, 3, 1, 2, 2]))
    rng = np.random.default_rng(1)
    model.context *= 9
    model.word += rng.normal(0, 2, model.word.shape).astype(np.float32)
    before = [0, 2]
    total = 0.0
    for kind, word in [*zip(of.tolist(), range(5), strict=True), (2, -1)]:
        text, words = np.array([*before, kind]), np.array([-1, -1, word])
        total += 10 ** model.log10([text], words)[2]
        # The same by the formula, in full.
        p = sum(model.context[c] * w for c, w in zip(before, model.weight, strict=True)).astype(float)
        soft = lambda x, i: x[i] - math.log(sum(math.exp(v) for v in x))
        want = soft([float(p @ t + b) for t, b in zip(model.target, model.bias, strict=True)], kind)
        if word >= 0:
            first = of.tolist().index(kind)
            want += soft([float(p @ t + b) for t, b, o in zip(model.word, model.word_bias, of, strict=True) if o == kind], word - first)
        assert model.log10([text], words)[2] == pytest.approx(want / math.log(10), abs=1e-4)
    assert total == pytest.approx(1, abs=1e-5)


def test_words_of_one_language_share_classes():
    import numpy as np

    texts = [lm_score.words_of(t) for t in sentences(EN, 200) + sentences(DE, 200)]
    counts = Counter(w for t in texts for w in t)
    frequent = [w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if w and c > 3]
    found = lm_score.Vocabulary.fit(texts, frequent, groups=2, class_words=1000, tails_each=2)
    assert sorted(found.singles) == sorted(frequent)
    assert (np.diff(found.class_of_single) >= 0).all()
    english, german = ({w.encode() for t in sentences(x, 50) for w in t.lower().split()} for x in (EN, DE))
    of = {w: found.class_of(w) for w in frequent}
    assert not {of[w] for w in frequent if w in english - german} & {of[w] for w in frequent if w in german - english}
    assert found.classes > found.tail_class(b"unheardof") >= found.single_classes


def test_the_sample_is_bounded_and_of_different_texts(frame):
    rows = [(i, f"text number {i % 40} " * (1 + i % 40)) for i in range(2000)]
    texts = [r.text for r in lm_score.sample_of(frame(rows).select("text"), 30, 3000).collect()]
    assert len(texts) == len(set(texts)) and 0 < len(texts) <= 30 and sum(map(len, texts)) <= 3000


def test_scores_without_training_rows(frame):
    got = lm_score.score_texts(frame([(1, "a b"), (2, None)]), F.lit(False)).select("row.doc_id", "n_tokens", "n_known", "train_tokens", "base_score").collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert lm_score.score_texts(frame([]), F.lit(True)).count() == 0


def test_classes_are_learned_from_all_training_rows(frame, monkeypatch):
    import numpy as np

    rows = [(i, f"{w} the rare{i} of {w} a {w}") for i, w in enumerate(["red", "blue", "green", "grey"] * 30)] + [(999, None)]
    found = []
    whole = lm_score.Vocabulary.by_company.__func__
    monkeypatch.setattr(lm_score.Vocabulary, "by_company", classmethod(lambda cls, near, frequent, *more: (found.append((near, frequent)), whole(cls, near, frequent, *more))[1]))
    df = frame(rows).repartition(3)
    lm_score.score_texts(df, F.col("doc_id") % 5 != 1, warm_docs=2, single_words=0.5)
    (near, frequent), texts = found[0], [lm_score.words_of(t) for i, t in rows if i % 5 != 1]
    want = np.zeros(near.shape)
    at = lambda w: frequent.index(w) if w in frequent else len(frequent) + lm_score.bucket(w)
    for text in texts:
        for i, w in enumerate(text):
            for other in text[max(0, i - lm_score.REACH) : i + lm_score.REACH + 1]:
                if other in frequent[: lm_score.COMPANY]:
                    want[at(w), frequent.index(other)] += 1
    assert 0 < len(frequent) and (near == want).all()


def test_words_in_memory_fill_their_bound(spark):
    """Not only those above the share, of which there may be few; and each ending is hashed once."""
    counts = spark.createDataFrame([(f"w{i}".encode(), c) for i, c in enumerate([300, 90, 50, 50, 40, 20, 7, 7, 7, 7, 7, 1, 1])], "word binary, c long")
    kept = lambda share: sorted(lm_score.kept_in_memory(counts, 1000, share).values(), reverse=True)
    assert kept(0.1) == [300, 90, 50, 50, 40, 20]  # the five words of 7 would make it eleven
    assert kept(0.09) == [300, 90, 50, 50, 40, 20, 7, 7, 7, 7, 7] and kept(0.5) == [300, 90] and kept(1e-5)[-1] == 7
    assert lm_score.kept_in_memory(counts.limit(0), 0, 0.1) == {}


def test_endings_are_hashed_once_and_bounded(monkeypatch):
    asked = []
    monkeypatch.setattr(lm_score.xxhash, "xxh3_64_intdigest", lambda e, whole=lm_score.xxhash.xxh3_64_intdigest: (asked.append(e), whole(e))[1])
    found = lm_score.Endings()
    monkeypatch.setattr(lm_score, "_endings", found)
    monkeypatch.setattr(lm_score.Endings, "most", 100)
    words = [b"%d-ending" % i for i in range(1000)] + [b""]
    assert len(set(lm_score.buckets(words[:-1]).tolist())) == 1 and asked == [b"ding"]
    lm_score.buckets([b"%04d" % i for i in range(1000)])
    assert len(found) <= 100
