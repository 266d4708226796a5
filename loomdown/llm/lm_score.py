"""Scoring by a log-bilinear neural language model.

The model predicts each word from the classes of the `order` words before it, in two steps. A weighted sum of their vectors is the
predicted vector; its products with all class vectors, normalised by a softmax, give the class; its products with the vectors of
the class's words give the word, by a softmax again, for a whole batch with one matrix product for each class. The
`single_words` * sqrt(vocabulary) most frequent words stand in classes of `class_words` words each. Rarer words are dealt to tail classes by
their last letters, and a word has the probability of its smoothed count within its tail class. So a text's probability
is normalised over all words, and the model's vocabulary grows with the corpus.

Which words share a class is learned from all training rows, by their company: words and endings are grouped by which frequent words
stand near them. Training is by noise-contrastive estimation in numpy at both steps: one pass over all training rows, each partition
from the same starting values, averaged by tokens. The starting values are trained on at most `warm_docs` different
texts with `warm_chars` characters, those with the smallest hashes. Counts cover all training rows. What goes
to every task is the counts of the most frequent words, at most 1 / known_share; all others are counted by a join, not from a table in memory.

Defined cases: a null or empty text has one token, its end. Repeated rows are scored each, very long texts whole. A null doc_id has no
remainder and is not trained on. Words of equal counts are ordered by their bytes. Without training rows every token has the base
probability of an unseen one. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .tokens import pieces

END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words in order, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def count_words(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, c) of all rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(words_of(text))
            if len(seen) > flush:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(rows, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def kept_in_memory(counts: DataFrame, n_all: int, known_share: float) -> dict[bytes, int]:
    """The counts of the most frequent words, as many as 1 / known_share allows, and of none that was seen once; n_all: the sum of all counts.

    Words of like counts, within some 3 %, stand or fall together, so that a few hundred numbers tell which fit.
    """
    like = counts.where("c > 1").groupBy(F.floor(F.log("c") * 32).alias("like")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()
    least, total = max(2, math.ceil(known_share * n_all)), 0
    for r in sorted(like, key=lambda r: -r["like"]):
        total += r["n"]
        if total > 1 / known_share:
            break
        least = min(least, r["c"])
    return {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).collect()}


#: Hashes of a word's last letters.
BUCKETS = 2048
#: How many of the most frequent words are company, and how far from a word.
COMPANY, REACH = 64, 8


class Endings(dict):
    """The hashes of the endings met by this process, which are far fewer than words; all are forgotten when they are `most`."""

    most = 1 << 18

    def __missing__(self, ending: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[ending] = found = xxhash.xxh3_64_intdigest(ending)
        return found


_endings = Endings()


def ending_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_endings.__getitem__, [w[-4:] for w in words]), np.uint64, len(words))


def buckets(words: list[bytes]) -> np.ndarray:
    return (ending_hashes(words) % np.uint64(BUCKETS)).astype(np.int64)


def bucket(word: bytes) -> int:
    return int(buckets([word])[0])


def company_of(of: np.ndarray, ends: np.ndarray, n_frequent: int) -> np.ndarray:
    """(n_frequent + BUCKETS, at most COMPANY): how often each of the most frequent words stands within REACH of each word or ending.

    of: the numbers of the words of some texts in a row, those of frequent words first; ends: of the texts.
    """
    wide = min(COMPANY, n_frequent)
    # Texts stand apart by more than the reach.
    place = np.arange(len(of)) + (REACH + 1) * np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    marks = np.flatnonzero(of < wide)
    first, last = np.searchsorted(place[marks], place - REACH), np.searchsorted(place[marks], place + REACH, "right")
    many = last - first
    which = marks[np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)]
    pairs = np.repeat(of, many) * wide + of[which]
    return np.bincount(pairs, minlength=(n_frequent + BUCKETS) * wide).astype(np.float64).reshape(n_frequent + BUCKETS, wide)


class Vocabulary:
    """Words that stand alone, in classes, and the tail classes of all others."""

    def __init__(self, singles: list[bytes], class_of_single: np.ndarray, group_of_bucket: np.ndarray, tails_each: int):
        """singles: in the order of their classes, which are 0, 1, ...; group_of_bucket: of each hash of a word's last letters."""
        self.singles, self.class_of_single, self.group_of_bucket, self.tails_each = singles, class_of_single, group_of_bucket, tails_each
        self.number = {w: i for i, w in enumerate(singles)}
        self.single_classes = int(class_of_single[-1]) + 1 if len(singles) else 0
        self.classes = self.single_classes + (int(group_of_bucket.max()) + 1) * tails_each

    def tail_classes(self, words: list[bytes]) -> np.ndarray:
        h = ending_hashes(words)
        within = (h >> np.uint64(32)).astype(np.int64) % self.tails_each
        return self.single_classes + self.group_of_bucket[(h % np.uint64(BUCKETS)).astype(np.int64)] * self.tails_each + within

    def classes_of(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        out, tail = np.zeros(len(words), np.int64), np.flatnonzero(at < 0)
        out[at >= 0] = self.class_of_single[at[at >= 0]]
        out[tail] = self.tail_classes([words[i] for i in tail.tolist()])
        return out

    def tail_class(self, word: bytes) -> int:
        return int(self.tail_classes([word])[0])

    def class_of(self, word: bytes) -> int:
        return int(self.classes_of([word])[0])

    @classmethod
    def fit(cls, texts: list[list[bytes]], frequent: list[bytes], groups: int, class_words: int, tails_each: int) -> Vocabulary:
        """frequent: the words that are to stand alone, most frequent first."""
        number = {w: i for i, w in enumerate(frequent)}
        flat = list(chain.from_iterable(texts))
        of = np.fromiter((number[w] if w in number else len(frequent) + bucket(w) for w in flat), np.int64, len(flat))
        return cls.by_company(company_of(of, np.cumsum(list(map(len, texts))), len(frequent)), frequent, groups, class_words, tails_each)

    @classmethod
    def by_company(cls, near: np.ndarray, frequent: list[bytes], groups: int, class_words: int, tails_each: int) -> Vocabulary:
        """near: company_of all texts."""
        size = len(frequent) + BUCKETS
        seen = near.sum(1)
        points = np.sqrt((near + near.sum(0) / max(1.0, seen.sum())) / (seen + 1)[:, None]) if near.size else np.zeros((size, 1))
        group = grouped(points, np.maximum(seen, 1e-3), groups)
        # Words of a group, by frequency, fill classes of `class_words`.
        order = np.lexsort((np.arange(len(frequent)), group[: len(frequent)]))
        own = group[order]
        place = np.arange(len(order)) - np.searchsorted(own, own)
        _, of_class = np.unique(np.stack([own, place // class_words]), axis=1, return_inverse=True) if len(order) else (None, np.empty(0, np.int64))
        return cls([frequent[i] for i in order], of_class.reshape(-1), group[len(frequent) :], tails_each)


def grouped(points: np.ndarray, weights: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """The group of each point, by weighted means; the first means are points far from each other."""
    weighed = points * weights[:, None]
    means = [weighed.sum(0) / weights.sum()]
    gap = ((points - means[0]) ** 2).sum(1)
    while len(means) <= groups:
        means.append(points[int((gap * weights).argmax())])
        gap = np.minimum(gap, ((points - means[-1]) ** 2).sum(1))
    centres = np.array(means[1:])
    for _ in range(rounds):
        of = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        total = np.bincount(of, weights, len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, weighed)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centres)
    return of


def log_share(scores: np.ndarray, own: np.ndarray, ones: np.ndarray, shift: bool) -> np.ndarray:
    """The natural log of the softmax at `own`; the scores are overwritten."""
    if shift:
        scores -= scores.max(1, keepdims=True)
    mine = scores[np.arange(len(own)), own]
    np.exp(scores, out=scores)
    return mine - np.log(scores @ ones)


class LogBilinear:
    """Vectors of context and predicted classes and of single words, position weights and biases."""

    NAMES = ("context", "target", "weight", "bias", "word", "word_bias")

    def __init__(self, unigram: np.ndarray, order: int, width: int, class_of_single: np.ndarray = np.empty(0, np.int64), single_counts: np.ndarray = np.empty(0), noise: int = 64, word_noise: int = 3, seed: int = 1):
        """unigram: of the classes; class_of_single: ascending, with the counts of the words."""
        rng = np.random.default_rng(seed)
        n = len(unigram)
        self.order, self.width, self.noise, self.word_noise, self.unigram = order, width, noise, word_noise, unigram
        self.log_noise = np.log(noise * unigram).astype(np.float32)
        self.of = class_of_single
        self.first = np.searchsorted(self.of, np.arange(n + 1))
        self.cdf = np.concatenate(([0.0], np.cumsum(single_counts + 0.5)))
        within = (single_counts + 0.5) / (self.cdf[self.first[1:]] - self.cdf[self.first[:-1]])[self.of]
        self.log_word_noise = np.log(word_noise * within).astype(np.float32)
        self.context = rng.normal(0, 0.1, (n + 1, width)).astype(np.float32)  # the last is the place before the text
        self.target = rng.normal(0, 0.1, (n, width)).astype(np.float32)
        self.weight = np.full((order, width), 1 / order, np.float32)
        self.bias = np.log(unigram).astype(np.float32)
        self.word = np.zeros((len(self.of), width), np.float32)
        self.word_bias = np.log(within).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, np.asarray(values[at : at + old.size], np.float32).reshape(old.shape))
            at += old.size

    def contexts(self, texts: list[np.ndarray]) -> np.ndarray:
        """(order, tokens): the classes before each token of each text."""
        pad = np.full(self.order, len(self.unigram))
        run = np.concatenate([np.concatenate((pad, t)) for t in texts])
        keep = np.concatenate([np.arange(len(t)) + at for t, at in zip(texts, np.cumsum([0, *(len(t) + self.order for t in texts[:-1])]), strict=True)])
        return np.stack([run[keep + i] for i in range(self.order)])

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(np.take(self.context * w, c, 0) for c, w in zip(before, self.weight, strict=True))

    def log10(self, texts: list[np.ndarray], words: np.ndarray, batch: int = 512) -> np.ndarray:
        """The log10 probability of each token's class, and of its word in it if it stands alone (words: its number or -1), over all texts in a row."""
        before, now = self.contexts(texts), np.concatenate(texts)
        out = np.empty(len(now), np.float32)
        ones = np.ones(len(self.bias), np.float32)
        target = np.ascontiguousarray(np.concatenate([self.target, self.bias[:, None]], 1).T)
        # Products of vectors cannot pass that of their lengths, so most batches need no shift before exp().
        length = lambda x: math.sqrt(np.einsum("tw,tw->t", x, x).max(initial=0))
        longest = length(target.T)
        weighted = [self.context * w for w in self.weight]
        all_p = np.ones((len(now), self.width + 1), np.float32)
        for at in range(0, len(now), batch):
            ctx, tgt = before[:, at : at + batch], now[at : at + batch]
            p = all_p[at : at + batch]
            p[:, :-1] = sum(np.take(w, c, 0) for w, c in zip(weighted, ctx, strict=True))
            out[at : at + batch] = log_share(p @ target, tgt, ones, length(p) * longest > 60)
        alone = np.flatnonzero(words >= 0)
        alone = alone[np.argsort(now[alone], kind="stable")]
        ends = np.searchsorted(now[alone], np.arange(self.of[-1] + 2)) if len(alone) else np.zeros(1, np.int64)
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if b > a:
                i, j = self.first[k], self.first[k + 1]
                own = np.concatenate([self.word[i:j], self.word_bias[i:j, None]], 1)
                p = np.take(all_p, alone[a:b], 0)
                out[alone[a:b]] += log_share(p @ own.T, words[alone[a:b]] - i, np.ones(j - i, np.float32), length(p) * length(own) > 60)
        return out.astype(np.float64) / math.log(10)

    def train(self, texts: list[np.ndarray], words: np.ndarray, rng: np.random.Generator, state: dict, rate: float = 0.08, batch: int = 6144, part: int = 512) -> int:
        """One pass of noise-contrastive estimation; the class noise of a batch is shared by its tokens, that of words is each one's own."""
        before, now = self.contexts(texts), np.concatenate(texts)
        n = len(self.target)
        cdf = np.cumsum(self.unigram)

        columns = lambda g: np.ascontiguousarray(g.T, np.float64)
        # The sums by index of rows that are given by their columns.
        rows = lambda index, g, size: np.stack([np.bincount(index, column, size) for column in g], 1)
        flat_products = lambda g, p: ((g * column[:, None]).reshape(-1) for column in np.ascontiguousarray(p.T))

        def step(name: str, grad: np.ndarray) -> None:
            square = state.setdefault(name, np.full(grad.shape, 1.0))
            square += grad * grad
            value = getattr(self, name)
            value += (rate * grad / np.sqrt(square)).astype(np.float32)

        for at in range(0, len(now), batch):
            ctx, tgt = before[:, at : at + batch], now[at : at + batch]
            noise = np.minimum(np.searchsorted(cdf, rng.random(self.noise) * cdf[-1]), n - 1)
            p_one = np.ones((len(tgt), self.width + 1), np.float32)  # with a 1 that meets the biases
            p = p_one[:, :-1]
            p[:] = self.predicted(ctx)
            of_target = np.take(self.target, tgt, 0)
            s_data = np.einsum("tw,tw->t", p, of_target) + self.bias[tgt] - self.log_noise[tgt]
            g_data = 1 / (1 + np.exp(s_data))
            g_p = g_data[:, None] * of_target
            noise_target = self.target[noise]
            negative = -np.concatenate([noise_target, (self.bias[noise] - self.log_noise[noise])[:, None]], 1).T
            g_noise_one = np.zeros((len(noise), self.width + 1), np.float32)
            for k in range(0, len(tgt), part):
                # -1 / (1 + exp(-s)) of the noise's scores s, in place, for as many tokens as stay in a processor's cache
                g = p_one[k : k + part] @ negative
                np.exp(g, out=g)
                g += 1
                np.divide(-1, g, out=g)
                g_p[k : k + part] += g @ noise_target
                g_noise_one += g.T @ p_one[k : k + part]
            g_target = rows(tgt, flat_products(g_data[:, None], p), n)
            np.add.at(g_target, noise, g_noise_one[:, :-1])
            g_bias = np.bincount(tgt, g_data, n)
            np.add.at(g_bias, noise, g_noise_one[:, -1])
            alone = np.flatnonzero(words[at : at + batch] >= 0)
            g_word, g_word_bias = np.zeros(self.word.shape), np.zeros(len(self.word))
            if len(alone):
                # Each word with `word_noise` others of its class, drawn by their counts.
                own, of = words[at : at + batch][alone], tgt[alone]
                low, high = self.cdf[self.first[of]], self.cdf[self.first[of + 1]]
                drawn = np.searchsorted(self.cdf, low[:, None] + rng.random((len(own), self.word_noise)) * (high - low)[:, None], "right") - 1
                both = np.concatenate([own[:, None], np.clip(drawn, self.first[of][:, None], self.first[of + 1][:, None] - 1)], 1)
                p_own, of_word = np.take(p_one, alone, 0)[:, :-1], np.take(self.word, both, 0)
                s_word = np.einsum("tw,tkw->tk", p_own, of_word) + (self.word_bias - self.log_word_noise)[both]
                g = -1 / (1 + np.exp(-s_word))
                g[:, 0] += 1
                g_p[alone] += np.einsum("tk,tkw->tw", g, of_word)
                flat = both.reshape(-1)
                g_word = rows(flat, flat_products(g, p_own), len(self.word))
                g_word_bias = np.bincount(flat, g.reshape(-1), len(self.word))
            g_columns = columns(g_p)
            by_place = [rows(c, g_columns, n + 1) for c in ctx]
            g_context = sum(r * w for r, w in zip(by_place, self.weight, strict=True))
            g_weight = np.stack([(r * self.context).sum(0) for r in by_place])
            for name, g in zip(self.NAMES, (g_context, g_target, g_weight, g_bias, g_word, g_word_bias), strict=True):
                step(name, g)
        return len(now)


def sample_of(rows: DataFrame, warm_docs: int, warm_chars: int) -> DataFrame:
    """(text): the different texts with the smallest hashes, as many as both bounds allow, as a written table."""
    rows = rows.select(F.xxhash64("text").alias("h"), F.length("text").alias("chars"), "text").where(F.col("chars") <= warm_chars)
    place = F.pmod("h", F.lit(1 << 40)), F.col("h")
    # Only hashes and lengths are compared; the texts that they choose meet in one task, within both bounds.
    few = rows.select("h", "chars").dropDuplicates(["h"]).orderBy(*place).limit(warm_docs).withColumn("total", F.sum("chars").over(W.orderBy(*place)))
    chosen = [r["h"] for r in few.where(F.col("total") <= warm_chars).collect()]
    return written(rows.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).repartition(1).sortWithinPartitions(*place).select("text"), "lm-sample")


SUMS = "tokens double, params array<double>"


def summed(parts: DataFrame) -> tuple[float, np.ndarray | None]:
    """The sums of the tasks' tokens and arrays, summed in Spark."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for all rows of a task, so that what is added by number does not grow with the tasks before."""
        tokens, params = 0.0, None
        for batch in batches:
            for n, own in zip(batch["tokens"].to_pylist(), batch["params"], strict=True):
                values = own.values.to_numpy(zero_copy_only=False)
                tokens, params = tokens + n, values if params is None else params + values
        if params is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([params], pa.list_(pa.float64()))], ["tokens", "params"])

    parts = written(written(parts, "lm-parameters").mapInArrow(added, SUMS), "lm-sums")
    tokens = parts.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return 0.0, None
    sums = parts.select(F.posexplode("params").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return tokens, np.array([r["x"] for r in sums])


def score_texts(
    docs: DataFrame,
    train: Column,
    text: str = "text",
    keep: list[str] | None = None,
    order: int = 4,
    width: int = 16,
    single_words: float = 2.0,
    class_words: int = 64,
    groups: int = 16,
    tails_each: int = 6,
    known_share: float = 1e-5,
    warm_docs: int = 1500,
    warm_chars: int = 6_000_000,
    batch_chars: int = 400_000,
) -> DataFrame:
    """Each row as the struct `row`, of the columns to keep or all, with n_tokens, n_known, train_tokens, base_score and score; `train` chooses the training rows."""
    row = F.struct("*") if keep is None else F.struct(*keep)
    base = docs.select(row.alias("row"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = written(count_words(base.where("train")), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = total["n"] or 0, total["v"]
    known = kept_in_memory(counts, n_all, known_share)
    sample = sample_of(base.where("train").select(F.coalesce("text", F.lit("")).alias("text")), warm_docs, warm_chars)
    frequent = sorted(known, key=lambda w: (-known[w], w))[: int(single_words * math.sqrt(v_all))]
    known_at = {w: i for i, w in enumerate(known)}
    frequent_at = {w: i for i, w in enumerate(frequent)}
    known_item = np.array([frequent_at[w] if w in frequent_at else len(frequent) + bucket(w) for w in known] or [0], np.int64)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
        """Rows with about `batch_chars` characters, and their words."""
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in pieces(texts, batch_chars):
                yield batch.slice(part.start, part.stop - part.start), [words_of(t) for t in texts[part]]

    def company_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, near = 0, None
        for _, chunk in chunks(batches):
            flat = list(chain.from_iterable(chunk))
            at = np.fromiter(map(known_at.get, flat, repeat(-1)), np.int64, len(flat))
            of, unknown = known_item[at], np.flatnonzero(at < 0)
            of[unknown] = len(frequent) + buckets([flat[i] for i in unknown.tolist()])
            own = company_of(of, np.cumsum(list(map(len, chunk))), len(frequent))
            tokens, near = tokens + len(flat), own if near is None else near + own
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.array([near.reshape(-1)], pa.list_(pa.float64()))], ["tokens", "params"])

    _, near = summed(base.where("train").select("text").mapInArrow(company_rows, SUMS))
    shape = len(frequent) + BUCKETS, min(COMPANY, len(frequent))
    near = np.zeros(shape) if near is None or not near.size else near.reshape(shape)
    vocabulary = Vocabulary.by_company(near, frequent, groups, class_words, tails_each)
    n_classes = vocabulary.classes

    def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = vocabulary.classes_of(batch["word"].to_pylist())
            sums, kinds = np.bincount(of, batch["c"].to_numpy(), n_classes), np.bincount(of, minlength=n_classes)
            yield pa.RecordBatch.from_arrays([pa.array(range(n_classes), pa.int64()), pa.array(sums.astype(np.int64)), pa.array(kinds)], ["class", "n", "v"])

    by_class = {r["class"]: r for r in counts.mapInArrow(class_rows, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n_class = np.array([by_class[i]["n"] if i in by_class else 0 for i in range(n_classes)], np.float64)
    v_class = np.array([by_class[i]["v"] if i in by_class else 0 for i in range(n_classes)], np.float64)
    unigram = (n_class + 1) / (n_class + 1).sum()
    facts = unigram, order, width, vocabulary.class_of_single, np.array([known[w] for w in vocabulary.singles], np.float64)
    model = LogBilinear(*facts)

    known_class = vocabulary.classes_of(list(known)) if known else np.zeros(1, np.int64)
    known_single = np.array([vocabulary.number.get(w, -1) for w in known] or [-1], np.int64)
    known_log = np.array([math.log10(c + 0.5) for c in known.values()] or [0.0])

    def looked_up(chunk: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of the chunk in a row: classes, numbers of single words, logs of counts (0 if not known here), numbers of those not known; ends of the texts."""
        flat = list(chain.from_iterable(chunk))
        at = np.fromiter(map(known_at.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(at < 0)
        of, single, logs = known_class[at], known_single[at], known_log[at]
        of[unknown] = vocabulary.tail_classes([flat[i] for i in unknown.tolist()])
        single[unknown] = -1
        logs[unknown] = 0
        return of, single, logs, unknown, np.cumsum(list(map(len, chunk)))

    def train_rows(start: np.ndarray | None, passes: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = LogBilinear(*facts)
            if start is not None:
                own.load(start)
            rng, state, tokens = np.random.default_rng(7), {}, 0
            if start is not None:
                state = {k: np.full(getattr(own, k).shape, 400.0) for k in own.NAMES}
            for _, chunk in chunks(batches):
                of, single, _, _, ends = looked_up(chunk)
                texts = np.split(of, ends[:-1])
                for _ in range(passes):
                    tokens += own.train(texts, single, rng, state)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.array([own.flat().astype(np.float64) * tokens], pa.list_(pa.float64()))], ["tokens", "params"])

        return rows

    for source, passes in ((sample, 3), (base.where("train").select("text"), 1)):
        tokens, params = summed(source.mapInArrow(train_rows(model.flat() if passes == 1 else None, passes), SUMS))
        if tokens:
            model.load(params / tokens)

    log_class = np.log10(n_class + 0.5 * (v_class + 1))
    log_all = math.log10(n_all + 0.5 * (v_all + 1))
    final = model.flat()

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LogBilinear(*facts)
        own.load(final)
        for batch, chunk in chunks(batches):
            of, single, logs, unknown, ends = looked_up(chunk)
            texts, starts = np.split(of, ends[:-1]), ends - np.array(list(map(len, chunk)))
            inner = np.where(single < 0, logs - log_class[of], 0)
            model_sum, base_sum = (np.add.reduceat(x, starts) for x in (own.log10(texts, single) + inner, logs - log_all))
            cuts = np.searchsorted(unknown, np.append(starts, ends[-1]))
            rare = [Counter(map(words.__getitem__, (unknown[a:b] - start).tolist())) for words, start, a, b in zip(chunk, starts, cuts[:-1], cuts[1:], strict=True)]
            sizes = ends - starts
            at = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            words = pa.ListArray.from_arrays(at, pa.array(list(chain.from_iterable(rare)), pa.binary()))
            times = pa.ListArray.from_arrays(at, pa.array(list(chain.from_iterable(r.values() for r in rare)), pa.int64()))
            cols = [pa.array(sizes), pa.array(sizes - np.diff(cuts)), pa.array(base_sum), pa.array(model_sum), words, times]
            yield pa.RecordBatch.from_arrays([batch["row"], *cols], ["row", "n_tokens", "known", "base", "model", "rare", "times"])

    # A row's number is given once and written with it, so that what is joined to it later is its own.
    found = base.select("row", "text").mapInArrow(score_rows, f"row {base.schema['row'].dataType.simpleString()}, n_tokens long, known long, base double, model double, rare array<binary>, times array<long>")
    parts = written(found.withColumn("rid", F.monotonically_increasing_id()), "lm-parts")
    rare = parts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("rid", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    rare = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_rare"),
    )
    return parts.drop("rare", "times").join(rare, "rid", "left").select(
        "row", "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log_rare", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("log_rare", F.lit(0.0))).alias("score"),
    )


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    out = score_texts(docs, ~held_out, keep=["doc_id"])
    return out.select("row.doc_id", F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
