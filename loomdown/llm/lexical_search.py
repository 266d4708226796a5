r"""Ranked lexical search of a query set over all documents, by MaxScore with bounds for pairs of terms.

The index is in segments: each holds some thousand whole documents, for each term of the queries the documents that hold it with their
impacts (what the term adds to their scores), and the largest of these. For pairs of terms that stand next to each other in
a query's order, by weight, a segment also has the intersection of the two lists with both impacts and the largest joint one.

A query takes its terms in that order. What a document can score on the first i terms alone is bounded by the sum of their largest
impacts, and tighter by pairs: two neighbours together add no more than their largest joint impact, or than the larger one of them where they do not
meet. The best way to pair up a prefix is found by taking each next term alone or with the one before it. Terms whose
prefix stays below the score that is needed are not searched for candidates: candidates come from the other lists, and are looked
up in the pair lists and lists of the prefix as long as their bounds reach that score. Segments whose bound over all terms is too low are
skipped. Nothing that could be among the best is left out, so the result is exact.

Queries go in blocks of about `block_chars` characters; a block's words, weights and results so far are what tasks are sent. Of
`seed_segments` segments the scores needed at the start are taken; they change what is skipped, not what is found.

Terms are the maximal runs `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` with A-Z lower-cased. Scores are whole numbers.

Defined cases: null and empty texts have no terms, match nothing and count in no statistic; a row is a document whatever its doc_id, so repeated
rows are found and counted each. Equal scores go by ascending doc_id, null ids last. A query repeats its terms' weights as often as it holds them; queries with
equal texts or ids are answered each, those without terms get no rows. Very long texts are read whole. Empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LARGE_ROWS, byte_view, release, table, written

IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
WINDOW = 1 << 20
SEGMENT = "segment long, ids array<long>, sizes array<long>, terms array<int>, lengths array<long>, docs array<int>, counts array<long>, n_docs long, n_terms long"
IMPACTS = "segment long, ids array<long>, terms array<int>, lengths array<long>, docs array<int>, impacts array<long>, pairs array<int>, pair_lengths array<long>, joint_maxima array<long>, pair_docs array<int>, first_impacts array<long>, second_impacts array<long>"
FOUND = "query int, doc_id long, score long, segment long"


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Spans of about `size` bytes that cut no term."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data) and IN_TERM[data[end - 1]] and IN_TERM[data[end]]:
            free = np.flatnonzero(~IN_TERM[data[at:end]])
            if len(free):
                end = at + int(free[-1]) + 1
            else:  # a term, or neighbouring texts without any other byte, longer than a window
                rest = np.flatnonzero(~IN_TERM[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        yield at, end
        at = end


def term_spans(data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each term; a text's first byte starts one anew."""
    inside = IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[text_starts[text_starts < len(data)]] = True
    cut[[0, -1]] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | np.concatenate((~inside[1:], [True])))) + 1
    return starts, ends


class Terms:
    """Finds the terms of a block of queries among those of texts: by a hash first, then byte by byte."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        base, factor = 0x9E3779B97F4A7C15, 0
        while True:  # another base if two of the words share a hash
            self.up, self.down = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
            own = self.hashes(self.bytes, self.begins[:-1], self.begins[1:])
            self.order = np.argsort(own)
            self.sorted = own[self.order]
            if not (np.diff(self.sorted) == 0).any():
                break
            factor += 2
            base = (base * 3 + factor) % (1 << 64) | 1
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.low(own)] = True

    @staticmethod
    def low(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A polynomial over each span, from running sums, modulo 2 ** 64."""
        powers = np.full(len(data) + 1, self.up, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((FOLD[data].astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        powers.fill(self.down)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        out = (sums[ends] - sums[starts]) * powers[starts]
        return out ^ (out >> np.uint64(32))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(span, term) of the spans that are terms."""
        if not len(self.words) or not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = self.hashes(data, starts, ends)
        span = np.flatnonzero(self.seen[self.low(hashes)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[span]), len(self.sorted) - 1)
        term = self.order[at]
        good = (self.sorted[at] == hashes[span]) & (self.lengths[term] == (ends - starts)[span])
        span, term = span[good], term[good]
        if not len(span):
            return span, term
        sizes = self.lengths[term]
        before = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
        same = FOLD[data[np.repeat(starts[span], sizes) + step]] == self.bytes[np.repeat(self.begins[term], sizes) + step]
        good = np.logical_and.reduceat(same, before)
        return span[good], term[good]


def terms_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    folded = FOLD[data].tobytes()
    return [folded[a:b] for a, b in zip(*term_spans(data, np.zeros(1, np.int64)), strict=True)]


@dataclass
class Query:
    item_id: int | None
    terms: list[int]  # by weight, then by number: frequent ones first
    times: list[int]


def queries_of(texts: list[str | None], ids: list[int | None]) -> tuple[list[bytes], list[Query]]:
    """(the distinct terms, the queries over their numbers)."""
    counted = [Counter(terms_of(t)) for t in texts]
    words = sorted(set().union(*counted)) if counted else []
    number = {w: i for i, w in enumerate(words)}
    return words, [Query(i, [number[w] for w in c], list(c.values())) for i, c in zip(ids, counted, strict=True)]


def index(docs: DataFrame, words: list[bytes], segment_postings: int) -> DataFrame:
    """Segments: documents with their sizes, and for each of the words the documents that hold it and how often."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, number = Terms(words), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = byte_view(batch["text"])
            starts, ends, keys, many = [], [], [], []
            per_doc = np.zeros(len(batch), np.int64)
            for a, b in windows(data, offsets):
                s, e = term_spans(data[a:b], offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a)
                doc = np.searchsorted(offsets, s + a, "right") - 1
                per_doc += np.bincount(doc, minlength=len(batch))
                span, term = vocabulary.find(data[a:b], s, e)
                key, n = np.unique(doc[span] * max(1, len(words)) + term, return_counts=True)
                keys.append(key)
                many.append(n)
            if not per_doc.any():
                continue
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(back, np.concatenate(many), len(key)).astype(np.int64)
            doc, term = key // max(1, len(words)), key % max(1, len(words))
            # Segments of whole documents with about so many postings.
            upto = np.searchsorted(doc, np.arange(len(batch)), "right")
            share = (np.maximum(upto, 1) - 1) // segment_postings
            for low in np.flatnonzero(np.concatenate(([True], np.diff(share) > 0))):
                high = int(np.searchsorted(share, share[low], "right"))
                full = np.flatnonzero(per_doc[low:high]) + low
                if not len(full):
                    continue
                p = slice(np.searchsorted(doc, low), np.searchsorted(doc, high))
                order = np.lexsort((doc[p], term[p]))
                terms, lengths = np.unique(term[p], return_counts=True)
                ids = batch["doc_id"].take(pa.array(full))
                columns = [
                    pa.array([number]), one(ids), one(per_doc[full]), one(terms.astype(np.int32)), one(lengths), one(np.searchsorted(full, doc[p][order]).astype(np.int32)), one(count[p][order]),
                    pa.array([len(full)]), pa.array([int(per_doc[full].sum())]),
                ]
                yield pa.RecordBatch.from_arrays(columns, SEGMENT_NAMES)
                number += 1

    return docs.mapInArrow(segments, SEGMENT)


SEGMENT_NAMES = [x.split()[0] for x in SEGMENT.split(", ")]
IMPACT_NAMES = [x.split()[0] for x in IMPACTS.split(", ")]


def one(values) -> pa.Array:
    """A column with these values as its one array."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def arrays(batch: pa.RecordBatch) -> Iterator[dict]:
    """Each row of a batch as numpy arrays; ids stay as they are, as they may be null."""
    for i in range(len(batch)):
        row = {}
        for name in batch.schema.names:
            value = batch[name][i]
            row[name] = value.values if name == "ids" else value.values.to_numpy() if pa.types.is_list(value.type) else value.as_py()
        yield row


def slices(lengths: np.ndarray) -> list[slice]:
    ends = np.cumsum(lengths)
    return [slice(int(b - n), int(b)) for b, n in zip(ends, lengths, strict=True)]


def statistics(segments: DataFrame, n_words: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms in all, documents with each word): as many numbers as the block has words."""
    n, total = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    held = segments.select(F.explode(F.arrays_zip("terms", "lengths")).alias("t")).groupBy("t.terms").agg(F.sum("t.lengths")).collect()
    df = np.zeros(n_words, np.int64)
    for term, many in held:
        df[term] = many
    return n or 0, total or 0, df


def weights(n: int, df: np.ndarray) -> list[int]:
    return [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]


def with_impacts(segments: DataFrame, weight: list[int], pairs: list[tuple[int, int]], n: int, total: int) -> DataFrame:
    """Segments with impacts in place of counts, and with the lists of the pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weight, np.int64)
        for batch in batches:
            for s in arrays(batch):
                m = 75 + (25 * s["sizes"] * n) // total
                parts = slices(s["lengths"])
                impacts = np.repeat(w[s["terms"]], s["lengths"]) * ((1_000_000_000 * s["counts"]) // (1000 * s["counts"] + 12 * m[s["docs"]]))
                at = dict(zip(s["terms"].tolist(), parts, strict=True))
                met = [(k, *joint(s["docs"], impacts, at[a], at[b])) for k, (a, b) in enumerate(pairs) if a in at and b in at]
                met = [x for x in met if len(x[1])]
                glue = lambda i, kind: one(np.concatenate([x[i] for x in met]) if met else np.empty(0, kind))
                columns = [
                    pa.array([s["segment"]]), one(s["ids"]), one(s["terms"]), one(s["lengths"]), one(s["docs"]), one(impacts), one(np.array([x[0] for x in met], np.int32)), one(np.array([len(x[1]) for x in met], np.int64)),
                    one(np.array([int((x[2] + x[3]).max()) for x in met], np.int64)), glue(1, np.int32), glue(2, np.int64), glue(3, np.int64),
                ]
                yield pa.RecordBatch.from_arrays(columns, IMPACT_NAMES)

    return segments.mapInArrow(rows, IMPACTS)


def joint(docs: np.ndarray, impacts: np.ndarray, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents in both lists, impact of the first, of the second)."""
    x, y = docs[a], docs[b]
    if len(x) > len(y):
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        hit = x[at] == y
        return y[hit], impacts[a][at[hit]], impacts[b][hit]
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    return x[hit], impacts[a][hit], impacts[b][at[hit]]


class Segment:
    def __init__(self, row: dict):
        self.ids, self.n_docs = row["ids"], len(row["ids"])
        self.docs, self.impacts = row["docs"], row["impacts"]
        parts = slices(row["lengths"])
        largest = np.maximum.reduceat(self.impacts, [p.start for p in parts]).tolist() if parts else []
        self.lists = dict(zip(row["terms"].tolist(), zip(parts, largest, strict=True), strict=True))
        self.pair_docs, self.firsts, self.seconds = row["pair_docs"], row["first_impacts"], row["second_impacts"]
        self.joints = dict(zip(row["pairs"].tolist(), zip(slices(row["pair_lengths"]), row["joint_maxima"].tolist(), strict=True), strict=True))


def prefix_bounds(alone: list[int], together: list[int | None]) -> tuple[list[int], list[bool]]:
    """The least bound of each prefix of the terms, and whether its last two are taken as a pair.

    together[i] bounds what terms i - 1 and i add at once, or is None.
    """
    bound, paired = [0], [False]
    for i, most in enumerate(alone):
        single = bound[i] + most
        double = bound[i - 1] + together[i] if i and together[i] is not None else single
        bound.append(min(single, double))
        paired.append(double < single)
    return bound, paired


def best_of_segment(seg: Segment, query: Query, pair_number: dict, k: int, needed: int, use_pairs: bool = True, counter: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that score at least `needed`, which is 1 or more, and of some of the others' none."""
    terms = [(t, n) for t, n in zip(query.terms, query.times, strict=True) if t in seg.lists]
    alone = [seg.lists[t][1] * n for t, n in terms]
    together: list[int | None] = [None] * len(terms)
    pair_at: list[int | None] = [None] * len(terms)
    for i in range(1, len(terms) if use_pairs else 0):
        (a, n_a), (b, n_b) = terms[i - 1], terms[i]
        pair = pair_number.get((a, b))
        if pair is None:
            continue
        most = max(alone[i - 1], alone[i])
        if pair in seg.joints:
            pair_at[i] = pair
            most = max(most, min(seg.joints[pair][1] * max(n_a, n_b), alone[i - 1] + alone[i]))
        together[i] = most
    bound, paired = prefix_bounds(alone, together)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if bound[-1] < needed:
        return none
    first = next(i for i in range(len(terms), -1, -1) if bound[i] < needed)  # terms before it alone never suffice
    total = np.zeros(seg.n_docs, np.int64)
    for t, n in terms[first:]:
        part = seg.lists[t][0]
        total[seg.docs[part]] += seg.impacts[part] * n
        if counter is not None:
            counter["scanned"] += part.stop - part.start
    doc = np.flatnonzero(total)
    score = total[doc]
    i = first
    while i > 0 and len(doc):
        stay = score + bound[i] >= needed
        doc, score = doc[stay], score[stay]
        if not len(doc):
            break
        two = paired[i]
        if two and pair_at[i - 1] is not None:
            part, _ = seg.joints[pair_at[i - 1]]
            at, hit = looked_up(seg.pair_docs[part], doc, counter)
            score[hit] += seg.firsts[part][at] * terms[i - 2][1] + seg.seconds[part][at] * terms[i - 1][1]
            # Those that hold not both gain no more than the larger of the two.
            other = np.flatnonzero(~hit & (score + max(alone[i - 2], alone[i - 1]) + bound[i - 2] >= needed))
            stay = hit.copy()
            stay[other] = True
        else:
            other, stay = np.arange(len(doc)), None
        for j in (i - 2, i - 1) if two else (i - 1,):
            part = seg.lists[terms[j][0]][0]
            at, hit = looked_up(seg.docs[part], doc[other], counter)
            score[other[hit]] += seg.impacts[part][at] * terms[j][1]
        if stay is not None:
            doc, score = doc[stay], score[stay]
        i -= 2 if two else 1
    stay = score >= needed
    doc, score = doc[stay], score[stay]
    if len(doc) > k:  # ties at the last place stay
        stay = score >= np.partition(score, len(score) - k)[len(score) - k]
        doc, score = doc[stay], score[stay]
    return doc, score


def looked_up(docs: np.ndarray, wanted: np.ndarray, counter: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of those found, which are found)."""
    if counter is not None:
        counter["looked up"] += len(wanted)
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    hit = docs[at] == wanted
    return at[hit], hit


class Best:
    """The k best documents of each query so far, equal scores by id with null ids last."""

    def __init__(self, n: int, k: int, needed: list[int]):
        self.k, self.needed = k, list(needed)
        self.rows: list[list[tuple[int, bool, int, int]]] = [[] for _ in range(n)]

    def add(self, query: int, ids: pa.Array, docs: np.ndarray, scores: np.ndarray, segment: int) -> None:
        own = ids.take(pa.array(docs)).to_pylist()
        rows = self.rows[query] + [(-s, i is None, i or 0, segment) for s, i in zip(scores.tolist(), own, strict=True)]
        rows.sort()
        self.rows[query] = rows[: self.k]
        if len(rows) >= self.k:
            self.needed[query] = max(self.needed[query], -rows[self.k - 1][0])


def ranked_in(segments: DataFrame, queries: list[Query], pairs: list[tuple[int, int]], k: int, needed: list[int]) -> DataFrame:
    """(query, doc_id, score, segment): of each task, the k best of each query that score at least what it needs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {p: i for i, p in enumerate(pairs)}
        best = Best(len(queries), k, needed)
        for batch in batches:
            for row in arrays(batch):
                seg = Segment(row)
                for q, query in enumerate(queries):
                    docs, scores = best_of_segment(seg, query, number, k, best.needed[q])
                    if len(docs):
                        best.add(q, seg.ids, docs, scores, row["segment"])
        out = [(q, None if null else i, -s, segment) for q, found in enumerate(best.rows) for s, null, i, segment in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["query", "doc_id", "score", "segment"])

    return segments.mapInArrow(rows, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; those of many tasks meet in parts first, so that no task gathers all."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), "segment")
    part = F.pmod(F.shiftright("segment", 32), F.lit(64))
    found = found.withColumn("at", F.row_number().over(W.partitionBy("query", part).orderBy(*order))).where(F.col("at") <= k)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, text="text", doc_id="doc_id", item_text="text", item_id="item_id", k: int = 20, block_chars: int = 2_000_000, segment_postings: int = 100_000, seed_segments: int = 4) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents with a score above 0."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars + 1
    done = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        words, asked = queries_of([r["text"] for r in own], [r["item_id"] for r in own])
        segments = written(index(slim, words, segment_postings), "segments", LARGE_ROWS)
        n, total, df = statistics(segments, len(words))
        weight = weights(n, df)
        for q in asked:
            order = sorted(range(len(q.terms)), key=lambda i: (weight[q.terms[i]], q.terms[i]))
            q.terms, q.times = [q.terms[i] for i in order], [q.times[i] for i in order]
        pairs = sorted({p for q in asked for p in zip(q.terms, q.terms[1:], strict=False)})
        scored = written(with_impacts(segments, weight, pairs, n, total), "impacts", LARGE_ROWS)
        release(segments)
        needed = [1] * len(asked)
        few = scored.select("segment").orderBy("segment").limit(seed_segments).collect()
        seeds = scored.where(F.col("segment").isin([r[0] for r in few]))
        for r in top(ranked_in(seeds, asked, pairs, k, needed), k).where(F.col("rank") == k).collect():
            needed[r["query"]] = max(1, r["score"])
        found = top(ranked_in(scored, asked, pairs, k, needed), k)
        ids = F.array(*(F.lit(q.item_id).cast("long") for q in asked)) if asked else F.array().cast("array<long>")
        done.append(written(found.select(F.get(ids, F.col("query")).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
        release(scored)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_terms = lambda x: rf"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = (
    f"WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL), "
    f"d AS (SELECT doc_id, {_terms('text')} AS terms FROM documents), n AS (SELECT doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0), s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n), "
    "p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), "
    "w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, big_n), "
    "i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) AS impact FROM p JOIN n USING (doc_id) JOIN w USING (term), s), "
    "r AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(times * impact) > 0) "
    "SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 20"
)
