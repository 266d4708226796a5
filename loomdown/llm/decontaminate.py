"""Benchmark decontamination by greedy string tiling.

Benchmark items are cut into seeds: Karp-Rabin fingerprints of `min_match` words. A document that shares seeds with an
item is tiled against it: the longest common run of words that touches no marked word is marked in both, again and
again, until no run of `min_match` words is left. The share of the item's words under tiles is its coverage, wherever and in
whichever order its parts stand, so that passages with moved sentences are caught too.

The benchmark is a stated query set. It is read in blocks of about `block_chars` characters, each small enough to be sent to all
tasks whatever the benchmark's size, and every block is held against all rows.

Runs that repeat make many pairs of places. Where there are more than a few for each word, the longest run is found by
halving over lengths with window fingerprints of what is unmarked, in which equal runs meet as one; the tiles are the same.

Defined cases: words are runs of letters, digits and underscores, lower-cased. An item of fewer than `min_match` words
must stand in the document whole; one without words matches nothing. Null and empty texts match nothing. Items with equal texts are
reported each. Of equally long runs the first in the item, then in the document, is marked first. Very long texts are searched whole. Repeated
rows of a doc_id give one row with the best coverage; rows with a null doc_id give a null one. Empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BASE = np.uint64(0x9E3779B97F4A7C15)
WORDS = re.compile(r"\w+")


def word_hashes(text: str | None) -> np.ndarray:
    words = WORDS.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def fingerprints(words: np.ndarray, width: int) -> np.ndarray:
    """The Karp-Rabin value of each window of `width` words, modulo 2 ** 64."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = out * BASE + words[i : len(words) - width + 1 + i]
    return out ^ (out >> np.uint64(31))


def long_fingerprints(words: np.ndarray, width: int) -> np.ndarray:
    """As fingerprints(), in a number of steps that grows with the logarithm of the width."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    out, size = words.astype(np.uint64), 1
    for bit in bin(width)[3:]:
        out, size = out[:-size] * np.uint64(pow(int(BASE), size, 2**64)) + out[size:], 2 * size
        if bit == "1":
            out, size = out[:-1] * BASE + words[size:], size + 1
    return out ^ (out >> np.uint64(31))


class Seeds:
    """The items of a block by the fingerprints of their windows."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t) for _, t in items]
        self.widths = [min(min_match, len(w)) for w in self.words]
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({w for w in self.widths if w}):
            rows = [(k, fingerprints(self.words[k], width)) for k, w in enumerate(self.widths) if w == width]
            prints = np.concatenate([p for _, p in rows])
            order = np.argsort(prints, kind="stable")
            item = np.concatenate([np.full(len(p), k) for k, p in rows])[order]
            at = np.concatenate([np.arange(len(p)) for _, p in rows])[order]
            self.by_width[width] = prints[order], item, at

    def shared(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places in the item) of each item with a seed in the document."""
        for width, (prints, item, at) in self.by_width.items():
            own = np.unique(fingerprints(words, width))
            first = np.searchsorted(prints, own, "left")
            hit = np.flatnonzero((first < len(prints)) & (prints[np.minimum(first, len(prints) - 1)] == own))
            if not len(hit):
                continue
            first, last = first[hit], np.searchsorted(prints, own[hit], "right")
            many = last - first
            entry = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
            entry = entry[np.argsort(item[entry], kind="stable")]
            cuts = np.flatnonzero(np.diff(item[entry])) + 1
            for part in np.split(entry, cuts):
                yield int(item[part[0]]), np.sort(at[part])


def common_places(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of places with equal windows, or None if there are more than a few for each word."""
    x, y = fingerprints(a, width)[a_at], fingerprints(b, width)
    order = np.argsort(y, kind="stable")
    first, last = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
    many = last - first
    if many.sum() > 16 * (len(a) + len(b)):
        return None
    entry = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
    return np.repeat(a_at, many), order[entry]


def tiles_by_length(a: np.ndarray, b: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling as tiles() gives it, without pairs of places."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)

    def windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, places) of the windows of free words."""
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return long_fingerprints(words, size)[at], at

    def meets(size: int) -> bool:
        return size <= min(len(a), len(b)) and bool(np.isin(windows(a, free_a, size)[0], windows(b, free_b, size)[0]).any())

    out, most = [], min(len(a), len(b))
    while True:
        low, high = width - 1, most + 1  # runs of `low` words or no tile at all; none of `high`
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if meets(middle) else (low, middle)
        if low < width:
            return out
        x, x_at = windows(a, free_a, low)
        y, y_at = windows(b, free_b, low)
        order = np.argsort(y, kind="stable")
        y, y_at = y[order], y_at[order]
        next_ = np.searchsorted(y, x, "left")  # the first of the places with this window that may be free
        cursor: dict[int, int] = {}
        for value, i, at in zip(x.tolist(), x_at.tolist(), next_.tolist(), strict=True):
            if not free_a[i : i + low].all():
                continue
            k = cursor.get(value, at)
            while k < len(y) and y[k] == value and not free_b[y_at[k] : y_at[k] + low].all():
                k += 1
            cursor[value] = k
            if k < len(y) and y[k] == value:
                j = int(y_at[k])
                free_a[i : i + low] = free_b[j : j + low] = False
                out.append((i, j, low))
        most = low - 1


def tiles(item_at: np.ndarray, doc_at: np.ndarray, width: int, n_item: int, n_doc: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from shared seeds: (place in the item, place in the document, length), longest first."""
    diagonal = doc_at - item_at
    order = np.lexsort((item_at, diagonal))
    i, d = item_at[order], diagonal[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 0) | (np.diff(i) != 1))))
    ends = np.append(new[1:], len(i))
    heap = [(-(int(b - a) + width - 1), int(i[a]), int(i[a] + d[a])) for a, b in zip(new, ends, strict=True)]
    heapq.heapify(heap)
    used_item, used_doc = np.zeros(n_item, bool), np.zeros(n_doc, bool)
    out = []
    while heap:
        size, x, y = heapq.heappop(heap)
        free = ~(used_item[x : x - size] | used_doc[y : y - size])
        if free.all():
            used_item[x : x - size] = used_doc[y : y - size] = True
            out.append((x, y, -size))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= width:
                heapq.heappush(heap, (-int(b - a), x + int(a), y + int(a)))
    return out


def best_tilings(seeds: Seeds, text: str | None, coverage: float) -> Iterator[tuple[int, float, int, int]]:
    """(item_id, coverage, tiles, longest tile) of the items covered to at least `coverage`."""
    words = word_hashes(text)
    for k, item_at in seeds.shared(words):
        n, width = len(seeds.words[k]), seeds.widths[k]
        reach = np.zeros(n + 1, np.int64)  # words that any seed touches: tiles can cover no more
        np.add.at(reach, item_at, 1)
        np.add.at(reach, item_at + width, -1)
        if np.count_nonzero(np.cumsum(reach[:-1])) < coverage * n:
            continue
        pairs = common_places(seeds.words[k], words, item_at, width)
        found = tiles(*pairs, width, n, len(words)) if pairs else tiles_by_length(seeds.words[k], words, width)
        share = sum(t[2] for t in found) / n
        if share >= coverage:
            yield seeds.ids[k], share, len(found), found[0][2]


def contaminated(docs: DataFrame, benchmark: DataFrame, text="text", doc_id="doc_id", item_text="text", item_id="item_id", min_match: int = 5, coverage: float = 0.6, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for each document and each item that it contains."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // block_chars + 1
    schema = "doc_id long, item_id long, coverage double, n_tiles long, longest long"

    def search(block: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        seeds = Seeds([(r["item_id"], r["text"]) for r in own], min_match)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(i, *found) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for found in best_tilings(seeds, t, coverage)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out, strict=True))], ["doc_id", "item_id", "coverage", "n_tiles", "longest"])

        return written(slim.mapInArrow(rows, schema), "tiles")

    # A block's results are written before the next one is read, so that one block at a time is in memory.
    found = search(0)
    for block in range(1, blocks):
        found = found.unionByName(search(block))
    best = F.max_by(F.struct("n_tiles", "longest"), F.struct("coverage", "longest"))
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), best.alias("b")).select("doc_id", "item_id", "coverage", "b.n_tiles", "b.longest")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)
