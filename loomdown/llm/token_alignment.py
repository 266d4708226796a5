r"""How the tokens of two tokenizers lie over each other, and how often pairs of their tokens do so in the corpus.

A is a byte-level BPE over a space and the text, B a sentencepiece model over the text, which adds that space. Both ends of tokens
are byte offsets. The offsets that both lists of ends share cut the tokens into groups, the smallest stretches that both
begin and end together. They are found by galloping: each end of the shorter list searches the longer one outward from where its
neighbour would be, in steps that double until the end is passed, and then by halving. The places found in both lists slice the
groups, and the differences of neighbouring places are how many A tokens lie over which run of B tokens.

Texts are taken in units, which begin at a space or line end with a plain character on both sides. Neither tokenizer joins anything across
such a place (`Pair` checks that of B's pieces; A splits words there), so a unit's tokens and groups are the same in every text. A worker remembers
units it has met, up to `memory` of them of which the most used ones stay, and the rest of the work goes by counts of units.

Counts of pairs are over the whole corpus: the number of documents that hold the pair linked. They are sent to all tasks if there are at
most `sent_pairs` of them, and otherwise joined by pair; the result is the same.

Defined cases: texts that are null, empty, or that either tokenizer does not give back byte by byte with the space have no tokens, zeros and ''. A
row is a document whatever its doc_id, so repeated rows are counted each. Very long texts are read whole, by pieces of units. Of several highest counts of an A id all are best.
Empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, release, table, written

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
NAMES = [x.split()[0] for x in ALIGNED.split(", ")]
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
#: Bytes that may stand before and after the space at which a text is cut. What may belong to a wide or a control character is left out.
PLAIN = np.zeros(256, bool)
PLAIN[0x21:0x7F] = True
LEAD = np.zeros(256, bool)
LEAD[0xC3:0xE0] = True


def gallop(longer: np.ndarray, wanted: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each wanted value the first place of the sorted list that is not below it, by doubling steps from its start, then halving."""
    size = len(longer)
    low = np.clip(start, 0, size)
    high = low.copy()
    # Steps down while the place before is not below the value, steps up while the place is below it.
    down = np.flatnonzero((low > 0) & (longer[np.maximum(low - 1, 0)] >= wanted))
    step = 1
    while len(down):
        high[down] = low[down] - 1
        low[down] = np.maximum(low[down] - step, 0)
        down = down[(low[down] > 0) & (longer[np.maximum(low[down] - 1, 0)] >= wanted[down])]
        step *= 2
    up = np.flatnonzero((high == low) & (low < size) & (longer[np.minimum(low, size - 1)] < wanted))
    step = 1
    while len(up):
        low[up] = high[up] + 1
        high[up] = np.minimum(high[up] + step, size)
        up = up[(high[up] < size) & (longer[np.minimum(high[up], size - 1)] < wanted[up])]
        step *= 2
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        below = longer[middle] < wanted[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


def common_places(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted lists of the values that they share."""
    short, long_ = (a_ends, b_ends) if len(a_ends) <= len(b_ends) else (b_ends, a_ends)
    if not len(short):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = gallop(long_, short, np.arange(len(short)) * len(long_) // len(short))
    hit = np.flatnonzero((at < len(long_)) & (long_[np.minimum(at, len(long_) - 1)] == short))
    return (hit, at[hit]) if short is a_ends else (at[hit], hit)


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers from each begin on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class Pair:
    """Two tokenizers with their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.a_bytes = {i: bytes(byte_of.get(c, 0) for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in map(self.b.id_to_piece, range(self.b.vocab_size()))):
            raise ValueError("a piece of B spans a space or a line end inside; texts can't be cut there")

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def whole(self, text: str) -> tuple[list[int], list[int]] | None:
        """(A's ids, B's ids) of a space and the text, or None if the bytes of either are others."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        data = (" " + text).encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
        return (a, b) if same else None


def unit_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where units begin: at each text, and at each space or line end with plain characters on both sides."""
    gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
    gap = gap[(gap > 1) & (gap < len(data) - 1)]
    before, after = data[gap - 1], data[gap + 1]
    left = PLAIN[before] | ((before >= 0x80) & LEAD[data[gap - 2]])
    return np.union1d(text_starts, gap[left & (PLAIN[after] | LEAD[after])])


class Memory:
    """Units by number: their tokens' counts, groups as text and linked pairs. A unit that has no alignment has a count of -1."""

    def __init__(self, pair: Pair, memory: int):
        self.pair, self.memory = pair, memory
        self.a_text = {i: str(i) for i in pair.a_bytes}
        self.b_text = [str(i) for i in range(len(pair.b_bytes))]
        self.a_size = np.zeros(max(pair.a_bytes) + 1, np.int64)
        self.a_size[list(pair.a_bytes)] = [len(x) for x in pair.a_bytes.values()]
        self.b_size = np.array([len(x) for x in pair.b_bytes], np.int64)
        self.number: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.uses = np.empty(0, np.int64)
        self.sizes = np.empty((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.pairs = np.empty(0, np.int64)  # of all units in turn, those of a unit once each
        self.times = np.empty(0, np.int64)
        self.bounds = np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keeps the units that were used most, half of what the memory holds."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.memory // 2])
        units = list(self.number)  # in the order of their numbers
        self.number = {units[i]: k for k, i in enumerate(kept.tolist())}
        self.groups = [self.groups[i] for i in kept.tolist()]
        many = np.diff(self.bounds)[kept]
        at = ranges(self.bounds[kept], many)
        self.pairs, self.times = self.pairs[at], self.times[at]
        self.bounds = np.concatenate(([0], np.cumsum(many)))
        self.uses, self.sizes = self.uses[kept] // 2, self.sizes[kept]

    def numbers(self, units: list[bytes], uses: np.ndarray) -> np.ndarray:
        if len(self.number) + len(units) > self.memory and self.number:
            self.forget()
        new = [u for u in units if u not in self.number]
        if new:
            self.learn(new)
        out = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        self.uses[out] += uses
        return out

    def learn(self, units: list[bytes], together: int = 500) -> None:
        """Encodes units that both begin with a gap and end with something else in rows, each other one alone."""
        texts = [u.decode() for u in units]
        rows = [i for i, t in enumerate(texts) if t[0] in " \n" and t[1:].isprintable() and "  " not in t and t[-1] not in " \n" and "▁" not in t]
        coded: list = [None] * len(units)
        alone = set(range(len(units))) - set(rows)
        for k in range(0, len(rows), together):
            part = rows[k : k + together]
            # Behind a unit of two bytes, as the first one must begin with a space.
            found = self.pair.whole("x" + "".join([texts[i] for i in part]))
            cuts = []
            if found:
                upto = 2 + np.cumsum([0, *(len(units[i]) for i in part)])
                for ids, size in zip(found, (self.a_size, self.b_size), strict=True):
                    ends = np.cumsum(size[np.array(ids)])
                    at = np.searchsorted(ends, upto)
                    if (ends[np.minimum(at, len(ends) - 1)] == upto).all():
                        cuts.append((at + 1).tolist())
            if len(cuts) < 2:  # something in the row is not given back
                alone.update(part)
                continue
            a, b = found
            for j, i in enumerate(part):
                coded[i] = a[cuts[0][j] : cuts[0][j + 1]], b[cuts[1][j] : cuts[1][j + 1]]
        for i in alone:
            coded[i] = self.alone(texts[i])
        self.add(units, coded)

    def alone(self, text: str) -> tuple[list[int], list[int]] | None:
        """A unit at the beginning of a text stands behind the space that is put there; another one, behind a unit of two bytes."""
        if text[0] == " ":
            return self.pair.whole(text[1:])
        found = self.pair.whole("x" + text)
        return found and (found[0][1:], found[1][1:])

    def add(self, units: list[bytes], coded: list) -> None:
        """Aligns the units' tokens, all in one row, and remembers what comes of it."""
        good = np.array([c is not None for c in coded])
        a_many, b_many = (np.array([len(c[k]) if c else 0 for c in coded], np.int64) for k in (0, 1))
        a_ids, b_ids = ([i for c in coded if c for i in c[k]] for k in (0, 1))
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_cut, b_cut = (x + 1 for x in common_places(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])))
        a_at, b_at = np.concatenate(([0], a_cut)), np.concatenate(([0], b_cut))
        a_in, b_in = np.diff(a_at), np.diff(b_at)
        # Each unit ends where its tokens and a group end.
        upto = np.concatenate(([0], np.searchsorted(a_cut, np.cumsum(a_many), "right")))
        a_text, b_text = [self.a_text[i] for i in a_ids], [self.b_text[i] for i in b_ids]
        x, y = a_at.tolist(), b_at.tolist()
        groups = [(a_text[p] if q - p == 1 else ",".join(a_text[p:q])) + "|" + (b_text[r] if t - r == 1 else ",".join(b_text[r:t])) for p, q, r, t in zip(x[:-1], x[1:], y[:-1], y[1:], strict=True)]
        low = upto.tolist()
        self.groups += [";".join(groups[p:q]).encode() for p, q in zip(low[:-1], low[1:], strict=True)]
        # All pairs of each group: each A token with the group's run of B tokens.
        group = np.repeat(np.arange(len(a_in)), a_in)
        linked = (np.repeat(a, b_in[group]) << 32) | b[ranges(b_at[:-1][group], b_in[group])]
        links = np.diff(np.concatenate(([0], np.cumsum(a_in * b_in)))[upto])
        unit = np.repeat(np.arange(len(units)), links)
        order = np.lexsort((linked, unit))
        linked, unit = linked[order], unit[order]
        new = np.flatnonzero(np.concatenate(([True], (linked[1:] != linked[:-1]) | (unit[1:] != unit[:-1])))) if len(linked) else np.empty(0, np.int64)
        at = len(self.number)
        self.number.update(zip(units, range(at, at + len(units)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.stack([np.where(good, a_many, -1), b_many, np.diff(upto), links], axis=1)])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])
        self.pairs = np.concatenate([self.pairs, linked[new]])
        self.times = np.concatenate([self.times, np.diff(np.append(new, len(linked)))])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.bincount(unit[new], minlength=len(units)))])


def with_space(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), pa.scalar(""))


def aligned(memory: Memory, texts: pa.Array, window: int = 1 << 23) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of each text; zeros and '' for one that has no alignment."""
    data, offsets = byte_view(with_space(texts))
    starts = unit_starts(data, offsets[:-1])
    bounds = np.append(starts, len(data))
    doc_of_unit = np.searchsorted(offsets, starts, "right") - 1
    n = len(texts)
    sizes = np.zeros((n, 4), np.int64)
    bad = np.diff(offsets) <= 1
    hashes = [hashlib.sha256() for _ in range(n)]
    begun = [False] * n
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    # Units are taken by windows of bytes, which bounds what is in memory beside the texts.
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data) + window, window)))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        flat = pa.BinaryArray.from_buffers(pa.binary(), int(high - low), [None, pa.py_buffer((bounds[low : high + 1] - bounds[low]).astype(np.int32)), pa.py_buffer(data[bounds[low] : bounds[high]])])
        coded = pc.dictionary_encode(flat)
        index = coded.indices.to_numpy()
        number = memory.numbers(coded.dictionary.to_pylist(), np.bincount(index, minlength=len(coded.dictionary)))[index]
        doc = doc_of_unit[low:high]
        bad[doc[memory.sizes[number, 0] < 0]] = True
        edges = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)])).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d = int(doc[a])
            if bad[d]:
                continue
            own = number[a:b]
            sizes[d] += memory.sizes[own].sum(axis=0)
            text = b";".join([memory.groups[i] for i in own.tolist()])
            hashes[d].update(b";" + text if begun[d] else text)
            begun[d] = True
            unit, times = np.unique(own, return_counts=True)
            many = memory.bounds[unit + 1] - memory.bounds[unit]
            at = ranges(memory.bounds[unit], many)
            held[d].append((memory.pairs[at], memory.times[at] * np.repeat(times, many)))
    out = []
    for d in range(n):
        if bad[d]:
            out.append((0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)))
            continue
        pairs, back = np.unique(np.concatenate([p for p, _ in held[d]]), return_inverse=True)
        links = np.bincount(back, np.concatenate([t for _, t in held[d]]), len(pairs)).astype(np.int64)
        out.append((*sizes[d].tolist(), hashes[d].hexdigest(), pairs, links))
    return out


def aligned_rows(docs: DataFrame, a_path: str, b_path: str, memory: int) -> DataFrame:
    """Each document's alignment, its digest and its distinct linked pairs (A id * 2**32 + B id) with their numbers of links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_units(a_path, b_path, memory)
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                columns = list(zip(*aligned(known, part["text"]), strict=True))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in c]))), pa.int32()), np.concatenate(c)) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), *lists], NAMES)

    return docs.mapInArrow(rows, ALIGNED)


_known: dict[tuple, Memory] = {}


def known_units(a_path: str, b_path: str, memory: int) -> Memory:
    """One for each Python worker."""
    key = (a_path, b_path, memory)
    if key not in _known:
        _known[key] = Memory(Pair(a_path, b_path), memory)
    return _known[key]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each pair linked, and whether none of its A id's pairs has more."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "pairs")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with n_best and count_sum, by counts that every task holds: 24 bytes a pair, sent once to each executor."""
    got = counts.orderBy("pair").toPandas()
    sent = rows.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(np.int64), got["count"].to_numpy(np.int64), got["best"].to_numpy(bool)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for batch in batches:
            bounds = batch["pairs"].offsets.to_numpy()
            pairs, links = (batch[c].values.to_numpy()[bounds[0] : bounds[-1]] for c in ("pairs", "links"))
            at = np.searchsorted(pair, pairs)
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (links * best[at], links * count[at])]
            bounds = bounds - bounds[0]
            n_best, count_sum = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in NAMES[:6]), pa.array(n_best), pa.array(count_sum)], [*NAMES[:6], "n_best", "count_sum"])

    return rows.mapInArrow(add, COUNTED)


def joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """As looked_up(), by a join of pairs: for counts too many to send. Hot pairs go to `parts` tasks, to which their counts are copied."""
    parts = 16
    numbered = written(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    held = numbered.select("number", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("number", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"), F.pmod("number", F.lit(parts)).alias("part"))
    copies = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    sums = held.join(copies, ["pair", "part"]).groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    full = numbered.join(sums, "number", "left")
    return full.select(*NAMES[:6], F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))


def alignment(docs: DataFrame, a_path: str, b_path: str, text="text", doc_id="doc_id", sent_pairs: int = 4_000_000, memory: int = 400_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(aligned_rows(slim, a_path, b_path, memory), "aligned")
    counts = written(pair_counts(rows), "pair-counts")
    few = counts.count() <= sent_pairs
    out = looked_up(rows, counts) if few else joined(rows, counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
