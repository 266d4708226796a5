"""N-gram Jaccard join by partition of the universe.

Documents are sets of hashed word shingles. Two sets with Jaccard similarity t or more differ in at most
(|r| + |s|) * (1 - t) / (1 + t) elements. In each size band, elements are hashed to segments so that by the pigeonhole
principle a linking pair agrees on a whole segment, or differs by at most one element in a segment for which
the one-deletion neighbourhood is indexed. How many segments of each kind a band has follows from a cost estimate: the
signatures written against the pairs that would meet by chance among the band's sets.

1. Equal sets fall into classes by a 128-bit hash; one document stands for each class.
2. One part of the universe, `slice_share` of it, tells which elements stand in one class only. A class with more of these than linking sets may
   differ in links with nothing, and goes no further. The part is counted whole, for all classes.
3. Each class left writes its signatures. The members of a bucket of equal signatures look to its hub, the one that shares most signatures with
   others, and each class is compared with that hub to which most of its buckets make it look: one pair for a class at most. Verified
   links give first components.
4. Buckets whose members all lie in one component can add nothing. In the others, each member outside the bucket's
   most frequent component is compared with all members of other components. Those pairs that pass two exact lower bounds
   (parity sketches) are verified on the whole texts, and the components follow from both sets of links.

No bucket is capped, and no pair of different components that shares a signature goes unverified, so that the components
are those of all links.

Defined cases: a null or blank text has no shingles and links with nothing; with fewer words than the width the whole
sequence is the only shingle. Rows that repeat a doc_id are looked at row by row. A row with a null doc_id gets a null
component. Very long texts are read whole; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written
from .graph import components
from .line_dedup import mix64

SKETCH_WORDS = 8
ODD, LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**32 - 1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of the shingles of a text, in ascending order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix64(out * ODD + h[i : len(h) - width + 1 + i], i + 1)
    return np.unique(out)


class Scheme:
    """Size bands, and for each the number of segments with exact and with one-deletion signatures."""

    def __init__(self, percent: int, counts: dict[int, int], top: int, growth: float = 1.5):
        """counts: sets by size, rounded as in `rounded`; top: the largest size."""
        self.percent, self.lows = percent, [1]
        while self.lows[-1] <= top * 100 // percent + 1:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * growth)))
        self.low_array = np.array(self.lows)
        in_band = np.zeros(len(self.lows))
        for n, c in counts.items():
            for b in self.bands(n):
                in_band[b] += c
        self.segments = [self.allocate(self.lows[b + 1] - 1, in_band[b]) for b in range(len(self.lows) - 1)]

    def differ(self, size: int) -> int:
        """The most elements in which linking sets of up to `size` elements differ."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def survivors(self, size: int, exact: int, deletion: int) -> int:
        """Segments on which a linking pair agrees at least: a difference spoils an exact one, two spoil another."""
        differ = self.differ(size)
        return exact + deletion - min(exact, differ) - max(0, differ - exact) // 2

    def allocate(self, size: int, sets: float) -> tuple[int, int]:
        """(exact, deletion) segments for sets of up to `size` elements, at the least estimated cost for one set."""
        differ = self.differ(size)
        best, choice = math.inf, (differ + 1, 0)
        for deletion in range(0, differ // 2 + 2, max(1, differ // 40)):
            exact = max(0, differ + 1 - 2 * deletion)
            while True:
                mean = 0.85 * size / (exact + deletion)
                thin = exact * math.exp(-mean) + deletion * math.exp(-mean) * (1 + mean)
                if exact > 2 * differ + 2 or self.survivors(size, exact, deletion) > thin + 3 * math.sqrt(thin):
                    break
                exact += 1
            # Pairs that meet without linking have few elements in common, here one in twenty.
            by_chance = (exact * math.exp(-2 * mean) + deletion * (mean + 1) * math.exp(-2 * max(0.0, mean - 1))) * mean / 20
            cost = exact + deletion * (mean + 1) + sets * by_chance
            if cost < best:
                best, choice = cost, (exact, deletion)
        return choice

    def bands(self, size: int) -> range:
        """The bands in which a set of this size can be the smaller or the larger of a pair."""
        first, last = np.searchsorted(self.low_array, [size, size * 100 // self.percent], "right") - 1
        return range(int(first), int(last) + 1)

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """The signatures of a set in all its bands.

        A segment that is empty, or one element short of it where deletions count, is thin. Thin segments agree among all sorts of sets.
        If a set has fewer of them than segments survive, a linking pair agrees on another segment too, and they are left out.
        """
        value, out = mix64(elements, 11), []
        for b in self.bands(len(elements)):
            exact, deletion = self.segments[b]
            count = exact + deletion
            of = (mix64(elements, 12 + b) % np.uint64(count)).astype(np.int64)
            sums, sizes = np.zeros(count, np.uint64), np.bincount(of, minlength=count)
            np.add.at(sums, of, value)
            base = mix64(np.arange(count, dtype=np.uint64) + np.uint64(b << 32), 13)
            near = np.flatnonzero(of < deletion)
            seg = np.concatenate([np.arange(count), of[near]])
            left = np.concatenate([sizes, sizes[of[near]] - 1])  # elements behind each signature
            part = np.concatenate([sums, sums[of[near]] - value[near]])
            thin = np.count_nonzero(sizes[deletion:] == 0) + np.count_nonzero(sizes[:deletion] <= 1)
            if thin < self.survivors(self.lows[b + 1] - 1, exact, deletion):
                seg, part = seg[left > 0], part[left > 0]
            out.append(mix64(part ^ base[seg], 14))
        return np.unique(np.concatenate(out))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements by hash: two sets differ in at least as many elements as their sketches in bits."""
    bits = np.bincount((mix64(elements, 5) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


#: Signatures only name candidates, so bits may go: six bytes of each are written, and a shard's rows hold four.
WIDTH = 6


def to_bytes(signatures: np.ndarray) -> bytes:
    """The upper six bytes of each."""
    return signatures.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, 8 - WIDTH :] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").reshape(-1)


def fine_sketch(elements: np.ndarray) -> bytes:
    """Parities at about two places for each element; the halves of a longer one, combined, are one of half the length."""
    places = max(512, 1 << int(2 * len(elements) - 1).bit_length())
    return np.packbits((np.bincount((mix64(elements, 6) % np.uint64(places)).astype(np.int64), minlength=places) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ."""
    x, y = (np.frombuffer(k, np.uint8) for k in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def linked(r: np.ndarray, s: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(r, s, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(r) + len(s) - both)


def classes_of(docs: DataFrame, width: int, slice_share: float) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, part): equal sets have equal keys; part: the elements in `slice_share` of the universe, packed."""
    below = np.uint64(slice_share * 2**32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, part = [], [], [], []
            for text in batch["text"].to_pylist():
                e = shingle_set(text, width)
                mixed = mix64(e, 3)
                n.append(len(e))
                k1.append(mixed.sum(dtype=np.uint64))
                k2.append(mix64(e, 4).sum(dtype=np.uint64))
                part.append(to_bytes(e[mixed & LOW < below]))
            keys = [np.array(k, np.uint64).view(np.int64) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), *map(pa.array, keys), pa.array(part, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "part"])

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, k1 long, k2 long, part binary")


def signature_rows(docs: DataFrame, width: int, scheme: Scheme) -> DataFrame:
    """(rep, n, sketch, fine, sigs) of documents that stand for their classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sketches, fine, sigs = [], [], [], []
            for text in batch["text"].to_pylist():
                e = shingle_set(text, width)
                n.append(len(e))
                sketches.append(sketch(e))
                fine.append(fine_sketch(e))
                sigs.append(to_bytes(scheme.signatures(e)))
            packed = [pa.array(x, pa.binary()) for x in (fine, sigs)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), *packed], ["rep", "n", "sketch", "fine", "sigs"])

    return docs.mapInArrow(rows, "rep long, n long, sketch array<long>, fine binary, sigs binary")


def repeated_members(signed: DataFrame, id_type: str, shards_log2: int = 10, local_hot: int = 64) -> DataFrame:
    """(sig, rep) of the signatures that at least two representatives have.

    Most signatures are alone. They travel to shards as packed arrays, four bytes each and those of the representative, and numpy drops
    them there. shards_log2: with more, shards are smaller and more bits of a signature count. A signature that more than `local_hot` rows of one batch have sends only two of them to its shard, which keeps the others' rows of it
    alive; the other rows of it in that batch form a group of their own, so that no shard grows with a large group of copies.
    Rows that repeat a representative count once.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            reps, once = np.unique(batch["rep"].to_numpy(), return_index=True)
            lists = batch["sigs"].take(pa.array(once)).to_pylist()
            sig = from_bytes(b"".join(lists)) >> np.uint64(32 - shards_log2)  # the shard, then 32 bits
            rep = np.repeat(reps, [len(x) // WIDTH for x in lists]).astype(id_type)
            order = np.argsort(sig, kind="stable")
            sig, rep = sig[order], rep[order]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.empty(0, np.int64)
            size = np.diff(np.append(first, len(sig)))
            place = np.arange(len(sig)) - np.repeat(first, size)
            hot = np.repeat(size > local_hot, size)
            groups: list[tuple] = []
            for salt, chosen in ((0, ~hot | (place < 2)), (1 + number * 65536 + int(rep[0] % 65536) if len(rep) else 1, hot & (place > 1))):
                s, r = sig[chosen], rep[chosen]
                cuts = np.searchsorted(s >> np.uint64(32), np.arange(2**shards_log2 + 1, dtype=np.uint64))
                groups += [(k, salt, s[a:b].astype("<u4").tobytes(), r[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            if groups:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*groups, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "salt", "sigs", "reps"])

    def keep(group: pa.Table) -> pa.Table:
        sig, rep = (np.frombuffer(b"".join(group[k].to_pylist()), kind) for k, kind in (("sigs", "<u4"), ("reps", id_type)))
        if not group["salt"][0].as_py():
            order = np.lexsort((rep, sig))
            sig, rep = sig[order], rep[order]
            same = sig[1:] == sig[:-1]
            new = np.concatenate(([True], ~(same & (rep[1:] == rep[:-1]))))[: len(sig)]
            sig, rep = sig[new], rep[new]
            same = sig[1:] == sig[:-1]
            again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            sig, rep = sig[again], rep[again]
        return pa.table({"sig": (group["shard"][0].as_py() << 32) + sig.astype(np.int64), "rep": rep.astype(np.int64)})

    packed = signed.select("rep", "sigs").mapInArrow(pack, "shard int, salt long, sigs binary, reps binary")
    return packed.groupBy("shard", "salt").applyInArrow(keep, "sig long, rep long")


def within_reach(percent: int, a: str = "a", b: str = "b"):
    """A condition that every linking pair meets: the sketches of n_a and n_b elements differ in few enough bits."""
    bits = sum(F.bit_count(F.get(f"sketch_{a}", F.lit(i)).bitwiseXOR(F.get(f"sketch_{b}", F.lit(i)))) for i in range(SKETCH_WORDS))
    return (100 + percent) * bits <= (100 - percent) * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def sifted(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose fine sketches let them link."""
    side = lambda k: signed.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("fine").alias(f"fine_{k}")).dropDuplicates([k])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [least_difference(a, b) for a, b in zip(batch["fine_a"].to_pylist(), batch["fine_b"].to_pylist(), strict=True)]
            both = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
            near = pa.array((100 + percent) * np.array(bits, np.int64) <= (100 - percent) * both)
            yield pa.RecordBatch.from_arrays([batch[k].filter(near) for k in ("a", "b")], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(rows, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; pairs: written."""
    side = lambda k: texts.join(pairs.select(F.col(k).alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for ta, tb in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                if ta != last[0]:
                    last = (ta, shingle_set(ta, width))
                keep.append(linked(last[1], shingle_set(tb, width), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch[k].filter(mask) for k in ("a", "b")], ["a", "b"])

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long").distinct()


def linking(pairs: DataFrame, signed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that link, as a written table."""
    near = written(sifted(pairs, signed, percent), "jaccard-pairs")
    out = written(verified(near, texts, width, percent), "jaccard-links")
    release(near)
    return out


def not_alone(keyed: DataFrame, percent: int) -> DataFrame:
    """(n_shingles, k1, k2, rep) of the classes that may link: few enough of their elements are in no other class.

    An element found alone is alone; one that only seems to be shared, as 42 bits of it agree with another's, lets its class stay.
    """
    classes = keyed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2")
    classes = classes.agg(F.min("doc_id").alias("rep"), (F.min(F.octet_length("part")) / WIDTH).alias("size"))
    shared = repeated_members(keyed.where("n_shingles > 0 and doc_id is not null").select(F.col("k1").alias("rep"), F.col("part").alias("sigs")), "<i8")
    shared = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("shared")).withColumnRenamed("rep", "k1")
    alone = F.col("size") - F.coalesce("shared", F.lit(0))
    return classes.join(shared, "k1", "left").where(100 * alone <= (100 - percent) * F.col("n_shingles")).select("n_shingles", "k1", "k2", "rep")


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, percent: int = 90, slice_share: float | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; slice_share: 1.5 times the share in which a set may differ, if not given."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parted = written(classes_of(docs, width, min(1.0, 0.015 * (100 - percent) if slice_share is None else slice_share)), "jaccard-parts")
    classes = written(not_alone(parted, percent), "jaccard-classes")
    keyed = written(parted.drop("part"), "jaccard-keys")
    release(parted)
    # Sizes as read from a table of at most a few hundred rows: rounded down to two leading digits of a power of 1.05.
    rounded = F.floor(F.pow(F.lit(1.05), F.floor(F.ln("n_shingles") / math.log(1.05)))).cast("long")
    sizes = classes.groupBy(rounded.alias("n")).agg(F.count(F.lit(1)).alias("c"), F.max("n_shingles").alias("top")).collect()
    scheme = Scheme(percent, {r["n"]: r["c"] for r in sizes}, max([1, *(r["top"] for r in sizes)]))

    # Neither side of this join is bounded, so small inputs take the same way as large ones.
    texts = written(docs.join(classes.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "jaccard-texts")
    signed = written(signature_rows(texts, width, scheme), "jaccard-signatures")
    ends = classes.agg(F.min("rep"), F.max("rep")).first()
    id_type = "<u4" if ends[0] is not None and ends[0] >= 0 and ends[1] < 2**32 else "<i8"
    members = written(repeated_members(signed, id_type), "jaccard-repeated")
    # Stars are built around the members that share the most with others: the original of many near copies links with each of them
    # where two copies may not link, so that only what links with no such member is left for the pairs below.
    many = members.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    degrees = members.join(many, "sig").groupBy("rep").agg(F.sum("c").alias("degree"))
    lows = members.join(degrees, "rep").groupBy("sig").agg(F.max_by("rep", F.struct("degree", F.negative("rep"))).alias("low"))

    shared = members.join(lows, "sig").where("low <> rep").groupBy("rep", "low").agg(F.count(F.lit(1)).alias("c"))
    star = shared.groupBy("rep").agg(F.max_by("low", F.struct("c", F.negative("low"))).alias("low")).select(F.least("low", "rep").alias("a"), F.greatest("low", "rep").alias("b"))
    links = linking(star, signed, texts, width, percent)
    labels = written(components(links), "jaccard-labels")

    labelled = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", F.coalesce("component", "rep").alias("label"))
    labelled = written(labelled, "jaccard-labelled")
    parts = labelled.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("sig").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("sig", "main")
    info = signed.select("rep", "n", "sketch").dropDuplicates(["rep"])
    open_ = written(labelled.join(main, "sig").join(info, "rep"), "jaccard-open")
    left = open_.where("label <> main").select("sig", F.col("rep").alias("x"), F.col("label").alias("label_x"), F.col("n").alias("n_x"), F.col("sketch").alias("sketch_x"))
    right = open_.select("sig", F.col("rep").alias("y"), (F.col("label") == F.col("main")).alias("in_main"), F.col("label").alias("label_y"), F.col("n").alias("n_y"), F.col("sketch").alias("sketch_y"))
    meet = (left["sig"] == right["sig"]) & (F.col("label_x") != F.col("label_y")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & within_reach(percent, "x", "y")
    more = left.join(right, meet).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = linking(more, signed, texts, width, percent)
    release(members, labelled, open_, signed, texts)
    # The second round's links are between components of the first.
    joined = more.join(labels.select(F.col("node").alias("a"), F.col("component").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("lb")), "b", "left")
    joined = components(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    final = labels.withColumnRenamed("component", "label").unionByName(joined.select("node", F.col("node").alias("label"))).distinct()
    final = final.groupBy("node").agg(F.min("label").alias("label")).join(joined.withColumnsRenamed({"node": "label", "component": "top"}), "label", "left").select("node", F.coalesce("top", "label").alias("component"))

    class_top = classes.join(final.withColumnRenamed("node", "rep"), "rep").select("n_shingles", "k1", "k2", F.col("component").alias("component_id"))
    # A class that links with none still holds its copies: its smallest doc_id stands for them.
    alone = keyed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("first_id"))
    tops = alone.join(class_top, ["n_shingles", "k1", "k2"], "left").select("n_shingles", "k1", "k2", F.coalesce("component_id", "first_id").alias("component_id"))
    out = keyed.join(tops, ["n_shingles", "k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""
