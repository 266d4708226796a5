"""Line deduplication by sharded minimal perfect hashing.

Every line's key (stripped of blanks, A-Z lower-cased) has a 128-bit hash. The hashes of keys that at least two
documents hold are dealt to shards; each shard gets a minimal perfect hash whose slots index three compact arrays:
a 64-bit fingerprint, the number of documents and the smallest doc_id that holds the key. Documents probe these arrays. The number of shards
follows that of keys and that of probes, so that both fit in a task.

Keys with more than `hot_share` of all (document, key) pairs are at most 1 / hot_share; their arrays go to every task,
which probes them while it reads. The other probes, 24 bytes each, travel to their shard, where no key has more than
`hot_share` of them. A document's verdicts return to it by doc_id. Two keys are taken for one only if all 128 bits agree.

Defined cases: a null or empty text is one empty line. Keys under `min_chars` code points are never dropped. Repeated rows
of one doc_id count as one document and get one row each, and among documents the smallest doc_id keeps the line. Rows with a null doc_id keep all
lines and do not count. Very long texts are split whole. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import BLANKS, written

STRIP = BLANKS.encode()


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit numbers for each seed."""
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys.

    Keys are thrown at a bit array twice their number; those that fall alone keep their bit and the others go on to a
    next, smaller array. A key's slot is the rank of its bit over all arrays, so n keys use the slots 0 to n - 1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.concatenate(([0], np.cumsum(bits)))[:-1])
            at += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            at = mix64(keys, len(levels) + 1) % np.uint64(2 * len(keys) + 1)
            alone = np.bincount(at.astype(np.int64), minlength=2 * len(keys) + 1) == 1
            levels.append(alone)
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (mix64(keys[left], i + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[i][at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", count, 4)
        at, levels = 4 + 4 * count, []
        for n in map(int, sizes):
            size = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool))
            at += size
        return cls(levels)


class Index:
    """The arrays of one shard."""

    def __init__(self, phf: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.phf, self.prints, self.counts, self.owners = phf, prints, counts, owners

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> Index:
        # Two keys may share h1, never both halves: slots are looked up by a mix of the two.
        both = mix64(h1, 0) ^ h2
        phf = PerfectHash.build(both)
        slot = phf.slots(both)
        arrays = [np.empty_like(a) for a in (h1, counts, owners)]
        for to, values in zip(arrays, (h1, counts, owners), strict=True):
            to[slot] = values
        return cls(phf, *arrays)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether two documents or more hold it, and the smallest doc_id that does."""
        if not len(self.prints):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        slot = self.phf.slots(mix64(h1, 0) ^ h2)
        found = (slot >= 0) & (self.prints[slot] == h1) & (self.counts[slot] > 1)
        return found, self.owners[slot]


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[int]]:
    """The lines as bytes, and for each the 128-bit hash of its key or -1."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = [x.strip(STRIP) for x in lines]
    long = [len(k) >= min_chars and (k.isascii() or len(k.decode("utf-8", "surrogatepass")) >= min_chars) for k in keys]
    return lines, [xxhash.xxh3_128_intdigest(k.lower()) if ok else -1 for k, ok in zip(keys, long, strict=True)]


def halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in hashes), "<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def document_keys(docs: DataFrame, min_chars: int, hot: Index | None = None) -> DataFrame:
    """(h1, h2, doc_id) for each distinct key of each document; with `hot`, only of keys that it does not hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[int] = []
            ids: list[int] = []
            for text, i in zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), strict=True):
                if i is not None:
                    own = {h for h in line_keys(text, min_chars)[1] if h >= 0}
                    hashes += own
                    ids += [i] * len(own)
            h1, h2 = halves(hashes)
            doc = np.array(ids, np.int64)
            if hot is not None and len(h1):
                stay = ~hot.probe(h1, h2)[0]
                h1, h2, doc = h1[stay], h2[stay], doc[stay]
            yield pa.RecordBatch.from_arrays([h1.view(np.int64), h2.view(np.int64), doc], ["h1", "h2", "doc_id"])

    return docs.mapInArrow(rows, "h1 long, h2 long, doc_id long")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, hot_share: float = 2e-5, shard_keys: int = 50_000, shard_probes: int = 1_000_000) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row: the text without the lines that an earlier document holds."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pairs = document_keys(slim, min_chars)
    keys = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    seen = Observation()
    keys = keys.observe(seen, F.sum("n").alias("probes"))
    keys = written(keys.where("owner <> last").drop("last"), "line-keys")
    facts = keys.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("pairs")).first()
    # Hot keys: more than hot_share of the pairs of held keys, so at most 1 / hot_share of them whatever the input.
    least = max(1000, int((facts["pairs"] or 0) * hot_share))
    top = keys.where(F.col("n") > least).toPandas()
    u = lambda x: np.asarray(x, np.int64).view(np.uint64)
    hot = Index.build(u(top["h1"]), u(top["h2"]), np.asarray(top["n"], np.int64), np.asarray(top["owner"], np.int64))
    shards = max(1024, -(-facts["keys"] // shard_keys), -(-(seen.get["probes"] or 0) // shard_probes))
    shard = lambda df: df.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        col = lambda k: group[k].to_numpy()
        x = Index.build(col("h1").view(np.uint64), col("h2").view(np.uint64), col("n"), col("owner"))
        return pa.table({"shard": group["shard"][:1], "phf": [x.phf.to_bytes()], "prints": [x.prints.tobytes()], "counts": [x.counts.astype("<i4").tobytes()], "owners": [x.owners.tobytes()]})

    arrays = shard(keys.where(F.col("n") <= least)).groupBy("shard").applyInArrow(build, "shard int, phf binary, prints binary, counts binary, owners binary")
    probes = shard(document_keys(slim, min_chars, hot))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())})
        of = lambda k, kind: np.frombuffer(right[k][0].as_py(), kind)
        x = Index(PerfectHash.from_bytes(right["phf"][0].as_py()), of("prints", "<u8"), of("counts", "<i4"), of("owners", "<i8"))
        h1, h2, doc = (left[k].to_numpy() for k in ("h1", "h2", "doc_id"))
        found, owner = x.probe(h1.view(np.uint64), h2.view(np.uint64))
        drop = found & (owner != doc)
        return pa.table({"doc_id": doc[drop], "h1": h1[drop], "h2": h2[drop]})

    verdicts = probes.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(probe, "doc_id long, h1 long, h2 long")
    verdicts = verdicts.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text, drop in zip(*(batch[k].to_pylist() for k in ("doc_id", "text", "drop")), strict=True):
                lines, hashes = line_keys(text, min_chars)
                gone = {((x["h2"] % 2**64) << 64) | (x["h1"] % 2**64) for x in drop or ()}
                if len(hot.prints) and i is not None:
                    own = [h for h in set(hashes) if h >= 0]
                    if own:
                        found, owner = hot.probe(*halves(own))
                        gone |= {h for h, a, b in zip(own, found, owner, strict=True) if a and b != i}
                kept = [x for x, h in zip(lines, hashes, strict=True) if h not in gone]
                out.append((i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    # Rows without an id have no verdict and need not meet in a join.
    judged = slim.where("doc_id is not null").join(verdicts, "doc_id", "left")
    judged = judged.unionByName(slim.where("doc_id is null").withColumn("drop", F.lit(None).cast(judged.schema["drop"].dataType)))
    return judged.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, text string")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
v AS (SELECT k.*, d.owner IS NOT NULL AND d.owner <> k.doc_id AS gone FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""
