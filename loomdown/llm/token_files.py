"""Token ids in compressed binary files.

Documents are range-sorted by doc_id, with a hash of the text and of the row's place behind it, so that many rows of one id
share no task; each partition writes one file, so that files in the order of their numbers hold the
documents in ascending order. A file is a run of records; a record is one independently coded block of ids. A document
that runs over the end of a block goes on in the next:

    magic "LDT3", then little-endian: u32 pieces, u32 ids, u32 bytes of the tables, u32 bytes of code, u32 crc32 of what
    follows, u32 crc32 of the ids as u32; then, packed by zlib, for each piece of a document i64 doc_id, u8 null flag, u8 end
    flag, u32 ids, then u32 size of the coder's table, its u32 numbers as steps from one to the next, and u32 bytes of code of each run;
    then the code; then "\n"

The records go through Spark's own file writer, so that task retries and lost executors leave no partial files, and any
store that Spark writes will do. Readers take whole files, check both sums of each block and decode blocks side by side.
A file holds `least_chars` to `most_chars` characters of text on average, as parallel work asks for.

Defined cases: a null or empty text holds only the end id. Repeated rows are kept, next to each other; rows with a null
doc_id come first. Texts are encoded whole, whatever their length. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import codec
from .common import fresh_path, written
from .tokens import encoder, pieces

MAGIC = b"LDT3"
HEAD = struct.Struct("<4s6I")
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "u1"), ("n", "<u4")])
SIDE_BY_SIDE = 12


def records(blocks: list[np.ndarray], tables: list[np.ndarray], vocab: int) -> list[bytes]:
    """A record for each block of ids and its table of pieces of documents."""
    out = []
    for ids, table, (alphabet, runs) in zip(blocks, tables, codec.encode(blocks, vocab), strict=True):
        steps = np.diff(alphabet.astype("<u4"), prepend=np.uint32(0))
        facts = [np.array([len(alphabet)]), steps, np.array(list(map(len, runs)))]
        head = zlib.compress(table.tobytes() + b"".join(x.astype("<u4").tobytes() for x in facts))
        code = b"".join(runs)
        sums = zlib.crc32(head + code), zlib.crc32(ids.astype("<u4").tobytes())
        out.append(HEAD.pack(MAGIC, len(table), len(ids), len(head), len(code), *sums) + head + code)
    return out


def parse(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(table of pieces, ids) of each record, in order."""
    at = 0
    while at < len(data):
        group = []
        while at < len(data) and len(group) < SIDE_BY_SIDE:
            magic, n_docs, n_ids, head_size, code_size, body_sum, ids_sum = HEAD.unpack_from(data, at)
            at += HEAD.size
            body = data[at : at + head_size + code_size]
            if magic != MAGIC or zlib.crc32(body) != body_sum:
                raise ValueError(f"damaged record before byte {at}")
            head = zlib.decompress(body[:head_size])
            table, facts = np.frombuffer(head, DOC, n_docs), np.frombuffer(head, "<u4", offset=n_docs * DOC.itemsize)
            alphabet, sizes = np.cumsum(facts[1 : facts[0] + 1], dtype=np.uint32), facts[facts[0] + 1 :].astype(np.int64)
            ends = head_size + np.cumsum(sizes)
            group.append((table, n_ids, alphabet, [body[e - n : e] for e, n in zip(ends, sizes, strict=True)], ids_sum))
            at += len(body) + 1
        decoded = codec.decode([g[3] for g in group], [g[1] for g in group], [g[2] for g in group])
        for (table, *_, ids_sum), ids in zip(group, decoded, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != ids_sum:
                raise ValueError("the decoded ids differ from those written")
            yield table, ids


def file_count(spark, texts: DataFrame, least_chars: int, most_chars: int) -> int:
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    wanted = 4 * spark.sparkContext.defaultParallelism
    return max(1, -(-chars // most_chars), min(wanted, chars // least_chars))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, vocab: int = 49408, block_ids: int = 1 << 18, least_chars: int = 6_000_000, most_chars: int = 256_000_000) -> None:
    """Writes the ids of every row's text, each followed by `end_id`, in ascending doc_id order.

    block_ids: ids in each block but a task's last.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Rows of one doc_id follow each other by their text, so that reruns agree; equal rows are dealt out by their place.
    keys = ("doc_id", F.xxhash64("text"), F.xxhash64(F.monotonically_increasing_id()))
    files = file_count(docs.sparkSession, slim, least_chars, most_chars)
    slim = slim.repartitionByRange(files, *keys).sortWithinPartitions(*keys[:2])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []  # ids that fill no block yet
        table: list[tuple] = []
        blocks: list[np.ndarray] = []
        tables: list[np.ndarray] = []
        room = block_ids

        def close() -> None:
            nonlocal room
            blocks.append(np.concatenate(waiting))
            tables.append(np.array(table, DOC))
            waiting.clear()
            table.clear()
            room = block_ids

        def flush() -> pa.RecordBatch:
            out = records(blocks, tables, vocab)
            blocks.clear()
            tables.clear()
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

        for batch in batches:
            texts, doc_ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            for part in pieces(texts, 4_000_000):
                ids, sizes = encoder(tokenizer).encode(texts[part])
                for i, n, to in zip(doc_ids[part], sizes, np.cumsum(sizes), strict=True):
                    doc = np.append(ids[to - n : to], np.uint32(end_id))
                    while len(doc):
                        now, doc = doc[:room], doc[room:]
                        waiting.append(now)
                        table.append((i or 0, i is None, not len(doc), len(now)))
                        room -= len(now)
                        if not room:
                            close()
                if len(blocks) >= SIDE_BY_SIDE:
                    yield flush()
        if waiting:
            close()
        if blocks:
            yield flush()

    # The cast keeps the bytes as they are; the text writer writes them and one "\n" after each record.
    out = slim.mapInArrow(rows, "record binary").select(F.col("record").cast("string"))
    out.write.text(path)


def read_token_files(spark, path: str, with_ids: bool = True) -> DataFrame:
    """(path, doc_id, at, n_tokens, ids_crc32) of every document, from the files, with its ids if asked; at: its start within its file."""
    names = ["path", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids]
    kinds = (pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                start, begun = 0, []  # begun: the pieces so far of a document that is not at its end
                for table, ids in parse(content.as_py()):
                    docs: list[tuple] = []
                    for (i, null, end, _), piece in zip(table.tolist(), np.split(ids, np.cumsum(table["n"], dtype=np.int64)[:-1]), strict=True):
                        begun.append(piece)
                        if end:
                            own = np.concatenate(begun)
                            docs.append((name, None if null else i, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), *[own][:with_ids]))
                            start += len(own)
                            begun = []
                    if docs:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs, strict=True), kinds, strict=False)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(rows, "path string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_table(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the files and reads from them (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, **options)
    rows = written(read_token_files(spark, path, with_ids=False), "token-rows")
    files = rows.groupBy("path").agg(F.sum("n_tokens").alias("n"))  # one row a file
    number = F.regexp_extract("path", "part-([0-9]+)[^/]*$", 1).cast("long")
    before = files.select("path", F.coalesce(F.sum("n").over(W.orderBy(number).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "path").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
