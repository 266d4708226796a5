"""Token counts of flat, unindexed token files by scanning for the separator.

A flat token file is nothing but ids, 16 or 32 bits each, little-endian, with an end-of-document id after each document. Files are
cut into blocks of `block_ids` ids, and numpy finds the separators of a block at once. A document that runs over the end of
a block, or of a file, is stitched by a prefix scan: each block says how many ids and separators it has and where its
last separator is; sums and maxima over the blocks before it, first within its file and then over the files in the order
of the numbers in their names, give every document its number, its start and its length. The scan over files sees one row a file.

Defined cases: a null or empty text is a document of one id, its end. Repeated rows are counted each, also those with a null doc_id. Very long
texts are counted whole. An empty table gives no rows; other columns do not matter. Ids after the last separator form a last document without an end. Empty files hold no document. A file whose
length is no multiple of an id's is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, written
from .tokens import encoder, pieces

#: In the files written here ids are one more than the tokenizer's, so that 0 is free for the end of a document.
END = 0


def blocks_of(spark, path: str, end_id: int, block_ids: int, id_type: str) -> DataFrame:
    """(path, block, n_ids, seps) for each block of each file: the positions of the separators within the block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                ids = np.frombuffer(content.as_buffer(), id_type)
                cuts = [ids[at : at + block_ids] for at in range(0, len(ids), block_ids)]
                seps = [np.flatnonzero(c == end_id) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cuts)), pa.array(range(len(cuts)), pa.int64()), pa.array(list(map(len, cuts)), pa.int64()), pa.array(seps, pa.list_(pa.int64()))], ["path", "block", "n_ids", "seps"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(rows, "path string, block long, n_ids long, seps array<long>")


def file_order() -> Column:
    """Files by the task and the number within it that their names give, then by name."""
    number = lambda p: F.coalesce(F.regexp_extract("path", p, 1).try_cast("long"), F.lit(-1))
    return F.struct(number(r"part-([0-9]+)[^/]*$"), number(r"-c([0-9]+)[^/-]*$"), "path")


def scan_token_files(spark, path: str, end_id: int = END, block_ids: int = 1 << 16, id_type: str = "<u4") -> DataFrame:
    """(path, doc_no, start, n_tokens, closed) of every document; path: the file with its end; n_tokens counts the separator."""
    blocks = written(blocks_of(spark, path, end_id, block_ids, id_type), "separators")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    count = F.size("seps").cast("long")
    local = blocks.select("path", "block", "seps", "n_ids", sums("n_ids", before).alias("ids_before"), sums(count, before).alias("seps_before"))
    local = local.withColumn("last", F.when(count > 0, F.col("ids_before") + F.element_at("seps", -1)))
    local = local.withColumn("last_before", F.max("last").over(before))
    files = local.groupBy("path").agg(F.sum("n_ids").alias("file_ids"), F.sum(count).alias("file_seps"), F.max("last").alias("file_last"))
    earlier = W.orderBy(file_order()).rowsBetween(W.unboundedPreceding, -1)
    files = files.withColumn("base", sums("file_ids", earlier)).withColumn("seps_base", sums("file_seps", earlier))
    files = files.withColumn("stitch", F.max(F.col("base") + F.col("file_last")).over(earlier))
    files = written(files, "separator-files")  # one row a file
    df = local.join(files, "path")
    opened = F.coalesce(F.col("base") + F.col("last_before"), F.col("stitch"), F.lit(-1)) + 1
    ends = F.transform("seps", lambda p: F.col("base") + F.col("ids_before") + p)
    df = df.select("path", (F.col("seps_base") + F.col("seps_before")).alias("first_no"), opened.alias("opened"), ends.alias("ends"))
    df = df.select("path", "first_no", "opened", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("opened")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    closed = df.select("path", (F.col("first_no") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("end") + 1 - start).alias("n_tokens"), F.lit(True).alias("closed"))
    total = files.agg(F.max_by("path", file_order()).alias("path"), F.sum("file_seps").alias("doc_no"), F.max(F.col("base") + F.col("file_last") + 1).alias("start"), F.sum("file_ids").alias("ids"))
    tail = total.select("path", "doc_no", F.coalesce("start", F.lit(0)).alias("start"), (F.col("ids") - F.coalesce("start", F.lit(0))).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail.where("n_tokens > 0"))


def write_flat(docs: DataFrame, path: str, tokenizer: str, text: str = "text", id_type: str = "<u2") -> None:
    """Writes flat token files in the order of the rows, without a shuffle: each task's rows go to files of its own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(id_type).itemsize
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in pieces(texts):
                ids, sizes = encoder(tokenizer).encode(texts[part])
                if len(ids) and int(ids.max()) + 1 > np.iinfo(id_type).max:
                    raise ValueError(f"an id does not fit in {id_type}")
                flat = (ids + np.uint32(1)).astype(id_type).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([flat[size * (to - n) : size * to] for n, to in zip(sizes, np.cumsum(sizes), strict=True)], pa.binary())], ["ids"])

    coded = docs.select(F.col(text).alias("text")).mapInArrow(rows, "ids binary")
    # The cast keeps the bytes as they are; the writer ends each row with the separator, an id of zero bytes.
    coded = coded.select(F.col("ids").cast("string").alias("value"))
    coded.write.option("maxRecordsPerFile", 5_000).option("lineSep", "\0" * np.dtype(id_type).itemsize).text(path)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", id_type: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens): written to flat files and counted from them alone.

    The files know no doc_id. A document gets its own back by the number of its task and its place among that task's rows, so `docs` must
    come in the same order each time it is read, as the rows of a table do. An error is raised if the numbers of documents do not agree.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "flat-tokens")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    write_flat(slim, path, tokenizer, id_type=id_type)
    found = written(scan_token_files(spark, path, id_type=id_type), "token-counts")
    found = found.withColumn("part", F.regexp_extract("path", "part-([0-9]+)-[^/]*$", 1).cast("int"))
    parts = found.groupBy("part").agg(F.min("doc_no").alias("first_no"), F.count(F.lit(1)).alias("n_found"))
    order = slim.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place"))
    order = written(order, "token-order")
    rows = order.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))
    if parts.join(rows, "part", "full").where("not (n_found <=> n_rows)").limit(1).count():
        raise ValueError("the rows came in another order when they were read again; write them to a table first")
    found = found.join(parts, "part").select("part", (F.col("doc_no") - F.col("first_no")).alias("place"), "start", "n_tokens")
    return order.join(found, ["part", "place"], "left").select("doc_id", "start", "n_tokens")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
