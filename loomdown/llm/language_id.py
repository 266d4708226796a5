"""Language identification by a string kernel.

The kernel of two texts is the cosine of their blended-spectrum presence vectors: which n-grams of 1 to `longest` letters
occur, whatever their number, hashed to `dims` places. Landmark texts span a Nyström feature space, in which one kernel
ridge regression for each language against the rest is fitted to indicators. As the kernel is a product of presence
vectors, the landmarks and their coefficients fold into one matrix, and a batch of texts is scored by one matrix product.

The fit reads at most `sample` different labelled texts, or four of each language if that is more: an equal number for each
language, those with the smallest hashes, whatever the number of their copies. At most `landmarks` are landmarks. Predictions read whole texts and nothing else.

Defined cases: a null text, or one without a letter, is "und" with score 0. Languages seen only in null labels do not exist; with no labelled
row at all every text is "und". Repeated rows are predicted each; very long texts are read whole; an empty table gives no rows. Ties go to the language first in code point order. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"


def presence(texts: list[str], dims: int, longest: int) -> np.ndarray:
    """The presence vectors of the texts, of unit length."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32).astype(np.uint64)
    plain = (codes < 128) & ((codes < 97) | (codes > 122)) & (codes > 0)
    codes[plain] = 32
    ends = np.flatnonzero(codes == 0)
    of = np.cumsum(codes == 0)
    if len(ends) != len(texts):  # a text holds U+0000 itself
        of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in low])
    out = np.zeros((len(texts), dims), np.float32)
    flat, gram = out.reshape(-1), codes.copy()
    inside = codes > 0
    for n in range(1, longest + 1):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            inside = inside[:-1] & (codes[n - 1 :] > 0)
        place = ((gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(40)
        flat[(of[: len(gram)] * dims + (place % np.uint64(dims)).astype(np.int64))[inside]] = 1
    size = np.sqrt(out.sum(1, keepdims=True))
    return out / np.maximum(size, 1)


class Classifier:
    def __init__(self, languages: list[str], matrix: np.ndarray, dims: int, longest: int):
        self.languages, self.matrix, self.dims, self.longest = languages, matrix, dims, longest

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], dims: int, longest: int, landmarks: int, ridge: float) -> Classifier:
        languages = sorted(set(labels))
        y = (np.array(labels)[:, None] == np.array(languages)[None, :]).astype(np.float64)
        turn = {lang: 0 for lang in languages}
        chosen = []
        for i, lang in enumerate(labels):
            if turn[lang] < max(1, landmarks // len(languages)):
                turn[lang] += 1
                chosen.append(i)
        marks = presence([texts[i] for i in chosen[:landmarks]], dims, longest).astype(np.float64)
        kernel = np.concatenate([presence(texts[at : at + 64], dims, longest) @ marks.T for at in range(0, len(texts), 64)])
        values, vectors = np.linalg.eigh(marks @ marks.T)
        good = values > 1e-8 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])
        features = np.concatenate([kernel @ whiten, np.ones((len(texts), 1))], 1)
        weights = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ y)
        matrix = np.concatenate([marks.T @ (whiten @ weights[:-1]), weights[-1:]])
        return cls(languages, matrix.astype(np.float32), dims, longest)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        values = presence(texts, self.dims, self.longest) @ self.matrix[:-1] + self.matrix[-1]
        best = values.argmax(1)
        return [self.languages[i] for i in best], np.clip(values[np.arange(len(best)), best], 0, 1).astype(np.float64)


def sample_of(rows: DataFrame, sample: int) -> list:
    """Different (text, lang), as evenly over the languages as they allow: each has its texts with the smallest hashes, or all of them."""
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    texts = rows.select("lang", "h").distinct()
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    each = max(4, sample // len(counts))
    # Twice the places and 64 more, so that too few by chance cannot happen in practice.
    below = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 40) * min(1.0, (2 * each + 64) / n)))))
    thinned = F.pmod("h", F.lit(1 << 40))
    few = texts.where(thinned < F.try_element_at(below, F.col("lang"))).withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy(thinned, "h"))).where(F.col("i") <= each)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first copy that each task meets."""
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch["lang"].to_pylist(), batch["h"].to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    chosen = rows.join(F.broadcast(few), ["lang", "h"]).select("lang", "h", "i", "text")
    chosen = chosen.mapInArrow(once, chosen.schema).dropDuplicates(["lang", "h"])
    return chosen.orderBy("i", "lang").select("text", "lang").collect()


def fit(docs: DataFrame, train: Column, text="text", lang="lang", dims=1 << 13, longest=3, sample=1600, landmarks=192, ridge=0.05) -> Classifier | None:
    rows = docs.where(train).select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text rlike '\\\\p{L}'")
    found = sample_of(rows, sample)
    return Classifier.fit([r["text"] for r in found], [r["lang"] for r in found], dims, longest, landmarks, ridge) if found else None


def identify(docs: DataFrame, model: Classifier | None, text: str = "text", doc_id: str = "doc_id", batch_chars: int = 200_000, batch_docs: int = 64) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            named, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            at = 0
            while at < len(todo):
                end, size = at, 0
                while end < len(todo) and end - at < batch_docs and (end == at or size + len(texts[todo[end]]) <= batch_chars):
                    size += len(texts[todo[end]])
                    end += 1
                found, score = model.predict([texts[i] for i in todo[at:end]])
                for i, lang in zip(todo[at:end], found, strict=True):
                    named[i] = lang
                scores[todo[at:end]] = score
                at = end
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(named, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where("doc_id is not null"), ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
