"""From raw documents to training ids: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes all that the one before kept, as rows with the columns of `documents`; the last returns the documents'
places in the token files. Between stages the rows are written as Parquet in the shared folder and read again.

Defined cases: rows are judged by their texts, so rows with a null or a repeated doc_id are dropped as duplicates or as contaminated like
all others. Of each group of near copies the row with the smallest doc_id stays, of equal ids the first, a null one only if there is no other.
Rows without words are near copies of nothing. Empty tables go through; very long texts are read whole; extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdown.llm import decontaminate, jaccard_join, mixing, quality, token_files
from loomdown.llm.common import written

#: The stages' own decisions (sets of shingles, tilings, sums of words in order, range coding) have no plain SQL together.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 80 % of their five-word shingles in common, one stays."""
    numbered = written(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")), "numbered")
    found = jaccard_join.jaccard_components(numbered.select("number", F.col("row.text").alias("text")), doc_id="number", width=5, percent=80)
    found = found.select(F.col("doc_id").alias("number"), "component_id")
    ids = numbered.select("number", F.col("row.doc_id").alias("doc_id"))
    first = F.min_by("number", F.struct(F.col("doc_id").isNull(), "doc_id", "number"))
    stay = found.join(ids, "number").groupBy("component_id").agg(first.alias("number")).select("number")
    return numbered.join(stay.hint("merge"), "number", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are told by a 64-bit hash, as ids may be missing."""
    key = F.xxhash64("text", F.lit(1)).alias("key")
    found = decontaminate.contaminated(docs.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    rows = docs.select(key, F.struct("*").alias("row"))
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mixing.training_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
