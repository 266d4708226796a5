"""Where pages come from and where Markdown goes: whole files, tables and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import html_to_markdown

PAGES = "page_id long, url string, html string"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_html_files(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str = "*") -> DataFrame:
    """(path, html): one row a file whose name fits `glob`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.decode("content", encoding).alias("html"))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out anew if the source gives fewer tasks than there are cores, as one small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """What driver and executors share: spark.checkpoint.dir, or the warehouse where that is not set."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (set_dir or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for several readers of what costs much to make. What was shuffled for it goes once it stands."""
    path, conf = f"{shared_folder(df.sparkSession)}/loomdown-{name}-{uuid.uuid4().hex[:12]}", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def in_slices(df: DataFrame, key: str, most: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `step`, which ends with `settled`, makes of the rows, all of a key at once and about `most` rows at a time: what it writes and shuffles on the way is bounded by that."""
    n = -(-df.count() // most)
    if n <= 1:
        return step(df)
    parts = [step(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]
    return df.sparkSession.read.schema(parts[0].schema).parquet(*(p.settled_path for p in parts))


def release(*tables: DataFrame) -> None:
    """Empties tables of `settled` that nothing reads any more, by any store's own overwrite."""
    for df in tables:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df.settled_path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_pages(spark: SparkSession, folder: str, glob: str = "*.parquet", schema: str = PAGES, max_files: int = 16) -> DataFrame:
    """New Parquet files of pages as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def with_markdown(pages: DataFrame, html: str = "html", width: int = 80, permissive: bool = True) -> DataFrame:
    """The rows with a column `markdown`, and in permissive mode `failed` for pages that could not be converted."""
    out = pages.withColumn("markdown", html_to_markdown(F.col(html), width, permissive))
    return out.withColumn("failed", F.col(html).isNotNull() & F.col("markdown").isNull()) if permissive else out


def write_markdown(df: DataFrame, path: str, markdown: Column | str = "markdown", mode: str = "errorifexists") -> None:
    """A text file of documents, each as it is and followed by a form feed; on reading back, a form feed in a text splits it too."""
    df.select(F.coalesce(F.col(markdown) if isinstance(markdown, str) else markdown, F.lit("")).alias("value")).write.mode(mode).option("lineSep", "\f").text(path)
