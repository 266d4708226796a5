"""Conversion as a stream: each page stands for itself, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import stream_pages, with_markdown


def stream_markdown(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*.parquet", width: int = 80, once: bool = True) -> StreamingQuery:
    """Converts pages as their files arrive, or once all that are there, into Parquet with exactly-once output."""
    pages = with_markdown(stream_pages(spark, folder, glob), width=width).drop("html")
    writer = pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
