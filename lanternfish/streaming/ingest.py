"""Continuous ingest: a stream of pages, each micro-batch one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lanternfish.operators import chunking, embed, ingest, store

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """New Parquet files of pages in folder as a stream."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(folder)


def start(pages: DataFrame, target: store.SegmentedStore, checkpoint: str, backend: embed.Backend | None = None, size: int = 400, overlap: int = 50, once: bool = True) -> StreamingQuery:
    """Store each micro-batch; of a url that comes twice in one, the row with the largest page_id counts.

    A batch that is run again after a failure writes the same sources again, which replaces them: the outcome
    is the same.
    """
    backend = backend or embed.Hashing()

    def write(batch: DataFrame, _: int) -> None:
        latest = chunking.latest_of_batch(batch, "url", "page_id", ["html"])
        chunks = chunking.chunk(ingest.documents(latest.select("url", "html")), size, overlap)
        target.upsert(embed.encode(chunks, backend))

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
