"""Raw pages to chunks: routing, extraction, statuses, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import guards, text
from lanternfish.operators import chunking
from lanternfish.schema import WEB_TYPE
from lanternfish.sources import tables
from lanternfish.sources.article import extract_udf

#: What an item of a batch can come to (fixed values of the reply format).
OK, FETCH_ERROR, EXTRACT_ERROR, ERROR = "ok", "fetch_error", "extract_error", "error"


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with title, content, page_metadata and extract_error (null if content was found)."""
    tables.small_batches(pages.sparkSession)
    out = pages.withColumn("_x", extract_udf(F.col(html), F.col(url)))
    return out.withColumns({"title": F.col("_x.title"), "content": F.col("_x.content"), "page_metadata": F.col("_x.metadata"), "extract_error": F.col("_x.error")}).drop("_x")


def documents(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Documents of the web type from pages that extraction found content in; source is the requested url."""
    found = extract(pages, html, url).filter(F.col("extract_error").isNull())
    return chunking.with_ids(found.select(F.col(url).alias("source"), "content", F.lit(WEB_TYPE).alias("type"), "title", F.col(url).alias("url"), "page_metadata"))


def route(items: DataFrame) -> DataFrame:
    """items (url, html, source_url) with source and origin: a url wins over html when both are given."""
    by_url = F.coalesce(F.length("url") > 0, F.lit(False))
    return items.withColumns({"source": F.when(by_url, F.col("url")).otherwise(F.col("source_url")), "origin": F.when(by_url, F.lit("url")).otherwise(F.lit("html"))})


def batch(items: DataFrame, position: str = "item", size: int = 400, overlap: int = 50) -> tuple[DataFrame, DataFrame]:
    """(replies, chunks to index) of items (position, source, html, fetch_error).

    Each item fails or succeeds on its own: replies hold position, source, status, error, title,
    chunks_indexed, words, preview. A source that comes twice is indexed once, with its last content at its
    first position, and answered twice.
    """
    done = extract(items, "html", "source")
    status = F.when(F.col("fetch_error").isNotNull(), FETCH_ERROR).when(F.col("extract_error").isNotNull(), EXTRACT_ERROR).otherwise(OK)
    done = done.withColumns({"status": status, "error": F.coalesce("fetch_error", "extract_error")})
    good = done.filter(F.col("status") == OK)
    cut = chunking.chunk(good.select(position, "source", "content"), size, overlap)
    sums = chunking.summaries(cut, position)
    replies = done.select(position, "source", "status", "error", "title").join(sums, position, "left")
    replies = replies.withColumns({"chunks_indexed": F.coalesce("chunks_indexed", F.lit(0)), "words": F.coalesce("words", F.lit(0)), "preview": F.coalesce("preview", F.lit(""))})
    latest = chunking.latest_of_batch(good, "source", position, ["content", "title", "page_metadata"])
    fresh = chunking.with_ids(latest.withColumns({"type": F.lit(WEB_TYPE), "url": F.col("source")}))
    return replies, chunking.chunk(fresh, size, overlap)


def failed(replies: DataFrame, why: str) -> DataFrame:
    """replies of a batch whose write failed: what was to be stored has the status error."""
    lost = F.col("status") == OK
    return replies.withColumns({"error": F.when(lost, F.lit(why)).otherwise(F.col("error")), "chunks_indexed": F.when(lost, 0).otherwise(F.col("chunks_indexed")), "status": F.when(lost, ERROR).otherwise(F.col("status"))})


def validated(items: DataFrame, most: int = 5 << 20) -> DataFrame:
    """items with request_error: null, or what the request breaks."""
    fine = guards.ingest_ok(F.col("url"), F.col("html"), F.col("source_url"), most)
    wrong = F.when(~fine, F.lit("a url, or html with its source_url, within bounds"))
    return items.withColumn("request_error", wrong)


def passages(rows: DataFrame) -> DataFrame:
    """Only what an agent reads: content, source, confidence."""
    return rows.select("content", "source", F.round("confidence", 3).alias("confidence"))


def words_of(content):
    return F.size(text.words(content))
