"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import text
from lanternfish.schema import DEFAULT_TYPE


def chunk(docs: DataFrame, size: int = 400, overlap: int = 50, content: str = "content") -> DataFrame:
    """A row per window of each document: order from 0, content the window, other columns carried along.

    Documents without words give no chunk. No shuffle.
    """
    others = [c for c in docs.columns if c != content]
    cut = docs.select(*others, text.words(F.col(content)).alias("_words"))  # a filter here would split the text twice
    return cut.select(*others, F.posexplode(text.windows(F.col("_words"), size, overlap)).alias("order", content))


def with_ids(docs: DataFrame) -> DataFrame:
    """docs with an id (that of the caller where given) and a type."""
    own = F.col("id") if "id" in docs.columns else F.lit(None).cast("string")
    kind = F.col("type") if "type" in docs.columns else F.lit(None).cast("string")
    return docs.withColumns({"id": F.coalesce(own, text.text_id(F.col("source"), F.col("content"))), "type": F.coalesce(kind, F.lit(DEFAULT_TYPE))})


def layers(docs: DataFrame, ingested: DataFrame) -> DataFrame:
    """The corpus of both layers, documents first; columns that one side lacks are null there."""
    return docs.withColumn("layer", F.lit(0)).unionByName(ingested.withColumn("layer", F.lit(1)), allowMissingColumns=True)


def latest_of_batch(items: DataFrame, source: str, position: str, payload: list[str]) -> DataFrame:
    """One row per source of a batch: the last payload at the first position."""
    last = F.max_by(F.struct(*payload), position)
    return items.groupBy(source).agg(F.min(position).alias(position), last.alias("_last")).select(source, position, *(F.col(f"_last.{c}").alias(c) for c in payload))


def corpus_hash(chunks: DataFrame, order: list[str]) -> DataFrame:
    """One row, corpus_hash: sha256 over source and content of the chunks in order.

    The digest folds all rows in one place; it is for the documentation layer, which is small and rebuildable.
    Use corpus_marks() for a corpus of any size.
    """
    part = F.concat(F.coalesce("source", F.lit("")), F.lit("\0"), F.col("content"), F.lit("\0"))
    rows = chunks.select(F.struct(*order, part.alias("part")).alias("r"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["part"]), "")
    return rows.agg(F.sha2(F.coalesce(joined, F.lit("")), 256).alias("corpus_hash"))


def corpus_marks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """One row, corpus_marks, that changes with any chunk, its source or its place.

    Each chunk's sha256 covers its source, place and content; the parts of all digests are summed in parallel, so
    that a corpus of any size costs one pass and a row per task.
    """
    leaf = F.sha2(F.concat_ws("\0", F.coalesce("source", F.lit("")), *(F.col(c).cast("string") for c in order), "content"), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 16, 31, 46)]
    return chunks.select(leaf.alias("h")).agg(F.sha2(F.concat_ws(" ", *parts), 256).alias("corpus_marks"))


def summaries(chunks: DataFrame, source: str = "source") -> DataFrame:
    """source, chunks_indexed, words (those in overlaps count twice), preview of the first chunk."""
    n = F.size(text.words(F.col("content")))
    return chunks.groupBy(source).agg(F.count("*").alias("chunks_indexed"), F.sum(n).cast("long").alias("words"), text.preview(F.min_by("content", "order")).alias("preview"))


def page_payload(chunks: DataFrame, source: str = "source") -> DataFrame:
    """source and its chunks (order, id, content) in order: what an ingest reply carries for a page."""
    return chunks.groupBy(source).agg(F.sort_array(F.collect_list(F.struct("order", "id", "content"))).alias("chunks"))


def positions(chunks: DataFrame, *order: str) -> DataFrame:
    """chunks with pos from 0 in corpus order; for small corpora and tests, since ranks need one order of all."""
    return chunks.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)
