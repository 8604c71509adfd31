"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

#: Version of the evidence and envelope shapes (a fixed value of the format).
EVIDENCE_VERSION = "1.0"
DEFAULT_TYPE, WEB_TYPE, UNKNOWN_SOURCE = "documentation", "web", "unknown"

_s = T.StringType()
PAGE_METADATA = T.StructType([T.StructField(n, _s) for n in ("url", "author", "date", "sitename")])
DOC = T.StructType([*(T.StructField(n, _s) for n in ("id", "source", "content", "type", "title", "url")), T.StructField("page_metadata", PAGE_METADATA)])
CHUNK = T.StructType([*DOC.fields, T.StructField("order", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
EVIDENCE = T.StructType(
    [
        T.StructField("content", _s),
        T.StructField("source", _s),
        T.StructField("type", _s),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("metadata", T.StructType([T.StructField("vector_score", T.DoubleType()), T.StructField("keyword_score", T.DoubleType()), T.StructField("id", _s)])),
    ]
)
EXTRACTED = T.StructType([T.StructField("title", _s), T.StructField("content", _s), T.StructField("metadata", PAGE_METADATA), T.StructField("error", _s)])
STATS = "live_chunks long, sources long, dead_chunks long, segments long"
