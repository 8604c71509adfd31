"""Text to vectors: a protocol, and a deterministic backend that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions import text
from lanternfish.sources import tables


class Backend(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Hashing:
    """Signed feature hashing of word tokens, of unit length; no learned model, but equal on every machine."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        import re

        out = np.zeros((len(texts), self.dimension))
        for row, t in enumerate(texts):
            for token in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(token.encode())
                out[row, h % self.dimension] += 1.0 if h & 0x80000000 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).astype(np.float32)


class Model:
    """A sentence-transformers model, where that library is installed; loaded once per Python worker."""

    _loaded: dict = {}

    def __init__(self, name: str, dimension: int):
        self.name, self.dimension = name, dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        if self.name not in self._loaded:
            from sentence_transformers import SentenceTransformer

            self._loaded[self.name] = SentenceTransformer(self.name)
        return np.asarray(self._loaded[self.name].encode(texts), dtype=np.float32)


def encode(df: DataFrame, backend: Backend, content: str = "content", out: str = "embedding") -> DataFrame:
    """df with the vector of each text; batches of Arrow rows go through one encode call."""
    tables.small_batches(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(backend.encode(texts.fillna("").tolist())))

    return df.withColumn(out, run(F.col(content)))


def hashed_terms(df: DataFrame, keys: list[str], content: str, dimension: int) -> DataFrame:
    """keys, slot, weight: the sparse form of the hashing vectors before scaling, in SQL functions only."""
    long = df.select(*keys, F.explode(text.tokens(F.col(content))).alias("t")).select(*keys, F.crc32(F.col("t").cast("binary")).alias("h"))
    sign = F.when(F.col("h") >= 1 << 31, 1.0).otherwise(-1.0)
    return long.groupBy(*keys, (F.col("h") % dimension).cast("int").alias("slot")).agg(F.sum(sign).alias("weight"))
