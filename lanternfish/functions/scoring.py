"""Scores as Column expressions: BM25, normalisation, cosine, fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: BM25 parameters; the guard of a zero norm (fixed values of the ranking).
K1, B, TINY = 1.5, 0.75, 1e-8


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)), never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(weight: Column, tf: Column, length: Column, mean: Column) -> Column:
    """One query term's part of a document's score; 0 where the mean length is 0."""
    norm = K1 * (1 - B) + K1 * B * length / mean
    return F.when(mean > 0, weight * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x scaled to 0..1; 0 where all values are equal."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, not rescaled; 0 for a zero vector."""
    size = norm(a) * norm(b)
    return dot(a, b) / F.when(size == 0, F.lit(TINY)).otherwise(size)


def fuse(vector: Column, keyword: Column, wv: float, wk: float) -> Column:
    return F.lit(wv) * vector + F.lit(wk) * keyword
