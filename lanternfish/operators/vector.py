"""Vector similarity: an expression for few queries, Arrow batches and a matrix product for many."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import scoring

#: Queries of a pass over the corpus: a task scores them against one Arrow batch at a time.
BLOCK_QUERIES = 512


def cosine(chunks: DataFrame, queries: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """qid, keys, vector_score of each chunk and query (qid, query_vec). Queries are bounded by the request limits."""
    pairs = chunks.select(*keys, F.col(vector).alias("_v")).crossJoin(F.broadcast(queries.select("qid", "query_vec")))
    return pairs.select("qid", *keys, scoring.cosine(F.col("_v"), F.col("query_vec")).alias("vector_score"))


def top_cosine(chunks: DataFrame, queries: list[tuple[int, list[float]]], key: str | list[str], k: int, vector: str = "embedding", weight: float = 1.0, missing: bool = False) -> DataFrame:
    """qid, key (one integer column or several), vector_score, rank of each query's k best chunks, ties by key.

    Best by weight times the cosine, to 9 digits. missing: chunks without a vector take part with a cosine of 0.
    Each task keeps k rows per query of what it reads (one matrix product per Arrow batch), so the shuffle
    carries tasks * queries * k narrow rows whatever the corpus.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not queries:
        return chunks.sparkSession.createDataFrame([], f"qid long, {', '.join(f'{c} long' for c in keys)}, vector_score double, rank int")
    ids = [q for q, _ in queries]
    matrix = np.array([v for _, v in queries], dtype=np.float64)
    # A broadcast lives in a file of the driver; a closure would keep the matrix in its memory with the plan.
    shared = chunks.sparkSession.sparkContext.broadcast((ids, matrix, np.linalg.norm(matrix, axis=1)))
    del ids, matrix
    m = len(keys)

    def run(batches):
        ids, matrix, size = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, m), np.int64)) for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.column_stack([batch.column(c).to_numpy() for c in range(m)])
            lists = batch.column(m)
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            widths = np.diff(lists.offsets.to_numpy())[there]
            if (widths != matrix.shape[1]).any():
                raise ValueError(f"vectors of width {matrix.shape[1]} are asked for, the rows have {sorted(set(widths.tolist()))}")
            rows = np.zeros((batch.num_rows, matrix.shape[1]))
            rows[there] = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(widths), -1) if len(widths) else 0.0
            denominator = np.linalg.norm(rows, axis=1)[:, None] * size[None, :]
            denominator[denominator == 0] = scoring.TINY
            scores = rows @ matrix.T / denominator
            for j in range(len(ids)):
                s, n = np.concatenate([best[j][0], scores[:, j]]), np.concatenate([best[j][1], names])
                keep = np.lexsort((*n.T[::-1], -np.round(weight * s, 9)))[:k]
                best[j] = (s[keep], n[keep])
        q = np.repeat(np.array(ids, dtype=np.int64), [len(s) for s, _ in best])
        found = np.concatenate([np.zeros((0, m), np.int64), *(n for _, n in best)])
        scored = np.concatenate([np.zeros(0), *(s for s, _ in best)])
        yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(found[:, c]) for c in range(m)), pa.array(scored)], names=["qid", *keys, "vector_score"])

    narrow = chunks.select(*(F.col(c).cast("long").alias(c) for c in keys), vector)
    narrow = narrow if missing else narrow.filter(F.col(vector).isNotNull())
    found = narrow.mapInArrow(run, f"qid long, {', '.join(f'{c} long' for c in keys)}, vector_score double")
    return rank(found, F.round(F.lit(weight) * F.col("vector_score"), 9), keys, k)


def pair_cosine(rows: DataFrame, queries: list[tuple[int, list[float]]], vector: str = "embedding") -> DataFrame:
    """rows (qid and others) with vector_score, the cosine of their vector and that of their query, in place of the vector.

    A missing vector counts as 0. One product per Arrow batch.
    """
    shared = rows.sparkSession.sparkContext.broadcast(({q: k for k, (q, _) in enumerate(queries)}, np.array([v for _, v in queries], dtype=np.float64)))
    names = ["qid", *(c for c in rows.columns if c not in ("qid", vector))]

    def run(batches):
        place, matrix = shared.value
        size = np.linalg.norm(matrix, axis=1) if len(matrix) else np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(names))
            there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            asked = np.fromiter((place[q] for q in batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)[there]
            scores = np.zeros(batch.num_rows)
            if len(there):
                own = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(there), -1)
                denominator = np.linalg.norm(own, axis=1) * size[asked]
                denominator[denominator == 0] = scoring.TINY
                scores[there] = np.einsum("ij,ij->i", own, matrix[asked]) / denominator
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores)], names=[*names, "vector_score"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, vector).mapInArrow(run, f"{schema}, vector_score double")


def top_cosine_each(chunks: DataFrame, queries: DataFrame, key: str, k: int, vector: str = "embedding") -> DataFrame:
    """qid, key, vector_score, rank of the k best chunks of every row (qid, query_vec) of queries, however many.

    Queries go out in blocks of about BLOCK_QUERIES: the driver holds one at a time, and each block is a pass over
    the chunks. Queries without a vector find nothing.
    """
    queries = queries.filter(F.col("query_vec").isNotNull()).select(F.col("qid").cast("long").alias("qid"), "query_vec")
    blocks = -(-queries.count() // BLOCK_QUERIES)
    passes = []
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if block:
            passes.append(top_cosine(chunks, [(r["qid"], r["query_vec"]) for r in block], key, k, vector))
    if not passes:
        return chunks.sparkSession.createDataFrame([], f"qid long, {key} long, vector_score double, rank int")
    return functools.reduce(DataFrame.unionByName, passes)


def rank(scores: DataFrame, by, ties: list[str], k: int) -> DataFrame:
    """The k best rows of each qid with their rank from 1; each task drops all but its own k first."""
    from pyspark.sql import Window

    over = Window.partitionBy("qid").orderBy(by.desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)
