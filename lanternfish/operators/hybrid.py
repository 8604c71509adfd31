"""Hybrid retrieval: cosine and normalised BM25 fused, ranked, and shaped as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import scoring
from lanternfish.operators import bm25, vector
from lanternfish.schema import DEFAULT_TYPE, EVIDENCE_VERSION, UNKNOWN_SOURCE
from lanternfish.sources import tables


def search(chunks: DataFrame, queries: DataFrame, keys: list[str], k: int, wv: float = 0.65, wk: float = 0.35, index: DataFrame | None = None, totals: tuple[int, int] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """qid, rank, keys, confidence, vector_score, keyword_score of each query's k best chunks.

    chunks: keys, content, embedding (null: cosine 0); or the embedding is in vectors, one a document, by some of the
    keys, and only keys travel to it. queries: qid, query, query_vec; bounded by the request limits.
    Ties go by keys, which give corpus order. index, totals: stored postings, and the numbers of chunks and tokens;
    made from chunks if absent. Content stays behind: join it back to the k winners with materialise().

    A chunk without a keyword match has the lowest keyword score, so of those only the k best by their vectors can
    win: each task drops all its others, and only matches and these are joined.
    """
    if index is None or totals is None:
        words, stats = bm25.score_chunks(chunks, keys, queries)
    else:
        n, total = totals
        mean = total / n if n else 0.0
        words = bm25.lookup(index, n, mean, queries, keys)
        stats = tables.local(chunks.sparkSession, [[n], [total], [mean]], "n long, total_length long, avgdl double")
    ends = bm25.spread(words, stats, queries)
    asked = [(r["qid"], r["query_vec"]) for r in queries.select("qid", "query_vec").collect()]  # a request: bounded by its limits
    if vectors is None:
        placed, paired = chunks, words.join(chunks.select(*keys, "embedding"), keys)
    else:
        on = [c for c in keys if c in vectors.columns]
        placed, paired = chunks.select(*keys).join(vectors, on, "left"), words.join(vectors, on, "left")
    best = vector.top_cosine(placed, asked, keys, k, weight=wv, missing=True)
    alone = best.select("qid", *(F.col(c).cast(chunks.schema[c].dataType).alias(c) for c in keys), "vector_score").join(words, ["qid", *keys], "left_anti")
    met = vector.pair_cosine(paired, asked)
    both = met.unionByName(alone, allowMissingColumns=True).join(F.broadcast(ends), "qid")
    keyword = scoring.min_max(F.coalesce("score", F.lit(0.0)), F.col("low"), F.col("high"))
    fused = both.select("qid", *keys, "vector_score", keyword.alias("keyword_score")).withColumn("confidence", scoring.fuse(F.col("vector_score"), F.col("keyword_score"), wv, wk))
    return vector.rank(fused, F.round("confidence", 9), keys, k)


def materialise(winners: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """winners with the other columns of their chunks: the wide columns are read for the k winners only."""
    return chunks.join(F.broadcast(winners), keys)  # k rows per query of a bounded batch


def evidence(content: Column, source: Column, kind: Column, score: Column, v: Column, w: Column, ident: Column) -> Column:
    """The evidence struct: defaults filled in, scores rounded to 3 digits."""
    r = lambda c: F.round(c.cast("double"), 3)
    meta = F.struct(r(v).alias("vector_score"), r(w).alias("keyword_score"), ident.alias("id"))
    return F.struct(content.alias("content"), F.coalesce(source, F.lit(UNKNOWN_SOURCE)).alias("source"), F.coalesce(kind, F.lit(DEFAULT_TYPE)).alias("type"), r(score).alias("confidence"), meta.alias("metadata"))


def envelope(rows: DataFrame, query: str = "query", item: str = "evidence") -> DataFrame:
    """qid and the JSON reply of each query: version, query, results in rank order (at most k)."""
    found = rows.groupBy("qid", query).agg(F.sort_array(F.collect_list(F.struct("rank", item))).alias("r"))
    return found.select("qid", F.to_json(F.struct(F.lit(EVIDENCE_VERSION).alias("schema_version"), F.col(query).alias("query"), F.transform("r", lambda x: x[item]).alias("results"))).alias("reply"))


def resolve_top_k(top_k: int | None, default: int, most: int) -> int:
    """How many results a request gets: default if it doesn't say, else what it says within 1 to most.

    The default is the operator's own choice and not cut; less than one result is refused.
    """
    if top_k is not None and top_k <= 0:
        raise ValueError(f"top_k: {top_k} results can't be given, ask for one at least")
    return default if top_k is None else min(most, top_k)
