"""Okapi BM25 as joins and aggregations.

postings(key, term, tf, dl) is the index: stored with each segment, so nothing is tokenised twice. Only rows of
query terms are ever joined or shuffled; document frequencies and totals are a row per query term.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import scoring, text
from lanternfish.sources import tables


def _runs(rows: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """keys, term, tf: equal tokens of each row, counted within it as runs of its sorted array. No shuffle."""
    first = F.transform("_s", lambda t, i: F.when((i == 0) | (t != F.get("_s", i - 1)), i))
    starts = rows.select(*keys, F.sort_array(tokens).alias("_s")).select(*keys, "_s", F.filter(first, lambda i: i.isNotNull()).alias("_at"))  # a filter here would cut tokens twice
    run = lambda i, k: F.struct(F.get("_s", i).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - i).cast("long").alias("tf"))
    return starts.select(*keys, F.inline(F.transform("_at", run)))


def term_counts(chunks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, term, tf: repeats within a chunk counted. A chunk's tokens are in one row, so all is combined before the shuffle."""
    return chunks.select(*keys, F.explode(text.tokens(F.col(content))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, dl: tokens of each chunk. No shuffle."""
    return chunks.select(*keys, F.size(text.tokens(F.col(content))).cast("long").alias("dl"))


def postings(chunks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, dl, term, tf of every chunk with tokens; keys name a chunk. No shuffle."""
    cut = chunks.select(*keys, text.tokens(F.col(content)).alias("_t"))
    return _runs(cut.withColumn("dl", F.size("_t").cast("long")), [*keys, "dl"], "_t")


def of_terms(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of a stored index that a batch of queries needs.

    The terms become literals of the plan, so Parquet skips row groups and pages of the postings, each file of which
    is sorted by term. Their number is bounded by the request limits.
    """
    terms = [r["term"] for r in query_terms(queries).select("term").distinct().collect()]
    return index.filter(F.col("term").isin(terms)) if terms else index.limit(0)


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def stats(lengths_: DataFrame) -> DataFrame:
    """One row: n, total_length, avgdl (0 for no chunk)."""
    out = lengths_.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_length"))
    return out.withColumn("avgdl", F.coalesce(F.try_divide(F.col("total_length").cast("double"), F.col("n")), F.lit(0.0)))


def merge_stats(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Statistics after a change, from those of what was, what came and what went: work in proportion to the change."""
    parts = old.select("n", "total_length").unionByName(added.select("n", "total_length")).unionByName(removed.select((-F.col("n")).alias("n"), (-F.col("total_length")).alias("total_length")))
    out = parts.agg(F.sum("n").alias("n"), F.sum("total_length").alias("total_length"))
    return out.withColumn("avgdl", F.coalesce(F.try_divide(F.col("total_length").cast("double"), F.col("n")), F.lit(0.0)))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term: the distinct terms of each query."""
    return queries.select("qid", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term"))


def chunk_frequency(chunks: DataFrame, content: str = "content") -> DataFrame:
    """term, df straight from chunks: a chunk names each of its terms once, and what is counted is combined before the shuffle."""
    return chunks.select(F.explode(F.array_distinct(text.tokens(F.col(content)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf_table(frequency: DataFrame, stats_: DataFrame) -> DataFrame:
    return frequency.crossJoin(F.broadcast(stats_)).select("term", "df", scoring.idf(F.col("n"), F.col("df")).alias("idf"))


def matches(chunks: DataFrame, keys: list[str], queries: DataFrame, content: str = "content") -> DataFrame:
    """Postings of the query terms only, straight from chunks. Queries are bounded by the request limits."""
    return _matches(chunks, keys, list(_asked(queries)), content)


def _matches(chunks: DataFrame, keys: list[str], terms: list[str], content: str) -> DataFrame:
    cut = chunks.select(*keys, text.tokens(F.col(content)).alias("_t"))
    wanted = F.filter("_t", lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")
    return _runs(cut.select(*keys, F.size("_t").cast("long").alias("dl"), wanted.alias("_w")), [*keys, "dl"], "_w")


def score(index: DataFrame, stats_: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """qid, keys, score of every chunk that has a query term. index: postings, of query terms at least."""
    terms = query_terms(queries)
    hits = index.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    # A row per query term. It reads tf so that both uses of hits keep one plan, and Spark shuffles it once.
    df = F.broadcast(hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")))
    joined = hits.join(df, "term").join(F.broadcast(terms), "term").crossJoin(F.broadcast(stats_.select("n", "avgdl")))
    part = scoring.bm25_term(scoring.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return joined.groupBy("qid", *keys).agg(F.sum(part).alias("score"))


def _asked(queries: DataFrame) -> dict[str, list[int]]:
    """Query ids by term, on the driver: bounded by the request limits."""
    out: dict[str, list[int]] = {}
    for r in query_terms(queries).collect():
        out.setdefault(r["term"], []).append(r["qid"])
    return out


def _weigh(hits: DataFrame, n: int, avgdl: float, df: dict[str, int], asked: dict[str, list[int]], keys: list[str]) -> DataFrame:
    """qid, keys, score from postings of the asked terms: frequencies are literals, so there is no join."""
    idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in asked if df.get(t)}
    if not idf:
        return hits.select(F.lit(0).cast("long").alias("qid"), *keys, F.lit(0.0).alias("score")).filter(F.lit(False))
    weight = F.create_map(*[F.lit(x) for t, w in idf.items() for x in (t, w)])
    part = scoring.bm25_term(weight[F.col("term")], F.col("tf"), F.col("dl"), F.lit(float(avgdl)))
    who = F.create_map(*[x for t in idf for x in (F.lit(t), F.array(*map(F.lit, asked[t])).cast("array<long>"))])
    return hits.select(F.explode(who[F.col("term")]).alias("qid"), *keys, part.alias("part")).groupBy("qid", *keys).agg(F.sum("part").alias("score"))


def lookup(index: DataFrame, n: int, avgdl: float, queries: DataFrame, keys: list[str]) -> DataFrame:
    """score() over a stored index whose statistics are known, with the least latency.

    Terms and their document frequencies come to the driver (a row per query term, bounded by the request
    limits) and return as literals: the last job is one pruned scan and one aggregation, without a join.
    """
    asked = _asked(queries)
    hits = index.filter(F.col("term").isin(list(asked))) if asked else index.limit(0)
    df = {r["term"]: r["df"] for r in document_frequency(hits).collect()}
    return _weigh(hits, n, avgdl, df, asked, keys)


def score_chunks(chunks: DataFrame, keys: list[str], queries: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(qid, keys, score; statistics) straight from chunks, in two passes.

    The first counts chunks, tokens, and the chunks with each query term, into one row; the second finds the
    terms' frequencies within chunks.
    """
    asked = _asked(queries)
    terms = list(asked)
    cut = chunks.select(text.tokens(F.col(content)).alias("_t"))
    counts = [F.coalesce(F.sum(F.size("_t")), F.lit(0)).cast("long").alias("total"), *(F.count_if(F.array_contains("_t", t)).alias(f"t{k}") for k, t in enumerate(terms))]
    r = cut.agg(F.count("*").alias("n"), *counts).first()
    n, total = r["n"], r["total"]
    avgdl = total / n if n else 0.0
    known = tables.local(chunks.sparkSession, [[n], [total], [avgdl]], "n long, total_length long, avgdl double")
    found = _weigh(_matches(chunks, keys, terms, content), n, avgdl, {t: r[f"t{k}"] for k, t in enumerate(terms)}, asked, keys)
    return found, known


def spread(scores: DataFrame, stats_: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, low, high over the whole corpus, where a chunk without a match has 0. Needs only the matches."""
    found = scores.groupBy("qid").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("m"))
    out = queries.select("qid").join(F.broadcast(found), "qid", "left").crossJoin(F.broadcast(stats_.select("n")))
    some = F.coalesce(F.col("m"), F.lit(0)) < F.col("n")
    zero = lambda f, c: F.when(some, f(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).otherwise(F.col(c))
    return out.select("qid", zero(F.least, "low").alias("low"), zero(F.greatest, "high").alias("high"))
