"""Redirect chains over a table of known hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def follow(facts: DataFrame, budget: int = 5) -> DataFrame:
    """url, final, hops, error of each url of facts (url, location; null where it answers itself).

    budget responses are looked at, so budget - 1 redirects succeed; a longer chain, or a loop, is an error,
    and so is a hop to an unknown url. A bounded number of equi-joins; urls that have arrived join no more.
    """
    hop = facts.select(F.col("url").alias("want"), F.col("location").alias("then"), F.lit(True).alias("found"))
    now = facts.select("url", F.col("url").alias("at"), F.col("location").alias("next"), F.lit(0).alias("hops"), F.lit(True).alias("known"))
    arrived = []
    for _ in range(budget - 1):
        arrived.append(now.filter("NOT known OR next IS NULL"))  # apart, or all would meet under one null key
        met = now.filter("known AND next IS NOT NULL").withColumnRenamed("next", "want").join(hop, "want", "left")
        now = met.select("url", F.col("want").alias("at"), F.col("then").alias("next"), (F.col("hops") + 1).alias("hops"), F.coalesce("found", F.lit(False)).alias("known"))
    for part in arrived:
        now = now.unionByName(part)
    error = F.when(~F.col("known"), F.lit("unknown url")).when(F.col("next").isNotNull(), F.lit("too many redirects"))
    return now.select("url", F.when(error.isNull(), F.col("at")).alias("final"), "hops", error.alias("error"))
