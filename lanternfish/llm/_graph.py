"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm._shared import lean, materialize, release

#: Edges that a task holds at once while it contracts them.
LOCAL_EDGES = 200_000
#: So few edges are finished in one task, which is of bounded size at any input.
LAST_EDGES = 16_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up, path = self.up, []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches):
    """Each task's edges as stars around the smallest node of what it holds."""
    forest, held = Forest(), 0

    def flush():
        pairs = [(x, forest.root(x)) for x in list(forest.up)]
        return [(a, b) for a, b in pairs if a != b]

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        held += batch.num_rows
        if held >= LOCAL_EDGES:
            pairs, forest, held = flush(), Forest(), 0
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["u", "v"])
    if held:
        pairs = flush()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["u", "v"])


def _nodes(stars: DataFrame) -> DataFrame:
    """(node, component) of every node of stars (u, v) around v."""
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least neighbour of u.

    least: u, n, m. Fewer than 1000 nodes have more than a thousandth of the edges, and more than 100, whatever
    the graph: their rows are met by a broadcast and not gathered. The others meet by a shuffle.
    """
    heavy = F.col("n") > max(100, total / 1000)
    hubs = F.broadcast(least.filter(heavy).select("u", "m"))
    met = edges.join(hubs, "u").select("u", "v", "m")
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.filter(~heavy).select("u", "m").hint("merge"), "u")
    return met.unionByName(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge between two nodes; component is its smallest node.

    edges: columns u, v of one orderable type; loops, repeats and nulls are ignored. Alternates large-star and
    small-star steps, each an aggregation and a join in which hubs are not gathered, after a local contraction;
    every step is written to the shared folder. Rounds grow with the logarithm of the largest component.
    """
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType.simpleString()
    clean = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = materialize(clean.mapInArrow(lean(_contract), f"u {kind}, v {kind}").distinct(), "components")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if 0 < mark[0] <= LAST_EDGES:
            last = materialize(now.repartition(1).mapInArrow(lean(_contract), f"u {kind}, v {kind}"), "components")
            release(spark, now)
            return _nodes(last)
        if mark[0] == 0 or (seen is not None and tuple(mark) == seen):
            return _nodes(now)
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.count("*").alias("n"), F.least("u", F.min("v")).alias("m"))
        large = _with_least(both.filter("v > u"), least, 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.mapInArrow(lean(_contract), f"u {kind}, v {kind}").distinct(), "components")
        least = large.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        small = _with_least(large, least, mark[0])
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        following = materialize(small.filter("u <> v").distinct(), "components")
        release(spark, now)
        release(spark, large)
        now = following
