"""Mixing sources to target weights.

Tokens (words) of each source are packed into fixed-length blocks. Each output shard's source counts are
multinomial draws, made given each source's total: a source's slots fall to the shards by binomial splits of the
range of shards, each with a generator seeded by the source and the range, so that any part of the draw can be
made anywhere and again. The mix meets the targets up to one block a source, and shards have about equal sizes.
Slots of a source go through a pseudorandom permutation of its block indices (a Feistel network with cycle
walking), pass after pass, and meet blocks by index. Sources are a table like any other: none is collected.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm._shared import lean, materialize, spread_join
from lanternfish.sources import tables

#: Words of a block; slots of an output shard on average; documents of a bucket for prefix sums.
BLOCK = 256
SHARD_SLOTS = 4096
BUCKET_DOCS = 4096
#: Slots of a source that one row of the plan stands for, copies of a row that one step expands.
PLAN_SLOTS, COPIES = 1 << 18, 4096
#: Rows of the sources' table up to which it is broadcast; a larger one is joined by a shuffle.
MOST_SOURCES = 50_000
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
OUT = ("size", "source_size", "target", "taken")


def halves(seed: int, low: int, high: int, count: int) -> tuple[int, int]:
    """(middle, slots below it): how count slots on shards low to high fall to the two halves."""
    middle = (low + high) // 2
    name = hashlib.sha256(b"%d %d %d" % (seed, low, high)).digest()
    rng = np.random.default_rng(int.from_bytes(name[:8], "little"))
    return middle, int(rng.binomial(count, (middle - low) / (high - low)))


def draw(seed: int, low: int, high: int, first: int, count: int, most: int = 0):
    """(low, high, first, count) of the shards low to high, or of ranges of them with at most most slots.

    first: the number of a range's first slot among those of the source.
    """
    todo = [(low, high, first, count)]
    while todo:
        low, high, first, count = todo.pop()
        if not count:
            continue
        if high - low == 1 or count <= most:
            yield low, high, first, count
            continue
        middle, below = halves(seed, low, high, count)
        todo += [(middle, high, first + below, count - below), (low, middle, first, below)]


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): four Feistel rounds on 2k bits, walked until below n."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            key = np.uint64(int.from_bytes(hashlib.sha256(b"%d %d" % (seed, r)).digest()[:8], "little") | 1)
            mixed = (right + np.uint64(r + 1)) * key
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def level(sources: DataFrame, share: float, most: float) -> tuple[float, float]:
    """(left, weight): a source's target is left * m_weight / weight, or most times its size where that is less.

    sources: m_size, m_weight. A target above most times the size is held there, and the excess goes to the other
    sources by weight, until none is above. Each step is an aggregation; what is held stays held.
    """
    total = share * (sources.agg(F.sum("m_size")).first()[0] or 0)
    left, weight, held = total, 1.0, None
    while True:
        over = F.lit(False) if held is None else F.lit(left) * F.col("m_weight") / F.lit(weight) > most * F.col("m_size")
        r = sources.agg(F.sum(F.when(over, most * F.col("m_size"))).alias("fixed"), F.sum(F.when(~over, F.col("m_weight"))).alias("live"), F.count_if(over).alias("n")).first()
        if r["n"] == held or not r["live"]:
            return left, weight
        left, weight, held = total - (r["fixed"] or 0.0), float(r["live"]), r["n"]


class Mix:
    """The plan of a mix over df; counts() gives what it takes of each row, blocks() the packed blocks themselves.

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating. Null texts have no
    words; sources without words have target 0. Rows with equal keys each count on their own, repeated rows too:
    as they don't differ, any of them may be the one of which more is taken. Texts of any length are whole, and
    other columns of df play no part, whatever their names. An empty table gives no rows. The same rows give the
    same mix, however they are dealt.
    """

    def __init__(self, df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 7):
        self.spark, self.key, self.source, self.block = df.sparkSession, key, source, block
        size = F.coalesce(F.regexp_count(F.col("m_text"), F.lit(WORD)), F.lit(0)).cast("long")
        name = F.when(F.col("m_source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("m_source")))
        rows = df.select(F.col(f"`{key}`").alias("m_key"), F.col(f"`{text}`").alias("m_text"), F.col(f"`{source}`").cast("string").alias("m_source"))
        self.rows = rows.select("m_key", "m_text", name.alias("m_src"), size.alias("m_size"), F.xxhash64(F.lit(seed), "m_key", "m_text").alias("m_hash"))
        # Rows that don't differ are one row with a number of copies: none of what follows can gather them.
        self.same = ["m_src", "m_hash", "m_key", "m_size"]
        self.units = materialize(self.rows.groupBy(*self.same).agg(F.count("*").alias("m_copies")), "mix-rows")
        found = self.units.groupBy("m_src").agg(F.sum(F.col("m_size") * F.col("m_copies")).alias("m_size"), F.count("*").alias("m_docs"))
        order = [(F.col("m_src") == "n").cast("int"), F.col("m_src")]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("m_place", F.monotonically_increasing_id())
        found = materialize(placed, "mix-sources")  # m_place: the partition, then 33 bits of the place in it
        before, ahead = [], 0
        for r in found.groupBy(F.shiftright("m_place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per partition
            before.append((r["part"], ahead))
            ahead += r["n"]
        offsets = self.spark.createDataFrame(before, "m_part long, m_before long")
        found = found.withColumn("m_part", F.shiftright("m_place", 33)).join(F.broadcast(offsets), "m_part")
        number = F.col("m_before") + F.col("m_place").bitwiseAND(F.lit((1 << 33) - 1))
        weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (number % len(weights) + 1).cast("int"))
        found = found.select("m_src", "m_size", "m_docs", weight.alias("m_weight"))
        left, whole = level(found, share, most)
        goal = F.least(F.lit(left) * F.col("m_weight") / F.lit(whole), most * F.col("m_size"))
        blocks = F.ceil(F.col("m_size") / block)
        quota = F.when(F.col("m_size") > 0, F.least(F.floor(most * blocks), F.round(blocks * goal / F.col("m_size")).cast("long"))).otherwise(0)
        buckets = F.greatest(F.lit(1), F.ceil(F.col("m_docs") / BUCKET_DOCS))
        facts = found.select("m_src", F.col("m_size").alias("source_size"), goal.alias("target"), buckets.alias("m_buckets"), "m_docs", blocks.alias("m_blocks"), quota.cast("long").alias("m_quota"), F.xxhash64(F.lit(seed), "m_src").alias("m_seed"))
        self.facts = materialize(facts, "mix-facts")
        self.sources = ahead
        self.shards = max(1, math.ceil((self.facts.agg(F.sum("m_quota")).first()[0] or 0) / SHARD_SLOTS))

    def slots(self) -> DataFrame:
        """m_src, shard, m_block of every slot of the mix: slots of a source go through its permutation in turn."""
        shards = self.shards

        def plan(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    held = [(r["m_src"], *piece, r["m_blocks"], r["m_seed"]) for piece in draw(r["m_seed"], 0, shards, 0, r["m_quota"], PLAN_SLOTS)]
                    for low in range(0, len(held), 10_000):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held[low : low + 10_000]], schema=kinds)

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    for shard, _, first, count in draw(r["m_seed"], r["low"], r["high"], r["first"], r["slots"]):
                        for low in range(first, first + count, 1 << 18):
                            index = np.arange(low, min(first + count, low + (1 << 18)), dtype=np.int64) % r["m_blocks"]
                            which = permute(index, r["m_blocks"], r["m_seed"])
                            yield pa.RecordBatch.from_arrays([pa.array([r["m_src"]] * len(which), pa.string()), pa.array(np.full(len(which), shard), pa.int64()), pa.array(which)], names=["m_src", "shard", "m_block"])

        names = ["m_src", "low", "high", "first", "slots", "m_blocks", "m_seed"]
        kinds = pa.schema([(n, pa.string() if n == "m_src" else pa.int64()) for n in names])
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        planned = self.facts.filter("m_quota > 0").select("m_src", "m_blocks", "m_quota", "m_seed").mapInArrow(lean(plan), "m_src string, low long, high long, first long, slots long, m_blocks long, m_seed long")
        return planned.repartition(parts, "m_src", "low").mapInArrow(lean(run), "m_src string, shard long, m_block long")

    def _with_facts(self, units: DataFrame) -> DataFrame:
        facts = self.facts.select("m_src", "source_size", "target", "m_buckets", "m_docs")
        if self.sources <= MOST_SOURCES:
            return units.join(F.broadcast(facts.drop("m_docs")), "m_src")
        return spread_join(units, facts, ["m_src"], "m_docs", F.col("m_hash"))

    def placed(self, units: DataFrame) -> DataFrame:
        """A row for each copy in units with m_first, the place of its first word in its source.

        Prefix sums go over buckets of bounded size.
        """
        rows = self._with_facts(units).withColumn("m_bucket", F.pmod(F.col("m_hash"), F.col("m_buckets"))).repartition("m_src", "m_bucket")
        words = F.col("m_size") * F.col("m_copies")
        ahead = rows.groupBy("m_src", "m_bucket").agg(F.sum(words).alias("m_sum"))
        over = Window.partitionBy("m_src").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
        ahead = ahead.select("m_src", "m_bucket", F.coalesce(F.sum("m_sum").over(over), F.lit(0)).alias("m_ahead"))
        inside = Window.partitionBy("m_src", "m_bucket").orderBy("m_hash", "m_key", "m_size")
        rows = rows.withColumns({"m_end": F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "m_nth": F.row_number().over(inside)})
        rows = rows.join(ahead, ["m_src", "m_bucket"]).withColumn("m_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_copies") - 1, F.lit(COPIES).cast("long"))))
        rows = rows.withColumn("m_copy", F.explode(F.sequence("m_run", F.least(F.col("m_run") + COPIES, F.col("m_copies")) - 1)))
        return rows.withColumn("m_first", F.col("m_ahead") + F.col("m_end") - words + F.col("m_copy") * F.col("m_size"))

    def pieces(self, placed: DataFrame, *carry: str) -> DataFrame:
        """A row for each block that a row's words reach into: m_block, m_from and m_to (places in the source)."""
        reach = F.sequence(F.floor(F.col("m_first") / self.block), F.floor((F.col("m_first") + F.col("m_size") - 1) / self.block))
        cut = placed.filter("m_size > 0").select("m_src", "m_bucket", "m_nth", "m_copy", "m_first", "m_size", *carry, F.explode(reach).alias("m_block"))
        low = F.greatest(F.col("m_first"), F.col("m_block") * self.block)
        return cut.withColumns({"m_from": low, "m_to": F.least(F.col("m_first") + F.col("m_size"), (F.col("m_block") + 1) * self.block)})

    def counts(self) -> DataFrame:
        """key, source, size, source_size, target, taken (words that the mix takes of the row, repeats counted)."""
        placed, row = self.placed(self.units), ["m_src", "m_bucket", "m_nth", "m_copy"]
        times = self.slots().groupBy("m_src", "m_block").agg(F.count("*").alias("m_times"))
        met = self.pieces(placed).join(times.hint("merge"), ["m_src", "m_block"])  # grows with the input: never broadcast
        sums = met.groupBy(*row).agg(F.sum((F.col("m_to") - F.col("m_from")) * F.col("m_times")).alias("taken"))
        done = placed.join(sums.hint("merge"), row, "left")
        name = F.when(F.col("m_src") != "n", F.expr("substring(m_src, 2)"))
        return done.select(F.col("m_key").alias(self.key), name.alias(self.source), F.col("m_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def blocks(self) -> DataFrame:
        """shard, source, block, block_text of every slot: the mixed corpus. A source's last block may be shorter."""
        units = self.rows.groupBy(*self.same).agg(F.count("*").alias("m_copies"), F.first("m_text").alias("m_text"))
        words = F.regexp_extract_all(F.col("m_text"), F.lit(WORD), F.lit(0))
        cut = self.pieces(self.placed(units), "m_text")
        part = F.array_join(F.slice(words, (F.col("m_from") - F.col("m_first") + 1).cast("int"), (F.col("m_to") - F.col("m_from")).cast("int")), " ")
        packed = cut.select("m_src", "m_block", F.struct("m_from", part.alias("part")).alias("p")).groupBy("m_src", "m_block").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # at most BLOCK pieces
        text = F.array_join(F.transform("ps", lambda p: p["part"]), " ")
        met = packed.join(self.slots().hint("merge"), ["m_src", "m_block"])
        return met.select("shard", F.when(F.col("m_src") != "n", F.expr("substring(m_src, 2)")).alias(self.source), F.col("m_block").alias("block"), text.alias("block_text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", "source")
    return Mix(docs).counts().select("doc_id", *OUT)
