"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive digits (runs of bytes, most significant first) until a group is a
singleton or its texts have ended. Equality is decided on the bytes alone; no digest takes part.

1. The driver grows a trie of *heavy* prefixes only: at each level one aggregation counts the next digit of
   the documents below heavy nodes, and digits that hold more than half a partition's share become nodes.
   At most 2 * partitions nodes can be heavy on a level. Where their bytes go beyond TRIE_BYTES, rows below the
   nodes that find no room are put aside and solved by another pass, with a trie of its own.
   A heavy digit at which texts end is a finished group: its size and largest id are in the aggregate.
2. Every other document lies below a light prefix, that is under half a partition's share of bytes. Light
   prefixes are dealt by one shuffle; sorted by prefix, each task streams them and goes on splitting locally.

A hot text (a third of all rows, say) is finished in step 1 by partial aggregation and never gathered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.llm._shared import clash_free, lean, materialize, partitions_for, small_batches, text_bytes
from lanternfish.sources import tables

#: Widths of the successive digits in bytes; the last repeats.
WIDTHS = (8, 24, 96, 384, 1536, 6144, 24576, 98304)
#: Bytes of prefixes that a pass's trie may hold on the driver and in a broadcast, besides those of one text.
TRIE_BYTES = 64 << 20
ROW_WEIGHT = 64
OUT = ("keep_id", "group_size", "kept", "text_sha256")


def _width(level: int) -> int:
    return WIDTHS[min(level, len(WIDTHS) - 1)]


def _walk(text: bytes, levels: list[dict]):
    """(level, node, digit, ended, finished group or None): where the text leaves the trie of heavy prefixes."""
    node, off = 0, 0
    for level in range(len(levels) + 1):
        w = _width(level)
        digit, ended = text[off : off + w], len(text) <= off + w
        hit = levels[level].get((node, digit, ended)) if level < len(levels) else None
        if hit is None:
            return level, node, digit, ended, None
        if hit[0] < 0:
            return level, node, digit, ended, hit
        node, off = hit[0], off + w
    raise AssertionError("unreachable")


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Indices of equal texts, by recursive splitting on successive digits."""
    done, todo = [], [(list(range(len(texts))), 0, 0)]
    while todo:
        members, off, level = todo.pop()
        w = _width(level)
        parts: dict[bytes, list[int]] = {}
        for i in members:
            parts.setdefault(texts[i][off : off + w], []).append(i)
        for digit, group in parts.items():
            if len(group) == 1 or len(digit) < w:
                done.append(group)
            else:
                todo.append((group, off + w, level + 1))
    return done


def _heavy_trie(df: DataFrame, text: str, key: str, capacity: float) -> tuple[list[dict], set[int]]:
    """(the trie by level, nodes whose rows another pass solves).

    Of the nodes that may grow, one, the lead, always finds room: each pass brings it to an end.
    """
    sc = df.sparkSession.sparkContext
    levels: list[dict] = []
    nodes, size, lead, later = 0, 0, 0, set()
    while True:
        trie, depth = sc.broadcast(levels), len(levels)

        def digits(batches, trie=trie, depth=depth):
            seen: dict[tuple, list] = {}

            def flush():
                rows = [(*k, *v) for k, v in seen.items()]
                seen.clear()
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["node", "digit", "ended", "n", "weight", "max_id"])

            held = 0
            for batch in batches:
                ids = batch.column(1).to_pylist()
                for t, i in zip(text_bytes(batch.column(0)), ids, strict=True):
                    t = t.lower()
                    level, node, digit, ended, hit = _walk(t, trie.value)
                    if level < depth or hit:
                        continue
                    cell = seen.get((node, digit, ended))
                    if cell is None:
                        seen[node, digit, ended] = [1, len(t) + ROW_WEIGHT, i]
                        held += len(digit) + 100
                        if held > 32 << 20:
                            yield flush()
                            held = 0
                    else:
                        cell[0] += 1
                        cell[1] += len(t) + ROW_WEIGHT
                        cell[2] = i if cell[2] is None else cell[2] if i is None else max(i, cell[2])
            yield flush()

        counted = (
            df.select(F.col(f"`{text}`"), F.col(f"`{key}`").cast("long"))
            .mapInArrow(lean(digits), "node long, digit binary, ended boolean, n long, weight long, max_id long")
            .groupBy("node", "digit", "ended")
            .agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max("max_id").alias("max_id"))
            .filter((F.col("weight") > capacity) & (F.col("n") > 1))
        )
        found = counted.collect()  # under 2 * partitions rows: each holds more than half a partition's share
        level, grows, first = {}, False, None
        for r in sorted(found, key=lambda r: (-r["weight"], r["node"], r["digit"], r["ended"])):
            leads = r["node"] == lead and first is None
            if size + len(r["digit"]) > TRIE_BYTES and not leads:
                later.add(r["node"])
                continue
            size += len(r["digit"])
            nodes += 1
            level[r["node"], bytes(r["digit"]), r["ended"]] = (-nodes, r["max_id"], r["n"]) if r["ended"] else (nodes,)
            grows |= not r["ended"]
            if leads:
                first = -nodes if r["ended"] else nodes
        lead = first
        if level:
            levels.append(level)
        if not grows:
            return levels, later


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", keep_only: bool = False, payload: list[str] | None = None) -> DataFrame:
    """Rows of df with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and so equals ''. Of equal
    texts the row with the largest key stays (a null key is smaller than any other; if all are null, any one
    row stays and keep_id is null). Rows that repeat both key and text: exactly one stays. group_size counts
    rows. Columns of df named like an output column are replaced. keep_only: return only rows that stay.
    payload: columns to return besides (default: all). Texts are compared whole. An empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = clash_free(df, *OUT)
    payload = df.columns if payload is None else payload
    total = df.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + ROW_WEIGHT)).first()[0] or 0
    parts = partitions_for(spark, total, 32 << 20)
    trie = spark.sparkContext.broadcast(_heavy_trie(df, text, key, total / (2 * parts)))
    postponed = bool(trie.value[1])
    names = [f"c{k}" for k in range(len(payload))]
    fields = [T.StructField(n, df.schema[c].dataType, True) for n, c in zip(names, payload, strict=True)]
    routed_schema = T.StructType([*fields, *(T.StructField(n, k, True) for n, k in (("b_text", T.BinaryType()), ("b_key", T.LongType()), ("b_bucket", T.LongType()), ("b_node", T.LongType()), ("b_keep", T.LongType()), ("b_n", T.LongType())))])
    out_schema = T.StructType([*fields, T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("text_sha256", T.StringType())])
    width = len(names)

    def put_aside(batches):
        levels, later = trie.value
        for batch in batches:
            out = (_walk(t.lower(), levels) for t in text_bytes(batch.column(width)))
            yield batch.filter(pa.array([hit is None and node in later for _, node, _, _, hit in out], pa.bool_()))

    def route(batches):
        turn, sent, (levels, later) = 0, set(), trie.value
        for batch in batches:
            keys = batch.column(width + 1).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            take = []
            for row, (t, i) in enumerate(zip(text_bytes(batch.column(width)), keys, strict=True)):
                t = t.lower()
                level, node, digit, _, hit = _walk(t, levels)
                if hit is None and node in later:
                    continue
                if hit is None:
                    bucket = xxhash.xxh64_intdigest(b"%d|%d|" % (level, node) + digit) - (1 << 63)
                    cells = (t, bucket, None, None, None)
                elif i == hit[1] and hit[0] not in sent:  # may be the row that stays: one of each task meet in a bucket
                    sent.add(hit[0])
                    cells = (hashlib.sha256(t).digest(), hit[0], -hit[0], hit[1], hit[2])
                elif keep_only:
                    continue
                else:
                    turn += 1
                    cells = (hashlib.sha256(t).digest(), xxhash.xxh64_intdigest(b"%d %d" % (turn, len(t))) - (1 << 63), -hit[0], hit[1], hit[2])
                take.append(row)
                for col, x in zip(cols, cells, strict=True):
                    col.append(x)
            kept = batch.take(pa.array(take, pa.int64()))
            extra = [pa.array(cols[0], pa.binary()), kept.column(width + 1), *(pa.array(c, pa.int64()) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays([*kept.columns[:width], *extra], names=routed_schema.names)

    def solve(batches):
        held = None

        def results(table):
            n = table.num_rows
            texts, keys = table.column("b_text").to_pylist(), table.column("b_key").to_pylist()
            node, keep, size, bucket = (table.column(c).to_pylist() for c in ("b_node", "b_keep", "b_n", "b_bucket"))
            kept, sha = [False] * n, [""] * n
            light = [i for i in range(n) if node[i] is None]
            for group in radix_groups([texts[i] for i in light]):
                rows = [light[g] for g in group]
                best = max(rows, key=lambda i: (keys[i] is not None, keys[i] or 0, -i))
                digest = hashlib.sha256(texts[best]).hexdigest()
                for i in rows:
                    keep[i], size[i], sha[i] = keys[best], len(rows), digest
                kept[best] = True
            seen = set()
            for i in range(n):
                if node[i] is not None:
                    sha[i] = texts[i].hex()
                    if bucket[i] == -node[i] and node[i] not in seen:
                        seen.add(node[i])
                        kept[i] = True
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[:width]]
            cols += [pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(kept, pa.bool_()), pa.array(sha, pa.string())]
            out = pa.Table.from_arrays(cols, names=out_schema.names)
            if keep_only:
                out = out.filter(out.column("kept"))
            yield from out.combine_chunks().to_batches(max_chunksize=5000)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            buckets = held.column("b_bucket")
            last = buckets[held.num_rows - 1]
            cut = pc.index(buckets, last).as_py()  # sorted: all before the last bucket is whole
            if cut:
                yield from results(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from results(held)

    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(payload, names, strict=True)), F.col(f"`{text}`").alias("b_text"), F.col(f"`{key}`").cast("long").alias("b_key"))
    dealt = source.mapInArrow(lean(route), routed_schema).repartition(parts, "b_bucket").sortWithinPartitions("b_bucket")
    out = dealt.mapInArrow(lean(solve), out_schema)
    if postponed:
        rest = materialize(source.mapInArrow(lean(put_aside), source.schema), "put-aside")
        out = out.unionByName(exact_dedup(rest, "b_text", "b_key", keep_only, names))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, payload, strict=True)), *OUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return exact_dedup(docs, payload=["doc_id"])


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g ON t.t = g.t
"""
