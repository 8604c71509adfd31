"""Substring dedup by seed and extend.

Seeds: in each window of WINDOW words the leftmost smallest hash of its 25-word runs is the window's anchor
(winnowing), so equal windows have equal anchors at equal places, and every window belongs to one anchor.
Join: anchors are counted over all documents; only those that two documents share go on.
Extend: an anchor is extended left and right over all windows that belong to it. Where the whole extension
equals one of a document with a smaller key, all its windows are repeats at once. Where extensions differ (the
edge of a shared passage, an edit), the first document of each distinct extension extends window by window,
and a window is a repeat if a smaller key has it. Neighbouring windows join into maximal repeats.

Extensions and windows are compared by two independent 64-bit hashes (the anchor's and their own). Minima are
taken by partial aggregation, and a batch sends each distinct extension once, so a passage that a third of all
documents share costs a row per batch, and no pairs are built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm._shared import clash_free, lean, materialize, release, small_batches, spread_join
from lanternfish.llm._tokens import chunks, hash_docs, mix64, rolling
from lanternfish.sources import tables

WINDOW = 50
#: A null key counts as the largest long: it makes no other document's words repeats.
LAST = (1 << 63) - 1
#: Seeds that a task holds at once to send equal extensions only once.
SEEDS_HELD = 400_000
OUT = ("n_words", "n_removed", "spans", "kept_text")
SEEDS = "key long, finger long, a long, f long, s0 array<int>, cnt int, dup boolean"


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of one document's anchors."""
    run = window // 2
    grams = rolling(hashes, run)
    width = window - run + 1
    n = len(grams) - width + 1
    if n <= 0:
        return grams[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[first]], first, np.diff(np.append(first, n))


def _extents(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words that each anchor's windows cover."""
    wins = rolling(hashes, window, salt=0x2545F4914F6CDD1D)
    out = wins[first] + wins[first + count - 1] * np.uint64(0x9E3779B97F4A7C15)
    middle = wins[first + count // 2] * np.uint64(0xD6E8FEB86659FD93)
    return mix64(out ^ middle ^ (count.astype(np.uint64) << np.uint64(57)) ^ anchor)


def _seed(window: int):
    def collapse(parts):
        """One batch of seeds; of equal extensions only those of the smallest key go on, a row per text."""
        columns = [np.concatenate(p) for p in parts]
        order = np.lexsort((columns[4], columns[1], columns[0], columns[3], columns[2]))
        key, finger, a_, f, s0, cnt = (c[order] for c in columns)
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a_[1:] != a_[:-1]) | (f[1:] != f[:-1])
        own = new.copy()
        own[1:] |= (key[1:] != key[:-1]) | (finger[1:] != finger[:-1])
        at = np.flatnonzero(own)
        same = key[at] > key[np.flatnonzero(new)][(np.cumsum(new) - 1)[at]]
        places = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int32()), pa.array(s0, pa.int32()))
        cols = [pa.array(key[at]), pa.array(finger[at]), pa.array(a_[at]), pa.array(f[at]), places, pa.array(cnt[at], pa.int32()), pa.array(same)]
        return pa.RecordBatch.from_arrays(cols, names=["key", "finger", "a", "f", "s0", "cnt", "dup"])

    def seed(batches):
        parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
        held = 0
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys, fingers = (batch.column(c).to_numpy() for c in (0, 2))
            for a, b in chunks(texts):
                hashes, lengths = hash_docs(texts[a:b])
                ends = np.cumsum(lengths)
                for row, (low, high) in enumerate(zip(ends - lengths, ends, strict=True), a):
                    own = hashes[low:high]
                    anchor, first, count = anchors(own, window)
                    if len(anchor):
                        extent = _extents(own, first, count, anchor, window)
                        m = len(anchor)
                        for part, x in zip(parts, (np.full(m, keys[row]), np.full(m, fingers[row]), anchor.view(np.int64), extent.view(np.int64), first, count), strict=True):
                            part.append(x)
                        held += m
            if held >= SEEDS_HELD:
                yield collapse(parts)
                parts, held = [[], [], [], [], [], []], 0
        if held:
            yield collapse(parts)

    return seed


def _windows(window: int):
    """(a, w, key, finger, s) of every window of the listed anchors; s has its places in the text."""

    def windows(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            keys, fingers, wanted = (batch.column(c).to_pylist() for c in (0, 1, 3))
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for low, high in chunks(texts):
                hashes, lengths = hash_docs(texts[low:high])
                ends = np.cumsum(lengths)
                for row, (x, y) in enumerate(zip(ends - lengths, ends, strict=True), low):
                    wins = rolling(hashes[x:y], window, salt=0x632BE59BD9B4E019)
                    found = [e for e in wanted[row] if e["s0"][-1] + e["cnt"] <= len(wins)]
                    s0, cnt, a, n = (np.array(x, dtype=np.int64) for x in ([e["s0"][0] for e in found], [e["cnt"] for e in found], [e["a"] for e in found], [len(e["s0"]) for e in found]))
                    step = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                    s = np.repeat(s0, cnt) + step
                    if (n == 1).all():
                        places, size = s, np.ones(len(s), dtype=np.int64)
                    else:
                        lists = [np.array(e["s0"], dtype=np.int64) for e in found]
                        places = np.concatenate([(x[None, :] + np.arange(c)[:, None]).reshape(-1) for x, c in zip(lists, cnt, strict=True)])
                        size = np.repeat(n, cnt)
                    for part, v in zip(parts, (np.repeat(a, cnt), wins[s].view(np.int64), np.full(len(s), keys[row]), np.full(len(s), fingers[row]), places, size), strict=True):
                        part.append(v)
            if parts[0]:
                a, w, key, finger, places, size = (np.concatenate(p) for p in parts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(w), pa.array(key), pa.array(finger, pa.int64()), lists], names=["a", "w", "key", "finger", "s"])

    return windows


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """(key, finger, from, to): word ranges of rows (key, text, finger) that windows of smaller keys cover."""
    spark = rows.sparkSession
    seeds = materialize(rows.mapInArrow(lean(_seed(window)), SEEDS), "seeds")
    local = materialize(seeds.filter("dup").select("key", "finger", "s0", "cnt"), "repeats")
    live, row = seeds.filter("NOT dup").drop("dup"), F.xxhash64("key", "finger")
    shared = live.groupBy("a").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).filter("low < high").select("a", "n")
    shared = materialize(shared, "shared-anchors")
    live = materialize(spread_join(live, shared, ["a"], "n", row), "shared-seeds")
    release(spark, seeds)
    whole = live.groupBy("a", "f").agg(F.min("key").alias("least"))
    several = whole.groupBy("a").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    judged = materialize(live.join(whole, ["a", "f"]), "extensions")  # a row of each (a, f) per batch at most
    several = materialize(several, "several")
    release(spark, live)
    full = judged.filter("least < key").select("key", "finger", "s0", "cnt")
    firsts = spread_join(judged.filter("least = key"), several, ["a"], "kinds", row)
    wanted = firsts.groupBy("key", "finger").agg(F.collect_set(F.struct("s0", "cnt", "a")).alias("wanted"))
    wins = wanted.join(rows, ["key", "finger"]).select("key", "finger", "text", "wanted")
    wins = materialize(wins.mapInArrow(lean(_windows(window)), "a long, w long, key long, finger long, s array<int>"), "windows")
    again = wins.groupBy("a", "w").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).filter("least < most")
    again = materialize(again.select("a", "w", "least", "n"), "repeated-windows")
    part = spread_join(wins, again, ["a", "w"], "n", row).filter("least < key").select("key", "finger", F.col("s").alias("s0"), F.lit(1).alias("cnt"))
    found = local.unionByName(full).unionByName(part).select("key", "finger", F.explode("s0").alias("from"), "cnt")
    return found.select("key", "finger", "from", (F.col("from") + F.col("cnt") + window - 1).alias("to"))


def _strip(width: int):
    def strip(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(width).cast(pa.binary()).to_pylist()]
            total, removed, spans, kept = [], [], [], []
            for t, found in zip(texts, batch.column(width + 1).to_pylist(), strict=True):
                words, merged = t.split(), []
                for a, b in sorted((e["from"], e["to"]) for e in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                out, low = [], 0
                for a, b in merged:
                    out += words[low:a]
                    low = b
                out += words[low:]
                total.append(len(words))
                removed.append(len(words) - len(out))
                spans.append([{"from": a, "to": b} for a, b in merged])
                kept.append(b" ".join(out).decode())
            kinds = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            cols = [*batch.columns[:width], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{k}" for k in range(width)] + list(OUT))

    return strip


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, payload: list[str] | None = None) -> DataFrame:
    """Columns of df (or payload) with n_words, n_removed, spans (word ranges that go) and kept_text.

    A word goes if a window of window words that covers it also starts in a row with a smaller key; windows
    are judged on the input. A null text has no words. A null key counts as the largest long, and rows of equal
    keys never remove each other's words: they are told apart by a 64-bit hash of the text, and repeated rows
    get equal results. Texts shorter than a window stay whole, long ones are read whole. Columns of df named
    like an output column are replaced. An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    df = clash_free(df, *OUT)
    payload = df.columns if payload is None else payload
    names = [f"c{k}" for k in range(len(payload))]
    order = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST))
    finger = F.xxhash64(F.col(f"`{text}`"))  # tells rows of one key apart
    wide = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(payload, names, strict=True)), order.alias("key"), F.col(f"`{text}`").alias("text"), finger.alias("finger"))
    found = repeated_windows(wide.select("key", "text", "finger"), window)
    spans = found.groupBy("key", "finger").agg(F.collect_set(F.struct("from", "to")).alias("found"))
    joined = wide.join(spans, ["key", "finger"], "left").select(*names, "text", "found")
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, payload, strict=True))
    out = joined.mapInArrow(lean(_strip(len(names))), f"{schema}, n_words long, n_removed long, spans array<struct<from:int,to:int>>, kept_text string")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, payload, strict=True)), *OUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    out = remove_repeats(docs, payload=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM t WHERE len(w) >= 50),
v AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 50], ' ') AS v FROM s),
f AS (SELECT v, min(doc_id) AS low FROM v GROUP BY v HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM v JOIN f USING (v) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM t),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
