"""Durable chunks: an append-only run of Parquet segments with versioned manifests, and a whole-rewrite store.

A segment holds chunks, their sources with counts, and their postings. A manifest is a small JSON list of segment
and deletion entries with their sizes; version n + 1 is published by a rename that fails if it exists, after its
data is complete. Readers pin a version, so a query sees one state, and a crash leaves at most files that no
manifest names. What is live follows from the log: per source the last entry that wrote or removed it.

Upkeep grows with what changed: many segments are merged from the newest back while they are of similar size, so
that a chunk is rewritten a logarithmic number of times, and of dead weight only the segments that hold it are
written anew. What is dead is looked up once a tenth of the store has changed.
"""

from __future__ import annotations

import json
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import text
from lanternfish.operators import bm25
from lanternfish.schema import CHUNK, STATS

FORMAT = 2
#: When compaction pays: dead share and least number of dead chunks, or many segments.
DEAD_RATIO, DEAD_LEAST, SEGMENTS_MOST = 0.3, 64, 32
#: Share of the store that changes between two looks for dead weight.
CHANGED = 0.1


class StoreCorrupt(Exception):
    """The store is there but can't be read; it holds the only copy, so nobody starts afresh over it."""


class ChunkStore(Protocol):
    def version(self) -> int: ...
    def load(self, version: int | None = None) -> DataFrame: ...
    def postings(self, version: int | None = None) -> DataFrame | None: ...
    def totals(self, version: int | None = None) -> tuple[int, int]: ...
    def upsert(self, chunks: DataFrame) -> None: ...
    def delete_sources(self, sources: list[str]) -> None: ...
    def stats(self, version: int | None = None) -> DataFrame: ...


def replay(log: DataFrame) -> DataFrame:
    """source, pos, n (and dl) of live sources from log rows (pos, source, n, removed): the last entry of a source counts."""
    told = [c for c in ("pos", "n", "dl") if c in log.columns]
    last = log.groupBy("source").agg(F.max_by(F.struct(*told, "removed"), F.struct("pos", "removed")).alias("l"))
    return last.filter(~F.col("l.removed")).select("source", *(f"l.{c}" for c in told))


def compaction_due(written: int, live: int, segments: int) -> bool:
    dead = written - live
    return segments > SEGMENTS_MOST or dead >= DEAD_LEAST and dead >= DEAD_RATIO * written


class _Files:
    """The file operations that a manifest needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        if not self.fs.exists(self.path("")):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path("")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", errors="replace")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write under another name, then rename; fails if name exists."""
        tmp = self.path(f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        context.rename(self.fs.makeQualified(tmp), self.fs.makeQualified(self.path(name)), options)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class SegmentedStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files, self.folder = spark, _Files(spark, folder), folder.rstrip("/")
        self._live: dict[int, dict[int, tuple[int, int, int]]] = {}

    # -- the log -------------------------------------------------------------

    def version(self) -> int:
        found = [n for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json")]
        return int(found[-1][9:-5]) if found else 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"format": FORMAT, "next": 1, "changed": 0, "entries": []}
        try:
            out = json.loads(self.files.read(f"manifest-{version:09d}.json"))
            if out["format"] != FORMAT or not isinstance(out["entries"], list) or not isinstance(out["next"], int):
                raise ValueError("not a manifest of this format")
        except (ValueError, KeyError, TypeError) as e:
            raise StoreCorrupt(f"manifest {version} in {self.folder}: {e}") from e
        return out

    def _commit(self, base: int, entries: list[dict], following: int, changed: int = 0) -> None:
        while entries and entries[0]["removes"]:  # nothing older is left to remove
            entries = entries[1:]
        self.files.publish(f"manifest-{base + 1:09d}.json", json.dumps({"format": FORMAT, "next": following, "changed": changed, "entries": entries}, separators=(",", ":")))

    def _path(self, name: str, part: str) -> str:
        return f"{self.folder}/{name}/{part}"

    def _placed(self, rows: DataFrame, places: dict[str, int]) -> DataFrame:
        """rows read from segments with pos, the place of each one's entry."""
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
        known = F.create_map(*(F.lit(x) for item in places.items() for x in item))  # an entry per segment
        return rows.withColumn("pos", known[name])

    def log(self, version: int | None = None) -> DataFrame:
        """pos, source, n, dl, removed of every entry."""
        entries = self.manifest(version)["entries"]
        out = self.spark.createDataFrame([], "pos int, source string, n long, dl long, removed boolean")
        for removed in (False, True):
            places = {e["name"]: pos for pos, e in enumerate(entries) if e["removes"] == removed}
            if places:
                rows = self.spark.read.schema("source string, n long, dl long").parquet(*(self._path(n, "sources") for n in places))
                out = out.unionByName(self._placed(rows, places).select("pos", "source", "n", "dl", F.lit(removed).alias("removed")))
        return out

    def live(self, version: int | None = None) -> dict[int, tuple[int, int, int]]:
        """By entry the chunks, tokens and sources that are live in it: a pass over the log for each new version."""
        version = self.version() if version is None else version
        if version not in self._live:
            found = replay(self.log(version)).groupBy("pos").agg(F.sum("n"), F.sum("dl"), F.count("*")).collect()  # a row per segment
            self._live = {v: x for v, x in self._live.items() if v > version - 4} | {version: {r[0]: tuple(r[1:]) for r in found}}
        return self._live[version]

    # -- reading ---------------------------------------------------------------

    def _read(self, part: str, version: int | None, only: set[int] | None = None) -> DataFrame | None:
        """Live rows of segments (all, or those of some entries) with pos.

        Segments without live sources aren't read, and those that are live as a whole are read as they are.
        """
        version = self.version() if version is None else version
        entries, live = self.manifest(version)["entries"], self.live(version)
        needed = {p for p in live if only is None or p in only}
        whole = {p for p in needed if live[p][0] == entries[p]["n"]}
        out = None
        for kind, wanted in (("whole", whole), ("part", needed - whole)):
            if not wanted:
                continue
            places = {entries[p]["name"]: p for p in sorted(wanted)}
            try:
                rows = self._placed(self.spark.read.option("mergeSchema", "true").parquet(*(self._path(n, part) for n in places)), places)
            except Exception as e:
                raise StoreCorrupt(f"segments of {self.folder}: {e}") from e
            if kind == "part":
                rows = rows.join(replay(self.log(version)).filter(F.col("pos").isin(list(wanted))).select("source", "pos"), ["source", "pos"], "left_semi")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def load(self, version: int | None = None) -> DataFrame:
        """Live chunks with pos; (pos, row) is corpus order. Empty where nothing was stored."""
        rows = self._read("chunks", version)
        if rows is None:
            return self.spark.createDataFrame([], CHUNK).withColumns({"row": F.lit(0).cast("long"), "pos": F.lit(0), "dl": F.lit(0).cast("long")})
        return rows

    def postings(self, version: int | None = None) -> DataFrame | None:
        return self._read("postings", version)

    def totals(self, version: int | None = None) -> tuple[int, int]:
        """(chunks, tokens) that are live."""
        live = self.live(version).values()
        return sum(x[0] for x in live), sum(x[1] for x in live)

    def stats(self, version: int | None = None) -> DataFrame:
        """One row: live_chunks, sources, dead_chunks, segments."""
        version = self.version() if version is None else version
        segments, live = [e for e in self.manifest(version)["entries"] if not e["removes"]], self.live(version).values()
        chunks = sum(x[0] for x in live)
        return self.spark.createDataFrame([(chunks, sum(x[2] for x in live), sum(e["n"] for e in segments) - chunks, len(segments))], STATS)

    # -- writing -----------------------------------------------------------------

    def _write(self, kind: str, number: int, chunks: DataFrame) -> dict | None:
        """The entry of a new segment; None where there is no chunk. Every chunk has a vector or none has, all of one width."""
        name = f"{kind}-{number:06d}-{uuid.uuid4().hex[:8]}"
        ordered = chunks if "row" in chunks.columns else chunks.withColumn("row", F.monotonically_increasing_id())
        ordered.drop("pos").withColumn("dl", F.size(text.tokens(F.col("content"))).cast("long")).write.parquet(self._path(name, "chunks"))
        done = self.spark.read.parquet(self._path(name, "chunks"))
        width = F.coalesce(F.size("embedding"), F.lit(-1)) if "embedding" in done.columns else F.lit(0)
        sizes = done.groupBy("source").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), F.min(width).alias("low"), F.max(width).alias("high"))
        sizes.write.parquet(self._path(name, "sources"))
        r = self.spark.read.parquet(self._path(name, "sources")).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"), F.min("low").alias("low"), F.max("high").alias("high")).first()
        if not r["n"]:
            self.files.remove(name)
            return None
        if r["low"] != r["high"] or r["low"] < 0:
            raise ValueError(f"chunks and vectors don't match: widths from {r['low']} to {r['high']}")
        bm25.postings(done, ["source", "row"]).sortWithinPartitions("term").write.parquet(self._path(name, "postings"))
        return {"name": name, "removes": False, "n": r["n"], "dl": r["dl"]}

    def upsert(self, chunks: DataFrame) -> None:
        """Store chunks; theirs replace all earlier ones of the same sources. Nothing to store: no new version."""
        base = self.version()
        m = self.manifest(base)
        entry = self._write("seg", m["next"], chunks)
        if entry:
            self._commit(base, [*m["entries"], entry], m["next"] + 1, m["changed"] + entry["n"])
            self.compact_if_due()

    def delete_sources(self, sources: list[str] | DataFrame) -> None:
        """Log the removal of sources that are live; none live: no new version."""
        wanted = sources if isinstance(sources, DataFrame) else self.spark.createDataFrame([(s,) for s in sources], "source string")
        base = self.version()
        m = self.manifest(base)
        name = f"del-{m['next']:06d}-{uuid.uuid4().hex[:8]}"
        gone = replay(self.log(base)).join(wanted.select("source").distinct(), "source", "left_semi")
        gone.select("source", "n", "dl").sort("source").write.parquet(self._path(name, "sources"))
        n = self.spark.read.parquet(self._path(name, "sources")).agg(F.sum("n")).first()[0]
        if not n:
            self.files.remove(name)
            return
        self._commit(base, [*m["entries"], {"name": name, "removes": True, "n": n, "dl": 0}], m["next"] + 1, m["changed"] + n)
        self.compact_if_due()

    def compact_if_due(self) -> bool:
        """Merge the newest segments where there are too many; then write anew those with much dead weight, if it is time to look."""
        base = self.version()
        entries = self.manifest(base)["entries"]
        at = [p for p, e in enumerate(entries) if not e["removes"]]
        done = len(at) > SEGMENTS_MOST
        if done:
            n, tail = entries[at[-1]]["n"], 1
            while tail < len(at) and (tail < 2 or entries[at[-tail - 1]]["n"] <= 2 * n):
                n += entries[at[-tail - 1]]["n"]
                tail += 1
            self._merge(base, set(at[-tail:]))
        return self._reclaim() or done

    def _merge(self, base: int, at: set[int]) -> None:
        """One segment, the newest, in place of some that no others stand between: corpus order stays."""
        m = self.manifest(base)
        rows = self._read("chunks", base, at)
        left = [e for p, e in enumerate(m["entries"]) if p not in at]
        if rows is not None:
            entry = self._write("seg", m["next"], rows.sort("pos", "row").drop("row"))
            left = [*left, entry] if entry else left
        self._commit(base, left, m["next"] + 1, m["changed"])

    def _reclaim(self) -> bool:
        base = self.version()
        m = self.manifest(base)
        written = sum(e["n"] for e in m["entries"] if not e["removes"])
        if m["changed"] < CHANGED * written:
            return False
        live = self.live(base)
        entries, following, due = [], m["next"], compaction_due(written, sum(x[0] for x in live.values()), 0)
        for p, e in enumerate(m["entries"]):
            n = live.get(p, (0,))[0]
            if due and not e["removes"] and e["n"] - n >= DEAD_RATIO * e["n"]:
                if n:
                    entries.append(self._write("seg", following, self._read("chunks", base, {p})))
                    following += 1
            else:
                entries.append(e)
        if due:
            self._commit(base, entries, following)
        return due

    def compact(self) -> None:
        """Rewrite all that is live as one segment; readers of older versions go on."""
        base = self.version()
        self._merge(base, {p for p, e in enumerate(self.manifest(base)["entries"]) if not e["removes"]})

    def vacuum(self) -> list[str]:
        """Remove what the current manifest doesn't name; only when nobody reads older versions. Returns the names."""
        version = self.version()
        named = {e["name"] for e in self.manifest(version)["entries"]} | {f"manifest-{version:09d}.json"}
        gone = [n for n in self.files.names() if n not in named and n.lstrip(".").startswith(("seg-", "del-", "manifest-"))]
        for n in gone:
            self.files.remove(n)
        return gone

    def adopt(self, chunks: DataFrame) -> bool:
        """Take over a store of the whole-rewrite kind as the first segment; only where nothing is stored yet."""
        if self.version():
            return False
        self.upsert(chunks.sort("pos", "row").drop("row") if "pos" in chunks.columns else chunks)
        return True


class RewriteStore:
    """The whole store in one table, rewritten by every change and swapped in: simple, and the way back."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files, self.folder = spark, _Files(spark, folder), folder.rstrip("/")

    def version(self) -> int:
        found = [n for n in self.files.names() if n.startswith("current-")]
        return int(found[-1][8:]) if found else 0

    def _current(self, version: int | None = None) -> str | None:
        version = self.version() if version is None else version
        return self.files.read(f"current-{version:09d}").strip() if version else None

    def load(self, version: int | None = None) -> DataFrame:
        name = self._current(version)
        if name is None:
            return self.spark.createDataFrame([], CHUNK).withColumns({"row": F.lit(0).cast("long"), "pos": F.lit(0)})
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:
            raise StoreCorrupt(f"{self.folder}/{name}: {e}") from e

    def _swap(self, rows: DataFrame) -> None:
        nth = self.version() + 1
        name = f"all-{nth:09d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.folder}/{name}")
        self.files.publish(f"current-{nth:09d}", name)

    def upsert(self, chunks: DataFrame) -> None:
        if chunks.isEmpty():
            return
        old = self.load()
        kept = old.join(chunks.select("source").distinct(), "source", "left_anti")
        last = old.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
        new = chunks.drop("pos").withColumn("pos", F.lit(last + 1))
        if "row" not in new.columns:
            new = new.withColumn("row", F.monotonically_increasing_id())
        self._swap(kept.unionByName(new, allowMissingColumns=True))

    def delete_sources(self, sources: list[str]) -> None:
        wanted = self.spark.createDataFrame([(s,) for s in sources], "source string")
        old = self.load()
        if not old.join(wanted, "source", "left_semi").isEmpty():
            self._swap(old.join(wanted, "source", "left_anti"))

    def postings(self, version: int | None = None) -> None:
        """None: this store keeps no index."""

    def totals(self, version: int | None = None) -> tuple[int, int]:
        r = bm25.stats(bm25.lengths(self.load(version), [])).first()
        return r["n"], r["total_length"]

    def stats(self, version: int | None = None) -> DataFrame:
        rows = self.load(version).agg(F.count("*").alias("live_chunks"), F.count_distinct("source").alias("sources"))
        return rows.select("live_chunks", "sources", F.lit(0).cast("long").alias("dead_chunks"), F.lit(1).cast("long").alias("segments"))


def make_store(kind: str, spark: SparkSession, folder: str) -> SegmentedStore | RewriteStore:
    kinds = {"segmented": SegmentedStore, "rewrite": RewriteStore}
    if kind not in kinds:
        raise ValueError(f"chunk store must be one of {sorted(kinds)}, got {kind!r}")
    out = kinds[kind](spark, folder)
    if kind == "segmented" and not out.version() and RewriteStore(spark, folder).version():
        out.adopt(RewriteStore(spark, folder).load())  # a store of the other kind was kept here
    return out


__all__ = ["STATS", "ChunkStore", "RewriteStore", "SegmentedStore", "StoreCorrupt", "compaction_due", "make_store", "replay"]
