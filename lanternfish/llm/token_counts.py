"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens, fitted on a bounded sample of rows; it
only saves time and never changes a count. Tier two encodes a pre-token that the table lacks with the
tokenizer library and keeps its length in a bounded cache of the Python worker. No pre-token is shuffled.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm._shared import lean, small_batches
from lanternfish.sources import tables

#: Rows from which the table of frequent pre-tokens is fitted, and the most entries it may have.
SAMPLE_ROWS = 2000
TABLE_ENTRIES = 1 << 16
#: Entries of a worker's cache, and the longest pre-token (characters) kept in it.
CACHE_ENTRIES = 1 << 18
CACHE_CHARS = 64
#: The pattern of byte-level BPE vocabularies of this family (fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _splitter(path: str):
    """(tokenizer, findall, special strings) of a byte-level BPE file."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    pieces = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    return tokenizer, regex.compile(PATTERN).findall, pieces


class Lengths(dict):
    """Tier two: pre-token to number of tokens; what is missing is encoded."""

    def __init__(self, frequent: dict[str, int], tokenizer):
        super().__init__(frequent)
        self.frequent, self.tokenizer = frequent, tokenizer

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= len(self.frequent) + CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def count_tokens(text: str, lengths: Lengths, findall, special) -> int:
    if special is None:
        return sum(map(lengths.__getitem__, findall(text)))
    parts = special.split(text)
    return len(parts) - 1 + sum(sum(map(lengths.__getitem__, findall(p))) for p in parts)


def token_counts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row of df.

    path: a byte-level BPE file of the tokenizers library; each executor must have it there. A null text
    counts as empty (0 bytes, 0 tokens); special strings in a text count as one token each, as the library
    does by default. Rows with equal or null keys are counted each on its own, so there are no ties. Texts and
    pre-tokens of any length are encoded whole. Other columns of df play no part, whatever their names. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.count()
    keep = min(1.0, SAMPLE_ROWS / max(1, rows))
    chosen = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(1 << 62)) < int(keep * (1 << 62))
    sample = df.filter(chosen).select(F.col(f"`{text}`").alias("t"))

    def frequent(batches):
        _, findall, special = _splitter(path)
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for part in special.split(t or "") if special else [t or ""]:
                    counts.update(findall(part))
            if len(counts) > 8 * TABLE_ENTRIES:
                counts = Counter(dict(counts.most_common(TABLE_ENTRIES)))
        top = [x for x in counts.most_common(TABLE_ENTRIES // 4) if len(x[0]) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())], names=["piece", "n"])

    top = sample.repartition(8).mapInArrow(lean(frequent), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).collect()
    tokenizer, _, _ = _splitter(path)
    pieces = [r["piece"] for r in top]
    table = spark.sparkContext.broadcast({p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)})

    def count(batches):
        tokenizer, findall, special = _splitter(path)
        lengths = Lengths(table.value, tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [count_tokens(t, lengths, findall, special) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(lean(count), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
