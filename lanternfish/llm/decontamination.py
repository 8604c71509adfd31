"""Benchmark decontamination by spaced seeds; DataFrame functions only.

A seed is a hash of the tokens that a fixed mask keeps of some consecutive ones; tokens under the mask's gaps
may differ. The masks are such that every overlap which the threshold accepts leaves a seed untouched. Seeds of documents meet seeds of benchmark items in a map-side join. At each hit, document and
item are aligned, and the overlap counts if in some window of WINDOW aligned tokens (the whole item, if it is
shorter) the share of equal tokens is at least the threshold; substitutions are allowed anywhere.

The benchmark's seeds are broadcast in blocks of items under BLOCK_BYTES; a larger benchmark takes more passes
over the documents. Documents are not shuffled: seeds of one document are made, joined and verified in one
stage of generated code, and only verified pairs leave it. Of neighbouring hits on a diagonal only the first
is verified, so a copied passage costs a few rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.sources import tables

WINDOW = 13
#: (window, substitutions): token positions that masks keep. In every window of that many tokens, wherever that many
#: are substituted, one mask fits at some place without touching a substitution (fixed values, found by search).
MASKS = {
    (13, 2): ((0, 2, 3, 5, 6, 7), (0, 1, 3, 7, 9, 10)),
    (10, 2): ((0, 1, 6, 7, 8), (0, 1, 2, 3, 5), (0, 3, 4, 6, 7)),
    (7, 1): ((0, 1, 3, 4),),
    (5, 1): ((0, 1, 2), (0, 1, 3)),
}
BLOCK_BYTES = 32 << 20
SEED_BYTES = 64


def masks_of(width: int, threshold: float) -> tuple:
    """Masks that leave a seed in every window of width tokens with a share of threshold equal ones.

    Where no entry of MASKS serves, one more class of positions than substitutions: one of them is untouched.
    """
    wrong = width - next(m for m in range(width + 1) if m / width >= threshold)
    if not wrong and width < 5:
        return (tuple(range(width)),)
    fits = [k for k in MASKS if k[0] <= width and k[1] >= wrong]
    return MASKS[max(fits)] if fits else tuple(tuple(range(g, width, wrong + 1)) for g in range(min(width, wrong + 1)))


def tokens(text):
    """Hashes of the runs of letters and digits, lower-cased; null for a null text."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _seed(mask: tuple, array, at):
    """The seed of a mask at a place; null where the mask does not fit."""
    parts = [F.get(array, at + o) for o in mask]
    return F.when((at >= 0) & (at < F.size(array) - mask[-1]), F.xxhash64(F.lit(",".join(map(str, mask))), *parts))


def _seeds(rows: DataFrame, array: str, at: str, masks: dict) -> DataFrame:
    """rows with a row for each token and mask: at, seed, and before, the seed one token earlier.

    masks: by mask the condition on which a row uses it, or None.
    """
    out = rows.select("*", F.posexplode(array).alias(at, "token")).drop("token")
    a, p = F.col(array), F.col(at)
    own = [(_seed(m, a, p), _seed(m, a, p - 1), used) for m, used in masks.items()]
    pairs = F.array(*(F.struct((seed if used is None else F.when(used, seed)).alias("seed"), before.alias("before")) for seed, before, used in own))
    made = out.select("*", F.explode(pairs).alias("pair")).select(*out.columns, F.col("pair.seed").alias("seed"), F.col("pair.before").alias("before"))
    return made.filter(F.col("seed").isNotNull())


def contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", threshold: float = 0.8) -> DataFrame:
    """key, finger (xxhash64 of the text), item, matched, coverage, best_window: a row per leaked pair.

    matched: most equal tokens of one alignment of the item to the document; coverage: their share of the
    item's tokens; best_window: the largest share of equal tokens in a window. Items of under WINDOW tokens are
    one window, so those of one to four tokens must be there without a substitution. Null and empty texts, and
    items without a token, match nothing; ties of alignments give one row with the best figures. Texts are read
    whole, however long. Repeated rows and rows of equal keys with different texts are told apart by finger;
    equal rows give one row. Other columns of either table play no part, whatever their names. An empty table
    on either side gives no rows.
    """
    items = bench.select(F.col(f"`{item}`").alias("item"), tokens(F.col(f"`{text}`")).alias("ih")).filter(F.size("ih") > 0).distinct()
    width = F.least(F.lit(WINDOW), F.size("ih"))
    found = items.groupBy(width.alias("width")).agg(F.sum(F.size("ih")).alias("held")).collect()  # WINDOW rows at most
    uses: dict[tuple, list[int]] = {}
    for r in found:
        for m in masks_of(r["width"], threshold):
            uses.setdefault(m, []).append(r["width"])
    held = sum(r["held"] * len(masks_of(r["width"], threshold)) for r in found)
    shortest = min((r["width"] for r in found), default=1)
    blocks = max(1, -(-held * SEED_BYTES // BLOCK_BYTES))
    uses = dict(sorted(uses.items())) or {(0,): []}
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("finger"), tokens(F.col(f"`{text}`")).alias("h"))
    rows = rows.filter(F.size("h") >= shortest)
    passes = []
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "ih"), F.lit(blocks)) == b)
        block = block.withColumn("ident", F.xxhash64("item", "ih"))
        seeds = _seeds(block.select("ident", "ih"), "ih", "i_at", {m: width.isin(w) for m, w in uses.items()})
        seeds = seeds.select("ident", "i_at", F.col("seed").alias("i_seed"), F.col("before").alias("i_before"))
        hits = _seeds(rows, "h", "at", dict.fromkeys(uses)).join(F.broadcast(seeds), (F.col("seed") == F.col("i_seed")) & (F.col("before").isNull() | F.col("i_before").isNull() | (F.col("before") != F.col("i_before"))))
        hits = hits.join(F.broadcast(block), "ident")
        shift = F.col("at") - F.col("i_at")
        low, high = F.greatest(F.lit(0), -shift), F.least(F.size("ih"), F.size("h") - shift)
        hits = hits.select("key", "finger", "item", F.size("ih").alias("n"), F.zip_with(F.slice("h", low + shift + 1, high - low), F.slice("ih", low + 1, high - low), lambda x, y: (x == y).cast("int")).alias("same"))
        wide = F.least(F.lit(WINDOW), F.col("n"))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
        best = F.when(F.size("same") >= wide, F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - wide + 1), lambda s: total(F.slice(F.col("same"), s, wide)))) / wide)
        passes.append(hits.select("key", "finger", "item", "n", total(F.col("same")).alias("matched"), best.alias("best_window")).filter(F.col("best_window") >= threshold))
    found = functools.reduce(DataFrame.unionByName, passes)
    found = found.groupBy("key", "finger", "item").agg(F.max("matched").cast("long").alias("matched"), F.max(F.col("matched") / F.col("n")).alias("coverage"), F.max("best_window").alias("best_window"))
    return found.withColumnsRenamed({"key": key, "item": item})


def query(spark, sf_dir: str) -> DataFrame:
    docs, bench = tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, bench).drop("finger")


#: All alignments of all documents to all items, without seeds.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS v FROM benchmark WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) > 0),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
bw AS (SELECT item_id, least(13, len(v)) AS wide, unnest(v) AS word, unnest(range(0, len(v))) AS q FROM b),
a AS (SELECT doc_id, item_id, p - q AS shift FROM dw JOIN bw USING (word) GROUP BY ALL HAVING count(*) >= 0.8 * min(wide)),
m AS (SELECT doc_id, item_id, len(v) AS n, list_transform(range(greatest(0, -shift), least(len(v), len(w) - shift)), lambda q: CAST(v[q + 1] = w[q + shift + 1] AS INTEGER)) AS m FROM a JOIN d USING (doc_id) JOIN b USING (item_id)),
s AS (SELECT doc_id, item_id, n, CAST(list_sum(m) AS BIGINT) AS matched, list_max(list_transform(range(0, len(m) - least(13, n) + 1), lambda s: list_sum(m[s + 1:s + least(13, n)]))) / least(13, n) AS best FROM m WHERE len(m) >= least(13, n))
SELECT doc_id, item_id, max(matched) AS matched, max(matched / n) AS coverage, max(best) AS best_window FROM s WHERE best >= 0.8 GROUP BY ALL
"""
