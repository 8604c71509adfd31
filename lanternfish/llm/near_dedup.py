"""MinHash near-dedup with min-max hashing.

Every permutation of a document's shingles gives two signature values, its minimum and its maximum, so 96 hash
evaluations a shingle give 192 values; they are banded into 32 keys of 6. Documents with equal shingle sets
form a class first, and only classes are banded. Classes that share a key, directly or through others, form a
candidate family (connected components over stars, never pairs). Links are confirmed inside families on the
full shingle sets, and connected components over the confirmed links give the groups.

A link at a similarity of 0.85 shares no key with probability (1 - 0.85**6)**32 = 3e-7,
one at 0.80 with (1 - 0.80**6)**32 = 6e-5.
A small family is one block of a task. A large one is cut into bands of set size (a link never skips a band)
and salted blocks. In a first round each block is compared with itself and a few pivots, which gathers most copies
of one text into groups; in a second round only pairs of blocks that may link two groups are compared. Every
comparison is a unit of work of bounded size, and documents are shipped to it as sets of hashes, made once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm._graph import connected_components
from lanternfish.llm._shared import lean, materialize, partitions_for, small_batches, spread_join
from lanternfish.llm._tokens import chunks, distinct, hash_docs, mix64, rolling
from lanternfish.sources import tables

SHINGLE = 5
PERMUTATIONS, BANDS = 96, 32
#: Classes and shingles that one block may hold.
BLOCK_CLASSES, BLOCK_SHINGLES = 384, 1 << 20
#: Members of a large family's band that all its blocks meet in the first round.
PIVOTS = 4
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_FOLD = _rng.integers(0, 1 << 63, (BANDS, 2 * PERMUTATIONS // BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower-cased A-Z); too few words: the whole sequence as one."""
    out = []
    for a, b in chunks(texts):
        hashes, lengths = hash_docs([t.lower() for t in texts[a:b]])
        rolled = rolling(hashes, k)
        low = 0
        for n in lengths:
            own = rolled[low : low + n - k + 1] if n >= k else rolling(hashes[low : low + n], n) if n else hashes[:0]
            out.append(distinct(own))
            low += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under each permutation, side by side."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((PERMUTATIONS, 2), dtype=np.uint32)
    out[:, 0], out[:, 1] = 0xFFFFFFFF, 0
    for low in range(0, len(values), 2048):
        part = _MUL[:, None] * values[None, low : low + 2048] + _ADD[:, None]
        np.minimum(out[:, 0], part.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], part.max(axis=1), out=out[:, 1])
    return out.reshape(-1)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key per band from rows of signatures."""
    parts = mix64(signatures.astype(np.uint64).reshape(len(signatures), BANDS, -1) + np.uint64(1))
    return mix64((parts * _FOLD[None]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None])


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sign(batches):
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for low in range(0, len(texts), 1000):
            sets = shingle_sets(texts[low : low + 1000])
            n = [len(s) for s in sets]
            keys = band_keys(np.array([signature(s) for s in sets]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*(c.slice(low, len(sets)) for c in (batch.column(0), batch.column(2))), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), lists], names=["key", "finger", "n", "node", "bands"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of the first set of its group, by confirmed links (Jaccard * 100 >= percent)."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        both = np.array([[size[0], 0], [0, size[1]]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        column = (np.cumsum(shared) - 1)[inverse]
        row = np.repeat(np.arange(m), size)
        live = shared[inverse]
        row, column = row[live], column[live]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((m, m), dtype=np.float64)
        step = 4096
        for low in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(column, [low, low + step])
            dense = np.zeros((m, step), dtype=np.float32)
            dense[row[a:b], column[a:b] - low] = 1
            both += dense @ dense.T
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, True)
    label = np.arange(m)
    while True:
        new = np.where(link, label[None, :], m).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _shingle(batches):
    """(node, sets) of texts; a row whose text is not that of the node's class is left out."""
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        sets = shingle_sets([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
        own = [k for k, s in enumerate(sets) if len(s) and node_of(s) == nodes[k]]
        yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in own], pa.int64()), pa.array([sets[k].tobytes() for k in own], pa.binary())], names=["node", "shingles"])


def _confirm(percent: int):
    def confirm(batches):
        held = None

        def links(table):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
            groups: dict = {}
            for i, (t, node) in enumerate(zip(table.column("task").to_pylist(), table.column("node").to_pylist(), strict=True)):
                groups.setdefault(t, {}).setdefault(node, i)
            u, v = [], []
            for group in groups.values():
                if len(group) > 1:
                    names = sorted(group)
                    for name, first in zip(names, linked([sets[group[x]] for x in names], percent), strict=True):
                        if names[first] != name:
                            u.append(name)
                            v.append(names[first])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            column = held.column("task")
            cut = pc.index(column, column[held.num_rows - 1]).as_py()
            if cut:
                yield links(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield links(held)

    return confirm


def _salted(members: DataFrame, cell: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members with salt; cells with salts and c_n): a cell's members in blocks of bounded size."""
    cells = members.groupBy(*cell).agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("salts"), F.count("*").alias("c_n"))
    cells = materialize(cells, "cells")
    by = F.xxhash64("node")
    dealt = spread_join(members, cells, cell, "c_n", by)
    return dealt.withColumn("salt", F.pmod(by, F.col("salts")).cast("int")), cells


def _first_units(members: DataFrame) -> DataFrame:
    """(node, task) of the first round over large families: each block with itself and with the cell's pivots.

    A cell is a family's band of set sizes. Its pivots, a few members chosen by hash, are in each of its blocks.
    """
    dealt, cells = _salted(members, ["family", "band"])
    over = Window.partitionBy("family", "band").orderBy(F.xxhash64(F.lit(1), "node"), "node")
    pivots = members.withColumn("nth", F.row_number().over(over)).filter(F.col("nth") <= PIVOTS)  # each task keeps PIVOTS of a cell
    pivots = pivots.join(cells, ["family", "band"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    task = F.xxhash64(F.lit(1), "family", "band", "salt").alias("task")
    return dealt.select("node", task).unionByName(pivots.select("node", task)).distinct()


def _second_units(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, task) of what the first round left open: pairs of blocks that may link members of two groups.

    groups: (node, component) by the links of the first round. A group that fills a good part of a block is a
    cell of its own, and is neither compared with itself nor with its part in another band; all other members
    of a family's band are one cell, which is also compared with itself.
    """
    named = members.join(groups, "node", "left")
    big = named.filter("component IS NOT NULL").groupBy("family", "band", "component").agg(F.count("*").alias("g_n")).filter(F.col("g_n") >= BLOCK_CLASSES // 4)
    big = materialize(big, "groups")
    named = materialize(named, "named")
    alone = named.join(big.drop("g_n"), ["family", "band", "component"], "left_anti").withColumn("component", F.lit(None).cast("long"))
    in_big = spread_join(named.filter("component IS NOT NULL"), big, ["family", "band", "component"], "g_n", F.xxhash64("node"))
    cell = F.xxhash64("family", "band", "component")
    rows = alone.unionByName(in_big).withColumn("cell", cell)
    dealt, _ = _salted(rows.select("node", "n", "cell"), ["cell"])
    kinds = materialize(rows.groupBy("cell", "family", "band", "component").agg(F.count("*").alias("c_n"), F.sum("n").alias("c_s")), "cells")
    kinds = kinds.withColumn("salts", F.ceil(F.greatest(F.col("c_n") / BLOCK_CLASSES, F.col("c_s") / BLOCK_SHINGLES)).cast("int"))
    a, b = (kinds.select("family", *(F.col(c).alias(f"{x}_{c}") for c in ("cell", "band", "component", "salts", "c_n"))) for x in "ab")
    pairs = a.join(b, "family").filter((F.abs(F.col("a_band") - F.col("b_band")) <= 1) & (F.col("a_cell") <= F.col("b_cell")))
    pairs = pairs.filter(F.col("a_component").isNull() | F.col("b_component").isNull() | (F.col("a_component") != F.col("b_component")))
    pairs = pairs.filter((F.col("a_cell") != F.col("b_cell")) | F.col("a_component").isNull())
    ahead = pairs.select(F.col("a_cell").alias("cell"), F.col("a_c_n").alias("c_n"), F.struct(F.col("b_cell").alias("other"), F.col("b_salts").alias("others")).alias("to"))
    back = pairs.filter("a_cell <> b_cell").select(F.col("b_cell").alias("cell"), F.col("b_c_n").alias("c_n"), F.struct(F.col("a_cell").alias("other"), F.col("a_salts").alias("others")).alias("to"))
    asked = ahead.unionByName(back).groupBy("cell").agg(F.max("c_n").alias("c_n"), F.collect_list("to").alias("to"))
    met = spread_join(dealt, materialize(asked, "block-pairs"), ["cell"], "c_n", F.xxhash64("node"))
    own, salt = F.col("cell"), F.col("salt")

    def units(to):
        def unit(j):
            first = (own < to["other"]) | (own == to["other"]) & (salt <= j)
            mine, other = F.struct(own.alias("c"), salt.alias("s")), F.struct(to["other"].alias("c"), j.alias("s"))
            return F.xxhash64(F.lit(2), F.when(first, mine).otherwise(other), F.when(first, other).otherwise(mine))

        return F.transform(F.sequence(F.lit(0), to["others"] - 1), unit)

    return met.select("node", F.explode(F.flatten(F.transform("to", units))).alias("task"))


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id, kept, finger (xxhash64 of the text) and group for every row of df.

    component_id is the smallest key that the row reaches over links of at least percent Jaccard similarity of
    the sets of distinct 5-word shingles (A-Z lower-cased; fewer words: the whole sequence as one shingle).
    Rows without words, or with a null text, link with nothing: they keep their own key. kept is null-safe
    key = component_id; a null key is no component_id unless all keys of a group are null. Repeated rows fall
    into one group. group names a row's group whatever its keys; it is null for rows without words. Texts are
    read whole. Other columns of df play no part, whatever their names. An empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    prepared = docs.withColumn("finger", F.xxhash64("text"))
    signed = materialize(prepared.mapInArrow(lean(_sign), "key long, finger long, n long, node long, bands array<long>"), "minhash")
    one = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "finger"))
    classes = signed.filter("n > 0").groupBy("node", "n").agg(F.min("key").alias("rep"), one.alias("one"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    classes = materialize(classes, "classes")
    keys = classes.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("last"), F.count("*").alias("b_n")).filter("v <> last").select("band", "v", "b_n")
    stars = spread_join(keys, materialize(shared, "shared-bands"), ["band"], "b_n", F.xxhash64("node")).filter("node <> v").select(F.col("node").alias("u"), "v")
    families = connected_components(stars)
    members = classes.select("node", "n", "one").join(families.select("node", F.col("component").alias("family")), "node")
    members = materialize(members.select("node", "n", F.col("one.key").alias("r_key"), F.col("one.finger").alias("r_finger"), "family"), "families")
    # Shuffled at every size, as members grow with the input; texts stream past the members' hash table and are not
    # sorted. Rows that repeat a key and a text come together again by node.
    met = (F.col("r_finger") == F.col("finger")) & F.col("r_key").eqNullSafe(F.col("key"))
    texts = prepared.join(members.select("node", "r_key", "r_finger").hint("shuffle_hash"), met).select("node", "text")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(texts.mapInArrow(lean(_shingle), "node long, shingles binary"), "shingles")
    shingles = members.agg(F.sum("n")).first()[0] or 0
    parts = partitions_for(spark, 8 * shingles, 16 << 20)

    def confirmed(units: DataFrame) -> DataFrame:
        work = units.join(sets.hint("merge"), "node").select("task", "node", "shingles")
        links = work.repartition(4 * parts, "task").sortWithinPartitions("task").mapInArrow(lean(_confirm(percent)), "u long, v long")
        return materialize(links.distinct(), "links")

    sizes = members.groupBy("family").agg(F.count("*").alias("f_n"), F.sum("n").alias("f_s"))
    sizes = materialize(sizes.withColumn("fits", (F.col("f_n") <= BLOCK_CLASSES) & (F.col("f_s") <= BLOCK_SHINGLES)), "sizes")
    dealt = spread_join(members.select("node", "n", "family"), sizes.drop("f_s"), ["family"], "f_n", F.xxhash64("node"))
    small = dealt.filter("fits").select("node", F.xxhash64("family").alias("task"))
    if sizes.filter("NOT fits").isEmpty():  # each family is one block: its links already are stars around the group's first node
        links = confirmed(small)
        groups = links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    else:
        # A link never skips a band of set sizes.
        band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100) * (1 - 1e-12)).cast("int")
        large = materialize(dealt.filter("NOT fits").select("node", "n", "family", band.alias("band")), "large-families")
        links = confirmed(small.unionByName(_first_units(large)))
        rest = confirmed(_second_units(large, connected_components(links)))
        groups = connected_components(links.unionByName(rest))
    groups = materialize(groups, "grouped")
    least = classes.select("node", "rep").join(groups, "node").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("c_n"))
    grouped = spread_join(groups, materialize(least, "least"), ["component"], "c_n", F.xxhash64("node"))
    known = classes.select("node", "n", "rep", "rows").join(grouped.withColumn("met", F.lit(True)), "node", "left")
    known = known.select("node", "n", "rows", F.when(F.col("met"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"), F.coalesce("component", "node").alias("group"))
    narrow = signed.select("key", "finger", "n", "node")
    out = spread_join(narrow.filter("n > 0"), materialize(known, "known"), ["node", "n"], "rows", F.monotonically_increasing_id())
    out = out.unionByName(narrow.filter("n = 0"), allowMissingColumns=True)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), "finger", "group")


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")).drop("finger", "group")


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM t WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
