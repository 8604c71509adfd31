"""LM scoring with a weighted backoff automaton.

The language model is of order 3, Dirichlet-smoothed at each order: p(w|uv) = (c(uvw) + MU3 p(w|v)) / (c(uv) + MU3),
p(w|v) = (c(vw) + MU2 p(w)) / (c(v) + MU2), with the additive unigram p(w) below. As an automaton: a state for each
known context (two words, one word, or none: the root); from each an arc for each n-gram seen after it, of weight
log p, to the state of the longest known context that it ends in; and a failure arc of weight log MU / (c + MU) to
the state of its shorter context. The root has an arc for each word and one for all unknown words. One traversal
from left to right carries the state and adds up the weights of the arcs and failure arcs that it takes.

The automaton grows with the corpus, so no machine holds it. Documents are packed into batches, which are written
once. Each batch sends the sorted, delta-coded hashes of its distinct n-grams with its training counts to shards of
the hash space; each shard sums them and answers every batch with the counts of just what it asked for, in its
order. From these a batch builds the part of the automaton that its texts can reach, and walks them.
Frequent words cost no more than one entry a batch, so there is no hot key. Cells are packed and read by whole-array
steps: rows of the exchange are batches x shards until a row holds a single hash, and Python does not see them one
by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm._shared import crc_mod, lean, materialize
from lanternfish.llm._tokens import chunks, distinct, hash_docs, index_distinct, mix64
from lanternfish.sources import tables

#: Pseudo-counts of the shorter context below a state of one and of two words. Additive smoothing of the root.
MU2, MU3 = 256.0, 32.0
ALPHA = 0.1
#: Bytes of text of a batch; bytes of all text for each shard.
BATCH_BYTES = 8 << 20
SHARD_BYTES = 10 << 20
#: Tokens that a text's part has in the traversal; longer texts are walked in parts, each with its true first state.
PART = 512
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bits of the hash of a run of two or three words (a word keeps all 64): so many more than the logarithm of the
#: bytes of text that an unseen run meets another's hash with probability 2**-MISS_BITS at most, at any size.
LEAST_BITS, MISS_BITS = 44, 12


def pack(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """uint64 values as one binary cell for each run between edges: 7 bits a byte, the last byte of a value below 128.

    All cells are made by whole-array steps, so that short cells cost no more a value than long ones.
    """
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[ends[live] + k] = (values[live] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | (size[live] > k + 1).astype(np.uint8) << 7
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(ends[edges]), pa.py_buffer(out)]).cast(pa.binary())


def unpack(cells: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The values of all cells, one cell after the other."""
    if isinstance(cells, pa.ChunkedArray):
        return np.concatenate([np.zeros(0, np.uint64), *(unpack(c) for c in cells.chunks)])
    if not len(cells):
        return np.zeros(0, np.uint64)
    cells = cells.cast(pa.large_binary())
    _, offsets, data = cells.buffers()
    low, high = np.frombuffer(offsets, dtype=np.int64)[[cells.offset, cells.offset + len(cells)]]
    if low == high:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(data, dtype=np.uint8)[low:high]
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = ends - begins + 1
    values = (data[begins] & 127).astype(np.uint64)
    for k in range(1, int(size.max())):
        live = np.flatnonzero(size > k)
        values[live] |= (data[begins[live] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return values


def pack_sorted(keys: np.ndarray, edges: np.ndarray) -> pa.Array:
    """As pack(), for sorted keys: a cell has its first key, then differences. No run is empty."""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[edges[:-1]] = keys[edges[:-1]]
    return pack(steps, edges)


def unpack_sorted(cells: pa.ChunkedArray | pa.Array, n: np.ndarray) -> np.ndarray:
    """The keys of cells of n keys each."""
    total = np.cumsum(unpack(cells), dtype=np.uint64)
    firsts = np.cumsum(n) - n
    return total - np.repeat(np.concatenate([[np.uint64(0)], total])[firsts], n)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens by text) of lower-cased texts; each text begins with BEGIN and ends with END."""
    words, lengths = [], []
    for a, b in chunks(texts):
        h, n = hash_docs([t.lower() for t in texts[a:b]])
        words.append(h)
        lengths.append(n)
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.concatenate(lengths) + 2
    ends = np.cumsum(n) - 1
    token = np.empty(int(n.sum()), dtype=np.uint64)
    inner = np.ones(len(token), dtype=bool)
    inner[ends] = inner[ends - n + 1] = False
    token[inner], token[ends], token[ends - n + 1] = np.concatenate(words), END, BEGIN
    return token, n


def run_bits(size: int) -> int:
    return min(64, max(LEAST_BITS, math.ceil(math.log2(max(2, size))) + MISS_BITS))


def run_hash(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0xC2B2AE3D27D4EB4F) + token)


def runs(texts: list[bytes], bits: int):
    """(tokens, tokens by text; for each order 1 to 3 the places where a run ends, and the runs' hashes).

    A BEGIN is no word: it only stands before others.
    """
    token, lengths = sequences(texts)
    place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    name, out = token, []
    for k in range(3):
        if k:
            name = np.concatenate([name[:1], run_hash(name[:-1], token[1:])])
        rows = np.flatnonzero(place >= max(1, k)).astype(np.int32)
        out.append((rows, name[rows] >> np.uint64(64 - bits) if k else name[rows]))
    return token, lengths, out


def count_runs(texts: list[bytes], learn: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the sorted hashes of all runs of the texts, and their numbers in those of which learn is true."""
    _, lengths, found = runs(texts, bits)
    live = np.repeat(learn, lengths)
    out = []
    for rows, names in found:
        keys, own = distinct(names), np.sort(names[live[rows]])
        out.append((keys, np.searchsorted(own, keys, "right").astype(np.uint64) - np.searchsorted(own, keys, "left").astype(np.uint64)))
    return out


class Grams:
    """The distinct n-grams of some texts.

    keys[k]: sorted hashes of the runs of k + 1 tokens, at[k]: a place where each ends, of[k]: by place the index in
    keys of the run that ends there, or -1.
    """

    def __init__(self, texts: list[bytes], bits: int = 64):
        self.token, self.lengths, found = runs(texts, bits)
        self.keys, self.at, self.of = [], [], []
        for rows, names in found:
            keys, at, inverse = index_distinct(names)
            of = np.full(len(self.token), -1, dtype=np.int32)
            of[rows] = inverse
            self.keys.append(keys)
            self.at.append(rows[at])
            self.of.append(of)


class Automaton:
    """The part of the weighted backoff automaton that the n-grams of some texts reach, from their training counts.

    State 0 is the root, 1 that of BEGIN, then those of known words and of known pairs. arcs: sorted state << 32 |
    word, with arc_weight and arc_to; fail, fail_weight: by state its failure arc; root_weight, root_to: by word
    the root's arcs, which an unknown word has too.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, docs: int):
        c0, c1, c2 = (c.astype(np.float64) for c in counts)
        word, pair, at1, at2 = grams.of[0], grams.of[1], grams.at[1], grams.at[2]
        self.root = (c0 + ALPHA) / (total + ALPHA * (distinct + 1))
        known = (c0 > 0) & (grams.keys[0] != END)
        of_word = np.where(known, np.cumsum(known) + 1, 0)
        last = grams.token[at1] == END
        live = (c1 > 0) & ~last
        of_pair = np.where(live, np.cumsum(live) + known.sum() + 1, of_word[word[at1]])
        seen = np.concatenate([[0.0, docs], c0[known], c1[live]])
        mu = np.concatenate([[1.0], np.full(1 + int(known.sum()), MU2), np.full(int(live.sum()), MU3)])
        self.fail_weight = np.log10(mu / (seen + mu))
        self.fail = np.concatenate([np.zeros(2 + int(known.sum()), dtype=np.int64), of_word[word[at1[live]]]])
        self.root_weight, self.root_to = np.log10(self.root), of_word
        before = word[at1 - 1]  # -1: BEGIN
        source = np.where(before < 0, 1, of_word[before])
        p1 = (c1 + MU2 * self.root[word[at1]]) / (seen[source] + MU2)
        one = c1 > 0
        left, right = pair[at2 - 1], pair[at2]
        p2 = (c2 + MU3 * p1[right]) / (c1[left] + MU3)
        two = c2 > 0
        arcs = np.concatenate([source[one] << 32 | word[at1[one]], of_pair[left[two]] << 32 | word[at2[two]]])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.arc_weight = np.concatenate([np.log10(p1[one]), np.log10(p2[two])])[order]
        self.arc_to = np.concatenate([of_pair[one], of_pair[right[two]]])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of many walkers that read a word each."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        todo = np.arange(len(state))
        while len(todo):
            at_root = state[todo] == 0
            done = todo[at_root]
            weight[done] += self.root_weight[word[done]]
            to[done] = self.root_to[word[done]]
            todo = todo[~at_root]
            wanted = state[todo] << 32 | word[todo]
            at = np.minimum(np.searchsorted(self.arcs, wanted), max(0, len(self.arcs) - 1))
            hit = self.arcs[at] == wanted if len(self.arcs) else np.zeros(len(todo), dtype=bool)
            done, at = todo[hit], at[hit]
            weight[done] += self.arc_weight[at]
            to[done] = self.arc_to[at]
            todo = todo[~hit]
            weight[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return weight, to

    def walk(self, grams: Grams) -> np.ndarray:
        """log10 probability of each text. All texts are walked side by side, one token a step.

        A state is a context of at most two words, so a long text's later part starts in the state that the two
        words before it lead to from the root, which is the state that its earlier part ends in.
        """
        ends = np.cumsum(grams.lengths)
        begins = ends - grams.lengths + 1
        parts = -(-(ends - begins) // PART)
        text = np.repeat(np.arange(len(parts)), parts)
        low = begins[text] + PART * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.minimum(low + PART, ends[text]) - low
        order = np.argsort(-size, kind="stable")
        text, low, size = text[order], low[order], size[order]
        state = np.ones(len(low), dtype=np.int64)
        word = grams.of[0].astype(np.int64)
        later = np.flatnonzero(low > begins[text])
        state[later] = 0
        for back in (2, 1):
            state[later] = self.step(state[later], word[low[later] - back])[1]
        out = np.zeros(len(low))
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, "left"))  # sizes fall: these have a token left
            weight, state[:live] = self.step(state[:live].copy(), word[low[:live] + k])
            out[:live] += weight
        return np.bincount(text, out, len(parts))


def _texts(blob: bytes) -> pa.Table:
    """key, text, train of a batch."""
    with pa.ipc.open_stream(blob) as reader:
        return reader.read_all()


def _bytes_of(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def shard_starts(bits: int, shards: int) -> np.ndarray:
    """The least hash of each shard, of hashes of some bits."""
    return np.array([(s << bits) // shards for s in range(shards)], dtype=np.uint64)


def score(df: DataFrame, train, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score of every row of df.

    train: a boolean column over df; rows where it is true are learned from. A null text counts as empty: one
    end token. Repeated rows and keys count each on its own, so there are no ties to break. Texts are read whole,
    however long. Other columns of df play no part, whatever their names. An empty table gives no rows; where no
    row is learned from, every token is unknown.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def pack_texts(batches):
        """Runs of rows with about BATCH_BYTES of text as one compressed cell."""
        part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def cell():
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            learned = sum(held_.column(2).true_count for held_ in held)
            sizes = (part << 32 | nth, sink.getvalue().to_pybytes(), learned, size)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(sizes, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["batch", "blob", "docs", "size"])

        for batch in batches:
            low = 0
            lengths = np.array([len(t) if t else 0 for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.int64) + 16
            while low < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(lengths[low:]), BATCH_BYTES - size, "right")))
                held.append(batch.slice(low, n))
                size += int(lengths[low : low + n].sum())
                low += n
                if size >= BATCH_BYTES or low < batch.num_rows:
                    yield cell()
                    nth, held, size = nth + 1, [], 0
        if held:
            yield cell()

    packed = materialize(rows.mapInArrow(lean(pack_texts), "batch long, blob binary, docs long, size long"), "lm-texts")
    told = packed.agg(F.sum("docs"), F.sum("size")).first()
    docs, size = told[0] or 0, told[1] or 0
    shards, bits = max(1, -(-size // SHARD_BYTES)), run_bits(size)
    packed = packed.select("batch", "blob")

    def ask(batches):
        starts = {b: shard_starts(b, shards) for b in (64, bits)}
        for cells in batches:
            for batch, blob in zip(*(c.to_pylist() for c in cells.columns), strict=True):
                own = _texts(blob)
                learn = np.array(own.column("train").to_pylist(), dtype=bool)
                for k, (keys, count) in enumerate(count_runs(_bytes_of(own), learn, bits)):
                    edges = np.append(np.searchsorted(keys, starts[bits if k else 64]), len(keys))
                    shard = np.flatnonzero(np.diff(edges))
                    if not len(shard):
                        continue
                    edges = np.append(edges[shard], len(keys))
                    named = (np.full(len(shard), batch), shard.astype(np.int32), np.full(len(shard), k, np.int32), np.diff(edges).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, named), pack_sorted(keys, edges), pack(count, edges)], names=["batch", "shard", "kind", "n", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        kinds, out = table.column("kind").to_numpy(), []
        names = ["batch", "shard", "kind", "n", "counts", "tokens", "words"]
        for k in range(3):
            own = table.take(np.flatnonzero(kinds == k))
            n = own.column("n").to_numpy().astype(np.int64)
            _, _, inverse = index_distinct(unpack_sorted(own.column("keys"), n))
            total = np.bincount(inverse, unpack(own.column("counts"))).astype(np.uint64)
            none = pa.array(np.zeros(len(n), np.int64))
            same = [own.column(c).combine_chunks() for c in names[:4]]
            out.append(pa.Table.from_arrays([*same, pack(total[inverse], np.append(0, np.cumsum(n))), none, none], names=names))
            if k == 0:
                sums = ([-1], [shard], [k], [0], [b""], [int(total.sum())], [int((total > 0).sum())])
                out.append(pa.Table.from_arrays([pa.array(v, t) for v, t in zip(sums, out[0].schema.types, strict=True)], names=names))
        return pa.concat_tables(out)

    asked = packed.mapInArrow(lean(ask), "batch long, shard int, kind int, n int, keys binary, counts binary")
    answers = asked.groupBy("shard").applyInArrow(lean(answer), "batch long, shard int, kind int, n int, counts binary, tokens long, words long")
    answers = materialize(answers, "lm-counts")
    sums = answers.filter("batch = -1").agg(F.sum("tokens"), F.sum("words")).first()
    total, words = sums[0] or 0, sums[1] or 0
    names = ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def traverse(packed_: pa.Table, counts: pa.Table) -> pa.Table:
        own = _texts(packed_.column("blob")[0].as_py())
        grams = Grams(_bytes_of(own), bits)
        kinds, shard = counts.column("kind").to_numpy(), counts.column("shard").to_numpy()
        seen = []
        for k in range(3):
            at = np.flatnonzero(kinds == k)
            seen.append(unpack(counts.column("counts").take(at[np.argsort(shard[at])])))
        machine = Automaton(grams, seen, total, words, docs)
        value = machine.walk(grams)
        word, inner = grams.of[0], grams.of[0] >= 0
        text = np.repeat(np.arange(len(grams.lengths)), grams.lengths)[inner]
        base = np.bincount(text, machine.root_weight[word[inner]], own.num_rows)
        n_known = np.bincount(text, seen[0][word[inner]] > 0, own.num_rows).astype(np.int64)
        return pa.Table.from_arrays([own.column("key").combine_chunks(), pa.array(grams.lengths - 1, pa.int64()), pa.array(n_known), pa.array(np.full(own.num_rows, total), pa.int64()), pa.array(base), pa.array(value)], names=names)

    out = packed.groupBy("batch").cogroup(answers.filter("batch >= 0").groupBy("batch")).applyInArrow(lean(traverse), f"key {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    out = score(docs, crc_mod(F.col("doc_id"), 10) != 0)
    return out.withColumn("held_out", crc_mod(F.col("doc_id"), 10) == 0)
