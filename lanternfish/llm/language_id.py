"""Language ID by interpolated Kneser-Ney character models.

One model per language over the letters of words (with word edges), stored together in sorted arrays of
n-gram hashes: for each n-gram that any language has seen, the log-probability under every language, and for
each context the interpolation weights. A text gets the language of the lowest cross-entropy per character.
It is rejected by another figure, the entropy with each word under its best learned language, so that a text
that mixes learned languages stays. The limit lies between what a calibration part of the sample shows for its
length and what its texts show to the models of all languages but their own, which stand for unlearned ones.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm._shared import clash_free, crc_mod, lean, small_batches
from lanternfish.llm._tokens import mix64
from lanternfish.sources import tables

ORDER = 5
#: Characters of labelled text, all languages together, on which the models are fitted (about; the documented bound).
SAMPLE_CHARS = 6_000_000
#: Standard deviations beyond which a text is rejected, at least, where a single language is learned.
LEAST_Z = 8.0
#: What it weighs to reject a share of texts in learned languages, against keeping that share of others.
OWN_WEIGHT = 20.0
#: Calibration texts below which a language has no figures of its own.
FEW_TEXTS = 8
#: Words kept in a worker's cache.
CACHE_WORDS = 150_000
#: Weight of a nat per character in the confidence score.
SHARPNESS = 8.0
START, END = 1, 2
#: Words: letters with their combining marks; number signs are no letters.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
OUT = ("lang_pred", "score", "entropy", "rejected")
BASE = 0xD6E8FEB86659FD93


def _grams(words: list[str], order: int):
    """(position in its word, hashes by order) of each character of the padded words."""
    text = "".join(f"{chr(START)}{w}{chr(END)}" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums, step = points.copy(), 1
    hashes = [np.zeros(len(points), dtype=np.uint64), mix64(sums + np.uint64(1))]
    for k in range(2, order + 1):
        step = step * BASE % (1 << 64)
        sums = sums.copy()
        sums[k - 1 :] += points[: len(points) - k + 1] * np.uint64(step)
        hashes.append(mix64(sums + np.uint64(k)))
    return place, lengths, hashes


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in the sorted keys, found) of what is wanted."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


def _fit_one(counts: Counter, order: int, alphabet: int) -> list[dict]:
    """Sorted arrays of one language, by order from 1."""
    words = sorted(counts)
    place, lengths, hashes = _grams(words, order)
    weight = np.repeat(np.fromiter((counts[w] for w in words), dtype=np.int64, count=len(words)), lengths)
    seen = [None]
    for k in range(1, order + 1):
        rows = np.flatnonzero(place >= max(1, k - 1))
        keys, first, inverse = np.unique(hashes[k][rows], return_index=True, return_inverse=True)
        seen.append((keys, rows[first], np.bincount(inverse, weight[rows], len(keys)) if len(keys) else np.zeros(0)))
    out: list[dict] = []
    for k in range(1, order + 1):
        keys, at, raw = seen[k]
        count = raw.copy()
        if k < order:  # continuation counts, but for what begins at a word's start
            longer = seen[k + 1][1]
            suffix, n = np.unique(hashes[k][longer], return_counts=True)
            where, found = _find(suffix, keys)
            inner = place[at] >= k
            count[inner] = np.where(found, n[where], 1)[inner] if len(n) else 1
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9))
        context = hashes[k - 1][at - 1] if k > 1 else np.zeros(len(keys), dtype=np.uint64)
        names, inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, count, len(names))
        back = d * kinds / np.maximum(total, 1e-9)
        below = np.full(len(keys), 1 / alphabet)
        suffix = hashes[k - 1][at]
        if k > 1:
            below = np.exp(out[-1]["logp"][_find(out[-1]["keys"], suffix)[0]])
        p = np.maximum(count - d, 0) / total[inverse] + back[inverse] * below
        out.append({"keys": keys, "logp": np.log(p), "context": context, "suffix": suffix, "names": names, "back": np.log(back)})
    return out


def fit(samples: dict[str, Counter], order: int = ORDER) -> dict:
    """The joint sorted hash arrays of all languages from word counts by language."""
    langs = sorted(samples)
    alphabet = len({c for x in samples.values() for w in x for c in w}) + 2
    models = [_fit_one(samples[x], order, alphabet) for x in langs]
    grams, contexts = [], []
    for k in range(order):
        keys, first = np.unique(np.concatenate([m[k]["keys"] for m in models]), return_index=True)
        context, suffix = (np.concatenate([m[k][n] for m in models])[first] for n in ("context", "suffix"))
        names = np.unique(np.concatenate([m[k]["names"] for m in models]))
        back = np.zeros((len(names), len(langs)))
        value = np.empty((len(keys), len(langs)))
        for j, m in enumerate(models):
            at, found = _find(m[k]["names"], names)
            back[found, j] = m[k]["back"][at[found]]
            below = np.full(len(keys), -np.log(alphabet)) if k == 0 else grams[-1][1][_find(grams[-1][0], suffix)[0], j]
            value[:, j] = back[_find(names, context)[0], j] + below
            at, found = _find(m[k]["keys"], keys)
            value[found, j] = m[k]["logp"][at[found]]
        grams.append((keys, value.astype(np.float32)))
        contexts.append((names, back.astype(np.float32)))
    return {"langs": langs, "grams": grams, "contexts": contexts, "alphabet": alphabet, "order": order}


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """Log-probability of each word under each language; the last column is the number of characters."""
    place, lengths, hashes = _grams(words, model["order"])
    n, langs = len(place), len(model["langs"])
    value = np.zeros((n, langs))
    todo = np.flatnonzero(place >= 1)
    for k in range(model["order"], 0, -1):
        apply = place[todo] >= k - 1
        now = todo[apply]
        keys, logp = model["grams"][k - 1]
        at, found = _find(keys, hashes[k][now])
        value[now[found]] += logp[at[found]]
        miss = now[~found]
        names, back = model["contexts"][k - 1]
        at, known = _find(names, hashes[k - 1][miss - 1] if k > 1 else np.zeros(len(miss), dtype=np.uint64))
        value[miss[known]] += back[at[known]]
        todo = np.concatenate([todo[~apply], miss])
    value[todo] -= np.log(model["alphabet"])
    starts = np.cumsum(lengths) - lengths
    return np.column_stack([np.add.reduceat(value, starts, axis=0), lengths - 1.0]) if n else np.zeros((0, langs + 1))


class Scorer:
    """Scores texts with a bounded cache of words, under all languages or all but one."""

    def __init__(self, model: dict, without: int | None = None):
        self.model, self.index = model, {}
        self.langs = [j for j in range(len(model["langs"])) if j != without]
        self.table = np.zeros((0, len(self.langs) + 2))

    def _rows(self, words: list[str]) -> np.ndarray:
        scores = word_scores(self.model, words)
        own = scores[:, self.langs]
        return np.column_stack([own, own.max(axis=1), scores[:, -1]])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: log-probability by language, that of each word's best language, the number of characters."""
        found = [LETTERS(t.lower()) if t else [] for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.index, self.table = {}, self.table[:0]
        new = sorted({w for words in found for w in words if w not in self.index})
        if new:
            self.index.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, *(self._rows(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        out = np.zeros((len(texts), self.table.shape[1]))
        for row, words in enumerate(found):
            if words:
                out[row] = self.table[np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        return out


def _sample(labelled: DataFrame, chars: int) -> list:
    """About chars characters of labelled rows, the same share for each language, chosen by a hash of the row."""
    sums = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()  # a row per language
    if not sums:
        return []
    share = {r["lang"]: min(1.0, chars / len(sums) / max(1, r["n"])) for r in sums}
    cut = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30)) + 1)])
    return labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < cut[F.col("lang")]).select("doc_id", "lang", "text").collect()


def _distance(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Standard deviations by which texts lie beyond the mean of the language that fits them best."""
    mean, between, per_char = limits[scores[:, :-2].argmax(axis=1), :3].T
    chars = np.maximum(scores[:, -1], 1)
    return (-scores[:, -2] / chars - mean) / np.sqrt(between + per_char / chars + 1e-9)


def _cut(own: np.ndarray, foreign: np.ndarray) -> float:
    """The middle of the distances that part own from foreign texts best; own ones weigh OWN_WEIGHT times as much."""
    if not len(foreign):
        return max(LEAST_Z, 1.5 * own.max())
    at = np.unique(np.concatenate([own, foreign]))
    lost = 1 - np.searchsorted(np.sort(own), at, "right") / len(own)
    kept = np.searchsorted(np.sort(foreign), at, "right") / len(foreign)
    cost = OWN_WEIGHT * lost + kept
    good = np.flatnonzero(cost <= cost.min() + 0.005)
    return float(at[good[0]] + at[min(good[-1] + 1, len(at) - 1)]) / 2


def _limits(model: dict, texts: list[str], owner: np.ndarray) -> np.ndarray:
    """By language: mean entropy of its texts, variance between them, variance of a character, and the distance to reject at.

    A language of few texts takes the figures of all together; where there are few in all, nothing is rejected.
    """
    langs = range(len(model["langs"]))
    scores = Scorer(model)(texts)
    learned = (owner >= 0) & (scores[:, -1] > 0)
    if learned.sum() < FEW_TEXTS:
        return np.tile([0.0, 0.0, 0.0, np.inf], (len(langs), 1))

    def figures(own):
        entropy, n = -own[:, -2] / own[:, -1], own[:, -1]
        mean = np.average(entropy, weights=n)
        per_char = np.median((entropy - mean) ** 2 * n) / 0.455  # the median of a chi-square of one degree
        long = n > 500
        return mean, np.median((entropy[long] - mean) ** 2) / 0.455 if long.any() else 0.05, per_char, np.inf

    rows = [learned & (owner == j) for j in langs]
    limits = np.array([figures(scores[x if x.sum() >= FEW_TEXTS else learned]) for x in rows])
    foreign = []
    for j in langs if len(langs) > 1 else ():
        out = Scorer(model, without=j)([texts[i] for i in np.flatnonzero(rows[j])])
        foreign.append(_distance(out, np.delete(limits, j, axis=0)))
    limits[:, 3] = _cut(_distance(scores[learned], limits), np.concatenate(foreign) if foreign else np.zeros(0))
    return limits


def train(labelled: DataFrame, chars: int = SAMPLE_CHARS, order: int = ORDER) -> dict | None:
    """Models and rejection limits from doc_id, lang, text rows; None without any letter to learn from.

    A fifth of the sample calibrates the limits, the rest fits the models.
    """
    rows = sorted(_sample(labelled, chars), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["text"]))
    fitted: dict[str, Counter] = {}
    apart = []
    for nth, r in enumerate(rows):
        if nth % 5 == 4:
            apart.append(r)
        else:
            fitted.setdefault(r["lang"], Counter()).update(LETTERS(r["text"].lower()))
    fitted = {k: v for k, v in fitted.items() if v}
    if not fitted:
        return None
    model = fit(fitted, order)
    owner = np.array([model["langs"].index(r["lang"]) if r["lang"] in fitted else -1 for r in apart], dtype=int)
    model["limits"] = _limits(model, [r["text"] for r in apart], owner)
    return model


def identify(df: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Rows of df with lang_pred, score (0 to 1), entropy (nats a character) and rejected.

    Texts that are null or have no letter get und, score 0, a null entropy, and are rejected; without a model
    (nothing to learn from) all texts do. Ties go to the language first in code-point order. Columns of df
    named like an output column are replaced. An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    df = clash_free(df, *OUT)
    width = len(df.columns)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in batches:
            texts = batch.column(width).to_pylist()
            n = len(texts)
            pred, conf, ent, rej = ["und"] * n, np.zeros(n), [None] * n, np.ones(n, dtype=bool)
            low = 0
            while low < n and model:
                high, held = low, 0
                while high < n and held < 1 << 20:
                    held += len(texts[high] or "")
                    high += 1
                sums = scorer(texts[low:high])
                chars = sums[:, -1]
                entropy = -sums[:, :-2] / np.maximum(chars, 1)[:, None]
                best = entropy.argmin(axis=1)
                lowest = entropy[np.arange(len(best)), best]
                weight = np.exp(-SHARPNESS * (entropy - lowest[:, None]))
                far = _distance(sums, model["limits"]) > model["limits"][best, 3]
                for i in np.flatnonzero(chars > 0):
                    pred[low + i], ent[low + i] = model["langs"][best[i]], float(lowest[i])
                    conf[low + i], rej[low + i] = 1 / weight[i].sum(), far[i]
                low = high
            cols = [*batch.columns[:width], pa.array(pred, pa.string()), pa.array(conf), pa.array(ent, pa.float64()), pa.array(rej)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [f"c{k}" for k in range(width)] + list(OUT)
    schema = ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(df.columns))
    source = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)), F.col(f"`{text}`").alias("b_text"))
    out = source.mapInArrow(lean(score), f"{schema}, lang_pred string, score double, entropy double, rejected boolean")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)), *OUT)


def training_rows(docs: DataFrame) -> DataFrame:
    """What op3 may learn from: labelled rows that are not held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    return rows.select("doc_id", "lang", "text")


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(training_rows(docs)))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
