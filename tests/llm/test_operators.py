"""The ten operators against brute force on small tables: nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lanternfish.llm import decontamination, exact_dedup, html_render, language_id, lm_scoring, mixing, near_dedup, substring_dedup, token_counts, url_filters
from lanternfish.llm._graph import connected_components
from lanternfish.llm._tokens import hash_docs, hash_words, rolling

DOCS = "doc_id long, text string"
ENGLISH = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all she they were my are me one their so an said them we who would been will no when there if more out up into do any your what has man could".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch".split()


def words(rng, n, vocabulary=None):
    return " ".join(rng.choice(vocabulary) if vocabulary else f"w{rng.randrange(4000)}" for _ in range(n))


def lower(text):
    return (text or "").encode().lower()


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, odd texts, nulls, a very long text."""
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 8, 60, 120, 300])) for _ in range(60)]
    passage = words(rng, 80)
    texts = list(base)
    for k in range(40):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = f"e{rng.randrange(99999)}"
        texts.append(" ".join(t) if k % 3 else " ".join(t).upper())
    texts += [f"{words(rng, 40)} {passage} {words(rng, 30)}" for _ in range(12)] + [passage] * 3
    texts += [None, None, "", " \t\n ", "one", "One", "ß É", "ß é", "a b c d", "A b C d", words(rng, 20000), "x" * 30000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# -- shared pieces ---------------------------------------------------------------------


def test_word_hashing_matches_split():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b" \t\n\x0b\x0cabcde\xc3\xa9\xa0\x85") for _ in range(rng.randrange(40))) for _ in range(200)]
    hashes, counts = hash_docs(texts)
    split = [t.split() for t in texts]
    assert counts.tolist() == [len(x) for x in split]
    flat = [w for x in split for w in x]
    seen = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_word_hashing_in_slices(monkeypatch):
    from lanternfish.llm import _tokens

    data = b"alpha beta  gamma " * 50 + b"y" * 500 + b" end"
    whole = hash_words(data)
    monkeypatch.setattr(_tokens, "SLICE", 64)
    cut = hash_words(data)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_rolling_hash_is_of_the_run():
    h, _ = hash_words(b"a b c a b c a")
    r = rolling(h, 3)
    assert r[0] == r[3] and r[1] == r[4] and len(set(r.tolist())) == 3
    assert rolling(h, 8).size == 0


@pytest.mark.parametrize("last", [16_000, 0])
def test_components(spark, monkeypatch, last):
    from lanternfish.llm import _graph

    monkeypatch.setattr(_graph, "LAST_EDGES", last)
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 300 + i) for i in range(50)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up.setdefault(a, a)
            up.setdefault(b, b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(frame(spark, edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}


# -- exact dedup -------------------------------------------------------------------------


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return {i: (max(groups[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("copies", [0, 400])
def test_exact_dedup(spark, corpus, copies):
    rows = corpus + [(1000 + k, "hot text " * 300 + ("" if k % 2 else "!")) for k in range(copies)]
    out = exact_dedup.exact_dedup(frame(spark, rows), payload=["doc_id"]).collect()
    want = expected_exact(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_dedup_repeats_nulls_and_clashes(spark):
    rows = [(5, "A", 1), (5, "a", 2), (None, "a", 3), (None, "z", 4), (None, "z", 5), (1, None, 6), (2, "", 7)] + [(9, "hot", 8)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = exact_dedup.exact_dedup(df).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"}
    by = {}
    for r in out:
        by.setdefault(r["text_sha256"], []).append(r)
    assert sorted(sum(x["kept"] for x in g) for g in by.values()) == [1] * len(by)
    assert {r["keep_id"] for r in out if (r["text"] or "").lower() == "a"} == {5}
    assert {r["keep_id"] for r in out if not r["text"]} == {2}
    only = exact_dedup.exact_dedup(df, keep_only=True).collect()
    assert len(only) == len(by) and all(r["kept"] for r in only)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_in_passes(spark, corpus, monkeypatch):
    """Heavy texts that find no room in the trie are solved by further passes."""
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 300)
    calls, one = [], exact_dedup.exact_dedup
    monkeypatch.setattr(exact_dedup, "exact_dedup", lambda *a, **k: calls.append(1) or one(*a, **k))
    rows = corpus + [(1000 + k, f"{'hot text ' * 300}{k % 3}") for k in range(300)] + [(2000 + k, f"{k % 2} {'warm text ' * 200}") for k in range(200)]
    out = one(frame(spark, rows), payload=["doc_id"]).collect()
    want = expected_exact(rows)
    assert calls and len(out) == len(rows)
    assert all((r["keep_id"], r["group_size"], r["text_sha256"]) == want[r["doc_id"]] for r in out)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)
    only = one(frame(spark, rows), keep_only=True).collect()
    assert sorted(r["doc_id"] for r in only) == sorted({w[0] for w in want.values()})


def test_exact_dedup_of_very_long_texts(spark):
    long = "long words " * 200_000
    rows = [(1, long), (2, long.upper()), (3, long + "x"), (4, long[:-1])] + [(10 + k, long) for k in range(4)]
    out = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, rows), payload=["doc_id"]).collect()}
    assert out == {**{i: (13, 6) for i in (1, 2, 10, 11, 12, 13)}, 3: (3, 1), 4: (4, 1)}


def test_radix_groups():
    texts = [b"a" * n for n in (0, 7, 8, 9, 32, 33, 8, 32, 0)] + [b"a" * 8 + b"b"]
    got = sorted(sorted(g) for g in exact_dedup.radix_groups(texts))
    assert got == [[0, 8], [1], [2, 6], [3], [4, 7], [5], [9]]


# -- decontamination ------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(k, words(rng, 30)) for k in range(6)] + [(6, "four words of item"), (7, None), (8, ""), (9, "six words that make an item")]
    texts = [items[k][1].split() for k in range(6)]
    changed = [w if j % 7 else "zz" for j, w in enumerate(texts[2])]
    rows = [
        (1, words(rng, 50) + " " + items[0][1] + " " + words(rng, 50)),  # whole
        (2, items[1][1].upper().replace(" ", ", ")),  # case and punctuation
        (3, words(rng, 20) + " " + " ".join(changed)),  # a substitution in seven
        (4, " ".join(texts[3][8:24])),  # a part
        (5, words(rng, 300)),  # clean
        (6, None),
        (7, ""),
        (8, " ".join(texts[4][:6]) + " " + words(rng, 30)),  # six words only
        (9, f"{items[0][1]} and {items[5][1]}"),
        (9, f"{items[0][1]} and {items[5][1]}"),
        (10, "x four words of item y"),
        (11, "x four words of items y"),
        (12, "six words that make one item"),
        (13, "six words which make one item"),
        (14, words(rng, 60_000) + " " + items[5][1] + " " + words(rng, 60_000)),  # very long
        (None, items[5][1]),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3), (9, 0), (9, 5), (10, 6), (12, 9), (14, 5), (None, 5)}
    clash = frame(spark, [(*r, "x", 1) for r in rows], f"{DOCS}, item string, matched int"), frame(spark, [(*r, "y") for r in items], "item_id long, text string, n string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(*clash).collect()} == got
    one = decontamination.contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string"))
    assert one.filter("doc_id = 9").count() == 2
    assert decontamination.contaminated(frame(spark, rows).limit(0), frame(spark, items, "item_id long, text string")).count() == 0
    assert decontamination.contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string").limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = frame(spark, [(k, words(rng, 40)) for k in range(30)], "item_id long, text string")
    rows = [(k, words(rng, 20) + " " + r["text"]) for k, r in enumerate(items.collect())]
    want = decontamination.contaminated(frame(spark, rows), items).orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60_000)
    assert decontamination.contaminated(frame(spark, rows), items).orderBy("doc_id").collect() == want
    assert len(want) == 30


@pytest.mark.parametrize("n", [*range(1, 15), 20])
def test_every_accepted_overlap_leaves_a_seed(n):
    """All places of the substitutions that the threshold allows in a window: one mask fits at some place."""
    wide = min(n, decontamination.WINDOW)
    masks = decontamination.masks_of(wide, 0.8)
    for wrong in range(wide + 1):
        if (wide - wrong) / wide >= 0.8:
            for gone in itertools.combinations(range(wide), wrong):
                assert any(not {o + at for o in m} & set(gone) for m in masks for at in range(wide - m[-1])), (n, gone)
    for threshold in (0.5, 0.6, 0.7, 0.9, 1.0):
        masks = decontamination.masks_of(wide, threshold)
        wrong = max(w for w in range(wide + 1) if (wide - w) / wide >= threshold)
        assert all(any(not {o + at for o in m} & set(gone) for m in masks for at in range(wide - m[-1])) for gone in itertools.combinations(range(wide), wrong))


def test_decontamination_finds_all_that_brute_force_finds(spark):
    rng = random.Random(14)
    items = [(k, words(rng, rng.choice([2, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 20]))) for k in range(60)]
    rows = []
    for k in range(240):
        w = items[k % 60][1].split()
        for at in rng.sample(range(len(w)), min(len(w), rng.choice([0, 1, 2, 2, 3]))):
            w[at] = f"z{rng.randrange(99)}"
        rows.append((k, f"{words(rng, 6)} {' '.join(w)} {words(rng, 5)}"))
    want = set()
    for k, text in rows:
        h = text.split()
        for i, item in items:
            v = item.split()
            wide = min(13, len(v))
            for shift in range(1 - len(v), len(h)):
                same = [0 <= q + shift < len(h) and v[q] == h[q + shift] for q in range(len(v))]
                inside = [q for q in range(len(v)) if 0 <= q + shift < len(h)]
                if any(sum(same[a : a + wide]) / wide >= 0.8 for a in inside if a + wide - 1 in inside):
                    want.add((k, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 120


# -- language ID ---------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, rng.choice([4, 30, 200]), GERMAN if k % 3 == 0 else ENGLISH), "de" if k % 3 == 0 else "en") for k in range(600)]
    rows += [(900, None, "en"), (901, "12 34 !!", None), (902, "", "de"), (903, "Ж" * 400 + " щ", None), (904, words(rng, 60, ENGLISH) + " " + words(rng, 60, GERMAN), None)]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(df))
    out = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    held = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(out[i]["lang_pred"] == lang for i, _, lang in held) / len(held) > 0.98
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"] for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert not out[904]["rejected"]
    assert out[903]["rejected"] and not any(out[i]["rejected"] for i, _, _ in rows[:600])
    assert language_id.train(language_id.training_rows(df.limit(0))) is None
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0
    clash = df.withColumn("score", df["doc_id"])
    assert language_id.identify(clash, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "entropy", "rejected"]


FRENCH = "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ses mais comme ou nous leur elle été cette fait tout être deux même aussi bien entre peut sans lui où vous encore depuis".split()


@pytest.mark.parametrize("few", [False, True])
def test_language_id_rejects_an_unlearned_language(spark, few):
    """French and letter junk among models of English and German; also where a language has few rows to calibrate on."""
    rng = random.Random(8)
    german = 15 if few else 200
    rows = [(k, words(rng, rng.choice([15, 60, 200]), GERMAN if k < german else ENGLISH), "de" if k < german else "en") for k in range(500)]
    french = [(1000 + k, words(rng, rng.choice([15, 60, 200]), FRENCH), None) for k in range(60)]
    junk = [(2000 + k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(7)) for _ in range(30)), None) for k in range(20)]
    mixed = [(3000 + k, " ".join(words(rng, 5, v) for v in (ENGLISH, GERMAN) * 4), None) for k in range(20)]
    df = frame(spark, rows + french + junk + mixed, "doc_id long, text string, lang string")
    out = language_id.identify(df, language_id.train(language_id.training_rows(df))).filter("rejected").collect()
    gone = {r["doc_id"] for r in out}
    assert {i for i, _, _ in french + junk} <= gone
    assert not gone & {i for i, _, _ in rows + mixed}


def test_letters_are_letters():
    assert language_id.LETTERS("½ ² Ⅷ ٣ _ -") == []
    assert language_id.LETTERS("naïve हिन्दी a1b") == ["naïve", "हिन्दी", "a", "b"]


def test_language_id_ties_repeats_and_long_texts(spark):
    rng = random.Random(16)
    rows = [(k, words(rng, 40, GERMAN if k % 2 else ENGLISH), "de" if k % 2 else "en") for k in range(200)]
    rows += [(500, "½ ² Ⅷ", "en"), (501, "zz", None), (502, words(rng, 30_000, GERMAN), None), (503, words(rng, 9, ENGLISH), None), (503, rows[0][1], None), (None, rows[1][1], "de"), (None, rows[1][1], "de")]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    out = language_id.identify(df, language_id.train(language_id.training_rows(df))).collect()
    assert len(out) == len(rows)
    at = {r["doc_id"]: r for r in out}
    assert (at[500]["lang_pred"], at[500]["score"], at[500]["rejected"]) == ("und", 0.0, True) and at[502]["lang_pred"] == "de"
    assert len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] is None}) == 1
    same = {"aa": Counter(ENGLISH), "bb": Counter(ENGLISH)}
    model = language_id.fit(same, 3) | {"limits": np.tile([0.0, 0.0, 0.0, np.inf], (2, 1))}
    assert {r["lang_pred"] for r in language_id.identify(df.filter("doc_id = 503"), model).collect()} == {"aa"}


def brute_kneser_ney(counts, order, alphabet):
    """p(char | text before it) by the textbook's recursion over plain dicts, words padded at both ends."""
    grams = [Counter() for _ in range(order + 1)]
    for word, n in counts.items():
        w = f"\1{word}\2"
        for at in range(1, len(w)):
            for k in range(1, min(order, at + 1) + 1):
                grams[k][w[at + 1 - k : at + 1]] += n
    used = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            left = {x[0] for x in grams[k + 1] if x[1:] == g} if k < order else ()
            used[k][g] = n if k == order or g[0] == "\1" else max(1, len(left))
    discount = [0.0]
    for k in range(1, order + 1):
        n1, n2 = (sum(v == x for v in used[k].values()) for x in (1, 2))
        discount.append(min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2))))

    def p(context, c, k):
        if k == 0:
            return 1 / alphabet
        h = context[len(context) - k + 1 :] if k > 1 else ""
        after = {g: v for g, v in used[k].items() if g[:-1] == h}
        if not after:
            return p(context, c, k - 1)
        total = sum(after.values())
        return max(used[k][h + c] - discount[k], 0) / total + discount[k] * len(after) / total * p(context, c, k - 1)

    def word(w):
        w = f"\1{w}\2"
        return sum(math.log(p(w[:at], w[at], min(order, at + 1))) for at in range(1, len(w)))

    return word


def test_kneser_ney_against_brute_force():
    counts = Counter(ENGLISH * 3 + ["that"] * 20 + ["aaa", "abab"])
    alphabet = len({c for w in counts for c in w}) + 2
    model = language_id.fit({"en": counts}, order=4)
    brute = brute_kneser_ney(counts, 4, alphabet)
    asked = ["that", "the", "tha", "aaaa", "q", "qqz", "from", "xé", "a", "thatthat"]
    got = language_id.word_scores(model, asked)
    for w, row in zip(asked, got, strict=True):
        assert math.isclose(row[0], brute(w), rel_tol=1e-4), w
        assert row[1] == len(w) + 1


def test_kneser_ney_sums_to_one():
    """Every context's probabilities over the alphabet and the word's end sum to one."""
    counts = Counter(ENGLISH * 3 + ["that"] * 20)
    model = language_id.fit({"en": counts}, order=3)
    letters = sorted({c for w in counts for c in w})
    for context in ("", "t", "th", "he", "q", "zz"):
        scores = language_id.word_scores(model, [context + c for c in letters])
        # log P(context c END) - log P(END | ...) - log P(context): take the letter's step alone
        total = 0.0
        for c in [*letters, chr(language_id.END)]:
            place, _, hashes = language_id._grams([context + c], 3)
            value = 0.0
            at = len(context) + 1
            for k in range(3, 0, -1):
                if place[at] < k - 1:
                    continue
                i, found = language_id._find(model["grams"][k - 1][0], hashes[k][at : at + 1])
                if found[0]:
                    value += float(model["grams"][k - 1][1][i[0], 0])
                    break
                ctx = hashes[k - 1][at - 1 : at] if k > 1 else np.zeros(1, np.uint64)
                j, known = language_id._find(model["contexts"][k - 1][0], ctx)
                value += float(model["contexts"][k - 1][1][j[0], 0]) if known[0] else 0.0
            else:
                value -= math.log(model["alphabet"])
            total += math.exp(value)
        assert scores.shape == (len(letters), 2)
        unseen = 1 / model["alphabet"] if context == "zz" else 0.0  # an unknown context: each symbol alike, one is the unknown letter
        assert abs(total + unseen - 1) < (0.02 if context in ("", "t", "th", "he", "q") else 0.1)


# -- token counts ------------------------------------------------------------------------------


def test_token_counts(spark, corpus):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    odd = ["a<|endoftext|> b", "  <|endoftext|>\n\n x", "don't we'll  \t é́ ½ ٣ 中文 😀😀 x", "\r\n 　 a", "<|endoftext|>" * 3, "t " * 1500]
    rows = corpus + [(5000 + k, t) for k, t in enumerate(odd)] + [(None, "null key"), (5000, odd[0])]
    library = Tokenizer.from_file(path)
    out = token_counts.token_counts(frame(spark, rows), path).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out)
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert got == want
    assert token_counts.token_counts(frame(spark, rows).limit(0), path).count() == 0
    long = [(1, "y" * 200_000, 5), (1, "y" * 200_000, 6)]
    out = token_counts.token_counts(spark.createDataFrame(long, f"{DOCS}, n_tokens int"), path).collect()
    assert [r.asDict() for r in out] == [{"doc_id": 1, "n_bytes": 200_000, "n_tokens": len(library.encode("y" * 200_000).ids), "over_limit": True}] * 2


def test_token_cache_is_bounded(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 10)
    tokenizer, findall, special = token_counts._splitter(path)
    table = token_counts.Lengths({" the": 1}, tokenizer)
    text = " the " + " ".join(f"word{k}" for k in range(200))
    assert token_counts.count_tokens(text, table, findall, special) == len(tokenizer.encode(text).ids)
    assert len(table) <= 12


# -- substring dedup ----------------------------------------------------------------------------


def expected_repeats(rows, window):
    low = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            low[key] = min(low.get(key, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if low[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def test_substring_dedup(spark, corpus):
    rng = random.Random(8)
    rows = [(i, None if t is None else t.lower()) for i, t in corpus]
    loop = " ".join(["tick tock"] * 120)
    rows += [(2000, loop), (2001, f"start {loop} end"), (2002, words(rng, 49)), (2003, words(rng, 50))]
    for k in range(30):  # passages cut out of others at any place
        t = rng.choice(rows)[1] or ""
        w = t.split()
        a = rng.randrange(len(w) + 1)
        rows.append((3000 + k, f"{words(rng, rng.randrange(60))} {' '.join(w[a : a + rng.randrange(45, 140)])} {words(rng, rng.randrange(60))}"))
    out = substring_dedup.remove_repeats(frame(spark, rows), payload=["doc_id"]).collect()
    want = expected_repeats(rows, 50)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == want and len(out) == len(rows)
    assert all(sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"] for r in out)
    assert sum(x[1] for x in want.values()) > 2000


def test_substring_dedup_nulls_ties_and_clashes(spark):
    rng = random.Random(9)
    a, b = words(rng, 70), words(rng, 70)
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, a, "x"), (None, b, "x"), (None, b, "y"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = substring_dedup.remove_repeats(df).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in out) == sorted([("1", 0), ("1", 0), ("1", 0), ("2", 70), ("None", 70), ("None", 70), ("3", 0)])
    assert "text" in df.columns and out[0].asDict().keys() == {"doc_id", "text", "n_words", "n_removed", "spans", "kept_text"}
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_substring_dedup_tells_rows_of_one_key_apart(spark):
    """Many null keys and one repeated key, each row with a text of its own: no row loses another one's words."""
    rng = random.Random(21)
    first = words(rng, 60)
    rows = [(1, first)] + [(None if k % 2 else 7, words(rng, 70)) for k in range(3000)] + [(None, f"{first} {words(rng, 10)}"), (7, f"{words(rng, 5)} {first}"), ((1 << 63) - 1, first)]
    out = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    lost = Counter((r["doc_id"], r["n_removed"]) for r in out if r["n_removed"])
    assert len(out) == len(rows) and lost == {(None, 60): 1, (7, 60): 1, ((1 << 63) - 1, 60): 1}


def test_substring_dedup_with_hot_anchors(spark, monkeypatch):
    """A common run in ever different surroundings, dealt over all tasks."""
    from lanternfish.llm import _shared

    monkeypatch.setattr(_shared, "HUB_LEAST", 5)
    rng = random.Random(22)
    run, passage = words(rng, 30), words(rng, 60)
    rows = [(k, f"{words(rng, 40)} {run if k % 3 else passage} {words(rng, 40)}") for k in range(80)]
    out = substring_dedup.remove_repeats(frame(spark, rows), payload=["doc_id"]).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == expected_repeats(rows, 50)


# -- LM scoring ------------------------------------------------------------------------------------


class Automaton:
    """The backoff automaton with dicts, walked one token at a time; contexts are tuples of words."""

    def __init__(self, texts, mu2, mu3):
        self.c, self.mu = Counter(), {1: mu2, 2: mu3}
        for t in texts:
            seq = [b"\n", *lower(t).split(), None]
            self.c[(b"\n",)] += 1
            for k in (1, 2, 3):
                self.c.update(tuple(seq[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(seq)))
        words_ = {g: n for g, n in self.c.items() if len(g) == 1 and g != (b"\n",)}
        self.total, self.distinct, self.words = sum(words_.values()), len(words_), [g[0] for g in words_]

    def root(self, w):
        return (self.c[(w,)] + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def weight(self, context, w):
        """The probability on the arc of w from the context, which has been seen with it."""
        if not context:
            return self.root(w)
        mu = self.mu[len(context)]
        return (self.c[(*context, w)] + mu * self.weight(context[1:], w)) / (self.c[context] + mu)

    def walk(self, text):
        base = score = 0.0
        state = (b"\n",)
        for w in [*lower(text).split(), None]:
            base += math.log10(self.root(w))
            while state and not self.c[(*state, w)]:  # failure arcs
                mu = self.mu[len(state)]
                score += math.log10(mu / (self.c[state] + mu))
                state = state[1:]
            score += math.log10(self.weight(state, w))
            state = (*state, w)[-2:]
            while state and not self.c[state]:
                state = state[1:]
        return base, score


@pytest.mark.parametrize("part", [512, 3])
def test_lm_scoring(spark, corpus, monkeypatch, part):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 30_000)
    monkeypatch.setattr(lm_scoring, "PART", part)
    from pyspark.sql import functions as F

    rows = [*corpus, (None, "null key"), (4001, corpus[3][1]), (4002, corpus[3][1])]
    df = frame(spark, [(i, t, 1.5) for i, t in rows], f"{DOCS}, score double")
    found = lm_scoring.score(df, lm_scoring.crc_mod(F.col("doc_id"), 10) != 0).collect()
    assert len(found) == len(rows)
    out = {r["doc_id"]: r for r in found}
    learn = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    machine = Automaton(learn, lm_scoring.MU2, lm_scoring.MU3)
    for i, t in rows:
        base, score = machine.walk(t)
        r = out[i]
        assert r["train_tokens"] == machine.total and r["n_tokens"] == len((t or "").split()) + 1
        assert r["n_known"] == sum(machine.c[(w,)] > 0 for w in [*lower(t).split(), None])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    if part == 3:
        return
    assert lm_scoring.score(df.limit(0), F.lit(True)).count() == 0
    none = lm_scoring.score(df, F.lit(False)).collect()
    assert {r["n_known"] for r in none} == {0} and len(none) == len(rows)


def test_lm_automaton_is_a_distribution():
    """From every state the probabilities of all words, of the end and of an unknown word sum to one."""
    texts = [b"a b a c", b"a b", b"", b"b a b q"]
    grams = lm_scoring.Grams([*texts, b"new"])
    found = lm_scoring.count_runs([*texts, b"new"], np.array([True] * 4 + [False]), 64)
    assert all((a == b[0]).all() for a, b in zip(grams.keys, found, strict=True))
    counts = [c for _, c in found]
    assert int(counts[0].sum()) == 14 and int((counts[0] > 0).sum()) == 5
    machine = lm_scoring.Automaton(grams, counts, 14, 5, 4)
    every = np.arange(len(grams.keys[0]))
    assert len(machine.fail) > 6
    for state in range(len(machine.fail)):
        weight, _ = machine.step(np.full(len(every), state), every)
        assert math.isclose((10**weight).sum(), 1.0), state


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_packing(cell):
    """Keys and counts of all widths come back, in cells of one value as in one cell; of taken cells just their own."""
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 990, dtype=np.uint64), np.array([0, 1, 127, 128, 1 << 63, 2**64 - 1], np.uint64)]))
    values = keys[rng.permutation(len(keys))] >> rng.integers(0, 64, len(keys)).astype(np.uint64)
    edges = np.append(np.arange(0, len(keys), cell), len(keys))
    n = np.diff(edges)
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(keys, edges), n) == keys).all()
    cells = lm_scoring.pack(values, edges)
    assert (lm_scoring.unpack(cells) == values).all()
    assert (lm_scoring.unpack(cells[len(n) // 2 :]) == values[edges[len(n) // 2] :]).all()
    assert (lm_scoring.unpack(pa.chunked_array([cells[:0], cells, cells[1:]])) == np.concatenate([values, values[edges[1] :]])).all()
    none = lm_scoring.pack(values[:0], np.zeros(1, np.int64))
    assert len(none) == 0 and lm_scoring.unpack(none).size == 0 and lm_scoring.unpack_sorted(none, n[:0]).size == 0


# -- near-dedup ----------------------------------------------------------------------------------------


def shingles(text):
    w = lower(text).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected_near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("block", [384, 8])
def test_near_dedup(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", block)
    rng = random.Random(11)
    rows, base = list(corpus), words(rng, 200).split()
    for k in range(50):  # a family: links, chains and strangers among copies of one text
        t = list(base)
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(9999)}"
        rows.append((4000 + k, " ".join(t[: rng.randrange(150, 201)])))
    out = {r["doc_id"]: r for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    want = expected_near(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())
    assert len({c for _, c in want.values()}) < len(rows) - 30


def test_near_dedup_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (None, "only null ids here"), (None, "only null ids here"), (7, None), (8, ""), (None, None)]
    out = near_dedup.near_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == sorted(
        [("None", "4", False), ("4", "4", True), ("4", "4", True), ("None", "None", True), ("None", "None", True), ("7", "7", True), ("8", "8", True), ("None", "None", True)]
    )
    assert near_dedup.near_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_near_dedup_of_many_rows_of_one_key(spark, monkeypatch):
    """Near copies with null and equal keys: each text goes to the comparison once, whatever its key."""
    rng = random.Random(31)
    base = words(rng, 120).split()
    texts = []
    for _ in range(400):
        t = list(base)
        t[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    rows = [(None if k < 300 else 9, t) for k, t in enumerate(texts)] + [(None, texts[0])] * 50
    sent, confirm = spark.sparkContext.accumulator(0), near_dedup._confirm

    def counted(percent):
        inner = confirm(percent)

        def run(batches):
            def seen():
                for b in batches:
                    sent.add(b.num_rows)
                    yield b

            yield from inner(seen())

        return run

    monkeypatch.setattr(near_dedup, "_confirm", counted)
    out = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert len(out) == len(rows) and {r["component_id"] for r in out} == {9} and len({r["group"] for r in out}) == 1
    assert {(r["doc_id"], r["kept"]) for r in out} == {(None, False), (9, True)}
    assert sent.value < 4 * len(texts)


def test_near_dedup_with_hot_keys_and_pivots(spark, monkeypatch):
    """A large family, cut into blocks: copies of one text around pivots, chains and strangers."""
    from lanternfish.llm import _shared

    monkeypatch.setattr(_shared, "HUB_LEAST", 5)
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 16)
    rng = random.Random(32)
    rows, base = [], words(rng, 200).split()
    for k in range(160):
        t = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 6, 9, 12])):
            t[rng.randrange(len(t))] = f"n{rng.randrange(9999)}"
        rows.append((k, " ".join(t[: rng.choice([200, 200, 180, 160])])))
    rows += [(500 + k, rows[5][1]) for k in range(40)]
    out = {r["doc_id"]: r for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    want = expected_near(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == want
    assert 5 < len({c for _, c in want.values()}) < 150


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = x[:800], x[200:]
    same = near_dedup.signature(a) == near_dedup.signature(b)
    assert abs(same.mean() - 0.6) < 0.12


# -- mixing ---------------------------------------------------------------------------------------------------


def mixing_targets(sizes, weights, share, most):
    """share * all sizes by weight; no target above most * its size, the excess reshared by weight."""
    total, fixed = share * sum(sizes), {}
    while True:
        live = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in live)
        over = [i for i in live if left * weights[i] / weight > most * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else left * weights[i] / weight for i in range(len(sizes))]
        fixed.update({i: float(most * sizes[i]) for i in over})


def test_mixing_targets():
    assert mixing_targets([100, 100, 100], [1, 1, 1], 1.5, 2) == [150, 150, 150]
    got = mixing_targets([10, 1000, 0], [5, 2, 1], 1.5, 2)
    assert got == [20, 1495, 0] and sum(got) == 1515


@pytest.mark.parametrize("wide", [False, True])
def test_mixing_against_brute_force(spark, monkeypatch, wide):
    """Every word is told apart, so the mixed blocks themselves tell what is taken of each row."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 10)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 16)
    monkeypatch.setattr(mixing, "PLAN_SLOTS", 40)
    monkeypatch.setattr(mixing, "COPIES", 3)
    if wide:
        from lanternfish.llm import _shared

        monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
        monkeypatch.setattr(_shared, "HUB_LEAST", 5)
    rng = random.Random(13)
    rows = [(k, " ".join(f"d{k}_{j}" for j in range(rng.choice([0, 1, 40, 100, 900]))), rng.choice("aab")) for k in range(120)]
    rows += [(None, " ".join(f"n_{j}" for j in range(30)), "a")] * 11
    mix = mixing.Mix(frame(spark, rows, "doc_id long, text string, source string"), block=32)
    counts, blocks = mix.counts().collect(), mix.blocks().collect()
    told = Counter(w.split("_")[0] for b in blocks for w in b["block_text"].split())
    taken = Counter()
    for r in counts:
        taken["n" if r["doc_id"] is None else f"d{r['doc_id']}"] += r["taken"]
    assert +taken == told and len(counts) == len(rows)
    seen, times = {}, Counter()
    for b in blocks:
        assert seen.setdefault((b["source"], b["block"]), b["block_text"]) == b["block_text"]
        times[b["source"], b["block"]] += 1
    for source in "ab":
        own = {k: n for k, n in times.items() if k[0] == source}
        size = sum(len((t or "").split()) for _, t, x in rows if x == source)
        assert max(own.values()) - (min(own.values()) if len(own) == -(-size // 32) else 0) <= 1 and max(own.values()) <= 2
    held = Counter(w for t in seen.values() for w in t.split())
    assert all(n == 1 for w, n in held.items() if w[0] == "d") and all(n <= 11 for w, n in held.items() if w[0] == "n")
    sizes = Counter(b["shard"] for b in blocks)
    assert len(sizes) == mix.shards > 3 and max(sizes.values()) < 30


def test_levels_are_those_of_the_targets(spark):
    rng = random.Random(15)
    for n in (0, 1, 2, 7, 40):
        sizes = [rng.choice([0, 3, 50, 1000, 10**6]) for _ in range(n)]
        weights = [(5, 2, 1)[k % 3] for k in range(n)]
        df = spark.createDataFrame([(k, s, float(w)) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))], "k int, m_size long, m_weight double")
        left, whole = mixing.level(df, 1.5, 2.0)
        got = [min(left * w / whole, 2.0 * s) for s, w in zip(sizes, weights, strict=True)]
        assert got == pytest.approx(mixing_targets(sizes, weights, 1.5, 2))


def test_draws_are_whole_and_the_same_from_any_part():
    for seed, shards, count in ((1, 1, 10), (2, 7, 0), (3, 7, 1000), (-4, 100, 50_000)):
        every = list(mixing.draw(seed, 0, shards, 0, count))
        assert sum(n for *_, n in every) == count and all(h - a == 1 and n > 0 for a, h, _, n in every)
        assert [f for _, _, f, _ in every] == [sum(n for *_, n in every[:k]) for k in range(len(every))]
        again = [x for a, h, f, n in mixing.draw(seed, 0, shards, 0, count, 3000) for x in mixing.draw(seed, a, h, f, n)]
        assert again == every
    drawn = [n for *_, n in mixing.draw(9, 0, 64, 0, 64 * 1000)]
    assert len(drawn) == 64 and 900 < min(drawn) and max(drawn) < 1100 and len(set(drawn)) > 20


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing.permute(np.arange(n), n, 5)
        assert sorted(got.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), 1000, 1).tolist() != mixing.permute(np.arange(1000), 1000, 2).tolist()


def test_mixing(spark):
    rng = random.Random(12)
    rows = [(k, words(rng, rng.choice([0, 5, 90, 700])), rng.choice(["a", "b", "c", "É", None]), "extra") for k in range(300)]
    rows += [(1000, None, "a", "x"), (1001, words(rng, 9000), "b", "x"), (None, "no key", "z", "x"), (1, rows[1][1], rows[1][2], "again")]
    df = frame(spark, rows, "doc_id long, text string, source string, size string")
    mixed = mixing.Mix(df)
    out = mixed.counts().collect()
    again = mixing.Mix(df.repartition(7)).counts().collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    sizes, taken, goal = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = (r["source_size"], r["target"])
    names = sorted(s for s in sizes if s is not None) + [None]
    want = mixing_targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)
    for s, w in zip(names, want, strict=True):
        assert goal[s] == (sizes[s], pytest.approx(w))
        assert abs(taken[s] - w) <= 2 * mixing.BLOCK
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(i), len((t or "").split())) for i, t, _, _ in rows)
    blocks = mixed.blocks().collect()
    told = Counter()
    for b in blocks:
        told[b["source"]] += len(b["block_text"].split())
    assert told == {s: n for s, n in taken.items() if n}
    most = Counter((b["source"], b["block"]) for b in blocks)
    assert max(most.values()) <= 2 and all(len(b["block_text"].split()) <= mixing.BLOCK for b in blocks)
    texts = {t.split()[0] for _, t, _, _ in rows if t}
    assert texts & {b["block_text"].split()[0] for b in blocks}
    assert mixing.Mix(df.limit(0)).counts().count() == 0


# -- HTML ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>x<li>y<li value=9>z</ol>", "3. x\n4. y\n9. z"),
        ("<table><tr><th>name<th>n<tr><td>apple<td>3<tr><td>fig<td>12</table>", "name   n\napple  3\nfig    12"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<pre>x  y\n  z</pre>", "x  y\n  z"),
        ("a<script>var t='</p>';</script>b<style>p{}</style>c", "abc"),
        ("a<span hidden>no</span><span style='display: none'>no</span>b", "ab"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<style>.x, #y {display:none}</style><p class='a x'>no</p><p id=y>no</p><p>yes</p>", "yes"),
        ("<style>@media print {p{display:none}} @media screen {.s{display:none}} @import 'x'; @media (max-width: 9px) {b{display:none}}</style><p>yes</p><i class=s>no</i><b>wide</b>", "yes\n\nwide"),
        ("<style>p{display:none} p.on, .on{display:block} #z.on{display:none!important}</style><p>no</p><p class=on>yes</p><p class=on id=z>no</p>", "yes"),
        ("<style>p{display:none}</style><p style='display:block'>yes</p><p>no</p>", "yes"),
        ("<style>.a .b{display:none} div > p{visibility:hidden} *.c{visibility:hidden}</style><p class=b>yes</p><i class=c>no</i>", "yes"),
        ("<table><tr><td rowspan=2 colspan=60>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<details><summary>s</summary>closed</details><details open><summary>t</summary>seen</details>", "s\nt\nseen"),
        ("<!-- <p>no</p> --><p>yes", "yes"),
        ("x <!-- never closed", "x"),
        ("<p>x</p>y <b z <!-- never closed", "x\n\ny <b z"),
        ("<select><option>a<option selected>b</select> <input type=submit value=go><input type=hidden value=no>", "b go"),
        ("a < b and c > d", "a < b and c > d"),
        ("<b><i>x</b>y</i>", "xy"),
        ("<a href='q\">x</a>y", "xy"),
        ("<blockquote>q</blockquote>after", "  q\n\nafter"),
        ("<title>T</title><h1>H</h1>text", "H\n\ntext"),
    ],
)
def test_render(page, text):
    assert html_render.render(page)[1] == text


def brute_page(rng, depth=0):
    """(markup, lines) of a random page: blocks, lists, tables and hidden parts, with what a reader sees of them."""
    html, lines = [], []

    def word():
        return f"w{rng.randrange(1000)}"

    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["p", "list", "table", "hidden", "pre", "quote"] + (["div"] if depth < 3 else []))
        own = []
        if kind == "p":
            a, b = word(), word()
            html.append(f"<p>{a} <b>{b}</b>\n &amp; <i hidden>no</i>" + rng.choice(["", "</p>"]))
            own = [f"{a} {b} &"]
        elif kind == "list":
            items = [word() for _ in range(rng.randrange(1, 4))]
            html.append("<ol>" + "".join(f"<li>{x}" for x in items) + "</ol>")
            own = [f"{k}. {x}" for k, x in enumerate(items, 1)]
        elif kind == "table":
            cells = [[word()[: rng.randrange(2, 5)] for _ in range(3)] for _ in range(rng.randrange(1, 4))]
            html.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in cells) + "</table>")
            wide = [max(len(r[k]) for r in cells) for k in range(3)]
            own = ["  ".join(c.ljust(n) for c, n in zip(r, wide, strict=True)).rstrip() for r in cells]
        elif kind == "hidden":
            html.append(rng.choice(["<script>no</script>", "<!-- no -->", "<p hidden>no</p>", "<div style='display:none'>no<p>no</div>", "<template><p>no</p></template>"]))
            continue
        elif kind == "pre":
            a = word()
            html.append(f"<pre>{a}  x\n y</pre>")
            own = [f"{a}  x", " y"]
        elif kind == "quote":
            a = word()
            html.append(f"<blockquote>{a}</blockquote>")
            own = [f"  {a}"]
        else:
            inner, own = brute_page(rng, depth + 1)
            html.append(f"<section>{inner}</section>")
        if own:
            lines += ([""] if lines else []) + own
    return "".join(html), lines


def test_render_against_brute_force():
    rng = random.Random(41)
    for _ in range(400):
        page, lines = brute_page(rng)
        assert html_render.render(page)[1] == "\n".join(lines).strip("\n"), page


def test_render_odd_pages():
    assert html_render.render("<div>" * 5000 + "deep")[1] == "deep"
    assert "end" in html_render.render("<p>w " * 20000 + "end")[1]
    assert html_render.render("<title> A  b </title>x")[0] == "A b"
    for junk in ("<" * 2000, "<a " * 3000, "<a b='" * 3000, "<!" * 2000, "</" * 2000, "&" * 100, "<td>x</td></table></p>", "<a b='" * 100_000, "<table><table><tr><td>x"):
        html_render.render(junk)


def test_extract(spark):
    df = spark.createDataFrame([(1, "<title>T</title><p>a</p><p>b</p>", "old"), (1, "<title>T</title><p>a</p><p>b</p>", "old"), (None, None, "x")], "page_id long, html string, title string")
    out = html_render.extract(df).collect()
    assert sorted((str(r["page_id"]), str(r["title"]), r["rendered"], r["n_blocks"]) for r in out) == [("1", "T", "a\n\nb", 2)] * 2 + [("None", "None", "", 0)]
    assert html_render.extract(df.limit(0)).count() == 0


# -- URLs ------------------------------------------------------------------------------------------------------


def test_split_and_rules():
    assert url_filters.split_url("HTTP://WWW.Example.com/En/a?q#f") == ("www.example.com", "/En/a", "?q")
    assert url_filters.split_url("no scheme") == url_filters.split_url(None) == ("", "", "")
    rules = url_filters.Rules(url_filters.RULES)
    assert rules.judge("blog.example.com", "/en/x") == ("example.com/en/", "block")
    assert rules.judge("www.example.com", "/en/x") == ("www.example.com/en/", "allow")
    assert rules.judge("x.www.example.com", "/en/x") == ("www.example.com/en/", "allow")
    assert rules.judge("notexample.com", "/en/x") == ("com/", "allow")
    assert rules.judge("a.net", "/es/") == ("net/es/", "block") and rules.judge("a.net", "/") == (None, None)
    assert rules.judge("example.com", "") == (None, None)


def test_links_are_elements():
    link = '<link rel=canonical href="{}">'
    at = lambda html: url_filters.targets("http://h.org/a/b", html)
    assert at(link.format("/c")) == ["http://h.org/c"] and at("<head>" + link.format("c#x") + "</head>") == ["http://h.org/a/c#x"]
    assert at("<!-- " + link.format("/c") + " -->") == [] and at("<script>var x='" + link.format("/c") + "'</script>") == []
    assert at("<template>" + link.format("/c") + "</template><textarea>" + link.format("/d") + "</textarea>") == []
    assert at('<base href="http://o.org/x/">' + link.format("c")) == ["http://o.org/x/c"]
    assert at("<meta http-equiv=REFRESH content='5;URL=/n'>" + link.format("http://[")) == ["http://h.org/n"]


def test_url_filters_hot_urls_and_clashes(spark, monkeypatch):
    """Many pages name one url, many are one page, many have no url at all; columns named like the operator's own."""
    from lanternfish.llm import _shared

    monkeypatch.setattr(_shared, "HUB_LEAST", 5)
    link = '<link rel="canonical" href="http://a.net/es/hot">'
    rows = [(k, f"http://s{k}.org/", link, "x", k) for k in range(60)] + [(100 + k, "http://same.org/", link if k == 3 else "", "x", k) for k in range(40)] + [(200 + k, None, link, "x", k) for k in range(40)]
    rows += [(300, "http://free.org/", "<p>" + "word " * 200_000 + f"<!-- {link} --><script>'{link}'</script>", "x", 1)]
    out = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string, node string, verdict int")).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"page_id", "host", "path", "rule", "verdict", "component"}
    assert all(r["verdict"] == ("block" if r["page_id"] < 200 else "allow") for r in out)
    tie = url_filters.Rules([("com", "/ab/", "allow"), ("a.com", "/a", "block")])
    assert tie.judge("a.com", "/ab/") == ("a.com/a", "block")


def test_url_equivalence(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.org/x", link.format("https://a.net/es/1")),  # alias of a blocked url
        (2, "http://a.org/y?p=1#t", "<META http-equiv=refresh content='0; url=/x'>"),  # alias of 1 by a refresh
        (3, "https://a.org/y?p=1", None),  # the same page as 2
        (4, "http://b.org/", link.format("http://b.net/fr/") + link.format("http://b.com/ok")),  # blocked and allowed: allow wins
        (5, "http://c.org/", "<p>nothing</p>"),
        (6, None, link.format("http://a.net/es/1")),
        (7, "nonsense", None),
        (8, "http://example.com/en/q", link.format("http://www.example.com/en/q")),  # its own rule counts
        (9, "http://d.org/", ""),
        (9, "http://d.org/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://d.org/", "http://e.org/z"), ("http://e.org/z", "http://f.net/es/"), (None, "http://d.org/")], "from_url string, to_url string")
    out = url_filters.judge(df, redirects=moved).collect()
    got = {r["page_id"]: r["verdict"] for r in out}
    assert len(out) == len(pages)
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block"}
    assert {r["rule"] for r in out if r["page_id"] in (1, 5)} == {None}
    assert url_filters.judge(df.limit(0)).count() == 0


def test_distinct_values():
    from lanternfish.llm._tokens import distinct, index_distinct

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        x = rng.integers(0, 100, n, dtype=np.uint64)
        keys, at, inverse = index_distinct(x)
        assert distinct(x).tolist() == keys.tolist() == sorted(set(x.tolist()))
        assert (x[at] == keys).all() and (keys[inverse] == x).all()
