"""Words, windows, scores and guards: traps of the ranking and of requests."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternfish.functions import guards, scoring, text
from lanternfish.operators import bm25, chunking, embed, hybrid, vector


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_words_split_at_unicode_space(spark):
    s = " a b c\x1cd\x85e\t\n f "
    assert one(spark, w=text.words(F.lit(s)))["w"] == s.split()
    assert one(spark, w=text.words(F.lit("")))["w"] == []
    assert one(spark, t=text.strip(F.lit("  x y \n")))["t"] == "x y"


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (350, 1), (351, 2), (400, 2), (700, 2), (701, 3), (1000, 3)])
def test_trailing_window(spark, n, chunks):
    df = spark.createDataFrame([(" ".join(map(str, range(n))), "x")], "content string, extra string")
    out = chunking.chunk(df).orderBy("order").collect()
    assert len(out) == chunks == math.ceil(n / 350)
    for r in out:
        first = r["order"] * 350
        assert r["content"].split() == [str(k) for k in range(first, min(n, first + 400))] and r["extra"] == "x"


def test_stride_must_move(spark):
    with pytest.raises(ValueError, match="overlap"):
        text.windows(F.col("w"), 50, 50)


def test_ids(spark):
    docs = spark.createDataFrame([("s", "c", None, None), ("s", "c", "own", "web")], "source string, content string, id string, type string")
    a, b = chunking.with_ids(docs).orderBy(F.desc("type")).collect()
    assert (a["id"], a["type"]) == ("own", "web") and len(b["id"]) == 32 and b["type"] == "documentation"


def test_preview_and_summary(spark):
    for n in (3, 39, 40, 41):
        got = one(spark, p=text.preview(F.lit(" ".join("w" * n))))["p"]
        assert got.endswith("...") == (n >= 40) and len(got.replace("...", "").split()) == min(n, 40)
    docs = spark.createDataFrame([("s", " ".join("w" * 500))], "source string, content string")
    r = chunking.summaries(chunking.chunk(docs)).first()
    assert (r["chunks_indexed"], r["words"]) == (2, 550)  # words in overlaps count twice


def test_batch_keeps_last_value_first_place(spark):
    rows = [(0, "a", "x"), (1, "b", "y"), (2, "a", "z")]
    out = chunking.latest_of_batch(spark.createDataFrame(rows, "item int, source string, v string"), "source", "item", ["v"])
    assert {(r["source"], r["item"], r["v"]) for r in out.collect()} == {("a", 0, "z"), ("b", 1, "y")}


def test_corpus_hash(spark):
    import hashlib

    df = spark.createDataFrame([("a.md", 0, "x"), ("b.md", 0, "é")], "source string, order int, content string")
    want = hashlib.sha256("a.md\0x\0b.md\0é\0".encode()).hexdigest()
    assert chunking.corpus_hash(df, ["source", "order"]).first()[0] == want
    swapped = df.withColumn("source", F.when(F.col("source") == "a.md", "b.md").otherwise("a.md"))
    assert chunking.corpus_marks(df, ["order"]).first() != chunking.corpus_marks(swapped, ["order"]).first()
    assert chunking.corpus_hash(df.limit(0), ["source", "order"]).first()[0] == hashlib.sha256(b"").hexdigest()


# -- BM25 ------------------------------------------------------------------------------


def brute(corpus, query, k1=1.5, b=0.75):
    toks = [re.findall(r"\w+", c.lower()) for c in corpus]
    n, avg = len(toks), sum(map(len, toks)) / len(toks) if toks else 0
    out = []
    for t in toks:
        s = 0.0
        for q in set(re.findall(r"\w+", query.lower())):
            df = sum(q in x for x in toks)
            tf = t.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        out.append(s)
    return out


def scores(spark, corpus, queries):
    c = spark.createDataFrame(list(enumerate(corpus)), "pos long, content string")
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    stats = bm25.stats(bm25.lengths(c, ["pos"]))
    found = bm25.score(bm25.matches(c, ["pos"], q), stats, q, ["pos"])
    return {(r["qid"], r["pos"]): r["score"] for r in found.collect()}, {r["qid"]: (r["low"], r["high"]) for r in bm25.spread(found, stats, q).collect()}


def test_hand_computed_score(spark):
    got, _ = scores(spark, ["the cat sat on the mat", "the dog sat on the log"], ["cat"])
    assert got == {(0, 0): pytest.approx(math.log(1 + 1.5 / 1.5))}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d é _x 9".split()), max_size=12).map(" ".join), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from("a b c d zz É".split()), max_size=4).map(" ".join), min_size=1, max_size=3))
def test_scores_match_brute_force(spark, corpus, queries):
    got, ends = scores(spark, corpus, queries)
    for q, query in enumerate(queries):
        want = brute(corpus, query)
        assert [got.get((q, i), 0.0) for i in range(len(corpus))] == pytest.approx(want)
        assert ends[q] == (pytest.approx(min(want)), pytest.approx(max(want)))


@pytest.mark.parametrize("queries", [["b zz a"], ["a b", "", "c a a"], [""]])
def test_lookup_equals_score(spark, queries):
    c = spark.createDataFrame(list(enumerate(["a b a", "b c", "d", ""])), "pos long, content string")
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    index, stats = bm25.postings(c, ["pos"]), bm25.stats(bm25.lengths(c, ["pos"]))
    s = stats.first()
    pick = lambda d: {(r["qid"], r["pos"]): pytest.approx(r["score"]) for r in d.collect()}
    want = pick(bm25.score(index, stats, q, ["pos"]))
    got = {(r["qid"], r["pos"]): r["score"] for r in bm25.lookup(index, s["n"], s["avgdl"], q, ["pos"]).collect()}
    assert got == want
    assert {(r["qid"], r["pos"]): r["score"] for r in bm25.score(bm25.of_terms(index, q), stats, q, ["pos"]).collect()} == want


def test_repeated_query_terms_count_once(spark):
    a, _ = scores(spark, ["x y", "x x z"], ["x x x"])
    b, _ = scores(spark, ["x y", "x x z"], ["x"])
    assert a == b


def test_incremental_statistics_equal_a_rebuild(spark):
    rng = random.Random(1)
    make = lambda n: spark.createDataFrame([(k, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(9)))) for k in range(n)], "pos long, content string").cache()
    old, new = make(20), make(7)
    gone = old.filter("pos % 3 = 0")
    part = lambda d: bm25.stats(bm25.lengths(d, ["pos"]))
    assert bm25.merge_stats(part(old), part(new), part(gone)).first() == part(old.filter("pos % 3 <> 0").unionByName(new)).first()
    none = bm25.merge_stats(part(old), part(new.limit(0)), part(old)).first()
    assert tuple(none) == (0, 0, 0.0)


# -- vectors and fusion ------------------------------------------------------------------


def test_cosine(spark):
    r = one(spark, a=scoring.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-2.0), F.lit(0.0))), z=scoring.cosine(F.array(F.lit(0.0)), F.array(F.lit(3.0))))
    assert r["a"] == -1.0 and r["z"] == 0.0


def test_min_max(spark):
    r = one(spark, a=scoring.min_max(F.lit(3.0), F.lit(1.0), F.lit(5.0)), b=scoring.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)))
    assert (r["a"], r["b"]) == (0.5, 0.0)


def test_arrow_top_k_equals_expression(spark):
    rng = random.Random(2)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(4)]) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "key long, embedding array<float>").repartition(3)
    queries = [(0, [1.0, 0.0, 1.0, 0.0]), (1, [0.0] * 4)]
    q = spark.createDataFrame(queries, "qid long, query_vec array<float>")
    slow = vector.rank(vector.cosine(df.filter("embedding IS NOT NULL"), q, ["key"]), F.round("vector_score", 9), ["key"], 5)
    fast = vector.top_cosine(df, queries, "key", 5)
    pick = lambda d: sorted((r["qid"], r["rank"], r["key"], round(r["vector_score"], 9)) for r in d.collect())
    assert pick(slow) == pick(fast)


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, "pos long, content string, embedding array<float>")


def test_single_chunk_has_no_keyword_score(spark):
    q = spark.createDataFrame([(0, "cat", [1.0, 0.0])], "qid long, query string, query_vec array<float>")
    r = hybrid.search(corpus_of(spark, [(0, "cat", [1.0, 0.0])]), q, ["pos"], 3).first()
    assert r["keyword_score"] == 0.0 and r["vector_score"] == 1.0 and r["confidence"] == 0.65


def test_ties_go_by_position_and_empty_query(spark):
    q = spark.createDataFrame([(0, "", [0.0, 0.0])], "qid long, query string, query_vec array<float>")
    out = hybrid.search(corpus_of(spark, [(k, "same", [1.0, 0.0]) for k in range(9)]), q, ["pos"], 4).collect()
    assert sorted((r["rank"], r["pos"]) for r in out) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_confidence_may_be_negative_and_output_is_rounded(spark):
    item = hybrid.evidence(F.lit("c"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(-0.12345), F.lit(-0.9876), F.lit(0.0), F.lit("i"))
    e = one(spark, e=item)["e"]
    assert (e["source"], e["type"], e["confidence"], e["metadata"]["vector_score"]) == ("unknown", "documentation", -0.123, -0.988)


def test_top_k():
    assert hybrid.resolve_top_k(None, 99, 50) == 99 and hybrid.resolve_top_k(70, 3, 50) == 50
    with pytest.raises(ValueError, match="top_k"):
        hybrid.resolve_top_k(0, 3, 50)


def test_empty_corpus(spark):
    q = spark.createDataFrame([(0, "cat", [1.0])], "qid long, query string, query_vec array<float>")
    assert hybrid.search(corpus_of(spark, []), q, ["pos"], 3).count() == 0


def test_hashing_backend(spark):
    b = embed.Hashing(16)
    v = b.encode(["A b b", "a B b", "", None])
    assert v.shape == (4, 16) and (v[0] == v[1]).all() and not v[2:].any()
    rows = embed.encode(spark.createDataFrame([("A b b",), (None,)], "content string"), b).collect()
    assert [len(r["embedding"]) for r in rows] == [16, 16]


# -- guards ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("ip", "blocked"),
    [("127.0.0.1", True), ("::1", True), ("169.254.169.254", True), ("10.0.0.5", True), ("192.168.1.1", True), ("::ffff:169.254.169.254", True), ("[::1]", True), ("0.0.0.0", True), ("224.1.1.1", True), ("8.8.8.8", False), ("2001:4860:4860::8888", False), ("x", None), (None, None)],
)
def test_addresses(ip, blocked):
    assert guards.address_blocked(ip) == blocked


def test_url_guard(spark):
    urls = ["http://a.b/c", "HTTPS://U:p@A.b:80/", "http://[::1]/x", "ftp://a/", "file:///etc", "javascript:alert(1)", "http:///x", "", None, "x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(guards.url_error(F.col("u")).isNull().alias("ok"), guards.host_of(F.col("u")).alias("h"))
    assert [r["ok"] for r in df.collect()] == [True] * 3 + [False] * 7
    assert [r["h"] for r in df.limit(3).collect()] == ["a.b", "a.b", "::1"]


def test_requests_and_responses(spark):
    n = lambda v, k: F.lit(v).cast(k)
    s = lambda v: n(v, "string")
    r = one(
        spark,
        q=guards.query_ok(s("  x ")), q0=guards.query_ok(s(" \t")), qn=guards.query_ok(s(None)), q9=guards.query_ok(s("x" * 2001)),
        k=guards.top_k_ok(n(None, "int")), k0=guards.top_k_ok(n(0, "int")), k9=guards.top_k_ok(n(51, "int")),
        u=guards.ingest_ok(s("http://x"), s(None), s(None)), h=guards.ingest_ok(s(""), s("<p>"), s("s")), h0=guards.ingest_ok(s(None), s("<p>"), s(None)), e=guards.ingest_ok(s(""), s(""), s("s")),
        t=guards.html_type_ok(s(" Text/HTML; charset=x")), t0=guards.html_type_ok(s(None)), t9=guards.html_type_ok(s("application/pdf")),
        b=guards.body_text(n(b"a\xffb", "binary"), 10), b9=guards.body_text(n(b"abc", "binary"), 2),
    )
    assert [r[x] for x in ("q", "q0", "qn", "q9", "k", "k0", "k9", "u", "h", "h0", "e", "t", "t0", "t9")] == [True, False, False, False, True, False, False, True, True, False, False, True, True, False]
    assert r["b"] == "a�b" and r["b9"] is None
    hosts = spark.createDataFrame([("a", "8.8.8.8"), ("a", "10.0.0.1"), ("b", "8.8.8.8"), ("c", None)], "host string, ip string")
    assert {(x["host"], x["blocked"]) for x in guards.blocked_host(hosts).collect()} == {("a", True), ("b", False), ("c", False)}


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_within_rows(spark):
    texts = ["b a b _ ä", "", None, "x", "a a A " * 300]
    c = spark.createDataFrame(list(enumerate(texts)), "pos long, content string").repartition(3).localCheckpoint()
    want = {(0, "b", 2, 5), (0, "a", 1, 5), (0, "_", 1, 5), (0, "ä", 1, 5), (3, "x", 1, 1), (4, "a", 900, 900)}
    index = bm25.postings(c, ["pos"])
    assert {(r["pos"], r["term"], r["tf"], r["dl"]) for r in index.collect()} == want and index.count() == len(want)
    q = spark.createDataFrame([(1, "A zz"), (2, "b a")], "qid long, query string")
    found = bm25.matches(c, ["pos"], q)
    assert {(r["pos"], r["term"], r["tf"], r["dl"]) for r in found.collect()} == {w for w in want if w[1] in "ab"}
    assert bm25.matches(c, ["pos"], q.filter("qid > 2")).count() == 0
    assert "Exchange" not in shuffles(index) and "Exchange" not in shuffles(found)


def test_vectors_of_documents_apart_from_chunks(spark):
    texts = ["released under the MIT license", "plain words", "the MIT way", "more words"]
    c = spark.createDataFrame([(k // 2, k % 2, t) for k, t in enumerate(texts * 3)], "doc_id long, ord int, content string")
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(0, 6, 2)], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, "MIT license", [0.0, 1.0]), (2, "none", [1.0, 0.0])], "qid long, query string, query_vec array<float>")
    want = hybrid.search(c.join(v, "doc_id", "left"), q, ["doc_id", "ord"], 7)
    got = hybrid.search(c, q, ["doc_id", "ord"], 7, vectors=v)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[n] for n in got.columns) for r in want.collect())


@pytest.mark.parametrize("of", ["texts", "pages"])
def test_arrow_batches_of_texts_are_small(spark, of):
    from lanternfish.operators import ingest

    class Sizes:
        dimension = 1

        def encode(self, texts):
            import numpy as np

            return np.full((len(texts), 1), len(texts), dtype=np.float32)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        rows = spark.range(1200).repartition(1).selectExpr("id", "'<p>x' AS html", "'u' AS url", "'x' AS content")
        if of == "texts":
            sizes = embed.encode(rows, Sizes()).selectExpr("max(embedding[0])").first()[0]
            assert sizes <= 500
        else:
            assert ingest.extract(rows.drop("content")).filter("content = 'x'").count() == 1200
        assert int(spark.conf.get(name)) <= 500
    finally:
        spark.conf.set(name, old)
