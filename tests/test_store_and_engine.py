"""Both stores under one contract, the log, the engine, ingest, the limiter and the streams."""

import json
import random
import time
import urllib.parse

import pytest
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.engine import Agent, BadRequest, Engine, NoContent, RateLimited
from lanternfish.operators import chunking, ingest, limiter, redirects, store
from lanternfish.sources import article, jsonstore, markdown, web
from lanternfish.streaming import ingest as stream_ingest
from lanternfish.streaming import limiter as stream_limiter


def page(spark, source, n, fill):
    rows = [(f"id-{source}", source, f"text {k} of {source} {fill}", "web", k, [float(fill)] * 4) for k in range(n)]
    return spark.createDataFrame(rows, "id string, source string, content string, type string, order int, embedding array<float>")


def held(s):
    return sorted((r["source"], r["order"], r["embedding"][0]) for r in s.load().collect())


@pytest.fixture(params=["segmented", "rewrite"])
def any_store(request, spark, tmp_path):
    return store.make_store(request.param, spark, str(tmp_path / "store"))


def test_contract(spark, any_store):
    s = any_store
    assert held(s) == [] and tuple(s.stats().first())[:3] == (0, 0, 0)
    s.upsert(page(spark, "a", 2, 1))
    s.upsert(page(spark, "b", 1, 2).unionByName(page(spark, "é 漢", 1, 3)))
    assert held(s) == [("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 2.0), ("é 漢", 0, 3.0)]
    s.upsert(page(spark, "a", 1, 9))  # replaces, and moves to the end
    assert held(s) == [("a", 0, 9.0), ("b", 0, 2.0), ("é 漢", 0, 3.0)]
    assert [r["source"] for r in s.load().orderBy("pos", "row").collect()][-1] == "a"
    s.delete_sources(["b", "nobody"])
    assert [h[0] for h in held(s)] == ["a", "é 漢"]
    s.upsert(page(spark, "a", 0, 1))
    assert len(held(s)) == 2
    r = s.stats().first()
    assert (r["live_chunks"], r["sources"]) == (2, 2)
    again = type(s)(spark, s.folder)
    assert held(again) == held(s)


def test_no_change_no_version(spark, tmp_path):
    s = store.SegmentedStore(spark, str(tmp_path))
    s.upsert(page(spark, "a", 1, 1))
    before = s.version()
    s.delete_sources(["b"])
    s.upsert(page(spark, "a", 1, 1).limit(0))
    assert s.version() == before


def test_misaligned_vectors_are_not_published(spark, tmp_path):
    s = store.SegmentedStore(spark, str(tmp_path))
    s.upsert(page(spark, "a", 1, 1))
    for bad in (F.when(F.col("order") == 0, F.col("embedding")), F.slice("embedding", 1, F.col("order") + 1)):
        with pytest.raises(ValueError, match="match"):
            s.upsert(page(spark, "b", 2, 2).withColumn("embedding", bad))
    assert held(s) == [("a", 0, 1.0)]


def test_unknown_store(spark):
    with pytest.raises(ValueError, match="chunk store"):
        store.make_store("sqlite", spark, "x")


def test_versions_are_pinned_and_publishing_is_exclusive(spark, tmp_path):
    s = store.SegmentedStore(spark, str(tmp_path))
    s.upsert(page(spark, "a", 2, 1))
    old = s.load()
    s.upsert(page(spark, "a", 1, 2))
    assert old.count() == 2 and s.load().count() == 1
    with pytest.raises(Exception, match="exist"):
        s._commit(s.version() - 1, [], 9)


def test_incremental_equals_rebuild(spark, tmp_path):
    rng, s, want = random.Random(3), store.SegmentedStore(spark, str(tmp_path)), {}
    for step in range(8):
        name = f"s{rng.randrange(3)}"
        if rng.random() < 0.3:
            s.delete_sources([name])
            want.pop(name, None)
        else:
            n = rng.randrange(1, 3)
            s.upsert(page(spark, name, n, step))
            want[name] = [(name, k, float(step)) for k in range(n)]
    assert held(s) == sorted(x for rows in want.values() for x in rows)
    posts = s.postings()
    assert posts.select("source", "row").distinct().count() == len(held(s))
    s.compact()
    assert held(s) == sorted(x for rows in want.values() for x in rows)
    assert s.stats().first()["dead_chunks"] == 0 and s.stats().first()["segments"] == 1


def test_compaction_rules(spark, tmp_path):
    assert store.compaction_due(10, 10, 33) and not store.compaction_due(10, 10, 32)
    assert store.compaction_due(200, 136, 2) and not store.compaction_due(1000, 936, 2) and not store.compaction_due(100, 40, 2)
    s = store.SegmentedStore(spark, str(tmp_path))
    s.upsert(page(spark, "a", 200, 1))
    s.upsert(page(spark, "a", 100, 2))
    assert tuple(s.stats().first()) == (100, 1, 0, 1)  # dead weight was reclaimed
    gone = s.vacuum()
    assert gone and held(s)[0][2] == 2.0


def test_many_segments_are_merged_from_the_newest_back(spark, tmp_path, monkeypatch):
    """Old, large segments are left alone; corpus order and the index stay right through several merges."""
    monkeypatch.setattr(store, "SEGMENTS_MOST", 3)
    s = store.SegmentedStore(spark, str(tmp_path))
    s.upsert(page(spark, "old", 40, 1))
    first = s.manifest()["entries"][0]["name"]
    s.upsert(page(spark, "gone", 1, 1))
    s.delete_sources(["gone"])
    for k in range(7):
        s.upsert(page(spark, f"p{k}", 2, k))
    entries = s.manifest()["entries"]
    assert entries[0]["name"] == first and sum(not e["removes"] for e in entries) <= 4
    rows = s.load().orderBy("pos", "row").collect()
    assert [(r["source"], r["order"]) for r in rows] == [("old", k) for k in range(40)] + [(f"p{k}", j) for k in range(7) for j in range(2)]
    assert len({(r["pos"], r["row"]) for r in rows}) == len(rows)
    assert s.postings().select("source", "row").distinct().count() == len(rows)
    assert s.totals() == (54, sum(r["dl"] for r in rows)) and s.stats().first()["dead_chunks"] == 0
    s.compact()
    s.compact()
    again = s.load().orderBy("pos", "row").collect()
    assert [(r["source"], r["order"]) for r in again] == [(r["source"], r["order"]) for r in rows] and len({r["row"] for r in again}) == 54


def test_only_segments_with_dead_weight_are_rewritten(spark, tmp_path):
    s = store.SegmentedStore(spark, str(tmp_path))
    s.upsert(page(spark, "a", 300, 1))
    s.upsert(page(spark, "b", 150, 1).unionByName(page(spark, "c", 50, 1)))
    kept = s.manifest()["entries"][0]["name"]
    s.upsert(page(spark, "b", 100, 2))
    assert s.stats().first()["dead_chunks"] == 150  # a quarter of all
    s.delete_sources(["c", "nobody"])
    assert s.manifest()["entries"][0]["name"] == kept and tuple(s.stats().first()) == (400, 2, 0, 2)
    assert [r["source"] for r in s.load().groupBy("source", "pos").count().orderBy("pos").collect()] == ["a", "b"]


def test_segments_of_several_schemas(spark, tmp_path):
    s = store.SegmentedStore(spark, str(tmp_path))
    s.upsert(page(spark, "a", 2, 1))
    s.upsert(page(spark, "b", 2, 2).withColumn("title", F.lit("t")))
    assert {r["title"] for r in s.load().collect()} == {None, "t"}


def test_a_rewrite_store_is_adopted_where_it_lies(spark, tmp_path):
    old = store.make_store("rewrite", spark, str(tmp_path))
    old.upsert(page(spark, "a", 3, 1))
    old.upsert(page(spark, "b", 1, 2))
    new = store.make_store("segmented", spark, str(tmp_path))
    assert held(new) == held(old) and store.make_store("segmented", spark, str(tmp_path)).version() == 1


def test_damage_is_not_an_empty_store(spark, tmp_path):
    s = store.SegmentedStore(spark, str(tmp_path))
    s.upsert(page(spark, "a", 1, 1))
    name = f"manifest-{s.version():09d}.json"
    good = (tmp_path / name).read_text()
    for bad in ("{ nope", "[]", json.dumps({"format": 99, "next": 1, "entries": []})):
        (tmp_path / f".{name}.crc").unlink(missing_ok=True)
        (tmp_path / name).write_text(bad)
        with pytest.raises(store.StoreCorrupt):
            s.load()
    (tmp_path / name).write_text(good)
    assert s.load().count() == 1


def test_orphans_go_and_other_stores_are_adopted(spark, tmp_path):
    s = store.SegmentedStore(spark, str(tmp_path / "new"))
    old = store.RewriteStore(spark, str(tmp_path / "old"))
    old.upsert(page(spark, "a", 2, 1))
    assert s.adopt(old.load()) and not s.adopt(old.load())
    page(spark, "x", 1, 1).write.parquet(str(tmp_path / "new" / "seg-000099-dead" / "chunks"))
    assert "seg-000099-dead" in s.vacuum() and len(held(s)) == 2


# -- configuration ------------------------------------------------------------------------------


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"top_k": 7, "vector_weight": 0.5, "unknown": 1}))
    c = config.load(str(f), {"LANTERNFISH_TOP_K": "11", "LANTERNFISH_CHUNK_SIZE": "not-a-number", "LANTERNFISH_API_KEYS": " a, ,b "})
    assert (c.top_k, c.vector_weight, c.chunk_size, c.api_keys, c.extra) == (11, 0.5, 400, ("a", "b"), {"unknown": 1})
    for bad in ({"CHUNK_OVERLAP": "400"}, {"CHUNK_SIZE": "0"}, {"TOP_K": "0"}, {"CHUNK_STORE": "x"}, {"INGEST_RATE_WINDOW": "0"}):
        with pytest.raises(ValueError):
            config.load(None, {f"LANTERNFISH_{k}": v for k, v in bad.items()})
    assert config.load(None, {"LANTERNFISH_API_KEYS": ""}).api_keys == ()


# -- extraction and fetching -----------------------------------------------------------------------

ARTICLE = """<html><head><title>The Title</title><meta name="author" content="A. Uthor"></head><body>
<nav>menu <a href="/x">x</a></nav><article><h1>Head</h1><p>First <a href="https://e.org/l">linked</a> words.</p>
<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table><pre><code>line 1
  line 2</code></pre><ul><li>one<li>two</ul><img src="i.png"></article><footer>imprint</footer></body></html>"""


def test_extract():
    got = article.extract(ARTICLE, "u")
    text = got["content"]
    assert got["title"] == "The Title" and got["metadata"] == {"url": "u", "author": "A. Uthor", "date": None, "sitename": None}
    for part in ("# Head", "[linked](https://e.org/l)", "| k | v |", "| a | 1 |", "```", "line 1\n  line 2", "- one", "- two"):
        assert part in text, part
    for part in ("menu", "imprint", "i.png"):
        assert part not in text
    assert article.extract("<html><body></body></html>", "u")["error"] and article.extract(None, "u")["title"] == "u"
    assert article.extract("<p>x", None)["title"] == "untitled"


def test_entities_end_with_a_semicolon():
    got = article.extract("<title>a &amp; b&amp</title><article><p>x&ampy &notit; &copy; &#65;&am<p>&middot;&amp</article>", "u")
    assert got["title"] == "a & b&amp"
    assert got["content"] == "x&ampy &notit; © A&am\n\n·&amp"


class Reply:
    def __init__(self, body):
        self.body = body

    def read(self, n):
        return self.body[:n]


def send(pages):
    def get(url):
        status, headers, body = pages[url]
        return status, headers, Reply(body)

    return get


def public(_):
    return ["8.8.8.8"]


def chain(n):
    pages = {f"http://a/{k}": (302, {"location": f"/{k + 1}"}, b"") for k in range(n)}
    return pages | {f"http://a/{n}": (200, {"content-type": "text/html; charset=latin-1"}, b"caf\xe9")}


def test_fetch():
    assert web.fetch("http://a/0", send=send(chain(4)), lookup=public) == "café"
    with pytest.raises(web.FetchError, match="redirects"):
        web.fetch("http://a/0", send=send(chain(5)), lookup=public)
    with pytest.raises(web.BlockedAddress):
        web.fetch("http://a/0", send=send({}), lookup=lambda _: ["8.8.8.8", "10.0.0.1"])
    hop = {"http://a/": (301, {"location": "http://inner/"}, b"")}
    with pytest.raises(web.BlockedAddress):
        web.fetch("http://a/", send=send(hop), lookup=lambda h: ["127.0.0.1"] if h == "inner" else ["8.8.8.8"])
    for url in ("file:///etc/passwd", "ftp://x/", "http:///x"):
        with pytest.raises(web.FetchError):
            web.check_url(url, public)
    one = lambda status, headers, body: send({"http://a/": (status, headers, body)})
    for reply in ((404, {}, b""), (200, {"content-type": "application/pdf"}, b""), (302, {}, b"")):
        with pytest.raises(web.FetchError):
            web.fetch("http://a/", send=one(*reply), lookup=public)
    for reply in ((200, {}, b"x" * 60), (200, {"content-length": "60"}, b"")):
        with pytest.raises(web.TooLarge):
            web.fetch("http://a/", 50, one(*reply), public)
    assert web.fetch("http://a/", send=one(200, {}, b"a\xffb"), lookup=public) == "a�b"
    assert urllib.parse.urljoin("http://a/b", "/c") == "http://a/c"


def test_web_source_reports_errors_per_url(spark):
    spark.dataSource.register(web.WebPages)
    rows = spark.read.format("web_pages").option("urls", "file:///x\nhttp://127.0.0.1/y").load().collect()
    assert {r["url"] for r in rows} == {"file:///x", "http://127.0.0.1/y"} and all(r["html"] is None and r["fetch_error"] for r in rows)


def test_redirect_chains_over_a_table(spark):
    rows = [(f"c{k}", f"c{k + 1}") for k in range(7)] + [("c7", None), ("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r["url"]: (r["final"], r["hops"], r["error"]) for r in redirects.follow(spark.createDataFrame(rows, "url string, location string")).collect()}
    assert got["c3"] == ("c7", 4, None) and got["c2"] == (None, 4, "too many redirects") and got["c7"] == ("c7", 0, None)
    assert got["x"][2] == "too many redirects" and got["z"] == (None, 1, "unknown url")


def test_markdown_and_json(spark, tmp_path):
    (tmp_path / "b.md").write_text("# b é", encoding="utf-8")
    (tmp_path / "a.md").write_text("a")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("no")
    got = markdown.read(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r["source"], r["content"], r["type"]) for r in got] == [("a.md", "a", "documentation"), ("b.md", "# b é", "documentation")]
    target = str(tmp_path / "j")
    jsonstore.write(markdown.read(spark, str(tmp_path)), target)
    assert jsonstore.read(spark, target).count() == 2
    (tmp_path / "j" / "part-bad.json").write_text("{ nope\n")
    assert jsonstore.read(spark, target, recoverable=True).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonstore.read(spark, target).collect()


# -- ingest and engine -------------------------------------------------------------------------------


def items(spark):
    rows = [(0, "http://a/", ARTICLE, None), (1, "http://b/", "<html></html>", None), (2, "http://c/", None, "blocked"), (3, "http://a/", "<article><p>newer words</p></article>", None)]
    return spark.createDataFrame(rows, "item int, source string, html string, fetch_error string")


def test_batch(spark):
    replies, chunks = ingest.batch(items(spark))
    got = {r["item"]: (r["status"], r["chunks_indexed"]) for r in replies.collect()}
    assert got == {0: ("ok", 1), 1: ("extract_error", 0), 2: ("fetch_error", 0), 3: ("ok", 1)}
    assert [(r["source"], r["content"]) for r in chunks.collect()] == [("http://a/", "newer words")]


def test_route(spark):
    df = spark.createDataFrame([("u", "h", "s"), ("", "h", "s"), (None, "h", "s")], "url string, html string, source_url string")
    assert [(r["source"], r["origin"]) for r in ingest.route(df).collect()] == [("u", "url"), ("s", "html"), ("s", "html")]
    assert [r["request_error"] is None for r in ingest.validated(df.withColumn("source_url", F.lit(None).cast("string"))).collect()] == [True, False, False]


@pytest.fixture
def engine(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "billing.md").write_text("error 402 insufficient credits billing account balance")
    (docs / "auth.md").write_text("token authentication failed refresh the api key")
    return Engine(spark, config.load(None, {"LANTERNFISH_DOCS_PATH": str(docs), "LANTERNFISH_INDEX_DIR": str(tmp_path / "index"), "LANTERNFISH_INGEST_RATE_LIMIT": "6"}))


def test_engine(spark, engine):
    best = engine.search("billing credits", 1).first()["evidence"]
    assert best["source"] == "billing.md" and best["confidence"] > 0.5
    replies = engine.ingest_batch(items(spark), now=0.0)
    assert replies.count() == 4
    out = engine.search_many(["newer words", "api key"], 2).collect()
    assert [(r["qid"], r["rank"]) for r in out] == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert out[0]["evidence"]["source"] == "http://a/" and out[2]["evidence"]["source"] == "auth.md"
    assert engine.health()["corpus_size"] == 3 and engine.totals()[0] == 3
    with pytest.raises(RateLimited):
        engine.ingest_batch(items(spark), now=1.0)
    with pytest.raises(ValueError, match="top_k"):
        engine.search("x", 0)
    assert engine.search_many([], 3).count() == 0
    again = Engine(spark, engine.settings)
    assert again.docs().count() == 2 and again.search("newer words", 1).first()["evidence"]["source"] == "http://a/"


def test_a_call_reads_one_version(spark, engine, monkeypatch):
    """A write between the reads of a search is not seen by any of them."""
    engine.ingest_batch(items(spark), now=0.0)
    seen, load, postings, totals = [], engine.store.load, engine.store.postings, engine.store.totals
    want = engine.search_many(["newer words", "billing"], 3).collect()

    def between(read):
        def run(version=None):
            seen.append(version)
            out = read(version)
            engine.add_chunks(page(spark, f"http://new/{len(seen)}", 1, 7).withColumn("content", F.lit("newer words billing")).drop("embedding"))
            return out

        return run

    for name, read in (("load", load), ("postings", postings), ("totals", totals)):
        monkeypatch.setattr(engine.store, name, between(read))
    assert engine.search_many(["newer words", "billing"], 3).collect() == want
    assert len(seen) >= 3 and len(set(seen)) == 1 and None not in seen


def test_single_ingest_and_agent(spark, engine):
    pages = {"http://ok/": ARTICLE, "http://empty/": "<html></html>"}

    def fetch(url):
        if url not in pages:
            raise web.BlockedAddress(f"{url} has a non-public address")
        return pages[url]

    engine.fetch = fetch
    done = engine.ingest("http://ok/", now=0.0)
    assert (done["source"], done["title"], done["chunks_indexed"]) == ("http://ok/", "The Title", 1)
    assert engine.ingest(html="<p>given words", source_url="s://x", now=9.0)["chunks"][0]["content"] == "given words"
    with pytest.raises(BadRequest):
        engine.ingest(html="<p>no source")
    with pytest.raises(web.BlockedAddress):
        engine.ingest("http://inner/", now=30.0)
    with pytest.raises(NoContent):
        engine.ingest("http://empty/", now=60.0)
    agent = Agent(engine)
    got = [agent.ingest(u)["status"] for u in ("http://ok/", "http://inner/", "http://empty/", "")]
    assert got == ["ok", "fetch_error", "extract_error", "error"]
    found = agent.search("given words")
    assert found[0]["source"] == "s://x" and set(found[0]) == {"content", "source", "confidence"} and len(found) == 4
    batch = spark.createDataFrame([(0, "http://ok/", None, None), (1, None, "<p>more", "s://y"), (2, "http://inner/", None, None), (3, None, None, None)], "item int, url string, html string, source_url string")
    engine.limiter = limiter.Bucket(0, 60)
    assert [r["status"] for r in agent.ingest_many(batch)] == ["ok", "ok", "fetch_error", "fetch_error"]
    engine.store.upsert = lambda chunks: 1 / 0
    assert [r["status"] for r in agent.ingest_many(batch)] == ["error", "error", "fetch_error", "fetch_error"]
    assert agent.ingest("http://ok/")["status"] == "error"


def test_chunk_settings_hold_for_every_way_in(spark, tmp_path):
    e = Engine(spark, config.load(None, {"LANTERNFISH_DOCS_PATH": str(tmp_path / "none"), "LANTERNFISH_INDEX_DIR": str(tmp_path / "i"), "LANTERNFISH_CHUNK_SIZE": "2", "LANTERNFISH_CHUNK_OVERLAP": "0"}))
    rows = spark.createDataFrame([(0, "s", "<p>a b c d e</p>", None)], "item int, source string, html string, fetch_error string")
    assert e.ingest_batch(rows).first()["chunks_indexed"] == 3 and e.store.totals()[0] == 3


def test_engine_without_documents(spark, tmp_path):
    e = Engine(spark, config.load(None, {"LANTERNFISH_DOCS_PATH": str(tmp_path / "none"), "LANTERNFISH_INDEX_DIR": str(tmp_path / "i"), "LANTERNFISH_API_KEYS": "k1,k2"}))
    assert e.search("anything").count() == 0
    assert e.caller(" k1 ").startswith("key:") and len(e.caller("k1")) == 16
    with pytest.raises(PermissionError):
        e.caller("k3")


# -- limiter ----------------------------------------------------------------------------------------------


def test_bucket():
    b = limiter.Bucket(3, 60)
    assert [b.check("x", 0.0) for _ in range(3)] == [None] * 3
    assert b.check("x", 0.0) == 20.0 and b.check("y", 0.0) is None
    assert b.check("x", 10.0) == 10.0  # the rejection spent nothing
    assert b.check("x", 20.0) is None
    assert b.check("z", 0.0, 99) is None and b.check("z", 30.0, 99) == 30.0  # cost is cut at the bucket
    assert all(limiter.Bucket(0, 60).check("x", 0.0) is None for _ in range(9))


def test_batch_limiter_equals_bucket(spark):
    rng, b = random.Random(5), limiter.Bucket(3, 60)
    rows = sorted({(rng.choice("abc"), float(rng.randrange(400)), rng.randrange(1, 5)) for _ in range(150)}, key=lambda r: (r[1], r[2]))
    want = {(i, t, c): b.check(i, t, c) for i, t, c in rows}
    df = spark.createDataFrame(rows, "identity string, ts double, cost int").repartition(5)
    out = limiter.admit(df, 3, 60, tie="cost", cost="cost").collect()
    assert {(r["identity"], r["ts"], r["cost"]): r["retry_after"] for r in out} == want
    assert all(r["admitted"] == (r["retry_after"] is None) for r in out)
    assert limiter.admit(df, 0, 60).filter("admitted").count() == len(rows)


def test_stream_limiter(spark, tmp_path):
    rows = [("a", float(t), 1.0) for t in (0, 1, 2, 3, 40)] + [("b", 5.0, 9.0)]
    spark.createDataFrame(rows, "identity string, ts double, cost double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("identity string, ts double, cost double").parquet(str(tmp_path / "in"))
    q = stream_limiter.admit_stream(stream, 3, 60).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 120
    while spark.table("admitted").count() < len(rows) and time.time() < until and q.isActive:  # a time to live keeps the query busy
        time.sleep(0.3)
    q.stop()
    b = limiter.Bucket(3, 60)
    want = {(i, t): b.check(i, t, c) for i, t, c in rows}
    assert {(r["identity"], r["ts"]): r["retry_after"] for r in spark.table("admitted").collect()} == want


def test_stream_ingest(spark, tmp_path):
    pages = [(1, "http://a/", ARTICLE), (2, "http://a/", "<article><p>later</p></article>"), (3, "http://b/", "<p>b</p>"), (4, "http://c/", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    s = store.SegmentedStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # run again: nothing new
        stream_ingest.start(stream_ingest.read_pages(spark, str(tmp_path / "in")), s, str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r["source"], r["content"]) for r in s.load().collect()) == [("http://a/", "later"), ("http://b/", "b")]


def test_layers(spark):
    docs = spark.createDataFrame([("a", "x")], "source string, content string")
    got = chunking.layers(docs, docs.withColumn("title", F.lit("t"))).orderBy("layer").collect()
    assert [(r["layer"], r["title"]) for r in got] == [(0, None), (1, "t")]


def test_postings_of_a_segment_are_sorted_by_term_in_each_file(spark, tmp_path):
    s = store.SegmentedStore(spark, f"{tmp_path}/s")
    s.upsert(spark.createDataFrame([(str(k), f"s{k % 3}", f"w{k % 7} a{k} z", "web", 0) for k in range(40)], "id string, source string, content string, type string, order int").repartition(2))
    files = list((tmp_path / "s").glob("seg-*/postings/*.parquet"))
    assert files and len(files) <= len(list((tmp_path / "s").glob("seg-*/chunks/*.parquet")))
    for f in files:
        terms = [r["term"] for r in spark.read.parquet(str(f)).select("term").coalesce(1).collect()]
        assert terms == sorted(terms)
