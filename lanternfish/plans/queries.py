"""One query per operator over the driver's tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import guards, scoring, text
from lanternfish.operators import bm25, chunking, embed, hybrid, ingest, limiter, redirects, store, vector
from lanternfish.sources import tables

SIZE, OVERLAP = 400, 50
KEYS = ["doc_id", "ord"]
#: The batch of queries, each with the row of embeddings that stands for its vector.
BATCH = ((1, "released under the MIT license", 7), (2, "thention der la the", 11), (3, "token api key error", 23), (4, "THE the The", 42), (5, "osmente schlich queeux", 64))
SINGLE = BATCH[1]
TOP = 50
CONTENT_TYPES = ("text/html", "text/html; charset=utf-8", "application/xhtml+xml", "application/pdf", "image/png", "", None, " TEXT/HTML ;q=1", "application/json")
ADDRESSES = ("127.0.0.1", "::1", "169.254.169.254", "10.0.0.5", "192.168.1.1", "::ffff:169.254.169.254", "8.8.8.8", "2001:4860:4860::8888", "224.0.0.1", "0.0.0.0", "nonsense")
BUCKET_LIMIT, BUCKET_WINDOW = 2, 86400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return tables.read(spark, f"{sf}/documents.parquet", "doc_id", "source", "text").withColumnRenamed("text", "content")


def chunks(spark, sf) -> DataFrame:
    """doc_id, source, ord, content."""
    return chunking.chunk(documents(spark, sf), SIZE, OVERLAP).withColumnRenamed("order", "ord")


def turns(spark, sf) -> DataFrame:
    """Conversations as a second layer: one document per turn."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("source"), F.col("text").alias("content"))
    return chunking.chunk(rows, SIZE, OVERLAP).withColumnRenamed("order", "ord")


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", "html")


def read_pages(spark, sf) -> DataFrame:
    """Documents that the reader makes of pages, cut into chunks."""
    return chunking.chunk(ingest.documents(pages(spark, sf)), SIZE, OVERLAP)


def items(spark, sf, source) -> DataFrame:
    """pages as items of an ingest batch; those without https could not be fetched, by our convention."""
    refused = guards.url_error(F.regexp_replace("url", "^http:", "ftp:"))
    return pages(spark, sf).select(F.col("page_id").alias("item"), source.alias("source"), "html", refused.alias("fetch_error"))


def queries_df(spark, which=BATCH) -> DataFrame:
    return spark.createDataFrame([(q, t, v) for q, t, v in which], "qid long, query string, vec_id long")


def with_vectors(spark, sf, which=BATCH) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    return queries_df(spark, which).join(vectors, "vec_id").select("qid", "query", "query_vec")


def document_vectors(spark, sf) -> DataFrame:
    """doc_id, embedding of the documents that have a vector."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def r9(c):
    return F.round(c, 9)


# -- chunks and terms ---------------------------------------------------------------


def chunk_windows(spark, sf):
    return chunks(spark, sf).select("doc_id", "source", "ord", "content", F.size(text.words(F.col("content"))).alias("n_words"))


def chunk_counts_by_source(spark, sf):
    return chunks(spark, sf).groupBy("source").agg(F.count("*").alias("n_chunks"))


def chunk_tail_contained(spark, sf):
    return chunk_windows(spark, sf).filter((F.col("ord") > 0) & (F.col("n_words") <= OVERLAP)).select("doc_id", "ord", "n_words")


def corpus_two_layers(spark, sf):
    both = chunking.layers(chunks(spark, sf), turns(spark, sf))
    return both.select("layer", "source", "doc_id", "conv_id", "turn", "ord", F.sha2("content", 256).alias("content_sha"))


def corpus_size(spark, sf):
    return chunking.layers(chunks(spark, sf), turns(spark, sf)).agg(F.count("*").alias("corpus_size"), F.count_distinct("source").alias("sources"))


def term_counts(spark, sf):
    return bm25.term_counts(documents(spark, sf), ["doc_id"])


def doc_lengths(spark, sf):
    return bm25.lengths(chunks(spark, sf), KEYS)


def document_frequency(spark, sf):
    return bm25.chunk_frequency(chunks(spark, sf))


def corpus_stats(spark, sf):
    return bm25.stats(bm25.lengths(chunks(spark, sf), KEYS)).withColumn("avgdl", r9("avgdl"))


def idf_table(spark, sf):
    c = chunks(spark, sf)
    return bm25.idf_table(bm25.chunk_frequency(c), bm25.stats(bm25.lengths(c, KEYS))).withColumn("idf", r9("idf"))


def query_terms(spark, sf):
    return bm25.query_terms(queries_df(spark))


# -- keyword search -----------------------------------------------------------------


def _keyword(c: DataFrame, queries: DataFrame) -> DataFrame:
    return bm25.score_chunks(c, KEYS, queries)[0]


def bm25_single(spark, sf):
    return _keyword(chunks(spark, sf), queries_df(spark, [SINGLE])).select(*KEYS, r9("score").alias("score"))


def bm25_batch(spark, sf):
    return _keyword(chunks(spark, sf), queries_df(spark)).select("qid", *KEYS, r9("score").alias("score"))


def bm25_minmax(spark, sf):
    c, q = chunks(spark, sf), queries_df(spark)
    scores, stats = bm25.score_chunks(c, KEYS, q)
    ends = bm25.spread(scores, stats, q)
    every = c.select(*KEYS).crossJoin(F.broadcast(q.select("qid"))).join(scores, ["qid", *KEYS], "left").join(F.broadcast(ends), "qid")
    return every.select("qid", *KEYS, r9(scoring.min_max(F.coalesce("score", F.lit(0.0)), F.col("low"), F.col("high"))).alias("keyword_score"))


def bm25_after_removal(spark, sf):
    """Scores after source src7 is deleted: statistics move with the corpus."""
    return _keyword(chunks(spark, sf).filter("source <> 'src7'"), queries_df(spark)).select("qid", *KEYS, r9("score").alias("score"))


def bm25_incremental(spark, sf):
    """Statistics after conversations came and src7 went, from the parts' statistics alone."""
    c = chunks(spark, sf)
    part = lambda rows, keys: bm25.stats(bm25.lengths(rows, keys))
    out = bm25.merge_stats(part(c, KEYS), part(turns(spark, sf), ["conv_id"]), part(c.filter("source = 'src7'"), KEYS))
    return out.withColumn("avgdl", r9("avgdl"))


# -- vectors ---------------------------------------------------------------------------


def _query_list(spark, sf, which):
    return [(r["qid"], list(r["query_vec"])) for r in with_vectors(spark, sf, which).collect()]  # a request: at most ten


def cosine_topk(spark, sf):
    best = vector.top_cosine(table(spark, sf, "embeddings"), _query_list(spark, sf, [SINGLE]), "vec_id", 5)
    return best.select("rank", "vec_id", F.round("vector_score", 6).alias("vector_score"))


def cosine_batch_topk(spark, sf):
    best = vector.top_cosine(table(spark, sf, "embeddings"), _query_list(spark, sf, BATCH), "vec_id", 10)
    return best.select("qid", "rank", "vec_id", F.round("vector_score", 6).alias("vector_score"))


def cosine_every_100th_topk(spark, sf):
    """The ten nearest of every row whose id is divisible by 100, among all rows."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vec"))
    best = vector.top_cosine_each(vectors, asked, "vec_id", 10)
    return best.select("qid", "rank", "vec_id", F.round("vector_score", 6).alias("vector_score"))


def cosine_zero_vector(spark, sf):
    zero = spark.createDataFrame([(1, [0.0] * 64)], "qid long, query_vec array<float>")
    return vector.cosine(table(spark, sf, "embeddings"), zero, ["vec_id"]).select("vec_id", "vector_score")


# -- hybrid search ---------------------------------------------------------------------


def _ranked(spark, sf, which=BATCH, k=TOP):
    return hybrid.search(chunks(spark, sf), with_vectors(spark, sf, which), KEYS, k, vectors=document_vectors(spark, sf))


def _scores(rows):
    return rows.withColumns({c: F.round(c, 3) for c in ("confidence", "vector_score", "keyword_score")})


def hybrid_search(spark, sf):
    return _scores(_ranked(spark, sf, [SINGLE])).select("rank", *KEYS, "confidence", "vector_score", "keyword_score")


def hybrid_batch(spark, sf):
    return _scores(_ranked(spark, sf)).select("qid", "rank", *KEYS, "confidence", "vector_score", "keyword_score")


def _evidence(spark, sf, k):
    wide = hybrid.materialise(_ranked(spark, sf, BATCH, k), chunks(spark, sf), KEYS)
    item = hybrid.evidence(F.col("content"), F.col("source"), F.lit(None).cast("string"), F.col("confidence"), F.col("vector_score"), F.col("keyword_score"), F.col("doc_id").cast("string"))
    return wide.join(queries_df(spark).select("qid", "query"), "qid").select("qid", "query", "rank", item.alias("evidence"))


def evidence(spark, sf):
    e = F.col("evidence")
    return _evidence(spark, sf, 10).select("qid", "rank", e["content"].alias("content"), e["source"].alias("source"), e["type"].alias("type"), e["confidence"].alias("confidence"), e["metadata"]["vector_score"].alias("vector_score"), e["metadata"]["keyword_score"].alias("keyword_score"), e["metadata"]["id"].alias("id"))


def evidence_json(spark, sf):
    return hybrid.envelope(_evidence(spark, sf, 3))


def passages(spark, sf):
    wide = hybrid.materialise(_ranked(spark, sf, BATCH, 5), chunks(spark, sf), KEYS)
    return ingest.passages(wide)


def evidence_defaults(spark, sf):
    d = documents(spark, sf).withColumns({"s": F.nullif(F.col("source"), F.lit("src3")), "t": F.when(F.col("source") == "src4", F.lit("web"))})
    item = hybrid.evidence(F.sha2("content", 256), F.col("s"), F.col("t"), F.lit(0.12345), F.lit(0.5), F.lit(0.0), F.col("doc_id").cast("string"))
    return d.select("doc_id", item.alias("e")).select("doc_id", F.col("e.content").alias("content_sha"), "e.source", "e.type", "e.confidence", F.col("e.metadata.id").alias("id"))


# -- pages and ingest --------------------------------------------------------------------


def page_title(spark, sf):
    return ingest.extract(pages(spark, sf)).select("page_id", "title")


def page_article_text(spark, sf):
    """The documents that ingest makes of pages."""
    return ingest.documents(pages(spark, sf)).select("id", "source", "content", "type", "title", "url")


def page_metadata(spark, sf):
    m = F.col("page_metadata")
    return ingest.extract(pages(spark, sf)).select("page_id", m["url"].alias("url"), m["author"].alias("author"), m["date"].alias("date"), m["sitename"].alias("sitename"))


def page_markdown(spark, sf):
    return ingest.extract(pages(spark, sf)).select("page_id", "title", "content", "extract_error")


def ingest_pages_chunks(spark, sf):
    return read_pages(spark, sf).select("id", "source", "title", F.col("order").alias("ord"), "content")


def ingest_status(spark, sf):
    """Replies of a batch: a refused url is a fetch error; a page without content an extract error."""
    replies, _ = ingest.batch(items(spark, sf, F.col("url")))
    return replies.select("item", "source", "status", F.col("error").isNotNull().alias("failed"), "title", "chunks_indexed")


def ingest_batch_dedup(spark, sf):
    """What a batch stores where all pages of a host are one source: the last one's content at the first one's place."""
    _, cut = ingest.batch(items(spark, sf, guards.host_of(F.col("url"))))
    return cut.select("source", "item", F.col("order").alias("ord"), F.sha2("content", 256).alias("content_sha"), "title", "type")


def page_payload(spark, sf):
    """The chunks of each stored page as an ingest reply carries them."""
    _, cut = ingest.batch(items(spark, sf, F.col("url")))
    payload = chunking.page_payload(cut)
    return payload.select("source", F.to_json(F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), F.length(c["content"]).alias("chars"), c["order"].alias("order")))).alias("chunks"))


def ingest_summary(spark, sf):
    replies, _ = ingest.batch(items(spark, sf, F.col("url")))
    return replies.select("item", "chunks_indexed", "words", "preview")


# -- the store ---------------------------------------------------------------------------------


def _stored(spark, sf, *steps) -> store.SegmentedStore:
    """A store of its own in the shared folder, after the chunks of documents and some steps."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    out = store.SegmentedStore(spark, f"{folder.rstrip('/')}/lanternfish-{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}")
    atexit.register(out.files.remove, "")
    out.upsert(_rows(chunks(spark, sf), "doc_id"))
    for step in steps:
        step(out)
    return out


def _rows(cut: DataFrame, *ids: str) -> DataFrame:
    return cut.select(F.concat_ws("-", *ids).alias("id"), "source", "content", F.col("ord").alias("order"))


def _replace(spark, sf):
    """A step: conversations come as new content of src1 and src2."""
    new = turns(spark, sf).withColumn("source", F.when(F.col("turn") % 2 == 0, F.lit("src1")).otherwise(F.lit("src2")))
    return lambda s: s.upsert(_rows(new, "conv_id", "turn"))


def source_upsert_latest(spark, sf):
    """Conversations replace what the store has of src1 and src2, then stand at the end."""
    rows = _stored(spark, sf, _replace(spark, sf)).load()
    return rows.select((F.col("pos") > 0).cast("int").alias("later"), "source", "id", F.col("order").alias("ord"), F.length("content").alias("chars"))


def delete_sources(spark, sf):
    """The store's chunks by source after src1 and a source that isn't there were deleted, and src2 came anew."""
    s = _stored(spark, sf, lambda s: s.delete_sources(["src1", "nobody"]), _replace(spark, sf), lambda s: s.delete_sources(["src1"]))
    return s.load().groupBy("source").agg(F.count("*").alias("n_chunks"))


def store_stats(spark, sf):
    return _stored(spark, sf, _replace(spark, sf), lambda s: s.delete_sources(["src7"])).stats()


def store_totals(spark, sf):
    """Statistics of the keyword index as the store keeps them."""
    s = _stored(spark, sf, _replace(spark, sf), lambda s: s.delete_sources(["src7"]))
    n, total = s.totals()
    return spark.createDataFrame([(n, total)], "n long, total_length long")


def store_postings(spark, sf):
    """Document frequencies of the stored index after replacements and a deletion."""
    s = _stored(spark, sf, _replace(spark, sf), lambda s: s.delete_sources(["src7"]))
    return bm25.document_frequency(s.postings())


def compaction_due(spark, sf):
    """Everything but src7 is written again: the dead weight is reclaimed."""
    again = _rows(chunks(spark, sf).filter("source <> 'src7'"), "doc_id")
    s = _stored(spark, sf, lambda s: s.upsert(again))
    by_source = s.load().groupBy("source").agg(F.count("*").alias("n_chunks"))
    return by_source.crossJoin(F.broadcast(s.stats().select("dead_chunks", "sources")))


def orphan_segments(spark, sf):
    """What the store's cleaning removes: a segment that no manifest names, and older manifests."""
    s = _stored(spark, sf, _replace(spark, sf))
    spark.range(1).write.parquet(f"{s.folder}/seg-999999-stray/chunks")
    return spark.createDataFrame([(n,) for n in s.vacuum()], "segment string")


# -- the store's log -----------------------------------------------------------------------


def _log(spark, sf):
    """events as a store's log: each a write of 1..5 chunks of its user's source, an error its removal."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("source"), (F.col("event_id") % 5 + 1).alias("n"), (F.col("event_type") == "error").alias("removed"))


def manifest_replay(spark, sf):
    return store.replay(_log(spark, sf))


def corpus_hash(spark, sf):
    """The exact digest of a small layer: nations as documents."""
    docs = table(spark, sf, "nation").select(F.col("n_name").alias("source"), F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")).alias("content"))
    return chunking.corpus_hash(chunking.chunk(docs, SIZE, OVERLAP), ["source", "order"])


def corpus_marks(spark, sf):
    return chunking.corpus_marks(chunks(spark, sf), KEYS)


# -- guards, service -------------------------------------------------------------------------


def request_bounds(spark, sf):
    t = table(spark, sf, "conversations")
    return t.select("conv_id", "turn", guards.query_ok(F.col("text"), 200).alias("query_ok"), guards.top_k_ok((F.col("turn") * 20).cast("int")).alias("top_k_ok"), guards.ingest_ok(F.lit(None).cast("string"), F.col("text"), F.when(F.col("role") == "user", F.lit("s://x"))).alias("ingest_ok"))


def url_guard(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?:", "ftp:")).when(F.col("page_id") % 3 == 1, F.upper("url")).otherwise(F.col("url"))
    p = table(spark, sf, "pages").select("page_id", u.alias("u"))
    return p.select("page_id", guards.host_of(F.col("u")).alias("host"), guards.url_error(F.col("u")).isNull().alias("allowed"))


def content_type_guard(spark, sf):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CONTENT_TYPES)], "i int, content_type string")
    return rows.select("i", guards.html_type_ok(F.col("content_type")).alias("passes"))


def ip_guard(spark, sf):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    return rows.select("ip", guards.blocked_ip(F.col("ip")).alias("blocked"))


def redirect_chains(spark, sf):
    """parts as urls: each redirects to a third of its number, the first three answer."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("url"), F.when(F.col("p_partkey") > 3, F.expr("cast(p_partkey div 3 as string)")).alias("location"))
    return redirects.follow(p)


def key_fingerprint(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.fingerprint(F.col("c_name")).alias("fingerprint"))


def token_bucket(spark, sf):
    """events as requests: two a day for each user."""
    e = table(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    out = limiter.admit(e, BUCKET_LIMIT, BUCKET_WINDOW, "user_id", "t", "event_id")
    return out.select("event_id", "user_id", "admitted")


def embed_hashing(spark, sf):
    out = embed.encode(documents(spark, sf), embed.Hashing(64))
    return out.select("doc_id", F.size("embedding").alias("dimension"), F.round(scoring.norm(F.col("embedding")), 5).alias("norm"))


def embed_sparse(spark, sf):
    return embed.hashed_terms(documents(spark, sf), ["doc_id"], "content", 64)


ALL = (
    chunk_windows, chunk_counts_by_source, chunk_tail_contained, corpus_two_layers, corpus_size, term_counts, doc_lengths, document_frequency, corpus_stats, idf_table, query_terms,
    bm25_single, bm25_batch, bm25_minmax, bm25_after_removal, bm25_incremental, cosine_topk, cosine_batch_topk, cosine_every_100th_topk, cosine_zero_vector, hybrid_search, hybrid_batch, evidence, evidence_json,
    passages, evidence_defaults, page_title, page_article_text, page_metadata, page_markdown, ingest_pages_chunks, ingest_status, ingest_batch_dedup, page_payload, ingest_summary,
    source_upsert_latest, manifest_replay, store_stats, store_totals, store_postings, compaction_due, delete_sources, orphan_segments, corpus_hash, corpus_marks, request_bounds, url_guard, content_type_guard, ip_guard, redirect_chains,
    key_fingerprint, token_bucket, embed_hashing, embed_sparse,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}
