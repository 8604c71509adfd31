"""The facade: search, ingest, health and maintenance over one store and one settings object."""

from __future__ import annotations

import hashlib
import hmac
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish import config as configuration
from lanternfish.functions import guards, text
from lanternfish.operators import bm25, chunking, embed, hybrid, ingest, limiter, store
from lanternfish.schema import EVIDENCE_VERSION
from lanternfish.sources import markdown, tables, web

log = logging.getLogger(__name__)
KEYS = ["layer", "pos", "row"]


class RateLimited(Exception):
    def __init__(self, wait: float):
        super().__init__(f"retry after {wait} s")
        self.retry_after = wait


class BadRequest(ValueError):
    """A request is out of its bounds."""


class NoContent(Exception):
    """A page has nothing to store."""


class Engine:
    """Two layers, markdown documents (rebuildable) and ingested pages (durable), searched as one corpus.

    Every call reads one version of the store, looked up once and handed on, so that chunks, postings and statistics
    belong to one state, whatever is written meanwhile.
    """

    #: How a url becomes a page; guarded against private addresses, redirects and size.
    fetch = staticmethod(web.fetch)

    def __init__(self, spark: SparkSession, settings: configuration.Settings | None = None, backend: embed.Backend | None = None):
        self.spark, self.settings = spark, settings or configuration.load()
        self.backend = backend or (embed.Hashing() if self.settings.vector_model == "hashing" else embed.Model(self.settings.vector_model, 384))
        self.store = store.make_store(self.settings.chunk_store, spark, f"{self.settings.index_dir}/ingested")
        self.limiter = limiter.Bucket(self.settings.ingest_rate_limit, self.settings.ingest_rate_window)
        self._docs: DataFrame | None = None
        self._docs_totals: tuple[int, int] | None = None

    # -- corpus ----------------------------------------------------------------

    def docs(self) -> DataFrame:
        """Chunks of the markdown layer with vectors, kept under the hash of their content and the backend that embedded them."""
        if self._docs is None:
            try:
                found = markdown.read(self.spark, self.settings.docs_path)
                empty = found.isEmpty()
            except Exception:  # no such folder
                found, empty = None, True
            if empty:
                log.warning("no markdown under %s: only ingested pages are searchable", self.settings.docs_path)
                self._docs = self._shape(self.spark.createDataFrame([], "source string, content string, type string"))
            else:
                self._docs = self._cached(self._shape(found))
        return self._docs

    def _shape(self, docs: DataFrame) -> DataFrame:
        cut = chunking.chunk(chunking.with_ids(docs), self.settings.chunk_size, self.settings.chunk_overlap)
        return cut.withColumns({"pos": F.lit(0), "row": F.xxhash64("source") * 0 + F.col("order")})

    def _cached(self, chunks: DataFrame) -> DataFrame:
        mark = chunking.corpus_hash(chunks, ["source", "order"]).first()[0]
        model = hashlib.sha256(f"{type(self.backend).__name__} {getattr(self.backend, 'name', '')} {self.backend.dimension}".encode()).hexdigest()[:12]
        path = f"{self.settings.index_dir}/docs-{mark}-{model}"
        rows = chunks.count()
        try:
            kept = self.spark.read.parquet(path)
            if kept.count() == rows:
                return kept
            log.warning("the cache of %s has another number of rows; embedding again", path)
        except Exception:  # absent or damaged: rebuildable
            pass
        embed.encode(chunks, self.backend).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def corpus(self, version: int | None = None) -> DataFrame:
        """All searchable chunks with layer, pos and row: corpus order."""
        return chunking.layers(self._docs_placed(), self.store.load(version))

    def _docs_placed(self) -> DataFrame:
        docs = self.docs()
        if "embedding" not in docs.columns:
            docs = embed.encode(docs, self.backend)
        # Files in name order, then windows: one number per chunk of a small layer.
        return docs.withColumn("row", F.dense_rank().over(_by_name()).cast("long") * (1 << 20) + F.col("order"))

    # -- search ------------------------------------------------------------------

    def search_many(self, queries: list[str], top_k: int | None = None) -> DataFrame:
        """qid, query, rank, evidence, by qid and rank."""
        s = self.settings
        k = hybrid.resolve_top_k(top_k, s.top_k, s.max_top_k)
        if len(queries) > s.max_batch_queries or any(len(q) > s.max_query_chars for q in queries):
            raise ValueError("too many or too long queries")
        vectors = self.backend.encode(list(queries)).tolist() if queries else []
        rows = tables.local(self.spark, [range(len(queries)), queries, vectors], "qid long, query string, query_vec array<float>")
        version = self.store.version()
        corpus = self.corpus(version)
        best = hybrid.search(corpus.select(*KEYS, "content", "embedding"), rows, KEYS, k, s.vector_weight, s.keyword_weight, self._index(rows, version), self.totals(version))
        wide = hybrid.materialise(best, corpus.drop("embedding"), KEYS).join(F.broadcast(rows.select("qid", "query")), "qid")
        item = hybrid.evidence(F.col("content"), F.col("source"), F.col("type"), F.col("confidence"), F.col("vector_score"), F.col("keyword_score"), F.col("id"))
        return wide.select("qid", "query", "rank", item.alias("evidence")).orderBy("qid", "rank")

    def _index(self, queries: DataFrame, version: int) -> DataFrame | None:
        """Postings of the queries' terms in both layers, stored ones as they are; None where the store keeps none."""
        stored = self.store.postings(version)
        if stored is None:
            return None if self.store.load(version).limit(1).count() else bm25.matches(self._docs_placed().withColumn("layer", F.lit(0)), KEYS, queries)
        docs = self._docs_placed().withColumn("layer", F.lit(0))
        stored = bm25.of_terms(stored.withColumn("layer", F.lit(1)), queries)
        return bm25.matches(docs, KEYS, queries).unionByName(stored.select(*KEYS, "dl", "term", "tf"))

    def search(self, query: str, top_k: int | None = None) -> DataFrame:
        return self.search_many([query], top_k)

    # -- ingest ------------------------------------------------------------------

    def add_chunks(self, chunks: DataFrame) -> None:
        """Embed and store chunks; they replace what the store has of their sources."""
        self.store.upsert(embed.encode(chunks, self.backend))

    def _charge(self, identity: str, now: float | None, n: int) -> None:
        wait = self.limiter.check(identity, time.monotonic() if now is None else now, n)
        if wait is not None:
            raise RateLimited(wait)

    def ingest_batch(self, items: DataFrame, identity: str = "local", now: float | None = None) -> DataFrame:
        """Replies of items (item, and source, html, fetch_error, or url, html, source_url); the fine ones are stored in one write.

        Items with a url are fetched here, each on its own. Where storing fails, what would have been stored is told
        to have failed.
        """
        n = items.count()
        if n > self.settings.max_batch_ingest:
            raise ValueError(f"at most {self.settings.max_batch_ingest} items")
        self._charge(identity, now, n)
        if "source" not in items.columns:
            items = self._fetched(items)
        replies, chunks = ingest.batch(items, size=self.settings.chunk_size, overlap=self.settings.chunk_overlap)
        try:
            self.add_chunks(chunks)
        except store.StoreCorrupt:
            raise
        except Exception as e:
            log.exception("storing a batch failed")
            return ingest.failed(replies, str(e))
        return replies

    def _fetched(self, items: DataFrame) -> DataFrame:
        """items (item, url, html, source_url) as item, source, html, fetch_error."""
        rows = []
        for r in ingest.validated(ingest.route(items), self.settings.max_html_chars).collect():  # a request: at most max_batch_ingest
            html, error = r["html"], r["request_error"]
            if error is None and r["origin"] == "url":
                try:
                    html = self.fetch(r["url"])
                except web.FetchError as e:
                    html, error = None, str(e)
            rows.append((r["item"], r["source"], html, error))
        return self.spark.createDataFrame(rows, "item int, source string, html string, fetch_error string")

    def ingest(self, url: str | None = None, html: str | None = None, source_url: str | None = None, identity: str = "local", now: float | None = None) -> dict:
        """Store one page, fetched or given with its source url, and reply what became of it.

        Raises BadRequest, FetchError (BlockedAddress, TooLarge), NoContent, RateLimited or StoreCorrupt.
        """
        asked = self.spark.createDataFrame([(0, url, html, source_url)], "item int, url string, html string, source_url string")
        r = ingest.validated(ingest.route(asked), self.settings.max_html_chars).first()
        if r["request_error"]:
            raise BadRequest(r["request_error"])
        self._charge(identity, now, 1)
        html = self.fetch(url) if r["origin"] == "url" else html
        one = self.spark.createDataFrame([(0, r["source"], html, None)], "item int, source string, html string, fetch_error string")
        replies, chunks = ingest.batch(one, size=self.settings.chunk_size, overlap=self.settings.chunk_overlap)
        reply = replies.first().asDict()
        if reply["status"] != ingest.OK:
            raise NoContent(reply["error"])
        self.add_chunks(chunks)
        return {"source": reply["source"], "title": reply["title"], "chunks_indexed": reply["chunks_indexed"], "chunks": chunks.select("id", "order", "content").orderBy("order").collect()}

    def ingest_pages(self, pages: DataFrame) -> None:
        """Bulk ingest of a table of url, html: no limits, one write."""
        self.add_chunks(chunking.chunk(ingest.documents(pages), self.settings.chunk_size, self.settings.chunk_overlap))

    # -- service -------------------------------------------------------------------

    def health(self) -> dict:
        return {"status": "ok", "corpus_size": self.corpus().count(), "auth": "on" if self.settings.api_keys else "off", "schema_version": EVIDENCE_VERSION}

    def stats(self) -> DataFrame:
        return self.store.stats()

    def totals(self, version: int | None = None) -> tuple[int, int]:
        """(chunks, tokens) of the corpus; stored ones are in the manifest, documents are tokenised once."""
        if self._docs_totals is None:
            r = bm25.stats(bm25.lengths(self._docs_placed(), [])).first()
            self._docs_totals = (r["n"], r["total_length"])
        n, total = self.store.totals(version)
        return self._docs_totals[0] + n, self._docs_totals[1] + total

    def caller(self, key: str | None, host: str = "unknown") -> str:
        """Who a request counts as: a fingerprint of its key, or its address where no keys are set."""
        keys = self.settings.api_keys
        if not keys:
            return f"ip:{host}"
        found = [k for k in keys if hmac.compare_digest(k.encode(), (key or "").strip().encode())]
        if not found:
            raise PermissionError("unknown key")
        return f"key:{hashlib.sha256(found[0].encode()).hexdigest()[:12]}"


class Agent:
    """What a language model's tools see of an engine: short passages and summaries, errors as text."""

    TOP_K = 5

    def __init__(self, engine: Engine):
        self.engine = engine

    def search(self, query: str, top_k: int = TOP_K) -> list[dict]:
        """Passages (content, source, confidence), the best first."""
        found = self.engine.search(query, top_k).select("rank", "evidence.content", "evidence.source", "evidence.confidence")
        return [{"content": r["content"], "source": r["source"], "confidence": r["confidence"]} for r in found.orderBy("rank").collect()]

    def _summary(self, source: str | None, status: str, error: str | None = None, **told) -> dict:
        short = lambda x: x[: guards.MAX_AGENT_CHARS] if x else x
        return {"source": source, "status": status, "error": short(error), "title": short(told.get("title")), "chunks_indexed": told.get("chunks_indexed", 0), "words": told.get("words", 0), "preview": told.get("preview", "")}

    def ingest(self, url: str | None = None, html: str | None = None, source_url: str | None = None, identity: str = "local") -> dict:
        """A summary of the stored page, or of why there is none: status ok, fetch_error, extract_error or error."""
        source = url or source_url
        try:
            done = self.engine.ingest(url, html, source_url, identity)
        except web.FetchError as e:
            return self._summary(source, ingest.FETCH_ERROR, str(e))
        except NoContent as e:
            return self._summary(source, ingest.EXTRACT_ERROR, str(e))
        except Exception as e:
            return self._summary(source, ingest.ERROR, str(e))
        words = [c["content"].split() for c in done["chunks"]]
        first = words[0][: text.PREVIEW_WORDS]
        preview = " ".join(first) + ("..." if len(first) >= text.PREVIEW_WORDS else "")
        return self._summary(done["source"], ingest.OK, title=done["title"], chunks_indexed=done["chunks_indexed"], words=sum(map(len, words)), preview=preview)

    def ingest_many(self, items: DataFrame, identity: str = "local") -> list[dict]:
        """A summary for each item (item, url, html, source_url), in order."""
        try:
            found = self.engine.ingest_batch(items, identity).orderBy("item").collect()
        except Exception as e:
            return [self._summary(r["url"] or r["source_url"], ingest.ERROR, str(e)) for r in items.orderBy("item").collect()]
        return [self._summary(r["source"], r["status"], r["error"], title=r["title"], chunks_indexed=r["chunks_indexed"], words=r["words"], preview=r["preview"]) for r in found]


def _by_name():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("source")  # the documentation layer only


__all__ = ["Agent", "BadRequest", "Engine", "NoContent", "RateLimited"]
