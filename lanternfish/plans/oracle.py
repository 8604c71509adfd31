"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from lanternfish.plans.queries import ADDRESSES, BATCH, BUCKET_LIMIT, BUCKET_WINDOW, CONTENT_TYPES, OVERLAP, SINGLE, SIZE, TOP

STRIDE = SIZE - OVERLAP
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}'), lambda x: x <> '')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def cut(name: str, rows: str, keys: str, content: str = "content") -> str:
    """CTEs: name has keys, ord, content of each window of the rows' content."""
    return f"""{name}_w AS (SELECT {keys}, {words(content)} AS words FROM {rows}),
{name}_s AS (SELECT {keys}, words, unnest(range(0, len(words), {STRIDE})) AS s FROM {name}_w),
{name} AS (SELECT {keys}, CAST(s // {STRIDE} AS INTEGER) AS ord, array_to_string(words[s + 1:s + {SIZE}], ' ') AS content FROM {name}_s)"""


def values(which) -> str:
    return ", ".join(f"({q}::BIGINT, '{t}', {v}::BIGINT)" for q, t, v in which)


def decoded(x: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def markdown(html: str) -> str:
    """Markdown of simple article pages: headings, paragraphs, line breaks; other tags go."""
    x = f"regexp_replace(regexp_extract({html}, '(?is)<article[^>]*>(.*?)</article>', 1), '\\s+', ' ', 'g')"
    for tag, mark in (("<h1[^>]*>", "\n\n# "), ("</h1>|</?p(?:\\s[^>]*)?>", "\n\n"), ("<br[^>]*>", "\n"), ("<[^>]*>", "")):
        x = f"regexp_replace({x}, '(?i){tag}', '{mark}', 'g')"
    return f"nullif(trim(regexp_replace(regexp_replace({decoded(x)}, ' *\n *', '\n', 'g'), '\n{{3,}}', '\n\n', 'g'), ' \n'), '')"


CHUNKS = cut("chunks", "documents", "doc_id, source", "text")
TURNS = cut("turns", "(SELECT conv_id, turn, 'conv' || conv_id AS source, text FROM conversations)", "conv_id, turn, source", "text")
TITLE = "trim(regexp_replace(" + decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r", '\s+', ' ', 'g'))"
META = lambda n: f"nullif(regexp_extract(html, '(?is)<meta[^>]*(?:name|property)=\"{n}\"[^>]*content=\"([^\"]*)\"', 1), '')"
ARTICLES = f"articles AS (SELECT page_id, url, coalesce(nullif({TITLE}, ''), {META('og:title')}, url, 'untitled') AS title, {markdown('html')} AS content FROM pages)"
ID = "left(sha256(url || chr(0) || content), 32)"
POSTINGS = f"""tok AS (SELECT doc_id, ord, {tokens('content')} AS t FROM chunks),
lens AS (SELECT doc_id, ord, len(t) AS dl FROM tok),
post AS (SELECT doc_id, ord, term, count(*) AS tf FROM (SELECT doc_id, ord, unnest(t) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, CAST(coalesce(sum(dl), 0) AS BIGINT) AS total_length, coalesce(sum(dl) / count(*), 0) AS avgdl FROM lens)"""
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"


def keyword(which, rows: str = CHUNKS) -> str:
    return f"""{rows}, {POSTINGS},
q AS (SELECT * FROM (VALUES {values(which)}) v(qid, query, vec_id)),
terms AS (SELECT DISTINCT qid, unnest({tokens('query')}) AS term FROM q),
scores AS (SELECT qid, doc_id, ord, sum({IDF} * tf * 2.5 / (tf + 0.375 + 1.125 * dl / avgdl)) AS score
  FROM post JOIN terms USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id, ord) CROSS JOIN stats GROUP BY ALL)"""


def every(which, rows: str = CHUNKS) -> str:
    return f"""{keyword(which, rows)},
full_k AS (SELECT qid, doc_id, ord, coalesce(score, 0) AS s FROM (SELECT qid, doc_id, ord FROM chunks CROSS JOIN q) LEFT JOIN scores USING (qid, doc_id, ord)),
ends AS (SELECT qid, min(s) AS lo, max(s) AS hi FROM full_k GROUP BY qid),
kw AS (SELECT qid, doc_id, ord, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0.0 END AS keyword_score FROM full_k JOIN ends USING (qid))"""


COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / CASE WHEN sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])) = 0 THEN 1e-8 ELSE sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])) END"


EVERY_DOCUMENT = cut("all_chunks", "documents", "doc_id, source", "text") + ", chunks AS (SELECT a.*, embedding FROM all_chunks a LEFT JOIN embeddings e ON e.vec_id = a.doc_id)"


def ranked(which, k: int) -> str:
    """The k best chunks of all documents, a missing vector counting as cosine 0."""
    return f"""{every(which, EVERY_DOCUMENT)},
near AS (SELECT qid, doc_id, ord, coalesce({COS.format('c.embedding', 'e.embedding')}, 0.0) AS vector_score FROM chunks c CROSS JOIN q JOIN embeddings e ON e.vec_id = q.vec_id),
fused AS (SELECT qid, doc_id, ord, vector_score, keyword_score, 0.65 * vector_score + 0.35 * keyword_score AS confidence FROM near JOIN kw USING (qid, doc_id, ord)),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(confidence, 9) DESC, doc_id, ord) AS INTEGER) AS rank FROM fused) WHERE rank <= {k})"""


R3 = "round(confidence, 3) AS confidence, round(vector_score, 3) AS vector_score, round(keyword_score, 3) AS keyword_score"
LOG = "log AS (SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS source, event_id % 5 + 1 AS n, event_type = 'error' AS removed FROM events)"
LIVE = f"{LOG}, last AS (SELECT source, max(pos) AS pos FROM log GROUP BY source), live AS (SELECT source, pos, n FROM log JOIN last USING (source, pos) WHERE NOT removed)"
STATUS = "CASE WHEN url LIKE 'http:%' THEN 'fetch_error' WHEN content IS NULL THEN 'extract_error' ELSE 'ok' END"
#: The store after conversations came as src1 and src2.
STORED = f"""{CHUNKS}, {TURNS}, stored AS (SELECT 0 AS later, source, CAST(doc_id AS VARCHAR) AS id, ord, content FROM chunks WHERE source NOT IN ('src1', 'src2')
  UNION ALL SELECT 1, CASE WHEN turn % 2 = 0 THEN 'src1' ELSE 'src2' END, conv_id || '-' || turn, ord, content FROM turns)"""
HOST = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '[\[\]]', '', 'g'))"
SCHEME = r"lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
PREVIEW = f"array_to_string(({words('content')})[1:40], ' ') || CASE WHEN len(({words('content')})[1:40]) >= 40 THEN '...' ELSE '' END"


def _sql(text) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    cos_best = lambda which, k: f"""WITH q AS (SELECT * FROM (VALUES {values(which)}) v(qid, query, vec_id)),
s AS (SELECT q.qid, c.vec_id, {COS.format('c.embedding', 'e.embedding')} AS s FROM embeddings c CROSS JOIN q JOIN embeddings e ON e.vec_id = q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT qid, rank, vec_id, round(s, 6) AS vector_score FROM r WHERE rank <= {k}"""  # noqa: E731
    pages_cut = f"ids AS (SELECT *, {ID} AS id FROM articles), " + cut("cuts", "ids", "id, url, title")
    items_cut = f"fine AS (SELECT * FROM articles WHERE {STATUS} = 'ok'), " + cut("cuts", "fine", "page_id")
    types = ", ".join(f"({i}, {_sql(c)})" for i, c in enumerate(CONTENT_TYPES))
    rate = f"({BUCKET_LIMIT} / {BUCKET_WINDOW}.0)"
    return {
        "chunk_windows": f"WITH {CHUNKS} SELECT doc_id, source, ord, content, CAST(len({words('content')}) AS INTEGER) AS n_words FROM chunks",
        "chunk_counts_by_source": f"WITH {CHUNKS} SELECT source, count(*) AS n_chunks FROM chunks GROUP BY source",
        "chunk_tail_contained": f"WITH {CHUNKS}, n AS (SELECT doc_id, ord, CAST(len({words('content')}) AS INTEGER) AS n_words FROM chunks) SELECT * FROM n WHERE ord > 0 AND n_words <= {OVERLAP}",
        "corpus_two_layers": f"WITH {CHUNKS}, {TURNS} SELECT 0 AS layer, source, doc_id, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, ord, sha256(content) AS content_sha FROM chunks UNION ALL SELECT 1, source, NULL, conv_id, turn, ord, sha256(content) FROM turns",
        "corpus_size": f"WITH {CHUNKS}, {TURNS}, c AS (SELECT source FROM chunks UNION ALL SELECT source FROM turns) SELECT count(*) AS corpus_size, count(DISTINCT source) AS sources FROM c",
        "term_counts": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL",
        "doc_lengths": f"WITH {CHUNKS}, {POSTINGS} SELECT doc_id, ord, dl FROM lens",
        "document_frequency": f"WITH {CHUNKS}, {POSTINGS} SELECT term, df FROM dfs",
        "corpus_stats": f"WITH {CHUNKS}, {POSTINGS} SELECT n, total_length, round(avgdl, 9) AS avgdl FROM stats",
        "idf_table": f"WITH {CHUNKS}, {POSTINGS} SELECT term, df, round({IDF}, 9) AS idf FROM dfs CROSS JOIN stats",
        "query_terms": f"SELECT DISTINCT qid, unnest({tokens('query')}) AS term FROM (VALUES {values(BATCH)}) v(qid, query, vec_id)",
        "bm25_single": f"WITH {keyword([SINGLE])} SELECT doc_id, ord, round(score, 9) AS score FROM scores",
        "bm25_batch": f"WITH {keyword(BATCH)} SELECT qid, doc_id, ord, round(score, 9) AS score FROM scores",
        "bm25_minmax": f"WITH {every(BATCH)} SELECT qid, doc_id, ord, round(keyword_score, 9) AS keyword_score FROM kw",
        "bm25_after_removal": f"WITH {keyword(BATCH, cut('chunks', '(SELECT * FROM documents WHERE source <> ' + _sql('src7') + ')', 'doc_id, source', 'text'))} SELECT qid, doc_id, ord, round(score, 9) AS score FROM scores",
        "bm25_incremental": f"WITH {CHUNKS}, {TURNS}, l AS (SELECT len({tokens('content')}) AS dl FROM (SELECT content FROM chunks WHERE source <> 'src7' UNION ALL SELECT content FROM turns)) SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total_length, round(sum(dl) / count(*), 9) AS avgdl FROM l",
        "cosine_topk": f"SELECT rank, vec_id, vector_score FROM ({cos_best([SINGLE], 5)})",
        "cosine_batch_topk": cos_best(BATCH, 10),
        "cosine_every_100th_topk": f"""WITH s AS (SELECT e.vec_id AS qid, c.vec_id, {COS.format('c.embedding', 'e.embedding')} AS s FROM embeddings c CROSS JOIN embeddings e WHERE e.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT qid, rank, vec_id, round(s, 6) AS vector_score FROM r WHERE rank <= 10""",
        "cosine_zero_vector": "SELECT vec_id, 0.0::DOUBLE AS vector_score FROM embeddings",
        "hybrid_search": f"WITH {ranked([SINGLE], TOP)} SELECT rank, doc_id, ord, {R3} FROM best",
        "hybrid_batch": f"WITH {ranked(BATCH, TOP)} SELECT qid, rank, doc_id, ord, {R3} FROM best",
        "evidence": f"WITH {ranked(BATCH, 10)} SELECT qid, rank, content, source, 'documentation' AS type, {R3}, CAST(doc_id AS VARCHAR) AS id FROM best JOIN chunks USING (doc_id, ord)",
        "evidence_json": f"WITH {ranked(BATCH, 3)}, e AS (SELECT qid, rank, {{'content': content, 'source': source, 'type': 'documentation', 'confidence': round(confidence, 3), 'metadata': {{'vector_score': round(vector_score, 3), 'keyword_score': round(keyword_score, 3), 'id': CAST(doc_id AS VARCHAR)}}}} AS e FROM best JOIN chunks USING (doc_id, ord)) SELECT qid, CAST(to_json({{'schema_version': '1.0', 'query': any_value(query), 'results': list(e ORDER BY rank)}}) AS VARCHAR) AS reply FROM e JOIN q USING (qid) GROUP BY qid",
        "passages": f"WITH {ranked(BATCH, 5)} SELECT content, source, round(confidence, 3) AS confidence FROM best JOIN chunks USING (doc_id, ord)",
        "evidence_defaults": "SELECT doc_id, sha256(text) AS content_sha, coalesce(nullif(source, 'src3'), 'unknown') AS source, CASE WHEN source = 'src4' THEN 'web' ELSE 'documentation' END AS type, 0.123::DOUBLE AS confidence, CAST(doc_id AS VARCHAR) AS id FROM documents",
        "page_title": f"WITH {ARTICLES} SELECT page_id, title FROM articles",
        "page_article_text": f"WITH {ARTICLES} SELECT {ID} AS id, url AS source, content, 'web' AS type, title, url FROM articles WHERE content IS NOT NULL",
        "page_metadata": f"SELECT page_id, url, {META('author')} AS author, {META('date')} AS date, {META('og:site_name')} AS sitename FROM pages",
        "page_markdown": f"WITH {ARTICLES} SELECT page_id, title, content, CASE WHEN content IS NULL THEN 'no extractable content' END AS extract_error FROM articles",
        "ingest_pages_chunks": f"WITH {ARTICLES}, {pages_cut} SELECT id, url AS source, title, ord, content FROM cuts",
        "ingest_status": f"WITH {ARTICLES}, {items_cut}, n AS (SELECT page_id, count(*) AS n FROM cuts GROUP BY page_id) SELECT page_id AS item, url AS source, {STATUS} AS status, {STATUS} <> 'ok' AS failed, title, coalesce(n, 0) AS chunks_indexed FROM articles LEFT JOIN n USING (page_id)",
        "ingest_batch_dedup": f"""WITH {ARTICLES}, h AS (SELECT min(page_id) AS item, arg_max(content, page_id) AS content, arg_max(title, page_id) AS title, {HOST.format('url')} AS source FROM articles WHERE {STATUS} = 'ok' GROUP BY source), {cut('cuts', 'h', 'source, item, title')}
SELECT source, item, ord, sha256(content) AS content_sha, title, 'web' AS type FROM cuts""",
        "page_payload": f"""WITH {ARTICLES}, l AS (SELECT url, arg_max(content, page_id) AS content FROM articles WHERE {STATUS} = 'ok' GROUP BY url), k AS (SELECT url, content, {ID} AS id FROM l), {cut('cuts', 'k', 'url, id')}
SELECT url AS source, CAST(to_json(list({{'id': id, 'chars': length(content), 'order': ord}} ORDER BY ord)) AS VARCHAR) AS chunks FROM cuts GROUP BY url""",
        "ingest_summary": f"WITH {ARTICLES}, {items_cut}, f AS (SELECT page_id, ord, len({words('content')}) AS n, {PREVIEW} AS p FROM cuts), g AS (SELECT page_id, count(*) AS chunks_indexed, CAST(sum(n) AS BIGINT) AS words, arg_min(p, ord) AS preview FROM f GROUP BY page_id) SELECT page_id AS item, coalesce(chunks_indexed, 0) AS chunks_indexed, coalesce(words, 0) AS words, coalesce(preview, '') AS preview FROM articles LEFT JOIN g USING (page_id)",
        "source_upsert_latest": f"WITH {STORED} SELECT later, source, id, ord, CAST(length(content) AS INTEGER) AS chars FROM stored",
        "delete_sources": f"WITH {STORED} SELECT source, count(*) AS n_chunks FROM stored WHERE source <> 'src1' GROUP BY source",
        "store_stats": f"WITH {STORED}, l AS (SELECT * FROM stored WHERE source <> 'src7') SELECT (SELECT count(*) FROM l) AS live_chunks, (SELECT count(DISTINCT source) FROM l) AS sources, (SELECT count(*) FROM chunks) + (SELECT count(*) FROM turns) - (SELECT count(*) FROM l) AS dead_chunks, 2::BIGINT AS segments",
        "store_totals": f"WITH {STORED} SELECT count(*) AS n, CAST(sum(len({tokens('content')})) AS BIGINT) AS total_length FROM stored WHERE source <> 'src7'",
        "store_postings": f"WITH {STORED} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tokens('content')})) AS term FROM stored WHERE source <> 'src7') GROUP BY term",
        "compaction_due": f"WITH {CHUNKS} SELECT source, count(*) AS n_chunks, 0::BIGINT AS dead_chunks, (SELECT count(DISTINCT source) FROM chunks) AS sources FROM chunks GROUP BY source",
        "orphan_segments": "SELECT * FROM (VALUES ('seg-999999-stray'), ('manifest-000000001.json')) v(segment)",
        "corpus_hash": "SELECT sha256(string_agg(n_name || chr(0) || n_name || ' ' || n_regionkey || chr(0), '' ORDER BY n_name)) AS corpus_hash FROM nation",
        "corpus_marks": f"WITH {CHUNKS}, h AS (SELECT sha256(source || chr(0) || doc_id || chr(0) || ord || chr(0) || content) AS h FROM chunks) SELECT sha256(" + " || ' ' || ".join(f"CAST(sum(CAST(('0x' || substr(h, {a}, 15)) AS BIGINT)) AS VARCHAR)" for a in (1, 16, 31, 46)) + ") AS corpus_marks FROM h",
        "ip_guard": r"SELECT ip, CASE WHEN NOT regexp_matches(ip, '[.:]') THEN NULL ELSE regexp_matches(ip, '^(::ffff:)?(127|10|0|192\.168|169\.254|22[4-9]|23[0-9])\.') OR ip = '::1' END AS blocked FROM (VALUES " + ", ".join(f"({_sql(x)})" for x in ADDRESSES) + ") v(ip)",
        "manifest_replay": f"WITH {LIVE} SELECT source, pos, n FROM live",
        "request_bounds": f"SELECT conv_id, turn, coalesce(length({strip('text')}) BETWEEN 1 AND 200, false) AS query_ok, turn * 20 BETWEEN 1 AND 50 AS top_k_ok, role = 'user' AND coalesce(length(text) > 0, false) AS ingest_ok FROM conversations",
        "url_guard": f"WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?:', 'ftp:') WHEN 1 THEN upper(url) ELSE url END AS u FROM pages) SELECT page_id, {HOST.format('u')} AS host, {SCHEME.format('u')} IN ('http', 'https') AND {HOST.format('u')} <> '' AS allowed FROM u",
        "content_type_guard": f"SELECT i, c IS NULL OR c = '' OR contains(lower({strip('split_part(c, chr(59), 1)')}), 'html') AS passes FROM (VALUES {types}) v(i, c)",
        "redirect_chains": "WITH RECURSIVE f AS (SELECT p_partkey AS place, CASE WHEN p_partkey > 3 THEN p_partkey // 3 END AS nxt FROM part), w AS (SELECT place AS url, place, nxt, 0 AS hops FROM f UNION ALL SELECT w.url, f.place, f.nxt, hops + 1 FROM w JOIN f ON f.place = w.nxt WHERE hops < 4), l AS (SELECT url, max(hops) AS hops, arg_max(place, hops) AS place, arg_max(coalesce(nxt, 0), hops) AS nxt FROM w GROUP BY url) SELECT CAST(url AS VARCHAR) AS url, CASE WHEN nxt = 0 THEN CAST(place AS VARCHAR) END AS final, hops, CASE WHEN nxt <> 0 THEN 'too many redirects' END AS error FROM l",
        "key_fingerprint": "SELECT c_custkey, left(sha256(c_name), 12) AS fingerprint FROM customer",
        "token_bucket": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, user_id, rn, t, {BUCKET_LIMIT}.0::DOUBLE - 1 AS tokens, true AS admitted FROM e WHERE rn = 1
UNION ALL SELECT event_id, user_id, rn, CASE WHEN have >= 1 THEN now_t ELSE t END, CASE WHEN have >= 1 THEN have - 1 ELSE tokens END, have >= 1
FROM (SELECT e.event_id, e.user_id, e.rn, e.t AS now_t, f.t, f.tokens, least({BUCKET_LIMIT}.0::DOUBLE, f.tokens + (e.t - f.t) * {rate}::DOUBLE) AS have FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT event_id, user_id, admitted FROM f""",
    }
