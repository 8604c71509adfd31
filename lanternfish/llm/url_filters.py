"""URL filters with redirect equivalence.

Rules judge a url by host suffix and path prefix, the longest rule first. Urls that redirect to each other, or
name each other as canonical (link elements and refresh directives in the pages, and any redirect pairs given
besides), are aliases: connected components over these edges carry a block from one alias to those that no
rule judges. An explicit allow takes precedence: a component with an allowed alias isn't blocked through others.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm import html_render
from lanternfish.llm._graph import connected_components
from lanternfish.llm._shared import lean, materialize, small_batches, spread_join
from lanternfish.sources import tables

#: (host, path, verdict) of the query's rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rules are sent to every worker: no more than this many.
MOST_RULES = 1_000_000
DEFAULT = "allow"
_PARTS = re.compile(r".*?://([^/?#]*)([^?#]*)(\??[^#]*)", re.S)
_REFRESH = re.compile(r"\s*[\d.]*\s*[;,]?\s*url\s*=\s*[\"']?([^\"']+)", re.I)
#: Elements whose content is no part of the page.
_INERT = frozenset(("template", "noscript"))
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, query) as rules see them; empty without ://."""
    m = _PARTS.match(url) if url else None
    return (m[1].translate(UPPER), m[2], m[3]) if m else ("", "", "")


class Rules:
    """Longest-match lookup of (host, path, verdict) rules."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for found in self.by_host.values():
            found.sort(key=lambda r: (-len(r[0]), r[1]))

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule as text, verdict) of the longest rule that fits; of equally long ones that of the longer host."""
        best: tuple[int, str, str] | None = None
        while host:
            for prefix, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix):
                    if best is None or len(host) + len(prefix) > best[0]:
                        best = (len(host) + len(prefix), host + prefix, verdict)
                    break
            host = host.partition(".")[2]
        return (best[1], best[2]) if best else (None, None)


def node_of(url: str | None) -> int | None:
    """A url's identity: scheme and fragment don't tell pages apart."""
    host, path, query = split_url(url)
    return xxhash.xxh64_intdigest(f"{host}{path or '/'}{query}".encode("utf-8", "surrogatepass")) - (1 << 63) if host else None


def targets(url: str, html: str | None) -> list[str]:
    """Urls that a page names as its canonical form or refreshes to, by elements of its tree: what stands in comments,
    scripts or templates names nothing. Relative ones count from the page's base."""
    if not html:
        return []
    low = html.lower()
    if "canonical" not in low and "refresh" not in low:
        return []
    out, base, todo = [], None, [html_render.parse(html)]
    while todo:
        node = todo.pop()
        a = node.attrs
        if node.tag == "base" and base is None and a.get("href"):
            base = a["href"].strip()
        elif node.tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
            out.append(a["href"].strip())
        elif node.tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh" and (r := _REFRESH.match(a.get("content", ""))):
            out.append(r[1].strip())
        if node.tag not in _INERT:
            todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    if base:
        try:
            url = urljoin(url, base)
        except ValueError:  # not a url
            pass
    full = []
    for t in out:
        try:
            full.append(urljoin(url, t))
        except ValueError:  # not a url
            continue
    return full


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", key: str = "page_id", redirects: DataFrame | None = None) -> DataFrame:
    """key, host, path, rule, verdict, component (null for a url without aliases) for every row of pages.

    redirects: pairs (from_url, to_url) besides those in the pages. Null urls and urls without :// have empty
    host and path, no rule, no aliases, and the default verdict. Repeated urls are one node, repeated rows each
    give a row; of rules that fit equally well (ties) that of the longer host counts. Pages are read whole, and
    other columns play no part, whatever their names. An empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    shared = spark.sparkContext.broadcast(Rules(rules))

    def read(batches):
        rules = shared.value
        for batch in batches:
            urls, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            parts = [split_url(u) for u in urls]
            found = [rules.judge(h, p) for h, p, _ in parts]
            aliases = []
            for u, t in zip(urls, texts, strict=True):
                own = []
                for x in targets(u, t) if u else ():
                    own.append({"node": node_of(x), "verdict": rules.judge(*split_url(x)[:2])[1]})
                aliases.append(own)
            kinds = pa.list_(pa.struct([("node", pa.int64()), ("verdict", pa.string())]))
            cols = [batch.column(0), *(pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([node_of(u) for u in urls], pa.int64()), pa.array(aliases, kinds)], names=["key", "host", "path", "rule", "own", "node", "aliases"])

    kind = pages.schema[key].dataType.simpleString()
    schema = f"key {kind}, host string, path string, rule string, own string, node long, aliases array<struct<node:long,verdict:string>>"
    rows = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`"), F.col(f"`{html}`"))
    read_pages = materialize(rows.mapInArrow(lean(read), schema), "urls")
    far = read_pages.select("node", F.explode("aliases").alias("to"))
    edges = far.select(F.col("node").alias("u"), F.col("to.node").alias("v"))
    judged = read_pages.select("node", F.col("own").alias("verdict")).unionByName(far.select("to.node", "to.verdict"))
    if redirects is not None:
        pairs = redirects.select(F.struct(F.lit(None).cast("string").alias("h"), "from_url").alias("a"), F.struct(F.lit(None).cast("string").alias("h"), "to_url").alias("b"))
        ends = pairs.select(F.monotonically_increasing_id().alias("key"), F.col("a.from_url").alias("u0"), F.col("b.to_url").alias("u1"))
        schema2 = "key long, host string, path string, rule string, own string, node long, aliases array<struct<node:long,verdict:string>>"
        both = materialize(ends.select("key", F.explode(F.array("u0", "u1")).alias("url"), F.lit("").alias("html")).mapInArrow(lean(read), schema2), "redirects")
        edges = edges.unionByName(both.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("v")).select("u", "v"))
        judged = judged.unionByName(both.select("node", F.col("own").alias("verdict")))
    rank = F.max(F.when(F.col("verdict") == "allow", 2).when(F.col("verdict") == "block", 1).otherwise(0)).alias("rank")
    # One url, one row, however many pages name it or are it.
    judged = materialize(judged.filter("node IS NOT NULL").groupBy("node").agg(rank, F.count("*").alias("n")), "judged")
    tied = materialize(connected_components(edges).join(judged.select("node", "rank"), "node"), "aliases")
    verdicts = materialize(tied.groupBy("component").agg(F.max("rank").alias("rank"), F.count("*").alias("c_n")), "verdicts")
    known = spread_join(tied.select("node", "component"), verdicts, ["component"], "c_n", F.xxhash64("node"))
    known = materialize(judged.select("node", "n").join(known, "node", "left"), "known")
    met = spread_join(read_pages.filter("node IS NOT NULL"), known, ["node"], "n", F.monotonically_increasing_id())
    out = met.unionByName(read_pages.filter("node IS NULL"), allowMissingColumns=True)
    verdict = F.coalesce("own", F.when(F.col("rank") == 2, F.lit("allow")).when(F.col("rank") == 1, F.lit("block")), F.lit(DEFAULT))
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "component")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(tables.read(spark, f"{sf_dir}/pages.parquet", "page_id", "url", "html")).drop("component")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"""{_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*([?][^#]*)', 1) AS query"""
#: Links with absolute urls; relative ones need an url library.
SQL = f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
tags AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(?:script|style|template|noscript|textarea|title)[ >].*?</(?:script|style|template|noscript|textarea|title)>', '', 'g'), '(?is)<(?:link|meta)[^>]*>')) AS t FROM pages WHERE url IS NOT NULL),
links AS (SELECT page_id, CASE WHEN regexp_matches(t, '(?is)rel=.?canonical') THEN regexp_extract(t, '(?is)href=.?(https?://[^" >]*)', 1)
  WHEN regexp_matches(t, '(?is)http-equiv=.?refresh') THEN regexp_extract(t, '(?is)url=.?(https?://[^" >]*)', 1) ELSE '' END AS url FROM tags),
u AS (SELECT page_id, 0 AS far, {_SPLIT} FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
  UNION ALL SELECT page_id, 1, {_SPLIT} FROM links WHERE url <> ''),
n AS (SELECT page_id, far, host, path, host || coalesce(nullif(path, ''), '/') || query AS node FROM u),
f AS (SELECT DISTINCT host, path, arg_max(struct_pack(r := h || p, v := v), length(h || p) * 1000 + length(h)) OVER (PARTITION BY host, path) AS own
  FROM (SELECT DISTINCT host, path FROM n) x JOIN rules ON (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p)),
j AS (SELECT n.*, own FROM n LEFT JOIN f USING (host, path)),
e AS (SELECT a.node AS a, b.node AS b FROM j a JOIN j b ON a.page_id = b.page_id AND a.far = 0 AND b.far = 1 WHERE a.host <> '' AND b.host <> ''),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, a AS b FROM g UNION SELECT reach.a, g.b FROM reach JOIN g ON g.a = reach.b),
told AS (SELECT reach.a AS node, bool_or(own.v = 'allow') AS ok, bool_or(own.v = 'block') AS bad FROM reach JOIN j ON j.node = reach.b GROUP BY reach.a)
SELECT page_id, host, path, own.r AS rule, coalesce(own.v, CASE WHEN ok THEN 'allow' WHEN bad THEN 'block' END, '{DEFAULT}') AS verdict
FROM j LEFT JOIN told USING (node) WHERE far = 0
"""
