"""Validation of requests, urls, addresses and responses as Column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions.text import strip

#: Characters of a url; characters of a title or an error in what an agent reads.
MAX_URL_CHARS, MAX_AGENT_CHARS = 2048, 128


def query_ok(query: Column, most: int = 2000) -> Column:
    return F.coalesce(F.length(strip(query)).between(1, most), F.lit(False))


def top_k_ok(top_k: Column, most: int = 50) -> Column:
    """A null top_k means the default."""
    return top_k.isNull() | top_k.between(1, most)


def ingest_ok(url: Column, html: Column, source_url: Column, most: int = 5 << 20) -> Column:
    """A url, or html with its source url; each within its bounds. Empty counts as absent."""
    said = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    short = lambda c, n: c.isNull() | (F.length(c) <= n)
    return (said(url) | said(html) & said(source_url)) & short(url, MAX_URL_CHARS) & short(source_url, MAX_URL_CHARS) & short(html, most)


def url_error(url: Column) -> Column:
    """null for a http(s) url with a host, else what is wrong with it."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(url.isNull() | ~scheme.isin("http", "https"), F.concat(F.lit("unsupported scheme: "), F.coalesce(scheme, F.lit(""))))
        .when(F.coalesce(host_of(url), F.lit("")) == "", F.lit("no host"))
        .otherwise(F.lit(None).cast("string"))
    )


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and brackets; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"[\[\]]", ""))


def address_blocked(text: str | None) -> bool | None:
    """Whether an address isn't public; null for what is no address."""
    try:
        ip = ipaddress.ip_address((text or "").strip("[]").split("%")[0])
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified


@F.pandas_udf(T.BooleanType())
def blocked_ip(addresses: pd.Series) -> pd.Series:
    """address_blocked() of a column; the standard library knows the ranges, SQL functions do not."""
    return addresses.map(address_blocked).astype("object")


def blocked_host(rows, host: str = "host", ip: str = "ip"):
    """(host, blocked): a host is blocked if any of its addresses is."""
    return rows.groupBy(host).agg(F.coalesce(F.bool_or(blocked_ip(F.col(ip))), F.lit(False)).alias("blocked"))


def html_type_ok(content_type: Column) -> Column:
    """A missing content type passes; else its main type must contain html."""
    main = F.lower(strip(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return content_type.isNull() | (content_type == "") | F.contains(main, F.lit("html"))


def body_text(body: Column, most: int) -> Column:
    """A response's text, or null beyond the byte cap. Malformed bytes are replaced, not refused."""
    return F.when(F.octet_length(body) <= most, decode_lossy(body))


@F.pandas_udf(T.StringType())
def decode_lossy(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="replace"))
