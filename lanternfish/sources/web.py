"""Web pages as a Python data source, guarded against private addresses, redirects and size."""

from __future__ import annotations

import socket
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lanternfish.functions.guards import address_blocked

MAX_BYTES, TIMEOUT, AGENT = 5 << 20, 10.0, "lanternfish/0.1"
#: Responses looked at in a chain: the last must not be a redirect.
HOPS = 5


class FetchError(Exception):
    """A page could not be fetched, or may not be."""


class BlockedAddress(FetchError):
    """A host has an address that isn't public."""


class TooLarge(FetchError):
    """A response is beyond the byte cap."""


def resolve(host: str) -> list[str]:
    try:
        return [x[4][0] for x in socket.getaddrinfo(host, None)]
    except OSError as e:
        raise FetchError(f"cannot resolve {host}: {e}") from e


def check_url(url: str, lookup: Callable[[str], list[str]] = resolve) -> None:
    """Raise for a url that may not be fetched."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme.lower() not in ("http", "https"):
        raise FetchError(f"unsupported scheme: {parts.scheme}")
    if not parts.hostname:
        raise FetchError(f"no host in {url}")
    for ip in lookup(parts.hostname):
        if address_blocked(ip):
            raise BlockedAddress(f"{parts.hostname} has the non-public address {ip}")


class _Still(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_, **__):
        return None


def get(url: str):
    """(status, headers, body stream) of one request, redirects not followed."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        r = urllib.request.build_opener(_Still).open(request, timeout=TIMEOUT)
    except urllib.error.HTTPError as e:
        r = e
    except OSError as e:
        raise FetchError(f"cannot fetch {url}: {e}") from e
    return r.status, r.headers, r


def fetch(url: str, most: int = MAX_BYTES, send=get, lookup=resolve) -> str:
    """The page at url as text. Every hop of a redirect chain is checked anew; the body is read up to the cap."""
    at = url
    check_url(at, lookup)
    for _ in range(HOPS):
        status, headers, body = send(at)
        if status not in (301, 302, 303, 307, 308):
            break
        if not headers.get("location"):
            raise FetchError(f"redirect without a location from {at}")
        at = urllib.parse.urljoin(at, headers["location"])
        check_url(at, lookup)
    else:
        raise FetchError(f"too many redirects from {url}")
    if status >= 400:
        raise FetchError(f"status {status} from {at}")
    kind = headers.get("content-type") or ""
    if kind and "html" not in kind.split(";")[0].strip().lower():
        raise FetchError(f"not html: {kind}")
    size = headers.get("content-length") or ""
    if size.isdigit() and int(size) > most:
        raise TooLarge(f"{size} bytes declared")
    data = body.read(most + 1)
    if len(data) > most:
        raise TooLarge(f"more than {most} bytes")
    charset = dict(p.strip().split("=", 1) for p in kind.split(";")[1:] if "=" in p).get("charset", "utf-8").strip("\"' ")
    try:
        return data.decode(charset, errors="replace")
    except LookupError:
        return data.decode("utf-8", errors="replace")


class WebPages(DataSource):
    """spark.read.format("web_pages").option("urls", "\\n".join(...)).load() -> url, html, fetch_error."""

    @classmethod
    def name(cls):
        return "web_pages"

    def schema(self):
        return "url string, html string, fetch_error string"

    def reader(self, schema):
        urls = [u for u in self.options.get("urls", "").split("\n") if u]
        return _Reader(urls, int(self.options.get("partitions", "8")))


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], n: int):
        self.urls, self.n = urls, max(1, n)

    def partitions(self):
        return [InputPartition(k) for k in range(min(self.n, max(1, len(self.urls))))]

    def read(self, partition):
        for url in self.urls[partition.value :: self.n]:
            try:
                yield (url, fetch(url), None)
            except FetchError as e:
                yield (url, None, str(e))
