"""Pages from the web, where the caller asks for it. Every hop's address is checked and is the one that is dialled."""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
import time
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import vectorised

# Limits, and networks beside those that the address library calls private, loopback, link-local or unspecified.
TIMEOUT, MOST_BYTES, HOPS = 30, 5_000_000, 5
BLOCKED = [ipaddress.ip_network(n) for n in ("fd00:ec2::254/128", "100.64.0.0/10", "198.18.0.0/15", "64:ff9b::/96")]
PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")]
ERRORS = ("ssrf_blocked", "redirect_limit", "http_error", "non_html", "no_text_content")


def block_reason_of(address: str | None) -> str | None:
    """Why an address must not be dialled, or None."""
    try:
        ip = ipaddress.ip_address(address or "")
    except ValueError:
        return "invalid"
    ip = getattr(ip, "ipv4_mapped", None) or ip
    for reason, hit in (("loopback", ip.is_loopback), ("unspecified", ip.is_unspecified), ("link-local", ip.is_link_local), ("multicast", ip.is_multicast and ip.is_link_local)):
        if hit:
            return reason
    if any(ip.version == n.version and ip in n for n in PRIVATE):
        return "private"
    return "reserved" if any(ip.version == n.version and ip in n for n in BLOCKED) else None


@vectorised("string")
def ip_block_reason(address: pd.Series) -> pd.Series:
    return address.map(block_reason_of)


class Refused(Exception):
    pass


def _dial(host: str, port: int, timeout: float) -> socket.socket:
    addresses = [a[4][0] for a in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]
    if not addresses or any(block_reason_of(a) for a in addresses):
        raise Refused("ssrf_blocked")
    return socket.create_connection((addresses[0], port), timeout)


def _request(url: str, deadline: float, agent: str):
    at = urlsplit(url)
    if at.scheme not in ("http", "https") or not at.hostname:
        raise Refused("ssrf_blocked")
    port, left = at.port or (443 if at.scheme == "https" else 80), max(0.1, deadline - time.monotonic())
    c = http.client.HTTPConnection(at.hostname, port, timeout=left)
    c.sock = _dial(at.hostname, port, left)
    if at.scheme == "https":
        c.sock = ssl.create_default_context().wrap_socket(c.sock, server_hostname=at.hostname)
    c.request("GET", (at.path or "/") + (f"?{at.query}" if at.query else ""), headers={"User-Agent": agent, "Host": at.netloc})
    return c, c.getresponse()


def fetch_one(url: str, html_only: bool = True, timeout: float = TIMEOUT, most: int = MOST_BYTES, agent: str = "Mozilla/5.0 (compatible; loomtext/1.0)") -> dict:
    """url -> content, status, content_type, final_url, error."""
    out = {"content": None, "status": None, "content_type": None, "final_url": url, "error": None}
    deadline = time.monotonic() + timeout
    try:
        for _ in range(HOPS + 1):
            c, r = _request(out["final_url"], deadline, agent)
            try:
                out["status"], out["content_type"] = r.status, r.headers.get("Content-Type", "")
                if r.status in (301, 302, 303, 307, 308) and r.headers.get("Location"):
                    out["final_url"] = urljoin(out["final_url"], r.headers["Location"])
                    continue
                if not 200 <= r.status < 300:
                    raise Refused("http_error")
                if html_only and "text/html" not in out["content_type"].lower():
                    raise Refused("non_html")
                out["content"] = r.read(most)
                return out
            finally:
                c.close()
        raise Refused("redirect_limit")
    except Refused as e:
        out["error"] = str(e)
    except (OSError, http.client.HTTPException, ValueError) as e:
        out["error"] = f"network: {type(e).__name__}"
    return out


FETCHED = "struct<content:binary,status:int,content_type:string,final_url:string,error:string>"


def fetched(url: Column, html_only: bool = True, timeout: float = TIMEOUT, most: int = MOST_BYTES) -> Column:
    """A failure is a row's error, not the job's."""

    @F.pandas_udf(FETCHED)
    def f(urls: pd.Series) -> pd.DataFrame:
        rows = [fetch_one(u, html_only, timeout, most) if u else {"error": "ssrf_blocked"} for u in urls]
        out = pd.DataFrame(rows, columns=["content", "status", "content_type", "final_url", "error"])
        return out.astype({"status": "Int32"})

    return f(url)


def fetch(urls: DataFrame, url_col: str = "url", **limits) -> DataFrame:
    """The columns of urls, with text, surfaces and what the server said; no_text_content keeps the surfaces."""
    from ..operators.htmlmd import article_text
    from .surfaces import html_surfaces

    got = urls.withColumn("_f", fetched(F.col(url_col), **limits))
    html = F.decode(F.col("_f.content"), "UTF-8")
    out = got.select(*urls.columns, article_text(html).alias("text"), html_surfaces(html).alias("hidden_surfaces"), F.col("_f.status").alias("status"), F.col("_f.content_type").alias("content_type"), F.col("_f.final_url").alias("final_url"), F.col("_f.error").alias("error"))
    return out.withColumn("error", F.when(F.col("error").isNull() & (F.coalesce("text", F.lit("")) == ""), "no_text_content").otherwise(F.col("error")))
