"""URLs: hosts, canonical form, traps, article shape, safety, crawl priority."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.arrow import arrow
from siftline.functions.text import let

#: Parameters that only track, and ports that may be fetched.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "igshid")
PORTS = (80, 443, 8080, 8443)


def host_of(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def domain_of(c: Column) -> Column:
    """The host in lower case without leading www."""
    return F.regexp_replace(host_of(c), r"^(www\.)+", "")


def canonical_url(url: str | None) -> str | None:
    """Without fragment and tracking parameters, parameters sorted, one trailing slash removed; null for what is no URL."""
    if url is None:
        return None
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING)
    path = parts.path[:-1] if parts.path.endswith("/") and not parts.path.endswith("//") else parts.path
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), path, urlencode(pairs), ""))


@arrow("string")
def canonical(x: pd.Series) -> pd.Series:
    return x.map(canonical_url)


def segments(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")


def parameters(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(c, F.lit("QUERY")), F.lit("")), "&"), lambda s: s != "")


def trap(c: Column) -> Column:
    """Why a URL looks like a crawler trap, or null."""
    most = let(segments(c), lambda parts: F.array_max(F.transform(parts, lambda s: F.size(F.filter(parts, lambda t: t == s)))))
    session = F.exists(parameters(c), lambda p: F.lower(p).rlike("^(phpsessid|jsessionid|sid|sessionid|session_id)="))
    return F.when(F.size(segments(c)) > 12, "too_deep").when(F.size(parameters(c)) > 8, "too_many_parameters").when(F.coalesce(most, F.lit(0)) > 3, "repeated_segment").when(session | F.lower(c).contains(";jsessionid="), "session_id")


def looks_like_article(c: Column) -> Column:
    """A path with a dated, numbered or long hyphenated last segment."""
    last = F.coalesce(F.try_element_at(segments(c), F.lit(-1)), F.lit(""))
    return F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")).rlike(r"/\d{4}/\d{1,2}/") | last.rlike(r"\d{4,}") | (F.size(F.split(last, "-")) >= 4)


def is_article_path(c: Column) -> Column:
    """The other predicate in use: at least two segments, the last with letters and a dash or digits."""
    return (F.size(segments(c)) >= 2) & F.coalesce(F.try_element_at(segments(c), F.lit(-1)), F.lit("")).rlike(r"[-\d]")


def crawl_priority(depth: Column, trust: Column, article: Column) -> Column:
    """Smaller goes first."""
    return 1000 * depth - 5 * trust - F.when(article, 250).otherwise(0)


def revisit_priority(depth: Column, trust: Column, changes: Column, overdue_s: Column) -> Column:
    """Priority of a known page: credit for changes in three bands and for being overdue, up to a day."""
    credit = F.when(changes >= 4, 400).when(changes >= 2, 200).when(changes >= 1, 100).otherwise(0)
    return 1000 * depth - 5 * trust - credit - F.least(F.greatest(overdue_s, F.lit(0)), F.lit(86400)) / 864


def crawl_delay(robots: Column, registry: Column, adaptive: Column, floor: float = 1.5, cap: float = 60.0) -> Column:
    return F.least(F.greatest(F.coalesce(robots, F.lit(0.0)), F.coalesce(registry, F.lit(0.0)), F.coalesce(adaptive, F.lit(0.0)), F.lit(floor)), F.lit(cap))


def unsafe_reason(url: str | None) -> str | None:
    """Why a URL must not be fetched, or null."""
    try:
        parts = urlsplit(url or "")
        port = parts.port
    except ValueError:
        return "malformed"
    if parts.scheme not in ("http", "https"):
        return "scheme"
    if parts.username or parts.password:
        return "credentials"
    if port is not None and port not in PORTS:
        return "port"
    host = (parts.hostname or "").rstrip(".")
    if not host:
        return "host"
    try:
        address = ipaddress.ip_address(int(host, 0) if re.fullmatch(r"0x[0-9a-f]+|\d+", host) else host)
        mapped = getattr(address, "ipv4_mapped", None) or address
        return None if mapped.is_global and not mapped.is_multicast else "private_address"
    except ValueError:
        pass
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal")) or "." not in host:
        return "private_host"
    return None


@arrow("string")
def unsafe(x: pd.Series) -> pd.Series:
    return x.map(unsafe_reason)


def display_url(c: Column) -> Column:
    """Host and up to two path segments as a breadcrumb: decoded, dashes as spaces, 28 characters each."""
    shown = F.transform(F.slice(segments(c), 1, 2), lambda s: _short(F.translate(F.coalesce(F.try_url_decode(s), s), "-_", "  ")))
    return F.array_join(F.concat(F.array(domain_of(c)), shown), " › ")


def _short(c: Column, most: int = 28) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def suffixes(host: Column) -> Column:
    """The host and each parent domain, nearest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def status_class(c: Column) -> Column:
    """The kind of an HTTP status."""
    return F.when(c.between(200, 299), "ok").when(c == 304, "not_modified").when(c.between(300, 399), "redirect").when(c.isin(404, 410), "gone").when(c.isin(401, 403, 451), "forbidden").when(c == 429, "rate_limited").when(c.between(400, 499), "client_error").when(c.between(500, 599), "server_error").otherwise("unknown")


def retryable(c: Column) -> Column:
    return c.isin(408, 425, 429) | c.between(500, 599)
