"""Citation URLs."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip


def public_url(value: str | None) -> str | None:
    """The normal form of a public http(s) URL, or None."""
    try:
        parts = urlsplit((value or "").strip())
        port, host = parts.port, (parts.hostname or "").lower()
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not host or parts.username or parts.password:
        return None
    try:
        if not ipaddress.ip_address(host).is_global:
            return None
        host = f"[{host}]" if ":" in host else host
    except ValueError:
        local = host == "localhost" or host.endswith((".localhost", ".local"))
        if local or not host.strip("0123456789."):
            return None
    place = host if port is None else f"{host}:{port}"
    return urlunsplit((parts.scheme.lower(), place, parts.path or "/", parts.query, ""))


@F.pandas_udf(T.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    """Arrow batches: address ranges need the standard library's tables."""
    return urls.map(public_url)


def normalize_domain_url(url) -> Column:
    """The same for hosts by name, without Python: null where it would be
    refused; addresses count as refused."""
    raw = strip(url)
    m = lambda g: F.regexp_extract(raw, r"^(?i)(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", g)
    authority = m(2)
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    port = F.regexp_extract(authority, r":(\d+)$", 0)
    good = (
        (m(1) != "") & (host != "") & ~authority.contains("@") & (host != "localhost")
        & ~host.endswith(".localhost") & ~host.endswith(".local") & ~host.rlike(r"^[0-9.]+$") & ~host.contains(":")
    )
    path = F.when(m(3) == "", "/").otherwise(m(3))
    query = F.when(F.char_length(m(4)) > 1, m(4)).otherwise("")
    return F.when(good, F.concat(F.lower(m(1)), F.lit("://"), host, port, path, query))


def reachable(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(s.between(200, 399) | s.isin(401, 403, 405), F.lit(False))


def definitive_failure(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(s.isin(404, 410), F.lit(False))
