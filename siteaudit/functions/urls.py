"""URL functions: native where a column expression can say it, Arrow UDFs where not."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Link schemes that are no pages.
SKIPPED = ("javascript:", "mailto:", "tel:", "data:")
# File extensions that are assets.
ASSETS = (
    "svg", "png", "jpg", "jpeg", "gif", "webp", "avif", "ico", "bmp", "tiff", "css", "js", "mjs", "cjs", "json", "xml", "rss", "atom", "map",
    "pdf", "zip", "gz", "tar", "dmg", "exe", "csv", "woff", "woff2", "ttf", "otf", "eot", "mp4", "webm", "mov", "mp3", "wav", "ogg", "avi",
)
_PORTS = {"http": 80, "https": 443}


def normalize(url: str) -> str | None:
    """A URL as browsers write it: lower-case scheme and host, no default port, no dot segments, encoded path; None if it isn't absolute http(s)."""
    try:
        parts = urlsplit(url.strip().replace("\t", "").replace("\n", "").replace("\r", ""))
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in _PORTS or not parts.hostname:
        return None
    host = parts.hostname.lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if " " in host or "<" in host or ">" in host:
        return None
    netloc = host if port is None or port == _PORTS[scheme] else f"{host}:{port}"
    if parts.username is not None:
        netloc = f"{parts.netloc.rpartition('@')[0]}@{netloc}"
    kept: list[str] = []
    steps = parts.path.replace("\\", "/").split("/")[1:] or [""]
    for i, step in enumerate(steps):
        plain = step.lower().replace("%2e", ".")
        if plain == "..":
            kept = kept[:-1]
        if plain in (".", ".."):
            if i == len(steps) - 1:
                kept.append("")
        else:
            kept.append(step)
    path = "/" + "/".join(kept)
    path = quote(path, safe="/%:@!$&'()*+,;=~-._[]|^\\")
    query = quote(parts.query, safe="/%:@!$&()*+,;=~-._?[]|^\\`{}")
    return urlunsplit((scheme, netloc, path, query, parts.fragment))


def drop_fragment(url: str) -> str:
    """The normal form without a fragment; what isn't a URL stays."""
    full = normalize(url)
    return url if full is None else full.partition("#")[0]


def resolve(base: str, href: str) -> str | None:
    """A link's target without fragment; None for what isn't an http(s) page."""
    href = href.strip()
    if not href or href.startswith("#") or href.lower().startswith(SKIPPED):
        return None
    try:
        joined = urljoin(base, href.replace("\\", "/"))
    except ValueError:
        return None
    full = normalize(joined)
    return None if full is None else full.partition("#")[0]


def join(base: str, href: str) -> str:
    """An address as it is found from a page, fragment included; what can't be joined stays."""
    try:
        joined = urljoin(base, href.strip().replace("\\", "/"))
    except ValueError:
        return href
    return normalize(joined) or joined


def same_site(a: str, b: str) -> bool:
    return a.removeprefix("www.") == b.removeprefix("www.")


@F.pandas_udf(T.StringType())
def norm_url(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else drop_fragment(u))


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else resolve(b, h) for b, h in zip(base, href)], dtype=object)


def strip_fragment(url: Column) -> Column:
    """The native fast path for URLs that are in normal form already."""
    return F.regexp_replace(url, "#.*$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site(url: Column) -> Column:
    """The host without a leading `www.`: equal sites are internal to each other."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def robots_path(url: Column) -> Column:
    """Path and query, at least `/`."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def glob(url: Column, pattern: str) -> Column:
    """Without `*` a substring; with it the parts in order, unanchored."""
    if "*" not in pattern:
        return url.contains(pattern)
    parts = [re.escape(p) for p in pattern.split("*")]
    return url.rlike("(?s)" + ".*".join(parts))


def url_filter(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Kept: some include pattern fits (or there is none) and no exclude pattern does."""
    keep = F.lit(not include)
    for p in include:
        keep = keep | glob(url, p)
    for p in exclude:
        keep = keep & ~glob(url, p)
    return keep


def excluded(url: Column, *, hosts: list[tuple[str, bool]] = (), paths: list[tuple[str, bool]] = ()) -> Column:
    """Some host or path rule fits; a rule is (value, is it a regular expression). Blank rules are ignored."""
    out = F.lit(False)
    for part, rules in ((host(url), hosts), (path(url), paths)):
        for value, regex in rules:
            if not value.strip():
                continue
            if regex:
                try:
                    re.compile(value)
                except re.error as e:
                    raise ValueError(f"bad filter expression {value!r}: {e}") from e
            out = out | (part.rlike(value) if regex else part.contains(value))
    return out


def is_asset(url: Column) -> Column:
    """The last path segment has the extension of an asset."""
    return F.lower(F.regexp_extract(path(url), r"\.([^./]*)$", 1)).isin(*ASSETS)


def slugify(text: Column) -> Column:
    """Everything but letters and digits as single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def report_id(started_ms: Column, seed: Column) -> Column:
    return F.concat_ws("-", started_ms.cast("string"), slugify(host(seed)))


def format_utc(ms: Column) -> Column:
    """`YYYY-MM-DD HH:MM UTC`; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm 'UTC'")
