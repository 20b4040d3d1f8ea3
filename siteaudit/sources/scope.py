"""What a crawl covers: its seeds by mode, the host they lead to, and the frontier."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import links

MODES = ("site", "page", "list")


@dataclass(frozen=True)
class Scope:
    """Seeds in normal form, their host, and the depth that links are followed to (0: not at all)."""

    seeds: tuple[str, ...]
    host: str
    max_depth: int
    redirected_from: str | None = None


def plan(mode: str, url: str = "", listed: list[str] = (), max_depth: int = 16) -> Scope:
    """`site` follows links from the url, `page` takes the url alone, `list` the listed urls alone (the url if there are none)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    given = list(listed) if mode == "list" and listed else [url]
    first = urls.normalize(given[0])
    if first is None:
        raise ValueError(f"{given[0]!r} is no http or https url with a host")
    seeds = dict.fromkeys(urls.drop_fragment(u) for u in given if urls.normalize(u))
    return Scope(tuple(seeds), urlsplit(first).hostname or "", max_depth if mode == "site" else 0)


def rebase(scope: Scope, final_url: str) -> Scope:
    """The scope on the host that its first seed leads to, if that is another one."""
    host = urlsplit(final_url).hostname or ""
    if not host or host.lower() == scope.host.lower():
        return scope
    return Scope((urls.drop_fragment(final_url), *scope.seeds[1:]), host, scope.max_depth, scope.seeds[0])


def frontier(pages: DataFrame, scope: Scope, max_pages: int | None = 500) -> DataFrame:
    """(id, depth) of the pages that the scope reaches over internal links, `max_pages` at most."""
    index = links.page_index(pages)
    seeds = index.where(F.col("key").isin(*scope.seeds)).select("id").orderBy("id")
    start = [r["id"] for r in seeds.collect()]  # at most a row for each seed
    return links.depths(links.adjacency(links.page_links(pages), index), start, scope.max_depth, max_pages)
