"""What a finished crawl is asked for: whole results, reports, tables for display, new scores of saved crawls."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links as lk
from . import scores, triage
from .catalog import rank


# ---- new scores from stored signals ----
def recompute(pages: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, site): all derived scores anew from the stored signals and issues; pages have one row for each page_id.

    Pages get link_score, geo_score, a11y_score and seo_score; site is one row of health, geo and a11y. Doing it again
    changes nothing.
    """
    links = lk.page_links(pages)
    ranks = lk.pagerank(pages.select(F.col("page_id").alias("id")), lk.adjacency(links, lk.page_index(pages))).withColumnRenamed("id", "page_id")
    seo = scores.seo_scores(pages, issues).dropDuplicates(["url"])
    out = pages.drop("link_score", "seo_score").withColumns({"geo_score": scores.geo_score(), "a11y_score": scores.a11y_score()})
    out = out.join(ranks, "page_id", "left").join(seo, "url", "left").withColumn("link_score", F.coalesce("link_score", F.lit(0.0)))
    site = scores.health_score(out, issues).crossJoin(scores.site_scores(out))
    return out, site


def rescore_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The pages of a new crawl whose text is another than before, or that weren't there: those to score again."""
    seen = old.select(F.col("url").alias("_u"), F.col("content_hash").alias("_h"))
    return new.join(seen, (F.col("url") == F.col("_u")) & F.col("content_hash").eqNullSafe(F.col("_h")), "left_anti")


# ---- gates and totals ----
def fails_score(site: DataFrame, least: int, score: str = "health") -> bool:
    """The site's score is below a limit."""
    return site.first()[score] < least


def delta_totals(changes: DataFrame) -> DataFrame:
    """(change, issues, rules) of `issue_changes`."""
    return changes.groupBy("change").agg(F.sum("n").alias("issues"), F.count("*").alias("rules"))


def report_pair(crawls: DataFrame, a: str, b: str) -> tuple[str, str]:
    """The two crawl ids, the older first."""
    rows = crawls.where(F.col("crawl_id").isin(a, b)).orderBy("created_at", "crawl_id").select("crawl_id").collect()
    if len(rows) != 2:
        raise KeyError(f"{a!r} and {b!r} aren't two saved crawls")
    return rows[0][0], rows[1][0]


# ---- tables ----
def search_pages(pages: DataFrame, text: str = "", *, status: int | None = None, depth: int | None = None) -> DataFrame:
    """Pages whose url holds a text, in any case, of one status and depth if given."""
    out = pages.where(F.lower("url").contains(text.lower()))
    out = out if status is None else out.where(F.col("status") == status)
    return out if depth is None else out.where(F.col("depth") == depth)


def sort_pages(pages: DataFrame, by: str = "depth", descending: bool = False) -> DataFrame:
    return pages.orderBy(F.desc(by) if descending else F.asc(by), "url")


def page_with_issues(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Pages with an array of their own issues, the most severe first; an empty one if there are none."""
    one = F.struct((-rank(F.col("severity"))).alias("o"), "rule", "title", "category", "severity", "detail")
    own = issues.groupBy(F.col("url").alias("_u")).agg(F.array_sort(F.collect_list(one)).alias("issues"))
    return pages.join(own, F.col("url") == F.col("_u"), "left").drop("_u").withColumn("issues", F.coalesce(F.transform("issues", lambda x: x.dropFields("o")), F.array().cast(_ISSUES)))


_ISSUES = "array<struct<rule:string,title:string,category:string,severity:string,detail:string>>"


# ---- whole results ----
def result_json(config: dict, pages: DataFrame, issues: DataFrame, summary: dict, site: dict, least: str = "notice") -> Iterator[str]:
    """The pieces of the JSON document of a crawl; pages and issues stream through, so it may be of any length.

    site: robotsFound, sitemapUrls, sitemapFound, startedAt.
    """
    rows = lambda df: (("," if i else "") + r[0] for i, r in enumerate(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()))
    yield '{"config":' + json.dumps(config) + ',"pages":['
    yield from rows(pages)
    yield '],"issues":['
    yield from rows(triage.problems(issues, least))
    yield '],"summary":' + json.dumps(summary)
    for name in ("robotsFound", "sitemapUrls", "sitemapFound", "startedAt"):
        yield f',"{name}":{json.dumps(site.get(name))}'
    yield "}"


def text_report(url: str, site: dict, summary: dict, issues: DataFrame, *, found: dict | None = None, statuses: DataFrame | None = None, graph: dict | None = None, authorities: list[dict] = (), least: str = "notice") -> str:
    """The report for a terminal: scores, counts, what to fix first, status codes, link graph, issues by rule."""
    found = found or {}
    say = lambda x: "found" if found.get(x) else "none"
    out = [
        f"  {url}", f"  Health {site['health']}/100   GEO {site['geo']}/100   A11y {site['a11y']}/100",
        f"  {summary['pages']} pages · {summary['indexable']} indexable · {summary['duplicates']} duplicate", f"  {summary['errors']} errors · {summary['warnings']} warnings · {summary['notices']} notices",
        f"  robots.txt: {say('robots')} · sitemap: {say('sitemap')} · llms.txt: {say('llms')}", "",
    ]
    fixes = triage.top_fixes(issues).collect()
    for i, f in enumerate(fixes, 1):
        out += (["  Top fixes"] if i == 1 else []) + [f"    {i}. {f['title']} ({f['n']})", f"       → {truncate(f['how_to_fix'], 86)}"]
    if statuses is not None:
        out += ["", "  Status codes", *(f"    {r['key']:<6} {r['n']}" for r in statuses.orderBy("key").toLocalIterator())]
    if graph:
        out += ["", "  Link graph", f"    {graph['orphans']} orphans · {graph['dead_ends']} dead ends · {graph['reciprocal_pairs']} reciprocal pairs · max depth {graph['max_depth']}"]
        out += ["    Top authority", *(f"      {a['link_score']:>3.0f}  {truncate(a['url'], 58)}" for a in list(authorities)[:3])] if authorities else []
    groups = triage.group_issues(triage.problems(issues, least), 1).collect()  # a row for each rule
    out += ["", "  Issues", *(f"    [{r['severity'][0].upper()}] {r['title']:<30} {r['n']}" for r in groups)] if groups else ["", "  No issues found"]
    return "\n".join(out)


def crawl_payload(pages: DataFrame, issues: DataFrame, site: DataFrame, graph: DataFrame | None = None) -> dict:
    """What a tool that asks for a crawl gets: scores, summary, first fixes, gaps, issues by rule, status codes, the graph's numbers."""
    one = lambda df: df.first().asDict()
    return {
        "scores": one(site), "summary": one(scores.summary(pages, issues)), "topFixes": [r.asDict() for r in triage.top_fixes(issues, 8).collect()],
        "geoGaps": one(scores.geo_gaps(pages)), "issuesByRule": [r.asDict() for r in triage.group_issues(issues, 15).toLocalIterator()],
        "byStatus": {r["key"]: r["n"] for r in scores.histogram(pages, "status").collect()}, "byDepth": {r["key"]: r["n"] for r in scores.histogram(pages, "depth").collect()}, "linkGraph": one(graph) if graph is not None else None,
    }


# ---- display ----
def truncate(text: str, most: int) -> str:
    return text if len(text) <= most else f"{text[:most]}…"


def wrap(text: str, width: int = 76) -> str:
    """Words in lines of a width, further lines indented by two spaces; lengths in bytes."""
    out, used = "", 0
    for word in text.split():
        n = len(word.encode())
        if used + n + 1 > width:
            out, used = out + "\n  ", 0
        elif used:
            out, used = out + " ", used + 1
        out, used = out + word, used + n
    return out


def csv_field(text: str) -> str:
    quoted = text.replace('"', '""')
    return f'"{quoted}"' if any(c in text for c in ',"\n') else text


def status_class(status: int) -> str:
    return "status-0" if status == 0 else f"status-{min(5, max(2, status // 100))}xx"


def status_label(status: int) -> str:
    return "ERR" if status == 0 else str(status)


def milliseconds(n: int) -> str:
    return f"{n}ms" if n < 1000 else f"{n / 1000:.{0 if n >= 10_000 else 1}f}s"


def size(n: int) -> str:
    return f"{n / 1_048_576:.1f} MB" if n >= 1_000_000 else f"{int(n / 1024 + 0.5)} KB" if n >= 1000 else f"{n} B"


def short_url(url: str) -> str:
    """Path and query, or the host for a start page."""
    p = urlsplit(url)
    if not p.scheme or not p.netloc:
        return url
    rest = (p.path or "/") + (f"?{p.query}" if p.query else "")
    return p.netloc if rest == "/" else rest
