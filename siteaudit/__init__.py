"""Site-audit analytics on Spark: pages, links, issues, scores, rule packs, saved crawls."""

from .functions.html import Extractor, extract, parse_html
from .operators.audit import audit, page_issues
from .operators.catalog import rule_table
from .operators.links import adjacency, broken_links, inlink_counts, page_links, pagerank, status_map
from .operators.result import crawl_payload, delta_totals, recompute, result_json, text_report
from .operators.scores import geo_gaps, health_score, seo_scores, site_scores, summary
from .operators.store import CrawlStore, issue_changes, page_changes, score_changes
from .operators.triage import group_issues, top_fixes
from .packs.language import built_in, parse_pack, score_texts
from .sources.responses import build_pages
from .sources.robots import Robots
from .sources.scope import Scope, frontier, plan, rebase

__all__ = [
    "CrawlStore", "Extractor", "Robots", "Scope", "adjacency", "audit", "broken_links", "build_pages", "built_in", "crawl_payload", "delta_totals", "extract", "frontier", "geo_gaps", "group_issues", "health_score",
    "inlink_counts", "issue_changes", "page_changes", "page_issues", "page_links", "pagerank", "parse_html", "parse_pack", "plan", "rebase", "recompute", "result_json", "rule_table", "score_changes", "score_texts",
    "seo_scores", "site_scores", "status_map", "summary", "text_report", "top_fixes",
]
