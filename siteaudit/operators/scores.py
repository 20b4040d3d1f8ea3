"""Scores of pages and sites, summaries and gap counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .catalog import label

# Weights of the readiness signals, accessibility penalties and severities.
GEO_WEIGHTS = (("structured_data", 20), ("semantic_html", 12), ("answerable", 18), ("has_author", 10), ("has_date", 8), ("faq_schema", 8))
SEO_PENALTY = {"error": 15.0, "warning": 7.0, "notice": 2.0}
HEALTH_WEIGHT = {"error": 3.0, "warning": 1.0, "notice": 0.25}
_APART = ("geo", "accessibility")


def html_page(status_gate: bool = False) -> Column:
    """The page has HTML content; with the gate only if its status is 200."""
    html = F.coalesce(F.col("content_type").contains("html"), F.lit(False)) | (F.col("h1_count") > 0) | (F.col("word_count") > 0)
    return (F.col("status") == 200) & html if status_gate else html


def geo_score() -> Column:
    total = F.lit(0)
    for name, points in GEO_WEIGHTS:
        total = total + F.when(F.col(name), points).otherwise(0)
    for name in ("question_headings", "structured_blocks"):
        total = total + F.when(F.col(name) > 0, 8).otherwise(0)
    total = total + F.when(F.col("word_count") >= 300, 8).otherwise(0)
    return F.when(F.col("status") == 200, F.least(total, F.lit(100))).otherwise(0)


def a11y_score() -> Column:
    part = lambda bad, all_: F.when(F.col(all_) > 0, F.col(bad) / F.col(all_)).otherwise(0.0)
    lost = 25.0 * part("links_no_text", "links_total") + 25.0 * part("inputs_no_label", "controls_total") + 15.0 * part("buttons_no_text", "buttons_total")
    for test, points in ((F.col("viewport_blocks_zoom"), 15.0), (F.col("iframes_no_title") > 0, 8.0), (F.col("positive_tabindex") > 0, 6.0), (F.col("skipped_heading"), 6.0)):
        lost = lost + F.when(test, points).otherwise(0.0)
    return F.when(html_page(True), F.round(F.greatest(F.lit(0.0), 100.0 - lost)).cast("int")).otherwise(0)


def _weighted(weights: dict[str, float]) -> Column:
    w = F.lit(0.0)
    for severity, points in weights.items():
        w = F.when(F.col("severity") == severity, points).otherwise(w)
    return F.when(F.col("category").isin(*_APART), 0.0).otherwise(w)


def health_score(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: health, 0 to 100."""
    n = pages.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    weight = issues.agg(F.coalesce(F.sum(_weighted(HEALTH_WEIGHT)), F.lit(0.0)).alias("w"))
    score = F.greatest(F.lit(0.0), F.round(100.0 - F.least(F.col("w") / F.col("n") * 12.0, F.lit(100.0))))
    return n.crossJoin(weight).select(score.cast("int").alias("health"))


def seo_scores(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(url, seo_score): 100 less the penalties of the page's issues, 0 for any status but 200; readiness and accessibility have scores of their own.

    Issues meet pages by the normal form of their urls. Penalties are summed by the url as it is written, so only one row
    for each is normalised.
    """
    lost = issues.groupBy("url").agg(F.sum(_weighted(SEO_PENALTY)).alias("lost"))
    lost = lost.groupBy(urls.norm_url("url").alias("_key")).agg(F.sum("lost").alias("lost"))
    out = pages.select("url", "status", urls.norm_url("url").alias("_key")).join(lost, "_key", "left")
    score = F.round(F.greatest(F.lit(0.0), 100.0 - F.coalesce("lost", F.lit(0.0)))).cast("int")
    return out.select("url", F.when(F.col("status") == 200, score).otherwise(0).alias("seo_score"))


def site_scores(pages: DataFrame) -> DataFrame:
    """One row: floor averages of readiness (200 and indexable) and accessibility (HTML)."""
    ready, html = (F.col("status") == 200) & F.col("indexable"), html_page(True)
    mean = lambda c, when: F.coalesce(F.floor(F.sum(F.when(when, c)) / F.sum(F.when(when, 1))), F.lit(0)).cast("int")
    return pages.agg(mean(F.col("geo_score"), ready).alias("geo"), mean(F.col("a11y_score"), html).alias("a11y"))


def geo_gaps(pages: DataFrame) -> DataFrame:
    """One row of counts over indexable pages of over 50 words."""
    p = pages.where((F.col("status") == 200) & F.col("indexable") & (F.col("word_count") > 50))
    lacks = {"missing_author": ~F.col("has_author"), "missing_date": ~F.col("has_date"), "no_structured_data": ~F.col("structured_data"), "no_semantic_html": ~F.col("semantic_html"), "not_answerable": ~F.col("answerable"), "no_question_headings": F.col("question_headings") == 0, "thin": F.col("word_count") < 300}
    return p.agg(F.count("*").alias("pages"), *(F.count_if(t).alias(n) for n, t in lacks.items()))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "notice", "good")))


def summary(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: page counts, the mean response time of 200 pages (whole ms) and the severity counts."""
    ok = F.col("status") == 200
    p = pages.agg(
        F.count("*").alias("pages"), F.count_if(F.col("indexable")).alias("indexable"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"),
        F.coalesce(F.floor(F.sum(F.when(ok, F.col("response_time_ms"))) / F.count_if(ok)), F.lit(0)).cast("long").alias("avg_response_ms"),
    )
    return p.crossJoin(severity_counts(issues))


def by_category(issues: DataFrame) -> DataFrame:
    """Problems by category label."""
    return issues.where("severity <> 'good'").groupBy(label(F.col("category")).alias("key")).agg(F.count("*").alias("n"))
