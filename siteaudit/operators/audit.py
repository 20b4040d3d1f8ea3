"""The audit: one pass over pages with facts, one array of candidate issues a page.

Each rule is a test and a detail; the gates (no answer, not 200, not HTML, not
indexable) are boolean columns made once. Only facts that need other pages (inlinks,
duplicates, broken links) come from joins before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import BY_RULE
from .scores import html_page

# Thresholds of the rules.
SLOW_MS, LARGE_BYTES, TITLE_MIN, TITLE_MAX, DESC_MIN, DESC_MAX = 2000, 2_000_000, 30, 60, 70, 160
THIN_WORDS, TEXT_RATIO, JS_WORDS, DEEP, COMPRESS_BYTES, GEO_READY, GEO_WORDS, GEO_THIN = 200, 0.08, 100, 4, 4096, 70, 50, 300
_ISSUE = ("rule", "title", "category", "severity")


def issue(rule: str, detail: Column | None = None) -> Column:
    """The fields of an issue of a rule."""
    _, title, category, severity, *_ = BY_RULE[rule]
    parts = [F.lit(v).alias(n) for n, v in zip(_ISSUE, (rule, title, category, severity))]
    return F.struct(*parts, (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _text(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def with_duplicates(pages: DataFrame) -> DataFrame:
    """Adds title_duplicate and description_duplicate: another 200 page has the same non-empty text."""
    for column, name in (("title", "title_duplicate"), ("meta_description", "description_duplicate")):
        key = F.when((F.col("status") == 200) & (F.col(column) != ""), F.col(column))
        shared = pages.where(key.isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k", F.lit(True).alias(name))
        pages = pages.join(shared, F.col(column) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(False)))
    return pages


def first_of_content(pages: DataFrame) -> DataFrame:
    """Adds duplicate_of: the url of the first page with the same content hash, for pages of any other url."""
    first = pages.where(F.col("content_hash").isNotNull()).groupBy(F.col("content_hash").alias("_h")).agg(F.min(F.struct("page_id", "url")).alias("_f"), F.count("*").alias("_n")).where("_n > 1")
    out = pages.join(first, F.col("content_hash") == F.col("_h"), "left")
    return out.withColumn("duplicate_of", F.when(F.col("_f.url") != F.col("url"), F.col("_f.url"))).drop("_h", "_f", "_n")


def rules() -> list[tuple[str, Column, Column | None]]:
    """(rule, test, detail) of all rules that look at one page's facts."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    answered, ok = c("status") != 0, c("status") == 200
    html = ok & html_page()
    shown = html & c("indexable")
    title_len, desc_len = F.length("title"), F.length("meta_description")
    no_title, no_desc = ~yes(c("title") != ""), ~yes(c("meta_description") != "")
    secure = ~c("final_url").startswith("http://")
    geo = shown & (c("word_count") > GEO_WORDS)
    weak = geo & (c("geo_score") < GEO_READY)
    meta_noindex = yes(c("meta_robots").contains("noindex"))
    lang2 = F.substring(c("lang"), 1, 2)
    paired = F.exists("hreflang_langs", lambda h: (F.lower(h) == "x-default") | yes(F.lower(h).startswith(F.lower(lang2))))
    return [
        ("connection-error", ~answered, c("error")),
        ("server-error", answered & (c("status") >= 500), c("status")),
        ("client-error", answered & c("status").between(400, 499), c("status")),
        ("redirect", answered & c("status").between(300, 399), c("status")),
        ("redirect-chain", answered & (c("hops") > 1), _text("%d hops", c("hops"))),
        ("slow-response", ok & (c("response_time_ms") > SLOW_MS), _text("%d ms", c("response_time_ms"))),
        ("title-missing", html & no_title, None),
        ("title-too-long", html & yes(title_len > TITLE_MAX), _text("%d chars", title_len)),
        ("title-too-short", html & ~no_title & yes(title_len < TITLE_MIN), _text("%d chars", title_len)),
        ("title-duplicate", html & ~no_title & c("title_duplicate"), None),
        ("description-missing", html & no_desc, None),
        ("description-too-long", html & yes(desc_len > DESC_MAX), _text("%d chars", desc_len)),
        ("description-too-short", html & ~no_desc & yes(desc_len < DESC_MIN), _text("%d chars", desc_len)),
        ("description-duplicate", html & ~no_desc & c("description_duplicate"), None),
        ("h1-missing", html & (c("h1_count") == 0), None),
        ("h1-multiple", html & (c("h1_count") > 1), _text("%d H1s", c("h1_count"))),
        ("noindex", html & meta_noindex, None),
        ("nofollow", html & yes(c("meta_robots").contains("nofollow")), None),
        ("x-robots-noindex", html & ~meta_noindex & yes(F.lower("x_robots_tag").contains("noindex")), c("x_robots_tag")),
        ("canonical-missing", html & c("canonical").isNull(), None),
        ("canonicalised", html & c("canonicalized"), c("canonical")),
        ("image-missing-alt", html & (c("images_missing_alt") > 0), _text("%d of %d images", c("images_missing_alt"), c("images_total"))),
        ("thin-content", html & (c("word_count") < THIN_WORDS), _text("%d words", c("word_count"))),
        ("content-requires-js", html & c("rendered") & (c("word_count") >= JS_WORDS) & (c("pre_render_word_count") * 3 < c("word_count")), _text("Only %d%% of content (%d of %d words) is in the raw HTML; the rest needs JavaScript", F.floor(c("pre_render_word_count") * 100 / F.greatest(c("word_count"), F.lit(1))), c("pre_render_word_count"), c("word_count"))),
        ("large-page", html & (c("size_bytes") > LARGE_BYTES), _text("%d KB", F.floor(c("size_bytes") / 1024))),
        ("duplicate-content", html & c("duplicate_of").isNotNull(), c("duplicate_of")),
        ("low-text-ratio", html & (c("text_ratio") > 0) & (c("text_ratio") < TEXT_RATIO) & (c("word_count") < THIN_WORDS), _text("%s%%", F.bround(c("text_ratio") * 100).cast("int").cast("string"))),
        ("orphan", html & (c("inlinks") == 0) & (c("depth") > 0), None),
        ("dead-end", html & c("indexable") & (c("n_internal") == 0), None),
        ("deep-page", html & (c("depth") > DEEP), _text("%d clicks from home", c("depth"))),
        ("no-compression", html & c("content_encoding").isNull() & (c("size_bytes") > COMPRESS_BYTES), None),
        ("not-secure", html & ~secure, None),
        ("mixed-content", html & secure & (c("mixed_content") > 0), _text("%d resource(s)", c("mixed_content"))),
        ("no-hsts", html & secure & ~c("hsts"), None),
        ("viewport-missing", html & ~c("has_viewport"), None),
        ("lang-missing", html & c("lang").isNull(), None),
        ("hreflang-incomplete", html & (F.size("hreflang_langs") > 0) & ~paired, None),
        ("a11y-link-no-text", html & (c("links_no_text") > 0), _text("%d of %d links", c("links_no_text"), c("links_total"))),
        ("a11y-button-no-text", html & (c("buttons_no_text") > 0), _text("%d button(s)", c("buttons_no_text"))),
        ("a11y-input-no-label", html & (c("inputs_no_label") > 0), _text("%d of %d controls", c("inputs_no_label"), c("controls_total"))),
        ("a11y-zoom-disabled", html & c("viewport_blocks_zoom"), None),
        ("a11y-iframe-no-title", html & (c("iframes_no_title") > 0), _text("%d iframe(s)", c("iframes_no_title"))),
        ("a11y-positive-tabindex", html & (c("positive_tabindex") > 0), _text("%d element(s)", c("positive_tabindex"))),
        ("a11y-skipped-heading", html & c("skipped_heading"), None),
        ("og-missing", shown & c("og_title").isNull(), None),
        ("twitter-missing", shown & c("twitter_card").isNull(), None),
        ("structured-data-missing", shown & (c("n_schema_types") == 0), None),
        ("structured-data-invalid", shown & (c("invalid_jsonld") > 0), _text("%d block(s)", c("invalid_jsonld"))),
        ("geo-ready", geo & (c("geo_score") >= GEO_READY), _text("%d/100", c("geo_score"))),
        ("geo-no-structured-data", weak & ~c("structured_data"), None),
        ("geo-not-answerable", weak & ~c("answerable"), None),
        ("geo-no-author", weak & ~c("has_author"), None),
        ("geo-no-semantic-html", weak & ~c("semantic_html"), None),
        ("geo-thin-for-ai", weak & (c("word_count") < GEO_THIN), _text("%d words", c("word_count"))),
    ]


#: Facts that a page table may lack, and what they are then.
DEFAULTS = {
    "error": "string", "hops": 0, "x_robots_tag": "string", "canonicalized": False, "rendered": False, "pre_render_word_count": 0, "duplicate_of": "string", "inlinks": 0, "content_encoding": "string",
    "hsts": False, "og_title": "string", "twitter_card": "string", "hreflang_langs": "array<string>", "schema_validations": "array<struct<type_name:string,missing_required:array<string>,missing_recommended:array<string>>>",
}


def page_issues(pages: DataFrame) -> DataFrame:
    """(url, rule, title, category, severity, detail) of all rules on single pages; pages as from `pages.facts`."""
    for name, kind in DEFAULTS.items():
        if name not in pages.columns:
            value = F.lit(None).cast(kind) if kind == "string" else F.array().cast(kind) if isinstance(kind, str) else F.lit(kind)
            pages = pages.withColumn(name, value)
    if "title_duplicate" not in pages.columns:
        pages = with_duplicates(pages)
    ok = (F.col("status") == 200) & html_page() & F.col("indexable")
    found = [F.when(test, issue(rule, detail)) for rule, test, detail in rules()]
    each = F.filter(F.array(*found), lambda x: x.isNotNull())
    # One issue for each schema item that lacks something.
    for rule, lacks in (("schema-missing-required", "missing_required"), ("schema-missing-recommended", "missing_recommended")):
        items = F.filter("schema_validations", lambda v: F.size(v[lacks]) > 0)
        more = F.transform(items, lambda v: issue(rule, F.concat(v["type_name"], F.lit(": missing "), F.array_join(v[lacks], ", "))))
        each = F.concat(each, F.when(ok, more).otherwise(F.slice(more, 1, 0)))
    return pages.select("url", F.inline(each)).select("url", *_ISSUE, "detail")


def site_issues(seed: str, *, robots_found: bool, sitemap_found: bool, llms_txt_found: bool) -> list[tuple[str, str]]:
    """(rule, url) of what the site as a whole lacks."""
    have = (("no-robots-txt", robots_found), ("no-sitemap", sitemap_found), ("geo-no-llms-txt", llms_txt_found))
    return [(rule, seed) for rule, found in have if not found]


def rule_rows(df: DataFrame, rule: str, detail: Column | None = None) -> DataFrame:
    """Issues of one rule for each row's url."""
    return df.select("url", issue(rule, detail).alias("i")).select("url", "i.*")


def audit(pages: DataFrame, *, broken: DataFrame | None = None, blocked: DataFrame | None = None, site: list[tuple[str, str]] = ()) -> DataFrame:
    """All issues: single pages, broken links (url, link, status), blocked links (url) and the site as a whole."""
    out = page_issues(pages)
    if broken is not None:
        code = F.when(F.col("status") == 0, F.lit("ERR")).otherwise(F.col("status").cast("string"))
        out = out.unionByName(rule_rows(broken, "broken-link", F.concat(code, F.lit(" → "), F.col("link"))))
    if blocked is not None:
        out = out.unionByName(rule_rows(blocked, "blocked-by-robots"))
    for rule, url in site:
        out = out.unionByName(rule_rows(pages.sparkSession.createDataFrame([(url,)], "url string"), rule))
    return out


def heading_jumps(headings: DataFrame) -> DataFrame:
    """(page_id, skipped) from (page_id, pos, level): some heading is over one level below the one before."""
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))
    return headings.withColumn("b", before).groupBy("page_id").agg(F.coalesce(F.max(F.col("level") > F.col("b") + 1), F.lit(False)).alias("skipped"))
