"""Queries over crawled pages: parsing, links, the audit, scores, triage, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as hx
from ..functions import urls
from ..operators import audit, catalog, links, scores, store, triage
from ..operators.cuts import cut, spread
from ..sources import responses, robots
from .registry import query, spread_table, table, views

CRAWL = responses.CRAWL_SQL.format(encoded="encode(html)")


def _q(text: str) -> str:
    return text.replace("'", "''")


# ---- HTML and URLs ----
_TITLE = r"regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\s+', ' ', 'g')"


def _plain(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


_BODY = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*)$', 1, 's'), '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g')"
_VISIBLE = r"trim(regexp_replace(" + _plain(_BODY) + r", '\s+', ' ', 'g'))"
_HREFS = r"list_distinct(list_filter(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda h: h <> '' AND NOT starts_with(h, '#')))"


@query("page_titles", f"SELECT page_id, nullif({_plain(_TITLE)}, '') AS title FROM pages")
def page_titles(spark, sf_dir):
    p = spread_table(spark, sf_dir, "pages")
    return p.select("page_id", hx.parse_html("url", "html").alias("s")).select("page_id", "s.title")


@query("page_parse", f"SELECT page_id, nullif({_plain(_TITLE)}, '') AS title, len(regexp_extract_all(html, '<h1>')) AS n_h1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS word_count, round(least(1.0, CAST(octet_length(encode(t)) AS DOUBLE) / octet_length(encode(html))), 6) AS text_ratio FROM (SELECT *, {_VISIBLE} AS t FROM pages)")
def page_parse(spark, sf_dir):
    s = spread_table(spark, sf_dir, "pages").select("page_id", hx.parse_html("url", "html").alias("s"))
    return s.select("page_id", "s.title", F.size("s.h1").cast("long").alias("n_h1"), "s.lang", F.col("s.word_count").cast("long").alias("word_count"), F.round("s.text_ratio", 6).alias("text_ratio"))


@query("page_text", f"SELECT page_id, sha256({_VISIBLE}) AS text_sha256 FROM pages")
def page_text(spark, sf_dir):
    s = spread_table(spark, sf_dir, "pages").select("page_id", hx.parse_html("url", "html").alias("s"))
    return s.select("page_id", F.sha2("s.text", 256).alias("text_sha256"))


@query("link_extract", r"SELECT page_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda h: h <> '' AND NOT starts_with(h, '#')), lambda h: regexp_replace(h, '#.*$', '')))) AS n_links FROM pages")
def link_extract(spark, sf_dir):
    """Distinct raw link targets by native expressions, the fast path where no full parse is needed."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    kept = F.filter(hrefs, lambda h: (h != "") & ~h.startswith("#"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(F.transform(kept, lambda h: F.regexp_replace(h, "#.*$", "")))).cast("long").alias("n_links"))


_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"


#: Links as they are parsed: entities resolved, fragments cut, non-ASCII letters encoded, each once a page (all of them start at the root of their site).
_ENCODED = "array_to_string(list_transform(string_split(regexp_replace(" + _plain("h") + ", '#.*$', ''), ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')"
PARSED_LINKS = rf"""
SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS pos
FROM (SELECT page_id, url, i, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_ENCODED} AS link
      FROM (SELECT page_id, url, unnest(hs) AS h, unnest(generate_series(1, len(hs))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages))
      WHERE h <> '' AND NOT starts_with(h, '#'))
GROUP BY page_id, url, link
"""


@query("parsed_links", f"SELECT page_id, CAST(pos AS INT) AS pos, link, true AS internal FROM ({PARSED_LINKS})")
def parsed_links(spark, sf_dir):
    s = spread_table(spark, sf_dir, "pages").select("page_id", "url", hx.parse_html("url", "html").alias("s")).select("page_id", "url", "s.internal_links", "s.external_links")
    return links.page_links(s).select("page_id", "pos", "link", "internal")


@query("internal_external_split", f"SELECT p.page_id, CAST(count(link) AS INT) AS internal, CAST(0 AS INT) AS external FROM pages p LEFT JOIN ({PARSED_LINKS}) l ON l.page_id = p.page_id GROUP BY p.page_id")
def internal_external_split(spark, sf_dir):
    s = spread_table(spark, sf_dir, "pages").select("page_id", hx.parse_html("url", "html").alias("s"))
    return s.select("page_id", F.size("s.internal_links").alias("internal"), F.size("s.external_links").alias("external"))


@query("url_parts", rf"SELECT page_id, {_HOST} AS host, regexp_replace({_HOST}, '^www\.', '') AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(url, '#.*$', '') AS plain FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.site(u).alias("site"), urls.path(u).alias("path"), urls.strip_fragment(u).alias("plain"))


@query("url_filters", "SELECT page_id, contains(" + _HOST + ", 'blog.') OR regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/(de|fr)/[0-9]+$') AS excluded FROM pages")
def url_filters(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.excluded(F.col("url"), hosts=[("blog.", False), (" ", False)], paths=[("^/(de|fr)/[0-9]+$", True)]).alias("excluded"))


@query("glob_filters", "SELECT page_id, url FROM pages WHERE (regexp_matches(url, 'https.*/en/') OR contains(url, '/es/')) AND NOT contains(url, 'page=') ")
def glob_filters(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(urls.url_filter(F.col("url"), ["https*/en/", "/es/"], ["page="])).select("page_id", "url")


@query("asset_filter", "SELECT page_id, lower(regexp_extract(regexp_extract(url || '.PNG', '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.([^./]*)$', 1)) IN ('png', 'css', 'json') AS asset FROM pages".replace("\\\\", "\\"))
def asset_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.is_asset(F.concat("url", F.lit(".PNG"))).alias("asset"))


@query("slugs", rf"SELECT page_id, CAST(page_id * 1000 AS VARCHAR) || '-' || regexp_replace(regexp_replace({_HOST}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS id, strftime(make_timestamp(page_id * 86400000 * 1000), '%Y-%m-%d %H:%M UTC') AS day FROM pages")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.report_id(F.col("page_id") * 1000, F.col("url")).alias("id"), urls.format_utc(F.col("page_id") * 86_400_000).alias("day"))


_ROBOTS = ((False, "/de/"), (True, "/de/1"), (False, "/fr/*7"), (False, "/en/*page="), (True, "/en/2"))
_RPATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)"
_RTESTS = ", ".join(f"CASE WHEN regexp_matches(p, '^{pat.replace('*', '.*')}') THEN {{'n': {len(pat)}, 'o': {-i}, 'allow': {str(allow).lower()}}} END" for i, (allow, pat) in enumerate(_ROBOTS))


@query("robots_allowed", f"SELECT page_id, coalesce(list_max(list_filter([{_RTESTS}], lambda x: x IS NOT NULL)).allow, true) AS allowed FROM (SELECT page_id, {_RPATH} AS p FROM pages)")
def robots_allowed(spark, sf_dir):
    text = "User-agent: *\n" + "".join(f"{'Allow' if a else 'Disallow'}: {p}\n" for a, p in _ROBOTS)
    paths = table(spark, sf_dir, "pages").select("page_id", urls.robots_path(F.col("url")).alias("path"))
    return robots.allowed_paths(paths, robots.parse(text, "any/1.0")).select("page_id", "allowed")


@query("sitemap_locs", "SELECT DISTINCT url AS loc FROM pages")
def sitemap_locs(spark, sf_dir):
    """Sitemap files made of the page urls, 100 each, and parsed again."""
    p = table(spark, sf_dir, "pages")
    esc = F.replace("url", F.lit("&"), F.lit("&amp;"))
    files = p.groupBy(F.floor(F.col("page_id") / 100).alias("f")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), esc, F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    return files.select(F.explode(responses.sitemap_urls(F.col("xml"))).alias("loc")).distinct()


@query("regex_extraction", r"SELECT page_id, list_slice(list_filter(regexp_extract_all(html, '<a href=\"/([a-z]+)\"', 1), lambda v: v <> ''), 1, 50) AS found FROM pages WHERE regexp_matches(html, '<a href=\"/([a-z]+)\"')")
def regex_extraction(spark, sf_dir):
    found = F.filter(F.slice(F.regexp_extract_all("html", F.lit('<a href="/([a-z]+)"'), F.lit(1)), 1, 50), lambda v: v != "")
    return table(spark, sf_dir, "pages").select("page_id", found.alias("found")).where(F.size("found") > 0)


@query("extraction_pivot", rf"SELECT url, coalesce(nullif({_plain(_TITLE)}, ''), '') AS heading, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language FROM ({CRAWL}) WHERE status = 200")
def extraction_pivot(spark, sf_dir):
    made = hx.extract([hx.Extractor("heading", css="head > title"), hx.Extractor("language", css="html", attr="lang")])
    return store.extraction_table(responses.crawl(spark, sf_dir).withColumn("extractions", made("html")), ["heading", "language"])


# ---- facts of a crawl, in SQL that both engines read alike ----
FACTS = r"""
SELECT page_id, url, CASE WHEN page_id % 9 = 4 THEN replace(url, 'https://', 'http://') ELSE url END AS final_url,
       CASE page_id % 20 WHEN 0 THEN 404 WHEN 7 THEN 500 WHEN 11 THEN 0 WHEN 13 THEN 302 ELSE 200 END AS status, CASE WHEN page_id % 20 = 11 THEN 'timed out' END AS error,
       CAST(page_id % 4 AS INT) AS hops, CAST(page_id % 6 AS INT) AS depth, (page_id * 37) % 4000 AS response_time_ms, (page_id * 77777) % 3000000 AS size_bytes,
       CASE WHEN page_id % 17 <> 5 THEN 'text/html' ELSE 'image/png' END AS content_type, CAST(CASE WHEN page_id % 17 = 5 THEN 0 ELSE page_id % 3 END AS INT) AS h1_count, CAST(CASE WHEN page_id % 17 = 5 THEN 0 ELSE (page_id * 13) % 700 END AS INT) AS word_count,
       CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Title shared by several pages of the site' WHEN 3 THEN 'Short' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
       CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'One description' ELSE repeat('d', CAST(page_id % 200 AS INT)) END AS meta_description,
       CASE page_id % 10 WHEN 3 THEN 'noindex, nofollow' WHEN 4 THEN 'nofollow' END AS meta_robots, CASE WHEN page_id % 8 = 3 THEN 'NoIndex' END AS x_robots_tag,
       CASE WHEN page_id % 3 = 1 THEN url END AS canonical, page_id % 6 = 1 AS canonicalized, CAST(page_id % 5 AS INT) AS images_total, CAST(page_id % 5 - page_id % 2 AS INT) AS images_missing_alt,
       page_id % 2 = 0 AS rendered, CAST((page_id * 7) % 300 AS INT) AS pre_render_word_count, CASE WHEN page_id % 12 = 5 THEN 'https://example.com/first' END AS duplicate_of, CAST(page_id % 40 AS DOUBLE) / 250 AS text_ratio,
       page_id % 3 AS inlinks, page_id % 4 <> 3 AS indexable, CAST(page_id % 4 AS INT) AS n_internal, CASE WHEN page_id % 2 = 0 THEN 'gzip' END AS content_encoding, CAST(page_id % 3 AS INT) AS mixed_content, page_id % 3 = 0 AS hsts,
       page_id % 2 = 1 AS has_viewport, CASE WHEN page_id % 4 <> 2 THEN 'en-GB' END AS lang, split(CASE page_id % 4 WHEN 0 THEN 'de,fr' WHEN 1 THEN 'EN,de' WHEN 2 THEN 'de,es' ELSE 'x-default' END, ',') AS hreflang_langs,
       CAST(page_id % 4 AS INT) AS links_no_text, CAST(page_id % 4 + 3 AS INT) AS links_total, CAST(page_id % 3 AS INT) AS buttons_no_text, CAST(page_id % 3 + 1 AS INT) AS buttons_total, CAST(page_id % 2 AS INT) AS inputs_no_label, CAST(page_id % 2 + 2 AS INT) AS controls_total,
       page_id % 5 = 2 AS viewport_blocks_zoom, CAST(page_id % 7 % 2 AS INT) AS iframes_no_title, CAST(page_id % 11 % 2 AS INT) AS positive_tabindex, page_id % 6 = 4 AS skipped_heading,
       CASE WHEN page_id % 2 = 0 THEN '' END AS og_title, CASE WHEN page_id % 3 = 0 THEN 'summary' END AS twitter_card, CAST(page_id % 3 AS INT) AS n_schema_types, CAST(page_id % 5 % 2 AS INT) AS invalid_jsonld,
       page_id % 3 > 0 AS structured_data, page_id % 4 > 0 AS semantic_html, page_id % 5 > 0 AS answerable, page_id % 6 > 2 AS has_author, page_id % 7 > 2 AS has_date, page_id % 8 > 5 AS faq_schema, page_id % 4 AS question_headings, page_id % 3 AS structured_blocks
FROM pages
"""
_GEO = "CASE WHEN status = 200 THEN " + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in [("structured_data", 20), ("semantic_html", 12), ("answerable", 18), ("has_author", 10), ("has_date", 8), ("faq_schema", 8), ("question_headings > 0", 8), ("structured_blocks > 0", 8), ("word_count >= 300", 8)]) + " ELSE 0 END"
_HTML = "(contains(coalesce(content_type, ''), 'html') OR h1_count > 0 OR word_count > 0)"
_A11Y = f"CASE WHEN status = 200 AND {_HTML} THEN CAST(round(greatest(0, 100.0::DOUBLE - (CASE WHEN links_total > 0 THEN 25.0::DOUBLE * (links_no_text / links_total) ELSE 0 END + CASE WHEN controls_total > 0 THEN 25.0::DOUBLE * (inputs_no_label / controls_total) ELSE 0 END + CASE WHEN buttons_total > 0 THEN 15.0::DOUBLE * (buttons_no_text / buttons_total) ELSE 0 END + CASE WHEN viewport_blocks_zoom THEN 15 ELSE 0 END + CASE WHEN iframes_no_title > 0 THEN 8 ELSE 0 END + CASE WHEN positive_tabindex > 0 THEN 6 ELSE 0 END + CASE WHEN skipped_heading THEN 6 ELSE 0 END))) AS INT) ELSE 0 END"
_SQL_RULES = [
    ("connection-error", "status = 0", "error"), ("server-error", "status >= 500", "status"), ("client-error", "status BETWEEN 400 AND 499", "status"), ("redirect", "status BETWEEN 300 AND 399", "status"),
    ("redirect-chain", "status <> 0 AND hops > 1", "hops || ' hops'"), ("slow-response", "status = 200 AND response_time_ms > 2000", "response_time_ms || ' ms'"),
    ("title-missing", "page AND coalesce(title, '') = ''", None), ("title-too-long", "page AND length(title) > 60", "length(title) || ' chars'"), ("title-too-short", "page AND title <> '' AND length(title) < 30", "length(title) || ' chars'"),
    ("title-duplicate", "page AND title <> '' AND title IN (SELECT title FROM f WHERE status = 200 GROUP BY title HAVING count(*) > 1)", None),
    ("description-missing", "page AND coalesce(meta_description, '') = ''", None), ("description-too-long", "page AND length(meta_description) > 160", "length(meta_description) || ' chars'"), ("description-too-short", "page AND meta_description <> '' AND length(meta_description) < 70", "length(meta_description) || ' chars'"),
    ("description-duplicate", "page AND meta_description <> '' AND meta_description IN (SELECT meta_description FROM f WHERE status = 200 GROUP BY meta_description HAVING count(*) > 1)", None),
    ("h1-missing", "page AND h1_count = 0", None), ("h1-multiple", "page AND h1_count > 1", "h1_count || ' H1s'"), ("noindex", "page AND contains(meta_robots, 'noindex')", None), ("nofollow", "page AND contains(meta_robots, 'nofollow')", None),
    ("x-robots-noindex", "page AND NOT coalesce(contains(meta_robots, 'noindex'), false) AND contains(lower(x_robots_tag), 'noindex')", "x_robots_tag"), ("canonical-missing", "page AND canonical IS NULL", None), ("canonicalised", "page AND canonicalized", "canonical"),
    ("image-missing-alt", "page AND images_missing_alt > 0", "images_missing_alt || ' of ' || images_total || ' images'"), ("thin-content", "page AND word_count < 200", "word_count || ' words'"),
    ("content-requires-js", "page AND rendered AND word_count >= 100 AND pre_render_word_count * 3 < word_count", "'Only ' || (pre_render_word_count * 100 // word_count) || '% of content (' || pre_render_word_count || ' of ' || word_count || ' words) is in the raw HTML; the rest needs JavaScript'"),
    ("large-page", "page AND size_bytes > 2000000", "size_bytes // 1024 || ' KB'"), ("duplicate-content", "page AND duplicate_of IS NOT NULL", "duplicate_of"), ("low-text-ratio", "page AND text_ratio > 0 AND text_ratio < 0.08 AND word_count < 200", "CAST(round_even(text_ratio * 100, 0) AS INT) || '%'"),
    ("orphan", "page AND inlinks = 0 AND depth > 0", None), ("dead-end", "page AND indexable AND n_internal = 0", None), ("deep-page", "page AND depth > 4", "depth || ' clicks from home'"), ("no-compression", "page AND content_encoding IS NULL AND size_bytes > 4096", None),
    ("not-secure", "page AND starts_with(final_url, 'http://')", None), ("mixed-content", "page AND NOT starts_with(final_url, 'http://') AND mixed_content > 0", "mixed_content || ' resource(s)'"), ("no-hsts", "page AND NOT starts_with(final_url, 'http://') AND NOT hsts", None),
    ("viewport-missing", "page AND NOT has_viewport", None), ("lang-missing", "page AND lang IS NULL", None), ("hreflang-incomplete", "page AND len(hreflang_langs) > 0 AND len(list_filter(hreflang_langs, lambda h: lower(h) = 'x-default' OR coalesce(starts_with(lower(h), lower(lang[:2])), false))) = 0", None),
    ("a11y-link-no-text", "page AND links_no_text > 0", "links_no_text || ' of ' || links_total || ' links'"), ("a11y-button-no-text", "page AND buttons_no_text > 0", "buttons_no_text || ' button(s)'"), ("a11y-input-no-label", "page AND inputs_no_label > 0", "inputs_no_label || ' of ' || controls_total || ' controls'"),
    ("a11y-zoom-disabled", "page AND viewport_blocks_zoom", None), ("a11y-iframe-no-title", "page AND iframes_no_title > 0", "iframes_no_title || ' iframe(s)'"), ("a11y-positive-tabindex", "page AND positive_tabindex > 0", "positive_tabindex || ' element(s)'"), ("a11y-skipped-heading", "page AND skipped_heading", None),
    ("og-missing", "shown AND og_title IS NULL", None), ("twitter-missing", "shown AND twitter_card IS NULL", None), ("structured-data-missing", "shown AND n_schema_types = 0", None), ("structured-data-invalid", "shown AND invalid_jsonld > 0", "invalid_jsonld || ' block(s)'"),
    ("geo-ready", "shown AND word_count > 50 AND geo_score >= 70", "geo_score || '/100'"), *((rule, f"shown AND word_count > 50 AND geo_score < 70 AND {test}", detail) for rule, test, detail in (("geo-no-structured-data", "NOT structured_data", None), ("geo-not-answerable", "NOT answerable", None), ("geo-no-author", "NOT has_author", None), ("geo-no-semantic-html", "NOT semantic_html", None), ("geo-thin-for-ai", "word_count < 300", "word_count || ' words'"))),
]
_KNOWN = ", ".join(f"('{r}', '{_q(t)}', '{c}', '{_q(catalog.CATEGORIES[c])}', '{s}', {catalog.RANKS[s]})" for r, t, c, s, *_ in catalog.RULES)
_UNION = " UNION ALL ".join(f"SELECT '{rule}' AS rule, page_id, url, CAST({detail or 'NULL'} AS VARCHAR) AS detail FROM g WHERE {test}" for rule, test, detail in _SQL_RULES)
ISSUES = f"""
f AS ({FACTS}), g AS MATERIALIZED (SELECT *, status = 200 AND {_HTML} AS page, status = 200 AND {_HTML} AND indexable AS shown, {_GEO} AS geo_score, {_A11Y} AS a11y_score FROM f),
known(rule, title, category, label, severity, rank) AS (VALUES {_KNOWN}),
issues AS (SELECT u.url, u.rule, k.title, k.category, k.label, k.severity, k.rank, u.detail, u.page_id FROM ({_UNION}) u JOIN known k ON k.rule = u.rule)
"""


def facts(spark, sf_dir):
    f = views(spark, sf_dir, "pages").sql(FACTS)
    return f.withColumns({"geo_score": scores.geo_score(), "a11y_score": scores.a11y_score()})


def issues(spark, sf_dir):
    return audit.page_issues(facts(spark, sf_dir))


@query("audit_issues", f"WITH {ISSUES} SELECT url, rule, title, category, severity, detail FROM issues")
def audit_issues(spark, sf_dir):
    """All rules over the derived facts."""
    return issues(spark, sf_dir)


#: What parsing finds on the test pages, in SQL: they have no descriptions, images, forms, structured data or links to each other.
_PARAGRAPHS = rf"list_transform(string_split(regexp_extract(html, '<body>(.*)$', 1, 's'), '<p>')[2:4], lambda s: len(list_filter(regexp_split_to_array(regexp_replace(regexp_extract(s, '^(.*?)(</p>|</article>|$)', 1, 's'), '<[^>]*>', '', 'g'), '\s+'), lambda w: w <> '')))"
PARSED_FACTS = rf"""
SELECT c.page_id, c.url, c.final_url, c.status, CAST(NULL AS VARCHAR) AS error, 0 AS hops, c.depth, c.response_time_ms, c.size_bytes, c.content_type, 1 AS h1_count, word_count,
       title, CAST(NULL AS VARCHAR) AS meta_description, CAST(NULL AS VARCHAR) AS meta_robots, CAST(NULL AS VARCHAR) AS x_robots_tag, CAST(NULL AS VARCHAR) AS canonical, false AS canonicalized, 0 AS images_total, 0 AS images_missing_alt,
       false AS rendered, word_count AS pre_render_word_count, CASE WHEN word_count >= 20 AND first_url <> c.url THEN first_url END AS duplicate_of, least(1.0, CAST(octet_length(encode(t)) AS DOUBLE) / octet_length(encode(c.html))) AS text_ratio,
       (SELECT count(*) FROM ({PARSED_LINKS}) l WHERE l.link = regexp_replace(c.final_url, '#.*$', '')) AS inlinks, c.status = 200 AS indexable, coalesce(n_internal, 0) AS n_internal, c.content_encoding, 0 AS mixed_content, c.hsts,
       false AS has_viewport, regexp_extract(c.html, '<html lang="([^"]*)"', 1) AS lang, CAST([] AS VARCHAR[]) AS hreflang_langs, 0 AS links_no_text, len(regexp_extract_all(c.html, '<a href=')) AS links_total, 0 AS buttons_no_text, 0 AS buttons_total,
       0 AS inputs_no_label, 0 AS controls_total, false AS viewport_blocks_zoom, 0 AS iframes_no_title, 0 AS positive_tabindex, false AS skipped_heading, CAST(NULL AS VARCHAR) AS og_title, CAST(NULL AS VARCHAR) AS twitter_card, 0 AS n_schema_types, 0 AS invalid_jsonld,
       false AS structured_data, true AS semantic_html, list_max({_PARAGRAPHS}) >= 25 AS answerable, false AS has_author, false AS has_date, false AS faq_schema, CASE WHEN ends_with(title, '?') THEN 1 ELSE 0 END AS question_headings, 1 AS structured_blocks
FROM (SELECT *, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INT) AS word_count, first_value(url) OVER (PARTITION BY {{lower_t}} ORDER BY page_id) AS first_url
      FROM (SELECT *, {_VISIBLE} AS t, nullif({_plain(_TITLE)}, '') AS title FROM ({CRAWL}))) c
LEFT JOIN (SELECT page_id, count(*) AS n_internal FROM ({PARSED_LINKS}) GROUP BY page_id) n ON n.page_id = c.page_id
""".replace("{lower_t}", "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_SITE = ", ".join(f"('{r}')" for r in ("no-sitemap", "geo-no-llms-txt"))


@query("audit_parsed", f"WITH {ISSUES.replace(FACTS, PARSED_FACTS)} SELECT url, rule, title, category, severity, detail FROM issues UNION ALL SELECT 'https://example.com/', rule, title, category, severity, NULL FROM known WHERE rule IN ({_SITE})")
def audit_parsed(spark, sf_dir):
    """The whole way: parse the pages, derive cross-page facts, audit."""
    # Parsed once and kept: inlinks, duplicates, links and rules each read it.
    p = cut(responses.build_pages(spread(responses.crawl(spark, sf_dir))).drop("text", "headings"))
    each = links.page_links(p)
    p = links.with_inlinks(audit.first_of_content(p), each)
    return audit.audit(p, broken=links.broken_links(each, links.status_map(p)), site=audit.site_issues("https://example.com/", robots_found=True, sitemap_found=False, llms_txt_found=False))


@query("title_length_issues", f"WITH {ISSUES} SELECT url, rule, detail FROM issues WHERE rule IN ('title-too-long', 'title-too-short')")
def title_length_issues(spark, sf_dir):
    return issues(spark, sf_dir).where(F.col("rule").isin("title-too-long", "title-too-short")).select("url", "rule", "detail")


@query("title_duplicates", f"SELECT title, count(*) AS n FROM ({FACTS}) WHERE status = 200 AND title <> '' GROUP BY title HAVING count(*) > 1")
def title_duplicates(spark, sf_dir):
    return facts(spark, sf_dir).where("status = 200 AND title <> ''").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


@query("content_duplicates", "SELECT doc_id, first AS duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS first FROM documents) WHERE first <> doc_id")
def content_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("url"), F.sha2("text", 256).alias("content_hash"))
    return audit.first_of_content(d).where("duplicate_of IS NOT NULL").select(F.col("page_id").alias("doc_id"), "duplicate_of")


@query("status_histogram", f"SELECT CAST(status AS VARCHAR) AS key, count(*) AS n FROM ({FACTS}) GROUP BY status")
def status_histogram(spark, sf_dir):
    return scores.histogram(facts(spark, sf_dir), "status")


@query("depth_histogram", f"SELECT CAST(depth AS VARCHAR) AS key, count(*) AS n FROM ({FACTS}) GROUP BY depth")
def depth_histogram(spark, sf_dir):
    return scores.histogram(facts(spark, sf_dir), "depth")


@query("category_counts", f"WITH {ISSUES} SELECT label AS key, count(*) AS n FROM issues WHERE severity <> 'good' GROUP BY label")
def category_counts(spark, sf_dir):
    return scores.by_category(issues(spark, sf_dir))


@query("category_shares", f"WITH {ISSUES}, c AS (SELECT label AS key, count(*) AS n FROM issues WHERE severity <> 'good' GROUP BY label) SELECT key, n, round(n / sum(n) OVER (), 6) AS of_total, round(n / max(n) OVER (), 6) AS of_max FROM c")
def category_shares(spark, sf_dir):
    return triage.shares(scores.by_category(issues(spark, sf_dir))).select("key", "n", F.round("of_total", 6).alias("of_total"), F.round("of_max", 6).alias("of_max"))


@query("severity_counts", f"WITH {ISSUES} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'notice') AS notices, count(*) FILTER (severity = 'good') AS goods FROM issues")
def severity_counts(spark, sf_dir):
    return scores.severity_counts(issues(spark, sf_dir))


@query("category_severity_pivot", f"WITH {ISSUES} SELECT category, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'notice') AS notice, count(*) AS total FROM issues WHERE severity <> 'good' GROUP BY category")
def category_severity_pivot(spark, sf_dir):
    return triage.category_severity(issues(spark, sf_dir))


@query("health_score", f"WITH {ISSUES} SELECT CAST(greatest(0, round(100 - least(100, sum(CASE WHEN category IN ('geo', 'accessibility') THEN 0 WHEN severity = 'error' THEN 3 WHEN severity = 'warning' THEN 1 WHEN severity = 'notice' THEN 0.25 ELSE 0 END)::DOUBLE / (SELECT count(*) FROM pages) * 12))) AS INT) AS health FROM issues")
def health_score(spark, sf_dir):
    return scores.health_score(facts(spark, sf_dir), issues(spark, sf_dir))


@query("seo_page_scores", f"WITH {ISSUES}, p AS (SELECT url, sum(CASE WHEN category IN ('geo', 'accessibility') THEN 0 WHEN severity = 'error' THEN 15 WHEN severity = 'warning' THEN 7 WHEN severity = 'notice' THEN 2 ELSE 0 END) AS lost FROM issues GROUP BY url) SELECT f.url, CASE WHEN f.status = 200 THEN CAST(greatest(0, 100 - coalesce(k.lost, 0)) AS INT) ELSE 0 END AS seo_score FROM f LEFT JOIN (SELECT regexp_replace(url, '#.*$', '') AS key, sum(lost) AS lost FROM p GROUP BY ALL) k ON k.key = regexp_replace(f.url, '#.*$', '')")
def seo_page_scores(spark, sf_dir):
    return scores.seo_scores(facts(spark, sf_dir), issues(spark, sf_dir))


@query("page_scores", f"WITH f AS ({FACTS}) SELECT page_id, CAST({_GEO} AS INT) AS geo_score, {_A11Y} AS a11y_score FROM f")
def page_scores(spark, sf_dir):
    return facts(spark, sf_dir).select("page_id", "geo_score", "a11y_score")


@query("site_scores", f"WITH {ISSUES} SELECT CAST(floor(avg(geo_score) FILTER (status = 200 AND indexable)) AS INT) AS geo, CAST(floor(avg(a11y_score) FILTER (page)) AS INT) AS a11y FROM g")
def site_scores(spark, sf_dir):
    return scores.site_scores(facts(spark, sf_dir))


@query("geo_gaps", f"WITH {ISSUES} SELECT count(*) AS pages, count(*) FILTER (NOT has_author) AS missing_author, count(*) FILTER (NOT has_date) AS missing_date, count(*) FILTER (NOT structured_data) AS no_structured_data, count(*) FILTER (NOT semantic_html) AS no_semantic_html, count(*) FILTER (NOT answerable) AS not_answerable, count(*) FILTER (question_headings = 0) AS no_question_headings, count(*) FILTER (word_count < 300) AS thin FROM g WHERE status = 200 AND indexable AND word_count > 50")
def geo_gaps(spark, sf_dir):
    return scores.geo_gaps(facts(spark, sf_dir))


@query("crawl_summary", f"WITH {ISSUES} SELECT (SELECT count(*) FROM f) AS pages, (SELECT count(*) FROM f WHERE indexable) AS indexable, (SELECT count(*) FROM f WHERE duplicate_of IS NOT NULL) AS duplicates, (SELECT CAST(floor(avg(response_time_ms)) AS BIGINT) FROM f WHERE status = 200) AS avg_response_ms, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'notice') AS notices, count(*) FILTER (severity = 'good') AS goods FROM issues")
def crawl_summary(spark, sf_dir):
    return scores.summary(facts(spark, sf_dir), issues(spark, sf_dir))


@query("indexability", f"SELECT page_id, CASE WHEN contains(coalesce(meta_robots, ''), 'noindex') OR contains(lower(coalesce(x_robots_tag, '')), 'noindex') THEN 'Noindex' WHEN status = 0 THEN 'Connection Error' WHEN status BETWEEN 300 AND 399 THEN 'Redirect' WHEN status BETWEEN 400 AND 499 THEN 'Client Error' WHEN status >= 500 THEN 'Server Error' WHEN canonicalized THEN 'Canonicalised' END AS reason FROM ({FACTS})")
def indexability(spark, sf_dir):
    return facts(spark, sf_dir).select("page_id", responses.indexability(F.col("status"), F.col("meta_robots"), F.col("x_robots_tag"), F.col("canonicalized")).alias("reason"))


@query("group_issues", f"WITH {ISSUES} SELECT rule, title, category, severity, count(*) AS n, list_slice(list(url ORDER BY url), 1, 5) AS samples FROM issues WHERE severity <> 'good' GROUP BY ALL")
def group_issues(spark, sf_dir):
    return triage.group_issues(issues(spark, sf_dir))


@query("top_fixes", f"WITH {ISSUES} SELECT rule, n, round(CASE severity WHEN 'error' THEN 5 WHEN 'warning' THEN 2 ELSE 0.6 END * sqrt(n), 6) AS impact FROM (SELECT rule, severity, count(*) AS n FROM issues WHERE severity <> 'good' GROUP BY ALL) ORDER BY impact DESC, n DESC, rule LIMIT 8")
def top_fixes(spark, sf_dir):
    """A report of fixed length."""
    return triage.top_fixes(issues(spark, sf_dir), 8).select("rule", "n", F.round("impact", 6).alias("impact"))


@query("severity_filter", f"WITH {ISSUES} SELECT url, rule FROM issues WHERE severity IN ('warning', 'error') AND category = 'headings'")
def severity_filter(spark, sf_dir):
    return triage.problems(issues(spark, sf_dir), "warning", "headings").select("url", "rule")


@query("affected_urls", f"WITH {ISSUES}, h AS (SELECT url FROM issues WHERE rule = 'h1-missing') SELECT url, (SELECT count(*) FROM h) AS total FROM h ORDER BY url LIMIT 20")
def affected_urls(spark, sf_dir):
    """A report of fixed length."""
    return triage.affected(issues(spark, sf_dir), "h1-missing", 20)


@query("rule_catalogue", f"WITH known(rule, title, category, label, severity, rank) AS (VALUES {_KNOWN}) SELECT rule, title, category, label AS category_label, severity, rank FROM known")
def rule_catalogue(spark, sf_dir):
    return catalog.rule_table(spark).select("rule", "title", "category", "category_label", "severity", "rank")


@query("issues_csv", f"WITH {ISSUES} SELECT upper(severity[1]) || severity[2:] AS severity, label AS category, rule, title, url, coalesce(detail, '') AS detail FROM issues")
def issues_csv(spark, sf_dir):
    return store.issues_csv(issues(spark, sf_dir))


# ---- comparison of two crawls ----
@query("crawl_diff_pages", "SELECT 'added' AS change, url FROM (SELECT url FROM pages WHERE page_id % 10 <> 4 EXCEPT SELECT url FROM pages WHERE page_id % 10 <> 3) UNION ALL SELECT 'removed', url FROM (SELECT url FROM pages WHERE page_id % 10 <> 3 EXCEPT SELECT url FROM pages WHERE page_id % 10 <> 4)")
def crawl_diff_pages(spark, sf_dir):
    """Two crawls derived from the pages (each lacks another tenth, as the comparison's input)."""
    p = table(spark, sf_dir, "pages")
    return store.page_changes(p.where("page_id % 10 <> 3"), p.where("page_id % 10 <> 4"))


_OLD, _NEW = "page_id % 10 <> 3 AND rule <> 'noindex'", "page_id % 10 <> 4"
_SIDE = "SELECT '{0}' AS change, rule, any_value(title) AS title, any_value(category) AS category, any_value(severity) AS severity, count(*) AS n, list_slice(list(DISTINCT url ORDER BY url), 1, 5) AS samples FROM {1} a WHERE NOT EXISTS (SELECT 1 FROM {2} b WHERE a.url = b.url AND a.rule = b.rule) GROUP BY rule"


@query("crawl_diff_issues", f"WITH {ISSUES}, o AS (SELECT * FROM issues WHERE {_OLD}), n AS (SELECT * FROM issues WHERE {_NEW}) " + _SIDE.format("new", "n", "o") + " UNION ALL " + _SIDE.format("resolved", "o", "n"))
def crawl_diff_issues(spark, sf_dir):
    p = facts(spark, sf_dir)
    p = audit.with_duplicates(p)
    old = audit.page_issues(p.where("page_id % 10 <> 3")).where("rule <> 'noindex'")
    return store.issue_changes(old, audit.page_issues(p.where("page_id % 10 <> 4")))


# ---- links between pages of a derived crawl ----
LINKS = "SELECT page_id, url, 0 AS pos, 'https://site.example/' || ((page_id * 7) % 50) AS link, true AS internal FROM pages UNION ALL SELECT page_id, url, 1, 'https://site.example/' || ((page_id * 3 + 1) % 50), true FROM pages UNION ALL SELECT page_id, url, 2, 'https://other.example/' || (page_id % 11), false FROM pages"
KNOWN_PAGES = "SELECT page_id, 'https://site.example/' || (page_id % 40) AS url, 'https://site.example/' || (page_id % 45) AS final_url, CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 403 ELSE 200 END AS status FROM pages"
_STATUS = f"s AS (SELECT key, arg_max(status, page_id * 2 + o) AS status FROM (SELECT final_url AS key, status, page_id, 0 AS o FROM ({KNOWN_PAGES}) UNION ALL SELECT url, status, page_id, 1 FROM ({KNOWN_PAGES})) GROUP BY key)"
_INDEX = f"x AS (SELECT key, arg_min(page_id, page_id * 2 + o) AS id FROM (SELECT final_url AS key, page_id, 0 AS o FROM ({KNOWN_PAGES}) UNION ALL SELECT url, page_id, 1 FROM ({KNOWN_PAGES})) GROUP BY key)"


@query("inlink_counts", f"SELECT link AS dst, count(*) AS inlinks FROM ({LINKS}) WHERE internal GROUP BY link")
def inlink_counts(spark, sf_dir):
    return links.inlink_counts(views(spark, sf_dir, "pages").sql(LINKS))


@query("broken_links", f"WITH {_STATUS} SELECT l.url, l.link, s.status FROM ({LINKS}) l JOIN s ON s.key = l.link WHERE s.status IN (0, 404, 410) OR s.status >= 500")
def broken_links(spark, sf_dir):
    v = views(spark, sf_dir, "pages")
    return links.broken_links(v.sql(LINKS), links.status_map(v.sql(KNOWN_PAGES)))


@query("verify_targets", f"WITH {_STATUS} SELECT DISTINCT link FROM ({LINKS}) WHERE link NOT IN (SELECT key FROM s)")
def verify_targets(spark, sf_dir):
    v = views(spark, sf_dir, "pages")
    return links.verify_targets(v.sql(LINKS), links.status_map(v.sql(KNOWN_PAGES)))


@query("adjacency", f"WITH {_INDEX} SELECT DISTINCT l.page_id AS src, x.id AS dst FROM ({LINKS}) l JOIN x ON x.key = l.link WHERE l.internal AND l.page_id <> x.id")
def adjacency(spark, sf_dir):
    v = views(spark, sf_dir, "pages")
    return links.adjacency(v.sql(LINKS), links.page_index(v.sql(KNOWN_PAGES)))


@query("heading_jumps", "SELECT page_id, coalesce(bool_or(level > b + 1), false) AS skipped FROM (SELECT page_id, level, lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS b FROM (SELECT doc_id AS page_id, unnest(generate_series(1, 4)) AS pos, (doc_id * unnest(generate_series(1, 4))) % 5 + 1 AS level FROM documents)) GROUP BY page_id")
def heading_jumps(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos")).withColumn("level", F.col("page_id") * F.col("pos") % 5 + 1)
    return audit.heading_jumps(h)


# ---- links as parsed, with urls in other forms than the normal one ----
#: The same urls with upper-case hosts, default ports and fragments.
_MESSY = r"regexp_extract(u, '^[a-z]+://') || upper(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)) || CASE WHEN starts_with(u, 'https') THEN ':443' ELSE ':80' END || regexp_extract(u, '^[a-z]+://[^/?#]*(.*)$', 1) || '#part'"
_CODE = "CASE length(u) % 4 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 403 ELSE 200 END"


def _messy(u):
    return F.concat(F.regexp_extract(u, "^[a-z]+://", 0), F.upper(F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1)), F.when(u.startswith("https"), ":443").otherwise(":80"), F.regexp_extract(u, "^[a-z]+://[^/?#]*(.*)$", 1), F.lit("#part"))


def _parsed(spark, sf_dir):
    return spread_table(spark, sf_dir, "pages").select("page_id", "url", hx.parse_html("url", "html").alias("s")).select("page_id", "url", "s.internal_links", "s.external_links")


@query("parsed_inlinks", f"SELECT p.page_id, count(l.link) AS inlinks FROM pages p LEFT JOIN (SELECT page_id, arg_min(link, pos) AS first FROM ({PARSED_LINKS}) GROUP BY page_id) f ON f.page_id = p.page_id LEFT JOIN ({PARSED_LINKS}) l ON l.link = coalesce(f.first, regexp_replace(p.url, '#.*$', '')) GROUP BY p.page_id")
def parsed_inlinks(spark, sf_dir):
    """Inlinks of pages that redirect to their own first link, written in another form."""
    p = _parsed(spark, sf_dir)
    first = F.try_element_at("internal_links", F.lit(1))
    pages = p.withColumn("final_url", F.coalesce(_messy(first), F.col("url")))
    return links.with_inlinks(pages, links.page_links(p)).select("page_id", "inlinks")


@query("parsed_broken_links", f"SELECT url, link, status FROM (SELECT url, link, {_CODE.replace('u)', 'link)')} AS status FROM ({PARSED_LINKS})) WHERE status IN (404, 503)")
def parsed_broken_links(spark, sf_dir):
    """Links against a table of verified statuses whose urls are written in another form."""
    each = links.page_links(_parsed(spark, sf_dir))
    verified = each.select(F.col("link").alias("u")).distinct().select(_messy(F.col("u")).alias("url"), F.expr(_CODE).alias("status"))
    pages = views(spark, sf_dir, "pages").sql(KNOWN_PAGES)
    return links.broken_links(each, links.status_map(pages, verified))


@query(
    "parsed_adjacency",
    f"WITH l AS ({PARSED_LINKS}), f AS (SELECT p.page_id, coalesce(arg_min(link, pos), regexp_replace(any_value(p.url), '#.*$', '')) AS final_key, regexp_replace(any_value(p.url), '#.*$', '') AS url_key FROM pages p LEFT JOIN l ON l.page_id = p.page_id GROUP BY p.page_id), "
    "x AS (SELECT key, min(page_id) AS id FROM (SELECT final_key AS key, page_id FROM f UNION ALL SELECT url_key, page_id FROM f) GROUP BY key) SELECT DISTINCT l.page_id AS src, x.id AS dst FROM l JOIN x ON x.key = l.link WHERE l.page_id <> x.id",
)
def parsed_adjacency(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    pages = p.withColumn("final_url", F.coalesce(_messy(F.try_element_at("internal_links", F.lit(1))), F.col("url")))
    return links.adjacency(links.page_links(p), links.page_index(pages))


# ---- the rules that look beyond one page ----
_BAD = "CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 404 WHEN 2 THEN 410 ELSE 500 END"


@query(
    "rules_beyond_a_page",
    f"WITH {ISSUES} SELECT i.url, i.rule, k.title, k.category, k.severity, i.detail FROM (SELECT url, 'broken-link' AS rule, CASE WHEN page_id % 4 = 0 THEN 'ERR' ELSE CAST({_BAD} AS VARCHAR) END || ' → ' || url || '/x' AS detail FROM pages "
    "UNION ALL SELECT url, 'blocked-by-robots', NULL FROM pages WHERE contains(url, '/de/') UNION ALL SELECT 'https://example.com/', rule, NULL FROM known WHERE rule IN ('no-robots-txt', 'no-sitemap', 'geo-no-llms-txt') "
    "UNION ALL SELECT url, 'schema-missing-required', 'Offer: missing price, priceCurrency' FROM g WHERE shown AND n_schema_types = 1 "
    "UNION ALL SELECT url, 'schema-missing-recommended', x || ': missing ' || y FROM (SELECT url, unnest(['Offer', 'Product']) AS x, unnest(['url', 'brand, sku']) AS y, n_schema_types FROM g WHERE shown) WHERE n_schema_types = 1 OR (n_schema_types = 2 AND x = 'Product')) i JOIN known k ON k.rule = i.rule",
)
def rules_beyond_a_page(spark, sf_dir):
    """Broken and blocked links, what the site lacks, and schema items that lack fields."""
    f = facts(spark, sf_dir)
    item = lambda name, required, recommended: F.struct(F.lit(name).alias("type_name"), F.lit(required).cast("array<string>").alias("missing_required"), F.lit(recommended).cast("array<string>").alias("missing_recommended"))
    offer, product = item("Offer", ["price", "priceCurrency"], ["url"]), item("Product", [], ["brand", "sku"])
    f = f.withColumn("schema_validations", F.when(F.col("n_schema_types") == 1, F.array(offer, product)).when(F.col("n_schema_types") == 2, F.array(product)).otherwise(F.array().cast(audit.DEFAULTS["schema_validations"])))
    p = table(spark, sf_dir, "pages")
    status = F.element_at(F.array(*(F.lit(x) for x in (0, 404, 410, 500))), (F.col("page_id") % 4 + 1).cast("int"))
    robots_txt = robots.parse("User-agent: *\nCrawl-delay: 2\nDisallow: /x\nUser-agent: other\nUser-agent: audit\nDisallow: /de/\n", "audit/2.0")
    blocked = robots.allowed_paths(p.select("url", urls.robots_path(F.col("url")).alias("path")), robots_txt).where("NOT allowed").select("url")
    site = audit.site_issues("https://example.com/", robots_found=False, sitemap_found=False, llms_txt_found=False)
    out = audit.audit(f, broken=p.select("url", F.concat("url", F.lit("/x")).alias("link"), status.alias("status")), blocked=blocked, site=site)
    return out.where(F.col("rule").isin("broken-link", "blocked-by-robots", "no-robots-txt", "no-sitemap", "geo-no-llms-txt", "schema-missing-required", "schema-missing-recommended"))
