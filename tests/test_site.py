"""Functions and operators on literal cases."""

import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteaudit.functions import html as hx
from siteaudit.functions import jsonld, urls
from siteaudit.operators import audit, links, scores, store, triage
from siteaudit.packs import language as pk
from siteaudit.sources import responses, robots
from siteaudit.streaming import crawl_stream as cs

PAGE = """<html lang="en"><head><title>  Hello  World </title><meta name="description" content=" short "><meta name="description" content="last">
<meta name="robots" content="NOINDEX, follow"><link rel="canonical" href="/target"><meta property="og:title" content=""></head>
<body><h1>One</h1><h2>Why?</h2><h4>x</h4><img src=a alt=" "><img src=b alt=x><a href="/about">A</a><a href="/about#t">B</a><a href="https://other.com/x"></a>
<a href="mailto:a@b">m</a><p>one<b>two<p>three<script>var a="</p>";</script><button></button><input type=text><label><input></label><iframe src="http://x/"></iframe><i tabindex=3></i>
<ul><li>1<li>2</ul></body></html>"""


def test_signals():
    s = hx.signals("https://www.example.com/page", PAGE)
    assert (s["title"], s["meta_description"], s["meta_robots"], s["canonical"]) == ("Hello World", "last", "noindex, follow", "https://www.example.com/target")
    assert s["og_title"] == "" and s["twitter_card"] is None
    assert (s["images_total"], s["images_missing_alt"], s["h1"], s["h2_count"]) == (2, 1, ["One"], 1)
    assert s["internal_links"] == ["https://www.example.com/about"] and s["external_links"] == ["https://other.com/x"]
    assert (s["links_no_text"], s["buttons_no_text"], s["inputs_no_label"], s["controls_total"]) == (1, 1, 1, 2)
    assert s["skipped_heading"] and s["mixed_content"] == 1 and s["positive_tabindex"] == 1 and s["iframes_no_title"] == 1
    assert "one two three" in s["text"] and "var" not in s["text"]


@pytest.mark.parametrize("html", ["", "<", "<p", "plain", "<a href=>x", "</div></p>", "<title></title>", "<p>" * 5000])
def test_odd_html(html):
    assert hx.signals("https://a/", html)["word_count"] >= 0


def test_urls():
    n = urls.normalize
    assert n("HTTP://Ex.COM:80/a/../b/./c#f") == "http://ex.com/b/c#f"
    assert n("https://ex.com/dieentzäsch").endswith("/dieentz%C3%A4sch") and n("nothing") is None and n("ftp://x/") is None
    assert urls.resolve("https://a.com/x/y", "../z?q=1#f") == "https://a.com/z?q=1"
    assert urls.resolve("https://a.com/x/", "//b.com") == "https://b.com/"
    assert urls.resolve("https://a.com/", "javascript:x") is None and urls.resolve("https://a.com/", " ") is None
    assert urls.same_site("www.a.com", "a.com") and not urls.same_site("a.com", "b.com")


def test_filters(spark):
    df = spark.createDataFrame([("https://a.com/x/y.PDF?z",), ("https://b.com/blog/1",)], "url string")
    assert [r[0] for r in df.select(urls.is_asset(F.col("url"))).collect()] == [True, False]
    assert [r[0] for r in df.select(urls.glob(F.col("url"), "a*y")).collect()] == [True, False]
    with pytest.raises(ValueError):
        urls.excluded(F.col("url"), hosts=[("(", True)])


def test_robots():
    text = "User-agent: Bot\nDisallow: /a\nAllow: /a/b\nUser-agent: *\nDisallow: /\nSitemap: https://x/s.xml # c\n"
    r = robots.parse(text, "bot/1.0")
    assert not r.allowed("/a/c") and r.allowed("/a/b/c") and r.allowed("/z") and r.sitemaps == ("https://x/s.xml",)
    assert not robots.parse(text, "other").allowed("/z")
    assert robots.parse("User-agent: bot\nDisallow:\nUser-agent: *\nDisallow: /p", "bot").rules == ((False, "/p"),)
    assert robots.Robots(((True, "/x"), (False, "/x"))).allowed("/x")
    assert robots.fits("/*.pdf$", "/a.pdf") and not robots.fits("/*.pdf$", "/a.pdf?x") and robots.fits("/a*b", "/axxb1")


def test_robots_native(spark):
    rules = [(False, "/de/"), (True, "/de/1"), (False, "/x$")]
    df = spark.createDataFrame([("/de/1",), ("/de/2",), ("/x",), ("/xy",)], "path string")
    assert [r["allowed"] for r in robots.allowed_native(df, rules).collect()] == [True, False, False, True]


def test_bodies_and_sitemaps(spark):
    raw = b"hello" * 9
    assert responses.decode(gzip.compress(raw), "gzip") == raw and responses.decode(zlib.compress(raw), "deflate") == raw
    assert responses.decode(zlib.compress(raw)[2:-4], "deflate") == raw and responses.decode(b"x", "gzip") == b"x" and responses.decode(raw, None) == raw
    df = spark.createDataFrame([("i", "<sitemapindex><loc>b</loc><loc>a</loc></sitemapindex>"), ("a", "<loc>1</loc><loc>2&amp;</loc>"), ("b", "<loc> 2&amp; </loc>")], "url string, xml string")
    assert [r["loc"] for r in responses.sitemap_table(df).collect()] == ["2&", "1"]
    h = spark.createDataFrame([({"Server": "x", "Strict-Transport-Security": "y"},)], "headers map<string,string>")
    r = responses.with_headers(h).first()
    assert (r["server"], r["hsts"], r["content_type"]) == ("x", True, None)


def test_jsonld():
    types, items, bad = jsonld.validate(['{"@graph":[{"@type":["Product","Thing"],"name":"x","image":"y"}]}', "{", " ", '{"@type":"offer"}', '{"a":NaN}'])
    assert types == ["Product", "Thing", "offer"] and bad == 2
    assert items[0]["missing_required"] == ["offers|review|aggregateRating"] and items[1]["missing_required"] == ["price", "priceCurrency"]
    assert jsonld.present(0) and jsonld.present(False) and not jsonld.present(" ") and not jsonld.present([])


def test_extractors(spark):
    html = '<div class="p x">9</div><div class="p">10</div><a rel="author" href="/me">m</a><i data-sku="123">'
    es = [hx.Extractor("price", css="div.p"), hx.Extractor("author", css='a[rel="author"]', attr="href"), hx.Extractor("sku", regex='data-sku="(\\d+)"'), hx.Extractor("none", css="b > i")]
    df = spark.createDataFrame([(html,), (None,)], "html string")
    got = [[(e["name"], e["values"]) for e in r[0]] for r in df.select(hx.extract(es)("html")).collect()]
    assert got == [[("price", ["9", "10"]), ("author", ["/me"]), ("sku", ["123"])], []]
    assert len(hx.Extractor("x", regex="a").values(hx.Tree("").root, "a" * 99)) == 50
    for bad in (hx.Extractor("x"), hx.Extractor("x", css="a >"), hx.Extractor("x", regex="(")):
        with pytest.raises((ValueError, Exception)):
            bad.check()


def test_extraction_table_has_each_page(spark):
    """Pages that share a url keep a row each, as do pages without findings; of one extractor's findings the first counts."""
    rows = [("u", 200, [("a", ["1", "2"]), ("a", ["3"])]), ("u", 200, [("a.b", ["4"])]), ("u", 200, [("a", ["1", "2"])]), ("v", 200, []), ("w", 200, None), ("x", 404, [("a", ["5"])])]
    df = spark.createDataFrame(rows, "url string, status int, extractions array<struct<name:string,values:array<string>>>")
    got = store.extraction_table(df, ["a", "a.b"])
    assert got.columns == ["url", "a", "a.b"]
    assert sorted(tuple(r) for r in got.collect()) == [("u", "", "4"), ("u", "1 | 2", ""), ("u", "1 | 2", ""), ("v", "", ""), ("w", "", "")]


def test_ranks():
    r = links._rank(3, np.array([1, 2]), np.array([0, 0]))
    assert r[0] == 100 and r[1] == r[2] < 100


def test_pagerank_ways_agree(spark):
    nodes = spark.range(6).select("id")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (4, 0)], "src long, dst long")
    a = {r["id"]: r["link_score"] for r in links.pagerank(nodes, edges).collect()}
    b = {r["id"]: r["link_score"] for r in links.pagerank(nodes, edges, task_edges=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_scores_of_nothing(spark, sf):
    from siteaudit.plans.crawl_queries import facts

    none = facts(spark, sf).limit(0)
    issues = audit.page_issues(none)
    assert scores.health_score(none, issues).first()["health"] == 100
    assert scores.site_scores(none).first().asDict() == {"geo": 0, "a11y": 0}
    assert triage.top_fixes(issues).count() == 0 and not triage.fails(issues, "notice")


def test_store(spark, tmp_path):
    st = store.CrawlStore(spark, f"file://{tmp_path}")
    pages = spark.createDataFrame([("https://a/",), ("https://a/b",)], "url string")
    issues = spark.createDataFrame([("https://a/", "title-missing", "Missing Title", "titles-meta", "error", None)], "url string, rule string, title string, category string, severity string, detail string")
    for i, at in (("one", 1), ("two", 2)):
        st.save(i, pages if i == "two" else pages.limit(1), issues.limit(int(i == "one")), spark.createDataFrame([(at,)], "created_at long"))
    assert st.latest() == "two" and [r["crawl_id"] for r in st.crawls().collect()] == ["two", "one"]
    assert [(r["change"], r["n"]) for r in store.issue_changes(st.load("issues", "one"), st.load("issues", "two")).collect()] == [("resolved", 1)]
    assert [r["change"] for r in store.page_changes(st.load("pages", "one"), st.load("pages", "two")).collect()] == ["added"]
    st.delete("two")
    assert st.latest() == "one"
    assert "Missing Title (1)" in store.html_report(issues) and "<script>" not in store.html_report(issues.withColumn("url", F.lit("<script>")))
    store.write_csv(store.issues_csv(issues), f"file://{tmp_path}/csv")
    assert store.issues_json(pages, issues).count() == 1
    assert "Fix first" in store.text_report({"a": 1}, [r.asDict() for r in triage.top_fixes(issues).collect()])


def test_all_page_changes(spark, tmp_path, duck, rows_of):
    from siteaudit.plans import registry

    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a/"), "id").alias("url"), F.lit("").alias("html"))
    pages.write.parquet(f"file://{tmp_path}/pages.parquet")
    got = registry.QUERIES["crawl_diff_pages"](spark, f"file://{tmp_path}")
    want = duck.cursor()
    want.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert rows_of(got) == rows_of(want.execute(registry.ORACLES["crawl_diff_pages"])) and got.count() == 2_400
    few = store.page_changes(pages.where("page_id % 10 <> 3"), pages.where("page_id % 10 <> 4"), 1_000)
    assert [r["n"] for r in few.groupBy("change").agg(F.count("*").alias("n")).collect()] == [1_000, 1_000]


def test_packs(spark, tmp_path):
    pack = pk.built_in()
    sloppy = "In today's fast-paced world, unlock the power of synergy. It's important to note — very really — that we delve into it."
    df = spark.createDataFrame([(sloppy,), ("The cat sat. A dog, having waited all day in the rain for somebody to open it, ran through the door and up the stairs at once! Why?",), ("",)], "text string")
    s = [r["ledger"] for r in pk.score_texts(df, pack).collect()]
    assert s[0]["score"] > s[1]["score"] + 4 and s[2]["score"] == 5.0
    assert any("unlock the power of" in e for h in s[0]["hits"] for e in h["evidence"])
    for bad in ('phrase_rule("a", phrases = [', 'phrase_rule("a", phrases = [""])', 'regex_rule("a", pattern = "(")', 'metric_rule("a", metric = nope(), when = above(1))', "x", 'phrase_rule("a'):
        with pytest.raises(pk.PackError):
            pk.parse_pack(bad)
    pk.add_pack('metric_rule("a", metric = word_count(), when = above(1),)  # c', "slop-default", str(tmp_path))
    assert len(pk.resolve_pack("slop-default", home=str(tmp_path)).rules) == 1 and pk.list_packs(home=str(tmp_path)) == [("slop-default", "global")]
    pk.remove_pack("slop-default", str(tmp_path))
    assert len(pk.resolve_pack("slop-default", home=str(tmp_path)).rules) == 10


def test_stream_equals_batch(spark, sf, tmp_path):
    from siteaudit.plans.crawl_queries import facts

    f = facts(spark, sf).withColumns({"title_duplicate": F.lit(False), "description_duplicate": F.lit(False)})
    f.repartition(4).write.parquet(f"{tmp_path}/p")
    f = spark.read.parquet(f"{tmp_path}/p")
    got = cs.run_to_end(cs.issue_stream(cs.read_stream(spark, f"{tmp_path}/p", f.schema)), "issues_seen")
    assert sorted(map(str, got.collect())) == sorted(map(str, audit.page_issues(f).collect()))
    run = cs.run_to_end(cs.running_summary(cs.read_stream(spark, f"{tmp_path}/p", f.schema)), "summary_seen", "complete")
    assert sum(r["pages"] for r in run.collect()) == f.count()


def test_signals_by_the_letter():
    s = hx.signals("https://a.com/p", """<meta name=author content=x><meta name=author content=""><meta name=viewport content="user-scalable=no"><meta name=viewport content="width=1">
<link rel=alternate hreflang=de href="/de#f"><link rel=canonical href="/c"><link rel=canonical href="javascript:x"><input type=submit><input type=BUTTON value=go><input type=reset aria-label=r>
<iframe aria-label=x></iframe><iframe aria-labelledby=y></iframe><iframe></iframe><img src="  http://b/x.png"><script src="" href="http://b/"></script><button><img alt=ok></button>""")
    assert not s["has_author"] and not s["viewport_blocks_zoom"] and s["hreflang"] == [{"lang": "de", "href": "https://a.com/de#f"}] and s["canonical"] == "https://a.com/c"
    assert (s["buttons_total"], s["buttons_no_text"], s["controls_total"], s["iframes_no_title"], s["mixed_content"]) == (4, 1, 0, 1, 1)


@pytest.mark.parametrize("html", ["<button>" * 40_000, "<a href=x>" * 40_000, "<h1>" * 40_000, "<a href=x><b>" * 20_000])
def test_nesting_takes_linear_time(html):
    import time

    began = time.perf_counter()
    hx.signals("https://a/", html)
    assert time.perf_counter() - began < 10


def test_robots_groups():
    assert not robots.fits("/a*$", "/ab") and robots.fits("/a*$", "/a") and robots.fits("/a$$", "/a") and not robots.fits("", "/a")
    assert robots.parse("User-agent: bot\nAllow:\nUser-agent: *\nDisallow: /", "bot").allowed("/x")
    text = "User-agent: a\nCrawl-delay: 5\nUser-agent: b\nDisallow: /x\n"
    assert robots.parse(text, "a").allowed("/x") and not robots.parse(text, "b").allowed("/x")
    # Lengths count in bytes.
    assert not robots.Robots(((True, "/abc"), (False, "/é*c"), (False, "/a*b*c"))).allowed("/abc") and robots.Robots(((False, "/*éé"), (True, "/*ééx"), (False, "/éé*"))).allowed("/ééx")


def test_pagerank_of_odd_graphs(spark):
    big = 2**53
    nodes = spark.createDataFrame([("x", big + i) for i in range(4)] + [("y", 1), ("y", 2), ("z", 7)], "crawl string, id long")
    edges = spark.createDataFrame([("x", big, big + 1), ("x", big + 1, big + 3), ("x", big + 2, big + 3), ("x", big + 1, 5), ("x", 6, big), ("y", 1, 2), ("y", 1, 2), ("y", 2, 2), ("z", 7, 8)], "crawl string, src long, dst long")
    want = {("x", big): 0.0, ("y", 2): 100.0, ("z", 7): 100.0, ("x", big + 3): 100.0}
    ways = [{(r["crawl"], r["id"]): r["link_score"] for r in links.pagerank(nodes, edges, crawl="crawl", task_edges=n).collect()} for n in (100, 0)]
    assert ways[0].keys() == ways[1].keys() == {tuple(r) for r in nodes.collect()} and all(abs(ways[0][k] - ways[1][k]) < 1e-9 for k in ways[0])
    assert all(ways[0][k] == v for k, v in want.items() if v) and ways[0]["x", big] == pytest.approx(ways[0]["x", big + 2]) and ways[0]["x", big + 1] > ways[0]["x", big]
    for n in (100, 0):
        assert links.pagerank(nodes.limit(0), edges, crawl="crawl", task_edges=n).count() == 0


def test_statuses_and_error_rows(spark):
    made = [(1, "HTTPS://A.com:443/x#f", "https://a.com/x", 200, 0, "text/html", '<a href="/y">y</a><a href="HTTPS://B.com/dead#z">d</a>'), (2, "https://a.com/y", "https://a.com/y", 200, 1, "image/png", "<p>no page")]
    r = spark.createDataFrame(made, "page_id long, url string, final_url string, status int, depth int, content_type string, html string").withColumns({"response_time_ms": F.lit(1).cast("long"), "size_bytes": F.lit(1).cast("long"), "hsts": F.lit(False), "hops": F.lit(0)})
    failed = responses.failed_responses(spark.createDataFrame([(3, "https://a.com/z", 1, "timed out")], "page_id long, url string, depth int, error string"))
    p = responses.build_pages(r.unionByName(failed, allowMissingColumns=True))
    got = {x["page_id"]: x for x in p.collect()}
    assert got[1]["indexable"] and not got[2]["indexable"] and got[2]["word_count"] == 0 and got[2]["indexability"] is None and (got[3]["indexability"], got[3]["error"]) == ("Connection Error", "timed out")
    verified = spark.createDataFrame([("https://B.com:443/dead", 404), ("https://a.com/y", 500)], "url string, status int")
    each = links.page_links(p)
    assert [(x["link"], x["status"]) for x in links.broken_links(each, links.status_map(p, verified)).collect()] == [("https://b.com/dead", 404)]
    assert {x["page_id"]: x["inlinks"] for x in links.with_inlinks(p, each).collect()} == {1: 0, 2: 1, 3: 0}
    assert [tuple(x) for x in links.adjacency(each, links.page_index(p)).collect()] == [(1, 2)]
    reasons = spark.createDataFrame([(0,), (204,), (302,), (404,), (503,)], "status int")
    assert [x[0] for x in reasons.select(responses.indexability(F.col("status"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False))).collect()] == ["Connection Error", None, "Redirect", "Client Error", "Server Error"]


def test_results(spark, tmp_path):
    import json

    from siteaudit.operators import result
    from siteaudit.plans.crawl_queries import facts
    from siteaudit.sources import scope

    f = facts(spark, "/root/testdata/sf0.001").withColumns({"internal_links": F.array("url"), "external_links": F.array().cast("array<string>")})
    issues = audit.page_issues(f)
    stale = f.withColumns({"geo_score": F.lit(1), "a11y_score": F.lit(1)})
    pages, site = result.recompute(stale, issues)
    again, site2 = result.recompute(pages, issues)
    assert site.first() == site2.first() and sorted(map(str, pages.collect())) == sorted(map(str, again.select(*pages.columns).collect()))
    assert {r["page_id"]: r["geo_score"] for r in pages.collect()} == {r["page_id"]: r["geo_score"] for r in f.collect()} and pages.where("status <> 200 AND seo_score <> 0").isEmpty()
    assert result.fails_score(site, 101) and not result.fails_score(site, 0)
    doc = json.loads("".join(result.result_json({"url": "x"}, pages.select("url"), issues, {"pages": 50}, {"robotsFound": True}, "error")))
    assert list(doc) == ["config", "pages", "issues", "summary", "robotsFound", "sitemapUrls", "sitemapFound", "startedAt"] and len(doc["pages"]) == 50 and {i["severity"] for i in doc["issues"]} == {"error"}
    text = result.text_report("x", site.first().asDict(), scores.summary(f, issues).first().asDict(), issues, statuses=scores.histogram(f, "status"), graph={"orphans": 1, "dead_ends": 2, "reciprocal_pairs": 3, "max_depth": 4}, authorities=[{"link_score": 100.0, "url": "u"}])
    assert all(x in text for x in ("Top fixes", "Status codes", "Link graph", "Top authority", "Issues"))
    assert set(result.crawl_payload(f, issues, site)) == {"scores", "summary", "topFixes", "geoGaps", "issuesByRule", "byStatus", "byDepth", "linkGraph"}
    assert sum(len(r["issues"]) for r in result.page_with_issues(f.select("url").distinct(), issues).collect()) == issues.count()
    assert result.search_pages(f, "EXAMPLE", status=404).where("status <> 404").isEmpty() and result.sort_pages(f, "depth", True).first()["depth"] == 5
    totals = result.delta_totals(store.issue_changes(issues.limit(0), issues)).first()
    assert (totals["change"], totals["issues"]) == ("new", issues.count()) and {"why", "category"} <= set(triage.top_fixes(issues).columns)
    old = f.select("url", F.lit("h").alias("content_hash"))
    assert result.rescore_changed(old, old.limit(3).withColumn("content_hash", F.lit("i"))).count() == 3 and result.rescore_changed(old, old).isEmpty()
    assert (result.status_class(0), result.status_class(302), result.status_label(0), result.milliseconds(1500), result.milliseconds(12_000), result.size(2_000_000), result.size(1536), result.short_url("https://a.com/?q"), result.short_url("https://a.com")) == ("status-0", "status-3xx", "ERR", "1.5s", "12s", "1.9 MB", "2 KB", "/?q", "a.com")
    assert result.csv_field('a"b') == '"a""b"' and result.truncate("abc", 2) == "ab…" and result.wrap("a " * 50).count("\n") == 1
    s = scope.plan("site", "http://A.com/#x")
    assert (s.seeds, s.host, s.max_depth) == (("http://a.com/",), "a.com", 16) and scope.rebase(s, "https://www.a.com/").redirected_from == "http://a.com/" and scope.rebase(s, "https://a.com/") == s
    assert scope.plan("list", listed=["https://a/1", "https://a/2", "https://a/1#x"]).seeds == ("https://a/1", "https://a/2") and scope.plan("page", "https://a/").max_depth == 0
    with pytest.raises(ValueError):
        scope.plan("site", "ftp://x")
    chain = spark.createDataFrame([(i, f"https://a/{i}", f"https://a/{i}", [f"https://a/{i + 1}", f"https://a/{i + 2}"], []) for i in range(9)], "page_id long, url string, final_url string, internal_links array<string>, external_links array<string>")
    assert sorted(tuple(r) for r in scope.frontier(chain, scope.plan("site", "https://a/0"), 4).collect()) == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert scope.frontier(chain, scope.plan("page", "https://a/0")).count() == 1


def test_store_is_whole_or_absent(spark, tmp_path):
    st = store.CrawlStore(spark, f"file://{tmp_path}")
    pages = spark.createDataFrame([(0, "https://a/"), (1, "https://a/b")], "page_id long, url string")
    issues = spark.createDataFrame([("https://a/", "r")], "url string, rule string")
    meta = lambda at: spark.createDataFrame([(at,)], "created_at long")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    st.save("one", pages, issues, meta(1), edges)
    st.save("two", pages, issues, meta(2), edges)
    with pytest.raises(Exception):  # breaks off while issues are written
        st.save("two", pages.limit(1), issues.select(F.raise_error(F.lit("no")).alias("url")), meta(3))
    assert [r["crawl_id"] for r in st.crawls().collect()] == ["one"] and st.load("pages").count() == 2 and st.load("edges", "one").count() == 1
    st.update_pages("one", spark.createDataFrame([(1, 7)], "page_id long, inlinks long"))
    assert {r["page_id"]: r["inlinks"] for r in st.load("pages", "one").collect()} == {0: None, 1: 7} and st.next_id("one") == 2 and st.latest() == "one"


def test_stopping_early(spark, tmp_path):
    import pathlib

    for i in range(4):
        spark.range(10).write.parquet(f"{tmp_path}/in{i}")
    (tmp_path / "all").mkdir()
    for i in range(4):
        for j, f in enumerate(pathlib.Path(f"{tmp_path}/in{i}").glob("*.parquet")):
            f.rename(f"{tmp_path}/all/{i}-{j}.parquet")
    stream = cs.read_stream(spark, f"{tmp_path}/all", "id long")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="0 seconds").start()
    assert cs.stop_after(query, 10) >= 10 and spark.read.parquet(f"{tmp_path}/out").count() >= 5


def test_pack_folders(tmp_path):
    pk.new_pack("mine", str(tmp_path))
    assert len(pk.resolve_pack("mine", home=str(tmp_path)).rules) == 3 and pk.which_pack("mine", home=str(tmp_path)) == "global" and pk.which_pack("slop-default") == "built-in"
    assert len(pk.parse_pack(pk.init_packs(str(tmp_path)).read_text()).rules) == 10
