"""Fetched responses as tables: bodies, headers, sitemaps, saved JSON, text files; and pages from them."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html, urls
from ..operators import scores

#: Locations that a sitemap gives and child sitemaps that an index gives, unless a caller says otherwise (None: all).
MAX_SITEMAP_URLS, MAX_SITEMAPS = 5000, 50


def decode(body: bytes, encoding: str) -> bytes:
    """An encoded body as plain bytes; as it is if it can't be decoded."""
    kind = (encoding or "").strip().lower()
    try:
        if kind in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if kind == "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompress(body, -zlib.MAX_WBITS)
        if kind == "br":  # decoded only where a brotli module is installed
            import brotli

            return brotli.decompress(body)
    except (OSError, EOFError, zlib.error, ImportError):
        return body
    return body


@F.pandas_udf(T.BinaryType())
def decode_body(body: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode(bytes(b), e) for b, e in zip(body, encoding)], dtype=object)


def with_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Columns of the headers that pages keep, from a map whose names may have any case."""
    low = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    get = lambda name: F.try_element_at(low, F.lit(name))
    return df.withColumns(
        {"server": get("server"), "content_encoding": get("content-encoding"), "cache_control": get("cache-control"), "x_robots_tag": get("x-robots-tag"), "content_type": get("content-type"), "hsts": get("strict-transport-security").isNotNull()}
    )


def sitemap_urls(xml: Column, most: int | None = MAX_SITEMAP_URLS) -> Column:
    """Distinct locations of a sitemap in order of appearance, the first `most` (None: all)."""
    found = F.regexp_extract_all(xml, F.lit("(?s)<loc>(.*?)</loc>"), F.lit(1))
    clean = F.transform(found, lambda u: F.replace(F.regexp_replace(u, r"(?U)^\s+|\s+$", ""), F.lit("&amp;"), F.lit("&")))
    found = F.array_distinct(F.filter(clean, lambda u: u != ""))
    return found if most is None else F.slice(found, 1, most)


def sitemap_table(files: DataFrame, most: int | None = MAX_SITEMAP_URLS, children: int | None = MAX_SITEMAPS) -> DataFrame:
    """(pos, loc) of sitemap files (url, xml): indexes are followed one level, first-seen wins."""
    each = files.select("url", F.lower("xml").contains("<sitemapindex").alias("index"), sitemap_urls(F.col("xml"), most).alias("locs"))
    child = each.where("index").select(F.posexplode("locs" if children is None else F.slice("locs", 1, children)).alias("o", "child"))
    roots = each.where("NOT index").join(child, F.col("url") == F.col("child"), "left").select(F.coalesce("o", F.lit(-1)).alias("o"), "locs")
    return roots.select("o", F.posexplode("locs").alias("i", "loc")).groupBy("loc").agg(F.min(F.struct("o", "i")).alias("pos")).orderBy("pos").limit(2**31 - 1 if most is None else most)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("name"), F.col("value").alias("text"))


def read_saved_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Saved crawls of an older form: JSON documents; missing fields are null, broken documents are left out."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("_broken", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", True).json(path).where("_broken IS NULL").drop("_broken")


# ---- pages ----
#: Metadata that the test pages don't have, derived from page_id in plain SQL that both engines read alike.
CRAWL_SQL = """
SELECT page_id, url, url AS final_url, html,
       CASE page_id % 20 WHEN 0 THEN 404 WHEN 7 THEN 500 ELSE 200 END AS status,
       CAST(page_id % 6 AS INT) AS depth, (page_id * 37) % 4000 AS response_time_ms,
       CAST(octet_length({encoded}) AS BIGINT) AS size_bytes, page_id % 3 = 0 AS hsts,
       CASE WHEN page_id % 2 = 0 THEN 'gzip' END AS content_encoding, 'text/html; charset=utf-8' AS content_type
FROM pages
"""


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test pages as a crawl."""
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("siteaudit_pages")
    return spark.sql(CRAWL_SQL.format(encoded="html").replace("FROM pages", "FROM siteaudit_pages"))


def indexability(status: Column, meta_robots: Column, x_robots: Column, canonicalized: Column) -> Column:
    """Why a page can't be indexed; null if nothing says so. Directives win over the status, a canonical comes last."""
    by_status = F.when(status == 0, "Connection Error").when(status.between(300, 399), "Redirect").when(status.between(400, 499), "Client Error").when(status >= 500, "Server Error")
    noindex = F.coalesce(meta_robots.contains("noindex"), F.lit(False)) | F.coalesce(F.lower(x_robots).contains("noindex"), F.lit(False))
    return F.when(noindex, "Noindex").otherwise(F.coalesce(by_status, F.when(canonicalized, "Canonicalised")))


def failed_responses(failed: DataFrame) -> DataFrame:
    """Responses of fetches that gave no answer, from (page_id, url, depth, error): status 0, nothing else; unite them by name with the others."""
    zero = {"status": F.lit(0), "response_time_ms": F.lit(0).cast("long"), "size_bytes": F.lit(0).cast("long"), "hsts": F.lit(False), "hops": F.lit(0)}
    null = {c: F.lit(None).cast("string") for c in ("html", "content_type", "content_encoding")}
    return failed.select("page_id", "url", F.col("url").alias("final_url"), "depth", "error").withColumns({**zero, **null})


def decoded_html(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses with html from binary bodies: decoded by their content encoding; size_bytes is that of the plain body."""
    plain = F.coalesce(decode_body(body, "content_encoding"), F.col(body))
    return responses.withColumn(body, plain).withColumns({"html": F.decode(F.col(body), "UTF-8"), "size_bytes": F.octet_length(body).cast("long")}).drop(body)


def build_pages(responses: DataFrame) -> DataFrame:
    """Pages with all facts of their own: parsed signals, indexability, scores, and the normal forms of both urls that joins use.

    Only bodies whose content type is HTML are parsed. Call it once and write the result.
    """
    is_html = F.coalesce(F.col("content_type").contains("text/html") | F.col("content_type").contains("application/xhtml"), F.lit(False))
    p = responses.withColumn("html", F.when(is_html, F.col("html")))
    for name, kind in (("x_robots_tag", "string"), ("error", "string"), ("content_encoding", "string")):
        if name not in p.columns:
            p = p.withColumn(name, F.lit(None).cast(kind))
    if "hops" not in p.columns:
        p = p.withColumn("hops", F.lit(0))
    p = p.withColumn("_parsed", F.col("html").isNotNull()).withColumn("_s", html.parse_html("final_url", "html"))
    p = p.select(*[c for c in p.columns if c not in ("_s", "html")], "_s.*")
    p = p.withColumns({"url_key": urls.norm_url("url"), "final_url_key": urls.norm_url("final_url")})
    canonicalized = F.col("canonical").isNotNull() & (urls.norm_url("canonical") != F.col("final_url_key"))
    p = p.withColumn("canonicalized", F.coalesce(canonicalized, F.lit(False)))
    p = p.withColumn("indexability", indexability(F.col("status"), F.col("meta_robots"), F.col("x_robots_tag"), F.col("canonicalized")))
    indexable = (F.col("status") == 200) & F.col("_parsed") & F.col("indexability").isNull()
    p = p.withColumns({"indexable": indexable, "h1_count": F.size("h1"), "n_internal": F.size("internal_links"), "n_schema_types": F.size("schema_types"), "structured_data": F.size("schema_types") > 0, "hreflang_langs": F.transform("hreflang", lambda h: h["lang"])})
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    p = p.withColumn("content_hash", F.when(F.col("word_count") >= 20, F.sha2(lowered, 256)))
    return p.withColumns({"rendered": F.lit(False), "pre_render_word_count": F.col("word_count"), "geo_score": scores.geo_score(), "a11y_score": scores.a11y_score()}).drop("_parsed")
