"""Links, graphs and authority."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .cuts import cut

ITERATIONS, DAMPING = 40, 0.85
#: Edges and pages of one crawl that a single task ranks at most; larger crawls iterate as DataFrames, with the same ranks.
TASK_EDGES = 20_000_000


def key_of(df: DataFrame, name: str) -> Column:
    """The normal form of a url column: `<name>_key` where the table has it (as from build_pages and page_links), else worked out here."""
    return F.col(f"{name}_key") if f"{name}_key" in df.columns else urls.norm_url(name)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, link, link_key, internal): internal links first, as on the page. Parsed links are in normal form already."""
    inner = pages.select("page_id", "url", F.posexplode("internal_links").alias("pos", "link"), F.lit(True).alias("internal"))
    outer = pages.select("page_id", "url", F.posexplode("external_links").alias("pos", "link"), F.lit(False).alias("internal"))
    return inner.unionByName(outer).withColumn("link_key", F.col("link"))


def inlink_counts(links: DataFrame) -> DataFrame:
    """(dst, inlinks) of internal links by the target's normal form; links to itself and to unknown pages count."""
    each = links.where("internal")
    return each.groupBy(key_of(each, "link").alias("dst")).agg(F.count("*").alias("inlinks"))


def with_inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    pages = pages.withColumn("_to", key_of(pages, "final_url"))
    return pages.join(inlink_counts(links), F.col("_to") == F.col("dst"), "left").drop("dst", "_to").withColumn("inlinks", F.coalesce("inlinks", F.lit(0)))


def _both_keys(pages: DataFrame, *values: Column) -> DataFrame:
    """(key, *values, o): a row for each page's final_url and one for its url."""
    row = lambda name, o: F.struct(key_of(pages, name).alias("key"), F.lit(o).alias("o"))
    return pages.select(*values, F.explode(F.array(row("final_url", 0), row("url", 1))).alias("k")).select("k.key", "k.o", "*").drop("k")


def page_index(pages: DataFrame) -> DataFrame:
    """(key, id): the normal forms of each final_url and url, the first writer's."""
    return _both_keys(pages, F.col("page_id").alias("id")).groupBy("key").agg(F.min_by("id", F.struct("id", "o")).alias("id"))


def status_map(pages: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """(key, status): the normal forms of each final_url and url, the last writer's; verified targets (url, status) fill in what no page says."""
    both = _both_keys(pages, F.col("page_id"), F.col("status").cast("int").alias("status"))
    if verified is not None:
        more = verified.select(F.lit(None).cast("long").alias("page_id"), F.col("status").cast("int").alias("status"), key_of(verified, "url").alias("key"), F.lit(-1).alias("o"))
        both = both.unionByName(more)
    return both.groupBy("key").agg(F.max_by("status", F.struct(F.col("o") >= 0, "page_id", "o", "status")).alias("status"))


def is_broken(status: Column) -> Column:
    return status.isin(0, 404, 410) | (status >= 500)


def broken_links(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """(url, link, status) of links whose target is known to fail."""
    bad = statuses.where(is_broken(F.col("status")))
    return links.withColumn("_to", key_of(links, "link")).join(bad, F.col("_to") == F.col("key")).select("url", "link", "status")


def verify_targets(links: DataFrame, statuses: DataFrame, most: int | None = 1500) -> DataFrame:
    """Distinct link targets of unknown status, the first `most` by first appearance (None: all)."""
    new = links.withColumn("_to", key_of(links, "link")).join(statuses, F.col("_to") == F.col("key"), "left_anti")
    at = F.struct("page_id", (~F.col("internal")).alias("outer"), "pos")
    found = new.groupBy("_to").agg(F.min_by("link", at).alias("link"), F.min(at).alias("at"))
    return found.select("link") if most is None else found.orderBy("at", "link").limit(most).select("link")


def adjacency(links: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst): distinct internal links between known pages, without loops."""
    e = links.where("internal").withColumn("_to", key_of(links, "link"))
    e = e.join(index, F.col("_to") == index["key"]).select(F.col("page_id").alias("src"), F.col("id").alias("dst"))
    return e.where("src <> dst").distinct()


def link_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds outlinks and inlinks from edges to (id, ...)."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outlinks"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inlinks"))
    return nodes.join(out, "id", "left").join(into, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("outlinks", "inlinks")})


def reciprocal_pairs(edges: DataFrame) -> DataFrame:
    """One row: pairs of pages that link to each other."""
    back = edges.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
    return edges.join(back, (F.col("src") == F.col("d2")) & (F.col("dst") == F.col("s2")), "left_semi").where("src < dst").agg(F.count("*").alias("reciprocal_pairs"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over nodes (id, depth, inlinks, outlinks, status, indexable, n_internal)."""
    n = nodes.agg(
        F.count_if((F.col("depth") > 0) & (F.col("inlinks") == 0)).alias("orphans"), F.count_if((F.col("status") == 200) & F.col("indexable") & (F.col("n_internal") == 0)).alias("dead_ends"),
        F.max("depth").alias("max_depth"), (F.sum("outlinks") / F.count("*")).alias("avg_outlinks"),
    )
    return n.crossJoin(reciprocal_pairs(edges))


def top(nodes: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k largest, ties in page order, with their place."""
    best = nodes.orderBy(F.desc(by), "id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), "id")))


def _rank(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    deg = np.bincount(src, minlength=n).astype(float)
    rank = np.full(n, 1.0 / n)
    for _ in range(ITERATIONS):
        share = np.divide(rank, deg, out=np.zeros(n), where=deg > 0)
        new = np.bincount(dst, DAMPING * share[src], n) + (1 - DAMPING) / n + DAMPING * rank[deg == 0].sum() / n
        rank = new
    return np.clip(rank / rank.max() * 100, 0, 100)


def pagerank(nodes: DataFrame, edges: DataFrame, *, crawl: str | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, link_score): damping 0.85, 40 rounds, ranks of pages without links spread evenly, scaled to 100.

    With `crawl`, a column of both tables, each crawl is ranked for itself and keeps the column. Edges from or to unknown
    nodes, loops and repeated edges count for nothing. The size is checked: a crawl of at most `task_edges` edges and
    pages is ranked in one task, as arrays; if any is larger, all iterate as DataFrames.
    """
    g = F.lit(0).alias("g") if crawl is None else F.col(crawl).alias("g")
    v = nodes.select(g, F.col("id").cast("long").alias("id")).distinct()
    e = edges.select(g, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct()
    e = e.join(v.withColumnRenamed("id", "src"), ["g", "src"], "left_semi").join(v.withColumnRenamed("id", "dst"), ["g", "dst"], "left_semi")
    # Nodes are rows without a target; the kind says so, as a null would turn ids into floating point numbers.
    both = cut(v.select("g", F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(True).alias("node")).union(e.select("g", "src", "dst", F.lit(False))))
    most = both.groupBy("g").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if most > task_edges:
        out = _pagerank_frames(both.where("node").select("g", F.col("src").alias("id")), both.where("NOT node").select("g", "src", "dst"))
    else:
        kind = both.schema["g"].dataType.simpleString()

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            node = pdf["node"].to_numpy(bool)
            src, dst = (pdf[c].to_numpy(np.int64) for c in ("src", "dst"))
            known = np.sort(src[node])
            rank = _rank(len(known), np.searchsorted(known, src[~node]), np.searchsorted(known, dst[~node])) if len(known) else np.zeros(0)
            return pd.DataFrame({"g": [key[0]] * len(known), "id": known, "link_score": rank})

        out = both.groupBy("g").applyInPandas(run, f"g {kind}, id long, link_score double")
    return out.select("id", "link_score") if crawl is None else out.withColumnRenamed("g", crawl)


def _pagerank_frames(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, id, link_score) of clean nodes (g, id) and edges (g, src, dst); a checkpoint every fifth round."""
    n = nodes.groupBy("g").agg(F.count("*").alias("n"))
    deg = edges.groupBy("g", "src").agg(F.count("*").alias("deg"))
    base = cut(nodes.join(n, "g").join(deg.withColumnRenamed("src", "id"), ["g", "id"], "left"))
    rank = base.withColumn("r", 1.0 / F.col("n"))
    for i in range(ITERATIONS):
        lost = rank.groupBy("g").agg(F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("r"))), F.lit(0.0)).alias("lost"))
        share = rank.where("deg IS NOT NULL").select("g", F.col("id").alias("src"), (DAMPING * F.col("r") / F.col("deg")).alias("share"))
        into = edges.join(share, ["g", "src"]).groupBy("g", F.col("dst").alias("id")).agg(F.sum("share").alias("x"))
        rank = base.join(into, ["g", "id"], "left").join(lost, "g").withColumn("r", F.coalesce("x", F.lit(0.0)) + (1 - DAMPING) / F.col("n") + DAMPING * F.col("lost") / F.col("n")).drop("x", "lost")
        if i % 5 == 4:
            rank = cut(rank)
    best = rank.groupBy("g").agg(F.max("r").alias("best"))
    return rank.join(best, "g").select("g", "id", F.least(F.lit(100.0), F.col("r") / F.col("best") * 100).alias("link_score"))


def depths(edges: DataFrame, start: int | list[int], most: int = 16, max_pages: int | None = None) -> DataFrame:
    """(id, depth) by breadth-first levels: each level is an anti-join of new targets with the visited.

    With `max_pages`, a level that passes the limit keeps its least ids, and the search ends there.
    """
    spark = edges.sparkSession
    seeds = [start] if isinstance(start, int) else list(dict.fromkeys(start))
    seen = frontier = spark.createDataFrame([(x, 0) for x in seeds[:max_pages]], "id long, depth int")
    left = None if max_pages is None else max_pages - len(seeds[:max_pages])
    for level in range(1, most + 1):
        if left == 0:
            break
        new = edges.join(frontier, edges["src"] == frontier["id"]).select(F.col("dst").cast("long").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(level).alias("depth"))
        frontier = cut(new if left is None else new.orderBy("id").limit(left))
        found = frontier.count()
        if not found:
            break
        seen = seen.union(frontier)
        left = None if left is None else left - found
    return seen


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes below the start that nothing links to."""
    return nodes.where((F.col("depth") > 0) & (F.col("inlinks") == 0))


def dead_ends(nodes: DataFrame) -> DataFrame:
    """Indexable 200 pages without internal links."""
    return nodes.where((F.col("status") == 200) & F.col("indexable") & (F.col("n_internal") == 0))


def redirect_chains(hops: DataFrame, most: int = 10) -> DataFrame:
    """(start, target, hops) by following (src, dst) up to `most` hops; a hop to itself ends the chain."""
    hops = hops.where("src <> dst")
    at = hops.join(hops.select(F.col("dst").alias("d")), F.col("src") == F.col("d"), "left_anti").select(F.col("src").alias("start"), F.col("dst").alias("target"), F.lit(1).alias("hops"))
    for _ in range(most - 1):
        step = hops.select(F.col("src").alias("s"), F.col("dst").alias("n"))
        at = at.join(step, F.col("target") == F.col("s"), "left").select("start", F.coalesce("n", "target").alias("target"), (F.col("hops") + F.col("n").isNotNull().cast("int")).alias("hops"))
    return at
