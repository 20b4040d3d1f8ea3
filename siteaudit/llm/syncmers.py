"""Document fingerprints: closed syncmers.

A k-mer of code points is an anchor if the least hash of its s-mers is that of its
first or last one. Whether a k-mer is an anchor depends on its own characters only,
so a passage has the same anchors in any text that holds it. That also gives the
anchors of an edited text without scanning it again: those of the kept part, those
of the part put in, shifted, and those of the 2k - 2 characters around the seam.

Texts are cut by one regular expression into blocks of `BLOCK` k-mers that overlap
by k - 1 characters, so the cost is linear in the text and the working set is one
block. All expressions are Spark's own.

The fingerprint string is the base64 text of the anchors' low 32 hash bits in text
order. A text without a closed syncmer (each one shorter than k, and some of up to
2k - s - 2 characters) has one anchor, the hash of all of it; only an empty one has
none and an empty fingerprint. Likeness: 2 * common / total of the distinct anchors;
two empty texts are alike (1).

Nulls: a null text is empty; null doc_ids come last in descending order, by the hash of
their text, and are dealt over runs by it. Rows of one doc_id are ordered by the hash of
their text and share a run, which is sorted with spilling. A very long text is cut into
blocks like any other. Extra columns are ignored. A single document is its own next one;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let, text_or_empty

K, S = 32, 8
#: k-mer starts that one block holds.
BLOCK = 256
#: Documents that one ordered run holds about, and the most runs (their bounds are literals of the plan);
#: beyond run * most documents the runs get longer and are sorted with spilling.
RUN, MOST_RUNS = 1_000, 16_384


def _chunk(smers: Column, at: Column, k: int, s: int) -> Column:
    """Anchors of one block from its s-mers: (position, hash)."""
    w = k - s + 1

    def pick(h: Column) -> Column:
        def choose(span: int, least: Column) -> Column:
            """least[i]: the least of span hashes from i on. Spans double until two of them cover a window."""
            if 2 * span <= w:
                wider = F.zip_with(least, F.slice(least, span + 1, F.size(least) - span), lambda x, y: F.least(x, y))
                return let(wider, lambda m: choose(2 * span, m))
            edges = lambda i: F.least(h[i], h[i + (w - 1)])
            starts = F.filter(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.least(least[i], least[i + (w - span)]) == edges(i))
            # The k-mer's hash comes from the s-mers that tile it.
            return F.transform(starts, lambda i: F.struct((at + i).alias("p"), F.xxhash64(*(h[i + j] for j in [*range(0, w - 1, s), w - 1])).alias("h")))

        return choose(1, h)

    return F.when(F.size(smers) < w, F.array().cast("array<struct<p:int,h:bigint>>")).otherwise(let(F.transform(smers, lambda x: F.xxhash64(x)), pick))


def _none() -> Column:
    return F.array().cast("array<struct<p:int,h:bigint>>")


def _syncmers(text: Column, k: int, s: int) -> Column:
    """array<struct<p, h>> of a text: code point positions and hashes of its closed syncmers; it may have none."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{BLOCK + k - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    each = F.transform(blocks, lambda b, i: _chunk(F.regexp_extract_all(b, F.lit(f"(?s)(?=(.{{{s}}}))."), F.lit(1)), i * BLOCK, k, s))
    return F.when(F.length(text) >= k, F.flatten(each)).otherwise(_none())


def _or_whole(found: Column, text: Column) -> Column:
    """The syncmers found in a text; where there are none, one anchor for all of it."""
    whole = F.array(F.struct(F.lit(0).alias("p"), F.xxhash64(text).alias("h")))
    return let(found, lambda xs: F.when(F.size(xs) > 0, xs).when(F.length(text) > 0, whole).otherwise(_none()))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<p, h>> of a text: its closed syncmers, or one anchor for all of a text without."""
    return _or_whole(_syncmers(text, k, s), text)


def spliced(own: Column, text: Column, keep: Column, other: Column, put: Column, m: Column, k: int = K, s: int = S) -> Column:
    """Anchors of left(text, keep) + left(put, m), from the anchors of text and put."""
    lead = F.least(keep, F.lit(k - 1))
    seam = F.concat(F.substring(text, keep - lead + 1, lead), F.substring(put, F.lit(1), F.least(m, F.lit(k - 1))))
    move = lambda xs, by: F.transform(xs, lambda x: F.struct((x["p"] + by).cast("int").alias("p"), x["h"].alias("h")))
    kept = F.filter(own, lambda x: x["p"] + k <= keep)
    put_in = move(F.filter(other, lambda x: x["p"] + k <= m), keep)
    crossing = move(_syncmers(seam, k, s), keep - lead)
    # The anchor of a whole text is of another kind and doesn't carry over.
    cut = lambda xs, t, part: F.when(F.get(xs, F.lit(0))["h"] != F.xxhash64(t), part).otherwise(_none())
    found = F.concat(cut(own, text, kept), crossing, cut(other, put, put_in))
    return _or_whole(found, F.concat(F.substring(text, F.lit(1), keep), F.substring(put, F.lit(1), m)))


def packed(found: Column) -> Column:
    """The fingerprint string of anchors."""
    return F.base64(F.unhex(F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x["h"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """2 * common / total over the distinct low hashes of two anchor lists."""
    low = lambda xs: F.array_distinct(F.transform(xs, lambda x: x["h"].bitwiseAND(F.lit(0xFFFFFFFF))))
    pair = F.struct(low(a).alias("a"), low(b).alias("b"))
    return let(pair, lambda p: F.when(F.size(p["a"]) + F.size(p["b"]) == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(p["a"], p["b"])) / (F.size(p["a"]) + F.size(p["b"]))))


def next_documents(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text, anchors, next_text, next_anchors); next: in descending doc_id, after the last the first.

    Runs are ranges of doc_id between approximate quantiles. Texts are shuffled once,
    by run; the first row of each run also goes to the run before it.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    n, some = docs.agg(F.count("*"), F.count("doc_id")).first()
    parts = max(1, min(some // run, MOST_RUNS))
    bounds = []
    if parts > 1:
        q = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
        bounds = sorted(set(q))
    last = len(bounds)
    # Binary search: runs are numbered from the highest doc_ids down, null doc_ids in the last.
    edges = F.array(*(F.lit(x).cast("long") for x in bounds)) if bounds else F.array().cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(max(1, last.bit_length())))
    found = F.aggregate(
        steps, F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi")),
        lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(let(F.floor((acc["lo"] + acc["hi"]) / 2).cast("int"), lambda mid: F.when(edges[mid] <= F.col("doc_id"), F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi"))))),
        lambda acc: acc["lo"],
    ) if bounds else F.lit(0)
    # Rows without an id: their ties are spread evenly, so equal ranges of them are runs, in order of the tie.
    nulls = max(1, min((n - some) // run, MOST_RUNS))
    place = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * nulls).cast("int")
    placed = docs.withColumn("run", F.when(F.col("doc_id").isNull(), F.lit(last) + F.least(place, F.lit(nulls - 1))).otherwise(F.lit(last) - found).cast("int"))
    # The first row of each run, by narrow partial sums.
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), (~F.col("doc_id").isNull()).alias("n"), (-F.col("tie")).alias("t"))
    heads = placed.groupBy("run").agg(F.max(order).alias("o")).withColumn("prev", F.coalesce(F.lag("run").over(Window.orderBy("run")), F.max("run").over(Window.partitionBy())))
    heads = heads.select(F.col("run").alias("r"), "prev", F.col("o.d").alias("d"), F.col("o.t").alias("t"))
    ghost = placed.join(F.broadcast(heads), (F.col("run") == F.col("r")) & (F.coalesce(F.col("doc_id"), F.lit(-(2**63))) == F.col("d")) & (-F.col("tie") == F.col("t")))
    ghost = ghost.select("doc_id", "text", "tie", F.col("prev").alias("run"), F.lit(1).alias("ghost")).dropDuplicates(["run"])
    rows = placed.select("doc_id", "text", "tie", "run", F.lit(0).alias("ghost")).union(ghost.select("doc_id", "text", "tie", "run", "ghost"))
    rows = rows.repartition(F.col("run")).withColumn("anchors", anchors(F.col("text")))
    w = Window.partitionBy("run").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "tie")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_anchors", F.lead("anchors").over(w))
    return rows.where("ghost = 0").drop("ghost", "run", "tie")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The digest of op7."""
    rows = next_documents(docs)
    rows = rows.withColumn("n_chars", F.length("text")).withColumn("m", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("keep", F.col("n_chars") - F.col("m")).withColumn("m", F.least("m", F.length("next_text")))
    edited = F.concat(F.substring("text", 1, F.col("keep")), F.substring("next_text", 1, F.col("m")))
    rows = rows.withColumn("edited", edited)
    c = F.col
    theirs = spliced(c("anchors"), c("text"), c("keep"), c("next_anchors"), c("next_text"), c("m"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    out = rows.withColumn("theirs", theirs)
    return out.select(
        "doc_id", c("n_chars").cast("long").alias("n_chars"), "edited_sha256", packed(c("anchors")).alias("fingerprint"), packed(c("theirs")).alias("edited_fingerprint"),
        likeness(c("anchors"), c("theirs")).alias("near_edited"), likeness(c("anchors"), c("next_anchors")).alias("near_next"),
    )
