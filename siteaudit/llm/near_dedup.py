"""MinHash near-deduplication with b-bit signatures.

1. One pass over whole texts makes each document's set of k-word shingles, the hash
   of that set, band keys from full minima, and the low `BITS` bits of all minima,
   packed into longs.
2. Documents of equal sets become one class (partial aggregation, so copies by the
   million collapse before the shuffle). Classes are the nodes of what follows, known
   by the hash of their set.
3. Classes that share a band key meet: first each with its bucket's least class, which
   is a random one, as classes are hashes (a star: linear in the bucket). Packed
   signatures estimate the similarity by bit
   counts, corrected for chance collisions of low bits; pairs far below the
   threshold go. The rest are confirmed on the full sets, recomputed from the texts.
4. Components of the confirmed links; later links join components, so only these few
   are searched again. Buckets that still hold several components are joined with
   themselves on the band key, with the estimate inside the join condition. So a pair
   that shares a band is either in one component already, far below the threshold by
   estimate, or confirmed exactly. It is done twice, first for the likely pairs, whose
   links leave fewer of the doubtful ones. This join looks, in each bucket, at every class
   outside the bucket's largest component with every class of the bucket; only pairs
   that pass leave it. `comparisons` measures how many it looks at.

With 32 bands of 5 rows a pair at similarity 0.8 shares no band with probability
3e-6, one at 0.85 with 2e-8. The estimate (640 minima of two bits) drops a pair
only when it is 4.5 standard deviations (0.085) below the threshold. Two bits take
half the room of four, and keep the compiled comparison of two signatures below the
size from which the JVM only interprets (0.3 instead of 11 microseconds a pair). Sets are told
apart by 64-bit hashes: among a billion different texts two are taken for one with
probability 3 percent.

Texts go only where they are compared: up to `SMALL` pairs are broadcast to the
texts (24 bytes each), more are joined by shuffle; where few texts are in many pairs and
take `TEXT_BYTES` at most, they are broadcast to the pairs instead.

Nulls and empty texts have empty sets and are linked with nothing. Texts of fewer
than k words are one shingle. Very long texts are read whole and take memory in
proportion to themselves. Every row is a document of its own: rows that repeat a
doc_id are linked by their texts alone. A null doc_id is linked like any other;
component_id is the smallest doc_id of the group that isn't null, and null if there
is none (kept is then true). An empty table gives an empty result. Extra columns pass
through `remove_near_duplicates` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import connected_components
from .shared import cut, free_name

BANDS, ROWS = 32, 5
#: Minima of a signature (the first BANDS * ROWS also make the bands) and the low bits kept of each.
MINIMA, BITS = 640, 2
#: Longs of a packed signature.
LONGS = MINIMA * BITS // 64
#: Pairs (or keys of rows that go) that are broadcast at most.
SMALL = 500_000
#: Texts that are broadcast to pairs: bytes at most, where each is in this many pairs on average.
TEXT_BYTES, REPEATS = 16 << 20, 8
#: Standard deviations below the threshold at which an estimate drops a pair.
MARGIN = 4.5

_rng = np.random.default_rng(97)
_MULT = (_rng.integers(0, 2**31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)

_SIGNED = "doc_id long, tie long, n_shingles long, node long, bands array<long>, sig array<long>"


def shingle_sets(block: tb.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a block, sorted within each, and each text's first."""
    w = tb.words(block, tb.NONSPACE)
    rows = block.hi - block.lo
    counts = w.counts()
    windows = tb.window_hashes(w.hashes, k)
    text = np.repeat(np.arange(rows), np.maximum(counts - k + 1, 0))
    start = np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(np.maximum(counts - k + 1, 0))[:-1])), np.maximum(counts - k + 1, 0))
    h = windows[start + np.arange(len(start))] if len(start) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.array([tb.window_hashes(w.hashes[w.first[r] : w.first[r + 1]], int(counts[r]))[0] for r in short.tolist()], np.uint64)
        h, text = np.concatenate([h, own]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(rows + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the non-empty sets: their hashes, band keys (n x BANDS) and packed signatures (n x LONGS)."""
    size = np.diff(first)
    full = np.flatnonzero(size)
    at = first[:-1][full]
    if not len(full):
        zero = np.zeros(0, np.int64)
        return zero, np.zeros((0, BANDS), np.int64), np.zeros((0, LONGS), np.int64)
    node = tb.mix(np.add.reduceat(tb.mix(h), at) + size[full].astype(np.uint64))
    small = (h >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((len(full), MINIMA), np.uint32)
    for j in range(MINIMA):
        minima[:, j] = np.minimum.reduceat(small * _MULT[j] + _ADD[j], at)
    wide = minima.astype(np.uint64)
    bands = np.empty((len(full), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, j])
        bands[:, b] = key
    # Low bits of linear hashes are alike across minima; those of the mixed minimum are not.
    low = tb.mix(wide + np.arange(MINIMA, dtype=np.uint64) * np.uint64(1 << 33)) & np.uint64((1 << BITS) - 1)
    each = 64 // BITS
    low = low.reshape(len(full), LONGS, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS))
    sig = np.bitwise_or.reduce(low, axis=2)
    return node.view(np.int64), bands.view(np.int64), sig.view(np.int64)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(2)):
                h, first = shingle_sets(block, k)
                size = np.diff(first)
                node, bands, sig = signatures(h, first)
                full = size > 0
                wide = np.zeros(len(size), np.int64)
                wide[full] = node
                lists = []
                for values, width in ((bands, BANDS), (sig, LONGS)):
                    offsets = np.concatenate(([0], np.cumsum(full * width))).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())))
                ids = (batch.column(i)[block.lo : block.hi] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(size.astype(np.int64)), pa.array(wide, mask=~full), *lists], names=["doc_id", "tie", "n_shingles", "node", "bands", "sig"])

    return run


def wide(side: str, sig: str = "sig") -> list[Column]:
    """A packed signature as a column for each long: what is compiled from them stays small enough for the JVM to compile in turn."""
    return [F.coalesce(F.col(sig)[i], F.lit(0)).alias(f"{side}{i}") for i in range(LONGS)]


def _same(a: str, b: str, longs: int = LONGS) -> Column:
    """Matching minima in the first longs of two signatures (columns as from `wide`), by bit counts."""
    lanes = sum(1 << i for i in range(0, 64, BITS))
    total: Column = F.lit(0)
    for i in range(longs):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        shift = 1
        while shift < BITS:  # gather each lane's bits in its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        total = total + F.bit_count(x.bitwiseAND(F.lit(lanes if lanes < 2**63 else lanes - 2**64)))
    return F.lit(longs * 64 // BITS) - total


def estimate(a: str, b: str) -> Column:
    """Jaccard similarity by matching low bits, corrected for chance collisions."""
    chance = 2.0**-BITS
    return (_same(a, b) / F.lit(float(MINIMA)) - chance) / (1.0 - chance)


def cutoff(threshold: float, minima: int = MINIMA, margin: float = MARGIN) -> float:
    chance = 2.0**-BITS
    match = threshold + (1 - threshold) * chance
    return threshold - margin * float(np.sqrt(match * (1 - match) / minima)) / (1 - chance)


def close(a: str, b: str, threshold: float, margin: float = MARGIN) -> Column:
    """The estimate isn't below the cutoff; a first look at a fifth of the minima, with its own cutoff, spares most pairs the rest."""
    chance = 2.0**-BITS
    least = lambda n, m: int(np.ceil((cutoff(threshold, n, m) * (1 - chance) + chance) * n - 1e-9))
    few = LONGS // 5 * 64 // BITS
    return (_same(a, b, LONGS // 5) >= least(few, MARGIN)) & (_same(a, b) >= least(MINIMA, margin))


def _confirm(k: int, num: int, den: int):
    """Pairs (a, b, text_a, text_b), those of one a close together, to the pairs that are links."""

    def sets(texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for block in tb.blocks(pa.array(texts, pa.large_utf8())):
            h, first = shingle_sets(block, k)
            out += [h[first[r] : first[r + 1]] for r in range(block.hi - block.lo)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                others, keep = sets(part.column(3).to_pylist()), []
                for i, text in enumerate(part.column(2)):
                    text = text.as_py()
                    if text != held[0]:
                        held = (text, sets([text])[0])
                    mine, other = held[1], others[i]
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep.append(den * both >= num * (len(mine) + len(other) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int, small: int) -> DataFrame:
    """Those of the pairs (a, tie_a, b, tie_b) whose full sets are similar enough, as (a, b); texts: (tie, text).

    The text of b comes to its pairs, then goes to its a; a hot a is split by Spark's skew join.
    """
    n = pairs.count()
    near = F.broadcast if n <= small else lambda df: df
    # The distinct texts of either side, so that no row is made for each pair twice over.
    need = cut(pairs.select(F.col("tie_a").alias("tie")).distinct().union(pairs.select("tie_b").distinct()).distinct())
    if 0 < REPEATS * need.count() <= n <= small:
        # Few texts in many pairs: they are written once, and broadcast if their size allows it.
        texts = cut(texts.join(F.broadcast(need), "tie"))
        if texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] <= TEXT_BYTES:
            side = lambda s: F.broadcast(texts.withColumnsRenamed({"tie": f"tie_{s}", "text": f"text_{s}"}))
            both = pairs.sortWithinPartitions("a").join(side("b"), "tie_b").join(side("a"), "tie_a")
            return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, num, den), "a long, b long").distinct()
    one = texts.withColumnsRenamed({"tie": "tie_b", "text": "text_b"}).join(near(pairs), "tie_b").select("a", "b", "text_b")
    lead = texts.withColumnsRenamed({"tie": "tie_a", "text": "text_a"}).join(near(pairs.select("a", "tie_a").distinct()), "tie_a").select("a", "text_a")
    return one.join(lead, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, num, den), "a long, b long").distinct()


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after further links; components that were found before are searched as one node each."""
    if labels is None:
        return connected_components(links)
    of = lambda s: labels.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    moved = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.select(F.col("component").alias("node"), F.col("to").alias("component")).join(labels, "node", "left_anti")
    return cut(old.union(new))


def _placed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, c) of shared buckets; a class without links is its own component."""
    return shared.select("band", "node").join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))


def outsiders(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, c, big) of the buckets that hold several components, and the component that has most of the bucket."""
    here = _placed(shared, labels)
    sizes = here.groupBy("band", "c").agg(F.count("*").alias("m"))
    big = sizes.groupBy("band").agg(F.max_by("c", F.struct("m", "c")).alias("big"), F.count("*").alias("several")).where("several > 1").select("band", "big")
    return here.join(big, "band")


def comparisons(buckets: DataFrame) -> tuple[int, int, int]:
    """Of `outsiders`: the largest bucket, the pairs that the last join looks at in the bucket with most, and in all."""
    n = buckets.groupBy("band").agg(F.count("*").alias("m"), F.count_if(F.col("c") != F.col("big")).alias("out"))
    pairs = F.col("m") * F.col("out")
    return tuple(n.agg(*(F.coalesce(x, F.lit(0)) for x in (F.max("m"), F.max(pairs), F.sum(pairs)))).first())


def signed_documents(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tie, n_shingles, node, bands, sig) of docs (doc_id, tie, text); node is null for an empty set."""
    return cut(docs.select("doc_id", "tie", "text").mapInArrow(_sign(k), _SIGNED))


def components_of(signed: DataFrame, docs: DataFrame, *, k: int, num: int, den: int, small: int = SMALL) -> DataFrame:
    """(node, component, least, tie) of each class: its component, its least doc_id (nulls last) and the tie of a text of it."""
    known = signed.where(F.col("node").isNotNull())
    reps = cut(known.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("tie").alias("tie"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sig"))))
    texts = docs.select("tie", "text")
    if not known.groupBy("tie").count().where("count > 1").isEmpty():  # rows alike in every column: one text will do
        texts = texts.join(known.select("tie").distinct(), "tie", "left_semi").dropDuplicates(["tie"])
    bands = reps.select(F.explode("bands").alias("band"), "node")
    buckets = bands.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("band", "a")
    shared = cut(bands.join(buckets, "band"))
    # Sets of very different sizes can't be similar enough.
    fits = lambda x, y, margin=MARGIN: (den * F.least(f"n_{x}", f"n_{y}") >= num * F.greatest(f"n_{x}", f"n_{y}")) & close(x, y, num / den, margin)
    of = lambda s: reps.select(F.col("node").alias(s), F.col("tie").alias(f"tie_{s}"), F.col("n_shingles").alias(f"n_{s}"), *wide(s))

    pairs = shared.where("a != node").select("a", F.col("node").alias("b")).distinct()
    pairs = cut(pairs.join(of("b"), "b").join(of("a"), "a").where(fits("a", "b")).select("a", "tie_a", "b", "tie_b"))
    tried, labels = pairs.select("a", "b"), _relabel(None, cut(_verified(pairs, texts, k, num, den, small)))
    # First the likely links, whose components leave fewer of the doubtful pairs to be confirmed; then all that the estimate can't rule out.
    for margin in (0.0, MARGIN):
        here = outsiders(shared, labels).join(reps.select("node", "tie", F.col("n_shingles").alias("n"), "sig", "bands"), "node")
        x, y = (here.select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "tie", "c", "big", "n", "bands")), *wide(s)) for s in "xy")
        across = (F.col("c_x") != F.col("c_y")) & ((F.col("c_y") == F.col("big_y")) | (F.col("c_x") < F.col("c_y")))
        # Every bucket that a pair shares looks at it once; the least band gives it.
        earlier = F.exists(F.arrays_zip("bands_x", "bands_y"), lambda z: (z["bands_x"] == z["bands_y"]) & (z["bands_x"] < x["band"]))
        found = x.where("c_x != big_x").join(y, (x["band"] == y["band"]) & across & fits("x", "y", margin) & ~earlier)
        first = F.col("node_x") < F.col("node_y")
        ends = [F.when(first, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(n) for c, n in (("node", "a"), ("tie", "tie_a"))]
        ends += [F.when(first, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")).alias(n) for c, n in (("node", "b"), ("tie", "tie_b"))]
        pairs = cut(found.select(*ends).join(tried, ["a", "b"], "left_anti"))
        links = cut(_verified(pairs, texts, k, num, den, small))
        tried = tried.union(pairs.select("a", "b"))
        if not links.isEmpty():
            labels = _relabel(labels, links)
    out = reps.select("node", "least", "tie").join(labels, "node", "left")
    return out.select("node", F.coalesce("component", "node").alias("component"), "least", "tie")


def near_duplicate_classes(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Links: documents whose k-word shingle sets have den * intersection >= num * union.
    """
    docs = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("doc_id", "text"))
    signed = signed_documents(docs, k)
    classes = cut(components_of(signed, docs, k=k, num=num, den=den, small=small))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of = classes.select("node", "component").join(least, "component").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = signed.select("doc_id", "n_shingles", "node").join(of, "node", "left").withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def remove_near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, small: int = SMALL) -> DataFrame:
    """docs with one row of each group of near duplicates, one of the smallest doc_id (nulls last).

    Rows are told apart by the hash of all their columns; of rows alike in every column one stays. Rows without words
    are no duplicates of anything and all stay.
    """
    tie, gone = free_name(docs, "row_tie"), free_name(docs, "gone")
    keyed = docs.withColumn(tie, F.xxhash64(*docs.columns))
    narrow = keyed.select("doc_id", F.col(tie).alias("tie"), "text")
    signed = signed_documents(narrow, k)
    classes = components_of(signed, narrow, k=k, num=num, den=den, small=small).select("node", "component")
    rows = signed.where(F.col("node").isNotNull()).groupBy("node", "tie").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("alike"))
    rows = cut(rows.join(classes, "node").select("component", "tie", "alike", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie").alias("place")))
    first = rows.groupBy("component").agg(F.min("place").alias("first"))
    out = cut(rows.join(first, "component").select("tie", "alike", (F.col("place") == F.col("first")).alias("stays")))
    near = lambda df: F.broadcast(df) if df.count() <= small else df
    left = keyed.join(near(out.where("NOT stays").select(F.col("tie").alias(gone))), F.col(tie) == F.col(gone), "left_anti")
    many = out.where("stays AND alike > 1").select(F.col("tie").alias(gone))
    if many.isEmpty():
        return left.drop(tie)
    one = left.join(near(many), F.col(tie) == F.col(gone), "left_semi").dropDuplicates([tie])
    return left.join(near(many), F.col(tie) == F.col(gone), "left_anti").union(one).drop(tie)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - least(4, len(w)) + 1)) AS i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)
), e AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
