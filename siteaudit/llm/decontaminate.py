"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over token windows.

The windows of the benchmark items are hashed; the sorted hashes go to every
executor by broadcast, after their number is checked. Each task scans the rolling
window hashes of whole texts, looks the candidates up and verifies hits by
comparing the words themselves. No shuffle. A benchmark of more windows than
`max_windows` is scanned in blocks of that size, one pass and one checkpoint for
each, so that neither driver nor executors ever hold more than one block.

Nulls and texts without words: no hits, not contaminated. A very long text is scanned
whole, in memory proportional to itself. An empty table gives an empty result, an empty
benchmark no hits. Items without words
have no window; null item ids count as items but not in id lists. Repeated rows
are judged alike. Extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .shared import cut, free_name

#: Windows that one broadcast may hold: 24 bytes each and the items' texts.
MAX_WINDOWS = 2_000_000


class Grams:
    """Hashed windows of benchmark items, and their words for verification."""

    def __init__(self, items: list[tuple[str | None, str]], n: int) -> None:
        self.n = n
        self.ids = [i for i, _ in items]
        self.by_len: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.words: list[list[bytes]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for at, (_, text) in enumerate(items):
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            w = tb.words(tb.Block(0, 1, data, np.array([0, len(data)])), tb.ALNUM)
            low = tb.LOWER[data].tobytes()
            self.words.append([low[s:e] for s, e in zip(w.starts.tolist(), w.ends.tolist())])
            k = min(n, len(w.hashes))
            if k:
                h = tb.window_hashes(w.hashes, k)
                found.setdefault(k, []).append((h, np.full(len(h), at), np.arange(len(h))))
        for k, parts in found.items():
            h, at, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.by_len[k] = h[order], at[order], pos[order]
        # One bit for each of 2**20 hash prefixes sorts out nearly all windows before the lookup.
        self.maybe = {k: np.zeros(1 << 20, bool) for k in self.by_len}
        for k, (h, _, _) in self.by_len.items():
            self.maybe[k][(h >> np.uint64(44)).astype(np.int64)] = True


def scan(block: tb.Block, grams: Grams) -> tuple[np.ndarray, list[set[int]], np.ndarray, tb.Words]:
    """Hit mask of a block's words, items hit by each text, and the word counts."""
    w = tb.words(block, tb.ALNUM)
    rows = block.hi - block.lo
    hits: list[set[int]] = [set() for _ in range(rows)]
    marks = np.zeros(len(w.hashes) + 1, np.int64)
    low: bytes | None = None
    for k, (known, items, places) in grams.by_len.items():
        h = tb.window_hashes(w.hashes, k)
        at = np.flatnonzero(grams.maybe[k][(h >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            continue
        lo, hi = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
        row = np.searchsorted(w.first, at, "right") - 1
        good = (hi > lo) & (at + k <= w.first[row + 1])
        if not good.any():
            continue
        low = low if low is not None else tb.LOWER[block.raw].tobytes()
        for i, a, b, r in zip(at[good].tolist(), lo[good].tolist(), hi[good].tolist(), row[good].tolist()):
            here = [low[s:e] for s, e in zip(w.starts[i : i + k].tolist(), w.ends[i : i + k].tolist())]
            true = [int(items[j]) for j in range(a, b) if grams.words[items[j]][places[j] : places[j] + k] == here]
            if true:
                hits[r].update(true)
                marks[i] += 1
                marks[i + k] -= 1
    return np.cumsum(marks[:-1]) > 0, hits, w.counts(), w


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: What one pass adds to the columns of the texts; spans are word positions, end exclusive.
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", _SPANS),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("n_items", T.LongType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _pass(df: DataFrame, text: str, found: str, items: list[tuple[str | None, str]], n: int, with_text: bool) -> DataFrame:
    """One scan: adds or extends the column `found`."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(Grams(items, n))
    schema = T.StructType([f for f in df.schema.fields if f.name != found] + [T.StructField(found, _FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        for batch in batches:
            old = batch.column(batch.schema.get_field_index(found)).to_pylist() if found in batch.schema.names else None
            out = []
            for block in tb.blocks(batch.column(batch.schema.get_field_index(text))):
                mask, hits, counts, w = scan(block, grams)
                for r in range(block.hi - block.lo):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    was = old[block.lo + r] if old else None
                    spans = _runs(mask[a:b]) if hits[r] else []
                    ids = [grams.ids[i] for i in hits[r]]
                    names, more = sorted(x for x in ids if x is not None), len(ids)
                    if was:
                        spans = _merge(spans, [(s["start"], s["end"]) for s in was["spans"]])
                        names, more = sorted([*names, *was["items"]]), more + was["n_items"]
                    clean = None
                    if with_text and spans:
                        data = block.raw[block.offsets[r] : block.offsets[r + 1]].tobytes()
                        base, kept, last = int(block.offsets[r]), [], 0
                        for s, e in spans:
                            kept.append(data[last : int(w.starts[a + s]) - base])
                            last = int(w.ends[a + e - 1]) - base
                        clean = b"".join([*kept, data[last:]]).decode("utf-8", "replace")
                    out.append({"n_words": int(counts[r]), "spans": [{"start": s, "end": e} for s, e in spans], "items": names, "n_items": more, "clean_text": clean})
            fields = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != found]
            yield pa.RecordBatch.from_arrays([c for _, c in fields] + [pa.array(out, _ARROW)], names=[c for c, _ in fields] + [found])

    return df.mapInArrow(run, schema)


_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
        ("n_items", pa.int64()),
        ("clean_text", pa.string()),
    ]
)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS, with_text: bool = False, found: str | None = None
) -> tuple[DataFrame, str]:
    """docs and a struct column of what was found (n_words, spans, items, n_items, clean_text); its name.

    clean_text is the text without the hit words, or null where nothing was hit.
    """
    found = found or free_name(docs, "found")
    grams = F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.col(item_text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))) - n + 1)
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t"), grams.alias("g"))
    n_items, total = items.agg(F.count("*"), F.coalesce(F.sum("g"), F.lit(0))).first()
    parts = max(1, -(-int(total) // max_windows))
    if parts == 1:
        return _pass(docs, text, found, [(r["id"], r["t"]) for r in items.select("id", "t").collect()], n, with_text), found
    items = cut(items.withColumn("part", F.pmod(F.xxhash64("id", "t"), F.lit(2 * parts))))
    for part in range(2 * parts):
        mine = [(r["id"], r["t"]) for r in items.where(F.col("part") == part).select("id", "t").toLocalIterator()]
        docs = cut(_pass(docs, text, found, mine, n, with_text))
    return docs, found


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leak_report(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The digest of op5: a row for each document."""
    out, found = find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    f = lambda name: F.col(f"{found}.{name}")
    n_hit = F.aggregate(f("spans"), F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(
        "doc_id", f("n_words").alias("n_words"), n_hit.alias("n_hit"), f("n_items").alias("n_items"),
        F.sha2(F.array_join(f("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """docs without those that hold a benchmark window."""
    out, found = find_leaks(docs, benchmark, **options)
    return out.where(F.size(f"{found}.spans") == 0).drop(found)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options: object) -> DataFrame:
    """docs with the hit words cut out of the texts."""
    out, found = find_leaks(docs, benchmark, text=text, with_text=True, **options)
    return out.withColumn(text, F.coalesce(f"{found}.clean_text", text)).drop(found)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM b, LATERAL (SELECT unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM g),
windows AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM d, ks, LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i) WHERE len(w) >= k
), hits AS (SELECT windows.doc_id, windows.k, windows.i, g.item_id FROM windows JOIN g ON windows.k = g.k AND windows.gram = g.gram),
n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
