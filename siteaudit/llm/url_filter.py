"""URL rules by a Bloom filter cascade: exact membership without joins.

Every page url has a few candidate keys: the last labels of its host (as many as
some rule's host has) with the start of its path (as long as some rule's path is).
These are the corpus's complete key universe. Level 1 of a cascade is a Bloom filter
of the listed keys; level 2 one of the unlisted keys of the universe that pass level
1; level 3 one of the listed keys that pass level 2; and so on until nothing passes
wrongly. A key of the universe is listed if the first level that it misses is even.
So each lookup is a few bit tests and its answer is exact. Blocking and allowing
rules have a cascade each; of the candidates that are rules, the longest wins.

Building needs the ground truth once: distinct universe keys, marked as listed or
not, as 128-bit hashes in a checkpoint. Bits are combined by bit_or with partial
aggregation; only finished filters reach the driver and are broadcast. A cascade that
would pass `max_bytes` (checked before it is built) is split by a hash of the keys in
two, and these again, so each that is built or sent has a bound; a lookup asks the one
that its key belongs to.

Nulls and urls without `://` have an empty host and path, no candidates and the
verdict `allow`. Of rules of one length the one with the longer path wins. A very long
url is judged whole; its host and path are cut at the first marks. An empty table gives
an empty result, an empty list allows all. Repeated rows are judged alike; extra columns
pass through untouched, also those named host, path, rule or verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import ascii_lower, cut, free_name

# The rules of the contract, as (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bytes that all filters of a cascade may take, and the least such bound that is meant.
MAX_BYTES, MIN_BYTES = 256 << 20, 1 << 10
#: More levels than this are never needed unless two keys have the same 128-bit hash: then it raises.
MAX_LEVELS = 64


@dataclass
class Level:
    """A Bloom filter: 64-bit words and the number of hashes."""

    seed: int
    hashes: int
    bits: np.ndarray

    def places(self, h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
        a, b = tb.mix(h1 + np.uint64(self.seed)), tb.mix(h2 ^ np.uint64(self.seed)) | np.uint64(1)
        n = np.uint64(len(self.bits) * 64)
        return [(a + np.uint64(i) * b) % n for i in range(self.hashes)]

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for p in self.places(h1, h2):
            out &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0
        return out


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of keys of the universe."""
        out = np.zeros(len(h1), bool)
        alive = np.arange(len(h1))
        for at, level in enumerate(self.levels):
            ok = level.passes(h1[alive], h2[alive])
            out[alive[~ok]] = at % 2 == 1
            alive = alive[ok]
        out[alive] = len(self.levels) % 2 == 1
        return out


def _words_for(n: int, rate: float) -> int:
    return max(1, int(np.ceil(n * 1.4427 * np.log2(1 / rate) / 64)))


def _fill(keys: DataFrame, level: Level) -> None:
    """Sets the level's bits for all keys (h1, h2): words are combined where they are, then collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
            at = np.concatenate(level.places(h1, h2))
            word, mask = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    for r in keys.select("h1", "h2").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        level.bits[r["word"]] = np.int64(r["mask"]).view(np.uint64)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
            yield batch.filter(pa.array(held.value.passes(h1, h2)))

    return keys.mapInArrow(run, keys.schema)


def build_cascade(universe: DataFrame, *, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """The cascade of a table (h1, h2, listed) of distinct keys; None if it would pass max_bytes."""
    sides = [universe.where("listed").select("h1", "h2"), universe.where("NOT listed").select("h1", "h2")]
    n, rest = (s.count() for s in sides)
    out, used = Cascade(), 0
    while n:
        at = len(out.levels)
        # The first filter leaves about as many false positives as there are listed keys; the others halve.
        rate = min(0.5, max(n / max(rest, 1), 1e-6)) if at == 0 else 0.5
        size = _words_for(n, rate)
        used += 8 * size
        if used > max_bytes:
            return None
        if at == MAX_LEVELS:
            raise RuntimeError("two keys of the universe have the same 128-bit hash")
        level = Level(0x5851F42D4C957F2D * (at + 1) % 2**63, max(1, round(np.log2(1 / rate))), np.zeros(size, np.uint64))
        _fill(sides[at % 2], level)
        out.levels.append(level)
        wrong = cut(_passing(sides[(at + 1) % 2], level))
        sides[(at + 1) % 2], n = wrong, wrong.count()
    return out


@dataclass
class Cascades:
    """Cascades of the parts of a universe: (bits, value) are the last bits of the second hash that a part's keys share."""

    parts: list[tuple[int, int, Cascade]] = field(default_factory=list)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        for bits, value, cascade in self.parts:
            at = np.flatnonzero((h2 & np.uint64((1 << bits) - 1)) == np.uint64(value))
            out[at] = cascade.listed(h1[at], h2[at])
        return out


def build_cascades(universe: DataFrame, *, max_bytes: int = MAX_BYTES, bits: int = 0, value: int = 0) -> Cascades:
    """The cascade of a universe, in as many parts as the bound asks for."""
    one = build_cascade(universe, max_bytes=max(max_bytes, MIN_BYTES))
    if one is not None:
        return Cascades([(bits, value, one)])
    out = Cascades()
    for bit in (0, 1):
        half = cut(universe.where(F.expr(f"pmod(shiftright(h2, {bits}), 2) = {bit}")))
        out.parts += build_cascades(half, max_bytes=max_bytes, bits=bits + 1, value=value | bit << bits).parts
    return out


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffix(host: Column, labels: int) -> Column:
    """The last labels of a host, null if it has fewer."""
    return F.when((F.length(host) > 0) & (F.size(F.split(host, r"\.", -1)) >= labels), F.substring_index(host, ".", -labels))


def candidates(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """array<struct<rule, key>>: the keys of a url that could be rules, longest first."""
    shapes = sorted({(len(h) + len(p), h.count(".") + 1, len(p)) for _, h, p in rules}, reverse=True)
    kinds = sorted({(labels, size) for _, labels, size in shapes})
    each = [F.when(F.length(path) >= size, F.concat(_suffix(host, labels), F.substring(path, 1, size))) for labels, size in kinds]
    keys = F.filter(F.array(*each), lambda k: k.isNotNull())
    return F.array_sort(keys, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.instr(a, "/") * -1 + F.instr(b, "/")))


def judge_urls(pages: DataFrame, rules: tuple | list = RULES, *, url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages with host, path, rule (null: none fits) and verdict."""
    rules = [(a, h.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), p) for a, h, p in rules]
    spark = pages.sparkSession
    host, path, keys, rule, verdict = (free_name(pages, c) for c in ("host", "path", "keys", "rule", "verdict"))
    out = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    if not rules:
        return out.withColumn(rule, F.lit(None).cast("string")).withColumn(verdict, F.lit("allow"))
    out = out.withColumn(keys, candidates(F.col(host), F.col(path), rules))
    table = spark.createDataFrame([(a, h + p) for a, h, p in rules], "action string, k string")
    hashed = lambda k: (F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(29), k).alias("h2"))
    seen = out.select(F.explode(keys).alias("k")).distinct().select("k", *hashed(F.col("k")))
    cascades = []
    for action in ("block", "allow"):
        mine = table.where(F.col("action") == action).select("k").distinct().withColumn("listed", F.lit(True))
        # Rules that no url meets are no part of the universe.
        marked = cut(seen.join(mine, "k", "left").select("h1", "h2", F.coalesce("listed", F.lit(False)).alias("listed")))
        cascades.append(build_cascades(marked, max_bytes=max_bytes))
    held = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("int")
    def pick(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """2 * place + action of the first candidate that is a rule; -1: none."""
        size = h1.map(len).to_numpy(np.int64)
        a, b = (np.concatenate([np.zeros(0, np.int64), *h]).astype(np.int64).view(np.uint64) for h in (h1, h2))
        block, allow = (c.listed(a, b) for c in held.value)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero(block | allow)
        first = np.full(len(size), -1, np.int64)
        first[row[hit[::-1]]] = 2 * place[hit[::-1]] + allow[hit[::-1]]
        return pd.Series(first.astype(np.int32))

    got = free_name(out, "got")
    hashes = [F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.lit(29), k))]
    out = out.withColumn(got, pick(*hashes))
    found = F.when(F.col(got) >= 0, F.element_at(F.col(keys), F.floor(F.greatest(F.col(got), F.lit(0)) / 2).cast("int") + 1))
    return out.withColumn(rule, found).withColumn(verdict, F.when((F.col(got) >= 0) & (F.col(got) % 2 == 0), "block").otherwise("allow")).drop(keys, got)


def url_digest(pages: DataFrame) -> DataFrame:
    """The digest of op1."""
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
