"""Queries over texts: metrics, rule packs, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..packs.language import built_in, hits, parse_pack, score_texts
from .registry import query, spread_table

ASC = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(list_transform(regexp_split_to_array({}, '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '')"
_W = WORDS.format("text")
_RATIO = "SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE CAST(len(list_filter(w, lambda x: {test})) AS DOUBLE) / len(w) END, 6) AS value FROM (SELECT doc_id, " + _W + " AS w FROM documents)"


def _ratio(test: str) -> str:
    return _RATIO.replace("{test}", test)


def _metric(name: str, *args: int):
    def run(spark, sf_dir):
        return spread_table(spark, sf_dir, "documents").select("doc_id", F.round(tx.METRICS[name](F.col("text"), *args), 6).alias("value"))

    return run


def _listed(words: tuple[str, ...]) -> str:
    return _ratio(ASC.format("x") + " IN (" + ", ".join(f"'{w}'" for w in words) + ")")


_VARIANCE = (
    "WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+')) AS s FROM documents), "
    "n AS (SELECT doc_id, len(" + WORDS.format("s") + ") AS n FROM s), v AS (SELECT doc_id, CASE WHEN count(*) < 2 THEN 0 ELSE var_pop(n) END AS v FROM n WHERE n > 0 GROUP BY doc_id) "
    "SELECT d.doc_id, round(coalesce(v, 0), 6) AS value FROM documents d LEFT JOIN v USING (doc_id)"
)
query("sentence_variance", _VARIANCE)(_metric("sentence_variance"))
query("filler_ratio", _listed(tx.FILLER_WORDS))(_metric("filler_ratio"))
query("transition_ratio", _listed(tx.TRANSITION_WORDS))(_metric("transition_ratio"))
query("adverb_density", _ratio("strlen(x) > 3 AND ends_with(" + ASC.format("x") + ", 'ly')"))(_metric("adverb_density"))
_DIVERSITY = "round(CASE WHEN len(w) = 0 THEN 0 ELSE CAST(len(list_distinct(list_transform(w, lambda x: " + ASC.format("x") + "))) AS DOUBLE) / len(w) END, 6)"
query("lexical_diversity", f"SELECT doc_id, {_DIVERSITY} AS value FROM (SELECT doc_id, {_W} AS w FROM documents)")(_metric("lexical_diversity"))
query(
    "em_dash_density",
    "SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE CAST(length(text) - length(replace(text, '—', '')) AS DOUBLE) / len(w) END, 6) AS value FROM (SELECT doc_id, text, " + _W + " AS w FROM documents)",
)(_metric("em_dash_density"))
_NGRAMS = "list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i : i + 2], ' '))"
query(
    "ngram_repetition",
    "SELECT doc_id, round(CASE WHEN len(w) < 4 THEN 0 ELSE 1.0 - CAST(len(list_distinct(" + _NGRAMS + ")) AS DOUBLE) / (len(w) - 2) END, 6) AS value FROM (SELECT doc_id, " + WORDS.format(ASC.format("text")) + " AS w FROM documents)",
)(_metric("ngram_repetition", 3))
query("text_word_count", f"SELECT doc_id, CAST(len({_W}) AS DOUBLE) AS value FROM documents")(_metric("word_count"))


@query("sentence_counts", "SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13))), lambda s: s <> '')) AS n FROM documents")
def sentence_counts(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"))


_PHRASES = ("of the", "the the", "de la", "in conclusion", "license")
_COUNTS = " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) // {len(p)}" for p in _PHRASES)


@query("slop_phrases", f"SELECT doc_id, CAST({_COUNTS} AS BIGINT) AS n, CAST(least({_COUNTS}, 3) * 2.0 AS DOUBLE) AS points FROM (SELECT doc_id, {ASC.format('text')} AS t FROM documents)")
def slop_phrases(spark, sf_dir):
    n = sum((tx.phrase_count(F.col("text"), p) for p in _PHRASES), F.lit(0))
    return spread_table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n"), (F.least(n, F.lit(3)) * 2.0).alias("points"))


_REGEX = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+, [\p{L}\p{M}\p{Nd}\p{Pc}]+,? and [\p{L}\p{M}\p{Nd}\p{Pc}]+"


@query("slop_regex", f"SELECT conv_id, turn, len(regexp_extract_all(text, '(?i){_REGEX}')) AS n FROM conversations")
def slop_regex(spark, sf_dir):
    return spread_table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.regex_count(F.col("text"), r"\w+, \w+,? and \w+").cast("long").alias("n"))


TEST_PACK = """
phrase_rule("common", weight = 1, phrases = ["of the", "de la", "in der"])
metric_rule("low-burstiness", weight = 3, metric = sentence_variance(), when = below(12))
metric_rule("adverbs", weight = 2, metric = adverb_density(), when = between(0.01, 0.2))
metric_rule("low-diversity", weight = 2, metric = lexical_diversity(), when = below(0.5))
"""
_COMMON = " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) // {len(p)}" for p in ("of the", "de la", "in der"))
_LEDGER = f"""
WITH v AS ({_VARIANCE}), a AS ({_ratio("strlen(x) > 3 AND ends_with(" + ASC.format("x") + ", 'ly')")}), l AS (SELECT doc_id, {_DIVERSITY} AS value FROM (SELECT doc_id, {_W} AS w FROM documents)),
p AS (SELECT doc_id, least({_COMMON}, 3) AS n FROM (SELECT doc_id, {ASC.format('text')} AS t FROM documents)),
h AS (
  SELECT doc_id, 'common' AS rule, CAST(n AS DOUBLE) AS points FROM p WHERE n > 0
  UNION ALL SELECT doc_id, 'low-burstiness', 3.0 FROM v WHERE value < 12
  UNION ALL SELECT doc_id, 'adverbs', 2.0 FROM a WHERE value BETWEEN 0.01 AND 0.2
  UNION ALL SELECT doc_id, 'low-diversity', 2.0 FROM l WHERE value < 0.5
)
"""


@query("slop_hits", _LEDGER + "SELECT doc_id, rule, points FROM h")
def slop_hits(spark, sf_dir):
    return hits(score_texts(spread_table(spark, sf_dir, "documents"), parse_pack(TEST_PACK)), "doc_id").select("doc_id", "rule", "points")


@query("slop_ledger", _LEDGER + "SELECT d.doc_id, CAST(coalesce(sum(points), 0) AS DOUBLE) AS score, count(h.rule) AS n_hits FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id")
def slop_ledger(spark, sf_dir):
    scored = score_texts(spread_table(spark, sf_dir, "documents"), parse_pack(TEST_PACK))
    return scored.select("doc_id", "ledger.score", F.size("ledger.hits").cast("long").alias("n_hits"))


@query("slop_topk", _LEDGER + "SELECT d.doc_id, CAST(coalesce(sum(points), 0) AS DOUBLE) AS score FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id ORDER BY score DESC, d.doc_id LIMIT 20")
def slop_topk(spark, sf_dir):
    """The 20 highest scores: a report of fixed length."""
    return slop_ledger(spark, sf_dir).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(20)


@query("slop_summary", _LEDGER + "SELECT round(avg(s), 6) AS mean, max(s) AS worst FROM (SELECT d.doc_id, coalesce(sum(points), 0) AS s FROM documents d LEFT JOIN h USING (doc_id) WHERE text <> '' GROUP BY d.doc_id)")
def slop_summary(spark, sf_dir):
    scored = score_texts(spread_table(spark, sf_dir, "documents").where("text <> ''"), parse_pack(TEST_PACK))
    return scored.agg(F.round(F.avg("ledger.score"), 6).alias("mean"), F.max("ledger.score").alias("worst"))


@query("slop_default")
def slop_default(spark, sf_dir):
    """The built-in pack over conversation turns; evidence included, tested against a plain restatement."""
    return hits(score_texts(spread_table(spark, sf_dir, "conversations"), built_in()), "conv_id", "turn")
