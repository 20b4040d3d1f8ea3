"""Text statistics as column expressions; all native, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The word lists of the two ratios.
FILLER_WORDS = (
    "very", "really", "just", "actually", "basically", "literally", "simply", "quite", "rather", "essentially",
    "certainly", "definitely", "truly", "absolutely", "totally", "completely", "extremely", "incredibly", "ultimately", "fundamentally",
)
TRANSITION_WORDS = (
    "however", "moreover", "furthermore", "additionally", "consequently", "therefore", "thus", "hence",
    "nevertheless", "nonetheless", "accordingly", "subsequently", "whereas", "notably", "importantly", "indeed",
)


def let(value: Column, body: object) -> Column:
    """body(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; accented capitals stay."""
    return F.translate(text, UPPER, LOWER)


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """White-space separated words without edge punctuation."""
    cut = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(cut, lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces up to and with each `.`, `!` or `?`; the tail is a sentence, too."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]|[^.!?]+"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def sentence_variance(text: Column) -> Column:
    """Population variance of words per sentence; 0 for fewer than two sentences with words."""
    counts = F.filter(F.transform(sentences(text), lambda s: F.size(words(s))), lambda n: n > 0)

    def spread(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return let(total / F.size(n), lambda m: F.aggregate(n, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(n))

    return let(counts, lambda n: F.when(F.size(n) < 2, F.lit(0.0)).otherwise(spread(n)))


def em_dash_density(text: Column) -> Column:
    dashes = F.length(text) - F.length(F.replace(text, F.lit("—"), F.lit("")))
    return _share(dashes, F.size(words(text)))


def _list_ratio(text: Column, listed: tuple[str, ...]) -> Column:
    return let(words(text), lambda w: _share(F.size(F.filter(w, lambda x: ascii_lower(x).isin(*listed))), F.size(w)))


def filler_ratio(text: Column) -> Column:
    return _list_ratio(text, FILLER_WORDS)


def transition_ratio(text: Column) -> Column:
    return _list_ratio(text, TRANSITION_WORDS)


def adverb_density(text: Column) -> Column:
    """Share of words of over three bytes that end in `ly`."""
    return let(words(text), lambda w: _share(F.size(F.filter(w, lambda x: (F.octet_length(x) > 3) & ascii_lower(x).endswith("ly"))), F.size(w)))


def lexical_diversity(text: Column) -> Column:
    return let(words(text), lambda w: _share(F.size(F.array_distinct(F.transform(w, ascii_lower))), F.size(w)))


def ngram_repetition(text: Column, n: int = 3) -> Column:
    """1 - distinct / all word n-grams; 0 for fewer than n + 1 words."""
    lowered = F.transform(words(text), ascii_lower)

    def ratio(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n + 1, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(grams)) / (F.size(w) - (n - 1)))

    return let(lowered, ratio)


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("double")


#: Metrics that a rule pack can name.
METRICS = {
    "word_count": word_count,
    "sentence_variance": sentence_variance,
    "em_dash_density": em_dash_density,
    "filler_ratio": filler_ratio,
    "transition_ratio": transition_ratio,
    "adverb_density": adverb_density,
    "lexical_diversity": lexical_diversity,
    "ngram_repetition": ngram_repetition,
}


def phrase_count(text: Column, phrase: str) -> Column:
    """Non-overlapping places of a phrase, ASCII case ignored."""
    low = phrase.translate(str.maketrans(UPPER, LOWER))
    t = ascii_lower(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(low), F.lit("")))) / F.lit(len(low))).cast("int")


def regex_count(text: Column, pattern: str) -> Column:
    """Matches of a pattern, always case-insensitive, with Unicode classes; `.` stops at line feeds only."""
    return F.regexp_count(text, F.lit("(?iuUd)" + pattern))
