"""The rule-pack language: phrases, regular expressions and text metrics, compiled to column expressions.

    phrase_rule("name", weight = 2, phrases = ["a", "b"])
    regex_rule("name", weight = 1, pattern = "...")
    metric_rule("name", weight = 3, metric = ngram_repetition(3), when = above(0.06))

`#` starts a comment; strings take ' or "; lists and calls may end with a comma.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Matches of one rule that count, and the evidence shown.
MATCH_CAP = 3


class PackError(ValueError):
    """A mistake in a pack, with its place."""

    def __init__(self, line: int, col: int, message: str) -> None:
        super().__init__(f"line {line}, column {col}: {message}")
        self.line, self.col, self.message = line, col, message


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    named: dict
    line: int
    col: int


_TOKEN = re.compile(r"(?P<space>[ \t\r\n]+|#[^\n]*)|(?P<name>[A-Za-z_]\w*)|(?P<number>-?\d+(?:\.\d+)?)|(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<mark>[()\[\],=])", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def lex(source: str) -> list[tuple[str, object, int, int]]:
    out, at = [], 0
    while at < len(source):
        line, col = source.count("\n", 0, at) + 1, at - source.rfind("\n", 0, at)
        m = _TOKEN.match(source, at)
        if not m:
            raise PackError(line, col, "string without an end" if source[at] in "\"'" else f"unexpected {source[at]!r}")
        kind, raw = m.lastgroup, m.group()
        if kind == "text":
            out.append((kind, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e.group(1), e.group(1)), raw[1:-1], flags=re.S), line, col))
        elif kind == "number":
            out.append((kind, float(raw), line, col))
        elif kind != "space":
            out.append((kind, raw, line, col))
        at = m.end()
    out.append(("end", "", source.count("\n") + 1, 1))
    return out


class _Parser:
    def __init__(self, source: str) -> None:
        self.tokens, self.at = lex(source), 0

    def take(self, mark: str | None = None):
        kind, value, line, col = self.tokens[self.at]
        if mark is not None and not (kind == "mark" and value == mark):
            raise PackError(line, col, f"expected {mark!r}" + (", but the pack ends" if kind == "end" else ""))
        self.at += 1
        return kind, value, line, col

    def peek(self, mark: str, ahead: int = 0) -> bool:
        kind, value, *_ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind == "mark" and value == mark

    def value(self) -> object:
        if self.peek("["):
            self.take("[")
            out = []
            while not self.peek("]"):
                out.append(self.value())
                if not self.peek("]"):
                    self.take(",")
            self.take("]")
            return out
        kind, value, line, col = self.take()
        if kind in ("text", "number"):
            return value
        if kind == "name":
            return self.call(value, line, col) if self.peek("(") else Call(value, (), {}, line, col)
        raise PackError(line, col, "expected a value" + (", but the pack ends" if kind == "end" else ""))

    def call(self, name: str, line: int, col: int) -> Call:
        self.take("(")
        args, named = [], {}
        while not self.peek(")"):
            if self.tokens[self.at][0] == "name" and self.peek("=", 1):
                key = self.take()[1]
                self.take("=")
                named[key] = self.value()
            else:
                args.append(self.value())
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        return Call(name, tuple(args), named, line, col)

    def calls(self) -> list[Call]:
        out = []
        while self.tokens[self.at][0] != "end":
            kind, value, line, col = self.take()
            if kind != "name":
                raise PackError(line, col, "expected a rule")
            out.append(self.call(value, line, col))
        return out


@dataclass(frozen=True)
class Rule:
    """matches(text) and evidence(text) are column expressions; points = weight * min(matches, cap)."""

    name: str
    weight: float
    kind: str
    phrases: tuple[str, ...] = ()
    pattern: str = ""
    metric: str = ""
    metric_args: tuple = ()
    test: str = ""
    limits: tuple[float, ...] = ()

    def measure(self, text: Column) -> Column:
        return tx.METRICS[self.metric](text, *(int(a) for a in self.metric_args))

    def fires(self, value: Column) -> Column:
        lo = self.limits[0]
        return {"below": value < lo, "above": value > lo, "between": value.between(lo, self.limits[-1])}[self.test]

    def hit(self, text: Column) -> Column:
        """struct<rule, points, evidence>, or null."""
        if self.kind == "phrase":
            counts = [(p, tx.phrase_count(text, p)) for p in self.phrases]
            each = F.array(*(F.struct(F.lit(p).alias("p"), n.alias("n")) for p, n in counts))

            def made(found: Column) -> Column:
                hits = F.filter(found, lambda x: x["n"] > 0)
                total = F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])
                evidence = F.transform(F.slice(hits, 1, MATCH_CAP), lambda x: F.format_string("“%s” (×%d)", x["p"], x["n"]))
                return F.when(total > 0, self._struct(F.lit(self.weight) * F.least(total, F.lit(MATCH_CAP)), evidence))

            return tx.let(each, made)
        if self.kind == "regex":
            found = F.regexp_extract_all(text, F.lit("(?iuUd)" + self.pattern), F.lit(0))
            return tx.let(found, lambda m: F.when(F.size(m) > 0, self._struct(F.lit(self.weight) * F.least(F.size(m), F.lit(MATCH_CAP)), F.slice(m, 1, MATCH_CAP))))
        shown = {"below": "below {0:g}", "above": "above {0:g}", "between": "between {0:g} and {1:g}"}[self.test].format(*self.limits)
        return tx.let(self.measure(text), lambda v: F.when(self.fires(v), self._struct(F.lit(self.weight), F.array(F.format_string(f"{self.metric} = %.3f ({shown})", v)))))

    def _struct(self, points: Column, evidence: Column) -> Column:
        return F.struct(F.lit(self.name).alias("rule"), points.cast("double").alias("points"), evidence.alias("evidence"))


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[Rule, ...] = field(default=())

    def ledger(self, text: Column) -> Column:
        """struct<pack, score, hits> of a text; hits in order of declaration."""
        hits = F.filter(F.array(*(r.hit(text) for r in self.rules)), lambda h: h.isNotNull())
        return tx.let(hits, lambda h: F.struct(F.lit(self.name).alias("pack"), F.aggregate(h, F.lit(0.0), lambda a, x: a + x["points"]).alias("score"), h.alias("hits")))


def _rule(c: Call) -> Rule:
    def fail(message: str) -> PackError:
        return PackError(c.line, c.col, message)

    if not c.args or not isinstance(c.args[0], str):
        raise fail(f"{c.name} needs a name")
    weight = c.named.get("weight", 1.0)
    if not isinstance(weight, float):
        raise fail("weight must be a number")
    known = {"phrase_rule": {"weight", "phrases"}, "regex_rule": {"weight", "pattern"}, "metric_rule": {"weight", "metric", "when"}}.get(c.name)
    if known is None:
        raise fail(f"unknown rule kind {c.name}")
    if extra := set(c.named) - known:
        raise fail(f"unknown argument {sorted(extra)[0]}")
    if c.name == "phrase_rule":
        phrases = c.named.get("phrases")
        if not isinstance(phrases, list) or not phrases or not all(isinstance(p, str) and p for p in phrases):
            raise fail("phrases must be a list of strings, none empty")
        return Rule(c.args[0], weight, "phrase", phrases=tuple(phrases))
    if c.name == "regex_rule":
        pattern = c.named.get("pattern")
        if not isinstance(pattern, str):
            raise fail("pattern must be a string")
        try:
            re.compile(pattern)
        except re.error as e:
            raise fail(f"bad pattern: {e}") from e
        return Rule(c.args[0], weight, "regex", pattern=pattern)
    metric, when = c.named.get("metric"), c.named.get("when")
    if not isinstance(metric, Call) or metric.name not in tx.METRICS:
        raise fail("unknown metric")
    if metric.name == "ngram_repetition" and not (metric.args and isinstance(metric.args[0], float) and metric.args[0] >= 1):
        raise fail("ngram_repetition needs a length of at least 1")
    if not isinstance(when, Call) or when.name not in ("below", "above", "between") or len(when.args) != 1 + (when.name == "between") or not all(isinstance(a, float) for a in when.args):
        raise fail("when must be below(x), above(x) or between(x, y)")
    return Rule(c.args[0], weight, "metric", metric=metric.name, metric_args=tuple(metric.args), test=when.name, limits=tuple(when.args))


def parse_pack(source: str, name: str = "pack") -> Pack:
    return Pack(name, tuple(_rule(c) for c in _Parser(source).calls()))


#: The built-in pack; its phrases, weights and limits are fixed values.
BUILT_IN = r"""
phrase_rule("ai-cliches", weight = 3, phrases = [
    "in today's fast-paced world", "in today's digital age", "in the ever-evolving", "unlock the power of", "unlock the potential",
    "elevate your", "take your", "to the next level", "look no further", "when it comes to", "it's important to note", "it's worth noting",
    "at the end of the day", "navigate the landscape", "navigate the complexities", "a testament to", "in conclusion", "the world of",
    "dive into", "delve into", "embark on a journey", "game changer", "game-changer", "best-in-class", "cutting-edge",
    "seamless integration", "robust solution", "in this article, we will", "whether you're",
])
phrase_rule("empty-buzzwords", weight = 2, phrases = [
    "synergy", "leverage", "paradigm", "holistic", "turnkey", "frictionless", "bleeding-edge", "world-class", "revolutionary",
    "disruptive", "next-generation", "mission-critical", "hyper-scale",
])
regex_rule("rule-of-three", weight = 2, pattern = "\\w+, \\w+,? and \\w+")
regex_rule("not-only-but-also", weight = 2, pattern = "not only .* but also")
metric_rule("low-burstiness", weight = 3, metric = sentence_variance(), when = below(12))
metric_rule("em-dash-spam", weight = 2, metric = em_dash_density(), when = above(0.012))
metric_rule("filler-heavy", weight = 2, metric = filler_ratio(), when = above(0.04))
metric_rule("transition-heavy", weight = 2, metric = transition_ratio(), when = above(0.03))
metric_rule("low-lexical-diversity", weight = 2, metric = lexical_diversity(), when = below(0.38))
metric_rule("repeated-phrasing", weight = 2, metric = ngram_repetition(3), when = above(0.06))
"""


def built_in() -> Pack:
    return parse_pack(BUILT_IN, "slop-default")


def score_texts(df: DataFrame, pack: Pack, text: str = "text") -> DataFrame:
    """df and the ledger of its texts."""
    return df.withColumn("ledger", pack.ledger(F.col(text)))


def hits(scored: DataFrame, *keys: str) -> DataFrame:
    """A row for each hit: keys, rule, points, evidence."""
    return scored.select(*keys, F.inline("ledger.hits"))


# ---- where packs live: a file, the repository's folder, the user's folder, built in ----
SUFFIX = ".pack"


def layers(repo: str | None, home: str | None) -> list[tuple[str, Path]]:
    return [(n, Path(p)) for n, p in (("repo", repo), ("global", home)) if p]


def resolve_pack(reference: str, repo: str | None = None, home: str | None = None) -> Pack:
    """A path wins over the repository's pack of the name, that over the user's, that over the built-in one."""
    if Path(reference).is_file():
        return parse_pack(Path(reference).read_text(), Path(reference).stem)
    for _, folder in layers(repo, home):
        if (f := folder / f"{reference}{SUFFIX}").is_file():
            return parse_pack(f.read_text(), reference)
    if reference == "slop-default":
        return built_in()
    raise FileNotFoundError(f"no pack {reference!r}")


def list_packs(repo: str | None = None, home: str | None = None) -> list[tuple[str, str]]:
    """(name, layer) of the packs that a reference would find."""
    out: dict[str, str] = {}
    for layer, folder in layers(repo, home):
        for f in sorted(folder.glob(f"*{SUFFIX}")) if folder.is_dir() else []:
            out.setdefault(f.stem, layer)
    out.setdefault("slop-default", "built-in")
    return list(out.items())


def add_pack(source: str, name: str, folder: str) -> Path:
    """Installs a pack after checking that it parses."""
    parse_pack(source, name)
    Path(folder).mkdir(parents=True, exist_ok=True)
    target = Path(folder) / f"{name}{SUFFIX}"
    target.write_text(source)
    return target


def remove_pack(name: str, folder: str) -> None:
    (Path(folder) / f"{name}{SUFFIX}").unlink()


def new_pack(name: str, folder: str) -> Path:
    """A pack to start from: one rule of each kind."""
    start = 'phrase_rule("phrases", weight = 1, phrases = ["in conclusion"])\nregex_rule("pattern", weight = 1, pattern = "very \\\\w+")\nmetric_rule("metric", weight = 1, metric = sentence_variance(), when = below(12))\n'
    return add_pack(start, name, folder)


def which_pack(reference: str, repo: str | None = None, home: str | None = None) -> str:
    """Where a reference leads: a path, or the name of a layer."""
    if Path(reference).is_file():
        return reference
    return dict(list_packs(repo, home))[reference]


def init_packs(folder: str) -> Path:
    """A folder for packs, with the built-in one to copy from."""
    return add_pack(BUILT_IN, "slop-default", folder)
