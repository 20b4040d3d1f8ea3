"""robots.txt: groups, rules and path matching."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Robots:
    """Rules (allowed?, pattern) of one agent, in file order, and the declared sitemaps."""

    rules: tuple[tuple[bool, str], ...] = ()
    sitemaps: tuple[str, ...] = ()

    def allowed(self, path: str) -> bool:
        """The longest fitting pattern (in bytes) decides, the first of equal length; none fits: allowed."""
        best, verdict = -1, True
        for allow, pattern in self.rules:
            n = len(pattern.encode())
            if n > best and fits(pattern, path):
                best, verdict = n, allow
        return verdict


def fits(pattern: str, path: str) -> bool:
    """The pattern's parts between `*` occur in order, each as early as possible, the first at the start; `$` asks that the last one ends the path."""
    if not pattern:
        return False
    at = 0
    for i, part in enumerate(pattern.rstrip("$").split("*")):
        found = path.find(part, at) if i else (0 if path.startswith(part) else -1)
        if found < 0:
            return False
        at = found + len(part) if part else at
    return not pattern.endswith("$") or at == len(path)


def parse(text: str, agent: str) -> Robots:
    """The rules of all groups whose agent contains our token, else those of `*`; a named group without rules falls back, too.

    Agents in a row share the rules that follow; any other field ends the row. An empty Disallow is no rule, an empty
    Allow is one that fits nothing.
    """
    token = agent.lower().split("/")[0].split(" ")[0]
    named: list[tuple[bool, str]] = []
    general: list[tuple[bool, str]] = []
    sitemaps: list[str] = []
    agents: list[str] = []
    row = False
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            agents = [*agents, value.lower()] if row else [value.lower()]
            row = True
            continue
        row = False
        if key == "sitemap":
            sitemaps.append(value)
        elif key == "allow" or (key == "disallow" and value):
            rule = (key == "allow", value)
            if any(token and token in a for a in agents if a != "*"):
                named.append(rule)
            general += [rule] * agents.count("*")
    return Robots(tuple(named or general), tuple(sitemaps))


def allowed_paths(paths: DataFrame, robots: Robots, column: str = "path") -> DataFrame:
    """Adds `allowed`; the few rules travel with the function."""

    @F.pandas_udf(T.BooleanType())
    def test(values: pd.Series) -> pd.Series:
        return values.map(lambda p: robots.allowed(p or "/"))

    return paths.withColumn("allowed", test(column))


def allowed_native(paths: DataFrame, rules: list[tuple[bool, str]], column: str = "path") -> DataFrame:
    """The same by column expressions, for patterns whose greedy and backtracking readings agree (no `*` before a `$`)."""
    import re

    best = F.lit(None).cast("struct<n:int,o:int,allow:boolean>")
    for i, (allow, pattern) in enumerate(rules):
        if not pattern:
            continue
        body = ".*".join(re.escape(p) for p in pattern.rstrip("$").split("*"))
        test = F.col(column).rlike(f"(?s)^{body}{'$' if pattern.endswith('$') else ''}")
        best = F.greatest(best, F.when(test, F.struct(F.lit(len(pattern.encode())).alias("n"), F.lit(-i).alias("o"), F.lit(allow).alias("allow"))))
    return paths.withColumn("allowed", F.coalesce(best["allow"], F.lit(True)))
