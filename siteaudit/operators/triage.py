"""What to do first: groups, fixes, pivots, filters and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import RANKS, rank, rule_table

# Impact weights of the severities.
WEIGHTS = {"error": 5.0, "warning": 2.0, "notice": 0.6, "good": 0.0}


def problems(issues: DataFrame, least: str = "notice", category: str | None = None) -> DataFrame:
    """Issues of at least a severity, never those that are good; of one category if named."""
    out = issues.where((rank(F.col("severity")) >= RANKS[least]) & (F.col("severity") != "good"))
    return out if category is None else out.where(F.col("category") == category)


def group_issues(issues: DataFrame, samples: int = 5) -> DataFrame:
    """A row a rule: count and first urls; most severe and frequent first, rule names break ties."""
    by = Window.partitionBy("rule").orderBy("url", F.coalesce("detail", F.lit("")))
    few = problems(issues).withColumn("i", F.row_number().over(by)).where(F.col("i") <= samples)
    urls = few.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "url"))), lambda x: x["url"]).alias("samples"))
    counts = problems(issues).groupBy("rule", "title", "category", "severity").agg(F.count("*").alias("n"))
    return counts.join(urls, "rule").orderBy(F.desc(rank(F.col("severity"))), F.desc("n"), "rule")


def top_fixes(issues: DataFrame, k: int = 5) -> DataFrame:
    """The k rules of highest impact: severity weight times the root of the count."""
    counts = problems(issues).groupBy("rule").agg(F.count("*").alias("n"))
    known = F.broadcast(rule_table(issues.sparkSession).select("rule", "title", "category", "severity", "why", "how_to_fix"))
    w = F.lit(0.0)
    for s, x in WEIGHTS.items():
        w = F.when(F.col("severity") == s, x).otherwise(w)
    return counts.join(known, "rule").withColumn("impact", w * F.sqrt("n")).orderBy(F.desc("impact"), F.desc("n"), "rule").limit(k)


def category_severity(issues: DataFrame) -> DataFrame:
    """Categories by severities, with totals."""
    out = problems(issues).groupBy("category").pivot("severity", ["error", "warning", "notice"]).count().na.fill(0)
    return out.withColumn("total", F.col("error") + F.col("warning") + F.col("notice"))


def affected(issues: DataFrame, rule: str, k: int) -> DataFrame:
    """The first k urls of a rule and how many there are."""
    hit = issues.where(F.col("rule") == rule)
    total = hit.agg(F.count("*").alias("total"))
    return hit.select("url").orderBy("url").limit(k).crossJoin(total)


def fails(issues: DataFrame, severity: str) -> bool:
    """Some issue is at least so severe."""
    return not issues.where(rank(F.col("severity")) >= RANKS[severity]).isEmpty()


def shares(counts: DataFrame, value: str = "n") -> DataFrame:
    """Adds the share of the total and of the largest."""
    all_rows = Window.partitionBy()
    return counts.withColumns({"of_total": F.col(value) / F.sum(value).over(all_rows), "of_max": F.col(value) / F.max(value).over(all_rows)})
