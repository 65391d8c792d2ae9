"""Items E1-E14: aggregation and scoring.

All per-repo aggregates are hash aggregations with map-side partial
aggregation: each task pre-sums its findings per repo, so a repository that
holds a third of all findings still ships one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secscan.functions import columns as C
from secscan.sources import catalogue as K

SEV_COLS = {s: s.lower() for s in K.SEVERITIES}

# What the grades of the two scores mean, our own wording.
DECAY_LABELS = {"A": "Hardly anything found", "B": "Some findings of little weight", "C": "Findings to work on", "D": "Serious findings",
                "F": "Findings that need work at once"}
GRADE_TEXT = {"A": "Few findings for its size", "B": "A few findings, look through them", "C": "Findings of medium weight, plan to fix them",
              "D": "Heavy findings, fix them soon", "F": "Heavy findings in many places, fix them now"}


def _map_lookup(key: Column, mapping: dict, default=None) -> Column:
    expr = F.lit(default)
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)).otherwise(expr)
    return expr


def _each(findings: DataFrame) -> Column:
    """How many findings a row stands for: ``n`` where they come counted."""
    return F.col("n") if "n" in findings.columns else F.lit(1)


def severity_counts(each: Column | int = 1) -> list[Column]:
    return [F.sum(F.when(F.col("severity") == s, each).otherwise(0)).cast("bigint").alias(c)
            for s, c in SEV_COLS.items()]


# ---------------------------------------------------------------- E1
def severity_summary(findings: DataFrame, by=("repo",)) -> DataFrame:
    return findings.groupBy(*by).agg(*severity_counts(), F.count(F.lit(1)).cast("bigint").alias("total"))


def _penalty(weights: dict, default: int = 1, each: Column | int = 1) -> Column:
    return F.sum(_map_lookup(F.col("severity"), weights, default) * each).cast("bigint")


# ---------------------------------------------------------------- E2
def density_score(findings: DataFrame, file_counts: DataFrame, threshold: int = 70) -> DataFrame:
    """Engine T score per repo.  ``file_counts``: (repo, files) including
    skipped files.  Repos without findings score 100.  Findings may come counted, as
    (repo, severity, n)."""
    each = _each(findings)
    pen = findings.groupBy("repo").agg(_penalty(K.DENSITY_PENALTY, each=each).alias("raw_penalty"), *severity_counts(each))
    j = file_counts.join(pen, "repo", "left").fillna(0, subset=["raw_penalty", *SEV_COLS.values()])
    norm = F.greatest(F.lit(1.0), F.log10(F.col("files").cast("double") + 1))
    clamped = F.least(F.lit(100.0), F.col("raw_penalty") / norm)
    score = F.greatest(F.lit(0), C.js_round(F.lit(100.0) - clamped)).cast("int")
    return (j.withColumn("score", score)
            .withColumn("penalty", C.js_round(clamped).cast("int"))
            .withColumn("grade", C.grade(F.col("score")))
            .withColumn("passed", F.col("score") >= F.lit(threshold))
            .drop("raw_penalty"))


# ---------------------------------------------------------------- E3
def decay_score(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Engine P score per repo: floor(100 / (1 + p/150)), at least 1; no
    findings -> 100.  ``repos`` lists every scanned repo (left join)."""
    pen = findings.groupBy("repo").agg(_penalty(K.DECAY_PENALTY).alias("penalty"), *severity_counts(),
                                       F.count(F.lit(1)).cast("bigint").alias("total"))
    j = repos.select("repo").distinct().join(pen, "repo", "left") \
        .fillna(0, subset=["penalty", "total", *SEV_COLS.values()])
    raw = F.floor(F.lit(100.0) / (F.lit(1.0) + F.col("penalty") / F.lit(150.0)))
    score = F.when(F.col("total") == 0, F.lit(100)).otherwise(F.greatest(F.lit(1), raw)).cast("int")
    g = C.grade(F.col("score"))
    label = F.when(F.col("total") == 0, F.lit("No vulnerabilities found")).otherwise(_map_lookup(g, DECAY_LABELS))
    return (j.withColumn("score", score).withColumn("grade", g).withColumn("passed", F.col("score") >= 70)
            .withColumn("label", label))


# ---------------------------------------------------------------- E4-E6
def file_score(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "path").agg(F.count(F.lit(1)).cast("bigint").alias("n")) \
        .withColumn("file_score", F.greatest(F.lit(0), F.lit(100) - F.col("n") * 10).cast("int"))


def grade_text(g: Column) -> Column:
    return _map_lookup(g, GRADE_TEXT)


def threshold_gate(scores: DataFrame, threshold: int = 70) -> DataFrame:
    if not 0 <= threshold <= 100:
        raise ValueError("threshold must be within 0..100")
    return scores.withColumn("passed", F.col("score") >= threshold) \
        .withColumn("exit_code", F.when(F.col("passed"), 0).otherwise(1).cast("int"))


# ---------------------------------------------------------------- E7 / E8
def scan_stats(files: DataFrame, lines_per_file: DataFrame) -> DataFrame:
    """files scanned, files reported as oversize, and lines per repo."""
    f = files.groupBy("repo").agg(
        F.count(F.lit(1)).cast("bigint").alias("files_total"),
        F.sum(F.when(F.col("oversize"), 1).otherwise(0)).cast("bigint").alias("files_oversize"))
    ln = lines_per_file.groupBy("repo").agg(F.sum("lines").cast("bigint").alias("lines_scanned"))
    return f.join(ln, "repo", "left").fillna(0, subset=["lines_scanned"])


def affected_files(findings: DataFrame, keep: int = 20) -> DataFrame:
    """Number of distinct affected paths per repo, and ``first``: the ``keep`` smallest, sorted.

    Paths are made distinct by (repo, path); the ranking keeps at most ``keep`` per task and repo before the exchange
    (up to 1,000), so no repo's whole list is gathered.  The full list is ``findings`` itself, one row per path."""
    d = findings.select("repo", "path").distinct()
    n = d.groupBy("repo").agg(F.count(F.lit(1)).cast("bigint").alias("n_affected"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    first = d.withColumn("_rn", rank).filter(F.col("_rn") <= keep).groupBy("repo").agg(
        F.array_sort(F.collect_list("path")).alias("first"))
    return n.join(first, "repo")


# ---------------------------------------------------------------- E9 / E10
def top_rules(findings: DataFrame, n: int = 8, per_repo: bool = False) -> DataFrame:
    counts = findings.groupBy(*(["repo"] if per_repo else []), "rule_id") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    if not per_repo:
        return counts.orderBy(F.desc("n"), "rule_id").limit(n)
    w = Window.partitionBy("repo").orderBy(F.desc("n"), "rule_id")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def severity_share(findings: DataFrame) -> DataFrame:
    c = findings.groupBy("repo", "severity").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    w = Window.partitionBy("repo")
    return c.withColumn("share", F.least(F.lit(100.0), F.col("n") * 100.0 / F.sum("n").over(w))) \
        .filter(F.col("n") > 0)


# ---------------------------------------------------------------- E11-E14
def findings_by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "path").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "rule_id", "severity"))).alias("findings"),
        F.count(F.lit(1)).cast("bigint").alias("n"))


def findings_by_line(findings: DataFrame, order_col: str = "rule_id", hint_chars: int | None = None) -> DataFrame:
    """Per (file, line): count, the first finding as primary, a label and a
    hint, whole unless the caller gives a display width."""
    agg = findings.groupBy("repo", "path", "line_no").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min(F.struct(F.col(order_col).alias("_o"), "rule_id", "severity", "message")).alias("_p"))
    hint = F.coalesce(F.col("_p.message"), F.lit(""))
    label = F.when(F.col("n") > 1, F.format_string("%d issues", F.col("n"))).otherwise(F.col("_p.rule_id"))
    return agg.select("repo", "path", "line_no", "n", F.col("_p.rule_id").alias("primary_rule"),
                      F.col("_p.severity").alias("primary_severity"), label.alias("label"),
                      (hint if hint_chars is None else F.substring(hint, 1, hint_chars)).alias("hint"))


def code_vs_dependency(findings: DataFrame, dependency_rule: str = "CWE-1104") -> DataFrame:
    kind = F.when(F.col("cwe") == dependency_rule, F.lit("dependency")).otherwise(F.lit("code"))
    return findings.groupBy("repo", kind.alias("kind")).agg(F.sum(_each(findings)).cast("bigint").alias("n"))


def score_band(score: Column) -> Column:
    return F.when(score >= 75, F.lit("good")).when(score >= 50, F.lit("fair")).otherwise(F.lit("poor"))
