"""Items F1-F7: ordering, filters and presentation columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secscan.functions import columns as C


def by_severity_order(findings: DataFrame, *tiebreak: str) -> DataFrame:
    """most severe first, stable within (a distributed range sort)."""
    return findings.orderBy(F.desc(C.severity_rank(F.col("severity"))), *tiebreak)


def severity_filter(findings: DataFrame, severity: str = "ALL") -> DataFrame:
    return findings if severity == "ALL" else findings.filter(F.col("severity") == severity)


def editor_level(findings: DataFrame) -> DataFrame:
    """severity -> editor level; 0-based range, default end column +30."""
    lvl = (F.when(F.col("severity").isin("CRITICAL", "HIGH"), "Error").when(F.col("severity") == "MEDIUM", "Warning")
           .when(F.col("severity") == "LOW", "Information").otherwise("Hint"))
    start_line = F.greatest(F.col("line_no") - 1, F.lit(0))
    start_col = F.greatest(F.coalesce(F.col("col"), F.lit(0)), F.lit(0))
    end_line = F.greatest(F.coalesce(F.col("end_line"), F.col("line_no")) - 1, F.lit(0)) \
        if "end_line" in findings.columns else start_line
    end_col = F.coalesce(F.col("end_col"), start_col + 30) if "end_col" in findings.columns else start_col + 30
    return findings.withColumn("level", lvl).withColumn("start_line", start_line.cast("int")) \
        .withColumn("start_col", start_col.cast("int")).withColumn("end_line", end_line.cast("int")) \
        .withColumn("end_col", end_col.cast("int"))


def finding_lookup(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """equi-join on the key path:line:rule."""
    k = F.concat_ws(":", F.col("path"), F.col("line_no").cast("string"), F.col("rule_id"))
    return findings.withColumn("key", k).join(keys, "key")


def presentation(findings: DataFrame) -> DataFrame:
    """F3 + F6 + F7 columns."""
    return findings.withColumn("short_path", C.short_path(F.col("path"))) \
        .withColumn("cwe_link", C.cwe_link(F.col("cwe"))) \
        .withColumn("message_html", C.html_safe(F.col("message")))
