"""Items H1-H7: scan history as a table (append-only snapshots)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_COLUMNS = ("id", "repo_url", "repo_name", "ts", "score", "grade", "passed", "total_findings", "critical", "high", "medium", "low",
                   "files_scanned", "lines_scanned", "duration_ms", "scan_json")
#: the summary as scan_json holds it
SUMMARY = ("struct<repo_url:string,repo_name:string,score:struct<score:int,grade:string,passed:boolean,penalty:bigint>,"
           "summary:map<string,bigint>,stats:struct<files_scanned:bigint,lines_scanned:bigint,duration_ms:bigint>,affected_files:array<string>>")


def report_rows(scores: DataFrame, stats: DataFrame, affected: DataFrame) -> DataFrame:
    """The report of every scanned repository as a history row (``HISTORY_COLUMNS`` without id).

    ``scores``: repo, repo_url, ts, duration_ms, score, grade, passed, penalty and counts by severity; ``stats``: repo,
    files_total, lines_scanned; ``affected``: repo, first (paths).  INFO is counted in the total and in scan_json, it has
    no column."""
    j = scores.join(stats.select("repo", F.col("files_total").alias("files_scanned"), "lines_scanned"), "repo", "left").join(
        affected.select("repo", F.col("first").alias("_affected")), "repo", "left").fillna(0, subset=["files_scanned", "lines_scanned"])
    counts = F.create_map(*[x for c in ("critical", "high", "medium", "low", "info") for x in (F.lit(c.upper()), F.col(c))])
    summary = F.struct("repo_url", F.col("repo").alias("repo_name"), F.struct("score", "grade", "passed", "penalty").alias("score"), counts.alias("summary"),
                       F.struct("files_scanned", "lines_scanned", "duration_ms").alias("stats"),
                       F.coalesce("_affected", F.array().cast("array<string>")).alias("affected_files"))
    return j.select("repo_url", F.col("repo").alias("repo_name"), "ts", "score", "grade", "passed",
                    (F.col("critical") + F.col("high") + F.col("medium") + F.col("low") + F.col("info")).alias("total_findings"),
                    "critical", "high", "medium", "low", "files_scanned", "lines_scanned", "duration_ms", F.to_json(summary).alias("scan_json"))


def summaries(history: DataFrame) -> DataFrame:
    """History rows with scan_json opened as the struct ``summary``."""
    return history.withColumn("summary", F.from_json("scan_json", SUMMARY))


def append_scan(reports: DataFrame, path: str) -> None:
    """H1: append report rows to the history table at ``path`` (shared storage).  All columns are required."""
    if missing := [c for c in HISTORY_COLUMNS if c not in reports.columns]:
        raise ValueError(f"report rows lack {', '.join(missing)}")
    reports.select(*HISTORY_COLUMNS).write.mode("append").parquet(path)


def history_page(h: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """H2: newest first, then id; a distributed sort, then offset/limit."""
    return h.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def history_entry(h: DataFrame, entry_id: int) -> DataFrame:
    return h.filter(F.col("id") == entry_id)


def history_stats(h: DataFrame) -> DataFrame:
    """H4: scans, mean score and pass rate (percent) at one decimal; zeros
    when empty (global aggregate with partial aggregation per task)."""
    return h.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_scans"),
        F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).cast("double").alias("avg_score"),
        F.coalesce(F.round(F.avg(F.col("passed").cast("int")) * 100, 1), F.lit(0.0)).cast("double").alias("pass_rate"))


def delete_scan(h: DataFrame, entry_id: int | None = None) -> DataFrame:
    """H5: the snapshot without one entry (or empty for 'clear'); the caller
    writes it to a new snapshot folder."""
    if entry_id is None:
        return h.limit(0)
    return h.filter(F.col("id") != entry_id)


def retain_latest(h: DataFrame, n: int = 50, by: str = "repo_name") -> DataFrame:
    """H6: newest ``n`` per repo (row_number filter -> partial group limit
    before the exchange)."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id"))
    return h.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def score_trend(h: DataFrame, n: int = 10, by: str = "repo_name") -> DataFrame:
    """H7: last ``n`` scans per repo in time order with the change to the
    previous one."""
    last = retain_latest(h, n, by)
    w = Window.partitionBy(by).orderBy("ts", "id")
    return last.withColumn("pos", F.row_number().over(w).cast("int")) \
        .withColumn("change", (F.col("score") - F.lag("score").over(w)).cast("int"))
