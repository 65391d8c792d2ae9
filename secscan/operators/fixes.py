"""Items G11 and G12: applying fixes to files, and the history that undoes them.

A fix replaces a range of lines.  Per file the fixes are put in order of their ranges; a fix that overlaps one already
taken is left out.  The file is rebuilt by one pass over its segments: what lies before a fix, its lines, what lies
behind the last.  Of fixes that start on the same line only the first in order can be taken, so they are reduced to
one per line while they are combined: what meets a file's row is no longer than the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secscan.sources.store import table_or_none

FIX_COLUMNS = ("repo", "path", "fix_id", "start_line", "end_line", "fixed_code")
HISTORY_KEY = "fix_id"


def _chosen(fixes: Column, n_lines: Column) -> Column:
    """The fixes, sorted by range, that lie within the file and overlap none before them; a range that ends behind
    the last line ends there."""
    fit = F.filter(fixes, lambda f: (f["start_line"] >= 1) & (f["start_line"] <= n_lines) & (f["end_line"] >= f["start_line"]))
    empty = F.struct(F.lit(0).cast("bigint").alias("end"), F.filter(fixes, lambda f: F.lit(False)).alias("taken"))

    def step(acc: Column, f: Column) -> Column:
        free = f["start_line"] > acc["end"]
        return F.struct(F.when(free, F.least(f["end_line"], n_lines.cast("bigint"))).otherwise(acc["end"]).alias("end"),
                        F.when(free, F.concat(acc["taken"], F.array(f))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(F.array_sort(fit), empty, step)["taken"]


def _indented(code: Column, first: Column) -> Column:
    """The lines of a fix with the indentation of the line it replaces; blank lines stay as they are."""
    indent = F.regexp_extract(first, r"^(\s*)", 1)
    return F.transform(F.split(F.coalesce(code, F.lit("")), "\n", -1), lambda x: F.when(x.rlike(r"^\s*$"), x).otherwise(F.concat(indent, x)))


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """The files that have fixes, with ``fixed`` content, ``n_applied`` and ``applied`` (the fix ids, in order).

    ``fixes``: repo, path, fix_id, start_line, end_line (both included, from 1), fixed_code.  Lines end at line feeds.
    """
    order = F.struct(F.col("end_line").cast("bigint").alias("end_line"), F.col("fix_id").alias("fix_id"), F.col("fixed_code").alias("fixed_code"))
    per_line = fixes.groupBy("repo", "path", F.col("start_line").cast("bigint").alias("start_line")).agg(F.min(
        F.when(F.col("end_line") >= F.col("start_line"), order)).alias("f")).filter("f IS NOT NULL")
    per_file = per_line.groupBy("repo", "path").agg(F.collect_list(F.struct("start_line", "f.end_line", "f.fix_id", "f.fixed_code")).alias("_f"))
    rows = files.join(per_file, ["repo", "path"]).withColumn("_lines", F.split("content", "\n", -1))
    rows = rows.withColumn("_f", _chosen(F.col("_f"), F.size("_lines")))
    n = F.size("_lines").cast("bigint")

    def before(i: Column) -> Column:  # the last line that the fix before this one takes
        return F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.least(F.get("_f", i - 1)["end_line"], n))

    def segment(f: Column, i: Column) -> Column:
        start = before(i) + 1
        return F.concat(F.slice("_lines", start.cast("int"), (f["start_line"] - start).cast("int")),
                        _indented(f["fixed_code"], F.get("_lines", (f["start_line"] - 1).cast("int"))))

    done = before(F.size("_f"))
    tail = F.slice("_lines", (done + 1).cast("int"), (n - done).cast("int"))
    whole = F.concat(F.flatten(F.transform("_f", segment)), tail)
    return rows.withColumn("fixed", F.array_join(whole, "\n")).withColumn("n_applied", F.size("_f")).withColumn(
        "applied", F.transform("_f", lambda f: f["fix_id"])).drop("_f", "_lines")


def fix_outcomes(fixes: DataFrame, applied: DataFrame) -> DataFrame:
    """Every fix with ``taken``: whether ``apply_fixes`` used it."""
    took = applied.select("repo", "path", F.explode("applied").alias("fix_id")).withColumn("_t", F.lit(True))
    return fixes.join(took, ["repo", "path", "fix_id"], "left").withColumn("taken", F.coalesce("_t", F.lit(False))).drop("_t")


def append_fix_history(entries: DataFrame, path: str) -> int:
    """Append the entries whose fix_id the table at ``path`` does not have yet; how many were new.

    Of entries with one id in a batch the least by all columns is taken, so a batch that is sent again, whole or in
    part, adds nothing.  One writer at a time; a batch's files appear together when its job commits.
    """
    spark = entries.sparkSession
    rest = [c for c in entries.columns if c != HISTORY_KEY]
    one = entries.filter(F.col(HISTORY_KEY).isNotNull()).groupBy(HISTORY_KEY).agg(F.min(F.struct(*rest)).alias("_e")).select(
        HISTORY_KEY, *[F.col(f"_e.{c}").alias(c) for c in rest]).select(*entries.columns)
    there = table_or_none(spark, path)
    if there is not None:
        one = one.join(there.select(HISTORY_KEY), HISTORY_KEY, "left_anti").select(*entries.columns)
    before = 0 if there is None else there.count()
    one.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def restore(files: DataFrame, history: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files as they were before the ``wanted`` fixes (a column fix_id): (repo, path, fix_id, content).

    A file named by several wanted fixes goes back to before the earliest of them (by ``applied_at``, then id)."""
    own = history.join(wanted.select(HISTORY_KEY).distinct(), HISTORY_KEY)
    first = own.groupBy("repo", "path").agg(F.min_by(F.struct(HISTORY_KEY, "original"), F.struct("applied_at", HISTORY_KEY)).alias("_o"))
    return files.select("repo", "path").join(first, ["repo", "path"]).select(
        "repo", "path", F.col(f"_o.{HISTORY_KEY}").alias(HISTORY_KEY), F.col("_o.original").alias("content"))
