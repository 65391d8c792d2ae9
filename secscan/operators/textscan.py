"""Items C1-C4, C12-C19: detection over files and lines.

What a file holds is found by ``operators.scan`` in the file's own row; these are its parts as operators of their own,
and what is done with finding rows afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secscan.functions import columns as C
from secscan.operators import corpus as A
from secscan.operators import rules as B
from secscan.operators import scan as N
from secscan.sources import catalogue as K

FINDING_COLUMNS = ("engine", "repo", "path", "line_no", "col", "rule_id", "rule_name", "severity", "message",
                   "cwe", "owasp", "remediation", "pass", "snippet")


# ---------------------------------------------------------------- engine T
def t_prepare(files: DataFrame, ignore=(), max_bytes: int | None = None) -> DataFrame:
    """A2 + A3 + A4 for engine T: ``oversize`` is reported, nothing is skipped for its size."""
    return A.size_gate(A.drop_ignored_paths(A.scannable_files(files, "T"), ignore, "T"), "T", max_bytes)


def scan_raw_lines(spark: SparkSession, files: DataFrame, rules: list[K.Rule] | None = None,
                   prepared: bool = False) -> DataFrame:
    """Engine T text rules (C1, C2, C13, C15) as finding rows."""
    return N.scan_t(files if prepared else t_prepare(files), B.default_rules("T") if rules is None else rules, ("raw", "exec"))


def entropy_secrets(spark: SparkSession, files: DataFrame, prepared: bool = False) -> DataFrame:
    """Quoted literal values passing the entropy test -> VG-SEC-001."""
    return N.scan_t(files if prepared else t_prepare(files), B.default_rules("T"), ("entropy",))


# ---------------------------------------------------------------- engine P
def p_prepare(files: DataFrame) -> DataFrame:
    """A2 + A3 for engine P: all files, of any size."""
    return A.drop_ignored_paths(A.scannable_files(files, "P"), (), "P")


def p_content_findings(files: DataFrame, rules: list[K.Rule] | None = None) -> DataFrame:
    """C4: whole-content rules, the first match per rule and line, on prepared files."""
    return N.scan_p(files, B.default_rules("P") if rules is None else rules, ("content",))


def scan_ext_rules(spark: SparkSession, files: DataFrame, passes=(1, 2), prepared: bool = False,
                   rules: list[K.Rule] | None = None) -> DataFrame:
    """Engine P findings of line rules (pass 1) and whole-content rules (pass 2)."""
    parts = tuple(name for k, name in ((1, "ext"), (2, "content")) if k in passes)
    return N.scan_p(files if prepared else p_prepare(files), B.default_rules("P") if rules is None else rules, parts)


# ---------------------------------------------------------------- C18 snippets
def snippets(findings: DataFrame, files: DataFrame, engine: str = "P") -> DataFrame:
    """Attach context lines to findings that come without (a scan's own rows have them).

    Findings are grouped per file (small) and joined to their file rows; the context is sliced from the file's own
    lines, so no line table is shuffled.  How the join is done is left to Spark's statistics; with the files table
    bucketed by (repo, path) it needs no exchange of contents.
    """
    cols = [c for c in findings.columns if c not in ("repo", "path")]
    side = findings.groupBy("repo", "path").agg(F.collect_list(F.struct(*cols)).alias("_f"))
    j = files.select("repo", "path", "content").join(side, ["repo", "path"])
    j = N.fixed(j, _lines=A.split_lines(F.col("content"), engine)).drop("content")
    around = N.context("h.line_no", 1, 2) if engine == "T" else f"if(h.pass = 2, {N.own_line('h.line_no')}, {N.context('h.line_no', 3, 3)})"
    return j.select("repo", "path", F.explode(F.expr(f"transform(_f, h -> {N.with_field('h', cols, 'snippet', around)})")).alias("w")).select(
        "repo", "path", "w.*")


# ---------------------------------------------------------------- C16 / C17
def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One row per (repo, path, rule, line); lower pass wins, then column.

    Shuffles on the finding key only; findings are small next to the corpus.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("repo", "path", "rule_id", "line_no").orderBy(F.col("pass"), F.col("col"))
    return findings.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def finding_ids(findings: DataFrame, scheme: str = "P") -> DataFrame:
    """``finding_id`` is for display: the first 8 hex digits of md5('rule:path:line'), upper case.

    ``finding_key`` is for joins: a full digest that includes the repo."""
    key = F.concat_ws(":", F.col("rule_id"), F.col("path"), F.col("line_no").cast("string"))
    whole = F.concat_ws("\n", "repo", "path", F.col("line_no").cast("string"), "rule_id")
    return findings.withColumn("finding_id", F.upper(F.substring(F.md5(key), 1, 8))).withColumn(
        "finding_key", F.sha2(whole.cast("binary"), 256))


#: what tells equal places' findings apart: they are numbered in this order
NUMBERED_BY = ("col", "message", "severity", "snippet")


def numbered(findings: DataFrame, *within: str) -> DataFrame:
    """``findings`` with ``_k``, their numbers 1, 2, ... within equal values of ``within``, in the order of their other columns."""
    from pyspark.sql import Window
    return findings.withColumn("_k", F.row_number().over(Window.partitionBy(*within).orderBy(*NUMBERED_BY)))


def place() -> tuple[Column, ...]:
    """Where a finding is and what."""
    return F.col("repo"), F.col("path"), F.col("line_no").cast("string"), F.col("rule_id")


def key_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def finding_keys(findings: DataFrame) -> DataFrame:
    """C17: ``finding_key`` of findings of every grain, the same from scan to scan: a digest of where and what, and which
    of equal ones it is.  Equal ones are numbered per (repo, path, rule, line), in the order of their other columns."""
    return numbered(findings, "repo", "path", "rule_id", "line_no").withColumn("finding_key", key_of(F.concat_ws("\n", *place(), F.col("_k").cast("string")))).drop("_k")


def key_counts(findings: DataFrame) -> DataFrame:
    """(rule_id, findings, keys): how many findings a rule has, and how many different keys (C17) they have."""
    return finding_keys(findings).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("finding_key").alias("keys"))


def shared_key_counts(uses: DataFrame, found: DataFrame, of: tuple[str, ...]) -> DataFrame:
    """``key_counts`` of findings that many places share: each row of ``uses`` (repo, path, *of) has the findings of ``found``
    (*of, rule_id, line_no and the columns that number them) with its values of ``of``; null ones meet nothing.

    Such findings are numbered once per value of ``of``, and go to the places as runs (the first finding and how many).
    At a place its runs are put one behind the other by their first findings, so its findings get the numbers that
    ``finding_keys`` gives them, if in other order where equal runs or runs within another one meet.  Every finding gets
    its key there, and the keys of a place are compared with each other: keys of places that differ as text are digests
    of different texts.  What is exchanged grows with ``uses`` and ``found``, not with their product; a task holds the
    keys of one place at a time."""
    from pyspark.sql import Window
    what = ("rule_id", "line_no")
    runs = numbered(found, *of, *what).groupBy(*[F.col(c).alias(f"_{c}") for c in of], *what).agg(
        F.max("_k").alias("_n"), F.min(F.struct(*NUMBERED_BY)).alias("_first"))
    at = uses.select("repo", "path", *of).join(runs.hint("merge"), [F.col(c) == F.col(f"_{c}") for c in of])
    # by the text of the place, as equal ones make equal keys; so many parts as the session has, for the bytes do not tell the work
    at = at.select("repo", "path", *what, "_n", "_first", F.concat_ws("\n", *place(), F.lit("")).alias("_where")).repartition(
        int(uses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_where")
    own = Window.partitionBy("_where", "repo", "path", *what).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    at = at.groupBy("_where", "rule_id").agg(F.sum("_n").alias("findings"), F.collect_list(F.struct("_before", "_n")).alias("_runs"))
    keys = F.flatten(F.transform("_runs", lambda r: F.transform(
        F.sequence(r["_before"] + 1, r["_before"] + r["_n"]), lambda k: key_of(F.concat("_where", k)))))
    at = at.select("rule_id", "findings", F.size(F.array_distinct(keys)).alias("keys"))
    return at.groupBy("rule_id").agg(F.sum("findings").alias("findings"), F.sum("keys").alias("keys"))


def running_ids(findings: DataFrame, order_cols=("path", "line_no", "rule_id")) -> DataFrame:
    """T: VG-00001 ... per repo in a fixed order (the reference's order is
    file-discovery order; ours is path, line, rule).

    The numbering is a window per repo on the finding keys only (findings are
    small); a third of all findings in one repo still forms one sorted run.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("repo").orderBy(*order_cols)
    return findings.withColumn("running_id", F.format_string("VG-%05d", F.row_number().over(w)))
