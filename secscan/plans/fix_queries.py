"""Registered queries of applied fixes and their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from secscan.operators import fixes as X
from secscan.sources.fixtures import fixture, with_fixtures
from secscan.sources.store import new_path

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


#: which fixes are taken, by walking from one to the next; the files rebuilt from numbered lines
APPLY_SQL = """
ln AS (SELECT repo, path, CAST(generate_subscripts(a, 1) AS BIGINT) AS n, unnest(a) AS line FROM (
  SELECT repo, path, string_split(content, chr(10)) AS a FROM indented_files) x),
len AS (SELECT repo, path, max(n) AS n_lines FROM ln GROUP BY ALL),
fits AS (SELECT f.repo, f.path, fix_id, CAST(start_line AS BIGINT) AS s, least(CAST(end_line AS BIGINT), n_lines) AS e, end_line, fixed_code
         FROM file_fixes f JOIN len USING (repo, path) WHERE start_line >= 1 AND start_line <= n_lines AND end_line >= start_line),
taken AS (WITH RECURSIVE t AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY s, end_line, fix_id) AS rn FROM fits) x WHERE rn = 1
    UNION ALL SELECT repo, path, fix_id, s, e, end_line, fixed_code, rn FROM (
      SELECT f.repo, f.path, f.fix_id, f.s, f.e, f.end_line, f.fixed_code,
             row_number() OVER (PARTITION BY f.repo, f.path ORDER BY f.s, f.end_line, f.fix_id) AS rn
      FROM t JOIN fits f ON f.repo = t.repo AND f.path = t.path AND f.s > t.e) y WHERE rn = 1)
  SELECT * FROM t),
new AS (SELECT t.repo, t.path, s AS n, k, CASE WHEN trim(c[k]) = '' THEN c[k] ELSE regexp_extract(l.line, '^(\\s*)', 1) || c[k] END AS line
        FROM (SELECT *, string_split(fixed_code, chr(10)) AS c FROM taken) t JOIN ln l ON l.repo = t.repo AND l.path = t.path AND l.n = t.s,
             unnest(generate_series(1, len(c))) AS u(k)),
kept AS (SELECT l.repo, l.path, l.n, 0 AS k, l.line FROM ln l WHERE NOT EXISTS (
           SELECT 1 FROM taken t WHERE t.repo = l.repo AND t.path = l.path AND l.n BETWEEN t.s AND t.e)),
done AS (SELECT repo, path, string_agg(line, chr(10) ORDER BY n, k) AS fixed FROM (SELECT * FROM new UNION ALL SELECT * FROM kept) z GROUP BY ALL),
ids AS (SELECT repo, path, CAST(count(*) AS INTEGER) AS n_applied, string_agg(fix_id, ',' ORDER BY s) AS applied FROM taken GROUP BY ALL)
"""


def _applied(spark, sf_dir):
    return X.apply_fixes(fixture(spark, sf_dir, "indented_files"), fixture(spark, sf_dir, "file_fixes"))


@register("apply_fixes", with_fixtures(APPLY_SQL + """
SELECT f.repo, f.path, coalesce(fixed, '') AS fixed, coalesce(n_applied, 0) AS n_applied, coalesce(applied, '') AS applied
FROM done f LEFT JOIN ids USING (repo, path) WHERE EXISTS (SELECT 1 FROM file_fixes x WHERE x.repo = f.repo AND x.path = f.path AND end_line >= start_line)""",
    "indented_files", "file_fixes"))
def q_apply_fixes(spark, sf_dir):
    return _applied(spark, sf_dir).select("repo", "path", "fixed", "n_applied", F.array_join("applied", ",").alias("applied"))


@register("fix_outcomes", with_fixtures(APPLY_SQL + """
SELECT f.repo, f.path, f.fix_id, t.fix_id IS NOT NULL AS taken FROM file_fixes f LEFT JOIN taken t USING (repo, path, fix_id)""", "indented_files", "file_fixes"))
def q_fix_outcomes(spark, sf_dir):
    return X.fix_outcomes(fixture(spark, sf_dir, "file_fixes"), _applied(spark, sf_dir)).select("repo", "path", "fix_id", "taken")


@register("fix_history", with_fixtures("""
SELECT repo, path, repo || ':' || path AS fix_id, content FROM indented_files WHERE length(content) % 3 = 0""", "indented_files"))
def q_fix_history(spark, sf_dir):
    """Every file's fix goes into the history, twice; a third of the fixes is taken back."""
    done = _applied(spark, sf_dir)
    files = fixture(spark, sf_dir, "indented_files")
    entries = files.join(done.select("repo", "path", "fixed"), ["repo", "path"], "left").select(
        F.concat_ws(":", "repo", "path").alias("fix_id"), "repo", "path", F.col("content").alias("original"), "fixed",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("applied_at"))
    path = new_path(spark, "fix-history")
    X.append_fix_history(entries, path)
    if X.append_fix_history(entries, path):
        raise AssertionError("a batch sent again added rows")
    history = spark.read.parquet(path)
    wanted = history.filter(F.length("original") % 3 == 0).select("fix_id")
    return X.restore(files, history, wanted)
