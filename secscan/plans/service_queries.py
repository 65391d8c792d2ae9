"""Registered queries of answers, reports and state around the scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from secscan.operators import corpus as A
from secscan.operators import enrich as GE
from secscan.operators import history as H
from secscan.operators import rules as B
from secscan.operators import scoring as E
from secscan.operators import textscan as S
from secscan.plans import sqlgen as G
from secscan.plans.dependency_queries import DEPENDENCY_FINDINGS_SQL
from secscan.plans.scan_queries import P_ALL_SQL, T_ALL_SQL, T_FINDINGS_SQL, _decay_sql, code_files, scan_corpus_p, t_corpus
from secscan.sources import catalogue as K
from secscan.sources.fixtures import fixture, with_fixtures
from secscan.sources.store import new_path
from secscan.streaming import streams as I

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ====================================================================== G3, G9
@register("parse_responses", with_fixtures("""
c AS (SELECT *, trim(coalesce(body, ''), ' ' || chr(10)) AS t FROM responses),
k AS (SELECT *, [t, CASE WHEN starts_with(t, '```') AND len(string_split(t, chr(10))) > 2 THEN array_to_string(string_split(t, chr(10))[2:-2], chr(10)) END,
        regexp_extract(t, '(?s)(\\{.*\\})', 1), regexp_extract(t, '(?s)(\\[.*\\])', 1)] AS cs FROM c),
f AS (SELECT *, list_filter([1, 2, 3, 4], lambda i: coalesce(json_valid(cs[i]), FALSE) AND cs[i] <> '')[1] AS form_no FROM k),
v AS (SELECT *, CAST(cs[form_no] AS JSON) AS j FROM f),
o AS (SELECT *, list_filter(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN j IS NOT NULL THEN [j] ELSE [] END, lambda x: json_type(x) = 'OBJECT') AS os FROM v)
SELECT conv_id, turn, ['whole', 'fence', 'object', 'array'][form_no] AS form, CAST(len(os) AS INTEGER) AS n_items, os[1] ->> 'why_dangerous' AS why_dangerous,
       TRY_CAST(os[1] ->> 'confidence_score' AS INTEGER) AS confidence_score, os[1] ->> 'fixed_code' AS fixed_code FROM o""", "responses"))
def q_parse_responses(spark, sf_dir):
    p = GE.parse_responses(fixture(spark, sf_dir, "responses"))
    return p.select("conv_id", "turn", "form", F.when(F.col("form").isNull(), 0).otherwise(F.size("items")).alias("n_items"), "answer.why_dangerous", "answer.confidence_score", "answer.fixed_code")


@register("static_fix", with_fixtures(f"""{P_ALL_SQL},
names AS (SELECT * FROM (VALUES {", ".join(f"({G.q(r.id)}, {G.q(r.name)})" for r in K.P_RULES + K.P_CONTENT_RULES + K.PY_FACT_RULES)}) n(rule_id, rule_name)),
lines AS (SELECT repo, path, CAST(generate_subscripts(arr, 1) AS INTEGER) AS line_no, unnest(arr) AS line FROM arrs)
SELECT f.repo, f.path, f.line_no, f.rule_id, n.rule_name, '# TODO: replace (' || n.rule_name || ')' || chr(10) || '# ' || trim(l.line) AS fixed_code,
       'Replace the code behind ' || n.rule_name || ' as its remediation says.' AS explanation, 'Check the callers before it is applied.' AS breaking_changes,
       'Closes ' || n.rule_name || '.' AS security_improvement
FROM p_all f JOIN names n USING (rule_id) JOIN lines l USING (repo, path, line_no) WHERE f.rule_id LIKE 'AST-%'""", "code_files"))
def q_static_fix(spark, sf_dir):
    """Findings of the second pass, whose snippet is their line."""
    found = scan_corpus_p(spark, S.p_prepare(code_files(spark, sf_dir))).filter("pass = 2")
    return GE.static_fix(found).select("repo", "path", "line_no", "rule_id", "rule_name", "fixed_code", "explanation", "breaking_changes", "security_improvement")


# ====================================================================== H1 with E7
_SCORED = _decay_sql()
_REPORT_SQL = f"""{_SCORED[:_SCORED.rindex("SELECT repo, CAST(penalty")]},
lines AS (SELECT repo, CAST(count(*) AS BIGINT) AS files, CAST(sum(len({G.p_split('content')})) AS BIGINT) AS n FROM p_files GROUP BY repo)
SELECT 'https://github.com/' || s.repo AS repo_url, s.repo AS repo_name, s.score,
       CASE WHEN s.score >= 90 THEN 'A' WHEN s.score >= 75 THEN 'B' WHEN s.score >= 55 THEN 'C' WHEN s.score >= 35 THEN 'D' ELSE 'F' END AS grade, s.score >= 70 AS passed,
       CAST(s.total AS BIGINT) AS total_findings, CAST(s.critical AS BIGINT) AS critical, CAST(s.high AS BIGINT) AS high, CAST(s.medium AS BIGINT) AS medium,
       CAST(s.low AS BIGINT) AS low, l.files AS files_scanned, l.n AS lines_scanned, CAST(1000 AS BIGINT) AS duration_ms,
       CAST(s.info AS BIGINT) AS info, CAST(s.penalty AS BIGINT) AS penalty, CAST(least(20, coalesce(a.n, 0)) AS INTEGER) AS n_affected
FROM scored s JOIN lines l USING (repo) LEFT JOIN (SELECT repo, count(DISTINCT path) AS n FROM p_all GROUP BY repo) a USING (repo)"""


@register("append_scan", with_fixtures(_REPORT_SQL, "code_files"))
def q_append_scan(spark, sf_dir):
    """Every repository's report goes into the history table; columns and summary are read back from it."""
    files = S.p_prepare(code_files(spark, sf_dir))
    found = scan_corpus_p(spark, files)
    lines = files.select("repo", F.size(A.split_lines(F.col("content"), "P")).alias("lines"))
    stats = E.scan_stats(files.select("repo", F.lit(False).alias("oversize")), lines)
    scores = E.decay_score(files, found).withColumn("repo_url", F.concat(F.lit("https://github.com/"), F.col("repo"))).withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn("duration_ms", F.lit(1000).cast("bigint"))
    path = new_path(spark, "scan-history")
    H.append_scan(H.report_rows(scores, stats, E.affected_files(found)).withColumn("id", F.crc32("repo_url")), path)
    back = H.summaries(spark.read.parquet(path))
    return back.select("repo_url", "repo_name", "score", "grade", "passed", "total_findings", "critical", "high", "medium", "low", "files_scanned", "lines_scanned",
                       "duration_ms", F.col("summary.summary").getItem("INFO").alias("info"), "summary.score.penalty", F.size("summary.affected_files").alias("n_affected"))


# ====================================================================== E13, C17 T
_DEPENDENCY_RULES = [r.id for r in K.T_RULES if r.cwe == "CWE-1104"] + ["VG-SCA-001"]


@register("code_vs_dependency", with_fixtures(f"""{DEPENDENCY_FINDINGS_SQL},{T_ALL_SQL}
SELECT repo, CASE WHEN rule_id IN {G.in_list(_DEPENDENCY_RULES)} THEN 'dependency' ELSE 'code' END AS kind, CAST(count(*) AS BIGINT) AS n
FROM all_f GROUP BY ALL""", "code_files", "manifests", "advisory_records"))
def q_code_vs_dependency(spark, sf_dir):
    return E.code_vs_dependency(t_corpus(spark, sf_dir, ("repo", "cwe")))


# ====================================================================== B2-B6
_RULES_SQL = ", ".join(f"({G.q(r.id)}, {G.q(r.severity)}, {G.q('|'.join(r.tags))})" for r in K.T_RULES)


@register("findings_by_tag", with_fixtures(f"""{DEPENDENCY_FINDINGS_SQL},{T_ALL_SQL},
r AS (SELECT * FROM (VALUES {_RULES_SQL}) v(rule_id, severity, tags)),
t AS (SELECT rule_id, unnest(string_split(tags, '|')) AS tag FROM r WHERE tags <> '')
SELECT f.repo, t.tag, CAST(count(*) AS BIGINT) AS n FROM all_f f JOIN t USING (rule_id) GROUP BY ALL""", "code_files", "manifests", "advisory_records"))
def q_findings_by_tag(spark, sf_dir):
    """B3 at volume: findings per repository and tag of the rules that made them."""
    tags = B.rules_summary(B.rules_all(spark, K.T_RULES)).select(F.col("id").alias("rule_id"), F.explode("tags").alias("tag"))
    found = t_corpus(spark, sf_dir, ("repo", "rule_id"))
    return found.join(F.broadcast(tags), "rule_id").groupBy("repo", "tag").agg(F.sum("n").alias("n"))


@register("scan_selected_rules", with_fixtures(f"""{P_ALL_SQL}
SELECT repo, path, line_no, rule_id, severity FROM p_all WHERE rule_id IN ('CS-EXEC-001', 'CS-SEC-002', 'AST-PY-ASSERT001')""", "code_files"))
def q_scan_selected(spark, sf_dir):
    """A scan of named rules only."""
    from secscan.operators import scan as N
    rules = B.rule_set(spark, "P", ids=("CS-EXEC-001", "CS-SEC-002", "AST-PY-ASSERT001", "NO-SUCH-RULE"))
    return N.scan_p(S.p_prepare(code_files(spark, sf_dir)), rules).select("repo", "path", "line_no", "rule_id", "severity")


# ====================================================================== I4, I5
@register("diagnostics_table", with_fixtures("""
SELECT repo, path, line_no, rule_id, seq FROM findings_synth f
WHERE seq % 3 = (SELECT max(g.seq % 3) FROM findings_synth g WHERE g.repo = f.repo AND g.path = f.path) AND line_no <> 3""", "findings_synth"))
def q_diagnostics_table(spark, sf_dir):
    """Findings come in three batches, the second one twice; rows on line 3 stand for files scanned and found clean."""
    f = fixture(spark, sf_dir, "findings_synth").select("repo", "path", "line_no", F.when(F.col("line_no") != 3, F.col("rule_id")).alias("rule_id"), "seq")
    path = new_path(spark, "diagnostics")
    for batch in (0, 1, 1, 2):
        I.write_batch(f.filter(F.col("seq") % 3 == batch), batch, path)
    packed = new_path(spark, "diagnostics-compact")
    I.compact(spark.read.parquet(path), 2, packed)
    return I.current_diagnostics(spark.read.parquet(packed)).select("repo", "path", "line_no", "rule_id", "seq")


@register("cache_dedupe", with_fixtures("""
n AS (SELECT key, CAST(ts_ms AS BIGINT) AS ts_ms, min(event_id) AS event_id FROM hot_requests GROUP BY ALL),
chain AS (WITH RECURSIVE c AS (
    SELECT key, min(ts_ms) AS ts_ms FROM n GROUP BY key
    UNION ALL SELECT key, ts_ms FROM (SELECT n.key, n.ts_ms, row_number() OVER (PARTITION BY n.key ORDER BY n.ts_ms) AS rn FROM c JOIN n ON n.key = c.key AND n.ts_ms >= c.ts_ms + 60000) x
      WHERE rn = 1)
  SELECT * FROM c)
SELECT key, ts_ms, event_id FROM n JOIN chain USING (key, ts_ms)""", "hot_requests"))
def q_cache_dedupe(spark, sf_dir):
    return I.stored_rows(fixture(spark, sf_dir, "hot_requests"), 60_000)


# ====================================================================== pages as files; C18 on findings that come without context
@register("scan_html_files", with_fixtures(f"""
p_files AS ({G.p_files_cte("html_files")}),
p_lines AS (SELECT repo, path, ext, CAST(generate_subscripts(arr, 1) AS INTEGER) AS line_no, unnest(arr) AS line
            FROM (SELECT repo, path, ext, {G.p_split('content')} AS arr FROM p_files) x),
hits AS ({G.p_line_hits_sql()})
SELECT repo, path, line_no, rule_id FROM hits""", "html_files"))
def q_scan_html(spark, sf_dir):
    return S.scan_ext_rules(spark, fixture(spark, sf_dir, "html_files")).select("repo", "path", "line_no", "rule_id")


@register("finding_snippets", with_fixtures(f"""{T_FINDINGS_SQL},
arrs AS (SELECT repo, path, {G.t_split('content')} AS arr FROM t_files)
SELECT t.repo, t.path, t.line_no, t.rule_id, array_to_string(list_slice(arr, greatest(t.line_no - 1, 1), least(t.line_no + 2, len(arr))), chr(10)) AS snippet
FROM t_text t JOIN arrs USING (repo, path)""", "code_files"))
def q_finding_snippets(spark, sf_dir):
    """Findings stored without context get it from the files again."""
    files = S.t_prepare(code_files(spark, sf_dir))
    found = S.scan_raw_lines(spark, files, prepared=True).drop("snippet")
    return S.snippets(found, files, "T").select("repo", "path", "line_no", "rule_id", "snippet")
