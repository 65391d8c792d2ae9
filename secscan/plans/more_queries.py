"""Registered queries: views (F), enrichment (G), history (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secscan.plans import sqlgen as G
from secscan.plans.scan_queries import P_FINDINGS_SQL
from secscan.sources.fixtures import fixture, with_fixtures

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ====================================================================== E at volume (findings_synth)
from secscan.functions import columns as C  # noqa: E402
from secscan.operators import enrich as GE  # noqa: E402
from secscan.operators import history as H  # noqa: E402
from secscan.operators import scoring as E  # noqa: E402
from secscan.operators import textscan as S  # noqa: E402
from secscan.operators import views as V  # noqa: E402
from secscan.sources import catalogue as K  # noqa: E402


def _fs(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "findings_synth")


_CNT = ", ".join(f"CAST(count(*) FILTER (WHERE severity = {G.q(s)}) AS BIGINT) AS {s.lower()}" for s in K.SEVERITIES)


@register("severity_summary", with_fixtures(
    f"SELECT repo, {_CNT}, CAST(count(*) AS BIGINT) AS total FROM findings_synth GROUP BY repo", "findings_synth"))
def q_severity_summary(spark, sf_dir):
    return E.severity_summary(_fs(spark, sf_dir))


_PEN = " ".join(f"WHEN {G.q(s)} THEN {v}" for s, v in K.DECAY_PENALTY.items())


@register("decay_score_at_volume", with_fixtures(f"""
SELECT repo, CAST(sum(CASE severity {_PEN} ELSE 1 END) AS BIGINT) AS penalty, CAST(count(*) AS BIGINT) AS total,
       CAST(greatest(1, floor(100.0 / (1.0 + sum(CASE severity {_PEN} ELSE 1 END) / 150.0))) AS INTEGER) AS score
FROM findings_synth GROUP BY repo""", "findings_synth"))
def q_decay_volume(spark, sf_dir):
    f = _fs(spark, sf_dir)
    return E.decay_score(f.select("repo"), f).select("repo", "penalty", "total", "score")


@register("top_rules", with_fixtures(
    "SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM findings_synth GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 8",
    "findings_synth"))
def q_top_rules(spark, sf_dir):
    return E.top_rules(_fs(spark, sf_dir), 8)


@register("severity_share", with_fixtures("""
SELECT repo, severity, CAST(count(*) AS BIGINT) AS n,
       round(least(100.0, CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER (PARTITION BY repo) AS DOUBLE)), 4) AS share
FROM findings_synth GROUP BY repo, severity""", "findings_synth"))
def q_severity_share(spark, sf_dir):
    return E.severity_share(_fs(spark, sf_dir)).withColumn("share", F.round("share", 4))


@register("file_score", with_fixtures("""
SELECT repo, path, CAST(count(*) AS BIGINT) AS n, CAST(greatest(0, 100 - 10 * count(*)) AS INTEGER) AS file_score
FROM findings_synth GROUP BY repo, path""", "findings_synth"))
def q_file_score(spark, sf_dir):
    return E.file_score(_fs(spark, sf_dir))


@register("affected_files", with_fixtures("""
SELECT repo, CAST(count(*) AS BIGINT) AS n_affected,
       array_to_string(list_slice(list_sort(list(path)), 1, 20), ',') AS first20
FROM (SELECT DISTINCT repo, path FROM findings_synth) d GROUP BY repo""", "findings_synth"))
def q_affected(spark, sf_dir):
    return E.affected_files(_fs(spark, sf_dir)).select("repo", "n_affected",
                                                       F.array_join("first", ",").alias("first20"))


@register("findings_by_line", with_fixtures("""
SELECT repo, path, line_no, CAST(count(*) AS BIGINT) AS n, min(rule_id) AS primary_rule,
       CASE WHEN count(*) > 1 THEN CAST(count(*) AS VARCHAR) || ' issues' ELSE min(rule_id) END AS label
FROM findings_synth GROUP BY repo, path, line_no""", "findings_synth"))
def q_by_line(spark, sf_dir):
    return E.findings_by_line(_fs(spark, sf_dir).withColumn("message", F.col("rule_id"))) \
        .select("repo", "path", "line_no", "n", "primary_rule", "label")


@register("findings_by_file", with_fixtures("""
SELECT repo, path, CAST(count(*) AS BIGINT) AS n,
       array_to_string(list_sort(list(CAST(line_no AS VARCHAR) || ':' || rule_id)), ',') AS items
FROM findings_synth GROUP BY repo, path""", "findings_synth"))
def q_by_file(spark, sf_dir):
    item = F.transform("findings", lambda f: F.concat_ws(":", f["line_no"].cast("string"), f["rule_id"]))
    return E.findings_by_file(_fs(spark, sf_dir)).select("repo", "path", "n", F.array_join(item, ",").alias("items"))


@register("dedupe_findings", with_fixtures("""
SELECT repo, path, rule_id, line_no, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, path, rule_id, line_no ORDER BY seq) AS rn FROM findings_synth) x
WHERE rn = 1""", "findings_synth"))
def q_dedupe(spark, sf_dir):
    f = _fs(spark, sf_dir).withColumn("pass", F.col("seq")).withColumn("col", F.lit(0))
    return S.dedupe_findings(f).select("repo", "path", "rule_id", "line_no", "seq")


@register("finding_ids", with_fixtures("""
SELECT repo, path, line_no, rule_id, upper(substr(md5(rule_id || ':' || path || ':' || CAST(line_no AS VARCHAR)), 1, 8)) AS finding_id
FROM findings_synth""", "findings_synth"))
def q_finding_ids(spark, sf_dir):
    return S.finding_ids(_fs(spark, sf_dir)).select("repo", "path", "line_no", "rule_id", "finding_id")


_RANK = "CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"


@register("by_severity_order", with_fixtures(
    f"SELECT repo, path, line_no, rule_id, severity, seq, CAST({_RANK} AS INTEGER) AS severity_rank FROM findings_synth "
    f"ORDER BY severity_rank DESC, seq, line_no", "findings_synth"))
def q_sev_order(spark, sf_dir):
    f = _fs(spark, sf_dir).withColumn("severity_rank", C.severity_rank(F.col("severity")))
    return V.by_severity_order(f, "seq", "line_no")


@register("severity_filter", with_fixtures(
    "SELECT repo, path, line_no, rule_id, seq FROM findings_synth WHERE severity = 'HIGH'", "findings_synth"))
def q_sev_filter(spark, sf_dir):
    return V.severity_filter(_fs(spark, sf_dir), "HIGH").select("repo", "path", "line_no", "rule_id", "seq")


@register("editor_level", with_fixtures(f"""
SELECT repo, path, line_no, rule_id, seq,
       CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'Error' WHEN severity = 'MEDIUM' THEN 'Warning'
            WHEN severity = 'LOW' THEN 'Information' ELSE 'Hint' END AS level,
       CAST(greatest(line_no - 1, 0) AS INTEGER) AS start_line, CAST(seq % 7 AS INTEGER) AS start_col,
       CAST(greatest(line_no - 1, 0) AS INTEGER) AS end_line, CAST(seq % 7 + 30 AS INTEGER) AS end_col
FROM findings_synth""", "findings_synth"))
def q_editor(spark, sf_dir):
    f = _fs(spark, sf_dir).withColumn("col", (F.col("seq") % 7).cast("int"))
    return V.editor_level(f).select("repo", "path", "line_no", "rule_id", "seq", "level", "start_line", "start_col",
                                    "end_line", "end_col")


_PRES_IN = ("SELECT *, CASE WHEN seq % 3 = 0 THEN NULL ELSE 'CWE-' || CAST(seq % 1000 AS VARCHAR) END AS cwe, "
            "rule_id || ' <' || severity || '> & ' || chr(34) || 'q' || chr(39) AS message FROM findings_synth")


@register("presentation", with_fixtures(f"""
SELECT path, seq, line_no,
       CASE WHEN len(regexp_split_to_array(path, '[/\\\\]')) >= 2
            THEN array_to_string(list_slice(regexp_split_to_array(path, '[/\\\\]'), -2, -1), '/') ELSE path END AS short_path,
       CASE WHEN regexp_extract(coalesce(cwe, ''), '(\\d+)', 1) <> ''
            THEN 'https://cwe.mitre.org/data/definitions/' || regexp_extract(cwe, '(\\d+)', 1) || '.html'
            ELSE 'https://owasp.org/www-project-top-ten/' END AS cwe_link,
       replace(replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'),
               chr(39), '&#039;') AS message_html
FROM ({_PRES_IN}) p""", "findings_synth"))
def q_presentation(spark, sf_dir):
    f = _fs(spark, sf_dir)
    f = f.withColumn("cwe", F.when(F.col("seq") % 3 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("CWE-"), (F.col("seq") % 1000).cast("string")))) \
        .withColumn("message", F.concat(F.col("rule_id"), F.lit(" <"), F.col("severity"), F.lit("> & \"q'")))
    return V.presentation(f).select("path", "seq", "line_no", "short_path", "cwe_link", "message_html")


# ====================================================================== H
def _hs(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "history_synth")


@register("history_page", with_fixtures(
    "SELECT id, repo_name, ts, score FROM history_synth ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 40", "history_synth"))
def q_history_page(spark, sf_dir):
    return H.history_page(_hs(spark, sf_dir), 20, 40).select("id", "repo_name", "ts", "score")


@register("history_stats", with_fixtures("""
SELECT CAST(count(*) AS BIGINT) AS total_scans, CAST(coalesce(round(avg(score), 1), 0.0) AS DOUBLE) AS avg_score,
       CAST(coalesce(round(avg(CAST(passed AS INTEGER)) * 100, 1), 0.0) AS DOUBLE) AS pass_rate
FROM history_synth""", "history_synth"))
def q_history_stats(spark, sf_dir):
    return H.history_stats(_hs(spark, sf_dir))


@register("retain_latest", with_fixtures("""
SELECT id, repo_name, ts, score FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY ts DESC, id DESC) AS rn FROM history_synth) x
WHERE rn <= 50""", "history_synth"))
def q_retain(spark, sf_dir):
    return H.retain_latest(_hs(spark, sf_dir), 50).select("id", "repo_name", "ts", "score")


@register("score_trend", with_fixtures("""
SELECT id, repo_name, ts, score, CAST(row_number() OVER (PARTITION BY repo_name ORDER BY ts, id) AS INTEGER) AS pos,
       CAST(score - lag(score) OVER (PARTITION BY repo_name ORDER BY ts, id) AS INTEGER) AS change
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY ts DESC, id DESC) AS rn
                     FROM history_synth) x WHERE rn <= 10) y""", "history_synth"))
def q_trend(spark, sf_dir):
    return H.score_trend(_hs(spark, sf_dir), 10).select("id", "repo_name", "ts", "score", "pos", "change")


@register("history_entry", with_fixtures(
    "SELECT id, repo_name, score FROM history_synth WHERE id = 7", "history_synth"))
def q_history_entry(spark, sf_dir):
    return H.history_entry(_hs(spark, sf_dir), 7).select("id", "repo_name", "score")


@register("delete_scan", with_fixtures(
    "SELECT id FROM history_synth WHERE id <> 7", "history_synth"))
def q_delete(spark, sf_dir):
    return H.delete_scan(_hs(spark, sf_dir), 7).select("id")


# ====================================================================== G
@register("chat_context", with_fixtures("""
SELECT conv_id, turn, array_to_string(list(upper(role) || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), chr(10)) AS context
FROM turns""", "turns"))
def q_chat(spark, sf_dir):
    return GE.chat_context(fixture(spark, sf_dir, "turns")).select("conv_id", "turn", "context")


@register("fix_risk", with_fixtures("""
SELECT fix_id,
       CAST(CASE WHEN severity = 'CRITICAL' OR contains(fixed, 'eval') OR contains(fixed, 'exec') THEN 60 ELSE 85 END AS INTEGER) AS confidence,
       CASE WHEN contains(lower(fixed), 'delete') OR contains(lower(fixed), 'drop') THEN 'High Risk'
            WHEN severity = 'CRITICAL' OR contains(fixed, 'eval') OR contains(fixed, 'exec') THEN 'Needs Review'
            ELSE 'Safe' END AS risk
FROM fixes""", "fixes"))
def q_fix_risk(spark, sf_dir):
    return GE.fix_risk(fixture(spark, sf_dir, "fixes")).select("fix_id", "confidence", "risk")


@register("line_changes", with_fixtures("""
WITH o AS (SELECT fix_id, line, row_number() OVER (PARTITION BY fix_id, line ORDER BY pos) AS occ FROM (
             SELECT fix_id, unnest(string_split(original, chr(10))) AS line,
                    generate_subscripts(string_split(original, chr(10)), 1) AS pos FROM fixes) a),
     n AS (SELECT fix_id, line, row_number() OVER (PARTITION BY fix_id, line ORDER BY pos) AS occ FROM (
             SELECT fix_id, unnest(string_split(fixed, chr(10))) AS line,
                    generate_subscripts(string_split(fixed, chr(10)), 1) AS pos FROM fixes) b)
SELECT coalesce(o.fix_id, n.fix_id) AS fix_id, coalesce(o.line, n.line) AS line,
       CASE WHEN o.fix_id IS NULL THEN '+' ELSE '-' END AS change
FROM o FULL OUTER JOIN n ON o.fix_id = n.fix_id AND o.line = n.line AND o.occ = n.occ
WHERE o.fix_id IS NULL OR n.fix_id IS NULL""".replace("WITH o AS", "o AS", 1), "fixes"))
def q_line_changes(spark, sf_dir):
    return GE.line_changes(fixture(spark, sf_dir, "fixes"))


@register("bulk_explanations", with_fixtures("""
SELECT repo, path, line_no, rule_id, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq, line_no) AS rn FROM findings_synth) x WHERE rn <= 5""",
    "findings_synth"))
def q_bulk(spark, sf_dir):
    return GE.bulk_explanations(_fs(spark, sf_dir), 5, order=("seq", "line_no")).select(
        "repo", "path", "line_no", "rule_id", "seq")


def _template_sql(value) -> str:
    return " ".join(f"WHEN contains(lower(rule_name), {G.q(k.lower())}) THEN {G.q(value(k))}" for k in GE.TEMPLATE_KEYS)


@register("static_explanations", with_fixtures(f"""
SELECT seq, line_no, CASE {_template_sql(lambda k: k)} ELSE 'generic' END AS template,
  CASE {_template_sql(lambda k: GE.EXPLANATIONS[k][0])} ELSE 'The pattern behind ' || rule_name || ' can be turned against the application.' END AS why_dangerous,
  CAST(3 AS INTEGER) AS practices,
  CASE {_template_sql(lambda k: f"https://cwe.mitre.org/data/definitions/{GE.EXPLANATIONS[k][4][4:]}.html")} ELSE 'https://owasp.org/www-project-top-ten/' END AS reference
FROM (SELECT seq, line_no, CASE CAST(seq % 5 AS INTEGER) WHEN 0 THEN 'SQL Injection via x' WHEN 1 THEN 'Hardcoded Secret'
        WHEN 2 THEN 'DOM XSS and SQL Injection' WHEN 3 THEN 'xss' ELSE 'Other' END AS rule_name FROM findings_synth) f""", "findings_synth"))
def q_static_expl(spark, sf_dir):
    f = _fs(spark, sf_dir).select("seq", "line_no", F.expr(
        "CASE CAST(seq % 5 AS INT) WHEN 0 THEN 'SQL Injection via x' WHEN 1 THEN 'Hardcoded Secret' "
        "WHEN 2 THEN 'DOM XSS and SQL Injection' WHEN 3 THEN 'xss' ELSE 'Other' END").alias("rule_name"))
    return GE.static_explanations(spark, f).select("seq", "line_no", "template", "static.why_dangerous", F.size("static.best_practices").alias("practices"),
                                                   F.get("static.references", F.lit(0)).alias("reference"))


# ====================================================================== A10 / A11 / B / G1 / I
from secscan.operators import corpus as A  # noqa: E402
from secscan.operators import facts as FX  # noqa: E402
from secscan.operators import rules as B  # noqa: E402
from secscan.streaming import streams as I  # noqa: E402

_GH = "^https://github\\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+(/.*)?$"


@register("valid_repo_urls", with_fixtures(f"""
SELECT id, url, error IS NULL AS valid, error FROM (
  SELECT id, url, CASE
    WHEN NOT starts_with(trim(url), 'https://') THEN 'The address does not start with https://'
    WHEN NOT regexp_matches(trim(url), {G.q(_GH)}) THEN 'The address is not that of a repository on github.com'
    WHEN regexp_extract(trim(url), '^https://([^/?#]*)', 1) <> 'github.com' THEN 'The host is not github.com'
    WHEN len(string_split(regexp_replace(regexp_extract(trim(url), '^https://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')) < 2
      THEN 'The address names no owner and repository'
    WHEN lower(string_split(regexp_replace(regexp_extract(trim(url), '^https://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')[1]
               || '/' || string_split(regexp_replace(regexp_extract(trim(url), '^https://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')[2])
         IN ('torvalds/linux', 'microsoft/windows')
      THEN string_split(regexp_replace(regexp_extract(trim(url), '^https://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')[1]
               || '/' || string_split(regexp_replace(regexp_extract(trim(url), '^https://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')[2]
               || ' is not scanned'
    WHEN contains(regexp_extract(trim(url), '^https://[^/?#]*([^?#]*)', 1), '..')
      OR contains(lower(regexp_extract(trim(url), '^https://[^/?#]*([^?#]*)', 1)), '%2e%2e') THEN 'The path leads upwards'
  END AS error FROM repo_urls) x""", "repo_urls"))
def q_valid_urls(spark, sf_dir):
    return A.valid_repo_urls(fixture(spark, sf_dir, "repo_urls")).select("id", "url", "valid", "error")


@register("repo_name", with_fixtures("""
SELECT id, CASE WHEN len(string_split(p, '/')) >= 2 THEN string_split(p, '/')[1] || '/' || string_split(p, '/')[2] ELSE p END AS repo_name
FROM (SELECT id, regexp_replace(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', ''), '^([^?#]*)', 1),
                                '^/+|/+$', '', 'g') AS p FROM repo_urls) x""", "repo_urls"))
def q_repo_name(spark, sf_dir):
    u = fixture(spark, sf_dir, "repo_urls")
    return u.select("id", C.repo_name(F.col("url")).alias("repo_name"))


def _rules_values() -> str:
    rows = []
    for i, r in enumerate(K.P_RULES, 1):
        for e in r.languages:
            rows.append(f"({i}, {G.q(r.id)}, {G.q(e)})")
    return ", ".join(rows)


@register("rule_coverage", with_fixtures(f"""
SELECT f.ext, CAST(count(*) AS BIGINT) AS files, coalesce(max(r.n_rules), 0) AS n_rules, max(r.rule_ids) AS rule_ids
FROM (SELECT {G.suffix_ext('path')} AS ext FROM code_files) f
LEFT JOIN (SELECT ext, CAST(count(*) AS INTEGER) AS n_rules, array_to_string(list(rule_id ORDER BY o), ',') AS rule_ids
           FROM (VALUES {_rules_values()}) v(o, rule_id, ext) GROUP BY ext) r USING (ext)
GROUP BY f.ext""", "code_files"))
def q_rule_coverage(spark, sf_dir):
    """B1 + B7 applied to a corpus: files per extension and the rules that
    apply to them (the catalogue side has a fixed size: broadcast)."""
    from secscan.plans.scan_queries import code_files
    rm = B.rules_for_extension(B.rules_all(spark)).select(
        "ext", F.size("rule_ids").cast("int").alias("n_rules"), F.array_join("rule_ids", ",").alias("rule_ids"))
    files = code_files(spark, sf_dir).select(C.suffix_ext(F.col("path")).alias("ext"))
    per_ext = files.groupBy("ext").agg(F.count(F.lit(1)).cast("bigint").alias("files"))
    return per_ext.join(F.broadcast(rm), "ext", "left").select(
        "ext", "files", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "rule_ids")


@register("debounced_scan", with_fixtures("""
SELECT client, CAST(min(ts_ms) AS BIGINT) AS start_ms, CAST(max(ts_ms) + 1500 AS BIGINT) AS end_ms,
       arg_max(event_id, [ts_ms, event_id]) AS last_event, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts_ms - prev > 1500 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY client ORDER BY ts_ms, event_id) AS sess
      FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY client ORDER BY ts_ms, event_id) AS prev FROM requests) a) b
GROUP BY client, sess""", "requests"))
def q_debounce(spark, sf_dir):
    r = fixture(spark, sf_dir, "requests").withColumn("ts", F.timestamp_millis("ts_ms"))
    d = I.debounced_scan(r, key="client", ts="ts", payload="event_id")
    return d.select("client", F.unix_millis("s.start").alias("start_ms"), F.unix_millis("s.end").alias("end_ms"),
                    F.col("last").alias("last_event"), "n")


@register("prompt_table", with_fixtures(P_FINDINGS_SQL + f""",
lists AS (SELECT repo, path, string_agg(l, chr(10) ORDER BY l) AS finding_list FROM (
   SELECT repo, path, 'L' || line_no || ' ' || rule_id || ' ' || severity AS l FROM p_findings JOIN sev USING (rule_id)) x
   GROUP BY repo, path),
cut AS (SELECT repo, path, content, finding_list, greatest(1, CAST(ceil(length(content) / {GE.CODE_LIMIT}.0) AS INTEGER)) AS parts
        FROM p_files JOIN lists USING (repo, path))
SELECT repo, path, CAST(k AS INTEGER) AS part, parts, 'File: ' || path || chr(10) || 'Part: ' || k || ' of ' || parts || chr(10)
  || 'Findings:' || chr(10) || finding_list || chr(10) || 'Code:' || chr(10)
  || substr(content, CAST((k - 1) * {GE.CODE_LIMIT} + 1 AS BIGINT), {GE.CODE_LIMIT}) AS prompt
FROM cut, unnest(generate_series(1, parts)) AS u(k)""", "code_files"))
def q_prompt_table(spark, sf_dir):
    from secscan.plans.scan_queries import code_files
    files = S.p_prepare(code_files(spark, sf_dir))
    return GE.prompt_table(files, S.scan_ext_rules(spark, files, prepared=True))


@register("enrichment_cache", with_fixtures("""
SELECT event_id, client AS key, (SELECT CAST(a.event_id AS VARCHAR) FROM requests a WHERE a.client = r.client AND a.event_id % 3 = 0
    AND a.ts_ms < r.ts_ms AND r.ts_ms <= a.ts_ms + 60000 ORDER BY a.ts_ms DESC, CAST(a.event_id AS VARCHAR) DESC LIMIT 1) AS cached_body
FROM requests r""", "requests"))
def q_enrichment_cache(spark, sf_dir):
    r = fixture(spark, sf_dir, "requests").select("event_id", F.col("client").alias("key"), F.timestamp_millis("ts_ms").alias("ts"))
    a = r.filter("event_id % 3 = 0").select("key", "ts", F.col("event_id").cast("string").alias("body"))
    return GE.enrichment_cache(r, a, 60).select("event_id", "key", "cached_body")


# ====================================================================== operators over findings, scores and answers
@register("threshold_gate", with_fixtures("""
SELECT id, score, score >= 70 AS passed, CASE WHEN score >= 70 THEN 0 ELSE 1 END AS exit_code,
       CASE WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS band FROM history_synth""", "history_synth"))
def q_threshold_gate(spark, sf_dir):
    h = fixture(spark, sf_dir, "history_synth").select("id", "score")
    return E.threshold_gate(h, 70).withColumn("band", E.score_band(F.col("score")))


@register("finding_lookup", with_fixtures("""
SELECT f.repo, f.path, f.line_no, f.rule_id, k.key, k.asked FROM findings_synth f JOIN (
  SELECT path || ':' || line_no || ':' || rule_id AS key, count(*) AS asked FROM findings_synth WHERE seq % 50 = 0 GROUP BY ALL) k
  ON f.path || ':' || f.line_no || ':' || f.rule_id = k.key""", "findings_synth"))
def q_finding_lookup(spark, sf_dir):
    f = _fs(spark, sf_dir)
    keys = f.filter("seq % 50 = 0").groupBy(F.concat_ws(":", "path", F.col("line_no").cast("string"), "rule_id").alias("key")).agg(
        F.count(F.lit(1)).alias("asked"))
    return V.finding_lookup(f, keys).select("repo", "path", "line_no", "rule_id", "key", "asked")


@register("finding_prompts", with_fixtures("""
SELECT repo, path, line_no, rule_id, seq, 'fix: Unknown (' || severity || ') in ' || path || ' line ' || line_no
  || '. CWE N/A. Snippet: (no snippet)' AS prompt FROM findings_synth""", "findings_synth"))
def q_finding_prompts(spark, sf_dir):
    return GE.finding_prompts(_fs(spark, sf_dir), "fix").select("repo", "path", "line_no", "rule_id", "seq", "prompt")


@register("latest_diagnostics", with_fixtures("""
SELECT repo, path, line_no, rule_id, seq FROM findings_synth f WHERE seq % 7 <> 1 AND NOT EXISTS (
  SELECT 1 FROM findings_synth b WHERE b.seq % 7 = 1 AND b.repo = f.repo AND b.path = f.path)
UNION ALL SELECT repo, path, line_no, rule_id, seq FROM findings_synth WHERE seq % 7 = 1 AND line_no <> 3""", "findings_synth"))
def q_latest_diagnostics(spark, sf_dir):
    """Files of the batch whose only finding is on line 3 come as scanned and clean."""
    f = _fs(spark, sf_dir).select("repo", "path", "line_no", "rule_id", "seq")
    batch = f.filter("seq % 7 = 1").withColumn("rule_id", F.when(F.col("line_no") != 3, F.col("rule_id")))
    return I.latest_diagnostics(f.filter("seq % 7 != 1"), batch)


_KEY_SQL = "sha256(repo || chr(10) || path || chr(10) || line_no || chr(10) || rule_id)"
_ANSWERS_SQL = f"""
answers AS (SELECT DISTINCT {_KEY_SQL} AS finding_key, 'p' || (seq % 3) AS provider,
  CASE WHEN seq % 5 = 0 THEN '' ELSE 'text ' || (seq % 11) END AS body FROM findings_synth)"""


def _answers(spark, sf_dir):
    return S.finding_ids(_fs(spark, sf_dir)).select(
        "finding_key", F.concat(F.lit("p"), (F.col("seq") % 3).cast("string")).alias("provider"),
        F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat(F.lit("text "), (F.col("seq") % 11).cast("string"))).alias("body")).distinct()


@register("provider_fallback", with_fixtures(f"""{_ANSWERS_SQL}
SELECT finding_key, provider, body FROM (SELECT *, row_number() OVER (PARTITION BY finding_key ORDER BY
  CASE provider WHEN 'p2' THEN 1 WHEN 'p0' THEN 2 ELSE 3 END, body) AS rn FROM answers WHERE body <> '') x WHERE rn = 1""", "findings_synth"))
def q_provider_fallback(spark, sf_dir):
    order = spark.createDataFrame([("p2", 1), ("p0", 2), ("p1", 3)], "provider string, prio int")
    return GE.provider_fallback(_answers(spark, sf_dir), order)


@register("merge_enrichment", with_fixtures(f"""{_ANSWERS_SQL},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_key ORDER BY provider, body) AS rn FROM answers) x WHERE rn = 1)
SELECT repo, path, line_no, rule_id, seq, coalesce(nullif(b.body, ''), rule_id) AS explanation,
       CASE WHEN b.body <> '' THEN 'model' END AS source
FROM (SELECT *, {_KEY_SQL} AS finding_key FROM findings_synth) f LEFT JOIN (
  SELECT * FROM best WHERE finding_key <= '8') b USING (finding_key)""", "findings_synth"))
def q_merge_enrichment(spark, sf_dir):
    f = S.finding_ids(_fs(spark, sf_dir)).withColumn("message", F.col("rule_id"))
    parsed = _answers(spark, sf_dir).filter("finding_key <= '8'").select(
        "finding_key", F.struct("provider", "body").alias("seq"), F.struct(F.col("body").alias("why_dangerous")).alias("answer"))
    return GE.merge_enrichment(f, parsed).select("repo", "path", "line_no", "rule_id", "seq", "explanation", "source")
