"""DuckDB oracle SQL fragments generated from the catalogue.

The oracle re-expresses each operator in plain SQL over the same fixture
views; only the regex dialect is translated (RE2 has no lookaround and an
ASCII ``\\b``).
"""

from __future__ import annotations

from secscan.functions import regex as RX
from secscan.sources import catalogue as K


def q(text: str) -> str:
    return RX.sql_literal(text)


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


SUFFIX_EXT = "lower(regexp_extract({p}, '[^/]\\.([^./]+)$', 1))"
P_SPLIT = ("(CASE WHEN list_last(regexp_split_to_array({c}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}"
           "\\x{{2028}}\\x{{2029}}]')) = '' THEN list_slice(regexp_split_to_array({c}, '\\r\\n|[\\n\\r\\x0b\\x0c"
           "\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1, len(regexp_split_to_array({c}, '\\r\\n|[\\n\\r\\x0b"
           "\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) - 1) ELSE regexp_split_to_array({c}, '\\r\\n|[\\n"
           "\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') END)")
T_SPLIT = "string_split({c}, chr(10))"


def suffix_ext(col: str) -> str:
    return SUFFIX_EXT.format(p=col)


def p_split(col: str) -> str:
    return P_SPLIT.format(c=col)


def t_split(col: str) -> str:
    return T_SPLIT.format(c=col)


def rule_condition(rule: K.Rule, text: str) -> str:
    """SQL boolean: ``text`` matches the rule pattern (RE2 rewrite)."""
    if rule.id == "PY-001":
        return (f"len(list_filter(list_slice(regexp_split_to_array({text}, '\\b(?:eval|exec)\\s*\\('), 2, "
                f"len(regexp_split_to_array({text}, '\\b(?:eval|exec)\\s*\\('))), "
                f"lambda x: NOT regexp_matches(x, '^[''\"][^''\"]*[''\"]\\s*\\)'))) > 0")
    if rule.id in ("DART-002", "CS-DART-002"):
        return (f"len(list_filter(list_slice(regexp_split_to_array({text}, '(?i)[''\"]http://'), 2, "
                f"len(regexp_split_to_array({text}, '(?i)[''\"]http://'))), "
                f"lambda x: NOT regexp_matches(x, '(?i)^(localhost|127\\.0\\.0\\.1)'))) > 0")
    if rule.engine == "T":
        pat = RX.js_to_re2(rule.pattern, rule.ignore_case)
    else:
        pat = RX.py_to_re2(rule.pattern, rule.ignore_case)
    return f"regexp_matches({text}, {q(pat)})"


def p_files_cte(source: str = "code_files", cap: int | None = None) -> str:
    exts = [e.lstrip(".") for e in K.P_EXTENSIONS]
    parts = "string_split(path, '/')"
    body = f"""
  SELECT repo, path, content, {suffix_ext('path')} AS ext
  FROM {source}
  WHERE {suffix_ext('path')} IN {in_list(exts)}
    AND len(list_filter(list_slice({parts}, 1, len({parts}) - 1),
                        lambda d: d IN {in_list(K.P_IGNORE_DIRS)} OR starts_with(d, '.'))) = 0"""
    if cap is None:
        return body
    return f"""
  SELECT repo, path, content, ext FROM (
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM ({body}) pf0) pf1
  WHERE rn <= {cap}"""


def t_files_cte(source: str = "code_files", max_bytes: int = K.T_MAX_FILE_BYTES) -> str:
    from secscan.operators.corpus import glob_to_regex
    ext_cond = " OR ".join(f"ends_with(path, {q(e)})" for e in K.T_EXTENSIONS)
    ign = "|".join(f"(?:{glob_to_regex(g)})" for g in K.T_DEFAULT_IGNORE)
    return f"""
  SELECT repo, path, content, strlen(content) > {max_bytes} AS oversize
  FROM {source}
  WHERE (({ext_cond}) OR starts_with(regexp_extract(path, '([^/]*)$', 1), 'Dockerfile'))
    AND len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.'))) = 0
    AND NOT regexp_matches(path, {q(ign)})"""


def p_line_hits_sql(lines: str = "p_lines", rules: list[K.Rule] | None = None) -> str:
    parts = []
    for r in rules or K.P_RULES:
        parts.append(f"SELECT repo, path, line_no, {q(r.id)} AS rule_id FROM {lines} "
                     f"WHERE ext IN {in_list([e.lstrip('.') for e in r.languages])} AND {rule_condition(r, 'line')}")
    return "\n  UNION ALL ".join(parts)


def p_content_hits_sql(files: str = "p_files") -> str:
    """Pass 2: every match with its line and column, first per (rule, line)."""
    parts = []
    for r in K.P_CONTENT_RULES:
        pat = RX.py_to_re2(r.pattern, r.ignore_case)
        parts.append(f"""SELECT repo, path, {q(r.id)} AS rule_id,
           regexp_split_to_array(content, {q(pat)}) AS ps, regexp_extract_all(content, {q(pat)}) AS ms
    FROM {files} WHERE ext IN {in_list(K.P_CONTENT_EXTENSIONS)}""")
    allm = "\n    UNION ALL ".join(parts)
    return f"""
  SELECT repo, path, rule_id, line_no, col FROM (
    SELECT repo, path, rule_id, k,
           1 + length(pre) - length(replace(pre, chr(10), '')) AS line_no,
           length(regexp_extract(pre, '[^\\n]*$')) AS col,
           row_number() OVER (PARTITION BY repo, path, rule_id,
                              1 + length(pre) - length(replace(pre, chr(10), '')) ORDER BY k) AS rn
    FROM (
      SELECT repo, path, rule_id, k,
             array_to_string(list_transform(range(1, k + 1),
                 lambda i: ps[i] || CASE WHEN i < k THEN ms[i] ELSE '' END), '') AS pre
      FROM (SELECT *, generate_subscripts(ms, 1) AS k FROM ({allm}) m0 WHERE len(ms) > 0) m1) m2) m3
  WHERE rn = 1"""
