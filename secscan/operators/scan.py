"""The scan in one pass per file: rules are data, all findings of a file are made in its own row.

A file's lines are split once.  The rules that can apply to it (its extension or family, and one of the strings that
every match of the pattern holds occurs in the content) are picked from an array; only these meet the lines.  Snippets
are sliced from the same array of lines, and a line's finding is kept once per rule, so a scan reads each file once
and has no shuffle.  Nothing depends on how many rules there are but the array: it comes from ``rules.rule_set``,
which is registry rows, selection, configuration and custom rules.

Work per file grows with its size and its findings, also where both are large: sequences of line numbers and markers
take the place of positions added up per hit.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secscan.functions import columns as C
from secscan.functions import regex as RX
from secscan.operators import corpus as A
from secscan.operators import jsfacts as J
from secscan.operators import pyfacts as PY
from secscan.sources import catalogue as K

HIT = "struct<rule_id:string,line_no:int,col:int,severity:string,cap:string,pass:int>"
HIT_FIELDS = ("rule_id", "line_no", "col", "severity", "cap", "pass")
RULE = ("array<struct<id:string,pattern:string,any:array<string>,fold:boolean,gate:string,exts:array<string>,unless:array<string>,"
        "severity:string,cap:boolean>>")
META = "array<struct<id:string,name:string,severity:string,message:string,cwe:string,owasp:string,remediation:string>>"
#: put before a match of a whole-content pattern; where a text has this character itself it is replaced for the search
MARK = "\uf8f0"
LITERAL = r"""["']([^"'\s]{12,})["']"""
#: characters that patterns which ignore case match, though lower() leaves them as they are or not
_FOLD_FROM, _FOLD_TO = "\u017f\u212a\u0131\u0130", "skii"


def java_pattern(rule: K.Rule) -> str:
    if rule.engine == "T":
        return RX.js_to_java(rule.pattern, rule.ignore_case)
    return RX.py_to_java(rule.pattern, rule.ignore_case)


def rule_column(rules: list[K.Rule]) -> Column:
    """The text rules as one constant array."""
    rows = [{"id": r.id, "pattern": java_pattern(r), "any": RX.required_literals(r.pattern, r.ignore_case), "fold": r.ignore_case,
             "gate": r.gate, "exts": [e.lower().lstrip(".") for e in r.languages or (K.P_CONTENT_EXTENSIONS if r.scope == "content" else ())], "unless": list(r.unless), "severity": r.severity,
             "cap": "{1}" in r.message} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), RULE)


def meta_column(rules: list[K.Rule]) -> Column:
    """What findings say of their rules, as one constant map by rule id."""
    rows = [{"id": r.id, "name": r.name, "severity": r.severity, "message": r.message, "cwe": r.cwe, "owasp": r.owasp,
             "remediation": K.remediation(r)} for r in {r.id: r for r in reversed(rules)}.values()]
    return F.map_from_entries(F.transform(F.from_json(F.lit(json.dumps(rows)), META), lambda r: F.struct(r["id"], r)))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row: a generated column is not put into later expressions again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _matching(src: str, rules: str, gate: str) -> Column:
    """Hits of the rules in column ``rules`` that pass ``gate`` (SQL over r) on numbered lines ``src``."""
    return F.expr(f"""flatten(transform(filter({rules}, r -> {gate}
        AND (size(r.any) = 0 OR exists(r.any, s -> contains(if(r.fold, _fold, _content), s)))
        AND NOT exists(r.unless, s -> contains(_content, s))),
      r -> transform(filter({src}, x -> x.l rlike r.pattern), x -> named_struct('rule_id', r.id, 'line_no', x.n, 'col', 0,
        'severity', r.severity, 'cap', if(r.cap, regexp_extract(x.l, r.pattern, 1), ''), 'pass', 1))))""")


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("l")))


def _none(kind: str = HIT) -> Column:
    return F.array().cast(f"array<{kind}>")


def secret_hits(severity: Column | str) -> Column:
    """Lines with a quoted value that passes the entropy test."""
    found = F.filter("_raw", lambda x: x["l"].rlike(LITERAL) & F.exists(F.regexp_extract_all(x["l"], F.lit(LITERAL), 1), C.is_high_entropy_secret))
    hits = F.transform(found, lambda x: F.struct(F.lit("VG-SEC-001").alias("rule_id"), x["n"].alias("line_no"), F.lit(0).alias("col"),
                                                 F.lit(severity).alias("severity"), F.lit("").alias("cap"), F.lit(1).alias("pass")))
    return F.when(F.col("_content").rlike(LITERAL), hits).otherwise(_none())


def content_hits(rules: str) -> Column:
    """C4: the first match of each whole-content rule on each line, with its column.

    A marker is put before every match; the marked text's lines then tell line and column, however many there are."""
    return F.expr(f"""flatten(transform(filter({rules}, r -> array_contains(r.exts, _ext)
        AND (size(r.any) = 0 OR exists(r.any, s -> contains(if(r.fold, _fold, _content), s)))),
      r -> transform(filter(transform(split(regexp_replace(replace(_content, '{MARK}', ' '), r.pattern, '{MARK}$0'), '\\n', -1),
            (l, i) -> named_struct('n', i + 1, 'at', locate('{MARK}', l))), x -> x.at > 0),
        x -> named_struct('rule_id', r.id, 'line_no', x.n, 'col', x.at - 1, 'severity', r.severity, 'cap', '', 'pass', 2))))""")


def first_per_line(df: DataFrame, hits: Column) -> DataFrame:
    """C16 within a file: column _hits with, of several findings of a rule on a line, the one of the earlier pass, then
    column."""
    order = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["rule_id"].alias("rule_id"), h["line_no"].alias("line_no"), h["pass"].alias("pass"), h["col"].alias("col"), h["severity"].alias("severity"), h["cap"].alias("cap"))))
    return fixed(fixed(df, _order=order), _hits=F.expr(
        "filter(_order, (h, i) -> i = 0 OR get(_order, i - 1).rule_id != h.rule_id OR get(_order, i - 1).line_no != h.line_no)"))


def context(n: str, before: int, after: int) -> str:
    """SQL of the lines around line n, joined."""
    return (f"array_join(slice(_lines, greatest({n} - {before}, 1), greatest(least({n} + {after}, size(_lines)) - greatest({n} - {before}, 1) + 1, 0)), '\\n')")


def with_field(name: str, fields, new: str, value: str) -> str:
    """SQL of the struct variable ``name`` with one more field."""
    return "named_struct(" + ", ".join([*(f"'{f}', {name}.`{f}`" for f in fields), f"'{new}', {value}"]) + ")"


def own_line(n: str) -> str:
    """SQL of line n, without the white space around it."""
    return f"regexp_replace(coalesce(get(_lines, {n} - 1), ''), '(?U)^\\\\s+|\\\\s+$', '')"


def _rows(df: DataFrame, engine: str, rules: list[K.Rule], snippet: str, keep_cap: bool = False) -> DataFrame:
    """Finding rows from column _hits; ``snippet`` is SQL over h, a hit.

    Hits are put together by line, so the context of a line is made once, however many findings are on it."""
    df = fixed(df.select("repo", "path", "_lines", F.array_sort(F.transform("_hits", lambda h: F.struct(
        h["line_no"].alias("line_no"), h["pass"].alias("pass"), h.alias("h")))).alias("_sorted")), _starts=F.expr(
        "filter(sequence(0, size(_sorted) - 1), i -> i = 0 OR get(_sorted, i).line_no != get(_sorted, i - 1).line_no OR get(_sorted, i).pass != get(_sorted, i - 1).pass)"))
    groups = F.expr(f"""transform(transform(_starts, (s, k) -> struct(s AS s, get(_sorted, s) AS h, coalesce(get(_starts, k + 1), size(_sorted)) AS z)),
        g -> named_struct('hs', slice(_sorted, g.s + 1, g.z - g.s), 'snippet', transform(array(g.h), h -> {snippet})[0]))""")
    hit = df.select("repo", "path", F.inline(groups)).select("repo", "path", F.explode("hs.h").alias("h"), "snippet")
    row = fixed(hit.select("repo", "path", "h.*", "snippet"), m=F.try_element_at(meta_column(rules), F.col("rule_id")))
    message = F.replace(F.replace(F.col("m.message"), F.lit("{line}"), F.col("line_no").cast("string")), F.lit("{1}"), F.coalesce("cap", F.lit("")))
    return row.select(F.lit(engine).alias("engine"), "repo", "path", "line_no", "col", "rule_id", F.col("m.name").alias("rule_name"), "severity",
                      message.alias("message"), F.col("m.cwe").alias("cwe"), F.col("m.owasp").alias("owasp"), F.col("m.remediation").alias("remediation"),
                      "pass", "snippet", *(["cap"] if keep_cap else []))


def _by_scope(rules: list[K.Rule], *scopes: str) -> list[K.Rule]:
    return [r for r in rules if r.scope in scopes and r.pattern]


def _overrides(rules: list[K.Rule], id_: str) -> K.Rule | None:
    return next((r for r in rules if r.id == id_), None)


def _fold(content: Column) -> Column:
    return F.lower(F.translate(content, _FOLD_FROM, _FOLD_TO))


def scan_t(files: DataFrame, rules: list[K.Rule], parts=("raw", "exec", "entropy", "struct"), keep_cap: bool = False) -> DataFrame:
    """Engine T's findings on prepared files: line rules, code-line rules of Python, secrets, JavaScript facts."""
    families = F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.lit(f)) for f, p in K.T_FAMILIES.items()],
                                       F.when(F.lower("path").contains("dockerfile"), F.lit("docker")), F.when(F.lower("path").endswith(".tf"), F.lit("tf"))))
    lines = A.split_lines(F.col("content"), "T")
    df = fixed(files.select("repo", "path", "content"), _lines=lines, _fams=families, _content=F.col("content"), _fold=_fold(F.col("content"))).drop("content")
    df = fixed(df, _raw=numbered(F.col("_lines")), _rules=rule_column(_by_scope(rules, "raw") if "raw" in parts else []),
               _exec=rule_column(_by_scope(rules, "exec") if "exec" in parts else []))
    is_py, is_js = F.array_contains("_fams", "py"), F.array_contains("_fams", "js")
    hits = [_matching("_raw", "_rules", "(array_contains(_fams, r.gate) OR exists(r.exts, e -> endswith(lower(path), concat('.', e))))")]
    code = F.when(is_py, A.code_lines(F.col("_lines"), "hash")).otherwise(_none("struct<n:int,l:string>"))
    df = fixed(df, _code=code)
    hits.append(_matching("_code", "_exec", "array_contains(_fams, r.gate)"))
    if "entropy" in parts and (secret := _overrides(rules, "VG-SEC-001")):
        hits.append(secret_hits(secret.severity))
    if "struct" in parts:
        df = fixed(df, _js=F.when(is_js & J.worth_reading(F.col("_content")), J.clean(F.col("_content"))))
        hits.append(F.when(F.col("_js").isNotNull(), J.hits("_js", [r for r in rules if r.scope == "struct"])).otherwise(_none()))
    df = fixed(df, _hits=F.concat(*hits)).filter("size(_hits) > 0")
    return _rows(df, "T", rules, context("h.line_no", 1, 2), keep_cap)


def scan_p(files: DataFrame, rules: list[K.Rule], parts=("ext", "content", "py")) -> DataFrame:
    """Engine P's findings on prepared files, once per rule and line: line rules, whole-content rules, Python facts."""
    lines = A.split_lines(F.col("content"), "P")
    df = fixed(files.select("repo", "path", "content"), _lines=lines, _ext=C.suffix_ext(F.col("path")), _content=F.col("content"), _fold=_fold(F.col("content"))).drop("content")
    df = fixed(df, _raw=numbered(F.col("_lines")), _rules=rule_column([r for r in _by_scope(rules, "raw") if r.gate == "ext"] if "ext" in parts else []),
               _whole=rule_column(_by_scope(rules, "content") if "content" in parts else []))
    hits = [_matching("_raw", "_rules", "array_contains(r.exts, _ext)"), content_hits("_whole")]
    if "py" in parts:
        df = fixed(df, _feeds=F.when(F.col("_ext") == "py", A.split_lines(F.col("_content"), "T")))
        df = fixed(df, _code=F.when(F.col("_ext") == "py", A.code_lines(F.col("_feeds"), "hash")).otherwise(_none("struct<n:int,l:string>")))
        hits.append(PY.hits("_code", [r for r in rules if r.scope == "pyfact"]))
    df = first_per_line(df, F.concat(*hits)).filter("size(_hits) > 0")
    return _rows(df, "P", rules, f"if(h.pass = 2, {own_line('h.line_no')}, {context('h.line_no', 3, 3)})")


def py_facts(files: DataFrame, rules: list[K.Rule]) -> DataFrame:
    """Every Python fact of prepared files, also several of a rule on a line."""
    df = files.filter(C.suffix_ext(F.col("path")) == "py")
    df = fixed(df.select("repo", "path", "content"), _lines=A.split_lines(F.col("content"), "T")).drop("content")
    df = fixed(df, _code=A.code_lines(F.col("_lines"), "hash"))
    return df.select("repo", "path", F.explode(PY.hits("_code", [r for r in rules if r.scope == "pyfact"])).alias("h")).select(
        "repo", "path", "h.line_no", F.col("h.col").alias("pos"), "h.rule_id", "h.severity")
