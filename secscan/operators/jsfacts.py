"""Items C5-C7: facts of JavaScript and TypeScript statements, read from a whole file within its row.

Comments are taken out first, and line breaks inside template texts become soft ones, so a statement may run over
lines: patterns see the file as one text.  Every occurrence counts, also several on a line.  Lines come from a marker
before each match; the first argument of a call is what stands before the first comma or closing bracket at its own
depth (brackets nested up to ``DEPTH`` deep).  Taint is a fold over the file's assignments in source order:
declarations taint and never un-taint, plain assignments taint or un-taint, sources have exactly two parts; sinks see
the final state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from secscan.functions.regex import spark_literal as q
from secscan.sources import catalogue as K

HIT = "struct<rule_id:string,line_no:int,col:int,severity:string,cap:string,pass:int>"
#: a line break inside a template, and what is put before a match
SOFT, MARK = "\ue000", "\ue001"
DEPTH = 8

IDENT = r"[A-Za-z_$][\w$]*+"
FREE = r"(?<![\w$.])"  # not within a name or behind a dot
# runs are possessive and loops go from one special character to the next, so long texts need no deep recursion
STRING = r"""(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""
TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
#: strings that are not closed end with their line; templates must be closed
TOKEN = (r""""[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+(?:"|(?=\n)|\z|\\)|'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+(?:'|(?=\n)|\z|\\)|"""
         + TEMPLATE + r"""|//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/""")
END = r"\s*(?:[,);]|\z)"


def _nested(depth: int) -> str:
    inner = f"|{_nested(depth - 1)}" if depth else ""
    return rf"""[(\[{{](?:[^()\[\]{{}}"'`]++|{STRING}|{TEMPLATE}{inner})*+[)\]}}]"""


NESTED = _nested(DEPTH)
ARGUMENT = rf"""(?:[^()\[\]{{}},"'`]++|{STRING}|{TEMPLATE}|{NESTED})*+"""

EVAL = FREE + r"eval\s*\("
TIMER = FREE + r"""(?:setTimeout|setInterval)\s*\(\s*["'`]"""
FUNCTION = FREE + r"new\s+Function(?![\w$])"
HTML = rf"\.(?:innerHTML|outerHTML|insertAdjacentHTML)\s*\+?=(?!=)(?!\s*(?:{STRING}|{TEMPLATE}|null)[ \t]*(?:[,);]|\n|\z))"
WRITE = FREE + rf"document\s*\.\s*(?:write|writeln)\s*\((?!\s*\))(?!\s*(?:{STRING}|{TEMPLATE}|null){END})"
FILES = FREE + rf"(?:fs|promises|fsPromises)\s*\.\s*(?:{'|'.join(K.FS_METHODS)})\s*\((?!\s*\))(?!\s*(?:{STRING}|`[^`$]*`)\s*(?:[,)]|\z))"
JOIN = FREE + r"(?:path|nodePath)\s*\.\s*join\s*\(([^)]*)"
JOIN_PART = rf"^\s*{IDENT}(\s*\.\s*{IDENT})*\s*(\(.*)?$"
RANDOM = rf"(?:(?<![\w$])({IDENT})\s*+[:=]\s*+)?Math\s*\.\s*random\s*\(\s*\)(?=(\s*(?:[;,)}}\]]|\n|\z))?)"
RANDOM_CONTEXT = "(?i)(" + "|".join(K.RANDOM_CONTEXT_NAMES) + ")"
SQL = rf"\.\s*(?:{'|'.join(K.SQL_METHODS)})\s*\((?=({ARGUMENT}))"
#: a destructuring (its names in group 1, its value in 2), or a declaration or assignment (3 keyword, 4 name, 5 value)
ASSIGN = (FREE + rf"(?:(?:const|let|var)\s*\{{([^}}]*)\}}\s*=(?![=>])\s*+(?=([^;,\n]*))"
          rf"|(?:(const|let|var)\s+)?+({IDENT})(?:\s*:\s*[\w.<>\[\]]+)?\s*=(?![=>])\s*+(?=([^;,\n]*)))")
SOURCE = r"^req\s*\.\s*(?:body|query|params|headers)\s*$"

#: strings of which one occurs in every file with a fact
KEYWORDS = ("eval", "setTimeout", "setInterval", "Function", "innerHTML", "outerHTML", "insertAdjacentHTML", "write", "fs", "romises",
            "join", "random", *K.SQL_METHODS)


def worth_reading(content: Column) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(content, k))


def clean(content: Column) -> Column:
    """The text without comments, line by line where it was, line breaks in templates soft."""
    text = F.translate(content, SOFT + MARK, "  ")
    token = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.when(t.startswith("//"), "")
                        .when(t.startswith("/*"), F.regexp_replace(t, r"[^\n]++", " ")).when(t.startswith("`"), F.replace(t, F.lit("\n"), F.lit(SOFT))).otherwise(t))
    rest = F.split(text, TOKEN, -1)
    parts = F.transform(F.array(F.struct(rest.alias("r"), token.alias("t"))), lambda z: F.array_join(
        F.transform(z["r"], lambda r, i: F.concat(r, F.coalesce(F.get(z["t"], i), F.lit("")))), ""))
    return parts[0]


def _lines(pattern: str, js: str) -> str:
    """SQL array of the line number of every match."""
    return (f"flatten(transform(split(regexp_replace({js}, {q(pattern)}, '{MARK}$0'), '[\\n{SOFT}]', -1), "
            f"(l, i) -> array_repeat(i + 1, length(l) - length(replace(l, '{MARK}', '')))))")


def _facts(rule: str, severity: str, pattern: str, needs: tuple[str, ...], js: str, keep: str = "TRUE", groups: tuple[int, ...] = ()) -> str:
    """SQL hits of a pattern; ``keep`` and ``severity`` may use the groups as m.g1, m.g2, ..."""
    fields = ", ".join(["'line', " + _lines(pattern, js), *[f"'g{g}', regexp_extract_all({js}, {q(pattern)}, {g})" for g in groups]])
    each = ", ".join(["'n', l", *[f"'g{g}', get(b.g{g}, i)" for g in groups]])
    hit = f"named_struct('rule_id', {q(rule)}, 'line_no', m.n, 'col', 0, 'severity', {severity}, 'cap', '', 'pass', 1)"
    some = " OR ".join(f"contains({js}, {q(n)})" for n in needs)
    return (f"CASE WHEN {some} THEN flatten(transform(array(named_struct({fields})), b -> transform(filter(transform(b.line, (l, i) -> named_struct({each})), "
            f"m -> {keep}), m -> {hit}))) ELSE CAST(array() AS array<{HIT}>) END")


def argument_kind(arg: str) -> str:
    """SQL kind of a first argument: literal, template with expressions, '+' at its own depth, a name, or other."""
    flat = f"regexp_replace({arg}, {q(f'{STRING}|{TEMPLATE}|{NESTED}')}, '_')"
    return (f"CASE WHEN {arg} rlike {q(rf'^\s*{STRING}\s*$')} THEN 'literal' WHEN {arg} rlike {q(r'^\s*`[^`]*\$\{')} AND {flat} rlike '^\\\\s*_\\\\s*$' THEN 'template' "
            f"WHEN {flat} rlike {q(r'(?<!\+)\+(?!\+)')} THEN 'concat' WHEN {arg} rlike {q(rf'^\s*{IDENT}\s*$')} THEN 'ident' ELSE 'other' END")


def tainted(js: str) -> str:
    """SQL array of the names that hold a source's value at the end of the file."""
    groups = ", ".join(f"'g{g}', regexp_extract_all({js}, {q(ASSIGN)}, {g})" for g in range(1, 6))
    names = f"filter(transform(split(get(b.g1, i), ','), p -> if(contains(p, '...') OR contains(p, '='), '', regexp_extract(p, {q(rf'({IDENT})\s*$')}, 1))), n -> n != '')"
    value = "trim(coalesce(nullif(get(b.g2, i), ''), get(b.g5, i)))"
    fact = f"named_struct('names', if(k = '', {names}, array(k)), 'plain', get(b.g3, i) = '' AND k != '', 'value', {value})"
    step = (f"if(f.value rlike {q(SOURCE)} OR array_contains(acc, f.value), array_union(acc, f.names), "
            "if(f.plain, array_except(acc, f.names), acc))")
    return (f"CASE WHEN contains({js}, 'req') THEN aggregate(flatten(transform(array(named_struct({groups})), b -> transform(b.g4, (k, i) -> {fact}))), "
            f"CAST(array() AS array<string>), (acc, f) -> {step}) ELSE CAST(array() AS array<string>) END")


def sql_hits(rule: K.Rule, js: str) -> str:
    """SQL hits of query calls whose first argument is built or tainted; ``cap`` is the argument's kind."""
    fields = f"'line', {_lines(SQL, js)}, 'arg', regexp_extract_all({js}, {q(SQL)}, 1), 'bad', {tainted(js)}"
    call = f"named_struct('n', l, 'kind', {argument_kind('get(b.arg, i)')}, 'dirty', array_contains(b.bad, trim(get(b.arg, i))))"
    keep = "m.kind IN ('template', 'concat') OR (m.kind = 'ident' AND m.dirty)"
    hit = f"named_struct('rule_id', {q(rule.id)}, 'line_no', m.n, 'col', 0, 'severity', {q(rule.severity)}, 'cap', m.kind, 'pass', 1)"
    some = " OR ".join(f"contains({js}, {q(n)})" for n in K.SQL_METHODS)
    return (f"CASE WHEN {some} THEN flatten(transform(array(named_struct({fields})), b -> transform(filter(transform(b.line, (l, i) -> {call}), "
            f"m -> {keep}), m -> {hit}))) ELSE CAST(array() AS array<{HIT}>) END")


def hits(js: str, rules: list[K.Rule]) -> Column:
    """Findings of the structural rules on the cleaned text in column ``js``."""
    own = {r.id: r for r in rules}
    parts = []

    def add(rule: str, severity: str, pattern: str, needs: tuple[str, ...], **more) -> None:
        if rule in own:  # an overridden severity is that of all of the rule's facts
            given = own[rule].severity != K.DEFAULT_SEVERITY[rule]
            parts.append(_facts(rule, q(own[rule].severity) if given else severity, pattern, needs, js, **more))

    add("VG-EVAL-001", "'HIGH'", EVAL, ("eval",))
    add("VG-EVAL-001", "'MEDIUM'", TIMER, ("setTimeout", "setInterval"))
    add("VG-EVAL-001", "'HIGH'", FUNCTION, ("Function",))
    add("VG-XSS-001", "'HIGH'", HTML, ("innerHTML", "outerHTML", "insertAdjacentHTML"))
    add("VG-XSS-001", "'HIGH'", WRITE, ("document",))
    add("VG-PATH-001", "'HIGH'", FILES, ("fs", "romises"))
    add("VG-PATH-001", "'MEDIUM'", JOIN, ("join",), groups=(1,), keep=f"exists(split(m.g1, ','), a -> a rlike {q(JOIN_PART)})")
    add("VG-RAND-001", f"if(m.g1 != '' AND m.g2 != '' AND m.g1 rlike {q(RANDOM_CONTEXT)}, 'MEDIUM', 'INFO')", RANDOM, ("random",), groups=(1, 2))
    if "VG-SQL-001" in own:
        parts.append(sql_hits(own["VG-SQL-001"], js))
    return F.expr(f"concat({', '.join(parts)})") if parts else F.array().cast(f"array<{HIT}>")
