"""Items C9-C11: calls and asserts of Python code lines, judged within the file's row.

Names are read line by line, so a call whose bracket opens on the next line is not seen."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from secscan.functions.regex import spark_literal as q
from secscan.sources import catalogue as K

#: a dotted name and its opening bracket; possessive, and not from within a name
P_CALL = r"(?<![A-Za-z_])([A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)*+)\s*+\("
P_ASSERT = r"^\s*assert\s+(.*)$"
DYNAMIC, GUARD = "AST-PY-SQL001", "AST-PY-ASSERT001"
SINK = "array<struct<name:string,tail:string,id:string,severity:string>>"
HIT = "struct<rule_id:string,line_no:int,col:int,severity:string,cap:string,pass:int>"


def hits(code: str, rules: list[K.Rule]) -> Column:
    """Findings on the code lines (n, l) in column ``code``: dangerous calls, dynamic SQL, asserts as guards.

    ``col`` is the place among the line's calls, so several on one line are told apart; a call is the first sink in list
    order that its name equals or whose last part follows a dot in it."""
    own = {r.id: r for r in rules}
    sinks = [{"name": s, "tail": "." + s.rsplit(".", 1)[-1], "id": i, "severity": own[i].severity} for s in K.PY_SINKS if (i := K.py_sink_id(s)) in own]
    table = f"from_json({q(json.dumps(sinks))}, {q(SINK)})"

    def hit(rule: str, pos: str, severity: str) -> str:
        return f"named_struct('rule_id', {rule}, 'line_no', x.n, 'col', {pos}, 'severity', {severity}, 'cap', '', 'pass', 2)"

    parts = []
    if sinks:
        first = f"get(filter({table}, s -> v.func = s.name OR endswith(v.func, s.tail)), 0)"
        parts.append(f"transform(filter(transform(c, v -> struct(v.pos AS pos, {first} AS s)), v -> v.s IS NOT NULL), v -> {hit('v.s.id', 'v.pos', 'v.s.severity')})")
    if DYNAMIC in own:
        fstring = q("^\\s*[fF][\"']")
        parts.append("transform(filter(c, v -> lower(v.func) rlike 'execute|cursor|query|raw' AND (v.nested OR contains(v.args, '+') "
                     f"OR v.args rlike {fstring})), v -> {hit(q(DYNAMIC), 'v.pos', q(own[DYNAMIC].severity))})")
    if GUARD in own:
        parts.append(f"CASE WHEN lower(regexp_extract(x.l, {q(P_ASSERT)}, 1)) rlike 'auth|user|admin|login|permission' "
                     f"THEN array({hit(q(GUARD), '-1', q(own[GUARD].severity))}) ELSE CAST(array() AS array<{HIT}>) END")
    if not parts:
        return F.array().cast(f"array<{HIT}>")
    # transform(array(y), b -> ...) gives y a name, so it is computed once
    calls = (f"transform(array(named_struct('names', regexp_extract_all(x.l, {q(P_CALL)}, 1), 'rest', split(x.l, {q(P_CALL)}, -1))), "
             "b -> transform(b.names, (n, i) -> named_struct('pos', i, 'func', n, 'args', get(b.rest, i + 1), "
             "'nested', trim(get(b.rest, i + 1)) = '' AND i + 1 < size(b.names))))")
    per_line = f"flatten(transform({calls}, c -> concat({', '.join(parts)})))"
    return F.expr(f"flatten(transform(filter({code}, x -> x.l rlike {q(P_CALL)} OR x.l rlike {q(P_ASSERT)}), x -> {per_line}))")
