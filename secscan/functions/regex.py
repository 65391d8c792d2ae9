"""Regex dialects.

Catalogue patterns are stored verbatim (JavaScript for engine T, Python ``re``
for engine P).  Spark runs ``java.util.regex``; the DuckDB oracle runs RE2.
These helpers translate only what differs between the dialects:

* JavaScript ``\\b`` is ASCII; Java 17's is Unicode-ish -> explicit ASCII boundary.
* Python ``\\w \\b \\s`` and case folding are Unicode, ``.`` stops only at ``\\n``
  -> Java flags ``(?U)`` (implies Unicode case) and ``(?d)``.
* RE2 has no Unicode ``\\b`` -> explicit class test for Python patterns.
"""

from __future__ import annotations

import re

_ASCII_WORD = "[A-Za-z0-9_]"
_JAVA_ASCII_BOUNDARY = f"(?:(?<={_ASCII_WORD})(?!{_ASCII_WORD})|(?<!{_ASCII_WORD})(?={_ASCII_WORD}))"
_RE2_UNICODE_NONWORD = r"[^\p{L}\p{N}_]"


def _replace_unescaped(pattern: str, token: str, repl) -> str:
    """Replace escape ``token`` (e.g. ``\\b``) when its backslash is not itself escaped."""
    out = []
    i = 0
    while i < len(pattern):
        if pattern.startswith(token, i):
            out.append(repl(pattern, i))
            i += len(token)
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def js_to_java(pattern: str, ignore_case: bool) -> str:
    body = _replace_unescaped(pattern, r"\b", lambda p, i: _JAVA_ASCII_BOUNDARY)
    return ("(?i)" if ignore_case else "") + body


def py_to_java(pattern: str, ignore_case: bool) -> str:
    return ("(?idU)" if ignore_case else "(?dU)") + pattern


def js_to_re2(pattern: str, ignore_case: bool) -> str:
    return ("(?i)" if ignore_case else "") + pattern


def py_to_re2(pattern: str, ignore_case: bool) -> str:
    """Unicode word boundary for RE2 by consuming the neighbour character.

    Valid for match/no-match tests only (positions shift); every ``\\b`` in
    the catalogue sits next to a word character of the pattern, so a leading
    ``\\b`` means "previous char is not a word char" and a trailing one
    "next char is not a word char".
    """
    def repl(p: str, i: int) -> str:
        nxt = p[i + 2:i + 3]
        leading = bool(nxt) and (nxt.isalnum() or nxt in "(_")
        if leading:
            return f"(?:^|{_RE2_UNICODE_NONWORD})"
        return f"(?:$|{_RE2_UNICODE_NONWORD})"
    body = _replace_unescaped(pattern, r"\b", repl)
    return ("(?i)" if ignore_case else "") + body


def has_lookaround(pattern: str) -> bool:
    return bool(re.search(r"\(\?<?[!=]", pattern))


def sql_literal(text: str) -> str:
    """Single-quoted SQL literal usable by both Spark SQL and DuckDB.

    Spark SQL treats backslash as an escape inside literals, DuckDB does not,
    so patterns with backslashes are passed to Spark through the DataFrame API
    and to DuckDB through this helper.
    """
    return "'" + text.replace("'", "''") + "'"


def spark_literal(text: str) -> str:
    """String literal of Spark SQL, whatever the text holds."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def _required(seq) -> list[list[str]]:
    """Sets of strings of a parsed pattern; every match holds one string of each set."""
    from re import _constants as S
    found, run = [], ""
    for op, arg in seq:
        if op is S.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append([run])
            run = ""
        if op is S.SUBPATTERN:
            found += _required(arg[-1])
        elif op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT) and arg[0] >= 1:
            found += _required(arg[2])
        elif op is S.ATOMIC_GROUP:
            found += _required(arg)
        elif op is S.BRANCH:
            each = [_best(_required(b)) for b in arg[1]]
            if all(each):
                found.append(sorted({s for one in each for s in one}))
    if run:
        found.append([run])
    return found


def _best(sets: list[list[str]]) -> list[str]:
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=[])


def required_literals(pattern: str, ignore_case: bool) -> list[str]:
    """Strings of which every match of the pattern holds at least one; empty if none of two characters is known.

    Texts without any of them need not meet the pattern at all.  Lower-case where the pattern ignores case."""
    from re import _parser
    try:
        best = _best(_required(_parser.parse(pattern)))
    except re.error:
        return []
    if not best or min(map(len, best)) < 2:
        return []
    return sorted({s.lower() if ignore_case else s for s in best})
