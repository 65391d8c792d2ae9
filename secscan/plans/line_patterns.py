"""Patterns of the DuckDB side for JavaScript and Python facts: single lines in RE2, where the operators read whole files.
They agree on texts whose statements stand on one line each."""

from __future__ import annotations

from secscan.sources import catalogue as K

IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"
LIT_ARG = r"""^\s*("[^"]*"|'[^']*'|`[^`]*`|null)\s*(,|\)|;|$)"""
PLAIN_LIT_ARG = r"""^\s*("[^"]*"|'[^']*'|`[^`$]*`)\s*(,|\)|$)"""

# Statement patterns on single lines (no lookaround).
P_EVAL = r"(^|[^A-Za-z0-9_$.])eval\s*\("
P_TIMER = r"""(^|[^A-Za-z0-9_$.])(setTimeout|setInterval)\s*\(\s*["'`]"""
P_NEWFN = r"(^|[^A-Za-z0-9_$.])new\s+Function([^A-Za-z0-9_$]|$)"
P_XSS_ASSIGN = r"\.(innerHTML|outerHTML|insertAdjacentHTML)\s*\+?=([^=].*|)$"
P_DOCWRITE = r"(^|[^A-Za-z0-9_$.])document\s*\.\s*(write|writeln)\s*\((.*)$"
P_FS = (r"(^|[^A-Za-z0-9_$.])(fs|promises|fsPromises)\s*\.\s*(" + "|".join(K.FS_METHODS) + r")\s*\((.*)$")
P_PATHJOIN = r"(^|[^A-Za-z0-9_$.])(path|nodePath)\s*\.\s*join\s*\(([^)]*)"
P_RAND = r"Math\s*\.\s*random\s*\(\s*\)"
P_RAND_NAME = r"(" + IDENT + r")\s*[:=]\s*Math\s*\.\s*random\s*\(\s*\)\s*([;,)}\]]|$)"
P_SQL = r"\.\s*(" + "|".join(K.SQL_METHODS) + r")\s*\((.*)$"
P_ARG_IDENT = r"^\s*(" + IDENT + r")\s*(,|\)|$)"
SQL_LITERAL_ARG = r"""^\s*("[^"]*"|'[^']*')\s*(,|\)|$)"""
P_PATH_ARG = r"^\s*" + IDENT + r"(\s*\.\s*" + IDENT + r")*\s*(\(.*)?$"
RANDOM_CONTEXT = "(?i)(" + "|".join(K.RANDOM_CONTEXT_NAMES) + ")"

# Assignment facts for taint.
P_DECL = r"(^|[^A-Za-z0-9_$.])(const|let|var)\s+(" + IDENT + r")\s*=([^=].*)$"
P_DESTRUCT = r"(^|[^A-Za-z0-9_$.])(const|let|var)\s*\{([^}]*)\}\s*=([^=].*)$"
P_ASSIGN = r"(^|[^A-Za-z0-9_$.\s]\s*|^\s*)(" + IDENT + r")\s*=([^=].*)$"
P_SOURCE = r"^\s*req\s*\.\s*(body|query|params|headers)\s*(;|,|\)|$)"

#: a dotted name and its opening bracket
P_CALL = r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\s*\("
P_ASSERT = r"^\s*assert\s+(.*)$"
