"""Items C5-C11 as tables of their own: code facts and the rules that judge them.

JavaScript (C5-C7) is re-aimed: no syntax tree per row, but patterns over a file's text without comments (see
``jsfacts``), so statements may span lines and every occurrence is a row.  Python (C9-C11) is read from code lines
(``pyfacts``).  The whole scan takes the same facts from the same columns, in one pass over a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secscan.operators import rules as B
from secscan.operators import scan as N
from secscan.sources import catalogue as K

STRUCTURAL = ("repo", "path", "line_no", "rule_id", "severity")


def _struct(files: DataFrame, rules: list[K.Rule]) -> DataFrame:
    return N.scan_t(files, rules, ("struct",))


def code_sinks(files: DataFrame) -> DataFrame:
    """C5 + C6: one row per occurrence of a dangerous construct in a JS/TS file."""
    return _struct(files, [r for r in B.default_rules("T") if r.id != "VG-SQL-001"])


def taint_flow(files: DataFrame) -> DataFrame:
    """VG-SQL-001 where the first argument is a template with expressions, a '+' concatenation, or a tainted name;
    ``arg_kind`` says which."""
    rows = N.scan_t(files, [r for r in B.default_rules("T") if r.id == "VG-SQL-001"], ("struct",), keep_cap=True)
    return rows.select(*STRUCTURAL, F.col("cap").alias("arg_kind"))


def structural_findings(files: DataFrame) -> DataFrame:
    """C5 + C6 + C7."""
    return _struct(files, B.default_rules("T")).select(*STRUCTURAL)


def py_findings(files: DataFrame) -> DataFrame:
    """C9 + C10 + C11 as finding rows, all of them; ``pos`` tells several on one line apart."""
    return N.py_facts(files, B.default_rules("P"))
