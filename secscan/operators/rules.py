"""Items B1-B8: the rule catalogue as a table, selection and configuration."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secscan.sources import catalogue as K

RULE_SCHEMA = T.StructType([
    T.StructField("rule_order", T.IntegerType(), False),
    T.StructField("engine", T.StringType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("enabled", T.BooleanType(), False),
    T.StructField("tags", T.ArrayType(T.StringType()), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("scope", T.StringType(), False),
    T.StructField("gate", T.StringType(), False),
    T.StructField("pattern", T.StringType(), True),
    T.StructField("ignore_case", T.BooleanType(), False),
    T.StructField("cwe", T.StringType(), True),
    T.StructField("owasp", T.StringType(), True),
    T.StructField("languages", T.ArrayType(T.StringType()), False),
    T.StructField("message", T.StringType(), False),
])


def _row(i: int, r: K.Rule):
    rtype = "ast" if r.scope == "struct" else "text"
    return (i, r.engine, r.id, r.name, r.severity, r.enabled, list(r.tags), rtype, r.scope, r.gate, r.pattern,
            r.ignore_case, r.cwe, r.owasp, list(r.languages), r.message)


def rules_all(spark: SparkSession, rules: list[K.Rule] | None = None) -> DataFrame:
    """B1: every rule as a row, ``rule_order`` = registry order."""
    rules = rules if rules is not None else K.all_rules()
    return spark.createDataFrame([_row(i, r) for i, r in enumerate(rules, start=1)], RULE_SCHEMA)


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.filter(F.col("id") == rule_id)


def rules_by_tag(rules: DataFrame, tag: str) -> DataFrame:
    return rules.filter(F.array_contains("tags", tag))


def rules_summary(rules: DataFrame) -> DataFrame:
    return rules.select("id", "name", "severity", "enabled", "tags")


def select_rules(rules: DataFrame, ids=None) -> DataFrame:
    """Explicit ids if the list is non-empty, else every enabled rule."""
    if ids:
        return rules.filter(F.col("id").isin(*ids))
    return rules.filter(F.col("enabled"))


def apply_rule_config(rules: DataFrame, config: DataFrame) -> DataFrame:
    """Disabled / enabled (wins) / severity override per rule id.

    ``config`` columns: rule_id, disabled, enabled, severity.  It is joined by
    rule id (left join: rules without a config row are unchanged)."""
    cfg = config.select(F.col("rule_id").alias("_cid"), F.col("disabled").alias("_dis"),
                        F.col("enabled").alias("_en"), F.col("severity").alias("_sev"))
    j = rules.join(cfg, rules["id"] == cfg["_cid"], "left")
    enabled = (F.when(F.coalesce(F.col("_en"), F.lit(False)), F.lit(True))
               .when(F.coalesce(F.col("_dis"), F.lit(False)), F.lit(False))
               .otherwise(F.col("enabled")))
    return j.withColumn("enabled", enabled) \
        .withColumn("severity", F.coalesce(F.col("_sev"), F.col("severity"))) \
        .drop("_cid", "_dis", "_en", "_sev")


def rules_for_extension(rules: DataFrame) -> DataFrame:
    """ext -> rule ids (engine P map), in registry order."""
    ex = rules.filter(F.col("engine") == "P").select(
        F.explode("languages").alias("ext"), "rule_order", "id")
    return ex.groupBy(F.lower(F.regexp_replace("ext", r"^\.", "")).alias("ext")) \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_order", "id"))), lambda s: s["id"])
             .alias("rule_ids"))


def custom_rule(rule_id: str, pattern: str, languages, severity: str = "MEDIUM", name: str | None = None,
                message: str | None = None, cwe: str | None = None, ignore_case: bool = True, engine: str = "P",
                owasp: str | None = None, remediation: str | None = None) -> K.Rule:
    """A user rule for the line pass of an engine, on files with the given extensions."""
    return K.Rule(engine, rule_id, name or rule_id, severity, cwe, ("custom",), "ext", "raw", pattern, ignore_case,
                  message or f"Custom rule {rule_id} matched.", tuple(languages), owasp, remediation=remediation)


#: a scan's rule set is an array in its plan
MOST_RULES = 10_000


def default_rules(engine: str) -> list[K.Rule]:
    """The enabled rules of an engine, as shipped."""
    rules = K.T_RULES if engine == "T" else K.P_RULES + K.P_CONTENT_RULES + K.PY_FACT_RULES
    return [r for r in rules if r.enabled]


def rule_set(spark: SparkSession, engine: str, ids: Sequence[str] = (), config: DataFrame | None = None,
             custom: Sequence[K.Rule] = ()) -> list[K.Rule]:
    """B5 + B6 + B8: the rules a scan runs: registry and custom rows, configured, then selected.

    The catalogue is worked on as a table and collected once; more than ``MOST_RULES`` rows are an error, as is an id
    that occurs twice.  A configuration row of an unknown id changes nothing."""
    rows = [r for r in K.all_rules() + K.PY_FACT_RULES if r.engine == engine] + list(custom)
    by_id = {r.id: r for r in rows}
    if len(by_id) < len(rows):
        raise ValueError(f"rule ids occur twice: {sorted(i for i in by_id if sum(r.id == i for r in rows) > 1)}")
    if len(rows) > MOST_RULES:
        raise ValueError(f"{len(rows)} rules; a scan takes {MOST_RULES}")
    table = rules_all(spark, rows)
    if config is not None:
        wanted = config.filter(F.col("rule_id").isin(*by_id))
        table = apply_rule_config(table, wanted.groupBy("rule_id").agg(
            F.bool_or("disabled").alias("disabled"), F.bool_or("enabled").alias("enabled"), F.max("severity").alias("severity")))
    chosen = select_rules(table, ids).select("id", "severity").orderBy("rule_order").collect()
    out = [dataclasses.replace(by_id[r.id], severity=r.severity, enabled=True) for r in chosen]
    if engine == "P":  # an unknown severity counts as medium there
        out = [r if r.severity in K.SEVERITIES else dataclasses.replace(r, severity="MEDIUM") for r in out]
    return out
