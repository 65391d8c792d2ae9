"""Items G1-G14: explanation and fix data around a model (the model call
itself is not built: prompts go out as a table, answers come back as one)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secscan.functions import columns as C

CODE_LIMIT = 12_000  # FIXED VALUE: characters of code sent per file.
# FIXED VALUES: explanation template keys, in lookup order.
TEMPLATE_KEYS = ("SQL Injection", "Hardcoded Secret", "XSS")


def prompt_table(files: DataFrame, findings: DataFrame, part_chars: int = CODE_LIMIT) -> DataFrame:
    """G1: prompts for each file that has findings, in numbered parts of ``part_chars`` characters of code: all of it.

    Findings are listed per file first (a shuffle of the small finding rows),
    then joined to the file rows."""
    per_file = findings.groupBy("repo", "path").agg(
        F.array_join(F.array_sort(F.collect_list(F.format_string("L%d %s %s", F.col("line_no"), F.col("rule_id"),
                                                                    F.col("severity")))), "\n").alias("finding_list"))
    j = files.select("repo", "path", "content").join(per_file, ["repo", "path"])
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / part_chars)).cast("int")
    j = j.withColumn("parts", n).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    code = F.substring("content", (F.col("part") - 1) * part_chars + 1, F.lit(part_chars))
    return j.select("repo", "path", "part", "parts", F.concat(
        F.lit("File: "), F.col("path"), F.lit("\nPart: "), F.col("part").cast("string"), F.lit(" of "), F.col("parts").cast("string"),
        F.lit("\nFindings:\n"), F.col("finding_list"), F.lit("\nCode:\n"), code).alias("prompt"))


def finding_prompts(findings: DataFrame, kind: str = "explain") -> DataFrame:
    """One prompt per finding with defaults for missing fields."""
    def d(c: str, default: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in findings.columns else F.lit(default)
    text = F.format_string(
        "%s: %s (%s) in %s line %s. CWE %s. Snippet: %s",
        F.lit(kind), d("rule_name", "Unknown"), d("severity", "UNKNOWN"), d("path", "unknown"), d("line_no", "0"),
        d("cwe", "N/A"), d("snippet", "(no snippet)"))
    return findings.withColumn("prompt", text)


#: fields of a parsed answer and their types
RESPONSE_FIELDS = {"why_dangerous": "string", "attack_scenario": "string", "fixed_code": "string", "explanation": "string",
                   "confidence_score": "int", "risk_level": "string"}
#: where JSON may be in an answer, in the order it is looked for
FORMS = ("whole", "fence", "object", "array")


def _candidates(body: Column) -> Column:
    """The texts that may be JSON: the whole answer, what its code fence holds, its outermost {...}, its outermost [...]."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    lines = F.split(text, "\n", -1)
    fence = F.when(text.startswith("```") & (F.size(lines) > 2), F.array_join(F.slice(lines, 2, F.size(lines) - 2), "\n"))
    return F.array(text, fence, F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1))


def parse_responses(responses: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """``parsed`` (the first of the forms that is JSON, as a variant), ``form`` (which it was; null for broken and
    empty answers) and ``items``: the answer's objects, one or the elements of its array.  ``fields`` are read from the
    first one into the struct ``answer``; a field that is missing or of another type is null."""
    tried = responses.withColumn("_c", _candidates(F.col("body")))
    # the parser passes over what stands behind a value, so a text is JSON if it is the only element of an array
    tried = tried.withColumn("_v", F.transform("_c", lambda c: F.transform(
        F.array(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")),
        lambda e: F.when(F.size(e) == 1, F.get(e, F.lit(0))))[0]))
    at = F.try_element_at(F.filter(F.sequence(F.lit(0), F.lit(len(FORMS) - 1)), lambda i: F.get("_v", i).isNotNull()), F.lit(1))
    tried = tried.withColumn("_at", at).withColumn("parsed", F.get("_v", F.col("_at")))
    tried = tried.withColumn("form", F.get(F.array(*[F.lit(f) for f in FORMS]), F.col("_at")))
    many = F.try_variant_get("parsed", "$", "array<variant>")
    tried = tried.withColumn("items", F.filter(F.coalesce(many, F.array("parsed")), lambda v: F.schema_of_variant(v).startswith("OBJECT")))
    first = F.get("items", F.lit(0))
    answer = F.struct(*[F.try_variant_get(first, f"$.{n}", k).alias(n) for n, k in (fields or RESPONSE_FIELDS).items()])
    return tried.withColumn("answer", F.when(F.size("items") > 0, answer)).drop("_c", "_v", "_at")


def merge_enrichment(findings: DataFrame, parsed: DataFrame, id_col: str = "finding_key") -> DataFrame:
    """Left join by id; first response per id wins; empty text falls back
    to the original; a source tag only on rows that got an answer."""
    first = parsed.groupBy(id_col).agg(F.min_by(F.struct(F.col("answer.why_dangerous").alias("why")), "seq").alias("_a")).select(
        F.col(id_col), F.col("_a.why").alias("_why"))
    j = findings.join(first, id_col, "left")
    why = F.coalesce(F.nullif(F.col("_why"), F.lit("")), F.col("message"))
    return j.withColumn("explanation", why).withColumn(
        "source", F.when(F.nullif(F.col("_why"), F.lit("")).isNotNull(), F.lit("model"))).drop("_why")


#: what is said of a finding without a model, by the first key that its rule's name holds; our own wording
EXPLANATIONS = {
    "SQL Injection": ("Text from outside becomes part of a statement, so whoever sends it decides what the database does.",
                      "A form field that closes the quoted value and adds a condition that is always true lists every row.",
                      ("Bind values as parameters.", "Check input against what is expected.", "Give the account only the rights it needs."),
                      "A database holds what the application is there to protect.", "CWE-89"),
    "Hardcoded Secret": ("Everybody who can read the code can use the secret, also from old revisions.",
                         "A copy of the repository is searched for keys, and one of them opens a paid service.",
                         ("Read secrets from a store at run time.", "Replace a secret that was ever committed.", "Keep files with secrets out of version control."),
                         "The secret works without any further step.", "CWE-798"),
    "XSS": ("Markup from one user runs as script in the page of another.", "A comment with a script sends the reader's session to its author.",
            ("Write text instead of markup.", "Escape by context.", "Restrict where scripts may come from."),
            "It acts with the rights of whoever looks at the page.", "CWE-79"),
}
GENERIC_EXPLANATION = ("The pattern behind {0} can be turned against the application.", "A scanner finds the place, and an input made for it does the rest.",
                       ("Follow the remediation of the finding.", "Review what reaches this code.", "Scan on every change."),
                       "The rating follows the rule's own.", None)


def explanation(rule_name: Column) -> Column:
    """why_dangerous, attack_scenario, best_practices, severity_rationale, references of a rule by its name."""
    def one(t: tuple) -> Column:
        why, attack, practices, rating, cwe = t
        return F.struct(F.replace(F.lit(why), F.lit("{0}"), rule_name).alias("why_dangerous"), F.lit(attack).alias("attack_scenario"),
                        F.array(*[F.lit(p) for p in practices]).alias("best_practices"), F.lit(rating).alias("severity_rationale"),
                        F.array(C.cwe_link(F.lit(cwe))).alias("references"))

    out = one(GENERIC_EXPLANATION)
    for key in reversed(TEMPLATE_KEYS):
        out = F.when(F.lower(rule_name).contains(key.lower()), one(EXPLANATIONS[key])).otherwise(out)
    return out


def static_explanations(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """``template`` (the first key, in list order, that occurs in the rule name, any case; else generic) and its
    fields as the struct ``static``.  The list is fixed, so the lookup compiles to one CASE expression (no join)."""
    name = F.coalesce(F.col("rule_name"), F.lit(""))
    expr = F.lit("generic")
    for key in reversed(TEMPLATE_KEYS):
        expr = F.when(F.lower(name).contains(key.lower()), F.lit(key)).otherwise(expr)
    return findings.withColumn("template", expr).withColumn("static", explanation(name))


def bulk_explanations(findings: DataFrame, n: int = 5, by: str = "repo", order=("seq",)) -> DataFrame:
    """The first ``n`` findings per scan, each keeping its own id."""
    if n < 1:
        raise ValueError("n must be at least 1")
    w = Window.partitionBy(by).orderBy(*order)
    return findings.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def provider_fallback(answers: DataFrame, priority: DataFrame, id_col: str = "finding_key") -> DataFrame:
    """First non-empty answer by provider priority, with the winner."""
    ok = answers.filter(F.coalesce(F.length("body"), F.lit(0)) > 0).join(priority, "provider")
    best = F.min_by(F.struct("provider", "body"), F.struct("prio", "body"))
    return ok.groupBy(id_col).agg(best.alias("w")) \
        .select(id_col, F.col("w.provider").alias("provider"), F.col("w.body").alias("body"))


def fix_risk(fixes: DataFrame) -> DataFrame:
    """Confidence 85 by default, at most 60 when CRITICAL or the fixed
    text has eval/exec ("Needs Review"); delete/drop in any case -> "High Risk"."""
    fixed = F.coalesce(F.col("fixed"), F.lit(""))
    base_conf = F.coalesce(F.col("confidence"), F.lit(85)) if "confidence" in fixes.columns else F.lit(85)
    crit = (F.col("severity") == "CRITICAL") | fixed.contains("eval") | fixed.contains("exec")
    conf = F.when(crit, F.least(base_conf, F.lit(60))).otherwise(base_conf)
    given = F.coalesce(F.col("risk_level"), F.lit("Safe")) if "risk_level" in fixes.columns else F.lit("Safe")
    risk = (F.when(F.lower(fixed).contains("delete") | F.lower(fixed).contains("drop"), F.lit("High Risk"))
            .when(crit, F.lit("Needs Review")).otherwise(given))
    return fixes.withColumn("confidence", conf.cast("int")).withColumn("risk", risk)


def static_fix(findings: DataFrame) -> DataFrame:
    """The fields of a fix without a model, with the whole snippet: fixed_code, explanation, breaking_changes,
    security_improvement."""
    snip = F.trim(F.coalesce(F.col("snippet"), F.lit("")))
    name = F.coalesce(F.col("rule_name"), F.lit("Unknown"))
    return findings.withColumn("fixed_code", F.concat(F.lit("# TODO: replace ("), name, F.lit(")\n"), F.regexp_replace(snip, "(?m)^", "# "))) \
        .withColumn("explanation", F.format_string("Replace the code behind %s as its remediation says.", name)) \
        .withColumn("breaking_changes", F.lit("Check the callers before it is applied.")) \
        .withColumn("security_improvement", F.format_string("Closes %s.", name))


def line_changes(fixes: DataFrame, key=("fix_id",)) -> DataFrame:
    """Removed and added lines of a fix as multiset differences
    (each line numbered by its occurrence, then a full outer join)."""
    w_o = Window.partitionBy(*key, "line").orderBy("pos")
    o = fixes.select(*key, F.posexplode(F.split("original", "\n", -1)).alias("pos", "line")) \
        .withColumn("occ", F.row_number().over(w_o))
    n = fixes.select(*key, F.posexplode(F.split("fixed", "\n", -1)).alias("pos", "line")) \
        .withColumn("occ", F.row_number().over(w_o))
    j = o.alias("o").join(n.alias("n"), [*key, "line", "occ"], "full")
    change = F.when(F.col("o.pos").isNull(), F.lit("+")).when(F.col("n.pos").isNull(), F.lit("-"))
    return j.select(*key, "line", change.alias("change")).filter(F.col("change").isNotNull())


def enrichment_cache(requests: DataFrame, answers: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """Reuse the latest earlier answer with the same key, if it is at most ``ttl_s`` old.

    An as-of step: requests and answers are put in one order per key and each request takes the last answer before
    it, so no request meets every answer, and equal requests stay separate rows."""
    extra = [c for c in requests.columns if c not in ("key", "ts")]
    req = requests.select("key", "ts", F.struct(*extra, F.lit(True).alias("_is")).alias("_r"),
                          F.lit(None).cast("string").alias("_body"), F.lit(None).cast("timestamp").alias("_at"))
    ans = answers.select("key", "ts", F.lit(None).cast(req.schema["_r"].dataType).alias("_r"), F.col("body").alias("_body"),
                         F.col("ts").alias("_at"))
    # an answer counts for later requests only: at equal times the request comes first
    w = Window.partitionBy("key").orderBy("ts", F.col("_r").isNull(), "_body").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_r").isNull(), F.struct("_body", "_at")), ignorenulls=True).over(w)
    j = req.unionByName(ans).withColumn("_a", last).filter("_r IS NOT NULL")
    fresh = F.col("ts") <= F.col("_a._at") + F.expr(f"INTERVAL {ttl_s} SECONDS")
    return j.select(*[F.col(c) if c in ("key", "ts") else F.col(f"_r.{c}") for c in requests.columns],
                    F.when(fresh, F.col("_a._body")).alias("cached_body"))


def cache_key(kind: Column, rule: Column, snippet: Column) -> Column:
    return F.md5(F.concat_ws(":", kind, rule, F.coalesce(snippet, F.lit(""))))


def chat_context(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns up to each message as 'ROLE: text' lines."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-(n - 1), 0)
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    return turns.withColumn("context", F.array_join(F.collect_list(line).over(w), "\n"))
