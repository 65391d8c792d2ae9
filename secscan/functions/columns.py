"""Column-level helpers (pure expressions, JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from secscan.sources.catalogue import SEVERITIES

# FIXED VALUES: severity rank CRITICAL 5 ... INFO 1.
SEVERITY_RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}

# FIXED VALUES: JavaScript String.prototype.trim whitespace set (for blank-line tests).
JS_SPACE_CLASS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def severity_rank(sev: Column) -> Column:
    expr = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        expr = F.when(sev == name, F.lit(rank)).otherwise(expr)
    return expr.cast("int")


def known_severity(sev: Column, default: str = "MEDIUM") -> Column:
    return F.when(sev.isin(*SEVERITIES), sev).otherwise(F.lit(default))


def grade(score: Column) -> Column:
    return (F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 55, "C")
            .when(score >= 35, "D").otherwise("F"))


def js_round(x: Column) -> Column:
    """Math.round: halves go up (floor(x + 0.5)), unlike Spark's round."""
    return F.floor(x + F.lit(0.5))


def is_blank_js(text: Column) -> Column:
    return text.rlike("^" + JS_SPACE_CLASS + "*$")


def suffix_ext(path: Column) -> Column:
    """Python Path.suffix, lower-cased, without the dot ('' when none)."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def entropy(s: Column) -> Column:
    """Shannon entropy (bits per character) of a string, over code points, from the run lengths of its sorted ones."""
    def done(acc: Column) -> Column:
        return acc["sum"] + F.when(acc["run"] > 0, acc["run"] * F.log2(acc["run"])).otherwise(0.0)

    def step(acc: Column, c: Column) -> Column:
        same = acc["prev"] == c
        return F.struct(c.alias("prev"), F.when(same, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, acc["sum"]).otherwise(done(acc)).alias("sum"))

    start = F.struct(F.lit("").alias("prev"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    n = F.length(s)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n) - F.aggregate(chars, start, step, done) / n)


def is_high_entropy_secret(value: Column) -> Column:
    n = F.length(value)
    least = F.when(n >= 32, 3.2).when(n >= 20, 3.6).otherwise(4.0)
    return (n >= 12) & (entropy(value) > least)


def repo_name(url: Column) -> Column:
    """owner/repo from a URL, else the stripped path."""
    no_scheme = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(no_scheme, r"^([^?#]*)", 1), r"^/+|/+$", "")
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", parts[0], parts[1])).otherwise(path)


def short_path(path: Column) -> Column:
    """Last two parts of a path split on / or \\."""
    parts = F.split(path, r"[/\\]")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, -2, 2))).otherwise(path)


def html_safe(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cwe_link(cwe: Column) -> Column:
    num = F.regexp_extract(F.coalesce(cwe, F.lit("")), r"(\d+)", 1)
    return F.when(num != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), num, F.lit(".html"))) \
        .otherwise(F.lit("https://owasp.org/www-project-top-ten/"))


def clean_version(v: Column) -> Column:
    """Leading ^~>=< and blanks removed, cut at the first blank, then at '||'."""
    stripped = F.regexp_replace(v, r"^[\^~>=<\s]+", "")
    first = F.split(stripped, " ", -1)[0]
    return F.trim(F.split(first, r"\|\|", -1)[0])
