"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule.
Policies are versioned sets of rules: applying one is a mask on the stored bits, and ablations are counts over
the distinct bit patterns, so neither touches a text again.

Defined results: a null or empty text has no words, no lines and measurements of 0.  Repeated doc_ids are separate
rows.  Extra columns are not read; ``keep`` names those to carry.  An empty table gives an empty ledger.
A very long text is one row of words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secscan.llm.common import words


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "capitals", "2 * n_upper > word_chars"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(r.name for r in RULES)))}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def _repeat_words(sorted_keys: str) -> Column:
    """Words covered by a three-word window that occurs at least twice.

    ``_k`` holds one long per window: the high bits of its hash, the low bits (mask ``_m``) its position, sorted.
    Equal neighbours are repeats.  The words themselves are compared too; should two different windows share the
    high bits, the document takes the sort on the words instead.
    """
    hits = (f"filter({sorted_keys}, (x, j) -> coalesce(((x ^ get({sorted_keys}, j - 1)) & ~_m) = 0, false)"
            f" OR coalesce(((x ^ get({sorted_keys}, j + 1)) & ~_m) = 0, false))")
    return F.expr(hits)


_FALSE_HIT = """exists(sequence(1, size(_hits) - 1), j -> (get(_hits, j) ^ get(_hits, j - 1)) & ~_m = 0 AND NOT (
    get(_w, CAST(get(_hits, j) & _m AS INT)) = get(_w, CAST(get(_hits, j - 1) & _m AS INT))
    AND get(_w, CAST(get(_hits, j) & _m AS INT) + 1) = get(_w, CAST(get(_hits, j - 1) & _m AS INT) + 1)
    AND get(_w, CAST(get(_hits, j) & _m AS INT) + 2) = get(_w, CAST(get(_hits, j - 1) & _m AS INT) + 2)))"""

_BY_WORDS = """transform(array(sort_array(transform(sequence(0, size(_w) - 3), i -> named_struct(
      'g', concat_ws(' ', get(_w, i), get(_w, i + 1), get(_w, i + 2)), 'p', CAST(i AS BIGINT))))),
    s -> transform(filter(s, (x, j) -> coalesce(x.g = get(s, j - 1).g, false) OR coalesce(x.g = get(s, j + 1).g, false)),
                   x -> x.p))[0]"""


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep`` and the measurements, from one split of the text."""
    out = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    out = out.withColumn("_w", words(F.col("_t"))).withColumn(
        "_l", F.expr("filter(split(_t, '\\n', -1), l -> l rlike '[^ \\\\t-\\\\r]')"))
    out = out.withColumn("_m", F.expr("shiftleft(1L, length(bin(size(_w)))) - 1L"))
    out = out.withColumn("_k", F.expr(
        "CASE WHEN size(_w) < 4 THEN CAST(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, size(_w) - 3),"
        " i -> (xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) & ~_m) | i)) END"))
    out = out.withColumn("_hits", _repeat_words("_k"))
    out = out.withColumn("_p", F.expr(
        f"CASE WHEN size(_hits) = 0 THEN CAST(array() AS array<bigint>) WHEN {_FALSE_HIT} THEN sort_array({_BY_WORDS})"
        " ELSE sort_array(transform(_hits, x -> x & _m)) END"))
    return out.select(
        *keep,
        F.expr("CAST(size(_w) AS BIGINT)").alias("n_words"),
        F.expr("CAST(length(array_join(_w, '')) AS BIGINT)").alias("word_chars"),
        F.expr("CAST(regexp_count(_t, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(size(_l) AS BIGINT)").alias("n_lines"),
        F.expr("CAST(size(_l) - size(array_distinct(_l)) AS BIGINT)").alias("n_dup_lines"),
        F.expr("aggregate(transform(_p, (x, j) -> least(3L, coalesce(get(_p, j + 1) - x, 3L))), 0L, (a, x) -> a + x)")
        .alias("n_repeat_words"),
        F.expr("CAST(regexp_count(_t, '\\\\p{Lu}') AS BIGINT)").alias("n_upper"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements plus ``fail_bits``: bit ``rule.bit`` is set where the rule fails."""
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measure(docs, keep).withColumn("fail_bits", bits)


def mask_of(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[n] for n in policy.rules)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, rules)).cast("bigint")) == 0


def apply_policy(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return book.withColumn("policy", F.lit(policy.version)).withColumn("kept", passes(policy, rules))


def ablations(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it were left out.

    The ledger is first counted by bit pattern (at most 2^rules rows, combined before the shuffle).
    """
    mask = mask_of(policy, rules)
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("b"))
                       for r in rules if r.name in policy.rules])
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    return patterns.select("bits", "n", F.explode(listed).alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.expr("coalesce(sum(n) FILTER (WHERE bits & r.b != 0), 0)").alias("n_fail"),
        F.expr("coalesce(sum(n) FILTER (WHERE bits = r.b), 0)").alias("n_fail_alone"),
        F.expr("coalesce(sum(n) FILTER (WHERE bits & ~r.b = 0), 0)").alias("n_kept_without"))


def keep_documents(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The documents that pass the policy, all their columns unchanged."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    # a filter would be pushed below the steps of ``measure`` and repeat all of them; a generator is not
    once = F.explode(F.array_repeat(F.lit(1), F.when(passes(policy), 1).otherwise(0)))
    return ledger(packed, keep=("_row",)).select("_row", once.alias("_one")).select("_row.*")
