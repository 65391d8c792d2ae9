"""Mixing sources to target weights by hierarchical budgeting.

A token budget is passed down a tree of domain, language and source.  At each node the children get shares in
proportion to their weights; a child that cannot use its share (its documents times the epochs allowed) is filled
up, and what it leaves goes to its siblings first, to the parent's siblings only when the whole subtree is full.
Each leaf turns its budget into whole epochs plus a prefix, by tokens, of one more epoch in an order seeded by
(seed, epoch, doc_id).

Defined results: null texts have no tokens; null tree columns are a child of their own; weights that are missing
are 1, and 0 or less gives nothing; documents without tokens are taken with every full epoch and in a prefix as long as the running
total before them is below the leaf's remainder.  Repeated doc_ids are ordered by their text's hash and stay separate
rows.  All budgets are integers, rounded down, so at most one token per child is left over.  An empty table gives an
empty mix; a very long text is one row with its tokens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secscan.llm.common import words, written

Weights = Mapping[tuple, int]  # key: the path from the root, e.g. ("web", "en"); value: whole-number weight


def _weight(path: Sequence[str], weights: Weights) -> Column:
    here = [(k, v) for k, v in weights.items() if len(k) == len(path)]
    out = F.lit(1)
    for key, value in here:
        same = F.lit(True)
        for c, v in zip(path, key, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        out = F.when(same, F.lit(max(0, int(value)))).otherwise(out)
    return out.cast("decimal(18,0)")


def _fill(children: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """``budget`` of each child from ``up`` (the parent's), ``cap`` and ``w``.

    In the order of cap / w, a child is filled if the level reached by spreading what is left over it and all later
    children reaches its cap; the first that is not sets the level of the rest.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("_ratio"), F.col(child))
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding,
                                                                                 Window.unboundedFollowing)
    d = children.filter("w > 0").withColumn("_ratio", F.expr("CAST(cap AS DOUBLE) / CAST(w AS DOUBLE)"))
    d = d.withColumn("_left", F.expr("up") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    d = d.withColumn("_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    d = d.withColumn("_open", F.expr("CAST(_left AS DECIMAL(20,0)) * w < CAST(cap AS DECIMAL(20,0)) * _w"))
    first = Window.partitionBy(*parent).orderBy("_ratio", child).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_l", F.first(F.expr("CASE WHEN _open THEN _left END"), ignorenulls=True).over(first))
    d = d.withColumn("_lw", F.first(F.expr("CASE WHEN _open THEN _w END"), ignorenulls=True).over(first))
    return d.withColumn("budget", F.expr(
        "CASE WHEN _l IS NULL THEN cap ELSE least(cap, CAST(CAST(_l AS DECIMAL(20,0)) * w div _lw AS BIGINT)) END")).drop(
        "_ratio", "_left", "_w", "_open", "_l", "_lw", "up", "w")


def budgets(leaves: DataFrame, tree: Sequence[str], total: Column, weights: Weights, epochs: int) -> DataFrame:
    """``leaves`` (tree columns, n_docs, tokens) -> the same with ``budget``.  Small: one row per leaf.

    ``total`` is an expression over ``tokens``, the sum of all leaves' tokens.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    level = None
    for i, name in enumerate(tree):
        path = list(tree[:i + 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        if i == 0:
            whole = nodes.agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
            nodes = nodes.withColumn("up", whole.select(F.least(F.col("cap"), total.cast("bigint"))).scalar())
        else:
            up = level.select(*[F.col(c).alias(f"_{c}") for c in path[:-1]], F.col("budget").alias("up"))
            nodes = nodes.join(up, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path[:-1]]).drop(
                *[f"_{c}" for c in path[:-1]])
        level = _fill(nodes.withColumn("w", _weight(path, weights)), path[:-1], name)
    key = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in tree]
    got = level.select(*[F.col(c).alias(f"_{c}") for c in tree], "budget")
    return leaves.join(got, key, "left").select(*tree, "n_docs", "tokens", F.coalesce("budget", F.lit(0)).alias("budget"))


def mix(docs: DataFrame, tree: Mapping[str, Column], total: Column, weights: Weights, epochs: int = 4, seed: int = 0,
        per_bucket: int = 4096) -> DataFrame:
    """Documents with at least one copy: doc_id, the tree columns, ``n_tokens`` and ``copies``.

    The seeded order is a hash, so its running token count is taken in two steps: each leaf is cut into ranges of the
    hash with about ``per_bucket`` documents, ranges are summed and scanned, and documents are scanned within their
    range only.  A leaf with a third of all documents is thus many small windows.
    """
    names = list(tree)
    n_tokens = F.size(words(F.col("text"))).cast("bigint")
    slim = written(docs.select("doc_id", *[e.alias(c) for c, e in tree.items()], n_tokens.alias("n_tokens"),
                               F.xxhash64("text").alias("_x")), "mix-tokens")
    leaves = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    plan = written(budgets(leaves, names, total, weights, epochs), "mix-budgets")
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in names], "n_docs",
                       F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget div tokens END").alias("_full"),
                       F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END").alias("_rest"))
    leaf = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"),
                              F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    d = slim.join(plan, leaf).drop(*[f"_{c}" for c in names]).withColumn("_o", order)
    d = d.withColumn("_bucket", F.expr(
        f"CAST(conv(substring(_o, 1, 8), 16, 10) AS BIGINT) * ((n_docs div {per_bucket}) + 1) div 4294967296"))
    earlier = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy(*names, "_bucket").agg(F.sum("n_tokens").alias("_n")).select(
        *[F.col(c).alias(f"_{c}") for c in names], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*names, "_bucket").orderBy("_o", "_x").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_here", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    d = d.join(ranges, [*leaf, F.col("_bucket") == F.col("_b")])
    d = d.withColumn("copies", F.expr("CAST(_full + CASE WHEN _before + _here < _rest THEN 1 ELSE 0 END AS BIGINT)"))
    return d.filter("copies > 0").select("doc_id", *names, "n_tokens", "copies")
