"""MinHash near-dedup with BagMinHash signatures of word shingles.

A document is the multiset of its five-word shingles.  Every unit of weight of every shingle has a Poisson process of
points (time, signature slot); a slot keeps the earliest point below the shingle's weight, so two slots agree with the
weighted Jaccard similarity as probability, without bias.  The units are not walked one by one: weights are cut into
levels [0,1), [1,2), [2,4), [4,8), ... whose processes have the level's width as rate, and a point draws its unit
within its level.  Points come in order of time, so a level is left as soon as it is later than the worst slot; after
the first points few levels are still running.

Signatures are cut into bands.  Documents that share a band are candidates, and links are made only where the exact
multiset overlap (sum of smaller over sum of larger counts) reaches the threshold.  Classes are the connected
components of the links.  Every pair of documents that shares a band is in one class or known to be below the
threshold, but bands are never expanded into pairs:

1. each band's documents are compared with one of them, its centre; most bands then hold a single component;
2. the others are gathered around the centres of their largest components, and compared with these;
3. there a document x is its difference D to the centre (what it has more and what it lacks), and for a threshold t
   with r = (1 - t) / (1 + t) two documents reach it exactly if |Dx| + |Dy| - 2 |Dx & Dy| <= r (nx + ny).  With
   s = |D| - r n this is sx + sy <= 2 |Dx & Dy|.  Documents with sx + sy <= 0 are linked without another look, through
   the document with the least s.  All others must share elements of their differences: they meet on single elements,
   rare ones first, elements that only one component has left out, and only where the places of the element in
   both differences leave room for enough common ones.  What meets is compared exactly.

Exact copies (same word sequence) are one document from the start.

Defined results: fewer than five words are one shingle; a text without words, null or empty, is a class of its own;
documents without doc_id are returned with a null class; rows with the same doc_id but other words are documents of
their own, rows with the same doc_id and the same words are in one class; very long texts are bags like any other, a
pair of them must fit a task's memory; an empty table gives no rows; only doc_id and text are read, so other columns
may have any name, and ``keep_documents`` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secscan.llm import packed as P
from secscan.llm.common import discard, perhaps, small_batches, words, written
from secscan.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: P(a pair at 0.8 shares no band) = (1 - 0.8^8)^64 = 8e-6; at 0.4, 4 % of the pairs are candidates
BANDS, ROWS = 64, 8
CHUNK = 4 << 20
#: steps of s, as parts of r n, by which documents are told whom they can still meet; and the last step
STEPS, LAST_STEP = 4, 48
CHUNK_ROWS = 8192


def shingles(table: pa.Table, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a row with fewer words than ``size`` has one of all its words."""
    w = P.Words.of(P.Texts.of(table["text"]))
    _, row, h = w.windows(size)
    rows, hashes = [row], [h]
    count = np.diff(w.first)
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            rows.append(short)
            hashes.append(P.rolling(w.hash, k)[w.first[short]])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    return row[order], h[order]


def levels(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weight levels of each distinct (row, shingle): row, seed, first unit, width, weight."""
    new = (np.diff(row, prepend=-1) != 0) | (np.diff(h, prepend=P.U(0)) != 0)
    at = np.flatnonzero(new)
    weight = np.diff(at, append=len(row))
    seed = P.mix(h[at] + P._SEED)
    parts = [(row[at], seed, np.zeros(len(at), np.int64), np.ones(len(at), np.int64), weight)]
    base = 1
    while len(more := np.flatnonzero(weight > base)):
        parts.append((row[at][more], P.mix(seed[more] + P.times(base)), np.full(len(more), base),
                      np.full(len(more), base), weight[more]))
        base *= 2
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(n: int, row: np.ndarray, h: np.ndarray, slots: int) -> np.ndarray:
    """n x slots times; rows without shingles stay at infinity."""
    sig = np.full((n, slots), np.inf)
    flat = sig.reshape(-1)
    row, seed, first, width, weight = levels(row, h)
    order = np.argsort(row, kind="stable")
    row, seed, first, width, weight = (x[order] for x in (row, seed, first, width, weight))
    time = np.zeros(len(row))
    worst = np.full(n, np.inf)
    for k in range(1, 1 << 30):
        if not len(row):
            return sig
        draw = P.mix(seed + P.times(2 * k))
        time = time - np.log(((draw >> P.U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        other = P.mix(draw + P.U(1))
        slot = ((other >> P.U(32)) * P.U(slots) >> P.U(32)).astype(np.int64)
        unit = first + (((other & P.U(0xFFFFFFFF)) * width.astype(P.U)) >> P.U(32)).astype(np.int64)
        hit = (unit < weight) & (time < worst[row])
        np.minimum.at(flat, row[hit] * slots + slot[hit], time[hit])
        changed = row[hit]
        changed = changed[np.flatnonzero(np.diff(changed, prepend=-1))]
        worst[changed] = sig[changed].max(axis=1)
        on = time < worst[row]
        if not on.all():
            row, seed, first, width, weight, time = (x[on] for x in (row, seed, first, width, weight, time))
    raise AssertionError("signature did not end")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for table in P.chunks(batches, "text", CHUNK):
        for at in range(0, len(table), CHUNK_ROWS):
            yield table.slice(at, CHUNK_ROWS)


def band_keys(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(key, node, n): a row per document (node, text) and band; n is the document's number of shingles."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            ids = table["node"].combine_chunks().to_numpy(zero_copy_only=False)
            row, h = shingles(table, size)
            n = np.bincount(row, minlength=len(ids))
            have = np.flatnonzero(n)
            bits = signatures(len(ids), row, h, bands * rows)[have].view(P.U).reshape(len(have), bands, rows)
            key = np.broadcast_to(P.mix(np.arange(bands, dtype=P.U) + P._SEED), (len(have), bands)).copy()
            for j in range(rows):
                key = P.mix(key * P._ROLL + bits[:, :, j])
            yield pa.RecordBatch.from_arrays([
                pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[have], bands)),
                pa.array(np.repeat(n[have].astype(np.int32), bands))], names=["key", "node", "n"])

    return docs.select("node", "text").mapInArrow(sign, "key bigint, node bigint, n int")


def bags(docs: DataFrame, size: int) -> DataFrame:
    """(node, bag): the sorted shingle hashes, repeats included."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            ids = table["node"].combine_chunks()
            row, h = shingles(table, size)
            at = np.searchsorted(row, np.arange(len(ids) + 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(
                [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "bag"])

    return docs.select("node", "text").mapInArrow(send, "node bigint, bag binary")


def texts_of(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, text) of the distinct ``candidates`` (node): few of the documents, so that the other texts are not exchanged.

    An inner join, as Spark would put a semi join below the bitmap, and so exchange every text."""
    return perhaps(docs.select("node", "text"), "node", candidates).join(candidates, "node").select("node", "text")


def common(x: bytes, y: bytes) -> int:
    """Size of the multiset intersection of two sorted arrays of hashes."""
    both = np.concatenate([np.frombuffer(x, P.U), np.frombuffer(y, P.U)])
    n = len(x) // 8
    order = np.argsort(both, kind="stable")
    cut = np.flatnonzero(np.diff(both[order], prepend=~both[order[:1]]))
    mine = np.add.reduceat((order < n).astype(np.int64), cut)
    yours = np.diff(cut, append=len(both)) - mine
    return int(np.minimum(mine, yours).sum())


def overlap(x: bytes, y: bytes) -> float:
    """Multiset Jaccard similarity of two sorted arrays of hashes."""
    c = common(x, y)
    return c / (len(x) // 8 + len(y) // 8 - c)


def _numbered(a: np.ndarray) -> np.ndarray:
    """Hash of (element, how often it came before) for every entry of a sorted array: a multiset as a set."""
    cut = np.flatnonzero(np.diff(a, prepend=~a[:1]))
    nth = np.arange(len(a)) - np.repeat(cut, np.diff(cut, append=len(a)))
    return P.mix(a + nth.astype(P.U) * P._ROLL)


def difference(x: bytes, c: bytes) -> np.ndarray:
    """The elements that x has more than c, and (told apart by a bit) those it lacks."""
    mine, theirs = _numbered(np.frombuffer(x, P.U)), _numbered(np.frombuffer(c, P.U))
    one = P.U(1)
    return np.concatenate([np.setdiff1d(mine, theirs) | one, np.setdiff1d(theirs, mine) & ~one]).view(np.int64)


@F.pandas_udf(T.LongType())
def _common(x: pd.Series, y: pd.Series) -> pd.Series:
    P.give_back()
    return pd.Series([common(a, b) for a, b in zip(x, y, strict=True)], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _difference(x: pd.Series, y: pd.Series) -> pd.Series:
    P.give_back()
    return pd.Series([difference(a, b) for a, b in zip(x, y, strict=True)])


def with_bags(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the bags of the documents in columns a and b as _x and _y; other bags are not exchanged where the
    pairs are few."""
    need = pairs.select(F.col(a).alias("_need")).union(pairs.select(b)).distinct()
    sets = sets.join(need, F.col("node") == F.col("_need"), "left_semi")
    x = sets.select(F.col("node").alias("_a"), F.col("bag").alias("_x"))
    y = sets.select(F.col("node").alias("_b"), F.col("bag").alias("_y"))
    return pairs.join(y, F.col(b) == F.col("_b")).join(x, F.col(a) == F.col("_a")).drop("_a", "_b")


def measured(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, node, n, n_c) with d, the size of the difference between node and c."""
    c = _common("_x", "_y")
    with small_batches(groups.sparkSession, 256):
        return written(with_bags(groups, sets, "node", "c").select("c", "node", "n", "n_c", (F.col("n") + F.col("n_c") - 2 * c).alias("d")), "compared")


def remeasured(groups: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """``measured``, but for the pairs that ``known`` has already, and the centres themselves."""
    done = known.select(F.col("c").alias("_c"), F.col("node").alias("_n"), "d")
    rows = written(groups.join(done, (F.col("c") == F.col("_c")) & (F.col("node") == F.col("_n")), "left").select(
        "c", "node", "n", "n_c", F.when(F.col("c") == F.col("node"), 0).otherwise(F.col("d")).alias("d")), "groups-known")
    new = measured(rows.filter("d IS NULL").drop("d"), sets)
    return written(rows.filter("d IS NOT NULL").union(new.select(*rows.columns)), "compared")


def _linked(ratio: float) -> Column:
    """Whether a document reaches the threshold with its centre; a little slack for the ratio's last bits."""
    return F.col("d") <= ratio * (F.col("n") + F.col("n_c")) + 1e-9


def _label(rows: DataFrame, comp: DataFrame | None, node: str, label: str) -> DataFrame:
    """``rows`` with the component of column ``node`` as column ``label``: the node itself if it has no links."""
    if comp is None:
        return rows.withColumn(label, F.col(node))
    by = comp.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return rows.join(by, F.col(node) == F.col("_n"), "left").withColumn(label, F.coalesce("_l", node)).drop("_n", "_l")


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, label) after more ``links`` (a, b) between nodes."""
    if comp is None:
        return components(links)
    ends = _label(_label(links, comp, "a", "la"), comp, "b", "lb").filter("la != lb")
    new = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    moved = new.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    kept = comp.join(moved, comp.label == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    return written(kept.union(new.join(comp, "node", "left_anti")), "classes")


def open_groups(groups: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows of those groups (c) that hold several components besides the centre, with the row's component and the
    group's largest one, ``big``."""
    rows = _label(groups, comp, "node", "comp")
    size = rows.filter("node != c").groupBy("c", "comp").agg(F.count(F.lit(1)).alias("_k")).groupBy("c").agg(
        F.max_by("comp", F.struct("_k", "comp")).alias("big"), F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    return written(rows.join(size.select("c", "big"), "c"), "open-groups")


def regrouped(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Open groups joined to one group for each largest component, around its centre with the most documents."""
    size = rows.groupBy("c").agg(F.count(F.lit(1)).alias("_k"), F.first("n_c").alias("n_c"))
    own = _label(size, comp, "c", "big").groupBy("big").agg(F.max_by(F.struct("c", "n_c"), F.struct("_k", "c")).alias("_z"))
    other = rows.filter("comp = big").groupBy("big").agg(F.min_by(F.struct(F.col("node").alias("c"), F.col("n").alias("n_c")), F.xxhash64("node")).alias("_o"))
    centre = rows.select("big").distinct().join(own, "big", "left").join(other, "big", "left").select("big", F.coalesce("_z", "_o").alias("_z"))
    centre = written(centre.select("big", F.col("_z.c").alias("_c"), F.col("_z.n_c").alias("_nc")), "centres")
    out = rows.select("big", "node", "n").join(centre, "big").select(F.col("_c").alias("c"), "node", "n", F.col("_nc").alias("n_c")).union(
        centre.select("_c", F.col("_c"), "_nc", "_nc"))
    return written(out.distinct(), "groups")


def meeting(rows: DataFrame, sets: DataFrame, ratio: float) -> DataFrame:
    """(a, b): pairs of documents of different components of a group that their differences do not rule out.

    ``rows``: open groups (c, node, n, n_c, d, comp, big).
    """
    s = F.col("d") - ratio * F.col("n")
    rows = rows.withColumn("s", s).withColumn("reach", F.col("d") + ratio * F.col("n"))
    low = rows.groupBy("c").agg(F.min("s").alias("low"))
    with small_batches(rows.sparkSession, 256):
        elements = with_bags(rows.filter("node != c"), sets, "node", "c").withColumn("_e", _difference("_x", "_y")).drop("_x", "_y")
        elements = written(elements.select("c", "node", "n_c", "d", "comp", "big", "s", "reach", F.explode("_e").alias("e")), "differences")
    shared = elements.groupBy("c", "e").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi")
    shared = written(shared.select("c", "e", "df"), "shared-elements")
    # the others come first in the order of elements: nobody of another component has them
    per = elements.join(shared, ["c", "e"])
    own = Window.partitionBy("c", "node")
    per = per.withColumn("_at", F.row_number().over(own.orderBy("df", "e"))).withColumn("_n", F.count(F.lit(1)).over(own))
    place = F.col("d") - F.col("_n") + F.col("_at") - 1
    per = per.withColumn("most", F.col("reach") - 2 * place).join(low, "c").filter("most >= low")
    step = lambda v: F.least(F.floor(v * STEPS / (ratio * F.col("n_c"))), F.lit(LAST_STEP)).cast("int")
    per = per.select("c", "node", "comp", "big", "s", "most", "e", step(F.col("s")).alias("own"), F.explode(
        F.sequence(step(F.col("low")), F.greatest(step(F.col("low")), step(F.col("most"))))).alias("other"))
    per = written(per, "meetings")
    x = per.filter("comp != big").alias("x")
    pair = x.join(per.alias("y"), F.expr("x.c = y.c AND x.e = y.e AND x.own = y.other AND x.other = y.own AND x.comp != y.comp "
                                         "AND y.s <= x.most AND x.s <= y.most AND x.s + y.s > 0"))
    out = written(pair.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    discard(elements, shared, per)
    return out


def near_classes(docs: DataFrame, copies: DataFrame, threshold: float, size: int, bands: int, rows: int) -> DataFrame:
    """(node, label) of the documents (node, text), without the nodes in ``copies``, that are in a class of several."""
    spark, ratio = docs.sparkSession, (1 - threshold) / (1 + threshold)
    with small_batches(spark, 2048):
        keys = written(band_keys(docs, bands, rows, size).join(copies.select("node"), "node", "left_anti"), "bands")
    # most keys are of one document: they go first, by two running bounds per key
    many = written(keys.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).filter("_lo < _hi").select("key"), "shared-bands")
    live = written(perhaps(keys, "key", many).join(many, "key"), "open-bands")
    discard(keys, many)
    centre = live.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("c"), F.col("n").alias("n_c")), F.xxhash64("node")).alias("_z"))
    groups = written(live.join(centre.select("key", "_z.c", "_z.n_c"), "key").select("c", "node", "n", "n_c").distinct(), "groups")
    discard(live)
    ends = written(groups.select("node").distinct(), "candidates")
    with small_batches(spark, 2048):
        sets = written(bags(texts_of(docs, ends), size).join(copies.select("node"), "node", "left_anti"), "bags")
    discard(ends)
    first = measured(groups.filter("node != c"), sets)
    comp = merged(None, first.filter(_linked(ratio)).select(F.col("c").alias("a"), F.col("node").alias("b")))
    left = open_groups(groups, comp)
    discard(groups)
    every, ends = sets, left.select("node").union(left.select("c")).distinct()
    sets = written(every.join(ends, "node", "left_semi"), "open-bags")
    discard(every)
    around = remeasured(regrouped(left, comp), first, sets)
    discard(first)
    comp = merged(comp, around.filter(_linked(ratio)).filter("node != c").select(F.col("c").alias("a"), F.col("node").alias("b")))
    s = F.col("d") - ratio * F.col("n")
    least = around.groupBy("c").agg(F.min_by(F.struct("node", s.alias("s")), F.struct(s, "node")).alias("_m"))
    sure = around.join(least, "c").filter((s + F.col("_m.s") <= 1e-9) & (F.col("node") != F.col("_m.node")))
    comp = merged(comp, sure.select(F.col("_m.node").alias("a"), F.col("node").alias("b")))
    rest = open_groups(around, comp)
    discard(left, around)
    pairs = meeting(rest, sets, ratio)
    c = _common("_x", "_y")
    total = (F.length("_x") + F.length("_y")) / 8
    with small_batches(spark, 256):
        links = written(with_bags(pairs, sets, "a", "b").filter(c >= threshold * (total - c) - 1e-9).select("a", "b"), "links")
    comp = merged(comp, links)
    discard(rest, pairs, links, sets)
    return comp


def digest(text: Column) -> Column:
    """Digest of the words; empty for a text without."""
    w = words(text)
    return F.when(F.size(w) > 0, F.md5(F.array_join(w, " ").cast("binary"))).otherwise(F.lit(""))


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, node) per row with an id: its digest and the document it is.  A node is its doc_id; where one
    doc_id has several texts, each of them has a number below all doc_ids."""
    ids = written(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("kind")), "word-digests")
    several = ids.groupBy("doc_id").agg(F.min("kind").alias("_a"), F.max("kind").alias("_b")).filter("_a < _b").select("doc_id")
    odd = ids.join(several, "doc_id", "left_semi").distinct()
    odd = written(odd.select(F.col("doc_id").alias("_d"), F.col("kind").alias("_k"), F.monotonically_increasing_id().alias("_i")), "repeated-ids")
    low = F.lit(ids.agg(F.min("doc_id")).first()[0]).cast("bigint")
    return written(ids.join(odd, (F.col("doc_id") == F.col("_d")) & (F.col("kind") == F.col("_k")), "left").select(
        "doc_id", "kind", F.coalesce(low - 1 - F.col("_i"), "doc_id").alias("node")), "nodes")


def judged(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, kind, node, label, class_id) per row with an id: its document, the class (by its least node and by its
    smallest doc_id)."""
    ids = nodes(docs)
    known = ids.filter("kind != ''")
    first = known.groupBy("kind").agg(F.min("node").alias("rep"), F.max("node").alias("_last")).filter("rep < _last")
    copies = written(known.join(first, "kind").filter("node > rep").select("node", "rep").distinct(), "copies")
    odd = written(ids.filter("node < doc_id").select(F.col("doc_id").alias("_d"), F.col("kind").alias("_k"), F.col("node").alias("_node")).distinct(), "odd-nodes")
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if not odd.isEmpty():
        texts = texts.withColumn("kind", digest(F.col("text"))).join(odd, (F.col("doc_id") == F.col("_d")) & (F.col("kind") == F.col("_k")), "left").select(
            F.coalesce("_node", "doc_id").alias("doc_id"), "text")
    near = near_classes(texts.withColumnRenamed("doc_id", "node"), copies, threshold, size, bands, rows)
    every = ids.join(copies.select(F.col("node").alias("_c"), "rep"), F.col("node") == F.col("_c"), "left").select(
        "doc_id", "kind", "node", F.coalesce("rep", "node").alias("rep"))
    every = _label(every, near, "rep", "label").withColumn("class_id", F.col("label"))
    if not odd.isEmpty():
        name = written(every.groupBy("label").agg(F.min("doc_id").alias("class_id")).filter("class_id != label"), "class-names")
        every = every.drop("class_id").join(name, "label", "left").withColumn("class_id", F.coalesce("class_id", "label"))
    return written(every.select("doc_id", "kind", "node", "label", "class_id"), "judged")


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class)."""
    return judged(docs, threshold, size, bands, rows).select("doc_id", "class_id").union(
        docs.filter("doc_id IS NULL").select(F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))


def keep_documents(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest doc_id (of its texts the least digest); all columns unchanged.

    Rows that share doc_id and words are one document, of which one row stays; rows without doc_id all stay."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    every = judged(docs)
    if every.filter("node < doc_id").isEmpty():
        gone = every.filter("doc_id != class_id").select(F.col("doc_id").alias("_d")).distinct()
        on = F.col("doc_id") == F.col("_d")
    else:
        head = every.groupBy("label").agg(F.min(F.struct("doc_id", "kind")).alias("_h"))
        gone = every.join(head, "label").filter(F.struct("doc_id", "kind") != F.col("_h")).select(F.col("doc_id").alias("_d"), F.col("kind").alias("_k")).distinct()
        on = (F.col("doc_id") == F.col("_d")) & (digest(F.col("text")) == F.col("_k"))
    out = docs.join(written(gone, "near-copies"), on, "left_anti").select(*cols)
    twice = written(every.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(
        F.col("doc_id").alias("_d"), F.col("kind").alias("_k")), "repeated-rows")
    if twice.isEmpty():
        return out
    on = (F.col("doc_id") == F.col("_d")) & (digest(F.col("text")) == F.col("_k"))
    again = out.join(twice, on, "left_semi").withColumn("_digest", digest(F.col("text"))).dropDuplicates(["doc_id", "_digest"])
    return out.join(twice, on, "left_anti").select(*cols).union(again.select(*cols))
