"""Language-model scoring: interpolated modified Kneser-Ney over bigrams.

Counting is done in Spark.  Tasks count the words, then the word pairs, of their texts and send them to hash buckets
in packed form; each bucket is one sorted array in the shared folder, so the model is a set of sorted hash arrays.
Workers map these files into memory, look words and pairs up by bucket and binary search, and score whole texts
without any shuffle.  What is held in memory is the pages in use, not the model.

The model: with c the counts, D the three discounts from the counts of counts, N1, N2, N3+ the followers of u seen
once, twice, more often, and a(w) the number of different words before w,
  p(w | u) = (c(uw) - D(c(uw))) / c(u.) + (D1 N1(u) + D2 N2(u) + D3 N3+(u)) / c(u.) * p(w)
  p(w)     = (a(w) - D'(a(w))) / a(.) + (sum of D') / a(.) / (V + 1)
The first word follows a start mark, and each text ends with an end token that is predicted and counted like a word.
An unseen context leaves p(w); an unseen word has the last term only.

Counts have 64 bits.  Words are numbered with 32: a corpus with more than 4.29e9 different words is an error.

Defined results: null and empty texts are the end token alone; a very long text is a chunk of its own; rows are scored
one by one, repeated ids included; a null id counts as the empty text in the split, so such rows are trained on; without
training texts (an empty table) every token has probability 1; only doc_id and text are read, whatever other columns
are called.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secscan.llm import packed as P
from secscan.llm.common import new_path, written

CHUNK = 8 << 20
#: files a task has open, however many buckets there are
MOST_OPEN = 128
END = P.U(0x5E0FD0C5E0FD0C55)

COUNTS = "bucket int, n int, keys binary, counts binary"
_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SEEN = "kind string, bucket int, n int, a bigint, b bigint, c bigint, d bigint, ids binary, v0 binary, v1 binary, v2 binary, v3 binary"
_SEEN = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), *[(c, pa.int64()) for c in "abcd"],
                   *[(c, pa.binary()) for c in ("ids", "v0", "v1", "v2", "v3")]])


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> P.U(64 - bits)).astype(np.int64)


def send_counts(keys: np.ndarray, bits: int, spread: bool) -> Iterator[pa.RecordBatch]:
    """Distinct keys and how often they occur, by bucket (of the key itself, or of its mixed bits)."""
    keys, counts = np.unique(keys, return_counts=True)
    rows = [(b, len(at), P.planes(keys[at]), P.planes(counts[at].astype(P.U)))
            for b, at in P.split(bucket_of(P.mix(keys.copy()) if spread else keys, bits), 1 << bits)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)],
                                         schema=_COUNTS)


def merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a bucket and their summed counts."""
    parts = list(zip(*[rows[c].to_pylist() for c in ("n", "keys", "counts")], strict=True))
    keys = np.concatenate([P.from_planes(k, n) for n, k, _ in parts])
    counts = np.concatenate([P.from_planes(c, n) for n, _, c in parts])
    order, cut, _ = P.by_key(keys)
    return keys[order][cut], np.add.reduceat(counts[order], cut)


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under its final name in one step: a repeated task replaces it by the same."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/_{name}-{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    store.move(part, f"{root}/{name}")


class Arrays:
    """Arrays of a folder, memory-mapped where it is a local mount and read whole (a bucket's size) where it is not; at
    most ``MOST_OPEN`` are held at a time, those used last."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def get(self, name: str, kind) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        while len(self.open) >= MOST_OPEN:
            self.open.popitem(last=False)
        path = f"{self.root}/{name}"
        if isinstance(self.store, fs.LocalFileSystem):
            there = os.path.exists(path) and os.path.getsize(path)
            found = np.memmap(path, kind, "r") if there else np.zeros(0, kind)
        elif self.store.get_file_info(path).type == fs.FileType.File:
            with self.store.open_input_file(path) as f:
                found = np.frombuffer(f.read(), kind)
        else:
            found = np.zeros(0, kind)
        self.open[name] = found
        return found


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, first token of each row and the end, whether a token is its row's first): words, then the end."""
    w = P.Words.of(P.Texts.of(table["text"]), lower=True)
    ends = w.first[1:]
    h = np.insert(w.hash, ends, END)
    at = w.first + np.arange(len(w.first))
    begin = np.zeros(len(h), bool)
    begin[at[:-1]] = True
    return h, at, begin


@dataclass
class Model:
    """What the driver knows of the files in ``folder``."""

    folder: str
    bits: int
    offsets: np.ndarray  # of each bucket's words among all word numbers
    n_tokens: int
    n_types: int
    slice_size: int
    pair_discounts: list = field(default_factory=list)
    word_discounts: list = field(default_factory=list)
    followed: int = 0  # a(.)
    left: float = 0.0  # the sum of D'(a(w)) over a(.)

    def numbers(self, files: Arrays, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each word hash."""
        out, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for b, at in P.split(bucket_of(h, self.bits), 1 << self.bits):
            known = files.get(f"words-{b}", P.U)
            if len(known):
                i = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                hit = known[i] == h[at]
                out[at[hit]] = self.offsets[b] + i[hit]
                counts[at[hit]] = files.get(f"word-counts-{b}", P.U)[i[hit]]
        return out, counts

    def pairs(self, files: Arrays, keys: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(keys), np.int64)
        for b, at in P.split(bucket_of(P.mix(keys.copy()), self.bits), 1 << self.bits):
            known = files.get(f"pairs-{b}", P.U)
            if len(known):
                i = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                hit = known[i] == keys[at]
                counts[at[hit]] = files.get(f"pair-counts-{b}", P.U)[i[hit]]
        return counts

    def facts(self, files: Arrays, numbers: np.ndarray, name: str, kind) -> np.ndarray:
        """Values kept by word number; 0 for -1."""
        out = np.zeros(len(numbers), kind)
        have = np.flatnonzero(numbers >= 0)
        for s, at in P.split(numbers[have] // self.slice_size, (self.n_types + 1) // self.slice_size + 1):
            out[have[at]] = files.get(f"{name}-{s}", kind)[numbers[have[at]] - s * self.slice_size]
        return out

    def contexts(self, numbers: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The number before each token; the start mark is the number after the last word."""
        before = np.empty_like(numbers)
        before[1:] = numbers[:-1]
        before[begin] = self.n_types
        return before


def pair_keys(before: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (before.astype(P.U) << P.U(32)) | numbers.astype(P.U)


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3 from the numbers of things counted 1, 2, 3 and 4 times; fixed ones where a number is 0."""
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return counts - np.take(np.array([0.0, *d]), np.minimum(counts, 3).astype(np.int64))


def training(docs: DataFrame) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2


def _seen(kind: str, bucket: int, totals=(0, 0, 0, 0), ids=None, values=()) -> dict:
    row = {"kind": kind, "bucket": bucket, "n": 0 if ids is None else len(ids), **dict(zip("abcd", map(int, totals), strict=True)),
           "ids": None if ids is None else P.planes(ids.astype(P.U)), "v0": None, "v1": None, "v2": None, "v3": None}
    return row | {f"v{i}": P.planes(v.astype(P.U)) for i, v in enumerate(values)}


def learn(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` and write the model to the shared folder."""
    spark, bits = docs.sparkSession, P.bits_for(docs)
    folder = new_path(spark, "kneser-ney")
    texts = docs.select("text")

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in P.chunks(batches, "text", CHUNK):
            yield from send_counts(tokens(table)[0], bits, spread=False)

    def keep_words(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        keys, counts = merged(rows)
        save(folder, f"words-{bucket}", keys)
        save(folder, f"word-counts-{bucket}", counts)
        return pa.Table.from_pylist([_seen("words", bucket, (len(keys), counts.sum(), 0, 0))], schema=_SEEN)

    words = texts.mapInArrow(send_words, COUNTS).groupBy("bucket").applyInArrow(keep_words, SEEN)
    found = written(words.select("bucket", "a", "b"), "word-buckets").collect()  # one row per bucket
    sizes = np.zeros(1 << bits, np.int64)
    sizes[[r.bucket for r in found]] = [r.a for r in found]
    types = int(sizes.sum())
    if types >= 1 << 32:
        raise ValueError("word numbers must fit 32 bits")
    model = Model(folder, bits, np.cumsum(sizes) - sizes, sum(r.b for r in found), types, max(1, types >> bits))

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Arrays(folder)
        for table in P.chunks(batches, "text", CHUNK):
            h, _, begin = tokens(table)
            numbers, _ = model.numbers(files, h)
            yield from send_counts(pair_keys(model.contexts(numbers, begin), numbers), bits, spread=True)

    def keep_pairs(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        keys, counts = merged(rows)
        save(folder, f"pairs-{bucket}", keys)
        save(folder, f"pair-counts-{bucket}", counts)
        u, w = (keys >> P.U(32)).astype(np.int64), (keys & P.U(0xFFFFFFFF)).astype(np.int64)
        out = [_seen("pair-counts", bucket, [np.count_nonzero(counts == P.U(k)) for k in (1, 2, 3, 4)])]
        cut = np.flatnonzero(np.diff(u, prepend=-1))
        per = [np.add.reduceat(x.astype(np.int64), cut) for x in (
            counts, counts == P.U(1), counts == P.U(2), counts > P.U(2))] if len(cut) else []
        ids, before = np.unique(w, return_counts=True)
        for kind, which, values in (("context", u[cut], per), ("word", ids, [before])):
            for s, at in P.split(which // model.slice_size, types // model.slice_size + 1):
                out.append(_seen(kind, s, ids=which[at], values=[v[at] for v in values]))
        return pa.Table.from_pylist(out, schema=_SEEN)

    pairs = written(texts.mapInArrow(send_pairs, COUNTS).groupBy("bucket").applyInArrow(keep_pairs, SEEN), "pair-facts")

    def keep_facts(rows: pa.Table) -> pa.Table:
        s = rows["bucket"][0].as_py()
        n = min(model.slice_size, types + 1 - s * model.slice_size)
        facts = {name: np.zeros(n, np.int64) for name in ("total", "one", "two", "more", "before")}
        for r in rows.to_pylist():
            at = (P.from_planes(r["ids"], r["n"]) - P.U(s * model.slice_size)).astype(np.int64)
            names = ("total", "one", "two", "more") if r["kind"] == "context" else ("before",)
            for i, name in enumerate(names):
                facts[name][at] += P.from_planes(r[f"v{i}"], r["n"]).astype(np.int64)  # ids are distinct within a row
        for name, values in facts.items():
            save(folder, f"{name}-{s}", values)
        b = facts["before"]
        return pa.Table.from_pylist([_seen("before-counts", s, [np.count_nonzero(b == k) for k in (1, 2, 3, 4)]),
                                     _seen("before-total", s, (b.sum(), np.count_nonzero(b > 2), 0, 0))], schema=_SEEN)

    facts = pairs.filter("kind IN ('context', 'word')").groupBy("bucket").applyInArrow(keep_facts, SEEN)
    sums = {r.kind: [r.a, r.b, r.c, r.d] for r in written(facts, "word-facts").union(pairs.filter("kind = 'pair-counts'")).groupBy(
        "kind").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()}
    model.pair_discounts = discounts(sums.get("pair-counts", [0] * 4))
    once = sums.get("before-counts", [0] * 4)
    model.word_discounts = discounts(once)
    model.followed, many = sums.get("before-total", [0] * 4)[:2]
    d = model.word_discounts
    model.left = (d[0] * once[0] + d[1] * once[1] + d[2] * many) / model.followed if model.followed else 1.0
    return model


def score_tokens(model: Model, files: Arrays, h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, log10 probability) of each token."""
    numbers, counts = model.numbers(files, h)
    word = np.full(len(h), model.left / (model.n_types + 1))
    if model.followed:
        before = model.facts(files, numbers, "before", np.int64)
        word += discounted(before, model.word_discounts) * (before > 0) / model.followed
    if not model.n_tokens:
        return counts, np.log10(word)
    u = model.contexts(numbers, begin)
    both = (u >= 0) & (numbers >= 0)
    c = np.zeros(len(h), np.int64)
    c[both] = model.pairs(files, pair_keys(u[both], numbers[both]))
    total = model.facts(files, u, "total", np.int64)
    rest = sum(d * model.facts(files, u, name, np.int64) for d, name in zip(model.pair_discounts, ("one", "two", "more"), strict=True))
    known = total > 0
    p = word.copy()
    p[known] = (discounted(c[known], model.pair_discounts) * (c[known] > 0) + rest[known] * word[known]) / total[known]
    return counts, np.log10(p)


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Arrays(model.folder)
        for table in P.chunks(batches, "text", CHUNK):
            h, at, begin = tokens(table)
            counts, logs = score_tokens(model, files, h, begin)
            base = np.log10((counts + 1) / (model.n_tokens + model.n_types + 1))
            per = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every row has its end token
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks().cast(pa.int64()), table["held_out"].combine_chunks(),
                pa.array(np.diff(at), pa.int64()), pa.array(per((counts > 0).astype(np.int64))),
                pa.array(np.full(len(table), model.n_tokens)), pa.array(per(base)), pa.array(per(logs))], schema=schema)

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per held-out flag, of the model and of the add-one base."""
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learn from the training rows of ``docs`` and score all of them."""
    train = training(docs)
    return score(docs, learn(docs.filter(train)), ~train)
