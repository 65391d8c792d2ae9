"""Substring dedup with fixed-block anchors.

Every document is a reference, cut into non-overlapping blocks of ``block`` words, and a probe, with every rolling
window of ``block`` words.  With 2 * block - 1 <= window, any repeat of ``window`` words holds a whole reference
block.  Blocks and probes meet in hash buckets; a probe hits if a document with a smaller id has the block.  Hits,
and the blocks hit, are then extended: only windows of ``window`` words around them are exchanged, the smallest
document of each is found, and in all later ones the windows that overlap make up the maximal repeats to remove.

Exact copies need no search: all of a copy's windows are in the copy with the smallest id.

Windows are compared by 64 bits of hash (a block hit by 40 bits and its bucket, which only selects candidates).

Defined results: null and empty texts have no words; rows without doc_id keep all words and remove none elsewhere;
rows with the same doc_id do not remove from each other, as neither id is smaller; texts shorter than a window stay.
Extra columns are carried along; one with the name of a result column is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from secscan.llm import packed as P
from secscan.llm.common import small_batches, written

WINDOW, BLOCK = 13, 7
KEY_BYTES = 5
CHUNK = 8 << 20
#: bytes of text that are hashed at a time
SLICE = 1 << 20

NOTES = "grp int, kind int, n int, docs binary, runs binary, keys binary"
_NOTES = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()),
                    ("runs", pa.binary()), ("keys", pa.binary())])
HIT, COPY, LATER = 0, 1, 2


def notes(kind: int, docs: np.ndarray, keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Answers to groups of documents: (doc, key) entries."""
    rows: list[tuple] = []
    for g, at in P.split(P.group_of(docs, bits).astype(np.int64), 1 << bits):
        d, r = P.runs(docs[at])
        rows.append((g, kind, len(at), P.planes(d), P.planes(r), P.planes(keys[at])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NOTES, strict=True)],
                                         schema=_NOTES)


def read_notes(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rows = table.filter(pc.equal(table["kind"], kind))
    docs, keys, _, _ = P.unpack(rows.append_column("flags", pa.array([b""] * len(rows), pa.binary())))
    return docs, keys


def copies(docs: DataFrame, bits: int) -> DataFrame:
    """Notes (doc, start of the text's digest) of the texts that a smaller doc_id has too (by a 128-bit digest)."""
    ids = written(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.md5("text").alias("_m")), "texts")
    first = ids.groupBy("_m").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    later = ids.join(first, "_m").filter("doc_id > _first").select("doc_id", "_m")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, _ = P.ids_of(b)
            yield from notes(COPY, d, np.array([int(m[:16], 16) for m in b.column("_m").to_pylist()], P.U), bits)

    return later.mapInArrow(send, NOTES)


def are_copies(ids: np.ndarray, there: np.ndarray, texts: P.Texts, answers: pa.Table) -> np.ndarray:
    """Which rows are noted as copies: by id and text, as a doc_id may have several texts."""
    docs, keys = read_notes(answers, COPY)
    out = np.isin(ids, docs) & there
    noted = set(zip(docs.tolist(), keys.tolist(), strict=True))
    for i in np.flatnonzero(out):
        text = texts.buf[texts.at[i]:texts.at[i + 1]].tobytes()
        out[i] = (int(ids[i]), int(hashlib.md5(text).hexdigest()[:16], 16)) in noted
    return out


def probes(table: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of ``block`` words in rows with a doc_id: the document, the hash, and whether it is a reference block."""
    ids, there = P.ids_of(table)
    w = P.Words.of(P.Texts.of(table["text"]))
    word, row, h = w.windows(block)
    ok = there[row]
    fixed = (word - w.first[row]) % block == 0
    return ids[row[ok]], h[ok], fixed[ok]


def block_hits(docs: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """Notes (doc, block hash) of probes that hit a smaller document's block, and of blocks hit from a larger one."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in P.chunks(batches, "text", CHUNK):
            # hashing takes many times the text: it goes by slices, of which only the entries are kept
            parts = [probes(piece, block) for piece in P.chunks(table.to_batches(), "text", SLICE)]
            yield from P.pack(*(np.concatenate(x) for x in zip(*(p[:2] for p in parts), strict=True)), bits, KEY_BYTES,
                              np.concatenate([p[2] for p in parts]))

    def meet(rows: pa.Table) -> pa.Table:
        P.give_back()
        doc, key, fixed, _ = P.unpack(rows)
        order, cut, run = P.by_key(key)
        d, f = doc[order], fixed[order]
        top = np.iinfo(np.int64).max
        smallest = np.minimum.reduceat(np.where(f, d, top), cut) if len(cut) else d
        largest = np.maximum.reduceat(d, cut) if len(cut) else d
        hit = (d > smallest[run]) | (f & (d < largest[run]))
        at = np.sort(order[hit])
        bucket = P.U(rows["bucket"][0].as_py()) << P.U(8 * KEY_BYTES)
        got = list(notes(HIT, doc[at], key[at] | bucket, bits))
        return pa.Table.from_batches(got, schema=_NOTES)

    return docs.select("doc_id", "text").mapInArrow(send, P.ENTRIES).groupBy("bucket").applyInArrow(meet, NOTES)


def _has_note(docs: np.ndarray, keys: np.ndarray, table: pa.Table, kind: int) -> np.ndarray:
    """Which (doc, key) are noted; two hashed together may in principle collide, which only adds a candidate."""
    d, k = read_notes(table, kind)
    joint = lambda a, b: P.mix(a.view(P.U) * P._ROLL + P.mix(b + P._SEED))
    return np.isin(joint(docs, keys), joint(d, k))


def candidates(table: pa.Table, answers: pa.Table, bits: int, window: int, block: int):
    """Of a group's documents: (words, rows that are copies, first word, row and hash of windows that hold a hit)."""
    ids, there = P.ids_of(table)
    texts = P.Texts.of(table["text"])
    w = P.Words.of(texts)
    copy = are_copies(ids, there, texts, answers)
    word, row, h = w.windows(block)
    seen = np.zeros(len(w.hash) + 1, np.int64)
    hit = _has_note(ids[row], h >> P.U(64 - bits - 8 * KEY_BYTES), answers, HIT) & there[row] & ~copy[row]
    seen[word[hit] + 1] = 1
    seen = np.cumsum(seen)
    word, row, h = w.windows(window)
    ok = (seen[word + window - block + 1] - seen[word] > 0) & there[row] & ~copy[row]
    return ids, w, copy, word[ok], row[ok], h[ok]


def later_windows(sent: DataFrame, answers: DataFrame, bits: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Answer bits, per group and bucket in the order sent: which candidate windows a smaller document has too."""
    def send(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        P.give_back()
        table = P.opened(left)
        got = []
        if table is not None:
            ids, _, _, _, row, h = candidates(table, right, bits, window, block)
            got = list(P.pack(ids[row], h, bits, 8 - bits // 8, sender=_key[0].as_py()))
        return pa.Table.from_batches(got, schema=P._ENTRIES)

    def meet(rows: pa.Table) -> pa.Table:
        P.give_back()
        doc, key, _, row = P.unpack(rows)
        order, cut, run = P.by_key(key)
        d = doc[order]
        late = np.zeros(len(doc), bool)
        if len(cut):
            late[order] = d > np.minimum.reduceat(d, cut)[run]
        return answer_bits(rows, row, late)

    entries = sent.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(send, P.ENTRIES)
    return entries.groupBy("bucket").applyInArrow(meet, NOTES)


def answer_bits(rows: pa.Table, row: np.ndarray, marked: np.ndarray) -> pa.Table:
    """For each packed row its sender gets back a bit per entry; ``runs`` holds the bucket, ``docs`` the sender's part."""
    at = np.searchsorted(row, np.arange(len(rows) + 1))
    packed = [np.packbits(marked[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    n = np.diff(at).astype(np.int32)
    part, bucket = (pa.array([v.to_bytes(4) for v in rows[c].to_pylist()], pa.binary()) for c in ("part", "bucket"))
    return pa.Table.from_arrays([
        pa.array(rows["sender"].to_numpy(), pa.int32()), pa.array(np.full(len(rows), LATER, np.int32)), pa.array(n), part, bucket,
        pa.array(packed, pa.binary())], schema=_NOTES)


class AnswerReader:
    """The bits of ``answer_bits``, handed out to the entries in the order they were found, part by part."""

    def __init__(self, answers: pa.Table, bits: int) -> None:
        rows = answers.filter(pc.equal(answers["kind"], LATER))
        self.bits, self.left = bits, {}
        for _, bucket, n, k in sorted(zip(*[rows[c].to_pylist() for c in ("docs", "runs", "n", "keys")], strict=True)):
            got = np.unpackbits(np.frombuffer(k, np.uint8), count=n).astype(bool)
            self.left.setdefault(int.from_bytes(bucket), []).append(got)
        self.left = {b: np.concatenate(x) for b, x in self.left.items()}

    def take(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for bucket, at in P.split((keys >> P.U(64 - self.bits)).astype(np.int64), 1 << self.bits):
            got = self.left[bucket]
            if len(got) < len(at):
                raise ValueError(f"bucket {bucket}: {len(got)} answers left for {len(at)} windows")
            out[at], self.left[bucket] = got[:len(at)], got[len(at):]
        return out


def covered(start: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in a run of ``size`` from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def covered_bytes(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_removed, kept_sha256 and kept_text (kept words, one space between)."""
    if 2 * block - 1 > window:
        raise ValueError("a window must be able to hold a whole block at any offset")
    new = ("n_words", "n_removed", "kept_sha256", "kept_text")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    bits = P.bits_for(docs)
    with small_batches(docs.sparkSession, 2048):
        answers = written(block_hits(docs, bits, block).unionAll(copies(docs, bits)), "block-hits")
    sent = P.parcels(docs, bits)
    later = written(later_windows(sent, answers, bits, window, block), "later-windows")
    schema = docs.select("*", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"),
                         F.lit("").alias("kept_sha256"), F.lit("").alias("kept_text")).schema
    fields = to_arrow_schema(schema)

    def cut(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        P.give_back()
        table = P.opened(left)
        if table is None:
            return fields.empty_table()
        ids, w, copy, word, row, h = candidates(table, right, bits, window, block)
        gone = covered(word[AnswerReader(right, bits).take(h)], window, len(w.hash))
        size = np.diff(w.first)
        whole_copy = np.repeat(copy & (size >= window), size)
        stay = ~(gone | whole_copy)
        texts = P.Texts.of(table["text"])
        buf, chosen = texts.buf.copy(), covered_bytes(w.start[stay], w.end[stay], len(texts.buf))
        space = w.end[stay & (w.end < np.repeat(texts.at[1:], size))]  # a row's last word may have none
        buf[space], chosen[space] = 32, True
        removed = size - np.add.reduceat(np.append(stay, False), w.first[:-1]) * (size > 0)
        digest, kept = [], []
        for a, b in zip(texts.at[:-1], texts.at[1:], strict=True):
            text = buf[a:b][chosen[a:b]].tobytes().removesuffix(b" ")
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode())
        new = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept)]
        return pa.Table.from_arrays([*[c.cast(f.type) for c, f in zip(table.columns, fields, strict=False)], *new],
                                    schema=fields)

    return sent.groupBy("grp").cogroup(answers.unionAll(later).groupBy("grp")).applyInArrow(cut, schema)


def clean_documents(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` with the repeats cut from their texts; documents of which nothing is left go, others keep all columns.

    A text without a repeat is unchanged; the others are their kept words.  ``n_chars``, if there, follows the text.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = dedup(packed, window, block).filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("_row.text")).otherwise(F.col("kept_text"))
    made = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("_row.n_chars")).otherwise(
        F.length("kept_text")).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
