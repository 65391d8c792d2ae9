"""Suffix dedup by bucket-pointer refinement over UTF-8 bytes.

Suffixes are told apart as in bucket-pointer refinement: initial buckets are q-grams, and a bucket is refined by the
bucket identifiers of its suffixes at a later offset, each pass doubling the depth and reusing the refined
identifiers, until the depth reaches the length of interest.  Suffixes that are alone in their bucket need no
refinement.  Over a corpus, that is done in two steps:

1. The q-gram buckets of sampled suffixes (the smallest q-gram hash in every window of ``length`` bytes, so that
   equal strings sample equal places) are exchanged; a string whose sampled bucket has one suffix occurs once.
2. The other suffixes are refined to depth ``length``: identifiers of q, 2q, 4q, ... bytes are built from each
   other, the last pass reaching back so that it ends at ``length``.  Buckets of the last depth are gathered; in
   each, all but the first suffix by (doc_id, position) mark ``length`` bytes.

Identifiers are 64-bit hashes of the bytes they stand for instead of ranks, so that tasks agree on them without a
global sort; buckets are then sorted on them.

Memory: a task works on about two megabytes of text at a time, at some 60 bytes per byte; a longer text is taken whole.

Exact copies need no search: every string of a copy is in the copy with the smallest id.

Defined results: null texts are empty; rows without doc_id keep all bytes and remove none elsewhere; among rows with
the same doc_id the one whose text sorts first is the earlier; texts shorter than ``length`` can only lose bytes to
nothing and stay.  Extra columns are carried along; one with the name of a
result column is replaced by it.  Kept bytes need not be valid UTF-8: ``kept`` is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from secscan.llm import block_anchors as B
from secscan.llm import packed as P
from secscan.llm.common import written

LENGTH, GRAM = 100, 32
KEY_BYTES = 5
CHUNK = 2 << 20
#: how hard documents are compressed that are sent
LEVEL = 9
#: bytes of text that are hashed at a time
PIECE = 1 << 16
_BYTE = P.mix(np.arange(1, 257, dtype=P.U) * P._ROLL)
#: an odd factor for each doubling pass
_PASS = P.mix(np.arange(1, 65, dtype=P.U)) | P.U(1)


def refined(buf: np.ndarray, depths: list[int]) -> list[np.ndarray]:
    """Bucket identifiers of every suffix at each depth (ascending): the bucket of depth a + b is that of depth a and,
    b bytes later, that of a depth already refined.  Identifiers run past the end of a text; callers mask those.

    It goes by pieces that the processor's cache holds: an identifier hangs on the bytes it stands for alone."""
    out = [np.empty(len(buf), P.U) for _ in depths]
    for a in range(0, len(buf), PIECE):
        ids, depth = _BYTE[buf[a:a + PIECE + depths[-1]]], 1
        for n, target in enumerate(depths):
            while depth < target:
                step = min(depth, target - depth)  # the later bucket starts ``step`` bytes on and reaches ``depth`` further
                later = ids[step:]
                ids = ids.copy()
                ids[:len(later)] *= _PASS[(depth + n) % 64]
                ids[:len(later)] += later
                depth += step
            ids = P.mix(ids)
            out[n][a:a + PIECE] = ids[:PIECE]
    return out


def sampled(gram: np.ndarray, at: np.ndarray, skip: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all strings of ``length`` bytes inside a text, their rows, and where in each its smallest q-gram hash
    is (the leftmost of equal ones), by a sliding minimum that doubles its width; rows to ``skip`` have none.

    The minimum is taken of a hash's upper bits with the place in the piece below them, so that it names its place."""
    span = length - q + 1
    sizes = np.where(skip, 0, np.maximum(np.diff(at) - (length - 1), 0))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    bits = P.U((PIECE + span).bit_length())  # the same in all tasks: they have to sample alike
    where = np.empty(len(gram), np.int64)
    for a in range(0, len(gram), PIECE):
        best, width = gram[a:a + PIECE + span] >> bits << bits, 1
        best |= np.arange(len(best), dtype=P.U)
        while width < span:
            step = min(width, span - width)
            best, width = np.minimum(best[step:], best[:max(len(best) - step, 0)]), width + step
        best &= (P.U(1) << bits) - P.U(1)
        n = min(len(best), PIECE)
        np.add(best[:n].view(np.int64), a, out=where[a:a + n])
    start = np.arange(sizes.sum()) + np.repeat(at[:-1] - (np.cumsum(sizes) - sizes), sizes)
    return start, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), where[start]


def _first_of_runs(place: np.ndarray) -> np.ndarray:
    """Where strings begin to have another sampled place than the string before."""
    return np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1) if len(place) else np.zeros(0, np.int64)


def shared_grams(docs: DataFrame, bits: int, length: int, q: int) -> DataFrame:
    """Notes (doc, q-gram bucket) of sampled suffixes whose bucket has more than one sampled suffix."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in P.chunks(batches, "text", CHUNK):
            ids, there = P.ids_of(table)
            texts = P.Texts.of(table["text"])
            gram, = refined(texts.buf, [q])
            _, row, place = sampled(gram, texts.at, ~there, length, q)
            new = _first_of_runs(place)
            yield from P.pack(ids[row[new]], gram[place[new]], bits, KEY_BYTES)

    def meet(rows: pa.Table) -> pa.Table:
        doc, key, _, _ = P.unpack(rows)
        order, cut, run = P.by_key(key)
        many = np.diff(cut, append=len(key)) > 1
        at = np.sort(order[many[run]]) if len(cut) else order
        bucket = P.U(rows["bucket"][0].as_py()) << P.U(8 * KEY_BYTES)
        return pa.Table.from_batches(list(B.notes(B.HIT, doc[at], key[at] | bucket, bits)), schema=B._NOTES)

    return docs.select("doc_id", "text").mapInArrow(send, P.ENTRIES).groupBy("bucket").applyInArrow(meet, B.NOTES)


def _open_strings(table: pa.Table, answers: pa.Table, bits: int, length: int, q: int):
    """Suffixes that need refinement: (ids, copies, texts, start, row, identifier at depth ``length``)."""
    ids, there = P.ids_of(table)
    texts = P.Texts.of(table["text"])
    copy = B.are_copies(ids, there, texts, answers)
    gram, whole = refined(texts.buf, [q, length])
    start, row, place = sampled(gram, texts.at, copy | ~there, length, q)
    new = _first_of_runs(place)
    seen = B._has_note(ids[row[new]], gram[place[new]] >> P.U(64 - bits - 8 * KEY_BYTES), answers, B.HIT)
    ok = np.repeat(seen, np.diff(new, append=len(place)))
    return ids, copy, texts, start[ok], row[ok], whole[start[ok]]


def later_strings(sent: DataFrame, answers: DataFrame, bits: int, length: int, q: int) -> DataFrame:
    """Answer bits, per group and bucket in the order sent: suffixes that are not the first of their final bucket."""
    def send(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        table = P.opened(left)
        got = []
        if table is not None:
            for n, part in enumerate(parts(table)):
                ids, _, _, _, row, h = _open_strings(part, right, bits, length, q)
                got += P.pack(ids[row], h, bits, 8 - bits // 8, sender=_key[0].as_py(), part=n)
        return pa.Table.from_batches(got, schema=P._ENTRIES)

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sender", "ascending"), ("part", "ascending")])
        doc, key, _, row = P.unpack(rows)
        by_doc = np.argsort(doc, kind="stable")
        order, cut, _ = P.by_key(key[by_doc])
        late = np.ones(len(doc), bool)
        late[by_doc[order[cut]]] = False
        return B.answer_bits(rows, row, late)

    entries = sent.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(send, P.ENTRIES)
    return entries.groupBy("bucket").applyInArrow(meet, B.NOTES)


def parts(table: pa.Table) -> Iterator[pa.Table]:
    """A group's documents in chunks, always the same ones."""
    return P.chunks(table.to_batches(), "text", CHUNK)


def dedup(docs: DataFrame, length: int = LENGTH, q: int = GRAM) -> DataFrame:
    """All columns of ``docs`` plus n_bytes, n_removed, n_spans, kept_sha256 and kept (binary)."""
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    bits = P.bits_for(docs)
    answers = written(shared_grams(docs, bits, length, q).unionAll(B.copies(docs, bits)), "shared-grams")
    sent = P.parcels(docs, bits, level=LEVEL)
    later = written(later_strings(sent, answers, bits, length, q), "later-strings")
    schema = docs.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("n_bytes", "n_removed", "n_spans")],
                         F.lit("").alias("kept_sha256"), F.lit(b"").alias("kept")).schema
    fields = to_arrow_schema(schema)

    def cut(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        table = P.opened(left)
        if table is None:
            return fields.empty_table()
        out, answered = [], B.AnswerReader(right, bits)
        for part in parts(table):
            ids, copy, texts, start, row, h = _open_strings(part, right, bits, length, q)
            gone = B.covered(start[answered.take(h)], length, len(texts.buf))
            size = np.diff(texts.at)
            gone |= np.repeat(copy & (size >= length), size)
            cols: list[list] = [[], [], [], []]
            for a, b in zip(texts.at[:-1], texts.at[1:], strict=True):
                g = gone[a:b]
                kept = texts.buf[a:b][~g].tobytes()
                spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (b > a and g[0]))
                for c, v in zip(cols, (int(np.count_nonzero(g)), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
            new = [pa.array(size, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                   pa.array(cols[2]), pa.array(cols[3], pa.binary())]
            out.append(pa.Table.from_arrays([*[c.cast(f.type) for c, f in zip(part.columns, fields, strict=False)], *new],
                                            schema=fields))
        return pa.concat_tables(out) if out else fields.empty_table()

    return sent.groupBy("grp").cogroup(answers.unionAll(later).groupBy("grp")).applyInArrow(cut, schema)
