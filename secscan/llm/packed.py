"""Texts as numpy arrays inside Arrow tasks, and a packed hash exchange between them.

A task that has hashed the windows of its texts sends them to hash buckets as a few binary rows, not as one row per
window: per bucket the hashes' bytes and the documents as runs.  A bucket is one group; the number of buckets
grows with the input so that each stays a few megabytes.  Answers go back to groups of documents (by a hash of
doc_id), where they meet the texts again.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_FNV, _SEED, _ROLL = U(0x100000001B3), U(0xCBF29CE484222325), U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: longer words are hashed one by one
_SHORT_WORD = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def times(n: int) -> np.uint64:
    """n steps of the rolling factor, modulo 2^64."""
    return U(n * int(_ROLL) & 0xFFFFFFFFFFFFFFFF)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours of ``h`` (length n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _ROLL
        out += h[j:j + n]
    return mix(out)


@dataclass
class Texts:
    """Texts of some rows, end to end in ``buf``; row i is buf[at[i]:at[i + 1]]."""

    buf: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        """From a string column; nulls are empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(buf[at[0]:at[-1]], at - at[0])

    def __len__(self) -> int:
        return len(self.at) - 1


@dataclass
class Words:
    """Words of ``Texts``: byte ranges, hashes, and the first word of each row (``first[i]`` to ``first[i + 1]``)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, t: Texts, lower: bool = False) -> Words:
        buf = _LOWER[t.buf] if lower else t.buf
        n = len(buf)
        inside = ~_SPACE[buf]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = t.at[:-1] < t.at[1:]
        before[t.at[:-1][full]] = False
        after[t.at[1:][full] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return cls(start, end, _word_hashes(buf, start, end), np.searchsorted(start, t.at))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of k words that lie in one row: first word, row, hash."""
        sizes = np.maximum(np.diff(self.first) - (k - 1), 0)
        row = np.repeat(np.arange(len(sizes)), sizes)
        word = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.first[row]
        return word, row, rolling(self.hash, k)[word]


def _word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    h = np.full(len(start), _SEED, U)
    order = np.argsort(-np.minimum(size, _SHORT_WORD + 1).astype(np.int8), kind="stable")
    left = np.searchsorted(-size[order].clip(max=_SHORT_WORD + 1), -np.arange(_SHORT_WORD + 2), side="left")
    s, g = start[order], h[order]
    for j in range(_SHORT_WORD):
        n = left[j]  # words of more than j bytes
        if not n:
            break
        g[:n] ^= buf[s[:n] + j]
        g[:n] *= _FNV
    h[order] = g
    for i in np.flatnonzero(size > _SHORT_WORD):
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i]:end[i]].tobytes())
    return mix(h + size.astype(U) * _ROLL)


# ---------------------------------------------------------------- packing
def planes(a: np.ndarray, width: int | None = None) -> bytes:
    """The bytes of an integer array by significance, so that the shuffle's compression finds the constant ones."""
    return a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T.tobytes()


def from_planes(data: bytes, n: int, kind=np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((n, size), np.uint8)
    if n:
        got = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, :len(got)] = got.T
    return out.view(kind).reshape(n)


def group_of(doc_ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(doc_ids.astype(np.int64).view(U) + _SEED) >> U(64 - bits)).astype(np.int32)


ENTRIES = "bucket int, sender int, part int, n int, docs binary, runs binary, keys binary, flags binary"
_ENTRIES = pa.schema([("bucket", pa.int32()), ("sender", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()),
                      ("runs", pa.binary()), ("keys", pa.binary()), ("flags", pa.binary())])


def split(which: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions in order) for each value of ``which``, all below n."""
    if not len(which):
        return
    which = which.astype(np.uint16 if n <= 1 << 16 else np.uint32, copy=False)
    order = np.argsort(which, kind="stable")
    seen = which[order]
    cut = np.append(0, np.flatnonzero(seen[1:] != seen[:-1]) + 1)
    for a, b in zip(cut, [*cut[1:], len(seen)], strict=True):
        yield int(seen[a]), order[a:b]


def runs(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1)) if len(docs) else np.zeros(0, np.int64)
    return docs[cut], np.diff(cut, append=len(docs)).astype(np.uint32)


def pack(docs: np.ndarray, keys: np.ndarray, bits: int, width: int, flags: np.ndarray | None = None,
         sender: int = -1, part: int = 0) -> Iterator[pa.RecordBatch]:
    """One row per bucket: the top ``bits`` of a key name its bucket, the next ``width`` bytes are sent."""
    if not len(keys):
        return
    cols: list[list] = [[] for _ in _ENTRIES]
    for bucket, at in split((keys >> U(64 - bits)).astype(np.uint32), 1 << bits):
        d, r = runs(docs[at])
        low = (keys[at] << U(bits)) >> U(64 - 8 * width)
        row = (bucket, sender, part, len(at), planes(d), planes(r), planes(low, width),
               b"" if flags is None else np.packbits(flags[at]).tobytes())
        for c, v in zip(cols, row, strict=True):
            c.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENTRIES, strict=True)], schema=_ENTRIES)


def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(docs, keys, flags, row) of all entries of packed rows."""
    docs, keys, flags, row = [], [], [], []
    for i, (n, d, r, k, f) in enumerate(zip(*[rows[c].to_pylist() for c in ("n", "docs", "runs", "keys", "flags")],
                                            strict=True)):
        count = len(d) // 8
        docs.append(np.repeat(from_planes(d, count, np.int64), from_planes(r, count, np.uint32)))
        keys.append(from_planes(k, n))
        flags.append(np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) if f else np.zeros(n, bool))
        row.append(np.full(n, i, np.int32))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, bool), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in (docs, keys, flags, row))


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts keys, starts of equal runs in it, run number of each sorted entry)."""
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=U(0)) != 0
    if len(new):
        new[0] = True
    return order, np.flatnonzero(new), np.cumsum(new) - 1


# ---------------------------------------------------------------- documents by group
PARCELS = "grp int, parcel binary"
_PARCELS = pa.schema([("grp", pa.int32()), ("parcel", pa.binary())])


def ids_of(batch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id as int64 (nulls 0) and which are there."""
    column = batch["doc_id"] if isinstance(batch, pa.Table) else batch.column("doc_id")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), there


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for the tasks and steps that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[pa.Table]:
    """Batches put together, or cut, to about ``size`` bytes of text; a longer text is a chunk of its own."""
    yield from _chunks(batches, text, size)
    give_back()


def _chunks(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        lengths = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths.astype(np.int64)) + n) // size
        for cut in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            if not len(cut):
                continue
            if held and part[cut[0]] > 0 and n:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(b.slice(cut[0], len(cut)))
            n += int(lengths[cut].sum())
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def parcels(docs: DataFrame, bits: int, chunk: int = 16 << 20, level: int = 3) -> DataFrame:
    """Rows of ``docs``, all columns, as compressed parcels per group of documents: (grp, parcel)."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=level)
        for table in chunks(batches, "text", chunk):
            ids, _ = ids_of(table)
            whole = table.combine_chunks()
            names, blobs = [], []
            for g, at in split(group_of(ids, bits).astype(np.int64), 1 << bits):
                sink = pa.BufferOutputStream()
                part = whole.take(pa.array(at))
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_table(part)
                names.append(g)
                blobs.append(z.compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], schema=_PARCELS)

    return docs.mapInArrow(send, PARCELS)


def opened(rows: pa.Table) -> pa.Table | None:
    """The documents of a group's parcels, ordered by doc_id and then text, so that each reading sees the same order."""
    z = zstandard.ZstdDecompressor()
    tables = [pa.ipc.open_stream(z.decompress(b)).read_all() for b in rows["parcel"].to_pylist()]
    if not tables:
        return None
    whole = pa.concat_tables(tables)
    return whole.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def bits_for(docs: DataFrame, text: str = "text", bucket_bytes: int = 8 << 20, least: int = 8) -> int:
    """log2 of the buckets that keep each at about ``bucket_bytes`` of text."""
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, math.ceil(math.log2(max(1, size / bucket_bytes))))
