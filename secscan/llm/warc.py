"""WARC archives: write them, index them, read back chosen records by byte ranges.

``write`` makes one gzip member per record (what readers expect of a ``.warc.gz``), rolling over to a new archive at a
size.  Rows with equal payloads are written once, as the response with the largest id; the others are revisit records
that name it.  Reading goes index first: ``index`` walks the archives as streams and keeps offset, length, URL, digest
and type per record, never a payload.  ``read`` takes any selection of the index, sorts it by place, coalesces records
that lie close together into one read of bounded size, and cuts the records out of it.

A task names its archives after its attempt, and the committed table of names decides which archives count: what a
lost or repeated attempt left behind is in no table.  A task holds one read or one record at a time.

Defined results: a null payload is empty; a null URL has no WARC-Target-URI and reads back as null; white space and
control characters in URLs are percent-encoded; a row without id is written with an empty one, is nobody's response,
and revisits an equal row with an id if there is one; rows that share both the largest id and the payload are all
responses, rows that share an id alone are told apart by payload; an empty table gives no archive and no rows;
payloads may be as long as one row can be; only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secscan.llm.common import new_path, small_batches, written

ARCHIVE_BYTES = 1 << 30
#: records up to GAP bytes apart share a read, of READ_BYTES at most (or one record)
GAP, READ_BYTES = 64 << 10, 8 << 20
#: records of one stretch of an archive are read by one task
STRETCH = 64 << 20
BATCH_ROWS = 64
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = "file string, offset bigint, length bigint, record_type string, id bigint, url string, payload_digest string, refers_to bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(id_: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda i: f"<urn:record:{'' if i is None else i}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(id_)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    head.append(("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"))
    if refers_to is None:
        block = _HTTP % len(payload) + payload
    else:
        block = b""
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", _REVISIT)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode()) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def write(pages: DataFrame, id_: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
          archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(file, n_records) of the archives written to the shared folder; payloads of ``least`` bytes and more are
    written once.

    Digests travel alone first; of them only those that occur again are joined back to the pages, so a page that is
    like no other meets a small table.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_}`").cast("bigint").alias("id"), F.col(f"`{url}`").alias("url"),
                        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    again = rows.filter(F.length("payload") >= least).groupBy("same").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    again = written(again.filter("n > 1 AND keep IS NOT NULL").select("same", "keep"), "warc-copies")
    rows = rows.join(again, "same", "left").select(
        "id", "url", "payload", F.expr("CASE WHEN id IS NULL OR id < keep THEN keep END").alias("refers_to"))
    folder = new_path(spark, "warc")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size, k = None, "", 0, 0, 0
        done: list[tuple[str, int]] = []
        try:
            for b in batches:
                for one in b.to_pylist():
                    if out is None:
                        name, n, size, k = f"{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz", 0, 0, k + 1
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(one["id"], one["url"], one["payload"], one["refers_to"], date)
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        done.append((f"{folder}/{name}", n))
        finally:
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())],
                                         names=["file", "n_records"])

    with small_batches(spark, BATCH_ROWS):
        return written(rows.mapInArrow(save, "file string, n_records bigint"), "warc-files")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _number(urn: str | None) -> int | None:
    found = re.search(r":(-?\d+)>$", urn or "")
    return int(found[1]) if found else None


def members(chunks: Iterable[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, WARC header) of every gzip member of a stream; what follows the header is passed over."""
    at = start = 0
    squeezed, head, found = None, b"", False
    for data in chunks:
        while data:
            if squeezed is None:
                squeezed, head, found = zlib.decompressobj(31), b"", False
                start = at
            out = squeezed.decompress(data, 1 << 16)
            if not found:
                head += out
                end = head.find(b"\r\n\r\n")
                if end >= 0:
                    head, found = head[:end], True
            left = squeezed.unused_data if squeezed.eof else squeezed.unconsumed_tail
            at += len(data) - len(left)
            if not left and not squeezed.eof:  # what is still inside
                while more := squeezed.decompress(b"", 1 << 16):
                    if not found:
                        head += more
                        end = head.find(b"\r\n\r\n")
                        if end >= 0:
                            head, found = head[:end], True
            if squeezed.eof:
                if not found:
                    raise ValueError(f"record at {start} has no header")
                yield start, at - start, head
                left, squeezed = squeezed.unused_data or left, None
            data = left
    if squeezed is not None:
        raise ValueError(f"record at {start} is cut off")


def index(files: DataFrame) -> DataFrame:
    """One row per record (``INDEX``) of the archives in column ``file``, a task per archive."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_stream(path, compression=None) as f:
                    rows: list[tuple] = []
                    for offset, length, head in members(iter(lambda: f.read(1 << 20), b"")):
                        h = _fields(head)
                        rows.append((name, offset, length, h.get("warc-type"), _number(h.get("warc-record-id")), h.get("warc-target-uri"),
                                     h.get("warc-payload-digest", "").removeprefix("sha1:") or None, _number(h.get("warc-refers-to"))))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    n = max(1, files.count())
    return files.select("file").repartition(min(n, 1 << 15), "file").mapInArrow(walk, INDEX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def coalesced(places: Iterable[tuple], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """(file, start, end, records) of the reads that cover ``places`` (file, offset, length, ...), sorted by place."""
    file, start, end, held = None, 0, 0, []
    for p in places:
        if held and (p[0] != file or p[1] > end + gap or p[1] + p[2] - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = p[0], p[1], p[1]
        held.append(p)
        end = max(end, p[1] + p[2])
    if held:
        yield file, start, end, held


def read(chosen: DataFrame, payload: bool = True) -> DataFrame:
    """The ``chosen`` index rows' records read back: their columns of the index, then payload_bytes, payload_sha1
    (measured on what was read) and, if asked for, the payload.

    A task takes the records of one stretch of an archive, in order of place, however few archives there are.
    """
    spark = chosen.sparkSession
    size = chosen.agg(F.sum("length")).first()[0] or 0
    names = [x.split()[0] for x in INDEX.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, opened, path = None, None, None
        places = (tuple(r) for b in batches for r in zip(*[b.column(c).to_pylist() for c in names], strict=True))
        for file, start, end, held in coalesced(places):
            if file != path:
                store, name = fs.FileSystem.from_uri(file)
                opened, path = store.open_input_file(name), file
            data = memoryview(opened.read_at(end - start, start))
            rows, full = [], 0
            for p in held:
                raw = zlib.decompress(data[p[1] - start:p[1] - start + p[2]], 31)
                body = raw.index(b"\r\n\r\n") + 4
                block = raw[body:body + int(_fields(raw[:body])["content-length"])]
                block = block[block.index(b"\r\n\r\n") + 4:] if block.startswith(b"HTTP/") else block
                rows.append((*p, len(block), base32_sha1(block), block if payload else None))
                full += len(block) if payload else 0
                if full > READ_BYTES:
                    yield _read_batch(rows, payload)
                    rows, full = [], 0
            if rows:
                yield _read_batch(rows, payload)

    schema = INDEX + ", payload_bytes bigint, payload_sha1 string" + ", payload binary" * payload
    parts = chosen.select(*names).repartition(max(1, -(-size // STRETCH)) if size > STRETCH else spark.sparkContext.defaultParallelism,
                                              "file", F.expr(f"offset div {min(STRETCH, max(1 << 20, size // 64))}"))
    return parts.sortWithinPartitions("file", "offset").mapInArrow(cut, schema)


def _read_batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    base = _batch([r[:8] for r in rows])
    more = [pa.array([r[8] for r in rows], pa.int64()), pa.array([r[9] for r in rows], pa.string())]
    names = [*base.schema.names, "payload_bytes", "payload_sha1"]
    if payload:
        more.append(pa.array([r[10] for r in rows], pa.binary()))
        names.append("payload")
    return pa.RecordBatch.from_arrays([*base.columns, *more], names=names)


def round_trip(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per row of ``pages``, all read from archives
    just written; a revisit has the measures of the response it names."""
    places = written(index(write(pages, least=least, archive_bytes=archive_bytes)), "warc-index")
    full = written(read(places.filter("record_type = 'response'"), payload=False).select("id", "payload_bytes", "payload_sha1"), "warc-read")
    back = places.filter("record_type = 'revisit'").select("id", "refers_to", "payload_digest")
    one = full.filter("id IS NOT NULL").groupBy("id", "payload_sha1").agg(F.max("payload_bytes").alias("payload_bytes"))
    one = written(one.select(F.col("id").alias("_id"), F.col("payload_sha1").alias("_sha1"), "payload_bytes"), "warc-responses")
    back = back.join(one, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_sha1")), "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select(F.col("id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"),
                       F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")).select(*cols).union(
        back.select(F.col("id").alias("page_id"), "payload_bytes", F.col("_sha1").alias("payload_digest"),
                    F.lit("revisit").alias("record_type"), "refers_to").select(*cols))
