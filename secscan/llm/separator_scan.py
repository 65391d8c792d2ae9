"""Token counts of flat token files by separator scan.

The files hold nothing but token ids, document after document, each closed by an end-of-document id; there is no
index.  They are read in blocks of bytes, in any order and by any task; a block is searched for the separator with
one vectorised comparison, and boundaries are stitched across blocks with a prefix scan: every block needs the number
of separators before it and the place of the last one.  The scan has two steps, over blocks within stretches of
``STRETCH`` blocks and over the stretches of a file, so one very long file is not one long window.

``write_shards`` makes such files from a table, for corpora that are not tokenised yet.

Defined results: two separators in a row are an empty document (null and empty texts are written so); tokens after
the last separator are a last document with ``closed`` false; an empty file has no documents; a file whose size is
no multiple of the token width is an error; a very long document spans blocks like any other.  ``count_tokens`` tells
documents apart by file and place, so ids may be null or repeated, each row has its own count; an empty table has none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secscan.llm.common import new_path, written

KIND = np.dtype("<u2")
BLOCK_TOKENS = 1 << 19
STRETCH = 1024


def encoder(vocabulary: str, pattern: str):
    import tiktoken
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_shards(docs: DataFrame, vocabulary: str, pattern: str, separator: int) -> tuple[str, DataFrame]:
    """(folder, order): one flat file per partition of ``docs``; ``order`` (file, ordinal, doc_id) is what was written
    where, known to the writer only.  The folder is in the shared storage; a repeated task replaces its file whole."""
    folder = new_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary, pattern), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, ordinal = f"{task.partitionId():06d}.tokens", 0
        part = f"{root}/_{name}-{task.taskAttemptId()}"
        with store.open_output_stream(part) as out:
            for b in batches:
                for text in b.column("text"):
                    ids = enc.encode_ordinary(text.as_py() or "")
                    out.write(np.array([*ids, separator], KIND).tobytes())
                n = len(b)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(
                    np.arange(ordinal, ordinal + n)), b.column("doc_id").cast(pa.int64())], names=["file", "ordinal", "doc_id"])
                ordinal += n
        store.move(part, f"{root}/{name}")

    order = docs.select("doc_id", "text").mapInArrow(write, "file string, ordinal bigint, doc_id bigint")
    return folder, written(order, "token-order")


def token_files(folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the folder's token files."""
    store, root = fs.FileSystem.from_uri(folder)
    found = [(f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))
             if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    for name, size in found:
        if size % KIND.itemsize:
            raise ValueError(f"{name}: {size} bytes are no whole number of tokens")
    return found


def scan_blocks(spark: SparkSession, folder: str, files: Sequence[tuple[str, int]], separator: int, block: int) -> DataFrame:
    """(file, block, first, n, seps): per block its first token, its tokens, and the separators' places in it."""
    listed = spark.createDataFrame(list(files), "file string, size bigint").filter("size > 0")
    width = block * KIND.itemsize
    blocks = listed.select("file", F.explode(F.expr(f"sequence(0L, (size - 1) div {width})")).alias("block")).repartition("file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, no in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    f.seek(no * width)
                    tokens = np.frombuffer(f.read(width), KIND)
                seps = np.flatnonzero(tokens == separator).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([no]), pa.array([no * block]), pa.array(
                    [len(tokens)]), pa.array([seps], pa.list_(pa.int64()))], names=["file", "block", "first", "n", "seps"])

    return blocks.mapInArrow(search, "file string, block bigint, first bigint, n bigint, seps array<bigint>")


def documents(spark: SparkSession, folder: str, separator: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the folder's files: file, ordinal, first (token), n_tokens, closed."""
    blocks = written(scan_blocks(spark, folder, token_files(folder), separator, block), "token-blocks").withColumn(
        "stretch", F.expr(f"block div {STRETCH}")).withColumn(
        "last", F.expr("CASE WHEN size(seps) > 0 THEN first + element_at(seps, -1) END"))
    inside = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = blocks.groupBy("file", "stretch").agg(
        F.sum(F.size("seps")).alias("_n"), F.max("last").alias("_l"), F.max(F.expr("first + n")).alias("_e"))
    before = whole.select("file", "stretch", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_n0"),
                          F.coalesce(F.max("_l").over(across), F.lit(-1)).alias("_l0"))
    stitched = blocks.withColumn("_n1", F.coalesce(F.sum(F.size("seps")).over(inside), F.lit(0))).withColumn(
        "_l1", F.max("last").over(inside)).join(before, ["file", "stretch"])
    found = stitched.select("file", (F.col("_n0") + F.col("_n1")).alias("_base"), F.coalesce("_l1", "_l0").alias("_prev"),
                            "first", "seps", F.posexplode("seps").alias("_i", "_at"))
    start = F.expr("CASE WHEN _i = 0 THEN _prev ELSE first + get(seps, _i - 1) END + 1")
    closed = found.select("file", (F.col("_base") + F.col("_i")).alias("ordinal"), start.alias("first"),
                          F.expr("first + _at").alias("_end"), F.lit(True).alias("closed"))
    tail = whole.groupBy("file").agg(F.sum("_n").alias("ordinal"), F.expr("coalesce(max(_l), -1) + 1").alias("first"),
                                     F.max("_e").alias("_end")).filter("_end > first").withColumn("closed", F.lit(False))
    return closed.unionByName(tail).select("file", F.col("ordinal").cast("bigint").alias("ordinal"), "first",
                                           (F.col("_end") - F.col("first")).alias("n_tokens"), "closed")


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, separator: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, file, ordinal of every document: written as token files, counted by their separators."""
    folder, order = write_shards(docs, vocabulary, pattern, separator)
    return order.join(documents(docs.sparkSession, folder, separator, block), ["file", "ordinal"]).select(
        "doc_id", "n_tokens", "file", "ordinal")
