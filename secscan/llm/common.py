"""Helpers shared by the training-data operators: words, shared storage, reading."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the white space of every word definition here: space and \t \n \x0b \f \r
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t-\\r]+"
#: of the bitmap of ``perhaps``: bits a key, bits at most (32 MB), bits in one row
FILTER_BITS, MOST_BITS, BUCKET = 16, 1 << 28, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the runs of non-space characters; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="corpus-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, and gives
    Spark the table's true size for its own choice of join."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made; call it once what was made of them is written itself."""
    for t in tables:
        if path := t.__dict__.get("_written"):
            jvm = t.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver's JVM finds them unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python workers at most ``rows`` rows at a time in the actions within: for rows that may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def perhaps(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` may be one of ``keys`` (a table of one column, of the same type); nearly all others go
    here, without an exchange of the rows.  For long rows of which few are wanted; an exact join has to follow.

    A bitmap of the keys' hashes is broadcast.  It has FILTER_BITS bits a key (one in so many others stays) and MOST_BITS
    at most; with more keys than it has room for, more rows stay.
    """
    size = max(BUCKET, min(MOST_BITS, FILTER_BITS * keys.count()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    place = at(F.col(keys.columns[0]))
    bits = keys.groupBy(F.floor(place / BUCKET).alias("_bucket")).agg(F.bitmap_construct_agg(place % BUCKET).alias("_bits"))
    own = rows.select("*", at(F.col(column)).alias("_place")).join(F.broadcast(bits), F.floor(F.col("_place") / BUCKET) == F.col("_bucket"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") % BUCKET / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return own.filter(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1).select(*rows.columns)
