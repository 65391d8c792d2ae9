"""Items I1-I6: Structured Streaming versions and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secscan.operators import rules as B
from secscan.operators import scan as N
from secscan.operators import textscan as S
from secscan.sources import catalogue as K
from secscan.sources.store import stored

DEBOUNCE = "1500 milliseconds"  # FIXED VALUE: editor debounce (allowed 500..10000 ms)


def stream_scan(files_stream: DataFrame, engine: str = "T", rules: list[K.Rule] | None = None) -> DataFrame:
    """The full scan of files (repo, path, content) as they arrive: every finding is made in its file's row, so the
    stream keeps no state.  Works on a streaming or a static DataFrame alike."""
    rules = B.default_rules(engine) if rules is None else rules
    if engine == "T":
        return N.scan_t(S.t_prepare(files_stream), rules)
    return N.scan_p(S.p_prepare(files_stream), rules)


def debounced_scan(events: DataFrame, gap: str = DEBOUNCE, watermark: str = "10 seconds",
                   key: str = "path", ts: str = "ts", payload: str = "content") -> DataFrame:
    """Per key, only the last version after ``gap`` of quiet.

    Session windows per key; the latest payload by event time.  With a
    watermark this runs on a stream (a session is emitted once the watermark
    passes its end); without, it is the batch twin."""
    ev = events.withWatermark(ts, watermark) if events.isStreaming else events
    return ev.groupBy(key, F.session_window(ts, gap).alias("s")).agg(
        F.max_by(payload, F.struct(F.col(ts), F.col(payload))).alias("last"),
        F.count(F.lit(1)).cast("bigint").alias("n"))


def latest_diagnostics(current: DataFrame, batch: DataFrame) -> DataFrame:
    """I4: new findings of a file replace its old ones (also when empty):
    keep old rows of files not in the batch, add the batch rows."""
    touched = batch.select("repo", "path").distinct()
    keep = current.join(touched, ["repo", "path"], "left_anti")
    return keep.unionByName(batch.filter(F.col("rule_id").isNotNull()), allowMissingColumns=True)


def cache_dedupe(stream: DataFrame, key: str = "key", ts: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Suppress repeats of a key within the ttl (watermark based)."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


# ---------------------------------------------------------------- I4 as a stream: a table of current findings
#: columns of the table; a row without rule_id says that the file was scanned and is clean
DIAGNOSTICS = ("repo", "path", "line_no", "col", "rule_id", "severity", "message", "snippet")


def scanned_files(files: DataFrame, engine: str = "T", rules: list[K.Rule] | None = None) -> DataFrame:
    """Findings of the latest version (by ``ts``) of each file of a batch, and one row without rule_id for a clean one."""
    last = files.groupBy("repo", "path").agg(F.max_by("content", F.struct("ts", "content")).alias("content"))
    found = stream_scan(last, engine, rules).select(*DIAGNOSTICS)
    clean = last.select("repo", "path").join(found.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    return found.unionByName(clean, allowMissingColumns=True)


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Put a batch's rows into the table at ``path`` (shared storage): its own folder, written over if the batch comes
    again, so a repeated batch changes nothing.  What is written grows with the batch, not with the table."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def current_diagnostics(table: DataFrame) -> DataFrame:
    """The findings of each file's last batch: new ones replace old ones, also where there are none."""
    last = table.groupBy("repo", "path").agg(F.max("batch_id").alias("_last"))
    return table.join(last, ["repo", "path"]).filter("batch_id = _last AND rule_id IS NOT NULL").drop("_last")


def compact(table: DataFrame, batch_id: int, path: str) -> None:
    """Write the last rows of each file as one batch of a new table; ``batch_id`` is the last that ``table`` holds."""
    last = table.groupBy("repo", "path").agg(F.max("batch_id").alias("_last"))
    write_batch(table.join(last, ["repo", "path"]).filter("batch_id = _last").drop("_last", "batch_id"), batch_id, path)


def diagnostics_stream(files_stream: DataFrame, path: str, checkpoint: str, engine: str = "T", rules: list[K.Rule] | None = None):
    """A stream of file versions (repo, path, content, ts) that keeps the table of current findings at ``path``; returns
    the writer, for the caller to choose its trigger and start it."""
    return files_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_batch(scanned_files(batch, engine, rules), batch_id, path))


# ---------------------------------------------------------------- I5 exactly: the limit counts from the row that was stored
def stored_rows(rows: DataFrame, ttl_ms: int, key: str = "key", ts_ms: str = "ts_ms", id_: str = "event_id") -> DataFrame:
    """The batch twin of ``cache_dedupe`` with the cache's own rule: a key's first row is stored; a later one is stored if
    the last *stored* row is ``ttl_ms`` old or older.  So stored rows are a chain, each the first row that is ttl after
    the one before.

    Every row points to the first one that is ttl or more behind it.  That one lies in the next bucket of ttl length, or
    heads the next one that has any rows, so pointers come from windows per (key, bucket) over distinct times, never
    from a whole key.  The chain is then followed from all first rows at once by pointer jumping: the pointers double
    their reach in each round, so a chain of n rows takes log2(n) of them.  Of rows at one time the least id counts.
    """
    k, t = F.col("k"), F.col("t")
    nodes = rows.groupBy(F.col(key).alias("k"), F.col(ts_ms).cast("bigint").alias("t")).agg(F.min(id_).alias("id"))
    nodes = stored(nodes.filter("t IS NOT NULL"), "cache-rows")
    bucket = F.floor(t / F.lit(ttl_ms)).cast("bigint")
    here = nodes.select("k", "t", bucket.alias("b"), t.alias("node"), F.lit(None).cast("bigint").alias("asks"))
    ask = nodes.select("k", (t + ttl_ms).alias("t"), (bucket + 1).alias("b"), F.lit(None).cast("bigint").alias("node"), t.alias("asks"))
    # windows run backwards in time: a frame that is open ahead would be read again for every row.  Of rows at one time
    # the one that answers comes before the one that asks
    after = Window.partitionBy("k", "b").orderBy(F.desc("t"), F.col("node").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, 0)
    asked = here.union(ask).withColumn("next", F.last("node", ignorenulls=True).over(after)).filter("asks IS NOT NULL")
    asked = stored(asked.select("k", "b", F.col("asks").alias("t"), "next"), "cache-asked")
    heads = nodes.groupBy("k", bucket.alias("b")).agg(F.min("t").alias("head"))
    wanted = asked.filter("next IS NULL").select("k", "b").distinct().withColumn("want", F.lit(True))
    line = heads.withColumn("want", F.lit(False)).unionByName(wanted, allowMissingColumns=True)
    later = Window.partitionBy("k").orderBy(F.desc("b")).rangeBetween(Window.unboundedPreceding, -1)
    ahead = line.withColumn("next_head", F.last("head", ignorenulls=True).over(later)).filter("want").select("k", "b", "next_head")
    jump = asked.join(ahead, ["k", "b"], "left").select("k", "t", F.coalesce("next", "next_head").alias("to")).filter("to IS NOT NULL")
    first = nodes.groupBy("k").agg(F.min("t").alias("t"))
    # only rows that something points to can be stored, apart from the first ones
    reached = jump.select("k", F.col("to").alias("t")).union(first.select("k", "t")).distinct()
    jump, chain = stored(jump.join(reached, ["k", "t"], "left_semi"), "cache-jumps"), stored(first, "cache-chain")
    while not jump.isEmpty():
        more = chain.join(jump, ["k", "t"]).select("k", F.col("to").alias("t"))
        chain = stored(chain.union(more).distinct(), "cache-chain")
        far = jump.select("k", F.col("t").alias("to"), F.col("to").alias("to2"))
        jump = stored(jump.join(far, ["k", "to"]).select("k", "t", F.col("to2").alias("to")), "cache-jumps")
    return nodes.join(chain, ["k", "t"], "left_semi").select(k.alias(key), t.alias(ts_ms), F.col("id").alias(id_))
