"""Streaming scan equals its batch twin; debounce emits the last version."""

import tempfile

import pytest
from pyspark.sql import functions as F

from secscan.streaming import streams as I


@pytest.mark.parametrize("engine, found", [("P", ("a.py", 1, "CS-EXEC-001")), ("T", ("b.js", 1, "VG-XSS-001"))])
def test_stream_scan_equals_batch(spark, engine, found):
    rows = [("r", "a.py", "x = eval(y)\nok"), ("r", "b.js", "el.innerHTML = v;"), ("r", "c.txt", "eval(z)")]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    src = tempfile.mkdtemp(prefix="secscan-stream-src-")
    df.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (I.stream_scan(stream, engine).writeStream.format("memory").queryName(f"scan_{engine}")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.path, r.line_no, r.rule_id) for r in spark.sql(f"SELECT * FROM scan_{engine}").collect())
    want = sorted((r.path, r.line_no, r.rule_id) for r in I.stream_scan(df, engine).collect())
    assert got == want and found in got


def test_debounce_batch_twin(spark):
    ev = spark.createDataFrame([("f", 0, "v1"), ("f", 1000, "v2"), ("f", 9000, "v3")],
                               "path string, ms long, content string").withColumn("ts", F.timestamp_millis("ms"))
    out = sorted(r.last for r in I.debounced_scan(ev).collect())
    assert out == ["v2", "v3"]
