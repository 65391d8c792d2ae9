"""Applied fixes, fix history, scan history, response parsing, diagnostics and cache tables, report files."""

import random

from pyspark.sql import functions as F

from secscan.operators import corpus as A
from secscan.operators import enrich as GE
from secscan.operators import fixes as X
from secscan.operators import history as H
from secscan.streaming import streams as I


def _apply(lines, fixes):
    """Fixes (id, start, end, code) by hand: the lines and the ids used."""
    used, last, out = [], 0, []
    for i, start, end, code in sorted(fixes, key=lambda f: (f[1], f[2], f[0])):
        if start <= last or start < 1 or start > len(lines) or end < start:
            continue
        out += lines[last:start - 1]
        indent = lines[start - 1][:len(lines[start - 1]) - len(lines[start - 1].lstrip())]
        out += [indent + x if x.strip() else x for x in code.split("\n")]
        last = min(end, len(lines))
        used.append(i)
    return "\n".join(out + lines[last:]), used


def test_fixes_are_applied(spark):
    rng = random.Random(3)
    files, fixes = [], []
    for n in range(60):
        lines = [" " * rng.randrange(5) + f"line {k}" * rng.randrange(2) for k in range(rng.randrange(1, 15))]
        files.append((f"f{n}", lines))
        for k in range(rng.randrange(7)):
            start = rng.randrange(-1, 17)
            fixes.append((f"f{n}", f"{n}-{k}", start, start + rng.randrange(-1, 4), rng.choice(["a", "a\n\n  b", "", "x\ny"])))
    df = spark.createDataFrame([("r", p, "\n".join(x)) for p, x in files], "repo string, path string, content string")
    fx = spark.createDataFrame([("r", *f) for f in fixes], "repo string, path string, fix_id string, start_line int, end_line int, fixed_code string")
    done = X.apply_fixes(df, fx)
    got = {r.path: (r.fixed, list(r.applied)) for r in done.collect()}
    for path, lines in files:
        own = [f[1:] for f in fixes if f[0] == path]
        if path in got:
            assert got[path] == _apply(lines, own)
        else:
            assert _apply(lines, own)[1] == []
    taken = {r.fix_id for r in X.fix_outcomes(fx, done).filter("taken").collect()}
    assert taken == {i for _, ids in got.values() for i in ids} and X.fix_outcomes(fx, done).count() == len(fixes)


def test_fix_history_is_appended_once(spark, tmp_path):
    schema = "fix_id string, repo string, path string, original string, fixed string, applied_at timestamp"
    t = "2024-01-0{} 00:00:00"
    one = spark.createDataFrame([("1", "r", "a", "old", "new", t.format(1)), ("2", "r", "a", "new", "newer", t.format(2)), ("2", "r", "a", "other", "x", t.format(2)),
                                 (None, "r", "a", "", "", t.format(1))], schema.replace("timestamp", "string")).withColumn("applied_at", F.col("applied_at").cast("timestamp"))
    path = f"{tmp_path}/history"
    assert X.append_fix_history(one, path) == 2 and X.append_fix_history(one, path) == 0
    more = one.union(one.limit(1).withColumn("fix_id", F.lit("3")).withColumn("path", F.lit("b")))
    assert X.append_fix_history(more, path) == 1
    files = spark.createDataFrame([("r", "a", "newest"), ("r", "b", "b")], "repo string, path string, content string")
    back = X.restore(files, spark.read.parquet(path), spark.createDataFrame([("1",), ("2",), ("9",)], "fix_id string"))
    assert [(r.path, r.fix_id, r.content) for r in back.collect()] == [("a", "1", "old")]


def test_responses_in_every_form(spark):
    bodies = ['{"why_dangerous":"a","confidence_score":3}', '```json\n{"why_dangerous":"b"}\n```', 'Well: {"why_dangerous":"c {x}"} ok', 'So [{"why_dangerous":"d"},{"x":1},3] it is',
              '{"why_dangerous":', "", None, "plain", '[{"why_dangerous":"e"}]', '{"confidence_score":"high","why_dangerous":"f"}', "[]", '{"a":1} trailing', '  {"why_dangerous":"g"}\n']
    got = {r.i: r for r in GE.parse_responses(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).select(
        "i", "form", F.size("items").alias("n"), "answer").collect()}
    assert [got[i].form for i in range(13)] == ["whole", "fence", "object", "array", None, None, None, None, "whole", "whole", "whole", "object", "whole"]
    assert [got[i].answer and got[i].answer.why_dangerous for i in range(13)] == ["a", "b", "c {x}", "d", None, None, None, None, "e", "f", None, None, "g"]
    assert got[3].n == 2 and got[0].answer.confidence_score == 3 and got[9].answer.confidence_score is None


def test_diagnostics_table_as_a_stream(spark, tmp_path):
    """A repeated batch changes nothing, a file that became clean has no rows, and the stream equals its batch twin."""
    schema = "repo string, path string, content string, ts int"
    batches = [[("r", "a.js", "eval(x)", 1), ("r", "b.js", "eval(y)\neval(z)", 1), ("r", "b.js", "old", 0)],
               [("r", "a.js", "fine()", 2), ("r", "c.tf", 'acl = "public-read"', 2)], [("r", "b.js", "document.write(q)", 3)]]
    src, table = f"{tmp_path}/src", f"{tmp_path}/table"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        I.diagnostics_stream(stream, table, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    def current():
        return sorted((r.path, r.line_no, r.rule_id) for r in I.current_diagnostics(spark.read.parquet(table)).collect())
    want = [("b.js", 1, "VG-XSS-001"), ("c.tf", 1, "VG-TF-001")]
    assert current() == want
    I.write_batch(I.scanned_files(spark.createDataFrame(batches[1], schema)), 1, table)
    assert current() == want
    whole = I.scanned_files(spark.createDataFrame([r for b in batches for r in b], schema)).filter("rule_id IS NOT NULL")
    assert sorted((r.path, r.line_no, r.rule_id) for r in whole.collect()) == want
    I.compact(spark.read.parquet(table), 2, f"{tmp_path}/small")
    small = spark.read.parquet(f"{tmp_path}/small")
    assert sorted((r.path, r.line_no, r.rule_id) for r in I.current_diagnostics(small).collect()) == want and small.count() == 3


def test_stored_rows_are_a_chain(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", "c"]), rng.randrange(40_000), i) for i in range(600)] + [("gap", 5, 1000), ("gap", 900_000, 1001), ("gap", 900_099, 1002), ("n", None, 7)]
    for ttl in (100, 1000, 50_000):
        want, last = [], {}
        for key, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
            if key not in last or t - last[key] >= ttl:
                last[key] = t
                want.append((key, t, i))
        got = I.stored_rows(spark.createDataFrame(rows, "key string, ts_ms bigint, event_id int"), ttl)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert I.stored_rows(spark.createDataFrame([], "key string, ts_ms bigint, event_id int"), 10).count() == 0


def test_stored_rows_read_no_frame_again(spark, monkeypatch):
    """A window frame that is open ahead costs the square of its rows: none is left, also not over the times of one key."""
    plans, keep = [], I.stored
    monkeypatch.setattr(I, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower()), keep(df, name))[1])
    rows = [("hot", 100 * i + (i % 3), i) for i in range(60)] + [("hot", 100 * i, 1000 + i) for i in range(60)] + [(None, 5, 1)]
    got = I.stored_rows(spark.createDataFrame(rows, "key string, ts_ms bigint, event_id int"), 250)
    want, last = [], None
    for t, i in sorted((t, i) for k, t, i in rows if k):
        if last is None or t - last >= 250:
            last = t
            want.append((t, i))
    assert sorted((r.ts_ms, r.event_id) for r in got.collect() if r.key) == want
    assert sum("window [" in p for p in plans) >= 2 and not any("unboundedfollowing" in p for p in plans)


def test_a_large_repository_is_written_by_many_tasks(spark, tmp_path):
    rows = [("big" if i % 3 else f"r{i}", f"p{i % 500}", i, f"R{i % 7}") for i in range(9000)]
    found = spark.createDataFrame(rows, "repo string, path string, line_no int, rule_id string")
    scores = found.select("repo").distinct().withColumn("score", F.lit(50))
    stats = found.groupBy("repo").agg(F.count(F.lit(1)).alias("lines_scanned"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        A.report_sink(found, scores, f"{tmp_path}/r", stats=stats, rows_per_file=400)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = list((tmp_path / "r/findings/repo=big").glob("*.json"))
    assert len({f.name.split("-")[1] for f in files}) > 3 and max(len(f.read_text().splitlines()) for f in files) <= 400
    assert sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/r/findings").select("repo", "path", "line_no", "rule_id").collect()) == sorted(rows)
    docs = {r.repo: r.report for r in spark.read.json(f"{tmp_path}/r/scores").collect()}
    assert docs["big"].score == 50 and docs["big"].lines_scanned == 6000


def test_reports_need_all_columns(spark, tmp_path):
    import pytest
    with pytest.raises(ValueError):
        H.append_scan(spark.createDataFrame([(1,)], "id int"), f"{tmp_path}/h")
