"""Rule tests: hits, misses and quirks on tiny in-memory files."""

from pyspark.sql import functions as F

from secscan.operators import facts as FX
from secscan.operators import textscan as S


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, ext string, content string")


def _ids(df):
    return sorted((r.line_no, r.rule_id) for r in df.select("line_no", "rule_id").collect())


def test_engine_p_rules(spark):
    content = "\n".join([
        'x = eval(user_input)',          # CS-EXEC-001
        'h = hashlib.md5(x)',            # CS-CRYPTO-001
        'les données des clients',       # "des" is a word: CS-CRYPTO-001 quirk
        'édes mot',                      # no boundary before "des" (Unicode word char)
        'password = "hunter2hunter2"',   # CS-SEC-002
        'print("ok")',
    ])
    got = _ids(S.scan_ext_rules(spark, _files(spark, [("r", "a.py", "py", content)])))
    assert (1, "CS-EXEC-001") in got
    assert (2, "CS-CRYPTO-001") in got
    assert (3, "CS-CRYPTO-001") in got
    assert (4, "CS-CRYPTO-001") not in got
    assert (5, "CS-SEC-002") in got
    assert not [g for g in got if g[0] == 6]


def test_engine_t_exec_lines_skip_comments_and_docstrings(spark):
    content = "\n".join([
        '"""',
        'eval(user)',                    # inside a docstring: skipped
        '"""',
        '# eval(user)',                  # comment: skipped
        'x = eval(user)  # note',        # PY-001
        'y = eval("1+1")',               # plain literal: no PY-001
        's = "#" ; pickle.loads(b)',     # '#' inside a string is not a comment: PY-003
    ])
    f = S.t_prepare(_files(spark, [("r", "a.py", "py", content)]))
    got = _ids(S.scan_raw_lines(spark, f, prepared=True))
    assert got == [(5, "PY-001"), (7, "PY-003")]


def test_java_xml_rule_silenced_by_marker(spark):
    a = "DocumentBuilderFactory f;\nf.setFeature(\"disallow-doctype-decl\", true);"
    b = "DocumentBuilderFactory f;"
    f = S.t_prepare(_files(spark, [("r", "A.java", "java", a), ("r", "B.java", "java", b)]))
    rows = S.scan_raw_lines(spark, f, prepared=True).collect()
    assert [(r.path, r.rule_id) for r in rows] == [("B.java", "JAVA-004")]


def test_captured_message(spark):
    f = S.t_prepare(_files(spark, [("r", "x.c", "c", "int a;\nstrcpy(d, s);")]))
    row = S.scan_raw_lines(spark, f, prepared=True).collect()[0]
    assert row.rule_id == "CPP-001" and "strcpy" in row.message and "2" in row.message


def test_multiline_pass_counts_lines_in_whole_content(spark):
    content = "a\nb = eval(x +\n y)\nwin.postMessage(d,\n '*')"
    f = _files(spark, [("r", "m.js", "js", content)])
    got = sorted((r.rule_id, r.line_no, r.col) for r in S.p_content_findings(f).collect())
    assert ("AST-JS-EVAL001", 2, 4) not in got  # '.' does not cross the newline
    assert ("AST-JS-MSG001", 4, 4) in got


def test_taint_fold_matches_sequential_reading(spark):
    content = "\n".join([
        "const a = req.body;",          # a tainted
        "let b = a;",                   # b tainted (copy)
        "a = 'x';",                     # a clean again
        "const { c, d: e } = req.query;",  # c, e tainted
        "let f = req.query.file;",      # three parts: not a source
        "db.query(a);",                 # clean -> no finding
        "db.query(b);",                 # tainted -> finding
        "db.query(e);",                 # tainted -> finding
        "db.query(f);",                 # not tainted
        "db.query(`x ${f}`);",          # template with expression -> finding
        "db.query('static');",          # literal -> none
    ])
    f = S.t_prepare(_files(spark, [("r", "s.js", "js", content)]))
    lines = sorted(r.line_no for r in FX.taint_flow(f).collect())
    assert lines == [7, 8, 10]


def test_random_context_severity(spark):
    content = "const token = Math.random();\nconst w = Math.random() * 10;\nx.sessionId = Math.random();"
    f = S.t_prepare(_files(spark, [("r", "r.js", "js", content)]))
    got = sorted((r.line_no, r.severity) for r in FX.code_sinks(f).filter(F.col("rule_id") == "VG-RAND-001").collect())
    assert got == [(1, "MEDIUM"), (2, "INFO"), (3, "MEDIUM")]


def test_report_sink_roundtrip(spark, tmp_path):
    from secscan.operators import corpus as A
    from secscan.operators import rules as B
    from secscan.operators import scoring as E
    files = _files(spark, [("r1", "a.py", "py", "x = eval(y)"), ("r2", "b.py", "py", "ok = 1")])
    f = S.scan_ext_rules(spark, files)
    scores = E.decay_score(files, f)
    A.report_sink(f, scores, str(tmp_path / "report"))
    A.rules_sink(B.rules_all(spark), str(tmp_path / "rules"))
    back = spark.read.json(str(tmp_path / "report" / "scores"))
    assert sorted((r.repo, r.score) for r in back.select("repo", "report.score").collect()) == [("r1", 90), ("r2", 100)]
    assert spark.read.json(str(tmp_path / "rules")).count() == 71
