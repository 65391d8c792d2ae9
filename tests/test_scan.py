"""The one-pass scan: every text rule by a hit and a miss, statements over lines, rule sets, large files."""

import time

import pytest
from pyspark.sql import functions as F

from secscan.functions.regex import required_literals
from secscan.operators import facts as FX
from secscan.operators import rules as B
from secscan.operators import scan as N
from secscan.operators import textscan as S
from secscan.sources import catalogue as K
from secscan.sources.fixtures import SEED_LINES


def _files(spark, rows):
    return spark.createDataFrame([("r", p, p.rsplit(".", 1)[-1], c) for p, c in rows], "repo string, path string, ext string, content string")


#: rule -> (file, lines that it finds, lines that it does not)
T_GOLDEN = {
    "PY-001": ("a.py", ["x = eval(user)", "exec (code)"], ['y = eval("1+1")', "evaluate(x)", "# eval(x)"]),
    "PY-002": ("a.py", ['os.system("ls")', "subprocess.run(c, shell=True)"], ["subprocess.run(c)", "myos.systems(x)"]),
    "PY-003": ("a.py", ["pickle.loads(b)", "pickle . load(f)"], ["pickled.loads(b)", "pickle.dumps(b)"]),
    "PY-006": ("a.py", ["t = xml.etree.ElementTree.parse(f)"], ["xml.sax(f)"]),
    "PY-007": ("a.py", ["random.randint(1, 2)"], ["secrets.token_hex()"]),
    "PY-008": ("a.py", ['return redirect(request.args["n"])'], ["return redirect(url)"]),
    "JAVA-002": ("A.java", ["new ProcessBuilder(c);", "Runtime.getRuntime().exec(c);"], ["Runtime.getRuntime().gc();"]),
    "JAVA-003": ("A.java", ["in.readObject();"], ["in.readObj();"]),
    "JAVA-004": ("A.java", ["DocumentBuilderFactory f;"], ["DocumentBuilder f;"]),
    "JAVA-007": ("A.java", ['Cipher.getInstance("DES");'], ['Cipher.getInstance("AES/GCM");']),
    "CPP-001": ("a.cpp", ["strcpy(a, b);"], ["strncpy(a, b, n);", "mystrcpy_s(a);"]),
    "CPP-002": ("a.c", ["system(cmd);"], ["ecosystem(cmd);"]),
    "PHP-001": ("a.php", ["eval($x);"], ["evaluate($x);"]),
    "RB-001": ("a.rb", ["system(cmd)", "x = `ls #{d}`"], ["systems(cmd)"]),
    "GO-001": ("a.go", ['fmt.Sprintf("SELECT %s", id)'], ['fmt.Sprintf("%s", id)']),
    "DART-001": ("a.dart", ["Process.run(c, []);"], ["Processor.run(c);"]),
    "DART-002": ("a.dart", ['var u = "http://e.org";'], ['var u = "http://localhost/a";', 'var u = "https://e.org";']),
    "DART-010": ("a.dart", ["HttpClient();"], ["HttpClients();"]),
    "VG-DOCKER-001": ("Dockerfile", ["USER root"], ["USER app"]),
    "VG-DOCKER-002": ("Dockerfile", ["FROM ubuntu", "FROM ubuntu:latest"], ["FROM ubuntu:20.04"]),
    "VG-DOCKER-003": ("Dockerfile", ["EXPOSE 22"], ["EXPOSE 8080"]),
    "VG-TF-001": ("m.tf", ['acl = "public-read"'], ['acl = "private"']),
    "VG-TF-002": ("m.tf", ['access_key = "ABCDEFGHIJKLMNOP"'], ["access_key = var.key"]),
}
P_GOLDEN = {
    "CS-XSS-001": ("a.js", ["el.innerHTML = x;", "document.write(x)"], ["el.innerText = x;"]),
    "CS-XSS-002": ("a.jsx", ["<p dangerouslySetInnerHTML={ x } />"], ["<p x={ y } />"]),
    "CS-SEC-002": ("a.py", ['PASSWORD = "hunter2hunter"'], ['password = "abc"']),
    "CS-EXEC-001": ("a.py", ["eval(x)", "EVAL (x)"], ["evaluate(x)"]),
    "CS-CRYPTO-001": ("a.py", ["hashlib.md5(x)", "les prix des clients"], ["désert", "md55"]),
    "CS-RAND-001": ("a.js", ["Math.random()"], ["Math.randomize()"]),
    "CS-DESER-001": ("a.py", ["pickle.loads(b)"], ["json.loads(b)"]),
    "CS-DART-010": ("a.dart", ["HttpClient()"], ["HttpClients()"]),
    "CS-PKG-001": ("a.json", ['"uuid": "^9.0.1",'], ['"uuid": "^9.0.2",']),
    "AST-JS-FUNC001": ("a.js", ['new Function("a", b)', "new\n  Function (a)"], ["new function()"]),
    "AST-JS-XSS001": ("a.js", ["document.write(a)", "document.write\n(a)"], ["document.writes(a)"]),
    "AST-JS-PROTO001": ("a.js", ["window[n](a)"], ["window.n(a)"]),
    "AST-JS-PROTO002": ("a.js", ["{ __proto__: x }"], ["{ proto: x }"]),
    "AST-JS-MSG001": ("a.js", ['w.postMessage(d, "*");', "w.postMessage(d,\n '*')"], ['w.postMessage(d, "https://e.org");']),
    "AST-JS-STOR001": ("a.js", ['localStorage.setItem("jwt", t)'], ['localStorage.setItem("size", t)']),
    "AST-JS-HASH001": ("a.js", ['crypto.createHash("md5")'], ['crypto.createHash("sha256")']),
}


@pytest.mark.parametrize("engine, golden", [("T", T_GOLDEN), ("P", P_GOLDEN)])
def test_rules_by_hits_and_misses(spark, engine, golden):
    rows, want = [], set()
    for rule, (name, hits, misses) in golden.items():
        for kind, texts in (("hit", hits), ("miss", misses)):
            for i, text in enumerate(texts):
                path = f"{rule}/{kind}{i}/{name}"
                rows.append((path, "start\n" + text + "\nend"))
                if kind == "hit":
                    want.add((path, rule, 2))
    files = _files(spark, rows)
    scan = N.scan_t(S.t_prepare(files), B.default_rules("T"), ("raw", "exec")) if engine == "T" else N.scan_p(S.p_prepare(files), B.default_rules("P"), ("ext", "content"))
    got = {(r.path, r.rule_id, r.line_no) for r in scan.collect() if r.path.startswith(r.rule_id + "/")}
    assert got == want


def test_every_match_holds_a_required_literal(spark):
    import re
    for r in K.T_RULES + K.P_RULES + K.P_CONTENT_RULES:
        if not r.pattern:
            continue
        some = required_literals(r.pattern, r.ignore_case)
        assert some, r.id
        for line in [x for s in SEED_LINES for x in (s, s.upper(), s.title())]:
            if re.search(r.pattern, line, re.I if r.ignore_case else 0):
                assert any(s in (line.lower() if r.ignore_case else line) for s in some), (r.id, line)


STATEMENTS = """const id =
  req.query;
db.query(
  `SELECT ${id}`,
  x);
eval(a); eval(b)
/* eval(c)
   eval(d) */
db.execute(id); // db.execute(id)
let s = "// not a comment"; eval(e);
db.run(fmt(a, b) + c);
db.run(fmt(a + b), c);
db.raw('plain (' );
const { name, q: alias,
        ...rest } = req.body;
pool.query(alias, 1);
pool.query(name);
pool.query(rest);
let t = `
  ${x} eval(f)
`; document.write(
  "safe");
document
  .write(t);
el.innerHTML =
   "fixed";
el.innerHTML =
   other;
id = "clean";
setTimeout(
  "go()", 1);
fs.readFileSync("a"); fs.readFileSync(name); fs.unlink(
  name);
const token = Math.random(), w = Math.random() * 2;
"""


def test_statements_over_lines_and_every_occurrence(spark):
    files = S.t_prepare(_files(spark, [("s.js", STATEMENTS), ("t.py", STATEMENTS)]))
    sinks = sorted((r.line_no, r.rule_id) for r in FX.code_sinks(files).collect())
    assert [x for x in sinks if x[1] == "VG-EVAL-001"] == [(n, "VG-EVAL-001") for n in (6, 6, 10, 20, 30)]
    assert [x[0] for x in sinks if x[1] == "VG-XSS-001"] == [23, 27]
    assert [x[0] for x in sinks if x[1] == "VG-PATH-001"] == [32, 32]
    assert sorted(r.severity for r in FX.code_sinks(files).filter("rule_id = 'VG-RAND-001'").collect()) == ["INFO", "MEDIUM"]
    flow = sorted((r.line_no, r.arg_kind) for r in FX.taint_flow(files).collect())
    # id is clean again at the end, so only the template, the concatenation and the two destructured names count
    assert flow == [(3, "template"), (11, "concat"), (16, "ident"), (17, "ident")]


def test_rule_sets(spark):
    config = spark.createDataFrame([("CS-EXEC-001", True, None, None), ("CS-SEC-002", True, True, None), ("CS-CRYPTO-001", None, None, "LOW"),
                                    ("AST-PY-EVAL", True, None, None), ("NOBODY", True, None, None)], "rule_id string, disabled boolean, enabled boolean, severity string")
    own = B.custom_rule("MY-1", r"frob\w+", [".PY", "js"], "HIGH", "Frob", "Frobbed on line {line}.", owasp="A04")
    rules = B.rule_set(spark, "P", config=config, custom=[own])
    text = 'eval(x)\npassword = "hunter2hunter"\nhashlib.md5(x)\nFROBnicate()'
    rows = {(r.rule_id, r.line_no): r for r in N.scan_p(S.p_prepare(_files(spark, [("a.py", text)])), rules).collect()}
    assert set(rows) == {("CS-SEC-002", 2), ("CS-CRYPTO-001", 3), ("MY-1", 4)}
    assert rows["CS-CRYPTO-001", 3].severity == "LOW" and rows["MY-1", 4].rule_name == "Frob" and rows["MY-1", 4].message == "Frobbed on line 4."
    assert all(r.rule_name and r.message and r.remediation for r in rows.values()) and rows["MY-1", 4].owasp == "A04"
    assert [r.id for r in B.rule_set(spark, "P", ids=["CS-EXEC-001"])] == ["CS-EXEC-001"]
    t = B.rule_set(spark, "T", config=config.withColumn("rule_id", F.lit("VG-EVAL-001")).filter("severity IS NOT NULL"), custom=[B.custom_rule("T-1", "frob", ["js"], engine="T")])
    got = {(r.rule_id, r.severity) for r in N.scan_t(S.t_prepare(_files(spark, [("a.js", "eval(x); frob()")])), t).collect()}
    assert got == {("VG-EVAL-001", "LOW"), ("T-1", "MEDIUM")}
    with pytest.raises(ValueError):
        B.rule_set(spark, "P", custom=[own, own])


def test_one_finding_per_rule_and_line(spark):
    files = S.p_prepare(_files(spark, [("a.py", "a = pickle.loads(x); b = pickle.loads(y)\neval(a); eval(b)")]))
    got = sorted((r.rule_id, r.line_no) for r in N.scan_p(files, B.default_rules("P")).collect())
    assert got == sorted(set(got)) and ("AST-PY-PICKLE_LOADS", 1) in got and ("AST-PY-EVAL", 2) in got and ("CS-DESER-001", 1) in got


def test_snippets_and_code_lines(spark):
    text = "\n".join(f"line {i}" for i in range(1, 6)) + "\neval(x)\n" + "\n".join(f"line {i}" for i in range(7, 12))
    row = S.scan_ext_rules(spark, _files(spark, [("a.py", text)])).first()
    assert row.snippet.split("\n") == ["line 3", "line 4", "line 5", "eval(x)", "line 7", "line 8", "line 9"]
    from secscan.operators import corpus as A
    doc = 'a\n"""x\neval(y)\n"""\nb # c\n\'\'\' one line \'\'\'\n\'\'\'\nopen block'
    got = [(r.line_no, r.line) for r in A.executable_lines(_files(spark, [("a.py", doc)]), "hash", ("path",)).orderBy("line_no").collect()]
    assert got == [(1, "a"), (5, "b "), (6, "''' one line '''")]


@pytest.mark.parametrize("lines", [1, 10_000])
def test_large_files_take_time_in_proportion(spark, lines):
    """5 MB and 10,000 hits, on one line or on as many."""
    hits = 10_000
    unit = 'document.write(a); x = eval(b + c); s = "' + "q" * 450 + '"; '
    text = ("\n" if lines > 1 else "").join([unit] * hits)
    files = _files(spark, [("a.js", text), ("a.py", text.replace(";", "\n") if lines > 1 else text)])
    assert len(text) > 4_900_000
    start = time.time()
    p = N.scan_p(S.p_prepare(files), B.default_rules("P")).filter("path = 'a.js'").groupBy("rule_id").count()
    assert {r.rule_id: r["count"] for r in p.collect()}["AST-JS-XSS001"] == lines
    t = N.scan_t(S.t_prepare(files), B.default_rules("T")).filter("path = 'a.js'").groupBy("rule_id").count()
    assert {r.rule_id: r["count"] for r in t.collect()}["VG-EVAL-001"] == hits
    assert time.time() - start < 120
