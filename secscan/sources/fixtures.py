"""Test inputs derived by SQL from the given tables.

The given tables hold prose, orders and events, not source code.  Each fixture
here is one SQL text that runs unchanged on Spark SQL and on DuckDB, so the
oracle sees exactly the rows Spark sees.  All of them grow with the tables:
every document becomes a source file, every line item a finding, and so on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixture seed lines appended to the prose of each document (our own test text).
SEED_LINES = (
    'x = eval(user_input)',
    '# eval(user_input)',
    'os.system("ls " + d)',
    'subprocess.run(cmd, shell=True)',
    'data = pickle.loads(blob)',
    'query = f"SELECT * FROM t WHERE id={uid}"',
    'password = "hunter2hunter2"',
    'api_key = "A1b2C3d4E5f6G7h8I9j0K1l2"',
    'el.innerHTML = userHtml;',
    'document.write(data);',
    'setTimeout("go()", 10);',
    'const id = req.query;',
    'db.query("SELECT " + id);',
    'const token = Math.random();',
    'fs.readFileSync(name);',
    'path.join(base, name);',
    'Statement st = c.executeQuery("SELECT " + id);',
    'new ProcessBuilder(cmd);',
    'DocumentBuilderFactory f;',
    'f.setFeature("disallow-doctype-decl", true);',
    'Cipher.getInstance("DES");',
    'strcpy(dst, src);',
    'system(cmd);',
    '$db->query("SELECT $id");',
    'exec(cmd)',
    'fmt.Sprintf("SELECT %s", id)',
    'Process.run(cmd, []);',
    'var u = "http://example.org/a";',
    'var v = "http://localhost/a";',
    'HttpClient();',
    'USER root',
    'FROM ubuntu',
    'FROM ubuntu:20.04',
    'EXPOSE 22',
    'acl = "public-read"',
    'access_key = "ABCDEFGHIJKLMNOP"',
    'print("login ok") # password',
    '"uuid": "^9.0.1",',
    'random.randint(1, 9)',
    'return 0',
    'client.badCertificateCallback = (c, h, p) => true;',
    'Random().nextInt(9);',
    'db.rawQuery("SELECT $id");',
    'File("/tmp/$name")',
    'SharedPreferences p; p.setString("token", t);',
    'print(password);',
    'new File(request.getParameter("f"));',
    'return redirect(request.args["next"])',
    'tree = xml.etree.ElementTree.parse(p)',
    'in = new ObjectInputStream(s);',
    'out = requests.get(base + path)',
    'h = hashlib.md5(x)',
    'f = open(base + name)',
    '<div dangerouslySetInnerHTML={ html } />',
    'eval("a" + b)',
    'const f = new Function("a", body);',
    'window[name](arg);',
    '{ __proto__: x }',
    'win.postMessage(data, "*");',
    'localStorage.setItem("jwt", t); // crypto.createHash("md5")',
)

FILE_KINDS = ("py", "js", "ts", "java", "dart", "php", "go", "rb", "c", "tf", "html", "json", "")


def _values(rows) -> str:
    return ",".join("(" + ",".join(_lit(v) for v in row) + ")" for row in rows)


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


SEEDS_VALUES = _values(list(enumerate(SEED_LINES)))
KINDS_VALUES = _values(list(enumerate(FILE_KINDS)))

FIXTURE_SQL: dict[str, str] = {}

FIXTURE_SQL["code_files"] = f"""
SELECT concat('org/', d.source) AS repo,
       concat(CASE WHEN d.doc_id % 37 = 0 THEN 'node_modules/' ELSE 'src/' END,
              CASE WHEN e.ext = '' THEN concat('Dockerfile.', CAST(d.doc_id AS STRING))
                   ELSE concat('f', CAST(d.doc_id AS STRING), '.', e.ext) END) AS path,
       e.ext AS ext,
       concat(d.text, chr(10), a.line, chr(10), b.line) AS content
FROM documents d
JOIN (VALUES {KINDS_VALUES}) AS e(k, ext) ON d.doc_id % 13 = e.k
JOIN (VALUES {SEEDS_VALUES}) AS a(k, line) ON (CAST(floor(d.doc_id / 13) AS BIGINT) * 7) % 60 = a.k
JOIN (VALUES {SEEDS_VALUES}) AS b(k, line) ON (CAST(floor(d.doc_id / 13) AS BIGINT) * 13 + 5) % 60 = b.k
"""

FIXTURE_SQL["html_files"] = """
SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS repo,
       concat(CAST(page_id AS STRING), '.html') AS path,
       'html' AS ext,
       html AS content,
       url
FROM pages
"""

FIXTURE_SQL["findings_synth"] = """
SELECT concat('r', CAST(l_suppkey AS STRING)) AS repo,
       concat('src/p', CAST(l_partkey AS STRING), '.py') AS path,
       CAST(l_linenumber AS INT) AS line_no,
       concat(l_returnflag, '-', l_linestatus) AS rule_id,
       CASE CAST(l_orderkey % 5 AS INT) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM'
            WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity,
       l_orderkey AS seq
FROM lineitem
"""

FIXTURE_SQL["history_synth"] = """
SELECT o_orderkey AS id,
       concat('c', CAST(o_custkey AS STRING)) AS repo_name,
       o_orderdate AS ts,
       CAST((o_orderkey * 31) % 101 AS INT) AS score,
       (o_orderkey * 31) % 101 >= 70 AS passed,
       CAST(o_orderkey % 23 AS INT) AS total_findings,
       CAST(o_orderkey % 7 AS INT) AS critical,
       CAST(o_orderkey % 5 AS INT) AS high,
       CAST(o_orderkey % 3 AS INT) AS medium,
       CAST(o_orderkey % 2 AS INT) AS low
FROM orders
"""

FIXTURE_SQL["requests"] = """
SELECT event_id, user_id % 50 AS client, event_id * 200 + (event_id * event_id) % 1700 AS ts_ms
FROM events
"""

FIXTURE_SQL["manifests"] = """
SELECT concat('org/b', CAST(p_size AS STRING)) AS repo,
       concat(CASE WHEN p_partkey % 11 = 0 THEN 'a/b/c/d/e/' ELSE '' END, CASE WHEN p_partkey % 17 = 0 THEN 'node_modules/' ELSE '' END,
              'm', CAST(p_partkey AS STRING), '/package.json') AS path,
       CASE WHEN p_partkey % 29 = 0 THEN '{"dependencies":{"alpha":' ELSE
       concat('{"dependencies":{"alpha":"^', CAST(p_partkey % 4 AS STRING), '.', CAST(p_size % 7 AS STRING),
              '.1","beta":"~2.0.0","delta":"1.2.', CAST(p_partkey % 5 AS STRING), '.', CAST(p_partkey % 13 AS STRING),
              '","eps":"2.0.0-rc.', CAST(p_partkey % 12 AS STRING), '","pkg', CAST(p_partkey % 40 AS STRING), '":"', CAST(p_partkey % 3 AS STRING), '.',
              CAST(p_size % 9 AS STRING), '.', CAST(p_partkey % 6 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN concat('-beta.', CAST(p_partkey % 4 AS STRING)) ELSE '' END,
              '"},"devDependencies":{"alpha":">=', CAST(p_partkey % 3 AS STRING), '.2.0 <9","gamma":"*","zeta":"',
              CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'latest' WHEN 1 THEN 'git+https://example.org/z.git#v1' WHEN 2 THEN '1.x' ELSE 'v3.0.0+build.5' END,
              '"},"peerDependencies":{"eta":"12345678901234567890.0.', CAST(p_partkey % 3 AS STRING), '"}}') END AS content
FROM part
"""


def _osv(id_: str, name: str, ranges: str, more: str = "", versions: str = "[]") -> str:
    return (f'{{"id":"{id_}"{more},"affected":[{{"package":{{"ecosystem":"npm","name":"{name}"}},"ranges":{ranges},"versions":{versions}}}]}}')


def _range(*events: str, kind: str = "SEMVER") -> str:
    return f'{{"type":"{kind}","events":[{",".join("{" + e + "}" for e in events)}]}}'


_ADVISORIES = (
    _osv("ADV-0001", "alpha", "[" + _range('"introduced":"1.0.0"', '"fixed":"1.2.0"') + "," + _range('"introduced":"2.0.0"', '"fixed":"2.5.0"') + "]",
         ',"summary":"Prototype pollution in alpha","database_specific":{"severity":"MODERATE"}'),
    _osv("ADV-0002", "alpha", "[" + _range('"fixed":"1.2.5"', '"introduced":"0"') + "]",
         ',"details":"Unchecked input reaches a shell call in alpha helpers. ' + "More text. " * 40 + '","severity":[{"type":"X","score":"x"},{"type":"C","score":"9.1"}]'),
    _osv("ADV-0003", "beta", "[" + _range('"introduced":"2.0.0"') + "]", ',"severity":[{"type":"C","score":"abc"}]'),
    _osv("ADV-0004", "gamma", "[" + _range('"introduced":"0"', '"fixed":"1.0.0"') + "]", ',"database_specific":{"severity":"HIGH"}'),
    _osv("ADV-0005", "delta", "[" + _range('"introduced":"1.2.1.4"', '"fixed":"1.2.3.10"', kind="ECOSYSTEM") + "]", ',"severity":[{"type":"C","score":"5.0"}]'),
    _osv("ADV-0006", "eps", "[" + _range('"introduced":"2.0.0-rc.3"', '"fixed":"2.0.0-rc.10"') + "]", ',"summary":"Early eps releases","database_specific":{"severity":"LOW"}'),
    _osv("ADV-0007", "eps", "[" + _range('"introduced":"1.0.0"', '"last_affected":"2.0.0-rc.2"') + "]", ',"severity":[{"type":"C","score":"7.5"}]'),
    _osv("ADV-0008", "zeta", "[" + _range('"introduced":"0123abc"', kind="GIT") + "," + _range('"introduced":"3"', '"fixed":"3.0.1"') + "]",
         ',"summary":"Zeta by tag"', '["latest"]'),
    _osv("ADV-0009", "eta", "[" + _range('"introduced":"12345678901234567890.0.1"', '"fixed":"12345678901234567891"') + "]"),
    '{"id":"ADV-0010","affected":[{"package":{"ecosystem":"PyPI","name":"alpha"},"ranges":[' + _range('"introduced":"0"') + "]}]}",
    '{"id": broken',
)

# Advisory records in JSON: a fixed few of special forms, and one per supplier, so both sides of the join grow.
FIXTURE_SQL["advisory_records"] = f"""
SELECT * FROM (VALUES {_values((a,) for a in _ADVISORIES)}) AS a(body)
UNION ALL
SELECT concat('{{"id":"ADV-S', CAST(s_suppkey AS STRING), '","summary":"Pkg issue ', CAST(s_suppkey AS STRING),
              '","database_specific":{{"severity":"', CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'Low' ELSE '' END,
              '"}},"severity":[{{"type":"C","score":"', CAST(s_suppkey % 10 AS STRING), '.5"}}],"affected":[',
              '{{"package":{{"ecosystem":"npm","name":"pkg', CAST(s_suppkey % 40 AS STRING), '"}},"ranges":[{{"type":"SEMVER","events":[{{"fixed":"1.',
              CAST(s_suppkey % 8 AS STRING), '.3"}},{{"introduced":"1.0.0-beta.2"}},{{"introduced":"0"}},{{"fixed":"0.', CAST(s_suppkey % 7 AS STRING), '"}}]}}],"versions":["2.7.1"]}},',
              '{{"package":{{"ecosystem":"npm","name":"pkg', CAST((s_suppkey + s_suppkey % 2) % 40 AS STRING), '"}},"ranges":[{{"type":"ECOSYSTEM","events":[{{"introduced":"2.',
              CAST(s_suppkey % 5 AS STRING), '"}},{{"last_affected":"2.6.1"}}]}}]}}]}}') AS body
FROM supplier
"""

FIXTURE_SQL["fixes"] = """
SELECT l_orderkey * 10 + l_linenumber AS fix_id,
       concat('r', CAST(l_suppkey AS STRING)) AS repo,
       CASE CAST(l_orderkey % 5 AS INT) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM'
            WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity,
       concat('x = run(', CAST(l_partkey AS STRING), ')', chr(10), 'y = 1', chr(10), 'z = 2') AS original,
       CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN concat('x = eval(', CAST(l_partkey AS STRING), ')', chr(10), 'y = 1')
            WHEN 1 THEN concat('DROP TABLE t', CAST(l_partkey AS STRING), chr(10), 'y = 1', chr(10), 'z = 2')
            WHEN 2 THEN concat('x = safe_run(', CAST(l_partkey AS STRING), ')', chr(10), 'y = 1', chr(10), 'z = 2', chr(10), 'w = 3')
            ELSE concat('x = run(', CAST(l_partkey AS STRING), ')', chr(10), 'z = 2', chr(10), 'y = 1') END AS fixed
FROM lineitem
"""

# Files with indented lines, and four fixes for each: overlapping, adjacent, behind the end, reversed.
FIXTURE_SQL["indented_files"] = f"""
SELECT repo, path, replace(content, '. ', concat('.', chr(10), '    ')) AS content FROM ({FIXTURE_SQL["code_files"]}) c
"""

FIXTURE_SQL["file_fixes"] = f"""
SELECT repo, path, concat(path, '#', CAST(k AS STRING)) AS fix_id,
       CAST(1 + (length(content) * 7 + k * 3) % 11 AS INT) AS start_line,
       CAST(1 + (length(content) * 7 + k * 3) % 11 + (length(content) + k * k) % 5 - 1 AS INT) AS end_line,
       concat('first(', CAST(k AS STRING), ')', chr(10), chr(10), '  second()', CASE WHEN k = 2 THEN chr(10) ELSE '' END) AS fixed_code
FROM ({FIXTURE_SQL["code_files"]}) c CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)
"""

FIXTURE_SQL["repo_urls"] = """
SELECT c_custkey AS id,
       CASE CAST(c_custkey % 8 AS INT)
         WHEN 0 THEN concat('https://github.com/', lower(c_mktsegment), '/repo', CAST(c_custkey AS STRING))
         WHEN 1 THEN concat('http://github.com/o/r', CAST(c_custkey AS STRING))
         WHEN 2 THEN concat('https://gitlab.com/o/r', CAST(c_custkey AS STRING))
         WHEN 3 THEN concat('https://github.com/onlyowner', CAST(c_custkey AS STRING))
         WHEN 4 THEN 'https://github.com/Torvalds/Linux'
         WHEN 5 THEN concat('https://github.com/a/b/../c', CAST(c_custkey AS STRING))
         WHEN 6 THEN concat('https://github.com/a/b/%2E%2E/x', CAST(c_custkey AS STRING))
         ELSE concat('  https://github.com/Owner-', CAST(c_custkey AS STRING), '/repo.name/tree/main?x=1  ')
       END AS url
FROM customer
UNION ALL
SELECT 1000000000 + page_id AS id, url FROM pages
"""

FIXTURE_SQL["turns"] = """
SELECT conv_id, turn, role, text FROM conversations
"""


# Requests with a hot key: a third of all rows.
FIXTURE_SQL["hot_requests"] = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id % 50 END AS key, event_id * 200 + (event_id * event_id) % 1700 AS ts_ms
FROM events
"""

# Answers of a model in every form: an object, fenced, within prose, an array, broken, empty, null, no JSON.
FIXTURE_SQL["responses"] = """
SELECT conv_id, turn, CASE CAST((conv_id + turn * 3) % 9 AS INT)
   WHEN 0 THEN concat('{"why_dangerous":"', role, ' ', CAST(length(text) AS STRING), '","confidence_score":', CAST(turn AS STRING), '}')
   WHEN 1 THEN concat('```json', chr(10), '{"why_dangerous":"', role, '",', chr(10), '"fixed_code":"a {b} [c]"}', chr(10), '```')
   WHEN 2 THEN concat('Sure: {"why_dangerous":"', role, '","confidence_score":"high"} hope it helps')
   WHEN 3 THEN concat('Found [{"why_dangerous":"first"}, {"why_dangerous":"', role, '"}, 7] in all')
   WHEN 4 THEN concat('{"why_dangerous":"', role, '"')
   WHEN 5 THEN ''
   WHEN 6 THEN NULL
   WHEN 7 THEN concat('  [{"explanation":"', CAST(length(text) AS STRING), '"}]  ')
   ELSE concat('no answer for ', role) END AS body
FROM conversations
"""


#: fixtures that are dealt over tasks, and by what
DEALT = {"code_files": ("repo", "path"), "manifests": ("repo", "path"), "advisory_records": ("body",)}
#: tables of short rows that long texts are made of: dealt before, so that the texts are made by many tasks, too
DEALT_BASE = {"manifests": ("part", "p_partkey")}


def register_base_views(spark: SparkSession, sf_dir: str, tables=BASE_TABLES) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a Spark DataFrame over the parquet tables of ``sf_dir`` that it names.

    Code files and manifests come evenly dealt by (repo, path), advisory records by their text, as large tables would be
    stored: the tables that they are made of are a few MB, which Spark reads in one task or two."""
    sql = FIXTURE_SQL[name]
    register_base_views(spark, sf_dir, [t for t in BASE_TABLES if re.search(rf"\b{t}\b", sql)])
    if name in DEALT_BASE:
        table, key = DEALT_BASE[name]
        spark.table(table).repartition(key).createOrReplaceTempView(table)
    df = spark.sql(sql)
    return df.repartition(*DEALT[name]) if name in DEALT else df


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the fixture CTEs it uses."""
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in names)
    joiner = "\n" if sql.lstrip().upper().startswith("SELECT") else ",\n"
    return f"WITH {ctes}{joiner}{sql.lstrip()}"
