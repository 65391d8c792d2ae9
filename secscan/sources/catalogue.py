"""Rule catalogue rows (item B1).

The catalogue is data: every rule is one row.  Text rules are applied as an array
of these rows; structural rules (scopes struct, entropy, pyfact) have their facts in
code, under the rule's id.

FIXED VALUES.  Rule ids, names, severities, CWE numbers, tags, extension lists and
the regular expressions below must equal the scanned behaviour exactly, so they are
stated verbatim, in registry order.  Message and remediation texts are our own short
wording.  Patterns of engine "T" are JavaScript regular expressions, patterns of
engine "P" are Python ``re`` expressions; ``secscan.functions.regex`` turns them
into the Java dialect Spark runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    engine: str            # "T" (density engine) or "P" (decay engine)
    id: str
    name: str
    severity: str
    cwe: str | None
    tags: tuple[str, ...]
    gate: str              # family key (T) or "ext" (P, uses `languages`)
    scope: str             # raw | exec | content | struct | entropy | dependency
    pattern: str | None
    ignore_case: bool
    message: str
    languages: tuple[str, ...] = field(default=())
    owasp: str | None = None
    enabled: bool = True
    unless: tuple[str, ...] = ()   # silent in files that hold one of these
    remediation: str | None = None


SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

# FIXED VALUES: severity weights of the two scores.
DENSITY_PENALTY = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3, "INFO": 1}
DECAY_PENALTY = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 7, "LOW": 3, "INFO": 1}

# FIXED VALUES: file families of engine T (path tests).
T_FAMILIES = {
    "py": r"(?i)\.py$",
    "java": r"(?i)\.java$",
    "cpp": r"(?i)\.(cpp|cc|c|h|hpp)$",
    "php": r"(?i)\.php$",
    "rb": r"(?i)\.rb$",
    "go": r"(?i)\.go$",
    "dart": r"(?i)\.dart$",
    "js": r"(?i)\.(js|ts|jsx|tsx|mjs|cjs)$",
}

_T = "T"
_P = "P"

# FIXED VALUES: markers that silence JAVA-004 for the whole file.
XML_HARDENING_MARKERS = ("FEATURE_SECURE_PROCESSING", "disallow-doctype-decl", "external-general-entities")

# FIXED VALUES: engine T rules, registry order.  {1} = first capture group,
# {line} = 1-based line number in messages.
T_RULES: list[Rule] = [
    Rule(_T, "VG-SQL-001", "SQL Injection", "CRITICAL", "CWE-89", ("sql", "injection", "security"),
         "js", "struct", None, False, "Dynamic value or concatenation inside a SQL call."),
    Rule(_T, "VG-XSS-001", "Cross-Site Scripting (XSS)", "HIGH", "CWE-79", ("xss", "dom", "injection", "owasp-a03"),
         "js", "struct", None, False, "HTML sink receives a non-literal value."),
    Rule(_T, "VG-SEC-001", "Hardcoded Secret", "CRITICAL", "CWE-798", ("secrets", "credentials"),
         "any", "entropy", None, False, "High-entropy literal looks like a real secret."),
    Rule(_T, "VG-EVAL-001", "Dangerous Code Evaluation", "HIGH", "CWE-95", ("eval", "code-injection", "rce", "owasp-a03"),
         "js", "struct", None, False, "Code is evaluated from a string."),
    Rule(_T, "VG-PATH-001", "Path Traversal", "HIGH", "CWE-22", ("path-traversal", "lfi", "file-system", "owasp-a01"),
         "js", "struct", None, False, "File system call with a non-literal path."),
    Rule(_T, "VG-RAND-001", "Insecure Random Number Generator", "MEDIUM", "CWE-338",
         ("randomness", "cryptography", "weak-crypto", "cwe-338"),
         "js", "struct", None, False, "Math.random() is not a secure generator."),
    Rule(_T, "PY-001", "Python eval/exec Injection", "CRITICAL", "CWE-95", ("injection", "python", "code-execution"),
         "py", "exec", r"""\b(eval|exec)\s*\((?!['"][^'"]*['"]\s*\))""", False,
         "eval/exec with a dynamic argument on line {line}."),
    Rule(_T, "PY-002", "Python Command Injection", "CRITICAL", "CWE-78",
         ("injection", "python", "command-injection", "owasp-a03"),
         "py", "exec", r"""\bos\s*\.\s*system\s*\(|\bsubprocess\s*\.\s*(call|run|Popen)\s*\(.*shell\s*=\s*True""", False,
         "Shell command on line {line}."),
    Rule(_T, "PY-003", "Python Insecure Deserialization (pickle)", "HIGH", "CWE-502",
         ("deserialization", "python", "owasp-a08"),
         "py", "exec", r"""\bpickle\s*\.\s*loads?\s*\(""", False, "pickle load on line {line}."),
    Rule(_T, "PY-004", "Python SQL Injection", "CRITICAL", "CWE-89", ("injection", "sql", "python", "owasp-a03"),
         "py", "exec",
         r"""(?:query|sql|cursor\.execute)\s*(?:=|\()\s*(?:f['"]|['"][^'"]*['"\\s]*%\s*\(|['"][^'"]*['"\\s]*\.format\s*\(|[^'"]*\+\s*(?:user|input|request|param|id|name))""",
         True, "SQL text built dynamically on line {line}."),
    Rule(_T, "PY-005", "Python Hardcoded Secret", "HIGH", "CWE-798", ("secrets", "python", "credentials", "owasp-a02"),
         "py", "exec", r"""(?:password|passwd|secret|api_key|apikey|token|auth_token|private_key)\s*=\s*['"][^'"]{4,}['"]""",
         True, "Credential literal on line {line}."),
    Rule(_T, "PY-006", "Python XML External Entity (XXE)", "HIGH", "CWE-611", ("xxe", "python", "xml", "owasp-a05"),
         "py", "exec", r"""\b(?:xml\.etree|minidom|expat|lxml\.etree).*parse\b|\bElementTree\s*\(\s*file""", True,
         "XML parsing without entity hardening on line {line}."),
    Rule(_T, "PY-007", "Python Insecure Random", "MEDIUM", "CWE-338", ("cryptography", "python", "random"),
         "py", "exec", r"""\brandom\s*\.\s*(?:random|randint|choice|shuffle|sample|seed)\s*\(""", False,
         "random module on line {line}."),
    Rule(_T, "PY-008", "Python Open Redirect", "MEDIUM", "CWE-601", ("redirect", "python", "web", "owasp-a01"),
         "py", "exec", r"""redirect\s*\(\s*request\s*\.\s*(?:args|form|get)\s*\[""", True,
         "Redirect target from request data on line {line}."),
    Rule(_T, "JAVA-001", "Java SQL Injection", "CRITICAL", "CWE-89", ("injection", "sql", "java", "owasp-a03"),
         "java", "raw", r"""(?:Statement|createStatement|executeQuery|executeUpdate)\s*\(.*\+""", False,
         "SQL concatenation on line {line}."),
    Rule(_T, "JAVA-002", "Java Command Injection", "CRITICAL", "CWE-78",
         ("injection", "java", "command-injection", "owasp-a03"),
         "java", "raw", r"""Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(|new\s+ProcessBuilder\s*\(""", False,
         "Process execution on line {line}."),
    Rule(_T, "JAVA-003", "Java Insecure Deserialization", "HIGH", "CWE-502", ("deserialization", "java", "owasp-a08"),
         "java", "raw", r"""ObjectInputStream|\.readObject\s*\(""", False, "Object deserialization on line {line}."),
    Rule(_T, "JAVA-004", "Java XML External Entity (XXE)", "HIGH", "CWE-611", ("xxe", "java", "xml", "owasp-a05"),
         "java", "raw", r"""DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|TransformerFactory""", False,
         "XML factory without visible hardening on line {line}.", unless=XML_HARDENING_MARKERS),
    Rule(_T, "JAVA-005", "Java Hardcoded Secret", "HIGH", "CWE-798", ("secrets", "java", "credentials", "owasp-a02"),
         "java", "raw", r'(?:password|passwd|secret|apiKey|api_key|token|authToken|privateKey)\s*=\s*"[^"]{4,}"',
         True, "Credential literal on line {line}."),
    Rule(_T, "JAVA-006", "Java Path Traversal", "HIGH", "CWE-22", ("path-traversal", "java", "owasp-a01"),
         "java", "raw",
         r"""new\s+File\s*\(.*(?:request|param|input|getParameter|getHeader).*\)|Paths\s*\.\s*get\s*\(.*(?:request|param|input)""",
         True, "File path from request data on line {line}."),
    Rule(_T, "JAVA-007", "Java Insecure Cryptography", "MEDIUM", "CWE-327", ("cryptography", "java", "owasp-a02"),
         "java", "raw", r'Cipher\s*\.\s*getInstance\s*\(\s*"(?:DES|RC4|RC2|Blowfish|DESede|AES\/ECB)"', True,
         "Weak cipher on line {line}."),
    Rule(_T, "CPP-001", "C/C++ Buffer Overflow", "CRITICAL", "CWE-120", ("c", "cpp", "buffer-overflow", "owasp-a03"),
         "cpp", "raw", r"""\b(strcpy|strcat|sprintf|vsprintf|gets)\s*\(""", False,
         "Unbounded {1}() on line {line}."),
    Rule(_T, "CPP-002", "C/C++ Command Injection", "CRITICAL", "CWE-78", ("c", "cpp", "command-injection"),
         "cpp", "raw", r"""\b(system|popen|execl|execv)\s*\(""", False, "Command call {1}() on line {line}."),
    Rule(_T, "PHP-001", "PHP eval Injection", "CRITICAL", "CWE-94", ("php", "injection"),
         "php", "raw", r"""\b(eval|assert)\s*\(""", False, "Dynamic {1}() on line {line}."),
    Rule(_T, "PHP-002", "PHP SQL Injection", "CRITICAL", "CWE-89", ("php", "sql", "owasp-a03"),
         "php", "raw", r"""query\s*\(\s*["'](?:.*)?\$.*["']\s*\)""", True, "Variable inside SQL text on line {line}."),
    Rule(_T, "RB-001", "Ruby Command Injection", "CRITICAL", "CWE-78", ("ruby", "injection"),
         "rb", "raw", r"""\b(system|exec)\s*\(|`.*\#\{.*\}""", False, "Shell call on line {line}."),
    Rule(_T, "GO-001", "Go SQL Injection", "CRITICAL", "CWE-89", ("go", "sql"),
         "go", "raw", r"""fmt\.Sprintf\s*\(\s*["'](?:SELECT|INSERT|UPDATE|DELETE|DROP).*["']\s*,""", True,
         "SQL built with Sprintf on line {line}."),
    Rule(_T, "DART-001", "Dart Command Injection", "CRITICAL", "CWE-78",
         ("dart", "injection", "command-injection", "owasp-a03"),
         "dart", "raw", r"""\bProcess\s*\.\s*(run|start|runSync)\s*\(""", False, "Process call on line {line}."),
    Rule(_T, "DART-002", "Dart Insecure HTTP Usage", "HIGH", "CWE-319", ("dart", "network", "tls", "owasp-a02"),
         "dart", "raw", r"""['"]http:\/\/(?!localhost|127\.0\.0\.1)""", True, "Plain http URL on line {line}."),
    Rule(_T, "DART-003", "Dart SSL Certificate Bypass", "CRITICAL", "CWE-295",
         ("dart", "tls", "ssl", "network", "owasp-a02"),
         "dart", "raw",
         r"""badCertificateCallback\s*=\s*\([^)]*\)\s*=>\s*true|badCertificateCallback\s*=\s*\(_[^)]*\)\s*\{?\s*return\s+true""",
         False, "Certificate check disabled on line {line}."),
    Rule(_T, "DART-004", "Dart Hardcoded Secret", "HIGH", "CWE-798", ("dart", "secrets", "credentials", "owasp-a02"),
         "dart", "raw",
         r"""(?:password|passwd|secret|apiKey|api_key|token|authToken|auth_token|privateKey|private_key|clientSecret|client_secret)\s*=\s*['"][^'"]{4,}['"]""",
         True, "Credential literal on line {line}."),
    Rule(_T, "DART-005", "Dart Insecure Random", "MEDIUM", "CWE-338", ("dart", "cryptography", "random", "owasp-a02"),
         "dart", "raw", r"""\bRandom\s*\(\s*\)\s*\.\s*(nextInt|nextDouble|nextBool)|new\s+Random\s*\(""", False,
         "Non-secure Random on line {line}."),
    Rule(_T, "DART-006", "Dart SQL Injection", "CRITICAL", "CWE-89", ("dart", "sql", "injection", "owasp-a03"),
         "dart", "raw", r"""\b(?:rawQuery|rawInsert|rawUpdate|rawDelete|execute)\s*\(\s*['"`][^'"`)]*\$[^'"`)]*['"`]""",
         False, "Interpolated SQL on line {line}."),
    Rule(_T, "DART-007", "Dart Path Traversal", "HIGH", "CWE-22", ("dart", "path-traversal", "file", "owasp-a01"),
         "dart", "raw",
         r"""\bFile\s*\(\s*['"`][^'"}`]*\$[^'"}`]*['"`]\s*\)|\bDirectory\s*\(\s*['"`][^'"}`]*\$[^'"}`]*['"`]\s*\)""",
         False, "Interpolated file path on line {line}."),
    Rule(_T, "DART-008", "Dart Insecure Local Storage", "MEDIUM", "CWE-312", ("dart", "flutter", "storage", "owasp-a02"),
         "dart", "raw",
         r"""SharedPreferences.*\.\s*set(?:String|Int|Bool|Double)\s*\(\s*['"][^'"]*(?:password|secret|token|key|auth|credential)[^'"]*['"]""",
         True, "Sensitive key in plain preferences on line {line}."),
    Rule(_T, "DART-009", "Dart Sensitive Data in Logs", "LOW", "CWE-532",
         ("dart", "logging", "information-disclosure", "owasp-a09"),
         "dart", "raw", r"""\b(?:print|debugPrint|log)\s*\([^)]*(?:password|passwd|secret|token|apiKey|api_key|auth)[^)]*\)""",
         True, "Sensitive name logged on line {line}."),
    Rule(_T, "DART-010", "Dart Unconfigured HttpClient", "LOW", "CWE-16", ("dart", "network", "tls", "owasp-a05"),
         "dart", "raw", r"""\bHttpClient\s*\(\s*\)""", False, "Bare HttpClient on line {line}."),
    Rule(_T, "VG-DOCKER-001", "Docker Root User", "HIGH", "CWE-250", ("docker", "iac", "security-misconfiguration"),
         "docker", "raw", r"""^USER\s+root\b""", True, "Container runs as root."),
    Rule(_T, "VG-DOCKER-002", "Docker Latest Tag", "LOW", "CWE-1104", ("docker", "iac", "supply-chain"),
         "docker", "raw", r"""^FROM\s+[^\s:]+(?::latest)?(?:\s+AS\s+\w+)?$""", True, "Base image is untagged or latest."),
    Rule(_T, "VG-DOCKER-003", "Docker Exposes Sensitive Port", "MEDIUM", "CWE-200", ("docker", "iac", "network"),
         "docker", "raw", r"""^EXPOSE\s+.*?(22|23|3389|11211|6379)\b""", True, "Sensitive port {1} exposed."),
    Rule(_T, "VG-TF-001", "Terraform Public S3 Bucket", "CRITICAL", "CWE-284", ("terraform", "iac", "aws", "s3"),
         "tf", "raw", r"""^\s*acl\s*=\s*["']public-read(-write)?["']""", True, "Bucket ACL is public."),
    Rule(_T, "VG-TF-002", "Terraform Hardcoded AWS Credentials", "HIGH", "CWE-798",
         ("terraform", "iac", "aws", "secrets"),
         "tf", "raw", r"""^\s*(access_key|secret_key)\s*=\s*["'][A-Za-z0-9/+=]{10,}["']""", True,
         "Cloud key literal in configuration."),
]

# FIXED VALUES: engine P line rules, registry order, all case-insensitive.
P_RULES: list[Rule] = [
    Rule(_P, "CS-SQL-001", "SQL Injection via String Concatenation", "CRITICAL", "CWE-89", (), "ext", "raw",
         r"""(execute|query|cursor\.execute|db\.query|connection\.execute)\s*\(\s*["\'].*\+|f["\'].*SELECT|f["\'].*INSERT|f["\'].*UPDATE|f["\'].*DELETE""",
         True, "SQL text built by concatenation or f-string.",
         ("py", "php", "java", "js", "ts", "rb"), "A03:2021 Injection"),
    Rule(_P, "CS-XSS-001", "Cross-Site Scripting (XSS) - innerHTML", "HIGH", "CWE-79", (), "ext", "raw",
         r"""\.innerHTML\s*=|\.outerHTML\s*=|document\.write\s*\(""", True, "HTML sink assignment.",
         ("js", "ts", "jsx", "tsx", "html"), "A03:2021 Injection"),
    Rule(_P, "CS-XSS-002", "Cross-Site Scripting - dangerouslySetInnerHTML", "HIGH", "CWE-79", (), "ext", "raw",
         r"""dangerouslySetInnerHTML\s*=\s*\{""", True, "React raw HTML property.",
         ("js", "ts", "jsx", "tsx"), "A03:2021 Injection"),
    Rule(_P, "CS-SEC-001", "Hardcoded API Key / Secret", "CRITICAL", "CWE-798", (), "ext", "raw",
         r"""(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key)\s*[=:]\s*["\'][A-Za-z0-9+/\-_]{20,}["\']""",
         True, "Credential literal in source.",
         ("py", "js", "ts", "java", "rb", "go", "php", "cs", "cpp", "c", "dart"),
         "A07:2021 Identification and Authentication Failures"),
    Rule(_P, "CS-SEC-002", "Hardcoded Password", "CRITICAL", "CWE-259", (), "ext", "raw",
         r"""password\s*[=:]\s*["\'][^"\']{6,}["\']""", True, "Password literal in source.",
         ("py", "js", "ts", "java", "rb", "go", "php", "cs", "dart"),
         "A07:2021 Identification and Authentication Failures"),
    Rule(_P, "CS-EXEC-001", "Dangerous eval() Usage", "HIGH", "CWE-95", (), "ext", "raw",
         r"""\beval\s*\(""", True, "eval call.", ("js", "ts", "jsx", "tsx", "py", "php", "rb"), "A03:2021 Injection"),
    Rule(_P, "CS-EXEC-002", "OS Command Injection", "CRITICAL", "CWE-78", (), "ext", "raw",
         r"""(os\.system|subprocess\.call|subprocess\.run|exec\s*\(|shell_exec|popen)\s*\(\s*[^)]*(\+|format|f["\'])""",
         True, "Command text built dynamically.", ("py", "php", "rb", "java"), "A03:2021 Injection"),
    Rule(_P, "CS-PATH-001", "Path Traversal Vulnerability", "HIGH", "CWE-22", (), "ext", "raw",
         r"""(open|readfile|include|require|file_get_contents)\s*\(\s*[^)]*(\+|\.format|f["\'])""", True,
         "File path built dynamically.", ("py", "php", "js", "ts", "java", "rb", "dart"),
         "A01:2021 Broken Access Control"),
    Rule(_P, "CS-RAND-001", "Insecure Random Number Generator", "MEDIUM", "CWE-338", (), "ext", "raw",
         r"""\b(Math\.random|random\.random|rand\(\)|mt_rand)\s*\(""", True, "Non-secure random generator.",
         ("py", "js", "ts", "php", "rb"), "A02:2021 Cryptographic Failures"),
    Rule(_P, "CS-DESER-001", "Insecure Deserialization", "CRITICAL", "CWE-502", (), "ext", "raw",
         r"""\b(pickle\.loads|pickle\.load|yaml\.load\s*\([^,)]+\)|unserialize\s*\(|ObjectInputStream)""", True,
         "Unsafe deserialization.", ("py", "php", "java", "rb"),
         "A08:2021 Software and Data Integrity Failures"),
    Rule(_P, "CS-SSRF-001", "Server-Side Request Forgery (SSRF)", "HIGH", "CWE-918", (), "ext", "raw",
         r"""(requests\.get|requests\.post|urllib\.request|fetch|axios\.get|axios\.post|http\.get)\s*\(\s*[^)]*(\+|format|f["\'])""",
         True, "Request URL built dynamically.", ("py", "js", "ts", "php", "rb", "java"),
         "A10:2021 Server-Side Request Forgery"),
    Rule(_P, "CS-CRYPTO-001", "Weak Cryptographic Algorithm", "HIGH", "CWE-327", (), "ext", "raw",
         r"""\b(MD5|SHA1|DES|RC4|hashlib\.md5|hashlib\.sha1|createHash\(["\']md5|createHash\(["\']sha1)\b""", True,
         "Weak algorithm name.", ("py", "js", "ts", "java", "php", "rb", "go"), "A02:2021 Cryptographic Failures"),
    Rule(_P, "CS-LOG-001", "Sensitive Data in Logs", "MEDIUM", "CWE-532", (), "ext", "raw",
         r"""(print|console\.log|logger\.\w+|logging\.\w+)\s*\([^)]*(?:password|token|secret|key|credential)[^)]*\)""",
         True, "Sensitive name logged.", ("py", "js", "ts", "java", "go", "rb", "php", "dart"),
         "A09:2021 Security Logging and Monitoring Failures"),
    Rule(_P, "CS-DART-001", "Dart Command Injection", "CRITICAL", "CWE-78", (), "ext", "raw",
         r"""\bProcess\s*\.\s*(run|start|runSync)\s*\(""", True, "Process call.", ("dart",), "A03:2021 Injection"),
    Rule(_P, "CS-DART-002", "Dart Insecure HTTP Usage", "HIGH", "CWE-319", (), "ext", "raw",
         r"""["\']http:\/\/(?!localhost|127\.0\.0\.1)""", True, "Plain http URL.", ("dart",),
         "A02:2021 Cryptographic Failures"),
    Rule(_P, "CS-DART-003", "Dart SSL Certificate Bypass", "CRITICAL", "CWE-295", (), "ext", "raw",
         r"""badCertificateCallback\s*=\s*\([^)]*\)\s*=>\s*true|badCertificateCallback\s*=\s*\(_[^)]*\)\s*\{?\s*return\s+true""",
         True, "Certificate check disabled.", ("dart",), "A02:2021 Cryptographic Failures"),
    Rule(_P, "CS-DART-005", "Dart Insecure Random", "MEDIUM", "CWE-338", (), "ext", "raw",
         r"""\bRandom\s*\(\s*\)\s*\.\s*(nextInt|nextDouble|nextBool)|new\s+Random\s*\(""", True,
         "Non-secure Random.", ("dart",), "A02:2021 Cryptographic Failures"),
    Rule(_P, "CS-DART-006", "Dart SQL Injection", "CRITICAL", "CWE-89", (), "ext", "raw",
         r"""\b(?:rawQuery|rawInsert|rawUpdate|rawDelete|execute)\s*\(\s*[\'"`][^\'"`)]*\$[^\'"`)]*[\'"`]""", True,
         "Interpolated SQL.", ("dart",), "A03:2021 Injection"),
    Rule(_P, "CS-DART-008", "Dart Insecure Local Storage", "MEDIUM", "CWE-312", (), "ext", "raw",
         r"""SharedPreferences.*\.\s*set(?:String|Int|Bool|Double)\s*\(\s*[\'"][^\'"]*(?:password|secret|token|key|auth|credential)[^\'"]*[\'"]""",
         True, "Sensitive key in plain preferences.", ("dart",), "A02:2021 Cryptographic Failures"),
    Rule(_P, "CS-DART-010", "Dart Unconfigured HttpClient", "LOW", "CWE-16", (), "ext", "raw",
         r"""\bHttpClient\s*\(\s*\)""", True, "Bare HttpClient.", ("dart",), "A05:2021 Security Misconfiguration"),
    Rule(_P, "CS-PKG-001", "Vulnerable Dependency", "MEDIUM", "CWE-1104", (), "ext", "raw",
         r"""["\']uuid["\']\s*:\s*["\']\^?9\.0\.1["\']""", True, "Pinned package version with a known advisory.",
         ("json",), "A06:2021 Vulnerable and Outdated Components"),
]

# FIXED VALUES: engine P whole-content patterns for js/ts/jsx/tsx/mjs/cjs
# (Python `re`, MULTILINE; only STOR001 and HASH001 ignore case).
P_CONTENT_RULES: list[Rule] = [
    Rule(_P, "AST-JS-EVAL001", "Dynamic eval() with string concatenation", "CRITICAL", None, (), "js", "content",
         r"""eval\s*\(.*\+.*\)""", False, "eval with a concatenated argument."),
    Rule(_P, "AST-JS-FUNC001", "Dynamic Function Constructor", "HIGH", None, (), "js", "content",
         r"""new\s+Function\s*\(""", False, "Function constructor."),
    Rule(_P, "AST-JS-XSS001", "DOM XSS via document.write()", "HIGH", None, (), "js", "content",
         r"""document\.write\s*\(""", False, "document.write call."),
    Rule(_P, "AST-JS-PROTO001", "Dynamic Property Access as Function Call", "HIGH", None, (), "js", "content",
         r"""window\[.*\]\s*\(""", False, "Computed window member called."),
    Rule(_P, "AST-JS-PROTO002", "Prototype Pollution", "HIGH", None, (), "js", "content",
         r"""__proto__\s*:""", False, "__proto__ key."),
    Rule(_P, "AST-JS-MSG001", "Insecure postMessage (wildcard origin)", "MEDIUM", None, (), "js", "content",
         r"""postMessage\s*\([^,]+,\s*['\"]?\*['\"]?\s*\)""", False, "postMessage to any origin."),
    Rule(_P, "AST-JS-STOR001", "Sensitive Data in localStorage", "MEDIUM", None, (), "js", "content",
         r"""localStorage\.setItem\s*\(.*(?:token|jwt|auth|session)""", True, "Token kept in localStorage."),
    Rule(_P, "AST-JS-HASH001", "Weak Hash Algorithm (MD5)", "MEDIUM", None, (), "js", "content",
         r"""crypto\.createHash\s*\(['\"]md5['\"]""", True, "MD5 hash."),
]

# FIXED VALUES: file extensions (with dot) of the two engines.
T_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".py", ".java", ".dart", ".html", ".php", ".go",
                ".rb", ".c", ".cpp", ".cs", ".sh", ".yaml", ".yml", ".json", ".tf")
P_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".java", ".php", ".rb", ".go", ".cs",
                ".cpp", ".c", ".html", ".dart", ".yaml", ".yml", ".json", ".sh")
P_CONTENT_EXTENSIONS = ("js", "ts", "jsx", "tsx", "mjs", "cjs")

# FIXED VALUES: default ignore globs (engine T) and pruned directory names (engine P).
T_DEFAULT_IGNORE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/coverage/**",
                    "**/*.min.js", "**/*.bundle.js")
P_IGNORE_DIRS = (".git", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", "env", "vendor",
                 ".next", ".nuxt", "coverage", ".pytest_cache", "target", "out")

# FIXED VALUES: size and count limits.
T_MAX_FILE_BYTES = 1024 * 1024

# FIXED VALUES: name fragments that make Math.random() a security context.
RANDOM_CONTEXT_NAMES = ("token", "secret", "password", "passwd", "nonce", "salt", "key", "iv", "seed", "random",
                        "uuid", "session", "csrf", "otp", "pin", "code", "hash", "id")

# FIXED VALUES: fs methods of the path rule (C5) and SQL call names.
FS_METHODS = ("readFile", "readFileSync", "writeFile", "writeFileSync", "appendFile", "appendFileSync", "unlink",
              "unlinkSync", "stat", "statSync", "lstat", "lstatSync", "access", "accessSync", "open", "openSync",
              "createReadStream", "createWriteStream", "readdir", "readdirSync", "mkdir", "mkdirSync", "rmdir",
              "rmdirSync")
SQL_METHODS = ("query", "execute", "run", "raw", "rawQuery")

# FIXED VALUES: Python sinks of the syntax pass (C9), in list order.
PY_SINKS = ("eval", "exec", "compile", "pickle.loads", "marshal.loads", "subprocess.call", "subprocess.Popen",
            "subprocess.run", "os.system", "os.popen", "os.execv", "os.execve", "__import__",
            "importlib.import_module", "open", "yaml.load")
PY_CRITICAL_SINKS = ("eval", "exec", "os.system")


def py_sink_id(sink: str) -> str:
    return "AST-PY-" + sink.replace(".", "_").upper()[:15]


#: findings of the Python syntax pass; not in the registry, so not selectable there, but in a scan's rule set
PY_FACT_RULES: list[Rule] = [
    *(Rule(_P, py_sink_id(s), f"Call of {s}", "CRITICAL" if s in PY_CRITICAL_SINKS else "HIGH", None, (), "py", "pyfact", None, False,
           f"{s} is called.") for s in PY_SINKS),
    Rule(_P, "AST-PY-SQL001", "Query text built at run time", "CRITICAL", None, (), "py", "pyfact", None, False,
         "A query call gets a concatenated, formatted or computed text."),
    Rule(_P, "AST-PY-ASSERT001", "Assert as access check", "MEDIUM", None, (), "py", "pyfact", None, False,
         "An access check is an assert, which optimised runs leave out."),
]

# Advice by weakness, our own wording.
REMEDIES = {
    "CWE-16": "Set the option to its safe value.", "CWE-22": "Resolve the path and check that it stays inside the folder it belongs to.",
    "CWE-78": "Call the program with a list of arguments and no shell.", "CWE-79": "Write text, not markup, or escape what comes from outside.",
    "CWE-89": "Pass values as bound parameters of a prepared statement.", "CWE-94": "Do not make code out of data.",
    "CWE-95": "Parse the data instead of evaluating it.", "CWE-120": "Use calls that take the size of the target.",
    "CWE-200": "Keep internal details out of what users get.", "CWE-250": "Run as a user with no more rights than needed.",
    "CWE-259": "Read the password from a secret store.", "CWE-284": "Restrict access to those who need it.",
    "CWE-295": "Check certificates against trusted authorities.", "CWE-312": "Encrypt the value before it is stored.",
    "CWE-319": "Use an encrypted connection.", "CWE-327": "Use a current algorithm.", "CWE-338": "Use a generator made for secrets.",
    "CWE-502": "Use a data format that cannot hold objects.", "CWE-532": "Leave the value out of logs.",
    "CWE-601": "Redirect to known addresses only.", "CWE-611": "Switch external entities off in the parser.",
    "CWE-798": "Read the value from a secret store and replace the leaked one.", "CWE-918": "Allow requests to known hosts only.",
    "CWE-1104": "Move to a release that is maintained.",
}
REMEDY = "Use the safe alternative that the message points to."


def remediation(rule: Rule) -> str:
    return rule.remediation or REMEDIES.get(rule.cwe or "", REMEDY)


def all_rules() -> list[Rule]:
    return T_RULES + P_RULES + P_CONTENT_RULES


DEFAULT_SEVERITY = {r.id: r.severity for r in T_RULES + P_RULES + P_CONTENT_RULES + PY_FACT_RULES}
