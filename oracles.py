"""SQL for the registered queries, written from what the operators mean.

DuckDB runs it on the same tables. Its regexes have no look-around, so a
boundary is a neighbouring character or an end of the line, outside group 1.
Fixed values: the file names, suffixes, regexes, line texts, scales and object
identifiers in it are those of the operators, written out once more.
"""

from __future__ import annotations

import re

from cryptoscape.plans import corpus
from cryptoscape.plans.queries import PROSE_CATALOGUE
from cryptoscape.sources.catalogue import load_algorithms, load_libraries

_SPACES = (r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
           r"\x{202F}\x{205F}\x{3000}")
_BREAKS = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


# --- files and lines ------------------------------------------------------------

_HEAD, _TAIL = (part.replace("{{", "{").replace("}}", "}")
                for part in corpus.PACKAGE_JSON.split("{text}"))
_EXCLUDED = (r"\.git|node_modules|__pycache__|\.venv|venv|\.env|dist|build|\.next|\.nuxt|"
             r"\.svelte-kit|\.tox|\.mypy_cache|\.ruff_cache|\.pytest_cache|vendor|target|"
             r"\.cargo|\.eggs|[^/]*\.egg-info")


def chars(value: str) -> str:
    """A SQL string with its control characters as chr()."""
    parts = re.split("([\x00-\x1f\x7f-\x9f\u2028\u2029])", value)
    return " || ".join(f"chr({ord(x)})" if i % 2 else q(x) for i, x in enumerate(parts) if x)


def planted(documents: str = "SELECT * FROM documents", shift: str = "0", move: str = "0") -> str:
    name = (f"CASE WHEN source = {q(corpus.CLEAN)} THEN 'f' || doc_id || '.py' ELSE "
            f"replace({lst(corpus.FILES)}[doc_id % {len(corpus.FILES)} + 1], '{{id}}', "
            "doc_id::VARCHAR) END")
    fitting = (f"{lst(corpus.SNIPPETS[kind] for kind in corpus.FILES.values())}"
               f"[doc_id % {len(corpus.FILES)} + 1]")
    other = (f"{lst(corpus.SNIPPETS.values())}"
             f"[(doc_id + {shift}) % {len(corpus.SNIPPETS)} + 1]")
    odd = " ".join(f"WHEN {r} THEN {chars(t)}" for r, t in corpus.ODD_LINES.items())
    broken = " ".join(f"WHEN {r} THEN {chars(bytes.fromhex(t).decode('utf-8', 'replace'))}"
                      for r, t in corpus.BROKEN.items())
    json_text = f"{q(_HEAD)} || to_json(text)::VARCHAR || {q(_TAIL)}"
    return f"""SELECT source AS repo,
      {lst(corpus.DIRECTORIES)}[(doc_id + {move}) % {len(corpus.DIRECTORIES)} + 1] || {name} AS path,
      CASE WHEN source = {q(corpus.CLEAN)} THEN text
           WHEN {name} LIKE '%package.json' AND doc_id % 7 = 0
           THEN left({json_text}, -1) || {q(corpus.ODD_JSON)}
           WHEN {name} LIKE '%package.json' THEN {json_text}
           ELSE CASE doc_id % 11 WHEN {corpus.EARLY_NUL} THEN chr(0) ELSE '' END
             || text || chr(10) || {fitting} || {other}
             || CASE doc_id % 11 {odd} {broken}
                WHEN {corpus.LATE_NUL} THEN repeat('pad ', {corpus.LATE_PAD}) || chr(0) || chr(10)
                  || 'MD5 after' || chr(10) ELSE '' END END AS content
      FROM ({documents})"""


PROSE = """SELECT 'documents' AS repo, 'd' || doc_id || '.py' AS path, text AS content FROM documents
  UNION ALL SELECT 'pages', 'p' || page_id || '.js', html FROM pages
  UNION ALL SELECT 'conversations', 'c' || conv_id || '/t' || turn || '.rb', text FROM conversations"""


def files(source: str, p: str = "") -> str:
    """CTEs ``files`` and ``lines`` with the prefix ``p``."""
    return f"""{p}raw AS MATERIALIZED ({source}),
{p}named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, strlen(content)
  - 2 * (length(content) - length(replace(content, chr(65533), ''))) AS size,
  contains(content, chr(0)) AS is_binary FROM {p}raw),
{p}sized AS (SELECT *, lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) AS suffix FROM {p}named),
{p}files AS MATERIALIZED (SELECT *,
  regexp_matches(path, '(^|/)({_EXCLUDED})(/|$)') AS excluded,
  regexp_matches(path, '(^|/)({_EXCLUDED})/') AS excluded_parent,
  suffix IN ('.py','.js','.ts','.tsx','.jsx','.mjs','.cjs','.go','.java','.rs','.rb','.php',
             '.cs','.swift') AS is_source,
  suffix IN ('.json','.yaml','.yml','.toml','.cfg','.ini','.conf','.env','.sh','.bash')
    AS is_config,
  name IN ('requirements.txt','Pipfile','pyproject.toml','package.json','go.mod','Cargo.toml',
           'pom.xml','build.gradle') AS is_manifest,
  suffix IN ('.conf','.cfg','.cnf','.ini','.yaml','.yml','.json') AS f_tls,
  suffix = '.pub' AS f_ssh_key, name IN ('sshd_config','ssh_config') AS f_ssh_daemon,
  suffix IN ('.json','.yaml','.yml') AS f_jwt, suffix = '.cnf' AS f_openssl,
  suffix IN ('.pem','.crt','.key') AS f_pem, name = '.env' OR name LIKE '.env.%' AS f_env
  FROM {p}sized),
{p}arrays AS (SELECT repo, path, CASE WHEN content = '' THEN [] WHEN parts[-1] = ''
    THEN parts[:-2] ELSE parts END AS arr
  FROM (SELECT repo, path, content, regexp_split_to_array(content, '{_BREAKS}') AS parts
        FROM {p}raw)),
{p}lines AS MATERIALIZED (SELECT repo, path, unnest(range(1, len(arr) + 1))::INT AS n,
  unnest(arr) AS line FROM {p}arrays)"""


CORPUS = files(planted())


def select_files(where: str) -> str:
    return f"WITH {CORPUS} SELECT repo, path, size::BIGINT AS size FROM files WHERE {where}"


# --- patterns ---------------------------------------------------------------------


def bounded(pattern: str) -> str:
    """RE2 form of a catalogue pattern with the match in group 1."""
    if re.search(r"\.\*|\.\+|[\\\[\]()|]", pattern):
        return f"(?i)({pattern})"
    if re.search("[-_]", pattern):
        body = re.sub("[-_]", "[-_ ]?", pattern)
    else:
        body = re.sub(r"([^A-Za-z0-9])", r"\\\1", pattern)
    return f"(?i)(?:^|[^a-zA-Z0-9])({body})(?:$|[^a-zA-Z0-9])"


def first_of(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract(line, {q(bounded(p))}, 1), '')" for p in patterns) + ", NULL)"


def source_hits(patterns: dict[str, list[str]], p: str = "") -> str:
    tried = ", ".join(
        f"{{'a': {q(a)}, 'o': {i}, 'm': {first_of(ps)}}}"
        for i, (a, ps) in enumerate(patterns.items()))
    return f"""{p}tried AS (SELECT l.repo, l.path, n, line,
  unnest(list_filter([{tried}], lambda x: x.m IS NOT NULL)) AS h
  FROM {p}lines l JOIN {p}files f ON l.repo = f.repo AND l.path = f.path
  WHERE f.is_source AND NOT f.excluded AND NOT f.is_binary),
{p}source_hits AS (SELECT repo, path, n AS line_number, h.m AS matched_text, h.a AS algorithm_id,
  'source_code' AS source, {strip('line')} AS line_text, n AS ord_a, h.o AS ord_b FROM {p}tried)"""


CATALOGUE = {a.id: a.patterns for a in load_algorithms().values()}
PROSE_PATTERNS = {a: [x for x in e["patterns"] if not x.startswith("(?P<broken")]
                  for a, e in PROSE_CATALOGUE.items()}

# (class, algorithm, regex with the match in group 1, line text) in the order of trial
_V1 = r"(?:[^.0-9A-Za-z_]|$)"
_NW = r"(?:[^0-9A-Za-z_]|$)"
CONFIG = (
    ("tls", "TLS-1.0", rf"(?i)(ssl_protocols\s+.*\bTLSv1){_V1}", "nginx TLS 1.0 enabled"),
    ("tls", "TLS-1.1", rf"(?i)(ssl_protocols\s+.*\bTLSv1\.1){_NW}", "nginx TLS 1.1 enabled"),
    ("tls", "TLS-1.0", rf"(?i)(SSLProtocol\s+.*\+?TLSv1){_V1}", "Apache TLS 1.0 enabled"),
    ("tls", "TLS-1.0", r"(?i)(ssl-min-ver\s+TLSv1\.0)", "HAProxy TLS 1.0 minimum version"),
    ("tls", "TLS-1.0", rf"(?i)(MinProtocol\s*=\s*TLSv1){_V1}", "OpenSSL TLS 1.0 minimum protocol"),
    ("env", "TLS-1.0", rf"(TLS_VERSION\s*=\s*1\.0){_NW}", "TLS 1.0 configured in environment"),
    ("ssh_key", "SSH-RSA", r"^(ssh-rsa\s)", "SSH RSA public key"),
    ("ssh_key", "DSA", r"^(ssh-dss\s)", "SSH DSA public key"),
    ("ssh_key", "ECDSA", r"^(ecdsa-sha2-nistp\d+\s)", "SSH ECDSA public key"),
    ("ssh_key", "Ed25519", r"^(ssh-ed25519\s)", "SSH Ed25519 public key"),
    ("ssh_daemon", "3DES", r"(?i)(Ciphers\s+.*3des)", "3DES cipher enabled in SSH config"),
    ("ssh_daemon", "AES-128", r"(?i)(Ciphers\s+.*aes128)", "AES-128 cipher enabled in SSH config"),
    ("ssh_daemon", "HMAC-SHA1", rf"(?i)(MACs\s+.*hmac-sha1){_NW}",
     "HMAC-SHA1 MAC enabled in SSH config"),
    ("ssh_daemon", "DH", r"(?i)(KexAlgorithms\s+.*diffie-hellman)",
     "Diffie-Hellman key exchange in SSH config"),
    ("jwt", "JWT-RS256", r"""(?i)((?:algorithm|alg)["'\s:=]+RS256)""",
     "JWT RS256 algorithm configured"),
    ("jwt", "JWT-ES256", r"""(?i)((?:algorithm|alg)["'\s:=]+ES256)""",
     "JWT ES256 algorithm configured"),
    ("env", "JWT-RS256", rf"(JWT_ALGORITHM\s*=\s*RS256){_NW}",
     "JWT RS256 algorithm in environment"),
    ("openssl", "SHA-1", rf"(?i)(default_md\s*=\s*sha1){_NW}",
     "OpenSSL default digest set to SHA-1"),
    ("openssl", "MD5", rf"(?i)(default_md\s*=\s*md5){_NW}", "OpenSSL default digest set to MD5"),
    ("openssl", "RSA", rf"(default_bits\s*=\s*(?:512|1024|2048)){_NW}",
     "RSA key size configured in OpenSSL"),
    ("pem", "RSA", r"(-----BEGIN RSA PRIVATE KEY-----)", "RSA private key in PEM format"),
    ("pem", "DSA", r"(-----BEGIN DSA PRIVATE KEY-----)", "DSA private key in PEM format"),
    ("pem", "ECDSA", r"(-----BEGIN EC PRIVATE KEY-----)", "ECDSA private key in PEM format"),
)


def config_hits(p: str = "") -> str:
    tried = ", ".join(
        f"{{'a': {q(a)}, 'o': {i}, 't': {q(t)}, "
        f"'m': CASE WHEN f_{c} THEN nullif(regexp_extract(line, {q(r)}, 1), '') END}}"
        for i, (c, a, r, t) in enumerate(CONFIG))
    return f"""{p}config_tried AS (SELECT l.repo, l.path, n,
  unnest(list_filter([{tried}], lambda x: x.m IS NOT NULL)) AS h
  FROM {p}lines l JOIN {p}files f ON l.repo = f.repo AND l.path = f.path
  WHERE NOT f.excluded_parent),
{p}config_hits AS (SELECT repo, path, n AS line_number, h.m AS matched_text, h.a AS algorithm_id,
  'config' AS source, h.t AS line_text, n AS ord_a, h.o AS ord_b FROM {p}config_tried
  QUALIFY row_number() OVER (PARTITION BY repo, path, n, h.a ORDER BY h.o) = 1)"""


# --- manifests ----------------------------------------------------------------------


def packages(p: str = "") -> str:
    left = strip("split_part(s, '=', 1)")
    unquoted = f"trim(trim({left}, '\"'), '''')"
    last = "OVER (PARTITION BY repo, path ORDER BY n)"
    name_re = q(r"""['"]([A-Za-z0-9_][A-Za-z0-9._-]*)""")
    gradle = q(r"""['"]([^'"]+):([^'"]+):([^'"]+)['"]""")
    maven = q(rf"<artifactId>[{_SPACES}]*([^<]+?)[{_SPACES}]*</artifactId>")
    # The last of repeated sections counts, and a repeated key once; a section has no braces.
    found = ("regexp_extract_all(regexp_extract(content, "
             "'(?s).*\"{}\": \\{{([^}}]*)\\}}', 1), '\"([^\"]+)\" *:', 1)")
    keys = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    sections = ", ".join(f"{{'s': {i}, 'k': {keys.format(s, s)}}}" for i, s in enumerate(
        ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")))
    code = "s <> '' AND NOT starts_with(s, '#')"
    return f"""{p}m AS (SELECT f.repo, f.path, f.name, n, line AS raw, {strip('line')} AS s
  FROM {p}lines l JOIN {p}files f ON l.repo = f.repo AND l.path = f.path
  WHERE f.is_manifest AND NOT f.excluded),
{p}heads AS (SELECT *, starts_with(s, '[') AS is_head,
  last_value(CASE WHEN starts_with(s, '[') THEN lower(s) END IGNORE NULLS) {last} AS head,
  last_value(CASE WHEN starts_with(s, 'require (') THEN true WHEN s = ')' THEN false END
             IGNORE NULLS) {last} AS in_require
  FROM {p}m),
{p}poetry AS (SELECT *, coalesce(contains(head, 'tool.poetry.dependencies'), false) AS poetry,
  contains(raw, 'dependencies') AND contains(raw, '=') AS assigns FROM {p}heads),
{p}lists AS (SELECT *, coalesce(last_value(CASE
    WHEN is_head THEN contains(lower(s), 'dependencies') AND NOT poetry
    WHEN assigns AND NOT poetry THEN true WHEN s = ']' THEN false END IGNORE NULLS) {last}, false)
    AS in_list FROM {p}poetry),
{p}found AS (
  SELECT repo, path, n, 0 AS sub, {strip(
      "regexp_extract(split_part(s, ' #', 1), '^[^><=!~;@\\[]*')")} AS package
    FROM {p}m WHERE name = 'requirements.txt' AND {code} AND NOT starts_with(s, '-')
  UNION ALL SELECT repo, path, n, 0, {unquoted} FROM {p}heads
    WHERE name = 'Pipfile' AND head IN ('[packages]', '[dev-packages]') AND NOT is_head
      AND {code} AND contains(s, '=')
  UNION ALL SELECT repo, path, n, 0, {left} FROM {p}heads
    WHERE name = 'Cargo.toml' AND contains(head, 'dependencies]') AND NOT is_head
      AND {code} AND contains(s, '=')
  UNION ALL SELECT repo, path, n, unnest(range(len(names))), unnest(names) FROM (
    SELECT *, regexp_extract_all(s, {name_re}, 1) AS names FROM {p}lists
    WHERE name = 'pyproject.toml' AND NOT is_head AND NOT poetry
      AND (assigns OR (in_list AND {code})))
  UNION ALL SELECT repo, path, n, 0, {left} FROM {p}lists
    WHERE name = 'pyproject.toml' AND NOT is_head AND poetry AND {code} AND contains(s, '=')
      AND {left} <> 'python'
  UNION ALL SELECT repo, path, n, unnest([0, 1]),
      unnest([regexp_extract(module, '[^/]*$'), module]) FROM (
    SELECT repo, path, n, regexp_extract(s, '^[^{_SPACES}]+[{_SPACES}]+([^{_SPACES}]+)', 1) AS module
      FROM {p}heads WHERE name = 'go.mod' AND starts_with(s, 'require ') AND NOT contains(s, '(')
    UNION ALL SELECT repo, path, n, regexp_extract(s, '^[^{_SPACES}]+') FROM {p}heads
      WHERE name = 'go.mod' AND in_require AND NOT starts_with(s, 'require (')
        AND NOT (starts_with(s, 'require ') AND NOT contains(s, '('))
        AND s <> '' AND NOT starts_with(s, '//'))
  UNION ALL SELECT repo, path, n, 0, regexp_extract(raw, {maven}, 1) FROM {p}m
    WHERE name = 'pom.xml'
  UNION ALL SELECT repo, path, n, unnest([0, 1]),
      unnest([regexp_extract(raw, {gradle}, 2),
              regexp_extract(raw, {gradle}, 1) || ':' || regexp_extract(raw, {gradle}, 2)])
    FROM {p}m WHERE name = 'build.gradle' AND regexp_matches(raw, {gradle})),
{p}json_sections AS (SELECT repo, path, unnest([{sections}]) AS x FROM {p}files
  WHERE name = 'package.json' AND NOT excluded),
{p}json_found AS (SELECT repo, path, x.s AS sec, unnest(range(len(x.k))) AS i, unnest(x.k) AS package
  FROM {p}json_sections WHERE x.k IS NOT NULL),
{p}json_lines AS (SELECT j.repo, j.path, sec, i, package, min(l.n) AS n FROM {p}json_found j
  LEFT JOIN {p}lines l ON j.repo = l.repo AND j.path = l.path
    AND contains(l.line, '"' || j.package || '"') GROUP BY ALL),
{p}packages AS (
  SELECT repo, path, package, n AS line_number,
    (row_number() OVER (PARTITION BY repo, path ORDER BY n, sub) - 1)::INT AS pkg_ord
    FROM {p}found WHERE package <> ''
  UNION ALL SELECT repo, path, package, n,
    (row_number() OVER (PARTITION BY repo, path ORDER BY sec, i) - 1)::INT FROM {p}json_lines)"""


LIBRARIES = ", ".join(
    f"({i}, {q(lib.package_name)}, {q(lib.description)}, {lst(lib.exposes)})"
    for i, lib in enumerate(load_libraries().values()))


def dependency_hits(p: str = "") -> str:
    return f"""{p}libs AS (SELECT * FROM (VALUES {LIBRARIES}) v(lib_ord, package_name, description,
    exposes) QUALIFY row_number() OVER (PARTITION BY lower(package_name)
                                        ORDER BY lib_ord DESC) = 1),
{p}exposed AS (SELECT repo, path, line_number, pkg_ord, package_name, description,
  unnest(exposes) AS algorithm_id, unnest(range(len(exposes)))::INT AS expose_ord
  FROM {p}packages k JOIN {p}libs l ON lower({strip('k.package')}) = lower(l.package_name)),
{p}dependency_hits AS (SELECT repo, path, line_number, package_name AS matched_text, algorithm_id,
  'dependency' AS source, description AS line_text, pkg_ord AS ord_a, expose_ord AS ord_b
  FROM {p}exposed QUALIFY row_number() OVER (
    PARTITION BY repo, path, line_number, algorithm_id ORDER BY pkg_ord, expose_ord) = 1)"""


# --- assessment -------------------------------------------------------------------

_CATALOGUE_ROWS = ", ".join(
    "(" + ", ".join(q(v) for v in (a.id, a.name, a.type, a.quantum_risk, a.reason, a.replacement,
                                   a.category, a.remediation)) + ")"
    for a in load_algorithms().values())
_IMPORT = r"^\s*(import\s+\S|from\s+\S+\s+import\s|use\s+\S)|require\s*\("
_CALL = (r"\.\s*(generate|encrypt|decrypt|sign|verify|digest|update|new|create)\s*\(|"
         r"new\s+\w+\s*\(")


def assessed(hits: str, p: str = "") -> str:
    """CTE ``findings`` from a finding table."""
    starts = " OR ".join(f"starts_with(ltrim(line_text), {q(s)})"
                         for s in ("#", "//", "/*", "*", '"""', "'''"))
    return f"""{p}catalogue AS (SELECT * FROM (VALUES {_CATALOGUE_ROWS})
  v(id, name, type, risk, reason, replacement, category, remediation)),
{p}classified AS (SELECT h.*, coalesce(c.name, h.algorithm_id) AS algorithm_name,
  coalesce(c.type, 'unknown') AS algorithm_type, coalesce(c.risk, 'UNKNOWN') AS quantum_risk,
  coalesce(c.reason, 'Algorithm not in database') AS reason,
  coalesce(c.replacement, '') AS replacement, c.category, c.remediation,
  CASE WHEN regexp_matches(path, '(^|/)(test_|tests/|__tests__/|spec/|test/)|_test[.]py$|_spec[.]')
       THEN 'test'
       WHEN regexp_matches(path, '(^|/)(docs/|README|CHANGELOG)|[.]md$|[.]rst$') THEN 'docs'
       WHEN regexp_matches(path, '(^|/)(build/|dist/|Makefile$|Dockerfile$)|[.]min[.](js|css)$')
       THEN 'build'
       WHEN {starts} THEN 'comment' ELSE 'runtime' END AS context
  FROM {hits} h LEFT JOIN {p}catalogue c ON h.algorithm_id = c.id),
{p}confident AS (SELECT *, CASE WHEN source IN ('dependency', 'config') THEN 'high'
  WHEN regexp_matches(line_text, {q(_IMPORT)}) OR regexp_matches(line_text, {q(_CALL)}) THEN 'high'
  WHEN context IN ('comment', 'docs') THEN 'low' ELSE 'medium' END AS confidence
  FROM {p}classified),
{p}findings AS MATERIALIZED (SELECT *, CASE WHEN quantum_risk = 'SAFE' THEN 'info'
  WHEN quantum_risk = 'VULNERABLE' AND context = 'runtime' THEN
    CASE confidence WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'high' ELSE 'medium' END
  WHEN quantum_risk = 'VULNERABLE' THEN CASE confidence WHEN 'high' THEN 'low' ELSE 'medium' END
  WHEN quantum_risk = 'PARTIAL' AND context = 'runtime' THEN
    CASE confidence WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END
  WHEN quantum_risk = 'PARTIAL' THEN CASE confidence WHEN 'high' THEN 'info' ELSE 'low' END
  ELSE 'medium' END AS severity,
  substr(sha256(path || ':' || coalesce(line_number::VARCHAR, 'None') || ':' || algorithm_id || ':'
    || source), 1, 16) AS hash,
  {{'s': CASE source WHEN 'source_code' THEN 0 WHEN 'dependency' THEN 1 ELSE 2 END,
    'p': CASE WHEN source = 'dependency' THEN replace(path, '/', chr(1)) ELSE path END,
    'a': ord_a, 'b': ord_b}} AS seq FROM {p}confident)"""


def scan(p: str = "") -> str:
    return f"""{source_hits(CATALOGUE, p)}, {config_hits(p)}, {packages(p)}, {dependency_hits(p)},
{p}hits AS (SELECT * FROM {p}source_hits UNION ALL SELECT * FROM {p}dependency_hits
  UNION ALL SELECT * FROM {p}config_hits)"""


FINDINGS = f"WITH {CORPUS}, {scan()}, {assessed('hits')}"
_ROW = "repo, path, line_number, matched_text, algorithm_id, line_text"
_KEY = "repo, path, line_number, algorithm_id, source, severity"
_LEVEL = ("CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' "
          "WHEN 'medium' THEN 'warning' ELSE 'note' END")


def index_of(severity: str) -> str:
    return (f"coalesce(list_position(['critical', 'high', 'medium', 'low', 'info'], {severity}), "
            "3)::INT - 1")


# --- policy -------------------------------------------------------------------------

_OVERRIDE = ("CASE upper(algorithm_id) WHEN 'SHA-1' THEN 'critical' WHEN 'SHA-256' THEN 'medium' "
             "ELSE severity END")
_IGNORED_PATH = ("(path GLOB '**/test_*' OR path GLOB 'docs/*' OR path GLOB 'app/svc?[0-5]/*' "
                 "OR path GLOB '[!a-v]eb/*')")
_IGNORED_FINDING = ("(algorithm_id IN ('MD5', 'Camellia-256') OR (algorithm_id = 'RSA' AND "
                    "(path GLOB 'legacy/auth/*' OR path GLOB 'pkg/*.java')) "
                    "OR (algorithm_id = 'AES-128' AND path GLOB 'src/*'))")
PER_REPO = f"""kept AS (SELECT * REPLACE (CASE WHEN repo = 'src1' THEN {_OVERRIDE}
  ELSE severity END AS severity) FROM findings
  WHERE NOT (repo = 'src1' AND ({_IGNORED_PATH} OR {_IGNORED_FINDING}))
    AND NOT (repo = 'src2' AND algorithm_id = 'RSA')),
gates(repo, threshold, max_new) AS (VALUES ('src1', 0, 40), ('src2', 4, 0), ('src3', 0, 1))"""


# --- diff ---------------------------------------------------------------------------

_EARLIER = files(planted(shift="CASE WHEN lang = 'fr' THEN 1 ELSE 0 END",
                         move="CASE WHEN lang = 'de' THEN 1 ELSE 0 END"), "o_")
DIFF = f"""{FINDINGS}, {_EARLIER}, {scan('o_')}, {assessed('o_hits', 'o_')},
before AS (SELECT repo, hash, path, line_number, algorithm_id, quantum_risk, source,
  CASE WHEN algorithm_id IN ('MD5', 'RSA') THEN 'low' ELSE severity END AS severity
  FROM o_findings),
diff AS (SELECT coalesce(f.repo, b.repo) AS repo, coalesce(f.hash, b.hash) AS hash,
  coalesce(f.path, b.path) AS path,
  CASE WHEN f.hash IS NULL THEN b.line_number ELSE f.line_number END AS line_number,
  coalesce(f.algorithm_id, b.algorithm_id) AS algorithm_id,
  coalesce(f.quantum_risk, b.quantum_risk) AS quantum_risk,
  coalesce(f.severity, b.severity) AS severity, coalesce(f.source, b.source) AS source,
  CASE WHEN f.hash IS NULL THEN 'resolved' WHEN b.hash IS NULL THEN 'new'
       WHEN {index_of('f.severity')} < {index_of('b.severity')} THEN 'worsened'
       ELSE 'unchanged' END AS diff_class
  FROM findings f FULL OUTER JOIN before b ON f.repo = b.repo AND f.hash = b.hash)"""
_STATUS = "CASE WHEN diff_class IN ('new', 'worsened') THEN diff_class END AS diff_status"
_NEW = "count(*) FILTER (diff_class IN ('new', 'worsened'))"

# --- documents ------------------------------------------------------------------------

_REPOS = """repos AS (SELECT repo, count(*) FILTER ((is_source OR is_config) AND NOT excluded)
  AS total_files_scanned FROM files GROUP BY repo)"""
KEYS = "seq.s AS source_ord, seq.p AS path_key, seq.a AS ord_a, seq.b AS ord_b"
_NO_KEYS = "0 AS source_ord, '' AS path_key, 0 AS ord_a, 0 AS ord_b"

# The findings that a diff reports, with their status.
DIFF_FINDINGS = f"""{DIFF}, reported AS (SELECT f.*, d.diff_class AS diff_status FROM findings f
  JOIN diff d ON f.repo = d.repo AND f.hash = d.hash WHERE d.diff_class IN ('new', 'worsened'))"""


def listing(status: str, table: str) -> str:
    return f"""SELECT repo, list_position(['VULNERABLE', 'PARTIAL', 'SAFE', 'UNKNOWN'],
    quantum_risk)::INT - 1 AS risk_ord, {KEYS}, upper(severity) AS severity,
  coalesce(upper({status}), '') AS badge, quantum_risk AS risk, algorithm_name AS algorithm,
  path || coalesce(':' || line_number, '') AS file_line, source, upper(confidence) AS confidence,
  context, CASE replacement WHEN '' THEN '-' ELSE replacement END AS replacement FROM {table}"""


_MESSAGE = "'Uses ' || algorithm_name || ': ' || reason || '. Instead: ' || replacement"


def sarif_results(status: str, table: str) -> str:
    return f"""SELECT repo, 'cryptoscape/' || algorithm_id AS rule_id, {_LEVEL} AS level,
  {_MESSAGE} AS message, path AS uri, coalesce(line_number, 1) AS start_line, quantum_risk,
  algorithm_type, replacement, confidence, context, severity, category, remediation,
  {status} AS diff_status FROM {table}"""


def risk_count(risk: str) -> str:
    return f"count(*) FILTER (quantum_risk = '{risk}')"


def piece(part: int, text: str, table: str, item: str = "0", sub: int = 0,
          keys: str = _NO_KEYS) -> str:
    return (f"SELECT repo, {part} AS part, ({item})::INT AS item, {sub} AS sub, {keys}, "
            f"{text} AS text FROM {table}")


def comma(first: str) -> str:
    return f"CASE WHEN {first} THEN '' ELSE ',' END"


_FIRST = "row_number() OVER (PARTITION BY repo ORDER BY seq) = 1"


def json_documents(start: str, table: str, status: str, tail: str) -> str:
    finding = ("{'file_path': path, 'line_number': line_number, 'matched_text': matched_text, "
               "'algorithm_id': algorithm_id, 'algorithm_name': algorithm_name, "
               "'algorithm_type': algorithm_type, 'source': source, 'quantum_risk': quantum_risk, "
               "'reason': reason, 'replacement': replacement, 'confidence': confidence, "
               "'context': context, 'severity': severity, 'category': category, "
               f"'remediation': remediation, 'diff_status': {status}}}")
    return f"""{start}, {_REPOS}, counted AS (SELECT r.repo, any_value(total_files_scanned) AS files,
  count(f.repo) AS total, {risk_count('VULNERABLE')} AS v, {risk_count('PARTIAL')} AS p,
  {risk_count('SAFE')} AS s FROM repos r LEFT JOIN {table} f ON r.repo = f.repo GROUP BY r.repo),
json_heads AS (SELECT repo, rtrim(to_json({{'version': '0.1.0', 'scan_path': repo,
    'total_files_scanned': files, 'scan_duration_seconds': 0.0::DOUBLE,
    'summary': {{'total_findings': total, 'vulnerable': v, 'partial': p, 'safe': s,
      'quantum_ready_score': CASE WHEN total = 0 THEN 100.0::DOUBLE
        ELSE s::DOUBLE / total * 100 END}}}})::VARCHAR, '}}') || '}},"findings":[' AS head FROM counted)
{piece(0, "head", "json_heads")}
UNION ALL {piece(1, f"{comma(_FIRST)} || to_json({finding})::VARCHAR", table, keys=KEYS)}
UNION ALL {tail}"""


JSON_DOCUMENTS = json_documents(FINDINGS, "findings", "NULL::VARCHAR", piece(2, "']}'", "repos"))
_SUMMARY = """(SELECT r.repo, '],"diff_summary":' || to_json({
  'new': count(*) FILTER (diff_class = 'new'), 'worsened': count(*) FILTER (diff_class = 'worsened'),
  'resolved': count(*) FILTER (diff_class = 'resolved'),
  'unchanged': count(*) FILTER (diff_class = 'unchanged')})::VARCHAR || '}' AS tail
  FROM repos r LEFT JOIN diff d ON r.repo = d.repo GROUP BY r.repo)"""
JSON_DIFF_DOCUMENTS = json_documents(DIFF_FINDINGS, "reported", "diff_status",
                                     piece(2, "tail", _SUMMARY))

_RULE = ("{'id': 'cryptoscape/' || algorithm_id, 'name': 'QuantumVulnerableCrypto', "
         "'shortDescription': {'text': algorithm_name || ': ' || reason}, "
         "'fullDescription': {'text': 'Risk ' || quantum_risk || ' for ' || algorithm_name || "
         "', type ' || algorithm_type || '. Use ' || replacement}, "
         "'defaultConfiguration': {'level': CASE quantum_risk WHEN 'VULNERABLE' THEN 'error' "
         "WHEN 'SAFE' THEN 'note' ELSE 'warning' END}, 'properties': {'tags': ['security', "
         "'cryptography', 'quantum', 'pqc'], 'precision': 'medium'}}")
_RESULT = (f"{{'ruleId': 'cryptoscape/' || algorithm_id, 'level': {_LEVEL}, 'message': {{'text': "
           f"{_MESSAGE}}}, "
           "'locations': [{'physicalLocation': {'artifactLocation': {'uri': path, 'uriBaseId': "
           "'%SRCROOT%'}, 'region': {'startLine': coalesce(line_number, 1), 'startColumn': 1}}}], "
           "'properties': {'quantum_risk': quantum_risk, 'algorithm_type': algorithm_type, "
           "'replacement': replacement, 'confidence': confidence, 'context': context, "
           "'severity': severity, 'category': category, 'remediation': remediation, "
           "'diff_status': NULL::VARCHAR}}")
_HEAD_TEXT = """'{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/'
  || 'schema/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":'
  || '"cryptoscape","version":"0.1.0","rules":['"""
_BETWEEN = """']}},"results":['"""
SARIF_DOCUMENTS = f"""{FINDINGS}, {_REPOS},
firsts AS (SELECT * FROM findings
  QUALIFY row_number() OVER (PARTITION BY repo, algorithm_id ORDER BY seq) = 1),
rules AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) - 1 AS i FROM firsts)
{piece(0, _HEAD_TEXT, "repos")}
UNION ALL {piece(1, f"{comma('i = 0')} || to_json({_RULE})::VARCHAR", "rules", "i")}
UNION ALL {piece(2, _BETWEEN, "repos")}
UNION ALL {piece(3, f"{comma(_FIRST)} || to_json({_RESULT})::VARCHAR", "findings", keys=KEYS)}
UNION ALL {piece(4, "']}]}'", "repos")}"""

_PROPERTIES = ", ".join(
    f"{{'name': 'cryptoscape:{n}', 'value': coalesce({n}, '')}}"
    for n in ("quantum_risk", "replacement", "source", "confidence", "context", "severity",
              "category", "remediation"))
_OCCURRENCE = ("'{\"location\":' || to_json(path) || ',\"line\":' || coalesce(line_number, 1) || "
               "CASE WHEN matched_text <> '' THEN ',\"additionalContext\":' || to_json(matched_text) "
               "ELSE '' END || '}'")


def cbom_documents(components: str) -> str:
    start = "\nSELECT repo, algorithm_id, occurrences"
    table = components.replace(start, ",\ncomponents AS (" + start.strip())
    head = """'{"bomFormat":"CycloneDX","specVersion":"1.6","version":1,"serialNumber":"urn:uuid:'
  || md5(repo) || '","metadata":{"timestamp":"2026-06-30T00:00:00+00:00","tools":{"components":'
  || '[{"type":"application","name":"cryptoscape","version":"0.1.0"}]},"component":{"type":'
  || '"application","name":' || to_json(repo) || ',"bom-ref":"scanned-project"}},"components":['"""
    opening = f"""{comma("component_index = 0")} || '{{"type":"cryptographic-asset","name":'
    || to_json(algorithm_name) || ',"bom-ref":' || to_json(bom_ref) || ',"cryptoProperties":'
    || '{{"assetType":' || to_json(asset_type) || coalesce(',"oid":' || to_json(oid), '')
    || coalesce(',"algorithmProperties":{{"primitive":' || to_json(primitive) || '}}', '')
    || '}},"properties":' || to_json([{_PROPERTIES}]) || ',"evidence":{{"occurrences":['"""
    first = "row_number() OVER (PARTITION BY repo, algorithm_id ORDER BY seq) = 1"
    placed = """(SELECT f.*, c.component_index FROM findings f JOIN components c
  ON f.repo = c.repo AND f.algorithm_id = c.algorithm_id)"""
    return f"""{table}), {_REPOS}
{piece(0, head, "repos")}
UNION ALL {piece(1, opening, "components", "component_index")}
UNION ALL {piece(1, f"{comma(first)} || {_OCCURRENCE}", placed, "component_index", 1, KEYS)}
UNION ALL {piece(1, "']}}'", "components", "component_index", 2)}
UNION ALL {piece(2, "']}'", "repos")}"""


_ENTRY = ("{'hash': hash, 'file': path, 'line': line_number, 'algorithm': algorithm_id, "
          "'risk': quantum_risk, 'severity': severity, 'source': source}")
_BASELINE_HEAD = """'{"baseline_version":"1.0","tool_version":"0.1.0","generated_at":'
  || '"2026-06-30T00:00:00+00:00","commit":null,"findings_count":' || n || ',"findings":['"""
BASELINE_DOCUMENTS = f"""{FINDINGS}, {_REPOS},
counted AS (SELECT r.repo, count(f.repo) AS n FROM repos r LEFT JOIN findings f ON r.repo = f.repo
  GROUP BY r.repo)
{piece(0, _BASELINE_HEAD, "counted")}
UNION ALL {piece(1, comma("row_number() OVER (PARTITION BY repo ORDER BY hash) = 1")
                 + f" || to_json({_ENTRY})::VARCHAR", "findings",
                 keys="0 AS source_ord, hash AS path_key, 0 AS ord_a, 0 AS ord_b")}
UNION ALL {piece(2, "']}'", "repos")}"""

# --- checks on catalogues -----------------------------------------------------------

PARTS = """parts AS (SELECT 'P' || p_partkey AS algorithm_id, p_name AS name,
  CASE p_size % 7 WHEN 0 THEN 'asymmetric' WHEN 1 THEN 'hash' WHEN 2 THEN 'gadget'
    ELSE 'symmetric' END AS type,
  CASE p_size % 3 WHEN 0 THEN 'VULNERABLE' WHEN 1 THEN 'SAFE' ELSE 'DOUBTFUL' END AS quantum_risk,
  p_name AS replacement, CASE WHEN p_size % 5 <> 0 THEN 'hash' END AS category,
  CASE p_size WHEN 9 THEN []::VARCHAR[] WHEN 8 THEN [p_brand, '  ']
    ELSE string_split(p_name, ' ') || [lower(p_type)]
      || [string_split(p_name, ' ')[p_size % 2 + 1]] END AS patterns,
  CASE p_size % 4 WHEN 0 THEN 'cnsa' WHEN 1 THEN 'nist' ELSE 'other' END AS body,
  p_size % 2 = 0 AS has_full FROM part)"""
LIBS = """libs AS (SELECT 'L-' || l_orderkey || '-' || l_linenumber AS library_id,
  CASE l_returnflag WHEN 'A' THEN 'python' WHEN 'N' THEN 'npm' ELSE 'cobol' END AS ecosystem,
  CASE WHEN l_linenumber <> 3 THEN l_returnflag ELSE '' END AS package_name,
  CASE WHEN l_returnflag = 'N' THEN [l_partkey, l_partkey + l_suppkey]
       WHEN l_linenumber > 1 THEN [l_partkey] ELSE [] END AS exposes,
  CASE WHEN l_linestatus = 'O' THEN 'SAFE' ELSE 'DOUBTFUL' END AS default_risk FROM lineitem)"""


def problems(table: str, id_column: str, checks: dict[str, str]) -> str:
    failed = ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN {q(name)} END"
                       for name, ok in checks.items())
    return (f"SELECT {id_column}, problem FROM (SELECT {id_column}, unnest([{failed}]) AS problem "
            f"FROM {table}) WHERE problem IS NOT NULL")


def in_order(rows: str, first: str) -> str:
    """``rows`` numbered by repository, ``first`` and the keys of the scan."""
    return (f" SELECT *, row_number() OVER (ORDER BY repo, {first}, source_ord, path_key, ord_a, ord_b) "
            f"AS seq_no FROM ({rows})")


ORACLES = {
    "src1_fil1_select_files": select_files("(is_source OR is_config) AND NOT excluded"),
    "fil3_size_filter": select_files("(is_source OR is_config) AND NOT excluded AND size <= 4000"),
    # The late NUL is behind the bytes that are probed.
    "fil4_text_files": select_files(
        "is_source AND NOT excluded AND NOT starts_with(content, chr(0))"),
    "prj1_decode": f"WITH {CORPUS} SELECT repo, path, content AS text FROM files",
    "fil5_manifests": select_files("is_manifest AND NOT excluded"),
    "fil6_config_files": select_files(
        "NOT excluded_parent AND (name IN ('nginx.conf','httpd.conf','apache2.conf','haproxy.cfg',"
        "'Caddyfile','sshd_config','ssh_config','openssl.cnf','settings.py','docker-compose.yml',"
        "'docker-compose.yaml') OR f_env OR suffix IN ('.conf','.cfg','.cnf','.ini','.pub','.pem',"
        "'.crt','.key','.json','.yaml','.yml'))"),
    "fil7_file_classes": f"""WITH {CORPUS} SELECT repo, path, suffix,
  (CASE WHEN is_source AND NOT excluded THEN 1 ELSE 0 END
   + CASE WHEN excluded_parent THEN 0 ELSE 2 * f_tls::INT + 4 * f_ssh_key::INT
     + 8 * f_ssh_daemon::INT + 16 * f_jwt::INT + 32 * f_openssl::INT + 64 * f_pem::INT
     + 128 * f_env::INT END)::INT AS mask,
  CASE WHEN is_manifest AND NOT excluded THEN name END AS manifest FROM files""",
    "prj2_lines": f"WITH {CORPUS} SELECT repo, path, n AS line_number, line FROM lines",
    "prj3_stripped_lines": f"WITH {files(PROSE)} SELECT repo, path, n AS line_number, "
                           f"{strip('line')} AS line_text FROM lines",
    "prj4_relative_path": "SELECT page_id, CASE WHEN starts_with(url, 'https://m.ththth.example.net/')"
                          " THEN substr(url, 30) ELSE url END AS path FROM pages",
    "agg0_files_scanned": f"WITH {CORPUS} SELECT repo, count(*) FILTER ((is_source OR is_config) "
                          "AND NOT excluded) AS total_files_scanned "
                          "FROM files GROUP BY repo",
    "scn1_scan_source": f"WITH {CORPUS}, {source_hits(CATALOGUE)} SELECT {_ROW} FROM source_hits",
    "scn1_custom_catalogue": f"WITH {files(PROSE)}, {source_hits(PROSE_PATTERNS)} "
                             f"SELECT {_ROW} FROM source_hits",
    "cfg_scan_config": f"WITH {CORPUS}, {config_hits()} SELECT {_ROW} FROM config_hits",
    "dep1_extract_packages": f"WITH {CORPUS}, {packages()} "
                             "SELECT repo, path, pkg_ord, package, line_number FROM packages",
    "dep9_scan_dependencies": f"WITH {CORPUS}, {packages()}, {dependency_hits()} "
                              f"SELECT {_ROW}, ord_a, ord_b FROM dependency_hits",
    "uni1_scan_counts": f"WITH {CORPUS}, {scan()} SELECT repo, source, algorithm_id, "
                        "count(*) AS n FROM hits GROUP BY ALL",
    "cls1_unknown_algorithms": f"WITH {files(PROSE)}, {source_hits(PROSE_PATTERNS)}, "
                               f"{assessed('source_hits')} SELECT repo, path, line_number, "
                               "algorithm_id, algorithm_name, algorithm_type, quantum_risk, reason, "
                               "replacement, severity, category FROM findings",
    "sev3_sarif_levels": f"{FINDINGS} SELECT repo, severity, {_LEVEL} AS level, count(*) AS n "
                         "FROM findings GROUP BY ALL",
    "rpt1_json_findings": f"{FINDINGS} SELECT repo, path AS file_path, line_number, matched_text, "
                          "algorithm_id, algorithm_name, algorithm_type, source, quantum_risk, "
                          "reason, replacement, confidence, context, severity, category, "
                          "remediation, NULL::VARCHAR AS diff_status FROM findings",
    "pol1_severity_overrides": f"{FINDINGS} SELECT repo, path, line_number, algorithm_id, source, "
                               f"{_OVERRIDE} AS severity FROM findings",
    "pol2_ignore_paths": f"{FINDINGS} SELECT {_KEY} FROM findings WHERE NOT {_IGNORED_PATH}",
    "pol3_pol4_ignore_findings": f"{FINDINGS} SELECT {_KEY} FROM findings "
                                 f"WHERE NOT {_IGNORED_FINDING}",
    "pol_policy_per_repo": f"{FINDINGS}, {PER_REPO} SELECT {_KEY} FROM kept",
    "pol5_fail_gate": f"""{FINDINGS}, {PER_REPO}, worst AS (
  SELECT repo, min({index_of('severity')}) AS worst FROM kept GROUP BY repo)
SELECT repo, worst, 0::BIGINT AS new_findings, coalesce(worst <= threshold, false) AS fails
FROM (SELECT DISTINCT repo FROM files) LEFT JOIN worst USING (repo) LEFT JOIN gates USING (repo)""",
    "bas_baseline_entries": f"{FINDINGS} SELECT repo, hash, path AS file, line_number AS line, "
                            "algorithm_id AS algorithm, quantum_risk AS risk, severity, source "
                            "FROM findings",
    "dif1_diff_findings": f"{DIFF} SELECT repo, hash, path, line_number, algorithm_id, "
                          f"quantum_risk, severity, source, diff_class, {_STATUS} FROM diff",
    "dif2_resolved": f"{DIFF} SELECT repo, hash, path AS file, line_number AS line, algorithm_id AS "
                     "algorithm, quantum_risk AS risk, severity, source FROM diff "
                     "WHERE diff_class = 'resolved'",
    "dif3_diff_summary": f"""{DIFF} SELECT r.repo, count(*) FILTER (diff_class = 'new') AS new,
  count(*) FILTER (diff_class = 'worsened') AS worsened,
  count(*) FILTER (diff_class = 'resolved') AS resolved,
  count(*) FILTER (diff_class = 'unchanged') AS unchanged,
  {_NEW} > 0 AS has_new_debt FROM (SELECT DISTINCT repo FROM files) r
  LEFT JOIN diff d ON r.repo = d.repo GROUP BY r.repo""",
    "dif5_reported": f"{DIFF} SELECT repo, path, line_number, algorithm_id, source, severity, "
                     f"{_STATUS} FROM diff WHERE diff_class IN ('new', 'worsened')",
    "pol5_diff_gate": f"""{DIFF}, {PER_REPO}, worst AS (
  SELECT repo, min({index_of('severity')}) AS worst, count(*) AS new_findings FROM diff
  WHERE diff_class IN ('new', 'worsened') GROUP BY repo)
SELECT repo, worst, coalesce(new_findings, 0) AS new_findings,
  CASE WHEN threshold IS NULL THEN coalesce(new_findings, 0) > 0
       ELSE coalesce(worst <= threshold, false) OR coalesce(new_findings, 0) > max_new END AS fails
FROM (SELECT DISTINCT repo FROM files) LEFT JOIN worst USING (repo) LEFT JOIN gates USING (repo)""",
    "agg1_agg2_readiness": f"""{FINDINGS}, counted AS (SELECT repo, count(*) AS total_findings,
  count(*) FILTER (quantum_risk = 'VULNERABLE') AS vulnerable,
  count(*) FILTER (quantum_risk = 'PARTIAL') AS partial,
  count(*) FILTER (quantum_risk = 'SAFE') AS safe FROM findings GROUP BY repo),
scored AS (SELECT f.repo, f.total_files_scanned, coalesce(total_findings, 0) AS total_findings,
  coalesce(vulnerable, 0) AS vulnerable, coalesce(partial, 0) AS partial, coalesce(safe, 0) AS safe,
  CASE WHEN coalesce(total_findings, 0) = 0 THEN 100.0::DOUBLE
       ELSE safe::DOUBLE / total_findings * 100 END AS quantum_ready_score
  FROM (SELECT repo, count(*) FILTER ((is_source OR is_config) AND NOT excluded)
        AS total_files_scanned FROM files GROUP BY repo) f
  LEFT JOIN counted USING (repo))
SELECT *, CASE WHEN quantum_ready_score >= 80 THEN 'green' WHEN quantum_ready_score >= 50
  THEN 'yellow' ELSE 'red' END AS score_band FROM scored""",
    "agg4_sarif_rules": f"""{FINDINGS} SELECT repo, algorithm_id,
  arg_min(algorithm_name, seq) AS algorithm_name, arg_min(quantum_risk, seq) AS quantum_risk,
  arg_min(reason, seq) AS reason, arg_min(replacement, seq) AS replacement,
  CASE arg_min(quantum_risk, seq) WHEN 'VULNERABLE' THEN 'error' WHEN 'SAFE' THEN 'note'
    ELSE 'warning' END AS default_level FROM findings GROUP BY repo, algorithm_id""",
    "agg5_cbom_components": f"""{FINDINGS}, firsts AS (SELECT *, count(*) OVER (
    PARTITION BY repo, algorithm_id) AS occurrences FROM findings
  QUALIFY row_number() OVER (PARTITION BY repo, algorithm_id ORDER BY seq) = 1),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY seq) - 1)::INT AS i FROM firsts)
SELECT repo, algorithm_id, occurrences, algorithm_name, algorithm_type, quantum_risk, replacement,
  source, confidence, context, severity, category, remediation, i AS component_index,
  'crypto-' || algorithm_id || '-' || i AS bom_ref,
  CASE algorithm_type WHEN 'protocol' THEN 'protocol' ELSE 'algorithm' END AS asset_type,
  CASE algorithm_id WHEN 'RSA' THEN '1.2.840.113549.1.1.1' WHEN 'DSA' THEN '1.2.840.10040.4.1'
    WHEN 'ECDSA' THEN '1.2.840.10045.2.1' WHEN 'AES-256' THEN '2.16.840.1.101.3.4.1.41'
    WHEN 'AES-128' THEN '2.16.840.1.101.3.4.1.1' WHEN 'SHA-256' THEN '2.16.840.1.101.3.4.2.1'
    WHEN 'SHA-384' THEN '2.16.840.1.101.3.4.2.2' WHEN 'SHA-512' THEN '2.16.840.1.101.3.4.2.3'
    WHEN 'SHA-1' THEN '1.3.14.3.2.26' WHEN 'MD5' THEN '1.2.840.113549.2.5'
    WHEN 'Ed25519' THEN '1.3.101.112' WHEN 'X25519' THEN '1.3.101.110' END AS oid,
  CASE algorithm_type WHEN 'asymmetric' THEN CASE WHEN algorithm_id IN
      ('RSA', 'ECDH', 'DH', 'X25519', 'X448', 'ElGamal') THEN 'pke' ELSE 'signature' END
    WHEN 'symmetric' THEN 'blockcipher' WHEN 'hash' THEN 'hash' WHEN 'kdf' THEN 'kdf'
    WHEN 'mac' THEN 'mac' END AS primitive FROM ranked""",
    "rpt2_sarif_results": f"{FINDINGS} {sarif_results('NULL::VARCHAR', 'findings')}",
    "rpt2_diff_results": f"{DIFF_FINDINGS} {sarif_results('diff_status', 'reported')}",
    "srt1_findings_listing": f"{FINDINGS} {in_order(listing('NULL', 'findings'), 'risk_ord')}",
    "srt1_diff_listing": f"{DIFF_FINDINGS} {in_order(listing('diff_status', 'reported'), 'risk_ord')}",
    "adv1_advice": FINDINGS + in_order(f"""SELECT repo, CASE quantum_risk WHEN 'VULNERABLE' THEN 0
    WHEN 'PARTIAL' THEN 1 ELSE 2 END AS advice_ord,
  {KEYS},
  CASE quantum_risk WHEN 'VULNERABLE' THEN 'CRITICAL: ' || algorithm_name || ' at ' || place
      || ' has to go (' || reason || '); use ' || replacement
    WHEN 'PARTIAL' THEN 'WARNING: ' || algorithm_name || ' at ' || place || ' is weak (' || reason
      || '); think of ' || replacement
    ELSE 'INFO: no entry for ' || algorithm_id || ', found at ' || place END AS message
FROM (SELECT *, path || coalesce(':' || line_number, '') AS place FROM findings)
WHERE quantum_risk <> 'SAFE'""", "advice_ord"),
    "src3_exposed_algorithms": f"WITH {LIBS} SELECT library_id, unnest(range(len(exposes)))::INT AS "
                               "expose_ord, 'P' || unnest(exposes) AS algorithm_id FROM libs",
    "src4_all_patterns": f"WITH {PARTS} SELECT algorithm_id, unnest(range(len(patterns)))::INT AS "
                         "pat_ord, unnest(patterns) AS pattern FROM parts",
    "qc1_unknown_exposed": f"WITH {PARTS}, {LIBS} SELECT library_id, 'P' || e AS algorithm_id FROM "
                           "(SELECT library_id, unnest(exposes) AS e FROM libs) "
                           "WHERE 'P' || e NOT IN (SELECT algorithm_id FROM parts)",
    "qc2_repeated_patterns": f"WITH {PARTS} SELECT algorithm_id, pattern, count(*) AS times FROM "
                             "(SELECT algorithm_id, unnest(patterns) AS pattern FROM parts) "
                             "GROUP BY ALL HAVING count(*) > 1",
    "qc2_blank_patterns": f"WITH {PARTS} SELECT algorithm_id FROM parts WHERE len(patterns) = 0 "
                          "OR list_contains(list_transform(patterns, lambda x: trim(x)), '')",
    "qc3_algorithm_problems": f"WITH {PARTS} " + problems("parts", "algorithm_id", {
        "type": "type IN ('asymmetric', 'symmetric', 'hash', 'kdf', 'mac', 'protocol')",
        "quantum_risk": "quantum_risk IN ('VULNERABLE', 'PARTIAL', 'SAFE', 'UNKNOWN')",
        "category": "category = 'hash'",
        "replacement": "quantum_risk <> 'VULNERABLE' OR length(replacement) > 10"}),
    "qc3_library_problems": f"WITH {LIBS} " + problems("libs", "library_id", {
        "ecosystem": "ecosystem IN ('python', 'npm', 'go', 'java', 'rust')",
        "package_name": "package_name <> ''", "exposes": "len(exposes) > 0",
        "default_risk": "default_risk IN ('VULNERABLE', 'PARTIAL', 'SAFE')"}),
    "qc4_reference_problems": f"WITH {PARTS}, asym AS (SELECT *, type = 'asymmetric' "
                              "AND quantum_risk = 'VULNERABLE' AS is_asym FROM parts) "
                              + problems("asym", "algorithm_id", {
        "no standard body": "body <> 'other'",
        "no cnsa reference": "NOT is_asym OR body = 'cnsa'",
        "no eu deadlines": "NOT is_asym OR has_full"}),
}
ORACLES["rpt1_json_documents"] = JSON_DOCUMENTS
ORACLES["rpt1_diff_documents"] = JSON_DIFF_DOCUMENTS
ORACLES["rpt2_sarif_documents"] = SARIF_DOCUMENTS
ORACLES["rpt3_cbom_documents"] = cbom_documents(ORACLES["agg5_cbom_components"])
ORACLES["bas2_baseline_documents"] = BASELINE_DOCUMENTS
ORACLES["src5_load_baselines"] = ORACLES["bas_baseline_entries"]
ORACLES["src1_tree_round_trip"] = ORACLES["src1_fil1_select_files"]
ORACLES["scn1_scan_chunks"] = ORACLES["scn1_scan_source"]
ORACLES["dif3_stored_baseline"] = ORACLES["dif3_diff_summary"]
ORACLES["fil7_stored_dependencies"] = ORACLES["dep9_scan_dependencies"]
