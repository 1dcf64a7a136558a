"""The source and configuration scan, against brute force and against single cases."""

import random
import time
import re

import pytest

from cryptoscape.operators.config_rules import config_patterns
from cryptoscape.operators.files import CLASS_BIT, select_manifests, store_corpus
from cryptoscape.operators.pattern_index import build_index, one_of, pattern_anchors
from cryptoscape.operators.patterns import compile_patterns, guard_terms, pattern_words
from cryptoscape.operators.scan import scan_config, scan_files, scan_order, scan_source
from cryptoscape.sources.catalogue import algorithms_from_dict, load_algorithms


def catalogue(**patterns):
    return algorithms_from_dict({
        k.replace("_", "-"): {"name": k, "type": "hash", "quantum_risk": "SAFE", "reason": "r",
                              "replacement": "x", "patterns": v} for k, v in patterns.items()})


def python_regex(pattern):
    """What a pattern means, in the regexes of Python."""
    if any(m in pattern for m in (".*", ".+", "\\", "[", "]", "(", ")", "|")):
        return re.compile(pattern, re.I)
    body = re.sub("[-_]", "[-_ ]?", pattern) if re.search("[-_]", pattern) else re.escape(pattern)
    return re.compile(f"(?<![a-zA-Z0-9]){body}(?![a-zA-Z0-9])", re.I)


def brute_force(files, algorithms):
    compiled = [(a.id, python_regex(p)) for a in algorithms.values() for p in a.patterns]
    found = set()
    for path, text in files.items():
        for n, line in enumerate(text.splitlines(), 1):
            seen = set()
            for algorithm, regex in compiled:
                match = regex.search(line)
                if match and algorithm not in seen:
                    seen.add(algorithm)
                    found.add((path, n, match.group(0), algorithm, line.strip()))
    return found


def random_files(seed, count):
    rng = random.Random(seed)
    patterns = [p for a in load_algorithms().values() for p in a.patterns]
    glue = [" ", "_", "-", ".", "(", "\u00e9", "x", "9", "", "\t", "\u017f", "\u212a", "\n", "\r\n", "\u2028"]

    def word():
        p = rng.choice(patterns).replace(".*", rng.choice(["('", "xx", ""]))
        p = re.sub("[-_]", lambda _: rng.choice(["-", "_", " ", "", "--"]), p)
        p = rng.choice([str, str.upper, str.lower, str.swapcase])(p)
        if rng.random() < 0.1:
            p = p.replace("s", "\u017f").replace("k", "\u212a").replace("i", "\u0131")
        return p

    return {f"f{i}.py": "".join(word() + rng.choice(glue) for _ in range(rng.randint(1, 8)))
            for i in range(count)}


def rows(df):
    return {(r.path, r.line_number, r.matched_text, r.algorithm_id, r.line_text)
            for r in df.collect()}


def test_all_patterns_equal_brute_force(corpus):
    files = random_files(7, 1500)
    expected = brute_force(files, load_algorithms())
    assert len(expected) > 3000
    assert rows(scan_source(corpus(files))) == expected


def test_custom_patterns_equal_brute_force(corpus):
    algorithms = catalogue(
        A=["foo.bar", "a_b.c", "x+y"], B=["colou?r.*end", r"\bw\w+d\b"], C=["é-b", "GNU License"],
        D=["key_?", "(one|two)"], E=["z*|q"])
    texts = ["foo.bar fooxbar", "a bxc A_B.C a-bZc", "x+y xxy", "color is the END", "word wörd",
             "É b", "gnu  license gnu license", "key ke key_", "two one", "", "zzz", "plain"]
    files = {f"g{i}.go": t for i, t in enumerate(texts)}
    assert rows(scan_source(corpus(files), algorithms)) == brute_force(files, algorithms)


def test_malformed_pattern_is_left_out(spark):
    assert compile_patterns(spark, catalogue(BAD=["(?P<open"], OK=["(?P<n>x)"]))[0].regex == "(?iU)(?<n>x)"
    assert len(compile_patterns(spark)) == 207


@pytest.mark.parametrize("pattern, text, hits", [
    ("RSA", "RSA_OAEP", True), ("RSA", "0RSA1", False), ("RSA", "generateRSAKey", False),
    ("DES", "description", False), ("DH", "DHTML", False), ("RC4", "SRC4", False),
    ("SHA-256", "SHA 256", True), ("SHA-256", "SHA--256", False), ("AES-128-CBC", "aes128cbc", True),
    ("TLSv1.0", "tlsv1.0", True), ("TLSv1.0", "TLSv1x0", False),
])
def test_boundaries(pattern, text, hits):
    # The words of the guard hold wherever the pattern matches.
    assert bool(python_regex(pattern).search(text)) == hits
    if hits:
        assert all(w in text.lower() for w in pattern_words(pattern))


def test_guard_terms_drop_what_others_cover():
    assert guard_terms([("rsa", "generate"), ("rsa",), ("dsa",)]) == [("dsa",), ("rsa",)]
    assert guard_terms([("rsa",), ()]) is None


def test_large_catalogue_equals_brute_force(corpus):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 6))) for _ in range(1500)]
    algorithms = catalogue(**{f"A{i}": words[i::60] for i in range(60)})
    files = {f"f{i}.py": " ".join(rng.choice(words) + rng.choice(["", "x"]) for _ in range(5))
             for i in range(100)}
    assert rows(scan_source(corpus(files), algorithms)) == brute_force(files, algorithms)


def test_first_pattern_names_the_match_and_lines_are_deduplicated(corpus):
    found = scan_source(corpus({"a.py": "  use rsa_sign, RSA and SHA256 or sha256  \n"})).collect()
    assert {(f.algorithm_id, f.matched_text, f.line_text) for f in found} == {
        ("RSA", "rsa", "use rsa_sign, RSA and SHA256 or sha256"),
        ("SHA-256", "SHA256", "use rsa_sign, RSA and SHA256 or sha256")}


def test_files_that_are_not_scanned(corpus):
    big = b"RSA\n" + b"x" * 1_000_000
    files = {"bin.py": b"RSA\x00", "late.py": b"x" * 8192 + b"\x00\nRSA", "big.py": big,
             "fits.py": b"RSA\n" + b"x" * 999_996, "node_modules/a.js": "RSA", "a.md": "RSA",
             "bad.py": b"RSA \xff\n", "empty.py": "", "x.PY": "RSA"}
    def paths(**limits):
        return {f.path for f in scan_files(corpus(files), sources=["source_code"], **limits).collect()}

    assert paths() == {"big.py", "fits.py", "bad.py", "x.PY"}
    assert paths(max_bytes=1_000_000, probe_bytes=8192) == {"late.py", "fits.py", "bad.py", "x.PY"}


def test_lines_of_a_scan_are_those_of_python(corpus):
    """Line numbers and texts with every kind of line break, in scans and manifests."""
    ends = ["\n", "\r\n", "\r", "\r\r\n", "\n\r", "\f", "\x0b", "\x1c", "\x1d", "\x1e", "\x85",
            "\u2028", "\u2029"]
    rng = random.Random(11)
    files = {f"f{i}.py": "".join(rng.choice(["x", "use MD5 here", ""]) + rng.choice(ends)
                                 for _ in range(12)) for i in range(60)}
    files |= {f"d{i}.py": f"x{e}use MD5 here{e}" for i, e in enumerate(ends)}
    found = {(f.path, f.line_number, f.line_text) for f in scan_source(corpus(files)).collect()}
    assert found == {(p, i, line.strip()) for p, t in files.items()
                     for i, line in enumerate(t.splitlines(), 1) if "MD5" in line}
    manifests = {f"m{i}/requirements.txt": f"x{e}bcrypt{e}" for i, e in enumerate(ends)}
    found = {(f.path, f.line_number) for f in scan_files(corpus(manifests)).collect()}
    assert found == {(p, i) for p, t in manifests.items()
                     for i, line in enumerate(t.splitlines(), 1) if line == "bcrypt"}


@pytest.mark.parametrize("letters, longest", [("ab", 3), ("abc-_ .+]^", 4), ("abcdefghijklmnopqrstuvwxyz09", 2)])
def test_one_regex_finds_the_longest_word_at_every_place(spark, letters, longest):
    rng = random.Random(3)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(60)}
    text = "".join(rng.choice(letters + "#") for _ in range(400))
    expected = [max((w for w in words if text.startswith(w, i)), key=len) for i in range(len(text))
                if any(text.startswith(w, i) for w in words)]
    df = spark.createDataFrame([(text,)], "t string")
    pattern = f"(?=({one_of(words)}))".replace("\\", "\\\\").replace("'", "\\'")
    assert df.selectExpr(f"regexp_extract_all(t, '{pattern}', 1)").first()[0] == expected


def test_anchors_are_the_rarest_pieces():
    assert pattern_anchors([("rsa",), ("generate", "rsa"), (), ("generaty",)]) == [
        "rsa", "nerate", "", "neraty"]


def test_words_that_start_other_words_are_all_tried(corpus):
    algorithms = catalogue(A=["ab"], B=["ab-c"], C=["abcdefgh"], D=["abcdef"], E=["abcdefgh", "b"], F=["x.*ab"])
    files = {f"f{i}.py": t for i, t in enumerate(
        ["ab", "abc", "AB-C ab", "abcdefgh", "abcdef b", "x abcdef", "xab", "b ab abcdefgh\nab", "none"])}
    assert rows(scan_source(corpus(files), algorithms)) == brute_force(files, algorithms)


def test_bounded_patterns_are_looked_for_at_word_starts_only(spark):
    """Inside words of a source file no pattern is named but those without a bound."""
    index = build_index([*compile_patterns(spark), *config_patterns()])
    source = CLASS_BIT["source"]
    df = spark.createDataFrame([("universal besides adsa ssl_protocols",), ("(rsa universal_md5",), ("xhmac.x",)],
                               "t string")
    found = [r[0] for r in df.selectExpr(index.found_anchors("t", str(source))).collect()]
    assert found[:2] == [[], ["rsa", "md5"]] and len(found[2]) == 1
    assert [r[0] for r in df.selectExpr(index.may_match("t", str(source))).collect()] == [False, True, True]
    tls = CLASS_BIT["tls"]
    assert df.selectExpr(index.found_anchors("t", str(source | tls))).first()[0]


def test_bounds_beside_letters_that_fold(corpus):
    algorithms = catalogue(A=["RSA"], B=["a?b-c"], C=["SHA-256", "sk+i-x"], D=["-x", "3DES"], E=["xk.*RSA"], F=["RSA_k"])
    beside = ["", "x", "9", "_", "-", "\u0131", "\u0130", "\u017f", "\u212a", "\u00e9", "\U0001d400", "."]
    words = ["RSA", "b-c", "ab_c", "c", "SHA256", "sha-256", "\u017fha 256", "s\u212aki-x", "si-x", "skix", "3des", "xkRSA",
             "rsa\u212a"]
    files = {f"f{i}.py": "\n".join(f"{b}{w}{a}" for b in beside for a in ("", "x", b)) for i, w in enumerate(words)}
    assert rows(scan_source(corpus(files), algorithms)) == brute_force(files, algorithms)


def test_index_names_few_patterns_a_line(spark):
    """Anchors of thousands of patterns stay apart, so a line that holds one tries one."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)})
    index = build_index(compile_patterns(spark, catalogue(**{f"A{i}": words[i::500] for i in range(500)})))
    numbers = index.found_anchors("t")
    df = spark.createDataFrame([(w,) for w in words], "t string").selectExpr(f"size({numbers}) AS n")
    assert df.selectExpr("min(n)", "avg(n) < 1.1").first() == (1, True)


def test_thousands_of_patterns_end_in_bounded_time(corpus):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)})
    algorithms = catalogue(**{f"A{i}": words[i::500] for i in range(500)})
    files = {f"f{i}.py": "\n".join(rng.choice(words) for _ in range(20)) for i in range(10)}
    start = time.monotonic()
    assert scan_source(corpus(files), algorithms).count() >= 200
    assert time.monotonic() - start < 120


def test_null_content_is_skipped(spark):
    df = spark.createDataFrame([("r", "a.py", None), ("r", "b.py", bytearray(b"RSA"))],
                               "repo string, path string, content binary")
    assert [f.path for f in scan_files(df).collect()] == ["b.py"]


def test_order_of_a_scan(corpus):
    files = {"b.py": "RSA\nMD5 RSA", "a/z.py": "RSA", "a.py": "RSA", "a.b/requirements.txt": "jose",
             "a/requirements.txt": "bcrypt", "k.pem": "-----BEGIN RSA PRIVATE KEY-----"}
    ordered = scan_files(corpus(files)).orderBy(*scan_order()).collect()
    places = [(f.path, f.line_number, f.algorithm_id) for f in ordered]
    assert places[:5] == [("a.py", 1, "RSA"), ("a/z.py", 1, "RSA"), ("b.py", 1, "RSA"),
                          ("b.py", 2, "RSA"), ("b.py", 2, "MD5")]
    # By component, "a" is before "a.b".
    assert places[5] == ("a/requirements.txt", 1, "bcrypt") and places[6][0] == "a.b/requirements.txt"
    assert places[-1] == ("k.pem", 1, "RSA")


def test_sample_project(corpus):
    files = {
        "app.py": "import hashlib\n\nx = hashlib.sha256(p).hexdigest()\n"
                  "y = hmac.new(k, m, hashlib.sha1).hexdigest()\n",
        "index.ts": "import { createCipheriv } from 'crypto';\nconst h = createHash('sha256');\n"
                    "createCipheriv('aes-128-cbc', k)\nfunction generateRSAKey() { g('rsa') }\n",
    }
    found = {(f.path, f.line_number, f.algorithm_id) for f in scan_source(corpus(files)).collect()}
    assert found == {("app.py", 3, "SHA-256"), ("app.py", 4, "SHA-1"), ("app.py", 4, "HMAC-SHA1"),
                     ("index.ts", 1, "AES-128"), ("index.ts", 2, "SHA-256"),
                     ("index.ts", 3, "AES-128"), ("index.ts", 4, "RSA")}


CONFIG_CASES = {
    # path: (text, [(line, algorithm, matched text)])
    "nginx.conf": ("x\nssl_protocols TLSv1 TLSv1.1 TLSv1.2;", [
        (2, "TLS-1.0", "ssl_protocols TLSv1"), (2, "TLS-1.1", "ssl_protocols TLSv1 TLSv1.1")]),
    "ok.conf": ("ssl_protocols TLSv1.2 TLSv1.3;\nssl_protocolsTLSv1", []),
    "httpd.conf": ("sslprotocol all +TLSv1\nSSLProtocol TLSv1.2", [
        (1, "TLS-1.0", "sslprotocol all +TLSv1")]),
    "haproxy.cfg": ("ssl-min-ver TLSv1.0", [(1, "TLS-1.0", "ssl-min-ver TLSv1.0")]),
    "openssl.cnf": ("default_bits = 2048\ndefault_bits = 4096\ndefault_md=SHA1\nDEFAULT_MD = md5\n"
                    "MinProtocol = TLSv1\nDefault_bits = 512", [
        (1, "RSA", "default_bits = 2048"), (3, "SHA-1", "default_md=SHA1"),
        (4, "MD5", "DEFAULT_MD = md5"), (5, "TLS-1.0", "MinProtocol = TLSv1")]),
    ".env": ("TLS_VERSION=1.0\nJWT_ALGORITHM = RS256\ntls_version=1.0\nTLS_VERSION=1.01", [
        (1, "TLS-1.0", "TLS_VERSION=1.0"), (2, "JWT-RS256", "JWT_ALGORITHM = RS256")]),
    "d/.env.local": ("JWT_ALGORITHM=RS256", [(1, "JWT-RS256", "JWT_ALGORITHM=RS256")]),
    "prod.env": ("JWT_ALGORITHM=RS256", []),
    "id.pub": ("ssh-rsa A\n ssh-rsa B\nssh-dss C\necdsa-sha2-nistp384 D\nssh-ed25519 E\nSSH-RSA F", [
        (1, "SSH-RSA", "ssh-rsa "), (3, "DSA", "ssh-dss "),
        (4, "ECDSA", "ecdsa-sha2-nistp384 "), (5, "Ed25519", "ssh-ed25519 ")]),
    "sshd_config": ("ciphers aes128-ctr,3DES-cbc\nMACs hmac-sha1\nMACs hmac-sha1x\n"
                    "KexAlgorithms x,diffie-hellman-group1", [
        (1, "3DES", "ciphers aes128-ctr,3DES"), (1, "AES-128", "ciphers aes128"),
        (2, "HMAC-SHA1", "MACs hmac-sha1"), (4, "DH", "KexAlgorithms x,diffie-hellman")]),
    "jwt.json": ('{"algorithm": "RS256"}\n"alg": "es256"\n"alg" "HS256"', [
        (1, "JWT-RS256", 'algorithm": "RS256'), (2, "JWT-ES256", 'alg": "es256')]),
    "server.pem": ("-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN EC PRIVATE KEY-----\n"
                   "-----BEGIN DSA PRIVATE KEY-----\n-----begin rsa private key-----", [
        (1, "RSA", "-----BEGIN RSA PRIVATE KEY-----"), (2, "ECDSA", "-----BEGIN EC PRIVATE KEY-----"),
        (3, "DSA", "-----BEGIN DSA PRIVATE KEY-----")]),
    "settings.py": ("TLS_VERSION=1.0", []),
    "vendor/nginx.conf": ("ssl_protocols TLSv1", []),
    "nul.conf": ("\x00\nssl_protocols TLSv1", [(2, "TLS-1.0", "ssl_protocols TLSv1")]),
}


def test_config_patterns(corpus):
    found = scan_config(corpus({p: t for p, (t, _) in CONFIG_CASES.items()})).collect()
    expected = {(p, *hit) for p, (_, hits) in CONFIG_CASES.items() for hit in hits}
    assert {(f.path, f.line_number, f.algorithm_id, f.matched_text) for f in found} == expected
    assert len(found) == len(expected)
    texts = {(f.path, f.algorithm_id): f.line_text for f in found}
    assert texts["nginx.conf", "TLS-1.1"] == "nginx TLS 1.1 enabled"
    assert {f.source for f in found} == {"config"}


def test_scan_has_no_shuffle_and_small_methods(corpus):
    """One read, no exchange, and generated methods below the size the JVM compiles."""
    df = scan_files(corpus({"a.py": "RSA", "package.json": "{}"}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [o for o in ("Exchange", "Join ", "EvalPython", "MapIn") if o in plan]
    assert plan.count("Scan ExistingRDD") == 1
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_scan_of_a_stream_of_files(spark, corpus, tmp_path):
    files = corpus({"a.py": "RSA", "requirements.txt": "bcrypt", "x.pem": "none"})
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    query = scan_files(stream).writeStream.format("memory").queryName("stream_findings").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    found = spark.table("stream_findings").select("path", "algorithm_id").collect()
    assert {tuple(r) for r in found} == {("a.py", "RSA"), ("requirements.txt", "bcrypt")}


def test_scans_of_a_stored_corpus_read_their_classes_only(spark, corpus, tmp_path):
    files = corpus(random_files(4, 60) | {
        "package.json": '{"dependencies": {"jose": 1}}', "a/requirements.txt": "bcrypt\n", "n.cfg": "",
        "nginx.conf": "ssl_protocols TLSv1;", "settings.json": "x", "notes.md": "RSA", "node_modules/x.js": "RSA"})
    path = tmp_path / "stored"
    stored = store_corpus(files, str(path))
    assert stored.count() == files.count()
    for sources in (["source_code"], ["dependency"], ["config"], ["source_code", "dependency", "config"]):
        wanted = sorted(scan_files(files, sources=sources).collect())
        assert wanted
        found = scan_files(stored, sources=sources)
        assert sorted(found.collect()) == wanted
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*file_classes", plan)
    wanted = sorted(scan_files(files, sources=["dependency"]).collect())
    # Files of other classes are not opened: they may be no Parquet at all.
    for part in path.glob("file_classes=*"):
        if not int(part.name.split("=")[1]) & CLASS_BIT["manifest"]:
            for f in part.glob("*.parquet"):
                f.write_bytes(b"spoiled" * (f.stat().st_size // 7 + 1))
                f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert sorted(scan_files(stored, sources=["dependency"]).collect()) == wanted
    assert select_manifests(stored).count() == 2
    with pytest.raises(Exception):
        scan_files(stored, sources=["source_code"]).collect()
