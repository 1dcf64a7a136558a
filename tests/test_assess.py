"""Classification, context, confidence, severity, policy."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cryptoscape.operators import classify as cl
from cryptoscape.operators import policy as po

DAY = dt.date(2026, 6, 30)


def test_classify_keeps_unknown_algorithms(make_findings):
    df = make_findings({}, {"algorithm_id": "AES-256"}, {"algorithm_id": "rsa"}, {"algorithm_id": "Q"})
    rows = {r.algorithm_id: r for r in cl.classify(df).collect()}
    assert (rows["RSA"].quantum_risk, rows["RSA"].algorithm_type) == ("VULNERABLE", "asymmetric")
    assert rows["AES-256"].quantum_risk == "SAFE"
    for name in ("rsa", "Q"):
        r = rows[name]
        assert (r.algorithm_name, r.algorithm_type, r.quantum_risk, r.reason, r.replacement) == (
            name, "unknown", "UNKNOWN", "Algorithm not in database", "")


def test_classify_with_a_bad_catalogue_gives_no_rows(make_findings, tmp_path):
    assert cl.classify(make_findings({}), tmp_path / "none.json").count() == 0
    (tmp_path / "bad.json").write_text('{"other": 1}')
    assert cl.classify(make_findings({}), str(tmp_path / "bad.json")).count() == 0


CONTEXTS = {
    ("src/a.py", "x = RSA"): "runtime", ("test_a.py", "x"): "test", ("a/test_b/c.py", "x"): "test",
    ("src/a_test.py", "x"): "test", ("a_test.go", "x"): "runtime", ("tests/a/b.py", "x"): "test",
    ("x/__tests__/a.js", "x"): "test", ("a/spec/b.rb", "x"): "test", ("a_spec.rb", "x"): "test",
    ("latest/a.py", "x"): "runtime", ("mytests/a.py", "x"): "runtime", ("test/docs/a.md", "x"): "test",
    ("docs/a.py", "x"): "docs", ("a/b.md", "x"): "docs", ("a.rst", "x"): "docs",
    ("README.py", "x"): "docs", ("x/CHANGELOG/a.py", "x"): "docs", ("MYREADME.py", "x"): "runtime",
    ("build/a.js", "x"): "build", ("a/dist/b.js", "x"): "build", ("a.min.js", "x"): "build",
    ("x/Makefile", "x"): "build", ("Makefile.py", "x"): "runtime", ("Dockerfile", "x"): "build",
    ("win\\tests\\a.py", "x"): "test", ("docs/a.py", "# RSA"): "docs",
    ("a.py", "# RSA"): "comment", ("a.py", "  // RSA"): "comment", ("a.py", "\t/* RSA"): "comment",
    ("a.py", "* RSA"): "comment", ("a.py", '"""RSA'): "comment", ("a.py", "'''RSA"): "comment",
    ("a.py", "\xa0# RSA"): "comment", ("a.py", "x # RSA"): "runtime", ("a.py", ""): "runtime",
}

CONFIDENCE = {
    # (line, source, path): confidence
    ("import rsa", "source_code", "a.py"): "high", ("  from x import y", "source_code", "a.py"): "high",
    ("use ring::rsa", "source_code", "a.rs"): "high", ("c = require('x')", "source_code", "a.js"): "high",
    ("important RSA", "source_code", "a.py"): "medium", ("k.generate(RSA)", "source_code", "a.py"): "high",
    ("new Cipher (x)", "source_code", "a.py"): "high", ("x. sign (RSA)", "source_code", "a.py"): "high",
    ("k.Generate(RSA)", "source_code", "a.py"): "medium", ("RSA", "dependency", "a.py"): "high",
    ("RSA", "config", "docs/a.json"): "high", ("# RSA", "source_code", "a.py"): "low",
    ("# k.sign(RSA)", "source_code", "a.py"): "high", ("RSA", "source_code", "docs/a.py"): "low",
    ("import rsa", "source_code", "tests/a.py"): "high", ("RSA", "source_code", "tests/a.py"): "medium",
}


def test_context_and_confidence(make_findings):
    df = make_findings(*[{"path": p, "line_text": t} for p, t in CONTEXTS])
    rows = cl.enrich_findings(df).collect()
    assert {(r.path, r.line_text): r.context for r in rows} == CONTEXTS
    df = make_findings(*[{"line_text": t, "source": s, "path": p} for t, s, p in CONFIDENCE])
    rows = cl.enrich_findings(df).collect()
    assert {(r.line_text, r.source, r.path): r.confidence for r in rows} == CONFIDENCE


def test_severity(spark):
    expected = {
        ("VULNERABLE", "high"): ("critical", "low"), ("VULNERABLE", "medium"): ("high", "medium"),
        ("VULNERABLE", "low"): ("medium", "medium"), ("PARTIAL", "high"): ("high", "info"),
        ("PARTIAL", "medium"): ("medium", "low"), ("PARTIAL", "low"): ("low", "low"),
        ("SAFE", "high"): ("info", "info"), ("UNKNOWN", "high"): ("medium", "medium"),
    }
    cases = [(r, c, ctx) for r, c in expected for ctx in ("runtime", "test", "docs", "comment", "build")]
    rows = spark.createDataFrame(cases, "r string, c string, x string").select(
        "*", cl.severity_of("r", "c", "x").alias("s")).collect()
    for r in rows:
        assert r.s == expected[r.r, r.c][r.x != "runtime"]


def test_category_and_sarif_level(make_findings, spark):
    df = cl.assess(make_findings({}, {"algorithm_id": "Q"}))
    rows = {r.algorithm_id: r for r in df.collect()}
    assert rows["RSA"].category == "pki" and rows["RSA"].remediation
    assert rows["Q"].category is None and rows["Q"].remediation is None
    levels = dict(spark.createDataFrame(
        [(s,) for s in ("critical", "high", "medium", "low", "info", "odd")], "s string").select(
        "s", cl.sarif_level("s")).collect())
    assert levels == {"critical": "error", "high": "error", "medium": "warning", "low": "note",
                      "info": "note", "odd": "warning"}


# --- policy ---------------------------------------------------------------------


def policy(**parts):
    return po.policy_from_dict({"version": "1", **parts})


def kept(findings, pol, as_of=DAY):
    return {(r.path, r.algorithm_id): r.severity
            for r in po.apply_policy(findings, pol, as_of).collect()}


@pytest.fixture(scope="module")
def assessed(make_findings):
    return cl.assess(make_findings(
        {"path": "src/a.py"}, {"path": "vendor/x/b.py"}, {"path": "legacy/auth/c/d.py"},
        {"path": "src/a.py", "algorithm_id": "MD5"}, {"path": "src/a.py", "algorithm_id": "SHA-256"})
    ).persist()


def test_ignore(assessed):
    p = policy(ignore={"paths": ["vendor/**", "*.go"], "algorithms": ["md5"]})
    assert set(kept(assessed, p)) == {("src/a.py", "RSA"), ("legacy/auth/c/d.py", "RSA"),
                                      ("src/a.py", "SHA-256")}


@pytest.mark.parametrize("rule, allowed", [
    ({"paths": ["legacy/auth/**"]}, True), ({"paths": ["legacy/*"], "expires": "2026-06-30"}, True),
    ({"paths": ["legacy/*"], "expires": "2026-06-29"}, False), ({"paths": ["src/*"]}, False),
    ({"paths": []}, False), ({}, False), ({"paths": ["x", "leg*"], "expires": dt.date(2030, 1, 1)}, True),
])
def test_allow(assessed, rule, allowed):
    p = policy(allow=[{"algorithm": "rsa", "reason": "r", **rule}])
    assert (("legacy/auth/c/d.py", "RSA") not in kept(assessed, p)) == allowed


def test_last_override_wins_and_applies_to_safe(assessed):
    p = policy(severity_overrides=[
        {"algorithm": "RSA", "severity": "low", "reason": "r"},
        {"algorithm": "rsa", "severity": "info", "reason": "r"},
        {"algorithm": "SHA-256", "severity": "critical", "reason": "r"}])
    severities = kept(assessed, p)
    assert severities["src/a.py", "RSA"] == "info"
    assert severities["src/a.py", "SHA-256"] == "critical"
    assert severities["src/a.py", "MD5"] == "high"


def test_gate(assessed):
    low = assessed.withColumn("severity", F.lit("low"))
    for on, fails in (("low", True), ("info", True), ("medium", False)):
        assert po.check_fail_conditions(low, policy(fail={"on_severity": on})).first().fails == fails
    p = policy(fail={"on_severity": "critical", "max_new_findings": 4})
    new = low.withColumn("diff_status", F.lit("new"))
    assert po.check_fail_conditions(new, p, diff_mode=True).first().fails
    assert not po.check_fail_conditions(new, p).first().fails
    odd = assessed.withColumn("severity", F.lit("odd"))
    assert po.check_fail_conditions(odd, policy(fail={"on_severity": "medium"})).first().fails


def test_policy_per_repository(spark, assessed):
    both = assessed.unionByName(assessed.withColumn("repo", F.lit("s")))
    table = po.policies_df(spark, {"r": policy(ignore={"paths": ["*"]})})
    assert {r.repo for r in po.apply_policy(both, table, DAY).collect()} == {"s"}
    gate = {r.repo: r.fails for r in po.check_fail_conditions(both, table).collect()}
    assert gate == {"r": True, "s": False}


def test_many_repositories_with_many_globs(spark, assessed):
    """1,000 policies of 100 globs: what a policy for all repositories gives for each of them."""
    globs = [f"d{i}/**/x{i}*.py" for i in range(60)] + [f"*.e{i}" for i in range(30)] + [
        f"f{i}/[a-c]?/*" for i in range(10)]
    paths = [f"d{i}/a/x{i}b.py" for i in range(8)] + ["a.e3", "f2/bz/q", "f2/dz/q", "src/a.py", "d1/x1.py", ""]
    p = policy(ignore={"paths": globs}, allow=[{"algorithm": "RSA", "paths": ["src/*"], "reason": "r"}])
    one = assessed.limit(1).drop("path").crossJoin(spark.createDataFrame([(x,) for x in paths], "path string"))
    rows = one.drop("repo").crossJoin(spark.range(1000).selectExpr("concat('r', id) AS repo"))
    want = {x for x, _ in kept(one, p)}
    assert want == {"f2/dz/q", "d1/x1.py", ""}
    table = po.policies_df(spark, {f"r{i}": p for i in range(1000)})
    got = po.apply_policy(rows, table, DAY).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in got} == dict.fromkeys(want, 1000)


def test_gate_of_a_repository_without_findings(spark, assessed):
    repos = spark.createDataFrame([("r",), ("clean",)], "repo string")
    for mode in (False, True):
        gate = {r.repo: tuple(r) for r in po.check_fail_conditions(
            assessed, policy(), diff_mode=mode, repos=repos).collect()}
        assert gate["clean"] == ("clean", None, 0, False) and gate["r"][3]
    none = po.apply_policy(assessed, policy(ignore={"paths": ["*"]}), DAY)
    assert [tuple(r)[1:] for r in po.check_fail_conditions(
        none, policy(), repos=repos.where("repo = 'r'")).collect()] == [(None, 0, False)]


def test_policy_files(tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"version": "1", "ignore": {"paths": ["a/*"]}}')
    assert po.load_policy(str(path)).ignore_paths == ["a/*"]
    assert po.load_policy(str(tmp_path / "none.json"), missing_ok=True) is None
    with pytest.raises(FileNotFoundError):
        po.load_policy(str(tmp_path / "none.json"))


@pytest.mark.parametrize("raw", [
    {"version": "1", "ignroe": {}}, {"version": "1", "ignore": {"path": []}}, [],
    {"version": "1", "fail": {"on": "low"}}, {"version": "1", "fail": {"max_new_findings": True}},
    {"version": "1", "allow": [{"algorithm": "x", "reason": "r", "until": "2030-01-01"}]},
    {}, {"version": "1", "fail": {"on_severity": "bad"}}, {"version": "1", "allow": [{"algorithm": "x"}]},
    {"version": "1", "allow": [{"algorithm": "x", "reason": "r", "expires": "soon"}]},
    {"version": "1", "severity_overrides": [{"algorithm": "x", "severity": "odd", "reason": "r"}]},
    {"version": "1", "ignore": {"paths": "x"}}, {"version": "1", "fail": {"max_new_findings": "1"}},
])
def test_invalid_policies(raw):
    with pytest.raises(po.PolicyError):
        po.policy_from_dict(raw)


def test_policy_defaults():
    p = policy()
    assert (p.on_severity, p.max_new_findings, p.ignore_paths, p.allow) == ("high", 0, [], [])
