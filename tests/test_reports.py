"""Baselines, diffs, aggregates, listings and documents."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cryptoscape.operators import baseline as bl
from cryptoscape.operators import reports as rp
from cryptoscape.operators import summary as sm
from cryptoscape.operators.classify import assess
from cryptoscape.operators.files import count_files
from cryptoscape.functions.storage import numbered
from cryptoscape.plans.inventory import inventory, materialize, stored_inventory

FILES = {
    ("one", "src/a.py"): "key = RSA.generate(1)\nh = sha256(x)\n# MD5 é \"quoted\"\nRSA\n",
    ("one", "b/requirements.txt"): "bcrypt\n",
    ("one", "nginx.conf"): "ssl_protocols TLSv1 TLSv1.1;",
    ("one", "package.json"): '{"dependencies": {"\\u006aose": 1}}',
    ("two", "x.go"): "AES-256 sha512\n",
    ("none", "y.py"): "nothing here\n",
}


@pytest.fixture(scope="module")
def files(corpus):
    return corpus(FILES)


@pytest.fixture(scope="module")
def findings(files, tmp_path_factory):
    return materialize(inventory(files), str(tmp_path_factory.mktemp("shared")), "findings")


@pytest.fixture(scope="module")
def repos(files):
    return count_files(files)


def expected_hash(path, line, algorithm, source):
    return hashlib.sha256(f"{path}:{line}:{algorithm}:{source}".encode()).hexdigest()[:16]


def test_hash(make_findings):
    df = make_findings({}, {"line_number": None}, {"path": "é.py"})
    for r in df.withColumn("h", bl.finding_hash()).collect():
        assert r.h == expected_hash(r.path, r.line_number, r.algorithm_id, r.source)


@pytest.fixture(scope="module")
def diffed(make_findings, spark):
    current = assess(make_findings(*[
        {"path": p, "algorithm_id": a} for p, a in (
            ("new.py", "RSA"), ("same.py", "RSA"), ("worse.py", "RSA"), ("better.py", "SHA-256"),
            ("twice.py", "RSA"), ("unset.py", "RSA"))]))
    line = 10
    entries = [(i, "r", expected_hash(p, line, a, "source_code"), p, line, a, "VULNERABLE", s,
                "source_code") for i, (p, a, s) in enumerate([
        ("same.py", "RSA", "high"), ("worse.py", "RSA", "low"), ("better.py", "SHA-256", "high"),
        ("twice.py", "RSA", "low"), ("twice.py", "RSA", "critical"), ("unset.py", "RSA", None),
        ("gone.py", "MD5", "high"), ("gone.py", "MD5", "low")])]
    baseline = spark.createDataFrame(
        entries, "ord int, repo string, hash string, file string, line int, algorithm string, "
                 "risk string, severity string, source string")
    return bl.diff_findings(current, baseline).persist()


def test_diff_classes(diffed):
    rows = {r.path: (r.diff_class, r.diff_status) for r in diffed.collect()}
    assert rows == {
        "new.py": ("new", "new"), "same.py": ("unchanged", None), "worse.py": ("worsened", "worsened"),
        "better.py": ("unchanged", None), "twice.py": ("unchanged", None),
        "unset.py": ("worsened", "worsened"),  # a baseline without severity counts as medium
        "gone.py": ("resolved", None)}
    assert diffed.count() == 7


def test_diff_summary_and_reported(diffed):
    row = bl.diff_summary(diffed).first().asDict()
    assert row == {"repo": "r", "new": 1, "worsened": 2, "resolved": 1, "unchanged": 3,
                   "has_new_debt": True}
    assert {r.path for r in bl.reported(diffed).collect()} == {"new.py", "worse.py", "unset.py"}
    gone = bl.resolved(diffed).first()
    assert (gone.file, gone.line, gone.algorithm, gone.severity) == ("gone.py", 10, "MD5", "low")


def test_diff_against_empty_sides(diffed, make_findings, spark):
    current = assess(make_findings({}))
    none = spark.createDataFrame([], bl.baseline_entries(current).schema)
    assert [r.diff_class for r in bl.diff_findings(current, none).collect()] == ["new"]
    before = bl.baseline_entries(current)
    empty = current.where(F.lit(False))
    assert [r.diff_class for r in bl.diff_findings(empty, before).collect()] == ["resolved"]


def documents(pieces):
    """Documents by repository: the texts of the pieces in order, each as one text."""
    texts = {}
    for r in pieces.orderBy("repo", *rp.ORDER).collect():
        texts.setdefault(r.repo, []).append(r.text)
    return {repo: ["".join(t)] for repo, t in texts.items()}


@pytest.fixture(scope="module")
def pieces(findings, repos):
    serial = F.lit("urn:uuid:0")
    return {
        "json": rp.json_pieces(findings, repos), "sarif": rp.sarif_pieces(findings, repos),
        "cbom": rp.cbom_pieces(findings, repos, "2026-01-01T00:00:00Z", serial),
        "baseline": rp.baseline_pieces(findings, repos, "2026-01-01T00:00:00Z", "abc"),
    }


@pytest.mark.parametrize("kind", ["json", "sarif", "cbom", "baseline"])
def test_pieces_have_one_shape_and_one_order(pieces, kind):
    df = pieces[kind]
    assert df.columns == ["repo", *rp.ORDER, "text"]
    assert df.select("repo", *rp.ORDER).distinct().count() == df.count()
    assert df.where("repo = 'one'").count() > 5
    assert set(documents(df)) == {"one", "two", "none"}
    for text in documents(df).values():
        json.loads(text[0])


def test_sarif_addresses(findings, repos):
    df = rp.sarif_pieces(findings, repos, help_uri="https://h.example", information_uri="https://i.example")
    driver = json.loads(documents(df)["one"][0])["runs"][0]["tool"]["driver"]
    assert driver["informationUri"] == "https://i.example"
    assert {r["helpUri"] for r in driver["rules"]} == {"https://h.example"}


def test_json_report(pieces):
    reports = {r: json.loads(t[0]) for r, t in documents(pieces["json"]).items()}
    one = reports["one"]
    assert list(one) == ["version", "scan_path", "total_files_scanned", "scan_duration_seconds",
                         "summary", "findings"]
    assert one["total_files_scanned"] == 3 and one["summary"]["total_findings"] == len(one["findings"])
    assert one["summary"]["safe"] == sum(f["quantum_risk"] == "SAFE" for f in one["findings"])
    first = one["findings"][0]
    assert (first["file_path"], first["line_number"], first["algorithm_id"], first["severity"]) == (
        "src/a.py", 1, "RSA", "critical")
    assert len(first) == 16 and first["diff_status"] is None
    assert [f["source"] for f in one["findings"]] == sorted(
        [f["source"] for f in one["findings"]], key=["source_code", "dependency", "config"].index)
    assert reports["none"]["findings"] == []
    assert reports["none"]["summary"]["quantum_ready_score"] == 100.0
    assert reports["two"]["summary"]["quantum_ready_score"] == 100.0


def test_json_report_of_a_diff(findings, repos, spark):
    none = spark.createDataFrame([], bl.baseline_entries(findings).schema)
    diff = bl.diff_findings(findings, none)
    reports = documents(rp.json_pieces(bl.reported(diff), repos, diff))
    one = json.loads(reports["one"][0])
    assert one["diff_summary"] == {"new": len(one["findings"]), "worsened": 0, "resolved": 0,
                                   "unchanged": 0}
    assert {f["diff_status"] for f in one["findings"]} == {"new"}
    assert json.loads(reports["none"][0])["diff_summary"]["new"] == 0


def test_sarif(pieces):
    logs = {r: json.loads(t[0]) for r, t in documents(pieces["sarif"]).items()}
    assert logs["one"]["version"] == "2.1.0" and "$schema" in logs["one"]
    run = logs["one"]["runs"][0]
    rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert rules[:3] == ["cryptoscape/RSA", "cryptoscape/SHA-256", "cryptoscape/MD5"]
    assert len(rules) == len(set(rules)) and {r["ruleId"] for r in run["results"]} == set(rules)
    level = {r["id"]: r["defaultConfiguration"]["level"] for r in run["tool"]["driver"]["rules"]}
    assert level["cryptoscape/RSA"] == "error" and level["cryptoscape/SHA-256"] == "note"
    comment = next(r for r in run["results"] if r["ruleId"] == "cryptoscape/MD5")
    assert comment["level"] == "warning" and comment["properties"]["context"] == "comment"
    assert len(comment["properties"]) == 9
    lines = {r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]
             if r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "package.json"}
    assert lines == {1}  # a finding without a line is on the first one
    empty = logs["none"]["runs"][0]
    assert empty["results"] == [] and empty["tool"]["driver"]["rules"] == []


def test_cbom(pieces):
    boms = {r: json.loads(t[0]) for r, t in documents(pieces["cbom"]).items()}
    bom = boms["one"]
    assert (bom["bomFormat"], bom["specVersion"], bom["version"]) == ("CycloneDX", "1.6", 1)
    assert bom["metadata"]["component"]["name"] == "one"
    by_name = {c["name"]: c for c in bom["components"]}
    refs = [c["bom-ref"] for c in bom["components"]]
    assert refs[:3] == ["crypto-RSA-0", "crypto-SHA-256-1", "crypto-MD5-2"]
    rsa = by_name["RSA"]
    assert rsa["cryptoProperties"] == {"assetType": "algorithm", "oid": "1.2.840.113549.1.1.1",
                                       "algorithmProperties": {"primitive": "pke"}}
    places = [(o["location"], o["line"], o["additionalContext"])
              for o in rsa["evidence"]["occurrences"]]
    assert places == [("src/a.py", 1, "RSA"), ("src/a.py", 4, "RSA"), ("package.json", 1, "jose")]
    assert by_name["TLS 1.0"]["cryptoProperties"] == {"assetType": "protocol"}
    assert by_name["ECDSA"]["cryptoProperties"]["algorithmProperties"] == {"primitive": "signature"}
    assert [p["name"] for p in rsa["properties"]] == [
        f"cryptoscape:{n}" for n in ("quantum_risk", "replacement", "source", "confidence",
                                     "context", "severity", "category", "remediation")]
    assert boms["none"]["components"] == []


def test_baseline_round_trip(pieces, findings, spark, tmp_path):
    text = documents(pieces["baseline"])["one"][0]
    document = json.loads(text)
    hashes = [e["hash"] for e in document["findings"]]
    assert hashes == sorted(hashes) and document["findings_count"] == len(hashes)
    assert list(document["findings"][0]) == ["hash", "file", "line", "algorithm", "risk",
                                             "severity", "source"]
    (tmp_path / "b.json").write_text(text, encoding="utf-8")
    loaded = bl.load_baseline(spark, str(tmp_path / "b.json"), "one")
    one = findings.where("repo = 'one'")
    assert {r.diff_class for r in bl.diff_findings(one, loaded).collect()} == {"unchanged"}


def test_stored_baseline_is_not_shuffled(findings, spark, tmp_path):
    """The same diff as with plain entries; only the findings are exchanged. Another session opens it."""
    entries = bl.baseline_entries(findings).where("algorithm <> 'MD5'").withColumn(
        "severity", F.when(F.col("source") == "config", "info").otherwise(F.col("severity")))
    path = str(tmp_path / "stored")
    stored = bl.store_baseline(entries, "kept_baseline", path, 4)
    want = sorted(map(repr, bl.diff_findings(findings, entries).collect()))
    assert want
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, entries.collect()), key=repr)
        spark.sql("DROP TABLE kept_baseline")  # the files of a table with a path stay
        opened = bl.open_baseline(spark, "kept_baseline", path, 4)
        for before in (opened, bl.open_baseline(spark, "kept_baseline", path, 4)):
            diff = bl.diff_findings(findings, before)
            assert sorted(map(repr, diff.collect())) == want
            assert exchanges(diff) == exchanges(bl.diff_findings(findings, entries)) - 1
        with pytest.raises(ValueError):
            bl.open_baseline(spark, "kept_baseline", path, 8)
        with pytest.raises(ValueError):
            bl.open_baseline(spark, "kept_baseline", str(tmp_path / "other"), 4)
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            bl.open_baseline(spark, "no_baseline", str(tmp_path / "other"), 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.sql("DROP TABLE IF EXISTS kept_baseline")


def exchanges(df):
    """Shuffles of the plan that adaptive execution starts from."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return plan.count("Exchange hashpartitioning")


def test_baselines_as_lines(findings, repos, spark, tmp_path):
    """Written to several files and read back, the entries are the same."""
    path = str(tmp_path / "lines")
    bl.write_baseline(findings.repartition(5), repos, path, "0.1.0", "2026-01-01T00:00:00Z")
    assert len(list((tmp_path / "lines").glob("part-*"))) > 1
    loaded = bl.load_baselines(spark, path)
    want = sorted(map(tuple, bl.baseline_entries(findings).collect()), key=repr)
    assert sorted(map(tuple, loaded.collect()), key=repr) == want
    summary = {r.repo: r for r in bl.diff_summary(bl.diff_findings(findings, loaded), repos).collect()}
    assert summary["one"].new == summary["one"].resolved == 0 and summary["one"].unchanged > 0
    assert (summary["none"].unchanged, summary["none"].has_new_debt) == (0, False)


@pytest.mark.parametrize("lines", [
    "not json", '{"repo": "r", "hash": "h"}',
    '{"repo": "r", "baseline_version": "1.0", "generated_at": "x", "findings_count": 1}'])
def test_bad_lines(spark, tmp_path, lines):
    (tmp_path / "b.json").write_text(lines)
    with pytest.raises(PySparkException):
        bl.load_baselines(spark, str(tmp_path / "b.json")).collect()
    with pytest.raises(PySparkException):
        bl.load_baselines(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("text", [
    "not json", "[1]", '{"baseline_version": "1.0", "findings": []}'])
def test_bad_baselines(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(PySparkException):
        bl.load_baseline(spark, str(tmp_path / "b.json"), "r").collect()
    with pytest.raises(PySparkException):
        bl.load_baseline(spark, str(tmp_path / "none.json"), "r").collect()


def test_written_documents(pieces, tmp_path):
    rp.write_documents(pieces["json"], str(tmp_path / "out"))
    folder = tmp_path / "out" / "repo=one"
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))
    assert json.loads(text) == json.loads(documents(pieces["json"])["one"][0])


def test_readiness_and_bands(findings, repos, spark):
    rows = {r.repo: r for r in sm.readiness(findings, repos).collect()}
    one = rows["one"]
    assert one.total_findings == one.vulnerable + one.partial + one.safe
    assert one.quantum_ready_score == pytest.approx(one.safe / one.total_findings * 100)
    assert (rows["none"].quantum_ready_score, rows["none"].score_band) == (100.0, "green")
    bands = spark.createDataFrame([(80.0,), (79.9,), (50.0,), (49.9,)], "s double").select(
        sm.score_band(F.col("s")).alias("b"))
    assert [r.b for r in bands.collect()] == ["green", "yellow", "yellow", "red"]


def test_unknown_risk_counts_in_the_total_only(make_findings):
    row = sm.risk_counts(assess(make_findings({}, {"algorithm_id": "Q"}))).first()
    assert (row.total_findings, row.vulnerable, row.partial, row.safe) == (2, 1, 0, 0)


def test_listing_and_advice(make_findings):
    df = assess(make_findings(
        {"algorithm_id": "SHA-256", "ord_a": 1}, {"algorithm_id": "Q", "ord_a": 2},
        {"algorithm_id": "AES-128", "ord_a": 3, "line_number": None}, {"ord_a": 4})
    ).withColumn("diff_status", F.when(F.col("algorithm_id") == "RSA", "new"))
    rows = rp.sorted_listing(df).collect()
    assert [(r.risk, r.file_line, r.badge) for r in rows] == [
        ("VULNERABLE", "src/auth.py:10", "NEW"), ("PARTIAL", "src/auth.py", ""),
        ("SAFE", "src/auth.py:10", ""), ("UNKNOWN", "src/auth.py:10", "")]
    assert rows[3].replacement == "-" and rows[0].severity == "HIGH"
    messages = [r.message for r in rp.advise(df).orderBy("advice_ord", "seq").collect()]
    assert [m.split(":")[0] for m in messages] == ["CRITICAL", "WARNING", "INFO"]
    assert messages[0].startswith("CRITICAL: RSA at src/auth.py:10 has to go (")
    assert "; think of " in messages[1]
    assert messages[2] == "INFO: no entry for Q, found at src/auth.py:10"


def _executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered_rows(spark, tmp_path):
    rows = [(i * 7 % 1000, f"r{i % 3}", "x") for i in range(1000)] + [(5, "r1", "again")] * 3
    df = spark.createDataFrame(rows, "a int, repo string, b string")
    got = numbered(df, ["repo", "a"], str(tmp_path), "rows").orderBy("seq_no").collect()
    assert [r.seq_no for r in got] == list(range(1, 1004))
    assert [(r.repo, r.a) for r in got] == sorted((r, a) for a, r, _ in rows)
    assert numbered(df.where("false"), ["a"], str(tmp_path), "rows").count() == 0


def test_first_findings_by_number(spark, make_findings, tmp_path):
    """Hash aggregates over stored findings give what the sort over lazy ones gives, for every report."""
    found = assess(make_findings(
        *[{"path": f"src/f{i % 7}.py", "line_number": 20 - i, "ord_a": 20 - i, "repo": f"r{i % 2}",
           "algorithm_id": ("RSA", "MD5", "AES-128")[i % 3]} for i in range(20)],
        {"source": "dependency", "path": "a/package.json", "line_number": None, "ord_a": 0},
        {"source": "config", "path": "conf/tls.conf", "algorithm_id": "TLS-1.0"}))
    stored = stored_inventory(found, str(tmp_path))
    for made in (sm.sarif_rules, sm.cbom_components):
        plan = _executed(made(stored))
        assert "SortAggregate" not in plan and "HashAggregate" in plan and "SortAggregate" in _executed(made(found))
        drop = lambda df: sorted(map(tuple, df.drop("first_key").collect()), key=repr)
        assert drop(made(stored)) == drop(made(found))
    repos = found.select("repo").distinct()
    counts = found.groupBy("repo").agg(F.count("*").alias("total_files_scanned"))
    for make in (lambda f: rp.json_pieces(f, counts), lambda f: rp.sarif_pieces(f, repos),
                 lambda f: rp.cbom_pieces(f, repos, "now", F.lit("urn:uuid:0"))):
        assert sorted(map(tuple, make(stored).collect())) == sorted(map(tuple, make(found).collect()))


def test_listing_and_advice_by_number(spark, make_findings, tmp_path):
    found = assess(make_findings(*[
        {"path": f"f{i % 5}.py", "line_number": i, "ord_a": i, "algorithm_id": ("RSA", "SHA-256", "Odd")[i % 3]}
        for i in range(30)]))
    for make in (rp.sorted_listing, rp.sorted_advice):
        want = [tuple(r) for r in make(found).collect()]
        got = make(found, str(tmp_path)).orderBy("seq_no").collect()
        assert [tuple(r)[:-1] for r in got] == want and [r.seq_no for r in got] == list(range(1, len(want) + 1))


def test_documents_scan_the_corpus_once(spark, corpus, tmp_path):
    """Contents are read by the job that writes the findings, and not by the plan of the document."""
    files = corpus({("a", "x.py"): "RSA md5", ("b", "y.py"): "sha1 DES"})
    files.write.parquet(str(tmp_path / "files"))
    stored = stored_inventory(inventory(spark.read.parquet(str(tmp_path / "files"))), str(tmp_path / "work"))
    pieces = rp.sarif_pieces(stored, stored.select("repo").distinct())
    assert "content" not in _executed(pieces) and pieces.count() > 8


def test_documents_broadcast_no_findings(spark, make_findings, tmp_path):
    """Stored findings look small (compressed), but their texts never go through the driver."""
    found = assess(make_findings(*[
        {"path": f"src/f{i % 7}.py", "line_number": i, "ord_a": i, "repo": r, "algorithm_id": ("RSA", "MD5")[i % 2]}
        for i in range(40) for r in ("a", "b", None)]))
    stored = stored_inventory(found, str(tmp_path))
    counts = spark.createDataFrame([("a", 1), ("empty", 0)], "repo string, total_files_scanned long")
    repos = found.select("repo").where("repo = 'a'").distinct()
    made = {"json": rp.json_pieces(stored, counts), "sarif": rp.sarif_pieces(stored, repos),
            "cbom": rp.cbom_pieces(stored, repos, "now", F.lit("urn:uuid:0")),
            "baseline": rp.baseline_pieces(stored, repos, "now")}
    for name, pieces in made.items():
        depth = None
        for line in _executed(pieces).splitlines():
            at = len(line) - len(line.lstrip(" :+-"))
            if depth is not None and at <= depth:
                depth = None
            if depth is None and "BroadcastExchange" in line:
                depth = at
            assert depth is None or "StructsToJson" not in line, name
        # as many pieces of findings as before: of repositories with a document, none without a repository
        part = {"json": "part = 1", "sarif": "part = 3", "cbom": "part = 1 AND sub = 1", "baseline": "part = 1"}[name]
        by_repo = {r.repo: r["count"] for r in pieces.where(part).groupBy("repo").count().collect()}
        assert by_repo == ({"a": 40} if name in ("json", "baseline") else {"a": 40, "b": 40}), name


def test_baselines_by_query(spark):
    from cryptoscape.plans.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    rows = [sorted(map(tuple, QUERIES[q](spark, folder).collect()), key=repr)
            for q in ("src5_load_baselines", "bas_baseline_entries")]
    assert rows[0] == rows[1] and len(rows[0]) > 50
