"""Catalogues, catalogue checks, the tree reader and the registered queries."""

import io
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cryptoscape.operators import quality as qc
from cryptoscape.operators.scan import scan_files
from cryptoscape.plans.queries import QUERIES
from cryptoscape.sources import catalogue as ct
from cryptoscape.sources.file_tree import RepoTree
from cryptoscape.sources.large_tree import cut_files, list_tree, read_chunk, read_listed, read_plan


def test_bundled_catalogues(spark):
    algorithms, libraries = ct.algorithms_df(spark), ct.libraries_df(spark)
    assert (algorithms.count(), libraries.count()) == (43, 13)
    for check in (qc.repeated_patterns, qc.blank_patterns, qc.algorithm_problems,
                  qc.reference_problems):
        assert check(algorithms).collect() == []
    assert qc.library_problems(libraries).collect() == []
    assert qc.unknown_exposed(libraries, algorithms).collect() == []


def test_patterns_of_an_algorithm():
    assert ct.get_patterns_for_algorithm("Ed448") == ["Ed448", "ED448"]
    assert ct.get_patterns_for_algorithm("NONE") == []
    assert sum(map(len, ct.get_all_patterns().values())) == 207


def test_custom_catalogue_files(tmp_path):
    good = {"name": "n", "type": "hash", "quantum_risk": "SAFE", "reason": "r", "replacement": "x",
            "patterns": ["p"], "extra": 1}
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"algorithms": {"A": good}}))
    assert ct.load_algorithms(path)["A"].patterns == ["p"]
    for bad in ({"algorithms": {"A": {**good, "quantum_risk": "NO"}}},
                {"algorithms": {"A": {"name": "n"}}}, {"x": 1}, [1]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            ct.load_algorithms(path)
        with pytest.raises(ValueError):
            ct.load_libraries(path)
    with pytest.raises(FileNotFoundError):
        ct.load_libraries(tmp_path / "none.json")


def test_catalogue_checks_find_problems(spark):
    entries = {
        "A": dict(name="A", type="odd", quantum_risk="VULNERABLE", reason="r", replacement="short",
                  patterns=["x", "x"], category="hash", remediation="m"),
        "B": dict(name="B", type="asymmetric", quantum_risk="VULNERABLE", reason="r",
                  replacement="long enough to do", patterns=[" "], category="pki", remediation="m",
                  references={"nist": ["x"]}),
    }
    df = ct.algorithms_df(spark, ct.algorithms_from_dict(entries))
    assert {tuple(r) for r in qc.algorithm_problems(df).collect()} == {
        ("A", "type"), ("A", "replacement")}
    assert [tuple(r) for r in qc.repeated_patterns(df).collect()] == [("A", "x", 2)]
    assert [r[0] for r in qc.blank_patterns(df).collect()] == ["B"]
    assert {tuple(r) for r in qc.reference_problems(df).collect()} == {
        ("A", "no standard body"), ("B", "no cnsa reference"), ("B", "no eu deadlines")}


def test_tree_reader(spark, tmp_path):
    files = {
        "p1/__init__.py": b"RSA", "p1/.env": b"TLS_VERSION=1.0", "p1/a/b/c/d/deep.py": b"MD5",
        "p1/__tests__/t.js": b"DSA", "p1/node_modules/x.js": b"RSA", "p1/x.egg-info/y.py": b"RSA",
        "p1/big.py": b"x" * 1_000_001, "p1/_private/k.go": b"\xff", "p2/z.rs": b"", "top.py": b"RSA",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    os.symlink(tmp_path / "p1/__init__.py", tmp_path / "p1/link.py")
    spark.dataSource.register(RepoTree)
    limited = spark.read.format("repo_tree").option("maxBytes", 1_000_000)
    df = limited.load(str(tmp_path))
    assert spark.read.format("repo_tree").load(str(tmp_path)).where("path = 'big.py'").count() == 1
    (tmp_path / "p1/picture.png").write_bytes(b"x")
    assert spark.read.format("repo_tree").option("suffixes", ".png,.rs").load(
        str(tmp_path)).count() == 2
    assert spark.read.format("repo_tree").option("tasks", 2).load(
        str(tmp_path)).rdd.getNumPartitions() == 2
    assert {(r.repo, r.path, r.size) for r in df.collect()} == {
        ("p1", "__init__.py", 3), ("p1", ".env", 15), ("p1", "a/b/c/d/deep.py", 3),
        ("p1", "__tests__/t.js", 3), ("p1", "_private/k.go", 1), ("p2", "z.rs", 0)}
    found = {(f.repo, f.path, f.algorithm_id) for f in scan_files(df).collect()}
    assert found == {("p1", "__init__.py", "RSA"), ("p1", ".env", "TLS-1.0"),
                     ("p1", "a/b/c/d/deep.py", "MD5"), ("p1", "__tests__/t.js", "DSA")}
    one = spark.read.format("repo_tree").options(repo="solo", depth=0).load(str(tmp_path))
    assert {(r.repo, r.path) for r in one.collect()} >= {("solo", "top.py"), ("solo", "p2/z.rs")}
    # A missing directory, and one without a repository below.
    for name in ("missing", "p2"):
        assert spark.read.format("repo_tree").load(str(tmp_path / name)).count() == 0


def write_tree(top, files):
    for name, content in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)


def rows(df):
    return {tuple(bytes(c) if isinstance(c, bytearray) else c for c in r) for r in df.collect()}


def test_listed_tree_equals_the_reader(spark, tmp_path):
    """A deep tree, a wide one, links, excluded names, empty directories; by path and by URI."""
    top, folder = tmp_path / "top", str(tmp_path / "scratch")
    deep = "/".join(f"d{i}" for i in range(20))
    files = {f"deep/{deep}/end.py": b"RSA", "deep/d0/d1/.env": b"TLS_VERSION=1.0", "top.py": b"RSA",
             "p/node_modules/x.js": b"RSA", "p/x.egg-info/y.py": b"RSA", "p/k.go": b"\xff", "p/e.rs": b"",
             "p/picture.png": b"x", "p/big.py": b"x" * 5000}
    files |= {f"wide/d{i}/f{j}.py": b"MD5 %d" % i for i in range(12) for j in range(3)}
    write_tree(top, files)
    (top / "p/nothing").mkdir()
    os.symlink(top / "p/k.go", top / "p/link.go")
    os.symlink(top / "wide", top / "p/linked")
    spark.dataSource.register(RepoTree)
    for options, given in (({}, {}), ({"repo": "solo"}, {"repo": "solo"}), ({"maxBytes": 4999}, {"max_bytes": 4999}),
                           ({"suffixes": ".png,.rs"}, {"suffixes": [".png", ".rs"]}), ({"suffixes": "*"}, {"suffixes": "*"})):
        wanted = rows(spark.read.format("repo_tree").options(**options).load(str(top)))
        assert wanted
        for most in (5, 1000) if not options else (1000,):
            listing = list_tree(spark, str(top), folder, directories_per_round=most, **given)
            got = read_listed(listing, folder)
            assert got.count() == len(wanted)
            assert rows(got.drop("chunk_start")) == wanted
    assert rows(read_listed(list_tree(spark, top.as_uri(), folder, **given), folder).drop("chunk_start")) == wanted
    for name in ("missing", "p/nothing", "top.py"):
        listing = list_tree(spark, str(top / name), folder)
        assert listing.count() == 0 and read_listed(listing, folder).count() == 0
    gone = list_tree(spark, str(top), folder)
    (top / "p/k.go").unlink()
    assert read_listed(gone, folder).where("path = 'k.go'").count() == 0


def test_no_task_reads_more_than_its_share(spark, tmp_path):
    rng = random.Random(2)
    write_tree(tmp_path / "top", {f"r{i % 3}/f{i}.py": b"x = 1\n" * rng.randint(0, 900) for i in range(200)}
               | {"r0/large.py": b"x = 2\n" * 50_000})
    folder, share, chunk = str(tmp_path / "scratch"), 400_000, 20_000
    listing = list_tree(spark, str(tmp_path / "top"), folder)
    plan = read_plan(listing, folder, share, chunk)
    cost = F.sum(F.coalesce(F.col("part_end") - F.col("part_start"), F.col("size")) + (64 << 10))
    bins = plan.groupBy("bin").agg(cost.alias("n")).collect()
    assert max(b.n for b in bins) <= share + chunk + (64 << 10)
    assert sorted(b.bin for b in bins) == list(range(len(bins)))
    got = read_listed(listing, folder, share, chunk)
    assert got.agg(F.sum(F.octet_length("content"))).first() == listing.agg(F.sum("size")).first()
    assert got.where("octet_length(content) > 20005").count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_chunks_are_whole_lines(size):
    rng = random.Random(size)
    for _ in range(200):
        text = b"".join(rng.choice([b"\n", b"a", b"\r\n", b"\xc3\xa9", b"x" * rng.randint(0, 90)])
                        for _ in range(rng.randint(0, 30)))
        parts = [read_chunk(io.BytesIO(text), at, min(at + size, len(text)), len(text))
                 for at in range(0, len(text), size)]
        parts = [p for p in parts if p[1]]
        assert b"".join(p for _, p in parts) == text
        assert all(p.endswith(b"\n") for _, p in parts[:-1])
        assert all(text.startswith(p, first) for first, p in parts)


def test_findings_of_chunks_are_those_of_files(spark, corpus, tmp_path):
    rng = random.Random(8)
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\x85", "\u2028", "\x0c"]
    pieces = ["use MD5", "RSA key", "x" * 300, "", "é SHA1", "ssl_protocols TLSv1.0;", "y = 1"]
    files = {(f"r{i % 3}", f"d/f{i}.{s}"): "".join(
        rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randint(0, 120)))
        for i in range(30) for s in ("py", "conf")}
    files |= {("r0", "late.py"): "RSA\n" * 400 + "\0\n", ("r0", "requirements.txt"): "x\n" * 900 + "bcrypt\n",
              ("r0", "late.conf"): "\0\n" * 400 + "ssl_protocols TLSv1.0;", ("r0", "bad.py"): b"\xe2\x80\nMD5 \xff\n" * 200,
              ("r0", "one.py"): "RSA " * 900, ("r0", "null.py"): "RSA"}
    whole = corpus(files).withColumn("content", F.when(F.col("path") != "null.py", F.col("content")))
    for limits in ({}, {"probe_bytes": 1602}, {"max_bytes": 1700}, {"sources": ["dependency"]}):
        wanted = sorted(scan_files(whole, **limits).collect())
        assert wanted
        for size in (1, 1000, 10**6) if not limits else (1000,):
            cut = cut_files(whole, size)
            assert (cut.where("chunk_start > 0").count() > 0) == (size < 10**6)
            assert sorted(scan_files(cut, **limits).collect()) == wanted, (size, limits)
    top = tmp_path / "top"
    write_tree(top, {"/".join(k): t.encode() if isinstance(t, str) else t for k, t in files.items()})
    read = read_listed(list_tree(spark, str(top), str(tmp_path / "scratch")), str(tmp_path / "scratch"), 1 << 20, 1000)
    read = read.where("path <> 'null.py'")
    assert sorted(scan_files(read).collect()) == sorted(scan_files(whole).collect())


TABLES = ["documents", "pages", "conversations", "part", "orders", "lineitem"]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = db.execute(sql)
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    want = sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    if os.path.isdir(FOLDER):
        assert entry.entry(spark).count() > 0
