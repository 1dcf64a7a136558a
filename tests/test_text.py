"""Text columns against the Python methods whose meaning they have."""

import fnmatch
import random

from pyspark.sql import functions as F

from cryptoscape.functions import paths
from cryptoscape.functions import text as tx

_ENDS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
_BLANKS = [" ", "\t", "\xa0", "\u3000", "\x1f", "\u200b", ""]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "b é", "-"] + _ENDS + _BLANKS) for _ in range(rng.randint(0, 9)))
            for _ in range(n)] + ["", "\n", "a\n", "a\n\n", "\r\n", "a\r\nb\r", "\n\r", "a"]


def test_split_lines_equals_splitlines(spark):
    texts = _texts(600, 1)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.expr(tx.split_lines("t")).alias("lines")).collect()
    for row in rows:
        assert row.lines == row.t.splitlines(), repr(row.t)


def test_strip_equals_strip(spark):
    texts = _texts(400, 2) + [c + "x y" + c for c in tx.WHITE_SPACE]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.expr(tx.strip("t")).alias("s")).collect()
    assert all(row.s == row.t.strip() for row in rows)


def test_white_space_is_all_of_it():
    assert set(tx.WHITE_SPACE) == {chr(i) for i in range(0x10000) if chr(i).isspace()}


def test_decode_replaces_invalid_bytes(spark):
    blobs = [b"ok \xc3\xa9", b"\xff\xfe", b"RSA \xe2\x82 x", b"\xf0\x9f\x98", b""]
    df = spark.createDataFrame([(b,) for b in blobs], "b binary")
    rows = df.select("b", tx.decode(F.col("b"), df.schema["b"].dataType).alias("t")).collect()
    assert all(row.t == bytes(row.b).decode("utf-8", "replace") for row in rows)


def test_fold_case_keeps_every_ascii_match(spark):
    folded = spark.createDataFrame([("\u017fHA \u0130d \u0131D \u212aey \u00c9",)], "t string").select(
        tx.fold_case(F.col("t")).alias("f")).first().f
    assert folded == "sha id id key \u00e9"


def test_glob_regex_equals_fnmatch(spark):
    rng = random.Random(3)
    names = ["a/b.py", "test_x", "src/test_x/y", "x[y]", "a.b", "a+b", "[", "!", "a-b", "", "é/ü",
             "z", "m", "a\nb", "^", "]", "a&&b"]
    globs = ["*", "**/test_*", "src/**", "*.py", "?", "[a-m]", "[!a-m]", "[]]", "[!]]", "x[[]y]",
             "[", "[!]", "a+b", "a.b", "[z-a]", "[!z-a]", "[^]", "a[&&]*", "", "[a-]", "*[!b]", "é/?"]
    globs += ["".join(rng.choice("ab[]!-*?./") for _ in range(rng.randint(1, 6)))
              for _ in range(200)]
    globs += ["**", "a*b*c", "a*a", "*b*b*", "ab*ba", "é*é*ü", "*/x[y]", "/a*", "a//b*", "/"]
    names += ["aXbYc", "a", "aa", "aba", "abba", "abxba", "bb", "b", "éé/ü", "q/xy", "/", "/ab", "a//bc", "a/b/"]
    pairs = [(n, g, paths.glob_regex(g), paths.glob_index([g])) for n in names for g in globs]
    rows = spark.createDataFrame(pairs, f"n string, g string, r string, p {paths.GLOBS_TYPE}").select(
        "n", "g", F.rlike("n", F.col("r")).alias("hit"),
        F.expr(paths.matches_any_glob("n", "p")).alias("hit_by_parts")).collect()
    for row in rows:
        assert row.hit == row.hit_by_parts == fnmatch.fnmatchcase(row.n, row.g), (row.n, row.g)


def test_globs_by_directory():
    """Globs with stars alone need no regex."""
    assert paths.glob_index(["src/**/gen*.py", "a/b", "src/x", "*.c"]) == {
        "src/": [{"first": "src/", "middle": ["/gen"], "last": ".py", "regex": None},
                 {"first": "src/x", "middle": [], "last": None, "regex": None}],
        "a/": [{"first": "a/b", "middle": [], "last": None, "regex": None}],
        "": [{"first": "", "middle": [], "last": ".c", "regex": None}]}
    assert paths.glob_index(["a/?.py"])["a/"][0]["regex"] == paths.glob_regex("a/?.py")


def test_suffix_and_excluded_directories(spark):
    cases = {  # path: (suffix, any component excluded, parent excluded)
        "a/b.PY": (".py", False, False), ".env": ("", True, False), "x/.env.local": (".local", False, False),
        "vendor/x.py": (".py", True, True), "a/vendor": ("", True, False), "a.tar.gz": (".gz", False, False),
        "lib/z.egg-info/y.py": (".py", True, True), "z.egg-info": (".egg-info", True, False),
        "myvendor/x.go": (".go", False, False), "a/build/b/c.ts": (".ts", True, True), "name.": ("", False, False),
    }
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select(
        "path", paths.file_suffix(F.col("path")), paths.in_excluded_dir(F.col("path")),
        paths.in_excluded_parent(F.col("path"))).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in rows} == cases
