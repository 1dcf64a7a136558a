"""Manifest extraction and the library lookup."""

import time

import pytest

from cryptoscape.operators.manifests import extract_packages
from cryptoscape.operators.scan import scan_dependencies
from cryptoscape.sources.catalogue import libraries_from_dict, load_libraries

# name: [(text, [(package, line)])]
CASES = {
    "requirements.txt": [
        ("a==1\nb>=2,<3\nc\nd~=1\ne!=2\nf<9\n", [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5),
                                                   ("f", 6)]),
        ("# c\n\n-r x.txt\n-e .\n  --hash=1\na # why\nb#c\nd[x]>=1; y\ne @ url\n", [
            ("a", 6), ("b#c", 7), ("d", 8), ("e", 9)]),
        ("==1\n;x\n", []),
        ("", []),
    ],
    "Pipfile": [
        ("a = 'no'\n[packages]\n\"b\" = '*'\n# c\n\nd\n'e' = {v = '='}\n[dev-packages]\nf=1\n"
         "[requires]\ng = 1\n[Packages]\nh = 2\n= 3\n", [("b", 3), ("e", 7), ("f", 9), ("h", 13)]),
        ("[packages] # x\na = 1", []),
    ],
    "pyproject.toml": [
        ('[project]\nname = "x"\ndependencies = [\n  "a>=1",\n\n  # "z"\n  \'b[c]\', "d.e-f_g"\n]\n"no"\n',
         [("a", 4), ("b", 7), ("d.e-f_g", 7)]),
        ('dependencies = ["a", "b>1"]\nname = "c"\n]\n"d"', [("a", 1), ("b", 1), ("c", 2)]),
        ('[tool.poetry.dependencies]\npython = "3"\na = "^1"\n# b = 1\nc\n]\nd = {extras = ["x"]}\n'
         'my-dependencies = ["y"]\n[other]\ne = "1"\n', [("a", 3), ("d", 7), ("my-dependencies", 8)]),
        ('[project.optional-dependencies]\nx = ["a", "b"]\n]\ny = ["c"]\n[build]\n"d"\n', [
            ("a", 2), ("b", 2)]),
        ('[x.dependencies]\n]\n# dependencies = "q"\n"r"\n', [("q", 3), ("r", 4)]),
        ('[TOOL.Poetry.Dependencies]\na = 1\n[tool.poetry.dev-dependencies]\nb = "c"\n', [
            ("a", 2), ("c", 4)]),
        ("", []),
    ],
    "package.json": [
        ('{\n "name": "x",\n "devDependencies": {"b": "1"},\n "dependencies": {\n  "a": "1",\n'
         '  "x": "2"\n },\n "peerDependencies": {"a": "3"},\n "optionalDependencies": {"o": "b"}\n}', [
            ("a", 5), ("x", 2), ("b", 3), ("a", 5), ("o", 9)]),
        ('{"dependencies": ["a"]}', []), ('{"dependencies": null}', []), ("[1]", []), ("", []),
        ('{"dependencies": {"a": 1}} trailing', []), ("{'dependencies': {'a': 1}}", []),
        ('{"dependencies": {"a": 1},}', []),
        ('{"dependencies": {"a": 1, "b": 2, "a": 3}}', [("a", 1), ("b", 1)]),
        ('{"dependencies": {"\\u0061b": 1}}', [("ab", None)]),
        ('{"dependencies": {"@s/p": 1,\r\n"q": 2}}', [("@s/p", 1), ("q", 2)]),
    ],
    "go.mod": [
        ("module m\nrequire (\n\ta/b v1 // indirect\n\n\t// c\n\td v2\n)\ne/f v3\nrequire g/h v1\n"
         "require i\n", [("b", 3), ("a/b", 3), ("d", 6), ("d", 6), ("h", 9), ("g/h", 9),
                         ("i", 10), ("i", 10)]),
        ("require (\nrequire x/y v1\n)\n)\nrequire (\nz v1\n", [
            ("y", 2), ("x/y", 2), ("z", 6), ("z", 6)]),
    ],
    "Cargo.toml": [
        ('[package]\nname = "x"\n[dependencies]\na = "1"\nb = { version = "=1" }\n# c = 1\nd\n'
         '[dependencies.e]\nversion = "1"\n[dev-dependencies]\nf = 1\n[target.x.build-dependencies]\n'
         "g = 1\n[profile]\nh = 1\n", [("a", 4), ("b", 5), ("f", 11), ("g", 13)]),
    ],
    "pom.xml": [
        ("<artifactId> a-b </artifactId>\n<artifactId>c</artifactId><artifactId>d</artifactId>\n"
         "<artifactId></artifactId>\n<artifactid>e</artifactid>", [("a-b", 1), ("c", 2)]),
    ],
    "build.gradle": [
        ("implementation 'g:a:1'\ncompile \"h:b:2\"\nx project(':c')\ny 'a:b'\nz 'a:b:c:d'", [
            ("a", 1), ("g:a", 1), ("b", 2), ("h:b", 2), ("c", 5), ("a:b:c", 5)]),
    ],
}


def test_extract_packages(corpus):
    files = {f"d{i}/{name}": text for name, cases in CASES.items()
             for i, (text, _) in enumerate(cases)}
    expected = {f"d{i}/{name}": packages for name, cases in CASES.items()
                for i, (_, packages) in enumerate(cases)}
    found = {}
    for r in extract_packages(corpus(files)).orderBy("path", "pkg_ord").collect():
        found.setdefault(r.path, []).append((r.package, r.line_number))
    for path, packages in expected.items():
        assert found.get(path, []) == packages, path


def test_names_are_exact_and_directories_are_excluded(corpus):
    files = dict.fromkeys(["Requirements.txt", "requirements-dev.txt", "venv/requirements.txt",
                           "Pipfile.lock", "x/requirements.txt"], "bcrypt")
    assert [r.path for r in extract_packages(corpus(files)).collect()] == ["x/requirements.txt"]


def test_library_lookup(corpus):
    files = {
        "a/requirements.txt": "Cryptography==42\nrequests\nBCRYPT\n",
        "b/package.json": '{"dependencies": {"jsonwebtoken": "1"},\n"devDependencies": {"x": "1"}}',
        "c/go.mod": "require x/bcrypt v1",
    }
    found = scan_dependencies(corpus(files)).collect()
    libraries = load_libraries()
    assert {(f.path, f.line_number, f.matched_text, f.algorithm_id) for f in found} == (
        {("a/requirements.txt", 1, "cryptography", a) for a in libraries["cryptography"].exposes}
        | {("b/package.json", 1, "jsonwebtoken", a) for a in libraries["jsonwebtoken"].exposes}
        | {("a/requirements.txt", 3, "bcrypt", "bcrypt"), ("c/go.mod", 1, "bcrypt", "bcrypt")})
    # Of libraries with one package name the last counts, whatever the ecosystem.
    text = {f.line_text for f in found if f.matched_text == "bcrypt"}
    assert text == {libraries["bcrypt-npm"].description}


def test_first_package_of_a_line_wins(corpus):
    files = {"pyproject.toml": 'dependencies = ["jose", "jsonwebtoken"]\n"jose"\n',
             "package.json": '{"dependencies": {"\\u006aose": 1, "\\u006asonwebtoken": 2}}'}
    found = scan_dependencies(corpus(files)).collect()
    assert {(f.path, f.line_number, f.matched_text) for f in found} == {
        ("pyproject.toml", 1, "jose"), ("pyproject.toml", 2, "jose"),
        ("package.json", None, "jose")}
    assert len(found) == 3 * len(load_libraries()["jose"].exposes)


def test_custom_libraries(corpus):
    libraries = libraries_from_dict({"l": {
        "ecosystem": "npm", "package_name": "@My/Lib", "description": "d", "exposes": ["RSA", "Q"],
        "default_risk": "SAFE"}})
    files = {"package.json": '{"dependencies": {"@my\\/lib": 1}}', "Pipfile": "[packages]\nbcrypt=1"}
    found = scan_dependencies(corpus(files), libraries).collect()
    assert {(f.path, f.algorithm_id, f.matched_text) for f in found} == {
        ("package.json", "RSA", "@My/Lib"), ("package.json", "Q", "@My/Lib")}


@pytest.mark.parametrize("lines", [20_000])
def test_large_manifest(corpus, lines):
    """A manifest near the size limit is one row of work, not one per pair of lines."""
    text = "[dependencies]\n" + "".join(f'p{i} = "1"\n' for i in range(lines)) + 'bcrypt = "1"\n'
    keys = ",\n".join(f'"p{i}": "1"' for i in range(lines)) + ',\n"bcrypt": "1"'
    found = scan_dependencies(corpus({
        "Cargo.toml": text, "package.json": '{"dependencies": {\n' + keys + "}}"})).collect()
    assert {(f.path, f.line_number, f.algorithm_id) for f in found} == {
        ("Cargo.toml", lines + 2, "bcrypt"), ("package.json", lines + 2, "bcrypt")}


def test_repeated_sections_and_odd_numbers(corpus):
    """Of repeated sections the last counts, as JSON loading does it; NaN is a number."""
    import json
    texts = [
        '{"dependencies": {"left": "1"}, "dependencies": {"bcrypt": "1"}}',
        '{"dependencies": {"bcrypt": "1"}, "dependencies": {"left": "1"}}',
        '{"dependencies": {"bcrypt": NaN, "jose": -Infinity, "bcrypt": 2}, "x": Infinity}',
        '{"dependencies": {"bcrypt": 1}, "dependencies": null}', '{"dependencies": ["bcrypt"]}',
        "{'dependencies': {'bcrypt': 1}}", '{"dependencies": {"bcrypt": 1}} x', '[{"dependencies": {"a": 1}}]',
        '{"a": {"dependencies": {"bcrypt": 1}}}', '{"dependencies": {"bcrypt": {"b": [1, {"c": 2}]}}}', ""]
    files = {f"p{i}/package.json": t for i, t in enumerate(texts)}
    want = set()
    for path, text in files.items():
        try:
            section = json.loads(text)
        except ValueError:
            continue
        section = section.get("dependencies") if isinstance(section, dict) else None
        want |= {(path, k) for k in (section if isinstance(section, dict) else ())}
    assert {(r.path, r.package) for r in extract_packages(corpus(files)).collect()} == want


def test_thousands_of_libraries(corpus):
    import time
    names = [f"lib-{i}" for i in range(5000)]
    libraries = libraries_from_dict({n: {
        "ecosystem": "npm", "package_name": n, "description": n, "exposes": ["RSA"],
        "default_risk": "SAFE"} for n in names})
    files = {f"p{i}/requirements.txt": "\n".join(names[i::40]) for i in range(40)}
    start = time.monotonic()
    assert scan_dependencies(corpus(files), libraries).count() == 5000
    assert time.monotonic() - start < 120


def test_large_package_json(spark, corpus):
    """32,000 keys on lines of their own, in four sections, take no more than their share of time."""
    names = [f"pkg-{i}" for i in range(32_000)]
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    lines, line_of = ["{"], {}
    for k, section in enumerate(sections):
        lines.append(f'  "{section}": {{')
        mine = names[k * 8000:(k + 1) * 8000] + names[:5]
        for i, name in enumerate(mine):
            lines.append(f'    "{name}": "^1.{i}"' + ("," if i + 1 < len(mine) else ""))
            line_of.setdefault(name, len(lines))
        lines.append("  }" + ("," if k < 3 else ""))
    df = corpus({"package.json": "\n".join([*lines, "}"])})
    start = time.time()
    got = extract_packages(df).collect()
    assert time.time() - start < 40 and len(got) == 32_015  # a key twice in a section is one
    assert {r.package: r.line_number for r in got} == line_of
    found = scan_dependencies(corpus({"package.json": "\n".join([*lines, "}"]).replace("pkg-9000", "crypto-js")}))
    assert {r.line_number for r in found.collect()} == {line_of["pkg-9000"]}


def test_keys_that_look_alike_in_package_json(spark, corpus):
    text = '{"name": "b", "x": "say \\"a\\" b",\n"dependencies": {"a\\"b": "1", "a": "2",\n"b": "3", "c\\u0041": "4", "": "5"},\n"c": {}}'
    got = {r.package: r.line_number for r in extract_packages(corpus({"package.json": text})).collect()}
    assert got == {'a"b': None, "a": 2, "b": 1, "cA": None, "": 2 if '""' in text.split("\n")[1] else 3}
