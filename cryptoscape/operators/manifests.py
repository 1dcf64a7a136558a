"""Package names and line numbers out of the text of dependency manifests.

Every extractor is an array expression over one file's lines, so its section
state needs no window and no shuffle. The result is ``array<struct<package, line_number>>`` in the order of extraction.
The expressions are SQL text over ``rows``, the array of ``struct<no, raw, line>``
with the number, the text and the stripped text of each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cryptoscape.functions import text as tx
from cryptoscape.functions.text import bind, quote, strip
from cryptoscape.operators.files import manifest_kind, select_manifests

PACKAGES_TYPE = "array<struct<package:string,line_number:int>>"

# The dependency sections of package.json, in the order they are read.
_JSON_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
# Quoted names in TOML lists, Gradle coordinates and Maven artifacts.
_QUOTED_NAME = r"""['"]([A-Za-z0-9_][A-Za-z0-9._-]*)"""
_GRADLE_NAME = r"""['"]([^'"]+):([^'"]+):([^'"]+)['"]"""
_MAVEN_NAME = rf"(?U)<artifactId>{tx.SPACE}*([^<]+?){tx.SPACE}*</artifactId>"

_NONE = f"CAST(array() AS {PACKAGES_TYPE})"
_BEFORE_EQUALS = strip("substring_index(r.line, '=', 1)")


def packages_of(kind: str, text: str, is_wanted: str = "true") -> str:
    """SQL for the packages of a manifest of the given kind, null for another kind.

    The line of a package.json key costs a search of the text. It is only looked
    up for keys with ``is_wanted``, a predicate on ``name``.
    """
    numbered = (f"transform({tx.split_lines(text)}, (l, i) -> "
                f"named_struct('no', i + 1, 'raw', l, 'line', {strip('l')}))")
    branches = " ".join(f"WHEN {quote(name)} THEN {sql}" for name, sql in _extractors().items())
    return (f"CAST(CASE WHEN {kind} = 'package.json' THEN {_package_json(text, is_wanted)} ELSE "
            f"{bind(numbered, 'rows', f'CASE {kind} {branches} END')} END AS {PACKAGES_TYPE})")


def extract_packages(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``repo, path, pkg_ord, package, line_number`` for every manifest in the corpus."""
    text = tx.decode(F.col("content"), files.schema["content"].dataType)
    manifests = select_manifests(files, max_bytes).select(
        "repo", "path", manifest_kind().alias("kind"), text.alias("text"))
    return manifests.select(
        "repo", "path", F.posexplode(F.expr(packages_of("kind", "text"))).alias("pkg_ord", "p")
    ).select("repo", "path", "pkg_ord", F.col("p.package").alias("package"),
             F.col("p.line_number").alias("line_number"))


def _package(name: str) -> str:
    return f"named_struct('package', {name}, 'line_number', r.no)"


def _named(packages: str) -> str:
    return f"filter({packages}, p -> p.package <> '')"


def _code(rows: str, comment: str = "#") -> str:
    return f"filter({rows}, r -> r.line <> '' AND NOT startswith(r.line, '{comment}'))"


def sections(rows: str, is_head: str, use: str) -> str:
    """Split lines at the heads and map ``use`` over the sections, flattened.

    ``use`` sees the section as ``head`` and ``body``. The lines before the
    first head are a section with an empty head.
    """
    start = "array(named_struct('no', 0, 'raw', '', 'line', ''))"
    after = f"coalesce(get(heads, k + 1).no, size({rows}) + 1)"
    body = f"slice({rows}, head.no + 1, {after} - head.no - 1)"
    return bind(f"concat({start}, filter({rows}, r -> {is_head}))", "heads",
                f"flatten(transform(heads, (head, k) -> {bind(body, 'body', use)}))")


def _assigned(name: str) -> str:
    """Packages of the ``name = ...`` lines of a section."""
    rows = f"filter({_code('body')}, r -> contains(r.line, '='))"
    return _named(f"transform({rows}, r -> {_package(name)})")


def _assigned_where(head_is_on: str, name: str) -> str:
    return sections("rows", "startswith(r.line, '[')",
                    f"CASE WHEN {head_is_on} THEN {_assigned(name)} ELSE {_NONE} END")


def _requirements() -> str:
    before_version = quote(r"^[^><=!~;@\[]*")
    name = strip(f"regexp_extract(substring_index(r.line, ' #', 1), {before_version}, 0)")
    rows = f"filter({_code('rows')}, r -> NOT startswith(r.line, '-'))"
    return _named(f"transform({rows}, r -> {_package(name)})")


def _pipfile() -> str:
    return _assigned_where("lower(head.line) IN ('[packages]', '[dev-packages]')",
                           f"btrim(btrim({_BEFORE_EQUALS}, '\"'), '\\'')")


def _cargo() -> str:
    return _assigned_where("contains(lower(head.line), 'dependencies]')", _BEFORE_EQUALS)


def _pyproject() -> str:
    """Quoted names in dependency lists, assigned names in the poetry table.

    A list is on from a head or an assignment with "dependencies" up to a lone "]".
    """
    poetry = f"filter({_assigned(_BEFORE_EQUALS)}, p -> p.package <> 'python')"
    assigns = "contains(r.raw, 'dependencies') AND contains(r.raw, '=')"
    # Inside a section lines are counted from its head, so that it can be cut again.
    local = ("transform(body, (r, i) -> "
             "named_struct('no', i + 1, 'raw', r.raw, 'line', r.line))")
    opening = f"filter(array(head), r -> {assigns})"
    is_on = f"(head.no = 0 AND in_list) OR size({opening}) > 0"
    listed = (f"concat({opening}, "
              f"filter({_code('body')}, r -> {is_on}))")
    names = (f"flatten(transform({listed}, r -> transform("
             f"regexp_extract_all(r.line, {quote(_QUOTED_NAME)}, 1), name -> {_package('name')})))")
    cut = sections("local", f"({assigns}) OR r.line = ']'", names)
    lists = bind(
        "contains(lower(head.line), 'dependencies')", "in_list",
        bind("head.no", "offset", bind(local, "local", (
            f"transform({cut}, p -> named_struct('package', p.package, "
            f"'line_number', p.line_number + offset))"))))
    return sections("rows", "startswith(r.line, '[')", (
        f"CASE WHEN contains(lower(head.line), 'tool.poetry.dependencies') THEN {poetry} "
        f"ELSE {lists} END"))


def _go_mod() -> str:
    """Modules of the require blocks and lines: last path segment, then whole path."""
    single = "startswith(r.line, 'require ') AND NOT contains(r.line, '(')"

    def module(index: int) -> str:
        word = quote(rf"(?U)^(?:[^\s\x1F]+[\s\x1F]+){{{index}}}([^\s\x1F]+)")
        return f"named_struct('no', r.no, 'path', regexp_extract(r.line, {word}, 1))"

    in_block = (f"transform(filter({_code('body', '//')}, r -> "
                f"startswith(head.line, 'require (') AND NOT ({single})), r -> {module(0)})")
    blocks = sections("rows", "startswith(r.line, 'require (') OR r.line = ')'", in_block)
    singles = f"transform(filter(rows, r -> {single}), r -> {module(1)})"
    last_segment, whole = _package("substring_index(r.path, '/', -1)"), _package("r.path")
    return (f"flatten(transform(sort_array(concat({blocks}, {singles})), "
            f"r -> array({last_segment}, {whole})))")


def _pom() -> str:
    name = f"regexp_extract(r.raw, {quote(_MAVEN_NAME)}, 1)"
    return _named(f"transform(rows, r -> {_package(name)})")


def _gradle() -> str:
    group, artifact = (f"regexp_extract(r.raw, {quote(_GRADLE_NAME)}, {i})" for i in (1, 2))
    both = f"array({_package(artifact)}, {_package(f'concat({group}, chr(58), {artifact})')})"
    return (f"flatten(transform(filter(rows, r -> r.raw RLIKE {quote(_GRADLE_NAME)}), "
            f"r -> {both}))")


def _with_lines(text: str, is_wanted: str) -> str:
    """``names`` with the first line that has each between quotes, all in one pass.

    What stands between two quotes of a line is one spot. Sorted, the first spot of
    a name is in front; sorted again with the names, it is at most as many places
    before a name as there are sections. A name that holds a quote is searched.
    """
    parts = f"split(l, {quote(chr(34))}, -1)"
    spots = (f"flatten(transform({tx.split_lines(text)}, (l, n) -> transform("
             f"{bind(parts, 'parts', 'slice(parts, 2, greatest(size(parts) - 2, 0))')}, "
             "s -> named_struct('name', s, 'kind', 0, 'at', n + 1))))")
    firsts = bind(f"array_sort({spots})", "spots",
                  "filter(spots, (x, i) -> i = 0 OR get(spots, i - 1).name <> x.name)")
    asked = "transform(names, (name, i) -> named_struct('name', name, 'kind', 1, 'at', i))"
    near = ", ".join(f"CASE WHEN get(merged, i - {j}).kind = 0 AND get(merged, i - {j}).name = m.name "
                     f"THEN get(merged, i - {j}).at END" for j in range(1, len(_JSON_SECTIONS) + 1))
    found = bind(f"array_sort(concat({firsts}, {asked}))", "merged",
                 f"transform(merged, (m, i) -> named_struct('at', m.at, 'kind', m.kind, 'name', m.name, "
                 f"'line', coalesce({near})))")
    needle = "concat('\"', name, '\"')"
    above = f"substring_index({text}, {needle}, 1)"
    searched = (f"CASE WHEN contains({text}, {needle}) THEN "
                f"{bind(above, 'above', tx.count_breaks('above'))} + 1 END")
    line = (f"CASE WHEN {is_wanted} AND NOT name RLIKE {quote(tx.LINE_BREAK)} THEN "
            f"CASE WHEN contains(name, '\"') THEN {searched} ELSE f.line END END")
    package = bind("f.name", "name", f"named_struct('package', name, 'line_number', {line})")
    return f"transform(array_sort(filter({found}, f -> f.kind = 1)), f -> {package})"


def _package_json(text: str, is_wanted: str) -> str:
    """Keys of the dependency objects; the line is the first one with the quoted key.

    Of repeated sections the last counts; a repeated key counts once, at its first place.
    """
    def section(name: str) -> str:
        last = f"try_element_at(filter(map_entries(whole), e -> e.key = '{name}'), -1).value"
        keys = f"array_distinct(map_keys(from_json({last}, 'map<string,string>', {_JSON_OPTIONS})))"
        return f"coalesce({keys}, CAST(array() AS array<string>))"

    keys = f"concat({', '.join(map(section, _JSON_SECTIONS))})"
    packages = bind(keys, "names", f"CASE WHEN exists(names, name -> {is_wanted}) THEN "
                                   f"{_with_lines(text, is_wanted)} ELSE transform(names, name -> "
                                   "named_struct('package', name, 'line_number', CAST(NULL AS int))) END")
    # In an array, text after the object is an error too.
    document = f"from_json(concat('[', {text}, '\\n]'), 'array<map<string,string>>', {_JSON_OPTIONS})"
    whole = f"CASE WHEN size({document}) = 1 THEN get({document}, 0) END"
    return bind(whole, "whole", f"CASE WHEN whole IS NOT NULL THEN {packages} ELSE {_NONE} END")


# NaN and the infinities are numbers; single quotes are not quotes.
_JSON_OPTIONS = "map('allowNonNumericNumbers', 'true', 'allowSingleQuotes', 'false')"


def _extractors() -> dict[str, str]:
    return {
        "requirements.txt": _requirements(),
        "Pipfile": _pipfile(),
        "pyproject.toml": _pyproject(),
        "go.mod": _go_mod(),
        "Cargo.toml": _cargo(),
        "pom.xml": _pom(),
        "build.gradle": _gradle(),
    }
