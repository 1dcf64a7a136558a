"""Path predicates: names, suffixes, excluded directories, glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cryptoscape.functions.text import quote

# Directories that are never scanned (also any name ending in .egg-info).
EXCLUDED_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".env", "dist", "build",
    ".next", ".nuxt", ".svelte-kit", ".tox", ".mypy_cache", ".ruff_cache",
    ".pytest_cache", "vendor", "target", ".cargo", ".eggs",
)

# The suffixes of source and of configuration files.
SOURCE_SUFFIXES = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".go", ".java", ".rs",
    ".rb", ".php", ".cs", ".swift",
)
CONFIG_SUFFIXES = (
    ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".conf", ".env", ".sh", ".bash",
)

# The usual limits for the size filter and for the binary test.
MAX_FILE_BYTES = 1_000_000
PROBE_BYTES = 8192

_EXCLUDED = "|".join([re.escape(d) for d in EXCLUDED_DIRS] + [r"[^/]*\.egg-info"])


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Lower-cased last suffix; a leading dot alone starts no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def in_excluded_dir(path: Column) -> Column:
    """Any component, the file name included, is an excluded name."""
    return path.rlike(rf"(?:^|/)(?:{_EXCLUDED})(?:/|\z)")


def in_excluded_parent(path: Column) -> Column:
    """Any parent component is an excluded name; the file name may be one."""
    return path.rlike(rf"(?:^|/)(?:{_EXCLUDED})/")


def is_env_file(name: Column) -> Column:
    return (name == ".env") | name.startswith(".env.")


_GLOB_TOKEN = re.compile(r"\*+|\?|\[!?\]?[^\]]*\]|.", re.DOTALL)


def glob_regex(glob: str) -> str:
    """Shell glob as a full-match Java regex; ``*`` also crosses ``/``."""
    return r"\A(?s:" + "".join(map(_glob_token, _GLOB_TOKEN.findall(glob))) + r")\z"


def _is_class(token: str) -> bool:
    return token[0] == "[" and len(token) > 2 and token != "[!]"


def _glob_token(token: str) -> str:
    if token[0] == "*":
        return ".*"
    if token == "?":
        return "."
    if _is_class(token):
        return _glob_class(token[1:-1])
    return re.sub(r"(\W)", r"\\\1", token) if token.isascii() else token


# Globs as data, by the directory that each names in full before its first wildcard.
# Of a glob: the literal text before its first wildcard, that after its last (null
# without a wildcard), the texts between, and a regex if stars are not all.
GLOBS_TYPE = "map<string,array<struct<first:string,middle:array<string>,last:string,regex:string>>>"


def glob_index(globs: list[str]) -> dict[str, list[dict[str, object]]]:
    """A value of GLOBS_TYPE for shell globs."""
    index: dict[str, list[dict[str, object]]] = {}
    for glob in globs:
        parts = _glob_parts(glob)
        index.setdefault(parts["first"][:parts["first"].rfind("/") + 1], []).append(parts)
    return index


def _glob_parts(glob: str) -> dict[str, object]:
    texts, is_regex = [""], False
    for token in _GLOB_TOKEN.findall(glob):
        if token[0] == "*" or token == "?" or _is_class(token):
            texts.append("")
            is_regex |= token[0] != "*"
        else:
            texts[-1] += token
    return {"first": texts[0], "middle": [t for t in texts[1:-1] if t],
            "last": texts[-1] if len(texts) > 1 else None,
            "regex": glob_regex(glob) if is_regex else None}


def matches_any_glob(path: str, globs: str) -> str:
    """SQL: does the path match a glob of a GLOBS_TYPE that comes with the row?

    Only globs below the directories of the path are tested. A regex that is no
    literal is compiled for every row, so both ends of a path have to agree
    first, and globs with stars alone need no regex: the texts between the ends
    are searched one behind the other.
    """
    above = (f"transform(sequence(0, length({path}) - length(replace({path}, '/', ''))), "
             f"i -> CASE WHEN i = 0 THEN '' ELSE concat(substring_index({path}, '/', i), '/') END)")
    inner = f"substring({path}, length(g.first) + 1, length({path}) - length(g.first) - length(g.last))"
    matches = (f"CASE WHEN g.last IS NULL THEN {path} = g.first "
               f"WHEN NOT startswith({path}, g.first) OR NOT endswith({path}, g.last) "
               f"OR length({path}) < length(g.first) + length(g.last) THEN false "
               f"WHEN g.regex IS NOT NULL THEN {path} RLIKE g.regex "
               f"ELSE aggregate(g.middle, {inner}, (rest, t) -> CASE WHEN contains(rest, t) "
               "THEN substring(rest, locate(t, rest) + length(t)) END) IS NOT NULL END")
    return f"exists({above}, d -> coalesce(exists(try_element_at({globs}, d), g -> {matches}), false))"


def _glob_class(body: str) -> str:
    negated = body[0] == "!" and len(body) > 1
    members = []
    for low, high in re.findall(r"(?s)(.)(?:-(.))?", body[1:] if negated else body):
        if high and low > high:  # an empty range matches nothing
            continue
        members.append(re.escape(low) + (f"-{re.escape(high)}" if high else ""))
    if not members:
        return "." if negated else "(?!)"
    return "[" + ("^" if negated else "") + "".join(members) + "]"


def glob_at_component(path: str, globs: tuple[str, ...]) -> str:
    """SQL: does a glob match the path, or a part of it that starts at a component?

    Only ``*`` at the ends of a glob is supported, so plain string predicates do.
    """
    rooted = f"concat('/', replace({path}, '\\\\', '/'))"
    tests = []
    for glob in globs:
        word = glob.strip("*") if glob.startswith("*") else "/" + glob.strip("*")
        test = "contains" if glob.endswith("*") else "endswith"
        tests.append(f"{test}({rooted}, {quote(word)})")
    return "(" + " OR ".join(tests) + ")"
