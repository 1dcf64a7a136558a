"""Data source ``repo_tree``: files below a directory as the corpus table.

Spark's own file listing drops names that start with a dot or underscore, which
this corpus needs (``.env``, ``__init__.py``). The driver lists the directories
of the upper ``depth`` levels; a task gets some of them, lists what is below and
reads it. A file is opened only if its name can matter to a scan. Options:
``path``; ``repo`` for the name of a single repository, else every directory
below ``path`` is a repository; ``depth`` (2); ``maxBytes`` (none: every size);
``suffixes``, a comma list (default: what the scanners look at; ``*``: all);
``tasks`` (200), the most tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cryptoscape.functions.paths import CONFIG_SUFFIXES, EXCLUDED_DIRS, SOURCE_SUFFIXES
from cryptoscape.operators.files import CONFIG_FILE_SUFFIXES, CONFIG_NAMES, MANIFESTS

SCHEMA = "repo string, path string, content binary, size bigint"


class RepoTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _Directories(InputPartition):
    """(repository, its root, a directory, whether what is below belongs to it)."""

    def __init__(self, places: list[tuple[str, str, str, bool]]):
        self.places = places


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.repo = options.get("repo")
        self.depth = int(options.get("depth", "2"))
        self.tasks = int(options.get("tasks", "200"))
        limit = options.get("maxBytes")
        self.max_bytes = int(limit) if limit else None
        suffixes = options.get("suffixes", "")
        self.suffixes = frozenset(s.strip().lower() for s in suffixes.split(",") if s.strip())

    def partitions(self) -> list[InputPartition]:
        places: list[tuple[str, str, str, bool]] = []
        if os.path.isdir(self.path):
            roots = ([(self.repo, self.path)] if self.repo is not None
                     else [(e.name, e.path) for e in _subdirectories(self.path)])
            for repo, root in roots:
                places += _upper(repo, root, root, self.depth)
        n = max(1, min(self.tasks, len(places)))
        return [_Directories(places[i::n]) for i in range(n)]

    def read(self, partition: _Directories) -> Iterator[tuple]:
        for repo, root, top, recursive in partition.places:
            for directory, names, files in os.walk(top):
                names[:] = [n for n in sorted(names) if recursive and not is_excluded(n)]
                for name in sorted(files):
                    if matters(name, self.suffixes):
                        row = self._row(repo, root, os.path.join(directory, name))
                        if row is not None:
                            yield row

    def _row(self, repo: str, root: str, path: str) -> tuple | None:
        """The file as a row; links, too large and unreadable files are left out."""
        try:
            if os.path.islink(path) or not os.path.isfile(path):
                return None
            if self.max_bytes is not None and os.lstat(path).st_size > self.max_bytes:
                return None
            with open(path, "rb") as f:
                content = f.read()
        except OSError:
            return None
        relative = os.path.relpath(path, root).replace(os.sep, "/")
        return repo, relative, content, len(content)


_SUFFIXES = frozenset((*SOURCE_SUFFIXES, *CONFIG_SUFFIXES, *CONFIG_FILE_SUFFIXES))
_NAMES = frozenset((*MANIFESTS, *CONFIG_NAMES))


def matters(name: str, suffixes: frozenset[str]) -> bool:
    """Can a file of this name matter to a scan? ``suffixes`` are the caller's own, ``*`` for all."""
    if "*" in suffixes:
        return True
    suffix = os.path.splitext(name)[1].lower()
    if suffixes:
        return suffix in suffixes
    return (suffix in _SUFFIXES or name in _NAMES or name == ".env"
            or name.startswith(".env."))


def is_excluded(name: str) -> bool:
    return name in EXCLUDED_DIRS or name.endswith(".egg-info")


def _subdirectories(directory: str) -> list[os.DirEntry]:
    with os.scandir(directory) as entries:
        return sorted((e for e in entries if e.is_dir(follow_symlinks=False)
                       and not is_excluded(e.name)), key=lambda e: e.name)


def _upper(repo: str, root: str, directory: str, depth: int) -> Iterator[tuple[str, str, str, bool]]:
    """The directories down to ``depth``, the last ones with all that is below them."""
    if depth == 0:
        yield repo, root, directory, True
        return
    yield repo, root, directory, False
    for entry in _subdirectories(directory):
        yield from _upper(repo, root, entry.path, depth - 1)
