"""Library lookup: packages to the algorithms they expose."""

from __future__ import annotations

import json
import zlib

from cryptoscape.functions.text import bind, quote, strip
from cryptoscape.operators.manifests import packages_of
from cryptoscape.sources.catalogue import Library, load_libraries

HITS_TYPE = (
    "array<struct<line_number:int,algorithm_id:string,ord_a:int,ord_b:int,"
    "matched_text:string,line_text:string>>"
)


def library_lookup(libraries: dict[str, Library] | None = None) -> dict[str, Library]:
    """Libraries by lower-cased package name; of equal names the last one counts."""
    return {lib.package_name.lower(): lib for lib in (libraries or load_libraries()).values()}


def package_words(libraries: dict[str, Library] | None = None) -> list[tuple[str, ...]]:
    """Guard words: a manifest without any of the names gives no finding."""
    return [(name,) if name.isascii() else () for name in library_lookup(libraries)]


def dependency_hits(kind: str, text: str, libraries: dict[str, Library] | None = None) -> str:
    """SQL for the findings of one manifest: an entry per (line, algorithm), first package first.

    ``ord_a`` is the position of the package and ``ord_b`` of the algorithm in
    what its library exposes.
    """
    known = library_lookup(libraries)
    slots: list[list[dict]] = [[] for _ in range(2 * len(known) + 1)]
    for name, lib in known.items():
        slots[zlib.crc32(name.encode()) % len(slots)].append(
            {"key": name, "name": lib.package_name, "text": lib.description, "exposes": lib.exposes})
    table = (f"from_json({quote(json.dumps(slots))}, 'array<array<struct<"
             "key:string,name:string,text:string,exposes:array<string>>>>')")

    def found(name: str) -> str:
        """The library of a name; a slot of the literal table holds one or two."""
        slot = f"get({table}, cast(crc32(cast(key AS binary)) % {len(slots)} AS int))"
        return bind(f"lower({strip(name)})", "key", f"get(filter({slot}, s -> s.key = key), 0)")

    exposed = (
        "transform(lib.exposes, (algorithm, j) -> named_struct('line_number', p.line_number, "
        "'algorithm_id', algorithm, 'ord_a', i, 'ord_b', j, "
        "'matched_text', lib.name, 'line_text', lib.text))")
    library = found("p.package")
    is_known = f"{found('name')} IS NOT NULL"
    packages = packages_of(kind, text, is_known)
    per_package = f"transform({packages}, (p, i) -> {bind(library, 'lib', exposed)})"
    hits = f"sort_array(flatten(filter({per_package}, h -> h IS NOT NULL)))"
    # Sorted, equal (line, algorithm) are neighbours and the first package is in front.
    first = ("filter(hits, (h, i) -> i = 0 OR NOT (h.line_number <=> get(hits, i - 1).line_number "
             "AND h.algorithm_id = get(hits, i - 1).algorithm_id))")
    return f"CAST({bind(hits, 'hits', first)} AS {HITS_TYPE})"
