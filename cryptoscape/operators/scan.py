"""The scan: one pass over the corpus table, without a shuffle.

Per file: class and size from the path, then one case-folded copy of the text
and a search for any anchor of the patterns, so a file that cannot hold a
finding is dropped before its lines are made. Per line: its anchors name the
patterns that are tried. Manifests give their findings as one array per file. The corpus is read once for all scanners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cryptoscape.functions import paths
from cryptoscape.functions import text as tx
from cryptoscape.operators import files as fl
from cryptoscape.operators.config_rules import config_patterns
from cryptoscape.operators.dependencies import HITS_TYPE, dependency_hits, package_words
from cryptoscape.operators.pattern_index import PatternIndex, build_index
from cryptoscape.operators.patterns import Pattern, compile_patterns, guard, guard_groups
from cryptoscape.sources.catalogue import Algorithm, Library

SOURCES = ("source_code", "dependency", "config")
FINDING_COLUMNS = ("repo", "path", "line_number", "matched_text", "algorithm_id", "source",
                   "line_text", "ord_a", "ord_b")


def scan_files(
    files: DataFrame,
    algorithms: dict[str, Algorithm] | None = None,
    libraries: dict[str, Library] | None = None,
    sources: Sequence[str] = SOURCES,
    max_bytes: int | None = None,
    probe_bytes: int | None = None,
) -> DataFrame:
    """Findings of the corpus: one row per (file, line, algorithm) and scanner.

    ``ord_a``/``ord_b`` order the findings of one file in one scanner. Files
    larger than ``max_bytes`` and source files with a NUL in their first
    ``probe_bytes`` are left out; without limits, every size and the whole
    content count.

    Of a corpus stored by file class (``files.store_corpus``) only the classes
    of the scanners are read. A row may hold a chunk of a file: lines of it, with their place in a column
    ``chunk_start`` that is null for whole files (``sources.large_tree``).
    Chunks are read once more for their numbers of lines. A manifest in chunks
    gives no dependency findings.
    """
    if "chunk_start" in files.columns:
        whole = files.where("chunk_start IS NULL").drop("chunk_start")
        parts = files.where("chunk_start IS NOT NULL")
        found = _scan(whole, algorithms, libraries, sources, max_bytes, probe_bytes)
        by_line = [s for s in sources if s != "dependency"]
        return found if not by_line else found.unionByName(
            _scan_chunks(parts, algorithms, by_line, max_bytes, probe_bytes))
    return _scan(files, algorithms, libraries, sources, max_bytes, probe_bytes)


def _scan_chunks(chunks: DataFrame, algorithms: dict[str, Algorithm] | None,
                 sources: Sequence[str], max_bytes: int | None, probe_bytes: int | None) -> DataFrame:
    """Findings of chunks, with the line numbers of their files.

    The scan hands ``repo`` on as it is, so it can hold the place of the chunk besides. The window
    has one narrow row per chunk of a file.
    """
    # Whether a file is binary is known when all of its chunks are.
    found = _scan(chunks.withColumn("repo", F.struct("repo", "chunk_start")), algorithms, None,
                  sources, max_bytes, probe_bytes=0)
    dtype = chunks.schema["content"].dataType
    left = None if probe_bytes is None else F.greatest(
        F.lit(probe_bytes) - F.col("chunk_start"), F.lit(0)).cast("int")
    text = tx.bind_row(
        chunks.select("repo", "path", "chunk_start",
                      tx.is_binary(F.col("content"), dtype, left).alias("has_nul"),
                      tx.decode(F.col("content"), dtype).alias("raw")), "text", F.col("raw"))
    counted = text.select("repo", "path", "chunk_start", "has_nul",
                          F.expr(tx.count_breaks("text")).alias("breaks"))
    file = Window.partitionBy("repo", "path")
    earlier = file.orderBy("chunk_start").rowsBetween(Window.unboundedPreceding, -1)
    places = counted.select(
        F.struct("repo", "chunk_start").alias("repo"), "path",
        F.coalesce(F.sum("breaks").over(earlier), F.lit(0)).cast("int").alias("_before"),
        F.max("has_nul").over(file).alias("_binary"))
    placed = found.join(places, ["repo", "path"]).where(
        (F.col("source") != "source_code") | ~F.col("_binary"))
    return placed.withColumns({
        "repo": F.col("repo.repo"), "line_number": F.col("line_number") + F.col("_before"),
        "ord_a": F.col("ord_a") + F.col("_before")}).select(*FINDING_COLUMNS)


def _scan(files: DataFrame, algorithms: dict[str, Algorithm] | None,
          libraries: dict[str, Library] | None, sources: Sequence[str], max_bytes: int | None,
          probe_bytes: int | None) -> DataFrame:
    patterns: list[Pattern] = []
    if "source_code" in sources:
        patterns += compile_patterns(files.sparkSession, algorithms)
    if "config" in sources:
        patterns += config_patterns()

    index = build_index(patterns)
    with_deps = "dependency" in sources
    may_depend = guard("folded", "mask", guard_groups(
        fl.CLASS_BIT["manifest"], package_words(libraries))) if with_deps else "false"

    classes = sorted({p.file_class for p in patterns})
    files = fl.of_classes(files, [*classes, "manifest"] if with_deps else classes)
    classed = _classed(files, classes, with_deps, max_bytes, probe_bytes)
    whole = tx.bind_row(classed, "folded", tx.fold_case(F.col("text")))
    # A JSON key may be written with escapes, which the guard cannot see through.
    escaped = (F.col("kind") == "package.json") & F.col("text").contains("\\")
    candidates = whole.where(
        F.expr(index.may_match("folded", "mask")) | F.expr(may_depend) | escaped)

    lines = _lines_of(candidates, libraries, with_deps)
    has_deps = (F.col("pos") == 0) & F.col("deps").isNotNull()
    lines = tx.bind_row(lines, "anchors", F.expr(index.found_anchors("folded", "mask")))
    possible = F.lit(True) if index.free else F.size("anchors") > 0
    hits = lines.where(possible | has_deps).select(
        "repo", "path", F.explode(F.expr(_all_hits(patterns, index))).alias("hit"))
    return hits.select("repo", "path", *[F.col(f"hit.{c}").alias(c) for c in FINDING_COLUMNS[2:]])


def scan_source(files: DataFrame, algorithms: dict[str, Algorithm] | None = None) -> DataFrame:
    return scan_files(files, algorithms, sources=["source_code"])


def scan_config(files: DataFrame) -> DataFrame:
    return scan_files(files, sources=["config"])


def scan_dependencies(files: DataFrame, libraries: dict[str, Library] | None = None) -> DataFrame:
    return scan_files(files, libraries=libraries, sources=["dependency"])


def scan_order() -> list[Column]:
    """Sort keys of a scan: source, then dependency, then config findings by path.

    Dependency findings follow the order of path components and of packages.
    """
    return [F.col("repo"), *report_order()]


def report_order() -> list[Column]:
    """Sort keys inside one repository."""
    ordinal = F.when(F.col("source") == "source_code", 0).when(
        F.col("source") == "dependency", 1).otherwise(2)
    # Components compare like an array when what joins them sorts before any character.
    key = F.when(F.col("source") == "dependency", F.translate("path", "/", "\x01")).otherwise(
        F.col("path"))
    return [ordinal, key, F.col("ord_a"), F.col("ord_b")]


def report_key() -> Column:
    """The sort keys inside a repository as one comparable value."""
    ordinal, key, ord_a, ord_b = report_order()
    return F.struct(ordinal.alias("source_ord"), key.alias("path_key"), ord_a, ord_b)


def place(findings: DataFrame) -> Column:
    """What orders the findings of a repository: their number where they are stored in order, or the key.

    A number is of fixed width, so its minimum is found by hashing, without a sort.
    """
    return F.col("seq_no") if "seq_no" in findings.columns else report_key()


def _classed(files: DataFrame, classes: list[str], with_deps: bool, max_bytes: int | None,
             probe_bytes: int | None) -> DataFrame:
    """``repo, path, mask, kind, text`` of the files that some scanner looks at."""
    dtype = files.schema["content"].dataType
    source, manifest = F.lit(fl.CLASS_BIT["source"]), F.lit(fl.CLASS_BIT["manifest"])
    kind = fl.manifest_kind() if with_deps else F.lit(None).cast("string")
    readable = ((F.col("mask").bitwiseAND(source) == 0)
                | ~tx.is_binary(F.col("content"), dtype, probe_bytes))

    sized = files if max_bytes is None else fl.with_size(files)
    small = sized.where(fl.small_enough(max_bytes) & F.col("content").isNotNull())
    named = tx.bind_row(small.select("repo", "path", "content"), "named", F.struct(
        paths.file_suffix(F.col("path")).alias("suffix"), kind.alias("kind")))
    mask = fl.class_mask(classes, "named.suffix").bitwiseOR(
        F.when(F.col("named.kind").isNotNull(), manifest).otherwise(0))
    text = tx.decode(F.col("content"), dtype)
    return tx.bind_row(named, "mask", mask).where((F.col("mask") != 0) & readable).select(
        "repo", "path", "mask", F.col("named.kind").alias("kind"), text.alias("text"))


def _lines_of(candidates: DataFrame, libraries: dict[str, Library] | None,
              with_dependencies: bool) -> DataFrame:
    """Lines of the files that patterns apply to; one empty line for any other file.

    The findings of a manifest are on its first row only.
    """
    deps = f"CAST(NULL AS {HITS_TYPE})"
    if with_dependencies:
        hits = dependency_hits("kind", "text", libraries)
        deps = f"CASE WHEN kind IS NOT NULL THEN {hits} END"
    has_lines = f"mask & {~fl.CLASS_BIT['manifest']} <> 0"
    # Folding changes no line break, so both texts have the same lines.
    zipped = f"arrays_zip({tx.split_lines('text')}, {tx.split_lines('folded')})"
    lines = f"CASE WHEN {has_lines} THEN {zipped} ELSE arrays_zip(array(''), array('')) END"
    return candidates.withColumn("deps", F.expr(deps)).select(
        "repo", "path", "mask", "deps", F.posexplode(F.expr(lines)).alias("pos", "l")
    ).select("repo", "path", "mask", "deps", "pos", F.col("l.0").alias("line"),
             F.col("l.1").alias("folded"))


def _all_hits(patterns: list[Pattern], index: PatternIndex) -> str:
    """SQL for the line and dependency findings of a row, in one shape."""
    found = "" if not patterns else (
        f"transform({index.line_hits('anchors', 'line', 'folded', 'mask')}, r -> named_struct("
        "'line_number', pos + 1, 'matched_text', regexp_extract(line, r.hit.regex, 0), "
        "'algorithm_id', r.algorithm_id, 'source', r.source, "
        f"'line_text', coalesce(r.hit.line_text, {tx.strip('line')}), "
        "'ord_a', pos + 1, 'ord_b', r.hit.place))")
    deps = (
        f"transform(CASE WHEN pos = 0 AND deps IS NOT NULL THEN deps "
        f"ELSE CAST(array() AS {HITS_TYPE}) END, d -> named_struct("
        "'line_number', d.line_number, 'matched_text', d.matched_text, "
        "'algorithm_id', d.algorithm_id, 'source', 'dependency', 'line_text', d.line_text, "
        "'ord_a', d.ord_a, 'ord_b', d.ord_b))")
    return f"concat({found}, {deps})" if patterns else deps
