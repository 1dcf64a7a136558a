"""Classification of findings: risk, context, confidence, severity."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryptoscape.functions import text as tx
from cryptoscape.functions.paths import glob_at_component
from cryptoscape.functions.scales import lookup
from cryptoscape.sources.catalogue import Algorithm, algorithms_df, load_algorithms

# Globs of test, documentation and build files, tried in this order.
CONTEXT_GLOBS = {
    "test": ("test_*", "*_test.py", "tests/*", "__tests__/*", "spec/*", "*_spec.*", "test/*"),
    "docs": ("docs/*", "*.md", "*.rst", "README*", "CHANGELOG*"),
    "build": ("build/*", "dist/*", "*.min.js", "*.min.css", "Makefile", "Dockerfile"),
}
# Starts of a comment line; lines that import or call.
COMMENT_STARTS = ("#", "//", "/*", "*", '"""', "'''")
IMPORT_LINE = (r"(?U)(?:^\s*(?:import\s+\S|from\s+\S+\s+import\s|use\s+\S)"
               r"|require\s*\()")
CALL_LINE = (r"(?U)(?:\.\s*(?:generate|encrypt|decrypt|sign|verify|digest|update|new|create)"
             r"\s*\(|new\s+\w+\s*\()")

# Fixed values: (risk, confidence) -> severity at run time, severity elsewhere.
SEVERITY = {
    ("VULNERABLE", "high"): ("critical", "low"),
    ("VULNERABLE", "medium"): ("high", "medium"),
    ("VULNERABLE", "low"): ("medium", "medium"),
    ("PARTIAL", "high"): ("high", "info"),
    ("PARTIAL", "medium"): ("medium", "low"),
    ("PARTIAL", "low"): ("low", "low"),
}
# The level of a result by its severity.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note",
               "info": "note"}


def _join_catalogue(findings: DataFrame, algorithms: dict[str, Algorithm],
                    *columns: Column) -> DataFrame:
    # A local relation: its size decides whether the join broadcasts it.
    catalogue = algorithms_df(findings.sparkSession, algorithms).select("algorithm_id", *columns)
    return findings.join(catalogue, "algorithm_id", "left")


def classify(findings: DataFrame,
             algorithms: dict[str, Algorithm] | str | os.PathLike | None = None,
             more: tuple[str, ...] = ()) -> DataFrame:
    """Add name, type, risk, reason and replacement of the algorithm, and ``more`` of its columns.

    An algorithm outside the catalogue is kept with risk UNKNOWN. A catalogue
    that cannot be read gives no rows.
    """
    try:
        catalogue = (algorithms if isinstance(algorithms, dict)
                     else load_algorithms(algorithms))
    except (FileNotFoundError, ValueError):
        catalogue, findings = load_algorithms(), findings.where(F.lit(False))
    joined = _join_catalogue(
        findings, catalogue, F.col("name").alias("algorithm_name"),
        F.col("type").alias("algorithm_type"), "quantum_risk", "reason", "replacement", *more)
    return joined.withColumns({
        "algorithm_name": F.coalesce("algorithm_name", "algorithm_id"),
        "algorithm_type": F.coalesce("algorithm_type", F.lit("unknown")),
        "reason": F.when(F.col("quantum_risk").isNull(), "Algorithm not in database")
        .otherwise(F.col("reason")),
        "replacement": F.when(F.col("quantum_risk").isNull(), "").otherwise(F.col("replacement")),
        "quantum_risk": F.coalesce("quantum_risk", F.lit("UNKNOWN")),
    })


def context_of(path: str, line_text: str) -> Column:
    """test, docs, build (by path), comment (by line) or runtime."""
    bare = f"ltrim({tx.quote(tx.WHITE_SPACE)}, {line_text})"
    by_path = " ".join(f"WHEN {glob_at_component(path, globs)} THEN '{context}'"
                       for context, globs in CONTEXT_GLOBS.items())
    comment = " OR ".join(f"startswith({bare}, {tx.quote(s)})" for s in COMMENT_STARTS)
    return F.expr(f"CASE {by_path} WHEN {comment} THEN 'comment' ELSE 'runtime' END")


def confidence_of(line_text: str, source: str, context: str) -> Column:
    """high for manifests, settings, imports and calls; low for other comments and docs."""
    active = " OR ".join(f"{line_text} RLIKE {tx.quote(r)}" for r in (IMPORT_LINE, CALL_LINE))
    return F.expr(f"CASE WHEN {source} IN ('dependency', 'config') OR {active} THEN 'high' "
                  f"WHEN {context} IN ('comment', 'docs') THEN 'low' ELSE 'medium' END")


def classify_context(findings: DataFrame) -> DataFrame:
    """``context`` and ``confidence`` from ``path``, ``line_text`` and ``source``."""
    return findings.withColumn("context", context_of("path", "line_text")).withColumn(
        "confidence", confidence_of("line_text", "source", "context"))


def enrich_findings(findings: DataFrame) -> DataFrame:
    """Add context and confidence to findings."""
    return classify_context(findings)


def severity_of(risk: str, confidence: str, context: str) -> Column:
    key = f"concat_ws(' ', {risk}, {confidence})"
    runtime = lookup(key, {" ".join(k): v[0] for k, v in SEVERITY.items()}, "medium")
    elsewhere = lookup(key, {" ".join(k): v[1] for k, v in SEVERITY.items()}, "medium")
    away = F.col(context).isin("test", "docs", "comment", "build")
    return F.when(F.col(risk) == "SAFE", "info").when(away, elsewhere).otherwise(runtime)


def enrich_severity(findings: DataFrame) -> DataFrame:
    """Add severity, and category and remediation from the bundled catalogue."""
    with_severity = findings.withColumn("severity", severity_of(
        "quantum_risk", "confidence", "context"))
    return _join_catalogue(with_severity, load_algorithms(), "category", "remediation")


def sarif_level(severity: str) -> Column:
    return lookup(severity, SARIF_LEVEL, "warning")


def assess(findings: DataFrame, algorithms: dict[str, Algorithm] | None = None) -> DataFrame:
    """Classified findings with context, confidence and severity."""
    if algorithms is not None:
        return enrich_severity(enrich_findings(classify(findings, algorithms)))
    # With the bundled catalogue one join brings everything.
    found = enrich_findings(classify(findings, more=("category", "remediation")))
    return found.withColumn("severity", severity_of("quantum_risk", "confidence", "context"))
