"""Checks of a catalogue; every check returns the offending rows.

They take catalogues as DataFrames, bundled or of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryptoscape.functions.scales import RISKS
from cryptoscape.sources.catalogue import exposed_rows, pattern_rows

# The domains of the catalogue columns.
TYPES = ("asymmetric", "symmetric", "hash", "kdf", "mac", "protocol")
CATEGORIES = ("pki", "at-rest", "hash", "kdf", "mac", "tls", "protocol", "jwt")
ECOSYSTEMS = ("python", "npm", "go", "java", "rust")
STANDARD_BODIES = ("nist", "ietf", "cnsa")
NEEDS_CCN = ("RSA", "ECDSA", "AES-256", "SHA-256")
EU_DEADLINES = ("eu_high_risk", "eu_full_transition")


def unknown_exposed(libraries: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Exposed algorithms that the catalogue does not have."""
    return exposed_rows(libraries).join(algorithms.select("algorithm_id"), "algorithm_id", "left_anti").select(
        "library_id", "algorithm_id")


def repeated_patterns(algorithms: DataFrame) -> DataFrame:
    """Patterns that occur twice in an algorithm."""
    return pattern_rows(algorithms).groupBy("algorithm_id", "pattern").agg(F.count("*").alias("times")).where(
        F.col("times") > 1)


def blank_patterns(algorithms: DataFrame) -> DataFrame:
    """Algorithms without a pattern, or with a blank one."""
    blank = F.exists("patterns", lambda p: F.trim(p) == "")
    return algorithms.where((F.size("patterns") == 0) | blank).select("algorithm_id")


def _problems(id_column: str, df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per (id, failed check); a check that is null failed."""
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
    return df.select(id_column, F.explode(failed).alias("problem"))


def algorithm_problems(algorithms: DataFrame) -> DataFrame:
    """Algorithms with a missing field, a value outside its domain or a short replacement."""
    vulnerable = F.col("quantum_risk") == "VULNERABLE"
    return _problems("algorithm_id", algorithms, {
        "name": F.col("name") != "",
        "type": F.col("type").isin(*TYPES),
        "quantum_risk": F.col("quantum_risk").isin(*RISKS),
        "category": F.col("category").isin(*CATEGORIES),
        "reason": F.col("reason") != "",
        "remediation": F.col("remediation") != "",
        "replacement": F.col("replacement").isNotNull()
        & (~vulnerable | (F.length("replacement") > 10)),
    })


def library_problems(libraries: DataFrame) -> DataFrame:
    return _problems("library_id", libraries, {
        "ecosystem": F.col("ecosystem").isin(*ECOSYSTEMS),
        "package_name": F.col("package_name") != "",
        "description": F.col("description").isNotNull(),
        "exposes": F.size("exposes") > 0,
        "default_risk": F.col("default_risk").isin(*RISKS[:3]),
    })


def reference_problems(algorithms: DataFrame) -> DataFrame:
    """Algorithms without the references and deadlines they need."""
    def has(column: str, key: str) -> Column:
        return F.coalesce(F.map_contains_key(column, key), F.lit(False))

    bodies = has("references", STANDARD_BODIES[0])
    for body in STANDARD_BODIES[1:]:
        bodies = bodies | has("references", body)
    asymmetric = (F.col("type") == "asymmetric") & (F.col("quantum_risk") == "VULNERABLE")
    deadlines = has("deadlines", EU_DEADLINES[0]) & has("deadlines", EU_DEADLINES[1])
    return _problems("algorithm_id", algorithms, {
        "no standard body": bodies,
        "no cnsa reference": ~asymmetric | has("references", "cnsa"),
        "no eu deadlines": ~asymmetric | deadlines,
        "no ccn reference": ~F.col("algorithm_id").isin(*NEEDS_CCN) | has("references", "ccn"),
    })
