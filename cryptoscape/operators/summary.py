"""Aggregates per repository: risk counts, readiness score, rules, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cryptoscape.functions.scales import lookup
from cryptoscape.operators.scan import place

# Object identifiers, and the asymmetric algorithms that encrypt or agree keys.
OIDS = {
    "RSA": "1.2.840.113549.1.1.1",
    "DSA": "1.2.840.10040.4.1",
    "ECDSA": "1.2.840.10045.2.1",
    "AES-256": "2.16.840.1.101.3.4.1.41",
    "AES-128": "2.16.840.1.101.3.4.1.1",
    "SHA-256": "2.16.840.1.101.3.4.2.1",
    "SHA-384": "2.16.840.1.101.3.4.2.2",
    "SHA-512": "2.16.840.1.101.3.4.2.3",
    "SHA-1": "1.3.14.3.2.26",
    "MD5": "1.2.840.113549.2.5",
    "Ed25519": "1.3.101.112",
    "X25519": "1.3.101.110",
}
KEY_EXCHANGE = ("RSA", "ECDH", "DH", "X25519", "X448", "ElGamal")
# Primitives by type; the level of a rule by its risk.
PRIMITIVES = {"symmetric": "blockcipher", "hash": "hash", "kdf": "kdf", "mac": "mac"}
RULE_LEVEL = {"VULNERABLE": "error", "PARTIAL": "warning", "SAFE": "note", "UNKNOWN": "warning"}


def risk_counts(findings: DataFrame, *more: Column) -> DataFrame:
    """Findings by risk; an UNKNOWN risk only counts in the total."""
    counted = [F.count_if(F.col("quantum_risk") == risk).alias(name)
               for name, risk in (("vulnerable", "VULNERABLE"), ("partial", "PARTIAL"),
                                  ("safe", "SAFE"))]
    return findings.groupBy("repo").agg(F.count("*").alias("total_findings"), *counted,
                                        *more)


def score_of(safe: Column, total: Column) -> Column:
    """Percentage of safe findings; 100 without findings."""
    return F.when(total == 0, F.lit(100.0)).otherwise(safe / total * 100)


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "yellow").otherwise("red")


def readiness(findings: DataFrame, repos: DataFrame | None = None, *more: Column) -> DataFrame:
    """Counts, score and band per repository, and ``more`` aggregates.

    ``repos`` lists all repositories (as ``count_files`` does), so one without
    findings has a row too.
    """
    counts = risk_counts(findings, *more)
    if repos is not None:
        counts = repos.join(counts, "repo", "left").na.fill(
            0, ["total_findings", "vulnerable", "partial", "safe"])
    score = score_of(F.col("safe"), F.col("total_findings"))
    return counts.withColumn("quantum_ready_score", score).withColumn(
        "score_band", score_band(F.col("quantum_ready_score")))


def first_findings(findings: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per algorithm of a repository: first_key, occurrences and ``fields`` of the first finding.

    Findings with their number (``stored_inventory``) are aggregated by hash: the
    least number, and the fields from the finding that has it; the semi join leaves
    only such findings, so Spark never broadcasts all of them. Others carry their
    keys and fields through a sort.
    """
    key, group = place(findings), findings.groupBy("repo", "algorithm_id")
    if "seq_no" not in findings.columns:
        return group.agg(F.min(key).alias("first_key"), F.count("*").alias("occurrences"),
                         F.min_by(F.struct(*fields), key).alias("r")).select(
            "repo", "algorithm_id", "first_key", "occurrences", "r.*")
    firsts = group.agg(F.min(key).alias("first_key"), F.count("*").alias("occurrences"))
    rows = findings.select(key.alias("first_key"), *fields).join(
        firsts.select("first_key"), "first_key", "left_semi")
    return firsts.join(rows, "first_key").select(
        "repo", "algorithm_id", "first_key", "occurrences", *fields)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule per algorithm of a repository, from its first finding."""
    fields = ("algorithm_name", "algorithm_type", "quantum_risk", "reason", "replacement")
    return first_findings(findings, fields).drop("occurrences").withColumn(
        "default_level", lookup("quantum_risk", RULE_LEVEL, "warning"))


def asset_type(algorithm_type: str) -> Column:
    return lookup(algorithm_type, {"protocol": "protocol"}, "algorithm")


def primitive_of(algorithm_type: str, algorithm_id: str) -> Column:
    """CycloneDX primitive; null for a protocol or an unknown type."""
    asymmetric = lookup(algorithm_id, dict.fromkeys(KEY_EXCHANGE, "pke"), "signature")
    return F.when(F.col(algorithm_type) == "asymmetric", asymmetric).otherwise(
        lookup(algorithm_type, PRIMITIVES))


def cbom_components(findings: DataFrame) -> DataFrame:
    """One component per algorithm of a repository, in the order of first findings.

    The first finding stands for the component. The window ranks algorithms, of
    which a repository has no more than the catalogue, not findings.
    """
    fields = ("algorithm_name", "algorithm_type", "quantum_risk", "replacement", "source",
              "confidence", "context", "severity", "category", "remediation")
    grouped = first_findings(findings, fields)
    ranked = F.row_number().over(Window.partitionBy("repo").orderBy("first_key")) - 1
    return grouped.withColumns({
        "component_index": ranked,
        "bom_ref": F.concat_ws("-", F.lit("crypto"), "algorithm_id", ranked.cast("string")),
        "asset_type": asset_type("algorithm_type"),
        "oid": lookup("algorithm_id", OIDS),
        "primitive": primitive_of("algorithm_type", "algorithm_id"),
    })
