"""Whole inventories: scan, assess, policy, and intermediate tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from cryptoscape.functions.storage import materialize, numbered
from cryptoscape.operators.classify import assess
from cryptoscape.operators.policy import Policy, apply_policy
from cryptoscape.operators.scan import scan_files, scan_order
from cryptoscape.sources.catalogue import Algorithm, Library


def inventory(
    files: DataFrame,
    policy: Policy | DataFrame | None = None,
    as_of: dt.date | None = None,
    algorithms: dict[str, Algorithm] | None = None,
    libraries: dict[str, Library] | None = None,
) -> DataFrame:
    """Assessed findings of a corpus, after its policy where there is one."""
    findings = assess(scan_files(files, algorithms, libraries), algorithms)
    if policy is None:
        return findings
    if as_of is None:
        raise ValueError("a policy needs the day it is applied on (as_of)")
    return apply_policy(findings, policy, as_of)


def stored_inventory(findings: DataFrame, folder: str) -> DataFrame:
    """Findings written to ``folder`` in scan order, each with its number ``seq_no``.

    The scan runs once, however many reports follow; first findings and order
    are then questions about numbers.
    """
    return numbered(findings, scan_order(), folder, "findings")


__all__ = ["inventory", "materialize", "stored_inventory"]
