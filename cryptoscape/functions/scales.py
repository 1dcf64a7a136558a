"""Ordered scales: severities and risks, and the fixed lookups on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cryptoscape.functions.text import quote

# Most severe first; the order in which reports list the risks.
SEVERITIES = ("critical", "high", "medium", "low", "info")
RISKS = ("VULNERABLE", "PARTIAL", "SAFE", "UNKNOWN")


def lookup(key: str, table: dict, default: object = None) -> Column:
    """Value for the SQL expression ``key`` in a small fixed table, else ``default``."""
    def literal(value: object) -> str:
        return quote(value) if isinstance(value, str) else "NULL" if value is None else str(value)

    branches = " ".join(f"WHEN {quote(k)} THEN {literal(v)}" for k, v in table.items())
    return F.expr(f"CASE {key} {branches} ELSE {literal(default)} END")


def severity_index(severity: str) -> Column:
    """0 for critical to 4 for info; an unknown severity counts as medium."""
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}, 2)
