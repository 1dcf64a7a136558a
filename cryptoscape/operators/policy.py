"""Policies: ignore, allow with expiry, severity overrides, and the fail gate.

A policy is one struct. One policy for all repositories is a literal; policies
by repository are a table of one row each, joined on the repository. Its rules
are then array predicates, so no rule join multiplies findings.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cryptoscape.functions.paths import GLOBS_TYPE, glob_index, glob_regex, matches_any_glob
from cryptoscape.functions.scales import SEVERITIES, severity_index
from cryptoscape.functions.text import quote

POLICY_TYPE = (
    f"struct<ignore_paths:string,ignore_globs:{GLOBS_TYPE},ignore_algorithms:array<string>,"
    f"allow:array<struct<algorithm:string,globs:{GLOBS_TYPE},expires:date>>,"
    "overrides:array<struct<algorithm:string,severity:string>>,"
    "on_severity:string,max_new:int>"
)


class PolicyError(ValueError):
    """A policy has a missing key or an invalid value."""


@dataclass(frozen=True)
class AllowRule:
    algorithm: str
    paths: list[str]
    reason: str
    expires: dt.date | None = None


@dataclass(frozen=True)
class SeverityOverride:
    algorithm: str
    severity: str
    reason: str


@dataclass(frozen=True)
class Policy:
    version: str
    ignore_paths: list[str] = field(default_factory=list)
    ignore_algorithms: list[str] = field(default_factory=list)
    allow: list[AllowRule] = field(default_factory=list)
    on_severity: str = "high"
    max_new_findings: int = 0
    severity_overrides: list[SeverityOverride] = field(default_factory=list)


# What a policy may hold: kind of value, and whether the key has to be there.
_TEXT, _NUMBER, _DAY, _SEVERITY, _TEXTS = "text", "number", "day", "severity", "texts"
_FIELDS: dict[str, dict[str, tuple[Any, bool]]] = {
    "policy": {"version": (_TEXT, True), "ignore": ("ignore", False), "allow": (["allow"], False),
               "fail": ("fail", False), "severity_overrides": (["severity_overrides"], False)},
    "ignore": {"paths": (_TEXTS, False), "algorithms": (_TEXTS, False)},
    "allow": {"algorithm": (_TEXT, True), "reason": (_TEXT, True), "paths": (_TEXTS, False),
              "expires": (_DAY, False)},
    "fail": {"on_severity": (_SEVERITY, False), "max_new_findings": (_NUMBER, False)},
    "severity_overrides": {"algorithm": (_TEXT, True), "severity": (_SEVERITY, True),
                           "reason": (_TEXT, True)},
}


def policy_from_dict(raw: dict[str, Any]) -> Policy:
    """Build a policy from its nested form; unknown keys and wrong values are errors."""
    found = _checked("policy", raw, "policy")
    ignore, fail = found.get("ignore", {}), found.get("fail", {})
    return Policy(
        version=found["version"],
        ignore_paths=ignore.get("paths", []),
        ignore_algorithms=ignore.get("algorithms", []),
        allow=[AllowRule(e["algorithm"], e.get("paths", []), e["reason"], e.get("expires"))
               for e in found.get("allow", [])],
        on_severity=fail.get("on_severity", "high"),
        max_new_findings=fail.get("max_new_findings", 0),
        severity_overrides=[SeverityOverride(e["algorithm"], e["severity"], e["reason"])
                            for e in found.get("severity_overrides", [])],
    )


def load_policy(path: str, missing_ok: bool = False) -> Policy | None:
    """Policy of a JSON file, or of a YAML file where the yaml package is there.

    With ``missing_ok`` no file means no policy.
    """
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        if missing_ok:
            return None
        raise
    if path.endswith((".yml", ".yaml")):
        import yaml

        return policy_from_dict(yaml.safe_load(text))
    return policy_from_dict(json.loads(text))


def _checked(section: str, value: Any, where: str) -> dict[str, Any]:
    """The entries of a section with their values checked and converted."""
    if not isinstance(value, dict):
        raise PolicyError(f"{where} has to be a mapping")
    fields = _FIELDS[section]
    for key in value:
        if key not in fields:
            raise PolicyError(f"{where} does not know {key!r}; it knows {', '.join(fields)}")
    for key, (_, needed) in fields.items():
        if needed and key not in value:
            raise PolicyError(f"{where} lacks {key!r}")
    return {key: _converted(fields[key][0], v, f"{where}.{key}") for key, v in value.items()}


def _converted(kind: Any, value: Any, where: str) -> Any:
    if isinstance(kind, list) or kind == _TEXTS:
        if not isinstance(value, list):
            raise PolicyError(f"{where} has to be a list")
        if kind == _TEXTS:
            return [str(v) for v in value]
        return [_checked(kind[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if kind == _TEXT:
        return str(value)
    if kind == _NUMBER:
        if not isinstance(value, int) or isinstance(value, bool):
            raise PolicyError(f"{where} has to be a whole number")
        return value
    if kind == _SEVERITY:
        if value not in SEVERITIES:
            raise PolicyError(f"{where}: {value!r} is none of {', '.join(SEVERITIES)}")
        return value
    if kind == _DAY:
        if isinstance(value, dt.date):
            return value
        try:
            return dt.date.fromisoformat(value)
        except (TypeError, ValueError) as e:
            raise PolicyError(f"{where}: {value!r} is no date") from e
    return _checked(kind, value, where)


def _any_glob(globs: list[str]) -> str | None:
    """One regex for all globs, so a path is tested once."""
    return "|".join(f"(?:{glob_regex(g)})" for g in globs) or None


def _as_row(policy: Policy, for_all: bool) -> dict[str, Any]:
    """Globs and ids in the form that rows are tested with, made once on the driver.

    A policy ``for_all`` is a literal, so the regex of its ignored paths is
    compiled once. Globs that differ by row stay apart.
    """
    return {
        "ignore_paths": _any_glob(policy.ignore_paths) if for_all else None,
        "ignore_globs": {} if for_all else glob_index(policy.ignore_paths),
        "ignore_algorithms": [a.upper() for a in policy.ignore_algorithms],
        "allow": [{"algorithm": r.algorithm.upper(), "globs": glob_index(r.paths),
                   "expires": r.expires.isoformat() if r.expires else None}
                  for r in policy.allow],
        "overrides": [{"algorithm": o.algorithm.upper(), "severity": o.severity}
                      for o in policy.severity_overrides],
        "on_severity": policy.on_severity,
        "max_new": policy.max_new_findings,
    }


def policies_df(spark: SparkSession, policies: dict[str, Policy]) -> DataFrame:
    """``repo, policy``: one policy per repository."""
    rows = pa.table({"repo": pa.array(policies, pa.string()),
                     "p": pa.array([json.dumps(_as_row(p, False)) for p in policies.values()],
                                   pa.string())})
    # A local relation: its size decides whether the join broadcasts it.
    return spark.createDataFrame(rows).select(
        "repo", F.from_json("p", POLICY_TYPE).alias("policy"))


def with_policy(df: DataFrame, policy: Policy | DataFrame) -> DataFrame:
    """Add the ``policy`` struct of each row's repository, null where there is none."""
    if isinstance(policy, DataFrame):
        return df.join(policy, "repo", "left")
    literal = f"from_json({quote(json.dumps(_as_row(policy, True)))}, {quote(POLICY_TYPE)})"
    return df.withColumn("policy", F.expr(literal))


def should_ignore_path() -> Column:
    return F.expr("coalesce(path RLIKE policy.ignore_paths, false) OR "
                  f"coalesce({matches_any_glob('path', 'policy.ignore_globs')}, false)")


def should_ignore_finding(as_of: dt.date) -> Column:
    """Ignored algorithm, or an allow rule in force for the algorithm and the path."""
    return F.expr(
        "coalesce(array_contains(policy.ignore_algorithms, upper(algorithm_id)), false) OR "
        "coalesce(exists(policy.allow, a -> a.algorithm = upper(algorithm_id) "
        f"AND coalesce(a.expires >= DATE '{as_of.isoformat()}', true) "
        f"AND coalesce({matches_any_glob('path', 'a.globs')}, false)), false)")


def apply_severity_overrides(findings: DataFrame, policy: Policy | DataFrame) -> DataFrame:
    """Severity of the last override for the algorithm, whatever its case."""
    return with_policy(findings, policy).withColumn("severity", _overridden()).drop("policy")


def _overridden() -> Column:
    return F.expr("coalesce(try_element_at(filter(policy.overrides, "
                  "o -> o.algorithm = upper(algorithm_id)), -1).severity, severity)")


def apply_policy(findings: DataFrame, policy: Policy | DataFrame, as_of: dt.date) -> DataFrame:
    """Override severities, then drop what the policy ignores or allows."""
    kept = with_policy(findings, policy).withColumn("severity", _overridden()).where(
        ~should_ignore_path() & ~should_ignore_finding(as_of))
    return kept.drop("policy")


def check_fail_conditions(findings: DataFrame, policy: Policy | DataFrame,
                          diff_mode: bool = False, repos: DataFrame | None = None) -> DataFrame:
    """``repo, worst, new_findings, fails`` per repository.

    ``repos`` lists all repositories (as ``count_files`` does): one without
    findings has a null ``worst``, no new findings and does not fail.
    """
    status = F.col("diff_status") if "diff_status" in findings.columns else F.lit(None)
    per_repo = findings.groupBy("repo").agg(
        F.min(severity_index("severity")).alias("worst"),
        F.count_if(F.coalesce(status.isin("new", "worsened"), F.lit(False)))
        .alias("new_findings"))
    if repos is not None:
        per_repo = repos.select("repo").join(per_repo, "repo", "left").na.fill(0, ["new_findings"])
    over = F.col("new_findings") > F.col("policy.max_new") if diff_mode else F.lit(False)
    bad = F.coalesce(F.col("worst") <= severity_index("policy.on_severity"), F.lit(False))
    # Without a policy a scan does not fail, and a diff fails on anything new.
    default = F.col("new_findings") > 0 if diff_mode else F.lit(False)
    return with_policy(per_repo, policy).select(
        "repo", "worst", "new_findings",
        F.when(F.col("policy").isNull(), default).otherwise(bad | over).alias("fails"))
