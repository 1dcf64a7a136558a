"""Algorithm and library catalogues: loading, checks and DataFrame form."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cryptoscape.functions.scales import RISKS
from cryptoscape.sources import catalogue_data as data

_ALGORITHM_KEYS = ("name", "type", "quantum_risk", "reason", "replacement", "patterns")
_LIBRARY_KEYS = ("ecosystem", "package_name", "description", "exposes", "default_risk")


@dataclass(frozen=True)
class Algorithm:
    id: str
    name: str
    type: str
    quantum_risk: str
    reason: str
    replacement: str
    patterns: list[str] = field(default_factory=list)
    category: str | None = None
    remediation: str | None = None
    variants: list[str] = field(default_factory=list)
    references: dict[str, list[str]] = field(default_factory=dict)
    deadlines: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Library:
    id: str
    ecosystem: str
    package_name: str
    description: str
    exposes: list[str]
    default_risk: str
    notes: str | None = None


def load_algorithms(path: str | os.PathLike | None = None) -> dict[str, Algorithm]:
    """The bundled algorithms, or those of a JSON or YAML file, by id.

    A file holds one object with the key ``algorithms``: id -> fields.
    """
    if path is None:
        return {algorithm_id: _bundled_algorithm(algorithm_id) for algorithm_id in data.ALGORITHMS}
    return algorithms_from_dict(_read_document(path, "algorithms"))


def algorithms_from_dict(raw: dict[str, dict[str, Any]]) -> dict[str, Algorithm]:
    """Check raw entries (required fields, known risk) and build the catalogue."""
    result = {}
    for algorithm_id, entry in raw.items():
        _require(f"algorithm {algorithm_id!r}", entry, _ALGORITHM_KEYS)
        if entry["quantum_risk"] not in RISKS:
            raise ValueError(f"algorithm {algorithm_id!r}: quantum_risk must be one of {RISKS}, "
                             f"not {entry['quantum_risk']!r}")
        known = {k: v for k, v in entry.items() if k in Algorithm.__dataclass_fields__}
        result[algorithm_id] = Algorithm(id=algorithm_id, **{k: v for k, v in known.items()
                                                             if k != "id"})
    return result


def load_libraries(path: str | os.PathLike | None = None) -> dict[str, Library]:
    """The bundled libraries, or those of a JSON or YAML file, by id."""
    if path is None:
        return {
            library_id: Library(library_id, ecosystem, package, description, list(exposes), risk)
            for library_id, (ecosystem, package, risk, description, exposes)
            in data.LIBRARIES.items()
        }
    return libraries_from_dict(_read_document(path, "libraries"))


def libraries_from_dict(raw: dict[str, dict[str, Any]]) -> dict[str, Library]:
    result = {}
    for library_id, entry in raw.items():
        _require(f"library {library_id!r}", entry, _LIBRARY_KEYS)
        result[library_id] = Library(id=library_id, notes=entry.get("notes"),
                                     **{k: entry[k] for k in _LIBRARY_KEYS})
    return result


def get_patterns_for_algorithm(
    algorithm_id: str, algorithms: dict[str, Algorithm] | None = None
) -> list[str]:
    catalogue = algorithms or load_algorithms()
    return list(catalogue[algorithm_id].patterns) if algorithm_id in catalogue else []


def get_all_patterns(algorithms: dict[str, Algorithm] | None = None) -> dict[str, list[str]]:
    return {a.id: list(a.patterns) for a in (algorithms or load_algorithms()).values()}


_ALGORITHM_SCHEMA = pa.schema([
    ("algorithm_id", pa.string()), ("algo_ord", pa.int32()), ("name", pa.string()),
    ("type", pa.string()), ("quantum_risk", pa.string()), ("reason", pa.string()),
    ("replacement", pa.string()), ("category", pa.string()), ("remediation", pa.string()),
    ("variants", pa.list_(pa.string())), ("patterns", pa.list_(pa.string())),
    ("references", pa.map_(pa.string(), pa.list_(pa.string()))),
    ("deadlines", pa.map_(pa.string(), pa.string())),
])
_LIBRARY_SCHEMA = pa.schema([
    ("library_id", pa.string()), ("lib_ord", pa.int32()), ("ecosystem", pa.string()),
    ("package_name", pa.string()), ("description", pa.string()),
    ("exposes", pa.list_(pa.string())), ("default_risk", pa.string()), ("notes", pa.string()),
])


def algorithms_df(
    spark: SparkSession, algorithms: dict[str, Algorithm] | None = None
) -> DataFrame:
    """The algorithm catalogue as a local relation (its size is known to the optimizer)."""
    rows = [
        {**{k: getattr(a, k) for k in _ALGORITHM_SCHEMA.names if hasattr(a, k)},
         "algorithm_id": a.id, "algo_ord": i,
         "references": list(a.references.items()), "deadlines": list(a.deadlines.items())}
        for i, a in enumerate((algorithms or load_algorithms()).values())
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_ALGORITHM_SCHEMA))


def libraries_df(spark: SparkSession, libraries: dict[str, Library] | None = None) -> DataFrame:
    rows = [
        {**{k: getattr(lib, k) for k in _LIBRARY_SCHEMA.names if hasattr(lib, k)},
         "library_id": lib.id, "lib_ord": i}
        for i, lib in enumerate((libraries or load_libraries()).values())
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_LIBRARY_SCHEMA))


def pattern_rows(algorithms: DataFrame) -> DataFrame:
    """``algorithm_id, pat_ord, pattern``: the patterns of a catalogue table, one per row."""
    return algorithms.select("algorithm_id", F.posexplode("patterns").alias("pat_ord", "pattern"))


def exposed_rows(libraries: DataFrame) -> DataFrame:
    """``library_id, expose_ord, algorithm_id``: what the libraries of a table expose."""
    return libraries.select(
        "library_id", F.posexplode("exposes").alias("expose_ord", "algorithm_id"))


def _bundled_algorithm(algorithm_id: str) -> Algorithm:
    name, kind, risk, category, patterns = data.ALGORITHMS[algorithm_id]
    replacement, reason = data.ADVICE.get(algorithm_id, (
        f"No change needed: {name} resists quantum attack",
        "its security level stays sufficient under Grover's search"))
    remediation = "No action required." if risk == "SAFE" else f"Migrate to {replacement}."
    deadlines = dict(data.DEADLINES) if kind == "asymmetric" else {}
    if algorithm_id == "RSA":
        deadlines.update(data.RSA_DEADLINES)
    return Algorithm(
        id=algorithm_id, name=name, type=kind, quantum_risk=risk, reason=reason,
        replacement=replacement, patterns=list(patterns), category=category,
        remediation=remediation, variants=data.VARIANTS.get(algorithm_id, []),
        references=data.REFERENCES.get(algorithm_id, data.TYPE_REFERENCES[kind]),
        deadlines=deadlines,
    )


def _read_document(path: str | os.PathLike, key: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("a YAML catalogue needs the yaml package; use JSON") from e
        document = yaml.safe_load(text)
    else:
        document = json.loads(text)
    if not isinstance(document, dict) or key not in document:
        raise ValueError(f"{path}: expected an object with the key {key!r}")
    return document[key]


def _require(what: str, entry: dict[str, Any], keys: tuple[str, ...]) -> None:
    missing = [k for k in keys if k not in entry]
    if missing:
        raise ValueError(f"{what}: missing required fields {missing}")
