"""Reports: findings listing, advice, and JSON, SARIF and CycloneDX documents.

A document of a repository is a sequence of pieces: rows with the columns in
``ORDER`` and a text. In that order the texts, one after another, are the
document. There is one shape at every size, so a repository with a third of all
findings is spread over the cluster, and nothing is gathered per repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cryptoscape.functions.scales import RISKS, lookup
from cryptoscape.functions.storage import numbered
from cryptoscape.operators.baseline import BASELINE_VERSION, baseline_entries, diff_summary
from cryptoscape.operators.classify import sarif_level
from cryptoscape.operators.scan import place, report_key
from cryptoscape.operators.summary import cbom_components, readiness, sarif_rules

TOOL = "cryptoscape"
VERSION = "0.1.0"

# What orders the pieces of a repository: part of the document, element and place in
# it, then the finding.
ORDER = ("part", "item", "sub", "source_ord", "path_key", "ord_a", "ord_b")

FINDING_FIELDS = (
    "line_number", "matched_text", "algorithm_id", "algorithm_name", "algorithm_type", "source",
    "quantum_risk", "reason", "replacement", "confidence", "context", "severity", "category",
    "remediation", "diff_status",
)


def with_diff_status(findings: DataFrame) -> DataFrame:
    if "diff_status" in findings.columns:
        return findings
    return findings.withColumn("diff_status", F.lit(None).cast("string"))


# --- listings -----------------------------------------------------------------


def _location() -> Column:
    return F.concat_ws(":", "path", F.col("line_number").cast("string"))


def findings_listing(findings: DataFrame) -> DataFrame:
    """The columns of the findings table, with the keys that order it in a repository."""
    badge = lookup("diff_status", {"new": "NEW", "worsened": "WORSENED"}, "")
    replacement = F.when(F.col("replacement") == "", "-").otherwise(F.col("replacement"))
    return with_diff_status(findings).select(
        "repo", lookup("quantum_risk", {r: i for i, r in enumerate(RISKS)}, len(RISKS))
        .alias("risk_ord"), report_key().alias("seq"),
        F.upper("severity").alias("severity"), badge.alias("badge"),
        F.col("quantum_risk").alias("risk"), F.col("algorithm_name").alias("algorithm"),
        _location().alias("file_line"), "source", F.upper("confidence").alias("confidence"),
        "context", replacement.alias("replacement"))


def sorted_listing(findings: DataFrame, folder: str | None = None) -> DataFrame:
    """The listing from the worst risk down, in scan order inside a risk (a range sort).

    The keys stay with the rows: ``risk_ord`` and those of the scan. With a
    ``folder`` that all executors reach, the findings are computed once, for the
    sample of the sort as well, and rows are numbered in a column ``seq_no``.
    """
    return _in_order(findings_listing(findings), ["repo", "risk_ord"], folder, "listing")


def sorted_advice(findings: DataFrame, folder: str | None = None) -> DataFrame:
    """Advice for the worst first, in scan order inside a degree; ``folder`` as for a listing."""
    return _in_order(advise(findings), ["repo", "advice_ord"], folder, "advice")


def _in_order(rows: DataFrame, by: list[str], folder: str | None, name: str) -> DataFrame:
    rows, by = rows.select("*", "seq.*").drop("seq"), [*by, *ORDER[3:]]
    return numbered(rows, by, folder, name) if folder else rows.orderBy(*by)


def advise(findings: DataFrame) -> DataFrame:
    """Advice for every finding that is not safe: ``repo, advice_ord, seq, message``."""
    what = F.concat(F.col("algorithm_name"), F.lit(" at "), _location())
    message = (
        F.when(F.col("quantum_risk") == "VULNERABLE", F.concat(
            F.lit("CRITICAL: "), what, F.lit(" has to go ("), F.col("reason"), F.lit("); use "),
            F.col("replacement")))
        .when(F.col("quantum_risk") == "PARTIAL", F.concat(
            F.lit("WARNING: "), what, F.lit(" is weak ("), F.col("reason"), F.lit("); think of "),
            F.col("replacement")))
        .otherwise(F.concat(F.lit("INFO: no entry for "), F.col("algorithm_id"),
                            F.lit(", found at "), _location())))
    order = lookup("quantum_risk", {"VULNERABLE": 0, "PARTIAL": 1, "UNKNOWN": 2}, 99)
    return findings.where(F.col("quantum_risk") != "SAFE").select(
        "repo", order.alias("advice_ord"), report_key().alias("seq"), message.alias("message"))


# --- documents ----------------------------------------------------------------


def _json(*fields: Column | str) -> Column:
    """JSON object that keeps null fields."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _compact(*fields: Column | str) -> Column:
    """JSON object without its null fields."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def _opened(json: Column, array_name: str) -> Column:
    """The object without its end, up to the start of one more array."""
    return F.concat(F.left(json, F.length(json) - 1), F.lit(f',"{array_name}":['))


def _piece(part: int, text: Column, item: Column | int = 0, sub: int = 0,
           key: str | None = None) -> list[Column]:
    """Columns of a piece; ``key`` names the struct with the finding's place, if it has one."""
    place = [F.col(f"{key}.{c}") if key else F.lit("" if c == "path_key" else 0)
             for c in ORDER[3:]]
    item = item if isinstance(item, Column) else F.lit(item)
    return [F.col("repo"), F.lit(part).alias("part"), item.cast("int").alias("item"),
            F.lit(sub).alias("sub"), *(p.alias(c) for p, c in zip(place, ORDER[3:])),
            text.alias("text")]


def _with_commas(elements: DataFrame, firsts: DataFrame) -> DataFrame:
    """A comma before every ``text`` but the first of its repository, by its place ``at``.

    ``firsts`` (repo, first_key) has a row per repository of the elements and comes
    from an aggregate that the document needs anyway. The join is a left one because
    Spark broadcasts no left side: from the size of compressed findings it takes
    their texts for small.
    """
    comma = F.when(F.col("at") == F.col("first_key"), "").otherwise(",")
    return elements.where("repo IS NOT NULL").join(firsts, "repo", "left").withColumn(
        "text", F.concat(comma, "text"))


def _of_repos(elements: DataFrame, repos: DataFrame) -> DataFrame:
    """The elements of the repositories that get a document."""
    return elements.join(repos.select("repo"), "repo", "left_semi")


def write_documents(pieces: DataFrame, path: str) -> None:
    """Write documents as text, a directory per repository, in key order by file name.

    Pieces end between JSON tokens, so the line end after each changes nothing.
    """
    ordered = pieces.repartitionByRange("repo", *ORDER).sortWithinPartitions("repo", *ORDER)
    ordered.select("repo", "text").write.partitionBy("repo").text(path)


def json_pieces(findings: DataFrame, file_counts: DataFrame, diff: DataFrame | None = None,
                duration: float = 0.0) -> DataFrame:
    """Pieces of the JSON report: summary, findings and, for a diff, its summary."""
    summary = readiness(findings, file_counts, F.min(place(findings)).alias("first_key"))
    head = _opened(_json(
        F.lit(VERSION).alias("version"), F.col("repo").alias("scan_path"), "total_files_scanned",
        F.lit(duration).alias("scan_duration_seconds"),
        F.struct("total_findings", "vulnerable", "partial", "safe", "quantum_ready_score")
        .alias("summary")), "findings")
    tails = file_counts.select("repo", F.lit("]}").alias("text"))
    if diff is not None:
        tails = diff_summary(diff, file_counts).select("repo", F.concat(
            F.lit('],"diff_summary":'), _json("new", "worsened", "resolved", "unchanged"),
            F.lit("}")).alias("text"))
    elements = with_diff_status(findings).select(
        "repo", report_key().alias("element_key"), place(findings).alias("at"),
        _json(F.col("path").alias("file_path"), *FINDING_FIELDS).alias("text"))
    body = _with_commas(_of_repos(elements, file_counts), summary.select("repo", "first_key"))
    return (summary.select(*_piece(0, head))
            .unionByName(body.select(*_piece(1, F.col("text"), key="element_key")))
            .unionByName(tails.select(*_piece(2, F.col("text")))))


def _rule_id() -> Column:
    return F.concat(F.lit(f"{TOOL}/"), F.col("algorithm_id"))


def _text(value: Column) -> Column:
    return F.struct(value.alias("text"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Columns of the SARIF results, one row per finding."""
    return with_diff_status(findings).select(
        "repo", report_key().alias("element_key"), place(findings).alias("at"), _rule_id().alias("rule_id"),
        sarif_level("severity").alias("level"),
        F.concat(F.lit("Uses "), F.col("algorithm_name"), F.lit(": "), F.col("reason"),
                 F.lit(". Instead: "), F.col("replacement")).alias("message"),
        F.col("path").alias("uri"), F.coalesce("line_number", F.lit(1)).alias("start_line"),
        "quantum_risk", "algorithm_type", "replacement", "confidence", "context", "severity",
        "category", "remediation", "diff_status")


def sarif_pieces(findings: DataFrame, repos: DataFrame, help_uri: str | None = None,
                 information_uri: str | None = None) -> DataFrame:
    """Pieces of a SARIF 2.1.0 log: head, rules, results and tail.

    ``help_uri`` is put into every rule and ``information_uri`` into the tool.
    """
    def uri(name: str, value: str | None) -> list[Column]:
        return [F.lit(value).alias(name)] if value else []

    ranked = F.row_number().over(Window.partitionBy("repo").orderBy("first_key")) - 1
    rules = sarif_rules(findings).withColumn("item", ranked)
    rule = _compact(
        _rule_id().alias("id"), F.lit("QuantumVulnerableCrypto").alias("name"),
        _text(F.concat_ws(": ", "algorithm_name", "reason")).alias("shortDescription"),
        _text(F.concat(F.lit("Risk "), F.col("quantum_risk"), F.lit(" for "),
                       F.col("algorithm_name"), F.lit(", type "), F.col("algorithm_type"),
                       F.lit(". Use "), F.col("replacement"))).alias("fullDescription"),
        F.struct(F.col("default_level").alias("level")).alias("defaultConfiguration"),
        *uri("helpUri", help_uri),
        F.struct(F.array(*map(F.lit, ("security", "cryptography", "quantum", "pqc"))).alias("tags"),
                 F.lit("medium").alias("precision")).alias("properties"))
    tool = _compact(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"),
                    *uri("informationUri", information_uri))
    head = F.concat(
        F.lit('{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/'
              'schema/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'),
        _opened(tool, "rules"))
    comma = F.when(F.col("item") == 0, "").otherwise(",")
    artifact = F.struct(F.col("uri").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    region = F.struct(F.col("start_line").alias("startLine"), F.lit(1).alias("startColumn"))
    location = F.struct(F.struct(artifact.alias("artifactLocation"), region.alias("region"))
                        .alias("physicalLocation"))
    result = _json(
        F.col("rule_id").alias("ruleId"), "level", _text(F.col("message")).alias("message"),
        F.array(location).alias("locations"),
        F.struct("quantum_risk", "algorithm_type", "replacement", "confidence", "context",
                 "severity", "category", "remediation", "diff_status").alias("properties"))
    body = _with_commas(
        sarif_results(findings).select("repo", "element_key", "at", result.alias("text")),
        rules.where("item = 0").select("repo", "first_key"))
    repos = repos.select("repo")
    return (repos.select(*_piece(0, head))
            .unionByName(rules.select(*_piece(1, F.concat(comma, rule), F.col("item"))))
            .unionByName(repos.select(*_piece(2, F.lit(']}},"results":['))))
            .unionByName(body.select(*_piece(3, F.col("text"), key="element_key")))
            .unionByName(repos.select(*_piece(4, F.lit("]}]}")))))


def cbom_pieces(findings: DataFrame, repos: DataFrame, timestamp: str,
                serial_number: Column) -> DataFrame:
    """Pieces of a CycloneDX 1.6 document: components, each with its occurrences.

    Time and serial number are given, so a document is reproducible.
    """
    tool = F.struct(F.lit("application").alias("type"), F.lit(TOOL).alias("name"),
                    F.lit(VERSION).alias("version"))
    metadata = F.struct(
        F.lit(timestamp).alias("timestamp"),
        F.struct(F.array(tool).alias("components")).alias("tools"),
        F.struct(F.lit("application").alias("type"), F.col("repo").alias("name"),
                 F.lit("scanned-project").alias("bom-ref")).alias("component"))
    heads = repos.select(*_piece(0, _opened(_compact(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"),
        F.lit(1).alias("version"), serial_number.alias("serialNumber"),
        metadata.alias("metadata")), "components")))

    components = cbom_components(findings)
    crypto = F.struct(
        F.col("asset_type").alias("assetType"), "oid",
        F.when(F.col("primitive").isNotNull(), F.struct("primitive"))
        .alias("algorithmProperties"))
    properties = F.array(*[
        F.struct(F.lit(f"{TOOL}:{name}").alias("name"),
                 F.coalesce(name, F.lit("")).alias("value"))
        for name in ("quantum_risk", "replacement", "source", "confidence", "context",
                     "severity", "category", "remediation")])
    component = _compact(
        F.lit("cryptographic-asset").alias("type"), F.col("algorithm_name").alias("name"),
        F.col("bom_ref").alias("bom-ref"), crypto.alias("cryptoProperties"),
        properties.alias("properties"))
    index = F.col("component_index")
    opening = F.concat(F.when(index == 0, "").otherwise(","),
                       F.left(component, F.length(component) - 1),
                       F.lit(',"evidence":{"occurrences":['))
    occurrence = _compact(
        F.col("path").alias("location"), F.coalesce("line_number", F.lit(1)).alias("line"),
        F.when(F.col("matched_text") != "", F.col("matched_text")).alias("additionalContext"))
    # The table of components has a row per repository and algorithm; its size
    # decides whether the join broadcasts it. A left join never broadcasts the findings.
    occurrences = findings.where("repo IS NOT NULL AND algorithm_id IS NOT NULL").select(
        "repo", "algorithm_id", report_key().alias("element_key"),
        place(findings).alias("at"), occurrence.alias("occurrence")).join(
        components.select("repo", "algorithm_id", "first_key", "component_index"),
        ["repo", "algorithm_id"], "left")
    comma = F.when(F.col("at") == F.col("first_key"), "").otherwise(",")
    return (heads
            .unionByName(components.select(*_piece(1, opening, index)))
            .unionByName(occurrences.select(*_piece(
                1, F.concat(comma, "occurrence"), index, 1, "element_key")))
            .unionByName(components.select(*_piece(1, F.lit("]}}"), index, 2)))
            .unionByName(repos.select(*_piece(2, F.lit("]}")))))


def baseline_pieces(findings: DataFrame, repos: DataFrame, generated_at: str,
                    commit: str | None = None) -> DataFrame:
    """Pieces of the baseline document of each repository, entries sorted by hash."""
    entries = baseline_entries(findings)
    counts = repos.select("repo").join(
        entries.groupBy("repo").agg(F.count("*").alias("findings_count"),
                                    F.min("hash").alias("first_hash")), "repo", "left"
    ).na.fill(0, ["findings_count"])
    head = _opened(_json(
        F.lit(BASELINE_VERSION).alias("baseline_version"), F.lit(VERSION).alias("tool_version"),
        F.lit(generated_at).alias("generated_at"),
        F.lit(commit).cast("string").alias("commit"), "findings_count"), "findings")
    entry = _json("hash", "file", "line", "algorithm", "risk", "severity", "source")
    comma = F.when(F.col("hash") == F.col("first_hash"), "").otherwise(",")
    body = _of_repos(entries, repos).join(counts.select("repo", "first_hash"), "repo", "left").select(
        "repo", F.concat(comma, entry).alias("text"),
        F.struct(F.lit(0).alias("source_ord"), F.col("hash").alias("path_key"),
                 F.lit(0).alias("ord_a"), F.lit(0).alias("ord_b")).alias("element_key"))
    return (counts.select(*_piece(0, head))
            .unionByName(body.select(*_piece(1, F.col("text"), key="element_key")))
            .unionByName(repos.select(*_piece(2, F.lit("]}")))))
