"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each runs an operator over whole given tables, or over the planted corpus that
Spark makes from them.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cryptoscape.functions import text as tx
from cryptoscape.functions.storage import scratch_folder
from cryptoscape.operators import baseline as bl
from cryptoscape.operators import classify as cl
from cryptoscape.operators import files as fl
from cryptoscape.operators import policy as po
from cryptoscape.operators import quality as qc
from cryptoscape.operators import reports as rp
from cryptoscape.operators import summary as sm
from cryptoscape.operators.manifests import extract_packages
from cryptoscape.operators.scan import scan_config, scan_dependencies, scan_files, scan_source
from cryptoscape.plans.catalogues import line_libraries, part_algorithms
from cryptoscape.plans.corpus import planted, prose, table
from cryptoscape.plans.inventory import inventory, materialize, stored_inventory
from cryptoscape.sources.catalogue import algorithms_from_dict, exposed_rows, pattern_rows
from cryptoscape.sources.large_tree import cut_files, list_tree, read_listed, write_tree

AS_OF = dt.date(2026, 6, 30)
SMALL_FILE = 4_000
SMALL_CHUNK = 1_000

POLICY = {
    "version": "1",
    "ignore": {"paths": ["**/test_*", "docs/*", "app/svc?[0-5]/*", "[!a-v]eb/*"],
               "algorithms": ["md5", "Camellia-256"]},
    "allow": [
        {"algorithm": "rsa", "paths": ["legacy/auth/**", "pkg/*.java"], "reason": "planned",
         "expires": "2026-09-30"},
        {"algorithm": "ECDSA", "paths": ["*"], "reason": "over", "expires": "2026-01-31"},
        {"algorithm": "AES-128", "paths": ["src/*"], "reason": "for good"},
        {"algorithm": "DH", "reason": "no path, so it never applies"},
    ],
    "fail": {"on_severity": "critical", "max_new_findings": 40},
    "severity_overrides": [
        {"algorithm": "SHA-1", "severity": "low", "reason": "first"},
        {"algorithm": "sha-1", "severity": "critical", "reason": "last"},
        {"algorithm": "SHA-256", "severity": "medium", "reason": "a safe one"},
    ],
}
# Repositories with a policy of their own; the others have none.
REPO_POLICIES = {
    "src1": POLICY,
    "src2": {"version": "1", "ignore": {"algorithms": ["RSA"]}, "fail": {"on_severity": "info"}},
    "src3": {"version": "1", "fail": {"on_severity": "critical", "max_new_findings": 1}},
}

# A catalogue of the user's own, for prose: words, a free separator, a regex.
PROSE_CATALOGUE = {
    "LICENSE": {"patterns": ["GNU General Public License", "licen[sc]e"], "type": "hash"},
    "TOKEN": {"patterns": ["api-key", "token", "secret_key"], "type": "mac"},
    "LINK": {"patterns": ["href.*example", "https?://[a-z.]+"], "type": "protocol"},
    "THE": {"patterns": ["the", "les", "(?P<broken"], "type": "kdf"},
}


def prose_catalogue() -> dict:
    return algorithms_from_dict({
        name: {"name": name.title(), "quantum_risk": "PARTIAL", "reason": "r",
               "replacement": "none", **entry} for name, entry in PROSE_CATALOGUE.items()})


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(table(spark, sf_dir, "documents"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(corpus(spark, sf_dir))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline entries of an earlier state: other French files, German ones at
    other places, and two algorithms that were rated lower."""
    files = planted(table(spark, sf_dir, "documents"),
                    F.when(F.col("lang") == "fr", 1).otherwise(0),
                    F.when(F.col("lang") == "de", 1).otherwise(0))
    entries = bl.baseline_entries(inventory(files))
    lower = F.when(F.col("algorithm").isin("MD5", "RSA"), "low").otherwise(F.col("severity"))
    return entries.withColumn("severity", lower)


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.diff_findings(findings(spark, sf_dir), snapshot(spark, sf_dir))


_ROW = ("repo", "path", "line_number", "matched_text", "algorithm_id", "line_text")


def _files(select: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: select(corpus(spark, sf_dir)).select(
        "repo", "path", F.col("size").cast("bigint").alias("size"))


def file_classes(spark, sf_dir):
    files = tx.bind_row(corpus(spark, sf_dir).select("repo", "path"), "suffix",
                        fl.paths.file_suffix(F.col("path")))
    return files.select("repo", "path", "suffix",
                        fl.class_mask(list(fl.CLASS_FILES), "suffix").alias("mask"),
                        fl.manifest_kind().alias("manifest"))


def tree_files(spark, sf_dir):
    """The corpus written as a tree to the shared folder, listed and read again."""
    folder = scratch_folder(spark)
    root = f"{folder.rstrip('/')}/tree-{uuid.uuid4().hex}"
    write_tree(corpus(spark, sf_dir), root)
    files = read_listed(list_tree(spark, root, folder), folder, chunk_bytes=None)
    return fl.select_files(files).select("repo", "path", "size")


def stored_dependencies(spark, sf_dir):
    """The dependency findings of the corpus stored by file class, of which only manifests are read."""
    path = f"{scratch_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    return scan_dependencies(fl.store_corpus(corpus(spark, sf_dir), path)).select(
        *_ROW, "ord_a", "ord_b")


def stripped_lines(spark, sf_dir):
    return fl.file_lines(prose(spark, sf_dir)).select(
        "repo", "path", "line_number", F.expr(tx.strip("line")).alias("line_text"))


def relative_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", fl.relative_path(F.col("url"), "https://m.ththth.example.net/").alias("path"))


def custom_catalogue(spark, sf_dir):
    return scan_source(prose(spark, sf_dir), prose_catalogue()).select(*_ROW)


def scan_counts(spark, sf_dir):
    return scan_files(corpus(spark, sf_dir)).groupBy("repo", "source", "algorithm_id").agg(
        F.count("*").alias("n"))


def classified_prose(spark, sf_dir):
    """Findings whose algorithms the bundled catalogue does not have."""
    found = scan_source(prose(spark, sf_dir), prose_catalogue())
    assessed = cl.enrich_severity(cl.enrich_findings(cl.classify(found)))
    return assessed.select(*_ROW[:3], "algorithm_id", "algorithm_name", "algorithm_type",
                           "quantum_risk", "reason", "replacement", "severity", "category")


def sarif_levels(spark, sf_dir):
    return findings(spark, sf_dir).groupBy(
        "repo", "severity", cl.sarif_level("severity").alias("level")).agg(
        F.count("*").alias("n"))


def _policy() -> po.Policy:
    return po.policy_from_dict(POLICY)


def _with_policy(keep):
    def run(spark, sf_dir):
        return keep(po.with_policy(findings(spark, sf_dir), _policy())).select(
            "repo", "path", "line_number", "algorithm_id", "source", "severity")
    return run


def repo_policies(spark: SparkSession) -> DataFrame:
    return po.policies_df(spark, {r: po.policy_from_dict(p) for r, p in REPO_POLICIES.items()})


def policy_per_repo(spark, sf_dir):
    return po.apply_policy(findings(spark, sf_dir), repo_policies(spark), AS_OF).select(
        "repo", "path", "line_number", "algorithm_id", "source", "severity")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.count_files(corpus(spark, sf_dir))


def fail_gate(spark, sf_dir):
    kept = po.apply_policy(findings(spark, sf_dir), repo_policies(spark), AS_OF)
    return po.check_fail_conditions(kept, repo_policies(spark),
                                    repos=repositories(spark, sf_dir))


def diff_gate(spark, sf_dir):
    return po.check_fail_conditions(
        bl.reported(diff(spark, sf_dir)), repo_policies(spark), diff_mode=True,
        repos=repositories(spark, sf_dir))


def diff_rows(spark, sf_dir):
    return diff(spark, sf_dir).select(
        "repo", "hash", "path", "line_number", "algorithm_id", "quantum_risk", "severity",
        "source", "diff_class", "diff_status")


def diff_reported(spark, sf_dir):
    return bl.reported(diff(spark, sf_dir)).select(
        "repo", "path", "line_number", "algorithm_id", "source", "severity", "diff_status")


def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in scan order with their numbers; the corpus is scanned once."""
    return stored_inventory(findings(spark, sf_dir), scratch_folder(spark))


def load_baselines(spark, sf_dir):
    """The findings as baselines, written as lines to the shared folder and read back."""
    folder = scratch_folder(spark)
    path, found = f"{folder}/baselines-{uuid.uuid4().hex}", materialize(findings(spark, sf_dir), folder, "findings")
    bl.write_baseline(found, repositories(spark, sf_dir), path, rp.VERSION, DAY)
    return bl.load_baselines(spark, path)


def stored_diff(spark, sf_dir):
    """The diff against a baseline that is kept as a bucketed table in the shared folder."""
    name = f"baseline_{uuid.uuid4().hex}"
    before = bl.store_baseline(snapshot(spark, sf_dir), name, f"{scratch_folder(spark)}/{name}",
                               int(spark.conf.get("spark.sql.shuffle.partitions")))
    return bl.diff_summary(bl.diff_findings(findings(spark, sf_dir), before),
                           repositories(spark, sf_dir))


def readiness(spark, sf_dir):
    files = corpus(spark, sf_dir)
    return sm.readiness(inventory(files), fl.count_files(files))


def sarif_rules(spark, sf_dir):
    return sm.sarif_rules(ordered_findings(spark, sf_dir)).select(
        "repo", "algorithm_id", "algorithm_name", "quantum_risk", "reason", "replacement",
        "default_level")


def cbom_components(spark, sf_dir):
    return sm.cbom_components(ordered_findings(spark, sf_dir)).drop("first_key")


def json_rows(spark, sf_dir):
    return rp.with_diff_status(findings(spark, sf_dir)).select(
        "repo", F.col("path").alias("file_path"), *rp.FINDING_FIELDS)


def sarif_results(spark, sf_dir):
    return rp.sarif_results(findings(spark, sf_dir)).drop("element_key", "at")


def listing(spark, sf_dir):
    return rp.sorted_listing(findings(spark, sf_dir), scratch_folder(spark))


def diff_listing(spark, sf_dir):
    return rp.sorted_listing(bl.reported(diff(spark, sf_dir)), scratch_folder(spark))


def advice(spark, sf_dir):
    return rp.sorted_advice(findings(spark, sf_dir), scratch_folder(spark))


DAY = "2026-06-30T00:00:00+00:00"


def json_documents(spark, sf_dir):
    return rp.json_pieces(ordered_findings(spark, sf_dir), repositories(spark, sf_dir))


def json_diff_documents(spark, sf_dir):
    found = materialize(diff(spark, sf_dir), scratch_folder(spark), "diff")
    return rp.json_pieces(bl.reported(found), repositories(spark, sf_dir), found)


def sarif_documents(spark, sf_dir):
    return rp.sarif_pieces(ordered_findings(spark, sf_dir), repositories(spark, sf_dir))


def sarif_diff_results(spark, sf_dir):
    return rp.sarif_results(bl.reported(diff(spark, sf_dir))).drop("element_key", "at")


def cbom_documents(spark, sf_dir):
    serial = F.concat(F.lit("urn:uuid:"), F.md5("repo"))
    return rp.cbom_pieces(ordered_findings(spark, sf_dir), repositories(spark, sf_dir), DAY, serial)


def baseline_documents(spark, sf_dir):
    found = materialize(findings(spark, sf_dir), scratch_folder(spark), "findings")
    return rp.baseline_pieces(found, repositories(spark, sf_dir), DAY)


def decoded(spark, sf_dir):
    """The whole text of every file."""
    files = corpus(spark, sf_dir)
    return files.select("repo", "path", tx.decode(
        F.col("content"), files.schema["content"].dataType).alias("text"))


def _on_parts(check):
    return lambda spark, sf_dir: check(part_algorithms(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src1_fil1_select_files": _files(fl.select_files),
    "src1_tree_round_trip": tree_files,
    "fil3_size_filter": _files(lambda files: fl.select_files(files, max_bytes=SMALL_FILE)),
    "fil4_text_files": _files(lambda files: fl.select_text_files(
        files, probe_bytes=fl.paths.PROBE_BYTES)),
    "prj1_decode": decoded,
    "fil5_manifests": _files(fl.select_manifests),
    "fil6_config_files": _files(fl.select_config_files),
    "fil7_file_classes": file_classes,
    "prj2_lines": lambda spark, sf_dir: fl.file_lines(corpus(spark, sf_dir)),
    "prj3_stripped_lines": stripped_lines,
    "prj4_relative_path": relative_urls,
    "agg0_files_scanned": lambda spark, sf_dir: fl.count_files(corpus(spark, sf_dir)),
    "scn1_scan_source": lambda spark, sf_dir: scan_source(corpus(spark, sf_dir)).select(*_ROW),
    "scn1_scan_chunks": lambda spark, sf_dir: scan_source(
        cut_files(corpus(spark, sf_dir), SMALL_CHUNK)).select(*_ROW),
    "scn1_custom_catalogue": custom_catalogue,
    "cfg_scan_config": lambda spark, sf_dir: scan_config(corpus(spark, sf_dir)).select(*_ROW),
    "dep1_extract_packages": lambda spark, sf_dir: extract_packages(corpus(spark, sf_dir)),
    "dep9_scan_dependencies": lambda spark, sf_dir: scan_dependencies(
        corpus(spark, sf_dir)).select(*_ROW, "ord_a", "ord_b"),
    "fil7_stored_dependencies": stored_dependencies,
    "uni1_scan_counts": scan_counts,
    "cls1_unknown_algorithms": classified_prose,
    "sev3_sarif_levels": sarif_levels,
    "rpt1_json_findings": json_rows,
    "pol1_severity_overrides": lambda spark, sf_dir: po.apply_severity_overrides(
        findings(spark, sf_dir), _policy()).select(
        "repo", "path", "line_number", "algorithm_id", "source", "severity"),
    "pol2_ignore_paths": _with_policy(lambda df: df.where(~po.should_ignore_path())),
    "pol3_pol4_ignore_findings": _with_policy(
        lambda df: df.where(~po.should_ignore_finding(AS_OF))),
    "pol_policy_per_repo": policy_per_repo,
    "pol5_fail_gate": fail_gate,
    "bas_baseline_entries": lambda spark, sf_dir: bl.baseline_entries(findings(spark, sf_dir)),
    "src5_load_baselines": load_baselines,
    "dif1_diff_findings": diff_rows,
    "dif2_resolved": lambda spark, sf_dir: bl.resolved(diff(spark, sf_dir)),
    "dif3_diff_summary": lambda spark, sf_dir: bl.diff_summary(
        diff(spark, sf_dir), repositories(spark, sf_dir)),
    "dif3_stored_baseline": stored_diff,
    "dif5_reported": diff_reported,
    "pol5_diff_gate": diff_gate,
    "agg1_agg2_readiness": readiness,
    "agg4_sarif_rules": sarif_rules,
    "agg5_cbom_components": cbom_components,
    "rpt2_sarif_results": sarif_results,
    "srt1_findings_listing": listing,
    "adv1_advice": advice,
    "srt1_diff_listing": diff_listing,
    "rpt2_diff_results": sarif_diff_results,
    "rpt1_diff_documents": json_diff_documents,
    "rpt1_json_documents": json_documents,
    "rpt2_sarif_documents": sarif_documents,
    "rpt3_cbom_documents": cbom_documents,
    "bas2_baseline_documents": baseline_documents,
    "src3_exposed_algorithms": lambda spark, sf_dir: exposed_rows(line_libraries(spark, sf_dir)),
    "src4_all_patterns": _on_parts(pattern_rows),
    "qc1_unknown_exposed": lambda spark, sf_dir: qc.unknown_exposed(
        line_libraries(spark, sf_dir), part_algorithms(spark, sf_dir)),
    "qc2_repeated_patterns": _on_parts(qc.repeated_patterns),
    "qc2_blank_patterns": _on_parts(qc.blank_patterns),
    "qc3_algorithm_problems": _on_parts(qc.algorithm_problems),
    "qc3_library_problems": lambda spark, sf_dir: qc.library_problems(
        line_libraries(spark, sf_dir)),
    "qc4_reference_problems": _on_parts(qc.reference_problems),
}
