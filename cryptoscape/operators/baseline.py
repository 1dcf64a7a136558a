"""Baselines: stable hashes, snapshots, and the diff of a scan against one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cryptoscape.functions.scales import severity_index
from cryptoscape.functions.text import quote

BASELINE_VERSION = "1.0"
_ENTRY = ("hash:string,file:string,line:int,algorithm:string,risk:string,severity:string,"
          "source:string")
_DOCUMENT = (f"baseline_version string, tool_version string, generated_at string, commit string, "
             f"findings_count bigint, findings array<struct<{_ENTRY}>>, _corrupt string")
_REQUIRED = ("baseline_version", "tool_version", "generated_at", "findings_count", "findings")


def finding_hash() -> Column:
    """First 16 hex digits of the SHA-256 of path, line, algorithm and scanner."""
    line = F.coalesce(F.col("line_number").cast("string"), F.lit("None"))
    stable = F.concat_ws(":", "path", line, "algorithm_id", "source")
    return F.left(F.sha2(stable, 256), F.lit(16))


def baseline_entries(findings: DataFrame) -> DataFrame:
    """The rows of a baseline: ``repo`` and the seven fields of an entry."""
    return findings.select(
        "repo", finding_hash().alias("hash"), F.col("path").alias("file"),
        F.col("line_number").alias("line"), F.col("algorithm_id").alias("algorithm"),
        F.col("quantum_risk").alias("risk"), "severity", "source")


def load_baseline(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Entries of one baseline document, as other tools keep them; ``ord`` is the place in it.

    The document is read by one task; baselines of any size are kept as lines.

    A missing file, invalid JSON or a missing key is an error.
    """
    document = spark.read.schema(_DOCUMENT).json(
        path, multiLine=True, columnNameOfCorruptRecord="_corrupt")
    checked = document.where(F.assert_true(
        F.col("_corrupt").isNull(), F.lit("baseline is not a JSON object")).isNull())
    for key in _REQUIRED:
        checked = checked.where(F.assert_true(
            F.col(key).isNotNull(), F.lit(f"baseline misses the key {key}")).isNull())
    return checked.select(
        F.lit(repo).alias("repo"), F.posexplode("findings").alias("ord", "e")
    ).select("repo", "ord", "e.*")


def write_baseline(findings: DataFrame, repos: DataFrame, path: str, tool_version: str,
                   generated_at: str, commit: str | None = None) -> None:
    """Write the baselines of all repositories as JSON lines: a header for each, and its entries.

    Lines are spread over files; ``load_baselines`` reads them in parallel.
    """
    entries = baseline_entries(findings)
    heads = repos.select("repo").join(
        entries.groupBy("repo").agg(F.count("*").alias("findings_count")), "repo", "left"
    ).na.fill(0, ["findings_count"]).select(
        "repo", F.lit(BASELINE_VERSION).alias("baseline_version"),
        F.lit(tool_version).alias("tool_version"), F.lit(generated_at).alias("generated_at"),
        F.lit(commit).cast("string").alias("commit"), "findings_count")
    entries.unionByName(heads, allowMissingColumns=True).write.json(path)


def load_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of baselines that ``write_baseline`` wrote, read line by line.

    A repository without its header, with several, or with another number of
    entries than its header says is an error, as is a line that is no JSON.
    """
    schema = (_ENTRY.replace(":", " ") + ", repo string, baseline_version string, tool_version string, "
              "generated_at string, commit string, findings_count bigint, _corrupt string")
    lines = spark.read.schema(schema).json(path, columnNameOfCorruptRecord="_corrupt")
    lines = lines.where(F.assert_true(
        F.col("_corrupt").isNull(), F.lit("a baseline line is no JSON")).isNull())
    is_head = F.col("baseline_version").isNotNull() & F.col("generated_at").isNotNull()
    counts = lines.groupBy("repo").agg(
        F.count_if(is_head).alias("heads"), F.max("findings_count").alias("said"),
        F.count_if(F.col("hash").isNotNull()).alias("there"))
    good = (F.col("heads") == 1) & F.coalesce(F.col("said") == F.col("there"), F.lit(False))
    checked = counts.where(F.assert_true(good, F.concat(
        F.lit("incomplete baseline of "), "repo")).isNull()).select("repo")
    return lines.where(F.col("hash").isNotNull()).join(checked, "repo", "left_semi").select(
        "repo", "hash", "file", "line", "algorithm", "risk", "severity", "source")


def store_baseline(entries: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write baseline entries to ``path`` as table ``name``, bucketed and sorted by what a diff joins on.

    One shuffle here saves one of the whole baseline in every diff. Take as many buckets as the
    shuffle partitions of the diffs to come, or more: Spark shuffles both sides into partitions of its
    own number when there are fewer.
    """
    keys = ("repo", "hash")
    (entries.select("repo", "hash", "file", "line", "algorithm", "risk", "severity", "source")
     .repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name, format="parquet", mode="errorifexists"))
    return entries.sparkSession.table(name)


def open_baseline(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """The table that ``store_baseline`` wrote to ``path``, in a session whose catalogue lacks it.

    ``buckets`` is the number it was written with. A table of that name that lies elsewhere or has
    other buckets, or a path without a table, is an error.
    """
    columns = "repo STRING, " + _ENTRY.replace(":", " ").upper().replace(",", ", ")
    if not spark.catalog.tableExists(name):
        spark.read.parquet(path).select("repo", "hash")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (repo, hash) "
                  f"SORTED BY (repo, hash) INTO {int(buckets)} BUCKETS LOCATION {quote(path)}")
    detail = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    lies_at, wanted = (p.removeprefix("file:").strip("/") for p in (detail.get("Location", ""), path))
    if lies_at != wanted or detail.get("Num Buckets") != str(buckets):
        raise ValueError(f"table {name} is not the baseline of {buckets} buckets at {path}")
    return spark.table(name)


def diff_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Full outer join of findings and baseline entries on (repo, hash).

    ``diff_class`` is new, worsened, unchanged or resolved. Resolved rows bring
    their columns from the baseline. Of equal hashes in a baseline with ``ord``
    the last counts; one without ``ord`` has each hash once, as
    ``baseline_entries`` gives it.
    """
    entry = F.struct("file", "line", "algorithm", "risk",
                     F.coalesce("severity", F.lit("medium")).alias("severity"), "source")
    if "ord" in baseline.columns:
        before = baseline.groupBy("repo", "hash").agg(F.max_by(entry, "ord").alias("b"))
    else:
        before = baseline.select("repo", "hash", entry.alias("b"))
    now = current.drop("diff_status").withColumn("hash", finding_hash())
    joined = now.withColumn("in_scan", F.lit(True)).join(before, ["repo", "hash"], "full_outer")
    worse = severity_index("severity") < severity_index("b.severity")
    diff_class = (F.when(F.col("in_scan").isNull(), "resolved")
                  .when(F.col("b").isNull(), "new")
                  .when(worse, "worsened").otherwise("unchanged"))
    from_baseline = {"path": "file", "line_number": "line", "algorithm_id": "algorithm",
                     "quantum_risk": "risk", "severity": "severity", "source": "source"}
    classed = joined.withColumn("diff_class", diff_class)
    for name, field in from_baseline.items():
        classed = classed.withColumn(name, F.when(
            F.col("diff_class") == "resolved", F.col(f"b.{field}")).otherwise(F.col(name)))
    status = F.when(F.col("diff_class").isin("new", "worsened"), F.col("diff_class"))
    return classed.withColumn("diff_status", status).drop("b", "in_scan")


def resolved(diff: DataFrame) -> DataFrame:
    """Baseline entries that the scan no longer finds."""
    return diff.where(F.col("diff_class") == "resolved").select(
        "repo", "hash", F.col("path").alias("file"), F.col("line_number").alias("line"),
        F.col("algorithm_id").alias("algorithm"), F.col("quantum_risk").alias("risk"),
        "severity", "source")


def reported(diff: DataFrame) -> DataFrame:
    """The findings a diff reports: new and worsened ones."""
    return diff.where(F.col("diff_class").isin("new", "worsened"))


def diff_summary(diff: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Counts of the four classes per repository, and whether there is new debt.

    ``repos`` lists all repositories; one without findings on either side counts zeros.
    """
    names = ["new", "worsened", "resolved", "unchanged"]
    counts = diff.groupBy("repo").agg(*[F.count_if(F.col("diff_class") == c).alias(c) for c in names])
    if repos is not None:
        counts = repos.select("repo").join(counts, "repo", "left").na.fill(0, names)
    return counts.withColumn("has_new_debt", F.col("new") + F.col("worsened") > 0)
