"""Operators on the corpus table ``files(repo, path, content, size)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cryptoscape.functions import paths, text

# Dependency manifests, matched by exact name.
MANIFESTS = ("requirements.txt", "Pipfile", "pyproject.toml", "package.json", "go.mod",
             "Cargo.toml", "pom.xml", "build.gradle")

# Configuration files matched by exact name or by suffix.
CONFIG_NAMES = ("nginx.conf", "httpd.conf", "apache2.conf", "haproxy.cfg", "Caddyfile",
                "sshd_config", "ssh_config", "openssl.cnf", "settings.py",
                "docker-compose.yml", "docker-compose.yaml")
CONFIG_FILE_SUFFIXES = (".conf", ".cfg", ".cnf", ".ini", ".pub", ".pem", ".crt", ".key",
                        ".json", ".yaml", ".yml")

# File classes that patterns apply to, by suffix or by exact name.
CLASS_FILES = {
    "source": paths.SOURCE_SUFFIXES,
    "tls": (".conf", ".cfg", ".cnf", ".ini", ".yaml", ".yml", ".json"),
    "ssh_key": (".pub",),
    "ssh_daemon": ("sshd_config", "ssh_config"),
    "jwt": (".json", ".yaml", ".yml"),
    "openssl": (".cnf",),
    "pem": (".pem", ".crt", ".key"),
    "env": (),  # .env and .env.*
}
CLASS_BIT = {name: 1 << i for i, name in enumerate([*CLASS_FILES, "manifest"])}


def with_size(files: DataFrame) -> DataFrame:
    """Add ``size`` in bytes where the corpus does not bring it."""
    if "size" in files.columns:
        return files
    return files.withColumn("size", F.octet_length("content").cast("bigint"))


def small_enough(max_bytes: int | None) -> Column:
    """The size filter; without a limit every file passes."""
    return F.lit(True) if max_bytes is None else F.col("size") <= max_bytes


def in_class(name: str, suffix: str) -> str:
    """SQL: does the file at ``path`` belong to a file class (suffix or name only)?"""
    file_name = "substring_index(path, '/', -1)"
    if name == "env":
        return f"({file_name} = '.env' OR startswith({file_name}, '.env.'))"
    tests = [f"{suffix if m.startswith('.') else file_name} = {text.quote(m)}"
             for m in CLASS_FILES[name]]
    return "(" + " OR ".join(tests) + ")"


def class_mask(classes: list[str], suffix: str) -> Column:
    """Bit mask of the file classes of a file, excluded directories considered."""
    def bits(names: list[str]) -> Column:
        return F.expr(" | ".join(
            ["0", *(f"CASE WHEN {in_class(n, suffix)} THEN {CLASS_BIT[n]} ELSE 0 END"
                    for n in names)]))

    source = [c for c in classes if c == "source"]
    config = [c for c in classes if c != "source"]
    return F.when(paths.in_excluded_parent(F.col("path")), F.lit(0)).otherwise(
        bits(config).bitwiseOR(F.when(
            paths.in_excluded_dir(F.col("path")), F.lit(0)).otherwise(bits(source))))


def store_corpus(files: DataFrame, path: str) -> DataFrame:
    """Write ``repo, path, content, size`` as Parquet partitioned by ``file_classes``, without a shuffle.

    Scans of it open only the partitions whose classes they look at. Rows without a path belong to
    no class.
    """
    named = text.bind_row(with_size(files).select("repo", "path", "content", "size"), "suffix",
                          paths.file_suffix(F.col("path")))
    classes = class_mask(list(CLASS_FILES), "suffix").bitwiseOR(
        F.when(manifest_kind().isNotNull(), CLASS_BIT["manifest"]).otherwise(0))
    kept = named.withColumn("file_classes", F.coalesce(classes, F.lit(0)).cast("int")).drop("suffix")
    kept.write.partitionBy("file_classes").parquet(path)
    return files.sparkSession.read.schema(kept.schema).parquet(path)


def of_classes(files: DataFrame, classes: list[str]) -> DataFrame:
    """The files of some classes where the corpus is stored by class; else all files."""
    if "file_classes" not in files.columns:
        return files
    bits = sum(CLASS_BIT[c] for c in classes)
    return files.where(F.col("file_classes").bitwiseAND(bits) != 0)


def manifest_kind() -> Column:
    """The manifest name of a file, null for any other file."""
    name = paths.file_name(F.col("path"))
    return F.when(name.isin(*MANIFESTS) & ~paths.in_excluded_dir(F.col("path")), name)


def select_files(files: DataFrame, suffixes: tuple[str, ...] | None = None,
                 max_bytes: int | None = None) -> DataFrame:
    """Files worth a scan: known suffix, no excluded directory, at most ``max_bytes``."""
    wanted = suffixes or paths.SOURCE_SUFFIXES + paths.CONFIG_SUFFIXES
    return with_size(files).where(
        paths.file_suffix(F.col("path")).isin(*wanted)
        & ~paths.in_excluded_dir(F.col("path")) & small_enough(max_bytes))


def select_text_files(files: DataFrame, max_bytes: int | None = None,
                      probe_bytes: int | None = None) -> DataFrame:
    """Source files that are not binary."""
    dtype = files.schema["content"].dataType
    return select_files(files, paths.SOURCE_SUFFIXES, max_bytes).where(
        ~text.is_binary(F.col("content"), dtype, probe_bytes))


def select_manifests(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    return with_size(of_classes(files, ["manifest"])).where(
        manifest_kind().isNotNull() & small_enough(max_bytes))


def select_config_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Configuration files; a file named like an excluded directory (``.env``) counts."""
    name, suffix = paths.file_name(F.col("path")), paths.file_suffix(F.col("path"))
    wanted = (name.isin(*CONFIG_NAMES) | paths.is_env_file(name)
              | suffix.isin(*CONFIG_FILE_SUFFIXES))
    return with_size(files).where(
        wanted & ~paths.in_excluded_parent(F.col("path")) & small_enough(max_bytes))


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``repo, path, line_number, line``."""
    dtype = files.schema["content"].dataType
    decoded = files.select("repo", "path", text.decode(F.col("content"), dtype).alias("text"))
    lines = F.posexplode(F.expr(text.split_lines("text"))).alias("pos", "line")
    return decoded.select("repo", "path", lines).select(
        "repo", "path", (F.col("pos") + 1).alias("line_number"), "line")


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``; a path elsewhere stays as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def count_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files that a scan looks at, per repository; a repository without any counts 0."""
    sized = files if max_bytes is None else with_size(files)
    counted = sized.select(
        "repo",
        (paths.file_suffix(F.col("path")).isin(*paths.SOURCE_SUFFIXES, *paths.CONFIG_SUFFIXES)
         & ~paths.in_excluded_dir(F.col("path")) & small_enough(max_bytes)).alias("scanned"))
    return counted.groupBy("repo").agg(F.count_if("scanned").alias("total_files_scanned"))
