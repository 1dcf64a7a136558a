"""Catalogue tables of the registered checks, made from the given tables.

Parts stand for algorithms and order lines for libraries that expose parts, so
the checks have work that grows with the data and rows that fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cryptoscape.plans.corpus import table


def part_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts in the shape of an algorithm catalogue."""
    size = F.col("p_size")
    kind = F.when(size % 7 == 0, "asymmetric").when(size % 7 == 1, "hash").when(
        size % 7 == 2, "gadget").otherwise("symmetric")
    risk = F.when(size % 3 == 0, "VULNERABLE").when(size % 3 == 1, "SAFE").otherwise("DOUBTFUL")
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("algorithm_id"),
        F.col("p_name").alias("name"), kind.alias("type"), risk.alias("quantum_risk"),
        F.col("p_brand").alias("reason"), F.col("p_name").alias("replacement"),
        F.when(size % 5 != 0, "hash").alias("category"), F.col("p_type").alias("remediation"),
        F.when(size == 9, F.array().cast("array<string>")).when(
            size == 8, F.array(F.col("p_brand"), F.lit("  "))).otherwise(
            F.concat(words, F.array(F.lower("p_type"), F.get(words, size % 2)))).alias("patterns"),
        F.create_map(F.when(size % 4 == 0, "cnsa").when(size % 4 == 1, "nist").otherwise("other"),
                     F.array("p_brand")).alias("references"),
        F.create_map(F.lit("eu_high_risk"), F.lit("2030-12-31"),
                     F.when(size % 2 == 0, "eu_full_transition").otherwise("none"),
                     F.lit("2035-12-31")).alias("deadlines"))


def line_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines in the shape of a library catalogue."""
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    exposed = F.when(flag == "N", F.array(part, part + F.col("l_suppkey"))).otherwise(
        F.slice(F.array(part), 1, F.col("l_linenumber") - 1))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.lit("L"), "l_orderkey", "l_linenumber").alias("library_id"),
        F.when(flag == "A", "python").when(flag == "N", "npm").otherwise("cobol")
        .alias("ecosystem"),
        F.when(F.col("l_linenumber") != 3, flag).otherwise("").alias("package_name"),
        F.col("l_linestatus").alias("description"),
        F.transform(exposed, lambda p: F.concat(F.lit("P"), p)).alias("exposes"),
        F.when(F.col("l_linestatus") == "O", "SAFE").otherwise("DOUBTFUL").alias("default_risk"))
