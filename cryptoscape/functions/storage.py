"""Tables that are written once to a shared folder, and the numbering of sorted rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A row id of Spark holds the partition above this bit and the row in it below.
_ROW_BITS = 33


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate tables (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile
    return tempfile.mkdtemp(prefix="cryptoscape-")


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table that several branches read to ``folder``, which all executors reach.

    A lost executor then costs no rescan, columns are pruned, and the size is
    known to the optimizer.
    """
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: Sequence[Column | str], folder: str, name: str,
             column: str = "seq_no") -> DataFrame:
    """``df`` in the order ``by``, with the number of each row from 1 in a last column.

    What ``df`` is made of is computed once: the sample for the ranges and the
    sort read the written rows. The sorted rows are written once more with their
    place, and numbers follow from one count per partition, so no task sees more
    than its range. Rows that tie get different numbers.
    """
    once = materialize(df, folder, name)
    ordered = once.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "_place", F.monotonically_increasing_id())
    ordered = materialize(ordered, folder, f"{name}-ordered")
    part = F.shiftright("_place", _ROW_BITS)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # one row per partition
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    row = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return ordered.join(F.broadcast(counts), part == F.col("_part")).select(
        *df.columns, (F.col("_ahead") + row + 1).alias(column))
