"""Helpers that several operators share: tables, whole texts in Arrow batches, stored intermediates."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes (a single text may have more) and rows that a Python worker treats at once.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text between runs of white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed once: a generator keeps later steps from repeating them."""
    fields = F.struct(*(v.alias(k) for k, v in values.items()))
    return df.select("*", F.inline(F.array(fields)))


def pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to BATCH_ROWS rows and, by the binary ``column``, about ``most`` bytes."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < whole.num_rows:
            before = ends[start - 1] if start else 0
            end = int(np.searchsorted(ends, before + most, "right"))
            end = min(max(end, start + 1), start + BATCH_ROWS)
            yield whole.slice(start, end - start)
            start = end


def map_texts(rows: DataFrame, text: str, keep: Iterable[str],
              work: Callable[[list[bytes]], list[list]], fields: str) -> DataFrame:
    """Apply ``work`` to the UTF-8 bytes of whole texts, batch by batch, without a shuffle.

    ``rows`` may have any other columns; those in ``keep`` go along. ``work`` gets the texts of
    a batch (null: empty) and returns one list per name in ``fields``, a DDL schema.
    """
    spark, keep = rows.sparkSession, list(keep)
    small = rows.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    kept = small.drop("_text").schema
    schema = kept
    for f in spark.createDataFrame([], fields).schema:
        schema = schema.add(f)
    from pyspark.sql.pandas.types import to_arrow_schema
    types = list(to_arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(keep)):
            made = work(batch.column(len(keep)).to_pylist())
            columns = [batch.column(i).cast(types[i].type) for i in range(len(keep))]
            columns += [pa.array(m, t.type) for m, t in zip(made, types[len(keep):])]
            yield pa.RecordBatch.from_arrays(columns, names=[t.name for t in types])

    return small.mapInArrow(run, schema)


def map_batches(rows: DataFrame, work: Callable[[Iterator[list[list]]], Iterator[list[list]]], fields: str,
                keep: Iterable[str] = ()) -> DataFrame:
    """Apply ``work`` to the rows of each partition: iterators of lists of columns go in and come out.

    Without ``keep``, a DDL schema of what comes out is all there is to say. With it, ``work`` must give a row
    per row, batch by batch; the columns named go along and are left out of what ``work`` sees.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    keep = list(keep)
    rows = rows.select(*(c for c in rows.columns if c not in keep), *keep)
    schema = rows.sparkSession.createDataFrame([], fields).schema
    for name in keep:
        schema = schema.add(rows.schema[name])
    types, seen = list(to_arrow_schema(schema)), len(rows.columns) - len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        along: list[list] = []

        def columns() -> Iterator[list[list]]:
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH_ROWS):
                    batch = whole.slice(at, BATCH_ROWS)
                    along.append([batch.column(seen + i).cast(types[len(types) - len(keep) + i].type)
                                  for i in range(len(keep))])
                    yield [batch.column(i).to_pylist() for i in range(seen)]

        for made in work(columns()):
            arrays = [pa.array(list(m), t.type) for m, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(arrays + (along.pop(0) if keep else []), names=[t.name for t in types])

    return rows.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches.

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile
        top = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{re.sub(r'[^a-z0-9_]+', '-', name.lower())}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
