"""Trees of any size on any store as the corpus table: listed in rounds, read in even tasks.

``list_tree`` lists directories as Spark tasks that hand on what they have not reached; the driver
lists nothing. ``read_listed`` deals files to tasks by bytes and cuts large ones into chunks at line
ends, so neither a task nor a row holds more than its share. ``scan_files`` puts chunks together by
line number. Paths may be URIs of any store that pyarrow opens (``file``, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import io
import os
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cryptoscape.functions import paths
from cryptoscape.functions.storage import materialize
from cryptoscape.operators.files import MANIFESTS, with_size
from cryptoscape.sources.file_tree import is_excluded, matters

#: Directories that a task lists below one before it hands the rest on.
DIRECTORIES_PER_ROUND = 1_000
#: Bytes of a task, and of a chunk of a file.
TASK_BYTES, CHUNK_BYTES = 128 << 20, 32 << 20
#: What opening a file costs, in bytes of reading.
OPEN_BYTES = 64 << 10

_ENTRIES = "repo string, root string, path string, size bigint, is_file boolean"
_CONTENT = "repo string, path string, content binary, size bigint, chunk_start bigint"
_BATCH_BYTES = 16 << 20


def list_tree(spark: SparkSession, path: str, folder: str, repo: str | None = None,
              suffixes: Iterable[str] = (), max_bytes: int | None = None,
              directories_per_round: int = DIRECTORIES_PER_ROUND) -> DataFrame:
    """Files below ``path`` as ``repo, root, path, size``.

    Every directory of ``path`` is a repository, or all of it is ``repo``. Names and suffixes are
    chosen as by the source ``repo_tree``; excluded directories and links are not entered. A missing
    path, or one without a directory, gives no row. Rounds are written to ``folder``, which all
    executors reach; their number is the tree's depth or its directories over
    ``directories_per_round``, whichever is less.
    """
    chosen = frozenset(s.lower() for s in suffixes)

    def extended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _entry_batches(_entries(row, chosen, directories_per_round))

    # The path "" of a null repository is the root above repositories.
    frontier = spark.createDataFrame([(repo, path, "", None, False)], _ENTRIES)
    files = None
    while True:
        tasks = max(1, spark.sparkContext.defaultParallelism)
        found = materialize(frontier.repartition(tasks).mapInArrow(extended, _ENTRIES), folder, "tree")
        small = F.lit(True) if max_bytes is None else F.col("size") <= max_bytes
        listed = found.where(F.col("is_file") & small).select("repo", "root", "path", "size")
        files = listed if files is None else files.unionByName(listed)
        frontier = found.where(~F.col("is_file"))
        if frontier.isEmpty():
            return files


def _entries(seed: dict, suffixes: frozenset[str], most: int) -> Iterator[tuple]:
    """Files of up to ``most`` directories from the seed on, breadth first, and directories not reached."""
    store, top = _open(seed["root"])
    waiting = deque([(seed["repo"], seed["root"], seed["path"])])
    for _ in range(most):
        if not waiting:
            return
        repo, root, below = waiting.popleft()
        if root != seed["root"]:
            store, top = _open(root)
        for name, is_dir, size in _listed(store, _join(top, below)):
            inner = _join(below, name)
            if is_dir and not is_excluded(name):
                waiting.append((name, _join(root, name), "") if repo is None else (repo, root, inner))
            elif not is_dir and repo is not None and matters(name, suffixes):
                yield repo, root, inner, size, True
    for repo, root, below in waiting:
        yield repo, root, below, None, False


def _entry_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("repo", pa.string()), ("root", pa.string()), ("path", pa.string()),
                        ("size", pa.int64()), ("is_file", pa.bool_())])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), os.path.abspath(root)


def _join(top: str, below: str) -> str:
    return f"{top.rstrip('/')}/{below}" if top and below else top or below


def _listed(store: pafs.FileSystem, directory: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a directory, size) of what stands in a directory; links are left out.

    A directory that is gone or may not be read holds nothing.
    """
    local = isinstance(store, pafs.LocalFileSystem)
    try:
        entries = store.get_file_info(pafs.FileSelector(directory, allow_not_found=True))
    except (NotADirectoryError, PermissionError):
        return
    for info in entries:
        is_dir = info.type == pafs.FileType.Directory
        if (is_dir or info.is_file) and not (local and os.path.islink(info.path)):
            yield info.base_name, is_dir, 0 if is_dir else info.size


def read_listed(listing: DataFrame, folder: str, task_bytes: int = TASK_BYTES,
                chunk_bytes: int | None = CHUNK_BYTES) -> DataFrame:
    """The files of ``list_tree`` as ``repo, path, content, size, chunk_start``.

    A file above ``chunk_bytes`` gives rows of about that size, cut behind a ``\\n``, with the byte
    each starts at in ``chunk_start``; it is null for whole files. Manifests stay whole, as their
    sections need all lines, and so does a line. ``size`` is the whole file's. A task reads at most
    ``task_bytes`` and one chunk. Files that are gone or may not be read by then are left out; any
    other error fails the task.
    """
    large = _is_large(chunk_bytes)
    # Two reads, so that a filter on chunk_start reads chunks only.
    whole = _read(read_plan(listing.where(~large), folder, task_bytes, chunk_bytes))
    parts = _read(read_plan(listing.where(large), folder, task_bytes, chunk_bytes))
    return whole.withColumn("chunk_start", F.lit(None).cast("bigint")).unionByName(parts)


def _read(plan: DataFrame) -> DataFrame:
    last = plan.agg(F.max("bin")).first()[0]
    return plan.repartitionById((last or 0) + 1, F.col("bin")).mapInArrow(_contents, _CONTENT)


def read_plan(listing: DataFrame, folder: str, task_bytes: int = TASK_BYTES,
              chunk_bytes: int | None = CHUNK_BYTES) -> DataFrame:
    """What tasks read: a row per file or chunk with its ``bin``, dealt by running bytes.

    Sums run inside a partition of the written plan; one row per partition joins them.
    """
    units = materialize(_units(listing, chunk_bytes).withColumn("_part", F.spark_partition_id()),
                        folder, "tree-units")
    cost = F.coalesce(F.col("part_end") - F.col("part_start"), F.col("size")) + OPEN_BYTES
    inside = Window.partitionBy("_part").orderBy("repo", "path", "part_start").rowsBetween(
        Window.unboundedPreceding, -1)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = units.groupBy("_part").agg(F.sum(cost).alias("_bytes")).select(
        "_part", F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_before"))
    running = F.coalesce(F.sum(cost).over(inside), F.lit(0))
    dealt = units.withColumn("_running", running).join(F.broadcast(before), "_part")
    return materialize(dealt.select(
        "repo", "root", "path", "size", "part_start", "part_end",
        F.floor((F.col("_before") + F.col("_running")) / task_bytes).cast("int").alias("bin")),
        folder, "tree-plan")


def _is_large(chunk_bytes: int | None) -> Column:
    if chunk_bytes is None:
        return F.lit(False)
    return (F.col("size") > chunk_bytes) & ~paths.file_name(F.col("path")).isin(*MANIFESTS)


def _units(listing: DataFrame, chunk_bytes: int | None) -> DataFrame:
    step = F.lit(chunk_bytes or 1).cast("bigint")
    first = F.lit(0).cast("bigint")
    starts = F.when(_is_large(chunk_bytes), F.sequence(first, F.col("size") - 1, step)).otherwise(
        F.array(first))
    return listing.withColumn("part_start", F.explode(starts)).withColumn(
        "part_end", F.when(_is_large(chunk_bytes), F.least(F.col("part_start") + step, "size")))


def _contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for batch in batches for r in batch.to_pylist())
    return _content_batches(r for r in map(_content, rows) if r is not None)


def _content(unit: dict) -> tuple | None:
    store, top = _open(unit["root"])
    try:
        with store.open_input_file(_join(top, unit["path"])) as f:
            if unit["part_end"] is None:
                first, content = None, f.read()
            else:
                first, content = read_chunk(f, unit["part_start"], unit["part_end"], unit["size"])
                if not content:
                    return None
    except (FileNotFoundError, PermissionError):
        return None
    return unit["repo"], unit["path"], content, unit["size"], first


def read_chunk(f, start: int, end: int, size: int) -> tuple[int, bytes]:
    """The lines that start in ``[start, end)`` and the place of the first; empty if none does.

    A line start is looked for inside the range only, so the parts of one long line cost their own
    bytes and not the line's.
    """
    first = _line_start(f, start, end, size)
    if first >= end:
        return end, b""
    last = _line_start(f, end, size, size)
    f.seek(first)
    return first, f.read(last - first)


def _line_start(f, at: int, limit: int, size: int) -> int:
    """The first place from ``at`` on behind a line end, or ``limit`` if there is none before it."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    f.seek(at - 1)
    place = at - 1
    while place < limit:
        block = f.read(min(1 << 16, limit - place))
        if not block:
            break
        i = block.find(b"\n")
        if i >= 0:
            return min(place + i + 1, limit)
        place += len(block)
    return limit


def _content_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes, or of one row."""
    schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("content", pa.binary()),
                        ("size", pa.int64()), ("chunk_start", pa.int64())])
    held: list[tuple] = []
    n = 0
    for row in rows:
        if held and n + len(row[2]) > _BATCH_BYTES:
            yield _batch(held, schema)
            held, n = [], 0
        held.append(row)
        n += len(row[2])
    if held:
        yield _batch(held, schema)


def cut_files(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A corpus table with its large contents cut into chunks, as ``read_listed`` gives them.

    Null contents stay whole rows. Columns besides ``repo, path, content, size`` go.
    """
    cut = ~paths.file_name(F.col("path")).isin(*MANIFESTS) & (F.octet_length("content") > chunk_bytes)
    rows = with_size(files).select("repo", "path", F.col("content").cast("binary").alias("content"),
                                   F.col("size").cast("bigint").alias("size"))

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _content_batches(
                (r["repo"], r["path"], part, r["size"], start)
                for r in batch.to_pylist() for start, part in _cut(bytes(r["content"]), chunk_bytes))

    whole = rows.where(~F.coalesce(cut, F.lit(False)))
    parts = rows.where(cut).mapInArrow(chunks, _CONTENT)
    return whole.withColumn("chunk_start", F.lit(None).cast("bigint")).unionByName(parts)


def _cut(content: bytes, chunk_bytes: int) -> Iterator[tuple[int, bytes]]:
    f, size = io.BytesIO(content), len(content)
    for start in range(0, size, chunk_bytes):
        first, part = read_chunk(f, start, min(start + chunk_bytes, size), size)
        if part:
            yield first, part


def write_tree(files: DataFrame, root: str) -> None:
    """Write ``repo, path, content`` as files below ``root``, the reverse of reading a tree.

    A row without content, or without a repository or path, gives no file. A task that runs again
    writes the same files again.
    """
    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(root)
        for batch in batches:
            for row in batch.to_pylist():
                place = _join(_join(top, row["repo"]), row["path"])
                store.create_dir(os.path.dirname(place), recursive=True)
                with store.open_output_stream(place) as f:
                    f.write(row["content"])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.select("repo", "path", F.col("content").cast("binary").alias("content"))
    rows.dropna().mapInArrow(written, "n bigint").agg(F.sum("n")).collect()
