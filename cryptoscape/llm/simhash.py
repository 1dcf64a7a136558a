"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming check, components.

Texts with equal fingerprints are one node. A fingerprint is cut into six blocks; two of them that
differ in at most three bits agree on at least three blocks, so every such pair meets under one of
the twenty keys made of three blocks (about 32 bits, hence few chance meetings). The fingerprints
below a key are compared in groups of bounded size: a key with many is split into parts, and each
pair of parts is a group of its own. A group returns a spanning forest of its links, not the pairs,
so output stays linear, and components come from stars that shrink with every round.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stored, table

BLOCKS = 6
#: Fingerprints of a key that are compared in one part.
PART = 4096
SEED = 42
#: Bytes of a text that are cut into words at a time.
LONG_TEXT = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words in lists of bounded size; a cut is made at white space only."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + LONG_TEXT)
        end = space.start() if space else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, width: int) -> int:
    """SimHash over all shingles of ``width`` words; 0 without words."""
    count, total, before = np.zeros(64, np.int64), 0, []

    def add(shingles: Iterable[bytes]) -> int:
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        count.__iadd__(bits.sum(axis=0, dtype=np.int64))
        return len(hashes)

    for words in _word_lists(text):
        words = before + words
        if len(words) >= width:
            total += add(map(b" ".join, zip(*(words[i:] for i in range(width)))))
        before = words[max(0, len(words) - width + 1):]
    if not total:
        if not before:
            return 0
        total = add([b" ".join(before)])
    return int.from_bytes(np.packbits(count * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and fp (long, the 64 bits) of every row's whole text."""
    def work(texts):
        return [[(f ^ (1 << 63)) - (1 << 63) for f in (fingerprint(t, width) for t in texts)]]

    return map_texts(docs, text, keep, work, "fp long")


def _keys() -> list[int]:
    """Masks of the bits that a key compares, one for each choice of half the blocks."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(BLOCKS)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - 3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of distinct fingerprints: (member, first of its tree)."""
    n, bits = len(fps), fps.view(np.uint64)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, n, 256):
        far = np.bitwise_count(bits[at:at + 256, None] ^ bits[None, at:])
        near = far <= most
        rows, cols = np.nonzero(near)
        rows, cols = rows + at, cols + at
        while len(rows):
            a, b = root[rows], root[cols]
            apart = a != b
            rows, cols, a, b = rows[apart], cols[apart], a[apart], b[apart]
            if not len(rows):
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            first = np.ones(len(high), bool)
            first[1:] = high[order][1:] != high[order][:-1]
            for h, l in zip(high[order][first], low[order][first]):
                x, y = find(int(h)), find(int(l))
                if x != y:
                    root[max(x, y)] = min(x, y)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    linked = np.nonzero(root != np.arange(n))[0]
    return [(int(fps[i]), int(fps[root[i]])) for i in linked]


def _compare(most: int):
    """For rows sorted by group: compare the distinct fingerprints of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, parts = None, []

        def close() -> list[tuple[int, int]]:
            fps = np.unique(np.concatenate(parts))
            return _forest(fps, most) if len(fps) > 1 else []

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)
            fp = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1
            starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(fp)]
            links: list[tuple[int, int]] = []
            for s, e in zip(starts, ends):
                if e == s:
                    continue
                k = tuple(key[s].tolist())
                if k != open_key:
                    if parts:
                        links += close()
                    open_key, parts = k, []
                parts.append(fp[s:e])
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
        if parts:
            links = close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
    return run


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within ``most`` (3 or fewer) bits.

    The links are enough to connect whatever the full set of pairs connects.
    """
    if not 0 <= most <= 3:
        raise ValueError("the keys cover up to 3 differing bits")
    masks = [_signed(m) for m in _keys()]
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.lit(m) for m in masks))).alias("k", "mask"))
    keyed = keyed.select("fp", "k", F.expr("fp & mask").alias("bits"))
    met = (keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1")
           .withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    rows = keyed.join(met, ["k", "bits"])
    # with one part the group is (0, 0); else a fingerprint goes to every pair with its part
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))
    rows = rows.select("k", "bits", own.alias("own"), F.explode(other).alias("other"), "fp")
    rows = rows.select("k", "bits", F.least("own", "other").alias("lo"),
                       F.greatest("own", "other").alias("hi"), "fp")
    rows = (rows.repartition("k", "bits", "lo", "hi")
            .sortWithinPartitions("k", "bits", "lo", "hi"))
    rows = rows.select(F.col("k").cast("long"), "bits", F.col("lo").cast("long"),
                       F.col("hi").cast("long"), "fp")
    return rows.mapInArrow(_compare(most), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node it reaches.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then the
    smaller ones; it ends when only stars are left, after a number of rounds that grows with the
    logarithm of the longest path. Every round is written to the shared folder.
    """
    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hung = both.join(low, "a")
        if larger:
            hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                low.select("a", F.col("m").alias("b")))
        return hung.where("a > b").distinct()

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = stored(e.where("a > b").distinct(), name)

    def state(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()

    before = state(e)
    while True:
        e = stored(star(star(e, True), False), name)
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _marked(docs: DataFrame, keep: tuple[str, ...], width: int, most: int, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): the columns in ``keep`` with fp for every row, and the root of every fp."""
    rows = stored(fingerprints(docs, width, text, keep), "fingerprints")
    nodes = rows.select("fp").distinct()
    roots = components(links(nodes, most))
    return rows, stored(nodes.join(roots, nodes.fp == roots.node, "left").select(
        nodes.fp, F.coalesce("root", nodes.fp).alias("root")), "roots")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, text: str = "text",
                    id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, fp and component_id, the smallest id it reaches.

    Null texts count as empty; all texts without words have fingerprint 0 and are linked. Rows
    with a null id are nodes like any other and get their component's smallest id that is not
    null, or null if there is none. Repeated rows are repeated. Other columns are ignored.
    """
    rows, roots = _marked(docs, (id_column,), width, most, text)
    first = rows.groupBy("fp").agg(F.min(id_column).alias("first"))
    grouped = stored(first.join(roots, "fp"), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    known = grouped.join(smallest, "root").select("fp", "component_id")
    return rows.join(known, "fp").select(id_column, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, text: str = "text",
                         id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates, with all their columns.

    Of each component the row with the smallest id stays (null ids last, then by a hash of the
    text); of rows with equal id and text, one. A table of what goes is joined, so texts are not
    kept anywhere else.
    """
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.select(F.col(id_column).alias("_id"), h.alias("_h"), F.col(text).alias("_text"))
    rows, roots = _marked(keyed, ("_id", "_h"), width, most, "_text")
    per_key = rows.join(roots, "fp").groupBy("root", "_id", "_h").agg(F.count("*").alias("_n"))
    return keep_first(docs, per_key, text, id_column)


def keep_first(docs: DataFrame, per_key: DataFrame, text: str, id_column: str) -> DataFrame:
    """One row of ``docs`` for each root; per_key has root, _id, _h (hash of the text) and _n (rows)."""
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    per_key = stored(per_key, "keys").withColumn("_rank", F.struct(
        F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_h").alias("h")))
    best = per_key.groupBy("root").agg(F.min("_rank").alias("_best"))
    fate = stored(per_key.join(best, "root").select(
        "_id", "_h", (F.col("_rank") == F.col("_best")).alias("_stays"), "_n").where(
        "not _stays or _n > 1"), "fates").withColumnRenamed("_h", "_of")
    whole = docs.select(F.struct("*").alias("row"), h.alias("_h"))
    met = whole.join(fate, F.col(f"row.{id_column}").eqNullSafe(F.col("_id"))
                     & (F.col("_h") == F.col("_of")), "left")
    single = met.where("_stays is null").select("row.*")
    again = met.where("_stays").dropDuplicates(["_id", "_h"]).select("row.*")
    return single.union(again)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
