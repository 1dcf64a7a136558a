"""Ranked lexical search: term at a time with limited accumulators.

A first pass stores, for every document, how often the queries' terms occur in it; terms that no
query has are never stored. Document counts and frequencies follow from that table. The second pass
goes through it in shards of bounded size and treats each query in every shard term by term, the
rarest of the whole table first. A term gives every document that holds it an accumulator, until the
bounds of the terms still to come cannot lift a document without one to the k-th best partial
score; from then on only existing accumulators are updated, and those that cannot reach the k-th
best any more are left out. Partial scores only grow, so nothing is lost. A task keeps its best
documents from shard to shard and returns k rows per query at most; the best of all tasks follow
from one window. Postings are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, stored, table

#: Bytes of query texts that are searched together; more queries take more passes.
BLOCK_BYTES = 4 << 20
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: Bytes outside terms become blanks, A to Z small letters; every byte of a non-ASCII letter stays.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of all other characters."""
    return text.translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The length part m of documents with n terms; exact where 64 bits would not do."""
    if total == 0:
        return np.full(len(n), 10, np.int64)
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // total
    return np.array([10 + 90 * int(x) * n_docs // total for x in n], np.int64)


def _postings(docs: DataFrame, text: str, id_column: str, known) -> DataFrame:
    """Rows with id, n (all terms), terms and tfs (those of the queries, by number)."""
    def work(texts):
        ids = known.value
        n, terms, tfs = [], [], []
        for t in texts:
            found = terms_of(t)
            met = [(ids[w], c) for w, c in Counter(found).items() if w in ids]
            n.append(len(found))
            terms.append([i for i, _ in met])
            tfs.append([c for _, c in met])
        return [n, terms, tfs]

    return map_texts(docs, text, (id_column,), work, "n long, terms array<int>, tfs array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return np.diff(offsets), np.asarray(column.values)[offsets[0]:offsets[-1]]


def _frequencies(rows: DataFrame) -> dict[int, int]:
    """Documents per term; a row per term and task, then a row per term of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(_flat(batch.column(0))[1])
            if len(more) > len(total):
                more[:len(total)] += total
                total = more
            else:
                total[:len(more)] += more
        which = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), pa.array(total[which], pa.int64())], ["term", "df"])

    parts = rows.select("terms").mapInArrow(run, "term int, df long")
    return {r.term: r.df for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Shard:
    """Postings of some documents by term, with impacts and the largest impact of each term."""

    def __init__(self, terms: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray):
        order = np.argsort(terms, kind="stable")
        terms, self.doc = terms[order], doc[order]
        tf = tf[order].astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc])
        which, start = np.unique(terms, return_index=True)
        end = np.append(start[1:], len(terms))
        best = np.maximum.reduceat(self.impact, start) if len(start) else start
        self.spans = {t: (s, e, b) for t, s, e, b in zip(
            which.tolist(), start.tolist(), end.tolist(), best.tolist())}
        self.docs = len(m)

    def search(self, query: list[tuple[int, int]], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) with every document among the k best that scores ``floor`` or more.

        ``query`` has (term, weight), rarest first. Ties are all returned if they may count.
        """
        found = [(w, *self.spans[t]) for t, w in query if t in self.spans]
        rest = np.cumsum([0] + [w * best for w, _, _, best in reversed(found)])[::-1].tolist()
        acc = np.zeros(self.docs, np.int64)
        alive, least, seen = None, max(floor, 1), 0
        for (w, start, end, _), left in zip(found, rest[1:]):
            doc, gain = self.doc[start:end], self.impact[start:end] * w
            if alive is None:
                acc[doc] += gain
                seen += end - start
                if left < max(least, int(acc.max())):
                    if seen >= k:
                        least = max(least, int(np.partition(acc, self.docs - k)[self.docs - k])
                                    if self.docs > k else least)
                    if left < least:  # a document without an accumulator cannot get there
                        alive = np.nonzero(acc)[0]
            else:
                at = np.searchsorted(doc, alive)
                at[at == len(doc)] = 0
                met = doc[at] == alive
                acc[alive[met]] += gain[at[met]]
            if alive is not None:
                score = acc[alive]
                if len(alive) > k:
                    least = max(least, int(np.partition(score, len(alive) - k)[len(alive) - k]))
                alive = alive[score + left >= least]
        if alive is None:
            alive = np.nonzero(acc)[0]
        score = acc[alive]
        good = score >= least
        return alive[good], score[good]


def _best(queries, n_docs: int, total: int, k: int):
    """For rows of ``_postings``: the k best documents of a task for each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = queries.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in lines]

        def close(parts: list[pa.RecordBatch]) -> None:
            ids = [i for p in parts for i in p.column(0).to_pylist()]
            n = np.concatenate([np.asarray(p.column(1)) for p in parts])
            sizes, terms = map(np.concatenate, zip(*(_flat(p.column(2)) for p in parts)))
            tf = np.concatenate([_flat(p.column(3))[1] for p in parts])
            doc = np.repeat(np.arange(len(n)), sizes)
            shard = Shard(terms, doc, tf, lengths(n, n_docs, total))
            for at, (_, query) in enumerate(lines):
                floor = -best[at][-1][0] if len(best[at]) == k else 0
                docs, scores = shard.search(query, k, floor)
                if len(docs):
                    new = [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist())]
                    best[at] = sorted(best[at] + new)[:k]

        parts, docs, postings = [], 0, 0
        for batch in batches:
            parts.append(batch)
            docs += batch.num_rows
            postings += len(_flat(batch.column(2))[1])
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                close(parts)
                parts, docs, postings = [], 0, 0
        if docs:
            close(parts)
        rows = [(line, None if no else i, -s) for (line, _), b in zip(lines, best) for s, no, i in b]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["line", "id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", id_column: str = "doc_id",
           item_text: str = "text", item_column: str = "item_id") -> DataFrame:
    """The ``k`` best rows of ``docs`` for every row of ``items``: the ids, rank (from 1), score.

    Documents without a term of the item are not returned, so an item may have fewer rows or none.
    Equal scores come by ascending id, null ids last. Ids of documents are whole numbers. Null texts
    hold no terms; repeated documents and repeated items each count as a row of their own, and a term
    counts once in an item. An empty table on either side gives no rows. Other columns are ignored.
    Items are searched in blocks of about BLOCK_BYTES of text, so that no broadcast grows with them.
    """
    spark = docs.sparkSession
    lines = stored(items.select(
        F.monotonically_increasing_id().alias("line"), F.col(item_column).alias("item"),
        F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text")), "items")
    size = lines.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    found = spark.createDataFrame([], "line long, id long, score long")
    sc = spark.sparkContext
    for block in range(blocks):
        mine = lines.where(F.pmod(F.xxhash64("line"), F.lit(blocks)) == block)
        words = {r.line: set(terms_of(bytes(r.text))) for r in mine.select("line", "text").collect()}
        ids = {w: i for i, w in enumerate(sorted(set().union(*words.values())))}
        if not ids:
            continue
        rows = stored(_postings(docs, text, id_column, sc.broadcast(ids)), "postings")
        n_docs, total = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _frequencies(rows)
        queries = [(line, sorted(((ids[w], weight(n_docs, df[ids[w]])) for w in ws if ids[w] in df),
                                 key=lambda q: (df[q[0]], q[0]))) for line, ws in words.items()]
        queries = [q for q in queries if q[1]]
        best = rows.select(F.col(id_column).cast("long"), "n", "terms", "tfs").mapInArrow(
            _best(sc.broadcast(queries), n_docs, total, k), "line long, id long, score long")
        found = found.union(stored(best, "best"))
    order = Window.partitionBy("line").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(lines.select("line", "item"), "line").select(
        F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
