"""Exact top-k inner products over a pivot-distance index.

Components become whole numbers, floor(scale * x). A vector x of a band of lengths gets one more
component, sqrt(M^2 - |x|^2), with M the largest length of its band, and a query gets 0 there. Then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products of a band are its nearest vectors, and the
triangle inequality over a pivot p bounds them: |q - x| >= | |q - p| - |x - p| |.

Every vector is filed under its nearest pivot and its distance to it. The distances below a pivot are cut
into annuli, and large annuli into pages. A query first searches the annulus whose bound is best, then more
and more annuli by falling bound, and stops when the bound of the next is below its k-th best score. Inside
a page, vectors are sorted by distance and searched slice by slice under the same bound. Pivots, annuli and
bands have fixed limits, so the list of annuli that travels with the queries has too; pages are met by a
join. In many dimensions distances to a pivot hardly differ; then the bounds exclude little and the search
compares most vectors, with unchanged results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Vectors, and components in all, of the sample that pivots are fitted on.
SAMPLE, SAMPLE_CELLS = 4096, 1 << 22
#: Most pivots, and most annuli of a pivot.
PIVOTS, ANNULI = 128, 64
#: Vectors of a page (fewer where they are long) and, within it, of a slice; queries per copy of a page.
PAGE, SLICE, QUERIES = 8192, 1024, 1 << 16
#: Annuli that a query searches in the first steps; the last step takes all that are left.
STEPS = (1, 8)
#: Share of the lengths by which distances may be off.
SLACK = 1e-6
#: Products below this are exact in doubles.
EXACT = float(1 << 53)
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63) + 1


def matrix(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """Rows of whole numbers as doubles; shorter vectors end in zeros."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0]:offsets[-1]].astype(float)
    sizes, n = np.diff(offsets), len(offsets) - 1
    if (sizes == width).all():
        return np.floor(scale * values.reshape(n, width))
    out = np.zeros((n, width))
    out[np.arange(width) < sizes[:, None]] = np.floor(scale * values)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held within the range of long."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    held = np.frompyfunc(lambda x: min(max(x, _LEAST), _MOST), 1, 1)
    return held(whole(a) @ whole(b).T).astype(np.int64)


def fit_pivots(vectors: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` or fewer centres: far points first, then means of what is nearest."""
    centres = vectors[:1]
    far = ((vectors - centres[0]) ** 2).sum(1)
    while len(centres) < n and far.max(initial=0) > 0:
        centres = np.vstack([centres, vectors[far.argmax()]])
        far = np.minimum(far, ((vectors - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        near = ((centres ** 2).sum(1) - 2 * vectors @ centres.T).argmin(1)
        centres = np.vstack([vectors[near == i].mean(0) for i in np.unique(near)])
    return centres


def band(square: float) -> int:
    """Lengths of one band differ by a factor of 1.42 at most; -1 holds the zero vectors."""
    return max(round(math.log2(square)), 0) if square > 0 else -1


class Geometry:
    """The bands with their largest squared lengths, and pivots for each, with the added component last."""

    def __init__(self, bands: dict[int, float], sample: np.ndarray, width: int, pivots: int):
        self.width, self.bands, self.of_band = width, bands, {}
        own = np.array([band(v @ v) for v in sample], int)
        made, most = [np.zeros((0, width + 1))], []
        for b, longest in sorted(bands.items()):
            mine = sample[own == b]
            if len(mine):
                added = np.sqrt(np.maximum(longest - (mine ** 2).sum(1), 0))
                share = max(1, round(pivots * len(mine) / len(sample)))
                made.append(fit_pivots(np.hstack([mine, added[:, None]]), share))
            else:
                made.append(np.zeros((1, width + 1)))
            self.of_band[b] = slice(len(most), len(most) + len(made[-1]))
            most += [longest] * len(made[-1])
        self.pivots, self.most = np.vstack(made), np.array(most)

    def distances(self, vectors: np.ndarray, added: np.ndarray, which: slice = slice(None)) -> np.ndarray:
        """From vectors (rows) with their added components to pivots (columns)."""
        p = self.pivots[which]
        flat = (vectors ** 2).sum(1)[:, None] + (p[:, :-1] ** 2).sum(1) - 2 * vectors @ p[:, :-1].T
        return np.sqrt(np.maximum(flat, 0) + (added[:, None] - p[:, -1]) ** 2)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector among those of its band, and the distance to it."""
        square = (vectors ** 2).sum(1)
        pivot, far = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        bands = np.array([band(s) for s in square], int)
        for b in np.unique(bands).tolist():
            rows, which = np.nonzero(bands == b)[0], self.of_band[b]
            d = self.distances(vectors[rows], np.sqrt(np.maximum(self.bands[b] - square[rows], 0)), which)
            near = d.argmin(1)
            pivot[rows], far[rows] = which.start + near, d[np.arange(len(rows)), near]
        return pivot, far


def bounds(square: np.ndarray, near: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    """The most that inner products can be for queries of squared length ``square``.

    ``near`` is the least distance that the triangle inequality leaves to vectors of a band whose squared
    lengths are up to ``most``.
    """
    low = np.maximum(near - SLACK * (np.sqrt(square) + np.sqrt(most)), 0)
    return (square + most - low ** 2) / 2 + SLACK * (square + most) + 1


def _usable(df: DataFrame, queries: Column, vector: str, id_column: str) -> DataFrame:
    """(id, vec, h, asks) of the rows whose vectors hold finite components only."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return (df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vec"),
                      F.coalesce(queries, F.lit(False)).alias("asks"))
            .where(F.col("vec").isNotNull() & F.forall("vec", finite))
            .withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))  # no -0.0
            .withColumn("h", F.xxhash64("vec")))


class Index:
    """Rows of (id, vec, h), where each belongs, and the list of annuli.

    Of equal vectors only those with the ``k`` smallest ids can be among the k best, so only they are rows.
    """

    def __init__(self, rows: DataFrame, k: int, scale: float):
        spark = rows.sparkSession
        self.scale, self.k = scale, k
        ranks = Window.partitionBy("h", "vec").orderBy(F.asc_nulls_last("id"))
        first = rows.select("id", "vec", "h", F.row_number().over(ranks).alias("n")).where(F.col("n") <= k)
        self.rows = stored(first.drop("n"), "vectors")
        width = self.rows.agg(F.max(F.size("vec"))).first()[0] or 0
        lengths = self.rows.select("vec").mapInArrow(self._lengths(width), "band int, most double, n long")
        found = lengths.groupBy("band").agg(F.max("most").alias("most"), F.sum("n").alias("n")).collect()
        n = sum(r.n for r in found)
        cells = max(width, 1)
        order = F.xxhash64("h", "id")
        sample = self.rows.select("vec", order.alias("o")).orderBy("o", "vec").limit(
            max(1, min(SAMPLE, SAMPLE_CELLS // cells))).select("vec").collect()
        padded = np.zeros((len(sample), width))
        for row, r in zip(padded, sample):
            row[:len(r.vec)] = np.floor(scale * np.array(r.vec, float))
        self.page = max(64, min(PAGE, SAMPLE_CELLS // cells))
        pivots = max(1, min(PIVOTS, SAMPLE_CELLS // cells, -(-n // (4 * self.page))))
        sc = spark.sparkContext
        self.geo = sc.broadcast(Geometry({r.band: r.most for r in found}, padded, width, pivots))
        self._cut(sc)

    def _lengths(self, width: int):
        scale = self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most, n = {}, {}
            for batch in batches:
                for s in (matrix(batch.column(0), width, scale) ** 2).sum(1).tolist():
                    b = band(s)
                    most[b], n[b] = max(most.get(b, 0.0), s), n.get(b, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.float64()),
                 pa.array(list(n.values()), pa.int64())], ["band", "most", "n"])
        return run

    def placed(self, cuts=None) -> DataFrame:
        """The rows with pivot and far; with ``cuts`` also their annulus and page of it."""
        geo, scale = self.geo, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pivot, far = geo.value.place(matrix(batch.column(1), geo.value.width, scale))
                made = [pivot, far]
                if cuts is not None:
                    edges, base, pages = cuts.value
                    annulus = np.zeros(len(pivot), np.int64)
                    for p in np.unique(pivot):
                        at = pivot == p
                        annulus[at] = base[p] + np.searchsorted(edges[p], far[at])
                    mixed = np.asarray(batch.column(2)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= np.asarray(batch.column(0).fill_null(0)).astype(np.uint64)
                    mixed = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
                    many = pages[annulus] if len(pages) else np.ones(len(annulus), np.int64)
                    made += [annulus, mixed.astype(np.int64) % many]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names)

        kind = self.rows.schema["vec"].dataType.simpleString()
        fields = f"id long, vec {kind}, h long, pivot long, far double"
        fields += ", annulus long, page long" if cuts is not None else ""
        names = [f.split()[0] for f in fields.split(", ")]
        return self.rows.mapInArrow(run, fields)

    def _cut(self, sc) -> None:
        """Edges of annuli from approximate quantiles; their true ends and sizes from all rows."""
        grid = [i / ANNULI for i in range(1, ANNULI)]
        found = {r.pivot: r for r in self.placed().groupBy("pivot").agg(
            F.count("*").alias("n"), F.percentile_approx("far", grid, 1000).alias("q")).collect()}
        edges, base, total = [], [], 0
        for p in range(len(self.geo.value.pivots)):
            many = min(ANNULI, -(-found[p].n // self.page)) if p in found else 1
            edges.append(np.array([found[p].q[round(i * ANNULI / many) - 1] for i in range(1, many)]))
            base.append(total)
            total += many
        rows = self.placed(sc.broadcast((edges, base, np.zeros(0)))).groupBy("annulus").agg(
            F.first("pivot").alias("pivot"), F.min("far").alias("low"), F.max("far").alias("high"),
            F.count("*").alias("n")).orderBy("annulus").collect()
        pages = np.ones(total, np.int64)
        for r in rows:
            pages[r.annulus] = -(-r.n // self.page)
        self.cuts = sc.broadcast((edges, base, pages))
        self.annuli = sc.broadcast((
            *(np.array([r[c] for r in rows], t) for c, t in (
                ("annulus", np.int64), ("pivot", np.int64), ("low", float), ("high", float))), pages))

    def wanted(self, queries: DataFrame, done: int, step: int | None) -> DataFrame:
        """A row for each query and page of its next ``step`` annuli that may hold a hit.

        Annuli come by falling bound; the first ``done`` are behind it. ``queries`` has query, vec, id, least.
        """
        geo, annuli, scale = self.geo, self.annuli, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, (number, pivot, low, high, pages) = geo.value, annuli.value
            last = len(number) if step is None else min(done + step, len(number))
            for whole in batches:
                for at in range(0, whole.num_rows, 128):
                    batch = whole.slice(at, 128)
                    vectors = matrix(batch.column(1), g.width, scale)
                    least = np.asarray(batch.column(3))
                    d = g.distances(vectors, np.zeros(len(vectors)))[:, pivot]
                    near = np.maximum(np.maximum(d - high, low - d), 0)
                    bound = bounds((vectors ** 2).sum(1)[:, None], near, g.most[pivot])
                    order = np.argsort(-bound, axis=1, kind="stable")[:, done:last]
                    rows, cols = np.nonzero(np.take_along_axis(bound, order, 1) >= least[:, None])
                    for c in range(0, len(rows), 4096):
                        row, which = rows[c:c + 4096], order[rows[c:c + 4096], cols[c:c + 4096]]
                        many = pages[number[which]]
                        page = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        row, which = np.repeat(row, many), np.repeat(which, many)
                        take = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(number[which]), pa.array(page), batch.column(0).take(take),
                             batch.column(2).take(take), batch.column(1).take(take), pa.array(d[row, which]),
                             pa.array(pivot[which]), pa.array(least[row])], names)

        names = ["annulus", "page", "query", "id", "vec", "far", "pivot", "least"]
        kind = queries.schema["vec"].dataType.simpleString()
        return queries.select("query", "vec", "id", "least").mapInArrow(
            run, f"annulus long, page long, query long, id long, vec {kind}, far double, pivot long, least long")

    def meet(self, wanted: DataFrame, copies: int) -> DataFrame:
        """The k best rows of every page for each query that wants it: query, id, score, own."""
        touched = [r.annulus for r in wanted.select("annulus").distinct().collect()]
        if not touched:
            return self.rows.sparkSession.createDataFrame([], _FOUND)
        pages = self.placed(self.cuts).where(F.col("annulus").isin(touched))
        both = pages.select(
            "annulus", "page", F.explode(F.expr(f"sequence(0L, {copies - 1}L)")).alias("part"),
            F.lit(0).cast("long").alias("side"), F.lit(0).cast("long").alias("query"), "id", "vec", "far", "pivot",
            F.lit(0).cast("long").alias("least")).unionByName(wanted.withColumns({
                "part": F.pmod("query", F.lit(copies)).cast("long"), "side": F.lit(1).cast("long")}))
        unit = ["annulus", "page", "part"]
        both = both.repartition(*unit).sortWithinPartitions(*unit, "side", "far")
        return both.mapInArrow(_meet(self.geo, self.k, self.scale), _FOUND)


_FOUND = "query long, id long, score long, own boolean"


def _meet(geo, k: int, scale: float):
    """For rows sorted by page, vectors first and by distance: search the page for its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, unit, parts, page = geo.value, None, [], None
        for whole in batches:
            keys = np.stack([np.asarray(whole.column(i)) for i in range(4)], 1)
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if end == start:
                    continue
                key, side = tuple(keys[start, :3].tolist()), keys[start, 3]
                if key != unit:
                    unit, parts, page = key, [], None
                if side == 0:
                    parts.append(whole.slice(start, end - start))
                    continue
                if not parts:  # no vector fell on this page
                    continue
                if page is None:
                    page = (pa.concat_arrays([p.column(5) for p in parts]),
                            np.vstack([matrix(p.column(6), g.width, scale) for p in parts]),
                            np.concatenate([np.asarray(p.column(7)) for p in parts]),
                            g.most[parts[0].column(8)[0].as_py()])
                for at in range(start, end, 2048):
                    yield search(whole.slice(at, min(2048, end - at)), *page)

    def search(queries: pa.RecordBatch, ids: pa.Array, vectors: np.ndarray, far: np.ndarray, most: float):
        q = matrix(queries.column(6), vectors.shape[1], scale)
        d, least = np.asarray(queries.column(7)), np.array(queries.column(9))
        id_key = np.asarray(ids.fill_null(_MOST))
        slices = [(s, min(s + SLICE, len(far))) for s in range(0, len(far), SLICE)]
        near = np.stack([np.maximum(np.maximum(d - far[e - 1], far[s] - d), 0) for s, e in slices], 1)
        bound = bounds((q ** 2).sum(1)[:, None], near, most)
        scores = [np.zeros(0, np.int64)] * len(q)
        places = [np.zeros(0, np.int64)] * len(q)
        for i in np.argsort(near.mean(0), kind="stable"):
            s, e = slices[i]
            on = np.nonzero(bound[:, i] >= least)[0]
            if not len(on):
                continue
            new = products(q[on], vectors[s:e])
            limit = least[on]
            if e - s > k:  # what is below the k-th best of the slice can't count
                limit = np.maximum(limit, np.partition(new, e - s - k, axis=1)[:, e - s - k])
            for j, r in enumerate(on):
                met = np.nonzero(new[j] >= limit[j])[0]
                if not len(met):
                    continue
                score, place = np.append(scores[r], new[j][met]), np.append(places[r], met + s)
                best = np.lexsort((id_key[place], -score))[:k]
                scores[r], places[r] = score[best], place[best]
                if len(best) == k:
                    least[r] = max(least[r], scores[r][-1])
        row, place = np.repeat(np.arange(len(q)), list(map(len, places))), np.concatenate(places)
        row, at = pa.array(row), pa.array(place)
        same = (vectors[place] == q[row]).all(1) & np.asarray(
            pc.fill_null(pc.equal(ids.take(at), queries.column(5).take(row)), False))
        return pa.RecordBatch.from_arrays(
            [queries.column(4).take(row), ids.take(at), pa.array(np.concatenate(scores)), pa.array(same)],
            ["query", "id", "score", "own"])
    return run


def _reduced(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, vector: str = "embedding",
          id_column: str = "vec_id") -> DataFrame:
    """The ``k`` largest inner products with other rows for every row of ``vectors`` that ``queries`` marks.

    Columns: query_id, rank (from 1), the id and score; equal scores come by ascending id, null ids last.
    Vectors that are null or hold null, NaN or infinite components take no part, on either side. Vectors of
    different lengths are compared as if the shorter ended in zeros, so an empty vector scores 0. A row is no
    candidate for itself, but another row with the same id or vector is; a repeated query is answered again.
    With fewer than k other rows all are returned; an empty table gives no rows. Scores beyond long are held
    at its ends. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, queries, vector, id_column)
    index = Index(rows, k + 1, scale)  # one more than asked for: a query may meet itself
    asks = stored(rows.where("asks").groupBy("id", "vec", "h").agg(F.count("*").alias("copies")).withColumn(
        "query", F.monotonically_increasing_id()), "queries")
    copies = -(-asks.count() // QUERIES) or 1
    tops, done = spark.createDataFrame([], _FOUND), 0
    for step in (*STEPS, None):
        least = tops.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        active = asks.join(least, "query", "left").withColumn(
            "least", F.when(F.col("n") == k + 1, F.col("least")).otherwise(_LEAST))
        found = index.meet(index.wanted(active, done, step), copies)
        tops = stored(_reduced(tops.unionByName(found), k + 1), "best")
        done += step or 0
    one = F.struct((-F.col("score")).alias("minus"), F.col("id").isNull().alias("no"), "id", "own")
    lists = tops.groupBy("query").agg(F.sort_array(F.collect_list(one)).alias("all"))
    own = F.array_position(F.transform("all", lambda x: x["own"]), True)
    lists = lists.withColumn("own", own).withColumn("all", F.slice(F.filter(
        "all", lambda x, i: i + 1 != F.col("own")), 1, k))
    return asks.join(lists, "query").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        F.col("id").alias("query_id"), F.posexplode("all").alias("rank", "one")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("one.id").alias(id_column),
        (-F.col("one.minus")).alias("score"))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors for every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
