"""Mixing sources to target weights by entropy balancing.

Document rates start at one and are tilted as little as possible, in relative entropy, so that
each source meets its token target: rate = min(CAP, exp(lambda * size / mean size)). The convex dual
is solved by safeguarded Newton steps: each step is one distributed sum over the histogram of
sizes per source, and only the largest error comes back to the driver. Rates become copies by
systematic rounding over the sizes of a source, and the few tokens that are then missing or too many
are settled by single copies of fitting size. Hashes decide which documents of equal size get a copy, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (5, 2, 1)
#: Tokens of the mix as a share of all tokens; most copies of a document.
SHARE, CAP = 1.5, 2
TOLERANCE, MOST_STEPS = 1e-7, 80
#: Copies per source that are moved one by one after rounding.
MOVES = 5
#: Rows of equal source and size that are ranked in one group.
RANKED = 512


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """Sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def _hash(id_column: str, text: str) -> Column:
    return F.xxhash64(F.col(id_column).cast("string"), F.coalesce(F.col(text), F.lit("")))


def targets(totals: DataFrame) -> DataFrame:
    """Add target to (key, source_size), one row per source.

    The budget goes to sources by weight; a source stops at CAP times its size and what it can't
    take is shared again. With sources by size per weight, the first that stay open share the
    rest, which running sums find at once. The window holds one row per source.
    """
    order = Window.orderBy("key")
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    t = totals.withColumn("w", F.get(weights, (F.row_number().over(order) - 1) % len(WEIGHTS)))
    t = t.withColumn("full", F.col("source_size") * float(CAP))
    everything = Window.partitionBy(F.lit(1))
    rise = Window.orderBy(F.col("full") / F.col("w"), "key")
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "budget": F.sum("source_size").over(everything) * SHARE,
        "stopped": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "open": F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing))})
    level = (F.col("budget") - F.col("stopped")) / F.col("open")
    t = t.withColumn("level", F.when(F.col("full") >= level * F.col("w"), level))
    t = t.withColumn("level", F.max("level").over(everything))
    return t.select("key", "source_size", F.coalesce(
        F.least("full", F.col("level") * F.col("w")), F.col("full")).alias("target"))


def _rate() -> Column:
    tilt = F.exp(F.least(F.col("lam") * F.col("z"), F.lit(50.0)))
    return F.when(F.col("fill"), F.lit(float(CAP))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(
        F.least(tilt, F.lit(float(CAP))))


def solve(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Lambda per source from the histogram (key, size, n) and (key, source_size, target, docs)."""
    state = goals.select(
        "*", (F.col("source_size") / F.col("docs")).alias("mean"),
        (F.col("target") >= F.col("source_size") * CAP * (1 - 1e-12)).alias("fill"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("error"))
    state = stored(state, "dual")
    for left in reversed(range(MOST_STEPS)):
        x = sizes.where("size > 0").join(state.where("not fill and target > 0"), "key").withColumn(
            "z", F.col("size") / F.col("mean"))
        r = _rate()
        sums = x.groupBy("key").agg(
            F.sum(F.col("n") * F.col("z") * r).alias("g"),
            F.sum(F.when(r < CAP, F.col("n") * F.col("z") * F.col("z") * r)).alias("curve"))
        s = state.join(sums, "key", "left").withColumn("g", F.col("g") - F.col("target") / F.col("mean"))
        lo = F.when(F.col("g") <= 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("g") >= 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        s = s.withColumns({"lo": lo, "hi": hi})
        newton = F.col("lam") - F.col("g") / F.col("curve")
        inside = (newton > F.coalesce("lo", F.lit(-1e300))) & (newton < F.coalesce("hi", F.lit(1e300)))
        halves = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(
            F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        error = F.coalesce(F.abs(F.col("g")) * F.col("mean") / F.greatest("target", F.lit(1.0)), F.lit(0.0))
        s = s.withColumn("error", error)
        lam = F.when(F.col("error") <= TOLERANCE, F.col("lam")).otherwise(
            F.when(F.coalesce(F.col("curve"), F.lit(0.0)) > 0, F.when(inside, newton).otherwise(halves))
            .otherwise(halves))
        state = stored(s.withColumn("lam", lam).select(state.columns), "dual")
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
        if not left:
            raise ArithmeticError(f"the dual is not solved after {MOST_STEPS} steps: {worst}")
    return state


def _closer(x: DataFrame) -> DataFrame:
    """Give or take one copy per source where that brings its tokens nearer to the target.

    ``x`` has a row per source and size; the size that leaves the least error is taken.
    """
    left = x.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    room = F.when(F.col("left") > 0, F.col("n") * CAP - F.col("copies")).otherwise(F.col("copies"))
    moves = x.join(left, "key").where((room > 0) & (F.col("size") > 0)).withColumn(
        "after", F.abs(F.abs("left") - F.col("size"))).where(F.col("after") < F.abs("left"))
    best = moves.groupBy("key").agg(F.min(F.struct(
        "after", "size", F.signum("left").cast("long").alias("sign"))).alias("m"))
    best = best.select(F.col("key").alias("_key"), F.col("m.size").alias("_size"), F.col("m.sign").alias("_sign"))
    return x.join(best, (x.key == best["_key"]) & (x["size"] == best["_size"]), "left").withColumn(
        "copies", F.col("copies") + F.coalesce("_sign", F.lit(0))).select(x.columns)


def plan(docs: DataFrame, text: str = "text", source: str = "source",
         id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, copies): each row's id, key, size, h, and the copies of each (key, size).

    copies has base, the copies that every row gets, and cut: rows with h <= cut get one more.
    """
    rows = stored(docs.select(F.col(id_column), _key(source).alias("key"), _size(text).alias("size"),
                              _hash(id_column, text).alias("h")), "sizes")
    sizes = stored(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "histogram")
    totals = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                      F.sum("n").alias("docs"))
    totals = stored(totals, "totals")
    goals = targets(totals.select("key", "source_size")).join(totals.select("key", "docs"), "key")
    state = solve(sizes, goals)
    x = sizes.join(state.select("key", "source_size", "target", "mean", "fill", "lam"), "key")
    x = x.withColumn("z", F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0))
    x = x.withColumn("r", _rate()).withColumn("whole", F.floor("r"))
    x = x.withColumn("extra", F.col("n") * (F.col("r") - F.col("whole")))
    falling = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("c", F.sum("extra").over(falling))
    x = x.withColumn("copies", F.col("n") * F.col("whole") + F.floor(F.col("c") + 0.5)
                     - F.floor(F.col("c") - F.col("extra") + 0.5))
    x = x.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), F.col("n") * CAP))
    x = x.select("key", "size", "n", "copies", "source_size", "target")
    for _ in range(MOVES):
        x = _closer(stored(x, "rounded"))
    x = x.select("key", "size", "n", "source_size", "target",
                 F.floor(F.col("copies") / F.col("n")).alias("base"),
                 (F.col("copies") % F.col("n")).alias("more"))
    x = stored(x, "copies")
    # the hash up to which rows of equal source and size get one more: rank in small groups
    some = rows.join(x.where("more > 0").select("key", "size", "n", "more"), ["key", "size"])
    # groups are ordered by the hash itself, so that ranks follow it
    some = some.withColumn("salt", F.floor((F.col("h").cast("double") / 2.0 ** 64 + 0.5)
                                           * F.ceil(F.col("n") / RANKED)))
    counts = some.groupBy("key", "size", "salt").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    here = some.join(counts, ["key", "size", "salt"]).where(
        "ahead < more and more <= ahead + m")
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("h"))
    cuts = here.withColumn("rank", rank + F.col("ahead")).where("rank = more").select(
        "key", "size", F.col("h").alias("cut"))
    return rows, stored(x.join(cuts, ["key", "size"], "left").select(
        "key", "size", "source_size", "target", "base", "cut"), "plan")


def _copies() -> Column:
    return (F.col("base") + F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)).cast("long")).cast("long")


def mix_sizes(docs: DataFrame, text: str = "text", source: str = "source",
              id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies and taken.

    A null text has size 0, a null source is a source of its own, the last. Rows of equal id and
    text share one fate where a source takes only some of its documents of that size. An empty
    table gives no rows; sources without words have target 0. Other columns are ignored.
    """
    rows, copies = plan(docs, text, source, id_column)
    found = rows.join(copies, ["key", "size"]).withColumn("copies", _copies())
    return found.select(id_column, "size", "source_size", "target", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id",
        copy: str = "copy") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the copy number from 1.

    The number is in a last column ``copy``; underscores are added to the name while ``docs`` has a column of
    that name. Nulls, ties and repeated rows are treated as ``mix_sizes`` does; rows without words are not
    taken where their source's target is 0. An empty table stays empty.
    """
    while copy.lower() in map(str.lower, docs.columns):
        copy += "_"
    _, copies = plan(docs, text, source, id_column)
    whole = docs.select(F.struct("*").alias("row"), _key(source).alias("key"),
                        _size(text).alias("size"), _hash(id_column, text).alias("h"))
    found = whole.join(copies, ["key", "size"]).withColumn("copies", _copies()).where("copies > 0")
    return found.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mix_sizes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")
