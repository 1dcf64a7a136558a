"""Quality rules: text statistics, fixed rules, and robust multivariate outliers.

Statistics of a text are built-in expressions over its row; nothing is shuffled for them. Per
language and source a minimum-covariance-determinant estimate is made from the transformed
statistics of the documents that pass the fixed rules: start from medians and median deviations,
keep the 75 % nearest, take their mean and covariance, and repeat. A document far from its group's
estimate by Mahalanobis distance is rejected. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bound, stored, table, words_of

#: Documents that the fixed rules need: words; most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Share of a group that the estimate rests on, and what makes its covariance fit normal data
#: (share / P(chi2 of 6 degrees <= the 75 % point of chi2 of 4 degrees)).
CORE, CONSISTENCY = 0.75, 1.486
#: Squared distance above which a document goes: the 1 - 1e-6 point of chi2 of 4 degrees.
CUT = 33.4
#: Documents that a group needs for an estimate of its own.
LEAST_GROUP = 50
STEPS = 3
#: Statistics, and the least standard deviation that an estimate may give them.
FLOORS = {"x0": 0.25, "x1": 0.05, "x2": 0.15, "x3": 0.15}
WINDOW = 5


def _repeated(df: DataFrame) -> DataFrame:
    """Add n_repeat_words for the column words: positions inside windows that occur again."""
    last = F.size("words") - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        *(F.get("words", i + k) for k in range(WINDOW))))
    df = bound(df, h=F.when(last >= 0, hashes))
    again = F.size(F.array_distinct("h")) < F.size("h")
    df = bound(df, s=F.when(again, F.sort_array(F.transform(
        "h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get("s", k - 1)["h"], F.lit(False)) | F.coalesce(
            x["h"] == F.get("s", k + 1)["h"], F.lit(False))

    df = bound(df, at=F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"])))
    steps = F.transform("at", lambda p, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop(
        "h", "s", "at")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keep every column of ``docs`` below ``row`` and add the statistics of its text.

    Null counts as an empty text. The statistics: n_words, word_chars, n_symbols, n_dup_lines,
    n_lines, n_repeat_words, and base_failed by the fixed rules.
    """
    df = docs.select(F.struct("*").alias("row"))
    df = bound(df, body=F.coalesce(F.col("row")[text], F.lit("")))
    df = bound(df, words=words_of(F.col("body")), lines=F.filter(
        F.split("body", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0))
    df = df.select(
        "row", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    df = _repeated(df).drop("words")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def vector() -> dict[str, Column]:
    """Transformed statistics, near normal for prose and steady for short texts."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {"x0": (chars + 100.0) / (n + 20.0),                       # characters a word, drawn to 5
            "x1": F.sqrt(F.col("n_symbols") / (chars + 20.0)),
            "x2": F.asin(F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0))),
            "x3": F.asin(F.sqrt(F.col("n_repeat_words") / (n + 20.0)))}


def _key(*names: str) -> Column:
    """A key that tells null from any value."""
    return F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("-"))
                                 for n in names))


def _grouped(x: DataFrame) -> DataFrame:
    """Add g: language and source, or a pool of its language or of all where rows are few."""
    sizes = x.groupBy("lang_source", "lang_only").agg(F.count("*").alias("n"))
    sizes = stored(sizes, "group-sizes")
    small = sizes.where(F.col("n") < LEAST_GROUP)
    pools = small.groupBy("lang_only").agg(F.sum("n").alias("pool"))
    g = F.when(F.col("n") >= LEAST_GROUP, F.concat(F.lit("g"), "lang_source")).when(
        F.coalesce("pool", F.lit(0)) >= LEAST_GROUP, F.concat(F.lit("l"), "lang_only")).otherwise(
        F.lit("all"))
    return stored(sizes.join(pools, "lang_only", "left").select("lang_source", g.alias("g")), "groups")


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the factor's columns l_i_j."""
    z: list[Column] = []
    for i, name in enumerate(names):
        value = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * z[j]
        z.append(value / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _factor(moments: DataFrame, names: list[str]) -> DataFrame:
    """Cholesky factor of each group's covariance, widened to the floors, as columns l_i_j."""
    df = moments
    for i, name in enumerate(names):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") * CONSISTENCY
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + FLOORS[name] ** 2
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            done = F.sqrt(F.greatest(value, F.lit(FLOORS[name] ** 2))) if i == j else (
                value / F.col(f"l{j}{j}"))
            df = bound(df, **{f"l{i}{j}": done})
    return df.select("g", *(f"m{i}" for i in range(len(names))),
                     *(f"l{i}{j}" for i in range(len(names)) for j in range(i + 1)))


def estimate(statistics: DataFrame) -> DataFrame:
    """Groups and their estimates from rows with row.lang, row.source and the statistics.

    One row per (language, source) key: lang_source, g, the mean m_i and the factor l_i_j. Rows
    that the fixed rules reject take no part.
    """
    x = statistics.where("not base_failed").select("lang_source", "lang_only", *(
        v.alias(k) for k, v in vector().items()))
    x = stored(x, "vectors")
    names = list(FLOORS)
    groups = _grouped(x)
    x = x.join(groups, "lang_source").select("g", *names)
    middle = x.groupBy("g").agg(*(F.percentile_approx(n, 0.5, 1000).alias(f"m{i}")
                                  for i, n in enumerate(names)))
    middle = stored(middle, "medians")
    spread = x.join(middle, "g").groupBy("g").agg(*(
        F.percentile_approx(F.abs(F.col(n) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}")
        for i, n in enumerate(names)))
    start = middle.join(spread, "g")
    for i, n in enumerate(names):
        for j in range(i + 1):
            start = start.withColumn(f"c{i}{j}", (F.col(f"d{i}") * 1.4826) ** 2 if i == j
                                     else F.lit(0.0))
    params = stored(_factor(start, names), "estimate")
    for _ in range(STEPS):
        d = x.join(params, "g").select("g", *names, _distance(names).alias("d"))
        near = stored(d.groupBy("g").agg(F.percentile_approx("d", CORE, 1000).alias("far")), "core")
        core = d.join(near, "g").where("d <= far")
        pairs = {f"c{i}{j}": F.covar_pop(names[i], names[j])
                 for i in range(len(names)) for j in range(i + 1)}
        moments = core.groupBy("g").agg(
            *(F.avg(n).alias(f"m{i}") for i, n in enumerate(names)),
            *(v.alias(k) for k, v in pairs.items()))
        params = stored(_factor(moments, names), "estimate")
    return stored(groups.join(params, "g"), "estimates")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           store_statistics: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` below ``row`` with its statistics, base_failed, distance and kept.

    kept is false if a fixed rule fails or the squared distance is above CUT. Null language or
    source forms a group of its own; a language and source whose rows all fail has distance null
    and is decided by the fixed rules. Rows are judged one by one, so repeats stay repeats. With
    ``store_statistics`` only the columns in ``keep`` stay below ``row``, and texts are read once.
    """
    if store_statistics:
        docs = docs.select(*dict.fromkeys((*keep, text, lang, source)))
    stats = with_statistics(docs, text).withColumns({
        "lang_source": _key(f"row.{lang}", f"row.{source}"), "lang_only": _key(f"row.{lang}")})
    if store_statistics:
        stats = stored(stats.withColumn("row", F.struct(*(F.col(f"row.{k}") for k in keep))),
                       "statistics")
    estimates = estimate(stats)
    found = stats.withColumns(vector()).join(estimates, "lang_source", "left")
    found = bound(found, distance=_distance(list(FLOORS)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return found.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return judged(docs).where("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    found = judged(table(spark, sf_dir, "documents"), store_statistics=True, keep=("doc_id",))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "distance")
