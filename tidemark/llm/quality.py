"""Quality rules and robust multivariate outliers.

Rules count words (runs without space, tab, LF, VT, FF and CR), symbols,
repeated lines and words in repeated three-word windows of each text, and fail
texts of few words or much repetition.

Texts that pass are judged by their statistics: logarithms and shares that
form a vector.  Its location and scatter are minimum-covariance-determinant
estimates of each (language, source).  From each of three deterministic starts
(scatters about the medians: of the median absolute deviations, of squashed
values, and of directions), concentration steps refit mean and covariance on
the ``HELD`` share of vectors nearest by Mahalanobis distance, as long as the
group's determinant falls by it; the start that ends at the least determinant is
taken, and mean and covariance are fitted once more on the vectors that it
does not hold for outlying (``REWEIGHT``).  A vector whose squared distance is
beyond the chi-square quantile for ``1 - REJECT`` is rejected.

Every document belongs to one group.  Those of fewer than ``LEAST_GROUP``
passing vectors are pooled by language, and pools still too small with one
another; if even that pool is too small, its documents are not judged by
distance.

Everything is DataFrame expressions.  Texts are read once; the rest works on
a written table of numbers.  Groups are only ever aggregated with partial
sums, so a hot source costs no single task more than others.  Shares of a
group are found from exact counts of fine steps of the value (``STEPS_A_UNIT``
to a unit, or to a unit of the logarithm of a distance), so results do not
depend on how rows are partitioned.  Estimates are broadcast if their rows
take few bytes; else the rows of a group are dealt over several tasks.

Null and empty texts have no words and fail.  Null language or source form
groups of their own.  Repeated rows are documents of their own, and ties in
distance stay together.  Texts of any length are taken whole.  Empty tables
give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import fits, materialize, met

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
HELD = 0.75
REWEIGHT = 0.975
REJECT = 1e-3
LEAST_GROUP = 100
MOST_STEPS = 30
STEPS_A_UNIT = 256

#: Least standard deviation of each statistic, in the statistics' own units;
#: keeps shares that are nearly always 0 from making every other value odd.
FLOORS = {"log_words": 0.25, "log_word_chars": 0.1, "symbol_share": 0.04, "line_share": 0.1, "repeat_share": 0.08, "capital_share": 0.04}
STATISTICS = tuple(FLOORS)
_P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]

#: Columns of an estimate: its centre and the upper half of its precision.
_CENTER = [f"m{i}" for i in range(_P)]
ESTIMATE = [*_CENTER, *(f"p{i}{j}" for i, j in _PAIRS)]

_WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur at least twice."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n"))
        return F.aggregate(places, start, step)["n"]

    def few(hashes: Column, twice: Column) -> Column:
        """Places of windows that are among a few repeated ones."""
        return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())

    def many(hashes: Column) -> Column:
        """The same by sorting windows with their places."""

        def marked(order: Column) -> Column:
            def like(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))

            return F.transform(order, lambda x, k: F.when(like(x, k - 1) | like(x, k + 1), x["i"]))

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.sort_array(F.filter(_let(ordered, marked), lambda i: i.isNotNull()))

    def places(hashes: Column) -> Column:
        def repeats(ordered: Column) -> Column:
            return F.array_distinct(F.filter(F.transform(ordered, lambda h, i: F.when((i > 0) & (F.get(ordered, i - 1) == h), h)), lambda h: h.isNotNull()))

        return _let(_let(F.sort_array(hashes), repeats), lambda twice: F.when(F.size(twice) <= 48, few(hashes, twice)).otherwise(many(hashes)))

    def windows(ids: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ids) - 3), lambda i: F.xxhash64(F.get(ids, i), F.get(ids, i + 1), F.get(ids, i + 2)))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(places(h))).otherwise(F.lit(0)))

    ids = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(ids, windows)).cast("bigint")


def base_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\f\r", "    "))) > 0)
    capitals = F.size(F.split(text, "[A-ZÀ-Þ]")) - 1

    def count(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def duplicate(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    found = documents.select("doc_id", "lang", "source", _let(words, count).alias("w"), _let(lines, duplicate).alias("l"), (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("bigint").alias("n_symbols"), capitals.cast("bigint").alias("n_capitals"))
    return found.select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols", "n_capitals")


def vector(base: DataFrame) -> DataFrame:
    """The base counts with the transformed statistics and base_failed."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return base.select(
        "*",
        failed.alias("base_failed"),
        F.log(words.cast("double")).alias("log_words"),
        F.log(chars / words).alias("log_word_chars"),
        F.sqrt(F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        F.sqrt(F.col("n_capitals") / chars).alias("capital_share"),
    )


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def inverse(matrix: Column, size: int) -> Column:
    """Inverse of a positive definite matrix in row order, by Gauss-Jordan
    sweeps, and the logarithm of its determinant (fields cells, log_det)."""

    def sweep(state: Column, k: Column) -> Column:
        a = state["cells"]
        pivot = F.get(a, k * (size + 1))

        def cell(m: Column) -> Column:
            i, j = F.floor(m / size).cast("int"), m % size
            row, column = F.get(a, k * size + j), F.get(a, i * size + k)
            return F.when((i == k) & (j == k), 1 / pivot).when(i == k, row / pivot).when(j == k, -column / pivot).otherwise(F.get(a, m) - column * row / pivot)

        return F.struct(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), cell).alias("cells"), (state["log_det"] + F.log(pivot)).alias("log_det"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.struct(matrix.alias("cells"), F.lit(0.0).alias("log_det")), sweep)


def distance() -> Column:
    """Squared Mahalanobis distance of a row's statistics from the estimate in its columns."""
    z = [F.col(c) - F.col(m) for c, m in zip(STATISTICS, _CENTER)]
    return _sum([z[i] * _sum([z[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0) for j in range(i, _P)]) for i in range(_P)])


def chi_square(share: float, degrees: int) -> float:
    """Quantile by the Wilson-Hilferty cube."""
    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(share) * a**0.5) ** 3


def concentration(share: float, degrees: int) -> float:
    """Factor that makes the covariance of the nearest share consistent."""
    cut, low, high = chi_square(share, degrees), 0.0, 1.0
    for _ in range(60):  # the chi-square distribution of two more degrees at the cut
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(max(middle, 1e-12), degrees + 2) < cut else (low, middle)
    return share / low


def _vector(columns: list[Column]) -> list[Column]:
    """Sums of the columns and of their products, for an aggregation."""
    return [F.array(*[F.sum(c) for c in columns]).alias("s"), F.array(*[F.sum(columns[i] * columns[j]) for i, j in _PAIRS]).alias("q")]


def _covariance(n: Column, s: Column, q: Column, factor: float = 1.0) -> list[Column]:
    """Covariance cells from sums, none of its variances under the floor."""
    mean = [F.get(s, F.lit(i)) / n for i in range(_P)]
    cells = []
    for i in range(_P):
        for j in range(_P):
            cell = (F.get(q, F.lit(_PAIRS.index((min(i, j), max(i, j))))) / n - mean[i] * mean[j]) * factor
            cells.append(F.greatest(cell, F.lit(FLOORS[STATISTICS[i]] ** 2)) if i == j else cell)
    return cells


def _estimate(keys: list[str], center: Column, scatter: Column, table: DataFrame) -> DataFrame:
    """keys, the columns of an estimate, scatter and log_det."""
    own = table.select(*keys, center.alias("center"), scatter.alias("scatter")).withColumn("i", inverse(F.col("scatter"), _P))
    means = [F.get("center", F.lit(i)).alias(c) for i, c in enumerate(_CENTER)]
    cells = [F.get("i.cells", F.lit(i * _P + j)).alias(f"p{i}{j}") for i, j in _PAIRS]
    return own.select(*keys, *means, *cells, "scatter", F.col("i.log_det").alias("log_det"))


def _fitted(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """The estimate of each group from its sums."""
    center = F.array(*[F.get("s", F.lit(i)) / F.col("n") for i in range(_P)])
    return _estimate(keys, center, F.array(*_covariance(F.col("n"), F.col("s"), F.col("q"), factor)), sums)


def _share_step(counted: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The least step of each group under or at which its share of rows lies."""
    order = Window.partitionBy(*keys).orderBy("step")
    so_far = counted.withColumns({"below": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return so_far.where(F.col("below") >= F.ceil(share * F.col("all"))).groupBy(*keys).agg(F.min("step").alias("step"))


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """group and the medians of the values, to a fine step, as an array."""
    steps = rows.select("group", F.posexplode(F.array(*[F.floor(v * (16 * STEPS_A_UNIT)) for v in values])).alias("place", "step"))
    found = _share_step(steps.groupBy("group", "place", "step").agg(F.count(F.lit(1)).alias("n")), ["group", "place"], 0.5)
    at = F.sort_array(F.collect_list(F.struct("place", "step")))
    return found.groupBy("group").agg(F.transform(at, lambda x: (x["step"] + 0.5) / (16 * STEPS_A_UNIT)).alias("medians"))


def with_groups(stats: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """``stats`` with the group that each document is judged in; null where
    that is too small."""
    by_source, by_language = _group("lang", "source"), _group("lang")
    named = stats.withColumn("by_source", by_source)
    sizes = named.where(~F.col("base_failed")).groupBy("by_source", by_language.alias("by_language")).agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "group-sizes")
    few = sizes.where(F.col("n") < least_group).groupBy("by_language").agg(F.sum("n").alias("pool"))
    rest = few.where(F.col("pool") < least_group).agg(F.sum("pool")).first()[0] or 0
    last = F.lit(0 if rest >= least_group else None).cast("bigint")
    placed = sizes.join(few, "by_language", "left").select("by_source", F.when(F.col("n") >= least_group, F.col("by_source")).when(F.col("pool") >= least_group, F.col("by_language")).otherwise(last).alias("group"))
    return met(named, placed, ["by_source"], fits(placed), "left").drop("by_source")


def _distances(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """Each vector under each estimate of its group, with the step of its distance."""
    placed = met(rows, now.select("group", "start", *ESTIMATE), ["group"], few)
    return placed.select("row", "group", "start", *STATISTICS, F.floor(F.log(distance() + 1e-9) * STEPS_A_UNIT).alias("step"))


def starts(rows: DataFrame) -> DataFrame:
    """group, start and the estimates of the three starts."""
    columns = [F.col(c) for c in STATISTICS]
    centers = materialize(_medians(rows, columns), "medians")
    few = fits(centers, items=_P)
    about = met(rows, centers, ["group"], few)
    spread = _medians(about.select("group", *[F.abs(c - F.get("medians", F.lit(i))).alias(n) for i, (c, n) in enumerate(zip(columns, STATISTICS))]), columns)
    scales = [F.greatest(1.4826 * F.get("spread", F.lit(i)), F.lit(floor)) for i, floor in enumerate(FLOORS.values())]
    scaled = centers.join(spread.withColumnRenamed("medians", "spread"), "group").select("group", F.col("medians").alias("center"), F.array(*scales).alias("scale"))
    scaled = materialize(scaled, "scales", done=[centers])
    z = met(rows, scaled, ["group"], few).select("group", *[((c - F.get("center", F.lit(i))) / F.get("scale", F.lit(i))).alias(n) for i, (c, n) in enumerate(zip(columns, STATISTICS))])
    length = F.greatest(F.sqrt(_sum([c * c for c in columns])), F.lit(1e-12))
    z = z.select("group", *STATISTICS, *[F.tanh(c).alias(f"t{i}") for i, c in enumerate(columns)], *[(c / length).alias(f"u{i}") for i, c in enumerate(columns)])
    squashed, directions = _vector([F.col(f"t{i}") for i in range(_P)]), _vector([F.col(f"u{i}") for i in range(_P)])
    sums = z.groupBy("group").agg(F.count(F.lit(1)).alias("n"), squashed[0], squashed[1], directions[1].alias("u"))
    sums = sums.join(scaled, "group")

    def scatter(cell) -> Column:
        own = []
        for i in range(_P):
            for j in range(_P):
                value = cell(i, j) * F.get("scale", F.lit(i)) * F.get("scale", F.lit(j))
                own.append(F.greatest(value, F.lit(FLOORS[STATISTICS[i]] ** 2)) if i == j else value)
        return F.array(*own)

    def pair(column: str, i: int, j: int) -> Column:
        return F.get(column, F.lit(_PAIRS.index((min(i, j), max(i, j))))) / F.col("n")

    # 0.394 is the variance of a squashed standard normal value, 1 / _P that of a direction's part
    kinds = [
        scatter(lambda i, j: F.lit(1.0 if i == j else 0.0)),
        scatter(lambda i, j: (pair("q", i, j) - F.get("s", F.lit(i)) * F.get("s", F.lit(j)) / (F.col("n") * F.col("n"))) / 0.394),
        scatter(lambda i, j: pair("u", i, j) * _P),
    ]
    each = sums.select("group", "center", F.posexplode(F.array(*kinds)).alias("start", "scatter"))
    return materialize(_estimate(["group", "start"], F.col("center"), F.col("scatter"), each), "estimates", done=[scaled])


def fit_groups(rows: DataFrame, held: float = HELD, most_steps: int = MOST_STEPS) -> DataFrame:
    """group and estimate of every group of the vectors."""
    columns, keys = [F.col(c) for c in STATISTICS], ["group", "start"]
    now = starts(rows).withColumns({"log_det": F.lit(float("inf")), "falls": F.lit(True)})
    few = fits(now, items=_P * _P)
    own = [*ESTIMATE, "scatter", "log_det"]
    for _ in range(most_steps):
        falling = now.where("falls")
        placed = _distances(rows, falling, few)
        cuts = _share_step(placed.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("n")), keys, held).withColumnRenamed("step", "cut")
        sums = met(placed, cuts, keys, few).where("step <= cut").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_vector(columns))
        new = _fitted(sums, keys, 1.0)
        both = now.join(new.select(*keys, F.struct(*own).alias("new")), keys, "left")
        falls = F.coalesce(F.col("new.log_det") < F.col("log_det") - 1e-6, F.lit(False))
        chosen = both.select(*keys, falls.alias("falls"), *[F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in own])
        now = materialize(chosen, "estimates", done=[now])
        if not now.agg(F.max("falls")).first()[0]:
            break
    best = now.groupBy("group").agg(F.min(F.struct(F.round("log_det", 6).alias("log_det"), "start")).alias("best")).select("group", "best.start")
    # the covariance of the nearest share, made consistent
    factor = concentration(held, _P)
    cells = [F.get("scatter", F.lit(m)) * factor for m in range(_P * _P)]
    cells = [F.greatest(c, F.lit(FLOORS[STATISTICS[m // _P]] ** 2)) if m % (_P + 1) == 0 else c for m, c in enumerate(cells)]
    raw = materialize(_estimate(keys, F.array(*_CENTER), F.array(*cells), now.join(best, keys)), "estimates", done=[now])
    kept = _distances(rows, raw, few).where(F.col("step") <= math.floor(math.log(chi_square(REWEIGHT, _P)) * STEPS_A_UNIT))
    sums = kept.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *_vector(columns))
    return materialize(_fitted(sums, ["group"], concentration(REWEIGHT, _P)).select("group", *ESTIMATE), "estimates", done=[raw])


def _group(*names: str) -> Column:
    """A number for a group: the hash of its names, null ones told apart."""
    return F.xxhash64(F.lit(len(names)), *[F.coalesce(F.concat(F.lit("="), n), F.lit("")) for n in names])


def judge(documents: DataFrame, reject: float = REJECT, least_group: int = LEAST_GROUP) -> DataFrame:
    """doc_id, counts, base_failed, distance and kept of every document."""
    stats = materialize(vector(base_statistics(documents)), "statistics")
    # a number of its own lets equal rows of a group be dealt apart
    numbered = with_groups(stats, least_group).drop("lang", "source").withColumn("row", F.monotonically_increasing_id())
    grouped = materialize(numbered, "statistics", done=[stats])
    rows = grouped.where(~F.col("base_failed") & F.col("group").isNotNull()).select("row", "group", *STATISTICS)
    fitted = fit_groups(rows)
    out = met(grouped, fitted, ["group"], fits(fitted), "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_square(1 - reject, _P))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
