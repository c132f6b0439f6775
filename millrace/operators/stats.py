"""Grouped statistics, shares, matrices and data-quality profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import settled


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL is one."""
    other = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    test = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return a.join(other, test, how).drop(*[f"_k_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) of each group, however few the groups: a column for each share.

    Equal values are counted before they are shuffled; the counts are sorted in ranges, so a group's values
    lie in many tasks; from the tasks' sums follows in which range and at which place a rank is.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = settled(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    per = ranged.groupBy(*keys, "_p").agg(F.sum("_n").alias("_c"))  # a row for each group and task
    order = Window.partitionBy(*keys).orderBy("_p")
    placed = per.select(*keys, "_p", (F.sum("_c").over(order) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_all"))
    inside = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    at = _same(ranged, placed, [*keys, "_p"]).withColumn("_first", first)
    value_at = lambda rank: F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n")), F.col("_v")))
    rank = lambda q: (F.col("_all") - 1) * F.lit(float(q))
    ends = at.groupBy(*keys).agg(F.max("_all").alias("_all"), *[value_at(f(rank(q))).alias(f"_{s}_{n}") for n, q in shares.items() for s, f in (("lo", F.floor), ("hi", F.ceil))])
    return ends.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (rank(q) - F.floor(rank(q)))).alias(n) for n, q in shares.items()])


def group_stats(df: DataFrame, keys: list[str], value: str, digits: int = 3) -> DataFrame:
    """A1: count, mean, median, sample deviation, minimum and maximum; rounded half to even."""
    r = lambda c: F.bround(c, digits).alias(c)
    per = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    both = _same(per, quantiles(df, keys, value, {"median": 0.5}), keys, "left")
    return both.select(*keys, "count", *[r(c) for c in ("mean", "median", "std", "min", "max")])


def nunique_count(df: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Distinct entities and rows of each group."""
    return df.groupBy(*keys).agg(F.countDistinct(entity).alias("n_entities"), F.count(F.lit(1)).alias("n_rows"))


def first_last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Bounds, mean, deviation, first and last value by ``order``, and their difference. NULL values are skipped."""
    at = F.when(F.col(value).isNotNull(), F.col(order))
    first, last = F.min_by(value, at), F.max_by(value, at)
    return df.groupBy(*keys).agg(F.min(order).alias("t_min"), F.max(order).alias("t_max"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg"), F.stddev_samp(value).alias("std"), first.alias("first"), last.alias("last"), (last - first).alias("trend"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean weighted by confidence; all weights are 1 in groups whose weights sum to 0."""
    total = F.sum(F.coalesce(F.col(weight), F.lit(0.0)))
    return df.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(value) * F.coalesce(F.col(weight), F.lit(0.0))) / total).otherwise(F.avg(value)).alias("weighted_mean"))


def label_share(df: DataFrame, keys: list[str], label: str, values: list[str], weight: str) -> DataFrame:
    """Weighted percentage of each label."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(*[F.coalesce(F.try_divide(F.sum(F.when(F.col(label) == v, F.col(weight)).otherwise(0.0)), total) * 100.0, F.lit(0.0)).alias(f"{v}_pct") for v in values])


def label_distribution(df: DataFrame, label: str, score: str) -> DataFrame:
    """Count, share, and score statistics of each label; shares come from summed counts."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"))
    per = _same(per, quantiles(df, [label], score, {"median": 0.5}), [label], "left")
    return per.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def missingness(df: DataFrame) -> DataFrame:
    """Columns with missing values, their count and percentage, from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("n_missing")) for c in df.columns])
    rows = one.select("_n", F.inline(cells))
    return rows.filter("n_missing > 0").select("column_name", "n_missing", (100.0 * F.col("n_missing") / F.col("_n")).alias("pct_missing"))


def profile(df: DataFrame) -> DataFrame:
    """Type, rows, missing and distinct values of each column."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"c_{c}") for c in df.columns], *[F.countDistinct(c).alias(f"d_{c}") for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.col("_n").alias("n_rows"), (F.col("_n") - F.col(f"c_{c}")).alias("n_missing"), F.col(f"d_{c}").alias("n_distinct")) for c, t in df.dtypes])
    return one.select(F.inline(cells))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often.

    Keys are counted by a 128-bit hash, so long texts are not shuffled; only those found twice are fetched.
    """
    hashed = df.select(*keys, F.xxhash64(*keys).alias("_a"), F.xxhash64(F.lit(1), *keys).alias("_b"))
    twice = hashed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hashed.join(twice, ["_a", "_b"]).groupBy("_a", "_b").agg(*[F.first(k).alias(k) for k in keys], F.first("n").alias("n")).select(*keys, "n")


def range_checks(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Minimum, maximum and number of values out of range of each column."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in rules for n, f in (("lo", F.min), ("hi", F.max))], *[F.count_if(~F.col(c).between(*map(F.lit, b))).alias(f"bad_{c}") for c, b in rules.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"lo_{c}").cast("double").alias("min"), F.col(f"hi_{c}").cast("double").alias("max"), F.col(f"bad_{c}").alias("n_outside")) for c in rules])
    return one.select(F.inline(cells))


def tolerance_bands(df: DataFrame, stored: str, again: Column, bands: tuple[float, ...] = (0.001, 0.05, 0.15)) -> DataFrame:
    """How many stored values lie within each relative distance of the recomputed ones."""
    gap = F.abs(F.try_divide(F.col(stored) - again, again))
    return df.agg(F.count(gap).alias("n"), *[F.count_if(gap <= b).alias(f"within_{k}") for k, b in enumerate(bands)], F.count_if(gap > bands[-1]).alias("beyond"))


def stability(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Deviation, variation, largest step, slope over position, range of entities with two rows or more."""
    w = Window.partitionBy(entity).orderBy(time)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_step", F.abs(F.col(value) - F.lag(value).over(w))).withColumn("_at", (F.row_number().over(w) - 1).cast("double"))
    out = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("std"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"), F.max("_step").alias("max_step"), F.regr_slope(value, "_at").alias("slope"), (F.max(value) - F.min(value)).alias("range"))
    return out.filter("n > 1")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, quartiles (linear) and bounds of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_x")) for c in columns])
    rows = df.select(F.inline(cells))
    one = rows.groupBy("column_name").agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    return one.join(quantiles(rows, ["column_name"], "_x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "column_name", "left")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of each pair of columns, pairwise complete, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])))


def pivot_counts(df: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Rows by known values of a column, missing as 0."""
    return df.groupBy(*rows).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def matrix_with_totals(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by row and column with TOTAL for either, from one cube."""
    cube = df.cube(row, column).agg(F.count(F.lit(1)).alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    name = lambda c, g: F.when(F.col(g) == 1, F.lit("TOTAL")).otherwise(F.col(c).cast("string")).alias(c)
    return cube.select(name(row, "_r"), name(column, "_c"), "n")


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each group, the least on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("majority"), F.max("_n").alias("votes"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """O2, O3: the first n rows; the last of ``order`` should be unique."""
    return df.orderBy(*order).limit(n)


def distinct_first(df: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """The first row by ``order``, which no two rows share, of each case-folded, trimmed text within ``keys``.

    Texts are compared by a 128-bit hash; none is a shuffle key.
    """
    folded = F.lower(F.trim(text))
    marked = df.withColumn("_o", F.struct(*order)).withColumn("_a", F.xxhash64(*keys, folded)).withColumn("_b", F.xxhash64(F.lit(1), *keys, folded))
    first = marked.groupBy("_a", "_b").agg(F.min("_o").alias("_o"))
    return marked.join(first, ["_a", "_b", "_o"], "left_semi").drop("_a", "_b", "_o")


def composite(parts: dict[str, float]) -> Column:
    """Weighted sum of scores as a sort key, NULL as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()])
