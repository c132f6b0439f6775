"""Row filters, renames, indicators and alignments of whole frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def text_filter(df: DataFrame, column: str, pattern: str, negate: bool = False) -> DataFrame:
    """Rows whose text matches a pattern in any case, or with ``negate`` all others; null text never matches."""
    hit = F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))
    return df.filter(~hit if negate else hit)


def positive(df: DataFrame, *columns: str) -> DataFrame:
    """P5: rows in which all columns are there and above zero."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) > 0) for c in columns]))


def has_label(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Rows whose lower-cased label is one of ``labels``."""
    return df.filter(F.lower(column).isin([x.lower() for x in labels]))


def by_label(df: DataFrame, columns: dict[str, str], kind: str | None = None, label: str | None = None) -> DataFrame:
    """Rows with a label in the column that stands for ``kind``; all rows if either is not given."""
    if kind is None or label is None:
        return df
    if kind not in columns:
        raise ValueError(f"unknown kind {kind!r}, not one of {sorted(columns)}")
    return df.filter(F.lower(columns[kind]) == label.lower())


def before_year(df: DataFrame, year: str, limit: int) -> DataFrame:
    """P10: rows before a year; a null year is kept."""
    return df.filter(F.col(year).isNull() | (F.col(year) < limit))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names; names that are not there are skipped."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def flattened(df: DataFrame, keys: list[str], values: dict[str, list[str]]) -> DataFrame:
    """Several aggregates of several columns as ``column_aggregate``."""
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    return df.groupBy(*keys).agg(*[kinds[k](c).alias(f"{c}_{k}") for c, wanted in values.items() for k in wanted])


def without_suffix(df: DataFrame, pattern: str) -> DataFrame:
    """Without the columns whose name matches a pattern."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def safe_name(column: str, most: int = 500) -> Column:
    """P25: the first characters of a text, and marks that no file name may hold as underscores."""
    return F.translate(F.substring(column, 1, most), '/\\:*?"<>| ', "__________")


def joined_ints(*columns: str) -> Column:
    """Rounded numbers joined by a slash."""
    return F.concat_ws("/", *[F.round(F.col(c), 0).cast("int").cast("string") for c in columns])


def with_origin(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The full outer join of two key sets with where each key is from."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    origin = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, origin.alias("origin"))


def aligned(frames: list[DataFrame], key: str) -> DataFrame:
    """Frames beside each other, matched by their index column; indices of any of them stay."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames)


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place in an order, for frames that fit one sort."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def table_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and rows that repeat an earlier one.

    Rows are told apart by a 128-bit hash that is summed before it is shuffled.
    """
    key = [F.xxhash64(*df.columns).alias("_a"), F.xxhash64(F.lit(1), *df.columns).alias("_b")]
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def split_means(df: DataFrame, keys: list[str], value: str, subset: Column) -> DataFrame:
    """A10: the mean of a subset and of the rest, and their difference."""
    inside, rest = F.avg(F.when(subset, F.col(value))), F.avg(F.when(~subset, F.col(value)))
    return df.groupBy(*keys).agg(inside.alias("mean_subset"), rest.alias("mean_rest"), (inside - rest).alias("difference"))


def first_name(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The first name of each key that is not empty, by ``order``; the key itself without any."""
    good = F.when(F.length(F.trim(name)) > 0, F.col(order))
    return df.groupBy(key).agg(F.coalesce(F.min_by(name, good), F.col(key).cast("string")).alias("name"))


def resume_state(todo: DataFrame, done: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Each item with its state: done, failed (to be tried again) or pending."""
    a, b = done.select(*keys).distinct().withColumn("_d", F.lit(1)), failed.select(*keys).distinct().withColumn("_f", F.lit(1))
    state = F.when(F.col("_d").isNotNull(), "done").when(F.col("_f").isNotNull(), "failed").otherwise("pending")
    return todo.join(a, keys, "left").join(b, keys, "left").withColumn("state", state).drop("_d", "_f")
