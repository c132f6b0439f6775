"""Operators over entity-time panels: lags, alignment, completeness, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def complete_entities(df: DataFrame, entity: str, value: str, least: int) -> DataFrame:
    """Rows of entities with ``least`` non-null values or more, by a semi join on counts.

    The counts are summed before they are shuffled; a hot entity stays spread.
    """
    good = df.groupBy(entity).agg(F.count(value).alias("_n")).filter(F.col("_n") >= least).select(entity)
    return df.join(good, entity, "left_semi")


def delta(df: DataFrame, entity: str, time: str, value: str, name: str = "delta") -> DataFrame:
    """Difference to the row before; gaps in time are not filled."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(entity).orderBy(time)))


def lags(df: DataFrame, entity: str, time: str, columns: list[str], n: int) -> DataFrame:
    """Lags 1 to n of several columns, over one window."""
    w = Window.partitionBy(entity).orderBy(time)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in columns for k in range(1, n + 1)])


def latest(df: DataFrame, entity: str, time: str) -> DataFrame:
    """The last row of each entity, by an aggregate that sums up before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(entity).agg(F.max_by(row, time).alias("_r")).select("_r.*")


def chrono_split(df: DataFrame, entity: str, time: str, share: float = 0.7) -> DataFrame:
    """``is_train`` by time: of n <= 3 rows all but the last, else the first floor(share * n)."""
    w = Window.partitionBy(entity)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(time))
    return df.withColumn("is_train", F.when(n <= 3, k < n).otherwise(k <= F.floor(F.lit(share) * n)))


def pct_vs_base(df: DataFrame, entity: str, time: str, value: str, base: int) -> DataFrame:
    """Percentage change against the base period, NULL for entities without it."""
    at = F.max(F.when(F.col(time) == base, F.col(value))).over(Window.partitionBy(entity))
    return df.withColumn("pct_vs_base", (F.try_divide(F.col(value), at) - 1.0) * 100.0)


def align_level(forecast: DataFrame, history: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Shift each entity's forecast so that its first value is the last actual one."""
    last = history.groupBy(entity).agg(F.max_by(value, time).alias("_last"))
    first = F.first(value).over(Window.partitionBy(entity).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return forecast.withColumn("_first", first).join(last, entity, "left").withColumn("aligned", F.col(value) - (F.col("_first") - F.coalesce("_last", "_first"))).drop("_first", "_last")


def ratio_to_max(df: DataFrame, value: str) -> DataFrame:
    """Value over the largest value."""
    top = df.agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top)).withColumn("ratio_to_max", F.try_divide(F.col(value), F.col("_top"))).drop("_top")  # one row


def best_available(df: DataFrame, entity: str, a: str, b: str) -> DataFrame:
    """Of two measures the one that an entity has more often, the first on ties."""
    per = df.groupBy(entity).agg((F.count(a) >= F.count(b)).alias("_first"))
    return df.join(per, entity).withColumn("method", F.when(F.col("_first"), F.lit(a)).otherwise(F.lit(b))).withColumn("best", F.when(F.col("_first"), F.col(a)).otherwise(F.col(b))).drop("_first")


def future_grid(df: DataFrame, entity: str, time: str, until: int) -> DataFrame:
    """The last row of each entity repeated for the periods after it up to ``until``."""
    last = latest(df, entity, time).filter(F.col(time) < until)
    return last.withColumn(time, F.explode(F.sequence(F.col(time) + 1, F.lit(until))))


def common_periods(a: DataFrame, b: DataFrame, time: str) -> DataFrame:
    """Periods that both frames have, by one grouping whose tasks first keep a row a period; INTERSECT would shuffle each row to its period's task."""
    sides = a.select(time, F.lit(0).alias("_side")).union(b.select(time, F.lit(1).alias("_side")))
    return sides.groupBy(time).agg(F.min("_side").alias("_least"), F.max("_side").alias("_most")).filter("_least < _most").select(time)


def only_left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a without a match."""
    return a.join(b.select(*keys), keys, "left_anti")


def require(condition: Column, name: str) -> Column:
    """A 0/1 indicator of a condition, 0 for NULL (P20)."""
    return F.coalesce(condition, F.lit(False)).cast("int").alias(name)
