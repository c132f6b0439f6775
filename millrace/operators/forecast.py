"""Trends, scenario paths, forests."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_trend(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Slope, intercept, fit and rows of a straight line per group."""
    t, v = F.col(time).cast("double"), F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept"), F.regr_r2(v, t).alias("r2"), F.regr_count(v, t).alias("n"))


def project(trend: DataFrame, time: str, years: tuple[int, int]) -> DataFrame:
    """the trend's values for future periods, not bounded."""
    return trend.withColumn(time, F.explode(F.sequence(F.lit(years[0]), F.lit(years[1])))).withColumn("projected", F.col("intercept") + F.col("slope") * F.col(time))


def scenarios(grid: DataFrame, rules: dict[str, dict[str, Column]]) -> DataFrame:
    """Each scenario's factors applied to the named columns; one row a grid row and scenario."""
    packed = F.array(*[F.struct(F.lit(name).alias("scenario"), *[F.coalesce((F.col(c) * f).cast("double"), F.col(c).cast("double")).alias(f"s_{c}") for c, f in factors.items()]) for name, factors in rules.items()])
    return grid.select("*", F.inline(packed))


def wide(scenario_rows: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """One row a key with each scenario's value as a column of its name."""
    return scenario_rows.groupBy(*keys).agg(*[F.max(F.when(F.col("scenario") == n, F.col(value))).alias(n) for n in names])


def merged_scores(talk: DataFrame, action: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Two scores side by side, and whether an entity has both, talk only, or is a new reporter."""
    both = talk.withColumn("_l", F.lit(1)).join(action.withColumn("_r", F.lit(1)), key, "full_outer")
    kind = F.when(F.col("_r").isNull(), "talk_only").when(F.col("_l").isNull(), "new_reporter").otherwise("both")
    return both.select(key, a, b, kind.alias("reported"))


def forest(train: DataFrame, test: DataFrame, label: str, numeric: list[str], categorical: list[str], trees: int = 500, depth: int = 30, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A random forest over one-hot and numeric features; metrics and importances.

    Categories unknown in training go to a slot of their own.
    """
    indexed = [f"{c}_ix" for c in categorical]
    stages = [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_oh" for c in categorical], dropLast=False, handleInvalid="keep")] if categorical else []
    inputs = [*[f"{c}_oh" for c in categorical], *numeric]
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)
    found = model.transform(test)
    judge = lambda m: RegressionEvaluator(labelCol=label, metricName=m).evaluate(found)
    metrics = train.sparkSession.createDataFrame([(m, float(judge(m))) for m in ("r2", "mae", "rmse")], "metric string, value double")
    attrs = found.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    weights = model.stages[-1].featureImportances
    table = train.sparkSession.createDataFrame([(names.get(i, str(i)), float(weights[i])) for i in range(weights.size)], "feature string, importance double")
    return metrics, table.orderBy(F.desc("importance"), "feature")


def period_average(df: DataFrame, keys: list[str], value: str, base_key: str, base) -> DataFrame:
    """means by keys and percentage change to the base period's mean of the same other keys."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    rest = [k for k in keys if k != base_key]
    start = means.filter(F.col(base_key) == base).select(*rest, F.col("mean").alias("_base"))
    joined = means.join(start, rest, "left") if rest else means.join(F.broadcast(start), how="left")  # one row
    return joined.withColumn("pct_change", (F.try_divide(F.col("mean"), F.col("_base")) - 1) * 100).drop("_base")


def tween(pairs: DataFrame, first: str, last: str, frames: int) -> DataFrame:
    """Eased positions between two values for each frame 0..frames."""
    from millrace.functions.scalars import smoothstep

    t = F.col("frame") / F.lit(float(frames))
    moved = pairs.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames))))
    return moved.withColumn("position", F.col(first) + (F.col(last) - F.col(first)) * smoothstep(t))
