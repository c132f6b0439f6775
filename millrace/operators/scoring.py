"""Composite scores: performance, trend, data quality, renewables, totals, periods, talk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import RENEWABLE_BANDS, SCORE_BANDS, band, clamp


@dataclass(frozen=True)
class ScoreRules:
    """Bounds and full marks of the parts."""

    benchmark: float = 2.0
    trend_threshold: float = 0.02
    least_r2: float = 0.5
    full: float = 30.0


def performance(value, rules: ScoreRules = ScoreRules()):
    """Full marks at 0, none at the benchmark or above; 0 without a value."""
    return F.coalesce(clamp(rules.full * (1.0 - value / rules.benchmark), 0.0, rules.full), F.lit(0.0))


def trend(slope, r2, n, rules: ScoreRules = ScoreRules()):
    """C4: marks for a falling trend that fits well; 0 for rising or flat, poor fit, or one point."""
    marks = rules.full * F.least(F.lit(1.0), F.abs(slope) / rules.trend_threshold)
    return F.when((n >= 2) & (slope < 0) & (r2 >= rules.least_r2), marks).otherwise(F.lit(0.0))


def data_quality(n, share1, share2, share_production):
    """Marks for length, completeness of two measures, and production data."""
    length = F.when(n >= 10, 7).when(n >= 7, 5).when(n >= 4, 3).otherwise(1)
    part = lambda s: F.when(s >= 0.9, 3).when(s >= 0.7, 2).when(s >= 0.5, 1).otherwise(0)
    return (length + part(share1) + part(share2) + F.when(share_production >= 0.9, 2).when(share_production >= 0.7, 1).otherwise(0)).cast("double")


def renewable(share, excluded):
    """Bands of the renewable share; 0 where excluded or missing."""
    return F.when(F.coalesce(excluded, F.lit(False)) | share.isNull(), F.lit(0.0)).otherwise(band(share, RENEWABLE_BANDS, 0.0))


def total_and_band(df: DataFrame, parts: list[str]) -> DataFrame:
    """Sum of the parts and its band."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.withColumn("total_score", total).withColumn("category", band(F.col("total_score"), SCORE_BANDS, "WEAK"))


def talk_score(climate_pct, specificity, commitment, weights=(0.2, 0.4, 0.4)):
    """Weighted mix of how much, how specific and how committed, from 0 to 100."""
    return (climate_pct / 100.0 * weights[0] + specificity * weights[1] + commitment * weights[2]) * 100.0


def period_scores(df: DataFrame, entity: str, time: str, value: str, split: int, least: int = 3) -> DataFrame:
    """Per entity and period the trend and its score; too few rows give a reason instead.

    The second period's trend runs over the whole history, as the defaults of the method have it.
    """
    early = F.col(time) <= split
    cond = lambda c, x: F.when(c, F.col(x).cast("double"))
    slope = lambda c: F.regr_slope(cond(c, value), cond(c, time))
    r2 = lambda c: F.regr_r2(cond(c, value), cond(c, time))
    every = F.lit(True)
    per = df.filter(F.col(value).isNotNull()).groupBy(entity).agg(F.count_if(early).alias("n_pre"), F.count_if(~early).alias("n_post"), slope(early).alias("slope_pre"), r2(early).alias("r2_pre"), slope(every).alias("slope_post"), r2(every).alias("r2_post"), F.avg(cond(early, value)).alias("mean_pre"), F.avg(cond(~early, value)).alias("mean_post"))
    pack = lambda p: F.struct(F.lit(p).alias("period"), F.col(f"n_{p}").alias("n_years"), F.col(f"mean_{p}").alias("mean"), F.col(f"slope_{p}").alias("slope"), F.col(f"r2_{p}").alias("r2"))
    rows = per.select(entity, F.inline(F.array(pack("pre"), pack("post"))))
    enough = F.col("n_years") >= least
    keep = lambda c: F.when(enough, c)
    return rows.select(entity, "period", "n_years", keep(F.col("mean")).alias("mean"), keep(F.col("slope")).alias("slope"), keep(performance(F.col("mean"))).alias("performance_score"), keep(trend(F.col("slope"), F.col("r2"), F.col("n_years"))).alias("trend_score"), F.when(~enough, F.lit("too few years")).alias("skip_reason"))


def compare_periods(scores: DataFrame, entity: str, value: str = "trend_score") -> DataFrame:
    """Both periods side by side and the change, NULL where either is missing."""
    wide = scores.groupBy(entity).pivot("period", ["pre", "post"]).agg(F.max(value))
    return wide.select(entity, F.col("pre").alias("pre_total"), F.col("post").alias("post_total"), (F.col("post") - F.col("pre")).alias("change"))
