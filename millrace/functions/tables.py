"""Functions for SQL text: a table function from a text to its chunks, an aggregate for the commonest value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


@udtf(returnType=T.StructType([T.StructField("position", T.IntegerType()), T.StructField("chunk", T.StringType())]))
class Chunks:
    """``chunks(text, size, overlap)``: windows of ``size`` characters, each ``overlap`` after the end of the one before; none of null or empty text."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        step = (size or 0) - (overlap or 0)
        if text and step > 0:
            for position, first in enumerate(range(0, len(text), step)):
                yield position, text[first : first + size]


@F.pandas_udf(T.StringType())
def heaviest(value: pd.Series, n: pd.Series) -> str:
    """The value with the greatest total of n, the least on ties; null where all values are."""
    total = n.groupby(value).sum()
    return None if total.empty else min(total.index[total == total.max()])


def register(spark: SparkSession) -> None:
    """Make ``chunks`` and ``heaviest`` known to SQL."""
    spark.udtf.register("chunks", Chunks)
    spark.udf.register("heaviest", heaviest)


def commonest(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The commonest value of each group; values are counted first, so that a group's task gets a row a value."""
    counts = df.groupBy(*keys, value.cast("string").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(heaviest("_value", "_n").alias("commonest"))
