"""Exact vector retrieval: filtered top-k, diversity re-ranking, unions, overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import dot


def topk(queries: DataFrame, items: DataFrame, k: int, on: list[str]) -> DataFrame:
    """The k nearest items of each query within equal ``on`` columns; ties by item_id.

    ``queries`` (query_id, q, on...) is matched by equi-join on the metadata,
    so items outside the filter are never scored. The rank filter becomes a group limit that each
    task applies before the shuffle, so k rows a query and task are moved.
    """
    hits = items.join(queries, on).select("query_id", "item_id", dot(F.col("embedding"), F.col("q")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def build_index(items: DataFrame, path: str, on: str) -> None:
    """A flat index (item_id, embedding) on disk, one folder a value of its filter column."""
    items.repartition(on).write.mode("overwrite").partitionBy(on).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The index; a filter or join on its folder column reads only those folders."""
    return spark.read.parquet(path)


def mmr_select(query: np.ndarray, vectors: np.ndarray, k: int, lam: float) -> list[int]:
    """Greedy picks by lam * sim(q, d) - (1 - lam) * max sim(d, picked); the earlier row on ties."""
    near, picked = vectors @ query, []
    apart = np.zeros(len(vectors))
    left = np.ones(len(vectors), bool)
    for _ in range(min(k, len(vectors))):
        value = np.where(left, lam * near - (1 - lam) * apart, -np.inf)
        best = int(value.argmax())
        picked.append(best)
        left[best] = False
        sims = vectors @ vectors[best]
        apart = sims if len(picked) == 1 else np.maximum(apart, sims)
    return picked


def mmr(queries: DataFrame, items: DataFrame, k: int, on: list[str], fetch_k: int = 50, lam: float = 0.2) -> DataFrame:
    """Diversity re-ranking of the fetch_k nearest items of each query (filtered first).

    A group handed to Python has fetch_k rows at most.
    """
    near = topk(queries, items, fetch_k, on)
    rows = near.join(items.select("item_id", "embedding"), "item_id").join(queries.select("query_id", "q"), "query_id")

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank"], ignore_index=True)
        order = mmr_select(np.asarray(part["q"].iloc[0], float), np.stack(part["embedding"].to_numpy()).astype(float), k, lam)
        return pd.DataFrame({"query_id": part["query_id"].iloc[order], "rank": range(1, len(order) + 1), "item_id": part["item_id"].iloc[order]})

    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {dict(queries.dtypes)['query_id']}, rank int, item_id {dict(items.dtypes)['item_id']}")


def union_first(hits: DataFrame, group: str, most: int) -> DataFrame:
    """One row an item within ``group``, its first hit by (query_id, rank), the first ``most`` of them."""
    first = hits.groupBy(group, "item_id").agg(F.min(F.struct("query_id", "rank")).alias("_h"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_h", "item_id"))  # kept by group limits in the tasks before the shuffle
    return first.withColumn("place", place).filter(F.col("place") <= most).select(group, "place", "item_id", F.col("_h.query_id").alias("query_id"))


def overlap(a: DataFrame, b: DataFrame, query: str = "query_id") -> DataFrame:
    """How many items two result sets of a query share, and the Jaccard share."""
    sets = lambda df, n: df.groupBy(query).agg(F.collect_set("item_id").alias(n))
    both = sets(a, "_a").join(sets(b, "_b"), query)
    return both.select(query, F.size(F.array_intersect("_a", "_b")).cast("long").alias("n_shared"), (F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))).alias("jaccard"))
