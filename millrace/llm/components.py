"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import cut

#: A table is broadcast only if it has this many rows at most (16 bytes each).
BROADCAST_ROWS = 2_000_000


def join_checked(rows: DataFrame, small: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table of (key, a few numbers): broadcast if its counted rows allow, else shuffled."""
    return rows.join(F.broadcast(small) if small.count() <= most else small, key, how)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label: the least node that links reach, for each node of ``links`` (columns a, b).

    Each round a node takes the least label among its own and its neighbours', then the label of
    that label (pointer jumping), so long chains shorten quickly; rounds go on until nothing
    changes. Every round is checkpointed. A hub's links are split by the join's skew handling and
    summed before they are shuffled, so no task holds all neighbours of a node.
    """
    both = links.select("a", "b").filter("a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # the first round needs no labels: the least neighbour
    labels = both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label"))
    labels = cut(labels)
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    for _ in range(most_rounds):
        if total is None:
            return labels
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        taken = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        labels = cut(taken.join(jump, "label", "left").select("node", F.least("label", F.coalesce("_next", "label")).alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
