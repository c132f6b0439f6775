"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.components import join_checked
from millrace.llm.shared import cut, row_word_count

#: Weights dealt to the sources in turn.
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words.
SHARE = 1.5
#: No source, and no document, is used more often than this.
MOST = 2.0
#: Rows of one flight, about; a group larger than this is dealt to several flights.
BLOCK = 512
#: Rows that a flight leaves out at its end, for the landing to choose among (two more may stay open).
SPARE = 12
#: How many flights' leftovers meet in the next one.
FAN_IN = 32
_EPS = 1e-9


def _ranked(per: DataFrame) -> DataFrame:
    """``per`` with the place of its ``source`` in code-point order, null last; sorted in ranges, no task has all."""
    ranges = cut(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    sizes, before, starts = sorted(map(tuple, ranges.groupBy("_part").count().collect())), 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    first = per.sparkSession.createDataFrame(starts, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.join(F.broadcast(first), "_part").withColumn("_rank", F.col("_before") + own).drop("_part", "_before")  # a row a task


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: its size, row count and target, by water filling.

    Sources in code-point order, null last, get the weights in turn and split ``share`` of all
    words in proportion, up to ``most`` times their own words; what is above goes to the others by weight,
    until none is above. Targets are ``min(most * size, level * weight)`` with one level for all,
    which rises round by round as sources reach their bound. The table has a row per source; a round sends one row to the driver.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    ranked = _ranked(cut(per)).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = cut(ranked.withColumn("_bound", F.col("source_size") * F.lit(float(most))))
    level, total = 0.0, min(share, most) * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("_bound") < level * F.col("_w")
        bound, weight, n = ranked.agg(F.sum(F.when(full, F.col("_bound")).otherwise(0.0)), F.sum(F.when(~full, F.col("_w")).otherwise(0.0)), F.sum(full.cast("int"))).first()
        new = (total - bound) / weight if weight else float("inf")
        if new <= level or not weight:
            break
        level = new
    target = F.least(F.col("_bound"), F.lit(level) * F.col("_w"))
    return ranked.select("source", "source_size", "source_rows", target.cast("double").alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, u: np.ndarray, spare: int = 0) -> np.ndarray:
    """Cube-method flight: probabilities become 0 or 1 but for two rows, and the last ``spare`` open rows.

    Three open rows at a time move along the null vector of the two constraints (rows, words) until one is 0
    or 1. The sums of ``pi`` and of ``pi * size`` do not change; the expectation of each entry is its
    start value over ``u`` uniform. ``u`` has a number for each row.
    """
    x, s = pi.astype(float).tolist(), size.astype(float).tolist()
    x = [0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v for v in x]
    is_open = [i for i, v in enumerate(x) if 0 < v < 1]
    active: list[int] = []
    for i in is_open[: max(0, len(is_open) - spare)]:
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        v = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        top = max(abs(w) for w in v)
        v = tuple(w / top for w in v) if top else (1.0, -1.0, 0.0)
        up = min((1 - x[k]) / w if w > 0 else -x[k] / w for k, w in zip(active, v) if w)
        down = min(x[k] / w if w > 0 else (x[k] - 1) / w for k, w in zip(active, v) if w)
        step = up if float(u[i]) * (up + down) < down else -down
        for k, w in zip(active, v):
            moved = x[k] + step * w
            x[k] = 0.0 if moved < _EPS else 1.0 if moved > 1 - _EPS else moved
        active = [k for k in active if 0 < x[k] < 1]
    return np.array(x)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last open rows, SPARE + 2 at most, to the choice nearest the token total, then the document total."""
    pi = pi.copy()
    rows = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(rows):
        return pi
    choice = (np.arange(1 << len(rows))[:, None] >> np.arange(len(rows))) & 1
    off = np.round(np.abs(choice @ size[rows] - float((pi[rows] * size[rows]).sum())), 6)
    docs = np.round(np.abs(choice.sum(1) - float(pi[rows].sum())), 6)
    pi[rows] = choice[np.lexsort((np.arange(len(choice)), docs, off))[0]]
    return pi


def _flights(df: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """One flight for each group of ``keys``; a group is bounded by the callers' dealing."""

    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_u", "doc_id", "size"], kind="stable", na_position="last", ignore_index=True)
        size = rows["size"].to_numpy(float)
        pi = flight(rows["_pi"].to_numpy(float), size, rows["_u"].to_numpy(float), SPARE)
        return rows.assign(_pi=land(pi, size) if last else pi)

    return df.groupBy(*keys).applyInPandas(fly, df.schema)


def mix_units(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """doc_id, source, size, n, source_size, target, times: how often the mix takes the n rows that are equal in the first three, together.

    Within a source every row has the same expected number of copies, target / size of source:
    n times its whole part is given to a unit, the fraction is the inclusion probability of a balanced
    sample. The sample is drawn by the cube method: flights over blocks of about BLOCK units move the
    probabilities through the null space of (rows, words) and leave a few open units a block; these
    meet in flights of FAN_IN blocks until one block a source is left, which is landed. So both
    totals of a source hold but for the landing of SPARE + 2 documents, which has the nearest of all their choices.

    Rows that repeat, and rows without id of one size, are one unit, so blocks are of like size whatever
    repeats. The random numbers are hashes of (doc_id, size, source), so reruns agree.
    """
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_word_count(F.col("text")).alias("size"))
    units = cut(units.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    t = source_targets(units, weights, share, most).join(units.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_units")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    t = t.withColumnRenamed("source", "_source").withColumn("_each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rows = units.join(cut(t.drop("source_rows")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    given = F.col("n") * F.col("_each")
    rows = rows.withColumn("_whole", F.floor(given + _EPS)).withColumn("_pi", F.greatest(F.lit(0.0), given - F.col("_whole")))
    spread = F.xxhash64(F.lit(seed), "doc_id", "size", "source")
    rows = rows.withColumn("_u", F.pmod(spread, F.lit(1 << 40)) / float(1 << 40))
    rows = rows.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_units") / BLOCK)).cast("long"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "source"), F.col("_blocks"))).drop("_each", "_units")
    done = []
    rows = cut(_flights(rows, ["source", "_block"], last=False))
    while True:
        is_open = (F.col("_pi") > 0) & (F.col("_pi") < 1)
        done.append(rows.filter(~is_open))
        rest = rows.filter(is_open)
        widest = rest.agg(F.max("_blocks")).first()[0]
        if widest is None:
            break
        last = widest <= FAN_IN
        rest = rest.withColumn("_block", F.floor(F.col("_block") / FAN_IN)).withColumn("_blocks", F.ceil(F.col("_blocks") / FAN_IN))
        if last:
            done.append(_flights(rest, ["source"], last=True))
            break
        rows = cut(_flights(rest, ["source", "_block"], last=False))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("_whole") + F.col("_pi").cast("long")).cast("long").alias("times"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """How often the mix takes each row: doc_id, source, size, source_size, target, copies (see ``mix_units``).

    Null text has size 0; a null source is a source of its own; rows that repeat share their copies evenly; no rows give no rows.
    """
    units = mix_units(docs, **options).withColumn("_number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return units.select("doc_id", "source", "size", "source_size", "target", (F.floor(F.col("times") / F.col("n")) + (F.col("_number") < F.col("times") % F.col("n")).cast("long")).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; the columns of ``docs``.

    Rows whose (doc_id, source) is unique, all but repeated rows, are matched by it without
    moving their texts while the table of copies may be broadcast (a counted bound). Rows with
    equal (doc_id, source, size) share the sum of their copies evenly; of these equal rows are summed before they meet.
    """
    mix = cut(mix_units(docs, **options).withColumn("_key", F.xxhash64("doc_id", "source")))
    repeated = cut(mix.groupBy("_key").agg(F.sum("n").alias("_n")).filter("_n > 1").select("_key"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"))
    once = mix.join(repeated, "_key", "left_anti").filter("times > 0").select("_key", F.col("times").cast("int").alias("_times"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("_key"), F.col("text").cast("string").alias("_text"))
    taken = join_checked(packed, once, "_key").select("row", "_times")
    if repeated.limit(1).count():
        shared = mix.join(repeated, "_key", "left_semi").groupBy("_key", F.col("size").alias("_size")).agg(F.sum("times").alias("_of"), F.sum("n").alias("_n"))
        equal = join_checked(packed, repeated, "_key").groupBy("row", "_key", row_word_count(F.col("_text")).alias("_size")).agg(F.count(F.lit(1)).alias("_m"))
        order = Window.partitionBy("_key", "_size").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
        placed = equal.withColumn("_before", F.coalesce(F.sum("_m").over(order), F.lit(0))).join(shared, ["_key", "_size"])
        more = F.least(F.col("_m"), F.greatest(F.lit(0), F.col("_of") % F.col("_n") - F.col("_before")))
        times = F.col("_m") * F.floor(F.col("_of") / F.col("_n")) + more
        taken = taken.unionByName(placed.select("row", times.cast("int").alias("_times")).filter("_times > 0"))
    return taken.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
