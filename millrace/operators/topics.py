"""Topics: class-based TF-IDF, centroids, merging, size statistics, clustering."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import dot, words
from millrace.session import settled

OUTLIER = -1


def ctfidf(df: DataFrame, cls: str, text: str, stop: list[str], n: int = 10, least: int = 4) -> DataFrame:
    """M4, M5: top terms of each class by share in the class * ln(1 + tokens per class / count of the term)."""
    tokens = df.select(cls, F.explode(words(F.col(text), least)).alias("term")).filter(~F.col("term").isin(stop))
    counts = tokens.groupBy(cls, "term").agg(F.count(F.lit(1)).alias("n"))
    counts = settled(counts, "term-counts")  # read three times; the texts once
    sizes = counts.groupBy(cls).agg(F.sum("n").alias("_size"))
    mean = sizes.agg((F.sum("_size") / F.count(F.lit(1))).alias("_mean"))
    every = counts.groupBy("term").agg(F.sum("n").alias("_f"))
    scored = counts.join(sizes, cls).join(every, "term").join(F.broadcast(mean)).withColumn("score", F.col("n") / F.col("_size") * F.log(1.0 + F.col("_mean") / F.col("_f")))  # mean is one row
    order = Window.partitionBy(cls).orderBy(F.desc(F.round("score", 12)), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(cls, "term", "rank", "n", "score")


def vocabulary(df: DataFrame, key: str, text: str, stop: list[str], min_df: int = 2, max_df: float = 0.92, least: int = 4) -> DataFrame:
    """M4: terms of one and two words with their documents and occurrences, without those in fewer than ``min_df`` or more than a share ``max_df`` of the documents.

    Two words are a term if they follow each other once stop words and short words are out.
    """
    own = df.select(key, F.filter(words(F.col(text), least), lambda w: ~w.isin(stop)).alias("_w"))
    pairs = F.transform(F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get("_w", i), w))
    # words are dealt by document once, so that a document's terms are counted where they are made; what is shuffled after is a row a term and task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as for terms: adaptive execution would merge parts by the size of the words
    terms = own.repartition(tasks, key).select(key, F.explode(F.concat("_w", pairs)).alias("term"))
    per = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("_n")).groupBy("term").agg(F.count(key).alias("n_docs"), F.sum("_n").alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return per.join(F.broadcast(total)).filter((F.col("n_docs") >= min_df) & (F.col("n_docs") <= max_df * F.col("_all"))).drop("_all")  # one row


def reranked(candidates: DataFrame, topic: str, term: str, vector: str, centre: str, n: int = 10, diversity: float = 0.4) -> DataFrame:
    """M6: of each topic's candidate terms the n that are near its centre and unlike each other.

    Greedy: (1 - diversity) * likeness to the centre - diversity * most likeness to a picked term; the earlier term on ties.
    A topic's candidates are bounded by who makes them.
    """
    from millrace.operators.retrieval import mmr_select

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(term, ignore_index=True)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
        order = mmr_select(unit(np.asarray(part[centre].iloc[0], float)), unit(np.stack(part[vector].to_numpy()).astype(float)), n, 1 - diversity)
        return pd.DataFrame({topic: part[topic].iloc[order], term: part[term].iloc[order], "rank": range(1, len(order) + 1)})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(topic).applyInPandas(pick, f"{topic} {kinds[topic]}, {term} string, rank int")


def staged_search(df: DataFrame, vector: str, stages: list[dict[str, list[int]]], start: dict[str, int]) -> DataFrame:
    """Parameters searched stage by stage: the best of a stage are locked for the next; all trials with their stage."""
    best, out = dict(start), None
    for k, choices in enumerate(stages):
        trial = grid(df, vector, choices.get("k", [best["k"]]), choices.get("dims", [best["dims"]])).withColumn("stage", F.lit(k + 1))
        top = trial.orderBy(F.desc("score"), "k", "dims").first()
        best = {"k": top["k"], "dims": top["dims"]}
        out = trial if out is None else out.unionByName(trial)
    return out


def centroids(df: DataFrame, topic: str, vector: str, size: int) -> DataFrame:
    """Mean vector of each topic of vectors of one size: one vector is summed per topic and task before the shuffle."""
    own = df.filter(F.size(vector) == size).select(topic, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return own.groupBy(topic).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))


#: Topics whose centroids may be sent to all tasks, at most.
MOST_CENTRES = 20_000


def assign_nearest(df: DataFrame, centres: DataFrame, topic: str, vector: str, only: int | None = None) -> DataFrame:
    """Nearest centroid by inner product, the lower topic on ties; with ``only`` just rows of that topic.

    Centroids are one row a topic; they are collected to one array row, and each item is scored
    where it is: no cross join of rows, no shuffle.
    """
    if (n := centres.count()) > MOST_CENTRES:
        raise ValueError(f"{n} centroids are too many to send to all tasks")
    packed = centres.filter(F.col(topic) != OUTLIER).agg(F.sort_array(F.collect_list(F.struct(F.col(topic).alias("t"), F.col("centroid").alias("c")))).alias("_c"))
    scored = F.transform("_c", lambda c: F.struct(dot(F.col(vector), c["c"]).alias("s"), (-c["t"]).alias("m")))
    best = -F.array_max(scored)["m"]
    new = F.when(F.col(topic) == only, best).otherwise(F.col(topic)) if only is not None else best
    return df.join(F.broadcast(packed)).withColumn("assigned", new.cast("int")).drop("_c")


def similarity_matrix(centres: DataFrame, topic: str) -> DataFrame:
    """Cosine of each pair of topics a < b; one row a topic."""
    from millrace.functions.scalars import cosine

    a, b = centres.select(F.col(topic).alias("a"), F.col("centroid").alias("_x")), centres.select(F.col(topic).alias("b"), F.col("centroid").alias("_y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("_x"), F.col("_y")).alias("cosine"))


def topic_tree(centres: DataFrame, topic: str) -> DataFrame:
    """The merge tree of topics by average cosine distance: ``left, right, height, size``, in order of height.

    A node is named by its least topic. Each round merges all pairs that are each other's nearest (the lower topics on ties), which average linkage allows without
    changing the tree; the distance of two nodes is the mean over their pairs of topics, so a round is one grouped sum.
    """
    likeness = similarity_matrix(centres.filter(F.col(topic) != OUTLIER), topic)
    pairs = settled(likeness.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), (1.0 - F.col("cosine")).alias("d"), F.lit(1).cast("long").alias("n")), "distances")
    sizes = settled(centres.filter(F.col(topic) != OUTLIER).select(F.col(topic).cast("int").alias("t"), F.lit(1).cast("long").alias("m")), "sizes")
    merges = None
    while not pairs.isEmpty():
        mean = F.round(F.col("d") / F.col("n"), 12)
        ends = pairs.withColumn("h", mean).select(F.explode(F.array("a", "b")).alias("t"), F.struct("h", "a", "b").alias("key"))
        nearest = ends.groupBy("t").agg(F.min("key").alias("key"))
        mutual = settled(nearest.groupBy("key").count().filter(F.col("count") == 2).select("key.a", "key.b", "key.h"), "merges")
        named = mutual.join(sizes.select(F.col("t").alias("a"), F.col("m").alias("_p")), "a").join(sizes.select(F.col("t").alias("b"), F.col("m").alias("_q")), "b")
        done = settled(named.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("h").alias("height"), (F.col("_p") + F.col("_q")).alias("size")), "nodes")
        merges = done if merges is None else merges.unionByName(done)
        to = mutual.select(F.col("b").alias("_from"), F.col("a").alias("_to"))
        for side in ("a", "b"):
            pairs = pairs.join(to, F.col(side) == F.col("_from"), "left").withColumn(side, F.coalesce("_to", side)).drop("_from", "_to")
        pairs = settled(pairs.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("d").alias("d"), F.sum("n").alias("n")), "distances")
        sizes = settled(sizes.join(to, F.col("t") == F.col("_from"), "left").groupBy(F.coalesce("_to", "t").alias("t")).agg(F.sum("m").alias("m")), "sizes")
    empty = centres.sparkSession.createDataFrame([], "left int, right int, height double, size long")
    return merges.orderBy("height", "left") if merges is not None else empty


def merge_topics(df: DataFrame, topic: str, groups: list[list[int]], known: set[int]) -> DataFrame:
    """Topics of a group become its least; unknown ids are skipped, groups with one survivor too."""
    target = {t: min(g) for raw in groups if len(g := [t for t in raw if t in known]) > 1 for t in g}
    if not target:
        return df.withColumn("merged", F.col(topic))
    return df.withColumn("merged", F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in target.items() for v in p]), F.col(topic)), F.col(topic)))


def drop_empty(df: DataFrame, labels: DataFrame, topic: str) -> DataFrame:
    """Documents of topics without keywords become outliers."""
    good = labels.filter(F.length(F.trim("keywords")) > 0).select(F.col(topic).alias("_t"))
    return df.join(good, F.col(topic) == F.col("_t"), "left").withColumn(topic, F.coalesce("_t", F.lit(OUTLIER))).drop("_t")


def size_stats(df: DataFrame, topic: str) -> DataFrame:
    """Number of topics, outlier share, and statistics of topic sizes."""
    sizes = df.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col(topic) != OUTLIER, F.col("n"))
    return sizes.agg(F.count(own).alias("n_topics"), (100.0 * F.coalesce(F.sum(F.when(F.col(topic) == OUTLIER, F.col("n"))), F.lit(0)) / F.sum("n")).alias("outlier_pct"), F.min(own).alias("size_min"), F.max(own).alias("size_max"), F.median(own).alias("size_median"), F.avg(own).alias("size_mean"), (100.0 * F.max(own) / F.sum("n")).alias("largest_pct"))


def stop_words(general: list[str], domain: list[str]) -> list[str]:
    """U8: general and domain stop words as one sorted list."""
    return sorted({w.lower() for w in general} | {w.lower() for w in domain})


def commonest_terms(df: DataFrame, text: str, n: int, least: int = 4) -> DataFrame:
    """U8: the n commonest words of a text column, the first by name on ties."""
    counts = df.select(F.explode(words(F.col(text), least)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(n).select("word")


def stop_word_table(general: DataFrame, domain: DataFrame) -> DataFrame:
    """U8: two tables of words as one set, in lower case."""
    return general.unionByName(domain).select(F.lower("word").alias("word")).distinct()


def keyword_filter(column, stop: list[str]):
    """Comma list without keywords that equal or contain a stop word."""
    kept = F.filter(F.split(column, r"\s*,\s*"), lambda k: (F.length(k) > 0) & ~F.exists(F.array(*[F.lit(s) for s in stop]), lambda s: F.lower(k).contains(s)))
    return F.array_join(kept, ", ")


def labels(keywords: DataFrame, topic: str, label: Callable | None = None) -> DataFrame:
    """M9: three keywords as a topic's label, ``Topic N`` without, a fixed label for outliers."""
    per = keywords.groupBy(topic).agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rank", "term"))), 1, 3), lambda r: r["term"]), ", ").alias("_l"))
    name = F.when(F.col(topic) == OUTLIER, F.lit("Outliers (unassigned)")).when(F.length("_l") > 0, F.col("_l")).otherwise(F.concat(F.lit("Topic "), F.col(topic).cast("string")))
    return per.select(topic, (label(F.col("_l")) if label else name).alias("label"))


def embed(df: DataFrame, text: str, size: int = 256) -> DataFrame:
    """M1 offline: hashed term counts, normalised; a model may be plugged in through ``text.classify``."""
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size)
    return Normalizer(inputCol="_tf", outputCol="vector").transform(tf.transform(Tokenizer(inputCol=text, outputCol="_tokens").transform(df))).drop("_tokens", "_tf")


def cluster(df: DataFrame, vector: str, k: int, dims: int = 8, outlier: float = 0.05, seed: int = 42) -> DataFrame:
    """M2, M3, M7, M12 in Spark's terms: PCA, k-means, and the farthest share of rows as outliers.

    Density clustering has no counterpart in Spark; distance to the own centre stands in for it.
    """
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    low = PCA(k=dims, inputCol="_v", outputCol="_p").fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="topic").fit(low)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    table = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    far = model.transform(low).withColumn("_d", F.aggregate(F.zip_with(vector_to_array("_p"), F.element_at(table, F.col("topic") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    edge = far.agg(F.percentile_approx("_d", 1.0 - outlier, 10_000).alias("_e"))
    return far.join(F.broadcast(edge)).withColumn("topic", F.when(F.col("_d") > F.col("_e"), F.lit(OUTLIER)).otherwise(F.col("topic"))).drop("_v", "_p", "_d", "_e")  # edge is one row


def grid(df: DataFrame, vector: str, ks: list[int], dims: list[int]) -> DataFrame:
    """Topics, outliers and silhouette * (1 - outliers) for each combination of parameters."""
    out = []
    for k, d in product(ks, dims):
        found = cluster(df, vector, k, d).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
        score = ClusteringEvaluator(predictionCol="topic").evaluate(found.filter(F.col("topic") != OUTLIER))
        s = size_stats(found, "topic").first()
        out.append((k, d, int(s["n_topics"]), float(s["outlier_pct"]), float(score), float(score * (1 - s["outlier_pct"] / 100))))
    return df.sparkSession.createDataFrame(out, "k int, dims int, n_topics int, outlier_pct double, silhouette double, score double")
