"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import join_checked
from millrace.llm.quality import COUNTS, text_counts
from millrace.llm.shared import slices, stored, text_bytes

#: Counts beside those of the quality rules: other ASCII marks, sentence ends, code points, words equal to the word before.
MORE = ("n_marks", "n_ends", "n_chars")
#: Folds of the labelled rows, by hash; each is judged by models that have not seen it.
FOLDS = 5
#: Candidates: how far a class's covariance goes to the pooled one, how far that goes to a multiple of the identity, and the power of the density ratio.
TO_POOLED, TO_ROUND, POWERS = (0.0, 0.1, 0.3, 0.6), (0.001, 0.01, 0.1), (1.0, 0.5, 0.25, 0.12)
#: Features are summed as integers of this many units, so that sums do not depend on how rows are split.
UNITS = 4096
#: The least score that is called good.
GOOD = 0.3
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True

FEATURES = ("log_words", "word_length", "symbols", "marks", "ends", "upper", "digits", "distinct", "repeated", "dup_lines", "line_words", "log_chars")


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each document: logarithms of sizes, square roots of shares; a share of nothing is 0."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    share = lambda a, b: np.sqrt(np.divide(c[a], c[b], out=np.zeros_like(c[a]), where=c[b] > 0))
    columns = (np.log1p(c["n_words"]), share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_marks", "n_words"), share("n_ends", "n_words"), share("n_upper", "word_chars"), share("n_digits", "word_chars"), share("n_distinct_words", "n_words"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), np.log1p(share("n_words", "n_lines")), np.log1p(c["n_chars"]))
    return np.clip(np.stack(columns, 1), 0, 64)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and MORE of every whole text; null and empty texts count 0 everywhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, offsets = text_bytes(part.column("text"))
            found = text_counts(raw, offsets)
            for name, mask in zip(MORE, (_MARK[raw], _END[raw], (raw & 0xC0) != 0x80)):
                before = np.concatenate([[0], np.cumsum(mask)])
                found[name] = before[offsets[1:]] - before[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[c].astype(np.int64)) for c in (*COUNTS, *MORE))], names=["doc_id", *COUNTS, *MORE])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE)))


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*COUNTS, *MORE)})


@dataclass(frozen=True)
class Moments:
    """Rows, sums and sums of products of the features of one class."""

    n: float
    first: np.ndarray
    second: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.first + other.first, self.second + other.second)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.first - other.first, self.second - other.second)

    @property
    def mean(self) -> np.ndarray:
        return self.first / max(self.n, 1)

    @property
    def scatter(self) -> np.ndarray:
        return self.second - np.outer(self.mean, self.mean) * self.n


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with shrunk covariances; ``factors`` are the inverted Cholesky factors, made once."""

    means: np.ndarray
    covariances: np.ndarray
    odds: float
    power: float = 1.0

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        lower = [np.linalg.cholesky(c) for c in self.covariances]
        return [(np.linalg.inv(a).T, 2 * np.log(np.diag(a)).sum()) for a in lower]

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-density of the good class minus that of the poor one: half the difference of Mahalanobis distances and log-determinants."""
        poor, good = ((((x - mean) @ factor) ** 2).sum(1) + size for mean, (factor, size) in zip(self.means, self.factors))
        return (poor - good) / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.power * self.ratio(x) + self.odds, -40, 40)))


def discriminant(poor: Moments, good: Moments, to_pooled: float, to_round: float, power: float = 1.0) -> Discriminant:
    """Covariances go to the pooled one by ``to_pooled``, and all to the diagonal of the pooled variances by ``to_round``."""
    pooled = (poor.scatter + good.scatter) / max(poor.n + good.n - 2, 1)
    ground = np.diag(np.maximum(np.diag(pooled), 1e-4))
    own = [m.scatter / max(m.n - 1, 1) for m in (poor, good)]
    mixed = [(1 - to_round) * ((1 - to_pooled) * c + to_pooled * pooled) + to_round * ground for c in own]
    return Discriminant(np.array([poor.mean, good.mean]), np.array(mixed), float(np.log((good.n + 1) / (poor.n + 1))), power)


def _moments(marked: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments of each (fold, class): integer sums in the tasks, added by a grouped shuffle; a few thousand numbers reach the driver."""
    p = len(FEATURES)
    size = 1 + p + p * p

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS * 2, size), np.int64)
        for batch in batches:
            x = np.rint(rows_of(batch) * UNITS).astype(np.int64)
            cell = batch.column("_fold").to_numpy() * 2 + batch.column("_y").to_numpy()
            for k in np.unique(cell):
                own = x[cell == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        at = np.flatnonzero(total.any(1))
        for k in at:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int64)), pa.array(np.arange(size)), pa.array(total[k])], names=["cell", "slot", "total"])

    sums = marked.mapInArrow(summed, "cell long, slot long, total long").groupBy("cell", "slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    flat = {k: np.zeros(size) for k in range(FOLDS * 2)}
    for r in sums:
        flat[r["cell"]][r["slot"]] = float(r["total"])
    return {(k // 2, k % 2): Moments(v[0], v[1 : p + 1] / UNITS, v[p + 1 :].reshape(p, p) / UNITS**2) for k, v in flat.items()}


def _losses(marked: DataFrame, models: list[list[Discriminant]]) -> np.ndarray:
    """Logarithmic loss of each candidate and power over all labelled rows, each row judged by the models without its fold."""

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), len(POWERS)), np.int64)
        for batch in batches:
            x, fold, sign = rows_of(batch), batch.column("_fold").to_numpy(), 2.0 * batch.column("_y").to_numpy() - 1
            for f in np.unique(fold):
                here = fold == f
                for k, by_fold in enumerate(models):
                    ratio = by_fold[f].ratio(x[here])
                    for j, power in enumerate(POWERS):
                        loss = np.logaddexp(0, -sign[here] * np.clip(power * ratio + by_fold[f].odds, -40, 40))
                        total[k, j] += np.rint(loss * UNITS).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "total"])

    out = np.zeros(len(models) * len(POWERS))
    for r in marked.mapInArrow(lost, "slot long, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["slot"]] = float(r["total"])
    return out.reshape(len(models), len(POWERS))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant | float:
    """Fit on all rows of ``stats`` whose id has a label 0 or 1; where one class has too few rows, the share of good rows instead.

    Of an id's labels the least counts. Shrinkage and power are those of the least cross-validated loss. Two passes over the
    statistics, whose sums alone reach the driver.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y")).dropna().groupBy("doc_id").agg(F.min("_y").alias("_y")).filter(F.col("_y").isin(0, 1))
    marked = join_checked(stats, marked, "doc_id").withColumn("_fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("long")).withColumn("_y", F.col("_y").cast("long"))
    marked = stored(marked, "quality-labelled")
    cells = _moments(marked)
    classes = [sum((cells[f, y] for f in range(1, FOLDS)), cells[0, y]) for y in (0, 1)]
    if min(m.n for m in classes) < 2:
        return float((classes[1].n + 1) / (classes[0].n + classes[1].n + 2))
    tried = list(product(TO_POOLED, TO_ROUND))
    models = [[discriminant(classes[0] - cells[f, 0], classes[1] - cells[f, 1], *t) for f in range(FOLDS)] for t in tried]
    loss = _losses(marked, models)
    best = int(loss.argmin())
    return discriminant(*classes, *tried[best // len(POWERS)], POWERS[best % len(POWERS)])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(stats: DataFrame, model: Discriminant | float) -> DataFrame:
    """doc_id and score for each row of ``stats``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(rows_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return stats.mapInArrow(judge, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= ``good``) of every row of ``docs``.

    Only the whole text is scored; null text is empty, and empty texts have the score of a text without words. Rows without
    id or label are scored, not learned from; rows that repeat score alike. Without labels every score is 0.5; an empty table gives no rows. Other columns are ignored.
    """
    stats = stored(statistics(docs), "quality-counts")
    model = train(stats.filter(~held_out(F.col("doc_id"))), labels)
    return predict(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted"))
