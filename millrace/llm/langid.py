"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.shared import let_go, slices, text_bytes

#: Buckets of hashed n-grams, for each of ORDERS.
BUCKETS = 2048
ORDERS = (2, 3, 4)
#: Training texts of a language, at most, and of all languages (each has one at least).
PER_LANGUAGE, TRAIN_ROWS = 600, 12_000
#: Rows that are dense at once in the fit.
DENSE_ROWS = 3000
#: Rows whose vectors are held at once.
ROWS = 256
UNDETERMINED = "und"
#: A prediction is ambiguous if the share of the nearest codeword is below this.
CLEAR = 0.6

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A unit vector of square-rooted n-gram shares for each row; zeros without letters.

    N-grams are over UTF-8 bytes with A-Z folded and all other ASCII as blanks, runs of
    blanks as one, a blank at each end of a row.
    """
    n = len(offsets) - 1
    width = BUCKETS * len(ORDERS)
    # put a blank before each row and one at the end, so that grams never join two rows' letters
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    folded = np.full(len(raw) + n + 1, 32, np.uint8)
    at = np.arange(len(raw)) + row_of + 1
    folded[at] = _FOLD[raw]
    rows = np.full(len(folded), n - 1)
    rows[:-1] = np.repeat(np.arange(n), np.diff(offsets) + 1)
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (rows[1:] != rows[:-1])
    folded, rows = folded[keep].astype(np.uint32), rows[keep]
    out = np.zeros((n, width), np.float32)
    for k, order in enumerate(ORDERS):
        if len(folded) < order:
            continue
        code = np.zeros(len(folded) - order + 1, np.uint32)
        for j in range(order):
            code = code * np.uint32(257) + folded[j : len(folded) - order + 1 + j]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        same = rows[: len(code)] == rows[np.minimum(np.arange(len(code)) + order - 2, len(rows) - 1)]
        counts = np.bincount(rows[: len(code)][same] * BUCKETS + code[same], minlength=n * BUCKETS)[: n * BUCKETS]
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = counts.reshape(n, BUCKETS)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def codebook(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of -1 and 1: all distinct splits for few classes, else the best of random ones."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = (1 << (k - 1)) - 1
        return np.array([[1.0 if c == 0 or not ((b + 1) >> (c - 1)) & 1 else -1.0 for b in range(bits)] for c in range(k)])
    rng, length = np.random.Generator(np.random.PCG64(seed)), int(np.ceil(10 * np.log2(k)))
    best, best_gap = None, (-1, -1.0)
    for _ in range(64):
        words = rng.choice([-1.0, 1.0], (k, length))
        apart = (length - words @ words.T) / 2
        apart[np.diag_indices(k)] = np.inf
        balance = -np.abs(words.mean(0)).max()
        if (apart.min(), balance) > best_gap:
            best, best_gap = words, (apart.min(), balance)
    return best


@dataclass
class Codes:
    """A fitted classifier: languages, their codewords, one linear classifier and weight a bit."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword by weighted logistic loss, and its share of the softmax."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * word)).sum(1) for word in self.words], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        return best, share[np.arange(len(best)), best]


class Rows:
    """Training vectors, kept sparse; ``blocks`` gives them dense, DENSE_ROWS at a time."""

    def __init__(self, at: list[np.ndarray], value: list[np.ndarray], width: int = BUCKETS * len(ORDERS)):
        self.at, self.value, self.width = at, value, width
        self._only = self._dense(0, len(at)) if len(at) <= DENSE_ROWS else None

    def _dense(self, first: int, last: int) -> np.ndarray:
        out = np.zeros((last - first, self.width), np.float32)
        for k in range(first, last):
            out[k - first, self.at[k]] = self.value[k]
        return out

    def __len__(self) -> int:
        return len(self.at)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        if self._only is not None:
            yield slice(0, len(self.at)), self._only
            return
        for k in range(0, len(self.at), DENSE_ROWS):
            last = min(k + DENSE_ROWS, len(self.at))
            yield slice(k, last), self._dense(k, last)


def fit(x: Rows, y: np.ndarray, languages: list[str], rounds: int = 150, ridge: float = 1e-4) -> Codes:
    """Fit each bit by accelerated gradient descent on the logistic loss, classes weighing the same.

    The weight of a bit in decoding is one minus twice its error on every fifth row, which is
    left out of the fit.
    """
    words = codebook(len(languages))
    goal, spare = words[y].astype(np.float32), np.arange(len(y)) % 5 == 4
    share = (1 / np.bincount(y, minlength=len(languages)).clip(1))[y].astype(np.float32)
    share[spare] = 0
    weight = (share / max(share.sum(), 1e-9))[:, None]
    w, b = np.zeros((x.width, words.shape[1]), np.float32), np.zeros(words.shape[1], np.float32)
    ahead_w, ahead_b, rate = w, b, 6.0
    for k in range(rounds):
        slope_w, slope_b = np.zeros_like(w), np.zeros_like(b)
        for rows, dense in x.blocks():
            pull = weight[rows] * goal[rows] / (1 + np.exp(np.clip(goal[rows] * (dense @ ahead_w + ahead_b), -30, 30)))
            slope_w += dense.T @ pull
            slope_b += pull.sum(0)
        new_w = ahead_w + rate * (slope_w - ridge * ahead_w)
        new_b = ahead_b + rate * 0.3 * slope_b
        speed = k / (k + 3)
        ahead_w, ahead_b = new_w + speed * (new_w - w), new_b + speed * (new_b - b)
        w, b = new_w, new_b
    judged = spare if spare.any() else ~spare
    margins = [dense @ w + b for _, dense in x.blocks()]
    right = ((np.concatenate(margins) * goal)[judged] > 0).mean(0) if len(y) else np.ones(words.shape[1])
    return Codes(languages, words, w, b, np.maximum(2 * right - 1, 0.05))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = TRAIN_ROWS) -> Codes | None:
    """Fit on rows with text and lang: ``per_language`` rows a language at most, those of lowest hash.

    With many languages each has fewer, so that all have ``most_rows`` at most, or one row each. Rows that
    repeat are hashed alike, and the bound holds for them too. None if there are no such rows.
    """
    rows = docs.filter("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("distinct")).orderBy("lang").collect()
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    number = max(1, min(per_language, most_rows // len(languages)))
    rate = {r["lang"]: min(1.0, 1.3 * (number + 20) / max(r["distinct"], 1)) for r in counts}  # a bound that lets enough rows pass
    known = docs.sparkSession.createDataFrame(list(rate.items()), "lang string, _rate double")
    unit = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"), unit.alias("_u")).join(F.broadcast(known), "lang").filter("_u < _rate")
    sample = near.withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id"))).filter(F.col("_at") <= number).select("doc_id", "lang", "text", "_u")

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=ROWS):
            x = vectors(*text_bytes(part.column("text"))).astype(np.float16)
            where = [np.flatnonzero(v).astype(np.uint16) for v in x]
            yield pa.RecordBatch.from_arrays([part.column("_u"), part.column("lang"), pa.array([w.tobytes() for w in where], pa.binary()), pa.array([v[w].tobytes() for v, w in zip(x, where)], pa.binary())], names=["u", "lang", "at", "value"])

    got = sample.mapInArrow(vectorise, "u double, lang string, at binary, value binary").toPandas()
    got = got.sort_values(["u", "lang", "at"], ignore_index=True)
    x = Rows([np.frombuffer(a, np.uint16) for a in got["at"]], [np.frombuffer(v, np.float16) for v in got["value"]])
    y = np.searchsorted(languages, got["lang"].to_numpy(object).astype(str)) if len(got) else np.zeros(0, int)
    return fit(x, y, languages)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def verdicts(column: pa.Array, model: Codes | None) -> tuple[np.ndarray, np.ndarray]:
    """The language and score of each text; ``und`` with score 0 for texts without a letter, and for all without a model."""
    names = np.array((model.languages if model else []) + [UNDETERMINED], object)
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    best, score = np.full(n, len(names) - 1), np.zeros(n)
    if model:
        best, score = model.decode(vectors(raw, offsets))
    ascii_letters = np.concatenate([[0], np.cumsum((_FOLD[raw] != 32) & (raw < 128))])
    for k in np.flatnonzero(ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]):
        if not any(c.isalpha() for c in bytes(raw[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace")):
            best[k], score[k] = len(names) - 1, 0.0
    return names[best], score


def predict(docs: DataFrame, model: Codes | None, clear: float = CLEAR) -> DataFrame:
    """doc_id, lang_pred, score, second-best flag ``ambiguous`` for every whole text.

    Only the text is looked at. Null text and text without a letter: ``und`` with score 0;
    without a model all are. Rows that repeat get the same result.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, rows=ROWS):
            named, score = verdicts(part.column("text"), model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(named, pa.string()), pa.array(score.astype(float)), pa.array(score < clear)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(judge, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and predict all of them."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def with_language(docs: DataFrame, clear: float = CLEAR) -> DataFrame:
    """The documents that the codes give a language clearly; columns are kept.

    Those that ``predict`` calls ``und`` and those that it flags as ambiguous, with no codeword
    clearly the nearest, go. Null texts and texts without letters go. If no document is labelled there
    is nothing to learn from, and only texts without letters go. Repeated rows fare alike.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    schema, names = docs.schema, docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, rows=ROWS):
            named, score = verdicts(part.column("text"), model or _NO_CODES)
            good = named != UNDETERMINED
            if model:
                good &= score >= clear
            yield part.filter(pa.array(good, pa.bool_())).select(names)

    return docs.mapInArrow(keep, schema)


#: Stands in where nothing is labelled: one language for every text with letters.
_NO_CODES = Codes(["any"], np.ones((1, 1)), np.zeros((BUCKETS * len(ORDERS), 1), np.float32), np.zeros(1, np.float32), np.ones(1))
