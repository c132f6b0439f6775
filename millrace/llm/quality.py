"""Quality rules: a learned decision list over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import gram_hashes, mix, slices, stored, text_bytes, word_bounds, word_hashes, BYTE_VALUE, powers

#: A repeated run has this many words.
REPEAT_WINDOW = 5
#: At most so many labelled rows are fetched for training, those of the lowest hash.
TRAIN_ROWS = 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct_words")


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each of n rows; rows ascend."""
    salted = mix(keys ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(salted, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = salted[order[1:]] != salted[order[:-1]]
    return np.bincount(rows[order[first]], minlength=n)


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each row of a slice of texts."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(raw, offsets)
    n_words = np.diff(first)
    row_of_word = np.repeat(np.arange(n), n_words)
    inside = np.zeros(len(raw) + 1, np.int32)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    point = (raw & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": _per_row((np.cumsum(inside[:-1]) > 0) & point, offsets), "n_symbols": _per_row(_SYMBOL[raw], offsets), "n_upper": _per_row(_UPPER[raw], offsets), "n_digits": _per_row(_DIGIT[raw], offsets)}
    # lines: cut at each \n and at row ends
    cuts = np.unique(np.concatenate([np.flatnonzero(raw == 10), offsets[1:] - 1 + (offsets[1:] == 0)])) if len(raw) else np.zeros(0, np.int64)
    if len(raw):
        up, down = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[raw] * up[:-1], out=total[1:])
        begins = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
        begins = begins[begins < len(raw)]
        stops = np.append(begins[1:], len(raw))
        stops = np.where(raw[stops - 1] == 10, stops - 1, stops)
        words_before = np.searchsorted(starts, [begins, stops])
        has_word = words_before[1] > words_before[0]
        begins, stops = begins[has_word], stops[has_word]
        keys = mix((total[stops] - total[begins]) * down[begins] + (stops - begins).astype(np.uint64))
        row_of_line = np.searchsorted(offsets, begins, "right") - 1
        lines = np.bincount(row_of_line, minlength=n)
        out["n_lines"], out["n_dup_lines"] = lines, lines - _distinct(keys, row_of_line, n)
    else:
        out["n_lines"] = out["n_dup_lines"] = np.zeros(n, np.int64)
    words = word_hashes(raw, starts, ends)
    out["n_distinct_words"] = _distinct(words, row_of_word, n)
    grams = gram_hashes(words, REPEAT_WINDOW)
    covered = np.zeros(len(words) + 1, np.int32)
    if len(grams):
        rows = row_of_word[: len(grams)]
        whole = np.flatnonzero(rows == row_of_word[REPEAT_WINDOW - 1 :])
        salted = mix(grams[whole] ^ (rows[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        ranked = np.sort(salted)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            twice = np.unique(twice)
            at = np.minimum(np.searchsorted(twice, salted), len(twice) - 1)
            hit = whole[twice[at] == salted]
            covered[hit] += 1
            covered[hit + REPEAT_WINDOW] -= 1
    out["n_repeat_words"] = _per_row(np.cumsum(covered[:-1]) > 0, first)
    return out


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the COUNTS of every whole text; null and empty texts count 0 everywhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, offsets = text_bytes(part.column("text"))
            found = text_counts(raw, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: Statistics that rules may test: name to (numerator, denominator or None).
TESTS = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_word_share": ("n_distinct_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def test_value(name: str, value) -> Column:
    """A test's statistic as a Column; 0 where the denominator is 0."""
    top, bottom = TESTS[name]
    if bottom is None:
        return value(top).cast("double")
    return F.coalesce(F.try_divide(value(top).cast("double"), value(bottom).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, '<=' or '>', threshold) that speaks for low quality."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float = 0.0
    covered: int = 0

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        m = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.terms:
            m &= (x[name] <= t) if op == "<=" else (x[name] > t)
        return m

    def column(self) -> Column:
        c = F.lit(True)
        for name, op, t in self.terms:
            v = test_value(name, F.col)
            c = c & ((v <= F.lit(t)) if op == "<=" else (v > F.lit(t)))
        return c

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {t:.6g}" for n, o, t in self.terms)


def _best_term(x: dict, y: np.ndarray, inside: np.ndarray, cuts: dict) -> tuple[float, tuple | None]:
    """The threshold with the largest information gain among the rows that a rule still covers."""
    p0, n0 = (y & inside).sum(), (~y & inside).sum()
    base = np.log2(p0 / (p0 + n0)) if p0 else -50.0
    best: tuple[float, tuple | None] = (1e-9, None)
    for name in x:
        order = np.argsort(x[name][inside], kind="stable")
        v, good = x[name][inside][order], y[inside][order]
        at = np.searchsorted(v, cuts[name], "right")
        p = np.concatenate([[0], np.cumsum(good)])[at]
        for op, pp, tt in (("<=", p, at), (">", p0 - p, len(v) - at)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / np.maximum(tt, 1)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), (name, op, float(cuts[name][k])))
    return best


def learn_rules(x: dict[str, np.ndarray], y: np.ndarray, grow: np.ndarray, least_precision: float = 0.8, least_cover: int = 4, most_rules: int = 24, most_terms: int = 4) -> list[Rule]:
    """Sequential covering: grow a conjunction on the growing rows, prune it on the others, repeat.

    ``y`` is true for low quality. A rule is grown while terms gain information, cut back to the
    prefix with the best (p - n) / (p + n) on the pruning rows, and taken if its precision over
    all rows left is ``least_precision`` or more; the rows that it covers leave the training.
    """
    left, rules = np.ones(len(y), bool), []
    cuts = {name: np.unique(np.quantile(v, np.linspace(0, 1, 101))) if len(v) else np.zeros(1) for name, v in x.items()}
    cuts = {name: (c[1:] + c[:-1]) / 2 if len(c) > 1 else c for name, c in cuts.items()}
    while len(rules) < most_rules and (left & y & grow).sum() >= 2:
        terms, inside = [], left & grow
        while len(terms) < most_terms and (~y & inside).any():
            _, term = _best_term(x, y, inside, cuts)
            if term is None:
                break
            terms.append(term)
            inside &= Rule((term,)).mask(x)
        if not terms:
            break

        def worth(k: int) -> float:
            m = Rule(tuple(terms[:k])).mask(x) & left & ~grow
            p, n = (m & y).sum(), (m & ~y).sum()
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(terms) + 1), key=lambda k: (worth(k), -k))
        for k in dict.fromkeys((keep, len(terms))):
            m = Rule(tuple(terms[:k])).mask(x) & left
            share = float((m & y).sum() / max(m.sum(), 1))
            if share >= least_precision and m.sum() >= least_cover:
                break
        else:
            break
        rules.append(Rule(tuple(terms[:k]), share, int(m.sum())))
        left &= ~m
    return rules


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **options) -> list[Rule]:
    """Learn from at most ``rows`` labelled documents, those with the lowest hash of their id.

    Rows of ``labels`` without id or quality are left out; without labels there are no rules.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    joined = stats.join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))  # bounded by rows
    row = F.min(F.struct(*(test_value(t, F.col).alias(t) for t in TESTS)))  # of rows that repeat an id one, the same in each run
    one = joined.groupBy("_id", "_y").agg(row.alias("_r")).select(F.pmod(F.xxhash64(F.lit("grow"), "_id"), F.lit(3)).alias("_fold"), "_id", "_y", "_r.*")
    sample = one.toPandas().sort_values("_id", ignore_index=True)
    if sample.empty:
        return []
    return learn_rules({t: sample[t].to_numpy(float) for t in TESTS}, (sample["_y"] == 0).to_numpy(), (sample["_fold"] > 0).to_numpy(), **options)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that holds, or null."""
    expr = None
    for k, rule in enumerate(rules):
        expr = F.when(rule.column(), F.lit(k)) if expr is None else expr.when(rule.column(), F.lit(k))
    return F.lit(None).cast("int") if expr is None else expr.cast("int")


def score_quality(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Statistics of each document, the base check, and the learned list's verdict.

    Columns: doc_id, COUNTS, base_failed, rule (number of the rule that speaks against the
    document, null if none), kept. Null or empty text fails the base check. Repeated rows are
    judged alike. Columns of the inputs beyond those named are ignored.
    """
    stats = stored(statistics(docs), "quality-stats")
    rules = train(stats, labels) if rules is None else rules
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
