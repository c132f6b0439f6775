"""Models learned from the corpus itself: sentence ends from abbreviation statistics, languages from character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import settled

# ---------------------------------------------------------------- sentences

#: Tokens are runs without white space; marks around them are not part of the word.
SPACE, AROUND, WORD = r"[\x20\x09-\x0D]+", r"""^[("'\[]+|[)"'\],;:]+\z""", r"^\p{L}[\p{L}.\-]*\z"
#: What a token that may end a sentence ends in before the next: its mark and those around it.
END = r"""([.!?][)"'\],;:]*) """
#: Texts that are in lower case as they stand, without a look at Spark's tables of letters, which takes longer than all else about a token.
SMALL = r"^[\x00-@\[-\x7Fß-öø-ÿ]*\z"
#: An abbreviation has this score at least; a true one would end in a period with this probability.
LEAST_SCORE, ALWAYS = 0.3, 0.99


def marked(text: Column, gap: str) -> Column:
    """A text's tokens with a blank between them, ``gap`` after those that may end a sentence. A line feed is in no token, so it can tell gaps."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, SPACE, " ")), END, f"$1{gap}")


def core(raw: Column) -> Column:
    """A token without the marks around it."""
    return F.regexp_replace(raw, AROUND, "")


def bare(raw: Column) -> Column:
    """A token's core without its period."""
    return F.regexp_replace(core(raw), r"\.\z", "")


def lower(x: Column) -> Column:
    """A text in lower case."""
    return F.when(x.rlike(SMALL), x).otherwise(F.lower(x))


def word_statistics(docs: DataFrame, text: str) -> DataFrame:
    """base, n, n_dot, n_lower, n_middle: how often a word occurs, with a period, in lower case, and capitalised inside a sentence.

    Equal tokens are counted first, so that words are told and judged once for each of them.
    """
    said = F.split(F.concat(F.lit("\n"), marked(F.col(text), " \n")), " ")  # a line feed before tokens at the start or after an end
    seen = docs.select(said.alias("_w")).select(F.explode_outer("_w").alias("_said")).groupBy("_said").agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.select(F.ltrim("_said", F.lit("\n")).alias("_raw"), (~F.startswith("_said", F.lit("\n"))).alias("_inside"), "_n")
    words = seen.select(lower(bare(F.col("_raw"))).alias("base"), core(F.col("_raw")).alias("_core"), "_inside", "_n")
    small = F.substring("_core", 1, 1) == lower(F.substring("_core", 1, 1))
    count = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    # words are told by an aggregate, as Spark would push a filter on their base down to each token of the texts
    sums = words.groupBy("base").agg(F.sum("_n").alias("n"), count(F.endswith("_core", F.lit("."))).alias("n_dot"), count(small).alias("n_lower"), count(~small & F.col("_inside")).alias("n_middle"), F.bool_or(F.col("base").rlike(WORD)).alias("_word"))
    return sums.filter("_word").drop("_word")


def abbreviations(words: DataFrame) -> DataFrame:
    """base, score of the words that behave as abbreviations.

    The likelihood that a word's periods belong to it, against that of any word at a sentence end, is weighed
    by shortness and inner periods, and divided by the word's length for each time that it stands without a period.
    """
    total = words.agg((F.sum("n_dot") / F.sum("n")).alias("_p"))
    rows = words.filter("n_dot > 0").join(F.broadcast(total))  # one row
    plain, size = F.col("n") - F.col("n_dot"), F.length(F.replace("base", F.lit("."), F.lit("")))
    null = F.col("n_dot") * F.log(F.col("_p") + 1e-8) + plain * F.log(1 - F.col("_p") + 1e-8)
    true = F.col("n_dot") * F.log(F.lit(ALWAYS)) + plain * F.log(F.lit(1 - ALWAYS))
    inner = F.length("base") - size + 1
    score = 2 * (true - null) * F.exp(-size) * inner * F.pow(size.cast("double"), -plain)
    return rows.select("base", score.alias("score")).filter(F.col("score") >= LEAST_SCORE)


def split_sentences(docs: DataFrame, key: str, text: str, words: DataFrame | None = None) -> DataFrame:
    """``key, position, sentence`` (words joined by one blank), with the abbreviations that the corpus itself shows.

    A word that ends in ! or ? ends a sentence. One that ends in a period does unless it is a single letter, an abbreviation, or a
    number before a word in lower case; after an abbreviation a sentence begins with a capitalised word that
    otherwise is in lower case. Words with a period alone are joined to the statistics, by hash; texts are not shuffled with them. Rows that repeat a key are told
    apart by their text; null texts and texts without words have no sentence.
    """
    words = settled(word_statistics(docs, text), "words") if words is None else words
    short = settled(abbreviations(words).select("base", F.lit(True).alias("_short")), "abbreviations")
    row = F.struct(F.col(key), F.unhex(F.md5(F.coalesce(text, F.lit(""))))).alias("_row")
    parts = lambda x: F.split(marked(F.col(x), "\n"), "\n")
    following = F.slice("_p", F.lit(2), F.size("_p"))
    # outer, as the filter that explode adds on empty lists would make them once more
    ends = docs.select(row, parts(text).alias("_p")).select("_row", F.posexplode_outer(F.arrays_zip(F.col("_p").alias("part"), following.alias("next"))).alias("at", "t")).filter("t.next is not null")
    ends = ends.select("_row", "at", F.substring_index("t.part", " ", -1).alias("raw"), F.substring_index("t.next", " ", 1).alias("next"))
    follows = F.substring(core(F.col("next")), 1, 1)
    sure = core(F.col("raw")).rlike(r"[!?]\z")
    open_ = bare(F.col("raw")).rlike(r"^(\p{L}|[0-9]+)\z") & (~bare(F.col("raw")).rlike(r"^[0-9]+\z") | follows.rlike(r"\p{Ll}"))
    doubt = ~sure & F.coalesce("_short", F.lit(False))
    judged = ends.filter(sure | ~open_).withColumn("base", lower(bare(F.col("raw")))).join(short, "base", "left").filter(~doubt | follows.rlike(r"\p{Lu}"))
    judged = settled(judged.select("_row", "at", F.when(doubt, lower(bare(F.col("next")))).alias("next_base")), "ends")
    starts = words.filter("n_lower > 0 and n_middle = 0").select(F.col("base").alias("next_base"))
    kept = judged.filter("next_base is null").unionByName(judged.filter("next_base is not null").join(starts, "next_base", "left_semi").select(*judged.columns))
    cuts = kept.groupBy("_row").agg(F.sort_array(F.collect_set("at")).alias("_cuts"))
    whole = docs.select(row, F.col(key), F.col(text).alias("_text")).join(cuts, "_row", "left").dropDuplicates(["_row"])
    whole = whole.select(key, "_cuts", parts("_text").alias("_p"))
    first = F.concat(F.array(F.lit(0)), F.transform(F.coalesce("_cuts", F.array().cast("array<int>")), lambda c: c + 1))
    after = F.concat(F.slice("_first", 2, F.size("_first")), F.array(F.size("_p")))
    pieces = F.transform(F.arrays_zip(F.col("_first").alias("a"), F.col("_after").alias("b")), lambda s: F.array_join(F.slice("_p", s["a"] + 1, s["b"] - s["a"]), " "))
    found = whole.withColumn("_first", first).withColumn("_after", after).select(key, F.posexplode_outer(pieces).alias("position", "sentence"))
    return found.filter("sentence != ''")  # that of a text without words


# ---------------------------------------------------------------- languages

#: Trigrams of code points fall into so many buckets; counts are smoothed by this.
BUCKETS, SMOOTH = 16_381, 0.5
#: Characters of the texts that are counted at once.
_SLICE = 1 << 20


def buckets(text: str) -> np.ndarray:
    """The bucket of each run of three code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % BUCKETS if len(c) > 2 else c[:0]


@dataclass(frozen=True)
class LanguageModels:
    """Names and smoothed log-probabilities (language x bucket)."""

    names: tuple[str, ...]
    logs: np.ndarray

    def likelihoods(self, text: str) -> np.ndarray:
        """Log-likelihood of a text under each language."""
        return self.logs[:, buckets(text)].sum(1)


def learn_languages(docs: DataFrame, text: str, lang: str) -> LanguageModels:
    """One model a language from all rows with text and language: counts are summed in the tasks, then by one grouped shuffle.

    What reaches the driver is at most BUCKETS numbers a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    total = seen.setdefault(name, np.zeros(BUCKETS, np.int64))
                    for k in range(0, max(len(value) - 2, 0), _SLICE):
                        total += np.bincount(buckets(value[k : k + _SLICE + 2]), minlength=BUCKETS)
        for name, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string"))
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = tuple(sorted({r["lang"] for r in sums}))
    total = np.zeros((len(names), BUCKETS))
    for r in sums:
        total[names.index(r["lang"]), r["bucket"]] = r["n"]
    return LanguageModels(names, np.log((total + SMOOTH) / (total.sum(1, keepdims=True) + SMOOTH * BUCKETS)))


def language_scores(chunks: DataFrame, text: str, models: LanguageModels) -> DataFrame:
    """``chunks`` with language (the likeliest, the first by name on ties; null without a trigram) and margin, its lead per trigram over the next."""
    shared = chunks.sparkSession.sparkContext.broadcast(models)
    names = chunks.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                best, lead = [], []
                for value in part.column(text).to_pylist():
                    if value is None or len(value) < 3 or not known.names:
                        best.append(None), lead.append(None)
                        continue
                    total = sum(known.likelihoods(value[k : k + _SLICE + 2]) for k in range(0, len(value) - 2, _SLICE))
                    at = int(total.argmax())
                    best.append(known.names[at])
                    lead.append(float(total[at] - np.delete(total, at).max()) / (len(value) - 2) if len(total) > 1 else 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(lead, pa.float64())], names=[*names, "language", "margin"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(judge, kinds + ", language string, margin double")


def document_languages(docs: DataFrame, chunks: DataFrame, key: str, text: str, models: LanguageModels, default: str = "en", least: int = 100) -> DataFrame:
    """``key, language, votes, n_chunks``: the language of most chunks above ``least`` characters, the first by name on ties, ``default`` without any."""
    votes = language_scores(chunks.filter(F.length(text) > least).select(key, text), text, models).filter("language is not null")
    counts = votes.groupBy(key, "language").agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("m"), "language")).alias("b"), F.sum("votes").alias("n_chunks"))
    found = docs.select(key).distinct().join(best, key, "left")
    return found.select(key, F.coalesce("b.language", F.lit(default)).alias("language"), F.coalesce(-F.col("b.m"), F.lit(0)).cast("long").alias("votes"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))
