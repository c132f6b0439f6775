"""Secret scans: pattern candidates, and a random forest that removes false positives."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import slices, text_bytes, word_bounds, word_hashes

#: A candidate anywhere: a run of characters of keys, hashes and encodings with a digit, of this length or more.
#: A candidate after an assignment or a word for secrets: the value there, of any length and characters.
LEAST_LENGTH = 16
_RUN = re.compile(r"[A-Za-z0-9+/=_\-.@:]{%d,}" % LEAST_LENGTH)
_DIGIT = re.compile(r"[0-9]")
#: Characters looked at on either side of a candidate.
CONTEXT = 60
#: Words of the corpus dictionary: the most frequent of four letters or more.
DICTIONARY_WORDS = 4000
#: A task sends its counts when it holds this many words, and at its end.
_HELD_WORDS = 200_000
_SECRET_WORDS = frozenset("token key secret password passwd pwd auth bearer credential credentials api apikey private access signature session".split())
_DIGEST_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest hash uuid guid revision rev version id etag build order invoice".split())
FEATURES = ("length", "entropy", "class_changes", "digit_share", "upper_share", "hex_only", "bigram_score", "dictionary_share", "slashes", "dots", "has_at", "after_scheme", "ends_like_file", "assigned", "quoted", "secret_word", "digest_word", "distinct_share", "dashes", "symbol_share", "spaces", "letters_only", "named_secret")
_ASSIGNED = re.compile(r"[\"'`]?[ \t]*(?:=>|:=|==?|:(?!//))[ \t]*")
_NAMED = re.compile(r"\b(?:%s)[ \t]+(?:(?:is|was)[ \t]+)?(?=[^\s=:])" % "|".join(sorted(_SECRET_WORDS, key=len, reverse=True)), re.I)
_ENDS_NAMED = re.compile(r"(?:%s)(?: is| was)?\Z" % "|".join(_SECRET_WORDS))
_QUOTED = re.compile(r"\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`")
_BARE = re.compile(r"[^\s\"'`]+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.")
_QUOTES = ("\"", "'", "`")
#: A run of one of these at the end of a bare value is no part of it.
_MARKS = frozenset("!#%*?&$~")


@dataclass
class Dictionary:
    """Frequent words, and log-probabilities of letter pairs learned from them."""

    words: frozenset
    pairs: dict

    @classmethod
    def of(cls, counts: list[tuple[str, int]]) -> "Dictionary":
        pairs: Counter = Counter()
        for word, n in counts:
            for a, b in zip(word, word[1:]):
                pairs[a + b] += n
        total = sum(pairs.values()) + 26 * 26
        return cls(frozenset(w for w, _ in counts), {p: math.log((n + 1) / total) for p, n in pairs.items()} | {"": math.log(1 / total)})


def dictionary_counts(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[tuple[str, int]]:
    """The most frequent lower-case words of four ASCII letters or more over all documents.

    Each task sums its counts over its slices and sends all of them; sums are made per word, so
    they do not depend on how the input is split, and ``words`` rows come to the driver.
    """
    plain = re.compile(rb"[a-z]{4,24}\Z")

    def lines(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held]), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in slices(batches):
            raw, offsets = text_bytes(part.column("text"))
            starts, ends, _ = word_bounds(raw, offsets)
            fit = (ends - starts >= 4) & (ends - starts <= 24)
            starts, ends = starts[fit], ends[fit]
            _, first, n = np.unique(word_hashes(raw, starts, ends), return_index=True, return_counts=True)
            for a, b, c in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
                if plain.match(w := raw[a:b].tobytes()):
                    held[w] += c
            if len(held) >= _HELD_WORDS:
                yield lines(held)
                held.clear()
        if held:
            yield lines(held)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in rows.orderBy(F.desc("n"), "word").limit(words).collect()]


def _value(text: str, at: int) -> tuple[int, str]:
    """Start and characters of the value at a place: what is quoted there, else all up to a blank or quote."""
    if m := _QUOTED.match(text, at):
        return m.start(m.lastindex), m.group(m.lastindex)
    m = _BARE.match(text, at + (text[at : at + 1] in "\"'`"))
    value = m.group().rstrip(",.;:)]}>") if m else ""
    if value[-1:] in _MARKS and value[-2:-1] == value[-1:]:
        value = value.rstrip(value[-1:])
    return (m.start(), value) if m else (at, "")


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """Start and characters of each candidate of a text, in order.

    A value takes the place of the runs in it, unless it has blanks, and of a run that begins with
    its name; a value further inside a run is left to the run. So no key is reported twice.
    """
    runs: dict[int, str] = {}
    for m in _RUN.finditer(text):
        run = m.group().strip(".:=@-")
        if len(run) >= LEAST_LENGTH and _DIGIT.search(run):
            runs[m.start() + m.group().index(run)] = run
    spots: dict[int, tuple[int, int]] = {}  # where a value begins: where it is looked for, and where its name begins
    quoted = lambda at: at + (text[at : at + 1] in _QUOTES)
    for m in _ASSIGNED.finditer(text):
        first = m.start()
        while first and text[first - 1] in _NAME_CHARS:
            first -= 1
        if first < m.start():
            spots[quoted(m.end())] = (m.end(), first)
    for m in _NAMED.finditer(text):
        spots.setdefault(quoted(m.end()), (m.end(), quoted(m.end())))
    found, starts, done = dict(runs), sorted(runs), 0
    for start, (at, first) in sorted(spots.items()):
        if start < done:  # inside a value that is taken: it is not read again, so all values together are no longer than the text
            continue
        k = bisect_right(starts, start) - 1
        around = starts[k] if k >= 0 and starts[k] + len(runs[starts[k]]) > start else None
        if around is not None and around < first:
            continue
        _, value = _value(text, at)
        if not value:
            continue
        end = start + len(value)
        if around is not None and around + len(runs[around]) > end:
            value, end = text[start : around + len(runs[around])], around + len(runs[around])
        blanks = " " in value or "\t" in value
        if around is not None:
            found.pop(around, None)
        if not blanks:
            for s in starts[bisect_left(starts, start) : bisect_left(starts, end)]:
                found.pop(s, None)
            done = end
        found[start] = value
    yield from sorted(found.items())


def features(text: str, start: int, run: str, known: Dictionary) -> list[float]:
    """The FEATURES of a candidate: its characters, dictionary words in it, path shape, and words around it."""
    n, low = len(run), run.lower()
    counts = Counter(run)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in run]
    pairs = [known.pairs.get(low[i : i + 2], known.pairs[""]) for i in range(n - 1) if low[i].isalpha() and low[i + 1].isalpha()]
    covered, i = 0, 0
    while i < n:
        step = next((k for k in range(min(16, n - i), 3, -1) if low[i : i + k] in known.words), 0)
        covered += step
        i += step or 1
    before, after = text[max(0, start - CONTEXT) : start], text[start + n : start + n + CONTEXT]
    tight = before.rstrip()
    near = re.findall(r"[a-z0-9]+", before.lower())[-4:] + re.findall(r"[a-z0-9]+", after.lower())[:2]
    quoted = tight[-1:] in "\"'`" and tight[-1:] != ""
    operator = tight.rstrip("\"'` ")[-1:]
    return [
        float(n),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        kinds.count("d") / n,
        kinds.count("u") / n,
        float(all(c in "0123456789abcdef" for c in low)),
        sum(pairs) / len(pairs) if pairs else 0.0,
        covered / n,
        float(run.count("/")),
        float(run.count(".")),
        float("@" in run or after[:1] == "@" or before[-1:] == "@"),
        float("://" in run or before.endswith("//") or "://" in before[-40:].split(" ")[-1]),
        float(bool(re.search(r"\.[a-z]{2,4}$", low))),
        float(operator in ("=", ":")),
        float(quoted),
        float(sum(w in _SECRET_WORDS for w in near)),
        float(sum(w in _DIGEST_WORDS for w in near)),
        len(counts) / n,
        float(run.count("-")),
        kinds.count("s") / n,
        float(run.count(" ")),
        float(run.isalpha()),
        float(bool(_ENDS_NAMED.search(tight.rstrip("\"'`=:> \t").lower()))),
    ]


def labelled_findings(words: list[str], rows: int = 4000, seed: int = 11) -> list[tuple[str, int, str, int]]:
    """Labelled findings to train on: (text, start, candidate, 1 for a secret) from known constructions.

    Secrets are random keys beside assignments and words for secrets, and passwords: short, of letters
    only, and with other marks, and keys in running text that show by themselves; the others are plain words and numbers in such places, mail
    addresses, links, paths, digests that are named so, long words with numbers, cards, phones,
    dates, versions and repeated patterns, in running text of ``words`` that name no secret or digest, and of words that
    no dictionary has.
    """
    rng, out = random.Random(seed), []
    words = [w for w in words if w not in _SECRET_WORDS | _DIGEST_WORDS] or ["lorem", "ipsum", "dolor"]
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    name = lambda: "".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s"]) for _ in range(rng.randint(2, 3)))
    word = lambda: name() if rng.random() < 0.3 else rng.choice(words)

    marks = "!#$%&*~^+@?"

    def password() -> str:
        odd = "".join(some(a, rng.randint(1, 4)) for a in rng.sample([alnum[:26], alnum[26:52], "0123456789", alnum, marks[:6]], 4))
        return rng.choice([lambda: word() + some("0123456789", rng.randint(1, 4)) + some(alnum, rng.randint(1, 4)), lambda: word().title() + some("0123456789", rng.randint(2, 4)) + some(marks, 1), lambda: odd if len(odd) > 5 else odd + some(alnum, 4)])()

    def secret() -> str:
        label = rng.choice(["token", "api_key", "secret", "password", "access_key", "auth", "private_key", "client_secret", "bearer token", "session key"])
        key = rng.choice([lambda: some(hexes, rng.choice([20, 32, 40, 64])), lambda: some(alnum, rng.randint(18, 48)), lambda: "AK" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 18), lambda: rng.choice(["pk_", "sk_live_", "tok-"]) + some(alnum, rng.randint(20, 36)), lambda: some(alnum + "+/", 40) + "=", password, password, lambda: some(alnum[:52], rng.randint(12, 40)), lambda: some(alnum + marks, rng.randint(8, 32))])()
        if rng.random() < 0.25:  # keys that show by themselves, in running text
            return rng.choice([lambda: rng.choice(["AK", "AKIA", "AS"]) + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", rng.choice([16, 16, 18])), lambda: rng.choice(["pk_", "sk_live_", "ghp_", "tok-"]) + some(alnum, rng.randint(20, 36)), lambda: some(alnum, rng.randint(24, 48))])()
        q = rng.choice(['"', "'", '"', ""])
        return label + rng.choice([" = ", "=", ": ", ":", " "]) + q + key + q

    def plain() -> str:
        label = rng.choice([word(), word(), "note", "name", "port", "version", "date", "title", "time", "token", "password", "key", "secret", "session", "access"])
        value = rng.choice([word, word, lambda: f"{word()} {word()} {word()}", lambda: str(rng.randint(0, 99999)), lambda: f"{rng.randint(0, 23)}:{rng.randint(10, 59)}", lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 99)}", lambda: rng.choice(["true", "false", "null", "none", "required", "of", "the", "and", "is"]), lambda: word().title(), lambda: f"{word()}_{word()}", lambda: f"{word()}({word()})", lambda: rng.choice("$%") + "{" + word() + "}"])()
        q = rng.choice(['"', "", "", ""])
        return label + rng.choice([" = ", "=", ": ", ":", " ", " is "]) + q + value + q

    def other() -> str:
        return rng.choice([
            lambda: f"{word()}.{rng.randint(1, 99):02d}@mail{rng.randint(1, 9)}.example.com",
            lambda: f"{name()}.{name()}.{rng.randint(1950, 2010)}@{word()}{rng.randint(1, 9)}.example.{rng.choice(['com', 'org', 'net'])}",
            lambda: f"https://www.{word()}.example.org/{word()}/{rng.randint(1, 99999)}.html",
            lambda: f"/usr/share/{word()}/{word()}-{rng.randint(1, 99)}.{rng.randint(0, 9)}/{word()}.txt",
            lambda: f"{rng.choice(['commit', 'sha1', 'md5', 'checksum', 'revision', 'digest'])} {some(hexes, rng.choice([32, 40, 64]))}",
            lambda: f"uuid {some(hexes, 8)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 12)}",
            lambda: "".join(word() for _ in range(4)) + str(rng.randint(1, 2024)),
            lambda: "_".join([word(), word(), word(), str(rng.randint(1, 99))]),
            lambda: some("0123456789", rng.choice([16, 18, 20])),
            lambda: "-".join(some("0123456789", 4) for _ in range(4)),
            lambda: f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}:00:00.000",
            lambda: f"{word()}-{rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}-{word()}.tar.gz",
            lambda: some("01", rng.randint(16, 40)),
            plain, plain, plain, plain,
            lambda: "1234567890" * 2,
            lambda: f"key{'=' * rng.randint(1, 3)}{''.join(word() for _ in range(3))}{rng.randint(1, 9)}",
        ])()

    while len(out) < rows:
        good = rng.random() < 0.5
        middle = secret() if good else other()
        text = " ".join(word() for _ in range(8)) + " " + middle + rng.choice(["", "", ",", ".", "!!", "###", "%%%"]) + " " + (secret() + " " if not good and rng.random() < 0.25 else "") + " ".join(word() for _ in range(6))
        if rng.random() < 0.15:
            text, middle = text.upper(), middle.upper()
        found = [(s, r) for s, r in candidates(text) if s < text.index(middle) + len(middle) and s + len(r) > text.index(middle)]
        if found:
            out.append((text, *max(found, key=lambda f: len(f[1])), int(good)))
    return out


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(df)


def train(spark: SparkSession, known: Dictionary, findings: list[tuple[str, int, str, int]], trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """Fit the forest on labelled findings (text, start, candidate, label)."""
    rows = [(*features(t, s, r, known), float(y)) for t, s, r, y in findings]
    shape = ", ".join(f"{f} double" for f in (*FEATURES, "label"))
    data = _assembled(spark.createDataFrame(rows, shape)).coalesce(1)
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def scan(docs: DataFrame, findings: list[tuple[str, int, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """Secrets of every whole text: doc_id, start (code points), length, sha256 of the secret, probability.

    Candidates come from one pass of a pattern; the forest judges each by its FEATURES and those
    below ``threshold`` go. Without ``findings`` the built-in constructions are the training set.
    Null and empty texts have none; repeated rows are reported each.
    """
    spark = docs.sparkSession
    counts = dictionary_counts(docs)
    known = Dictionary.of(counts)
    findings = labelled_findings([w for w, _ in counts[:2000]]) if findings is None else findings
    model = train(spark, known, findings)
    shared = spark.sparkContext.broadcast(known)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for start, run in candidates(text or ""):
                    rows.append((doc_id, start, len(run), hashlib.sha256(run.encode()).hexdigest(), *features(text, start, run, shared.value)))
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.float64()] * len(FEATURES)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "sha256", *(f"f_{f}" for f in FEATURES)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = source.mapInArrow(search, "doc_id long, start long, length long, sha256 string, " + ", ".join(f"f_{f} double" for f in FEATURES))
    named = found.select("doc_id", "start", F.col("length").alias("_length"), "sha256", *(F.col(f"f_{f}").alias(f) for f in FEATURES))
    judged = model.transform(_assembled(named)).withColumn("probability", vector_to_array("probability")[1])
    return judged.filter(F.col("probability") >= threshold).select("doc_id", "start", F.col("_length").alias("length"), "sha256", F.round("probability", 6).alias("probability"))
