"""Documents to paragraphs, chunks, language votes, path metadata and word counts."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars as X
from millrace.functions.scalars import words

_END = re.compile(r"[.!?]\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


_TOC, _PAGE, _DIGITS, _NUMBER, _URL, _TITLE = (re.compile(p) for p in (X.NOISE_TOC, X.NOISE_PAGE, X.NOISE_DIGITS, X.NOISE_NUMBER, X.NOISE_URL, X.NOISE_TITLE))


def noise(line: str) -> bool:
    """T2 for one line within ``paragraphs``; the rules and values are those of ``scalars.noise_line``."""
    s, parts = line.strip(), line.split()
    chars, n = len(s), len(line.split())
    if chars < X.NOISE_LEAST or any(p.search(s) for p in (_PAGE, _URL, _TITLE, _TOC)) or (chars < X.NOISE_DIGIT_CHARS and _DIGITS.search(s)):
        return True
    if sum(s.count(c) for c in X.NOISE_MARKS) > X.NOISE_MOST_MARKS or (chars > X.NOISE_DOT_CHARS and s.count(".") > X.NOISE_DOT_SHARE * chars):
        return True
    if n > X.NOISE_SHORT_WORDS and sum(len(w) <= X.NOISE_SHORT for w in parts) > X.NOISE_SHORT_SHARE * n:
        return True
    return n > X.NOISE_NUMBER_WORDS and sum(bool(_NUMBER.search(w)) for w in parts) > X.NOISE_NUMBER_SHARE * n


def repetitive(text: str) -> bool:
    """T3 for one paragraph; the values are those of ``scalars.repetition``."""
    found = text.split()
    if len(found) < X.REPEAT_WORDS:
        return False
    run = 1
    for a, b in zip(found, found[1:]):
        run = run + 1 if a == b else 1
        if run >= X.REPEAT_RUN:
            return True
    content = Counter(w.lower() for w in found if w.lower() not in X.REPEAT_STOP)
    return bool(content) and max(content.values()) > X.REPEAT_SHARE * content.total()


def paragraphs(text: str | None) -> list[str]:
    """Clean lines joined to paragraphs; one ends at a sentence end before an empty line or the end."""
    out, current = [], []
    lines = unicodedata.normalize("NFC", text or "").split("\n")
    for k, line in enumerate(lines):
        s = re.sub(r"[ \t]+", " ", line).strip()
        if s and not noise(s):
            current.append(s)
        last = k == len(lines) - 1
        empty_next = last or not lines[k + 1].strip()
        if current and _END.search(current[-1]) and (empty_next or not s):
            out.append(" ".join(current))
            current = []
    if current:
        out.append(" ".join(current))
    return [p for p in out if len(p) > 30 and not repetitive(p)]


def semantic_chunks(parts: list[str], low: int = 600, high: int = 1400, lossless: bool = True) -> list[str]:
    """T4: paragraphs packed to chunks of ``low`` to ``high`` characters, long ones cut at sentences.

    ``lossless`` keeps a short rest and flushes a pending chunk; without it a rest shorter than
    ``low`` is dropped, as is a short piece that cannot take the next sentence.
    """
    out, pending = [], ""

    def push(chunk: str) -> None:
        if chunk and (lossless or len(chunk) >= low):
            out.append(chunk)

    for part in parts:
        if len(part) > high:
            if lossless:
                push(pending)
            elif len(pending) >= low:
                out.append(pending)
            pending = ""
            piece = ""
            for sentence in _SENTENCE.split(part):
                while len(sentence) > high:
                    push(piece)
                    piece, sentence = "", sentence[high:] if not out.append(sentence[:high]) else ""
                if len(piece) + 1 + len(sentence) <= high or not piece:
                    piece = f"{piece} {sentence}".strip()
                else:
                    push(piece)
                    piece = sentence
            pending = piece
        elif len(pending) < low or len(pending) + 1 + len(part) <= high:
            joined = f"{pending}\n{part}".strip("\n")
            if lossless and len(joined) > high and pending:
                push(pending)
                pending = part
            else:
                pending = joined
        else:
            push(pending)
            pending = part
    push(pending)
    return out


#: Bytes of a batch that Python handles at once.
PORTION = 4 << 20


def portions(batches: Iterator[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches halved until each has ``most`` bytes or one row, so that Python objects are made of a bounded part of a batch."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def chunk(df: DataFrame, key: str, text: str, low: int = 600, high: int = 1400, lossless: bool = True) -> DataFrame:
    """T1-T4, T6, T10 in one Arrow pass: key, position, chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            found = [semantic_chunks(paragraphs(t.as_py()), low, high, lossless) for t in part.column(1)]
            of = pa.array([k for k, chunks in enumerate(found) for _ in chunks], pa.int64())
            position = pa.array([i for chunks in found for i in range(len(chunks))], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), position, pa.array([c for chunks in found for c in chunks], pa.string())], names=[key, "position", "chunk"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, position int, chunk string")


def fixed_windows(df: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 100) -> DataFrame:
    """T5 without snapping: windows of ``size`` characters every size - overlap; native."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    cut = df.filter(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("position", "_start"))
    return cut.select(key, "position", F.substring(F.col(text), F.col("_start") + 1, F.lit(size)).alias("chunk"))


def snapped_windows(text: str, size: int = 1500, overlap: int = 100) -> list[str]:
    """T5 with snapping to a sentence or line end in the last fifth of a window."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            base = at + int(0.8 * size)
            best = max((text.rfind(m, base, end) + len(m) for m in (". ", "! ", "? ", "\n\n", "\n") if text.rfind(m, base, end) >= 0), default=end)
            end = best
        out.append(text[at:end].strip())
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return [c for c in out if c]


def snapped(df: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 100) -> DataFrame:
    """T5 over Arrow batches: key, position, chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            found = [snapped_windows(t.as_py() or "", size, overlap) for t in part.column(1)]
            of = pa.array([k for k, chunks in enumerate(found) for _ in chunks], pa.int64())
            position = pa.array([i for chunks in found for i in range(len(chunks))], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), position, pa.array([c for chunks in found for c in chunks], pa.string())], names=[key, "position", "chunk"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, position int, chunk string")


def language_vote(df: DataFrame, key: str, text: str, profiles: dict[str, list[str]], default: str = "en") -> DataFrame:
    """The language whose stop words occur most, the least code on ties, ``default`` without any."""
    tokens = F.split(F.lower(text), r"[^\p{L}]+")
    known = lambda stop: lambda w: w.isin(stop)
    scored = df.select(key, tokens.alias("_w")).select(key, *[F.size(F.filter("_w", known(stop))).alias(f"s_{lang}") for lang, stop in sorted(profiles.items())])
    top = F.greatest(*[F.col(f"s_{lang}") for lang in profiles])
    vote = F.coalesce(*[F.when((F.col(f"s_{lang}") == top) & (top > 0), F.lit(lang)) for lang in sorted(profiles)], F.lit(default))
    return scored.select(key, vote.alias("language"), top.alias("votes"))


def path_metadata(df: DataFrame, path: str) -> DataFrame:
    """Company, id, year and report type out of a file path."""
    parts = F.split(F.col(path), "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]+$", "")
    pieces = F.split(name, "_")
    year = F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({path}, '(20[12][0-9])', 1), '') AS int)"), F.try_element_at(pieces, F.lit(2)).try_cast("int"))
    at = F.array_position(F.transform(parts, F.lower), F.lit("reports"))
    company = F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))
    ident = F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d{2,3})_", 1), F.lit("")), F.element_at(pieces, 1))
    return df.select("*", company.alias("company"), ident.alias("company_id"), year.alias("year"), F.array_join(F.slice(pieces, 3, 64), "_").alias("report_type"))


def word_frequencies(df: DataFrame, keys: list[str], text: str, stop: list[str], variants: dict[str, str] | None = None, n: int = 20, least: int = 4) -> DataFrame:
    """Top words of each group after stop words and variants; ties by word."""
    rows = df.select(*keys, F.explode(words(F.col(text), least)).alias("word")).filter(~F.col("word").isin(stop))
    if variants:
        rows = rows.withColumn("word", F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in variants.items() for v in p]), F.col("word")), F.col("word")))
    counts = rows.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "word") if keys else Window.orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def classify(df: DataFrame, text: str, model: Callable[[pd.Series], pd.DataFrame], schema: str, batch: int = 32) -> DataFrame:
    """Labels and scores of a pluggable model, loaded once a task, in one pass for all heads."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [model(frame[text].iloc[i : i + batch]) for i in range(0, len(frame), batch)]
            yield pd.concat([frame.reset_index(drop=True), pd.concat(parts, ignore_index=True)], axis=1)

    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{kept}, {schema}")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows by a hash of their key; the same for every run."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def nfc(text: Column) -> Column:
    """Unicode normal form C, over Arrow batches; text of ASCII only is left as it is."""

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return compose(text)


def is_cut(text: Column, tokens: int = 512) -> Column:
    """Whether a text is longer than a model of so many tokens reads, at four characters each."""
    return F.length(text) > 4 * tokens


def sentence_list(text: Column) -> Column:
    """The sentences of a text by their end marks."""
    parts = F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 0)


def translate(df: DataFrame, text: str, lang: str, models: dict[str, Callable[[pd.Series], pd.Series]], batch: int = 16) -> DataFrame:
    """Texts of the languages in ``models`` through their model, batch by batch; others, and those that fail, stay.

    ``translated`` says whether a text is the model's. A batch that fails is tried again text by text.
    """

    def one(model: Callable, texts: pd.Series) -> list[tuple[str | None, bool]]:
        try:
            return [(t, True) for t in model(texts)]
        except Exception:  # a batch too large for the model, or one bad text
            if len(texts) == 1:
                return [(texts.iloc[0], False)]
            return [out for k in range(len(texts)) for out in one(model, texts.iloc[k : k + 1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            out, langs = part.column(text).to_pylist(), part.column(lang).to_pylist()
            done = [False] * len(out)
            for name, model in models.items():
                rows = [k for k, of in enumerate(langs) if of == name and out[k] is not None]
                for k in range(0, len(rows), batch):
                    some = rows[k : k + batch]
                    for at, (found, is_done) in zip(some, one(model, pd.Series([out[i] for i in some], index=some, dtype=object))):
                        out[at], done[at] = found, is_done
            at = part.schema.get_field_index(text)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type)).append_column("translated", pa.array(done))

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", translated boolean")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet; the resume step of incremental runs."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
