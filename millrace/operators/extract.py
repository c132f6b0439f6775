"""Batched extraction: prompts, response parsing, deduplication, resume."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = "\n\n---\n\n"


@dataclass(frozen=True)
class ExtractConfig:
    """Limits that set the batch size, and retries."""

    context: int = 32_000
    prompt_chars: int = 2_000
    chunk_tokens: int = 400
    output_tokens: int = 30
    margin: int = 500
    attempts: int = 3
    least_wait: float = 10.0

    def batch_size(self) -> int:
        """Chunks that fit a context window, one at least."""
        return max(1, int((min(self.context, 32_000) - self.prompt_chars // 4 - self.margin) / (self.chunk_tokens + self.output_tokens)))


def above_threshold(df: DataFrame, score: str, least: float) -> DataFrame:
    """A missing score counts 0; no filter at threshold 0."""
    return df if least <= 0 else df.filter(F.coalesce(F.col(score), F.lit(0.0)) >= least)


def batches(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """Position and batch number within keys."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", rn).withColumn("batch", F.floor((rn - 1) / size).cast("int"))


def parse_bullets(text):
    """Items of a bulleted answer: lines of ten characters or more without their mark; none for the sentinel."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: F.length(x) >= 10)
    bare = F.transform(kept, lambda x: F.trim(F.regexp_replace(x, r"^([-•*–·]|[0-9][.):])\s*", "")))
    return F.when(F.upper(text).contains("NONE_FOUND"), F.array().cast("array<string>")).otherwise(bare)


def parse_numbered(text):
    """A map of N to label out of lines ``N: label``."""
    pairs = F.filter(F.transform(F.split(text, "\n"), lambda x: F.split(x, ":", 2)), lambda p: (F.size(p) == 2) & F.trim(p[0]).rlike("^[0-9]+$"))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.trim(p[0]).cast("int"), F.trim(p[1])))))


def retry_after(message: str, least: float = 10.0) -> float:
    """Seconds to wait that an error asks for."""
    found = re.search(r"retry.*?(\d+)", message, re.I | re.S)
    return max(least, float(found.group(1)) if found else least)


def retry_seconds(message, least: int = 10):
    """X23 as a Column: the seconds that an error asks to wait, ``least`` or more."""
    asked = F.nullif(F.regexp_extract(message, r"(?is)retry.*?(\d+)", 1), F.lit("")).try_cast("int")
    return F.greatest(F.lit(least), F.coalesce(asked, F.lit(least)))


def batch_size_of(context, config: "ExtractConfig" = None):
    """X33 as a Column of the context's size."""
    c = config or ExtractConfig()
    fit = (F.least(context, F.lit(32_000)) - c.prompt_chars // 4 - c.margin) / (c.chunk_tokens + c.output_tokens)
    return F.greatest(F.lit(1), F.floor(fit)).cast("int")


def bullet_lines(text):
    """The number of bullet lines of an answer."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*([-•*–·]|\d[.):])")))


def joined(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """L2, L4: the texts of each batch in order, joined by the separator; a batch is bounded by its size."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", text))), lambda x: x[text])
    return df.groupBy(*keys, "batch").agg(F.array_join(ordered, SEPARATOR).alias("joined"), F.count(F.lit(1)).alias("n_texts"))


def pipeline(approach: str, model: Callable[[str], str] | None = None, providers: dict[str, Callable[[str], str]] | None = None) -> Callable[[str], str]:
    """The model of an approach: one that is given, or a provider by its name."""
    if model is not None:
        return model
    if approach not in (providers or {}):
        raise ValueError(f"unknown approach {approach!r}")
    return providers[approach]


def run_model(df: DataFrame, keys: list[str], text: str, prompt: str, model: Callable[[str], str], config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """Prompts of joined batches through a pluggable model, retried on rate limits only.

    A batch is bounded by the batch size; a failing batch gets its error, the others go on.
    """
    packed = joined(df, keys, text).withColumnRenamed("joined", "_joined").drop("n_texts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for joined in frame["_joined"]:
                answer = error = None
                for attempt in range(config.attempts):
                    try:
                        answer = model(f"{prompt}\n\n{joined}")
                        error = None
                        break
                    except Exception as e:  # isolated: reported in the row
                        error = f"{type(e).__name__}: {e}"
                        if "rate" not in str(e).lower() or attempt == config.attempts - 1:
                            break
                        time.sleep(retry_after(str(e), config.least_wait))
                answers.append(answer)
                errors.append(error)
            yield frame.drop(columns="_joined").assign(answer=answers, error=errors)

    kinds = dict(df.dtypes)
    return packed.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", batch int, answer string, error string")


def run_models(df: DataFrame, keys: list[str], text: str, prompt: str, models: dict[str, Callable[[str], str]], config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """The same prompts through several models, a row a prompt and model."""
    out = None
    for name, model in models.items():
        found = run_model(df, keys, text, prompt, model, config).withColumn("model", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def agreement(answers: DataFrame, keys: list[str], model: str = "model", answer: str = "answer") -> DataFrame:
    """For each two models the prompts that both answered, and in how many they say the same.

    The answers to one prompt, as many as there are models, meet in one row; no prompt meets another.
    """
    said = answers.filter(F.col(answer).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.col(model).alias("m"), F.col(answer).alias("a")))).alias("_s"))
    pairs = F.flatten(F.transform("_s", lambda x: F.transform(F.filter("_s", lambda y: y["m"] > x["m"]), lambda y: F.struct(x["m"].alias("a"), y["m"].alias("b"), (x["a"] == y["a"]).alias("same")))))
    each = said.select(F.explode(pairs).alias("p"))
    return each.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(F.col("p.same")).alias("n_equal")).withColumn("agreement", F.col("n_equal") / F.col("n_prompts"))


def format_ok(answer: str, least: int = 2) -> bool:
    """Whether an answer has enough bullet lines."""
    return sum(bool(re.match(r"\s*([-•*–·]|\d[.):])", line)) for line in answer.split("\n")) >= least


def n_batches(chunks: int, size: int) -> int:
    """A27 on the driver: ceiling division."""
    return math.ceil(chunks / size)
