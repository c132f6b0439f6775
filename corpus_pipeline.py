"""The corpus pipeline: from raw documents to token shards of a balanced, clean mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, jaccard, langid, mixing, sstable
from millrace.llm.shared import release, stored, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the output codes give a language clearly; ambiguous ones, null texts and texts without letters go.

    Ties and repeated rows fare alike; no documents give none; without labelled documents only texts without letters go.
    """
    return langid.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8, the one of the least doc_id.

    Null and wordless texts, and rows without doc_id, link to nothing and stay; of rows that repeat an id one stays.
    """
    return jaccard.one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none, an empty benchmark takes none away."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source's target takes it; a null source is one, repeated rows are drawn one by one."""
    return mixing.mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, read back as one row a document; null texts have the end id only, null ids come first."""
    return sstable.tokens_table(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing_sources", mixing_sources), ("token_shards", token_shards)]

#: SQL cannot express the learned, the metric and the tokenising stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next, what it was made from is then removed."""
    docs, others = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, docs, others)
    return STAGES[-1][1](spark, docs, sf_dir)
