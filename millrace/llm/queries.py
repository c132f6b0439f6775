"""The queries ``opN_<name>`` of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import codes, conversations, decontaminate, discriminant, html, jaccard, langid, mixing, quality, reference_sql, rollup, secrets, sstable, suffixes
from millrace.llm.components import join_checked
from millrace.llm.shared import cut, fresh_path, stored, table


def op1_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to sorted-string-table shards and read back."""
    return sstable.tokens_table(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, after the forest has removed false positives."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingles and a similarity of 0.9."""
    return jaccard.link_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with how many of their words the mix takes."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their statistics and the decision list's verdict."""
    judged = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version, kept by deltas.

    Batches: all documents under both versions; documents labelled toxic go; those labelled as
    poor lose their SYMBOLS and are counted anew; then the first batch once more, which the rollup knows and leaves out.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = cut(labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"), F.min("quality").alias("_quality")))
    poor = F.when((F.col("_quality") == 0) & (F.coalesce("_toxic", F.lit(0)) != 1), F.regexp_replace("text", rollup.SYMBOLS, ""))
    known = stored(rollup.counted(join_checked(docs, marks, "doc_id", "left").withColumn("_again", poor), rollup.versions(), again="_again"), "token-counts")
    gone = join_checked(known, cut(marks.filter("_toxic = 1").select("doc_id")), "doc_id")
    kept = rollup.Rollup(spark, fresh_path(spark, "rollup"))
    for name, change in (("load", rollup.inserts(known)), ("takedown", rollup.deletes(gone)), ("recount", rollup.revisions(known.filter("n_again is not null"), "n_again", "chars_again")), ("load", rollup.inserts(known))):
        kept.commit(name, change)
    return kept.totals()


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more of all documents that occur again in the corpus."""
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.transform("spans", lambda s: F.array(s["first"], s["last"])).alias("spans"), "n_repeated", "n_words")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: faults, cheapest edits and the digest of the repaired rows."""
    return conversations.audits(conversations.damaged(table(spark, sf_dir, "conversations")), "_gone")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes under codebooks of six rounds."""
    return codes.compressed_vectors(table(spark, sf_dir, "embeddings"))


def op13_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the discriminant's quality score."""
    return discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    """Name to callable."""
    return {f.__name__: f for f in (op1_sstable_tokens, op2_secret_scan, op3_jaccard_join, op4_language_id, op5_html_extraction, op6_mix_sources, op7_quality_rules, op8_benchmark_leaks, op9_token_rollups, op10_suffix_dedup, op11_conversation_repair, op12_vector_codes, op13_quality_discriminant)}


def oracle_sql() -> dict:
    """Name to DuckDB SQL; the others need tokenizers, learned models or joins that SQL has no terms for."""
    return {"op11_conversation_repair": reference_sql.OP11_SQL, "op12_vector_codes": reference_sql.OP12_SQL}
