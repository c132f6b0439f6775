"""What the third round's findings left: rows without keys, ties, and work for each token."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from millrace.operators import language
from millrace.plans import registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(tmp_path, **tables):
    """A folder of tables as the queries read them."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def alike(spark, name, where, *tables):
    """The rows of a query and of its SQL, whatever is null in them."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = Counter(tuple(r[c] for c in names) for r in registry.queries()[name](spark, where).collect())
    assert got == Counter(want.fetchall())
    return got


def test_chunks_of_rows_without_id_or_source_and_of_equal_ids_are_those_of_sql(spark, tmp_path):
    rows = [(1, "a", "en", "src1", 1), (1, "bbb", "en", "src1", 3), (1, "aa", "en", "src1", 2), (2, "c", "en", "src1", 1), (None, "dddd", "en", "src1", 4), (3, "e", "en", None, 1), (4, None, "en", "src12", None), (5, "f", None, "src12", 1), (6, None, None, None, None), (7, "", "es", None, 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS).coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    alike(spark, "scored_documents", folder(tmp_path, documents=docs, labels=labels), "documents", "labels")


def test_a_company_beyond_one_document_keeps_its_positions(spark, tmp_path):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    labels = spark.range(0, 700, 3).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = alike(spark, "scored_documents", folder(tmp_path, documents=docs, labels=labels), "documents", "labels")
    assert sorted(r[3] for r in got) == list(range(700))


def test_years_are_of_all_digits_of_a_source(spark, tmp_path):
    rows = [(k, "a", lang, source, 1) for k, (lang, source) in enumerate((l, s) for l in ("en", "es", None) for s in ("src00000000012", "src0000000005", "src12", "src-3", "src2147483644"))]
    docs = spark.createDataFrame(rows + [(99, "b", "en", "äöü 4 ", 1)], DOCUMENTS)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = alike(spark, "scored_documents", folder(tmp_path, documents=docs, labels=labels), "documents", "labels")
    assert {r[2] for r in got if r[0] == "src00000000012" and r[1] == "en"} == {2020}


def test_cached_documents_of_odd_rows_are_those_of_sql(spark, tmp_path):
    texts = ("a", "b\u0085c", "d\u2028e\u2029f", "g\x1ch\x0bi\x0cj\rk\nl", "", None)
    rows = [(k, text, lang, source, 1) for k, (text, lang, source) in enumerate((t, l, s) for t in texts for l in ("en", "es", None) for s in ("src3", "src00000000012", None))]
    docs = spark.createDataFrame(rows, DOCUMENTS).coalesce(1)
    alike(spark, "cached_documents", folder(tmp_path, documents=docs), "documents")


def test_topics_are_of_all_digits_of_a_source(spark, tmp_path):
    docs = spark.createDataFrame([(k, text, "en", source, 1) for k, (text, source) in enumerate((("lorem ipsum dolor", "src00000000012"), ("amet elit", "src1"), ("dolor elit", "src0")))], DOCUMENTS)
    alike(spark, "topic_labels", folder(tmp_path, documents=docs), "documents")


ODD = [
    "Dr. Smith came. He left at 5. Then no. 7 was here! \"Really?\" (Yes.) she said.", "ÄRGER. Über etc. und so. ÉTÉ. Été. x. Y. Z", "a.\u000b b.\r\nC.\fd. \t e", " . .. ... ! ?! .) (. ).( \"' ", "etc.", "Etc. 12. 13. vier. 3.5. Fünf", "", "   ", None,
    "etc. and etc. The etc. the vs. Cat the cat etc. Dog a.m. Then p.m. then", "ß. ẞ. STRASSE. Straße. ǅ. Α. α. ΩΣ. x", "U+ nb sp. A\u0085b. C", "one two\nthree", "?\n!\n.\na", "[Etc.] (etc.), 'No.'; 9.) d", "7. a 7. A 7.", "e.g. i.e. z.B. Er",
]


def test_sentences_and_words_of_odd_texts_are_those_of_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in enumerate(ODD)], DOCUMENTS)
    more = spark.range(100, 160).select("id", F.lit("We met vs. them etc. and the cat etc. near. The cat, vs. Dogs the dogs. It was.").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    where = folder(tmp_path, documents=docs.unionByName(more.withColumnRenamed("id", "doc_id")))
    alike(spark, "learned_sentences", where, "documents")
    alike(spark, "learned_abbreviations", where, "documents")


def test_words_are_told_for_each_distinct_token_only(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A word. Another word", "en", "src1", 1)], DOCUMENTS)
    where = folder(tmp_path, documents=docs)
    plan = language.word_statistics(spark.read.parquet(f"{where}/documents.parquet"), "text")._jdf.queryExecution().executedPlan().toString()
    tokens = plan[plan.rindex("Exchange ") :]  # what is done before texts' tokens are counted
    assert "lower(" not in tokens and "RLIKE" not in tokens and "Scan parquet" in tokens
