"""What the third round found: results that differ from SQL at size, work that grows faster than the input."""

import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard
from millrace.operators import density, panel, text
from millrace.plans import registry
from millrace.sources import tables


def folder(tmp_path, **tables):
    """A folder of tables as the queries read them."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same_as_sql(spark, name, where, *tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = sorted(tuple(r[c] for c in names) for r in registry.queries()[name](spark, where).collect())
    assert got and repr(got) == repr(sorted(want.fetchall()))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_chunk_ids_beyond_three_digits_are_those_of_sql(spark, tmp_path):
    docs = spark.range(1100).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    same_as_sql(spark, "scored_documents", folder(tmp_path, documents=docs, labels=labels), "documents", "labels")


def test_year_of_documents_without_language_is_that_of_sql(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "src1", 1), (2, "b", "es", "src1", 1)], DOCUMENTS)
    plain = docs.unionByName(spark.createDataFrame([(3, "c", None, "src2", 1)], DOCUMENTS))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    where = folder(tmp_path, documents=plain, labels=labels)
    got = {(r["company"], r["company_id"]): r["year"] for r in registry.queries()["scored_documents"](spark, where).collect()}
    assert got == {("src1", "en"): 2019, ("src1", "es"): 0, ("src2", None): 2020}


@pytest.mark.parametrize("text", ["Ä Ä Ä Ä Ä Ä", "aÄ B C D E F", "éA B C", "_A B C", "x\u000bA\u000bB\u000bC", "ÖA B C Ü D E", "A  B\n\tC Ä Ö Ü"])
def test_spaced_capitals_are_those_of_sql(spark, tmp_path, text):
    docs = spark.createDataFrame([(1, text, "de", "src1", len(text))], DOCUMENTS)
    same_as_sql(spark, "spaced_capitals", folder(tmp_path, documents=docs), "documents")


def test_repetition_of_a_long_text_takes_time_in_proportion(spark, tmp_path):
    long, last = " ".join(f"w{i % 7919}" for i in range(60_000)), "Aa b\tb b b\nb c d e f b " + "x y " * 9
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate((long, long + " q q q q q", "q qq q q q q " * 3, last, "a b", ""))], DOCUMENTS)
    where, began = folder(tmp_path, documents=docs), time.perf_counter()
    same_as_sql(spark, "repetition_flag", where, "documents")
    assert time.perf_counter() - began < 60


def test_blocks_meet_each_box_of_a_page_once_and_stay_where_nothing_is_known_of_them(spark):
    kinds = "page long, kind string, text string, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([(1, "text", "in", 1.0, 1.0, 9.0, 9.0), (1, "text", "half", 5.0, 0.0, 15.0, 10.0), (1, "text", "out", 50.0, 50.0, 60.0, 60.0), (1, "text", "none", None, 2.0, 3.0, 9.0), (2, "text", "other page", 1.0, 1.0, 9.0, 9.0)], kinds)
    boxes = spark.range(3000).select(F.lit(1).cast("long").alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"))
    found = tables.block_text(blocks, boxes, ["page"])
    assert {r["page"]: (r["text"], r["n_blocks"]) for r in found.collect()} == {1: ("half\nnone\nout", 3), 2: ("other page", 1)}
    assert "collect_list(struct(x0" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_periods_are_grouped_and_not_joined_row_by_row(spark):
    a, b = (spark.range(1000).select((F.col("id") % k).cast("int").alias("t")) for k in (7, 5))
    found = panel.common_periods(a, b, "t")
    assert sorted(r["t"] for r in found.collect()) == [0, 1, 2, 3, 4]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_joins_of_the_jaccard_join_broadcast_a_bounded_table(spark):
    rows = spark.range(10).withColumnRenamed("id", "doc_id")
    for n, hints in ((1000, 1), (300_000, 0)):
        small = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("node"))
        found = jaccard.join_checked(rows, small, "doc_id")
        assert found._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == hints and found.count() == 10


def test_vocabulary_counts_documents_by_key_and_shuffles_no_terms_of_documents(spark, tmp_path):
    rows = [(k // 2 if k < 8 else k, "alpha beta gamma" if k < 9 else "other words here", "en", "src1", 1) for k in range(30)] + [(None, "alpha beta", "en", "src1", 1)] * 2
    where = folder(tmp_path, documents=spark.createDataFrame(rows, DOCUMENTS))
    same_as_sql(spark, "ngram_vocabulary", where, "documents")
    plan = registry.queries()["ngram_vocabulary"](spark, where)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L, term", plan)


def test_python_makes_objects_of_a_bounded_part_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"id": list(range(300)), "text": ["x" * (100_000 if k % 7 else 10) for k in range(300)]})
    parts = list(text.portions([batch], 1 << 20))
    assert max(p.nbytes for p in parts if p.num_rows > 1) <= 1 << 20 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in text.portions([batch.slice(0, 0), batch.slice(1, 1)], 10)] == [1]


def test_neighbours_and_tree_by_blocks_that_grow_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.round(rng.normal(size=(1300, 3)), 1), rng.normal(size=(1300, 3)) + 5])
    rows = density.points(spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    assert density._blocks(rows, 40)[1] <= density.BLOCKS + 1  # 65 of 40 points before, in 2 145 pairs
    apart = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    near = {(r["id"], r["rank"]): (r["other"], r["distance"]) for r in density.neighbours(rows, 4, 40).collect()}
    for k in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), apart[k])) if j != k][:4]
        assert [near[k, r + 1][0] for r in range(4)] == order and np.allclose([near[k, r + 1][1] for r in range(4)], apart[k][order])
    core = np.sort(apart, 1)[:, 4]
    a, b, w = density._prim(np.arange(len(x)), x, core)
    weight, reached, least = np.maximum(np.maximum(apart, core), core[:, None]), np.zeros(len(x), bool), np.full(len(x), np.inf)
    at, total = 0, 0.0
    for _ in range(len(x) - 1):
        reached[at] = True
        least = np.minimum(least, weight[at])
        at = int(np.where(reached, np.inf, least).argmin())
        total += least[at]
    assert np.isclose(w.sum(), total)
    assert len(a) == len(x) - 1 and (a < b).all() and np.allclose(w, weight[a, b])
