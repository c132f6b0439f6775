"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v).removesuffix("+00:00")


def test_every_query_has_sql_or_is_listed():
    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {"semantic_chunks", "mmr_topk", "kmeans_topics", "panel_subset_search", "granger_lags", "random_intercept_model", "random_forest_eval", "keyword_rerank", "staged_topic_search", "snapped_chunks", "density_topics", "density_staged_search", "topic_merge_tree", "best_treatment_year", "mixed_model_terms"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    got = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(cell(row[names.index(c)]) for c in sorted(names)) for row in sql.fetchall())
    assert got == want
