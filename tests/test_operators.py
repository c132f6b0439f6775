"""Golden numbers, properties and edge cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as X
from millrace.operators import econometrics as E
from millrace.operators import extract as L
from millrace.operators import panel as P
from millrace.operators import retrieval as R
from millrace.operators import scoring as G
from millrace.operators import stats as S
from millrace.operators import text as T
from millrace.sources import sinks, tables


def one(df):
    return df.collect()[0]


def test_ratio_clamp_bands_and_groups(spark):
    row = one(spark.range(1).select(X.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), X.clamp(F.lit(40.0), 0, 30).alias("b"), X.clamp(F.lit(None).cast("double"), 0, 30).alias("c"), X.band(F.lit(60.0), X.SCORE_BANDS, "WEAK").alias("d"), X.substring_group(F.lit("BF-BOF, EAF"), [("EAF", "EAF"), ("BF-BOF", "BF")]).alias("e"), X.substring_group(F.lit(None).cast("string"), [("EAF", "EAF")]).alias("f")))
    assert tuple(row) == (None, 30.0, None, "LEADER", "EAF", "Other")


def test_group_stats_single_row_and_nulls(spark):
    rows = {r["g"]: r for r in S.group_stats(spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), (None, 1.0)], "g string, x double"), ["g"], "x").collect()}
    assert rows["a"]["count"] == 1 and rows["a"]["std"] is None
    assert rows["b"]["mean"] == 3.0 and rows["b"]["std"] == 1.414 and None in rows


def test_weighted_mean_without_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 1.0, 1.0), ("b", 5.0, 3.0)], "k string, x double, w double")
    assert {r["k"]: r["weighted_mean"] for r in S.weighted_mean(df, ["k"], "x", "w").collect()} == {"a": 2.0, "b": 4.0}


def test_delta_skips_gaps_and_split_is_chronological(spark):
    df = spark.createDataFrame([("a", 2013, 1.0), ("a", 2015, 4.0), ("a", 2016, 2.0), ("b", 2013, 1.0)], "k string, t int, y double")
    assert [r["delta"] for r in P.delta(df, "k", "t", "y").orderBy("k", "t").collect()] == [None, 3.0, -2.0, None]
    assert [r["is_train"] for r in P.chrono_split(df, "k", "t").orderBy("k", "t").collect()] == [True, True, False, False]


def test_best_available_prefers_first_on_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, None), ("b", None, 2.0)], "k string, x double, z double")
    assert {r["k"]: r["method"] for r in P.best_available(df, "k", "x", "z").collect()} == {"a": "x", "b": "z"}


def test_scores(spark):
    row = one(spark.range(1).select(G.performance(F.lit(0.5)).alias("a"), G.performance(F.lit(None).cast("double")).alias("b"), G.trend(F.lit(-0.01), F.lit(0.6), F.lit(5)).alias("c"), G.trend(F.lit(0.0), F.lit(None).cast("double"), F.lit(5)).alias("d"), G.renewable(F.lit(85.0), F.lit(False)).alias("e"), G.renewable(F.lit(85.0), F.lit(True)).alias("f"), G.talk_score(F.lit(100.0), F.lit(1.0), F.lit(1.0)).alias("g")))
    assert tuple(row) == pytest.approx((22.5, 0.0, 15.0, 0.0, 5.0, 0.0, 100.0))


def test_t_test_and_group_means_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0)], "g string, y double")
    assert one(E.t_test(df, "g", "y", "a", "b"))["t"] == pytest.approx(-3 / np.sqrt(4 / 3 * (1 / 3 + 1 / 2)))
    fit = one(E.group_mean_fit(df, "g", "y"))
    assert fit["r2"] == pytest.approx(1 - 4 / 14.8) and fit["rmse"] == pytest.approx(np.sqrt(4 / 5))


def test_distributions_against_known_values():
    assert E.t_p(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert E.f_p(3.492828476735633, 2, 20) == pytest.approx(0.05, abs=1e-9)


def test_panel_ols_recovers_slope_and_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(f"e{i}", t, float(3.0 * x + i), float(x)) for i in range(6) for t, x in enumerate(rng.normal(size=5))]
    df = spark.createDataFrame(rows, "k string, t int, y double, x double")
    for effects in ("entity", "twoway"):
        fit = E.panel_ols(df, "y", ["x"], "k", "t", effects, cluster="k")
        assert fit.coef[0] == pytest.approx(3.0, abs=1e-6) and fit.r2 > 0.999999


def test_subset_search_orders_by_bic(spark):
    rng = np.random.default_rng(2)
    rows = [(float(2 * a + 0.01 * e), float(a), float(b)) for a, b, e in rng.normal(size=(60, 3))]
    best = E.subset_search(spark.createDataFrame(rows, "y double, a double, b double"), "y", ["a", "b"]).first()
    assert "a" in best["terms"].split(",") and best["r2"] > 0.99


def test_mmr_with_lambda_one_is_similarity_search(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "item_id long, embedding array<double>, topic int")
    q = items.filter("item_id < 2").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"), "topic")
    near = {(r["query_id"], r["rank"]): r["item_id"] for r in R.topk(q, items, 5, ["topic"]).collect()}
    assert near == {(r["query_id"], r["rank"]): r["item_id"] for r in R.mmr(q, items, 5, ["topic"], 20, 1.0).collect()}
    assert near[0, 1] == 0 and len(near) == 10


def test_mmr_answers_every_hundredth_item(spark, tmp_path):
    from millrace.plans import analytics

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i // 100 % 3) for i in range(450)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = analytics.mmr_topk(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in out} == {0, 100, 200, 300, 400} and len(out) == 25
    assert all(r["item_id"] // 100 % 3 == r["query_id"] // 100 % 3 for r in out)


def test_chunks_are_lossless_and_bounded():
    parts = ["A short start here that is long enough.", *["Word " * 60 + "end." for _ in range(12)], "x" * 4000]
    found = T.semantic_chunks(parts, 600, 1400)
    assert all(len(c) <= 1400 for c in found)
    assert "".join("".join(found).split()) == "".join("".join(parts).split())
    assert len("".join(T.semantic_chunks(parts[:2], 600, 1400, lossless=False))) <= len("".join(found))


def test_paragraph_rules():
    text = "First line of the text\n\nends only here at last.\n\n12\nPage 3\nAnother paragraph that is long enough to stay."
    assert T.paragraphs(text) == ["First line of the text ends only here at last.", "Another paragraph that is long enough to stay."]
    assert T.paragraphs(None) == [] and T.noise("HTTPS://www.example.org/x") and not T.noise("www.example.org/x") and T.noise("3 of 12") and T.noise("Contents ........ 12") and not T.noise("A plain sentence of text.")
    assert T.repetitive("go go go go go and then some more words") and not T.repetitive("too short")


def test_noise_column_equals_python(spark):
    lines = ["ab", "a b c d e f", "Chapter one ....... 12", "page 12 of the book", "12.5%", "1 2 3 4 5 6 7 8 9 x", "https://a.b/c", "- - - - - -", "A Plain sentence.", ""]
    got = [r[0] for r in spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "l string, i int").orderBy("i").select(X.noise_line(F.col("l"))).collect()]
    assert got == [T.noise(x) for x in lines]


def test_windows_snap_and_fixed(spark):
    text = "One sentence. " * 300
    parts = T.snapped_windows(text, 500, 50)
    assert all(len(p) <= 500 for p in parts) and parts[0].endswith(".")
    df = spark.createDataFrame([(1, "abcdefghij"), (2, None), (3, "")], "k int, t string")
    assert [r["chunk"] for r in T.fixed_windows(df, "k", "t", 4, 1).orderBy("position").collect()] == ["abcd", "defg", "ghij", "j"]


def test_bullets_labels_and_batches(spark):
    row = one(spark.createDataFrame([("- a longer item here\nshort\n1. another long item\n• third long item", "1: one\n2: two: b\nx: no", "none_found")], "a string, b string, c string").select(L.parse_bullets(F.col("a")).alias("a"), L.parse_numbered(F.col("b")).alias("b"), L.parse_bullets(F.col("c")).alias("c")))
    assert row["a"] == ["a longer item here", "another long item", "third long item"] and row["b"] == {1: "one", 2: "two: b"} and row["c"] == []
    assert L.ExtractConfig().batch_size() == int((32000 - 500 - 500) / 430) and L.retry_after("please retry in 42 s") == 42.0


def test_model_run_isolates_errors(spark):
    df = L.batches(spark.createDataFrame([(1, "x"), (1, "y"), (2, "boom")], "k int, t string"), ["k"], ["t"], 2)

    def model(prompt):
        if "boom" in prompt:
            raise ValueError("broken")
        return prompt.replace("\n", "|")

    rows = {r["k"]: r for r in L.run_model(df, ["k"], "t", "P", model).collect()}
    assert rows[1]["answer"] == "P||x||---||y" and rows[1]["error"] is None and rows[2]["error"] == "ValueError: broken"


def test_csv_and_json_folders(spark, tmp_path):
    (tmp_path / "a_1.csv").write_text("id,text\n001,good\n002,NO_ITEMS\n")
    (tmp_path / "a_2.csv").write_text("\n")
    (tmp_path / "b_1.csv").write_text("id,text\n009,other\n")
    rows = tables.scan_csv_folder(spark, str(tmp_path), "a", "id string, text string", text="text").collect()
    assert [tuple(r) for r in rows] == [("001", "good")]
    (tmp_path / "x_bert.json").write_text('{"pdf_path": "p", "company_id": "001", "year": null, "chunks": [{"text": "t"}]}')
    docs = tables.scan_scored(spark, str(tmp_path), before_year=2025)
    chunk = one(tables.explode_chunks(docs))
    assert (chunk["chunk_id"], chunk["company"], chunk["year"], chunk["sentiment_label"], chunk["detector_score"]) == ("chunk_000", "Unknown", 0, "neutral", 0.0)


def test_path_metadata_and_names(spark):
    df = spark.createDataFrame([("/d/Reports/Acme/012_2021_annual_full.pdf",), ("x_y_z.pdf",)], "p string")
    a, b = T.path_metadata(df, "p").collect()
    assert (a["company"], a["company_id"], a["year"], a["report_type"]) == ("Acme", "012", 2021, "annual_full")
    assert (b["company"], b["company_id"], b["year"]) == (None, "x", None)
    assert tables.normal_name(" A (b)  c/d! ") == "a_b_c_d"


def test_runs_and_partitions(spark, tmp_path):
    root = str(tmp_path / "out")
    assert sinks.next_run(spark, root).endswith("run_01")
    sinks.write_stats(spark, {"a": 1}, root + "/run_07")
    assert sinks.runs(spark, root) == ["run_07"] and sinks.next_run(spark, root).endswith("run_08")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_partitioned(df, root + "/t", "k")
    sinks.write_partitioned(df.filter("k = 'a'").withColumn("v", F.lit(9)), root + "/t", "k")
    assert {r["k"]: r["v"] for r in spark.read.parquet(root + "/t").collect()} == {"a": 9, "b": 2}


def test_stream_ingest_is_incremental(spark, tmp_path):
    from millrace.streaming.events import ingest, read_stream

    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "id int, s string").select("id", F.col("s").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(src)
    for _ in range(2):
        ingest(read_stream(spark, src, df.schema), "id", "ts", "1 hour", out, ck)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_snapped_chunks_cover_the_text_and_end_at_sentences(spark):
    from millrace.plans import registry

    rows = registry.queries()["snapped_chunks"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["position"])):
        by.setdefault(r["doc_id"], []).append(r["chunk"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for i, chunks in by.items():
        assert all(0 < len(c) <= 1500 and c in texts[i] for c in chunks)
        assert texts[i].strip().startswith(chunks[0]) and texts[i].strip().endswith(chunks[-1])


def test_reranked_keywords_are_candidates_and_unlike(spark):
    rows = [(0, "a", [1.0, 0.0], [1.0, 0.2]), (0, "b", [0.99, 0.01], [1.0, 0.2]), (0, "c", [0.0, 1.0], [1.0, 0.2]), (1, "d", [1.0, 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "topic int, term string, v array<double>, c array<double>")
    from millrace.operators import topics

    got = {(r["topic"], r["rank"]): r["term"] for r in topics.reranked(df, "topic", "term", "v", "c", n=2, diversity=0.6).collect()}
    assert got == {(0, 1): "b", (0, 2): "c", (1, 1): "d"} or got == {(0, 1): "a", (0, 2): "c", (1, 1): "d"}


def test_staged_search_locks_the_best(spark):
    from millrace.plans import registry

    rows = registry.queries()["staged_topic_search"](spark, "/root/testdata/sf0.001").collect()
    first, second = [r for r in rows if r["stage"] == 1], [r for r in rows if r["stage"] == 2]
    best = min(first, key=lambda r: (-r["score"], r["k"], r["dims"]))
    assert {r["k"] for r in first} == {6, 10} and {r["k"] for r in second} == {best["k"]} and {r["dims"] for r in second} == {4, 8}


def test_quantiles_equal_numpy_with_nulls_and_hot_groups(spark):
    import numpy as np

    from millrace.operators import stats

    rng = np.random.default_rng(3)
    rows = [(None if k % 5 == 0 else f"g{k % 3}", None if k % 11 == 0 else float(rng.integers(0, 40))) for k in range(900)] + [("hot", 7.0)] * 2000 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in stats.quantiles(df, ["g"], "v", {"a": 0.3, "b": 0.9}).collect()}
    for g in {g for g, v in rows if v is not None}:
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(own, [0.3, 0.9])))
    assert "none" not in got


def test_twoway_effects_on_an_unbalanced_panel_equal_dummies(spark):
    import numpy as np

    from millrace.operators import econometrics

    rng = np.random.default_rng(5)
    rows = [(e, t, float(rng.normal()), float(rng.normal())) for e in range(12) for t in range(6) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "e int, t int, x double, y double")
    fit = econometrics.panel_ols(df, "y", ["x"], "e", "t", "twoway", cluster="e", least=1)
    a = np.array(rows)
    x = np.column_stack([a[:, 2], *(a[:, 0] == e for e in range(12)), *(a[:, 1] == t for t in range(1, 6))]).astype(float)
    assert fit.coef[0] == pytest.approx(np.linalg.lstsq(x, a[:, 3], rcond=None)[0][0])
    assert np.isfinite(fit.se[0]) and fit.se[0] > 0


def test_translation_falls_back_to_single_texts(spark):
    from millrace.operators import text

    def model(texts):
        if len(texts) > 1 or texts.iloc[0] == "bad":
            raise MemoryError
        return "t:" + texts

    df = spark.createDataFrame([(1, "de", "a"), (2, "de", "bad"), (3, "fr", "c"), (4, "de", None)], "i int, lang string, text string")
    got = {r["i"]: (r["text"], r["translated"]) for r in text.translate(df, "text", "lang", {"de": model}).collect()}
    assert got == {1: ("t:a", True), 2: ("bad", False), 3: ("c", False), 4: (None, False)}


def test_mixed_model_equals_a_dense_likelihood(spark):
    rng = np.random.default_rng(11)
    effect = rng.normal(0, 1.5, 30)
    rows = [(e, float(a), float(b), float(2 + 0.7 * a - 0.3 * b + effect[e] + rng.normal(0, 0.6))) for e in range(30) for a, b in rng.normal(size=(2 + e % 5, 2))]
    m = E.mixed_model(spark.createDataFrame(rows, "e int, a double, b double, y double"), "y", ["a", "b"], "e")
    z = np.array(rows)
    x, y = np.column_stack([np.ones(len(z)), z[:, 1:3]]), z[:, 3]

    def loss(var_e, var_u):
        v = var_e * np.eye(len(z)) + var_u * (z[:, :1] == z[:, 0])
        i = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ i @ x, x.T @ i @ y)
        r = y - x @ beta
        return np.linalg.slogdet(v)[1] + r @ i @ r + np.linalg.slogdet(x.T @ i @ x)[1], beta

    best, beta = loss(m["var_residual"], m["var_entity"])
    assert list(m["coef"].values()) == pytest.approx(beta.tolist(), rel=1e-6)
    assert all(best <= loss(m["var_residual"] * f, m["var_entity"] * h)[0] + 1e-9 for f in (0.97, 1, 1.03) for h in (0.97, 1, 1.03))


def test_granger_wald_and_subsets_under_effects(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(25):
        x, y = rng.normal(size=14), np.zeros(14)
        for t in range(2, 14):
            y[t] = 0.3 * y[t - 1] + 0.8 * x[t - 1] + 0.1 * rng.normal()
        rows += [(e, t, float(x[t]), float(y[t] + e)) for t in range(14)]
    df = spark.createDataFrame(rows, "e int, t int, x double, y double")
    g = E.granger(df, "y", "x", "e", "t")
    assert g["p"] < 1e-6 and g["p_wald"] < 1e-6 and g["wald"] > 0
    best = E.subset_search(df, "y", ["x", "t"], entity="e").first()
    assert best["r2"] < E.subset_search(df.withColumn("e2", F.col("e").cast("double")), "y", ["x", "t", "e2"]).orderBy(F.desc("r2")).first()["r2"]


def test_two_way_and_robust_errors_equal_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), int(t), float(x), float(z), float(2 * x - z + e)) for k, t, x, z, e in zip(rng.integers(0, 9, 200), rng.integers(0, 7, 200), rng.normal(size=200), rng.normal(size=200), rng.normal(size=200))]
    df = spark.createDataFrame(rows, "k int, t int, x double, z double, y double")
    a = np.array(rows)
    k, t, X, y = a[:, 0], a[:, 1], a[:, 2:4], a[:, 4]
    inside = lambda v: v - np.array([v[k == g].mean(0) for g in k])
    X, y = inside(X), inside(y)
    bread = np.linalg.inv(X.T @ X)
    s = X * (y - X @ (bread @ X.T @ y))[:, None]
    meat = lambda keys: sum(np.outer(m, m) for m in (s[keys == g].sum(0) for g in np.unique(keys)))
    fit = lambda **o: E.panel_ols(df, "y", ["x", "z"], "k", "t", "entity", least=1, **o).se
    both = meat(k) + meat(t) - meat(k * 100 + t)
    assert np.allclose(fit(cluster=("k", "t")), np.sqrt(np.diag(bread @ both @ bread)))
    assert np.allclose(fit(cluster=("k", "t"), debiased=True), np.sqrt(np.diag(bread @ both @ bread) * 200 / 198))
    assert np.allclose(fit(robust=True, debiased=True), np.sqrt(np.diag(bread @ (s.T @ s) @ bread) * 200 / (200 - 2 - 9)))
