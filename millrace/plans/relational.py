"""Queries over the relational tables: statistics, joins, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import percent, ratio, substring_group, weighted_sum
from millrace.operators import panel as P
from millrace.operators import stats as S
from millrace.sources.tables import load, union_all

#: Ordered substring rules that group part types.
TYPE_RULES = [("STEEL", "metal"), ("BRASS", "metal"), ("COPPER", "metal"), ("ECONOMY", "economy"), ("PROMO", "promo"), ("STANDARD", "standard")]
QUERIES: dict = {}
ORACLES: dict = {}


def registrar(queries: dict, oracles: dict):
    """A decorator that registers a query under its function's name, with its SQL if it has one."""

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return keep

    return query


query = registrar(QUERIES, ORACLES)


def customer_years(spark: SparkSession, d: str) -> DataFrame:
    """The customer-year panel: k, t, y (sum of prices), n (orders)."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("t"), "o_totalprice")
    return o.groupBy("k", "t").agg((F.round(F.sum("o_totalprice"), 2) / 1e5).alias("y"), F.count(F.lit(1)).alias("n"))


CY = "cy AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS t, round(sum(o_totalprice), 2) / 1e5 AS y, count(*) AS n FROM orders GROUP BY ALL)"


def nation_years(spark: SparkSession, d: str) -> DataFrame:
    """The nation-year panel: k, t, y (mean price in units of 1e5), n."""
    o = load(spark, d, "orders").join(load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey")
    return o.groupBy("k", F.year("o_orderdate").alias("t")).agg((F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1)) / 1e5).alias("y"), F.count(F.lit(1)).alias("n"))


NY = "ny AS (SELECT c_nationkey AS k, CAST(year(o_orderdate) AS INT) AS t, round(sum(o_totalprice), 2) / count(*) / 1e5 AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def r(c, digits: int = 6):
    """Rounded, under the column's own name if it is a string."""
    return F.round(F.col(c), digits).alias(c) if isinstance(c, str) else F.round(c, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def priced_parts(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return line.join(part, "l_partkey").withColumn("unit", ratio(F.col("l_extendedprice"), F.col("l_quantity"))).withColumn("grp", substring_group(F.col("p_type"), TYPE_RULES))


GRP = "CASE " + " ".join(f"WHEN p_type LIKE '%{a}%' THEN '{b}'" for a, b in TYPE_RULES) + " ELSE 'Other' END"
PP = f"pp AS (SELECT l_partkey, l_suppkey, p_type, p_brand, l_discount, l_extendedprice / nullif(l_quantity, 0) AS unit, {GRP} AS grp FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {PP} SELECT grp, count(unit) AS count, round(avg(unit), 3) AS mean, round(median(unit), 3) AS median, round(stddev_samp(unit), 3) AS std, round(min(unit), 3) AS min, round(max(unit), 3) AS max FROM pp GROUP BY grp")
def stats_by_group(spark, d):
    """A1, P14, P15."""
    return S.group_stats(priced_parts(spark, d), ["grp"], "unit", 3)


@query(f"WITH {PP} SELECT grp, count(DISTINCT l_suppkey) AS n_entities, count(*) AS n_rows FROM pp GROUP BY grp")
def group_nunique_count(spark, d):
    """A2, A21."""
    return S.nunique_count(priced_parts(spark, d), ["grp"], "l_suppkey")


@query("SELECT n_name, o_orderstatus, round(avg(o_totalprice), 7) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def mean_by_keys(spark, d):
    """Means by two keys over joined dimensions."""
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name", "o_orderstatus").agg(r(F.avg("o_totalprice"), 7).alias("mean_price"))


@query("""SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS year, arg_min(c_mktsegment, o_orderkey) AS first_segment, bool_or(o_orderstatus = 'F') AS any_final, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 7) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def entity_year_rollup(spark, d):
    """A4: first, any, sum and mean by entity and year."""
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.min_by("c_mktsegment", "o_orderkey").alias("first_segment"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"), r(F.sum("o_totalprice"), 2).alias("total"), r(F.avg("o_totalprice"), 7).alias("mean"))


@query(f"WITH {CY} SELECT k, min(t) AS t_min, max(t) AS t_max, count(*) AS n, round(avg(y), 9) AS avg, round(stddev_samp(y), 9) AS std, arg_min(y, t) AS first, arg_max(y, t) AS last, round(arg_max(y, t) - arg_min(y, t), 8) AS trend FROM cy GROUP BY k")
def entity_totals(spark, d):
    """A5: totals with first, last and trend."""
    return rounded(rounded(S.first_last(customer_years(spark, d), ["k"], "t", "y"), "avg", "std", digits=9), "trend", digits=8)


@query(f"WITH {CY} SELECT t, count(DISTINCT k) AS n_entities, CAST(sum(n) AS BIGINT) AS n_orders, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, min(y) AS min, max(y) AS max FROM cy GROUP BY t")
def yearly_summary(spark, d):
    """A6."""
    return customer_years(spark, d).groupBy("t").agg(F.countDistinct("k").alias("n_entities"), F.sum("n").alias("n_orders"), r(F.avg("y")).alias("mean"), r(F.stddev_samp("y")).alias("std"), F.min("y").alias("min"), F.max("y").alias("max"))


@query("SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, CAST(coalesce(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_toxic, round(100.0 * count(l.doc_id) / count(*), 6) AS labelled_pct, round(CASE WHEN count(l.doc_id) > 0 THEN 100.0 * sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / count(l.doc_id) ELSE 0 END, 6) AS toxic_pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def funnel_ratios(spark, d):
    """A funnel with guarded ratios."""
    j = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels").withColumn("hit", F.lit(1)), "doc_id", "left")
    g = j.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("hit").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return g.select("*", r(percent(F.col("n_labelled"), F.col("n_docs"))).alias("labelled_pct"), r(percent(F.col("n_toxic"), F.col("n_labelled"))).alias("toxic_pct"))


@query("SELECT source, round(CASE WHEN sum(coalesce(quality, 0)) > 0 THEN sum(n_chars * coalesce(quality, 0)) / sum(coalesce(quality, 0)) ELSE avg(n_chars) END, 6) AS weighted_mean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def weighted_mean_by_confidence(spark, d):
    """Weights 1 where all are 0."""
    j = load(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("x")).join(load(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("w")), "doc_id", "left")
    return rounded(S.weighted_mean(j, ["source"], "x", "w"), "weighted_mean")


@query("SELECT l_linestatus, " + ", ".join(f"round(coalesce(100.0 * sum(CASE WHEN l_returnflag = '{v}' THEN l_quantity ELSE 0 END) / sum(l_quantity), 0), 6) AS \"{v}_pct\"" for v in "ANR") + " FROM lineitem GROUP BY l_linestatus")
def weighted_label_share(spark, d):
    """A9."""
    return rounded(S.label_share(load(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", ["A", "N", "R"], "l_quantity"), "A_pct", "N_pct", "R_pct")


@query("WITH j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT count(*) AS n, sum((doc_id IS NULL)::INT) AS doc_id, sum((lang IS NULL)::INT) AS lang, sum((quality IS NULL)::INT) AS quality, sum((toxic IS NULL)::INT) AS toxic FROM j) SELECT column_name, CAST(m AS BIGINT) AS n_missing, round(100.0 * m / n, 6) AS pct_missing FROM (SELECT n, unnest(['doc_id', 'lang', 'quality', 'toxic']) AS column_name, unnest([doc_id, lang, quality, toxic]) AS m FROM c) WHERE m > 0")
def missingness_profile(spark, d):
    """A12."""
    j = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id", "left")
    return rounded(S.missingness(j), "pct_missing")


@query("WITH c AS (SELECT count(*) AS n, count(c_nationkey) AS a, count(DISTINCT c_nationkey) AS b, count(c_mktsegment) AS e, count(DISTINCT c_mktsegment) AS f FROM customer) SELECT 'c_nationkey' AS column_name, 'int' AS type, n AS n_rows, n - a AS n_missing, b AS n_distinct FROM c UNION ALL SELECT 'c_mktsegment', 'string', n, n - e, f FROM c")
def column_profile(spark, d):
    """A14."""
    return S.profile(load(spark, d, "customer").select("c_nationkey", "c_mktsegment"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """A13."""
    return S.duplicate_keys(load(spark, d, "documents"), ["text"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(sum(CASE WHEN {c} NOT BETWEEN {a} AND {b} THEN 1 ELSE 0 END) AS BIGINT) AS n_outside FROM lineitem" for c, a, b in (("l_discount", 0, 0.05), ("l_tax", 0, 0.08), ("l_quantity", 1, 40))))
def range_checks(spark, d):
    """A15."""
    return S.range_checks(load(spark, d, "lineitem"), {"l_discount": (0, 0.05), "l_tax": (0, 0.08), "l_quantity": (1, 40)})


@query("WITH g AS (SELECT abs((n_chars - length(text)) / nullif(length(text), 0)) AS gap FROM documents) SELECT count(gap) AS n, count(*) FILTER (gap <= 0.001) AS within_0, count(*) FILTER (gap <= 0.05) AS within_1, count(*) FILTER (gap <= 0.15) AS within_2, count(*) FILTER (gap > 0.15) AS beyond FROM g")
def tolerance_bands(spark, d):
    """Stored against recomputed."""
    return S.tolerance_bands(load(spark, d, "documents"), "n_chars", F.length("text").cast("double"))


@query(f"WITH {CY}, s AS (SELECT k, y, abs(y - lag(y) OVER (PARTITION BY k ORDER BY t)) AS step, CAST(row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS DOUBLE) AS pos FROM cy) SELECT k, count(*) AS n, round(stddev_samp(y), 6) AS std, round(stddev_samp(y) / nullif(avg(y), 0), 6) AS cv, round(max(step), 6) AS max_step, round(regr_slope(y, pos), 6) AS slope, round(max(y) - min(y), 6) AS range FROM s GROUP BY k HAVING count(*) > 1")
def stability_metrics(spark, d):
    """A16, W3."""
    return rounded(S.stability(customer_years(spark, d), "k", "t", "y"), "std", "cv", "max_step", "slope", "range")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM customer" for c in ("c_acctbal", "c_nationkey")))
def describe_metrics(spark, d):
    """A17."""
    return rounded(S.describe(load(spark, d, "customer"), ["c_acctbal", "c_nationkey"]), "mean", "std", "q25", "q50", "q75")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def correlation_pairs(spark, d):
    """A18, E16."""
    return rounded(S.correlations(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "corr")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type")
def label_distribution(spark, d):
    """A22."""
    return rounded(S.label_distribution(load(spark, d, "events"), "event_type", "value"), "mean", "median", "pct")


@query("SELECT CASE WHEN grouping(year(o_orderdate)) = 1 THEN 'TOTAL' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (year(o_orderdate), o_orderstatus)")
def count_matrix_with_totals(spark, d):
    """A23."""
    return S.matrix_with_totals(load(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus"), "year", "o_orderstatus")


KINDS = ["view", "signup", "error", "click", "purchase"]


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY ALL")
def pivot_counts(spark, d):
    """A24."""
    return S.pivot_counts(load(spark, d, "events").withColumn("day", F.to_date("ts").cast("string")), ["day"], "event_type", KINDS)


@query("SELECT o_custkey, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years FROM orders GROUP BY o_custkey")
def years_per_entity(spark, d):
    """A25, S25."""
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("years"))


@query("SELECT source, CAST(sum(ceil(n_chars / 1400.0)) * 2 AS BIGINT) AS n_calls, count(*) AS n_docs, CAST(floor(avg(n_chars)) AS BIGINT) AS avg_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents GROUP BY source")
def batch_estimate(spark, d):
    """A26, A27."""
    return load(spark, d, "documents").groupBy("source").agg((F.sum(F.ceil(F.col("n_chars") / 1400.0)) * 2).cast("long").alias("n_calls"), F.count(F.lit(1)).alias("n_docs"), F.floor(F.avg("n_chars")).alias("avg_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))


@query("WITH t AS (SELECT DISTINCT source, lower(left(text, 50)) AS p FROM documents), n AS (SELECT source, count(*) AS n FROM t GROUP BY source), s AS (SELECT a.source AS a, b.source AS b, count(*) AS s FROM t a JOIN t b ON a.p = b.p AND a.source < b.source GROUP BY ALL) SELECT a, b, s AS n_shared, round(s / (x.n + y.n - s), 8) AS jaccard FROM s JOIN n x ON x.source = a JOIN n y ON y.source = b")
def jaccard_prefix_overlap(spark, d):
    """Shared prefixes of each pair of sources, from one equi-join on the prefix and summed sizes."""
    t = load(spark, d, "documents").select("source", F.lower(F.left("text", F.lit(50))).alias("p")).distinct()
    n = t.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    per = t.groupBy("p").agg(F.sort_array(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    pairs = per.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))
    both = pairs.join(n.select(F.col("source").alias("a"), F.col("n").alias("x")), "a").join(n.select(F.col("source").alias("b"), F.col("n").alias("z")), "b")
    return both.select("a", "b", "n_shared", F.round(F.col("n_shared") / (F.col("x") + F.col("z") - F.col("n_shared")), 8).alias("jaccard"))


@query(f"WITH {CY} SELECT k, t, round(y - lag(y) OVER (PARTITION BY k ORDER BY t), 8) AS delta FROM cy")
def yoy_delta(spark, d):
    """W1."""
    return P.delta(customer_years(spark, d), "k", "t", "y").select("k", "t", r("delta", 8))


@query(f"WITH {CY} SELECT k, t, lag(y, 1) OVER w AS y_lag1, lag(y, 2) OVER w AS y_lag2, lag(n, 1) OVER w AS n_lag1, lag(n, 2) OVER w AS n_lag2 FROM cy WINDOW w AS (PARTITION BY k ORDER BY t)")
def lag_features(spark, d):
    """W2."""
    return P.lags(customer_years(spark, d), "k", "t", ["y", "n"], 2).select("k", "t", "y_lag1", "y_lag2", "n_lag1", "n_lag2")


@query(f"WITH {CY} SELECT k, max(t) AS t, arg_max(y, t) AS y, arg_max(n, t) AS n FROM cy GROUP BY k")
def latest_row_per_entity(spark, d):
    """W4."""
    return P.latest(customer_years(spark, d), "k", "t")


@query(f"WITH {CY}, w AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) AS i, count(*) OVER (PARTITION BY k) AS n FROM cy) SELECT k, t, CASE WHEN n <= 3 THEN i < n ELSE i <= floor(0.7 * n) END AS is_train FROM w")
def chrono_train_test_split(spark, d):
    """W5."""
    return P.chrono_split(customer_years(spark, d), "k", "t").select("k", "t", "is_train")


@query(f"WITH {NY} SELECT k, t, round((y / nullif(max(CASE WHEN t = 1996 THEN y END) OVER (PARTITION BY k), 0) - 1) * 100, 6) AS pct_vs_base FROM ny")
def pct_change_vs_base(spark, d):
    """W6."""
    return P.pct_vs_base(nation_years(spark, d), "k", "t", "y", 1996).select("k", "t", r("pct_vs_base"))


@query(f"WITH {NY}, f AS (SELECT k, t, y * 1.1 AS y FROM ny WHERE t > 1998), h AS (SELECT k, arg_max(y, t) AS last FROM ny WHERE t <= 1998 GROUP BY k) SELECT f.k, t, round(y - (first_value(y) OVER (PARTITION BY f.k ORDER BY t) - last), 6) AS aligned FROM f JOIN h ON f.k = h.k")
def level_shift_alignment(spark, d):
    """W7, F5."""
    ny = nation_years(spark, d)
    return P.align_level(ny.filter("t > 1998").withColumn("y", F.col("y") * 1.1), ny.filter("t <= 1998"), "k", "t", "y").select("k", "t", r("aligned"))


@query(f"WITH {NY}, g AS (SELECT t, sum(n) AS n FROM ny GROUP BY t) SELECT t, CAST(n AS BIGINT) AS n, round(n / max(n) OVER (), 6) AS ratio_to_max FROM g")
def ratio_to_max(spark, d):
    """W8."""
    return rounded(P.ratio_to_max(nation_years(spark, d).groupBy("t").agg(F.sum("n").alias("n")), "n"), "ratio_to_max")


@query(f"WITH {CY} SELECT k, t, n FROM cy WHERE k IN (SELECT k FROM cy GROUP BY k HAVING count(nullif(n, 1)) >= 4)")
def completeness_filter(spark, d):
    """P11, J8."""
    rows = customer_years(spark, d).withColumn("v", F.nullif(F.col("n"), F.lit(1)))
    return P.complete_entities(rows, "k", "v", 4).select("k", "t", "n")


@query("SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_join_dimension(spark, d):
    """J1-J3."""
    o, c, n, g = (load(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(g, n.n_regionkey == g.r_regionkey, "left").select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT k, n_orders, n_lines, c_acctbal FROM a JOIN b USING (k) JOIN customer ON k = c_custkey")
def multiway_component_join(spark, d):
    """Components per entity, joined on it."""
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    a = o.groupBy("k").agg(F.count(F.lit(1)).alias("n_orders"))
    b = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(o, "o_orderkey").groupBy("k").agg(F.count(F.lit(1)).alias("n_lines"))
    return a.join(b, "k").join(load(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal"), "k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_dropped(spark, d):
    """J7, J13."""
    return P.only_left(load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_valid(spark, d):
    """J8, P1."""
    return load(spark, d, "customer").select("c_custkey", "c_name").join(load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS t FROM orders WHERE year(o_orderdate) IN (SELECT year(l_shipdate) FROM lineitem)")
def common_years(spark, d):
    """J9, U4."""
    return P.common_periods(load(spark, d, "orders").select(F.year("o_orderdate").alias("t")), load(spark, d, "lineitem").select(F.year("l_shipdate").alias("t")), "t")


@query(f"WITH {NY}, l AS (SELECT k, max(t) AS t, arg_max(y, t) AS y, arg_max(n, t) AS n FROM ny GROUP BY k) SELECT k, CAST(u AS INT) AS t, y, n FROM (SELECT k, y, n, unnest(generate_series(t + 1, 2005)) AS u FROM l)")
def cross_future_grid(spark, d):
    """F1, J11."""
    return P.future_grid(nation_years(spark, d), "k", "t", 2005)


@query("SELECT 'order' AS kind, o_orderkey AS key, o_totalprice AS price, NULL AS quantity FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'line', l_orderkey, NULL, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def union_by_name(spark, d):
    """U1."""
    a = load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return union_all(a, load(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("quantity")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def key_difference(spark, d):
    """U5."""
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, d):
    """U3."""
    return load(spark, d, "part").select("p_brand", "p_type").dropDuplicates()


@query(f"WITH {PP} SELECT p_brand, count(*) AS n FROM pp GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top_n_groups(spark, d):
    """O2, O3."""
    return S.top_n(priced_parts(spark, d).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("p_brand")], 10)


@query("SELECT l_orderkey, l_linenumber, round(0.4 * l_discount + 0.4 * l_tax + 0.2 * l_quantity / 50, 9) AS score FROM lineitem ORDER BY score DESC, l_orderkey, l_linenumber LIMIT 50")
def composite_quality_topk(spark, d):
    """Top by a weighted score."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(0.4 * F.col("l_discount") + 0.4 * F.col("l_tax") + 0.2 * F.col("l_quantity") / 50, 9).alias("score"))
    return S.top_n(rows, [F.desc("score"), F.asc("l_orderkey"), F.asc("l_linenumber")], 50)


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(p, (-n, p)) AS majority, max(n) AS votes FROM c GROUP BY o_custkey")
def majority_vote(spark, d):
    """A20, O4."""
    return S.majority(load(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT c_custkey, round(1.5 * (c_mktsegment = 'BUILDING')::INT + 3.0 * (c_mktsegment = 'AUTOMOBILE')::INT + 2.0 * (c_acctbal > 5000)::INT, 6) AS pressure FROM customer")
def sector_pressure_score(spark, d):
    """P20, P23, C12."""
    flags = load(spark, d, "customer").select("c_custkey", P.require(F.col("c_mktsegment") == "BUILDING", "a"), P.require(F.col("c_mktsegment") == "AUTOMOBILE", "b"), P.require(F.col("c_acctbal") > 5000, "c"))
    return flags.select("c_custkey", r(weighted_sum({"a": 1.5, "b": 3.0, "c": 2.0})).alias("pressure"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS total_k FROM events GROUP BY event_type")
def json_prop_extract(spark, d):
    """X28, X32."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total_k"))


@query("SELECT time_bucket(INTERVAL '2 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    """Tumbling windows."""
    from millrace.streaming.events import tumbling

    return rounded(tumbling(load(spark, d, "events"), "ts", "2 hours", ["event_type"], "value"), "total", digits=4)


@query("SELECT b - INTERVAL '1 hour' * o AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, value, unnest([0, 1, 2]) AS o FROM events) GROUP BY ALL")
def events_sliding(spark, d):
    """Sliding windows of three hours each hour."""
    from millrace.streaming.events import sliding

    return rounded(sliding(load(spark, d, "events"), "ts", "3 hours", "1 hour", "value"), "total", digits=4)


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS finish, count(*) AS n FROM s GROUP BY user_id, sid")
def events_sessions(spark, d):
    """Session windows."""
    from millrace.streaming.events import sessions

    return sessions(load(spark, d, "events"), "ts", "2 hours", ["user_id"])
