"""Queries of row filters, renames, alignments, scalars and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as X
from millrace.operators import extract as L
from millrace.operators import frames as W
from millrace.operators import text as T
from millrace.operators import topics as M
from millrace.plans.relational import CY, NY, customer_years, nation_years, r, registrar, rounded
from millrace.sources import tables as S
from millrace.sources.tables import load

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

# ---------------------------------------------------------------- filters and projections


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND nullif(o_orderpriority, '5-LOW') IS NOT NULL")
def not_null_rows(spark, d):
    """P3."""
    rows = load(spark, d, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return rows.dropna(subset=["s", "p"]).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, t FROM (SELECT p_partkey, nullif(p_type, 'PROMO BRASS') AS t FROM part) WHERE NOT coalesce(regexp_matches(t, 'steel|copper', 'i'), false)")
def text_filter_negated(spark, d):
    """Null text stays."""
    return W.text_filter(load(spark, d, "part").select("p_partkey", F.nullif("p_type", F.lit("PROMO BRASS")).alias("t")), "t", "steel|copper", negate=True)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND nullif(c_nationkey, 3) > 0")
def positive_mask(spark, d):
    """P5."""
    rows = load(spark, d, "customer").withColumn("k", F.nullif("c_nationkey", F.lit(3)))
    return W.positive(rows, "c_acctbal", "k").select("c_custkey", "c_acctbal")


@query("SELECT l.doc_id, coalesce(quality, 0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(quality, 0) >= 0.5")
def score_threshold(spark, d):
    """A missing score counts as 0."""
    j = load(spark, d, "documents").select(F.col("doc_id").alias("i")).join(load(spark, d, "labels"), F.col("i") == F.col("doc_id"), "left")
    return L.above_threshold(j, "quality", 0.5).select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def label_membership(spark, d):
    """P8."""
    return W.has_label(load(spark, d, "customer"), "c_mktsegment", ["Building", "MACHINERY"]).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f'")
def optional_label_filter(spark, d):
    """The column follows from the kind."""
    return W.by_label(load(spark, d, "orders"), {"status": "o_orderstatus", "priority": "o_orderpriority"}, "status", "F").select("o_orderkey")


@query("SELECT o_orderkey, y FROM (SELECT o_orderkey, CAST(nullif(year(o_orderdate), 1997) AS INT) AS y FROM orders) WHERE y IS NULL OR y < 1999")
def year_exclusion(spark, d):
    """P10: null years are kept."""
    return W.before_year(load(spark, d, "orders").select("o_orderkey", F.nullif(F.year("o_orderdate"), F.lit(1997)).alias("y")), "y", 1999)


@query("SELECT p_partkey, p_size FROM part")
def existing_columns(spark, d):
    """Names that are not there are skipped."""
    return S.existing(load(spark, d, "part"), ["p_partkey", "p_colour", "p_size", "p_weight"])


@query("SELECT p_brand AS brand, avg(p_size) AS size_mean, max(p_size) AS size_max, count(p_retailprice) AS price_count FROM part GROUP BY p_brand")
def renamed_flat_columns(spark, d):
    """Renamed columns, and aggregates of several columns under flat names."""
    rows = W.renamed(load(spark, d, "part"), {"p_brand": "brand", "p_size": "size", "p_retailprice": "price", "missing": "x"})
    return W.flattened(rows, ["brand"], {"size": ["mean", "max"], "price": ["count"]})


_COLOUR = "CASE WHEN p_type LIKE '%STEEL%' THEN 'dark' WHEN p_type LIKE '%PROMO%' THEN 'bright' WHEN p_type LIKE '%ECONOMY%' THEN 'plain' ELSE 'Other' END"


@query(f"SELECT p_type, {_COLOUR} AS colour, count(*) AS n FROM part GROUP BY ALL")
def colour_groups(spark, d):
    """Ordered substring rules, in another order than the groups'."""
    colour = X.substring_group(F.col("p_type"), [("STEEL", "dark"), ("PROMO", "bright"), ("ECONOMY", "plain")])
    return load(spark, d, "part").groupBy("p_type", colour.alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS mapped, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS replaced FROM orders")
def dictionary_map(spark, d):
    """Without entry NULL by map, itself by replace."""
    names = {"F": "final", "O": "open"}
    return load(spark, d, "orders").select("o_orderkey", X.mapped(F.col("o_orderstatus"), names).alias("mapped"), X.mapped(F.col("o_orderstatus"), names, keep=True).alias("replaced"))


@query("SELECT o_custkey, CAST(2024 - min(year(o_orderdate)) AS INT) AS age FROM orders GROUP BY o_custkey")
def age_from_first_year(spark, d):
    """Years up to a stated year, never the clock's."""
    return load(spark, d, "orders").groupBy("o_custkey").agg((F.lit(2024) - F.min(F.year("o_orderdate"))).alias("age"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dropped_suffix_columns(spark, d):
    """The duplicate columns of a join go by their suffix."""
    g = load(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey").withColumn("n_name_y", F.lit("x"))
    return W.without_suffix(load(spark, d, "nation").join(g, "n_regionkey"), "_y$|regionkey$")


@query(r"""SELECT page_id, translate(substring(url, 1, 40), '/\:*?"<>| ', '__________') AS name FROM pages""")
def safe_names(spark, d):
    """P25."""
    return load(spark, d, "pages").select("page_id", W.safe_name("url", 40).alias("name"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_quantity) AS INT) AS VARCHAR) || '/' || CAST(CAST(round(l_extendedprice) AS INT) AS VARCHAR) AS parts FROM lineitem")
def joined_integers(spark, d):
    """P26."""
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", W.joined_ints("l_quantity", "l_extendedprice").alias("parts"))


@query("SELECT replace(company, '’', chr(39)) AS company, CAST(year AS INT) AS year, country FROM (SELECT c_name || '’s' AS company, CAST(1990 + c_nationkey AS VARCHAR) AS year, c_mktsegment AS country FROM customer) WHERE country IN ('BUILDING', 'MACHINERY') AND CAST(year AS INT) BETWEEN 1995 AND 2010")
def company_panel(spark, d):
    """Plain apostrophes, integer years, regions and an inclusive range."""
    rows = load(spark, d, "customer").select(F.concat("c_name", F.lit("’s")).alias("company"), (1990 + F.col("c_nationkey")).cast("string").alias("year"), F.col("c_mktsegment").alias("country"))
    return S.panel(rows, ["BUILDING", "MACHINERY"], years=(1995, 2010))


# ---------------------------------------------------------------- joins, sets, orders


@query(f"WITH {NY}, p AS (SELECT t, avg(y) AS path FROM ny GROUP BY t) SELECT ny.k, ny.t + 2 AS t, ny.y, round(p.path, 8) AS path FROM ny LEFT JOIN p ON p.t = ny.t + 2")
def future_join_path(spark, d):
    """Future rows with the path of their year, which may be missing."""
    ny = nation_years(spark, d)
    return ny.select("k", (F.col("t") + 2).alias("t"), "y").join(ny.groupBy("t").agg(r(F.avg("y"), 8).alias("path")), "t", "left")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS origin FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996) b ON a.k = b.k")
def outer_join_origin(spark, d):
    """Full outer join with where keys are from."""
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return W.with_origin(o.filter("o_orderstatus = 'P'"), o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1996)), ["k"])


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_join_left_only(spark, d):
    """Keys on the left only."""
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return W.with_origin(o, o.filter("o_orderstatus = 'P'"), ["k"]).filter("origin = 'left_only'").select("k")


@query("WITH m AS (SELECT o_custkey, arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS method FROM orders GROUP BY o_custkey) SELECT o.o_orderkey, m.method, o.o_orderpriority = m.method AS same FROM orders o JOIN m ON o.o_custkey = m.o_custkey")
def row_lookup_join(spark, d):
    """The method of each entity looked up for its rows by one join."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    m = o.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("method"))
    return o.join(m, "o_custkey").select("o_orderkey", "method", (F.col("o_orderpriority") == F.col("method")).alias("same"))


@query("SELECT k, a.n AS n_orders, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)")
def columnwise_concat(spark, d):
    """Frames beside each other by their index."""
    a = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return W.aligned([a, b], "k")


@query(f"WITH {NY} SELECT k, t, CAST(row_number() OVER (ORDER BY CASE WHEN n % 3 = 0 THEN NULL ELSE n END DESC NULLS LAST, k, t) AS INT) AS place FROM ny")
def sorted_missing_last(spark, d):
    """O1: descending, missing values last."""
    ny = nation_years(spark, d).withColumn("v", F.when(F.col("n") % 3 != 0, F.col("n")))
    return W.placed(ny, [F.col("v").desc_nulls_last(), F.col("k"), F.col("t")]).select("k", "t", "place")


@query(f"WITH {NY} SELECT k, t, CAST(row_number() OVER (ORDER BY k, t) AS INT) AS place FROM ny")
def index_sorted(spark, d):
    """By entity and time."""
    return W.placed(nation_years(spark, d), [F.col("k"), F.col("t")]).select("k", "t", "place")


_COMMON = r"SELECT w FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM {0}) WHERE regexp_matches(w, '^[a-z]{{4,}}$') GROUP BY w) QUALIFY row_number() OVER (ORDER BY n DESC, w) <= {1}"


@query(f"SELECT DISTINCT w AS word FROM ({_COMMON.format('documents', 40)} UNION ALL {_COMMON.format('benchmark', 15)})")
def stop_word_union(spark, d):
    """U8: general and domain stop words as one set: the commonest words of the documents and those of the benchmark."""
    return M.stop_word_table(M.commonest_terms(load(spark, d, "documents"), "text", 40), M.commonest_terms(load(spark, d, "benchmark"), "text", 15))


# ---------------------------------------------------------------- aggregates


@query("SELECT l_returnflag, round(avg(l_extendedprice) FILTER (l_discount > 0.05), 4) AS mean_subset, round(avg(l_extendedprice) FILTER (l_discount <= 0.05), 4) AS mean_rest, round(avg(l_extendedprice) FILTER (l_discount > 0.05) - avg(l_extendedprice) FILTER (l_discount <= 0.05), 4) AS difference FROM lineitem GROUP BY l_returnflag")
def conditional_means(spark, d):
    """A10: a subset's mean against the rest's."""
    return rounded(W.split_means(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", F.col("l_discount") > 0.05), "mean_subset", "mean_rest", "difference", digits=4)


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, 3 AS n_columns, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM (SELECT lang, source, n_chars FROM documents) GROUP BY lang, source, n_chars)")
def table_shape(spark, d):
    """Rows, columns, duplicates."""
    return W.table_shape(load(spark, d, "documents").select("lang", "source", "n_chars"))


@query("WITH s AS (SELECT source, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY source) SELECT count(*) AS n_groups, round(avg(n), 4) AS avg_docs, round(avg(m), 4) AS avg_chars, round(max(m), 4) AS max_chars FROM s")
def summary_averages(spark, d):
    """Averages of the groups' summary."""
    s = load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("m"))
    return s.agg(F.count(F.lit(1)).alias("n_groups"), r(F.avg("n"), 4).alias("avg_docs"), r(F.avg("m"), 4).alias("avg_chars"), r(F.max("m"), 4).alias("max_chars"))


@query("SELECT source, coalesce(arg_min(lang, doc_id) FILTER (lang <> 'en'), source) AS name FROM documents GROUP BY source")
def first_group_name(spark, d):
    """The first name that is not empty, else the id."""
    return W.first_name(load(spark, d, "documents").select("source", "doc_id", F.when(F.col("lang") != "en", F.col("lang")).otherwise(F.lit(" ")).alias("lang")), "source", "lang", "doc_id")


# ---------------------------------------------------------------- scalars and text rules


@query("SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS text FROM documents")
def nfc_text(spark, d):
    """Composed characters."""
    return load(spark, d, "documents").select("doc_id", T.nfc(F.replace("text", F.lit("é"), F.lit("é"))).alias("text"))


@query("SELECT doc_id, text || 'ab' AS text FROM documents")
def invisible_characters(spark, d):
    """Control and invisible characters go."""
    return load(spark, d, "documents").select("doc_id", X.without_invisible(F.concat(F.lit("﻿"), "text", F.lit("a­​\u0007\u001f‍b"))).alias("text"))


@query(r"SELECT doc_id, regexp_replace('A B C D E F ' || text, '\b([A-ZÄÖÜ])\s+([A-ZÄÖÜ])\s+([A-ZÄÖÜ])', '\1\2\3', 'g') AS text FROM documents")
def spaced_capitals(spark, d):
    """Letter-spaced capitals, three at a time."""
    return load(spark, d, "documents").select("doc_id", X.join_spaced_capitals(F.concat(F.lit("A B C D E F "), "text")).alias("text"))


def _squeezed(sql: str) -> str:
    for mark in (".", "-", "–", "—", "•", "·"):
        sql = f"regexp_replace({sql}, '[{mark}]{{4,}}', '{mark}{mark}', 'g')"
    return sql


@query(f"SELECT doc_id, {_squeezed(chr(39) + 'a.... ----- – –––– ••••• ·' + chr(39) + ' || text')} AS text FROM documents")
def repeated_marks(spark, d):
    """Four or more equal marks become two."""
    return load(spark, d, "documents").select("doc_id", X.squeeze_repeats(F.concat(F.lit("a.... ----- – –––– ••••• ·"), "text")).alias("text"))


@query(r"SELECT conv_id, turn, regexp_matches(text, '[.!?]\s*$') AS ends FROM conversations")
def sentence_end(spark, d):
    """X12."""
    return load(spark, d, "conversations").select("conv_id", "turn", X.ends_sentence(F.col("text")).alias("ends"))


_PATH = "'data/Reports/' || split_part(split_part(url, '/', 3), '.', 1) || '/' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') || CASE WHEN page_id % 3 = 0 THEN '_nodate' ELSE '_' || CAST(2010 + page_id % 15 AS VARCHAR) END || '_annual_report.pdf'"


@query(rf"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), f AS (SELECT page_id, path, regexp_replace(split_part(path, '/', 4), '\.[A-Za-z0-9]+$', '') AS name FROM p)
SELECT page_id, split_part(path, '/', 3) AS company, coalesce(nullif(regexp_extract(name, '^(\d{{2,3}})_', 1), ''), split_part(name, '_', 1)) AS company_id,
       coalesce(try_cast(nullif(regexp_extract(path, '(20[12][0-9])', 1), '') AS INT), try_cast(split_part(name, '_', 2) AS INT)) AS year, array_to_string(string_split(name, '_')[3:], '_') AS report_type FROM f""")
def report_path_metadata(spark, d):
    """Company, id, year and report type of a path."""
    rows = load(spark, d, "pages").select("page_id", F.expr(_PATH.replace("VARCHAR", "STRING")).alias("path"))
    return T.path_metadata(rows, "path").select("page_id", "company", "company_id", "year", "report_type")


@query("SELECT doc_id, CAST(s // 1400 AS INT) AS position, source || '_' || lpad(CAST(s // 1400 AS VARCHAR), 3, '0') AS chunk_id FROM (SELECT doc_id, source, unnest(generate_series(0, greatest(length(text) - 1, 0), 1400)) AS s FROM documents WHERE length(text) > 0)")
def chunk_identifiers(spark, d):
    """The position of a chunk in its document and its padded id."""
    docs = load(spark, d, "documents").select("doc_id", "source", "text")
    chunks = T.fixed_windows(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
    return chunks.select("doc_id", "position", F.format_string("%s_%03d", "source", "position").alias("chunk_id"))


@query("SELECT p_type, array_to_string(list_filter(string_split(lower(replace(p_type, ' ', ', ')), ', '), lambda k: length(k) > 0 AND NOT contains(k, 'steel') AND NOT contains(k, 'eco')), ', ') AS kept FROM (SELECT DISTINCT p_type FROM part)")
def keyword_filter(spark, d):
    """Keywords that are or hold a stop word go."""
    types = load(spark, d, "part").select("p_type").distinct()
    return types.select("p_type", M.keyword_filter(F.lower(F.replace("p_type", F.lit(" "), F.lit(", "))), ["steel", "eco"]).alias("kept"))


@query("SELECT n_nationkey, n_name AS first, 'Topic: ' || n_name AS second FROM nation")
def numbered_labels(spark, d):
    """Lines ``N: label`` of an answer; other lines are skipped."""
    answer = F.concat(F.lit("Labels:\n1: "), F.col("n_name"), F.lit("\nnone\n 2 : Topic: "), F.col("n_name"))
    parsed = load(spark, d, "nation").select("n_nationkey", L.parse_numbered(answer).alias("m"))
    return parsed.select("n_nationkey", F.col("m")[1].alias("first"), F.col("m")[2].alias("second"))


@query("SELECT event_id, greatest(10, coalesce(try_cast(nullif(regexp_extract(m, '(?i)retry.*?([0-9]+)', 1), '') AS INT), 10)) AS wait FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'rate limit, Retry in ' || CAST(event_id % 90 AS VARCHAR) || ' s' ELSE event_type END AS m FROM events)")
def retry_waits(spark, d):
    """The seconds that an error asks to wait, ten at least."""
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("rate limit, Retry in "), (F.col("event_id") % 90).cast("string"), F.lit(" s"))).otherwise(F.col("event_type"))
    return load(spark, d, "events").select("event_id", L.retry_seconds(said).alias("wait"))


_PRIORITIES = {"1-URGENT": "1_urgent", "2-HIGH": "2_high", "3-MEDIUM": "3_medium", "4-NOT SPECIFIED": "4_not_specified", "5-LOW": "5_low"}


@query("SELECT year(o_orderdate) AS order_year, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{n}\"" for p, n in _PRIORITIES.items()) + " FROM orders GROUP BY 1")
def normal_names(spark, d):
    """The columns that a pivot has made of raw values, under normal names."""
    counts = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("Order  Year")).pivot("o_orderpriority", list(_PRIORITIES)).count().na.fill(0)
    return S.rename_normal(counts)


@query(r"SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(' ' || p_type || ' (' || p_brand || ') / EUR', '[^0-9A-Za-z_]+', '_', 'g'), '_+', '_', 'g'), '_')) AS name FROM part")
def normal_labels(spark, d):
    """The same rule over values."""
    raw = F.concat(F.lit(" "), "p_type", F.lit(" ("), "p_brand", F.lit(") / EUR"))
    return load(spark, d, "part").select("p_partkey", S.normal_label(raw).alias("name"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 1) AS rounded, round(abs(l_tax - l_discount), 6) AS gap, round(ln(l_quantity), 8) AS log, round(sqrt(l_quantity), 8) AS root, round(power(l_discount, 2), 8) AS square FROM lineitem")
def rounding_and_powers(spark, d):
    """X26, X27."""
    c = F.col
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround("l_extendedprice", 1).alias("rounded"), r(F.abs(c("l_tax") - c("l_discount"))).alias("gap"), r(F.log("l_quantity"), 8).alias("log"), r(F.sqrt("l_quantity"), 8).alias("root"), r(F.pow("l_discount", F.lit(2)), 8).alias("square"))


@query(f"WITH {NY}, p AS (SELECT k, arg_min(y, t) AS x0, arg_max(y, t) AS x1, arg_min(n, t) AS y0, arg_max(n, t) AS y1 FROM ny GROUP BY k) SELECT k, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS distance, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) > 5 AS moved FROM p")
def moved_distance(spark, d):
    """Euclidean distance between first and last place, and whether it is above 5."""
    p = nation_years(spark, d).groupBy("k").agg(F.min_by("y", "t").alias("x0"), F.max_by("y", "t").alias("x1"), F.min_by("n", "t").alias("y0"), F.max_by("n", "t").alias("y1"))
    far = X.distance(("x0", "y0"), ("x1", "y1"))
    return p.select("k", r(far).alias("distance"), (far > 5).alias("moved"))


@query("SELECT n_nationkey, CAST(greatest(1, floor((least(c, 32000) - 500 - 500) / 430)) AS INT) AS batch_size FROM (SELECT n_nationkey, n_nationkey * 2000 AS c FROM nation)")
def context_batch_size(spark, d):
    """Chunks that fit a context window."""
    return load(spark, d, "nation").select("n_nationkey", L.batch_size_of(F.col("n_nationkey") * 2000).alias("batch_size"))


@query("SELECT doc_id, length(text) > 2048 AS is_cut FROM documents")
def truncation_flag(spark, d):
    """Texts longer than four characters for each of 512 tokens."""
    return load(spark, d, "documents").select("doc_id", T.is_cut(F.col("text")).alias("is_cut"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q, strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders")
def date_parts(spark, d):
    """X35."""
    o = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", F.year(o).alias("y"), F.month(o).alias("m"), F.quarter(o).alias("q"), F.date_format(o, "yyyy-MM").alias("ym"), F.datediff(o.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 0)"


@query(rf"SELECT doc_id, CAST(len({_SENTENCES}) AS INT) AS n_sentences, {_SENTENCES}[1] AS first FROM documents WHERE length(trim(text)) > 0")
def sentences(spark, d):
    """Sentences by their end marks."""
    s = load(spark, d, "documents").filter(F.length(F.trim("text")) > 0).select("doc_id", T.sentence_list(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.try_element_at("s", F.lit(1)).alias("first"))


@query("SELECT doc_id, lang, CASE WHEN lang IN ('de', 'fr') THEN '[en] ' || text ELSE text END AS text, lang IN ('de', 'fr') AS translated FROM documents")
def translated_documents(spark, d):
    """A pluggable translation of supported languages; others stay as they are."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    return T.translate(docs, "text", "lang", {"de": lambda texts: "[en] " + texts, "fr": lambda texts: "[en] " + texts}).select("doc_id", "lang", "text", "translated")


@query("SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'done' WHEN d.doc_id % 7 = 0 THEN 'failed' ELSE 'pending' END AS state FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def resume_state(spark, d):
    """What is done, what failed and is tried again, and what is open."""
    docs = load(spark, d, "documents").select("doc_id")
    return W.resume_state(docs, load(spark, d, "labels"), docs.filter("doc_id % 7 = 0"), ["doc_id"])


@query("SELECT doc_id, label, score FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 'climate' ELSE 'no' END AS label, round(length(text) % 100 / 100.0, 4) AS score FROM documents) WHERE lower(label) IN ('climate', 'yes', 'climate-related')")
def detector_filter(spark, d):
    """Labels and scores of a pluggable model, and the rows that it keeps by label."""
    import pandas as pd

    def model(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"label": ["climate" if "the" in t.lower() else "no" for t in texts], "score": [round(len(t) % 100 / 100.0, 4) for t in texts]})

    found = T.classify(load(spark, d, "documents").select("doc_id", "text"), "text", model, "label string, score double")
    return W.has_label(found, "label", ["climate", "yes", "climate-related"]).select("doc_id", "label", "score")


@query("SELECT doc_id, source FROM documents WHERE lower(lang) = 'en' ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def seeded_sample(spark, d):
    """A filter and a sample that every run repeats."""
    docs = W.by_label(load(spark, d, "documents"), {"language": "lang"}, "language", "EN")
    return T.seeded_sample(docs, "doc_id", 25).select("doc_id", "source")


@query(r"SELECT conv_id, turn, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*([-•*–·]|\d[.):])'))) AS INT) AS n_bullets, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*([-•*–·]|\d[.):])'))) >= 2 AS ok FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '- one item' || chr(10) || ' 2. ' || text ELSE text END AS text FROM conversations)")
def answer_format(spark, d):
    """Whether an answer has two bullet lines or more."""
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("- one item\n 2. "), F.col("text"))).otherwise(F.col("text"))
    n = L.bullet_lines(text)
    return load(spark, d, "conversations").select("conv_id", "turn", n.alias("n_bullets"), (n >= 2).alias("ok"))


@query("WITH k AS (SELECT conv_id, turn, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS p FROM conversations WHERE length(text) >= 40) SELECT conv_id, CAST((p - 1) // 3 AS INT) AS batch, CAST(length(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p)) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_texts FROM k GROUP BY conv_id, batch")
def batched_prompts(spark, d):
    """Texts above a threshold in batches of the context's size, joined by the separator."""
    rows = L.above_threshold(load(spark, d, "conversations").withColumn("_score", F.length("text").cast("double")), "_score", 40.0).select("conv_id", "turn", "text")
    size = L.ExtractConfig(context=2360).batch_size()
    return L.joined(L.batches(rows, ["conv_id"], ["turn"], size), ["conv_id"], "text").select("conv_id", "batch", F.length("joined").cast("long").alias("n_chars"), "n_texts")


@query("SELECT conv_id, turn, CAST(0 AS INT) AS batch, 'chars: ' || CAST(length('Q' || chr(10) || chr(10) || text) AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS error FROM conversations")
def model_answers(spark, d):
    """Prompts through a pluggable model."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", "text")
    return L.run_model(L.batches(rows, ["conv_id", "turn"], ["turn"], 3), ["conv_id", "turn"], "text", "Q", L.pipeline("stub", lambda prompt: f"chars: {len(prompt)}"))
