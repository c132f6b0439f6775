"""Queries of scores, texts, vectors, topics, models and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as X
from millrace.operators import econometrics as E
from millrace.operators import extract as L
from millrace.operators import forecast as C
from millrace.operators import panel as P
from millrace.operators import retrieval as R
from millrace.operators import scoring as G
from millrace.operators import text as T
from millrace.operators import topics as M
from millrace.plans.relational import CY, NY, PP, customer_years, nation_years, priced_parts, r, registrar, rounded
from millrace.sources.tables import load

QUERIES: dict = {}
ORACLES: dict = {}
#: Stop words of the language vote, and those left out of word counts.
PROFILES = {"de": ["der", "die", "das", "und", "ist", "nicht", "mit", "sich", "von"], "en": ["the", "and", "of", "to", "in", "is", "that", "it", "for"], "es": ["que", "los", "las", "el", "del", "con", "por", "una", "su"], "fr": ["le", "les", "des", "et", "une", "est", "dans", "pour", "que"]}
STOP = ["that", "this", "with", "from", "have", "were", "their"]


query = registrar(QUERIES, ORACLES)


# ---------------------------------------------------------------- scores

_LINES = "ln AS (SELECT l_suppkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS a, CASE WHEN l_quantity > 25 THEN NULL ELSE l_tax END AS b FROM lineitem)"


def _lines(spark, d):
    line = load(spark, d, "lineitem")
    return line.select(F.col("l_suppkey").alias("k"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("a"), F.when(F.col("l_quantity") <= 25, F.col("l_tax")).alias("b"))


@query(f"WITH {_LINES}, m AS (SELECT k, count(a) >= count(b) AS f FROM ln GROUP BY k) SELECT ln.k, CASE WHEN f THEN 'a' ELSE 'b' END AS method, count(CASE WHEN f THEN a ELSE b END) AS n, round(sum(CASE WHEN f THEN a ELSE b END), 6) AS total FROM ln JOIN m ON ln.k = m.k GROUP BY ln.k, f")
def best_method_per_entity(spark, d):
    """C1, C2."""
    return P.best_available(_lines(spark, d), "k", "a", "b").groupBy("k", "method").agg(F.count("best").alias("n"), r(F.sum("best")).alias("total"))


_PERF = "round(coalesce(CASE WHEN y IS NOT NULL THEN least(30.0, greatest(0.0, 30.0 * (1 - y / 2.0))) END, 0), 6)"


@query(f"WITH {NY}, l AS (SELECT k, arg_max(y, t) AS y, max(t) AS t FROM ny GROUP BY k) SELECT k, t, {_PERF} AS performance_score FROM l")
def performance_score(spark, d):
    """C3, X25."""
    return P.latest(nation_years(spark, d), "k", "t").select("k", "t", r(G.performance(F.col("y"))).alias("performance_score"))


_TREND = "CASE WHEN n >= 2 AND slope < 0 AND r2 >= 0.5 THEN 30.0 * least(1.0, abs(slope) / 0.02) ELSE 0.0 END"


@query(f"WITH {NY}, s AS (SELECT k, regr_slope(y, t) AS slope, regr_r2(y, t) AS r2, regr_count(y, t) AS n FROM ny GROUP BY k) SELECT k, round(slope, 6) AS slope, round(r2, 6) AS r2, round({_TREND}, 6) AS trend_score FROM s")
def trend_score(spark, d):
    """C4, E9."""
    t = C.linear_trend(nation_years(spark, d), ["k"], "t", "y")
    return t.select("k", r("slope"), r("r2"), r(G.trend(F.col("slope"), F.col("r2"), F.col("n"))).alias("trend_score"))


_PART = lambda s: f"CASE WHEN {s} >= 0.9 THEN 3 WHEN {s} >= 0.7 THEN 2 WHEN {s} >= 0.5 THEN 1 ELSE 0 END"
_QUALITY = f"CAST(CASE WHEN n >= 10 THEN 7 WHEN n >= 7 THEN 5 WHEN n >= 4 THEN 3 ELSE 1 END + {_PART('s1')} + {_PART('s2')} + CASE WHEN s3 >= 0.9 THEN 2 WHEN s3 >= 0.7 THEN 1 ELSE 0 END AS DOUBLE)"


@query(f"WITH {CY}, s AS (SELECT k, count(*) AS n, count(nullif(n, 1)) / count(*) AS s1, count(CASE WHEN y > 1 THEN y END) / count(*) AS s2, count(y) / count(*) AS s3 FROM cy GROUP BY k) SELECT k, {_QUALITY} AS data_quality FROM s")
def data_quality_score(spark, d):
    """C5."""
    s = customer_years(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.count(F.nullif("n", F.lit(1))) / F.count(F.lit(1))).alias("s1"), (F.count(F.when(F.col("y") > 1, F.col("y"))) / F.count(F.lit(1))).alias("s2"), (F.count("y") / F.count(F.lit(1))).alias("s3"))
    return s.select("k", G.data_quality(F.col("n"), F.col("s1"), F.col("s2"), F.col("s3")).alias("data_quality"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 0.0 WHEN s_acctbal / 100 >= 80 THEN 5.0 WHEN s_acctbal / 100 >= 60 THEN 4.0 WHEN s_acctbal / 100 >= 40 THEN 3.0 WHEN s_acctbal / 100 >= 20 THEN 2.0 WHEN s_acctbal / 100 >= 10 THEN 1.0 ELSE 0.0 END AS renewable_score FROM supplier")
def bucketed_renewable_score(spark, d):
    """C6, C7."""
    s = load(spark, d, "supplier")
    return s.select("s_suppkey", G.renewable(F.col("s_acctbal") / 100, F.col("s_nationkey") % 5 == 0).alias("renewable_score"))


@query(f"WITH {NY}, s AS (SELECT k, regr_slope(y, t) AS slope, regr_r2(y, t) AS r2, regr_count(y, t) AS n, arg_max(y, t) AS y FROM ny GROUP BY k), p AS (SELECT k, {_PERF} AS a, round({_TREND}, 6) AS b, CAST(least(n * 2, 15) AS DOUBLE) AS c FROM s) SELECT k, round(a + b + c, 6) AS total_score, CASE WHEN a + b + c >= 60 THEN 'LEADER' WHEN a + b + c >= 45 THEN 'STRONG' WHEN a + b + c >= 30 THEN 'MODERATE' ELSE 'WEAK' END AS category FROM p")
def action_score_total(spark, d):
    """C8, P18."""
    ny = nation_years(spark, d)
    s = C.linear_trend(ny, ["k"], "t", "y").join(P.latest(ny, "k", "t").select("k", "y"), "k")
    parts = s.select("k", r(G.performance(F.col("y"))).alias("a"), r(G.trend(F.col("slope"), F.col("r2"), F.col("n"))).alias("b"), F.least(F.col("n") * 2, F.lit(15)).cast("double").alias("c"))
    return G.total_and_band(parts, ["a", "b", "c"]).select("k", r("total_score"), "category")


_PERIODS = f"""{NY}, e AS (SELECT k, count(*) FILTER (t <= 1998) AS n, regr_slope(y, t) FILTER (t <= 1998) AS slope, regr_r2(y, t) FILTER (t <= 1998) AS r2, avg(y) FILTER (t <= 1998) AS y, 'pre' AS period FROM ny GROUP BY k
UNION ALL SELECT k, count(*) FILTER (t > 1998), regr_slope(y, t), regr_r2(y, t), avg(y) FILTER (t > 1998), 'post' FROM ny GROUP BY k)"""


@query(f"WITH {_PERIODS} SELECT k, period, n AS n_years, CASE WHEN n >= 3 THEN round(y, 6) END AS mean, CASE WHEN n >= 3 THEN round(slope, 6) END AS slope, CASE WHEN n >= 3 THEN {_PERF} END AS performance_score, CASE WHEN n >= 3 THEN round({_TREND}, 6) END AS trend_score, CASE WHEN n < 3 THEN 'too few years' END AS skip_reason FROM e")
def period_scores(spark, d):
    """C9, P19."""
    return rounded(G.period_scores(nation_years(spark, d), "k", "t", "y", 1998), "mean", "slope", "performance_score", "trend_score")


@query(f"WITH {_PERIODS}, s AS (SELECT k, period, CASE WHEN n >= 3 THEN {_PERF} END AS p FROM e), w AS (SELECT k, max(p) FILTER (period = 'pre') AS a, max(p) FILTER (period = 'post') AS b FROM s GROUP BY k) SELECT k, a AS pre_total, b AS post_total, round(b - a, 6) AS change FROM w")
def period_comparison(spark, d):
    """C10."""
    scores = rounded(G.period_scores(nation_years(spark, d), "k", "t", "y", 1998), "performance_score")
    return rounded(G.compare_periods(scores, "k", "performance_score"), "change")


@query("WITH s AS (SELECT source, 100.0 * count(l.doc_id) / count(*) AS c, coalesce(avg(quality), 0) AS q, coalesce(avg(toxic), 0) AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source) SELECT source, round((c / 100 * 0.2 + q * 0.4 + x * 0.4) * 100, 6) AS talk_score, round((c / 100 * 0.3 + q * 0.35 + x * 0.35) * 100, 6) AS alt_score FROM s")
def talk_score(spark, d):
    """T16, C11."""
    j = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels").withColumn("hit", F.lit(1)), "doc_id", "left")
    s = j.groupBy("source").agg((100.0 * F.count("hit") / F.count(F.lit(1))).alias("c"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("q"), F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("x"))
    parts = F.col("c"), F.col("q"), F.col("x")
    return s.select("source", r(G.talk_score(*parts)).alias("talk_score"), r(G.talk_score(*parts, weights=(0.3, 0.35, 0.35))).alias("alt_score"))


@query(f"WITH {NY}, p AS (SELECT k, arg_min(y, t) AS a, arg_max(y, t) AS b FROM ny GROUP BY k) SELECT k, CAST(f AS INT) AS frame, round(a + (b - a) * ((f / 10.0) * (f / 10.0) * (3.0 - 2.0 * (f / 10.0))), 8) AS position FROM (SELECT k, a, b, unnest(generate_series(0, 10)) AS f FROM p)")
def talk_action_tween(spark, d):
    """Eased positions of each entity between its first and last value."""
    ends = nation_years(spark, d).groupBy("k").agg(F.min_by("y", "t").alias("a"), F.max_by("y", "t").alias("b"))
    return C.tween(ends, "a", "b", 10).select("k", "frame", r("position", 8))


# ---------------------------------------------------------------- texts


@query(r"SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '\(cid:[0-9]+\)', '', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g')), '\.{5,}', '...', 'g'), '\s{3,}', ' ', 'g') AS cleaned FROM documents")
def clean_text_regex(spark, d):
    """X2-X6, X8, X10."""
    return load(spark, d, "documents").select("doc_id", X.squeeze_marks(X.clean_artifacts(F.col("text")), backreference=False).alias("cleaned"))


_P = r"list_filter(string_split_regex(s, '\s+'), lambda x: length(x) > 0)"


@query(rf"WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s FROM documents), w AS (SELECT doc_id, s, length(s) AS c, {_P} AS p FROM l), f AS (SELECT doc_id, c < 3 OR (len(p) > 5 AND len(list_filter(p, lambda x: length(x) <= 2)) / greatest(len(p), 1) > 0.7) OR regexp_matches(s, '^.{{5,50}}\.{{5,}}\s*\d+$') OR regexp_matches(s, '^(page|p\.?)\s*\d+|^\d+\s*(of|/)\s*\d+$', 'i') OR (regexp_matches(s, '^[\d\s.\-/]+$') AND c < 15) OR (len(p) > 8 AND len(list_filter(p, lambda x: regexp_matches(x, '^\d+[.,]?\d*$'))) / greatest(len(p), 1) > 0.6) OR regexp_matches(s, '^https?://\S+$', 'i') OR c - length(translate(s, '•·*─―–-', '')) > 5 OR (c > 10 AND (c - length(replace(s, '.', ''))) / c > 0.4) OR regexp_matches(s, '^[A-Z][a-z]+(\s+[A-Z][a-z]+){{10,}}$') AS noise FROM w) SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(sum(noise::INT) AS INT) AS n_noise FROM f GROUP BY doc_id")
def noise_line_flags(spark, d):
    """Lines and noise lines of each text, counted where the text is."""
    lines = F.split("text", "\n")
    return load(spark, d, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, X.noise_line)).alias("n_noise"))


_RUN = "len(list_filter(generate_series(1, len(w) - 4), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3] AND w[i] = w[i + 4])) > 0"
_CONTENT = "list_filter(list_transform(w, lambda x: lower(x)), lambda x: x NOT IN (" + ", ".join(f"'{x}'" for x in X.REPEAT_STOP) + "))"


@query(rf"WITH t AS (SELECT doc_id, {_P.replace('(s,', '(text,')} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, {_CONTENT} AS c FROM t), m AS (SELECT doc_id, w, c, coalesce(list_max(map_values(list_aggregate(c, 'histogram'))), 0) AS top FROM c) SELECT doc_id, CAST(len(w) AS INT) AS n_words, CAST(top AS INT) AS top, len(w) >= 10 AND ({_RUN} OR top > 0.3 * len(c)) AS repetitive FROM m")
def repetition_flag(spark, d):
    """Equal words in a row, or a content word that is too frequent."""
    found = load(spark, d, "documents").filter("text is not null").select("doc_id", X.repetition(F.col("text")).alias("r"))
    return found.select("doc_id", F.col("r.n").alias("n_words"), "r.top", F.col("r.flag").alias("repetitive"))


@query("SELECT doc_id, CAST(s // 1400 AS INT) AS position, substring(text, CAST(s + 1 AS BIGINT), 1500) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1400)) AS s FROM documents WHERE length(text) > 0)")
def fixed_window_chunks(spark, d):
    """T5."""
    return T.fixed_windows(load(spark, d, "documents"), "doc_id", "text", 1500, 100)


@query()
def semantic_chunks(spark, d):
    """Stateful; checked against plain Python."""
    return T.chunk(load(spark, d, "documents"), "doc_id", "text")


def _vote_sql() -> str:
    counts = ", ".join("len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{s}'" for s in stop) + f"))) AS {lang}" for lang, stop in PROFILES.items())
    top = "greatest(" + ", ".join(PROFILES) + ")"
    case = " ".join(f"WHEN {lang} = {top} AND {top} > 0 THEN '{lang}'" for lang in PROFILES)
    return f"WITH v AS (SELECT doc_id, {counts} FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}]+') AS w FROM documents)) SELECT doc_id, CASE {case} ELSE 'en' END AS language, CAST({top} AS BIGINT) AS votes FROM v"


@query(_vote_sql())
def language_vote(spark, d):
    """T7."""
    return T.language_vote(load(spark, d, "documents"), "doc_id", "text", PROFILES).withColumn("votes", F.col("votes").cast("long"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, try_cast(nullif(regexp_extract(url, '/([0-9]+)[^0-9/]*/?[^/]*$', 1), '') AS INT) AS number FROM pages")
def url_path_metadata(spark, d):
    """T9, X13-X16 on urls."""
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '/([0-9]+)[^0-9/]*/?[^/]*$', 1), '') AS int)")
    return load(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1).alias("lang"), number.alias("number"))


_STOP = ", ".join(f"'{s}'" for s in STOP)


@query(rf"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE regexp_matches(word, '^[a-z]{{4,}}$') AND word NOT IN ({_STOP}) GROUP BY ALL) SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INT) AS rank FROM c QUALIFY rank <= 20")
def word_frequencies_grouped(spark, d):
    """A19, X18, T17, T19."""
    return T.word_frequencies(load(spark, d, "documents"), ["lang"], "text", STOP)


@query(r"SELECT conv_id, turn, CAST(len(i) AS BIGINT) AS n_items, array_to_string(i, '|') AS items FROM (SELECT conv_id, turn, CASE WHEN contains(upper(text), 'NONE_FOUND') THEN [] ELSE list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 10), lambda x: trim(regexp_replace(x, '^([-•*–·]|[0-9][.):])\s*', ''))) END AS i FROM conversations)")
def bullet_parse(spark, d):
    """X20, X22."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", L.parse_bullets(F.col("text")).alias("i"))
    return rows.select("conv_id", "turn", F.size("i").cast("long").alias("n_items"), F.array_join("i", "|").alias("items"))


@query("SELECT source, min(doc_id) AS doc_id, lower(trim(text)) AS folded FROM documents GROUP BY source, lower(trim(text))")
def dedup_case_insensitive(spark, d):
    """U6."""
    from millrace.operators.stats import distinct_first

    return distinct_first(load(spark, d, "documents").select("doc_id", "source", "text"), ["source"], "text", ["doc_id"]).select("source", "doc_id", F.lower(F.trim("text")).alias("folded"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def incremental_resume(spark, d):
    """What is not done yet."""
    return T.pending(load(spark, d, "documents").select("doc_id"), load(spark, d, "labels"), ["doc_id"])


@query("WITH p AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS position FROM conversations) SELECT conv_id, turn, position, CAST(floor((position - 1) / 3) AS INT) AS batch FROM p")
def extraction_batches(spark, d):
    """L2: position and batch number within a key."""
    return L.batches(load(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 3)


# ---------------------------------------------------------------- vectors and topics


def _items(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("topic"))


def _queries(items):
    """The query set, which grows with the items: each row whose id is divisible by 100."""
    return items.filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"), "topic")


_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS INT) AS rank, round({_DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5")
def similarity_topk_filtered(spark, d):
    """Every hundredth item against all items of its topic."""
    items = _items(spark, d)
    return R.topk(_queries(items), items, 5, ["topic"]).select("query_id", "item_id", "rank", r("score"))


@query(f"WITH h AS (SELECT a.vec_id AS query_id, a.label AS topic, b.vec_id AS item_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 QUALIFY rank <= 6), f AS (SELECT topic, item_id, min((query_id, rank)) AS m FROM h GROUP BY ALL) SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY m) AS INT) AS place, item_id FROM f QUALIFY place <= 10")
def multi_query_union(spark, d):
    """R4, U7."""
    items = _items(spark, d)
    q = _queries(items)
    hits = R.topk(q, items, 6, ["topic"]).join(q.select("query_id", "topic"), "query_id")
    return R.union_first(hits, "topic", 10).select("topic", "place", "item_id")


@query()
def mmr_topk(spark, d):
    """Greedy, for every hundredth item; at lam = 1 it equals the similarity search (tested)."""
    items = _items(spark, d)
    return R.mmr(_queries(items), items, 5, ["topic"])


@query(f"WITH t AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10) SELECT query_id, count(*) FILTER (rank <= 5) AS n_shared, round(count(*) FILTER (rank <= 5) / count(*), 6) AS jaccard FROM t GROUP BY query_id")
def retrieval_overlap(spark, d):
    """Five against ten results."""
    items = _items(spark, d)
    q = _queries(items)
    return rounded(R.overlap(R.topk(q, items, 5, ["topic"]), R.topk(q, items, 10, ["topic"])), "jaccard")


_CENTRES = "c AS (SELECT label AS topic, list_transform(generate_series(1, 64), lambda i: 0.0) AS z, [" + ", ".join(f"avg(CAST(embedding[{k}] AS DOUBLE))" for k in range(1, 65)) + "] AS centroid FROM embeddings GROUP BY label)"


@query(f"WITH {_CENTRES} SELECT vec_id AS item_id, CAST(arg_min(topic, (-list_inner_product(CAST(embedding AS DOUBLE[]), centroid), topic)) AS INT) AS assigned FROM embeddings, c GROUP BY vec_id")
def nearest_centroid_reassign(spark, d):
    """M8, R7."""
    items = _items(spark, d)
    return M.assign_nearest(items, M.centroids(items, "topic", "embedding", 64), "topic", "embedding").select("item_id", "assigned")


@query(f"WITH {_CENTRES} SELECT x.topic AS a, y.topic AS b, round(list_cosine_similarity(x.centroid, y.centroid), 6) AS cosine FROM c x JOIN c y ON x.topic < y.topic")
def topic_similarity_matrix(spark, d):
    """M17."""
    return rounded(M.similarity_matrix(M.centroids(_items(spark, d), "topic", "embedding", 64), "topic"), "cosine")


@query(rf"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w WHERE regexp_matches(term, '^[a-z]{{4,}}$') AND term NOT IN ({_STOP}) GROUP BY ALL), z AS (SELECT lang, sum(n) AS size FROM c GROUP BY lang), f AS (SELECT term, sum(n) AS f FROM c GROUP BY term), m AS (SELECT sum(size) / count(*) AS mean FROM z), s AS (SELECT c.lang, c.term, n, n / size * ln(1.0 + mean / f) AS score FROM c JOIN z ON c.lang = z.lang JOIN f ON c.term = f.term, m) SELECT lang, term, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(score, 12) DESC, term) AS INT) AS rank, n, round(score, 8) AS score FROM s QUALIFY rank <= 10")
def ctfidf_keywords(spark, d):
    """M4, M5."""
    return M.ctfidf(load(spark, d, "documents"), "lang", "text", STOP).select("lang", "term", "rank", "n", r("score", 8))


@query("SELECT CASE WHEN label IN (1, 3) THEN 1 WHEN label IN (2, 5, 7) THEN 2 ELSE label END AS merged, count(*) AS n FROM embeddings GROUP BY 1")
def merge_topics_map(spark, d):
    """M10, M11, M13."""
    items = _items(spark, d)
    return M.merge_topics(items, "topic", [[1, 3], [2, 5, 7], [9, 99]], set(range(10))).groupBy("merged").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS t, count(*) AS n FROM embeddings GROUP BY 1) SELECT count(*) FILTER (t <> -1) AS n_topics, round(100.0 * coalesce(sum(n) FILTER (t = -1), 0) / sum(n), 6) AS outlier_pct, min(n) FILTER (t <> -1) AS size_min, max(n) FILTER (t <> -1) AS size_max, round(median(n) FILTER (t <> -1), 6) AS size_median, round(avg(n) FILTER (t <> -1), 6) AS size_mean, round(100.0 * max(n) FILTER (t <> -1) / sum(n), 6) AS largest_pct FROM s")
def topic_size_stats(spark, d):
    """Statistics of topic sizes."""
    items = _items(spark, d).withColumn("topic", F.when(F.col("topic") == 0, F.lit(-1)).otherwise(F.col("topic")))
    return rounded(M.size_stats(items, "topic"), "outlier_pct", "size_median", "size_mean", "largest_pct")


@query()
def kmeans_topics(spark, d):
    """M2, M3, M7: PCA, k-means, distance outliers."""
    return M.cluster(_items(spark, d).drop("topic"), "embedding", 8).select("item_id", "topic")


# ---------------------------------------------------------------- models and forecasts


def _treated(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.year("o_orderdate") >= 1998).cast("int").alias("post"), F.year("o_orderdate").alias("t"), (F.col("o_totalprice") / 1e5).alias("y"))
    return o.join(load(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("treated")), "c_custkey")


_TR = "tr AS (SELECT (year(o_orderdate) >= 1998)::INT AS post, year(o_orderdate) AS t, o_totalprice / 1e5 AS y, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS treated FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {_TR}, m AS (SELECT avg(y) FILTER (treated = 1 AND post = 1) AS a, avg(y) FILTER (treated = 1 AND post = 0) AS b, avg(y) FILTER (treated = 0 AND post = 1) AS c, avg(y) FILTER (treated = 0 AND post = 0) AS e FROM tr) SELECT round(a, 6) AS t_post, round(b, 6) AS t_pre, round(c, 6) AS c_post, round(e, 6) AS c_pre, round((a - b) - (c - e), 6) AS did FROM m")
def did_2x2(spark, d):
    """E5."""
    return rounded(E.did(_treated(spark, d), "y", "treated", "post"), "t_post", "t_pre", "c_post", "c_pre", "did")


@query(f"WITH {_TR} SELECT CAST(s AS INT) AS start, round((avg(y) FILTER (treated = 1 AND t >= s) - avg(y) FILTER (treated = 1 AND t < s)) - (avg(y) FILTER (treated = 0 AND t >= s) - avg(y) FILTER (treated = 0 AND t < s)), 6) AS did FROM tr, generate_series(1996, 2000) g(s) GROUP BY s")
def did_year_grid(spark, d):
    """E5, E6."""
    return rounded(E.did_grid(_treated(spark, d), "y", "treated", "t", list(range(1996, 2001))), "did")


@query(f"WITH {PP}, s AS (SELECT count(unit) FILTER (grp = 'metal') AS n1, count(unit) FILTER (grp = 'promo') AS n2, avg(unit) FILTER (grp = 'metal') AS m1, avg(unit) FILTER (grp = 'promo') AS m2, var_samp(unit) FILTER (grp = 'metal') AS v1, var_samp(unit) FILTER (grp = 'promo') AS v2 FROM pp) SELECT n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t FROM s")
def pooled_t_test(spark, d):
    """E7."""
    return rounded(E.t_test(priced_parts(spark, d), "grp", "unit", "metal", "promo"), "m1", "m2", "t")


@query(f"WITH {PP}, m AS (SELECT grp, avg(unit) AS m FROM pp GROUP BY grp), a AS (SELECT avg(unit) AS a FROM pp) SELECT round(1 - sum((unit - m) * (unit - m)) / sum((unit - a) * (unit - a)), 6) AS r2, round(avg(abs(unit - m)), 6) AS mae, round(sqrt(avg((unit - m) * (unit - m))), 6) AS rmse FROM pp JOIN m ON pp.grp = m.grp, a")
def group_mean_residual_r2(spark, d):
    """E8, E12, W9."""
    return rounded(E.group_mean_fit(priced_parts(spark, d), "grp", "unit"), "r2", "mae", "rmse")


@query(f"WITH {NY}, s AS (SELECT k, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM ny GROUP BY k) SELECT k, CAST(t AS INT) AS t, round(a + b * t, 6) AS projected FROM (SELECT k, a, b, unnest(generate_series(2002, 2006)) AS t FROM s)")
def linear_trend_forecast(spark, d):
    """E9, F2."""
    return C.project(C.linear_trend(nation_years(spark, d), ["k"], "t", "y"), "t", (2002, 2006)).select("k", "t", r("projected"))


@query(f"WITH {NY}, l AS (SELECT k, max(t) AS t0, arg_max(y, t) AS y FROM ny GROUP BY k), g AS (SELECT k, y, unnest(generate_series(t0 + 1, 2006)) AS t FROM l), s AS (SELECT t, 'bau' AS scenario, y FROM g UNION ALL SELECT t, 'tight', y * 0.8 FROM g UNION ALL SELECT t, 'switch', CASE WHEN t < 2004 THEN y * 0.7 ELSE y * 0.4 END FROM g), m AS (SELECT scenario, t, avg(y) AS mean FROM s GROUP BY ALL) SELECT m.scenario, CAST(m.t AS INT) AS t, round(m.mean, 6) AS mean, round((m.mean / b.mean - 1) * 100, 6) AS pct_change FROM m JOIN m b ON m.scenario = b.scenario AND b.t = 2003")
def scenario_paths(spark, d):
    """F1, F3, F4, F6, P22."""
    grid = P.future_grid(nation_years(spark, d), "k", "t", 2006)
    rules = {"bau": {"y": F.lit(1.0)}, "tight": {"y": F.lit(0.8)}, "switch": {"y": F.when(F.col("t") < 2004, 0.7).otherwise(0.4)}}
    paths = C.scenarios(grid, rules).select("scenario", "t", F.col("s_y").alias("v"))
    return rounded(C.period_average(paths, ["scenario", "t"], "v", "t", 2003), "mean", "pct_change")


@query(f"WITH {NY}, w AS (SELECT y - avg(y) OVER (PARTITION BY k) AS y, n - avg(n) OVER (PARTITION BY k) AS x FROM ny) SELECT 'fe' AS model, 'n' AS term, round(sum(x * y) / sum(x * x), 8) AS coef FROM w")
def fixed_effects_slope(spark, d):
    """E1, W10."""
    fit = E.panel_ols(nation_years(spark, d), "y", ["n"], "k", "t", "entity", cluster="k", least=1)
    return fit.tidy(spark, "fe").select("model", "term", r("coef", 8))


@query("WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_discount * l_discount) AS b, sum(l_quantity * l_discount) AS c FROM lineitem), v AS (SELECT round(a * b / (a * b - c * c), 6) AS v FROM g) SELECT unnest(['l_quantity', 'l_discount']) AS feature, v AS vif, CASE WHEN v >= 10 THEN 'high' ELSE 'ok' END AS status FROM v")
def vif_two_feature(spark, d):
    """E4."""
    return rounded(E.vif(load(spark, d, "lineitem"), ["l_quantity", "l_discount"]), "vif")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS const, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_line(spark, d):
    """D18, E1 pooled: least squares from sums."""
    fit = E.ols(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(fit.coef[0]), 4), round(float(fit.coef[1]), 4), round(float(fit.r2), 6))], "const double, slope double, r2 double")


@query()
def panel_subset_search(spark, d):
    """All subsets from one pass of sums."""
    ny = nation_years(spark, d).withColumn("age", F.col("t") - 1995).withColumn("age2", F.col("age") * F.col("age"))
    return E.subset_search(ny, "y", ["n", "age", "age2"], entity="k")


@query()
def granger_lags(spark, d):
    """Joint test of two lags."""
    g = E.granger(nation_years(spark, d).withColumn("x", F.col("n").cast("double")), "y", "x", "k", "t")
    return spark.createDataFrame([(int(g["n"]), float(g["f"]), float(g["p"]), float(g["wald"]), float(g["p_wald"]))], "n long, f double, p double, wald double, p_wald double")


@query()
def random_intercept_model(spark, d):
    """E2."""
    m = E.random_intercept(nation_years(spark, d), "y", "t", "k")
    return spark.createDataFrame([tuple(m.values())], "const double, slope double, var_residual double, var_entity double")


@query()
def random_forest_eval(spark, d):
    """Trained on earlier rows, judged on later ones."""
    rows = load(spark, d, "lineitem").withColumn("late", F.year("l_shipdate") >= 2000).select("late", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    metrics, _ = C.forest(rows.filter("not late"), rows.filter("late"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"], trees=10, depth=6)
    return metrics
