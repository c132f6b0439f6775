"""Queries of panel models, treatment effects, datasets, topics and retrieval-driven extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as X
from millrace.operators import econometrics as E
from millrace.operators import extract as L
from millrace.operators import forecast as C
from millrace.operators import frames as W
from millrace.operators import panel as P
from millrace.operators import retrieval as R
from millrace.operators import stats as S
from millrace.operators import text as T
from millrace.operators import topics as M
from millrace.plans.analytics import ORACLES as ORACLES_OF_TEXTS
from millrace.plans.relational import NY, TYPE_RULES, nation_years, r, registrar, rounded
from millrace.session import scratch
from millrace.sources import sinks as K
from millrace.sources.tables import load

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

# ---------------------------------------------------------------- panel models


#: Entities that have every period, on which two-way differences are exact.
NB = "nb AS (SELECT * FROM ny WHERE k IN (SELECT k FROM ny GROUP BY k HAVING count(*) = (SELECT count(DISTINCT t) FROM ny)))"


def _balanced(spark, d):
    ny = nation_years(spark, d)
    return P.complete_entities(ny, "k", "y", ny.agg(F.countDistinct("t")).first()[0])


def _slope(within: str) -> str:
    return f"(SELECT sum(x * y) / sum(x * x) FROM ({within}))"


_BY = {
    "entity": "SELECT y - avg(y) OVER (PARTITION BY k) AS y, n - avg(n) OVER (PARTITION BY k) AS x FROM ny",
    "time": "SELECT y - avg(y) OVER (PARTITION BY t) AS y, n - avg(n) OVER (PARTITION BY t) AS x FROM ny",
    "twoway": "SELECT y - avg(y) OVER (PARTITION BY k) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y, n - avg(n) OVER (PARTITION BY k) - avg(n) OVER (PARTITION BY t) + avg(n) OVER () AS x FROM ny",
    "pooled": "SELECT y - avg(y) OVER () AS y, n - avg(n) OVER () AS x FROM ny",
}


def _fit(df, effects: str):
    return E.panel_ols(df, "y", ["n"], "k", "t", effects, least=1)


@query(f"WITH {NY}, {NB} SELECT 'twoway' AS model, 'n' AS term, round({_slope(_BY['twoway'].replace('FROM ny', 'FROM nb'))}, 8) AS coef")
def twoway_effects_slope(spark, d):
    """Entity and time effects, on the entities that have every period."""
    return _fit(_balanced(spark, d), "twoway").tidy(spark, "twoway").select("model", "term", r("coef", 8))


@query(f"WITH {NY} SELECT 'time' AS model, 'n' AS term, round({_slope(_BY['time'])}, 8) AS coef")
def time_effects_slope(spark, d):
    """Time effects."""
    return _fit(nation_years(spark, d), "time").tidy(spark, "time").select("model", "term", r("coef", 8))


@query(f"""WITH {NY}, m AS (SELECT k, count(*) AS t, avg(y) AS ym, avg(n) AS xm FROM ny GROUP BY k),
w AS (SELECT sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n FROM ({_BY['entity']})),
b AS (SELECT regr_syy(ym, xm) - regr_sxy(ym, xm) * regr_sxy(ym, xm) / regr_sxx(ym, xm) AS ssr, count(*) AS m, count(*) / sum(1.0 / t) AS h FROM m),
v AS (SELECT (yy - xy * xy / xx) / (n - m - 1) AS e, greatest(0, ssr / (m - 2) - (yy - xy * xy / xx) / (n - m - 1) / h) AS u FROM w, b),
s AS (SELECT 1 - (1 - sqrt(e / (e + u * m.t))) AS c, y - (1 - sqrt(e / (e + u * m.t))) * ym AS y, n - (1 - sqrt(e / (e + u * m.t))) * xm AS x FROM ny JOIN m ON ny.k = m.k, v),
g AS (SELECT sum(c * c) AS cc, sum(c * x) AS cx, sum(x * x) AS xx, sum(c * y) AS cy, sum(x * y) AS xy FROM s)
SELECT round((xx * cy - cx * xy) / (cc * xx - cx * cx), 6) AS const, round((cc * xy - cx * cy) / (cc * xx - cx * cx), 8) AS slope FROM g""")
def random_effects_slope(spark, d):
    """Random entity effects."""
    fit = E.random_effects(nation_years(spark, d), "y", ["n"], "k")
    return spark.createDataFrame([(round(fit["coef"]["const"], 6), round(fit["coef"]["n"], 8))], "const double, slope double")


@query(f"WITH {NY}, s AS (SELECT k % 3 AS segment, y - avg(y) OVER (PARTITION BY k % 3, t) AS y, n - avg(n) OVER (PARTITION BY k % 3, t) AS x FROM ny) SELECT CAST(segment AS INT) AS segment, round(sum(x * y) / sum(x * x), 8) AS coef FROM s GROUP BY segment")
def segment_fits(spark, d):
    """A time-effects fit, clustered by entity, of each segment."""
    ny = nation_years(spark, d)
    fits = {s: E.panel_ols(ny.filter(F.col("k") % 3 == s), "y", ["n"], "k", "t", "time", cluster="k", least=1) for s in range(3)}
    return spark.createDataFrame([(s, round(float(f.coef[0]), 8)) for s, f in fits.items()], "segment int, coef double")


@query(f"WITH {NY}, {NB} SELECT 'n' AS term, " + ", ".join(f"round({_slope(_BY[m].replace('FROM ny', 'FROM nb'))}, 8) AS {m}" for m in ("entity", "time", "twoway", "pooled")))
def model_comparison(spark, d):
    """Coefficients of several models beside each other."""
    fits = {m: _fit(_balanced(spark, d), m) for m in ("entity", "time", "twoway", "pooled")}
    return rounded(E.compared(fits, spark).filter("term = 'n'"), *fits, digits=8)


# ---------------------------------------------------------------- treatment effects


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {_det([row[:j] + row[j + 1 :] for row in m[1:]])}" for j in range(len(m))) + ")"


def _first_coefficient(terms: list[str], y: str, table: str) -> str:
    """SQL of the first coefficient of a least-squares fit, by Cramer's rule."""
    s = lambda a, b: f"(SELECT sum({a} * {b}) FROM {table})"
    gram = [[s(a, b) for b in terms] for a in terms]
    return f"{_det([[s(a, y), *row[1:]] for a, row in zip(terms, gram)])} / {_det(gram)}"


_TREATED = "tr AS (SELECT c_nationkey AS k, year(o_orderdate) AS t, o_totalprice / 1e5 AS y, (c_nationkey % 4 = 0)::INT AS d, o_custkey % 10 / 10.0 AS x FROM orders JOIN customer ON o_custkey = c_custkey)"


def _start(k: int) -> str:
    terms = {f"e{k}": f"((t >= {k})::INT * d)", f"p{k}": f"(t >= {k})::INT", "x": "x", "y": "y"}
    return "w" + str(k) + " AS (SELECT " + ", ".join(f"{v} - avg({v}) OVER (PARTITION BY k) AS {n}" for n, v in terms.items()) + " FROM tr)"


def _treated(spark, d):
    o = load(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("t"), (F.col("o_totalprice") / 1e5).alias("y"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    return o.join(c, "o_custkey").withColumn("d", (F.col("k") % 4 == 0).cast("int")).withColumn("x", F.col("o_custkey") % 10 / 10.0)


_STARTS = [1997, 1998, 1999]


@query(f"WITH {_TREATED}, " + ", ".join(map(_start, _STARTS)) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS start, round({_first_coefficient([f'e{k}', f'p{k}', 'x'], 'y', f'w{k}')}, 6) AS coef" for k in _STARTS))
def did_controlled(spark, d):
    """E5: effects on the treated with a control and entity effects, for each start."""
    return E.did_controlled(_treated(spark, d), "y", "d", "t", ["x"], "k", _STARTS).select("start", r("coef"))


@query()
def best_treatment_year(spark, d):
    """The best start by three criteria, of the estimates with a control and entity effects."""
    return E.best_start(E.did_controlled(_treated(spark, d), "y", "d", "t", ["x"], "k", _STARTS))


_SPLITS = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "many": "l_quantity > 25"}
_SSE = "sum((l_extendedprice - m) * (l_extendedprice - m))"


@query("WITH " + ", ".join(f"{n} AS (SELECT '{n}' AS split, {_SSE} AS sse, max(m) FILTER (b) AS mean_true, max(m) FILTER (NOT b) AS mean_false FROM (SELECT l_extendedprice, {t} AS b, avg(l_extendedprice) OVER (PARTITION BY {t}) AS m FROM lineitem))" for n, t in _SPLITS.items()) + ", a AS (SELECT " + _SSE.replace("m)", "(SELECT avg(l_extendedprice) FROM lineitem))") + " AS total FROM lineitem), u AS (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in _SPLITS) + ") SELECT split, round(mean_true, 3) AS mean_true, round(mean_false, 3) AS mean_false, round(1 - sse / total, 6) AS r2 FROM u, a ORDER BY sse LIMIT 1")
def depth_one_tree(spark, d):
    """The best single split, its means and its fit."""
    best = E.one_split(load(spark, d, "lineitem"), "l_extendedprice", {n: F.expr(t) for n, t in _SPLITS.items()})
    return best.select("split", r("mean_true", 3), r("mean_false", 3), r("r2"))


# ---------------------------------------------------------------- datasets, scores, forecasts


@query("""WITH ln AS (SELECT l_suppkey AS k, year(l_shipdate) AS t, sum(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END) AS a, sum(CASE WHEN l_quantity > 48 THEN NULL ELSE l_tax END) AS b, sum(l_quantity) AS q, max(p_type) AS tech FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
m AS (SELECT k, count(a) >= count(b) AS f FROM ln GROUP BY k)
SELECT ln.k, CAST(t AS INT) AS t, CASE WHEN f THEN 'a' ELSE 'b' END AS method, round((CASE WHEN f THEN a ELSE b END + a) / q, 8) AS intensity, """ + "CASE " + " ".join(f"WHEN tech LIKE '%{a}%' THEN '{b}'" for a, b in TYPE_RULES) + """ ELSE 'Other' END AS grp
FROM ln JOIN m ON ln.k = m.k WHERE q > 0 AND t BETWEEN 1996 AND 1999""")
def analysis_dataset(spark, d):
    """Filters, best method of each entity, a total that is NULL if a part is, its ratio, and the group."""
    line = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a, b = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")), F.when(F.col("l_quantity") <= 48, F.col("l_tax"))
    rows = line.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("t")).agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum("l_quantity").alias("q"), F.max("p_type").alias("tech"))
    best = P.best_available(rows, "k", "a", "b").filter((F.col("q") > 0) & F.col("t").between(1996, 1999))
    return best.select("k", "t", "method", r(X.ratio(F.col("best") + F.col("a"), F.col("q")), 8).alias("intensity"), X.substring_group(F.col("tech"), TYPE_RULES).alias("grp"))


@query("SELECT s_suppkey, n_name AS tech, coalesce(CAST(nullif(n_nationkey % 21, 20) AS DOUBLE), 0.0) AS technology_score FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def technology_lookup(spark, d):
    """The technology score of each entity by a lookup, 0 without."""
    table = load(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("tech"), F.nullif(F.col("n_nationkey") % 21, F.lit(20)).cast("double").alias("v"))
    return load(spark, d, "supplier").join(table, "s_nationkey", "left").select("s_suppkey", "tech", F.coalesce("v", F.lit(0.0)).alias("technology_score"))


@query("""WITH names AS (SELECT 'src1' AS source, 'Alpha' AS company UNION ALL SELECT 'src2', 'Beta'), talk AS (SELECT coalesce(names.company, d.source) AS company, avg(n_chars) AS talk FROM documents d LEFT JOIN names ON d.source = names.source GROUP BY 1),
action AS (SELECT CASE WHEN n_nationkey = 1 THEN 'Alpha' WHEN n_nationkey = 2 THEN 'Beta' WHEN n_nationkey < 10 THEN 'src' || CAST(n_nationkey AS VARCHAR) ELSE n_name END AS company, CAST(n_regionkey AS DOUBLE) AS action FROM nation)
SELECT coalesce(t.company, a.company) AS company, round(talk, 4) AS talk, action, CASE WHEN a.company IS NULL THEN 'talk_only' WHEN t.company IS NULL THEN 'new_reporter' ELSE 'both' END AS reported FROM talk t FULL JOIN action a ON t.company = a.company""")
def talk_action_merge(spark, d):
    """Both scores under mapped names, and who has both, talk only, or is new."""
    talk = load(spark, d, "documents").groupBy(X.mapped(F.col("source"), {"src1": "Alpha", "src2": "Beta"}, keep=True).alias("company")).agg(r(F.avg("n_chars"), 4).alias("talk"))
    k = F.col("n_nationkey")
    name = F.when(k == 1, "Alpha").when(k == 2, "Beta").when(k < 10, F.concat(F.lit("src"), k.cast("string"))).otherwise(F.col("n_name"))
    action = load(spark, d, "nation").select(name.alias("company"), F.col("n_regionkey").cast("double").alias("action"))
    return C.merged_scores(talk, action, "company", "talk", "action")


@query(f"WITH {NY}, s AS (SELECT k, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(t) AS t0 FROM ny GROUP BY k), g AS (SELECT k, a, b, unnest(generate_series(t0 + 1, 2004)) AS t FROM s) SELECT k, CAST(t AS INT) AS t, round(a + b * t, 6) AS bau, round((a + b * t) * 0.9, 6) AS tight, round((a + b * t) * CASE WHEN t < 2003 THEN 0.8 ELSE 0.5 END, 6) AS switch FROM g")
def wide_predictions(spark, d):
    """a fitted model's predictions under each scenario, assembled beside each other."""
    ny = nation_years(spark, d)
    grid = P.future_grid(ny, "k", "t", 2004).select("k", "t").join(C.linear_trend(ny, ["k"], "t", "y"), "k").withColumn("v", F.col("intercept") + F.col("slope") * F.col("t"))
    rules = {"bau": {"v": F.lit(1.0)}, "tight": {"v": F.lit(0.9)}, "switch": {"v": F.when(F.col("t") < 2003, 0.8).otherwise(0.5)}}
    return rounded(C.wide(C.scenarios(grid, rules), ["k", "t"], "s_v", list(rules)), *rules)


# ---------------------------------------------------------------- topics

_STOPS = ["that", "this", "with", "from"]
_IN = ", ".join(f"'{s}'" for s in _STOPS)
_TERMS = rf"w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{4,}}$') AND x NOT IN ({_IN})) AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS term FROM w UNION ALL SELECT doc_id, l[i] || ' ' || l[i + 1] FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 1)) AS i FROM w))"


@query(f"WITH {_TERMS}, c AS (SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM t GROUP BY term) SELECT * FROM c WHERE n_docs >= 5 AND n_docs <= 0.5 * (SELECT count(*) FROM documents)")
def ngram_vocabulary(spark, d):
    """M4: terms of one and two words within bounds of document frequency."""
    return M.vocabulary(load(spark, d, "documents"), "doc_id", "text", _STOPS, min_df=5, max_df=0.5)


_TOPIC = "CASE WHEN source = 'src0' THEN -1 ELSE CAST(substring(source, 4) AS INT) END"


@query(rf"""WITH c AS (SELECT {_TOPIC} AS topic, term, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents WHERE source IS NOT NULL) WHERE regexp_matches(term, '^[a-z]{{4,}}$') AND term NOT IN ({_IN}) GROUP BY ALL),
s AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) * ln(1 + (sum(n) OVER () / (SELECT count(DISTINCT topic) FROM c)) / sum(n) OVER (PARTITION BY term)) AS score FROM c),
k AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, term) AS rank FROM s QUALIFY rank <= 4)
SELECT topic, CASE WHEN topic = -1 THEN 'Outliers (unassigned)' WHEN topic % 5 = 4 THEN 'Topic ' || topic ELSE string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 3) END AS label FROM k GROUP BY topic""")
def topic_labels(spark, d):
    """M9: three keywords of a topic's documents as its label, Topic N where the keywords are empty, a fixed one for outliers."""
    docs = load(spark, d, "documents").filter("source is not null").withColumn("topic", F.when(F.col("source") == "src0", -1).otherwise(F.substr("source", F.lit(4)).cast("int")))
    keywords = M.ctfidf(docs, "topic", "text", _STOPS, n=4)
    return M.labels(keywords.withColumn("term", F.when(F.col("topic") % 5 == 4, F.lit("")).otherwise(F.col("term"))).filter("term <> '' or rank = 1"), "topic")


@query("SELECT CASE WHEN label IN (2, 7) THEN -1 ELSE label END AS topic, count(*) AS n FROM embeddings GROUP BY 1")
def empty_topics_dropped(spark, d):
    """Documents of topics without keywords become outliers."""
    items = load(spark, d, "embeddings").select("vec_id", F.col("label").alias("topic"))
    names = items.select("topic").distinct().withColumn("keywords", F.when(F.col("topic").isin(2, 7), F.lit(" ")).otherwise(F.lit("a, b")))
    return M.drop_empty(items, names, "topic").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


_LABELS = list(range(10))


@query("SELECT CAST(2015 + vec_id % 8 AS INT) AS year, " + ", ".join(f'count(*) FILTER (label = {k}) AS "{k}"' for k in _LABELS) + " FROM embeddings GROUP BY 1")
def topics_over_time(spark, d):
    """Documents by year and topic."""
    items = load(spark, d, "embeddings").select((2015 + F.col("vec_id") % 8).cast("int").alias("year"), F.col("label").alias("topic"))
    return S.pivot_counts(items, ["year"], "topic", _LABELS)


_KEYWORDS = rf"(SELECT '{{0}}' AS category, source, term, CAST(row_number() OVER (PARTITION BY source ORDER BY round(n / size * ln(1 + mean / f), 12) DESC, term) AS INT) AS rank FROM (SELECT source, term, n, sum(n) OVER (PARTITION BY source) AS size, sum(n) OVER (PARTITION BY term) AS f, sum(n) OVER () / (SELECT count(DISTINCT source) FROM x{{0}}) AS mean FROM x{{0}}) QUALIFY rank <= {{1}})"


def _counts(lang: str) -> str:
    return rf"x{lang} AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents WHERE lang = '{lang}') WHERE regexp_matches(term, '^[a-z]{{4,}}$') AND term NOT IN ({_IN}) GROUP BY ALL)"


@query(f"WITH {_counts('en')}, {_counts('de')} {_KEYWORDS.format('en', 5)} UNION ALL {_KEYWORDS.format('de', 3)}")
def category_keywords(spark, d):
    """The topic step of each category, with the parameters of its own."""
    state = K.RunState("run", "", {"n": 5})
    parts = []
    for category in ("en", "de"):
        own = K.RunState(state.name, category, state.parameters).with_overrides({"de": {"n": 3}})
        docs = load(spark, d, "documents").filter(F.col("lang") == category)
        parts.append(M.ctfidf(docs, "source", "text", _STOPS, n=own.parameters["n"]).select(F.lit(category).alias("category"), "source", "term", "rank"))
    return parts[0].unionByName(parts[1])


@query()
def keyword_rerank(spark, d):
    """M6: keywords near their class and unlike each other; vectors of terms are their shares by source."""
    docs = load(spark, d, "documents")
    top = M.ctfidf(docs, "lang", "text", _STOPS, n=30).select("lang", "term")
    words = docs.select("source", "lang", F.explode(X.words(F.col("text"))).alias("term"))
    sources = sorted(r[0] for r in docs.select("source").distinct().collect() if r[0])  # a vector has a place for each
    share = lambda df, keys: df.groupBy(*keys).agg(*[F.avg((F.col("source") == s).cast("double")).alias(s) for s in sources]).select(*keys, F.array(*sources).alias("v"))
    terms = share(words.join(F.broadcast(top.select("term").distinct()), "term"), ["term"])  # thirty terms a class
    centre = share(words, ["lang"]).withColumnRenamed("v", "c")
    return M.reranked(top.join(terms, "term").join(centre, "lang"), "lang", "term", "v", "c")


@query()
def staged_topic_search(spark, d):
    """Parameters searched stage by stage, the best of each locked."""
    return M.staged_search(load(spark, d, "embeddings"), "embedding", [{"k": [6, 10]}, {"dims": [4, 8]}], {"k": 8, "dims": 6})


# ---------------------------------------------------------------- retrieval, texts


@query("""WITH h AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 QUALIFY rank <= 4)
SELECT query_id, item_id, CAST(rank AS INT) AS rank, trim(string_split(text, chr(10))[1]) AS item FROM h JOIN documents ON doc_id = item_id WHERE length(trim(string_split(text, chr(10))[1])) >= 10""")
def retrieval_extraction(spark, d):
    """Of the texts nearest to a question what the model extracts from them, here the first line."""
    items = load(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("topic"))
    asked = items.filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"), "topic")
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    found = R.topk(asked, items, 4, ["topic"]).join(texts, "item_id").withColumn("batch", F.lit(0)).withColumn("position", F.lit(1))
    answers = L.run_model(found, ["query_id", "item_id", "rank"], "text", "List", lambda prompt: "- " + prompt.split("\n\n", 1)[1].split("\n")[0].strip())
    return answers.select("query_id", "item_id", "rank", F.explode(L.parse_bullets(F.col("answer"))).alias("item")).filter(F.length("item") >= 10)


@query("""SELECT a.vec_id AS query_id, b.vec_id AS item_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS INT) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 QUALIFY rank <= 3""")
def stored_index_search(spark, d):
    """A flat index built once, kept by topic on disk, and searched where the filter says."""
    path = scratch(spark, "index")
    items = load(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("topic"))
    R.build_index(items, path, "topic")
    asked = items.filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"), "topic")
    return R.topk(asked, R.load_index(spark, path), 3, ["topic"]).select("query_id", "item_id", "rank")


_PROFILES = {"de": ["der", "die", "das", "und"], "en": ["the", "and", "of", "to"], "es": ["que", "los", "las", "el"], "fr": ["le", "les", "des", "et"]}


def _vote() -> str:
    counts = ", ".join("len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{s}'" for s in stop) + f"))) AS {lang}" for lang, stop in _PROFILES.items())
    case = " ".join(f"WHEN {lang} = greatest(de, en, es, fr) AND {lang} > 0 THEN '{lang}'" for lang in _PROFILES)
    return f"""WITH c AS (SELECT doc_id, s, substring(text, CAST(s + 1 AS BIGINT), 1500) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1400)) AS s FROM documents WHERE length(text) > 0)),
v AS (SELECT doc_id, s, {counts} FROM (SELECT doc_id, s, string_split_regex(lower(chunk), '[^\\p{{L}}]+') AS w FROM c WHERE length(chunk) > 100)), l AS (SELECT doc_id, CASE {case} ELSE 'en' END AS lang FROM v),
z AS (SELECT doc_id, lang AS g, count(*) AS c FROM l GROUP BY ALL) SELECT d.doc_id, coalesce(arg_min(g, (-c, g)), 'en') AS language, CAST(coalesce(max(c), 0) AS BIGINT) AS votes FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id"""


@query(_vote())
def chunk_language_majority(spark, d):
    """The language of each chunk above a hundred characters, and the document's by majority; the default without any."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    chunks = T.fixed_windows(docs, "doc_id", "text").filter(F.length("chunk") > 100).withColumn("_id", F.struct("doc_id", "position"))
    votes = T.language_vote(chunks, "_id", "chunk", _PROFILES).select(F.col("_id.doc_id").alias("doc_id"), "language")
    best = S.majority(votes, ["doc_id"], "language")
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("majority", F.lit("en")).alias("language"), F.coalesce("votes", F.lit(0)).alias("votes"))


_TEXT = ORACLES_OF_TEXTS["clean_text_regex"]


@query(f"""WITH c AS ({_TEXT}), w AS (SELECT c.doc_id, d.lang, CAST(s // 1400 AS INT) AS position, substring(cleaned, CAST(s + 1 AS BIGINT), 1500) AS chunk FROM (SELECT doc_id, cleaned, unnest(generate_series(0, greatest(length(cleaned) - 1, 0), 1400)) AS s FROM c WHERE length(cleaned) > 0) c JOIN documents d ON c.doc_id = d.doc_id)
SELECT doc_id, position, lang, lang IN ('de', 'es', 'fr') AS translated, CAST(length(chunk) + CASE WHEN lang IN ('de', 'es', 'fr') THEN 4 ELSE 0 END AS INT) AS n FROM w""")
def document_chain(spark, d):
    """A document cleaned, cut to chunks, and those of other languages translated."""
    docs = load(spark, d, "documents")
    cleaned = docs.select("doc_id", "lang", X.squeeze_marks(X.clean_artifacts(F.col("text")), backreference=False).alias("text"))
    chunks = T.fixed_windows(cleaned, "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id")
    done = T.translate(chunks, "chunk", "lang", {k: (lambda texts: "[t] " + texts) for k in ("de", "es", "fr")})
    return done.select("doc_id", "position", "lang", "translated", F.length("chunk").alias("n"))


@query()
def snapped_chunks(spark, d):
    """T5: windows that end at a sentence or line end where there is one in their last fifth."""
    return T.snapped(load(spark, d, "documents"), "doc_id", "text")
