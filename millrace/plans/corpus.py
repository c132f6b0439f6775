"""Queries of sentence and language models, staged scoring, document caches and SQL table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import tables as U
from millrace.operators import econometrics as E
from millrace.operators import extract as L
from millrace.operators import forecast as Y
from millrace.operators import language as G
from millrace.operators import panel as P
from millrace.operators import text as T
from millrace.operators.heads import HeadStore
from millrace.plans.relational import NY, nation_years, registrar, rounded
from millrace.session import scratch, settled
from millrace.sources import cache_source as C
from millrace.sources.tables import load

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

# ---------------------------------------------------------------- sentences

_TOKENS = rf"""tok AS (SELECT doc_id, raw, i, core, lower(regexp_replace(core, '\.\z', '')) AS base FROM (SELECT doc_id, raw, i, regexp_replace(raw, '{G.AROUND.replace("'", "''")}', '', 'g') AS core FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM documents)))),
ctx AS (SELECT *, lag(core) OVER w AS before, lead(core) OVER w AS next, lead(base) OVER w AS next_base, core[1] = lower(core[1]) AS small FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
words AS (SELECT base, count(*) AS n, sum(suffix(core, '.')::INT) AS n_dot, sum(small::INT) AS n_lower, sum((NOT small AND before IS NOT NULL AND NOT regexp_matches(before, '[.!?]\z'))::INT) AS n_middle FROM ctx WHERE regexp_matches(base, '{G.WORD}') GROUP BY base),
weighed AS (SELECT base, 2 * (n_dot * ln({G.ALWAYS}) + (n - n_dot) * ln(1 - {G.ALWAYS}) - n_dot * ln(p + 1e-8) - (n - n_dot) * ln(1 - p + 1e-8)) * exp(-size) * (length(base) - size + 1) * pow(size::DOUBLE, -(n - n_dot)) AS score
  FROM (SELECT *, length(replace(base, '.', '')) AS size FROM words), (SELECT sum(n_dot) / sum(n) AS p FROM words) WHERE n_dot > 0), short AS (SELECT * FROM weighed WHERE score >= {G.LEAST_SCORE})"""


@query(f"WITH {_TOKENS} SELECT base, round(score, 6) AS score FROM short")
def learned_abbreviations(spark, d):
    """Words of the corpus whose periods belong to them."""
    return rounded(G.abbreviations(settled(G.word_statistics(load(spark, d, "documents"), "text"), "words")), "score")


@query(rf"""WITH {_TOKENS}, cut AS (SELECT doc_id, i, raw, coalesce(next IS NOT NULL AND regexp_matches(core, '[.!?]\z') AND (regexp_matches(core, '[!?]\z') OR (NOT regexp_matches(base, '^\p{{L}}\z') AND NOT (regexp_matches(base, '^[0-9]+\z') AND regexp_matches(next[1], '\p{{Ll}}'))
  AND (base NOT IN (SELECT base FROM short) OR (regexp_matches(next[1], '\p{{Lu}}') AND next_base IN (SELECT base FROM words WHERE n_lower > 0 AND n_middle = 0))))), false) AS ends FROM ctx),
grp AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM cut)
SELECT doc_id, CAST(position AS INT) AS position, string_agg(raw, ' ' ORDER BY i) AS sentence FROM grp GROUP BY doc_id, position""")
def learned_sentences(spark, d):
    """Sentences by the end marks and abbreviations that the corpus shows."""
    return G.split_sentences(load(spark, d, "documents"), "doc_id", "text")


# ---------------------------------------------------------------- languages

_BUCKET = f"(unicode(l[i]) * 961 + unicode(l[i + 1]) * 31 + unicode(l[i + 2])) % {G.BUCKETS}"
_MODELS = rf"""doc AS (SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL), cp AS (SELECT doc_id, lang, regexp_extract_all(text, '(?s).') AS l FROM doc), gram AS (SELECT lang, {_BUCKET} AS b FROM (SELECT lang, l, unnest(range(1, len(l) - 1)) AS i FROM cp WHERE lang IS NOT NULL)),
cnt AS (SELECT lang, b, count(*) AS n FROM gram GROUP BY ALL), tot AS (SELECT lang, sum(n) AS total FROM cnt GROUP BY lang), lg AS (SELECT lang, b, ln((n + {G.SMOOTH}) / (total + {G.SMOOTH} * {G.BUCKETS})) - ln({G.SMOOTH} / (total + {G.SMOOTH} * {G.BUCKETS})) AS more FROM cnt JOIN tot USING (lang)),
win AS (SELECT doc_id, CAST(s // 1400 AS INT) AS position, regexp_extract_all(substring(text, CAST(s + 1 AS BIGINT), 1500), '(?s).') AS l FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1400)) AS s FROM doc WHERE length(text) > 0)),
wg AS (SELECT doc_id, position, b, count(*) AS n FROM (SELECT doc_id, position, {_BUCKET} AS b FROM (SELECT doc_id, position, l, unnest(range(1, len(l) - 1)) AS i FROM win WHERE len(l) > 100)) GROUP BY ALL),
base AS (SELECT doc_id, position, lang, sum(n) AS m, sum(n) * any_value(ln({G.SMOOTH} / (total + {G.SMOOTH} * {G.BUCKETS}))) AS s FROM wg, tot GROUP BY ALL), extra AS (SELECT doc_id, position, lang, sum(n * more) AS s FROM wg JOIN lg USING (b) GROUP BY ALL),
sc AS (SELECT doc_id, position, lang, m, base.s + coalesce(extra.s, 0) AS s FROM base LEFT JOIN extra USING (doc_id, position, lang)),
best AS (SELECT doc_id, position, arg_min(lang, (-s, lang)) AS language, (max(s) - (list_reverse_sort(list(s)))[2]) / any_value(m) AS margin FROM sc GROUP BY ALL)"""


def _windows(spark, d):
    return T.fixed_windows(load(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_MODELS} SELECT doc_id, position, language, round(margin, 6) AS margin FROM best")
def chunk_language_scores(spark, d):
    """Each chunk's language under models of character trigrams, and its lead over the next."""
    models = G.learn_languages(load(spark, d, "documents"), "text", "lang")
    scored = G.language_scores(_windows(spark, d).filter(F.length("chunk") > 100), "chunk", models)
    return rounded(scored.select("doc_id", "position", "language", "margin"), "margin")


@query(f"WITH {_MODELS}, v AS (SELECT doc_id, language, count(*) AS n FROM best GROUP BY ALL), t AS (SELECT doc_id, arg_min(language, (-n, language)) AS language, max(n) AS votes, sum(n) AS n_chunks FROM v GROUP BY doc_id) SELECT d.doc_id, coalesce(language, 'en') AS language, CAST(coalesce(votes, 0) AS BIGINT) AS votes, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks FROM documents d LEFT JOIN t USING (doc_id)")
def language_model_vote(spark, d):
    """A document's language by the majority of its chunks."""
    docs = load(spark, d, "documents")
    return G.document_languages(docs, _windows(spark, d), "doc_id", "chunk", G.learn_languages(docs, "text", "lang"))


# ---------------------------------------------------------------- staged scoring

#: Rules that stand for the four models: a pattern for each label, in order, and what is left.
HEADS = {"specificity": ((r"[0-9]", "spec"), "non"), "sentiment": ((r"on", "opportunity"), (r"er", "risk"), "neutral"), "commitment": ((r"that|dass|que", "yes"), "no"), "netzero": ((r"th", "net-zero"), (r"en", "reduction"), "none")}


def _rule(head: str):
    *rules, rest = HEADS[head]

    def model(texts: pd.Series) -> pd.DataFrame:
        label = pd.Series(rest, index=texts.index)
        for pattern, name in reversed(rules):
            label = label.where(~texts.str.contains(pattern), name)
        return pd.DataFrame({"label": label, "score": texts.str.len() % 97 / 97})

    return model


def _case(head: str) -> str:
    *rules, rest = HEADS[head]
    return "CASE " + " ".join(f"WHEN regexp_matches(chunk, '{p}') THEN '{n}'" for p, n in rules) + f" ELSE '{rest}' END AS {head}_label, round(length(chunk) % 97 / 97.0, 6) AS {head}_score"


_STAGED = f"w AS (SELECT doc_id, CAST(s // 1400 AS INT) AS position, substring(text, CAST(s + 1 AS BIGINT), 1500) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1400)) AS s FROM documents WHERE length(text) > 0))"


def _scored(spark, d) -> tuple[HeadStore, int]:
    """All four heads, each run once more after all; the store and how many documents the second runs scored."""
    chunks = _windows(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", F.col("chunk").alias("text")))).alias("chunks"))
    store = HeadStore(spark, scratch(spark, "heads"), tuple(HEADS))
    store.create(chunks)
    for head in HEADS:
        store.run(head, _rule(head))
    return store, sum(store.run(head, _rule(head)) for head in HEADS)


@query(f"WITH {_STAGED} SELECT doc_id, position, {', '.join(map(_case, HEADS))}, true AS netzero_analyzed, CAST(0 AS INT) AS scored_again FROM w")
def staged_heads(spark, d):
    """Four heads one after the other, their fields in nested chunks; a second run of each finds nothing to do."""
    store, again = _scored(spark, d)
    rows = store.documents().select("doc_id", F.explode("chunks").alias("c"), "netzero_analyzed")
    rows = rows.select("doc_id", "c.position", *[f"c.{h}_{k}" for h in HEADS for k in ("label", "score")], "netzero_analyzed", F.lit(again).alias("scored_again"))
    return rounded(rows, *[f"{h}_score" for h in HEADS])


@query(f"WITH {_STAGED}, s AS (SELECT doc_id, {', '.join(map(_case, HEADS))} FROM w) SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (netzero_label = 'reduction') AS netzero_count, round(100.0 * count(*) FILTER (netzero_label = 'reduction') / count(*), 6) AS netzero_pct, count(*) FILTER (sentiment_label = 'risk' AND commitment_label = 'yes') AS n_risk_committed FROM s GROUP BY doc_id")
def staged_head_statistics(spark, d):
    """What the heads say of each document, from its nested chunks."""
    docs = _scored(spark, d)[0].documents()
    hits = lambda test: F.size(F.filter("chunks", test)).cast("long")
    reduction = hits(lambda c: c["netzero_label"] == "reduction")
    return rounded(docs.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), reduction.alias("netzero_count"), (100.0 * reduction / F.size("chunks")).alias("netzero_pct"), hits(lambda c: (c["sentiment_label"] == "risk") & (c["commitment_label"] == "yes")).alias("n_risk_committed")), "netzero_pct")


# ---------------------------------------------------------------- caches

_YEAR = "CASE WHEN lang = 'es' THEN NULL ELSE 2015 + CAST(substring(source, 4) AS INT) % 12 END"


@query(f"""WITH c AS (SELECT doc_id, source, lang, {_YEAR} AS year, text FROM documents) SELECT CAST(doc_id AS VARCHAR) AS pdf_path, source AS company, lang AS company_id, CAST(year AS INT) AS year, 'chunk_000' AS chunk_id, text, false AS broken FROM c WHERE year IS NULL OR year < 2022
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true FROM range(2)""")
def cached_documents(spark, d):
    """Documents written as JSON by year and read by the data source; two broken entries are rows of their own."""
    path = scratch(spark, "cache")
    year = F.when(~F.col("lang").eqNullSafe("es"), 2015 + F.substr("source", F.lit(4)).cast("int") % 12)
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pdf_path"), F.col("source").alias("company"), F.col("lang").alias("company_id"), year.alias("year"), F.array("text").alias("chunks"))
    docs.withColumn("cache_year", F.col("year")).write.option("ignoreNullFields", "false").partitionBy("cache_year").json(path)
    spark.createDataFrame([('{"pdf_path": "cut off',), ("[1]",)], "value string").coalesce(2).write.mode("append").text(path)
    found = C.scan_cache(spark, path, suffix="", before=2022)
    chunk = F.try_element_at("chunks", F.lit(1))
    return found.select("pdf_path", "company", "company_id", "year", chunk["chunk_id"].alias("chunk_id"), chunk["text"].alias("text"), F.col("_error").isNotNull().alias("broken"))


# ---------------------------------------------------------------- table functions


@query("SELECT doc_id, CAST(s // 1400 AS INT) AS position, substring(text, CAST(s + 1 AS BIGINT), 1500) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1400)) AS s FROM documents WHERE length(text) > 0)")
def lateral_chunks(spark, d):
    """T5, 2.19: a table function in SQL text, joined laterally."""
    U.register(spark)
    return spark.sql("SELECT d.doc_id, c.position, c.chunk FROM {documents} d, LATERAL chunks(d.text, 1500, 100) c", documents=load(spark, d, "documents"))


@query("SELECT source, arg_min(lang, (-n, lang)) AS commonest FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY source")
def commonest_language(spark, d):
    """A20, 2.19: an aggregate function over counted values, in SQL text."""
    U.register(spark)
    return spark.sql("SELECT source, heaviest(lang, n) AS commonest FROM (SELECT source, lang, count(*) AS n FROM {documents} WHERE lang IS NOT NULL GROUP BY source, lang) GROUP BY source", documents=load(spark, d, "documents"))


# ---------------------------------------------------------------- models compared, forecasts of fitted models


_ANSWERS = {"first": "string_split(text, chr(10))[1]", "last": "string_split(text, chr(10))[-1]", "longest": "list_sort(list_transform(string_split(text, chr(10)), lambda x: {'n': -length(x), 'x': x}))[1].x"}


@query("WITH a AS (SELECT conv_id, turn, " + ", ".join(f"{e} AS {n}" for n, e in _ANSWERS.items()) + " FROM conversations WHERE text IS NOT NULL), l AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS model, {n} AS answer FROM a" for n in _ANSWERS) + ") SELECT x.model AS a, y.model AS b, count(*) AS n_prompts, count(*) FILTER (x.answer = y.answer) AS n_equal, round(count(*) FILTER (x.answer = y.answer) / count(*), 6) AS agreement FROM l x JOIN l y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.model < y.model GROUP BY ALL")
def model_agreement(spark, d):
    """Several models over the same prompts, and how often each two of them say the same."""
    texts = load(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", "text", F.lit(0).alias("batch"), F.lit(1).alias("position"))
    models = {"first": lambda p: p.split("\n\n", 1)[1].split("\n")[0], "last": lambda p: p.split("\n\n", 1)[1].split("\n")[-1], "longest": lambda p: min(p.split("\n\n", 1)[1].split("\n"), key=lambda x: (-len(x), x))}
    return rounded(L.agreement(L.run_models(texts, ["conv_id", "turn"], "text", "List", models), ["conv_id", "turn"]), "agreement")


_FORECAST = f"""{NY}, m AS (SELECT avg(y) AS y, avg(n) AS n, avg(t) AS t FROM ny), g AS (SELECT sum((a.n - m.n) * (a.n - m.n)) AS xx, sum((a.n - m.n) * (a.t - m.t)) AS xz, sum((a.t - m.t) * (a.t - m.t)) AS zz, sum((a.n - m.n) * (a.y - m.y)) AS xy, sum((a.t - m.t) * (a.y - m.y)) AS zy FROM ny a, m),
f AS (SELECT (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bn, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bt FROM g), l AS (SELECT k, max(t) AS t0, arg_max(n, t) AS n FROM ny GROUP BY k), fut AS (SELECT k, n, unnest(generate_series(t0 + 1, 2004)) AS t FROM l),
s AS (SELECT k, t, 'bau' AS scenario, n * 1.0 AS n FROM fut UNION ALL SELECT k, t, 'tight', n * 0.8 FROM fut UNION ALL SELECT k, t, 'growth', n * CASE WHEN t < 2003 THEN 1.1 ELSE 1.3 END FROM fut)"""


@query(f"WITH {_FORECAST}, p AS (SELECT s.k, s.t, scenario, m.y + bn * (s.n - m.n) + bt * (s.t - m.t) AS v FROM s, f, m) SELECT k, CAST(t AS INT) AS t, " + ", ".join(f"round(max(v) FILTER (scenario = '{n}'), 5) AS {n}" for n in ("bau", "tight", "growth")) + " FROM p GROUP BY k, t")
def fitted_forecast(spark, d):
    """A regression fitted on the panel predicts each scenario of the future grid, side by side."""
    ny = nation_years(spark, d)
    fit = E.ols(ny, "y", ["n", "t"])
    rules = {"bau": {"n": F.lit(1.0)}, "tight": {"n": F.lit(0.8)}, "growth": {"n": F.when(F.col("t") < 2003, 1.1).otherwise(1.3)}}
    rows = Y.scenarios(P.future_grid(ny, "k", "t", 2004), rules).select("k", "t", "scenario", F.col("s_n").alias("n"))
    return rounded(Y.wide(E.predicted(rows, fit), ["k", "t"], "predicted", list(rules)), *rules, digits=5)


@query()
def mixed_model_terms(spark, d):
    """A random intercept for each entity beside two regressors."""
    m = E.mixed_model(nation_years(spark, d).withColumn("age", F.col("t") - 1995).withColumn("size", F.col("n") / 100), "y", ["age", "size"], "k")
    rows = [(t, float(v)) for t, v in m["coef"].items()] + [("var_residual", float(m["var_residual"])), ("var_entity", float(m["var_entity"]))]
    return spark.createDataFrame(rows, "term string, value double")
