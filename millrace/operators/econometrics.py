"""Regression, panel models and tests; sums in Spark, small matrices on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else math.nan


def f_p(f: float, a: float, b: float) -> float:
    """Upper p-value of Fisher's F."""
    return beta_share(b / 2, a / 2, b / (b + a * f)) if b > 0 and f >= 0 else math.nan


@dataclass
class Fit:
    """Coefficients and quality of one regression."""

    terms: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int
    dof: float
    ssr: float
    r2: float
    cov: np.ndarray

    def tidy(self, spark, model: str = "ols") -> DataFrame:
        """A row a term: model, term, coef, se, t, p."""
        t = self.coef / np.where(self.se > 0, self.se, np.nan)
        rows = [(model, n, float(c), float(s), float(x), t_p(float(x), self.dof)) for n, c, s, x in zip(self.terms, self.coef, self.se, t)]
        return spark.createDataFrame(rows, "model string, term string, coef double, se double, t double, p double")

    @property
    def loglik(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi) + math.log(max(self.ssr, 1e-300) / self.n) + 1)

    def aic(self) -> float:
        return 2 * len(self.terms) - 2 * self.loglik

    def bic(self) -> float:
        return len(self.terms) * math.log(self.n) - 2 * self.loglik


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Row count and cross products of all pairs of columns: one pass, k * k numbers come back."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return row["n"], g


def _solve(terms: list[str], n: int, g: np.ndarray, used: float, syy_centred: float | None = None) -> Fit:
    """Least squares from the cross products of (terms..., y); ``used`` is the number of parameters."""
    xx, xy, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    ssr = max(float(yy - beta @ xy), 0.0)
    dof = n - used
    cov = inverse * (ssr / dof if dof > 0 else math.nan)
    total = yy if syy_centred is None else syy_centred
    return Fit(terms, beta, np.sqrt(np.clip(np.diag(cov), 0, None)), n, dof, ssr, 1 - ssr / total if total else math.nan, cov)


def ols(df: DataFrame, y: str, xs: list[str], constant: bool = True) -> Fit:
    """Ordinary least squares over rows without missing values."""
    rows = df.select(y, *xs).dropna().withColumn("_one", F.lit(1.0))
    terms = (["_one"] if constant else []) + xs
    n, g = gram(rows, terms + [y])
    centred = g[-1, -1] - g[0, -1] ** 2 / n if constant and n else None
    fit = _solve(terms, n, g, len(terms), centred)
    fit.terms = ["const" if t == "_one" else t for t in fit.terms]
    return fit


def predicted(df: DataFrame, fit: Fit) -> DataFrame:
    """``df`` with what a fit with a constant, or without, expects of each row; null where a term is missing."""
    value = sum((F.col(t).cast("double") * float(b) if t != "const" else F.lit(float(b)) for t, b in zip(fit.terms, fit.coef)), F.lit(0.0))
    return df.withColumn("predicted", value)


def demeaned(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Columns as differences from their group's mean; means are summed before they are joined."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = df.join(means, group)
    return joined.select(*[c for c in df.columns if c not in columns], *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])


#: Periods that two-way effects hold as indicators, at most.
MOST_PERIODS = 200


def _score_products(rows: DataFrame, keys: list[str], columns: list[str]) -> np.ndarray:
    """Cross products of score sums over the groups of ``keys``; of single rows without keys."""
    summed = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns]) if keys else rows
    return gram(summed, columns)[1]


def panel_ols(df: DataFrame, y: str, xs: list[str], entity: str, time: str, effects: str = "entity", cluster: str | tuple[str, str] | None = None, least: int = 3, robust: bool = False, debiased: bool = False) -> Fit:
    """Entity, time, two-way or pooled effects; classical, robust or clustered covariance.

    Entities below ``least`` rows are left out; terms without variation within groups are dropped.
    The clustered covariance sums scores per cluster in Spark; only k * k sums reach the driver. A pair of cluster columns adds
    the products of both clusterings and takes off those of their intersection, negative variances count as 0; ``robust`` is
    the same with every row a cluster. ``debiased`` scales both by n / (n - parameters), where effects whose groups are a cluster do not count.
    """
    clusters = () if cluster is None else (cluster,) if isinstance(cluster, str) else tuple(cluster)
    rows = df.select(*dict.fromkeys((entity, time, y, *xs, *clusters))).dropna()
    good = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(entity)
    rows = rows.join(good, entity, "left_semi")
    named = [c for c in clusters if c in (y, *xs)]  # a regressor may be a cluster as well
    rows = rows.select(*dict.fromkeys((entity, time, *(c for c in clusters if c not in named))), *[F.col(c).alias(f"_key_{c}") for c in named], *[F.col(c).cast("double").alias(c) for c in (y, *xs)])
    clusters = tuple(f"_key_{c}" if c in named else c for c in clusters)
    size = rows.agg(F.countDistinct(entity).alias("e"), F.countDistinct(time).alias("t")).first()
    extra: list[str] = []
    if effects == "pooled":
        within = rows.withColumn("_one", F.lit(1.0))
    elif effects == "twoway":  # exact on unbalanced panels too: periods as indicators, entities by differences
        periods = [p[0] for p in rows.select(time).distinct().orderBy(time).limit(MOST_PERIODS + 1).collect()][1:]
        if len(periods) >= MOST_PERIODS:
            raise ValueError(f"more than {MOST_PERIODS} periods")
        extra = [f"_t{k}" for k in range(len(periods))]
        within = demeaned(rows.select("*", *[(F.col(time) == p).cast("double").alias(c) for c, p in zip(extra, periods)]), [y, *xs, *extra], entity)
    else:
        within = demeaned(rows, [y, *xs], {"entity": entity, "time": time}[effects])
    within = within.persist()
    terms = (["_one"] if effects == "pooled" else []) + xs
    n, g = gram(within, terms + extra + [y])
    if extra:  # the periods are taken out of the sums
        at, own = np.arange(len(terms), len(terms) + len(extra)), [*range(len(terms)), len(g) - 1]
        shift = np.linalg.pinv(g[np.ix_(at, at)]) @ g[np.ix_(at, own)]
        if clusters or robust:
            within = within.select("*", *[(F.col(c) - sum((F.col(t) * float(b) for t, b in zip(extra, shift[:, k])), F.lit(0.0))).alias(f"_r{k}") for k, c in enumerate([*terms, y])]).drop(*terms, y)
            within = within.withColumnsRenamed({f"_r{k}": c for k, c in enumerate([*terms, y])})
        g = g[np.ix_(own, own)] - g[np.ix_(own, at)] @ shift
    keep = [k for k in range(len(terms)) if g[k, k] > 1e-10 * max(n, 1)]
    index = [*keep, len(terms)]
    absorbed = {"entity": size["e"], "time": size["t"], "twoway": size["e"] + size["t"] - 1, "pooled": 0}[effects]
    fit = _solve([terms[k] for k in keep], n, g[np.ix_(index, index)], len(keep) + absorbed)
    if clusters or robust:
        residual = F.col(y) - sum((F.col(t) * float(b) for t, b in zip(fit.terms, fit.coef)), F.lit(0.0))
        names = [f"s{k}" for k in range(len(fit.terms))]
        scores = within.withColumn("_u", residual).select(*clusters, *[(F.col(t) * F.col("_u")).alias(s) for t, s in zip(fit.terms, names)])
        meat = sum(_score_products(scores, [c], names) for c in clusters) if clusters else _score_products(scores, [], names)
        if len(clusters) == 2:
            meat = meat - _score_products(scores, list(clusters), names)
        bread = np.linalg.pinv(g[np.ix_(keep, keep)])
        counted = 0 if effects in ("entity", "time") and {"entity": entity, "time": time}[effects] in clusters else absorbed
        fit.cov = bread @ meat @ bread * (n / (n - len(keep) - counted) if debiased else 1.0)
        fit.se = np.sqrt(np.clip(np.diag(fit.cov), 0, None))
    within.unpersist()
    return fit


def random_effects(df: DataFrame, y: str, xs: list[str], entity: str) -> dict:
    """Random entity effects by feasible generalised least squares.

    The variance of errors is from the within fit, that of entities from the fit of their means; each
    entity is then quasi-demeaned by its own share. One table of means, k * k sums to the driver.
    """
    rows = df.select(entity, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    names = [y, *xs]
    means = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_t"), *[F.avg(c).alias(f"_m_{c}") for c in names]).persist()
    joined = rows.join(means, entity)
    n, inner = gram(joined.select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in names]), xs + [y])
    m, outer = gram(means.select(F.lit(1.0).alias("_one"), *[F.col(f"_m_{c}").alias(c) for c in names]), ["_one", *xs, y])
    even = means.agg((F.count(F.lit(1)) / F.sum(1.0 / F.col("_t"))).alias("h")).first()["h"]
    within, between = _solve(xs, n, inner, len(xs) + m), _solve(["const", *xs], m, outer, len(xs) + 1)
    var_e = within.ssr / max(n - m - len(xs), 1)
    var_u = max(0.0, between.ssr / max(m - len(xs) - 1, 1) - var_e / even)
    share = 1.0 - F.sqrt(F.lit(var_e) / (F.lit(var_e) + F.lit(var_u) * F.col("_t"))) if var_e > 0 else F.lit(1.0)
    moved = joined.select((1.0 - share).alias("_one"), *[(F.col(c) - share * F.col(f"_m_{c}")).alias(c) for c in names])
    _, g = gram(moved, ["_one", *xs, y])
    fit = _solve(["const", *xs], n, g, len(xs) + 1)
    means.unpersist()
    return {"coef": dict(zip(fit.terms, fit.coef.tolist())), "var_error": var_e, "var_entity": var_u}


def compared(fits: dict[str, "Fit"], spark) -> DataFrame:
    """The coefficients of several fits beside each other, a row a term."""
    terms = sorted({t for f in fits.values() for t in f.terms})
    rows = [(t, *[float(dict(zip(f.terms, f.coef)).get(t, math.nan)) for f in fits.values()]) for t in terms]
    return spark.createDataFrame(rows, "term string, " + ", ".join(f"`{n}` double" for n in fits))


def did_controlled(df: DataFrame, y: str, treated: str, time: str, controls: list[str], entity: str, years: list[int]) -> DataFrame:
    """E5: the effect on the treated for each possible start, with controls and entity effects; its p-value and fit.

    All starts are columns of one within-transformed table, so one pass of sums serves them all.
    """
    base = df.select(entity, *[F.col(c).cast("double").alias(c) for c in (y, *controls)], F.col(treated).alias("_d"), F.col(time).alias("_w")).dropna()
    for k in years:
        base = base.withColumn(f"_p{k}", (F.col("_w") >= k).cast("double")).withColumn(f"_e{k}", F.col(f"_p{k}") * F.col("_d"))
    columns = [y, *controls, *[f"_{s}{k}" for k in years for s in "ep"]]
    within = demeaned(base.select(entity, *columns), columns, entity)
    entities = base.select(entity).distinct().count()
    total = base.agg(F.var_pop(y) * F.count(y)).first()[0] or math.nan
    n, g = gram(within, columns)
    at, out = {c: i for i, c in enumerate(columns)}, []
    for k in years:
        index = [at[c] for c in (f"_e{k}", f"_p{k}", *controls, y)]
        fit = _solve([f"_e{k}", f"_p{k}", *controls], n, g[np.ix_(index, index)], 2 + len(controls) + entities, total)
        t = fit.coef[0] / fit.se[0] if fit.se[0] > 0 else math.nan
        out.append((k, float(fit.coef[0]), t_p(float(t), fit.dof), float(fit.r2)))
    return df.sparkSession.createDataFrame(out, "start int, coef double, p double, r2 double")


def best_start(grid: DataFrame, most_p: float = 0.1) -> DataFrame:
    """The best start by significance and size, by the most negative effect below ``most_p``, and by fit."""
    score = -F.log("p") * F.abs("coef")
    tie = -F.col("start")
    return grid.agg(F.max_by("start", F.struct(score, tie)).alias("by_significance"), F.min_by("start", F.when(F.col("p") < most_p, F.struct("coef", "start"))).alias("by_effect"), F.max_by("start", F.struct("r2", tie)).alias("by_fit"))


def one_split(df: DataFrame, y: str, flags: dict) -> DataFrame:
    """A tree of depth one: the indicator whose two means leave the least squared error, those means, and its share explained.

    One pass of sums for all indicators.
    """
    v, sums = F.col(y).cast("double"), [F.count(y).alias("n"), F.sum(y).cast("double").alias("s"), F.sum(F.col(y) * F.col(y)).cast("double").alias("q")]
    for k, (name, test) in enumerate(flags.items()):
        sums += [F.count(F.when(test, v)).alias(f"n{k}"), F.sum(F.when(test, v)).alias(f"s{k}")]
    one, total = df.agg(*sums), F.col("q") - F.col("s") * F.col("s") / F.col("n")
    c = F.col
    rows = [F.struct((c("q") - c(f"s{k}") * c(f"s{k}") / c(f"n{k}") - (c("s") - c(f"s{k}")) * (c("s") - c(f"s{k}")) / (c("n") - c(f"n{k}"))).alias("sse"), F.lit(name).alias("split"), (c(f"s{k}") / c(f"n{k}")).alias("mean_true"), ((c("s") - c(f"s{k}")) / (c("n") - c(f"n{k}"))).alias("mean_false")) for k, name in enumerate(flags)]
    best = one.select(total.alias("_all"), F.array_min(F.filter(F.array(*rows), lambda x: x["sse"].isNotNull())).alias("_b"))
    return best.select("_b.split", "_b.mean_true", "_b.mean_false", (1.0 - c("_b.sse") / c("_all")).alias("r2"))


def did(df: DataFrame, y: str, treated: str, post: str) -> DataFrame:
    """E5: cell means and the difference in differences of the 2 x 2 design."""
    cell = lambda t, p: F.avg(F.when((F.col(treated) == t) & (F.col(post) == p), F.col(y)))
    means = df.agg(cell(1, 1).alias("t_post"), cell(1, 0).alias("t_pre"), cell(0, 1).alias("c_post"), cell(0, 0).alias("c_pre"))
    return means.withColumn("did", (F.col("t_post") - F.col("t_pre")) - (F.col("c_post") - F.col("c_pre")))


def did_grid(df: DataFrame, y: str, treated: str, time: str, years: list[int]) -> DataFrame:
    """The estimate for each possible start, all from one pass."""
    cell = lambda t, after, k: F.avg(F.when((F.col(treated) == t) & ((F.col(time) >= k) if after else (F.col(time) < k)), F.col(y)))
    one = df.agg(*[((cell(1, True, k) - cell(1, False, k)) - (cell(0, True, k) - cell(0, False, k))).alias(str(k)) for k in years])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("start"), F.col(str(k)).alias("did")) for k in years])))


def t_test(df: DataFrame, group: str, y: str, a, b) -> DataFrame:
    """Pooled two-sample t statistic."""
    v = lambda f, g: f(F.when(F.col(group) == g, F.col(y)))
    s = df.agg(v(F.count, a).alias("n1"), v(F.count, b).alias("n2"), v(F.avg, a).alias("m1"), v(F.avg, b).alias("m2"), v(F.var_samp, a).alias("v1"), v(F.var_samp, b).alias("v2"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return s.select("n1", "n2", "m1", "m2", ((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1.0 / F.col("n1") + 1.0 / F.col("n2")))).alias("t"))


def group_mean_fit(df: DataFrame, group: str, y: str) -> DataFrame:
    """Fit of the group-mean model: R2, MAE, RMSE. Means are joined, not windowed."""
    means = df.groupBy(group).agg(F.avg(y).alias("_m"))
    top = df.agg(F.avg(y).alias("_all"))
    rows = df.join(means, group).join(F.broadcast(top))  # one row
    e = F.col(y) - F.col("_m")
    return rows.agg((1.0 - F.sum(e * e) / F.sum((F.col(y) - F.col("_all")) * (F.col(y) - F.col("_all")))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def granger(df: DataFrame, y: str, x: str, entity: str, time: str, n: int = 2) -> dict:
    """Y on n lags of y and x without constant; the joint F test of x's lags, and a Wald test that allows for dependence within entities."""
    w = Window.partitionBy(entity).orderBy(time)
    lag = df.select(F.col(entity).alias("_e"), F.col(y).alias("_y"), *[F.lag(c, k).over(w).alias(f"{s}{k}") for c, s in ((y, "y"), (x, "x")) for k in range(1, n + 1)]).dropna()
    own, other = [f"y{k}" for k in range(1, n + 1)], [f"x{k}" for k in range(1, n + 1)]
    m, g = gram(lag, own + other + ["_y"])
    full = _solve(own + other, m, g, 2 * n)
    cut = [*range(n), 2 * n]
    small = _solve(own, m, g[np.ix_(cut, cut)], n)
    f = ((small.ssr - full.ssr) / n) / (full.ssr / (m - 2 * n)) if m > 2 * n and full.ssr > 0 else math.nan
    terms = own + other
    residual = F.col("_y") - sum((F.col(t) * float(b) for t, b in zip(terms, full.coef)), F.lit(0.0))
    scores = lag.withColumn("_u", residual).groupBy("_e").agg(*[F.sum(F.col(t) * F.col("_u")).alias(f"s{k}") for k, t in enumerate(terms)])
    entities, meat = gram(scores, [f"s{k}" for k in range(2 * n)])
    bread = np.linalg.pinv(g[:-1, :-1])
    cov = (bread @ meat @ bread)[n:, n:]
    wald = float(full.coef[n:] @ np.linalg.pinv(cov) @ full.coef[n:]) / n
    return {"n": m, "f": f, "p": f_p(f, n, m - 2 * n), "wald": wald, "p_wald": f_p(wald, n, entities - 1), "coef": dict(zip(terms, full.coef.tolist()))}


def vif(df: DataFrame, xs: list[str]) -> DataFrame:
    """Variance inflation without intercept, missing as 0: diagonal of inverse Gram times Gram."""
    _, g = gram(df.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in xs]), xs)
    v = np.diag(np.linalg.pinv(g)) * np.diag(g)
    return df.sparkSession.createDataFrame([(c, float(x), "high" if x >= 10 else "ok") for c, x in zip(xs, v)], "feature string, vif double, status string")


def subset_search(df: DataFrame, y: str, xs: list[str], sort_by: str = "bic", most: int = 4096, entity: str | None = None) -> DataFrame:
    """All subsets of terms from one pass of sums, ranked by a criterion; with ``entity`` under entity effects."""
    rows = df.select(*([entity] if entity else []), *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    if entity:  # differences plus the overall mean, so that the constant stays a term
        means = rows.agg(*[F.avg(c).alias(c) for c in (y, *xs)]).first()
        rows = demeaned(rows, [y, *xs], entity).select(*[(F.col(c) + F.lit(float(means[c] or 0.0))).alias(c) for c in (y, *xs)])
    rows = rows.withColumn("_one", F.lit(1.0))
    terms = ["_one", *xs]
    n, g = gram(rows, terms + [y])
    centred = g[-1, -1] - g[0, -1] ** 2 / n
    out = []
    for size in range(1, len(xs) + 1):
        for chosen in combinations(range(1, len(terms)), size):
            if len(out) >= most:
                break
            index = [0, *chosen, len(terms)]
            fit = _solve([terms[k] for k in index[:-1]], n, g[np.ix_(index, index)], len(index) - 1, centred)
            out.append((",".join(terms[k] for k in chosen), len(chosen), n, float(fit.r2), float(fit.aic()), float(fit.bic())))
    table = df.sparkSession.createDataFrame(out, "terms string, k int, n long, r2 double, aic double, bic double")
    return table.orderBy(F.desc(sort_by) if sort_by == "r2" else F.asc(sort_by), "terms")


def mixed_model(df: DataFrame, y: str, xs: list[str], entity: str, reml: bool = True) -> dict:
    """A random intercept per entity and any number of regressors, by (restricted) maximum likelihood.

    All that the likelihood needs are the cross products of all rows, and for each group size those of
    the entities' sums: one pass over the rows, no job for a step of the search. ``var_entity`` and ``var_residual``
    are the variances; the driver holds a small matrix for each size that occurs.
    """
    names = ["_one", *xs, y]
    rows = df.select(entity, *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna().withColumn("_one", F.lit(1.0))
    total, g = gram(rows, names)
    sums = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in names])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    by_size = sums.groupBy("_n").agg(F.count(F.lit(1)).alias("_m"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs]).collect()
    outer = np.zeros((len(by_size), len(names), len(names)))
    for k, r in enumerate(by_size):
        for i, j in pairs:
            outer[k, i, j] = outer[k, j, i] = r[f"h{i}_{j}"]
    size, many = np.array([r["_n"] for r in by_size], float), np.array([r["_m"] for r in by_size], float)
    used = total - (len(xs) + 1 if reml else 0)

    def solved(ratio: float) -> tuple[float, np.ndarray, float]:
        a = g - np.tensordot(ratio / (1 + ratio * size), outer, 1)
        beta = np.linalg.pinv(a[:-1, :-1]) @ a[:-1, -1]
        var = max(float(a[-1, -1] - beta @ a[:-1, -1]) / used, 1e-300)
        loss = used * math.log(var) + float(many @ np.log1p(ratio * size)) + (np.linalg.slogdet(a[:-1, :-1])[1] if reml else 0.0)
        return loss, beta, var

    low, high, golden = -18.0, 12.0, (math.sqrt(5) - 1) / 2  # of the logarithm of the variances' ratio
    while high - low > 1e-9:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if solved(math.exp(a))[0] < solved(math.exp(b))[0] else (a, high)
    ratio = math.exp((low + high) / 2)
    ratio = ratio if solved(ratio)[0] < solved(0.0)[0] else 0.0
    _, beta, var = solved(ratio)
    return {"coef": dict(zip(["const", *xs], beta.tolist())), "var_residual": var, "var_entity": ratio * var}


def random_intercept(df: DataFrame, y: str, x: str, entity: str) -> dict:
    """E2 with one regressor: const, slope and both variances."""
    m = mixed_model(df, y, [x], entity)
    return {"const": m["coef"]["const"], "slope": m["coef"][x], "var_residual": m["var_residual"], "var_entity": m["var_entity"]}
