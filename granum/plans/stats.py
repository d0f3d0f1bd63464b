"""Descriptive and inferential statistics, and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granum.functions.money import dsum
from granum.operators import statistics as S
from granum.operators import timeseries as T
from granum.operators.ranking import quantiles_by
from granum.plans.profile import _L, labelled
from granum.plans.registry import query
from granum.sources.tables import parquet


@query(
    "zscore_outliers",
    "SELECT doc_id, round((n_chars - m) / s, 4) AS z FROM documents, (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents) WHERE abs((n_chars - m) / s) > 3",
)
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents more than three sample deviations from the mean length."""
    df = parquet(spark, sf_dir, "documents").select("doc_id", "n_chars")
    stats = df.agg(F.avg("n_chars").alias("m"), F.stddev_samp("n_chars").alias("s"))
    z = (F.col("n_chars") - F.col("m")) / F.col("s")
    return df.join(F.broadcast(stats)).where(F.abs(z) > 3).select("doc_id", F.round(z, 4).alias("z"))


@query("histogram", "SELECT CAST(least(floor(l_quantity / 2.5), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity in twenty equal bins from 0 to 50, the last one closed."""
    b = F.least(F.width_bucket("l_quantity", F.lit(0.0), F.lit(50.0), F.lit(20)) - 1, F.lit(19)).cast("int")
    return parquet(spark, sf_dir, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


_Q = (0.0, 0.25, 0.5, 0.75, 1.0)


@query("monthly_box", "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS q{int(100 * p)}" for p in _Q) + " FROM orders GROUP BY 1")
def monthly_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-number summary by calendar month."""
    by = quantiles_by(parquet(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate")), ["month"], "o_totalprice", list(_Q))
    return by.select("month", *[F.round(F.col("q")[i], 4).alias(f"q{int(100 * p)}") for i, p in enumerate(_Q)])


_TTEST = f"""SELECT n1, n0, round(m1, 4) AS mean_1, round(m0, 4) AS mean_0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / CAST(n1 + n0 - 2 AS DOUBLE) * (1.0 / CAST(n1 AS DOUBLE) + 1.0 / CAST(n0 AS DOUBLE))), 6) AS t, n1 + n0 - 2 AS df
        FROM (SELECT count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0, avg(n_chars) FILTER (WHERE quality = 1) AS m1, avg(n_chars) FILTER (WHERE quality = 0) AS m0,
              var_samp(n_chars) FILTER (WHERE quality = 1) AS v1, var_samp(n_chars) FILTER (WHERE quality = 0) AS v0 FROM {_L})"""


@query("ttest_ind", _TTEST)
def ttest_ind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled t of length by quality."""
    return S.ttest(labelled(spark, sf_dir), F.col("n_chars"), F.col("quality") == 1)


def _t_tail(t: str, dof: str) -> str:
    """SQL for the two-sided tail of Student's t: Simpson's rule for the incomplete beta integral."""
    x = f"({dof} / ({dof} + ({t}) * ({t})))"
    f = f"2 * exp(lgamma({dof} / 2 + 0.5) - lgamma({dof} / 2) - lgamma(CAST(0.5 AS DOUBLE)) + ({dof} - 1) * ln(sin(asin(sqrt({x})) * i / 4000)))"
    inner = f"list_sum(list_transform(range(1, 4001), lambda i: (CASE WHEN i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}))"
    return f"least(1.0, greatest(0.0, asin(sqrt({x})) / 4000 / 3 * {inner}))"


@query("ttest_p_value", f"SELECT *, round({_t_tail('t', 'CAST(df AS DOUBLE)')}, 6) AS p FROM ({_TTEST})")
def ttest_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The t statistic with its two-sided p-value."""
    t = ttest_ind(spark, sf_dir)
    return t.withColumn("p", F.round(S.p_values("t", F.col("t"), F.col("df")), 6))


@query(
    "mean_ci",
    f"""WITH RECURSIVE o AS (SELECT count(n_chars) AS n, avg(n_chars) AS m, stddev_samp(n_chars) / sqrt(count(n_chars)) AS se FROM {_L}),
          b AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1000 AS DOUBLE) AS hi, CAST(n - 1 AS DOUBLE) AS dof FROM o
                UNION ALL SELECT step + 1, CASE WHEN 1 - p < 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN 1 - p < 0.95 THEN hi ELSE (lo + hi) / 2 END, dof
                FROM (SELECT *, {_t_tail('(lo + hi) / 2', 'dof')} AS p FROM b WHERE step < 60))
        SELECT n, round(m, 4) AS mean, round(se, 6) AS se, round(m - (lo + hi) / 2 * se, 4) AS low, round(m + (lo + hi) / 2 * se, 4) AS high FROM o, b WHERE step = 60""",
)
def mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of the mean length."""
    return S.mean_ci(labelled(spark, sf_dir), F.col("n_chars"))


_G = f"(SELECT lang, count(n_chars) AS n, avg(n_chars) AS m, coalesce(var_samp(n_chars), 0) AS v FROM {_L} WHERE lang IS NOT NULL GROUP BY 1)"


@query(
    "anova_oneway",
    f"SELECT k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within, round(((q - n * mm * mm) / (k - 1)) / (w / CAST(n - k AS DOUBLE)), 4) AS f FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, sum(n * m) / CAST(sum(n) AS DOUBLE) AS mm, sum(n * m * m) AS q, sum((n - 1) * v) AS w FROM {_G})",
)
def anova_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length by language."""
    return S.anova(labelled(spark, sf_dir), F.col("n_chars"), "lang")


@query(
    "tukey_pairs",
    f"WITH g AS {_G}, e AS (SELECT sum((n - 1) * v) / CAST(sum(n) - count(*) AS DOUBLE) AS mse FROM g) SELECT a.lang AS group_1, b.lang AS group_2, round(b.m - a.m, 4) AS diff, round(sqrt(mse / 2 * (1.0 / CAST(a.n AS DOUBLE) + 1.0 / CAST(b.n AS DOUBLE))), 4) AS se FROM g a JOIN g b ON a.lang < b.lang, e",
)
def tukey_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise differences of mean length by language."""
    return S.tukey_pairs(labelled(spark, sf_dir), F.col("n_chars"), "lang")


@query(
    "ols_fit",
    f"""SELECT 'quality' AS term, round(regr_slope(n_chars, quality), 4) AS coef, round(regr_r2(n_chars, quality), 6) AS r2 FROM {_L}
        UNION ALL SELECT 'const', round(regr_intercept(n_chars, quality), 4), round(regr_r2(n_chars, quality), 6) FROM {_L}""",
)
def ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length on quality by least squares."""
    return S.ols(labelled(spark, sf_dir), "n_chars", ["quality"]).select("term", "coef", "r2")


_S = "(SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, regr_sxx(y, x) AS xx, regr_sxx(y, z) AS zz, regr_sxy(z, x) AS xz, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy, regr_syy(y, x) AS yy FROM (SELECT CAST(n_chars AS DOUBLE) AS y, CAST(quality AS DOUBLE) AS x, CAST(toxic AS DOUBLE) AS z FROM {0}) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)"


@query(
    "ols_inference",
    f"""WITH s AS (SELECT *, xx * zz - xz * xz AS d FROM {_S.format(_L)}), b AS (SELECT *, (zz * xy - xz * zy) / d AS b1, (xx * zy - xz * xy) / d AS b2 FROM s),
          c AS (SELECT *, my - b1 * mx - b2 * mz AS b0, (yy - b1 * xy - b2 * zy) / CAST(n - 3 AS DOUBLE) AS v, 1 - (yy - b1 * xy - b2 * zy) / yy AS r FROM b),
          t AS (SELECT 'const' AS term, b0 AS coef, sqrt(v * (1.0 / CAST(n AS DOUBLE) + (mx * mx * zz - 2 * mx * mz * xz + mz * mz * xx) / d)) AS se, n, r FROM c UNION ALL SELECT 'quality', b1, sqrt(v * zz / d), n, r FROM c UNION ALL SELECT 'toxic', b2, sqrt(v * xx / d), n, r FROM c)
        SELECT term, round(coef, 4) AS coef, round(se, 4) AS std_err, round(coef / se, 3) AS t, round(r, 6) AS r2, round({_t_tail('(round(coef / se, 3))', 'CAST(n - 3 AS DOUBLE)')}, 6) AS p FROM t""",
)
def ols_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-regressor fit with standard errors and p-values."""
    df = labelled(spark, sf_dir)
    dof = df.agg((F.count("*") - 3).alias("d")).scalar()
    return S.ols(df, "n_chars", ["quality", "toxic"]).withColumn("p", F.round(S.p_values("t", F.col("t"), dof), 6))


@query("ols_summary")
def ols_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fit with intervals and the F test."""
    return S.ols_summary(labelled(spark, sf_dir), "n_chars", ["quality", "toxic"])


@query("tukey_hsd")
def tukey_hsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tukey's test of length between languages, with intervals."""
    return S.tukey_hsd(labelled(spark, sf_dir), F.col("n_chars"), "lang")


@query(
    "bayes_posterior",
    f"""SELECT round(p_a_b * p_b / p_a, 6) AS posterior, round(direct, 6) AS direct FROM (SELECT avg(CAST(toxic = 1 AS INTEGER)) FILTER (WHERE quality = 1) AS p_a_b, avg(CAST(quality = 1 AS INTEGER)) AS p_b, avg(CAST(toxic = 1 AS INTEGER)) AS p_a,
          avg(CAST(quality = 1 AS INTEGER)) FILTER (WHERE toxic = 1) AS direct FROM {_L})""",
)
def bayes_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior by Bayes' rule and by direct count."""
    t, q = (F.col("toxic") == 1).cast("int"), (F.col("quality") == 1).cast("int")
    post = F.avg(F.when(q == 1, t)) * F.avg(q) / F.avg(t)
    return labelled(spark, sf_dir).agg(F.round(post, 6).alias("posterior"), F.round(F.avg(F.when(t == 1, q)), 6).alias("direct"))


@query(
    "binomial_pmf",
    f"""WITH p AS (SELECT avg(CAST(quality = 1 AS INTEGER)) AS p FROM {_L}), c AS (SELECT k, CAST(factorial(10) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(10 - k AS INTEGER))) AS DOUBLE) AS c FROM (SELECT unnest(range(11)) AS k)), f AS (SELECT k, c * power(p, k) * power(1 - p, 10 - k) AS m FROM c, p)
        SELECT CAST(k AS INTEGER) AS k, round(m, 6) AS pmf, round(sum(m) OVER (ORDER BY k), 6) AS cdf FROM f""",
)
def binomial_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial probabilities of ten draws at the observed rate."""
    n = 10
    p = labelled(spark, sf_dir).agg(F.avg((F.col("quality") == 1).cast("int")).alias("p"))
    comb = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("k"), F.lit(1))), F.lit(1.0), lambda a, j: F.when(F.col("k") == 0, 1.0).otherwise(a * (n + 1 - j) / j))
    rows = p.select("p", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")).withColumn("m", comb * F.pow("p", "k") * F.pow(1 - F.col("p"), n - F.col("k")))
    return rows.select("k", F.round("m", 6).alias("pmf"), F.round(F.sum("m").over(Window.partitionBy("p").orderBy("k")), 6).alias("cdf"))


def _logit_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", "quality", "toxic", (F.col("n_chars") / 1000.0).alias("kilo"))


def _logit_sql(steps: int = 9) -> str:
    """Newton steps written out, each one aggregate and the inverse of a symmetric 3 x 3 matrix."""
    out = [f"d AS MATERIALIZED (SELECT CAST(quality AS DOUBLE) AS y, CAST(toxic AS DOUBLE) AS x, n_chars / 1000.0 AS z FROM {_L} WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL)", "w0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c)"]
    for k in range(steps):
        out.append(
            f"""h{k} AS MATERIALIZED (SELECT a, b, c, sum(q) AS m00, sum(q * x) AS m01, sum(q * z) AS m02, sum(q * x * x) AS m11, sum(q * x * z) AS m12, sum(q * z * z) AS m22, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum((y - p) * z) AS g2
               FROM (SELECT *, p * (1 - p) AS q FROM (SELECT *, 1 / (1 + exp(-(a + b * x + c * z))) AS p FROM d, w{k})) GROUP BY a, b, c)"""
        )
        out.append(
            f"""w{k + 1} AS (SELECT a + ((m11 * m22 - m12 * m12) * g0 + (m02 * m12 - m01 * m22) * g1 + (m01 * m12 - m02 * m11) * g2) / e AS a, b + ((m02 * m12 - m01 * m22) * g0 + (m00 * m22 - m02 * m02) * g1 + (m01 * m02 - m00 * m12) * g2) / e AS b,
               c + ((m01 * m12 - m02 * m11) * g0 + (m01 * m02 - m00 * m12) * g1 + (m00 * m11 - m01 * m01) * g2) / e AS c
               FROM (SELECT *, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS e FROM h{k}))"""
        )
    return "WITH " + ", ".join(out) + f", w AS (SELECT * FROM w{steps}) "


@query(
    "logit_odds",
    _logit_sql() + "SELECT 'const' AS term, round(a, 6) AS coef, round(exp(a), 6) AS odds_ratio FROM w UNION ALL SELECT 'toxic', round(b, 6), round(exp(b), 6) FROM w UNION ALL SELECT 'kilo', round(c, 6), round(exp(c), 6) FROM w",
)
def logit_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds ratios of quality by toxicity and length."""
    fit = S.logit(_logit_frame(spark, sf_dir), "quality", ["toxic", "kilo"])
    return fit.select("term", F.round("coef", 6).alias("coef"), F.round("odds_ratio", 6).alias("odds_ratio"))


@query("logit_summary")
def logit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fit with errors, intervals of the odds ratios and pseudo R-squared."""
    return S.logit_summary(_logit_frame(spark, sf_dir), "quality", ["toxic", "kilo"])


@query("logit_grid", _logit_sql() + "SELECT CAST(i % 2 AS INTEGER) AS toxic, CAST(i // 2 AS DOUBLE) AS kilo, round(1 / (1 + exp(-(a + b * (i % 2) + c * (i // 2)))), 6) AS p FROM w, (SELECT unnest(range(42)) AS i)")
def logit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted probability over a grid of length and toxicity."""
    w = {r["term"]: r["coef"] for r in S.logit(_logit_frame(spark, sf_dir), "quality", ["toxic", "kilo"]).collect()}
    grid = spark.range(42).select((F.col("id") % 2).cast("int").alias("toxic"), F.floor(F.col("id") / 2).cast("double").alias("kilo"))
    z = w["const"] + w["toxic"] * F.col("toxic") + w["kilo"] * F.col("kilo")
    return grid.withColumn("p", F.round(1 / (1 + F.exp(-z)), 6))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of mean and median length, 10,000 replicates."""
    return S.bootstrap_ci(parquet(spark, sf_dir, "documents"), "n_chars")


@query("bootstrap_stat")
def bootstrap_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of a statistic of the caller's: the trimmed mean of supplier balances."""
    return S.bootstrap(parquet(spark, sf_dir, "supplier"), "s_acctbal", S.weighted_trimmed_mean)


_M = "(SELECT strftime(o_orderdate, '%Y-%m') AS t, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders GROUP BY 1)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue as ``series, t, y``."""
    return parquet(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("t")).agg(dsum("o_totalprice").alias("y")).select(F.lit("orders").alias("series"), "t", "y")


@query(
    "yoy_growth",
    f"SELECT year, round(m, 0) AS mean_y, round(100 * (m / lag(m) OVER (ORDER BY year) - 1), 4) AS growth_pct FROM (SELECT CAST(substr(t, 1, 4) AS INTEGER) AS year, avg(y) AS m FROM {_M} GROUP BY 1)",
)
def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual mean and its growth."""
    by = monthly(spark, sf_dir).groupBy("series", F.substring("t", 1, 4).cast("int").alias("year")).agg(F.avg("y").alias("m"))
    w = Window.partitionBy("series").orderBy("year")
    return by.select("year", F.round("m", 0).alias("mean_y"), F.round(100 * (F.col("m") / F.lag("m").over(w) - 1), 4).alias("growth_pct"))


_TR = f"(SELECT t, y, l, ld, ld - lag(ld, 12) OVER (ORDER BY t) AS lds FROM (SELECT t, y, ln(y) AS l, ln(y) - lag(ln(y)) OVER (ORDER BY t) AS ld FROM {_M}))"


@query("ts_transform", f"SELECT t, round(l, 6) AS log_y, round(ld, 6) AS log_diff, round(lds, 6) AS log_diff_seasonal FROM {_TR}")
def ts_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log, difference and seasonal difference."""
    return T.transforms(monthly(spark, sf_dir)).select("t", *[F.round(c, 6).alias(c) for c in ("log_y", "log_diff", "log_diff_seasonal")])


@query(
    "seasonal_decompose",
    f"""WITH a AS (SELECT t, ln(y) AS y, (row_number() OVER (ORDER BY t) - 1) % 12 AS pos FROM {_M}),
             b AS (SELECT *, CASE WHEN count(y) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (sum(y) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * lag(y, 6) OVER (ORDER BY t) + 0.5 * lead(y, 6) OVER (ORDER BY t)) / 12 END AS tr FROM a),
             s AS (SELECT pos, avg(y - tr) AS s FROM b GROUP BY 1), c AS (SELECT pos, s - (SELECT avg(s) FROM s) AS s FROM s)
        SELECT t, round(tr, 6) AS trend, round(s, 6) AS seasonal, round(y - tr - s, 6) AS resid FROM b JOIN c USING (pos)""",
)
def seasonal_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive decomposition of the log series."""
    logs = monthly(spark, sf_dir).withColumn("y", F.log("y"))
    return T.decompose(logs).select("t", *[F.round(c, 6).alias(c) for c in ("trend", "seasonal", "resid")])


_ACF = f"WITH c AS (SELECT row_number() OVER (ORDER BY t) AS i, ld - avg(ld) OVER () AS c FROM {_TR} WHERE ld IS NOT NULL) SELECT CAST(b.i - a.i AS INTEGER) AS lag, round(sum(a.c * b.c) / (SELECT sum(c * c) FROM c), 4) AS acf FROM c a JOIN c b ON b.i - a.i BETWEEN 1 AND 24 GROUP BY 1"


@query("acf", _ACF)
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelations of the differenced log to lag 24."""
    return T.acf(T.transforms(monthly(spark, sf_dir)), "log_diff", 24).select("lag", "acf")


@query(
    "residual_diagnostics",
    f"""WITH d AS (SELECT t, ln(y) - lag(ln(y)) OVER (ORDER BY t) AS x FROM {_M}), e AS (SELECT x - avg(x) OVER () AS e, count(*) OVER () AS n, row_number() OVER (ORDER BY t) AS i FROM d WHERE x IS NOT NULL),
             r AS (SELECT k, a.n, sum(a.e * b.e) AS p FROM e a, e b, (SELECT unnest(range(1, 13)) AS k) WHERE a.i = b.i + k GROUP BY k, a.n),
             m AS (SELECT max(n) AS n, sum(e * e) AS v, sum(e * e * e) AS m3, sum(e * e * e * e) AS m4, sum(e * e) FILTER (WHERE i > n - round(n / CAST(3 AS DOUBLE))) AS b, sum(e * e) FILTER (WHERE i <= round(n / CAST(3 AS DOUBLE))) AS a FROM e),
             s AS (SELECT *, (m3 / n) / pow(v / n, 1.5) AS s, (m4 / n) / pow(v / n, 2) AS k FROM m)
        SELECT n, round(n * (n + 2) * (SELECT sum(pow(p / (SELECT v FROM m), 2) / (n - k)) FROM r), 4) AS portmanteau, round(n / CAST(6 AS DOUBLE) * (s * s + pow(k - 3, 2) / 4), 4) AS jarque_bera,
               round(s, 4) AS skewness, round(k, 4) AS kurtosis, round(b / a, 4) AS heteroskedasticity FROM s""",
)
def residual_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a random walk with drift leaves of the log series is uncorrelated, normal and even."""
    return T.diagnostics(T.transforms(monthly(spark, sf_dir)), "log_diff", 12).drop("series")


@query(
    "pacf",
    f"""WITH RECURSIVE r AS (SELECT list(acf ORDER BY lag) AS r FROM ({_ACF})), p AS (SELECT 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(0 AS DOUBLE) AS l
          UNION ALL SELECT k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - l * phi[k + 1 - j]), [l]), l
          FROM (SELECT k, phi, (r[k + 1] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j])), 0)) AS l FROM p, r WHERE k < 24))
        SELECT CAST(k AS INTEGER) AS lag, round(l, 4) AS pacf FROM p WHERE k > 0""",
)
def pacf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial autocorrelations to lag 24."""
    return T.pacf(T.transforms(monthly(spark, sf_dir)), "log_diff", 24).select("lag", "pacf")


_HOLD = f"(SELECT t, y, forecast FROM (SELECT t, y, lag(y, 12) OVER (ORDER BY t) AS forecast, row_number() OVER (ORDER BY t DESC) AS b FROM {_M}) WHERE b <= 12)"


@query("forecast_holdout", f"SELECT * FROM {_HOLD}")
def forecast_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last twelve months against the year before."""
    return T.seasonal_naive(monthly(spark, sf_dir)).select("t", "y", "forecast")


@query("forecast_metrics", f"SELECT round(avg(abs(y - forecast)), 4) AS mae, round(sqrt(avg((y - forecast) * (y - forecast))), 4) AS rmse, round(100 * avg(abs((y - forecast) / y)), 4) AS mape FROM {_HOLD}")
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the seasonal-naive forecast."""
    return T.errors(forecast_holdout(spark, sf_dir))


@query("adf_stat")
def adf_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dickey-Fuller statistic of the differenced log."""
    return T.adf(T.transforms(monthly(spark, sf_dir)), "log_diff")


@query("forecast_models")
def forecast_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the naive, (1,1,1) and seasonal models on the last twelve whole months."""
    m = monthly(spark, sf_dir)
    return T.holdout_scores(m.where(F.col("t") < m.agg(F.max("t")).scalar()))


@query("forecast_seasonal")
def forecast_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months ahead with bounds; the last month is incomplete and left out."""
    m = monthly(spark, sf_dir)
    return T.sarima_forecast(m.where(F.col("t") < m.agg(F.max("t")).scalar()))


@query("forecast_segments")
def forecast_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months ahead of the revenue of every market segment, fitted side by side."""
    orders = parquet(spark, sf_dir, "orders").join(parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series")), F.col("o_custkey") == F.col("c_custkey"))
    m = orders.groupBy("series", F.date_format("o_orderdate", "yyyy-MM").alias("t")).agg(dsum("o_totalprice").alias("y"))
    return T.sarima_forecast(m.where(F.col("t") < m.agg(F.max("t")).scalar()))
