"""Time-series operators over regular series; series are small after aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from granum.functions import special


#: Series are partitioned by this column, so many of them run side by side.
def _w() -> WindowSpec:
    return Window.partitionBy("series").orderBy("t")


def transforms(df: DataFrame, y: str = "y", season: int = 12) -> DataFrame:
    """``df`` with log, first difference of the log, and its seasonal difference."""
    out = df.withColumn("log_y", F.log(y))
    out = out.withColumn("log_diff", F.col("log_y") - F.lag("log_y").over(_w()))
    return out.withColumn("log_diff_seasonal", F.col("log_diff") - F.lag("log_diff", season).over(_w()))


def trend(y: str, season: int = 12) -> Column:
    """Centred 2 x season moving average; null at both ends."""
    half = season // 2
    whole = F.count(y).over(_w().rowsBetween(-half, half)) == season + 1
    inner = F.sum(y).over(_w().rowsBetween(1 - half, half - 1))
    return F.when(whole, (inner + 0.5 * F.lag(y, half).over(_w()) + 0.5 * F.lead(y, half).over(_w())) / season)


def decompose(df: DataFrame, y: str = "y", season: int = 12) -> DataFrame:
    """Additive decomposition: ``trend, seasonal, resid``; seasonal means are centred."""
    with_trend = df.withColumn("trend", trend(y, season)).withColumn("pos", (F.row_number().over(_w()) - 1) % season)
    means = with_trend.groupBy("series", "pos").agg(F.avg(F.col(y) - F.col("trend")).alias("s"))
    centred = means.withColumn("seasonal", F.col("s") - F.avg("s").over(Window.partitionBy("series"))).drop("s")
    out = with_trend.join(F.broadcast(centred) if season <= 366 else centred, ["series", "pos"])
    return out.withColumn("resid", F.col(y) - F.col("trend") - F.col("seasonal"))


def acf(df: DataFrame, y: str, lags: int) -> DataFrame:
    """``series, lag, acf`` up to ``lags``, by shifted products over the total sum of squares."""
    centred = df.where(F.col(y).isNotNull()).withColumn("_c", F.col(y) - F.avg(y).over(Window.partitionBy("series")))
    shifted = centred.select("series", "_c", *[F.lag("_c", k).over(_w()).alias(f"_l{k}") for k in range(1, lags + 1)])
    one = shifted.groupBy("series").agg(F.sum(F.col("_c") * F.col("_c")).alias("ss"), *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"p{k}") for k in range(1, lags + 1)])
    return one.select("series", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.round(F.col(f"p{k}") / F.nullif(F.col("ss"), F.lit(0.0)), 4).alias("acf")) for k in range(1, lags + 1)])))


def diagnostics(df: DataFrame, y: str, lags: int = 12) -> DataFrame:
    """``series, n, portmanteau, jarque_bera, skewness, kurtosis, heteroskedasticity`` of residuals, centred.

    The portmanteau statistic (Ljung-Box, chi-squared with ``lags`` degrees of freedom under
    no autocorrelation) sums squared autocorrelations, Jarque-Bera's asks for normal third and
    fourth moments, and the last one divides the squares of the last third of a series by
    those of the first.  All are sums over each series; null residuals take no part, and a
    statistic of a series without variance is null.
    """
    own = Window.partitionBy("series")
    held = df.where(F.col(y).isNotNull()).withColumn("_e", F.col(y) - F.avg(y).over(own)).withColumn("_n", F.count("*").over(own)).withColumn("_i", F.row_number().over(_w()))
    shifted = held.select("series", "_e", "_n", "_i", *[F.lag("_e", k).over(_w()).alias(f"_l{k}") for k in range(1, lags + 1)])
    third = F.round(F.col("_n") / 3).cast("int")
    power = lambda k: F.sum(F.pow("_e", F.lit(float(k)))).alias(f"m{k}")
    one = shifted.groupBy("series").agg(
        F.count("*").alias("n"), power(2), power(3), power(4), *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"p{k}") for k in range(1, lags + 1)],
        F.sum(F.when(F.col("_i") <= third, F.col("_e") * F.col("_e"))).alias("early"), F.sum(F.when(F.col("_i") > F.col("_n") - third, F.col("_e") * F.col("_e"))).alias("final"),
    )
    n, var = F.col("n"), F.nullif(F.col("m2"), F.lit(0.0))
    squares = sum((F.pow(F.coalesce(F.col(f"p{k}"), F.lit(0.0)) / var, F.lit(2.0)) / F.nullif(n - k, F.lit(0)) for k in range(2, lags + 1)), F.pow(F.col("p1") / var, F.lit(2.0)) / F.nullif(n - 1, F.lit(0)))
    skew, kurt = (F.col("m3") / n) / F.pow(var / n, F.lit(1.5)), (F.col("m4") / n) / F.pow(var / n, F.lit(2.0))
    return one.select(
        "series", "n", F.round(n * (n + 2) * squares, 4).alias("portmanteau"), F.round(n / 6 * (skew * skew + F.pow(kurt - 3, F.lit(2.0)) / 4), 4).alias("jarque_bera"),
        F.round(skew, 4).alias("skewness"), F.round(kurt, 4).alias("kurtosis"), F.round(F.col("final") / F.nullif(F.col("early"), F.lit(0.0)), 4).alias("heteroskedasticity"),
    )


def pacf(df: DataFrame, y: str, lags: int) -> DataFrame:
    """``series, lag, pacf`` by the Durbin-Levinson recursion on the autocorrelations."""

    def recurse(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.concatenate(([1.0], frame.sort_values("lag")["acf"].to_numpy(dtype=float)))
        phi, out = np.zeros(0), []
        for k in range(1, len(r)):
            den = 1.0 - phi @ r[1:k]
            last = (r[k] - phi @ r[1:k][::-1]) / den if den else 0.0
            phi = np.concatenate((phi - last * phi[::-1], [last]))
            out.append((frame["series"].iloc[0], k, round(float(last), 4)))
        return pd.DataFrame(out, columns=["series", "lag", "pacf"])

    return acf(df, y, lags).groupBy("series").applyInPandas(recurse, "series string, lag int, pacf double")


def seasonal_naive(df: DataFrame, y: str = "y", season: int = 12) -> DataFrame:
    """The last ``season`` points of each series with the value a season before as forecast."""
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("t")))
    return df.withColumn("forecast", F.lag(y, season).over(_w())).withColumn("_b", back).where(F.col("_b") <= season).drop("_b")


def errors(df: DataFrame, y: str = "y", forecast: str = "forecast") -> DataFrame:
    """MAE, RMSE and MAPE of a forecast."""
    e = F.col(y) - F.col(forecast)
    return df.agg(F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(100 * F.avg(F.abs(e / F.nullif(F.col(y), F.lit(0.0)))), 4).alias("mape"))


def adf(df: DataFrame, y: str) -> DataFrame:
    """``series, stat, lags, n, p`` of the augmented Dickey-Fuller regression, lag chosen by AIC."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("t")[y].dropna().to_numpy(dtype=float)
        name = frame["series"].iloc[0]
        top = min(int(np.ceil(12 * (len(x) / 100) ** 0.25)), len(x) // 2 - 3)
        if top < 0:
            return pd.DataFrame([(name, None, 0, len(x), None)], columns=["series", "stat", "lags", "n", "p"])
        d = np.diff(x)

        def ols(k: int, skip: int) -> tuple[float, float, int]:
            target = d[skip:]
            cols = [x[skip:-1], np.ones(len(target)), *[d[skip - j : len(d) - j] for j in range(1, k + 1)]]
            a = np.column_stack(cols)
            coef, *_ = np.linalg.lstsq(a, target, rcond=None)
            rss = float(((target - a @ coef) ** 2).sum())
            dof = max(1, len(target) - a.shape[1])
            se = np.sqrt(max(rss / dof * np.linalg.pinv(a.T @ a)[0, 0], 1e-300))
            return float(coef[0] / se), len(target) * np.log(max(rss, 1e-300) / len(target)) + 2 * a.shape[1], len(target)

        best = min(range(top + 1), key=lambda k: ols(k, top)[1])
        stat, _, n = ols(best, best)
        return pd.DataFrame([(name, round(stat, 6), best, n, round(special.adf_p(stat), 6))], columns=["series", "stat", "lags", "n", "p"])

    return df.groupBy("series").applyInPandas(fit, "series string, stat double, lags int, n long, p double")


#: Prior variance, in innovations, of states that nothing is known of.
DIFFUSE = 1e9
#: A filter whose gain moves by less than this keeps it.
SETTLED = 1e-13


@dataclass(frozen=True)
class Space:
    """A model in state space: ``y = see @ state``, then ``state = move @ state + shock * innovation``.

    The states are the last points that differencing needs and those of the moving average;
    ``prior`` is the variance of the first ones, and that many points (``unknown``) are
    spent on finding those of which nothing is known.
    """

    see: np.ndarray
    move: np.ndarray
    shock: np.ndarray
    prior: np.ndarray
    unknown: int


def _space(p: np.ndarray, season: int) -> Space:
    """The (1,1,1) or, with a season, (1,1,1)(1,1,1) model of parameters ``p``.

    Without a season the differenced series starts from its stationary distribution, whose
    parameters are held inside (-1, 1); with one, nothing is known of its start and nothing
    asked of its parameters.
    """
    ar, ma, lags = np.array([1.0, -p[0]]), np.array([1.0, p[1]]), np.array([1.0, -1.0])
    if season:
        gap = np.zeros(season - 1)
        ar, ma, lags = np.convolve(ar, [1.0, *gap, -p[2]]), np.convolve(ma, [1.0, *gap, p[3]]), np.convolve(lags, [1.0, *gap, -1.0])
    past, own = len(lags) - 1, max(len(ar) - 1, len(ma))
    see = np.concatenate((-lags[1:], [1.0], np.zeros(own - 1)))
    move, shock = np.zeros((past + own, past + own)), np.zeros(past + own)
    move[0] = see
    move[np.arange(1, past), np.arange(past - 1)] = 1.0
    inner = np.eye(own, k=1)
    inner[: len(ar) - 1, 0] = -ar[1:]
    move[past:, past:] = inner
    shock[past : past + len(ma)] = ma
    prior = DIFFUSE * np.eye(past + own)
    if not season:
        prior[past:, past:] = np.linalg.solve(np.eye(own * own) - np.kron(inner, inner), np.outer(shock[past:], shock[past:]).ravel()).reshape(own, own)
    return Space(see, move, shock, prior, past + own if season else past)


def kalman(m: Space, z: np.ndarray, ahead: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """The negative log likelihood of ``z``, and its forecasts ``ahead`` with their deviations.

    Linear in the length; missing points (NaN) are stepped over.  The variance of the
    innovations is worked out of the likelihood.
    """
    state, var, gain, scale = np.zeros(len(m.see)), m.prior, None, 0.0
    noise = np.outer(m.shock, m.shock)
    seen, squares, logs, same = 0, 0.0, 0.0, False
    for y in z:
        if not np.isfinite(y):
            state, var, same = m.move @ state, m.move @ var @ m.move.T + noise, False
            continue
        if not same:
            at = var @ m.see
            last, scale, gain = gain, float(m.see @ at), m.move @ at
            if not scale > 0:
                return np.inf, np.zeros(ahead), np.zeros(ahead)
            gain = gain / scale
            new = m.move @ var @ m.move.T + noise - scale * np.outer(gain, gain)
            same = seen > m.unknown and last is not None and np.abs(gain - last).max() < SETTLED
            var = (new + new.T) / 2
        off = y - m.see @ state
        state = m.move @ state + gain * off
        seen += 1
        if seen > m.unknown:
            squares, logs = squares + off * off / scale, logs + np.log(scale)
    n = max(seen - m.unknown, 1)
    level = max(squares, 1e-300) / n
    path, spread = np.zeros(ahead), np.zeros(ahead)
    for k in range(ahead):
        path[k], spread[k] = m.see @ state, np.sqrt(level * max(float(m.see @ var @ m.see), 0.0))
        state, var = m.move @ state, m.move @ var @ m.move.T + noise
    loss = (n * np.log(level) + logs) / 2
    return loss if np.isfinite(loss) else np.inf, path, spread


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, size: float = 0.4, rounds: int = 300, close: float = 1e-9) -> np.ndarray:
    """A point of least ``f`` by the downhill simplex method."""
    points = [start, *(start + size * np.eye(len(start)))]
    held = sorted(((f(x), i, x) for i, x in enumerate(points)), key=lambda h: h[:2])
    n = len(points)
    for _ in range(rounds):
        if held[-1][0] - held[0][0] < close:
            break
        centre = np.mean([h[2] for h in held[:-1]], axis=0)
        away = centre - held[-1][2]
        tried = {a: f(centre + a * away) for a in (1.0,)}
        if tried[1.0] < held[0][0]:
            tried[2.0] = f(centre + 2 * away)
        elif tried[1.0] >= held[-2][0]:
            tried[-0.5] = f(centre - 0.5 * away)
        a = min(tried, key=tried.get)
        if tried[a] < held[-1][0] and (a != 1.0 or tried[a] < held[-2][0] or -0.5 in tried):
            held[-1] = (tried[a], n, centre + a * away)
            n += 1
        else:
            low = held[0][2]
            held[1:] = [(f(low + (x - low) / 2), i, low + (x - low) / 2) for _, i, x in held[1:]]
        held.sort(key=lambda h: h[:2])
    return held[0][2]


def arima_path(z: np.ndarray, season: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast and deviation, on the scale of ``z``, of (1,1,1) or, with a season, (1,1,1)(1,1,1).

    Parameters have the greatest Gaussian likelihood, by the filter of :func:`kalman`, at any
    length.  Points may be missing (NaN).
    """
    base = z[np.isfinite(z)][0]
    held = (lambda p: p) if season else np.tanh
    with np.errstate(over="ignore", invalid="ignore"):
        best = simplex(lambda p: kalman(_space(held(p), season), z - base)[0], np.array([0.1, -0.3, 0.05, -0.3] if season else [0.1, -0.3]))
        _, path, sd = kalman(_space(held(best), season), z - base, ahead)
    return base + path, sd


#: Points that a series must have beyond those that the start of its model takes.
SPARE = 10


def arima_forecast(df: DataFrame, y: str = "y", season: int = 12, ahead: int = 12) -> DataFrame:
    """``series, step, forecast, low, high`` of a model on logs; ``season`` 0 leaves the seasonal part out.

    Series are fitted side by side (see :func:`arima_path`), each in time linear in its
    length; bounds are those of the filter.  A null value is a gap.  Series of fewer known
    points than the model's unknown states and ten more give no rows.
    """
    least = (_space(np.zeros(4), season).unknown if season else 1) + SPARE

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        s = frame.sort_values("t")[y].to_numpy(dtype=float)
        if np.isfinite(s).sum() < least:
            return pd.DataFrame(columns=["series", "step", "forecast", "low", "high"])
        path, sd = arima_path(np.log(np.maximum(s, 1e-12)), season, ahead)
        return pd.DataFrame({"series": frame["series"].iloc[0], "step": np.arange(1, ahead + 1), "forecast": np.exp(path), "low": np.exp(path - 1.96 * sd), "high": np.exp(path + 1.96 * sd)})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is kept: few rows are much work here
    return df.repartition(parts, "series").groupBy("series").applyInPandas(fit, "series string, step int, forecast double, low double, high double")


def sarima_forecast(df: DataFrame, y: str = "y", season: int = 12, ahead: int = 12) -> DataFrame:
    """The seasonal model's forecast."""
    return arima_forecast(df, y, season, ahead)


def holdout_scores(df: DataFrame, y: str = "y", season: int = 12, hold: int = 12) -> DataFrame:
    """``model, mae, rmse, mape`` of the seasonal-naive, (1,1,1) and seasonal forecasts of the last ``hold`` points.

    Models see only what comes before; both scores and forecasts are of the plain scale.
    """
    numbered = df.withColumn("_b", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("t"))))
    known, asked = numbered.where(F.col("_b") > hold).drop("_b"), numbered.where(F.col("_b") <= hold).select("series", F.col(y).alias("y"), (F.lit(hold + 1) - F.col("_b")).cast("int").alias("step"))
    runs = {"naive": seasonal_naive(df, y, season).where("forecast is not null")}
    for name, s in (("arima", 0), ("sarima", season)):
        runs[name] = asked.join(arima_forecast(known, y, s, hold), ["series", "step"])
    out = None
    for name, run in runs.items():
        one = errors(run).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out
