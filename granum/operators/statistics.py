"""Inferential statistics from one-pass moments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granum.functions import special
from granum.operators.ranking import cut_points, part_of


def p_values(kind: str, *args: Column) -> Column:
    """Tail probabilities and quantiles of finished statistics.

    ``t`` (t, df), ``f`` (F, df1, df2), ``z`` (z), ``chi2`` (x, df), ``range`` (q, groups, df) and
    ``adf`` (statistic) give p-values; ``tq`` (level, df) and ``rangeq`` (level, groups, df) quantiles.
    """
    fn = {
        "t": special.t_two_sided, "f": special.f_upper, "z": special.normal_two_sided, "chi2": special.chi2_upper, "range": special.range_upper,
        "adf": special.adf_p, "tq": special.t_quantile, "rangeq": special.range_quantile,
    }[kind]

    @F.pandas_udf("double")
    def tail(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*cols, strict=True)], dtype="float64")

    return tail(*[a.cast("double") for a in args])


def ttest(df: DataFrame, x: Column, group: Column) -> DataFrame:
    """Pooled-variance two-sample t of the rows where ``group`` is true against false."""
    a, b = F.when(group, x), F.when(~group, x)
    one = df.agg(*[f(v).alias(n) for v, k in ((a, "1"), (b, "0")) for f, n in ((F.count, f"n{k}"), (F.avg, f"m{k}"), (F.var_samp, f"v{k}"))])
    n1, n0, dof = F.col("n1"), F.col("n0"), F.col("n1") + F.col("n0") - 2
    pooled = ((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / F.nullif(dof, F.lit(0))
    t = (F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(pooled * (1 / n1 + 1 / n0)), F.lit(0.0))
    return one.select("n1", "n0", F.round("m1", 4).alias("mean_1"), F.round("m0", 4).alias("mean_0"), F.round(t, 6).alias("t"), dof.alias("df"))


def mean_ci(df: DataFrame, x: Column, level: float = 0.95) -> DataFrame:
    """Mean, standard error and the t interval of the mean."""
    one = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"))
    half = p_values("tq", F.lit(level), F.col("n") - 1) * F.col("se")
    return one.select("n", F.round("m", 4).alias("mean"), F.round("se", 6).alias("se"), F.round(F.col("m") - half, 4).alias("low"), F.round(F.col("m") + half, 4).alias("high"))


def group_moments(df: DataFrame, x: Column, group: str) -> DataFrame:
    """``group, n, m, v`` of the non-null values; null groups are dropped."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))


def anova(df: DataFrame, x: Column, group: str) -> DataFrame:
    """One-way F from group moments."""
    g = group_moments(df, x, group)
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
    between = F.col("q") - F.col("n") * F.col("mm") * F.col("mm")
    f = (between / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return t.select((F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), F.round(f, 4).alias("f"))


def tukey_pairs(df: DataFrame, x: Column, group: str) -> DataFrame:
    """Mean differences of group pairs with the Tukey-Kramer standard error."""
    return _tukey(df, x, group).select("group_1", "group_2", F.round("diff", 4).alias("diff"), F.round("se", 4).alias("se"))


def _tukey(df: DataFrame, x: Column, group: str) -> DataFrame:
    g = group_moments(df, x, group)
    whole = g.agg((F.sum((F.col("n") - 1) * F.col("v")) / (F.sum("n") - F.count("*"))).alias("mse"), (F.sum("n") - F.count("*")).alias("df"), F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "n", "m"))).alias("r"))
    a = whole.select("r", "mse", "df", "k", F.posexplode("r").alias("i", "a")).select("a", "mse", "df", "k", F.explode(F.expr("slice(r, i + 2, size(r))")).alias("b"))
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    return a.select(F.col("a.g").alias("group_1"), F.col("b.g").alias("group_2"), (F.col("b.m") - F.col("a.m")).alias("diff"), se.alias("se"), "df", "k")


def tukey_hsd(df: DataFrame, x: Column, group: str, level: float = 0.95) -> DataFrame:
    """Tukey's test of each pair: ``group_1, group_2, diff, q, p, low, high, reject``."""
    t = _tukey(df, x, group).withColumn("q", F.abs("diff") / F.nullif(F.col("se"), F.lit(0.0)))
    t = t.withColumn("p", p_values("range", F.col("q"), F.col("k"), F.col("df"))).withColumn("half", p_values("rangeq", F.lit(level), F.col("k"), F.col("df")) * F.col("se"))
    return t.select("group_1", "group_2", F.round("diff", 4).alias("diff"), F.round("q", 4).alias("q"), F.round("p", 4).alias("p"), F.round(F.col("diff") - F.col("half"), 4).alias("low"), F.round(F.col("diff") + F.col("half"), 4).alias("high"), (F.col("p") < 1 - level).alias("reject"))


def _solved(names: list[str], a: np.ndarray, b: np.ndarray, yy: float, sy: float, n: float) -> dict:
    """Least squares from the normal equations."""
    inv = np.linalg.pinv(a)
    coef, k = inv @ b, len(names)
    rss, tss, dof = yy - coef @ b, yy - sy**2 / n, max(1, n - k)
    se = np.sqrt(np.maximum(rss / dof * np.diag(inv), 0))
    return {"coef": coef, "se": se, "rss": rss, "r2": 1 - rss / tss if tss else float("nan"), "dof": dof, "n": n, "t": coef / np.where(se > 0, se, np.nan)}


def _normal_equations(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    t = F.col(y).cast("double")
    full = df.where(F.expr(" and ".join(f"{c} is not null" for c in [y, *xs])))
    return full.agg(
        *[F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i], *[F.sum(c * t).alias(f"b{i}") for i, c in enumerate(cols)],
        F.sum(t * t).alias("yy"), F.sum(t).alias("sy"), F.count("*").alias("n"),
    )


def _fits(df: DataFrame, y: str, xs: list[str], rows: Callable[[dict], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of a least-squares fit; the moments come from one aggregate, the small system is solved once."""
    names = ["const", *xs]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = range(len(names))
        for f in frames:
            for _, r in f.iterrows():
                if r["n"] > 0:
                    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in k] for i in k], dtype=float)
                    yield rows(_solved(names, a, np.array([r[f"b{i}"] for i in k], dtype=float), r["yy"], r["sy"], r["n"]) | {"names": names})

    return _normal_equations(df, y, xs).mapInPandas(solve, schema)


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``term, coef, std_err, t, r2`` of least squares with an intercept."""
    rows = lambda f: pd.DataFrame({"term": f["names"], "coef": f["coef"].round(4), "std_err": f["se"].round(4), "t": f["t"].round(3), "r2": round(f["r2"], 6)})
    return _fits(df, y, xs, rows, "term string, coef double, std_err double, t double, r2 double")


def ols_summary(df: DataFrame, y: str, xs: list[str], level: float = 0.95) -> DataFrame:
    """``term, coef, std_err, t, p, low, high`` of each term, and the fit's ``r2, adj_r2, f, f_p, n``."""

    def rows(f: dict) -> pd.DataFrame:
        half = special.t_quantile(level, f["dof"]) * f["se"]
        k = len(f["names"]) - 1
        stat = (f["r2"] / k) / ((1 - f["r2"]) / f["dof"]) if k and f["r2"] < 1 else float("nan")
        return pd.DataFrame({
            "term": f["names"], "coef": f["coef"].round(4), "std_err": f["se"].round(4), "t": f["t"].round(3), "p": [round(special.t_two_sided(t, f["dof"]), 6) if t == t else None for t in f["t"]],
            "low": (f["coef"] - half).round(4), "high": (f["coef"] + half).round(4), "r2": round(f["r2"], 6), "adj_r2": round(1 - (1 - f["r2"]) * (f["n"] - 1) / f["dof"], 6),
            "f": round(stat, 4), "f_p": round(special.f_upper(stat, k, f["dof"]), 6) if stat == stat else None, "n": int(f["n"]),
        })

    return _fits(df, y, xs, rows, "term string, coef double, std_err double, t double, p double, low double, high double, r2 double, adj_r2 double, f double, f_p double, n long")


def _newton(df: DataFrame, y: str, xs: list[str], rounds: int = 25) -> dict:
    """An unregularised logistic fit; every step is one aggregate of the weighted normal equations."""
    names = ["const", *xs]
    full = df.where(F.expr(" and ".join(f"{c} is not null" for c in [y, *xs])))
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    t, k = F.col(y).cast("double"), len(names)
    w, out = np.zeros(k), {"names": names, "coef": np.zeros(k), "cov": np.full((k, k), np.nan), "ll": float("nan"), "null": float("nan"), "n": 0}
    for _ in range(rounds):
        z = sum((float(b) * c for b, c in zip(w, cols, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        got = full.agg(
            *[F.sum(p * (1 - p) * a * b).alias(f"h{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i],
            *[F.sum((t - p) * a).alias(f"g{i}") for i, a in enumerate(cols)], F.sum(t * z - F.when(z > 30, z).otherwise(F.log1p(F.exp(z)))).alias("ll"), F.avg(t).alias("m"), F.count("*").alias("n"),
        ).first().asDict()
        if not got["n"]:
            return out
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        inv, m = np.linalg.pinv(h), got["m"]
        step = inv @ np.array([got[f"g{i}"] for i in range(k)])
        out |= {"coef": w, "cov": inv, "ll": got["ll"], "n": got["n"], "null": got["n"] * (m * np.log(m) + (1 - m) * np.log(1 - m)) if 0 < m < 1 else 0.0}
        if np.abs(step).max() < 1e-10:
            break
        w = w + step
    return out | {"coef": w}


def logit(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``term, coef, odds_ratio`` of an unregularised logistic fit by Newton steps."""
    f = _newton(df, y, xs)
    return df.sparkSession.createDataFrame([(n, float(b), float(np.exp(b))) for n, b in zip(f["names"], f["coef"], strict=True)], "term string, coef double, odds_ratio double")


def logit_summary(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``term, coef, std_err, z, p, odds_ratio, low, high`` (the odds ratio's 95 % interval) and ``pseudo_r2, lr_p, n``."""
    f = _newton(df, y, xs)
    se = np.sqrt(np.diag(f["cov"]))
    ratio = float(1 - f["ll"] / f["null"]) if f["null"] else None
    lr = float(special.chi2_upper(2 * (f["ll"] - f["null"]), len(xs))) if f["null"] and xs else None
    rows = [
        (n, float(b), float(s), float(b / s) if s else None, float(special.normal_two_sided(b / s)) if s else None, float(np.exp(b)), float(np.exp(b - 1.959963985 * s)), float(np.exp(b + 1.959963985 * s)), ratio, lr, f["n"])
        for n, b, s in zip(f["names"], f["coef"], se, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, std_err double, z double, p double, odds_ratio double, low double, high double, pseudo_r2 double, lr_p double, n long")


Statistic = Callable[[np.ndarray, np.ndarray], float]


def weighted_mean(x: np.ndarray, w: np.ndarray) -> float:
    """The mean of values that occur ``w`` times."""
    return float((x * w).sum() / w.sum())


def weighted_quantile(x: np.ndarray, w: np.ndarray, q: float = 0.5) -> float:
    """The least value that at least a share ``q`` of the weight does not exceed; ``x`` ascends."""
    run = np.cumsum(w)
    return float(x[min(int(np.searchsorted(run, q * run[-1])), len(x) - 1)])


def weighted_trimmed_mean(x: np.ndarray, w: np.ndarray, share: float = 0.1) -> float:
    """The mean without the lowest and highest ``share`` of the weight, in whole rows; ``x`` ascends."""
    run = np.cumsum(w)
    cut = int(run[-1] * share)
    inside = np.clip(run, cut, run[-1] - cut)
    return weighted_mean(x, np.diff(inside, prepend=cut))


#: Replicates of a bag in one task, and the fewest a bag has.
DRAWS, FEWEST = 500, 100


def _dealt(value: float, n: int, bags: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """To which bags the ``n`` rows of a value go, and how many to each; the same wherever it is asked."""
    rng = np.random.default_rng([seed, int(np.float64(value).view(np.uint64))])
    if n < bags:
        return np.unique(rng.integers(0, bags, n), return_counts=True)
    each = rng.multinomial(n, np.full(bags, 1 / bags))
    return np.flatnonzero(each), each[each > 0]


def bootstrap(values: DataFrame, x: str, stat: Statistic, replicates: int = 10_000, level: float = 0.95, seed: int = 42, room: int = 262_144) -> DataFrame:
    """``estimate, low, high, bags`` of any statistic, by a bag of little bootstraps, for any number of rows.

    ``stat(values, weights)`` gets ascending values and how often each occurs (see
    :func:`weighted_mean`, :func:`weighted_quantile`, :func:`weighted_trimmed_mean`).  Rows
    are dealt to ``n / room`` bags; every row is in one bag, and a replicate of a bag draws as many rows as
    the table has, as multinomial weights on the bag's values.  Estimate and bounds are the
    means over bags.  Up to ``room`` rows there is one bag, and this is the plain bootstrap.
    Bags share ``replicates``, and each has ``FEWEST`` at least.

    A task holds the values of one bag: about ``room`` rows, fewer where values repeat, as
    only distinct values with their counts are dealt, each by a generator that it seeds.  So
    one value may hold most rows, and lost tasks and other partitions give the same result.
    Null and NaN take no part; without rows everything is null.
    """
    held = values.select(F.col(x).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counts = held.select((F.col("x") + 0.0).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    names = ["bag", "x", "n", "whole", "bags"]
    whole = counts.withColumn("whole", counts.agg(F.sum("n")).scalar())

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            held, rows = [], 0
            for value, n, total in zip(f["x"], f["n"], f["whole"], strict=True):
                bags = -(-int(total) // room)
                at, each = _dealt(value, int(n), bags, seed)
                held.append((at, np.full(len(at), value), each, np.full(len(at), total), np.full(len(at), bags)))
                rows += len(at)
                if rows > 100_000:
                    yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*held, strict=True), strict=True)})
                    held, rows = [], 0
            if held:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*held, strict=True), strict=True)})

    dealt = whole.mapInPandas(deal, "bag long, x double, n long, whole long, bags long")
    runs = F.greatest(F.lit(FEWEST), F.ceil(F.lit(replicates) / F.col("bags")))
    parts = dealt.withColumn("runs", runs.cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("runs") / DRAWS).cast("long") - 1)))

    def draw(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("x")
        own, n = f["x"].to_numpy(), f["n"].to_numpy()
        bag, part, total, last = (int(f[c].iloc[0]) for c in ("bag", "part", "whole", "runs"))
        share = n / n.sum()
        out = []
        for b in range(part * DRAWS, min((part + 1) * DRAWS, last)):
            w = np.random.default_rng([seed, bag, b]).multinomial(total, share)
            out.append(float(stat(own[w > 0], w[w > 0])))
        return pd.DataFrame({"bag": bag, "s": out, "point": float(stat(own, n))})

    draws = parts.groupBy("bag", "part").applyInPandas(draw, "bag long, s double, point double")
    tail = (1 - level) / 2
    by_bag = draws.groupBy("bag").agg(F.percentile("s", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.min("point").alias("point"))
    return by_bag.agg(F.avg("point").alias("estimate"), F.avg(F.col("q")[0]).alias("low"), F.avg(F.col("q")[1]).alias("high"), F.nullif(F.count("*"), F.lit(0)).alias("bags"))


def _weights(value: float, n: int, replicates: int, seed: int) -> np.ndarray:
    """How often each replicate draws a value that occurs ``n`` times; the same wherever it is asked."""
    return np.random.default_rng([seed, int(np.float64(value).view(np.uint64))]).poisson(n, replicates)


def bootstrap_ci(df: DataFrame, x: str, replicates: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile intervals of mean and median by the Poisson bootstrap, for any number of rows.

    A value that occurs ``n`` times is drawn Poisson(n) times in a replicate, by a generator
    that the value seeds, so draws do not depend on batches or partitions.  Distinct values
    are counted with map-side combine and dealt to ranges; each range gives the weight and
    sum it has in every replicate, and the range of a replicate's median is gone through once
    more.  The median is the value where half of the weight is reached.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"))
    order = [("x", False)]
    dealt = counts.withColumn("part", part_of(order, cut_points(counts, order, 64)))

    def totals(f: pd.DataFrame) -> pd.DataFrame:
        weight, total = np.zeros(replicates, dtype=np.int64), np.zeros(replicates)
        for value, n in zip(f["x"], f["n"], strict=True):
            w = _weights(value, int(n), replicates, seed)
            weight += w
            total += w * value
        return pd.DataFrame({"part": int(f["part"].iloc[0]), "b": np.arange(replicates), "w": weight, "s": total})

    sums = dealt.groupBy("part").applyInPandas(totals, "part int, b int, w long, s double")
    run = Window.partitionBy("b").orderBy("part")
    sums = sums.withColumn("done", F.sum("w").over(run) - F.col("w")).withColumn("whole", F.sum("w").over(Window.partitionBy("b")))
    means = sums.groupBy("b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    half = sums.where("done < whole / 2 and done + w >= whole / 2").groupBy("part").agg(F.collect_list(F.struct("b", "done", "whole")).alias("asked"))

    def medians(f: pd.DataFrame) -> pd.DataFrame:
        asked = f["asked"].iloc[0]
        b = np.array([a["b"] for a in asked], dtype=np.int64)
        done, goal = (np.array([a[k] for a in asked], dtype=np.float64) for k in ("done", "whole"))
        out = np.full(len(b), np.nan)
        for value, n in sorted(zip(f["x"], f["n"], strict=True)):
            done = done + _weights(value, int(n), replicates, seed)[b]
            out = np.where(np.isnan(out) & (done >= goal / 2), value, out)
        return pd.DataFrame({"b": b, "median": out})

    middle = dealt.join(half, "part").groupBy("part").applyInPandas(medians, "b int, median double")
    tail = (1 - level) / 2
    ends = lambda c: F.percentile(c, F.array(F.lit(tail), F.lit(1 - tail)))
    rows = means.agg(ends("mean").alias("q")).withColumn("statistic", F.lit("mean")).unionByName(middle.agg(ends("median").alias("q")).withColumn("statistic", F.lit("median")))
    return rows.select("statistic", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
