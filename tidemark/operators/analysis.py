"""Profiles and diagnostics over labels, scores and fills."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import exp, lgamma, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import correlation
from .ranking import positions, quantiles, running
from .validation import ranked, spearman


def ecdf(rows: DataFrame, train: DataFrame, value: str, by: Sequence[str] = (), name: str = "ecdf") -> DataFrame:
    """Share of the training values at or below each row's: an as-of join on the values' running counts."""
    from .asof import asof

    counts = train.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = running(counts, {"_k": F.col("_c")}, value, by, block=None if not by else F.lit(0)).select(*by, F.col(value).alias("_v"), "_k")
    n = train.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    hit = asof(rows, counts, value, "_v", ["_k"], by, block=10)
    hit = hit.join(n, list(by), "left") if by else hit.crossJoin(F.broadcast(n))
    return hit.withColumn(name, F.coalesce("_k", F.lit(0)) / F.col("_n")).drop("_k", "_n")


def relative_rank(df: DataFrame, value: str, by: Sequence[str], name: str = "relative_rank") -> DataFrame:
    """(less + (equal + 1) / 2) / (n + 1)."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked(df, value, by, "_r")
    rows = rows.join(n, list(by)) if by else rows.crossJoin(F.broadcast(n))
    return rows.withColumn(name, F.col("_r") / (F.col("_n") + 1)).drop("_r", "_n")


def top_k_like(df: DataFrame, accepted: str, score: str, tie: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """In each stratum the rows of greatest score, as many as another rule accepted there."""
    k = df.groupBy(*strata).agg(F.count_if(F.col(accepted)).alias("_k"))
    order = Window.partitionBy(*strata).orderBy(F.desc(score), *tie)
    return df.withColumn("_n", F.row_number().over(order)).join(k, list(strata)).where("_n <= _k").drop("_n", "_k")


def peak(df: DataFrame, at: str, value: str, by: Sequence[str]) -> DataFrame:
    """Where the absolute value is greatest (the least place of equal ones)."""
    return df.groupBy(*by).agg(F.min_by(F.struct(at, value), F.struct(-F.abs(F.col(value)), at)).alias("p")).select(*by, f"p.{at}", f"p.{value}")


def correlations(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float]:
    """Pairwise Pearson over rows where both are there, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[f"c{i}"] for i, p in enumerate(pairs)}


def orthogonal(df: DataFrame, columns: Sequence[str], first: str, limit: float) -> list[str]:
    """Greedy: next the column whose greatest absolute correlation with the chosen ones is least, while it is under the limit."""
    c = correlations(df, columns)
    corr = lambda a, b: abs(c.get((a, b), c.get((b, a))) or 0.0)
    chosen, rest = [first], [x for x in columns if x != first]
    while rest:
        worst = {x: max(corr(x, y) for y in chosen) for x in rest}
        best = min(rest, key=lambda x: (worst[x], x))
        if worst[best] > limit:
            break
        chosen.append(best)
        rest.remove(best)
    return chosen


def joint_threshold(scores: DataFrame, p_long: str, p_short: str, rate: float, steps: int = 30) -> tuple[float, float]:
    """Quantile thresholds of both sides so that a share ``rate`` of rows signals: bisection on the common quantile.

    Quantiles on a fixed grid and the counts come from one pass each; the grid is the only thing on the driver.
    """
    grid = [i / 1000 for i in range(1001)]
    a, b = quantiles(scores, p_long, grid), quantiles(scores, p_short, grid)
    low, high = 0, 1000
    for _ in range(steps):
        if high - low <= 1:
            break
        mid = (low + high) // 2
        share = scores.agg(F.avg(F.when((F.col(p_long) >= a[mid]) | (F.col(p_short) >= b[mid]), 1.0).otherwise(0.0))).first()[0]
        low, high = (mid, high) if share > rate else (low, mid)
    return a[high], b[high]


def plateaus(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """Levels of a calibrated score: how many, and the share of the largest."""
    levels = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"))
    return levels.groupBy(*by).agg(F.count(F.lit(1)).alias("levels"), F.sum("_n").alias("n"), (F.max("_n") / F.sum("_n")).alias("largest_share"))


def stability(df: DataFrame, feature: str, target: str, period: str, by: Sequence[str] = ()) -> DataFrame:
    """Information coefficient of each period: the greatest over the median size, and the share with the sign of the mean."""
    ic = spearman(df, feature, target, [*by, period]).where("ic is not null")
    mean = ic.groupBy(*by).agg(F.avg("ic").alias("_m"))
    ic = ic.join(mean, list(by)) if by else ic.crossJoin(F.broadcast(mean))
    size = F.abs("ic")
    return ic.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), F.avg("ic").alias("mean_ic"), F.try_divide(F.max(size), F.median(size)).alias("max_over_median"), F.avg(F.when(F.signum("ic") == F.signum("_m"), 1.0).otherwise(0.0)).alias("same_sign"))


def return_statistics(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], lags: int) -> DataFrame:
    """Moments, Jarque-Bera and Ljung-Box of a series."""
    w = Window.partitionBy(*by).orderBy(*order)
    m = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess_kurtosis"))
    d = df.join(m, list(by)).withColumn("_d", F.col(x) - F.col("_m"))
    d = d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    rho = [(F.sum(F.col("_d") * F.col(f"_l{k}")) / F.sum(F.col("_d") * F.col("_d"))).alias(f"r{k}") for k in range(1, lags + 1)]
    a = d.groupBy(*by).agg(*rho)
    both = m.join(a, list(by))
    box = sum((F.col(f"r{k}") * F.col(f"r{k}") / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("excess_kurtosis") * F.col("excess_kurtosis") / 4)
    return both.select(*by, "n", "sd", "skew", "excess_kurtosis", jb.alias("jarque_bera"), (F.col("n") * (F.col("n") + 2) * box).alias("ljung_box"), "r1")


def dickey_fuller(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """n, slope and t of the regression of a step on the level before it (with a constant): far below 0 speaks against a unit root."""
    before = F.lag(x).over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("_b", before.cast("double")).withColumn("_s", F.col(x) - F.col("_b")).where("_s is not null")
    m = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx("_s", "_b").alias("_xx"), F.regr_sxy("_s", "_b").alias("_xy"), F.regr_syy("_s", "_b").alias("_yy"))
    slope = F.try_divide(F.col("_xy"), F.col("_xx"))
    error = F.try_divide(F.col("_yy") - slope * F.col("_xy"), F.col("n") - 2)
    return m.select(*by, "n", slope.alias("slope"), F.when((F.col("n") > 2) & (error > 0), slope / F.sqrt(error / F.col("_xx"))).alias("df_t"))


def compare_bars(frames: dict[str, DataFrame], lags: int = 5, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("close_time", "open_time")) -> DataFrame:
    """A row for each kind of bars and symbol: number, moments, Jarque-Bera and Ljung-Box of log returns, Dickey-Fuller t of the log close."""
    parts = []
    for name, bars in frames.items():
        w = Window.partitionBy(*by).orderBy(*order)
        level = bars.where(F.col("close") > 0).select(*by, *order, F.log("close").alias("_level"))
        level = level.withColumn("_r", F.col("_level") - F.lag("_level").over(w))
        stats = return_statistics(level, "_r", by, order, lags)
        root = dickey_fuller(level, "_level", by, order).select(*by, "df_t")
        parts.append(stats.join(root, list(by)).select(F.lit(name).alias("bars"), *by, "n", "sd", "skew", "excess_kurtosis", "jarque_bera", "ljung_box", "df_t"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def required_lift(p_tp: Column, breakeven: Column) -> Column:
    return F.when(p_tp > 0, breakeven / p_tp)


def lift_error(p_tp: Column, n: Column, breakeven: Column) -> Column:
    """Standard error of the lift by the delta method."""
    return F.when((p_tp > 0) & (n > 0), breakeven / (p_tp * p_tp) * F.sqrt(p_tp * (1 - p_tp) / n))


def one_sided_gate(mean: float, sd: float, n: int, least: float, level: float = 0.05) -> bool:
    """Whether a mean is above ``least``, by Student's t with n - 1 degrees of freedom."""
    return n >= 2 and sd > 0 and t_tail((mean - least) / (sd / sqrt(n)), n - 1) < level


def t_quantile(p: float, df: float) -> float:
    """Of Student's t, by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_tail(mid, df) < p else (low, mid)
    return (low + high) / 2


def welch_interval(a: tuple[float, float, int], b: tuple[float, float, int], level: float = 0.95) -> tuple[float, float, float]:
    """Difference of two means (mean, sd, n), and its interval by Welch's degrees of freedom; nothing with fewer than two values."""
    (ma, sa, na), (mb, sb, nb) = a, b
    if min(na, nb) < 2:
        return ma - mb, float("nan"), float("nan")
    va, vb = sa * sa / na, sb * sb / nb
    if va + vb == 0:
        return ma - mb, ma - mb, ma - mb
    df = (va + vb) ** 2 / (va * va / (na - 1) + vb * vb / (nb - 1))
    half = t_quantile(0.5 + level / 2, df) * sqrt(va + vb)
    return ma - mb, ma - mb - half, ma - mb + half


def path_majority(paths: DataFrame, statistic: str, least: float, by: Sequence[str] = ()) -> DataFrame:
    """n_paths, above and majority: whether more than half of the backtest paths lie above ``least`` (a null path does not)."""
    out = paths.groupBy(*by).agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(F.col(statistic) > least).alias("above"))
    return out.withColumn("majority", 2 * F.col("above") > F.col("n_paths"))


def fold_gate(values: Sequence[float], least: float, folds: int, level: float = 0.05) -> dict:
    """A mean over folds against ``least``: at least so many folds, and a one-sided t test."""
    n = len(values)
    mean = sum(values) / n if n else float("nan")
    sd = sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) if n > 1 else 0.0
    p = t_tail((mean - least) / (sd / sqrt(n)), n - 1) if n > 1 and sd > 0 else 1.0
    return {"n": n, "mean": mean, "sd": sd, "p": p, "passes": n >= folds and p < level}


def t_tail(t: float, df: float) -> float:
    """Chance that Student's t exceeds t: half the regularised incomplete beta at df / (df + t^2), by its continued fraction."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised; Lentz's method on whichever side converges."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def tau_sweep(df: DataFrame, score: str, taus: Sequence[float], time: str, by: Sequence[str]) -> DataFrame:
    """Signals a year for each threshold of a small grid, and by path the greatest over the least."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    years = (F.max(time) - F.min(time)) / (365.25 * 86_400_000)
    per = df.select(*by, time, score, grid).groupBy(*by, "tau").agg((F.count_if(F.col(score) >= F.col("tau")) / years).alias("signals_a_year"))
    return per.groupBy("tau").agg(F.avg("signals_a_year").alias("mean_signals"), F.try_divide(F.max("signals_a_year"), F.min("signals_a_year")).alias("dispersion"))


def gate_efficiency(df: DataFrame, kept: str, outcome: str, bucket: str) -> DataFrame:
    """By bucket: rows, those removed, and the share of each outcome that was removed."""
    gone = ~F.col(kept)
    return df.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("removed"),
        F.try_divide(F.count_if(gone & (F.col(outcome) == "TP")).cast("double"), F.count_if(F.col(outcome) == "TP")).alias("tp_removed"), F.try_divide(F.count_if(gone & (F.col(outcome) == "SL")).cast("double"), F.count_if(F.col(outcome) == "SL")).alias("sl_removed"),
    )


def leakage(df: DataFrame, features: Sequence[str], target: str, limit: float) -> DataFrame:
    """(feature, ic, suspicious): features whose rank correlation with the target is too good to be causal."""
    parts = [spearman(df, f, target).select(F.lit(f).alias("feature"), "n", "ic") for f in features]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("suspicious", F.abs("ic") > limit)


def kill_switch(df: DataFrame, triggers: dict[str, Column]) -> DataFrame:
    """KILLED where any trigger holds, with the first one's name; ARMED else."""
    first = F.coalesce(*[F.when(c, F.lit(n)) for n, c in triggers.items()])
    return df.withColumn("trigger", first).withColumn("state", F.when(first.isNotNull(), "KILLED").otherwise("ARMED"))


def quantile_rows(df: DataFrame, column: str, tie: Sequence[str], k: int) -> DataFrame:
    """tercile (or k-ile) of each row in the global order."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return positions(df, column, tie, name="_i").crossJoin(F.broadcast(n)).withColumn("part", F.floor(F.col("_i") * k / F.col("_n")).cast("long")).drop("_i", "_n")
