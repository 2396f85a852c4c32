"""Splits, scores and tests for time-ordered labels.

Splits are tables keyed by row and split, never positions. Their number is small and
fixed by a configuration, so split bounds are literals or one-row-a-split tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb, erf, exp, log, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import correlation
from .ranking import positions, quantiles, running

EULER = 0.5772156649015329


def edges(t_min: int, t_max: int, n: int) -> list[int]:
    """Equal spans of time; the last edge lies one beyond the end."""
    out = [int(t_min + round((t_max - t_min) * i / n)) for i in range(n + 1)]
    out[-1] += 1
    return out


def time_group(time: Column, at: Sequence[int]) -> Column:
    """Which of the spans a time lies in; those outside go to the first or last."""
    inner = [F.when(time >= x, 1).otherwise(0) for x in at[1:-1]]
    out = F.lit(0)
    for x in inner:
        out = out + x
    return out


def split_table(groups: int, test: int) -> list[tuple[int, ...]]:
    return list(combinations(range(groups), test))


def paths(groups: int) -> list[list[tuple[int, int]]]:
    """For two test groups a split: the pairs of each path by the circle method, every group once a path."""
    ring, out = list(range(groups)), []
    for _ in range(groups - 1):
        out.append(sorted(tuple(sorted((ring[i], ring[groups - 1 - i]))) for i in range(groups // 2)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def purged_splits(labels: DataFrame, groups: int = 6, test: int = 2, embargo_ms: int = 0, lookback_ms: int = 0) -> DataFrame:
    """(split_id, label_id, grp, role): test, train, purged or embargo, for every row and combination of test groups.

    A training row goes if its interval meets a test group's (which reaches to the last t1
    in it), if its look-back does, or if it begins within the embargo around the group.
    """
    low, high = labels.agg(F.min("t0"), F.max("t0")).first()
    at = edges(low, high, groups)
    rows = labels.withColumn("grp", time_group(F.col("t0"), at))
    ends = {r.grp: r.e for r in rows.groupBy("grp").agg(F.max("t1").alias("e")).collect()}  # a row for each group
    bounds = [(at[g], at[g + 1] - 1, max(at[g + 1] - 1, ends.get(g, 0))) for g in range(groups)]
    t0, t1 = F.col("t0"), F.col("t1")

    def role(tested: tuple[int, ...]) -> Column:
        in_test = F.col("grp").isin(*tested)
        purge, embargo = F.lit(False), F.lit(False)
        for g in tested:
            start, end, end_eff = bounds[g]
            purge = purge | ((t0 <= end_eff) & (t1 >= start)) | ((t0 > end_eff) & (t0 - lookback_ms <= end_eff) & F.lit(lookback_ms > 0))
            embargo = embargo | ((t0 > end) & (t0 <= end + embargo_ms)) | ((t0 >= start - embargo_ms) & (t0 < start))
        return F.when(in_test, "test").when(purge, "purged").when(embargo, "embargo").otherwise("train")

    roles = F.array(*[F.struct(F.lit(i).alias("split_id"), role(s).alias("role")) for i, s in enumerate(split_table(groups, test))])
    return rows.select("label_id", "grp", F.explode(roles).alias("s")).select("s.split_id", "label_id", "grp", "s.role")


def walk_forward(labels: DataFrame, first_periods: int) -> DataFrame:
    """(period, label_id, role): each quarter after the first ones is tested on what ended before it began."""
    ts = F.timestamp_millis("t0")
    rows = labels.withColumn("period", F.year(ts) * 4 + F.quarter(ts))
    present = rows.groupBy("period").agg(F.min("t0").alias("begin"))  # a row for each quarter
    tested = present.withColumn("n", F.row_number().over(Window.orderBy("period"))).where(F.col("n") > first_periods).select(F.col("period").alias("test_period"), "begin")
    test = rows.join(F.broadcast(tested), F.col("period") == F.col("test_period")).select("test_period", "label_id", F.lit("test").alias("role"))
    train = rows.join(F.broadcast(tested), (F.col("t0") < F.col("begin")) & (F.col("t1") < F.col("begin"))).select("test_period", "label_id", F.lit("train").alias("role"))
    return test.unionByName(train)


def temporal_holdout(labels: DataFrame, share: float) -> DataFrame:
    """role: the last share of t0 calibrates; earlier rows that reach into it are purged."""
    (cut,) = quantiles(labels, "t0", [1 - share])
    return labels.withColumn("role", F.when(F.col("t0") >= F.lit(cut), "calibration").when(F.col("t1") >= F.lit(cut), "purged").otherwise("fit"))


# --- scores ---


def sharpe(ret: str, span_start: Column, span_end: Column) -> Column:
    """mean / sd * sqrt(n / years) of a group; null without two rows, spread or span."""
    years = (span_end - span_start) / (365.25 * 86_400_000)
    n, sd = F.count(ret), F.stddev_samp(ret)
    return F.when((n >= 2) & (sd > 0) & (years > 0), F.avg(ret) / sd * F.sqrt(n / years))


def moments(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """n, mean, population sd, skew and excess kurtosis of a group, from one aggregation."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess_kurtosis"))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))


def psr_statistic(sr: Column, benchmark: Column | float, n: Column, skew: Column, excess: Column) -> Column:
    """The z of the probabilistic Sharpe ratio: its normal cdf is the ratio itself."""
    b = benchmark if isinstance(benchmark, Column) else F.lit(benchmark)
    return (sr - b) / F.sqrt((1 - skew * sr + excess / 4 * sr * sr) / (n - 1))


def expected_max_sharpe(sigma: float, trials: int) -> float:
    z = NormalDist().inv_cdf
    return 0.0 if trials < 2 else sigma * ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * exp(1))))


def fdr(df: DataFrame, p: str, by: Sequence[str] = (), yekutieli: bool = False) -> DataFrame:
    """adjusted: the least of p * m / rank over this rank and those above, at most 1 (times the harmonic number for BY)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")).withColumn("_scale", harmonic("_m") if yekutieli else F.lit(1.0))
    rows = positions(df, p, [c for c in df.columns if c not in (p, *by)], by, "_rank").withColumn("_rank", F.col("_rank") + 1)
    rows = rows.join(sizes, list(by)) if by else rows.crossJoin(F.broadcast(sizes))
    # the least of those above, in blocks of ranks: one row a block is carried on
    rows = rows.withColumns({"_q": F.col(p) * F.col("_m") * F.col("_scale") / F.col("_rank"), "_block": F.expr(f"_rank div {RANKS_OF_BLOCK}")})
    later = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "_block").agg(F.min("_q").alias("_low")).select(*by, "_block", F.min("_low").over(later).alias("_later"))
    up = Window.partitionBy(*by, "_block").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_low", F.min("_q").over(up)).join(blocks, [*by, "_block"]).select(*df.columns, F.least(F.lit(1.0), "_low", "_later").alias("adjusted"))


RANKS_OF_BLOCK = 50_000


def harmonic(n: str) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to a thousand, by its expansion beyond (error under 1e-14)."""
    x = F.col(n).cast("double")
    summed = F.aggregate(F.sequence(F.lit(1), F.least(F.col(n), F.lit(1000))), F.lit(0.0), lambda a, i: a + 1 / i)
    return F.when(x <= 1000, summed).otherwise(F.log(x) + F.lit(EULER) + 1 / (2 * x) - 1 / (12 * x * x))


def decile_profile(df: DataFrame, score: str, tie: Sequence[str], value: str, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """n and mean value by bucket floor(i * k / n) of the score's order."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = positions(df, score, tie, by, "_i")
    rows = rows.join(n, list(by)) if by else rows.crossJoin(F.broadcast(n))
    return rows.withColumn("bucket", F.floor(F.col("_i") * k / F.col("_n")).cast("long")).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.min(score).alias("low"), F.max(score).alias("high"))


def ranked(df: DataFrame, column: str, by: Sequence[str], name: str) -> DataFrame:
    """Average ranks from counts of distinct values: one row a value is sorted, not one a row, and that in ranges of values."""
    values = running(df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c")), {"_upto": F.col("_c")}, column, by, block=None if not by else F.lit(0))
    values = values.select(*by, F.col(column).alias("_value"), (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name))
    return df.withColumn("_value", F.col(column)).join(values, [*by, "_value"]).select(*df.columns, name)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """ic and n of each group: Pearson of average ranks over rows where both are there."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = ranked(ranked(rows, x, by, "_rx"), y, by, "_ry")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("ic"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc by the rank sum, and pr_auc by steps of recall over distinct scores."""
    rows = ranked(df, score, by, "_rank")
    good = F.col(label) == 1
    sums = rows.groupBy(*by).agg(F.sum(F.when(good, F.col("_rank"))).alias("_s"), F.count_if(good).alias("n_pos"), F.count_if(~good).alias("n_neg"))
    roc = sums.withColumn("roc_auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg")))).drop("_s")
    steps = df.groupBy(*by, (-F.col(score)).alias("_down")).agg(F.count_if(good).alias("_p"), F.count(F.lit(1)).alias("_k"))
    steps = running(steps, {"_good": F.col("_p"), "_all": F.col("_k")}, "_down", by, block=None if not by else F.lit(0))
    steps = steps.withColumn("_precision", F.col("_good") / F.col("_all"))
    pr = steps.groupBy(*by).agg((F.sum(F.col("_p") * F.col("_precision")) / F.nullif(F.sum("_p"), F.lit(0))).alias("pr_auc"))
    return roc.join(pr, list(by)) if by else roc.crossJoin(F.broadcast(pr))


def losses(df: DataFrame, p: str, label: str, by: Sequence[str] = (), clip: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"), F.avg(F.when(F.col(label) == 1, -F.log(q)).otherwise(-F.log(1 - q))).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame, p: str, label: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(bin, n, confidence, accuracy) of equal-width bins; the last one holds 1."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(label).alias("accuracy"))


def expected_calibration_error(df: DataFrame, p: str, label: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    c = calibration(df, p, label, bins, by)
    return c.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def pbo(returns: DataFrame, block: str, strategies: Sequence[str], n_blocks: int) -> dict:
    """Probability of backtest overfitting: in-sample winners whose out-of-sample rank is in the lower half.

    Blocks give sums and squares by one aggregation (n_blocks rows go to the driver);
    every half of the blocks is then combined from them.
    """
    parts = returns.groupBy(block).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(strategies)], *[F.sum(F.col(s) * F.col(s)).alias(f"q{i}") for i, s in enumerate(strategies)]).orderBy(block).limit(n_blocks).collect()

    def scores(chosen: Sequence) -> list[float]:
        n = sum(r.n for r in chosen)
        out = []
        for i in range(len(strategies)):
            s, q = sum(r[f"s{i}"] for r in chosen), sum(r[f"q{i}"] for r in chosen)
            var = (q - s * s / n) / (n - 1)
            out.append(s / n / sqrt(var) if var > 0 else 0.0)
        return out

    logits = []
    for half in combinations(range(len(parts)), len(parts) // 2):
        inside, outside = scores([parts[i] for i in half]), scores([parts[i] for i in range(len(parts)) if i not in half])
        best = max(range(len(strategies)), key=inside.__getitem__)
        v = outside[best]
        rank = (sum(x < v for x in outside) + (sum(x == v for x in outside) + 1) / 2) / (len(outside) + 1)
        logits.append(log(rank / (1 - rank)))
    return {"pbo": sum(x <= 0 for x in logits) / len(logits), "n_combinations": comb(len(parts), len(parts) // 2)}


def qlike(forecast: Column, realised: Column) -> Column:
    return F.when((forecast > 0) & (realised > 0), realised / forecast - F.log(realised / forecast) - 1)


def diebold_mariano(df: DataFrame, loss_a: str, loss_b: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(loss_a) - F.col(loss_b)
    return df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), (F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0))).alias("dm"))


def hhi(df: DataFrame, share_of: str, by: Sequence[str] = ()) -> DataFrame:
    """Concentration of shares, the effective number, and the Hill number of order 1."""
    total = df.groupBy(*by).agg(F.sum(share_of).alias("_t"))
    rows = df.join(total, list(by)) if by else df.crossJoin(F.broadcast(total))
    s = F.when(F.col("_t") > 0, F.col(share_of) / F.col("_t"))
    h = F.sum(s * s)
    return rows.groupBy(*by).agg(h.alias("hhi"), (1 / h).alias("effective_number"), F.exp(-F.sum(F.when(s > 0, s * F.log(s)).otherwise(0.0))).alias("hill"))


def jaccard(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    both, any_ = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
    return df.groupBy(*by).agg(F.when(any_ > 0, both / any_).alias("jaccard"))


def anova(df: DataFrame, group: str, response: str) -> DataFrame:
    """Welch's F, its degrees of freedom and omega squared, from group moments."""
    g = df.groupBy(group).agg(F.count(response).alias("n"), F.avg(response).alias("m"), F.var_samp(response).alias("v")).where("n > 1 and v > 0")
    g = g.withColumn("w", F.col("n") / F.col("v"))
    t = g.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("m")).alias("swm"), F.sum("n").alias("nn"), F.sum(F.col("n") * F.col("m")).alias("snm"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    x = g.crossJoin(F.broadcast(t))
    return x.groupBy("k", "nn", "within").agg(
        F.sum(F.col("w") * F.pow(F.col("m") - F.col("swm") / F.col("sw"), 2)).alias("between_w"), F.sum(F.pow(1 - F.col("w") / F.col("sw"), 2) / (F.col("n") - 1)).alias("lam"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("snm") / F.col("nn"), 2)).alias("between")
    ).select(
        F.col("k").alias("groups"), ((F.col("between_w") / (F.col("k") - 1)) / (1 + 2 * (F.col("k") - 2) / (F.col("k") * F.col("k") - 1) * F.col("lam"))).alias("welch_f"), ((F.col("k") * F.col("k") - 1) / (3 * F.col("lam"))).alias("df2"),
        ((F.col("between") - (F.col("k") - 1) * F.col("within") / (F.col("nn") - F.col("k"))) / (F.col("between") + F.col("within") + F.col("within") / (F.col("nn") - F.col("k")))).alias("omega2"),
    )


def cochran_q(df: DataFrame, effect: str, se: str, by: Sequence[str] = ()) -> DataFrame:
    """Heterogeneity of estimates: Q with weights 1 / se^2 and I2 in percent."""
    w = 1 / (F.col(se) * F.col(se))
    e = F.col(effect)
    q = F.sum(w * e * e) - F.sum(w * e) * F.sum(w * e) / F.sum(w)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), (F.sum(w * e) / F.sum(w)).alias("pooled"), q.alias("q")).withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q")) * 100).otherwise(0.0))


def top_share(df: DataFrame, margin: str, tie: Sequence[str], q: float, by: Sequence[str] = ()) -> DataFrame:
    """The ceil(q * n) rows of greatest margin that are also positive."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = positions(df.withColumn("_low", -F.col(margin)), "_low", tie, by, "_i")
    rows = rows.join(n, list(by)) if by else rows.crossJoin(F.broadcast(n))
    return rows.where((F.col("_i") < F.ceil(q * F.col("_n"))) & (F.col(margin) > 0)).drop("_n", "_i", "_low")
