"""Rule-based baselines that a model has to beat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import shuffle_places
from .validation import sharpe

DAY_MS = 86_400_000


def buy_and_hold(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """n_days, mean and deviation of the daily log returns, and their ratio a year; null with fewer than two days or no spread.

    A day's close is that of its last bar. Days are numbered by symbol: a row a day.
    """
    days = bars.groupBy(*by, F.floor(F.col("open_time") / DAY_MS).alias("day")).agg(F.max_by("close", "open_time").alias("close"))
    ret = F.log(F.col("close") / F.lag("close").over(Window.partitionBy(*by).orderBy("day")))
    out = days.withColumn("r", ret).groupBy(*by).agg(F.count(F.lit(1)).alias("n_days"), F.avg("r").alias("mean_daily_log_ret"), F.stddev_samp("r").alias("std_daily_log_ret"))
    return out.withColumn("sharpe_naive", F.when(F.col("std_daily_log_ret") > 0, F.col("mean_daily_log_ret") / F.col("std_daily_log_ret") * F.sqrt(F.lit(365.25))))


def static_rule(labels: DataFrame, rule: Column, by: Sequence[str] = ()) -> DataFrame:
    """n_signals, n_filled, fill_rate, sharpe_naive, mean_trade_ret and trades_per_year of the labels that a rule picks.

    labels: t0 (ms), barrier_hit (NOFILL where no order was filled), ret_net. For example
    ``F.col("side") == -1`` (always short), or long in two regimes above an average.
    """
    picked = labels.where(rule).withColumn("_ret", F.when(F.col("barrier_hit") != "NOFILL", F.col("ret_net")))
    filled = F.col("_ret").isNotNull()
    start, end = F.min(F.when(filled, F.col("t0"))), F.max(F.when(filled, F.col("t0")))
    years = (end - start) / (365.25 * DAY_MS)
    out = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_signals"), F.count("_ret").alias("n_filled"), sharpe("_ret", start, end).alias("sharpe_naive"), F.avg("_ret").alias("mean_trade_ret"), F.try_divide(F.count("_ret").cast("double"), years).alias("trades_per_year"))
    return out.withColumn("fill_rate", F.try_divide(F.col("n_filled").cast("double"), F.col("n_signals")))


def strip_carry(trades: DataFrame) -> DataFrame:
    """ret_net without what was paid or received for holding: the gross return less fees."""
    return trades.withColumn("ret_net", F.col("ret_gross") - (F.col("cost_entry_bps") + F.col("cost_exit_bps")) / 10_000)


def percentile_of(null: DataFrame, statistic: str, value: float) -> float | None:
    """Share, in percent, of a null distribution that lies below a value; null and not-a-number do not count."""
    known = null.where(F.col(statistic).isNotNull() & ~F.isnan(statistic))
    return known.agg((F.avg(F.when(F.col(statistic) < value, 1.0).otherwise(0.0)) * 100).alias("p")).first().p


def shuffle_features(df: DataFrame, features: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Each feature in an order of its own (row_id says which row is which), the rest as it is; for a model's score on noise."""
    rows = shuffle_places(df, by, seed, "_place")
    for i, feature in enumerate(features):
        other = shuffle_places(df.select(*by, "row_id", F.col(feature).alias(f"_f{i}")), by, seed + 1 + i, "_place").drop("row_id")
        rows = rows.join(other, [*by, "_place"])
    return rows.select(*[F.col(f"_f{features.index(c)}").alias(c) if c in features else F.col(c) for c in df.columns])
