"""Research features and probes that stand beside the feature frame: gaps, an index of implied volatility, days since an event."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof
from .ranking import positions
from .windows import lagged, rolling, rolling_zscore

DAY_MS = 86_400_000
#: Days of the halvings of the block reward.
HALVINGS = ("2012-11-28", "2016-07-09", "2020-05-11", "2024-04-20")


def gap_pct(open_: str = "open", close: str = "close") -> Column:
    """The open over the close before it, less one."""
    before = lagged(close, 1)
    return F.when(before != 0, (F.col(open_) - before) / before)


def days_since(bars: DataFrame, events: DataFrame, at: str = "open_time", event_time: str = "event_ms", name: str = "days_since") -> DataFrame:
    """Days from the last event at or before each bar; null before the first one."""
    found = asof(bars, events.select(F.col(event_time).alias("_event")), at, "_event", ["_event"])
    return found.withColumn(name, (F.col(at) - F.col("_event")) / DAY_MS).drop("_event")


def halvings(spark) -> DataFrame:
    return spark.createDataFrame([(d,) for d in HALVINGS], "day string").select(F.unix_millis(F.to_timestamp("day")).alias("event_ms"))


def index_features(bars: DataFrame, index: DataFrame, window: int, realised: str, bars_per_year: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """C13_bvol_index, C14_bvol_z and C15_iv_rv_spread: the last index value (calc_time, index_value; in percent a year) at or before a
    bar's close, its z over a window of bars, and its excess over the annualised realised volatility of a column of standard deviations."""
    out = asof(bars, index.select("calc_time", "index_value"), "close_time", "calc_time", ["index_value"]).withColumnRenamed("index_value", "C13_bvol_index")
    out = out.withColumn("C14_bvol_z", rolling_zscore("C13_bvol_index", window, by))
    return out.withColumn("C15_iv_rv_spread", F.col("C13_bvol_index") / 100 - F.col(realised) * F.lit(bars_per_year**0.5))


def realised_volatility(x: str, n: int, by: Sequence[str] = ("symbol",)) -> Column:
    return rolling(F.stddev_samp(x), x, n, by)


def open_close_divergence(bars: DataFrame, events: DataFrame, event_time: str, value: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """n and differing: bars whose last event at or before the open is not that at or before the close."""
    both = asof(bars.select(*by, "open_time", "close_time"), events.select(*by, F.col(event_time).alias("_t"), F.col(value).alias("_a")), "open_time", "_t", ["_a"], by)
    both = asof(both, events.select(*by, F.col(event_time).alias("_t"), F.col(value).alias("_b")), "close_time", "_t", ["_b"], by)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"))


def conditioned(predictions: DataFrame, labels: DataFrame, on: Sequence[str], score: str, ret: str, condition: str, k: int, tie: Sequence[str]) -> DataFrame:
    """n, mean score and mean return of each regime (or other condition) and quantile bucket of the score, over all joined rows."""
    both = predictions.join(labels, list(on)).where(F.col(score).isNotNull())
    n = both.groupBy(condition).agg(F.count(F.lit(1)).alias("_n"))
    placed = positions(both, score, tie, [condition], "_i").join(n, condition)
    bucket = F.floor(F.col("_i") * k / F.col("_n")).cast("long")
    return placed.groupBy(condition, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(ret).alias("mean_ret"))


#: Values of all series together that go to each replicate's task.
VALUES_MOST = 1_000_000


def _bounded(df: DataFrame) -> pd.DataFrame:
    n = df.count()
    if n > VALUES_MOST:
        raise ValueError(f"{n} values are too many to send to each replicate (at most {VALUES_MOST}); aggregate them first")
    return df.toPandas()


def pooled_block_bootstrap(values: DataFrame, value: str, by: str, order: str, replicates: int, seed: int, block: int | None = None) -> DataFrame:
    """(replicate, mean): each series drawn anew in circular blocks of its own, all pooled. The series are of a checked size."""
    data = _bounded(values.select(by, order, value).where(F.col(value).isNotNull())).sort_values([by, order], kind="stable")
    series = [g[value].to_numpy(float) for _, g in data.groupby(by, sort=True)]
    spark = values.sparkSession
    sent = spark.sparkContext.broadcast(series)

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                total = count = 0
                for i, x in enumerate(sent.value):
                    rng = np.random.default_rng([seed, int(k), i])
                    size = block or max(1, round(len(x) ** (1 / 3)))
                    starts = rng.integers(0, len(x), -(-len(x) // size))
                    drawn = x[(starts[:, None] + np.arange(size)).ravel()[: len(x)] % len(x)]
                    total, count = total + drawn.sum(), count + len(x)
                out.append((int(k), float(total / count) if count else None))
            yield pd.DataFrame(out, columns=["replicate", "mean"])

    return spark.range(replicates).mapInPandas(run, "replicate long, mean double")


def max_t_null(values: DataFrame, features: Sequence[str], target: str, order: str, replicates: int, seed: int, block: int) -> DataFrame:
    """(replicate, max_t): the greatest absolute correlation of any feature with the target, whose blocks are put in another order.

    Replicate -1 is the data as they stand. The rows are one series of a checked size.
    """
    data = _bounded(values.select(order, *features, target).dropna()).sort_values(order, kind="stable")
    x, y = data[list(features)].to_numpy(float), data[target].to_numpy(float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), np.inf) if len(x) else x
    spark = values.sparkSession
    sent = spark.sparkContext.broadcast((x, y))

    def run(batches):
        x, y = sent.value
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                z = y
                if k >= 0:
                    blocks = np.array_split(np.arange(len(y)), max(1, -(-len(y) // block)))
                    z = y[np.concatenate([blocks[i] for i in np.random.default_rng([seed, int(k)]).permutation(len(blocks))])]
                sd = z.std() if len(z) else 0.0
                out.append((int(k), float(np.abs(x.T @ (z - z.mean()) / len(z) / sd).max()) if sd > 0 else None))
            yield pd.DataFrame(out, columns=["replicate", "max_t"])

    return spark.range(-1, replicates).mapInPandas(run, "replicate long, max_t double")


def null_p_value(null: DataFrame, statistic: str) -> float:
    """(1 + replicates at or above the observed one) / (1 + replicates)."""
    r = null.agg(F.max(F.when(F.col("replicate") < 0, F.col(statistic))).alias("seen")).first().seen
    n = null.where("replicate >= 0").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(statistic) >= F.lit(r)).alias("k")).first()
    return (1 + n.k) / (1 + n.n)
