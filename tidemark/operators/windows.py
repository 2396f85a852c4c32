"""Causal window operators over bars: rolling, expanding, recurrences, ranks, runs.

Rolling frames are full or null. Recurrences (EMA, Wilder) and ranks against the past are
grouped kernels over a key's bars: sequential in a key by nature, parallel over keys.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import candles
from ..functions.semantics import correlation, full, ln, rows_before, strictly_before

BY, ORDER = ("symbol",), ("open_time",)


def lagged(x: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    return F.lag(x, n).over(Window.partitionBy(*by).orderBy(*order))


def log_return(close: str, n: int = 1, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """ln(C_t / C_{t-n}); a negative n looks ahead."""
    past = lagged(close, n, by, order)
    if n < 0:
        return ln(past) - ln(F.col(close))
    return ln(F.col(close)) - ln(past)


def rolling(aggregate: Column, x: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    return full(aggregate, F.col(x), rows_before(by, order, n), n)


def rolling_zscore(x: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    mean, sd = rolling(F.avg(x), x, n, by, order), rolling(F.stddev_samp(x), x, n, by, order)
    return F.when(sd > 0, (F.col(x) - mean) / sd)


def rolling_corr(x: str, y: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    w = rows_before(by, order, n)
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    return F.when(F.count(both).over(w) == n, correlation(x, y, w))


def rolling_median(x: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """The middle of the sorted frame; an array of n values a row, so for small n."""
    values = F.sort_array(F.collect_list(x).over(rows_before(by, order, n)))
    middle = (F.element_at(values, (n + 1) // 2) + F.element_at(values, n // 2 + 1)) / 2
    return F.when(F.size(values) == n, middle)


def efficiency_ratio(close: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> tuple[Column, Column]:
    """(step, ratio): add the step as ``_step`` before using the ratio."""
    step = F.abs(F.col(close) - lagged(close, 1, by, order))
    path = rolling(F.sum("_step"), "_step", n, by, order)
    return step, F.when(path > 0, F.abs(F.col(close) - lagged(close, n, by, order)) / path)


def stochastic(close: str, high: str, low: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    top, bottom = rolling(F.max(high), high, n, by, order), rolling(F.min(low), low, n, by, order)
    return F.when(top.isNotNull(), F.when(top > bottom, 100 * (F.col(close) - bottom) / (top - bottom)).otherwise(50.0))


def volatility(term: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """Root of a term's rolling mean; null where the mean is negative."""
    mean = rolling(F.avg(term), term, n, by, order)
    return F.when(mean >= 0, F.sqrt(mean))


def yang_zhang(bars: DataFrame, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER, name: str = "yang_zhang") -> DataFrame:
    """Overnight and open-to-close variances and the mean Rogers-Satchell term, weighted by k."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = bars.withColumns({"_o": ln(o) - ln(lagged("close", 1, by, order)), "_c": ln(c) - ln(o), "_rs": candles.rogers_satchell_term(o, h, low, c)})
    var = rolling(F.var_samp("_o"), "_o", n, by, order) + k * rolling(F.var_samp("_c"), "_c", n, by, order) + (1 - k) * rolling(F.avg("_rs"), "_rs", n, by, order)
    return df.withColumn(name, F.when(var >= 0, F.sqrt(var))).drop("_o", "_c", "_rs")


def expanding_zscore(x: str, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """Against the strict past: at least two values, and they differ."""
    w = strictly_before(by, order)
    sd = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) >= 2) & (sd > 0), (F.col(x) - F.avg(x).over(w)) / sd)


def time_mean(x: str, time: str, window_ms: int, by: Sequence[str] = BY) -> Column:
    """Mean over [t - window, t): rows of the same time are not part of it."""
    return F.avg(x).over(Window.partitionBy(*by).orderBy(time).rangeBetween(-window_ms, -1))


def day_vwap_distance(bars: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """vwap: volume-weighted typical price since the UTC day of close_time began."""
    w = Window.partitionBy(*by, F.floor(F.col("close_time") / candles.DAY_MS)).orderBy("close_time").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(w)
    return bars.withColumn("vwap", F.when(volume > 0, F.sum(typical * F.col("volume")).over(w) / volume))


def _recurrence(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], name: str, kernel) -> DataFrame:
    """(by, order, name) from kernel(values) -> values, a task a key."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*by, *order)), f"`{name}` double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        values = [None if v is None or v != v else v for v in pdf["_x"].tolist()]
        out = pdf[[*by, *order]].copy()
        out[name] = pd.Series(kernel(values), index=out.index, dtype="float64")
        return out

    return df.select(*by, *order, F.col(x).cast("double").alias("_x")).groupBy(*by).applyInPandas(run, schema)


def ema(df: DataFrame, x: str, span: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER, name: str = "ema") -> DataFrame:
    """alpha = 2 / (span + 1), seeded by the first value; null until span values have come."""
    alpha = 2 / (span + 1)

    def kernel(values: list) -> list:
        out, state, n = [], None, 0
        for v in values:
            if v is not None:
                state = v if state is None else alpha * v + (1 - alpha) * state
                n += 1
            out.append(state if n >= span and v is not None else None)
        return out

    return _recurrence(df, x, by, order, name, kernel)


def wilder(df: DataFrame, x: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER, name: str = "wilder") -> DataFrame:
    """Seeded by the mean of the first n values, then ((n - 1) * previous + x) / n; a missing value gives null and keeps the state."""

    def kernel(values: list) -> list:
        out, seed, state = [], [], None
        for v in values:
            if v is None:
                out.append(None)
                continue
            if state is None:
                seed.append(v)
                state = sum(seed) / n if len(seed) == n else None
            else:
                state = (state * (n - 1) + v) / n
            out.append(state)
        return out

    return _recurrence(df, x, by, order, name, kernel)


def atr(bars: DataFrame, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    tr = candles.true_range(F.col("high"), F.col("low"), lagged("close", 1, by, order))
    return wilder(bars.withColumn("_tr", tr), "_tr", n, by, order, "atr")


def rsi(bars: DataFrame, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """100 without losses, 50 when flat."""
    change = F.col("close") - lagged("close", 1, by, order)
    df = bars.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))})
    df = df.withColumns({"_up": F.when(change.isNotNull(), F.col("_up")), "_down": F.when(change.isNotNull(), F.col("_down"))})
    keys = [*by, *order]
    both = wilder(df, "_up", n, by, order, "up").join(wilder(df, "_down", n, by, order, "down"), keys)
    value = F.when(F.col("down") > 0, 100 - 100 / (1 + F.col("up") / F.col("down"))).when(F.col("up") > 0, 100.0).when(F.col("up") == 0, 50.0)
    return both.select(*keys, value.alias("rsi"))


def macd_histogram(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    keys = [*by, *order]
    line = ema(bars, "close", fast, by, order, "f").join(ema(bars, "close", slow, by, order, "s"), keys).withColumn("macd", F.col("f") - F.col("s"))
    return line.join(ema(line, "macd", signal, by, order, "signal"), keys).select(*keys, "macd", "signal", (F.col("macd") - F.col("signal")).alias("histogram"))


def percentile_rank(df: DataFrame, x: str, by: Sequence[str] = BY, order: Sequence[str] = ORDER, last: int | None = None, time: str | None = None, window_ms: int | None = None, name: str = "rank") -> DataFrame:
    """Share of earlier values that are not above this one: of all, of the last rows, or of a time window.

    The first value, and one without a past in its window, has none.
    """
    types = dict(df.dtypes)
    keys = list(dict.fromkeys([*by, *order, *([time] if time else [])]))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), f"`{name}` double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        values = pdf["_x"].tolist()
        times = pdf[time].tolist() if time else None
        past: list[float] = []
        begin, out = 0, []
        for i, v in enumerate(values):
            while begin < i and ((last is not None and i - begin > last) or (times is not None and times[i] - times[begin] > window_ms)):
                old = values[begin]
                begin += 1
                if old == old and old is not None:
                    del past[bisect_right(past, old) - 1]
            missing = v is None or v != v
            out.append(None if missing or not past else bisect_right(past, v) / len(past))
            if not missing:
                insort(past, v)
        result = pdf[keys].copy()
        result[name] = pd.Series(out, index=result.index, dtype="float64")
        return result

    return df.select(*keys, F.col(x).cast("double").alias("_x")).groupBy(*by).applyInPandas(run, schema)


def islands(df: DataFrame, value: str, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """segment (from 0) of equal neighbours, and the place in it (from 1)."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    df = df.withColumn("_new", change).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
    return df.withColumn("run_length", F.row_number().over(Window.partitionBy(*by, "segment").orderBy(*order)).cast("long"))


def segment_mean(df: DataFrame, value: str, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Column:
    """Expanding mean inside the segment."""
    return F.avg(value).over(Window.partitionBy(*by, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def last_epochs_sum(df: DataFrame, value: str, epoch: str, n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """total: the sum over the last n distinct epochs, each counted once when it begins; null before n of them."""
    w = Window.partitionBy(*by).orderBy(*order)
    begins = F.col(epoch).isNotNull() & ~F.lag(epoch).over(w).eqNullSafe(F.col(epoch))
    df = df.withColumn("_begins", begins).withColumn("_epoch_no", F.sum(F.when(F.col("_begins"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = df.where("_begins").select(*by, "_epoch_no", F.col(value).alias("_v"))
    last = Window.partitionBy(*by).orderBy("_epoch_no").rowsBetween(-(n - 1), 0)
    per = per.select(*by, "_epoch_no", F.when(F.count("_v").over(last) == n, F.sum("_v").over(last)).alias("total"))
    return df.join(per, [*by, "_epoch_no"], "left").drop("_begins", "_epoch_no")


def transition_failures(df: DataFrame, value: str, horizon: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """For each change of value with a full horizon after it: whether the old value comes back within it."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_before", F.lag(value).over(w)).withColumn("_ahead", F.collect_list(value).over(w.rowsBetween(0, horizon - 1)))
    changes = df.where(F.col("_before").isNotNull() & (F.col("_before") != F.col(value)) & (F.size("_ahead") == horizon))
    return changes.withColumn("failed", F.array_contains("_ahead", F.col("_before"))).drop("_ahead", "_before")


def circular_shift(df: DataFrame, value: str, time: str, shift_ms: int, by: Sequence[str] = BY) -> DataFrame:
    """shifted: the value at or before (t - t_min + shift) mod the duration; times stay."""
    from .asof import asof

    ends = df.groupBy(*by).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    rows = df.join(ends, list(by)).withColumn("_at", F.col("_low") + F.pmod(F.col(time) - F.col("_low") + shift_ms, F.greatest(F.col("_high") - F.col("_low"), F.lit(1))))
    return asof(rows, df.select(*by, F.col(time).alias("_rt"), F.col(value).alias("shifted")), "_at", "_rt", ["shifted"], by).drop("_low", "_high", "_at")

