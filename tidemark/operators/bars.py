"""Bars from trades: by the clock, by a running threshold, by signed imbalance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "1d": 86_400_000}
#: Running sums that decide a boundary are decimals: their order of addition does not matter.
EXACT = "decimal(38,6)"
MILLION = 10**6


def ohlcv(time: str = "transact_time", tie: str = "agg_trade_id") -> list[Column]:
    """Price path, sums and taker sums of a group of trades."""
    at = F.struct(time, tie)
    taker = ~F.col("is_buyer_maker")
    quote = F.col("price") * F.col("quantity")
    return [
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(quote).alias("quote_volume"),
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(taker, F.col("quantity")).otherwise(0)).alias("taker_buy_volume"),
        F.sum(F.when(taker, quote).otherwise(0.0)).alias("taker_buy_quote_volume"),
    ]


def clock_bars(trades: DataFrame, step_ms: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """OHLCV for each bucket of the clock; close_time is the bucket's last ms."""
    begin = F.floor(F.col("transact_time") / step_ms) * step_ms
    rows = trades.groupBy(*by, begin.cast("long").alias("open_time")).agg(*ohlcv())
    return rows.withColumn("close_time", F.col("open_time") + step_ms - 1)


def resample(bars: DataFrame, step_ms: int, base_ms: int = 60_000, complete: bool = True, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarser bars from bars; with complete, every bucket that lacks one of its base bars goes."""
    begin = (F.floor(F.col("open_time") / step_ms) * step_ms).cast("long")
    out = bars.groupBy(*by, begin.alias("_begin")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume")], F.count(F.lit(1)).alias("_n"),
    )
    if complete:
        out = out.where(F.col("_n") == step_ms // base_ms)
    return out.withColumnRenamed("_begin", "open_time").withColumn("close_time", F.col("open_time") + step_ms - 1).drop("_n")


def running_sum(df: DataFrame, value: Column, by: Sequence[str], time: str, tie: str, block_ms: int = 86_400_000) -> DataFrame:
    """df with ``cum``: the exact running sum of value by (time, tie), spread over blocks of time.

    Each block's total is summed before the shuffle; the running totals of the blocks,
    one row a block, are added to the running sum inside the block. So a symbol is not
    one task.
    """
    rows = df.withColumn("_v", value.cast(EXACT)).withColumn("_block", F.floor(F.col(time) / block_ms))
    totals = rows.groupBy(*by, "_block").agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).cast(EXACT).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(totals, [*by, "_block"])
    return joined.withColumn("cum", (F.col("_before") + F.sum("_v").over(inside)).cast(EXACT)).drop("_before", "_v", "_block")


def threshold_ids(trades: DataFrame, value: Column, threshold: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """bar_id = floor(running sum / threshold); the trade that crosses opens the next bar, ids may skip.

    As ``running_sum``, in millionths: whole numbers of 64 bits inside a block (a day), where
    most of the work is, and decimals only for the totals of blocks, of which whole bars and
    a rest go into the block. So the sums are as exact, and no row needs a decimal.
    """
    unit = round(threshold * MILLION)
    rows = trades.withColumns({"_v": F.floor(value * float(MILLION) + 0.5), "_block": F.floor(F.col("transact_time") / 86_400_000)})
    totals = rows.groupBy(*by, "_block").agg(F.sum("_v").cast("decimal(38,0)").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("decimal(38,0)"))
    totals = totals.select(*by, "_block", F.pmod("_before", F.lit(unit)).cast("long").alias("_rest"), F.expr(f"cast((_before - pmod(_before, {unit})) div {unit} as bigint)").alias("_bars"))
    inside = Window.partitionBy(*by, "_block").orderBy("transact_time", "agg_trade_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(totals, [*by, "_block"]).withColumn("_sum", F.col("_rest") + F.sum("_v").over(inside))
    return summed.withColumn("bar_id", F.col("_bars") + F.expr(f"(_sum - pmod(_sum, {unit})) div {unit}")).drop("_v", "_block", "_rest", "_bars", "_sum")


def threshold_bars(trades: DataFrame, value: Column, threshold: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    rows = threshold_ids(trades, value, threshold, by)
    return rows.groupBy(*by, "bar_id").agg(F.min("transact_time").alias("open_time"), F.max("transact_time").alias("close_time"), *ohlcv(), F.lit(float(threshold)).alias("threshold_quote"))


def dollar_bars(trades: DataFrame, threshold: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    return threshold_bars(trades, F.col("price") * F.col("quantity"), threshold, by)


def volume_bars(trades: DataFrame, threshold: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    return threshold_bars(trades, F.col("quantity"), threshold, by)


def calibrate(trades: DataFrame, bars_wanted: Column | int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Threshold that would have given so many bars: total quote volume over their number."""
    wanted = bars_wanted if isinstance(bars_wanted, Column) else F.lit(bars_wanted)
    return trades.groupBy(*by).agg(F.sum(F.col("price") * F.col("quantity")).alias("total_quote"), F.count(F.lit(1)).alias("n_trades")).withColumn("threshold", F.col("total_quote") / wanted)


def walkforward_thresholds(trades: DataFrame, trailing_days: int, bars_per_day: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each day's threshold, from the days strictly before it; days without any such trade have none."""
    days = trades.groupBy(*by, F.floor(F.col("transact_time") / 86_400_000).cast("long").alias("day")).agg(F.sum(F.col("price") * F.col("quantity")).alias("quote"))
    trailing = Window.partitionBy(*by).orderBy("day").rangeBetween(-trailing_days, -1)
    return days.withColumn("threshold", F.sum("quote").over(trailing) / (trailing_days * bars_per_day)).where(F.col("threshold").isNotNull())


IMBALANCE = "symbol string, bar_id long, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, count long, taker_buy_volume double, taker_buy_quote_volume double, threshold_quote double"


@dataclass(frozen=True)
class ImbalanceRule:
    """Smoothing spans, in trades and in bars, and the bounds of the expected length of a bar."""

    sign_span: int = 100
    length_span: int = 20
    initial_length: float = 50.0
    least: float = 5.0
    most: float = 500.0
    floor: float = 1e-12  # of the expected imbalance: a balanced flow still closes bars

    def __post_init__(self) -> None:
        if min(self.sign_span, self.length_span, self.initial_length, self.least) <= 0 or self.most < self.least:
            raise ValueError(f"spans and lengths must be positive, and most not under least: {self}")


@dataclass
class Imbalance:
    """What the rule remembers from trade to trade; mean is None before the first one."""

    rule: ImbalanceRule
    mean: float | None = None
    theta: float = 0.0
    length: float = 0.0
    n: int = 0

    def closes(self, bought: bool) -> bool:
        """Takes a trade (a taker's buy is +1, a sale -1) and says whether it ends its bar."""
        r, sign = self.rule, 1.0 if bought else -1.0
        alpha = 2.0 / (r.sign_span + 1.0)
        self.mean = sign if self.mean is None else alpha * sign + (1.0 - alpha) * self.mean
        self.length = self.length or r.initial_length
        self.theta, self.n = self.theta + sign, self.n + 1
        if abs(self.theta) < self.length * max(abs(self.mean), r.floor):
            return False
        alpha = 2.0 / (r.length_span + 1.0)
        self.length = min(max(alpha * self.n + (1.0 - alpha) * self.length, r.least), r.most)
        self.theta, self.n = 0.0, 0
        return True


def _imbalance_bars(pdf: pd.DataFrame, rule: ImbalanceRule) -> pd.DataFrame:
    """A symbol's bars: the rule says where they end, sums and extremes go by stretches."""
    pdf = pdf.sort_values(["transact_time", "agg_trade_id"], kind="stable")
    state, bought = Imbalance(rule), ~pdf["is_buyer_maker"].to_numpy(bool)
    closed = np.fromiter((state.closes(b) for b in bought.tolist()), bool, len(pdf))
    first = np.append(0, np.flatnonzero(closed) + 1)
    first = first[first < len(pdf)]  # the last bar may be open
    last = np.append(first[1:], len(pdf)) - 1
    time, price, quantity = (pdf[c].to_numpy() for c in ("transact_time", "price", "quantity"))
    quantity = quantity.astype(float)
    sums = {c: np.add.reduceat(x, first) for c, x in {"volume": quantity, "quote_volume": price * quantity, "taker_buy_volume": quantity * bought, "taker_buy_quote_volume": price * quantity * bought}.items()}
    out = {"symbol": pdf["symbol"].iat[0], "bar_id": np.arange(len(first)), "open_time": time[first], "close_time": time[last], "open": price[first], "high": np.maximum.reduceat(price, first), "low": np.minimum.reduceat(price, first), "close": price[last], **sums, "count": last - first + 1, "threshold_quote": np.nan}
    return pd.DataFrame(out)[[c.split()[0] for c in IMBALANCE.split(", ")]].assign(threshold_quote=pd.Series([None] * len(first), dtype="object"))


def tick_imbalance_bars(trades: DataFrame, rule: ImbalanceRule = ImbalanceRule()) -> DataFrame:
    """A bar ends where the sum of its trades' signs reaches the expected length times the mean sign; threshold_quote is null.

    A trade's sign is that of its taker (is_buyer_maker: -1). Both expectations are
    exponential means, of signs over all trades and of lengths over closed bars, and live
    on from bar to bar. The last bar is given as it stands. A recurrence over a symbol's
    whole tape, so a task a symbol; see ``streaming`` for the incremental form.
    """
    own = trades.select("symbol", "transact_time", "agg_trade_id", "price", "quantity", "is_buyer_maker")
    return own.groupBy("symbol").applyInPandas(lambda pdf: _imbalance_bars(pdf, rule), IMBALANCE)


def drop_ghosts(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Of bars that share an open_time the last to close."""
    last = Window.partitionBy(*by, "open_time").orderBy(F.desc("close_time"))
    return bars.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
