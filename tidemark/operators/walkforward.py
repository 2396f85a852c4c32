"""Threshold bars whose threshold changes from period to period while the open bar goes on."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import walkforward_thresholds

SCHEMA = "symbol string, period long, bar_id long, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, count long, threshold_quote double"
DAY_MS = 86_400_000


class Carry:
    """The open bar's trades and the running value, kept when the threshold is replaced."""

    def __init__(self, threshold: float):
        self.threshold, self.base, self.open, self.bar_id = threshold, 0.0, [], 0
        self._current = 0

    def step(self, trades: list[tuple[int, float, float]]) -> list[list[tuple[int, float, float]]]:
        """Adds trades (time, price, quantity); gives the bars that they close. The one that crosses opens the next."""
        closed = []
        for t in trades:
            value = self.base + t[1] * t[2]
            bucket = math.floor(value / self.threshold)
            if bucket != self._current and self.open:
                closed.append(self.open)
                self.open = []
            self.base, self._current = value, bucket
            self.open.append(t)
        return closed

    def replace(self, threshold: float) -> None:
        """The open bar's value is counted anew, from its own trades, against the new threshold."""
        self.threshold = threshold
        self.base = sum(p * q for _, p, q in self.open)
        self._current = math.floor(self.base / threshold)

    def finish(self) -> list[list[tuple[int, float, float]]]:
        left, self.open = ([self.open] if self.open else []), []
        return left


def bar_row(symbol: str, period: int, bar_id: int, bar: list[tuple[int, float, float]], threshold: float) -> tuple:
    prices = [p for _, p, _ in bar]
    return symbol, period, bar_id, bar[0][0], bar[-1][0], prices[0], max(prices), min(prices), prices[-1], sum(q for *_, q in bar), sum(p * q for _, p, q in bar), len(bar), threshold


def walkforward_bars(trades: DataFrame, trailing_days: int, cadence_days: int, bars_per_day: int) -> DataFrame:
    """Bars of every period that has trades in the days before it; trades of other periods enter no bar.

    threshold_quote is the one in force when the bar closed. Sequential in a symbol.
    """
    daily = walkforward_thresholds(trades, trailing_days, bars_per_day)
    first = trades.groupBy("symbol").agg((F.floor(F.min("transact_time") / DAY_MS)).alias("first_day"))
    own = trades.join(F.broadcast(first), "symbol").withColumn("period", F.floor((F.floor(F.col("transact_time") / DAY_MS) - F.col("first_day")) / cadence_days))
    starts = own.groupBy("symbol", "period").agg(F.min(F.floor(F.col("transact_time") / DAY_MS)).alias("day"))
    thresholds = starts.join(daily.select("symbol", "day", "threshold"), ["symbol", "day"]).where("threshold > 0").select("symbol", "period", "threshold")
    rows = own.join(thresholds, ["symbol", "period"]).select("symbol", "period", "threshold", "transact_time", "agg_trade_id", "price", "quantity")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["transact_time", "agg_trade_id"], kind="stable")
        carry, out = None, []
        for period, part in pdf.groupby("period", sort=True):
            threshold = float(part["threshold"].iat[0])
            if carry is None:
                carry = Carry(threshold)
            else:
                carry.replace(threshold)
            for bar in carry.step(list(zip(part["transact_time"], part["price"], part["quantity"].astype(float), strict=True))):
                out.append(bar_row(part["symbol"].iat[0], period, len(out), bar, threshold))
        if carry is not None:
            for bar in carry.finish():
                out.append(bar_row(pdf["symbol"].iat[0], int(pdf["period"].max()), len(out), bar, carry.threshold))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.groupBy("symbol").applyInPandas(run, SCHEMA)
