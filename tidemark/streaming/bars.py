"""Incremental bars: state a symbol, the same rows as the batch operators.

Threshold bars keep the running value and the open bar; a bar is emitted when a trade
crosses into the next. A stream never ends, so the open bar comes only from the batch
``finish`` (``flush``), or when a timer says that the symbol is silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import IMBALANCE, Imbalance, ImbalanceRule

BAR = "symbol string, bar_id long, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, count long"
_STATE = "cum string, bar_id long, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, count long"
_FIELDS = [c.split()[0] for c in BAR.split(", ")]
_EXACT = Decimal("0.000001")


class ThresholdBars(StatefulProcessor):
    """Bars by a running sum of price * quantity, exact to six places."""

    def __init__(self, threshold: float, silent_ms: int | None = None):
        self.threshold, self.silent_ms = Decimal(str(threshold)), silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_bar = handle.getValueState("open_bar", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        symbol = key[0]
        pdf = pd.concat(list(rows)).sort_values(["transact_time", "agg_trade_id"], kind="stable")
        state = self.open_bar.get() if self.open_bar.exists() else None
        cum = Decimal(state[0]) if state else Decimal(0)
        bar = list(state[1:]) if state else None
        out = []
        for t, price, quantity in zip(pdf["transact_time"].tolist(), pdf["price"].tolist(), pdf["quantity"].tolist(), strict=True):
            cum += Decimal(repr(price * quantity)).quantize(_EXACT)
            bar_id = int(cum // self.threshold)
            if bar is not None and bar[0] == bar_id:
                bar = [bar_id, bar[1], t, bar[3], max(bar[4], price), min(bar[5], price), price, bar[7] + quantity, bar[8] + price * quantity, bar[9] + 1]
            else:
                if bar is not None:
                    out.append((symbol, *bar))
                bar = [bar_id, t, t, price, price, price, price, float(quantity), price * quantity, 1]
        self.open_bar.update((str(cum), *bar))
        if self.silent_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield pd.DataFrame(out, columns=_FIELDS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open_bar.exists():
            state = self.open_bar.get()
            self.open_bar.clear()
            yield pd.DataFrame([(key[0], *state[1:])], columns=_FIELDS)
        else:
            yield pd.DataFrame([], columns=_FIELDS)

    def close(self) -> None:
        pass


class ImbalanceBars(StatefulProcessor):
    """Tick-imbalance bars: one row of state a symbol."""

    _KEPT = "mean double, theta double, length double, n long, bar_id long, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, count long, taker_buy_volume double, taker_buy_quote_volume double"
    output = IMBALANCE

    def __init__(self, rule: ImbalanceRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", self._KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["transact_time", "agg_trade_id"], kind="stable")
        state, bar_id, bar = Imbalance(self.rule), 0, None
        if self.kept.exists():
            state.mean, state.theta, state.length, state.n, bar_id, *bar = self.kept.get()
            bar = bar if state.n else None
        out = []
        for t, price, quantity, maker in zip(*(pdf[c].tolist() for c in ("transact_time", "price", "quantity", "is_buyer_maker")), strict=True):
            quote, taker = price * quantity, float(not maker)
            if bar is None:
                bar = [t, t, price, price, price, price, 0.0, 0.0, 0, 0.0, 0.0]
            bar = [bar[0], t, bar[2], max(bar[3], price), min(bar[4], price), price, bar[6] + quantity, bar[7] + quote, bar[8] + 1, bar[9] + taker * quantity, bar[10] + taker * quote]
            if state.closes(not maker):
                out.append((key[0], bar_id, *bar, None))
                bar, bar_id = None, bar_id + 1
        self.kept.update((state.mean, state.theta, state.length, state.n, bar_id, *(bar or [0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0])))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in IMBALANCE.split(", ")])

    def close(self) -> None:
        pass


def stateful_bars(trades: DataFrame, processor: StatefulProcessor) -> DataFrame:
    """trades may be a stream or a batch; the state store must be RocksDB.

    Timers only where the processor asks for them: with them a query that takes what is available never ends.
    """
    own = trades.select("symbol", "transact_time", "agg_trade_id", "price", F.col("quantity").cast("double").alias("quantity"), "is_buyer_maker")
    return own.groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=getattr(processor, "output", BAR), outputMode="append", timeMode="ProcessingTime" if getattr(processor, "silent_ms", None) else "None")


def tumbling_ohlcv(trades: DataFrame, width: str, late: str) -> DataFrame:
    """OHLCV of event-time windows; a window comes once when the watermark has passed it."""
    at = F.struct("transact_time", "agg_trade_id")
    timed = trades.withColumn("ts", F.timestamp_millis("transact_time")).withWatermark("ts", late)
    return timed.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("count")
    ).select("symbol", F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "count")


def sliding_mean(trades: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    timed = trades.withColumn("ts", F.timestamp_millis("transact_time")).withWatermark("ts", late)
    return timed.groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("count")).select("symbol", F.unix_millis("w.start").alias("open_time"), "mean_price", "count")


def sessions(trades: DataFrame, gap: str, late: str) -> DataFrame:
    timed = trades.withColumn("ts", F.timestamp_millis("transact_time")).withWatermark("ts", late)
    return timed.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("count"), F.sum("quantity").alias("volume")).select("symbol", F.unix_millis("w.start").alias("start_time"), F.unix_millis("w.end").alias("end_time"), "count", "volume")


def drift_alarm(trades: DataFrame, stored: DataFrame, bars_wanted: int, limit: float) -> DataFrame:
    """symbol, new threshold, its relative deviation from the stored one, and whether that is an alarm."""
    from ..operators.bars import calibrate

    both = calibrate(trades, bars_wanted).select("symbol", "threshold").join(stored.select("symbol", F.col("threshold").alias("stored")), "symbol")
    deviation = F.abs(F.col("threshold") / F.col("stored") - 1)
    return both.select("symbol", "threshold", "stored", deviation.alias("deviation"), (deviation > limit).alias("alarm"))


def buffered_trades(orders: DataFrame, trades: DataFrame, horizon: str, late: str) -> DataFrame:
    """Trades inside each order's horizon: a stream-stream join whose state the watermarks bound."""
    o = orders.withColumn("_ot", F.timestamp_millis("t_post")).withWatermark("_ot", late).alias("o")
    t = trades.withColumn("_tt", F.timestamp_millis("transact_time")).withWatermark("_tt", late).alias("t")
    match = (F.col("o.symbol") == F.col("t.symbol")) & (F.col("_tt") > F.col("_ot")) & (F.col("_tt") <= F.col("_ot") + F.expr(f"INTERVAL {horizon}"))
    return o.join(t, match).select(F.col("o.symbol").alias("symbol"), "oid", "t_post", "transact_time", "agg_trade_id", "price", "quantity", "limit_price", "side")
