"""Declared schemas of the market tables; readers never infer one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in columns.items()])


_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Contract:
    """Name, ordered columns, key, time column with its unit, and the grid step (None: event driven)."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    time: str
    non_null: tuple[str, ...] = ()
    step_ms: int | None = None
    casts: dict[str, str] = field(default_factory=dict)


_KLINE = dict(open_time="long", open="string", high="string", low="string", close="string", volume="double", close_time="long", quote_volume="double", count="long", taker_buy_volume="double", taker_buy_quote_volume="double", ignore="string")
_BAR = {k: ("double" if v == "string" else v) for k, v in _KLINE.items() if k != "ignore"}
_PRICES = ("open", "high", "low", "close")


def _klines(name: str) -> Contract:
    return Contract(name, _schema(**_KLINE), ("open_time",), "open_time", ("open_time", *_PRICES, "volume", "close_time"), 60_000, dict.fromkeys(_PRICES, "double"))


def _bars(name: str, step_ms: int) -> Contract:
    return Contract(name, _schema(**_BAR), ("open_time",), "open_time", tuple(_BAR), step_ms)


def _dollar(name: str) -> Contract:
    return Contract(name, _schema(**_BAR, threshold_quote="double"), ("open_time",), "close_time", (*_BAR, "threshold_quote"))


CONTRACTS = {
    c.name: c
    for c in (
        _klines("klines_1m"),
        _klines("mark_price_klines_1m"),
        _klines("premium_index_klines_1m"),
        Contract("agg_trades", _schema(agg_trade_id="long", price="double", quantity="double", first_trade_id="long", last_trade_id="long", transact_time="long", is_buyer_maker="boolean"), ("agg_trade_id",), "transact_time", ("agg_trade_id", "price", "quantity", "transact_time")),
        *(_dollar(f"dollar_bars_r{i}") for i in (1, 2, 3)),
        _bars("bars_15m", 900_000),
        _bars("bars_30m", 1_800_000),
        _bars("bars_1h", 3_600_000),
        Contract(
            "metrics",
            _schema(create_time="string", symbol="string", sum_open_interest="double", sum_open_interest_value="double", count_toptrader_long_short_ratio="double", sum_toptrader_long_short_ratio="double", count_long_short_ratio="double", sum_taker_long_short_vol_ratio="double"),
            ("create_time",), "create_time", ("create_time", "symbol"), 300_000,
        ),
        Contract("funding", _schema(calc_time="long", funding_interval_hours="long", last_funding_rate="string"), ("calc_time",), "calc_time", ("calc_time", "funding_interval_hours", "last_funding_rate"), None, {"last_funding_rate": "double"}),
        Contract("book_ticker", _schema(transaction_time="long", best_bid_price="double", best_bid_qty="double", best_ask_price="double", best_ask_qty="double"), ("transaction_time",), "transaction_time"),
    )
}
