"""Registration of queries with the SQL that gives the same rows, and the shared views."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000
#: Kinds of events, which stand for symbols.
SYMBOLS = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    """Registers a function by its name, q_ left off."""

    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, with one zero, for results that are compared by value."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


def pick(df: DataFrame, keys: Sequence[str], **values: Column | str) -> DataFrame:
    return df.select(*keys, *[r(v).alias(k) for k, v in values.items()])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ticks(spark, sf_dir)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events."""
    return B.clock_bars(ticks(spark, sf_dir), HOUR)


TICKS = """ticks AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS transact_time, event_id AS agg_trade_id, value AS price,
  1 + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS quantity, event_id % 2 = 0 AS is_buyer_maker FROM events)"""

OHLCV = """arg_min(price, (transact_time, agg_trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (transact_time, agg_trade_id)) AS close,
  CAST(sum(quantity) AS BIGINT) AS volume, sum(price * quantity) AS quote_volume, count(*) AS count,
  CAST(sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END) AS BIGINT) AS taker_buy_volume, sum(CASE WHEN NOT is_buyer_maker THEN price * quantity ELSE 0 END) AS taker_buy_quote_volume"""


def clock_sql(step: int, name: str = "bars", of: str = "ticks") -> str:
    return f"{name} AS (SELECT symbol, transact_time // {step} * {step} AS open_time, transact_time // {step} * {step} + {step - 1} AS close_time, {OHLCV} FROM {of} GROUP BY 1, 2, 3)"


BARS = clock_sql(HOUR)
HEAD = f"WITH {TICKS}, {BARS}"
