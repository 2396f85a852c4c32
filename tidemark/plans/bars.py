"""Bars: clock, threshold, imbalance, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from .base import HEAD, HOUR, OHLCV, TICKS, clock_sql, hours, query, r, ticks

OUT = ("open", "high", "low", "close", "quote_volume", "taker_buy_quote_volume")
COUNTS = ("volume", "count", "taker_buy_volume")
ROUNDED = ", ".join(f"round({c}, 6) + 0 AS {c}" for c in OUT) + ", volume, count, taker_buy_volume"


def shown(df, *keys):
    return df.select(*keys, *[r(c).alias(c) for c in OUT], *COUNTS)


def _clock(step: int):
    return f"WITH {TICKS}, {clock_sql(step)} SELECT symbol, open_time, close_time, {ROUNDED} FROM bars"


@query(_clock(300_000))
def q_resample_ohlcv_5m(spark, sf_dir):
    return shown(B.clock_bars(ticks(spark, sf_dir), 300_000), "symbol", "open_time", "close_time")


@query(_clock(HOUR))
def q_resample_ohlcv_1h(spark, sf_dir):
    return shown(hours(spark, sf_dir), "symbol", "open_time", "close_time")


@query(_clock(86_400_000))
def q_resample_ohlcv_1d(spark, sf_dir):
    return shown(B.clock_bars(ticks(spark, sf_dir), 86_400_000), "symbol", "open_time", "close_time")


@query(
    f"""{HEAD}, two AS (SELECT symbol, open_time // 7200000 * 7200000 AS b, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close,
    CAST(sum(volume) AS BIGINT) AS volume, sum(quote_volume) AS quote_volume, CAST(sum(count) AS BIGINT) AS count, CAST(sum(taker_buy_volume) AS BIGINT) AS taker_buy_volume,
    sum(taker_buy_quote_volume) AS taker_buy_quote_volume FROM bars GROUP BY 1, 2 HAVING count(*) = 2)
    SELECT symbol, b AS open_time, b + 7199999 AS close_time, {ROUNDED} FROM two"""
)
def q_resample_drop_incomplete(spark, sf_dir):
    return shown(B.resample(hours(spark, sf_dir), 2 * HOUR, HOUR), "symbol", "open_time", "close_time")


def _threshold(value: str, threshold: int) -> str:
    return f"""WITH {TICKS}, ids AS (SELECT *, CAST(floor(sum(CAST({value} AS DECIMAL(38,6))) OVER (PARTITION BY symbol ORDER BY transact_time, agg_trade_id ROWS UNBOUNDED PRECEDING) / {threshold}) AS BIGINT) AS bar_id FROM ticks),
    bars AS (SELECT symbol, bar_id, min(transact_time) AS open_time, max(transact_time) AS close_time, {OHLCV} FROM ids GROUP BY 1, 2)
    SELECT symbol, bar_id, open_time, close_time, {ROUNDED}, CAST({threshold} AS DOUBLE) AS threshold_quote FROM bars"""


@query(_threshold("price * quantity", 20000))
def q_dollar_bars(spark, sf_dir):
    df = B.dollar_bars(ticks(spark, sf_dir), 20000)
    return shown(df, "symbol", "bar_id", "open_time", "close_time", "threshold_quote")


@query(_threshold("quantity", 500))
def q_volume_bars(spark, sf_dir):
    df = B.volume_bars(ticks(spark, sf_dir), 500)
    return shown(df, "symbol", "bar_id", "open_time", "close_time", "threshold_quote")


@query(f"WITH {TICKS} SELECT symbol, round(sum(price * quantity), 4) + 0 AS total_quote, count(*) AS n_trades, round(sum(price * quantity) / 500, 4) + 0 AS threshold FROM ticks GROUP BY 1")
def q_bar_calibration(spark, sf_dir):
    df = B.calibrate(ticks(spark, sf_dir), 500)
    return df.select("symbol", r("total_quote", 4).alias("total_quote"), "n_trades", r("threshold", 4).alias("threshold"))


@query(
    f"""WITH {TICKS}, days AS (SELECT symbol, transact_time // 86400000 AS day, sum(price * quantity) AS quote FROM ticks GROUP BY 1, 2),
    t AS (SELECT symbol, day, quote, sum(quote) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) / 350 AS threshold FROM days)
    SELECT symbol, day, round(quote, 4) + 0 AS quote, round(threshold, 4) + 0 AS threshold FROM t WHERE threshold IS NOT NULL"""
)
def q_walkforward_threshold(spark, sf_dir):
    df = B.walkforward_thresholds(ticks(spark, sf_dir), 7, 50)
    return df.select("symbol", "day", r("quote", 4).alias("quote"), r("threshold", 4).alias("threshold"))


#: Trade by trade: the running value, its bucket and the open bar's value; a new period's threshold counts the open bar anew.
_WALK = f"""WITH RECURSIVE {TICKS}, days AS (SELECT symbol, transact_time // 86400000 AS day, sum(price * quantity) AS quote FROM ticks GROUP BY 1, 2),
    th AS (SELECT symbol, day, sum(quote) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) / 140 AS threshold FROM days), f AS (SELECT symbol, min(day) AS first FROM days GROUP BY 1),
    o AS (SELECT t.*, t.transact_time // 86400000 AS day, (t.transact_time // 86400000 - f.first) // 2 AS period FROM ticks t JOIN f ON f.symbol = t.symbol), st AS (SELECT symbol, period, min(day) AS day FROM o GROUP BY 1, 2),
    x AS (SELECT o.symbol, o.period, th.threshold, o.transact_time, o.agg_trade_id, o.price, o.quantity, o.price * o.quantity AS pq, row_number() OVER (PARTITION BY o.symbol ORDER BY o.transact_time, o.agg_trade_id) AS i
      FROM o JOIN st ON st.symbol = o.symbol AND st.period = o.period JOIN th ON th.symbol = o.symbol AND th.day = st.day WHERE th.threshold > 0),
    s AS (SELECT symbol, i, period, threshold, pq AS base, floor(pq / threshold) AS bucket, pq AS own, CAST(0 AS BIGINT) AS bar_id FROM x WHERE i = 1
    UNION ALL SELECT symbol, i, period, threshold, base, floor(base / threshold), CASE WHEN floor(base / threshold) <> held THEN pq ELSE own + pq END, bar_id + CASE WHEN floor(base / threshold) <> held THEN 1 ELSE 0 END FROM (
      SELECT x.symbol, x.i, x.period, x.threshold, x.pq, s.own, s.bar_id, CASE WHEN x.period <> s.period THEN s.own ELSE s.base END + x.pq AS base, CASE WHEN x.period <> s.period THEN floor(s.own / x.threshold) ELSE s.bucket END AS held FROM s JOIN x ON x.symbol = s.symbol AND x.i = s.i + 1)),
    b AS (SELECT x.symbol, s.bar_id, max(x.i) AS last, max(x.period) AS own_period, arg_max(x.threshold, x.i) AS own_threshold, min(transact_time) AS open_time, max(transact_time) AS close_time, arg_min(price, x.i) AS open, max(price) AS high, min(price) AS low, arg_max(price, x.i) AS close, CAST(sum(quantity) AS DOUBLE) AS volume, sum(pq) AS quote_volume, count(*) AS count FROM x JOIN s ON s.symbol = x.symbol AND s.i = x.i GROUP BY 1, 2)
    SELECT b.symbol, coalesce(n.period, own_period) AS period, bar_id, open_time, close_time, open, high, low, close, volume, round(quote_volume, 6) + 0 AS quote_volume, count, round(coalesce(n.threshold, own_threshold), 6) + 0 AS threshold_quote FROM b LEFT JOIN x n ON n.symbol = b.symbol AND n.i = b.last + 1"""


@query(_WALK)
def q_walkforward_bars(spark, sf_dir):
    from ..operators.walkforward import walkforward_bars

    df = walkforward_bars(ticks(spark, sf_dir), trailing_days=7, cadence_days=2, bars_per_day=20)
    return df.withColumns({c: r(c) for c in ("quote_volume", "threshold_quote")})


#: The recurrence trade by trade: mean sign, signed count, trades of the bar, expected length, whether the trade ends its bar.
_IMBALANCE = f"""WITH RECURSIVE {TICKS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY transact_time, agg_trade_id) AS i, CASE WHEN is_buyer_maker THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS b FROM ticks),
    s AS (SELECT symbol, i, b AS mean, b AS theta, 1::DOUBLE AS k, 6.0::DOUBLE AS len, 0::BIGINT AS bar_id, abs(b) >= 6.0 * greatest(abs(b), 1e-12) AS ends FROM t WHERE i = 1
    UNION ALL SELECT symbol, i, mean, theta, k, len, bar_id, abs(theta) >= len * greatest(abs(mean), 1e-12) FROM (
      SELECT t.symbol, t.i, 2.0::DOUBLE / 10 * t.b + (1 - 2.0::DOUBLE / 10) * s.mean AS mean, CASE WHEN s.ends THEN 0 ELSE s.theta END + t.b AS theta, CASE WHEN s.ends THEN 0 ELSE s.k END + 1 AS k,
        CASE WHEN s.ends THEN least(greatest(2.0::DOUBLE / 6 * s.k + (1 - 2.0::DOUBLE / 6) * s.len, 2.0), 200.0) ELSE s.len END AS len, s.bar_id + CASE WHEN s.ends THEN 1 ELSE 0 END AS bar_id
      FROM s JOIN t ON t.symbol = s.symbol AND t.i = s.i + 1)),
    bars AS (SELECT t.symbol, s.bar_id, min(transact_time) AS open_time, max(transact_time) AS close_time, {OHLCV} FROM t JOIN s ON s.symbol = t.symbol AND s.i = t.i GROUP BY 1, 2)
    SELECT symbol, bar_id, open_time, close_time, {ROUNDED}, CAST(NULL AS DOUBLE) AS threshold_quote FROM bars"""


@query(_IMBALANCE)
def q_tick_imbalance_bars(spark, sf_dir):
    df = B.tick_imbalance_bars(ticks(spark, sf_dir), B.ImbalanceRule(sign_span=9, length_span=5, initial_length=6.0, least=2.0, most=200.0))
    return shown(df.withColumns({c: F.col(c).cast("long") for c in ("volume", "taker_buy_volume")}), "symbol", "bar_id", "open_time", "close_time", "threshold_quote")


@query(
    f"""{HEAD}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol, close_time // 86400000 ORDER BY close_time DESC) AS n FROM bars)
    SELECT symbol, close_time // 86400000 AS day, open_time, close_time, round(close, 6) + 0 AS close FROM d WHERE n = 1"""
)
def q_dedupe_keep_last(spark, sf_dir):
    df = hours(spark, sf_dir).withColumn("day", F.expr("close_time div 86400000"))
    last = df.groupBy("symbol", "day").agg(F.max_by(F.struct("open_time", "close_time", "close"), "close_time").alias("x"))
    return last.select("symbol", "day", "x.open_time", "x.close_time", r("x.close").alias("close"))


@query(
    f"""WITH {TICKS}, s AS (SELECT *, sum(price * quantity) OVER (PARTITION BY symbol ORDER BY transact_time, agg_trade_id ROWS UNBOUNDED PRECEDING) AS c FROM ticks)
    SELECT symbol, agg_trade_id, round(c, 3) + 0 AS running FROM s"""
)
def q_running_quote(spark, sf_dir):
    df = B.running_sum(ticks(spark, sf_dir), F.col("price") * F.col("quantity"), ["symbol"], "transact_time", "agg_trade_id")
    return df.select("symbol", "agg_trade_id", r(F.col("cum").cast("double"), 3).alias("running"))


@query(
    f"""WITH {TICKS} SELECT symbol, transact_time // 900000 AS bucket, round(CAST(sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END) AS DOUBLE), 6) + 0 AS bought,
    round(CAST(sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS DOUBLE), 6) + 0 AS sold,
    round((sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE -quantity END)) / CAST(sum(quantity) AS DOUBLE), 6) + 0 AS imbalance FROM ticks GROUP BY 1, 2"""
)
def q_order_flow_imbalance(spark, sf_dir):
    taker = ~F.col("is_buyer_maker")
    bought, sold = F.sum(F.when(taker, F.col("quantity")).otherwise(0)), F.sum(F.when(~taker, F.col("quantity")).otherwise(0))
    df = ticks(spark, sf_dir).groupBy("symbol", F.expr("transact_time div 900000").alias("bucket")).agg(bought.alias("b"), sold.alias("s"))
    return df.select("symbol", "bucket", r(F.col("b").cast("double")).alias("bought"), r(F.col("s").cast("double")).alias("sold"), r((F.col("b") - F.col("s")) / (F.col("b") + F.col("s"))).alias("imbalance"))
