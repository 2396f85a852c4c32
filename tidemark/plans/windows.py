"""Causal windows over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import candles as K
from ..functions.semantics import average_rank, ln
from ..operators import windows as W
from .base import HEAD, TICKS, hours, pick, query, r, ticks

KEY = ("symbol", "open_time")
O = "(PARTITION BY symbol ORDER BY open_time)"  # noqa: E741


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(aggregate: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {aggregate} {over(n)} END"


def log(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


RET = f"{HEAD}, p AS (SELECT *, lag(close) OVER {O} AS pc FROM bars), ret AS (SELECT *, ({log('close')}) - ({log('pc')}) AS r1 FROM p)"


def rets(spark, sf_dir):
    return hours(spark, sf_dir).withColumns({"r1": W.log_return("close"), "pc": W.lagged("close", 1)})


@query(f"{HEAD}, l AS (SELECT *, lag(close, 4) OVER {O} AS c4, lead(close, 4) OVER {O} AS f4 FROM bars) SELECT symbol, open_time, round(({log('close')}) - ({log('c4')}), 6) + 0 AS ret_4, round(({log('f4')}) - ({log('close')}), 6) + 0 AS fwd_4 FROM l")
def q_log_return_n(spark, sf_dir):
    return pick(hours(spark, sf_dir), KEY, ret_4=W.log_return("close", 4), fwd_4=W.log_return("close", -4))


@query(f"{RET} SELECT symbol, open_time, round({full('stddev_samp(r1)', 'r1', 24)}, 6) + 0 AS vol_24, round({full('avg(volume)', 'volume', 24)}, 6) + 0 AS mean_volume, round({full('min(low)', 'low', 24)}, 6) + 0 AS low_24, round({full('max(high)', 'high', 24)}, 6) + 0 AS high_24, round({full('sum(quote_volume)', 'quote_volume', 24)}, 4) + 0 AS quote_24 FROM ret")
def q_rolling_stats(spark, sf_dir):
    df = rets(spark, sf_dir)
    return df.select(
        *KEY, r(W.rolling(F.stddev_samp("r1"), "r1", 24)).alias("vol_24"), r(W.rolling(F.avg("volume"), "volume", 24)).alias("mean_volume"), r(W.rolling(F.min("low"), "low", 24)).alias("low_24"),
        r(W.rolling(F.max("high"), "high", 24)).alias("high_24"), r(W.rolling(F.sum("quote_volume"), "quote_volume", 24), 4).alias("quote_24"),
    )


@query(f"{HEAD}, z AS (SELECT symbol, open_time, close, {full('avg(close)', 'close', 48)} AS m, {full('stddev_samp(close)', 'close', 48)} AS s FROM bars) SELECT symbol, open_time, round(CASE WHEN s > 0 THEN (close - m) / s END, 6) + 0 AS z FROM z")
def q_rolling_zscore(spark, sf_dir):
    return pick(hours(spark, sf_dir), KEY, z=W.rolling_zscore("close", 48))


@query(f"{RET}, t AS (SELECT *, CASE WHEN low > 0 THEN power(ln(high / low), 2) / (4 * ln(2)) END AS pk, CASE WHEN low > 0 AND open > 0 AND close > 0 THEN 0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2) END AS gk, CASE WHEN low > 0 AND open > 0 AND close > 0 THEN ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) END AS rs FROM ret), m AS (SELECT symbol, open_time, {full('avg(pk)', 'pk', 24)} AS pk, {full('avg(gk)', 'gk', 24)} AS gk, {full('avg(rs)', 'rs', 24)} AS rs FROM t) SELECT symbol, open_time, round(CASE WHEN pk >= 0 THEN sqrt(greatest(pk, 0)) END, 6) + 0 AS parkinson, round(CASE WHEN gk >= 0 THEN sqrt(greatest(gk, 0)) END, 6) + 0 AS garman_klass, round(CASE WHEN rs >= 0 THEN sqrt(greatest(rs, 0)) END, 6) + 0 AS rogers_satchell FROM m")
def q_range_volatility(spark, sf_dir):
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = hours(spark, sf_dir).withColumns({"pk": K.parkinson_term(h, low), "gk": K.garman_klass_term(o, h, low, c), "rs": K.rogers_satchell_term(o, h, low, c)})
    return pick(df, KEY, parkinson=W.volatility("pk", 24), garman_klass=W.volatility("gk", 24), rogers_satchell=W.volatility("rs", 24))


_K = 0.34 / (1.34 + 25 / 23)


@query(f"{HEAD}, p AS (SELECT *, lag(close) OVER {O} AS pc FROM bars), t AS (SELECT *, ({log('open')}) - ({log('pc')}) AS vo, ({log('close')}) - ({log('open')}) AS vc, CASE WHEN low > 0 AND open > 0 AND close > 0 THEN ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) END AS rs FROM p), m AS (SELECT symbol, open_time, ({full('var_samp(vo)', 'vo', 24)}) + {_K!r} * ({full('var_samp(vc)', 'vc', 24)}) + (1 - {_K!r}) * ({full('avg(rs)', 'rs', 24)}) AS v FROM t) SELECT symbol, open_time, round(CASE WHEN v >= 0 THEN sqrt(greatest(v, 0)) END, 6) + 0 AS yang_zhang FROM m")
def q_yang_zhang(spark, sf_dir):
    return pick(W.yang_zhang(hours(spark, sf_dir), 24), KEY, yang_zhang="yang_zhang")


@query(f"{HEAD}, d AS (SELECT *, abs(close - lag(close) OVER {O}) AS st, abs(close - lag(close, 24) OVER {O}) AS net FROM bars), e AS (SELECT symbol, open_time, net, {full('sum(st)', 'st', 24)} AS path FROM d) SELECT symbol, open_time, round(CASE WHEN path > 0 THEN net / path END, 6) + 0 AS er FROM e")
def q_efficiency_ratio(spark, sf_dir):
    step, ratio = W.efficiency_ratio("close", 24)
    return pick(hours(spark, sf_dir).withColumn("_step", step), KEY, er=ratio)


@query(f"{HEAD}, e AS (SELECT symbol, open_time, close, {full('max(high)', 'high', 14)} AS h, {full('min(low)', 'low', 14)} AS l FROM bars) SELECT symbol, open_time, round(CASE WHEN h IS NOT NULL THEN CASE WHEN h > l THEN 100 * (close - l) / (h - l) ELSE 50.0 END END, 6) + 0 AS k FROM e")
def q_stoch_k(spark, sf_dir):
    return pick(hours(spark, sf_dir), KEY, k=W.stochastic("close", "high", "low", 14))


@query(f"{HEAD} SELECT symbol, open_time, round(CASE WHEN count(close) {over(24)} = 24 AND stddev_pop(close) {over(24)} > 0 AND stddev_pop(volume) {over(24)} > 0 THEN (avg(close * volume) {over(24)} - avg(close) {over(24)} * avg(volume) {over(24)}) / (stddev_pop(close) {over(24)} * stddev_pop(volume) {over(24)}) END, 6) + 0 AS corr FROM bars")
def q_rolling_corr(spark, sf_dir):
    return pick(hours(spark, sf_dir), KEY, corr=W.rolling_corr("close", "volume", 24))


@query(f"{HEAD} SELECT symbol, open_time, round(CASE WHEN count(volume) {over(24)} = 24 THEN median(volume) {over(24)} END, 6) + 0 AS median_24 FROM bars")
def q_rolling_median(spark, sf_dir):
    return pick(hours(spark, sf_dir), KEY, median_24=W.rolling_median("volume", 24))


@query(f"{HEAD}, v AS (SELECT symbol, open_time, sum((high + low + close) / 3 * volume) OVER w AS a, sum(volume) OVER w AS b FROM bars WINDOW w AS (PARTITION BY symbol, close_time // 86400000 ORDER BY close_time ROWS UNBOUNDED PRECEDING)) SELECT symbol, open_time, round(CASE WHEN b > 0 THEN a / b END, 6) + 0 AS vwap FROM v")
def q_vwap_day_reset(spark, sf_dir):
    return pick(W.day_vwap_distance(hours(spark, sf_dir)), KEY, vwap="vwap")


@query(f"{HEAD}, e AS (SELECT symbol, open_time, close, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT symbol, open_time, round(CASE WHEN n >= 2 AND s > 0 THEN (close - m) / s END, 6) + 0 AS z FROM e")
def q_expanding_zscore_strict(spark, sf_dir):
    return pick(hours(spark, sf_dir), KEY, z=W.expanding_zscore("close"))


def _means(spans) -> str:
    return ", ".join(f"round(avg(r1 * r1) OVER (PARTITION BY symbol ORDER BY close_time RANGE BETWEEN {ms} PRECEDING AND 1 PRECEDING), 6) + 0 AS {name}" for name, ms in spans.items())


SPANS = {"har_day": 86_400_000, "har_week": 604_800_000, "har_month": 2_592_000_000}


@query(f"{RET} SELECT symbol, open_time, {_means(SPANS)} FROM ret")
def q_har_time_range_mean(spark, sf_dir):
    df = rets(spark, sf_dir).withColumn("rv", F.col("r1") * F.col("r1"))
    return df.select(*KEY, *[r(W.time_mean("rv", "close_time", ms)).alias(name) for name, ms in SPANS.items()])


@query(f"{HEAD} SELECT symbol, open_time, round((rank() OVER (PARTITION BY symbol ORDER BY count) + (count(*) OVER (PARTITION BY symbol, count) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol), 6) + 0 AS pct FROM bars")
def q_avg_rank_over_group(spark, sf_dir):
    from pyspark.sql import Window

    return pick(hours(spark, sf_dir), KEY, pct=average_rank(["symbol"], "count") / F.count(F.lit(1)).over(Window.partitionBy("symbol")))


@query(f"{RET}, s AS (SELECT *, CAST(sign(coalesce(r1, 0)) AS INT) AS s FROM ret), c AS (SELECT *, CASE WHEN lag(s) OVER {O} IS NOT DISTINCT FROM s AND row_number() OVER {O} > 1 THEN 0 ELSE 1 END AS nw FROM s), g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment FROM c) SELECT symbol, open_time, segment, row_number() OVER (PARTITION BY symbol, segment ORDER BY open_time) AS run_length, round(avg(volume) OVER (PARTITION BY symbol, segment ORDER BY open_time ROWS UNBOUNDED PRECEDING), 6) + 0 AS mean_volume FROM g")
def q_run_length_islands(spark, sf_dir):
    df = rets(spark, sf_dir).withColumn("s", F.signum(F.coalesce("r1", F.lit(0.0))).cast("int"))
    df = W.islands(df, "s")
    return df.select(*KEY, "segment", "run_length", r(W.segment_mean(df, "volume")).alias("mean_volume"))


@query(f"""{HEAD} SELECT symbol, open_time, (close_time % 86400000) // 3600000 AS hour, (close_time // 86400000) % 7 AS dow, (close_time // 86400000) % 7 IN (2, 3) AS weekend,
(close_time % 86400000) // 3600000 >= 8 AND (close_time % 86400000) // 3600000 < 16 AS session, round(((28800000 - close_time % 28800000) % 28800000) / 3600000.0, 6) + 0 AS to_funding,
round(sin(((close_time % 86400000) // 3600000) * (2 * pi() / 24)), 6) + 0 AS hour_sin, round(cos(((close_time % 86400000) // 3600000) * (2 * pi() / 24)), 6) + 0 AS hour_cos,
CAST(year(epoch_ms(close_time)) * 4 + quarter(epoch_ms(close_time)) AS BIGINT) AS quarter, CAST(year(epoch_ms(close_time)) * 2 + CASE WHEN month(epoch_ms(close_time)) > 6 THEN 1 ELSE 0 END AS BIGINT) AS semester FROM bars""")
def q_calendar_features(spark, sf_dir):
    ms = F.col("close_time")
    ts = F.timestamp_millis(ms)
    s, c = K.cycle(K.hour_of_day(ms), 24)
    return hours(spark, sf_dir).select(
        *KEY, K.hour_of_day(ms).alias("hour"), K.day_of_week(ms).alias("dow"), K.is_weekend(ms).alias("weekend"), K.in_session(ms, 8, 16).alias("session"), r(K.hours_to_boundary(ms, 8)).alias("to_funding"), r(s).alias("hour_sin"), r(c).alias("hour_cos"),
        (F.year(ts) * 4 + F.quarter(ts)).cast("long").alias("quarter"), (F.year(ts) * 2 + F.when(F.month(ts) > 6, 1).otherwise(0)).cast("long").alias("semester"),
    )


def _shape(expression: str, default: str = "0.0") -> str:
    return f"round(CASE WHEN high <> low THEN ({expression}) / (high - low) ELSE {default} END, 6) + 0"


@query(f"{HEAD}, p AS (SELECT *, lag(close) OVER {O} AS pc FROM bars) SELECT symbol, open_time, {_shape('abs(close - open)')} AS body, {_shape('high - greatest(open, close)')} AS upper, {_shape('least(open, close) - low')} AS lower, {_shape('close - low', '0.5')} AS place, round(CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END, 6) + 0 AS tr, round(CASE WHEN volume <> 0 THEN 2 * taker_buy_volume / CAST(volume AS DOUBLE) - 1 END, 6) + 0 AS taker FROM p")
def q_candle_shapes(spark, sf_dir):
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return pick(hours(spark, sf_dir).withColumn("pc", W.lagged("close", 1)), KEY, body=K.body_ratio(o, h, low, c), upper=K.upper_wick_ratio(o, h, low, c), lower=K.lower_wick_ratio(o, h, low, c), place=K.close_place(h, low, c), tr=K.true_range(h, low, F.col("pc")), taker=K.taker_imbalance(F.col("taker_buy_volume"), F.col("volume")))


def _recursive(alpha: float, value: str = "close") -> str:
    return f"""WITH RECURSIVE {TICKS}, {HEAD.split(TICKS + ', ')[1]}, n AS (SELECT symbol, open_time, {value} AS x, row_number() OVER {O} AS i FROM bars),
    e AS (SELECT symbol, open_time, i, x AS v FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.open_time, n.i, {alpha!r} * n.x + {1 - alpha!r} * e.v FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


@query(f"{_recursive(2 / 13)} SELECT symbol, open_time, round(CASE WHEN i >= 12 THEN v END, 6) + 0 AS ema FROM e")
def q_ema(spark, sf_dir):
    return pick(W.ema(hours(spark, sf_dir), "close", 12), KEY, ema="ema")


_TR = f"tr AS (SELECT symbol, open_time, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS x, row_number() OVER {O} AS i FROM (SELECT *, lag(close) OVER {O} AS pc FROM bars))"
_WILDER = f"WITH RECURSIVE {TICKS}, {HEAD.split(TICKS + ', ')[1]}, {_TR}, e AS (SELECT symbol, 14 AS i, avg(x) AS v FROM tr WHERE i <= 14 GROUP BY 1 HAVING count(*) = 14 UNION ALL SELECT tr.symbol, tr.i, (e.v * 13 + tr.x) / 14 FROM e JOIN tr ON tr.symbol = e.symbol AND tr.i = e.i + 1)"


@query(f"{_WILDER} SELECT tr.symbol, tr.open_time, round(e.v, 6) + 0 AS atr FROM tr LEFT JOIN e ON tr.symbol = e.symbol AND tr.i = e.i")
def q_wilder_atr(spark, sf_dir):
    return pick(W.atr(hours(spark, sf_dir), 14), KEY, atr="atr")


_CH = f"ch AS (SELECT symbol, open_time, close - lag(close) OVER {O} AS d, row_number() OVER {O} - 1 AS i FROM bars)"


@query(f"""WITH RECURSIVE {TICKS}, {HEAD.split(TICKS + ', ')[1]}, {_CH}, e AS (SELECT symbol, CAST(14 AS BIGINT) AS i, avg(greatest(d, 0)) AS u, avg(greatest(-d, 0)) AS w FROM ch WHERE i BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14
UNION ALL SELECT ch.symbol, ch.i, (e.u * 13 + greatest(ch.d, 0)) / 14, (e.w * 13 + greatest(-ch.d, 0)) / 14 FROM e JOIN ch ON ch.symbol = e.symbol AND ch.i = e.i + 1)
SELECT ch.symbol, ch.open_time, round(CASE WHEN w > 0 THEN 100 - 100 / (1 + u / w) WHEN u > 0 THEN 100 WHEN u = 0 THEN 50 END, 5) + 0 AS rsi FROM ch LEFT JOIN e ON ch.symbol = e.symbol AND ch.i = e.i""")
def q_rsi(spark, sf_dir):
    return W.rsi(hours(spark, sf_dir), 14).select(*KEY, r("rsi", 5).alias("rsi"))


def _ema_sql(name: str, of: str, x: str, span: int) -> str:
    """name(symbol, i, k, v): the recurrence over the rows of ``of`` where x is known, numbered anew as k."""
    a = 2 / (span + 1)
    return f"""{name}_k AS (SELECT symbol, i, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM {of} WHERE {x} IS NOT NULL),
    {name} AS (SELECT symbol, i, k, x AS v FROM {name}_k WHERE k = 1 UNION ALL SELECT n.symbol, n.i, n.k, {a!r} * n.x + {1 - a!r} * e.v FROM {name} e JOIN {name}_k n ON n.symbol = e.symbol AND n.k = e.k + 1)"""


@query(
    f"""WITH RECURSIVE {TICKS}, {HEAD.split(TICKS + ', ')[1]}, b AS (SELECT symbol, open_time, close, row_number() OVER {O} AS i FROM bars), {_ema_sql('fast', 'b', 'close', 12)}, {_ema_sql('slow', 'b', 'close', 26)},
    line AS (SELECT b.symbol, b.open_time, b.i, CASE WHEN f.k >= 12 AND s.k >= 26 THEN f.v - s.v END AS macd FROM b LEFT JOIN fast f ON f.symbol = b.symbol AND f.i = b.i LEFT JOIN slow s ON s.symbol = b.symbol AND s.i = b.i), {_ema_sql('sig', 'line', 'macd', 9)}
    SELECT l.symbol, l.open_time, round(macd, 6) + 0 AS macd, round(CASE WHEN g.k >= 9 THEN g.v END, 6) + 0 AS signal, round(macd - CASE WHEN g.k >= 9 THEN g.v END, 6) + 0 AS histogram FROM line l LEFT JOIN sig g ON g.symbol = l.symbol AND g.i = l.i"""
)
def q_macd_hist(spark, sf_dir):
    return pick(W.macd_histogram(hours(spark, sf_dir)), KEY, macd="macd", signal="signal", histogram="histogram")


def _ranked(where: str) -> str:
    return f"{HEAD}, n AS (SELECT symbol, open_time, close_time, close, row_number() OVER {O} AS i FROM bars), k AS (SELECT a.symbol, a.open_time, count(b.i) AS n, count(CASE WHEN b.close <= a.close THEN 1 END) AS le FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.i < a.i {where} GROUP BY 1, 2) SELECT symbol, open_time, round(CASE WHEN n > 0 THEN le / CAST(n AS DOUBLE) END, 6) + 0 AS rank FROM k"


@query(_ranked(""))
def q_pct_rank_expanding(spark, sf_dir):
    return pick(W.percentile_rank(hours(spark, sf_dir), "close"), KEY, rank="rank")


@query(_ranked("AND b.i >= a.i - 48"))
def q_pct_rank_rolling(spark, sf_dir):
    return pick(W.percentile_rank(hours(spark, sf_dir), "close", last=48), KEY, rank="rank")


@query(_ranked("AND a.close_time - b.close_time <= 86400000"))
def q_pct_rank_by_time(spark, sf_dir):
    return pick(W.percentile_rank(hours(spark, sf_dir), "close", time="close_time", window_ms=86_400_000), KEY, rank="rank")


@query(f"""{HEAD}, b AS (SELECT *, open_time // 28800000 AS ep FROM bars), f AS (SELECT *, CASE WHEN lag(ep) OVER {O} IS DISTINCT FROM ep THEN 1 ELSE 0 END AS bg FROM b),
n AS (SELECT *, sum(bg) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS no FROM f),
t AS (SELECT symbol, no, CASE WHEN count(close) OVER w = 9 THEN sum(close) OVER w END AS total FROM n WHERE bg = 1 WINDOW w AS (PARTITION BY symbol ORDER BY no ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
SELECT n.symbol, n.open_time, round(t.total, 6) + 0 AS total FROM n LEFT JOIN t ON n.symbol = t.symbol AND n.no = t.no""")
def q_funding_last_n(spark, sf_dir):
    df = hours(spark, sf_dir).withColumn("ep", F.expr("open_time div 28800000"))
    return pick(W.last_epochs_sum(df, "close", "ep", 9), KEY, total="total")


@query(f"""{RET}, s AS (SELECT symbol, open_time, CAST(sign(coalesce(r1, 0)) AS INT) AS s FROM ret), w AS (SELECT *, lag(s) OVER {O} AS b, list(s) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a FROM s)
SELECT symbol, open_time, list_contains(a, b) AS failed FROM w WHERE b IS NOT NULL AND b <> s AND len(a) = 4""")
def q_transition_failures(spark, sf_dir):
    df = rets(spark, sf_dir).withColumn("s", F.signum(F.coalesce("r1", F.lit(0.0))).cast("int"))
    return W.transition_failures(df, "s", 4).select(*KEY, "failed")


@query(f"""{HEAD}, e AS (SELECT symbol, min(open_time) AS lo, max(open_time) AS hi FROM bars GROUP BY 1), r AS (SELECT b.symbol, b.open_time, lo + (b.open_time - lo + 90000000) % greatest(hi - lo, 1) AS at FROM bars b JOIN e ON b.symbol = e.symbol)
SELECT r.symbol, r.open_time, round(x.close, 6) + 0 AS shifted FROM r ASOF LEFT JOIN bars x ON r.symbol = x.symbol AND r.at >= x.open_time""")
def q_circular_shift(spark, sf_dir):
    return pick(W.circular_shift(hours(spark, sf_dir), "close", "open_time", 90_000_000), KEY, shifted="shifted")


@query(f"{HEAD}, n AS (SELECT symbol, open_time, close, row_number() OVER {O} AS i FROM bars) SELECT symbol, open_time, CASE WHEN i > 50 THEN round(close, 6) + 0 END AS masked FROM n")
def q_warmup_mask(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("symbol").orderBy("open_time"))
    return hours(spark, sf_dir).select(*KEY, F.when(n > 50, r("close")).alias("masked"))


@query(f"WITH {TICKS}, g AS (SELECT symbol, transact_time - lag(transact_time) OVER (PARTITION BY symbol ORDER BY transact_time, agg_trade_id) AS gap FROM ticks) SELECT symbol, count(CASE WHEN gap <= 0 THEN 1 END) AS not_increasing, count(CASE WHEN gap > 3600000 THEN 1 END) AS long_gaps, max(gap) AS longest FROM g GROUP BY 1")
def q_monotonic_and_gaps(spark, sf_dir):
    from pyspark.sql import Window

    gap = F.col("transact_time") - F.lag("transact_time").over(Window.partitionBy("symbol").orderBy("transact_time", "agg_trade_id"))
    return ticks(spark, sf_dir).withColumn("gap", gap).groupBy("symbol").agg(F.count_if(F.col("gap") <= 0).alias("not_increasing"), F.count_if(F.col("gap") > 3_600_000).alias("long_gaps"), F.max("gap").alias("longest"))


@query(f"{HEAD}, l AS (SELECT symbol, open_time, ({log('volume')}) - ({log(f'lag(volume, 4) OVER {O}')}) AS d FROM (SELECT symbol, open_time, CAST(volume AS DOUBLE) AS volume FROM bars)), z AS (SELECT symbol, open_time, d, {full('avg(d)', 'd', 24)} AS m, {full('stddev_samp(d)', 'd', 24)} AS s FROM l) SELECT symbol, open_time, round(CASE WHEN s > 0 THEN (d - m) / s END, 6) + 0 AS z FROM z")
def q_log_change_zscore(spark, sf_dir):
    df = hours(spark, sf_dir).withColumn("d", ln(F.col("volume").cast("double")) - ln(W.lagged("volume", 4).cast("double")))
    return pick(df, KEY, z=W.rolling_zscore("d", 24))
