"""The catalogue of bar features by id: price (A), momentum (B), volatility (C), flow (D), funding and positioning (E), calendar (K).

``catalogue`` takes bars with what is aligned to them (see ``align``) and gives the wanted
ids. All recurrences and strictly-past ranks of a symbol come from one grouped kernel; the
rest are windows that share one partitioning. Missing inputs give null features.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import candles as K
from ..functions.costs import round_trip_bps
from ..functions.semantics import ln, ratio
from . import windows as W
from .asof import asof
from .features import Feature, ordered

c = F.col
DAY_MS = 86_400_000
#: Columns that other sources bring to a bar; null where there is none.
ALIGNED = ("funding_last", "oi_contracts", "oi_notional", "oi_log_change", "toptrader_ls", "toptrader_ls_count", "global_ls", "taker_ls_vol", "taker_1m", "threshold_quote")


def _log_change(x: str, n: int):
    return ln(c(x)) - ln(W.lagged(x, n))


def _z(x: str, n: int, *needs: str) -> Feature:
    return Feature(lambda: W.rolling_zscore(x, n), needs or (x,), n)


def _strict(x: str, *needs: str) -> Feature:
    return Feature(lambda: W.expanding_zscore(x), needs or (x,), 2)


def _realised(n: int):
    return W.rolling(F.stddev_samp("A01_log_return_1"), "A01_log_return_1", n) * F.lit(float(n) ** 0.5)


def _efficiency(n: int) -> Feature:
    return Feature(lambda: ratio(F.abs(c("close") - W.lagged("close", n)), W.rolling(F.sum("_step"), "_step", n)), ("_step",), n + 1)


def _of_atr(x, *needs: str) -> Feature:
    return Feature(lambda: ratio(x(), c("C01_atr_20")), needs, 20)


_duration = lambda: (c("close_time") - c("open_time")) / 1000
_body = lambda: c("close") - c("open")
_session = lambda a, b: K.in_session(c("close_time"), a, b).cast("double")

#: Made by the kernel from columns of the bar.
KERNEL = ("_ema_12", "_ema_24", "_ema_48", "_macd", "_macd_signal", "_rsi_14", "_rsi_48", "C01_atr_20")
#: Strictly-past ranks, made by a second kernel: name, column, window in ms or None for all.
RANKS = {"C07_vol_pctile_expanding": ("C03_realized_vol_48", None), "C08_vol_pctile_rolling_1y": ("C03_realized_vol_48", 365 * DAY_MS), "C09_range_pctile_expanding": ("A11_true_range_pct", None), "_ratio_rank": ("C06_vol_ratio_12_96", None)}

CATALOGUE: dict[str, Feature] = {
    **{f"A0{i}_log_return_{n}": Feature(lambda n=n: W.log_return("close", n), (), n) for i, n in ((1, 1), (2, 2), (3, 4), (4, 12))},
    "A16_return_3": Feature(lambda: W.log_return("close", 3), (), 3),
    "C02_atr_20_pct": Feature(lambda: ratio(c("C01_atr_20"), c("close")), (), 20),
    "A05_ret_vol_norm_4": Feature(lambda: ratio(c("A03_log_return_4"), c("C02_atr_20_pct") * 2), ("A03_log_return_4", "C02_atr_20_pct"), 20),
    "A06_ret_vol_norm_12": Feature(lambda: ratio(c("A04_log_return_12"), c("C02_atr_20_pct") * F.lit(3.0**0.5) * 2), ("A04_log_return_12", "C02_atr_20_pct"), 20),
    "A07_body_ratio": Feature(lambda: K.body_ratio(c("open"), c("high"), c("low"), c("close"))),
    "A08_upper_wick_ratio": Feature(lambda: K.upper_wick_ratio(c("open"), c("high"), c("low"), c("close"))),
    "A09_lower_wick_ratio": Feature(lambda: K.lower_wick_ratio(c("open"), c("high"), c("low"), c("close"))),
    "A10_close_location": Feature(lambda: K.close_place(c("high"), c("low"), c("close"))),
    "_tr": Feature(lambda: K.true_range(c("high"), c("low"), W.lagged("close", 1))),
    "A11_true_range_pct": Feature(lambda: ratio(F.when(W.lagged("close", 1).isNotNull(), c("_tr")), W.lagged("close", 1)), ("_tr",), 1),
    "A13_dist_ema48_atr": _of_atr(lambda: c("close") - c("_ema_48")),
    "A14_dist_ema12_atr": _of_atr(lambda: c("close") - c("_ema_12")),
    "A15_dist_vwap_d_atr": _of_atr(lambda: c("close") - c("_vwap")),
    "A17_log_tr_per_overshoot_ratio": Feature(lambda: F.log1p(ratio(c("A11_true_range_pct"), ratio(c("quote_volume") - c("threshold_quote"), c("threshold_quote")))), ("A11_true_range_pct",), 1),
    "A18_body_log": Feature(lambda: ln(c("close")) - ln(c("open"))),
    "A19_log_range": Feature(lambda: ln(c("high")) - ln(c("low"))),
    "A20_log_duration": Feature(lambda: F.log1p(_duration())),
    "A21_log_dollar_velocity": Feature(lambda: F.log1p(ratio(c("quote_volume"), _duration()))),
    "B01_rsi_14": Feature(lambda: (c("_rsi_14") - 50) / 50, (), 14),
    "B02_rsi_48": Feature(lambda: (c("_rsi_48") - 50) / 50, (), 48),
    "B03_roc_12": Feature(lambda: ratio(c("close") - W.lagged("close", 12), W.lagged("close", 12)), (), 12),
    "B04_macd_hist_norm": _of_atr(lambda: c("_macd") - c("_macd_signal")),
    "B05_ema_slope_24": _of_atr(lambda: c("_ema_24") - W.lagged("_ema_24", 6)),
    "B06_momentum_accel": Feature(lambda: ratio(c("A03_log_return_4") - W.lagged("A03_log_return_4", 4), c("C02_atr_20_pct")), ("A03_log_return_4", "C02_atr_20_pct"), 20),
    "_step": Feature(lambda: F.abs(c("close") - W.lagged("close", 1)), (), 1),
    "B07_efficiency_ratio_48": _efficiency(48), "B08_efficiency_ratio_16": _efficiency(16), "B15_efficiency_ratio_h3": _efficiency(3),
    "B09_zscore_close_48": Feature(lambda: W.rolling_zscore("close", 48), (), 48),
    "B10_stoch_k_14": Feature(lambda: W.stochastic("close", "high", "low", 14), (), 14),
    "B11_bb_position_20": Feature(lambda: W.rolling_zscore("close", 20) / 2, (), 20),
    "B12_close_location_h3": Feature(lambda: W.stochastic("close", "high", "low", 3) / 50 - 1, (), 3),
    "B13_extension_h3": Feature(lambda: ratio(F.abs("A16_return_3"), _realised(3)), ("A16_return_3", "A01_log_return_1"), 4),
    "B14_rejection_after_extension": Feature(lambda: ratio(-F.signum(W.lagged("A16_return_3", 1)) * c("A01_log_return_1"), c("C02_atr_20_pct")), ("A16_return_3", "A01_log_return_1", "C02_atr_20_pct"), 20),
    "B16_log_range_ratio_1": Feature(lambda: ln(c("high") - c("low")) - ln(W.lagged("high", 1) - W.lagged("low", 1)), (), 1),
    "_body": Feature(_body), "_body_size": Feature(lambda: F.abs(_body())),
    "B17_directional_pressure_h3": Feature(lambda: ratio(W.rolling(F.sum("_body"), "_body", 3), W.rolling(F.sum("_body_size"), "_body_size", 3)), ("_body", "_body_size"), 3),
    "_body_atr": _of_atr(_body),
    "B18_engulfing_atr": Feature(lambda: -F.signum(W.lagged("_body_atr", 1)) * c("_body_atr"), ("_body_atr",), 21),
    "_rv_12": Feature(lambda: W.rolling(F.stddev_samp("A01_log_return_1"), "A01_log_return_1", 12), ("A01_log_return_1",), 13),
    "C03_realized_vol_48": Feature(lambda: _realised(48), ("A01_log_return_1",), 49),
    "_pk": Feature(lambda: K.parkinson_term(c("high"), c("low"))), "_gk": Feature(lambda: K.garman_klass_term(c("open"), c("high"), c("low"), c("close"))),
    "C04_parkinson_vol_48": Feature(lambda: W.volatility("_pk", 48) * F.lit(48.0**0.5), ("_pk",), 48),
    "C05_garman_klass_48": Feature(lambda: W.volatility("_gk", 48) * F.lit(48.0**0.5), ("_gk",), 48),
    "C06_vol_ratio_12_96": Feature(lambda: ratio(c("_rv_12") * F.lit(12.0**0.5), _realised(96)), ("_rv_12",), 97),
    "C10_vol_expansion_flag": Feature(lambda: F.when(c("_ratio_rank").isNotNull(), (c("_ratio_rank") > 0.80).cast("double"))),
    "C11_vol_compression_flag": Feature(lambda: F.when(c("_ratio_rank").isNotNull(), (c("_ratio_rank") < 0.20).cast("double"))),
    "C12_vol_of_vol_48": Feature(lambda: W.rolling(F.stddev_samp("_rv_12"), "_rv_12", 48) * F.lit(12.0**0.5), ("_rv_12",), 61),
    "D01f_volume_z_96": Feature(lambda: W.rolling_zscore("volume", 96), (), 96),
    "D02f_rel_volume_48": Feature(lambda: ratio(c("volume"), W.rolling_median("volume", 48)), (), 48),
    "_log_volume": Feature(lambda: F.log1p(c("volume").cast("double"))),
    "D03f_volume_z_expanding": _strict("_log_volume"),
    "_rel_4": Feature(lambda: ratio(c("volume"), W.rolling_median("volume", 4)), (), 4),
    "D04f_volume_accel": Feature(lambda: c("_rel_4") - W.lagged("_rel_4", 4), ("_rel_4",), 8),
    "D05f_taker_buy_ratio": Feature(lambda: ratio(c("taker_buy_volume"), c("volume"))),
    "_taker": Feature(lambda: K.taker_imbalance(c("taker_buy_volume"), c("volume"))),
    "D06f_taker_imbalance_z_48": _z("_taker", 48),
    "D07f_taker_imbalance_1m_agg": Feature(lambda: c("taker_1m")),
    "_count": Feature(lambda: c("count").cast("double")), "D08f_trade_count_z_48": _z("_count", 48),
    "_size": Feature(lambda: ratio(c("volume"), c("count"))), "D09f_avg_trade_size_z": _z("_size", 48),
    "_move": Feature(lambda: F.abs("A01_log_return_1"), ("A01_log_return_1",), 1), "_volume_z": Feature(lambda: W.rolling_zscore("volume", 48), (), 48),
    "D10f_vol_price_divergence": Feature(lambda: W.rolling_corr("_move", "_volume_z", 48), ("_move", "_volume_z"), 96),
    "E01f_funding_last": Feature(lambda: c("funding_last")), "E02f_funding_z_expanding": Feature(lambda: W.expanding_zscore("funding_last"), (), 2),
    "E03f_funding_cum_3d": Feature(lambda: c("_funding_9")),
    "E05f_time_to_funding_h": Feature(lambda: K.hours_to_boundary(c("close_time"), 8)),
    "E08f_oi_notional": Feature(lambda: c("oi_notional")), "E09f_oi_contracts": Feature(lambda: c("oi_contracts")),
    "E10f_oi_change_z_48": Feature(lambda: W.rolling_zscore("oi_log_change", 48), (), 48),
    "_oi_48": Feature(lambda: _log_change("oi_contracts", 48), (), 48), "_oi_12": Feature(lambda: _log_change("oi_contracts", 12), (), 12),
    "E11f_oi_change_1d": _z("_oi_48", 48),
    "E12f_price_oi_divergence": Feature(lambda: F.signum("A04_log_return_12") * F.signum("_oi_12"), ("A04_log_return_12", "_oi_12"), 12),
    "E14f_toptrader_ls_ratio": Feature(lambda: c("toptrader_ls")), "E15f_toptrader_ls_z": Feature(lambda: W.expanding_zscore("toptrader_ls"), (), 2),
    "E16f_global_ls_ratio": Feature(lambda: c("global_ls")), "E17f_retail_vs_top_spread": Feature(lambda: W.expanding_zscore("global_ls") - W.expanding_zscore("toptrader_ls"), (), 2),
    "E18f_taker_ls_vol_ratio": Feature(lambda: c("taker_ls_vol")), "E21f_toptrader_ls_ratio_count": Feature(lambda: c("toptrader_ls_count")),
    "E27f_cost_atr_ratio": Feature(lambda: ratio(round_trip_bps(0.0002, 0.0005, 0.5), c("C02_atr_20_pct") * 10_000), ("C02_atr_20_pct",), 20),
    "K01_hour_sin": Feature(lambda: K.cycle(K.hour_of_day(c("close_time")), 24)[0]), "K01_hour_cos": Feature(lambda: K.cycle(K.hour_of_day(c("close_time")), 24)[1]),
    "K02_dow_sin": Feature(lambda: K.cycle(K.day_of_week(c("close_time")), 7)[0]), "K02_dow_cos": Feature(lambda: K.cycle(K.day_of_week(c("close_time")), 7)[1]),
    "K03_is_weekend": Feature(lambda: K.is_weekend(c("close_time")).cast("double")),
    "K04_session_asia": Feature(lambda: _session(0, 8)), "K04_session_europe": Feature(lambda: _session(8, 16)), "K04_session_us": Feature(lambda: _session(16, 24)),
}
#: All ids, without the helpers (which begin with an underscore); some come from the kernels.
IDS = tuple(sorted([*(k for k in CATALOGUE if k[0] != "_"), "C01_atr_20", *(k for k in RANKS if k[0] != "_")]))


def align(bars: DataFrame, funding: DataFrame | None = None, metrics: DataFrame | None = None, minutes: DataFrame | None = None, step_ms: int = 900_000) -> DataFrame:
    """bars with the columns of ALIGNED: the last known funding rate (calc_time, last_funding_rate) and metrics row (t, sum_open_interest, ...)
    at or before the close, the metrics' own log change, and the mean taker imbalance of the one-minute bars inside."""
    out = bars
    if funding is not None:
        out = asof(out, funding.select("symbol", c("calc_time").alias("_t"), c("last_funding_rate").cast("double").alias("funding_last")), "close_time", "_t", ["funding_last"], ["symbol"])
    if metrics is not None:
        names = {"oi_contracts": "sum_open_interest", "oi_notional": "sum_open_interest_value", "toptrader_ls": "sum_toptrader_long_short_ratio", "toptrader_ls_count": "count_toptrader_long_short_ratio", "global_ls": "count_long_short_ratio", "taker_ls_vol": "sum_taker_long_short_vol_ratio"}
        own = metrics.withColumn("oi_log_change", ln(c("sum_open_interest")) - ln(W.lagged("sum_open_interest", 1, ("symbol",), ("t",))))
        own = own.select("symbol", c("t").alias("_t"), *[c(v).cast("double").alias(k) for k, v in names.items()], "oi_log_change")
        out = asof(out, own, "close_time", "_t", [*names, "oi_log_change"], ["symbol"])
    if minutes is not None:
        bucket = F.floor(c("open_time") / step_ms)
        mean = minutes.groupBy("symbol", bucket.alias("_bucket")).agg(F.avg(K.taker_imbalance(c("taker_buy_volume"), c("volume"))).alias("taker_1m"))
        out = out.withColumn("_bucket", bucket).join(mean, ["symbol", "_bucket"], "left").drop("_bucket")
    return out.withColumns({k: F.lit(None).cast("double") for k in ALIGNED if k not in out.columns})


def ema_of(x: Sequence[float | None], span: int) -> list[float | None]:
    """Seeded by the first known value; null until so many have come, and where the value is."""
    alpha, state, n, out = 2 / (span + 1), None, 0, []
    for v in x:
        if v is not None:
            state, n = (v if state is None else alpha * v + (1 - alpha) * state), n + 1
        out.append(state if v is not None and n >= span else None)
    return out


def wilder_of(x: Sequence[float | None], n: int) -> list[float | None]:
    """The mean of the first n known values, then steps of an n-th."""
    state, seen, out = None, [], []
    for v in x:
        if v is not None:
            if state is not None:
                state = (state * (n - 1) + v) / n
            else:
                seen.append(v)
                state = sum(seen) / n if len(seen) == n else None
        out.append(state if v is not None else None)
    return out


def rsi_of(close: Sequence[float], n: int) -> list[float | None]:
    steps = [None, *(b - a for a, b in zip(close, close[1:], strict=False))]
    up, down = (wilder_of([None if s is None else max(sign * s, 0.0) for s in steps], n) for sign in (1, -1))
    return [None if u is None else 100 - 100 / (1 + u / d) if d > 0 else 100.0 if u > 0 else 50.0 for u, d in zip(up, down, strict=True)]


def ranks_of(x: Sequence[float | None], time: Sequence[int], window_ms: int | None) -> list[float | None]:
    """Share of the earlier known values, of all or of a time window, that are not above this one."""
    past, queue, out = [], deque(), []
    for v, t in zip(x, time, strict=True):
        while window_ms is not None and queue and queue[0][0] < t - window_ms:
            past.pop(bisect_right(past, queue.popleft()[1]) - 1)
        out.append(bisect_right(past, v) / len(past) if v is not None and past else None)
        if v is not None:
            insort(past, v)
            queue.append((t, v))
    return out


def _known(s: pd.Series) -> list:
    return [None if pd.isna(v) else float(v) for v in s]


def _recurrences(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("open_time", kind="stable")
    close, high, low = (pdf[x].astype(float).tolist() for x in ("close", "high", "low"))
    before = [None, *close[:-1]]
    tr = [h - lo if p is None else max(h - lo, abs(h - p), abs(lo - p)) for h, lo, p in zip(high, low, before, strict=True)]
    ema = {n: ema_of(close, n) for n in (12, 24, 26, 48)}
    macd = [None if a is None or b is None else a - b for a, b in zip(ema[12], ema[26], strict=True)]
    found = {"_ema_12": ema[12], "_ema_24": ema[24], "_ema_48": ema[48], "_macd": macd, "_macd_signal": ema_of(macd, 9), "_rsi_14": rsi_of(close, 14), "_rsi_48": rsi_of(close, 48), "C01_atr_20": wilder_of(tr, 20)}
    return pdf.assign(**{k: np.array([np.nan if v is None else v for v in found[k]], float) for k in KERNEL})


def catalogue(bars: DataFrame, wanted: Sequence[str] = IDS, funding_hours: int = 8) -> DataFrame:
    """symbol, open_time, close_time and the wanted ids."""
    keys = ["symbol", "open_time", "close_time"]
    own = bars.select(*keys, "open", "high", "low", "close", "volume", "quote_volume", "count", "taker_buy_volume", *[c(k).cast("double").alias(k) if k in bars.columns else F.lit(None).cast("double").alias(k) for k in ALIGNED])
    schema = ", ".join([*(f"`{k}` {t}" for k, t in own.dtypes), *(f"`{k}` double" for k in KERNEL)])
    df = own.groupBy("symbol").applyInPandas(_recurrences, schema)
    df = df.withColumns({k: F.when(~F.isnan(k), c(k)) for k in KERNEL})
    df = W.day_vwap_distance(df).withColumnRenamed("vwap", "_vwap")
    if "E03f_funding_cum_3d" in wanted:
        epochs = df.where("funding_last is not null").withColumn("_epoch", F.floor(c("close_time") / (funding_hours * 3_600_000)))
        nine = W.last_epochs_sum(epochs, "funding_last", "_epoch", 9).select("symbol", "open_time", c("total").alias("_funding_9"))
        df = df.join(nine, ["symbol", "open_time"], "left")
    ranked = {k: v for k, v in RANKS.items() if k in wanted or (k == "_ratio_rank" and {"C10_vol_expansion_flag", "C11_vol_compression_flag"} & set(wanted))}
    first = ordered(CATALOGUE, [x for x, _ in ranked.values()], given=df.columns)
    df = _add(df, first)
    if ranked:
        schema = ", ".join([*(f"`{k}` {t}" for k, t in df.dtypes), *(f"`{k}` double" for k in ranked)])

        def rank(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("open_time", kind="stable")
            time = pdf["close_time"].tolist()
            return pdf.assign(**{k: np.array([np.nan if v is None else v for v in ranks_of(_known(pdf[x]), time, ms)], float) for k, (x, ms) in ranked.items()})

        df = df.groupBy("symbol").applyInPandas(rank, schema).withColumns({k: F.when(~F.isnan(k), c(k)) for k in ranked})
    df = _add(df, ordered(CATALOGUE, [x for x in wanted if x not in df.columns], given=df.columns))
    return df.select(*keys, *wanted)


def _add(df: DataFrame, steps: Sequence[str]) -> DataFrame:
    waiting = list(steps)
    while waiting:  # all that is ready at once: one projection a level
        ready = [n for n in waiting if all(x not in waiting for x in CATALOGUE[n].needs)]
        df = df.withColumns({n: CATALOGUE[n].build() for n in ready})
        waiting = [n for n in waiting if n not in ready]
    return df
