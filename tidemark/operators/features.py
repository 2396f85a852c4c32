"""A registry of bar features: each id names a column, what it needs and how it is built.

``frame`` adds what is asked for and what that needs, in order; windows with the same
partitioning share their sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import candles as K
from ..functions.semantics import ln, ratio
from . import windows as W

c = F.col


@dataclass(frozen=True)
class Feature:
    build: Callable[[], Column]
    needs: tuple[str, ...] = ()
    warmup: int = 0


def _z(x: str, n: int) -> Feature:
    return Feature(lambda: W.rolling_zscore(x, n), (x,) if x not in BARS else (), n)


BARS = ("open", "high", "low", "close", "volume", "quote_volume", "count", "taker_buy_volume")

REGISTRY: dict[str, Feature] = {
    "ret_1": Feature(lambda: W.log_return("close"), (), 1),
    **{f"ret_{n}": Feature(lambda n=n: W.log_return("close", n), (), n) for n in (2, 4, 8, 16, 48)},
    "body_ratio": Feature(lambda: K.body_ratio(c("open"), c("high"), c("low"), c("close"))),
    "upper_wick": Feature(lambda: K.upper_wick_ratio(c("open"), c("high"), c("low"), c("close"))),
    "lower_wick": Feature(lambda: K.lower_wick_ratio(c("open"), c("high"), c("low"), c("close"))),
    "close_place": Feature(lambda: K.close_place(c("high"), c("low"), c("close"))),
    "gap": Feature(lambda: ratio(c("open") - W.lagged("close", 1), W.lagged("close", 1)), (), 1),
    "tr": Feature(lambda: K.true_range(c("high"), c("low"), W.lagged("close", 1))),
    "tr_pct": Feature(lambda: ratio(c("tr"), c("close")), ("tr",)),
    "atr_sma_20": Feature(lambda: W.rolling(F.avg("tr"), "tr", 20), ("tr",), 20),
    "ret_vol_norm_4": Feature(lambda: ratio(c("ret_4"), ratio(c("atr_sma_20"), c("close")) * 2), ("ret_4", "atr_sma_20"), 20),
    **{f"vol_{n}": Feature(lambda n=n: W.rolling(F.stddev_samp("ret_1"), "ret_1", n), ("ret_1",), n) for n in (12, 24, 48)},
    "vol_ratio": Feature(lambda: ratio(c("vol_12"), c("vol_48")), ("vol_12", "vol_48"), 48),
    "vol_of_vol": Feature(lambda: W.rolling(F.stddev_samp("vol_12"), "vol_12", 24), ("vol_12",), 36),
    "pk_term": Feature(lambda: K.parkinson_term(c("high"), c("low"))),
    "gk_term": Feature(lambda: K.garman_klass_term(c("open"), c("high"), c("low"), c("close"))),
    "rs_term": Feature(lambda: K.rogers_satchell_term(c("open"), c("high"), c("low"), c("close"))),
    "parkinson_24": Feature(lambda: W.volatility("pk_term", 24), ("pk_term",), 24),
    "garman_klass_24": Feature(lambda: W.volatility("gk_term", 24), ("gk_term",), 24),
    "rogers_satchell_24": Feature(lambda: W.volatility("rs_term", 24), ("rs_term",), 24),
    "stoch_14": Feature(lambda: W.stochastic("close", "high", "low", 14), (), 14),
    "step": Feature(lambda: F.abs(c("close") - W.lagged("close", 1)), (), 1),
    "er_24": Feature(lambda: ratio(F.abs(c("close") - W.lagged("close", 24)), W.rolling(F.sum("step"), "step", 24)), ("step",), 25),
    "close_z_48": _z("close", 48),
    "volume_z_96": _z("volume", 96),
    "rel_volume_48": Feature(lambda: ratio(c("volume"), W.rolling_median("volume", 48)), (), 48),
    "taker": Feature(lambda: K.taker_imbalance(c("taker_buy_volume"), c("volume"))),
    "taker_mean_12": Feature(lambda: W.rolling(F.avg("taker"), "taker", 12), ("taker",), 12),
    "taker_z": Feature(lambda: W.expanding_zscore("taker"), ("taker",), 2),
    "trade_size": Feature(lambda: ratio(c("quote_volume"), c("count"))),
    "trade_size_z": Feature(lambda: W.expanding_zscore("trade_size"), ("trade_size",), 2),
    "price_volume_corr": Feature(lambda: W.rolling_corr("close", "volume", 24), (), 24),
    "log_volume_change": Feature(lambda: ln(c("volume").cast("double")) - ln(W.lagged("volume", 4).cast("double")), (), 4),
    "volume_change_z": Feature(lambda: W.rolling_zscore("log_volume_change", 48), ("log_volume_change",), 52),
    "sq_ret": Feature(lambda: c("ret_1") * c("ret_1"), ("ret_1",)),
    "har_day": Feature(lambda: W.time_mean("sq_ret", "close_time", K.DAY_MS), ("sq_ret",)),
    "har_week": Feature(lambda: W.time_mean("sq_ret", "close_time", 7 * K.DAY_MS), ("sq_ret",)),
    "hour_sin": Feature(lambda: K.cycle(K.hour_of_day(c("close_time")), 24)[0]),
    "hour_cos": Feature(lambda: K.cycle(K.hour_of_day(c("close_time")), 24)[1]),
    "dow_sin": Feature(lambda: K.cycle(K.day_of_week(c("close_time")), 7)[0]),
    "weekend": Feature(lambda: K.is_weekend(c("close_time")).cast("double")),
    "session_eu": Feature(lambda: K.in_session(c("close_time"), 7, 16).cast("double")),
    "to_funding": Feature(lambda: K.hours_to_boundary(c("close_time"), 8)),
}
ACTIVE = ("ret_1", "ret_4", "ret_16", "body_ratio", "close_place", "gap", "tr_pct", "ret_vol_norm_4", "vol_24", "vol_ratio", "vol_of_vol", "parkinson_24", "garman_klass_24", "stoch_14", "er_24", "close_z_48", "volume_z_96", "rel_volume_48", "taker_mean_12", "taker_z", "price_volume_corr", "volume_change_z", "har_day", "har_week", "hour_sin", "hour_cos", "dow_sin", "weekend", "session_eu", "to_funding", "trade_size_z")


def order(wanted: Sequence[str]) -> list[str]:
    return ordered(REGISTRY, wanted)


def ordered(registry: dict[str, Feature], wanted: Sequence[str], given: Sequence[str] = ()) -> list[str]:
    """The features and all that they need (but for columns that are given), each after what it needs; unknown names and circles raise."""
    out: list[str] = []
    open_: set[str] = set()
    known = set(given)

    def visit(name: str) -> None:
        if name in out or name in known:
            return
        if name not in registry:
            raise KeyError(f"no such feature: {name}")
        if name in open_:
            raise ValueError(f"a circle through {name}")
        open_.add(name)
        for n in registry[name].needs:
            visit(n)
        out.append(name)

    for name in wanted:
        visit(name)
    return out


def frame(bars: DataFrame, wanted: Sequence[str] = ACTIVE, mask_warmup: bool = False) -> DataFrame:
    """symbol, open_time, close_time and the wanted features; the longest warm-up can be masked."""
    steps = order(wanted)
    df, waiting = bars, list(steps)
    while waiting:  # all that is ready at once: one projection a level
        ready = [n for n in waiting if all(x not in waiting for x in REGISTRY[n].needs)]
        df = df.withColumns({n: REGISTRY[n].build() for n in ready})
        waiting = [n for n in waiting if n not in ready]
    keys = ["symbol", "open_time", "close_time"]
    if mask_warmup:
        from pyspark.sql import Window

        n = max(REGISTRY[x].warmup for x in steps)
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("open_time")))
        return df.select(*keys, *[F.when(c("_n") > n, c(x)).alias(x) for x in wanted])
    return df.select(*keys, *wanted)


def dead_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, known, dead): a feature that is missing, or the same in all rows that have it, is dead. Exact, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count(x).alias("known"), F.coalesce(F.min(x) == F.max(x), F.lit(True)).alias("dead")).alias(x) for x in columns])
    return counts.unpivot(["n"], list(columns), "column", "_x").select("column", "n", "_x.known", "_x.dead")
