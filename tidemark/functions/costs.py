"""Fees, breakeven and rounding to the grid of prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_trip_bps(maker: float, taker: float, maker_prob: Column | float) -> Column:
    p = maker_prob if isinstance(maker_prob, Column) else F.lit(maker_prob)
    return (maker + p * maker + (1 - p) * taker) * 1e4


def breakeven_win_rate(cost_atr: Column, payoff: Column | float) -> Column:
    return 0.5 + cost_atr / (2 * (payoff if isinstance(payoff, Column) else F.lit(payoff)))


def round_to_tick(price: Column, side: Column, tick: str, scale: int = 8) -> Column:
    """Down for buys (side 1), up for sells, in decimals."""
    steps = price.cast(f"decimal(28,{scale})") / F.lit(tick).cast(f"decimal(28,{scale})")
    whole = F.when(side == 1, F.floor(steps)).otherwise(F.ceil(steps))
    return (whole.cast("decimal(28,0)") * F.lit(tick).cast(f"decimal(28,{scale})")).cast("double")


def floor_to_step(quantity: Column, step: str, scale: int = 8) -> Column:
    return (F.floor(quantity.cast(f"decimal(28,{scale})") / F.lit(step).cast(f"decimal(28,{scale})")).cast("decimal(28,0)") * F.lit(step).cast(f"decimal(28,{scale})")).cast("double")


def decide_side(p_long: Column, p_short: Column, tau_long: Column | float, tau_short: Column | float) -> Column:
    """1 where long reaches its threshold and is at least as likely as short, -1 the other way round, else 0."""
    tl, ts = (x if isinstance(x, Column) else F.lit(x) for x in (tau_long, tau_short))
    long_, short = p_long >= tl, p_short >= ts
    return F.when(long_ & (~short | (p_long >= p_short)), 1).when(short, -1).otherwise(0)
