"""Shapes, volatility terms and calendar of bars, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import ln, ratio

DAY_MS = 86_400_000


def body_ratio(o: Column, h: Column, low: Column, c: Column) -> Column:
    return ratio(F.abs(c - o), h - low, 0.0)


def upper_wick_ratio(o: Column, h: Column, low: Column, c: Column) -> Column:
    return ratio(h - F.greatest(o, c), h - low, 0.0)


def lower_wick_ratio(o: Column, h: Column, low: Column, c: Column) -> Column:
    return ratio(F.least(o, c) - low, h - low, 0.0)


def close_place(h: Column, low: Column, c: Column) -> Column:
    """Where the close lies between low (0) and high (1)."""
    return ratio(c - low, h - low, 0.5)


def true_range(h: Column, low: Column, previous_close: Column) -> Column:
    return F.when(previous_close.isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - previous_close), F.abs(low - previous_close)))


def parkinson_term(h: Column, low: Column) -> Column:
    return F.pow(ln(h / F.when(low > 0, low)), 2) / (4 * math.log(2))


def garman_klass_term(o: Column, h: Column, low: Column, c: Column) -> Column:
    return 0.5 * F.pow(ln(h / F.when(low > 0, low)), 2) - (2 * math.log(2) - 1) * F.pow(ln(c / F.when(o > 0, o)), 2)


def rogers_satchell_term(o: Column, h: Column, low: Column, c: Column) -> Column:
    o, low, c = (F.when(x > 0, x) for x in (o, low, c))
    return ln(h / c) * ln(h / o) + ln(low / c) * ln(low / o)


def taker_imbalance(taker_buy: Column, volume: Column) -> Column:
    return 2 * ratio(taker_buy, volume) - 1


def hour_of_day(ms: Column) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY_MS)) / 3_600_000).cast("long")


def day_of_week(ms: Column) -> Column:
    """0 is Thursday, the epoch's first day."""
    return F.pmod(F.floor(ms / DAY_MS), F.lit(7)).cast("long")


def is_weekend(ms: Column) -> Column:
    return day_of_week(ms).isin(2, 3)


def in_session(ms: Column, start: int, end: int) -> Column:
    """Half open: [start, end) in hours of the day."""
    h = hour_of_day(ms)
    return (h >= start) & (h < end)


def hours_to_boundary(ms: Column, interval_hours: int) -> Column:
    """Until the next multiple of the interval; 0 at a boundary."""
    step = interval_hours * 3_600_000
    return F.pmod(-ms, F.lit(step)) / 3_600_000


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)
