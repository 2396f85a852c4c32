"""Data-quality checks: each one pass over its input, counts rather than rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_violations(df: DataFrame, expected: T.StructType) -> list[str]:
    """All of them: missing and further columns, types, order."""
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in expected.fields}
    out = [f"missing {n}" for n in want if n not in have] + [f"unexpected {n}" for n in have if n not in want]
    out += [f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
    if not out and list(have) != list(want):
        out.append("the order of the columns differs")
    return out


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, n), in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["n"], list(columns), "column", "nulls").select("column", "nulls", "n")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """n, distinct_keys, surplus rows and the number of keys that repeat."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_keys"), (F.sum("c") - F.count(F.lit(1))).alias("surplus"), F.count_if(F.col("c") > 1).alias("repeated_keys"))


def duplicate_examples(df: DataFrame, key: Sequence[str], n: int = 20) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").orderBy(*key).limit(n)


def missing_from_grid(df: DataFrame, time: str, step: int, by: Sequence[str]) -> DataFrame:
    """The times of a key's grid, from its first to its last, that it lacks; from the gaps alone."""
    w = Window.partitionBy(*by).orderBy(time)
    gaps = df.select(*by, time).distinct().withColumn("_next", F.lead(time).over(w)).where(F.col("_next") - F.col(time) > step)
    return gaps.select(*by, F.explode(F.sequence(F.col(time) + step, F.col("_next") - 1, F.lit(step).cast("long"))).alias(time))


def classify_gaps(gaps: DataFrame, maintenance: DataFrame, time: str) -> DataFrame:
    """explained: whether a gap lies in one of the maintenance intervals [start_ms, end_ms), by a range join on blocks as long as the longest."""
    from .ranges import within

    longest = maintenance.agg(F.max(F.col("end_ms") - F.col("start_ms"))).first()[0]
    if longest is None:
        return gaps.withColumn("explained", F.lit(False))
    spans = maintenance.select("start_ms", (F.col("end_ms") - 1).alias("_end")).where("_end >= start_ms")
    hit = within(spans, gaps.select(time).distinct(), "start_ms", "_end", time, max(1, longest), ()).select(time).distinct().withColumn("_hit", F.lit(True))
    return gaps.join(hit, time, "left").withColumn("explained", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bar_checks(bars: DataFrame, by: Sequence[str] = ("symbol",), step_ms: int | None = None) -> DataFrame:
    """Counts of incoherent, non-positive, negative-volume and misplaced bars for each key, in one aggregation."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rules = {
        "incoherent": _any([low > o, low > c, h < o, h < c, low > h]),
        "not_positive": _any([x <= 0 for x in (o, h, low, c)]),
        "negative_volume": F.col("volume") < 0,
        "taker_over_volume": F.col("taker_buy_volume") > F.col("volume"),
    }
    if step_ms:
        rules["bad_close_time"] = F.col("close_time") != F.col("open_time") + step_ms - 1
        rules["off_grid"] = F.col("open_time") % step_ms != 0
    return bars.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


def outlier_returns(bars: DataFrame, close: str, order: str, by: Sequence[str], sigmas: float = 8.0) -> DataFrame:
    """Rows whose log return is beyond so many standard deviations of its key's."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(close).over(w)
    rets = bars.withColumn("log_return", F.when((F.col(close) > 0) & (before > 0), F.log(F.col(close) / before)))
    sigma = rets.groupBy(*by).agg(F.stddev_samp("log_return").alias("sigma"))
    return rets.join(sigma, list(by)).where(F.abs(F.col("log_return")) > sigmas * F.col("sigma"))


def price_deviation(a: DataFrame, b: DataFrame, on: Sequence[str], price_a: str, price_b: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """n common rows, how many deviate by more than a share, and the worst."""
    share = F.abs(F.col(price_a) - F.col(price_b)) / F.col(price_a)
    both = a.select(*on, price_a).join(b.select(*on, price_b), list(on)).where(F.col(price_a) > 0)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(share > threshold).alias("beyond"), F.max(share).alias("worst"))


def interval_check(df: DataFrame, time: str, declared_hours: str, by: Sequence[str]) -> DataFrame:
    """Median and deviation of the gaps in hours, and the rows whose rounded gap is not the declared one."""
    gap = (F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time))) / 3_600_000
    g = df.withColumn("_gap", gap)
    return g.groupBy(*by).agg(F.median("_gap").alias("median_hours"), F.stddev_samp("_gap").alias("std_hours"), F.count_if(F.round("_gap") != F.col(declared_hours)).alias("mismatches"))


def coverage(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The first time from which all sources have data, and each one's own."""
    parts = [df.agg(F.min(time).alias("first"), F.max(time).alias("last")).select(F.lit(name).alias("source"), "first", "last") for name, (df, time) in frames.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.withColumn("effective_start", F.max("first").over(Window.partitionBy()))


def max_deviation(a: DataFrame, b: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(column, deviation) between two frames that should agree."""
    right = b.select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    both = a.join(right, list(on)).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).cast("double").alias(c) for c in columns])
    return both.unpivot(["n"], list(columns), "column", "deviation").select("column", "deviation", "n")


_CHECK = re.compile(r"^(unique|monotonic_increasing|not_null|positive)\(([\w, ]+)\)$")


def falls(df: DataFrame, column: str, order: Sequence[str]) -> int:
    """Rows, in the given order, that do not lie above the one before; null is not above. Ranges of the order are tasks."""
    from .ranking import cuts, range_of

    first = order[0]
    rows = df.withColumn("_range", F.when(F.col(first).isNull(), -1).otherwise(range_of(first, cuts(df, first, 1024))))
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    w = Window.partitionBy("_range").orderBy(*order)
    not_above = ~F.coalesce(F.col(column) > F.lag(column).over(w), F.lit(False)) & (F.row_number().over(w) > 1)
    inner = rows.withColumn("_bad", not_above)
    # one row a range: its own falls, and whether it begins above the end of the range before
    ends = inner.groupBy("_range").agg(F.count_if("_bad").alias("_n"), F.min_by(column, at).alias("_first"), F.max_by(column, at).alias("_last"))
    before = F.lag("_last").over(Window.orderBy("_range"))
    edges = ends.withColumn("_edge", (F.row_number().over(Window.orderBy("_range")) > 1) & ~F.coalesce(F.col("_first") > before, F.lit(False)))
    return edges.agg(F.sum(F.col("_n") + F.col("_edge").cast("int"))).first()[0] or 0


def declared_check(df: DataFrame, check: str, order: Sequence[str] = ()) -> bool:
    """``unique(a, b)``, ``monotonic_increasing(a)``, ``not_null(a)`` or ``positive(a)``; anything else raises.

    A DataFrame has no order of its own: monotonic_increasing needs the columns that give
    the rows' order, and fails where a row does not lie above the one before it.
    """
    m = _CHECK.match(check.strip())
    if not m:
        raise ValueError(f"no such check: {check}")
    columns = [c.strip() for c in m[2].split(",")]
    if m[1] == "unique":
        return duplicates(df, columns).first().surplus in (0, None)
    if m[1] == "monotonic_increasing":
        if not order:
            raise ValueError("monotonic_increasing needs the order of the rows")
        return all(falls(df, c, order) == 0 for c in columns) and df.where(_any([F.col(c).isNull() for c in columns])).isEmpty()
    bad = _any([F.col(c).isNull() if m[1] == "not_null" else ~(F.col(c) > 0) for c in columns])
    return df.where(bad).isEmpty()


def gate(counts: DataFrame, limits: dict[str, float], n: str = "n") -> DataFrame:
    """score (100 less the share of failing rows) and PASS where no count is above its share of n."""
    shares = [F.col(c) / F.col(n) for c in limits]
    ok = reduce(lambda a, b: a & b, [s <= m for s, m in zip(shares, limits.values(), strict=True)])
    return counts.withColumn("score", 100 * (1 - reduce(lambda a, b: a + b, shares) / len(shares))).withColumn("gate", F.when(ok, "PASS").otherwise("FAIL"))
