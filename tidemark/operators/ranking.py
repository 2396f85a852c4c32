"""Positions in a global order without one task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a table; their number bounds what is gathered or broadcast about them.
MOST_RANGES = 16_384
PARTS = 1024


def cuts(df: DataFrame, column: str, n: int) -> list:
    """At most n - 1 quantiles, ascending."""
    n = min(n, MOST_RANGES)
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted(set(found or []))


def range_of(column: str, at: Sequence) -> Column:
    """Number of cuts that are not above the value (null: 0), found in two steps of about the root of their number."""
    if not at:
        return F.lit(0)
    step = max(1, int(len(at) ** 0.5))
    heads = F.array(*[F.lit(x) for x in at[::step]])
    rows = F.array(*[F.array(*[F.lit(x) for x in at[i : i + step]]) for i in range(0, len(at), step)])
    c = F.col(column)
    row = F.size(F.filter(heads, lambda x: x <= c))
    within = F.size(F.filter(F.element_at(rows, F.greatest(row, F.lit(1))), lambda x: x <= c))
    return F.when(c.isNull() | (row == 0), 0).otherwise((row - 1) * step + within)


def positions(df: DataFrame, column: str, tie: Sequence[str] = (), by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """name: 0, 1, ... in the order of column and tie, within each group.

    Without groups the order is cut at quantiles: each range is numbered on its own and
    begins where the counts of those before it (PARTS rows) end. Nulls come first.
    """
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(column, *tie)).cast("long") - 1)
    rows = df.withColumn("_range", F.when(F.col(column).isNull(), -1).otherwise(range_of(column, cuts(df, column, PARTS))))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_k"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column, *tie)) - 1
    placed = rows.withColumn("_at", inside).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_at"))
    return placed.drop("_range", "_before", "_at")


def running(df: DataFrame, values: dict[str, Column], order: str, by: Sequence[str] = (), block: Column | None = None) -> DataFrame:
    """df with a column for each of values: its sum over the rows up to this one, in the order of a column without ties.

    block is a function of order that never falls as order grows (by default ranges
    between quantiles, nulls first). Each block is summed on its own; what the blocks
    before it hold is one row a block, so no task needs all rows of a group.
    """
    if block is None:
        block = F.when(F.col(order).isNull(), -1).otherwise(range_of(order, cuts(df, order, PARTS)))
    rows = df.withColumns({"_block": block, **{f"_v_{k}": v for k, v in values.items()}})
    totals = rows.groupBy(*by, "_block").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_b"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_t_{k}") for k in values])
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({k: F.sum(f"_v_{k}").over(inside) for k in values}).join(totals, same)
    return summed.withColumns({k: F.coalesce(k, F.lit(0)) + F.col(f"_t_{k}") for k in values}).select(*df.columns, *values)


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list:
    """Exact quantiles with linear interpolation: the rows at the wanted places are picked, none is gathered."""
    known = df.where(F.col(column).isNotNull()).select(column)
    n = known.count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    wanted = sorted({int(p) for p in places} | {min(n - 1, int(p) + 1) for p in places})
    at = {r.position: r[0] for r in positions(known, column).where(F.col("position").isin(wanted)).collect()}
    return [at[int(p)] + (p - int(p)) * (at[min(n - 1, int(p) + 1)] - at[int(p)]) for p in places]
