"""Rules that hold everywhere: what is missing, full windows, guarded division, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN means missing in kernels; in a DataFrame missing is null."""
    names = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def ln(x: Column) -> Column:
    """Null, not an infinity, where the argument is not positive."""
    return F.when(x > 0, F.log(x))


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, and the default where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def rows_before(by: Sequence[str], order: Sequence[str], n: int) -> WindowSpec:
    """This row and the n - 1 before it."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)


def strictly_before(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def full(aggregate: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over a frame, null unless all its n values are there."""
    return F.when(F.count(x).over(w) == n, aggregate.over(w))


def decile(order: WindowSpec, by: WindowSpec, k: int = 10) -> Column:
    """floor(i * k / n) of the sorted position i; not ntile, which deals the remainder elsewhere."""
    return F.floor((F.row_number().over(order) - 1) * k / F.count(F.lit(1)).over(by)).cast("long")


def average_rank(by: Sequence[Column | str], value: str) -> Column:
    """Rank from 1 where ties share their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlation(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson over rows where both are there; null, not an error, where one side does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    parts = F.covar_pop(x, y), F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    cov, sx, sy = (p.over(over) if over is not None else p for p in parts)
    return F.when((sx > 0) & (sy > 0), F.try_divide(cov, sx * sy))
