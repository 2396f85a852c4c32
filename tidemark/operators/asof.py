"""As-of joins without one task for each key.

Time is cut into blocks. Inside a block the last row on or before a time comes from one
window over both sides; what a block inherits from the blocks before it is one row a
block. So the work of a key is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 86_400_000


def asof(left: DataFrame, right: DataFrame, on: str, right_on: str, columns: Sequence[str], by: Sequence[str] = (), tie: Sequence[str] = (), forward: bool = False, block: int = BLOCK_MS) -> DataFrame:
    """left with columns of the last right row at or before its time (forward: the first at or after it).

    Right rows win equal times; among equal right rows the last by tie wins (forward: the
    first). A right row whose values are null still counts. No such row: nulls.
    """
    values = F.struct(*[F.col(c) for c in columns])
    names = left.columns
    order = [F.col(x) for x in ("_t", "_side", "_tie")]
    ties = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tie or (right_on,))])
    tie_type = dict(right.select(ties.alias("x")).dtypes)["x"]
    a = left.select(*by, F.col(on).alias("_t"), F.lit(0 if forward else 1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), F.struct(*names).alias("_row"), F.lit(None).cast(dict(right.select(values.alias("x")).dtypes)["x"]).alias("_hit"))
    b = right.select(*by, F.col(right_on).alias("_t"), F.lit(1 if forward else 0).alias("_side"), ties.alias("_tie"), F.lit(None).cast(dict(left.select(F.struct(*names).alias("x")).dtypes)["x"]).alias("_row"), values.alias("_hit"))
    both = a.unionByName(b).withColumn("_block", F.floor(F.col("_t") / block))
    pick = F.first if forward else F.last
    edge = (F.min_by if forward else F.max_by)(F.col("_hit"), F.when(F.col("_hit").isNotNull(), F.struct("_t", "_tie")))
    blocks = both.groupBy(*by, "_block").agg(edge.alias("_edge"))
    w = Window.partitionBy(*by).orderBy("_block")
    w = w.rowsBetween(1, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "_block", pick("_edge", True).over(w).alias("_carried"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    inside = inside.rowsBetween(0, Window.unboundedFollowing) if forward else inside.rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", pick("_hit", True).over(inside)).where(F.col("_row").isNotNull())
    found = near.join(blocks, [*by, "_block"]).withColumn("_hit", F.coalesce("_near", "_carried"))
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in names], *[F.col(f"_hit.{c}").alias(c) for c in columns])


def valid_from_lookup(rows: DataFrame, snapshots: DataFrame, date: str, valid_from: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The snapshot in force on each row's date: an as-of join on dates (as days)."""
    return asof(rows, snapshots, date, valid_from, columns, by, block=365)
