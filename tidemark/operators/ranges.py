"""Joins on time ranges: paths, first touches, sums and fills.

A range join is an equality join on blocks of time as long as the longest range, each
range standing in the two blocks it can reach, with the exact bounds as a residual. What
is wanted of a range (a first row, a sum) is aggregated right after the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .asof import BLOCK_MS, asof
from .ranking import running


def within(ranges: DataFrame, points: DataFrame, start: str, end: str, at: str, longest_ms: int, by: Sequence[str] = ("symbol",), open_left: bool = False) -> DataFrame:
    """Pairs of a range and a point inside it; closed on both sides unless open_left."""
    first, last = F.floor(F.col(start) / longest_ms), F.floor(F.col(end) / longest_ms)
    a = ranges.withColumn("_block", F.explode(F.sequence(first, last)))
    b = points.withColumn("_block", F.floor(F.col(at) / longest_ms))
    low = F.col(at) > F.col(start) if open_left else F.col(at) >= F.col(start)
    return a.join(b, [*by, "_block"]).where(low & (F.col(at) <= F.col(end))).drop("_block")


def range_sum(ranges: DataFrame, points: DataFrame, start: str, end: str, at: str, value: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """total and n of the points in [start, end]: differences of running sums at two as-of joins, whatever the length."""
    sums = points.groupBy(*by, at).agg(F.sum(value).alias("_v"), F.count(value).alias("_k"))
    sums = running(sums, {"_sum": F.coalesce("_v", F.lit(0.0)), "_n": F.col("_k")}, at, by, F.floor(F.col(at) / BLOCK_MS)).select(*by, at, "_sum", "_n")
    upper = asof(ranges, sums, end, at, ["_sum", "_n"], by).withColumnsRenamed({"_sum": "_s1", "_n": "_n1"}).withColumn("_before", F.col(start) - 1)
    both = asof(upper, sums, "_before", at, ["_sum", "_n"], by)
    n = F.coalesce("_n1", F.lit(0)) - F.coalesce("_n", F.lit(0))
    return both.withColumns({"total": F.coalesce("_s1", F.lit(0.0)) - F.coalesce("_sum", F.lit(0.0)), "n": n}).drop("_sum", "_n", "_s1", "_n1", "_before")


def maker_fill(orders: DataFrame, trades: DataFrame, order_id: str, longest_ms: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """t_entry and fill_price of each order: the first trade in (t_post, horizon] at the limit or better; null if none."""
    touches = F.when(F.col("side") == 1, F.col("price") <= F.col("limit_price")).otherwise(F.col("price") >= F.col("limit_price"))
    tape = trades.select(*by, F.col("transact_time").alias("_t"), "agg_trade_id", "price")
    hits = within(orders.select(*by, order_id, "t_post", "horizon", "side", "limit_price"), tape, "t_post", "horizon", "_t", longest_ms, by, open_left=True).where(touches)
    first = hits.groupBy(order_id).agg(F.min(F.struct("_t", "agg_trade_id")).alias("_f")).select(order_id, F.col("_f._t").alias("t_entry"))
    return orders.join(first, order_id, "left").withColumn("fill_price", F.when(F.col("t_entry").isNotNull(), F.col("limit_price")))


def queue_fill(orders: DataFrame, trades: DataFrame, order_id: str, longest_ms: int, tick: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Like maker_fill, behind a queue: the fill comes when the opposing flow at the limit reaches queue_ahead; at once if there is none."""
    tape = trades.select(*by, F.col("transact_time").alias("_t"), "agg_trade_id", "price", "quantity", "is_buyer_maker")
    pairs = within(orders.select(*by, order_id, "t_post", "horizon", "side", "limit_price", "queue_ahead"), tape, "t_post", "horizon", "_t", longest_ms, by, open_left=True)
    flow = pairs.where((F.abs(F.col("price") - F.col("limit_price")) < tick / 2) & (F.col("is_buyer_maker") == (F.col("side") == 1)))
    w = Window.partitionBy(order_id).orderBy("_t", "agg_trade_id").rowsBetween(Window.unboundedPreceding, 0)
    done = flow.withColumn("_cum", F.sum("quantity").over(w)).where(F.col("_cum") >= F.col("queue_ahead")).groupBy(order_id).agg(F.min("_t").alias("_t"))
    at = F.when(F.col("queue_ahead") <= 0, F.col("t_post")).otherwise(F.col("_t"))
    return orders.join(done, order_id, "left").withColumn("t_entry", at).withColumn("fill_price", F.when(F.col("t_entry").isNotNull(), F.col("limit_price"))).drop("_t")


def markouts(fills: DataFrame, book: DataFrame, horizons_ms: Sequence[int], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """markout_<h>_bps: the signed move from fill_price to the book's mid h later; null past the book's end."""
    end = book.groupBy(*by).agg(F.max("transaction_time").alias("_end"))
    mid = book.select(*by, "transaction_time", ((F.col("best_bid_price") + F.col("best_ask_price")) / 2).alias("_mid"))
    out = fills.join(end, list(by), "left")
    for h in horizons_ms:
        out = asof(out.withColumn("_target", F.col("t_entry") + h), mid, "_target", "transaction_time", ["_mid"], by)
        move = 1e4 * F.col("side") * (F.col("_mid") - F.col("fill_price")) / F.col("fill_price")
        out = out.withColumn(f"markout_{h}_bps", F.when(F.col("_target") <= F.col("_end"), move)).drop("_mid", "_target")
    return out.drop("_end")


def first_touch(orders: DataFrame, path: DataFrame, order_id: str, longest_ms: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """barrier_hit, t1, exit_price, mfe and mae of filled orders over the bars in [t_entry, horizon_end].

    orders: side, fill_price, tp_price, sl_price; path: bars with open_time. The earlier
    touch wins; inside one bar the barrier nearer to the open, the profit on a tie. The
    stop pays the worse of its level and the open. Without a touch the last close.
    """
    need = orders.select(*by, order_id, "side", "t_entry", "horizon_end", "fill_price", "tp_price", "sl_price")
    bars = path.select(*by, F.col("open_time").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close")])
    pairs = within(need, bars, "t_entry", "horizon_end", "_t", longest_ms, by)
    long_ = F.col("side") == 1
    tp = F.when(long_, F.col("_high") >= F.col("tp_price")).otherwise(F.col("_low") <= F.col("tp_price"))
    sl = F.when(long_, F.col("_low") <= F.col("sl_price")).otherwise(F.col("_high") >= F.col("sl_price"))
    nearer = F.abs(F.col("tp_price") - F.col("_open")) <= F.abs(F.col("_open") - F.col("sl_price"))
    kind = F.when(tp & (~sl | nearer), F.lit("TP")).when(sl, F.lit("SL"))
    worse = F.when(long_, F.least("sl_price", "_open")).otherwise(F.greatest("sl_price", "_open"))
    paid = F.when(kind == "TP", F.col("tp_price")).when(kind == "SL", worse)
    w = Window.partitionBy(order_id).orderBy("_t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumns({"_kind": kind, "_paid": paid, "_tie": tp & sl, "_gap": sl & (kind == "SL") & (worse != F.col("sl_price")), "_top": F.max("_high").over(upto), "_bottom": F.min("_low").over(upto), "_n": F.row_number().over(w).cast("long")})
    # the window and the aggregate share one shuffle by order
    seen = F.struct("_t", F.coalesce("_kind", F.lit("TIME")).alias("kind"), F.coalesce("_paid", "_close").alias("paid"), "_tie", "_gap", "_top", "_bottom", "_n")
    ends = pairs.groupBy(order_id).agg(F.min(F.when(F.col("_kind").isNotNull(), seen)).alias("_touch"), F.max(seen).alias("_last"))
    out = orders.join(ends.select(order_id, F.coalesce("_touch", "_last").alias("_end"), F.col("_touch").isNotNull().alias("_hit")), order_id, "left")
    favourable = F.when(long_, F.col("_end._top") - F.col("fill_price")).otherwise(F.col("fill_price") - F.col("_end._bottom"))
    adverse = F.when(long_, F.col("fill_price") - F.col("_end._bottom")).otherwise(F.col("_end._top") - F.col("fill_price"))
    hit = F.coalesce("_hit", F.lit(False))
    return out.withColumns(
        {
            "barrier_hit": F.col("_end.kind"),
            "t1": F.col("_end._t"),
            "exit_price": F.col("_end.paid"),
            "tie_break_used": hit & F.coalesce("_end._tie", F.lit(False)),
            "gap_fill_used": hit & F.coalesce("_end._gap", F.lit(False)),
            "n_bars_held": F.col("_end._n"),
            "mfe": F.greatest(favourable, F.lit(0.0)),
            "mae": F.greatest(adverse, F.lit(0.0)),
        }
    ).drop("_end", "_hit")


PLACES_OF_BLOCK = 50_000


def concurrency(labels: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """concurrency and uniqueness of intervals (t0, t1] counted in places of the sorted t0.

    Interval i covers the places from its own to the last t0 at or before its t1. Places,
    counts of begun and ended intervals and prefix sums of 1 / concurrency are sums by
    blocks of time or of places (one row a block is carried on), so a symbol is not one
    task; two joins on places put them together. The intervals are used several times, so
    they are written once.
    """
    rows = labels.select(*by, "label_id", "t0", "t1").withColumn("_at", F.struct("t0", "label_id"))
    rows = running(rows, {"idx0": F.lit(1)}, "_at", by, F.floor(F.col("t0") / BLOCK_MS))
    rows = materialise(rows.drop("_at").withColumn("idx0", F.col("idx0").cast("long")))
    last = rows.select(*by, F.col("t0").alias("_t"), "idx0")
    last = last.groupBy(*by, "_t").agg(F.max("idx0").alias("idx1"))
    rows = materialise(asof(rows, last, "t1", "_t", ["idx1"], by).withColumn("idx1", F.greatest("idx1", "idx0")))
    ended = rows.groupBy(*by, (F.col("idx1") + 1).alias("idx0")).agg(F.count(F.lit(1)).alias("_ended"))
    block = F.expr(f"idx0 div {PLACES_OF_BLOCK}")
    rows = running(rows.join(ended, [*by, "idx0"], "left"), {"_gone": F.coalesce("_ended", F.lit(0))}, "idx0", by, block)
    rows = rows.withColumn("concurrency", F.col("idx0") - F.col("_gone")).drop("_ended", "_gone")
    rows = running(rows, {"_p": 1 / F.col("concurrency")}, "idx0", by, block)
    upper = rows.select(*by, F.col("idx0").alias("idx1"), F.col("_p").alias("_p1"))
    rows = rows.join(upper, [*by, "idx1"])
    own = 1 / F.col("concurrency")
    rows = rows.withColumn("uniqueness", (F.col("_p1") - F.col("_p") + own) / (F.col("idx1") - F.col("idx0") + 1))
    return labels.join(rows.select(*by, "label_id", "idx0", "idx1", "concurrency", "uniqueness"), [*by, "label_id"])


def sample_weight(labels: DataFrame, ret: str = "ret_gross") -> DataFrame:
    """sample_weight: uniqueness * |return|, with mean 1 over all rows (the mean is one row, broadcast)."""
    raw = labels.withColumn("_w", F.col("uniqueness") * F.abs(F.col(ret)))
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("sample_weight", F.when(F.col("_mean") > 0, F.col("_w") / F.col("_mean"))).drop("_w", "_mean")
