"""As-of and range joins, fills, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import asof as A
from ..operators import ranges as R
from ..sources import tables as S
from .base import HEAD, HOUR, SYMBOLS, hours, query, r, ticks

O = "(PARTITION BY symbol ORDER BY open_time)"  # noqa: E741
#: Funding: every seventh event, its rate from the price; null for some.
FUNDING = "funding AS (SELECT symbol, transact_time AS calc_time, agg_trade_id AS funding_id, CASE WHEN agg_trade_id % 21 <> 0 THEN (price - 50) / 1e4 END AS rate FROM ticks WHERE agg_trade_id % 7 = 0)"


def funding(spark, sf_dir):
    rate = F.when(F.col("agg_trade_id") % 21 != 0, (F.col("price") - 50) / 1e4)
    return ticks(spark, sf_dir).where("agg_trade_id % 7 = 0").select("symbol", F.col("transact_time").alias("calc_time"), F.col("agg_trade_id").alias("funding_id"), rate.alias("rate"))


@query(f"{HEAD}, {FUNDING} SELECT b.symbol, b.open_time, f.funding_id, round(f.rate, 8) + 0 AS rate FROM bars b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.close_time >= f.calc_time")
def q_asof_backward(spark, sf_dir):
    df = A.asof(hours(spark, sf_dir), funding(spark, sf_dir), "close_time", "calc_time", ["funding_id", "rate"], ["symbol"], ["funding_id"])
    return df.select("symbol", "open_time", "funding_id", r("rate", 8).alias("rate"))


@query(f"{HEAD}, {FUNDING} SELECT b.symbol, b.open_time, f.funding_id FROM bars b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.open_time <= f.calc_time")
def q_asof_forward(spark, sf_dir):
    df = A.asof(hours(spark, sf_dir), funding(spark, sf_dir), "open_time", "calc_time", ["funding_id"], ["symbol"], ["funding_id"], forward=True)
    return df.select("symbol", "open_time", "funding_id")


@query(f"{HEAD}, {FUNDING} SELECT count(*) AS n_rows, count(f.funding_id) AS matched, count(f.rate) AS with_value FROM bars b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.close_time >= f.calc_time")
def q_asof_null_value_row(spark, sf_dir):
    df = A.asof(hours(spark, sf_dir), funding(spark, sf_dir), "close_time", "calc_time", ["funding_id", "rate"], ["symbol"], ["funding_id"])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("funding_id").alias("matched"), F.count("rate").alias("with_value"))


@query(f"""{HEAD}, {FUNDING}, e AS (SELECT symbol, open_time, open_time AS s, open_time + 28800000 AS t FROM bars)
SELECT e.symbol, e.open_time, round(coalesce(sum(f.rate), 0), 6) + 0 AS total, count(f.rate) AS n FROM e LEFT JOIN funding f ON e.symbol = f.symbol AND f.calc_time >= s AND f.calc_time <= t GROUP BY 1, 2""")
def q_funding_range_sum(spark, sf_dir):
    spans = hours(spark, sf_dir).select("symbol", "open_time", F.col("open_time").alias("s"), (F.col("open_time") + 8 * HOUR).alias("t"))
    df = R.range_sum(spans, funding(spark, sf_dir), "s", "t", "calc_time", "rate")
    return df.select("symbol", "open_time", r("total").alias("total"), "n")


#: An order at each bar's close, 0.5 % inside, alive for six hours; every second one sells.
ORDERS = """orders_ AS (SELECT symbol, open_time AS order_id, symbol || ':' || open_time AS oid, close_time AS t_post, close_time + 21600000 AS horizon,
  CASE WHEN (open_time // 3600000) % 2 = 0 THEN 1 ELSE -1 END AS side, CASE WHEN (open_time // 3600000) % 2 = 0 THEN close * 0.995 ELSE close * 1.005 END AS limit_price FROM bars)"""


def orders(spark, sf_dir):
    even = F.expr("(open_time div 3600000) % 2 = 0")
    return hours(spark, sf_dir).select(
        "symbol", "open_time", F.concat_ws(":", "symbol", "open_time").alias("oid"), F.col("close_time").alias("t_post"), (F.col("close_time") + 6 * HOUR).alias("horizon"),
        F.when(even, 1).otherwise(-1).alias("side"), F.when(even, F.col("close") * 0.995).otherwise(F.col("close") * 1.005).alias("limit_price"),
    )


_FILL = f"""{HEAD}, {ORDERS}, hit AS (SELECT o.oid, min(t.transact_time) AS t_entry FROM orders_ o JOIN ticks t ON o.symbol = t.symbol AND t.transact_time > o.t_post AND t.transact_time <= o.horizon
  AND CASE WHEN o.side = 1 THEN t.price <= o.limit_price ELSE t.price >= o.limit_price END GROUP BY 1),
fills AS (SELECT o.*, h.t_entry, CASE WHEN h.t_entry IS NOT NULL THEN o.limit_price END AS fill_price FROM orders_ o LEFT JOIN hit h ON o.oid = h.oid)"""


def fills(spark, sf_dir):
    return R.maker_fill(orders(spark, sf_dir), ticks(spark, sf_dir), "oid", 6 * HOUR)


@query(f"{_FILL} SELECT oid, side, t_entry, round(fill_price, 6) + 0 AS fill_price FROM fills")
def q_maker_fill_first_match(spark, sf_dir):
    return fills(spark, sf_dir).select("oid", "side", "t_entry", r("fill_price").alias("fill_price"))


_QUEUE = f"""{HEAD}, {ORDERS}, q AS (SELECT *, (open_time_ // 3600000) % 5 * 20 AS queue_ahead FROM (SELECT *, order_id AS open_time_, round(limit_price) AS px FROM orders_)),
f AS (SELECT q.oid, t.transact_time, t.agg_trade_id, sum(t.quantity) OVER (PARTITION BY q.oid ORDER BY t.transact_time, t.agg_trade_id ROWS UNBOUNDED PRECEDING) AS cum, q.queue_ahead FROM q JOIN ticks t
  ON q.symbol = t.symbol AND t.transact_time > q.t_post AND t.transact_time <= q.horizon AND abs(t.price - q.px) < 10 AND t.is_buyer_maker = (q.side = 1)),
d AS (SELECT oid, min(transact_time) AS t FROM f WHERE cum >= queue_ahead GROUP BY 1)"""


@query(f"{_QUEUE} SELECT q.oid, q.queue_ahead, CASE WHEN q.queue_ahead <= 0 THEN q.t_post ELSE d.t END AS t_entry FROM q LEFT JOIN d ON q.oid = d.oid")
def q_queue_fill_cumqty(spark, sf_dir):
    q = orders(spark, sf_dir).withColumns({"queue_ahead": F.expr("(open_time div 3600000) % 5 * 20"), "limit_price": F.round("limit_price")})
    return R.queue_fill(q, ticks(spark, sf_dir), "oid", 6 * HOUR, tick=20.0).select("oid", "queue_ahead", "t_entry")


BOOK = "book AS (SELECT symbol, transact_time AS transaction_time, price - 0.01 AS bid, price + 0.03 AS ask FROM ticks WHERE agg_trade_id % 3 = 0)"


def book(spark, sf_dir):
    t = ticks(spark, sf_dir).where("agg_trade_id % 3 = 0")
    return t.select("symbol", F.col("transact_time").alias("transaction_time"), (F.col("price") - 0.01).alias("best_bid_price"), (F.col("price") + 0.03).alias("best_ask_price"))


def _markout(h: int) -> str:
    return f"m{h} AS (SELECT f.oid, CASE WHEN f.t_entry + {h} <= e.last THEN 1e4 * f.side * ((b.bid + b.ask) / 2 - f.fill_price) / f.fill_price END AS v FROM f JOIN e ON f.symbol = e.symbol ASOF LEFT JOIN book b ON f.symbol = b.symbol AND f.t_entry + {h} >= b.transaction_time)"


@query(f"{_FILL}, {BOOK}, e AS (SELECT symbol, max(transaction_time) AS last FROM book GROUP BY 1), f AS (SELECT * FROM fills WHERE t_entry IS NOT NULL AND fill_price > 0), {_markout(60000)}, {_markout(1800000)} SELECT f.oid, round(a.v, 4) + 0 AS after_1m, round(b.v, 4) + 0 AS after_30m FROM f JOIN m60000 a ON f.oid = a.oid JOIN m1800000 b ON f.oid = b.oid")
def q_fill_markouts(spark, sf_dir):
    done = fills(spark, sf_dir).where("t_entry is not null and fill_price > 0")
    df = R.markouts(done, book(spark, sf_dir), [60_000, 1_800_000])
    return df.select("oid", r("markout_60000_bps", 4).alias("after_1m"), r("markout_1800000_bps", 4).alias("after_30m"))


@query(f"{_FILL} SELECT side, count(*) AS n, count(t_entry) AS filled, round(count(t_entry) / CAST(count(*) AS DOUBLE), 6) + 0 AS p_fill FROM fills GROUP BY ROLLUP (side)")
def q_fill_summary(spark, sf_dir):
    df = fills(spark, sf_dir).rollup("side").agg(F.count(F.lit(1)).alias("n"), F.count("t_entry").alias("filled"))
    return df.select("side", "n", "filled", r(F.col("filled") / F.col("n")).alias("p_fill"))


# --- labels: entries at the open of the bar after each bar, barriers by its ATR stand-in ---
TP, SL, HOLD = 0.3, 0.2, 6


def _labels_sql(side: int, tp: float = TP, sl: float = SL) -> str:
    up, down = (f"fill_price * (1 + {tp})", f"fill_price * (1 - {sl})") if side == 1 else (f"fill_price * (1 - {tp})", f"fill_price * (1 + {sl})")
    hit_tp, hit_sl = ("p.high >= tp_price", "p.low <= sl_price") if side == 1 else ("p.low <= tp_price", "p.high >= sl_price")
    worse = "least(sl_price, p.open)" if side == 1 else "greatest(sl_price, p.open)"
    return f"""{HEAD}, en AS (SELECT symbol, symbol || ':' || open_time AS oid, open_time AS t0, lead(open_time) OVER {O} AS t_entry, lead(open) OVER {O} AS fill_price FROM bars),
o AS (SELECT *, t_entry + {HOLD * HOUR} AS horizon_end, {up} AS tp_price, {down} AS sl_price FROM en WHERE t_entry IS NOT NULL AND fill_price > 0),
p AS (SELECT o.*, p.open_time AS t, p.open, p.high, p.low, p.close, {hit_tp} AS tp, {hit_sl} AS sl, abs(tp_price - p.open) <= abs(p.open - sl_price) AS nearer, {worse} AS worse FROM o JOIN bars p ON o.symbol = p.symbol AND p.open_time >= o.t_entry AND p.open_time <= o.horizon_end),
k AS (SELECT *, CASE WHEN tp AND (NOT sl OR nearer) THEN 'TP' WHEN sl THEN 'SL' END AS kind FROM p),
f AS (SELECT oid, min(t) AS touch FROM k WHERE kind IS NOT NULL GROUP BY 1), l AS (SELECT oid, max(t) AS last FROM k GROUP BY 1),
u AS (SELECT l.oid, coalesce(f.touch, l.last) AS until, f.touch FROM l LEFT JOIN f ON l.oid = f.oid),
x AS (SELECT k.oid, k.symbol, k.t0, k.t_entry, k.fill_price, k.t AS t1, coalesce(k.kind, 'TIME') AS barrier_hit, CASE WHEN u.touch IS NULL THEN k.close WHEN k.kind = 'TP' THEN k.tp_price ELSE k.worse END AS exit_price,
  u.touch IS NOT NULL AND k.tp AND k.sl AS tie, u.touch IS NOT NULL AND k.kind = 'SL' AND k.worse <> k.sl_price AS gap FROM k JOIN u ON k.oid = u.oid AND k.t = u.until),
m AS (SELECT k.oid, max(high) AS top, min(low) AS bottom, count(*) AS n FROM k JOIN u ON k.oid = u.oid AND k.t <= u.until GROUP BY 1),
labels_ AS (SELECT x.*, m.n AS n_bars_held, {'greatest(top - fill_price, 0)' if side == 1 else 'greatest(fill_price - bottom, 0)'} AS mfe, {'greatest(fill_price - bottom, 0)' if side == 1 else 'greatest(top - fill_price, 0)'} AS mae,
  {side} * (exit_price / fill_price - 1) AS ret_gross FROM x JOIN m ON x.oid = m.oid)"""


def barrier_labels(spark, sf_dir, side: int, tp: float = TP, sl: float = SL):
    bars = hours(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("open_time")
    o = bars.select("symbol", F.concat_ws(":", "symbol", "open_time").alias("oid"), F.col("open_time").alias("t0"), F.lead("open_time").over(w).alias("t_entry"), F.lead("open").over(w).alias("fill_price"))
    o = o.where("t_entry is not null and fill_price > 0").withColumns({"horizon_end": F.col("t_entry") + HOLD * HOUR, "side": F.lit(side), "tp_price": F.col("fill_price") * (1 + side * F.lit(tp)), "sl_price": F.col("fill_price") * (1 - side * F.lit(sl))})
    df = R.first_touch(o, bars, "oid", HOLD * HOUR)
    return df.withColumn("ret_gross", F.lit(side) * (F.col("exit_price") / F.col("fill_price") - 1))


_SHOW = "SELECT oid, t_entry, t1, barrier_hit, round(exit_price, 6) + 0 AS exit_price, n_bars_held, tie, gap, round(mfe, 6) + 0 AS mfe, round(mae, 6) + 0 AS mae, round(ret_gross, 6) + 0 AS ret_gross FROM labels_"


def _show(df):
    return df.select("oid", "t_entry", "t1", "barrier_hit", r("exit_price").alias("exit_price"), "n_bars_held", F.col("tie_break_used").alias("tie"), F.col("gap_fill_used").alias("gap"), r("mfe").alias("mfe"), r("mae").alias("mae"), r("ret_gross").alias("ret_gross"))


@query(f"{_labels_sql(1)} {_SHOW}")
def q_triple_barrier_long(spark, sf_dir):
    return _show(barrier_labels(spark, sf_dir, 1))


@query(f"{_labels_sql(-1)} {_SHOW}")
def q_triple_barrier_short(spark, sf_dir):
    return _show(barrier_labels(spark, sf_dir, -1))


@query(f"{_labels_sql(1)} SELECT barrier_hit, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) + 0 AS share, round(avg(ret_gross), 6) + 0 AS mean_ret FROM labels_ GROUP BY 1")
def q_barrier_distribution(spark, sf_dir):
    g = barrier_labels(spark, sf_dir, 1).groupBy("barrier_hit").agg(F.count(F.lit(1)).alias("n"), F.avg("ret_gross").alias("m"))
    return g.select("barrier_hit", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), r("m").alias("mean_ret"))


@query(f"""{_labels_sql(1)}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t0, oid) AS i0 FROM labels_),
j AS (SELECT a.symbol, a.oid, a.i0, (SELECT max(b.i0) FROM i b WHERE b.symbol = a.symbol AND b.t0 <= a.t1) AS i1 FROM i a),
c AS (SELECT a.symbol, a.i0, count(*) AS c FROM j a JOIN j b ON a.symbol = b.symbol AND b.i0 <= a.i0 AND b.i1 >= a.i0 GROUP BY 1, 2)
SELECT j.oid, min(o.c) AS concurrency, round(avg(1.0 / c.c), 6) + 0 AS uniqueness FROM j JOIN c ON j.symbol = c.symbol AND c.i0 BETWEEN j.i0 AND j.i1 JOIN c o ON o.symbol = j.symbol AND o.i0 = j.i0 GROUP BY 1""")
def q_concurrency_uniqueness(spark, sf_dir):
    lab = barrier_labels(spark, sf_dir, 1).withColumn("label_id", F.col("oid"))
    return R.concurrency(lab).select("oid", "concurrency", r("uniqueness").alias("uniqueness"))


@query(f"""{_labels_sql(1)}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t0, oid) AS i0 FROM labels_),
j AS (SELECT a.symbol, a.oid, a.i0, a.ret_gross, (SELECT max(b.i0) FROM i b WHERE b.symbol = a.symbol AND b.t0 <= a.t1) AS i1 FROM i a),
c AS (SELECT a.symbol, a.i0, count(*) AS c FROM j a JOIN j b ON a.symbol = b.symbol AND b.i0 <= a.i0 AND b.i1 >= a.i0 GROUP BY 1, 2),
uq AS (SELECT j.oid, any_value(j.ret_gross) AS ret, avg(1.0 / c.c) AS q FROM j JOIN c ON j.symbol = c.symbol AND c.i0 BETWEEN j.i0 AND j.i1 GROUP BY 1)
SELECT oid, round(q * abs(ret) / avg(q * abs(ret)) OVER (), 6) + 0 AS sample_weight FROM uq""")
def q_sample_weight(spark, sf_dir):
    lab = R.concurrency(barrier_labels(spark, sf_dir, 1).withColumn("label_id", F.col("oid")))
    return R.sample_weight(lab).select("oid", r("sample_weight").alias("sample_weight"))


GRID = [(tp, sl) for tp in (0.2, 0.3) for sl in (0.1, 0.2)]


def _cell(tp: float, sl: float) -> str:
    return f"SELECT CAST({tp} AS DOUBLE) AS tp, CAST({sl} AS DOUBLE) AS sl, * FROM ({_labels_sql(1, tp, sl)} SELECT count(*) AS n, round(avg(CASE WHEN barrier_hit = 'TP' THEN 1.0 ELSE 0.0 END), 6) + 0 AS frac_tp, round(avg(CASE WHEN barrier_hit = 'SL' THEN 1.0 ELSE 0.0 END), 6) + 0 AS frac_sl, round(avg(ret_gross), 6) + 0 AS mean_ret FROM labels_)"


def surface(spark, sf_dir):
    """One row for each cell of the barrier grid: entries crossed with the (small) grid, then one first-touch pass."""
    bars = hours(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("open_time")
    o = bars.select("symbol", "open_time", F.lead("open_time").over(w).alias("t_entry"), F.lead("open").over(w).alias("fill_price")).where("t_entry is not null and fill_price > 0")
    cells = F.explode(F.array(*[F.struct(F.lit(tp).alias("tp"), F.lit(sl).alias("sl")) for tp, sl in GRID])).alias("c")
    o = o.select("*", cells).select("*", "c.tp", "c.sl").drop("c")
    o = o.withColumns({"oid": F.concat_ws(":", "symbol", "open_time", "tp", "sl"), "horizon_end": F.col("t_entry") + HOLD * HOUR, "side": F.lit(1), "tp_price": F.col("fill_price") * (1 + F.col("tp")), "sl_price": F.col("fill_price") * (1 - F.col("sl"))})
    hit = R.first_touch(o, bars, "oid", HOLD * HOUR).withColumn("ret", F.col("exit_price") / F.col("fill_price") - 1)
    share = lambda k: F.avg(F.when(F.col("barrier_hit") == k, 1.0).otherwise(0.0))
    return hit.groupBy("tp", "sl").agg(F.count(F.lit(1)).alias("n"), r(share("TP")).alias("frac_tp"), r(share("SL")).alias("frac_sl"), r(F.avg("ret")).alias("mean_ret"))


@query(" UNION ALL ".join(_cell(*c) for c in GRID))
def q_barrier_grid_sweep(spark, sf_dir):
    return surface(spark, sf_dir)


@query(f"SELECT tp, max(CASE WHEN sl = 0.1 THEN mean_ret END) AS sl_10, max(CASE WHEN sl = 0.2 THEN mean_ret END) AS sl_20 FROM ({' UNION ALL '.join(_cell(*c) for c in GRID)}) GROUP BY 1")
def q_pivot_surface(spark, sf_dir):
    return surface(spark, sf_dir).groupBy("tp").pivot("sl", [0.1, 0.2]).agg(F.first("mean_ret")).toDF("tp", "sl_10", "sl_20")


# --- equality joins ---


@query(f"""{_FILL}, s AS (SELECT oid, symbol, t_post, side FROM fills), lab AS (SELECT oid, side, t_entry, fill_price FROM fills WHERE order_id // 3600000 % 4 <> 0)
SELECT s.oid, s.side, l.t_entry, l.oid IS NOT NULL AS labelled, round(l.fill_price, 6) + 0 AS fill_price FROM s LEFT JOIN lab l ON s.oid = l.oid AND s.side = l.side""")
def q_signal_label_left_join(spark, sf_dir):
    f = fills(spark, sf_dir)
    s = f.select("oid", "side")
    lab = f.where("(open_time div 3600000) % 4 <> 0").select("oid", "side", "t_entry", "fill_price", F.lit(True).alias("labelled"))
    return s.join(lab, ["oid", "side"], "left").select("oid", "side", "t_entry", F.coalesce("labelled", F.lit(False)).alias("labelled"), r("fill_price").alias("fill_price"))


@query(f"""{_FILL}, sig AS (SELECT oid, side, order_id // 3600000 % 7 = 0 AS bad FROM fills), lab AS (SELECT oid, side, t_entry FROM fills WHERE order_id // 3600000 % 7 <> 0),
ord AS (SELECT oid, side, t_entry, true AS filled FROM fills WHERE t_entry IS NOT NULL AND order_id // 3600000 % 5 <> 0),
j AS (SELECT s.oid, s.side, l.oid IS NOT NULL AS has_label, l.t_entry, o.filled FROM sig s LEFT JOIN lab l ON s.oid = l.oid AND s.side = l.side LEFT JOIN ord o ON s.oid = o.oid AND s.side = o.side AND l.t_entry = o.t_entry)
SELECT side, count(*) AS n_signals, count(CASE WHEN NOT has_label THEN 1 END) AS missing_labels, count(CASE WHEN has_label AND t_entry IS NULL THEN 1 END) AS nofill, count(CASE WHEN t_entry IS NOT NULL AND filled IS NULL THEN 1 END) AS order_gaps, count(filled) AS filled FROM j GROUP BY 1""")
def q_reconciliation_base(spark, sf_dir):
    f = fills(spark, sf_dir).withColumn("h", F.expr("open_time div 3600000"))
    sig = f.select("oid", "side")
    lab = f.where("h % 7 <> 0").select("oid", "side", "t_entry", F.lit(True).alias("has_label"))
    sent = f.where("t_entry is not null and h % 5 <> 0").select("oid", "side", "t_entry", F.lit(True).alias("filled"))
    base = sig.join(lab, ["oid", "side"], "left")
    none = base.where("t_entry is null").withColumn("filled", F.lit(None).cast("boolean"))
    both = base.where("t_entry is not null").join(sent, ["oid", "side", "t_entry"], "left").unionByName(none, allowMissingColumns=True)
    has = F.coalesce("has_label", F.lit(False))
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_signals"), F.count_if(~has).alias("missing_labels"), F.count_if(has & F.col("t_entry").isNull()).alias("nofill"),
        F.count_if(F.col("t_entry").isNotNull() & F.col("filled").isNull()).alias("order_gaps"), F.count("filled").alias("filled"),
    )


@query("""WITH snap AS (SELECT c_nationkey AS k, CAST(c_custkey % 2000 AS INTEGER) AS d, c_custkey AS id, round(c_acctbal, 2) AS tick FROM customer),
o AS (SELECT o_orderkey, o_custkey % 25 AS k, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d FROM orders),
last AS (SELECT k, d, max(id) AS id, arg_max(tick, id) AS tick FROM snap GROUP BY 1, 2)
SELECT o.o_orderkey, s.id AS snapshot, s.tick FROM o ASOF LEFT JOIN last s ON o.k = s.k AND o.d >= s.d""")
def q_filters_scd_asof(spark, sf_dir):
    snap = S.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), (F.col("c_custkey") % 2000).cast("int").alias("from_day"), F.col("c_custkey").alias("snapshot"), F.round("c_acctbal", 2).alias("tick"))
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("long").alias("k"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("day"))
    df = A.asof(o, snap, "day", "from_day", ["snapshot", "tick"], ["k"], ["from_day", "snapshot"], block=365)
    return df.select("o_orderkey", "snapshot", "tick")


@query(f"""{HEAD}, o AS (SELECT symbol, open_time, close * (1 + (open_time // 3600000 % 13 - 6) / 200.0) AS other FROM bars)
SELECT b.symbol, count(*) AS n, count(CASE WHEN abs(b.close - o.other) / b.close > 0.02 THEN 1 END) AS beyond, round(max(abs(b.close - o.other) / b.close), 6) + 0 AS worst FROM bars b JOIN o ON b.symbol = o.symbol AND b.open_time = o.open_time WHERE b.close > 0 GROUP BY 1""")
def q_price_deviation(spark, sf_dir):
    from ..operators.quality import price_deviation

    b = hours(spark, sf_dir)
    o = b.select("symbol", "open_time", (F.col("close") * (1 + (F.expr("open_time div 3600000 % 13") - 6) / 200.0)).alias("other"))
    return price_deviation(b, o, ["symbol", "open_time"], "close", "other", 0.02, ["symbol"]).select("symbol", "n", "beyond", r("worst").alias("worst"))


@query(f"{HEAD}, s AS (SELECT symbol, unnest(range(min(open_time), max(open_time) + 1, {HOUR})) AS open_time FROM bars GROUP BY 1) SELECT s.symbol, s.open_time FROM s ANTI JOIN bars b ON s.symbol = b.symbol AND s.open_time = b.open_time")
def q_grid_gaps_anti(spark, sf_dir):
    from ..operators.quality import missing_from_grid

    return missing_from_grid(hours(spark, sf_dir), "open_time", HOUR, ["symbol"])


@query(f"{HEAD}" + ", w AS (SELECT open_time, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN round(close, 6) + 0 END) AS {s}" for s in SYMBOLS) + " FROM bars GROUP BY 1) SELECT * FROM w WHERE " + " AND ".join(f"{s} IS NOT NULL" for s in SYMBOLS))
def q_multi_symbol_alignment(spark, sf_dir):
    return hours(spark, sf_dir).groupBy("open_time").pivot("symbol", SYMBOLS).agg(F.first(r("close"))).dropna(subset=SYMBOLS)


@query(f"""{HEAD}, d AS (SELECT symbol, open_time // 86400000 AS day, sum(quote_volume) AS q FROM bars WHERE open_time // 3600000 % 24 < 3 GROUP BY 1, 2),
s AS (SELECT symbol, unnest(range(min(open_time // 86400000), max(open_time // 86400000) + 1)) AS day FROM bars GROUP BY 1)
SELECT s.symbol, s.day, round(coalesce(d.q, 0), 4) + 0 AS quote FROM s LEFT JOIN d ON s.symbol = d.symbol AND s.day = d.day""")
def q_dense_day_grid(spark, sf_dir):
    b = hours(spark, sf_dir).withColumn("day", F.expr("open_time div 86400000"))
    d = b.where("open_time div 3600000 % 24 < 3").groupBy("symbol", "day").agg(F.sum("quote_volume").alias("q"))
    spine = b.groupBy("symbol").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return spine.join(d, ["symbol", "day"], "left").select("symbol", "day", r(F.coalesce("q", F.lit(0.0)), 4).alias("quote"))


@query(f"{HEAD}, m AS (SELECT symbol, transact_time // 900000 * 900000 AS t, avg(CASE WHEN is_buyer_maker THEN -1.0 ELSE 1.0 END) AS x FROM ticks GROUP BY 1, 2) SELECT b.symbol, b.open_time, round(m.x, 6) + 0 AS flow FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.open_time = m.t")
def q_bucket_mean_lookup(spark, sf_dir):
    m = ticks(spark, sf_dir).groupBy("symbol", F.expr("transact_time div 900000 * 900000").alias("open_time")).agg(F.avg(F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0)).alias("x"))
    return hours(spark, sf_dir).join(m, ["symbol", "open_time"], "left").select("symbol", "open_time", r("x").alias("flow"))


@query(f"{HEAD} SELECT symbol, open_time, CASE WHEN side = 1 THEN CAST(floor(CAST(close AS DECIMAL(28,8)) / 0.25) * 0.25 AS DOUBLE) ELSE CAST(ceil(CAST(close AS DECIMAL(28,8)) / 0.25) * 0.25 AS DOUBLE) END AS px FROM (SELECT *, CASE WHEN (open_time // 3600000) % 2 = 0 THEN 1 ELSE -1 END AS side FROM bars)")
def q_tick_rounding(spark, sf_dir):
    side = F.when(F.expr("(open_time div 3600000) % 2 = 0"), 1).otherwise(-1)
    return hours(spark, sf_dir).select("symbol", "open_time", costs.round_to_tick(F.col("close"), side, "0.25").alias("px"))


@query(f"""{HEAD}, g AS (SELECT symbol, open_time, {24} AS n FROM bars), p AS (SELECT b.symbol, b.open_time, b.close, f.close AS later FROM bars b ASOF LEFT JOIN bars f ON b.symbol = f.symbol AND b.open_time + 14400000 <= f.open_time)
SELECT symbol, open_time, round(CASE WHEN close > 0 THEN 1e4 * (later - close) / close END, 4) + 0 AS drift_bps FROM p""")
def q_post_fill_drift(spark, sf_dir):
    b = hours(spark, sf_dir).select("symbol", "open_time", "close", (F.col("open_time") + 4 * HOUR).alias("target"))
    df = A.asof(b, hours(spark, sf_dir).select("symbol", F.col("open_time").alias("t"), F.col("close").alias("later")), "target", "t", ["later"], ["symbol"], forward=True)
    return df.select("symbol", "open_time", r(F.when(F.col("close") > 0, 1e4 * (F.col("later") - F.col("close")) / F.col("close")), 4).alias("drift_bps"))


@query(f"{HEAD}, h AS (SELECT symbol, open_time, close, lag(close) OVER {O} AS pc FROM bars) SELECT a.symbol, a.open_time, round(b.close, 6) + 0 AS factor FROM h a ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'click') b ON a.open_time >= b.open_time WHERE a.symbol <> 'click'")
def q_common_factor_asof(spark, sf_dir):
    b = hours(spark, sf_dir)
    factor = b.where("symbol = 'click'").select(F.col("open_time").alias("t"), F.col("close").alias("factor"))
    return A.asof(b.where("symbol <> 'click'").select("symbol", "open_time"), factor, "open_time", "t", ["factor"]).select("symbol", "open_time", r("factor").alias("factor"))


