"""Profiles and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import features as X
from ..operators import validation as V
from ..operators import windows as W
from .base import HEAD, HOUR, TICKS, clock_sql, hours, query, r, ticks
from .joins import _FILL, _labels_sql, barrier_labels, fills
from .validation import SCORED, scored
from .windows import RET, O, full, log, rets


@query(f"{SCORED}, tr AS (SELECT symbol, score FROM s WHERE id % 2 = 0) SELECT s.id, round((SELECT count(*) FROM tr WHERE tr.symbol = s.symbol AND tr.score <= s.score) / CAST((SELECT count(*) FROM tr WHERE tr.symbol = s.symbol) AS DOUBLE), 6) + 0 AS ecdf FROM s WHERE id % 2 = 1")
def q_train_ecdf(spark, sf_dir):
    s = scored(spark, sf_dir).select("symbol", "id", "score")
    return A.ecdf(s.where("id % 2 = 1"), s.where("id % 2 = 0"), "score", ["symbol"]).select("id", r("ecdf").alias("ecdf"))


@query(f"{SCORED}, k AS (SELECT id, rank() OVER (PARTITION BY symbol ORDER BY p) - 1 AS less, count(*) OVER (PARTITION BY symbol, p) AS eq, count(*) OVER (PARTITION BY symbol) AS n FROM s) SELECT id, round((less + (eq + 1) / 2.0) / (n + 1), 6) + 0 AS relative_rank FROM k")
def q_relative_rank(spark, sf_dir):
    return A.relative_rank(scored(spark, sf_dir), "p", ["symbol"]).select("id", r("relative_rank").alias("relative_rank"))


@query(f"{SCORED}, k AS (SELECT symbol, count(CASE WHEN p > 0.8 THEN 1 END) AS k FROM s GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS n FROM s) SELECT n.symbol, n.id FROM n JOIN k ON n.symbol = k.symbol WHERE n.n <= k.k")
def q_topk_like_other_rule(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("accepted", F.col("p") > 0.8)
    return A.top_k_like(s, "accepted", "score", ["id"], ["symbol"]).select("symbol", "id")


_IC = "b AS (SELECT symbol, open_time, close, r1 FROM ret), f AS (SELECT symbol, open_time, r1, {fwd} FROM b)"
HORIZONS = (1, 2, 4, 8)


def _horizon(h: int) -> str:
    return f"CASE WHEN close > 0 AND lead(close, {h}) OVER (PARTITION BY symbol ORDER BY open_time) > 0 THEN ln(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY open_time)) - ln(close) END AS f{h}"


def _ic(h: int) -> str:
    return f"SELECT symbol, {h} AS horizon, round(corr(a, b), 6) + 0 AS ic FROM (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY r1) + (count(*) OVER (PARTITION BY symbol, r1) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY f{h}) + (count(*) OVER (PARTITION BY symbol, f{h}) - 1) / 2.0 AS b FROM f WHERE r1 IS NOT NULL AND f{h} IS NOT NULL) GROUP BY 1"


@query(f"{RET}, {_IC.format(fwd=', '.join(map(_horizon, HORIZONS)))} {' UNION ALL '.join(map(_ic, HORIZONS))}")
def q_ic_by_horizon(spark, sf_dir):
    df = rets(spark, sf_dir).withColumns({f"f{h}": W.log_return("close", -h) for h in HORIZONS})
    long = df.unpivot(["symbol", "open_time", "r1"], [f"f{h}" for h in HORIZONS], "h", "fwd").withColumn("horizon", F.substring("h", 2, 9).cast("int"))
    return V.spearman(long, "r1", "fwd", ["symbol", "horizon"]).select("symbol", "horizon", r("ic").alias("ic"))


@query(f"WITH x AS ({RET}, {_IC.format(fwd=', '.join(map(_horizon, HORIZONS)))} {' UNION ALL '.join(map(_ic, HORIZONS))}) SELECT symbol, arg_min(horizon, (-abs(ic), horizon)) AS horizon, arg_min(ic, (-abs(ic), horizon)) AS ic FROM x GROUP BY 1")
def q_peak_horizon(spark, sf_dir):
    return A.peak(q_ic_by_horizon(spark, sf_dir), "horizon", "ic", ["symbol"])


@query(f"{RET}, m AS (SELECT symbol, count(r1) AS n, avg(r1) AS mu, stddev_pop(r1) AS sd FROM ret GROUP BY 1), d AS (SELECT r.symbol, r.r1 - m.mu AS d, sd, n, lag(r.r1 - m.mu) OVER (PARTITION BY r.symbol ORDER BY open_time) AS l1, lag(r.r1 - m.mu, 2) OVER (PARTITION BY r.symbol ORDER BY open_time) AS l2 FROM ret r JOIN m ON r.symbol = m.symbol), a AS (SELECT symbol, any_value(n) AS n, any_value(sd) AS sd, avg(power(d / sd, 3)) AS sk, avg(power(d / sd, 4)) - 3 AS ex, sum(d * l1) / sum(d * d) AS r1, sum(d * l2) / sum(d * d) AS r2 FROM d GROUP BY 1) SELECT symbol, n, round(sd, 6) + 0 AS sd, round(sk, 6) + 0 AS skew, round(ex, 5) + 0 AS excess, round(n / 6.0 * (sk * sk + ex * ex / 4), 3) + 0 AS jarque_bera, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 4) + 0 AS ljung_box FROM a")
def q_bar_return_statistics(spark, sf_dir):
    s = A.return_statistics(rets(spark, sf_dir), "r1", ["symbol"], ["open_time"], 2)
    return s.select("symbol", "n", r("sd").alias("sd"), r("skew").alias("skew"), r("excess_kurtosis", 5).alias("excess"), r("jarque_bera", 3).alias("jarque_bera"), r("ljung_box", 4).alias("ljung_box"))


_KINDS = f"""WITH {TICKS}, {clock_sql(HOUR, 'h')}, ids AS (SELECT *, CAST(floor(sum(CAST(price * quantity AS DECIMAL(38,6))) OVER (PARTITION BY symbol ORDER BY transact_time, agg_trade_id ROWS UNBOUNDED PRECEDING) / 20000) AS BIGINT) AS bar_id FROM ticks),
    d AS (SELECT symbol, min(transact_time) AS open_time, max(transact_time) AS close_time, arg_max(price, (transact_time, agg_trade_id)) AS close FROM ids GROUP BY symbol, bar_id),
    l AS (SELECT 'hour' AS bars, symbol, open_time, close_time, ln(close) AS x FROM h WHERE close > 0 UNION ALL SELECT 'dollar', symbol, open_time, close_time, ln(close) FROM d WHERE close > 0), s AS (SELECT *, lag(x) OVER (PARTITION BY bars, symbol ORDER BY close_time, open_time) AS b FROM l), r AS (SELECT *, x - b AS r FROM s),
    m AS (SELECT bars, symbol, count(r) AS n, avg(r) AS mu, stddev_pop(r) AS sd FROM r GROUP BY 1, 2), t AS (SELECT r.*, r.r - m.mu AS e, m.n, m.sd, lag(r.r - m.mu) OVER w AS e1, lag(r.r - m.mu, 2) OVER w AS e2 FROM r JOIN m USING (bars, symbol) WINDOW w AS (PARTITION BY r.bars, r.symbol ORDER BY close_time, open_time)),
    a AS (SELECT bars, symbol, any_value(n) AS n, any_value(sd) AS sd, avg(power(e / sd, 3)) AS sk, avg(power(e / sd, 4)) - 3 AS ex, sum(e * e1) / sum(e * e) AS r1, sum(e * e2) / sum(e * e) AS r2, regr_sxx(r, b) AS xx, regr_sxy(r, b) AS xy, regr_syy(r, b) AS yy FROM t GROUP BY 1, 2)
    SELECT bars, symbol, n, round(sd, 6) + 0 AS sd, round(n / 6.0 * (sk * sk + ex * ex / 4), 2) + 0 AS jarque_bera, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 4) + 0 AS ljung_box, round(xy / xx / sqrt((yy - xy / xx * xy) / (n - 2) / xx), 5) + 0 AS df_t FROM a"""


@query(_KINDS)
def q_bar_type_comparison(spark, sf_dir):
    from ..operators import bars as B

    kinds = {"hour": hours(spark, sf_dir), "dollar": B.dollar_bars(ticks(spark, sf_dir), 20000)}
    return A.compare_bars(kinds, 2).select("bars", "symbol", "n", r("sd").alias("sd"), r("jarque_bera", 2).alias("jarque_bera"), r("ljung_box", 4).alias("ljung_box"), r("df_t", 5).alias("df_t"))


@query(f"{SCORED}, l AS (SELECT symbol, CAST(floor(p * 20) AS BIGINT) AS lv, count(*) AS n FROM s GROUP BY 1, 2) SELECT symbol, count(*) AS levels, CAST(sum(n) AS BIGINT) AS n, round(max(n) / CAST(sum(n) AS DOUBLE), 6) + 0 AS largest_share FROM l GROUP BY 1")
def q_isotonic_plateaus(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("lv", F.floor(F.col("p") * 20))
    return A.plateaus(s, "lv", ["symbol"]).select("symbol", "levels", "n", r("largest_share").alias("largest_share"))


@query(f"{_labels_sql(1)}, z AS (SELECT barrier_hit, n_bars_held % 3 AS bucket, ret_gross > -0.15 AS kept FROM labels_) SELECT bucket, count(*) AS n, count(CASE WHEN NOT kept THEN 1 END) AS removed, round(CASE WHEN count(CASE WHEN barrier_hit = 'TP' THEN 1 END) > 0 THEN count(CASE WHEN NOT kept AND barrier_hit = 'TP' THEN 1 END) / CAST(count(CASE WHEN barrier_hit = 'TP' THEN 1 END) AS DOUBLE) END, 6) + 0 AS tp_removed, round(CASE WHEN count(CASE WHEN barrier_hit = 'SL' THEN 1 END) > 0 THEN count(CASE WHEN NOT kept AND barrier_hit = 'SL' THEN 1 END) / CAST(count(CASE WHEN barrier_hit = 'SL' THEN 1 END) AS DOUBLE) END, 6) + 0 AS sl_removed FROM z GROUP BY 1")
def q_gate_efficiency(spark, sf_dir):
    lab = barrier_labels(spark, sf_dir, 1).withColumns({"kept": F.col("ret_gross") > -0.15, "bucket": F.col("n_bars_held") % 3})
    g = A.gate_efficiency(lab, "kept", "barrier_hit", "bucket")
    return g.select("bucket", "n", "removed", r("tp_removed").alias("tp_removed"), r("sl_removed").alias("sl_removed"))


@query(f"{_labels_sql(1)}, g AS (SELECT symbol, count(*) AS n, avg(CASE WHEN barrier_hit = 'TP' THEN 1.0 ELSE 0.0 END) AS p FROM labels_ GROUP BY 1) SELECT symbol, n, round(p, 6) + 0 AS p_tp, round(CASE WHEN p > 0 THEN 0.55 / p END, 6) + 0 AS lift, round(CASE WHEN p > 0 THEN 0.55 / (p * p) * sqrt(p * (1 - p) / n) END, 6) + 0 AS lift_error FROM g")
def q_economic_gate_table(spark, sf_dir):
    g = barrier_labels(spark, sf_dir, 1).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("barrier_hit") == "TP", 1.0).otherwise(0.0)).alias("p"))
    b = F.lit(0.55)
    return g.select("symbol", "n", r("p").alias("p_tp"), r(A.required_lift(F.col("p"), b)).alias("lift"), r(A.lift_error(F.col("p"), F.col("n"), b)).alias("lift_error"))


@query(f"{HEAD}, g AS (SELECT symbol, t.tau, count(CASE WHEN close >= t.tau THEN 1 END) / ((max(open_time) - min(open_time)) / (365.25 * 86400000)) AS s FROM bars, (VALUES (40.0), (60.0), (80.0)) t(tau) GROUP BY 1, 2) SELECT CAST(tau AS DOUBLE) AS tau, round(avg(s), 4) + 0 AS mean_signals, round(CASE WHEN min(s) <> 0 THEN max(s) / min(s) END, 5) + 0 AS dispersion FROM g GROUP BY 1")
def q_tau_sweep(spark, sf_dir):
    t = A.tau_sweep(hours(spark, sf_dir), "close", [40, 60, 80], "open_time", ["symbol"])
    return t.select("tau", r("mean_signals", 4).alias("mean_signals"), r("dispersion", 5).alias("dispersion"))


@query(f"{_FILL}, z AS (SELECT side, t_entry IS NOT NULL AS filled, limit_price AS v FROM fills) SELECT side, round(avg(CASE WHEN filled THEN v END), 6) + 0 AS mean_filled, round(avg(CASE WHEN NOT filled THEN v END), 6) + 0 AS mean_open, round(avg(CASE WHEN filled THEN 1.0 ELSE 0.0 END), 6) + 0 AS p_fill FROM z GROUP BY 1")
def q_fill_selectivity(spark, sf_dir):
    filled = F.col("t_entry").isNotNull()
    return fills(spark, sf_dir).groupBy("side").agg(r(F.avg(F.when(filled, F.col("limit_price")))).alias("mean_filled"), r(F.avg(F.when(~filled, F.col("limit_price")))).alias("mean_open"), r(F.avg(F.when(filled, 1.0).otherwise(0.0))).alias("p_fill"))


@query(f"{SCORED}, i AS (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS i, count(*) OVER () AS n FROM s) SELECT CAST(floor(i * 3 / n) AS BIGINT) AS part, symbol, count(*) AS n, round(avg(y), 6) + 0 AS rate FROM i GROUP BY 1, 2")
def q_stratified_terciles(spark, sf_dir):
    return A.quantile_rows(scored(spark, sf_dir), "score", ["id"], 3).groupBy("part", "symbol").agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("rate"))


@query(f"{SCORED}, k AS (SELECT symbol, id % 6 AS per, rank() OVER (PARTITION BY symbol, id % 6 ORDER BY p) + (count(*) OVER (PARTITION BY symbol, id % 6, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol, id % 6 ORDER BY y) + (count(*) OVER (PARTITION BY symbol, id % 6, y) - 1) / 2.0 AS b FROM s), c AS (SELECT symbol, per, corr(a, b) AS ic FROM k GROUP BY 1, 2), m AS (SELECT symbol, avg(ic) AS m FROM c GROUP BY 1) SELECT c.symbol, count(*) AS periods, round(avg(ic), 6) + 0 AS mean_ic, round(max(abs(ic)) / median(abs(ic)), 5) + 0 AS max_over_median, round(avg(CASE WHEN sign(ic) = sign(m) THEN 1.0 ELSE 0.0 END), 6) + 0 AS same_sign FROM c JOIN m ON c.symbol = m.symbol GROUP BY 1")
def q_feature_stability(spark, sf_dir):
    s = A.stability(scored(spark, sf_dir).withColumn("per", F.col("id") % 6), "p", "y", "per", ["symbol"])
    return s.select("symbol", "periods", r("mean_ic").alias("mean_ic"), r("max_over_median", 5).alias("max_over_median"), r("same_sign").alias("same_sign"))


@query(f"{SCORED}, k AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS s, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM s) SELECT 'p' AS feature, count(*) AS n, round(corr(a, b), 6) + 0 AS ic, abs(corr(a, b)) > 0.3 AS suspicious FROM k UNION ALL SELECT 'score', count(*), round(corr(s, b), 6) + 0, abs(corr(s, b)) > 0.3 FROM k")
def q_leakage_scan(spark, sf_dir):
    return A.leakage(scored(spark, sf_dir), ["p", "score"], "y", 0.3).select("feature", "n", r("ic").alias("ic"), "suspicious")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 350000 THEN 'exposure' WHEN o_orderstatus = 'P' AND o_totalprice < 5000 THEN 'stale' END AS trigger, CASE WHEN o_totalprice > 350000 OR (o_orderstatus = 'P' AND o_totalprice < 5000) THEN 'KILLED' ELSE 'ARMED' END AS state FROM orders")
def q_kill_switch(spark, sf_dir):
    from ..sources import tables as S

    o = S.table(spark, sf_dir, "orders")
    k = A.kill_switch(o, {"exposure": F.col("o_totalprice") > 350000, "stale": (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 5000)})
    return k.select("o_orderkey", "trigger", "state")


def _of(n: int, x: str = "r1", f: str = "stddev_samp") -> str:
    return full(f"{f}({x})", x, n)


#: Catalogue ids that windows give; those of the recurrences are held against ema, atr, rsi and macd_hist.
_CATALOGUE = f"""{HEAD}, p AS (SELECT *, lag(close) OVER {O} AS pc, lag(close, 3) OVER {O} AS c3, lag(close, 4) OVER {O} AS c4, lag(close, 12) OVER {O} AS c12, lag(close, 48) OVER {O} AS c48, lag(high) OVER {O} AS ph, lag(low) OVER {O} AS pl FROM bars),
    q AS (SELECT *, ({log('close')}) - ({log('pc')}) AS r1, ({log('close')}) - ({log('c3')}) AS r3, ({log('close')}) - ({log('c12')}) AS r12, abs(close - pc) AS st, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close - open AS body, abs(close - open) AS size, ln(1 + volume) AS lv,
      CASE WHEN volume > 0 THEN 2 * taker_buy_volume / CAST(volume AS DOUBLE) - 1 END AS taker FROM p),
    w AS (SELECT *, {_of(12)} AS rv12, {_of(96)} AS rv96, {_of(48)} AS rv48, {_of(3)} AS rv3, avg(lv) OVER e AS lm, stddev_samp(lv) OVER e AS ls, count(lv) OVER e AS ln_, {_of(48, 'taker', 'avg')} AS tm, {_of(48, 'taker')} AS ts FROM q WINDOW e AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT symbol, open_time, round(r12, 6) + 0 AS a04, round(CASE WHEN pc IS NOT NULL AND pc <> 0 THEN tr / pc END, 6) + 0 AS a11, round(({log('close')}) - ({log('open')}), 6) + 0 AS a18, round(ln(1 + (close_time - open_time) / 1000.0e0), 6) + 0 AS a20,
      round(CASE WHEN c12 <> 0 THEN (close - c12) / c12 END, 6) + 0 AS b03, round(CASE WHEN {_of(48, 'st', 'sum')} > 0 THEN abs(close - c48) / {_of(48, 'st', 'sum')} END, 6) + 0 AS b07, round(CASE WHEN rv3 > 0 THEN abs(r3) / (rv3 * sqrt(3.0e0)) END, 5) + 0 AS b13,
      round(CASE WHEN {_of(3, 'size', 'sum')} > 0 THEN {_of(3, 'body', 'sum')} / {_of(3, 'size', 'sum')} END, 6) + 0 AS b17, round(rv48 * sqrt(48.0e0), 6) + 0 AS c03, round(CASE WHEN rv96 > 0 THEN rv12 * sqrt(12.0e0) / (rv96 * sqrt(96.0e0)) END, 6) + 0 AS c06, round({_of(48, 'rv12')} * sqrt(12.0e0), 6) + 0 AS c12,
      round(CASE WHEN ln_ >= 2 AND ls > 0 THEN (lv - lm) / ls END, 5) + 0 AS d03, round(CASE WHEN ts > 0 THEN (taker - tm) / ts END, 5) + 0 AS d06, CASE WHEN close_time // 3600000 % 24 < 8 THEN 1.0e0 ELSE 0.0e0 END AS k04 FROM w"""


@query(_CATALOGUE)
def q_feature_catalogue(spark, sf_dir):
    from ..operators import catalogue as G

    shown = {"a04": "A04_log_return_12", "a11": "A11_true_range_pct", "a18": "A18_body_log", "a20": "A20_log_duration", "b03": "B03_roc_12", "b07": "B07_efficiency_ratio_48", "b17": "B17_directional_pressure_h3", "c03": "C03_realized_vol_48", "c06": "C06_vol_ratio_12_96", "c12": "C12_vol_of_vol_48"}
    five = {"b13": "B13_extension_h3", "d03": "D03f_volume_z_expanding", "d06": "D06f_taker_imbalance_z_48"}
    df = G.catalogue(hours(spark, sf_dir), [*shown.values(), *five.values(), "K04_session_asia"])
    return df.select("symbol", "open_time", *[r(c).alias(k) for k, c in shown.items()], *[r(c, 5).alias(k) for k, c in five.items()], F.col("K04_session_asia").alias("k04"))


@query()
def q_feature_frame(spark, sf_dir):
    df = X.frame(hours(spark, sf_dir), mask_warmup=True)
    return df.select("symbol", "open_time", "close_time", *[r(c).alias(c) for c in X.ACTIVE])


@query(
    f"""{SCORED}, g AS (SELECT range AS i FROM range(1001)), q AS (SELECT i, (SELECT quantile_cont(p, list_transform(range(1001), lambda k: k / 1000.0::DOUBLE)) FROM s)[i + 1] AS a, (SELECT quantile_cont(1 - p, list_transform(range(1001), lambda k: k / 1000.0::DOUBLE)) FROM s)[i + 1] AS b FROM g),
    d AS (SELECT p, count(*) AS n FROM s GROUP BY 1), h AS (SELECT i, sum(CASE WHEN p >= a OR 1 - p >= b THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS share FROM q, d GROUP BY 1),
    x AS (SELECT coalesce(min(CASE WHEN share <= 0.3 AND i BETWEEN 1 AND 999 THEN i END), 1000) AS i FROM h) SELECT round(a, 9) + 0 AS tau_long, round(b, 9) + 0 AS tau_short FROM q JOIN x USING (i)"""
)
def q_joint_threshold(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("q", 1 - F.col("p"))
    a, b = A.joint_threshold(s, "p", "q", 0.3)
    return spark.createDataFrame([(round(float(a), 9), round(float(b), 9))], "tau_long double, tau_short double")


@query()
def q_orthogonal_selection(spark, sf_dir):
    df = X.frame(hours(spark, sf_dir), ["ret_1", "vol_24", "parkinson_24", "er_24", "stoch_14", "taker"])
    return spark.createDataFrame([(i, n) for i, n in enumerate(A.orthogonal(df, ["ret_1", "vol_24", "parkinson_24", "er_24", "stoch_14", "taker"], "vol_24", 0.5))], "place int, feature string")


@query(f"{_labels_sql(1)} SELECT symbol, count(*) AS n, count(CASE WHEN barrier_hit = 'TP' THEN 1 END) AS tp FROM labels_ GROUP BY 1")
def q_outcome_by_symbol(spark, sf_dir):
    return barrier_labels(spark, sf_dir, 1).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("barrier_hit") == "TP").alias("tp"))

