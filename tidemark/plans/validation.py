"""Splits, scores and tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import validation as V
from ..sources import tables as S
from .base import HEAD, HOUR, TICKS, hours, query, r, ticks
from .joins import _FILL, _labels_sql, barrier_labels, fills

#: Scored rows: one for each event, p from its k, a label from its id, a continuous score from its value.
SCORED = f"WITH {TICKS}, s AS (SELECT symbol, agg_trade_id AS id, (quantity - 0.5) / 100.0 AS p, price AS score, CASE WHEN (agg_trade_id * 7919) % 100 < quantity THEN 1 ELSE 0 END AS y, price - 40 AS margin FROM ticks)"


def scored(spark, sf_dir):
    return ticks(spark, sf_dir).select(
        "symbol", F.col("agg_trade_id").alias("id"), ((F.col("quantity") - 0.5) / 100.0).alias("p"), F.col("price").alias("score"), F.when((F.col("agg_trade_id") * 7919) % 100 < F.col("quantity"), 1).otherwise(0).alias("y"), (F.col("price") - 40).alias("margin")
    )


#: Labels: an interval of eight hours from each bar.
_SPANS = f"{HEAD}, labels_ AS (SELECT symbol || ':' || open_time AS label_id, open_time AS t0, open_time + {8 * HOUR} AS t1 FROM bars)"


def spans(spark, sf_dir):
    return hours(spark, sf_dir).select(F.concat_ws(":", "symbol", "open_time").alias("label_id"), F.col("open_time").alias("t0"), (F.col("open_time") + 8 * HOUR).alias("t1"))


_EDGES = "e AS (SELECT i, CASE WHEN i = 6 THEN hi + 1 ELSE lo + CAST(round_even((hi - lo) * i / 6.0, 0) AS BIGINT) END AS edge FROM (SELECT min(t0) AS lo, max(t0) AS hi FROM labels_), range(7) t(i))"
_GROUPED = f"{_SPANS}, {_EDGES}, g AS (SELECT l.*, CAST((SELECT count(*) FROM e WHERE i BETWEEN 1 AND 5 AND edge <= l.t0) AS INTEGER) AS grp FROM labels_ l)"


@query(f"{_GROUPED} SELECT grp, count(*) AS n, min(t0) AS first, max(t0) AS last FROM g GROUP BY 1")
def q_cpcv_groups(spark, sf_dir):
    rows = spans(spark, sf_dir)
    low, high = rows.agg(F.min("t0"), F.max("t0")).first()
    return rows.groupBy(V.time_group(F.col("t0"), V.edges(low, high, 6)).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("first"), F.max("t0").alias("last"))


_EMBARGO = 2 * HOUR
_PAIRS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(combinations(range(6), 2)))
_ROLES = f"""{_GROUPED}, b AS (SELECT a.i AS grp, a.edge AS s, z.edge - 1 AS t, greatest(z.edge - 1, (SELECT max(t1) FROM g WHERE g.grp = a.i)) AS te FROM e a JOIN e z ON z.i = a.i + 1),
sp AS (SELECT * FROM (VALUES {_PAIRS}) v(split_id, ga, gb)),
x AS (SELECT sp.split_id, g.label_id, g.grp, CASE WHEN g.grp IN (ga, gb) THEN 'test'
  WHEN (g.t0 <= a.te AND g.t1 >= a.s) OR (g.t0 <= z.te AND g.t1 >= z.s) THEN 'purged'
  WHEN (g.t0 > a.t AND g.t0 <= a.t + {_EMBARGO}) OR (g.t0 >= a.s - {_EMBARGO} AND g.t0 < a.s) OR (g.t0 > z.t AND g.t0 <= z.t + {_EMBARGO}) OR (g.t0 >= z.s - {_EMBARGO} AND g.t0 < z.s) THEN 'embargo' ELSE 'train' END AS role
  FROM g, sp JOIN b a ON a.grp = sp.ga JOIN b z ON z.grp = sp.gb)"""


@query(f"{_ROLES} SELECT CAST(split_id AS INTEGER) AS split_id, label_id, grp, role FROM x")
def q_cpcv_splits_roles(spark, sf_dir):
    return V.purged_splits(spans(spark, sf_dir), 6, 2, _EMBARGO)


@query(f"{_ROLES} SELECT CAST(split_id AS INTEGER) AS split_id, role, count(*) AS n FROM x GROUP BY 1, 2")
def q_purge_embargo_counts(spark, sf_dir):
    return V.purged_splits(spans(spark, sf_dir), 6, 2, _EMBARGO).groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n"))




@query(
    f"{_SPANS}, w AS (SELECT label_id, t0 * 12 AS t0, t1 * 12 - 11 * t0 + t0 * 0 AS t1x, t0 AS raw FROM labels_), l AS (SELECT label_id, raw * 12 AS t0, raw * 12 + {8 * HOUR} AS t1 FROM w), "
    "p AS (SELECT *, CAST(year(epoch_ms(t0)) * 4 + quarter(epoch_ms(t0)) AS INTEGER) AS period FROM l), q AS (SELECT period, min(t0) AS b, row_number() OVER (ORDER BY period) AS n FROM p GROUP BY 1) "
    "SELECT test_period, role, count(*) AS n FROM (SELECT q.period AS test_period, 'test' AS role FROM q JOIN p ON p.period = q.period WHERE q.n > 2 UNION ALL SELECT q.period, 'train' FROM q JOIN p ON p.t0 < q.b AND p.t1 < q.b WHERE q.n > 2) GROUP BY 1, 2"
)
def q_walkforward_splits(spark, sf_dir):
    # the events span a month: times are stretched twelvefold so that there are quarters
    rows = spans(spark, sf_dir).select("label_id", (F.col("t0") * 12).alias("t0")).withColumn("t1", F.col("t0") + 8 * HOUR)
    return V.walk_forward(rows, 2).groupBy("test_period", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SPANS}, c AS (SELECT quantile_cont(t0, 0.8) AS cut FROM labels_) SELECT CASE WHEN t0 >= cut THEN 'calibration' WHEN t1 >= cut THEN 'purged' ELSE 'fit' END AS role, count(*) AS n FROM labels_, c GROUP BY 1")
def q_temporal_holdout(spark, sf_dir):
    return V.temporal_holdout(spans(spark, sf_dir), 0.2).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SCORED}, i AS (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS i, count(*) OVER () AS n FROM s) SELECT CAST(floor(i * 10 / n) AS BIGINT) AS bucket, count(*) AS n, round(avg(y), 6) + 0 AS mean_value, min(score) AS low, max(score) AS high FROM i GROUP BY 1")
def q_decile_profile(spark, sf_dir):
    return V.decile_profile(scored(spark, sf_dir), "score", ["id"], "y").select("bucket", "n", r("mean_value").alias("mean_value"), "low", "high")


_SPEARMAN = "rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


@query(f"{SCORED}, k AS (SELECT symbol, {_SPEARMAN.format(by='symbol', c='p')} AS a, {_SPEARMAN.format(by='symbol', c='score')} AS b FROM s) SELECT symbol, count(*) AS n, round(corr(a, b), 6) + 0 AS ic FROM k GROUP BY 1")
def q_spearman_ic(spark, sf_dir):
    return V.spearman(scored(spark, sf_dir), "p", "score", ["symbol"]).select("symbol", "n", r("ic").alias("ic"))


@query(f"{SCORED}, s2 AS (SELECT *, id % 4 AS slot FROM s), k AS (SELECT symbol, slot, {_SPEARMAN.format(by='symbol, slot', c='p')} AS a, {_SPEARMAN.format(by='symbol, slot', c='score')} AS b FROM s2) SELECT symbol, slot, round(corr(a, b), 6) + 0 AS ic FROM k GROUP BY 1, 2")
def q_ic_disjoint(spark, sf_dir):
    return V.spearman(scored(spark, sf_dir).withColumn("slot", F.col("id") % 4), "p", "score", ["symbol", "slot"]).select("symbol", "slot", r("ic").alias("ic"))


@query(f"{SCORED}, k AS (SELECT symbol, y, {_SPEARMAN.format(by='symbol', c='p')} AS a FROM s), d AS (SELECT symbol, p, sum(y) AS pos, count(*) AS k FROM s GROUP BY 1, 2), c AS (SELECT symbol, pos, sum(pos) OVER w / CAST(sum(k) OVER w AS DOUBLE) AS prec FROM d WINDOW w AS (PARTITION BY symbol ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), q AS (SELECT symbol, sum(pos * prec) / sum(pos) AS pr FROM c GROUP BY 1), t AS (SELECT symbol, sum(CASE WHEN y = 1 THEN a END) AS sm, CAST(sum(y) AS BIGINT) AS p1, CAST(sum(1 - y) AS BIGINT) AS n0 FROM k GROUP BY 1) SELECT t.symbol, p1 AS n_pos, n0 AS n_neg, round((sm - p1 * (p1 + 1) / 2.0) / (CAST(p1 AS DOUBLE) * n0), 6) + 0 AS roc_auc, round(pr, 6) + 0 AS pr_auc FROM t JOIN q ON t.symbol = q.symbol")
def q_auc_ranksum(spark, sf_dir):
    return V.auc(scored(spark, sf_dir), "p", "y", ["symbol"]).select("symbol", "n_pos", "n_neg", r("roc_auc").alias("roc_auc"), r("pr_auc").alias("pr_auc"))


@query(f"{SCORED} SELECT symbol, count(*) AS n, round(avg((p - y) * (p - y)), 6) + 0 AS brier, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) + 0 AS log_loss FROM s GROUP BY 1")
def q_log_loss_brier(spark, sf_dir):
    return V.losses(scored(spark, sf_dir), "p", "y", ["symbol"]).select("symbol", "n", r("brier").alias("brier"), r("log_loss").alias("log_loss"))


@query(f"{SCORED}, b AS (SELECT symbol, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM s GROUP BY 1, 2) SELECT symbol, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(c - a)) / sum(n), 6) + 0 AS ece FROM b GROUP BY 1")
def q_ece(spark, sf_dir):
    return V.expected_calibration_error(scored(spark, sf_dir), "p", "y", 10, ["symbol"]).select("symbol", "n", r("ece").alias("ece"))


@query(f"{SCORED} SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 6) + 0 AS confidence, round(avg(y), 6) + 0 AS accuracy FROM s GROUP BY 1")
def q_calibration_table(spark, sf_dir):
    return V.calibration(scored(spark, sf_dir), "p", "y").select("bin", "n", r("confidence").alias("confidence"), r("accuracy").alias("accuracy"))


@query(f"{_labels_sql(1)} SELECT symbol, count(*) AS n, round(avg(ret_gross), 6) + 0 AS mean, round(avg(ret_gross) / stddev_samp(ret_gross) * sqrt(count(*) / ((max(t0) - min(t0)) / (365.25 * 86400000))), 4) + 0 AS sharpe, round(avg(CASE WHEN ret_gross > 0 THEN 1.0 ELSE 0.0 END), 6) + 0 AS win_rate FROM labels_ GROUP BY 1")
def q_sharpe_by_path(spark, sf_dir):
    g = barrier_labels(spark, sf_dir, 1).groupBy("symbol")
    return g.agg(F.count(F.lit(1)).alias("n"), r(F.avg("ret_gross")).alias("mean"), r(V.sharpe("ret_gross", F.min("t0"), F.max("t0")), 4).alias("sharpe"), r(F.avg(F.when(F.col("ret_gross") > 0, 1.0).otherwise(0.0))).alias("win_rate"))


@query(f"""{_labels_sql(1)}, mo AS (SELECT symbol, count(*) AS n, avg(ret_gross) AS mu, stddev_pop(ret_gross) AS sd FROM labels_ GROUP BY 1),
st AS (SELECT mo.symbol, any_value(mo.n) AS n, any_value(mu / sd) AS sr, avg(power((ret_gross - mu) / sd, 3)) AS sk, avg(power((ret_gross - mu) / sd, 4)) - 3 AS ex FROM labels_ l JOIN mo ON l.symbol = mo.symbol GROUP BY 1)
SELECT symbol, n, round(sr, 6) + 0 AS sr, round(sk, 5) + 0 AS skew, round(ex, 4) + 0 AS excess, round(sr / sqrt((1 - sk * sr + ex / 4 * sr * sr) / (n - 1)), 5) + 0 AS psr_z FROM st""")
def q_psr_dsr(spark, sf_dir):
    m = V.moments(barrier_labels(spark, sf_dir, 1), "ret_gross", ["symbol"]).withColumn("sr", F.col("mean") / F.col("sd"))
    z = V.psr_statistic(F.col("sr"), 0.0, F.col("n"), F.col("skew"), F.col("excess_kurtosis"))
    return m.select("symbol", "n", r("sr").alias("sr"), r("skew", 5).alias("skew"), r("excess_kurtosis", 4).alias("excess"), r(z, 5).alias("psr_z"))


_P = "WITH t AS (SELECT c_custkey AS id, c_nationkey AS fam, ((c_custkey * 7919) % 10007 + 1) / 10008.0 AS p FROM customer)"


def pvalues(spark, sf_dir):
    return S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("fam"), (((F.col("c_custkey") * 7919) % 10007 + 1) / 10008.0).alias("p"))


@query(f"{_P}, k AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY fam) AS m FROM t) SELECT id, round(least(1.0, min(p * m / rk) OVER (PARTITION BY fam ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) + 0 AS adjusted FROM k")
def q_bh_fdr(spark, sf_dir):
    return V.fdr(pvalues(spark, sf_dir), "p", ["fam"]).select("id", r("adjusted").alias("adjusted"))


@query(f"{_P}, k AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY fam) AS m FROM t), c AS (SELECT fam, list_sum(list_transform(range(1, max(m) + 1), lambda i: 1.0::DOUBLE / i)) AS c FROM k GROUP BY 1), h AS (SELECT k.*, c.c FROM k JOIN c ON k.fam = c.fam) SELECT id, round(least(1.0, min(p * m * c / rk) OVER (PARTITION BY fam ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) + 0 AS adjusted FROM h")
def q_by_fdr(spark, sf_dir):
    return V.fdr(pvalues(spark, sf_dir), "p", ["fam"], yekutieli=True).select("id", r("adjusted").alias("adjusted"))


@query(f"{SCORED}, k AS (SELECT *, row_number() OVER (ORDER BY margin DESC, id) AS rk, count(*) OVER () AS n FROM s) SELECT id, round(margin, 6) + 0 AS margin FROM k WHERE rk <= ceil(0.1 * n) AND margin > 0")
def q_top_q_by_margin(spark, sf_dir):
    return V.top_share(scored(spark, sf_dir), "margin", ["id"], 0.1).select("id", r("margin").alias("margin"))


@query("WITH k AS (SELECT o_orderkey, o_custkey % 25 AS grp, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) SELECT grp, o_orderkey, o_totalprice, rk FROM k WHERE rk <= 5")
def q_topk_per_group(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("grp"), "o_totalprice")
    return o.withColumn("rk", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rk <= 5").select("grp", "o_orderkey", "o_totalprice", F.col("rk").cast("long").alias("rk"))


@query("WITH c AS (SELECT o_custkey % 10 AS path, o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), t AS (SELECT path, sum(v) AS t FROM c GROUP BY 1) SELECT c.path, round(sum(power(v / t, 2)), 8) + 0 AS hhi, round(1 / sum(power(v / t, 2)), 4) + 0 AS effective_number, round(exp(-sum(v / t * ln(v / t))), 4) + 0 AS hill FROM c JOIN t ON c.path = t.path GROUP BY 1")
def q_hhi(spark, sf_dir):
    c = S.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("path"), F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return V.hhi(c, "v", ["path"]).select("path", r("hhi", 8).alias("hhi"), r("effective_number", 4).alias("effective_number"), r("hill", 4).alias("hill"))


@query(f"{SCORED} SELECT symbol, round(count(CASE WHEN p > 0.6 AND score > 60 THEN 1 END) / CAST(count(CASE WHEN p > 0.6 OR score > 60 THEN 1 END) AS DOUBLE), 6) + 0 AS jaccard FROM s GROUP BY 1")
def q_jaccard_accept_sets(spark, sf_dir):
    s = scored(spark, sf_dir).withColumns({"a": F.col("p") > 0.6, "b": F.col("score") > 60})
    return V.jaccard(s, "a", "b", ["symbol"]).select("symbol", r("jaccard").alias("jaccard"))


@query(f"{SCORED}, g AS (SELECT symbol, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM s GROUP BY 1), w AS (SELECT *, n / v AS w, count(*) OVER () AS k, sum(n / v) OVER () AS sw, sum(n / v * m) OVER () AS swm, sum(n) OVER () AS nn, sum(n * m) OVER () AS snm, sum((n - 1) * v) OVER () AS wi FROM g), t AS (SELECT k, nn, wi, sum(w * power(m - swm / sw, 2)) AS bw, sum(power(1 - w / sw, 2) / (n - 1)) AS lam, sum(n * power(m - snm / nn, 2)) AS b FROM w GROUP BY 1, 2, 3) SELECT k AS groups, round((bw / (k - 1)) / (1 + 2 * (k - 2) / CAST(k * k - 1 AS DOUBLE) * lam), 6) + 0 AS welch_f, round((k * k - 1) / (3 * lam), 2) + 0 AS df2, round((b - (k - 1) * wi / (nn - k)) / (b + wi + wi / (nn - k)), 6) + 0 AS omega2 FROM t")
def q_anova_by_group(spark, sf_dir):
    return V.anova(scored(spark, sf_dir), "symbol", "score").select("groups", r("welch_f").alias("welch_f"), r("df2", 2).alias("df2"), r("omega2").alias("omega2"))


@query(f"{SCORED}, g AS (SELECT id % 10 AS fam, symbol, avg(score) AS e, stddev_samp(score) / sqrt(count(*)) AS se FROM s GROUP BY 1, 2), q AS (SELECT fam, count(*) AS k, sum(e / (se * se)) / sum(1 / (se * se)) AS pooled, sum(e * e / (se * se)) - power(sum(e / (se * se)), 2) / sum(1 / (se * se)) AS q FROM g GROUP BY 1) SELECT fam, k, round(pooled, 5) + 0 AS pooled, round(q, 4) + 0 AS q, round(CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) * 100 ELSE 0 END, 3) + 0 AS i2 FROM q")
def q_cochran_q(spark, sf_dir):
    g = scored(spark, sf_dir).groupBy((F.col("id") % 10).alias("fam"), "symbol").agg(F.avg("score").alias("e"), (F.stddev_samp("score") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return V.cochran_q(g, "e", "se", ["fam"]).select("fam", "k", r("pooled", 5).alias("pooled"), r("q", 4).alias("q"), r("i2", 3).alias("i2"))


@query(f"{SCORED} SELECT symbol, round(corr(p, y), 6) + 0 AS p_y, round(corr(score, y), 6) + 0 AS score_y, round(corr(p, score), 6) + 0 AS p_score FROM s GROUP BY 1")
def q_correlation_matrix(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("symbol").agg(r(F.corr("p", "y")).alias("p_y"), r(F.corr("score", "y")).alias("score_y"), r(F.corr("p", "score")).alias("p_score"))


@query(f"{SCORED} SELECT symbol, round(sum(p * y) / sum(p), 6) + 0 AS weighted_rate FROM s GROUP BY 1")
def q_weighted_rate(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("symbol").agg(r(F.try_divide(F.sum(F.col("p") * F.col("y")), F.sum("p"))).alias("weighted_rate"))


@query(f"{SCORED}, d AS (SELECT *, 1 - p AS q FROM s) SELECT symbol, CASE WHEN p >= 0.55 AND (NOT q >= 0.52 OR p >= q) THEN 1 WHEN q >= 0.52 THEN -1 ELSE 0 END AS side, count(*) AS n FROM d GROUP BY 1, 2")
def q_decide_side(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("side", costs.decide_side(F.col("p"), 1 - F.col("p"), 0.55, 0.52)).groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SCORED} SELECT symbol, round(quantile_cont(score, 0.25), 6) + 0 AS q25, round(quantile_cont(score, 0.5), 6) + 0 AS q50, round(quantile_cont(score, 0.9), 6) + 0 AS q90 FROM s GROUP BY 1")
def q_quantile_threshold(spark, sf_dir):
    g = scored(spark, sf_dir).groupBy("symbol")
    return g.agg(*[r(F.percentile("score", q)).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q90", 0.9))])


@query(f"{SCORED}, c AS (SELECT quantile_cont(score, 1 / 3.0) AS a, quantile_cont(score, 2 / 3.0) AS b FROM s) SELECT (CASE WHEN score <= a THEN 'LOW' WHEN score <= b THEN 'MID' ELSE 'HIGH' END) || '_' || (CASE WHEN symbol IN ('click', 'view') THEN 'RANGE' ELSE 'TREND' END) AS environment, count(*) AS n, round(avg(y), 6) + 0 AS rate FROM s, c GROUP BY 1")
def q_environments(spark, sf_dir):
    s = scored(spark, sf_dir)
    cut = s.agg(F.percentile("score", 1 / 3).alias("a"), F.percentile("score", 2 / 3).alias("b"))
    level = F.when(F.col("score") <= F.col("a"), "LOW").when(F.col("score") <= F.col("b"), "MID").otherwise("HIGH")
    group = F.when(F.col("symbol").isin("click", "view"), "RANGE").otherwise("TREND")
    return s.crossJoin(F.broadcast(cut)).groupBy(F.concat_ws("_", level, group).alias("environment")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("rate"))


@query(f"{_FILL} SELECT CASE WHEN grouping(symbol) = 1 THEN 'ALL' ELSE symbol END AS symbol, CAST(side AS INTEGER) AS side, count(*) AS n, round(avg(CASE WHEN t_entry IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) + 0 AS filled FROM fills GROUP BY GROUPING SETS ((symbol, side), (symbol), ())")
def q_rollup_pooled_strata(spark, sf_dir):
    f = fills(spark, sf_dir)
    g = f.rollup("symbol", "side").agg(F.grouping("symbol").alias("all"), F.count(F.lit(1)).alias("n"), r(F.avg(F.when(F.col("t_entry").isNotNull(), 1.0).otherwise(0.0))).alias("filled"))
    return g.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("symbol")).alias("symbol"), "side", "n", "filled")


@query(f"{_labels_sql(1)}, mo AS (SELECT symbol, avg(ret_gross) AS m FROM labels_ GROUP BY 1) SELECT count(*) AS n, round(avg(m), 6) + 0 AS mean, round(median(m), 6) + 0 AS median, round(stddev_samp(m), 6) + 0 AS std, round(min(m), 6) + 0 AS low, round(max(m), 6) + 0 AS high FROM mo")
def q_path_dispersion(spark, sf_dir):
    m = barrier_labels(spark, sf_dir, 1).groupBy("symbol").agg(F.avg("ret_gross").alias("m"))
    return m.agg(F.count(F.lit(1)).alias("n"), r(F.avg("m")).alias("mean"), r(F.median("m")).alias("median"), r(F.stddev_samp("m")).alias("std"), r(F.min("m")).alias("low"), r(F.max("m")).alias("high"))


@query(f"{_labels_sql(1)}, c AS (SELECT *, CAST(-0.0002 AS DOUBLE) AS entry, CAST(CASE WHEN barrier_hit = 'TP' THEN -0.0002 ELSE -0.0005 END AS DOUBLE) AS ex, CAST(0.0001 AS DOUBLE) * n_bars_held AS funding FROM labels_) SELECT symbol, round(sum(ret_gross), 6) + 0 AS directional, round(-sum(funding), 6) + 0 AS carry, round(sum(entry + ex), 6) + 0 AS execution, round(sum(ret_gross - funding + entry + ex), 6) + 0 AS net FROM c GROUP BY 1")
def q_pnl_decomposition(spark, sf_dir):
    lab = barrier_labels(spark, sf_dir, 1)
    entry, exit_ = F.lit(-0.0002), F.when(F.col("barrier_hit") == "TP", -0.0002).otherwise(-0.0005)
    funding = 0.0001 * F.col("n_bars_held")
    return lab.groupBy("symbol").agg(r(F.sum("ret_gross")).alias("directional"), r(-F.sum(funding)).alias("carry"), r(F.sum(entry + exit_)).alias("execution"), r(F.sum(F.col("ret_gross") - funding + entry + exit_)).alias("net"))


@query(
    f"""WITH {TICKS}, v AS (SELECT transact_time // 86400000 AS day, symbol, avg(price - 50) AS x FROM ticks GROUP BY 1, 2), d AS (SELECT day, symbol, coalesce(x, 0) AS x FROM (SELECT DISTINCT day FROM v) CROSS JOIN (SELECT DISTINCT symbol FROM v) LEFT JOIN v USING (day, symbol)),
    b AS (SELECT day % 8 AS block, symbol, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM d GROUP BY 1, 2), c AS (SELECT range AS c FROM range(256) WHERE bit_count(range) = 4),
    h AS (SELECT c, symbol, (c >> block) & 1 = 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM b, c GROUP BY 1, 2, 3), k AS (SELECT c, symbol, inside, CASE WHEN (q - s * s / n) / (n - 1) > 0 THEN s / n / sqrt((q - s * s / n) / (n - 1)) ELSE 0 END AS score FROM h),
    best AS (SELECT c, arg_min(symbol, (-score, symbol)) AS symbol FROM k WHERE inside GROUP BY 1), o AS (SELECT b.c, (SELECT score FROM k WHERE k.c = b.c AND NOT k.inside AND k.symbol = b.symbol) AS v FROM best b),
    r AS (SELECT o.c, (count(CASE WHEN k.score < o.v THEN 1 END) + (count(CASE WHEN k.score = o.v THEN 1 END) + 1) / 2.0) / (count(*) + 1) AS rank FROM o JOIN k ON k.c = o.c AND NOT k.inside GROUP BY 1)
    SELECT round(avg(CASE WHEN rank <= 0.5 THEN 1.0 ELSE 0.0 END), 9) + 0 AS pbo, CAST(count(*) AS INTEGER) AS n_combinations FROM r"""
)
def q_pbo_cscv(spark, sf_dir):
    t = ticks(spark, sf_dir)
    days = t.groupBy(F.expr("transact_time div 86400000").alias("day")).pivot("symbol").agg(F.avg(F.col("price") - 50)).na.fill(0.0)
    names = sorted(c for c in days.columns if c != "day")
    blocks = days.withColumn("block", (F.col("day") % 8).cast("int"))
    out = V.pbo(blocks, "block", names, 8)
    return spark.createDataFrame([(round(out["pbo"], 9), out["n_combinations"])], "pbo double, n_combinations int")


@query(f"{HEAD}, p AS (SELECT symbol, open_time, close, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS pc FROM bars), v AS (SELECT symbol, open_time, power(CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END, 2) AS rv FROM p), f AS (SELECT symbol, rv, avg(rv) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS a, lag(rv) OVER (PARTITION BY symbol ORDER BY open_time) AS b FROM v), l AS (SELECT symbol, CASE WHEN a > 0 AND rv > 0 AND b > 0 THEN rv / a - ln(rv / a) - 1 END AS la, CASE WHEN b > 0 AND rv > 0 AND a > 0 THEN rv / b - ln(rv / b) - 1 END AS lb, rv, a FROM f) SELECT symbol, count(la - lb) AS n, round(avg(la), 6) + 0 AS qlike_mean, round(avg(la - lb) / (stddev_samp(la - lb) / sqrt(count(la - lb))), 5) + 0 AS dm, round(regr_slope(rv, a), 6) + 0 AS slope, round(regr_intercept(rv, a), 6) + 0 AS intercept, round(regr_r2(rv, a), 6) + 0 AS r2 FROM l GROUP BY 1")
def q_forecast_losses(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("open_time")
    b = hours(spark, sf_dir).withColumn("pc", F.lag("close").over(w))
    b = b.withColumn("rv", F.pow(F.when((F.col("close") > 0) & (F.col("pc") > 0), F.log(F.col("close") / F.col("pc"))), 2))
    b = b.withColumns({"a": F.avg("rv").over(w.rowsBetween(-24, -1)), "b": F.lag("rv").over(w)})
    both = (F.col("a") > 0) & (F.col("b") > 0)
    b = b.withColumns({"la": F.when(both, V.qlike(F.col("a"), F.col("rv"))), "lb": F.when(both, V.qlike(F.col("b"), F.col("rv")))})
    dm = V.diebold_mariano(b, "la", "lb", ["symbol"])
    fit = b.groupBy("symbol").agg(F.avg("la").alias("q"), F.regr_slope("rv", "a").alias("s"), F.regr_intercept("rv", "a").alias("i"), F.regr_r2("rv", "a").alias("r2"))
    return dm.join(fit, "symbol").select("symbol", "n", r("q").alias("qlike_mean"), r("dm", 5).alias("dm"), r("s").alias("slope"), r("i").alias("intercept"), r("r2").alias("r2"))
