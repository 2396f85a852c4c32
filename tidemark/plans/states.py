"""Regimes, fitted models, resampling: recurrences and seeded draws, which SQL does not express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boosting as G
from ..operators import models as M
from ..operators import regime as R
from ..operators import windows as W
from .base import HEAD, TICKS, hours, query, r, ticks
from .windows import O, full, log


def measured(spark, sf_dir):
    """Hourly bars with trend, volatility and return."""
    step, ratio = W.efficiency_ratio("close", 12)
    df = hours(spark, sf_dir).withColumn("_step", step).withColumn("er", F.round(ratio, 9)).withColumn("r1", W.log_return("close")).withColumn("vol", F.round(W.rolling(F.stddev_samp("r1"), "r1", 12), 9)).drop("_step")
    ranked = W.percentile_rank(df, "vol", name="vol_rank").join(W.percentile_rank(df, "er", name="er_rank"), ["symbol", "open_time"])
    return df.join(ranked, ["symbol", "open_time"]).withColumn("stressed", F.coalesce(F.abs("r1") > 3.5, F.lit(False)))


def _expanding(x: str) -> str:
    """Share of the earlier known values that are not above this one."""
    return f"CASE WHEN a.{x} IS NOT NULL AND count(b.{x}) > 0 THEN count(CASE WHEN b.{x} <= a.{x} THEN 1 END) / CAST(count(b.{x}) AS DOUBLE) END"


MEASURED = f"""p AS (SELECT *, lag(close) OVER {O} AS pc, abs(close - lag(close) OVER {O}) AS st, abs(close - lag(close, 12) OVER {O}) AS net, row_number() OVER {O} AS i FROM bars),
    q AS (SELECT *, ({log('close')}) - ({log('pc')}) AS r1 FROM p), w AS (SELECT symbol, open_time, i, r1, round(CASE WHEN {full('sum(st)', 'st', 12)} > 0 THEN net / {full('sum(st)', 'st', 12)} END, 9) AS er, round({full('stddev_samp(r1)', 'r1', 12)}, 9) AS vol FROM q),
    measured AS (SELECT a.symbol, a.open_time, a.i, any_value(coalesce(abs(a.r1) > 3.5, false)) AS s, {_expanding('er')} AS e, {_expanding('vol')} AS v FROM w a LEFT JOIN w b ON b.symbol = a.symbol AND b.i < a.i GROUP BY a.symbol, a.open_time, a.i, a.er, a.vol)"""


def _machine(cells: list[tuple[float, float, float, float]]) -> str:
    """The machine bar by bar, for each cell of (enter, leave) cutoffs of trend and volatility."""
    values = ", ".join(str(c) for c in cells)
    return f"""WITH RECURSIVE {TICKS}, {HEAD.split(TICKS + ', ')[1]}, {MEASURED}, cells(te, tl, ve, vl) AS (VALUES {values}),
    m AS (SELECT DISTINCT ON (symbol, te, ve) symbol, te, tl, ve, vl, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, false AS trend, false AS high, CAST(NULL AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS regime, CAST(NULL AS VARCHAR) AS cand, 0 AS n, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS len FROM measured, cells
    UNION ALL SELECT symbol, te, tl, ve, vl, i, t, trend, high, raw, now, CASE WHEN now = raw THEN NULL ELSE raw END, CASE WHEN now = raw THEN 0 ELSE n END, CASE WHEN now = raw THEN t ELSE since END, CASE WHEN now = was THEN len + 1 ELSE 1 END FROM (
      SELECT *, CASE WHEN raw IN ('R5', 'R0') OR was IS NULL OR was = 'R0' OR (n >= 2 AND t - since >= 7200000) THEN raw ELSE was END AS now FROM (
        SELECT symbol, te, tl, ve, vl, i, t, trend, high, raw, was, len, CASE WHEN raw = cand THEN n ELSE 0 END + 1 AS n, CASE WHEN raw = cand THEN since ELSE t END AS since FROM (
          SELECT *, CASE WHEN s THEN 'R5' WHEN e IS NULL OR v IS NULL THEN 'R0' WHEN trend AND high THEN 'R4' WHEN trend THEN 'R3' WHEN high THEN 'R2' ELSE 'R1' END AS raw FROM (
            SELECT m.symbol, te, tl, ve, vl, d.i, d.open_time AS t, d.s, d.e, d.v, m.regime AS was, m.cand, m.n, m.since, m.len,
              CASE WHEN d.s OR d.e IS NULL OR d.v IS NULL THEN m.trend ELSE d.e >= CASE WHEN m.trend THEN tl ELSE te END END AS trend, CASE WHEN d.s OR d.e IS NULL OR d.v IS NULL THEN m.high ELSE d.v >= CASE WHEN m.high THEN vl ELSE ve END END AS high
            FROM m JOIN measured d ON d.symbol = m.symbol AND d.i = m.i + 1)))))"""


@query(f"{_machine([(0.7, 0.5, 0.7, 0.5)])} SELECT symbol, t AS open_time, raw AS regime_raw, regime, len AS bars_in_regime, regime NOT IN ('R0', 'R5') AS tradeable FROM m WHERE i > 0")
def q_regime_state_machine(spark, sf_dir):
    return R.state_machine(measured(spark, sf_dir), "er_rank", "vol_rank", "stressed")


@query(f"{_machine([(a, a - 0.2, a, a - 0.2) for a in (0.6, 0.7, 0.8)])} SELECT symbol, CAST(te AS DOUBLE) AS trend_cut, CAST(ve AS DOUBLE) AS vol_cut, regime, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY symbol, te, ve) AS DOUBLE), 9) + 0 AS share FROM m WHERE i > 0 GROUP BY symbol, te, ve, regime")
def q_regime_cutoff_sweep(spark, sf_dir):
    df = R.cutoff_sweep(measured(spark, sf_dir), "er_rank", "vol_rank", "stressed", [(0.6, 0.6), (0.7, 0.7), (0.8, 0.8)])
    return df.withColumn("share", r("share", 9))


@query()
def q_bocpd(spark, sf_dir):
    return R.change_points(hours(spark, sf_dir), "close")


@query()
def q_hmm_filtered(spark, sf_dir):
    return R.hidden_states(measured(spark, sf_dir), ("r1", "vol"))


@query()
def q_jump_model(spark, sf_dir):
    return R.jump_states(measured(spark, sf_dir), ("r1", "vol"))


@query(
    f"""{HEAD}, g AS (SELECT symbol, open_time, open_time - lag(open_time) OVER w AS gap, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
    m AS (SELECT *, median(gap) OVER w AS middle FROM g WHERE gap > 0 WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, abs(gap - middle) AS dev FROM m),
    e AS (SELECT *, median(dev) OVER w AS mad, avg(dev) OVER w AS mean, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT symbol, open_time, gap, lag(middle) OVER w AS middle, CASE WHEN lag(mad) OVER w > 0 THEN lag(mad) OVER w ELSE lag(mean) OVER w END AS scale, lag(n) OVER w AS n FROM e WINDOW w AS (PARTITION BY symbol ORDER BY i))
    SELECT g.symbol, g.open_time, CASE WHEN g.gap <= 0 THEN true WHEN p.n >= 3 THEN CASE WHEN p.scale > 0 THEN 0.6745 * (p.gap - p.middle) / p.scale > 3.5 ELSE p.gap > p.middle END END AS triggered FROM g LEFT JOIN p ON p.symbol = g.symbol AND p.open_time = g.open_time"""
)
def q_event_gap_trigger(spark, sf_dir):
    return R.event_gap(hours(spark, sf_dir), "open_time")


@query()
def q_acd_durations(spark, sf_dir):
    return M.acd(hours(spark, sf_dir))


def _mean(ms: int) -> str:
    return f"avg(rv) OVER (PARTITION BY symbol ORDER BY close_time RANGE BETWEEN {ms} PRECEDING AND 1 PRECEDING)"


def _det(*rows: str) -> str:
    """Of a 3 x 3 matrix whose rows are lists of three names."""
    a, b, c = (r.split() for r in rows)
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


#: Three regressors: Cramer's rule on their covariances.
_HAR = f"""{HEAD}, p AS (SELECT *, lag(close) OVER {O} AS pc FROM bars), q AS (SELECT symbol, close_time, power(({log('close')}) - ({log('pc')}), 2) AS rv FROM p),
    x AS (SELECT symbol, rv AS y, {_mean(86_400_000)} AS a, {_mean(604_800_000)} AS b, {_mean(2_592_000_000)} AS c FROM q), k AS (SELECT * FROM x WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
    s AS (SELECT symbol, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy FROM k GROUP BY 1),
    d AS (SELECT *, {_det('aa ab ac', 'ab bb bc', 'ac bc cc')} AS d FROM s),
    z AS (SELECT *, {_det('ay ab ac', 'by_ bb bc', 'cy bc cc')} / d AS b1, {_det('aa ay ac', 'ab by_ bc', 'ac cy cc')} / d AS b2, {_det('aa ab ay', 'ab bb by_', 'ac bc cy')} / d AS b3 FROM d)
    SELECT symbol, n, round(my - b1 * ma - b2 * mb - b3 * mc, 5) + 0 AS b0, round(b1, 5) + 0 AS b1, round(b2, 5) + 0 AS b2, round(b3, 5) + 0 AS b3 FROM z"""


@query(_HAR)
def q_har_ols(spark, sf_dir):
    df = measured(spark, sf_dir).withColumn("rv", F.col("r1") * F.col("r1"))
    df = df.withColumns({n: W.time_mean("rv", "close_time", ms) for n, ms in (("day", 86_400_000), ("week", 604_800_000), ("month", 2_592_000_000))})
    out = M.ols(df, "rv", ["day", "week", "month"], ["symbol"])
    return out.select("symbol", "n", *[r(c, 5).alias(c) for c in ("b0", "b1", "b2", "b3")])


@query()
def q_egarch(spark, sf_dir):
    return M.egarch(measured(spark, sf_dir), "r1")


def daily(spark, sf_dir):
    d = ticks(spark, sf_dir).groupBy(F.expr("transact_time div 86400000").alias("row_id"))
    return d.agg((F.avg("price") - 50).alias("x"), F.avg(F.col("quantity") - 50.5).alias("y"))


@query()
def q_stationary_bootstrap(spark, sf_dir):
    return M.block_bootstrap(daily(spark, sf_dir).orderBy("row_id"), "x", 200, 11)


@query()
def q_permutation_null(spark, sf_dir):
    return M.permutation_null(daily(spark, sf_dir), "x", "y", 100, 11)


@query()
def q_random_entries(spark, sf_dir):
    df = ticks(spark, sf_dir).select(F.col("agg_trade_id").alias("row_id"), (F.col("price") - 50).alias("x"))
    return M.random_entries(df, "x", 200, 20)


def training(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("open_time")
    df = measured(spark, sf_dir).withColumns({"y": (F.lead("close").over(w) > F.col("close")).cast("double"), "w": F.lit(1.0)})
    return df.dropna(subset=["er", "vol", "r1", "y"])


@query()
def q_meta_logit(spark, sf_dir):
    df = training(spark, sf_dir)
    model = M.meta_logit(df, ["er", "vol", "r1"], "y", "w")
    return model.transform(df).select("symbol", "open_time", r(M.probability_of()).alias("p"))


@query()
def q_boosted_isotonic(spark, sf_dir):
    df = training(spark, sf_dir)
    scored = M.boosted_side(df, ["er", "vol", "r1"], "y", "w", trees=5).transform(df).withColumn("score", M.probability_of("probability"))
    knots = M.isotonic(scored, "score", "y", "w")
    return scored.select("symbol", "open_time", r(M.interpolate(F.col("score"), knots)).alias("p"))


@query()
def q_monotone_boosting(spark, sf_dir):
    df = training(spark, sf_dir)
    stumps, base = G.fit(df, ["er", "vol", "r1"], "y", "w", signs={"r1": -1}, rounds=6)
    return df.select("symbol", "open_time", r(G.probability(stumps, base)).alias("p"))
