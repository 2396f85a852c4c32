"""Controls, triggers and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as L
from ..operators import risk as K
from ..sources import tables as S
from .base import HEAD, HOUR, hours, query, r

#: An account for each order, from the order's numbers.
_ACCOUNT = {
    "system_state": "CASE WHEN o_orderstatus = 'P' THEN 'PAUSED' ELSE 'RUNNING' END", "kill_switch_active": "o_orderkey % 11 = 0", "reconciliation_age_s": "o_orderkey % 64", "bar_staleness_s": "o_orderkey % 95",
    "book_staleness_s": "o_orderkey % 6", "equity": "o_totalprice / 100", "qty": "(o_orderkey % 50 + 1) / 1000.0e0", "min_qty": "0.001e0", "unit_notional": "o_custkey % 40 + 1",
    "notional_real": "(o_custkey % 40 + 1) * (o_orderkey % 9 + 1)", "min_notional": "5", "notional_req": "(o_custkey % 40 + 1) * (o_orderkey % 9 + 0.5e0)", "quant_error": "(o_orderkey % 13) / 40.0e0", "risk_real": "o_totalprice / 20000",
    "leverage_eff": "(o_orderkey % 17) / 5.0e0", "im_required_usd": "o_totalprice / 200", "fees_mtd_usd": "o_totalprice * (o_custkey % 9) / 30000", "daily_loss_usd": "o_totalprice * (o_custkey % 8) / 30000",
    "equity_peak_usd": "CASE WHEN o_custkey % 19 = 0 THEN 0 ELSE o_totalprice / 100 * (1 + (o_custkey % 6) / 50.0e0) END", "consecutive_losses": "o_custkey % 7",
    "spread_bps": "CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 12 + 0.0e0 END", "depth_20bps_usd": "CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 40 + 1) * 4.0e0 END",
}
_HISTORY = [1.0, 4.0, 9.0, 2.0, 7.0, 10.0]
_RULES = [
    ("2", "STATE_NOT_RUNNING", "system_state = 'RUNNING'"), ("3", "KILL_SWITCH_ACTIVE", "NOT kill_switch_active"), ("4", "STALE_RECONCILIATION", "reconciliation_age_s < 60"), ("5", "DATA_STALE", "bar_staleness_s < 90 AND book_staleness_s < 5"),
    ("6", "BELOW_MIN_QTY", "qty >= min_qty"), ("7", "BELOW_MIN_NOTIONAL", "notional_real >= min_notional"), ("8", "INSUFFICIENT_GRANULARITY", "notional_real >= 3 * unit_notional"), ("9a", "QUANTIZATION_LIMIT", "quant_error <= 0.25e0"),
    ("9b", "INSUFFICIENT_RESOLUTION", "notional_req >= 2 * unit_notional"), ("10", "RISK_OVERSHOOT", "risk_real <= 0.006e0 * equity"), ("11", "MAX_NOTIONAL", "leverage_eff <= 3"), ("12", "INSUFFICIENT_MARGIN", "im_required_usd <= 0.6e0 * equity"),
    ("13", "FEE_BUDGET_EXHAUSTED", "fees_mtd_usd + notional_real * (0.0002e0 + 0.4942e0 * 0.0002e0 + 0.5058e0 * 0.0005e0) <= 0.03e0 * equity"), ("14", "DAILY_LOSS_LIMIT", "daily_loss_usd <= 0.02e0 * equity"),
    ("15", "MAX_DRAWDOWN", "CASE WHEN equity_peak_usd > 0 THEN (equity_peak_usd - equity) / equity_peak_usd <= 0.1e0 END"), ("16", "CONSECUTIVE_LOSSES", "consecutive_losses <= 5"),
    ("17", "LIQUIDITY_INSUFFICIENT", "spread_bps <= quantile_cont([1.0, 4.0, 9.0, 2.0, 7.0, 10.0]::DOUBLE[], 0.95) AND depth_20bps_usd >= 4 * unit_notional"), ("18", "EVENT_WINDOW", "CAST(NULL AS BOOLEAN)"),
    ("19", "AGGREGATE_RISK_LIMIT", "CASE WHEN o_custkey % 4 <> 0 THEN sqrt(w * w + v * v + 2 * 0.5e0 * w * v) <= 0.01e0 END"),
]
_CONTROLS = f"""WITH a AS (SELECT o_orderkey, o_custkey, {", ".join(f"{v} AS {k}" for k, v in _ACCOUNT.items())}, (o_custkey % 10) / 1000.0e0 AS w, (o_custkey % 7) / 1000.0e0 AS v FROM orders),
c AS (SELECT o_orderkey, [{", ".join(f"{{'id': '{i}', 'reason': '{n}', 'ok': {x.replace("quantile_cont([1.0, 4.0, 9.0, 2.0, 7.0, 10.0]::DOUBLE[], 0.95)", "9.75e0")}}}" for i, n, x in _RULES)}] AS rules FROM a),
s AS (SELECT *, list_position(list_transform(rules, lambda x: coalesce(x.ok, x.id <> '19')), false) AS stop FROM c), g AS (SELECT *, CASE WHEN stop > 0 THEN rules[: stop] ELSE rules END AS seen FROM s)
SELECT o_orderkey, coalesce(stop, 0) = 0 AS approved, CASE WHEN stop > 0 THEN CASE WHEN rules[stop].ok IS NULL THEN 'MANDATORY_CONTROL_NOT_COMPUTABLE' ELSE rules[stop].reason END END AS rejection_reason,
array_to_string(list_transform(list_filter(seen, lambda x: x.ok), lambda x: x.id), ' ') AS passed, array_to_string(list_transform(list_filter(seen, lambda x: x.ok IS NULL), lambda x: x.id), ' ') AS unknown, len(seen) AS n_evaluated FROM g"""


@query(_CONTROLS)
def q_pre_trade_controls(spark, sf_dir):
    w, v = (F.col("o_custkey") % 10) / 1000, (F.col("o_custkey") % 7) / 1000
    half = F.array(*[F.array(*[F.lit(x) for x in row]) for row in ((1.0, 0.5), (0.5, 1.0))])
    account = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *[F.expr(x.replace("e0", "D")).alias(k) for k, x in _ACCOUNT.items()], F.array(*[F.lit(x) for x in _HISTORY]).alias("spread_history_bps"), F.when(F.col("o_custkey") % 4 != 0, F.array(w, v)).alias("position_risks"), half.alias("correlation_matrix"))
    done = K.decide(account, K.pre_trade_controls())
    return done.select("o_orderkey", "approved", "rejection_reason", F.concat_ws(" ", "controls_passed").alias("passed"), F.concat_ws(" ", "controls_not_computable").alias("unknown"), F.size("controls_evaluated").cast("long").alias("n_evaluated"))


_SENSORS = {
    "equity": "o_totalprice / 100 - 50", "daily_loss_usd": "o_totalprice * (o_custkey % 8) / 30000", "equity_peak_usd": "CASE WHEN o_custkey % 19 = 0 THEN 0 ELSE o_totalprice / 95 END", "consecutive_losses": "o_custkey % 7",
    "seconds_since_last_exchange_contact": "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 130 END", "critical_reconciliation_divergence": "CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 50 = 0 END", "unexpected_order_detected": "o_orderkey % 97 = 0",
    "api_errors_last_60s": "CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 12 END", "quality_gate_failed_live": "CAST(NULL AS BOOLEAN)", "model_unavailable": "o_orderstatus = 'P'", "risk_engine_exception_caught": "CAST(NULL AS BOOLEAN)",
    "unknown_order_state_age_s": "CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 125 END", "filters_hash": "'h' || (o_custkey % 2)", "last_revalidated_filters_hash": "CASE WHEN o_custkey % 6 <> 0 THEN 'h1' END",
}
_KILLS = [
    "CASE WHEN equity > 0 THEN daily_loss_usd / equity > 0.02e0 END", "CASE WHEN equity_peak_usd > 0 THEN (equity_peak_usd - equity) / equity_peak_usd > 0.1e0 END", "consecutive_losses > 5", "seconds_since_last_exchange_contact > 120",
    "critical_reconciliation_divergence", "unexpected_order_detected", "api_errors_last_60s > 10", "quality_gate_failed_live", "model_unavailable", "risk_engine_exception_caught", "unknown_order_state_age_s > 120", "filters_hash <> last_revalidated_filters_hash", "equity < 150",
]


@query(f"""WITH a AS (SELECT o_orderkey, {", ".join(f"{v} AS {k}" for k, v in _SENSORS.items())} FROM orders), t AS (SELECT o_orderkey, [{", ".join(f"{{'id': 'K{i:02}', 'on': {x}}}" for i, x in enumerate(_KILLS, 1))}] AS t FROM a)
SELECT o_orderkey, array_to_string(list_transform(list_filter(t, lambda x: x.on), lambda x: x.id), ' ') AS triggered, array_to_string(list_transform(list_filter(t, lambda x: x.on IS NULL), lambda x: x.id), ' ') AS unknown, CASE WHEN len(list_filter(t, lambda x: x.on)) > 0 THEN 'KILLED' ELSE 'OK' END AS decision FROM t""")
def q_kill_switch_triggers(spark, sf_dir):
    sensors = S.table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(x).alias(k) for k, x in _SENSORS.items()])
    return K.kill_switch(sensors).select("o_orderkey", F.concat_ws(" ", "triggered_ids").alias("triggered"), F.concat_ws(" ", "not_computable_ids").alias("unknown"), "decision")


@query(f"""{HEAD}, b AS (SELECT symbol, open_time, (open_time // {HOUR} % 100) / 100.0e0 AS vol_pctile, CASE WHEN open_time // {HOUR} % 9 <> 0 THEN (open_time // {HOUR} % 90) / 10.0e0 - 4.5 END AS funding_z, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS gap FROM bars),
f AS (SELECT 1704067200000 + i * 86400000 AS ts, i // 3 AS h FROM range(40) t(i)), k AS (SELECT ts FROM (SELECT ts, h, lag(h) OVER (ORDER BY ts) AS p FROM f) WHERE h <> p)
SELECT b.symbol, b.open_time, array_to_string(list_filter([CASE WHEN vol_pctile > 0.98 THEN 'S1' END, CASE WHEN abs(funding_z) > 3 THEN 'S3' END, CASE WHEN gap > {HOUR} THEN 'S6' END, CASE WHEN b.open_time - k.ts < 86400000 THEN 'S10' END], lambda x: x IS NOT NULL), ' ') AS held, b.funding_z IS NULL AS unknown_s3 FROM b ASOF LEFT JOIN k ON b.open_time >= k.ts""")
def q_stress_ten(spark, sf_dir):
    h = F.expr(f"open_time div {HOUR}")
    b = hours(spark, sf_dir).select("symbol", "open_time", ((h % 100) / 100).alias("vol_pctile"), F.when(h % 9 != 0, (h % 90) / 10 - 4.5).alias("funding_z"))
    f = spark.range(40).select((F.lit(1704067200000) + F.col("id") * 86400000).alias("ts"), F.expr("id div 3").alias("filters_hash"))
    return K.stress_triggers(b, f, HOUR).select("symbol", "open_time", F.concat_ws(" ", "stress_triggers").alias("held"), F.col("S3").isNull().alias("unknown_s3"))


@query(f"""{HEAD}, d AS (SELECT symbol, open_time // 86400000 AS day, arg_max(close, open_time) AS close FROM bars GROUP BY 1, 2), x AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM d)
SELECT symbol, count(*) AS n_days, round(avg(r), 8) + 0 AS mean, round(stddev_samp(r), 8) + 0 AS sd, round(avg(r) / stddev_samp(r) * sqrt(365.25), 6) + 0 AS sharpe FROM x GROUP BY 1""")
def q_buy_and_hold(spark, sf_dir):
    return L.buy_and_hold(hours(spark, sf_dir)).select("symbol", "n_days", r("mean_daily_log_ret", 8).alias("mean"), r("std_daily_log_ret", 8).alias("sd"), r("sharpe_naive").alias("sharpe"))


#: Orders as labels: a side, an outcome and a return for each.
_LABELS = "l AS (SELECT o_custkey % 5 AS grp, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS t0, CASE o_orderstatus WHEN 'F' THEN 'TP' WHEN 'O' THEN 'SL' ELSE 'NOFILL' END AS barrier_hit, o_totalprice / 100000 - 1.4 AS ret_net FROM orders)"


def _rule_sql(name: str, rule: str) -> str:
    return f"""SELECT '{name}' AS rule, grp, count(*) AS n_signals, count(x) AS n_filled, round(count(x) / CAST(count(*) AS DOUBLE), 8) + 0 AS fill_rate, round(avg(x), 8) + 0 AS mean, round(avg(x) / stddev_samp(x) * sqrt(count(x) / ((max(t) - min(t)) / 31557600000.0e0)), 6) + 0 AS sharpe,
    round(count(x) / ((max(t) - min(t)) / 31557600000.0e0), 6) + 0 AS per_year FROM (SELECT *, CASE WHEN barrier_hit <> 'NOFILL' THEN ret_net END AS x, CASE WHEN barrier_hit <> 'NOFILL' THEN t0 END AS t FROM l WHERE {rule}) GROUP BY grp"""


@query(f"WITH {_LABELS} {_rule_sql('short', 'side = -1')} UNION ALL {_rule_sql('long_some', 'side = 1 AND grp IN (1, 3)')}")
def q_static_rules(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    hit = F.when(F.col("o_orderstatus") == "F", "TP").when(F.col("o_orderstatus") == "O", "SL").otherwise("NOFILL")
    labels = o.select((F.col("o_custkey") % 5).alias("grp"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("side"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t0"), hit.alias("barrier_hit"), (F.col("o_totalprice") / 100000 - 1.4).alias("ret_net"))
    rules = {"short": F.col("side") == -1, "long_some": (F.col("side") == 1) & F.col("grp").isin(1, 3)}
    parts = [L.static_rule(labels, rule, ["grp"]).select(F.lit(name).alias("rule"), "grp", "n_signals", "n_filled", r("fill_rate", 8).alias("fill_rate"), r("mean_trade_ret", 8).alias("mean"), r("sharpe_naive").alias("sharpe"), r("trades_per_year").alias("per_year")) for name, rule in rules.items()]
    return parts[0].unionByName(parts[1])
