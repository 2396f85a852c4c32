"""Ordered three-valued rules: pre-trade controls and kill-switch triggers, as columns.

A rule's outcome is a boolean column: true, false, or null where it cannot be computed
from what is known. Everything is one projection, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import round_trip_bps

NOT_COMPUTABLE = "MANDATORY_CONTROL_NOT_COMPUTABLE"


@dataclass(frozen=True)
class Limits:
    """Fixed values of the controls and triggers."""

    reconciliation_max_age_s: float = 60.0
    bar_max_age_s: float = 90.0
    book_max_age_s: float = 5.0
    min_granularity_units: float = 3.0
    quantization_tolerance: float = 0.25
    min_resolution_units: float = 2.0
    risk_max_of_equity: float = 0.006
    max_notional_multiple: float = 3.0
    margin_max_of_equity: float = 0.60
    fee_budget_of_equity: float = 0.03
    daily_loss_of_equity: float = 0.02
    drawdown_of_peak: float = 0.10
    max_consecutive_losses: int = 5
    spread_quantile: float = 0.95
    min_depth_units: float = 4.0
    aggregate_risk_max: float = 0.01
    maker_fee: float = 0.0002
    taker_fee: float = 0.0005
    maker_prob: float = 0.4942
    disconnected_s: float = 120.0
    api_errors_a_minute: int = 10
    unknown_order_s: float = 120.0
    equity_floor: float = 150.0


@dataclass(frozen=True)
class Rule:
    id: str
    reason: str
    passes: Column


def quantile_of(values: Column, share: float) -> Column:
    """Linear interpolation in an array; null if it is empty or null."""
    s, last = F.sort_array(F.transform(values, lambda x: x.cast("double"))), F.size(values) - 1
    at = F.lit(share) * last
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, last))
    return F.when(F.size(values) > 0, a + (at - low) * (b - a))


def aggregate_risk(weights: Column, matrix: Column) -> Column:
    """sqrt(w' C w); null where a side is missing or the matrix does not fit the weights."""
    n = F.size(weights)
    fits = (n > 0) & (F.size(matrix) == n) & F.forall(matrix, lambda row: F.coalesce(F.size(row) == n, F.lit(False)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(fits, F.sqrt(dot(weights, F.transform(matrix, lambda row: dot(weights, row)))))


def pre_trade_controls(limits: Limits = Limits(), spread_p95: Column | None = None) -> list[Rule]:
    """The active controls in their order. (The first of old, on the regime, is not active.)

    Columns: system_state, kill_switch_active, reconciliation_age_s, bar_staleness_s,
    book_staleness_s; of the sizing qty, min_qty, notional_real, min_notional,
    unit_notional, notional_req, quant_error, risk_real, equity, leverage_eff;
    im_required_usd, fees_mtd_usd, daily_loss_usd, equity_peak_usd, consecutive_losses;
    spread_bps, spread_history_bps (or spread_p95 as a column), depth_20bps_usd,
    position_risks, correlation_matrix.
    """
    c, m = F.col, limits
    cost = c("notional_real") * round_trip_bps(m.maker_fee, m.taker_fee, m.maker_prob) / 10_000
    p95 = spread_p95 if spread_p95 is not None else quantile_of(c("spread_history_bps"), m.spread_quantile)
    return [
        Rule("2", "STATE_NOT_RUNNING", c("system_state") == "RUNNING"),
        Rule("3", "KILL_SWITCH_ACTIVE", ~c("kill_switch_active")),
        Rule("4", "STALE_RECONCILIATION", c("reconciliation_age_s") < m.reconciliation_max_age_s),
        Rule("5", "DATA_STALE", (c("bar_staleness_s") < m.bar_max_age_s) & (c("book_staleness_s") < m.book_max_age_s)),
        Rule("6", "BELOW_MIN_QTY", c("qty") >= c("min_qty")),
        Rule("7", "BELOW_MIN_NOTIONAL", c("notional_real") >= c("min_notional")),
        Rule("8", "INSUFFICIENT_GRANULARITY", c("notional_real") >= m.min_granularity_units * c("unit_notional")),
        Rule("9a", "QUANTIZATION_LIMIT", c("quant_error") <= m.quantization_tolerance),
        Rule("9b", "INSUFFICIENT_RESOLUTION", (c("unit_notional") != 0) & (c("notional_req") >= m.min_resolution_units * c("unit_notional"))),
        Rule("10", "RISK_OVERSHOOT", (c("equity") > 0) & (c("risk_real") <= m.risk_max_of_equity * c("equity"))),
        Rule("11", "MAX_NOTIONAL", c("leverage_eff") <= m.max_notional_multiple),
        Rule("12", "INSUFFICIENT_MARGIN", c("im_required_usd") <= m.margin_max_of_equity * c("equity")),
        Rule("13", "FEE_BUDGET_EXHAUSTED", c("fees_mtd_usd") + cost <= m.fee_budget_of_equity * c("equity")),
        Rule("14", "DAILY_LOSS_LIMIT", c("daily_loss_usd") <= m.daily_loss_of_equity * c("equity")),
        Rule("15", "MAX_DRAWDOWN", F.when(c("equity_peak_usd") > 0, (c("equity_peak_usd") - c("equity")) / c("equity_peak_usd") <= m.drawdown_of_peak)),
        Rule("16", "CONSECUTIVE_LOSSES", c("consecutive_losses") <= m.max_consecutive_losses),
        # false wins over unknown, unknown over true
        Rule("17", "LIQUIDITY_INSUFFICIENT", (c("spread_bps") <= p95) & (c("depth_20bps_usd") >= m.min_depth_units * c("unit_notional"))),
        Rule("18", "EVENT_WINDOW", F.lit(None).cast("boolean")),  # no calendar of events
        Rule("19", "AGGREGATE_RISK_LIMIT", aggregate_risk(c("position_risks"), c("correlation_matrix")) <= m.aggregate_risk_max),
    ]


MANDATORY = ("19",)


def decide(df: DataFrame, rules: Sequence[Rule], mandatory: Collection[str] = MANDATORY) -> DataFrame:
    """approved, rejection_reason, controls_passed, controls_not_computable, controls_evaluated.

    Rules are taken in order up to the first that fails; one that cannot be computed is
    noted and goes on, unless it is mandatory: then it rejects.
    """
    outcome = [F.col(f"_rule{i}") for i in range(len(rules))]
    stops = [F.when(~F.coalesce(o, F.lit(r.id not in mandatory)), F.lit(i)) for i, (r, o) in enumerate(zip(rules, outcome, strict=True))]
    stop = F.coalesce(*stops)
    reasons = [F.when(F.col("_stop") == i, F.when(o.isNull(), NOT_COMPUTABLE).otherwise(r.reason)) for i, (r, o) in enumerate(zip(rules, outcome, strict=True))]
    reached = [F.coalesce(F.col("_stop") >= i, F.lit(True)) for i in range(len(rules))]
    named = lambda kept: F.array_compact(F.array(*[F.when(k, F.lit(r.id)) for r, k in zip(rules, kept, strict=True)]))
    out = df.withColumns({f"_rule{i}": r.passes for i, r in enumerate(rules)}).withColumn("_stop", stop)
    out = out.withColumns(
        {
            "approved": F.col("_stop").isNull(), "rejection_reason": F.coalesce(*reasons), "controls_passed": named([g & o for g, o in zip(reached, outcome, strict=True)]),
            "controls_not_computable": named([g & o.isNull() for g, o in zip(reached, outcome, strict=True)]), "controls_evaluated": named(reached),
        }
    )
    return out.drop("_stop", *[f"_rule{i}" for i in range(len(rules))])


#: What an exchange's filters are hashed by, in this order.
FILTERS = ("tick_size", "step_size", "min_qty", "max_qty", "market_step_size", "min_notional")


def filters_hash(columns: Sequence[str] = FILTERS) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def kill_switch_triggers(limits: Limits = Limits()) -> dict[str, Column]:
    """True where a trigger has gone off, null where its sensor is silent."""
    c, m = F.col, limits
    return {
        "K01": F.when(c("equity") > 0, c("daily_loss_usd") / c("equity") > m.daily_loss_of_equity),
        "K02": F.when(c("equity_peak_usd") > 0, (c("equity_peak_usd") - c("equity")) / c("equity_peak_usd") > m.drawdown_of_peak),
        "K03": c("consecutive_losses") > m.max_consecutive_losses,
        "K04": c("seconds_since_last_exchange_contact") > m.disconnected_s,
        "K05": c("critical_reconciliation_divergence"),
        "K06": c("unexpected_order_detected"),
        "K07": c("api_errors_last_60s") > m.api_errors_a_minute,
        "K08": c("quality_gate_failed_live"),
        "K09": c("model_unavailable"),
        "K10": c("risk_engine_exception_caught"),
        "K11": c("unknown_order_state_age_s") > m.unknown_order_s,
        "K12": c("filters_hash") != c("last_revalidated_filters_hash"),
        "K13": c("equity") < m.equity_floor,
    }


def kill_switch(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """decision (KILLED if any trigger has gone off, else OK), triggered_ids and not_computable_ids; all triggers are looked at."""
    triggers = kill_switch_triggers(limits)
    ids = lambda test: F.array_compact(F.array(*[F.when(test(t), F.lit(k)) for k, t in triggers.items()]))
    out = df.withColumns({"triggered_ids": ids(lambda t: t), "not_computable_ids": ids(lambda t: t.isNull())})
    return out.withColumn("decision", F.when(F.size("triggered_ids") > 0, "KILLED").otherwise("OK"))


def reset_kill_switch(operator: str, reason: str) -> str:
    """The state after a reset, which a named person has to ask for and to explain: paused, not running."""
    if not operator.strip() or not reason.strip():
        raise ValueError("a reset needs an operator and a reason")
    return "PAUSED"


def stress_triggers(bars: DataFrame, snapshots: DataFrame | None = None, step_ms: int | None = 900_000, by: Sequence[str] = ("symbol",), window_ms: int = 86_400_000) -> DataFrame:
    """S1 to S10 as boolean columns, and stress_triggers (those that hold) and stressed.

    bars: open_time, vol_pctile, funding_z, and spread_pctile where there is one; with
    step_ms None the gap trigger is the column event_gap (see ``regime.event_gap``).
    snapshots: (ts, filters_hash), of all symbols; a change triggers for window_ms. What has
    no source (basis, staleness, depth, events, liquidations) is null.
    """
    from pyspark.sql import Window

    from .asof import asof

    c, unknown = F.col, F.lit(None).cast("boolean")
    order = Window.partitionBy(*by).orderBy("open_time")
    gap = F.coalesce(c("open_time") - F.lag("open_time").over(order) > step_ms, F.lit(False)) if step_ms else c("event_gap")
    spread = c("spread_pctile") > 0.95 if "spread_pctile" in bars.columns else unknown
    found = {"S1": c("vol_pctile") > 0.98, "S2": spread, "S3": F.abs("funding_z") > 3.0, "S4": unknown, "S5": unknown, "S6": gap, "S7": unknown, "S8": unknown, "S9": unknown}
    out = bars.withColumns(found)
    changed = unknown
    if snapshots is not None:
        # a row for each snapshot of the filters: few, and all of one table
        marked = snapshots.select("ts", (c("filters_hash") != F.lag("filters_hash").over(Window.orderBy("ts"))).alias("changed"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
        out = asof(out, marked.where("changed").select(c("ts").alias("_changed")), "open_time", "_changed", ["_changed"])
        several = marked.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("_several"))
        out = out.crossJoin(F.broadcast(several))
        changed = F.when(c("_several"), F.coalesce(c("open_time") - c("_changed") < window_ms, F.lit(False)))
    out = out.withColumn("S10", changed).drop("_changed", "_several")
    names = [f"S{i}" for i in range(1, 11)]
    held = F.array_compact(F.array(*[F.when(c(n), F.lit(n)) for n in names]))
    return out.withColumn("stress_triggers", held).withColumn("stressed", F.size("stress_triggers") > 0)
