"""Controls, triggers, baselines and sealed folders."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import baselines, risk
from tidemark.sources import artifacts as A

FINE = dict(
    system_state="RUNNING", kill_switch_active=False, reconciliation_age_s=1.0, bar_staleness_s=1.0, book_staleness_s=1.0, qty=1.0, min_qty=0.1, notional_real=100.0, min_notional=5.0, unit_notional=10.0, notional_req=105.0, quant_error=0.05, risk_real=5.0,
    equity=1000.0, leverage_eff=0.1, im_required_usd=50.0, fees_mtd_usd=1.0, daily_loss_usd=0.0, equity_peak_usd=1000.0, consecutive_losses=0, spread_bps=1.0, spread_history_bps=[1.0, 2.0, 3.0], depth_20bps_usd=500.0, position_risks=[0.004, 0.003], correlation_matrix=[[1.0, 0.9], [0.9, 1.0]],
)
TYPES = "system_state string, kill_switch_active boolean, reconciliation_age_s double, bar_staleness_s double, book_staleness_s double, qty double, min_qty double, notional_real double, min_notional double, unit_notional double, notional_req double, quant_error double, risk_real double, equity double, leverage_eff double, im_required_usd double, fees_mtd_usd double, daily_loss_usd double, equity_peak_usd double, consecutive_losses int, spread_bps double, spread_history_bps array<double>, depth_20bps_usd double, position_risks array<double>, correlation_matrix array<array<double>>"
CASES = [
    ({}, None), ({"system_state": "PAUSED"}, "STATE_NOT_RUNNING"), ({"kill_switch_active": True}, "KILL_SWITCH_ACTIVE"), ({"reconciliation_age_s": 60.0}, "STALE_RECONCILIATION"), ({"book_staleness_s": 5.0}, "DATA_STALE"), ({"qty": 0.05}, "BELOW_MIN_QTY"),
    ({"notional_real": 4.0}, "BELOW_MIN_NOTIONAL"), ({"notional_real": 29.0}, "INSUFFICIENT_GRANULARITY"), ({"quant_error": 0.26}, "QUANTIZATION_LIMIT"), ({"notional_req": 19.0}, "INSUFFICIENT_RESOLUTION"), ({"risk_real": 6.1}, "RISK_OVERSHOOT"), ({"equity": -5.0}, "RISK_OVERSHOOT"),
    ({"leverage_eff": 3.1}, "MAX_NOTIONAL"), ({"im_required_usd": 601.0}, "INSUFFICIENT_MARGIN"), ({"fees_mtd_usd": 30.0}, "FEE_BUDGET_EXHAUSTED"), ({"daily_loss_usd": 20.1}, "DAILY_LOSS_LIMIT"), ({"equity_peak_usd": 1200.0}, "MAX_DRAWDOWN"), ({"consecutive_losses": 6}, "CONSECUTIVE_LOSSES"),
    ({"spread_bps": 2.95}, "LIQUIDITY_INSUFFICIENT"), ({"spread_bps": 2.95, "depth_20bps_usd": None}, "LIQUIDITY_INSUFFICIENT"), ({"depth_20bps_usd": 39.0, "spread_bps": None}, "LIQUIDITY_INSUFFICIENT"), ({"position_risks": [0.008, 0.008]}, "AGGREGATE_RISK_LIMIT"),
    ({"position_risks": None}, risk.NOT_COMPUTABLE), ({"position_risks": []}, risk.NOT_COMPUTABLE), ({"correlation_matrix": [[1.0, 0.9]]}, risk.NOT_COMPUTABLE), ({"correlation_matrix": [[1.0], [1.0]]}, risk.NOT_COMPUTABLE),
]


def test_controls_in_order(spark):
    rows = [tuple({**FINE, **change}.values()) for change, _ in CASES]
    got = risk.decide(spark.createDataFrame(rows, TYPES).coalesce(1), risk.pre_trade_controls()).collect()
    assert [r.rejection_reason for r in got] == [want for _, want in CASES]
    assert got[0].approved and got[0].controls_not_computable == ["18"] and len(got[0].controls_evaluated) == 19 and len(got[0].controls_passed) == 18
    assert got[1].controls_evaluated == ["2"] and got[1].controls_passed == [] and not got[1].approved
    assert got[22].controls_not_computable == ["18", "19"] and got[22].controls_evaluated[-1] == "19"


def test_what_cannot_be_computed_goes_on(spark):
    rows = [tuple({**FINE, "equity_peak_usd": 0.0, "spread_bps": None, "depth_20bps_usd": None}.values()), tuple({**FINE, "spread_history_bps": []}.values())]
    got = risk.decide(spark.createDataFrame(rows, TYPES).coalesce(1), risk.pre_trade_controls()).collect()
    assert got[0].approved and got[0].controls_not_computable == ["15", "17", "18"] and got[1].controls_not_computable == ["17", "18"]


def test_kill_switch_and_reset(spark):
    columns = "equity double, daily_loss_usd double, equity_peak_usd double, consecutive_losses int, seconds_since_last_exchange_contact double, critical_reconciliation_divergence boolean, unexpected_order_detected boolean, api_errors_last_60s int, quality_gate_failed_live boolean, model_unavailable boolean, risk_engine_exception_caught boolean, unknown_order_state_age_s double, filters_hash string, last_revalidated_filters_hash string"
    calm = (1000.0, 0.0, 1000.0, 0, None, None, None, None, None, None, None, None, "a", None)
    alarm = (100.0, 2.1, 1000.0, 6, 121.0, True, True, 11, True, True, True, 121.0, "a", "b")
    edge = (1000.0, 20.0, 1000.0, 5, 120.0, False, False, 10, False, False, False, 120.0, "a", "a")
    broke = (-1.0, 5.0, 0.0, 0, None, None, None, None, None, None, None, None, "a", "a")
    got = risk.kill_switch(spark.createDataFrame([calm, alarm, edge, broke], columns).coalesce(1)).collect()
    assert (got[0].decision, got[0].triggered_ids, len(got[0].not_computable_ids)) == ("OK", [], 9)
    assert (got[1].decision, got[1].triggered_ids, got[1].not_computable_ids) == ("KILLED", [f"K{i:02}" for i in range(1, 14)], [])
    assert (got[2].decision, got[2].triggered_ids, got[2].not_computable_ids) == ("OK", [], [])
    assert got[3].triggered_ids == ["K13"] and {"K01", "K02"} <= set(got[3].not_computable_ids)
    assert risk.reset_kill_switch("someone", "looked at") == "PAUSED"
    for operator, reason in (("", "x"), ("x", " ")):
        with pytest.raises(ValueError, match="reset"):
            risk.reset_kill_switch(operator, reason)


def test_filters_hash(spark):
    import hashlib

    row = spark.createDataFrame([("0.10", "0.001", "0.001", "100", "0.001", "5")], ", ".join(f"{c} string" for c in risk.FILTERS)).select(risk.filters_hash().alias("h")).first()
    assert row.h == hashlib.sha256(b"0.10|0.001|0.001|100|0.001|5").hexdigest()


def test_stress_triggers(spark):
    h = 3_600_000
    rows = [("a", 0, 0.99, 0.0), ("a", h, None, -3.1), ("a", 3 * h, 0.5, None), ("a", 30 * h, 0.98, 3.0)]
    bars = spark.createDataFrame(rows, "symbol string, open_time long, vol_pctile double, funding_z double")
    changes = spark.createDataFrame([(-h, "x"), (2 * h, "y"), (5 * h, "y")], "ts long, filters_hash string")
    got = sorted(risk.stress_triggers(bars, changes, h).collect(), key=lambda r: r.open_time)
    assert [r.stress_triggers for r in got] == [["S1"], ["S3"], ["S6", "S10"], ["S6"]] and [r.stressed for r in got] == [True, True, True, True]
    assert got[1].S1 is None and got[2].S3 is None and got[0].S2 is None and got[0].S6 is False
    one = risk.stress_triggers(bars, changes.limit(1), h).collect()
    assert all(r.S10 is None for r in one) and all(r.S10 is None for r in risk.stress_triggers(bars, None, h).collect())
    calm = risk.stress_triggers(bars, spark.createDataFrame([(0, "x"), (h, "x")], "ts long, filters_hash string"), h).collect()
    assert all(r.S10 is False for r in calm)


def test_baselines(spark):
    day = 86_400_000
    bars = spark.createDataFrame([("a", d * day + k, float(100 + (d * 7) % 5 + k)) for d in range(5) for k in range(2)] + [("b", 0, 1.0)], "symbol string, open_time long, close double")
    got = {r.symbol: r for r in baselines.buy_and_hold(bars).collect()}
    close = [101 + (d * 7) % 5 for d in range(5)]
    rets = [math.log(b / a) for a, b in zip(close, close[1:], strict=False)]
    mean = sum(rets) / 4
    sd = math.sqrt(sum((x - mean) ** 2 for x in rets) / 3)
    assert got["a"].n_days == 5 and got["a"].sharpe_naive == pytest.approx(mean / sd * math.sqrt(365.25)) and got["b"].sharpe_naive is None
    labels = spark.createDataFrame([(0, "TP", 0.1, -1), (day, "NOFILL", 9.0, -1), (2 * day, "SL", -0.2, -1), (day, "TP", 1.0, 1)], "t0 long, barrier_hit string, ret_net double, side int")
    rule = baselines.static_rule(labels, F.col("side") == -1).first()
    assert (rule.n_signals, rule.n_filled) == (3, 2) and rule.mean_trade_ret == pytest.approx(-0.05) and rule.trades_per_year == pytest.approx(365.25)
    null = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (3.0,)], "s double")
    assert baselines.percentile_of(null, "s", 2.5) == pytest.approx(200 / 3)


def test_shuffled_features_keep_their_values(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), i % 2) for i in range(200)], "row_id long, x double, y double, label long")
    got = baselines.shuffle_features(df, ["x", "y"], 3).collect()
    assert sorted(r.x for r in got) == [float(i) for i in range(200)] and sorted(-r.y for r in got) == sorted(r.x for r in got)
    assert all(r.label == r.row_id % 2 for r in got) and sum(r.x == r.row_id for r in got) < 20 and sum(r.x == -r.y for r in got) < 20


def test_sealed_tables(spark, tmp_path):
    store = A.Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string")
    about = A.write_table(store, "labels/symbol=x", df, {"stage": "labels"})
    assert about["rows"] == 3 and about["stage"] == "labels" and A.manifest_of(store, "labels/symbol=x") == about
    assert sorted(A.read_table(store, "labels/symbol=x", verify=True).collect(), key=str) == sorted(df.collect(), key=str)
    assert A.content_hash(df.repartition(3).orderBy("v")) == A.content_hash(df) != A.content_hash(df.distinct())
    with pytest.raises(FileExistsError):
        A.write_table(store, "labels/symbol=x", df, {})
    with pytest.raises(FileNotFoundError):
        A.read_table(store, "labels/symbol=y")
    with pytest.raises(ZeroDivisionError):
        A.seal(store, "labels/symbol=z", lambda trial: 1 / 0, {})
    assert [n for n, _ in store.folders("labels")] == ["symbol=x"]
    df.limit(1).write.parquet(store.at("labels/symbol=x/rows2"))
    df.limit(1).write.mode("append").parquet(store.at("labels/symbol=x/rows"))
    with pytest.raises(ValueError, match="manifest"):
        A.read_table(store, "labels/symbol=x", verify=True)


def test_orphans_go_and_sealed_folders_stay(spark, tmp_path):
    store = A.Store(spark, str(tmp_path / "store"))
    df = spark.range(3)
    A.write_table(store, "a/b", df, {})
    df.write.parquet(store.at("a/.trial-b-dead/rows"))
    df.write.parquet(store.at("a/c/rows"))  # a writer that died before its seal
    assert A.collect_orphans(store, now_ms=0) == []
    assert A.collect_orphans(store, older_than_ms=0) == ["a/.trial-b-dead"]
    assert store.sealed("a/b") and A.write_table(store, "a/c", df, {})["rows"] == 3


def test_reports_are_replaced_whole(spark, tmp_path):
    import json

    where = str(tmp_path / "reports" / "quality.json")
    for payload in ({"b": 1, "a": [1, 2]}, {"a": "new"}):
        A.write_report(spark, where, payload)
        with open(where) as f:
            assert json.load(f) == payload


def test_model_bundles(spark, tmp_path):
    from tidemark.operators.models import meta_logit

    df = spark.createDataFrame([(float(i), float(i % 3), int(i > 9), 1.0) for i in range(20)], "x double, y double, label int, w double")
    model = meta_logit(df, ["x", "y"], "label", "w")
    store = A.Store(spark, str(tmp_path / "models"))
    about = A.write_model(store, "s/fold=1", model, [(0.1, 0.2), (0.9, 0.8)], ["x", "y"], {"tau": 0.4})
    again, knots, read = A.read_model(store, "s/fold=1")
    assert read == about and knots == [(0.1, 0.2), (0.9, 0.8)] and read["features"] == ["x", "y"]
    assert [r._prediction for r in again.transform(df).collect()] == [r._prediction for r in model.transform(df).collect()]
    with pytest.raises(FileExistsError):
        A.write_model(store, "s/fold=1", model, [], ["x", "y"], {})
    store.put("s/fold=1/calibrator.json", b"{}")
    with pytest.raises(ValueError, match="calibrator"):
        A.read_model(store, "s/fold=1")
    A.write_model(store, "s/fold=2", model, [(0.0, 0.0)], ["y", "x"], {})
    with pytest.raises(ValueError, match="manifest"):
        A.read_model(store, "s/fold=2")


def test_jump_paths_equal_all_paths():
    """The least of all paths, by trying each, for both kinds of vectors."""
    from itertools import product

    import numpy as np

    from tidemark.operators import regime

    rng = np.random.default_rng(4)
    for vectors in (np.eye(2), regime.simplex(2, 0.5), regime.simplex(3, 0.5)):
        costs = regime.jump_costs(vectors, 0.7)
        assert costs[0, 0] == 0 and (costs >= 0).all() and np.allclose(costs, costs.T)
        loss = rng.random((5, len(vectors)))
        total = lambda p: sum(loss[t, v] for t, v in enumerate(p)) + sum(costs[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert total(regime.jump_path(loss, costs)) == pytest.approx(min(total(p) for p in product(range(len(vectors)), repeat=5)))
    assert len(regime.simplex(2)) == 21 and np.allclose(regime.simplex(3).sum(1), 1)


def test_continuous_jumps_find_two_states(spark):
    import random

    from tidemark.operators import regime

    rng = random.Random(2)
    rows = [("a", i, rng.gauss(0.3 if (i // 50) % 2 else -0.3, 0.1), rng.gauss(2 if (i // 50) % 2 else 1, 0.2)) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, r double, vol double")
    for cont in (True, False):
        got = {r.open_time: r for r in regime.jump_states(df, ("r", "vol"), cont=cont).collect()}
        assert sum(got[i].state == (i // 50) % 2 for i in range(400)) > 370 and all(0.3 < r.probability <= 1 for r in got.values())


def test_coupled_variance_by_hand():
    import numpy as np

    from tidemark.operators import models

    x, psi = np.array([np.nan, 0.1, -0.2, np.nan, 0.3]), np.array([1.0, 2.0, np.nan, 1.0, 1.0])
    omega, alpha, beta, gamma = 0.01, 0.2, 0.8, -0.1
    h = [math.log(0.04)]
    for value, tau in ((0.1, 2.0), (-0.2, 1.0)):
        z = value / math.exp(h[-1] / 2)
        h.append(omega + beta**tau * h[-1] + tau * (alpha * (abs(z) - math.sqrt(2 / math.pi)) + gamma * z))
    got = models.coupled_log_variance(x, psi, (omega, alpha, beta, gamma), 1.0, math.log(0.04))
    assert np.isnan(got[0]) and got[1:].tolist() == pytest.approx([h[0], h[1], h[2], h[2]])
    # average durations throughout: the plain recursion
    one = models.coupled_log_variance(x, np.ones(5), (omega, alpha, beta, gamma), 1.0, math.log(0.04))
    z = 0.1 / 0.2
    assert one[2] == pytest.approx(omega + beta * math.log(0.04) + alpha * (z - math.sqrt(2 / math.pi)) + gamma * z)


def test_coupled_variance_is_fitted(spark):
    import numpy as np

    from tidemark.operators import models

    rng = np.random.default_rng(1)
    sd = np.where((np.arange(300) // 60) % 2, 0.03, 0.005)
    rows = [("a", i, float(rng.normal(0, sd[i])), float(rng.uniform(0.5, 2))) for i in range(300)] + [("b", i, 0.0, 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, x double, psi double")
    got = models.egarch_coupled(df, "x", "psi", 0.9).toPandas().sort_values("open_time")
    a = got[got.symbol == "a"]
    x, h = np.array([r[2] for r in rows[:270]]), np.log(a.variance.to_numpy()[:270])
    assert models.coupled_loss(x, h) < models.coupled_loss(x, np.full(270, math.log(x.var()))) and (a.beta.between(0, 0.999)).all()
    assert got[got.symbol == "b"].variance.isna().all()


def test_welch_gates_and_majority(spark):
    from tidemark.operators import analysis as N

    assert N.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    diff, low, high = N.welch_interval((1.0, 2.0, 10), (0.5, 1.0, 20))
    assert diff == 0.5 and (low, high) == pytest.approx((-0.985, 1.985), abs=0.02)
    assert math.isnan(N.welch_interval((1.0, 0.0, 1), (0.0, 1.0, 9))[1])
    assert N.fold_gate([0.6, 0.62, 0.61, 0.63], 0.5, 3)["passes"] and not N.fold_gate([0.6, 0.62], 0.5, 3)["passes"] and not N.fold_gate([0.6, 0.3, 0.61], 0.5, 3)["passes"]
    paths = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", -1.0), ("b", 1.0), ("b", None)], "g string, s double")
    assert {r.g: (r.n_paths, r.above, r.majority) for r in N.path_majority(paths, "s", 0.0, ["g"]).collect()} == {"a": (3, 2, True), "b": (2, 1, False)}


def test_pooled_bootstrap_and_max_t(spark):
    from tidemark.operators import research as X

    rows = [(g, i, float((i * 13) % 7 + (5 if g == "b" else 0))) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i long, x double")
    mean = sum(r[2] for r in rows) / len(rows)
    got = [r.mean for r in X.pooled_block_bootstrap(df, "x", "g", "i", 200, 5).collect()]
    assert len(got) == 200 and abs(sum(got) / 200 - mean) < 0.1 and got == [r.mean for r in X.pooled_block_bootstrap(df, "x", "g", "i", 200, 5).collect()]
    wide = spark.createDataFrame([(i, float(i % 10), float((i * 7) % 11), float(i % 10) + (i % 3)) for i in range(300)], "i long, a double, b double, y double")
    null = X.max_t_null(wide, ["a", "b"], "y", "i", 99, 3, 7)
    assert X.null_p_value(null, "max_t") == 0.01 and null.count() == 100
    noise = X.max_t_null(wide.withColumn("y", F.rand(3)), ["a", "b"], "y", "i", 99, 3, 7)
    assert X.null_p_value(noise, "max_t") > 0.01


def test_too_long_a_series_is_refused(spark, monkeypatch):
    from tidemark.operators import models
    from tidemark.operators import research as X

    monkeypatch.setattr(X, "VALUES_MOST", 5)
    monkeypatch.setattr(models, "SERIES_MOST", 5)
    df = spark.range(9).select(F.lit("a").alias("g"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="aggregate"):
        X.pooled_block_bootstrap(df, "x", "g", "i", 3, 1)
    with pytest.raises(ValueError, match="aggregate"):
        models.block_bootstrap(df, "x", 3, 1)


def test_experiments_and_remaining_trials(spark, tmp_path):
    store = A.Store(spark, str(tmp_path / "log"))
    assert [A.append_experiment(store, {"name": n}) for n in ("a", "b")] == [1, 2]
    store.put("experiments/000000003.json", b"{}")  # another writer was first
    assert A.append_experiment(store, {"name": "c"}) == 4
    assert sorted((r.experiment_id, r.name) for r in A.experiments(store, "name string").where("name is not null").collect()) == [(1, "a"), (2, "b"), (4, "c")]
    left = A.remaining(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), spark.createDataFrame([(1, 2)], "a int, b int"), ["a", "b"])
    assert [tuple(r) for r in left.collect()] == [(1, 3)]


def test_parzen_search_comes_near_the_best():
    from tidemark.operators import boosting

    score = lambda s: 1 - (s["x"] - 0.3) ** 2 - (s["y"] - 7) ** 2 / 100
    space = {"x": (0.0, 1.0), "y": (0.0, 10.0)}
    tried = boosting.parzen_search(score, space, 60, 3)
    assert len(tried) == 60 and tried[0]["auc"] > 0.99 and all(0 <= t["settings"]["x"] <= 1 and 0 <= t["settings"]["y"] <= 10 for t in tried)
    again = boosting.parzen_search(score, space, 60, 3, done=[])
    assert again == tried and boosting.parzen_search(score, space, 60, 3, done=tried) == tried
    best = boosting.over_seeds(tried, 3, [1, 2], lambda s, seed: score(s) - seed / 100)
    assert len(best) == 3 and best[0]["least"] < best[0]["mean"]


def test_ablation_arms(spark):
    from tidemark.operators import boosting

    df = spark.createDataFrame([(float(i), float(i % 7), int(i > 50)) for i in range(100)], "a double, b double, y int")
    score = lambda train, test, features: test.withColumn("_s", F.col("a") if "a" in features else F.col("b"))
    got = boosting.ablation([(df, df)], {"all": ["a", "b"], "without a": ["b"]}, "y", score)
    assert got[0]["auc"] == 1.0 and got[0]["loss"] == 0 and got[1]["loss"] > 0.3
