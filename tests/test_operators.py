"""Small cases worked out by hand, causality, and equality of batch and stream."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import costs, semantics
from tidemark.operators import asof, bars, quality, ranges, ranking, regime, validation, windows
from tidemark.operators.walkforward import Carry, walkforward_bars

TRADES = "symbol string, transact_time long, agg_trade_id long, price double, quantity long, is_buyer_maker boolean"


def tape(spark, values, symbol="a"):
    return spark.createDataFrame([(symbol, i, i, float(p), int(q), i % 2 == 0) for i, (p, q) in enumerate(values)], TRADES)


def series(spark, values, symbol="a"):
    return spark.createDataFrame([(symbol, i, None if v is None else float(v)) for i, v in enumerate(values)], "symbol string, open_time long, x double")


def test_threshold_bar_crossing_trade_opens_the_next(spark):
    got = bars.dollar_bars(tape(spark, [(1, 4), (1, 5), (1, 1), (1, 25), (1, 1)]), 10).orderBy("bar_id").collect()
    # running sums 4, 9, 10, 35, 36: bars 0, 0, 1, 3, 3; id 2 is skipped
    assert [(r.bar_id, r["count"], r.open_time, r.close_time) for r in got] == [(0, 2, 0, 1), (1, 1, 2, 2), (3, 2, 3, 4)]


def test_threshold_bars_of_no_trades(spark):
    assert bars.dollar_bars(tape(spark, []), 10).count() == 0


def test_running_sum_does_not_depend_on_blocks(spark):
    t = tape(spark, [(0.1 * i, i % 7 + 1) for i in range(200)])
    one = bars.running_sum(t, F.col("price") * F.col("quantity"), ["symbol"], "transact_time", "agg_trade_id", 10**9)
    many = bars.running_sum(t, F.col("price") * F.col("quantity"), ["symbol"], "transact_time", "agg_trade_id", 7)
    key = lambda df: sorted((r.agg_trade_id, r.cum) for r in df.collect())
    assert key(one) == key(many)


def test_resample_drops_incomplete_buckets_everywhere(spark):
    rows = [("a", 60_000 * i, 60_000 * i + 59_999, 1.0, 2.0, 0.5, 1.5, 1, 1.0, 1, 1, 1.0) for i in (0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume long, quote_volume double, count long, taker_buy_volume long, taker_buy_quote_volume double")
    got = bars.resample(df, 300_000).orderBy("open_time").collect()
    assert [(r.open_time, r.volume, r.close_time) for r in got] == [(0, 5, 299_999), (600_000, 5, 899_999)]


def test_asof_backward_and_null_values(spark):
    left = spark.createDataFrame([("a", 899_999), ("a", 1_799_999), ("a", 2_699_999), ("a", 100)], "symbol string, t long")
    right = spark.createDataFrame([("a", 500_000, 10.0), ("a", 1_700_000, None), ("a", 2_600_000, 30.0)], "symbol string, rt long, v double")
    got = {r.t: (r.v, r.rt) for r in asof.asof(left, right, "t", "rt", ["v", "rt"], ["symbol"], block=1_000_000).collect()}
    assert got == {899_999: (10.0, 500_000), 1_799_999: (None, 1_700_000), 2_699_999: (30.0, 2_600_000), 100: (None, None)}


def test_asof_with_empty_right_side(spark):
    left = spark.createDataFrame([("a", 1)], "symbol string, t long")
    right = spark.createDataFrame([], "symbol string, rt long, v double")
    assert [tuple(r) for r in asof.asof(left, right, "t", "rt", ["v"], ["symbol"]).collect()] == [("a", 1, None)]


def test_asof_does_not_see_the_future(spark):
    left = spark.createDataFrame([("a", i * 10) for i in range(50)], "symbol string, t long")
    right = [("a", i * 7, float(i)) for i in range(80)]
    early = asof.asof(left, spark.createDataFrame(right, "symbol string, rt long, v double"), "t", "rt", ["v"], ["symbol"], block=100)
    other = asof.asof(left, spark.createDataFrame([(s, t, v if t <= 200 else -1.0) for s, t, v in right], "symbol string, rt long, v double"), "t", "rt", ["v"], ["symbol"], block=100)
    pick = lambda df: sorted((r.t, r.v) for r in df.where("t <= 200").collect())
    assert pick(early) == pick(other)


def path(spark, rows):
    return spark.createDataFrame([("a", t, *map(float, x)) for t, *x in rows], "symbol string, open_time long, open double, high double, low double, close double")


def order(spark, side=1, tp=11.0, sl=9.0, end=3):
    return spark.createDataFrame([("a", "o", side, 0, end, 10.0, tp, sl)], "symbol string, oid string, side int, t_entry long, horizon_end long, fill_price double, tp_price double, sl_price double")


@pytest.mark.parametrize(
    ("rows", "hit", "price", "tie", "gap"),
    [
        ([(0, 10, 10.5, 9.5, 10), (1, 10, 11.2, 9.9, 11)], "TP", 11.0, False, False),
        ([(0, 10, 10.5, 9.5, 10), (1, 10, 10.2, 8.9, 9)], "SL", 9.0, False, False),
        ([(0, 10, 10.5, 9.5, 10), (1, 8.5, 8.7, 8.0, 8.2)], "SL", 8.5, False, True),
        ([(0, 10, 11.5, 8.5, 10)], "TP", 11.0, True, False),  # as near to either: the profit
        ([(0, 9.5, 11.5, 8.5, 10)], "SL", 9.0, True, False),
        ([(0, 10, 10.5, 9.5, 10), (3, 10, 10.5, 9.5, 10.4), (4, 10, 12, 8, 10)], "TIME", 10.4, False, False),
    ],
)
def test_first_touch(spark, rows, hit, price, tie, gap):
    got = ranges.first_touch(order(spark), path(spark, rows), "oid", 10).collect()[0]
    assert (got.barrier_hit, got.exit_price, got.tie_break_used, got.gap_fill_used) == (hit, price, tie, gap)


def test_short_side_mirrors(spark):
    got = ranges.first_touch(order(spark, -1, 9.0, 11.0), path(spark, [(0, 10, 10.5, 9.5, 10), (1, 10, 10.1, 8.9, 9)]), "oid", 10).collect()[0]
    assert (got.barrier_hit, got.exit_price, got.mfe, got.mae) == ("TP", 9.0, pytest.approx(1.1), pytest.approx(0.5))


def test_order_without_path_has_no_outcome(spark):
    got = ranges.first_touch(order(spark), path(spark, [(7, 10, 11, 9, 10)]), "oid", 10).collect()[0]
    assert got.barrier_hit is None and got.exit_price is None


def test_fill_window_is_open_on_the_left(spark):
    o = spark.createDataFrame([("a", "x", 5, 9, 1, 1.0), ("a", "y", 6, 9, 1, 0.5)], "symbol string, oid string, t_post long, horizon long, side int, limit_price double")
    t = spark.createDataFrame([("a", 5, 1, 0.9), ("a", 7, 2, 0.95), ("a", 9, 3, 0.5)], "symbol string, transact_time long, agg_trade_id long, price double")
    got = {r.oid: (r.t_entry, r.fill_price) for r in ranges.maker_fill(o, t, "oid", 10).collect()}
    assert got == {"x": (7, 1.0), "y": (9, 0.5)}


def test_concurrency_of_three_intervals(spark):
    df = spark.createDataFrame([("a", "1", 0, 10), ("a", "2", 5, 25), ("a", "3", 20, 30)], "symbol string, label_id string, t0 long, t1 long")
    got = {r.label_id: (r.concurrency, r.uniqueness) for r in ranges.concurrency(df).collect()}
    # places: 1 covers 1-2, 2 covers 2-3, 3 covers 3: counts 1, 2, 2
    assert got == {"1": (1, pytest.approx(0.75)), "2": (2, pytest.approx(0.5)), "3": (2, pytest.approx(0.5))}


def test_ema_and_wilder_seeds(spark):
    got = [r.ema for r in windows.ema(series(spark, [1, 2, 3, 4]), "x", 3).orderBy("open_time").collect()]
    assert got == [None, None, 2.25, 3.125]
    got = [r.wilder for r in windows.wilder(series(spark, [1, 2, None, 3, 7]), "x", 3).orderBy("open_time").collect()]
    assert got == [None, None, None, 2.0, pytest.approx((2 * 2 + 7) / 3)]


def test_percentile_rank_counts_earlier_ties(spark):
    got = [r["rank"] for r in windows.percentile_rank(series(spark, [2, 1, 2, 3, 2]), "x").orderBy("open_time").collect()]
    assert got == [None, 0.0, 1.0, 1.0, 0.75]
    got = [r["rank"] for r in windows.percentile_rank(series(spark, [2, 1, 2, 3, 2]), "x", last=2).orderBy("open_time").collect()]
    assert got == [None, 0.0, 1.0, 1.0, 0.5]


def test_rolling_needs_a_full_window(spark):
    df = series(spark, [1, 2, None, 4, 5, 6])
    got = [r.m for r in df.select("open_time", windows.rolling(F.avg("x"), "x", 3).alias("m")).orderBy("open_time").collect()]
    assert got == [None, None, None, None, None, 5.0]


def test_windows_do_not_see_the_future(spark):
    a, b = [math.sin(i) for i in range(60)], [math.sin(i) if i < 40 else 99.0 for i in range(60)]
    for make in (lambda d: d.select("open_time", windows.expanding_zscore("x").alias("v")), lambda d: windows.ema(d, "x", 5).select("open_time", F.col("ema").alias("v")), lambda d: windows.percentile_rank(d, "x").select("open_time", F.col("rank").alias("v"))):
        pick = lambda d: sorted((r.open_time, r.v) for r in make(d).where("open_time < 40").collect())  # noqa: B023, E731
        assert pick(series(spark, a)) == pick(series(spark, b))


def test_prefixes_give_the_same_rows(spark):
    values = [math.cos(i * 1.7) for i in range(50)]
    whole = {r.open_time: r.z for r in series(spark, values).select("open_time", windows.rolling_zscore("x", 8).alias("z")).collect()}
    for n in (20, 35):
        part = {r.open_time: r.z for r in series(spark, values[:n]).select("open_time", windows.rolling_zscore("x", 8).alias("z")).collect()}
        assert part == pytest.approx({t: whole[t] for t in part}, nan_ok=True, abs=1e-8)


def test_islands(spark):
    got = [(r.segment, r.run_length) for r in windows.islands(series(spark, [1, 1, 2, 2, 2, 1]), "x").orderBy("open_time").collect()]
    assert got == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 1)]


def test_positions_equal_a_sort(spark):
    df = spark.range(500).select("id", ((F.col("id") * 7919) % 101).cast("double").alias("v"))
    got = sorted((r.v, r.id, r.position) for r in ranking.positions(df, "v", ["id"]).collect())
    assert [p for *_, p in got] == list(range(500))


def test_decile_is_not_ntile(spark):
    df = spark.range(25).select("id", F.col("id").cast("double").alias("v"))
    got = sorted((r.bucket, r.n) for r in validation.decile_profile(df, "v", ["id"], "v").collect())
    assert [n for _, n in got] == [3, 2, 3, 2, 3, 2, 3, 2, 3, 2]


def test_splits_and_paths():
    assert len(validation.split_table(6, 2)) == 15
    ps = validation.paths(6)
    assert len(ps) == 5 and all(sorted(g for pair in p for g in pair) == list(range(6)) for p in ps)
    assert len({pair for p in ps for pair in p}) == 15


def test_purge_and_embargo(spark):
    df = spark.createDataFrame([(str(i), i * 10, i * 10 + 15) for i in range(60)], "label_id string, t0 long, t1 long")
    rows = validation.purged_splits(df, 6, 2, embargo_ms=20).where("split_id = 14").collect()  # the last two groups
    role = {int(r.label_id): r.role for r in rows}
    test = [i for i, r in role.items() if r == "test"]
    assert min(test) == 40 and max(test) == 59
    assert role[39] == role[38] == "purged" and role[36] == "train"


def test_normal_scores():
    assert validation.normal_cdf(0) == 0.5
    assert validation.expected_max_sharpe(1.0, 1) == 0.0 and validation.expected_max_sharpe(1.0, 100) > 2


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "p double, y int")
    got = validation.auc(df, "p", "y").collect()[0]
    assert got.roc_auc == pytest.approx(0.875) and got.pr_auc == pytest.approx((1 * 1 + 1 * 2 / 3) / 2)


def test_guarded_division(spark):
    got = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double").select(semantics.ratio(F.col("a"), F.col("b"), 0.5).alias("x")).collect()
    assert [r.x for r in got] == [0.5, 0.5, 0.25]


def test_nan_becomes_null(spark):
    df = semantics.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert df.where("x is null").count() == 1


def test_tick_rounding(spark):
    df = spark.createDataFrame([(1.234, 1), (1.234, -1), (0.3, 1)], "p double, s int").select(costs.round_to_tick(F.col("p"), F.col("s"), "0.1").alias("x"))
    assert [r.x for r in df.collect()] == [1.2, 1.3, 0.3]


def test_decision_rule(spark):
    df = spark.createDataFrame([(0.7, 0.6), (0.6, 0.7), (0.4, 0.7), (0.1, 0.1)], "a double, b double").select(costs.decide_side(F.col("a"), F.col("b"), 0.5, 0.5).alias("x"))
    assert [r.x for r in df.collect()] == [1, -1, -1, 0]


def test_schema_violations(spark):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    other = spark.createDataFrame([(1, 2.0)], "a int, c double")
    assert quality.schema_violations(df, df.schema) == []
    assert quality.schema_violations(df.select("b", "a"), df.schema) == ["the order of the columns differs"]
    assert len(quality.schema_violations(df, other.schema)) == 3


def test_declared_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "a long, b double")
    assert quality.declared_check(df, "unique(a)") and not quality.declared_check(df, "not_null(b)")
    with pytest.raises(ValueError, match="no such check"):
        quality.declared_check(df, "drop(a)")
    with pytest.raises(ValueError, match="order"):
        quality.declared_check(df, "monotonic_increasing(a)")


@pytest.mark.parametrize(("values", "fine"), [([1, 2, 3], True), ([3, 1, 2], False), ([1, 2, 2], False), ([1, None, 3], False), ([None, 1], False), ([5], True), ([], True), (list(range(3000)), True), ([*range(2000), 1999], False)])
def test_monotonic_looks_at_the_rows_as_they_stand(spark, values, fine):
    df = spark.createDataFrame(list(enumerate(values)), "i long, a long").repartition(3)
    assert quality.declared_check(df, "monotonic_increasing(a)", ["i"]) is fine


def test_gap_triggers_equal_the_plain_version():
    import random

    import numpy as np

    rng = random.Random(3)
    for k in range(6):
        times = list(np.cumsum([rng.choice([5, 5, 7, rng.randrange(1, 60), 0 if k % 2 else 9]) for _ in range(120)]))
        past, deviations = [], []
        for i, got in enumerate(regime.gap_triggers([int(t) for t in times])):
            if not i:
                assert got is None
                continue
            gap = times[i] - times[i - 1]
            if gap <= 0:
                assert got is True
                continue
            if len(past) < 3:
                assert got is None
            else:
                m, mad = np.median(past), np.median(deviations)
                scale = mad if mad > 0 else np.mean(deviations)
                assert got == (0.6745 * (gap - m) / scale > 3.5 if scale > 0 else gap > m)
            past.append(gap)
            deviations.append(abs(gap - np.median(past)))


def test_student_t_tail():
    from tidemark.operators.analysis import one_sided_gate, t_tail

    for t, df, want in ((0.0, 5, 0.5), (2.015048, 5, 0.05), (12.7062, 1, 0.025), (-1.0, 1, 0.75), (1.660234, 100, 0.05), (3.0, 2, 0.047733)):
        assert t_tail(t, df) == pytest.approx(want, abs=2e-6)
    assert one_sided_gate(1.0, 1.0, 6, 0.0) and not one_sided_gate(1.0, 1.3, 5, 0.0) and not one_sided_gate(1.0, 0.0, 9, 0.0)


def test_quantiles_and_running_sums_without_one_task(spark):
    import numpy as np

    x = [float((i * 7919) % 1000) for i in range(997)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(x)] + [(None, -1)], "x double, i long")
    assert ranking.quantiles(df, "x", [0.0, 0.1, 0.5, 0.999, 1.0]) == pytest.approx(list(np.quantile(x, [0.0, 0.1, 0.5, 0.999, 1.0])))
    assert ranking.quantiles(df.where("x < 0"), "x", [0.5]) == [None]
    got = {r.i: r.s for r in ranking.running(df.where("i >= 0"), {"s": F.lit(1)}, "i").collect()}
    assert got == {i: i + 1 for i in range(997)}


def test_fdr_in_blocks_of_ranks(spark, monkeypatch):
    p = [((i * 37) % 101) / 101 for i in range(101)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id long, p double")
    monkeypatch.setattr(validation, "RANKS_OF_BLOCK", 7)
    order = sorted(range(101), key=lambda i: p[i])
    want, low = {}, 1.0
    for rank in range(101, 0, -1):
        low = min(low, p[order[rank - 1]] * 101 / rank)
        want[order[rank - 1]] = low
    assert {r.id: r.adjusted for r in validation.fdr(df, "p").collect()} == pytest.approx(want)
    h = sum(1 / i for i in range(1, 102))
    scaled = {r.id: r.adjusted for r in validation.fdr(df, "p", yekutieli=True).collect()}
    assert all(scaled[i] <= min(1.0, want[i] * h) + 1e-12 for i in want)
    big = spark.createDataFrame([(5000,)], "n long").select(validation.harmonic("n").alias("h")).first().h
    assert big == pytest.approx(sum(1 / i for i in range(1, 5001)), abs=1e-13)


def test_dead_features(spark):
    from tidemark.operators.features import dead_columns

    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None), (None, 2.0, None)], "a double, b double, c double")
    assert {r.column: (r.known, r.dead) for r in dead_columns(df, ["a", "b", "c"]).collect()} == {"a": (2, True), "b": (3, False), "c": (0, True)}


def test_regime_needs_count_and_time():
    c = regime.Cutoffs(confirm_bars=2, confirm_ms=100)
    state, seen = regime.START, []
    for t, er in ((0, 0.1), (60, 0.9), (120, 0.9), (180, 0.9), (240, None), (300, 0.9)):
        state, _, got = regime.step_machine(state, er, 0.1, False, t, c)
        seen.append(got)
    assert seen == ["R1", "R1", "R1", "R3", "R0", "R3"]
    assert regime.step_machine(state, 0.9, 0.9, True, 400, c)[2] == "R5"


def test_carry_survives_chunks():
    trades = [(i, 1.0, float(i % 5 + 1)) for i in range(100)]
    whole = Carry(17.0)
    expected = whole.step(trades) + whole.finish()
    for size in (1, 3, 50):
        c, got = Carry(17.0), []
        for a in range(0, 100, size):
            got += c.step(trades[a : a + size])
        assert got + c.finish() == expected


def test_walkforward_skips_periods_without_a_past(spark):
    day = 86_400_000
    rows = [("a", d * day + i, d * 100 + i, 1.0, 10, True) for d in (0, 1, 2) for i in range(10)]
    got = walkforward_bars(spark.createDataFrame(rows, TRADES), 7, 1, 2).collect()
    assert min(r.open_time for r in got) >= day and sum(r["count"] for r in got) == 20


RULE = bars.ImbalanceRule(sign_span=9, length_span=3, initial_length=4.0, least=2.0, most=60.0)


def test_imbalance_bars_by_hand(spark):
    """Without memory (spans of one) a bar ends where the signed count reaches the length of the bar before."""
    price = [100.0, 101.0, 102.0, 99.0, 98.0, 97.0, 103.0, 104.0, 105.0, 106.0]
    maker = [False, False, False, True, True, False, False, False, False, False]
    t = spark.createDataFrame([("a", i, i, p, 2, m) for i, (p, m) in enumerate(zip(price, maker, strict=True))], TRADES)
    got = sorted(bars.tick_imbalance_bars(t, bars.ImbalanceRule(1, 1, 3.0, 1.0, 100.0)).collect(), key=lambda r: r.bar_id)
    assert [(r.open_time, r.close_time, r["count"], r.open, r.high, r.low, r.close) for r in got] == [(0, 2, 3, 100.0, 102.0, 100.0, 102.0), (3, 9, 7, 99.0, 106.0, 97.0, 106.0)]
    assert [(r.volume, r.taker_buy_volume, r.threshold_quote) for r in got] == [(6.0, 6.0, None), (14.0, 10.0, None)]
    assert got[0].quote_volume == got[0].taker_buy_quote_volume == 606.0


def test_a_balanced_flow_still_closes_bars(spark):
    t = spark.createDataFrame([("a", i, i, 100.0 + i % 5, 1, i % 2 == 0) for i in range(200)], TRADES)
    got = bars.tick_imbalance_bars(t, bars.ImbalanceRule(99, 3, 20.0, 1.0, 1000.0)).collect()
    assert len(got) > 1 and sum(r["count"] for r in got) == 200
    for wrong in ({"sign_span": 0}, {"length_span": 0}, {"initial_length": 0.0}, {"least": 0.0}, {"least": 50.0, "most": 10.0}):
        with pytest.raises(ValueError):
            bars.ImbalanceRule(**wrong)


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import bars as S

    t = spark.createDataFrame([(s, i, i, float((i * 37) % 11), i % 5 + 1, i % 2 == 0) for s in "ab" for i in range(300)], TRADES)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        t.where(f"transact_time >= {k * 100} and transact_time < {(k + 1) * 100}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for processor, batch in ((S.ThresholdBars(50), bars.dollar_bars(t, 50)), (S.ImbalanceBars(RULE), bars.tick_imbalance_bars(t, RULE))):
        name = type(processor).__name__
        # files of one batch may come in any order of their names: write order is kept by the time in them
        q = S.stateful_bars(stream, processor).writeStream.outputMode("append").format("parquet").option("path", f"{sink}/{name}").option("checkpointLocation", f"{sink}/c{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted((r.symbol, r.bar_id, r.open_time, r.close_time, r.open, r.high, r.low, r.close, r["count"]) for r in spark.read.parquet(f"{sink}/{name}").collect())
        want = sorted((r.symbol, r.bar_id, r.open_time, r.close_time, r.open, r.high, r.low, r.close, r["count"]) for r in batch.collect())
        closed = set(got)
        assert closed <= set(want) and len(want) - len(closed) <= 2, name  # the open bar of each symbol is still in the state


def test_tumbling_stream(spark, tmp_path):
    from tidemark.streaming import bars as S

    t = tape(spark, [(i % 7, 1) for i in range(50)]).withColumn("transact_time", F.col("transact_time") * 60_000)
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    df = S.tumbling_ohlcv(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), "10 minutes", "0 seconds")
    q = df.writeStream.outputMode("append").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.open_time: (r.open, r.close, r["count"]) for r in spark.sql("select * from tumbling").collect()}
    want = {r.open_time: (r.open, r.close, r["count"]) for r in bars.clock_bars(t, 600_000).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_round_trip_of_sources(spark, tmp_path):
    from tidemark.sources import tables as S
    from tidemark.sources.contracts import CONTRACTS

    csv = tmp_path / "f.csv"
    csv.write_text("calc_time,funding_interval_hours,last_funding_rate\n1,8,0.0001\n2,8,x\n")
    got = S.read_csv(spark, str(csv), "funding").collect()
    assert [(r.calc_time, r.last_funding_rate) for r in got] == [(1, "0.0001"), (2, "x")]
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    S.write_artifact(df, str(tmp_path / "art"), "stage", {"k": 1}, "a", "r1", df.schema)
    assert S.read_artifact(spark, str(tmp_path / "art"), "stage", {"k": 1}, "a", "r1").collect() == df.collect()
    assert S.scan_artifacts(spark, str(tmp_path / "art"), "stage", df.schema).first().symbol == "a"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        S.write_artifact(df, str(tmp_path / "art"), "stage", {"k": 1}, "a", "r1")
    bars_ = spark.createDataFrame([tuple([d * 86_400_000] + [1.0] * 4 + [1.0, d * 86_400_000 + 5, 1.0, 1, 1.0, 1.0, 7.0]) for d in range(3)], CONTRACTS["dollar_bars_r1"].schema)
    S.write_by_day(bars_, str(tmp_path / "days"))
    assert S.scan(spark, str(tmp_path / "days"), "dollar_bars_r1", start="1970-01-02", end="1970-01-02").count() == 1
    assert S.scan(spark, str(tmp_path / "days"), "dollar_bars_r1", start="1999-01-02").columns[:2] == ["open_time", "open"]


def test_tables_that_cut_a_plan_can_be_cleared(spark):
    from tidemark.sources import shared

    df = shared.materialise(spark.range(5))
    assert df.count() == 5 and shared.clear(spark) and not shared.clear(spark)


def test_boosting_respects_its_constraint(spark):
    from tidemark.operators import boosting

    df = spark.range(400).select(((F.col("id") * 37) % 101 / 101.0).alias("a"), ((F.col("id") * 53) % 89 / 89.0).alias("b"), F.lit(1.0).alias("w"))
    df = df.withColumn("y", (F.col("a") + 0.2 * F.col("b") > 0.6).cast("int"))
    stumps, base = boosting.fit(df, ["a", "b"], "y", "w", rounds=8)
    assert validation.auc(df.withColumn("s", boosting.probability(stumps, base)), "s", "y").first().roc_auc > 0.9
    down, _ = boosting.fit(df, ["a", "b"], "y", "w", signs={"a": -1, "b": 1}, rounds=8)
    assert all(s.right <= s.left for s in down if s.feature == "a") and all(s.right >= s.left for s in down if s.feature == "b")
    tried = boosting.search([(df, df)], ["a", "b"], "y", "w", {"rounds": [1, 4]})
    assert [t["settings"]["rounds"] for t in tried] == [4, 1]
    assert boosting.search([], ["a"], "y", "w", {"rounds": [1, 4]}, tried) == tried
