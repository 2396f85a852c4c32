"""The feature catalogue: every id on aligned bars, the kernels against plain versions, causality."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogue as G
from tidemark.operators import leakage as L
from tidemark.operators import windows as W

STEP = 900_000


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(4)
    rows, price = [], 100.0
    for i in range(260):
        o = price
        price = max(1.0, price + rng.gauss(0, 1))
        hi, lo = max(o, price) + rng.random(), min(o, price) - rng.random()
        rows.append(("a", i * STEP, i * STEP + STEP - 1, o, hi, lo, price, rng.randrange(5, 50), rng.random() * 1e4 + 2000, rng.randrange(1, 9), rng.randrange(0, 5)))
    b = spark.createDataFrame(rows, "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume long, quote_volume double, count long, taker_buy_volume long")
    funding = spark.createDataFrame([("a", k * 28_800_000, (k % 7 - 3) / 1e4) for k in range(10)], "symbol string, calc_time long, last_funding_rate double")
    names = ("sum_open_interest", "sum_open_interest_value", "sum_toptrader_long_short_ratio", "count_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio")
    metrics = spark.createDataFrame([("a", k * 300_000, *(rng.random() + j + 1 for j in range(6))) for k in range(780)], "symbol string, t long, " + ", ".join(f"{n} double" for n in names))
    minutes = spark.createDataFrame([("a", k * 60_000, rng.randrange(1, 9), rng.randrange(0, 2)) for k in range(3900)], "symbol string, open_time long, volume long, taker_buy_volume long")
    return G.align(b, funding, metrics, minutes).withColumn("threshold_quote", F.lit(1000.0))


def test_every_id_has_values(bars):
    got = G.catalogue(bars).toPandas().sort_values("open_time")
    assert len(got) == 260 and len(G.IDS) == 84 and list(got.columns) == ["symbol", "open_time", "close_time", *G.IDS]
    never = [k for k in G.IDS if got[k].isna().all()]
    assert never == ["E03f_funding_cum_3d"] or never == []  # nine settlements take three days
    assert set(got["E12f_price_oi_divergence"].dropna()) <= {-1.0, 0.0, 1.0} and got["B12_close_location_h3"].dropna().between(-1, 1).all()
    assert got["E27f_cost_atr_ratio"].dropna().gt(0).all() and got["C08_vol_pctile_rolling_1y"].dropna().equals(got["C07_vol_pctile_expanding"].dropna())


def test_recurrences_equal_the_operators(bars):
    got = G.catalogue(bars, ["C01_atr_20", "B01_rsi_14", "A14_dist_ema12_atr", "B04_macd_hist_norm", "C09_range_pctile_expanding", "A11_true_range_pct", "A15_dist_vwap_d_atr"]).toPandas().sort_values("open_time")
    key = ["symbol", "open_time"]
    want = W.atr(bars, 20).join(W.rsi(bars, 14), key).join(W.ema(bars, "close", 12), key).join(W.macd_histogram(bars), key).join(bars.select(*key, "close"), key).toPandas().sort_values("open_time")
    close = lambda a, b: np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-9, atol=1e-12)
    close(got["C01_atr_20"], want["atr"])
    close(got["B01_rsi_14"], (want["rsi"] - 50) / 50)
    close(got["A14_dist_ema12_atr"], (want["close"] - want["ema"]) / want["atr"])
    close(got["B04_macd_hist_norm"], want["histogram"] / want["atr"])
    tr = got["A11_true_range_pct"].tolist()
    plain = [None if i < 2 else np.mean([x <= tr[i] for x in tr[1:i]]) for i in range(len(tr))]
    close(got["C09_range_pctile_expanding"].iloc[2:], plain[2:])


def test_ranks_in_a_time_window():
    assert G.ranks_of([3.0, 1.0, None, 2.0, 2.0], [0, 1, 2, 3, 10], 3) == [None, 0.0, None, 0.5, None]
    assert G.ranks_of([3.0, 1.0, None, 2.0, 2.0], [0, 1, 2, 3, 10], None) == [None, 0.0, None, 0.5, 2 / 3]


def test_no_id_sees_the_future(bars):
    assert L.prefix_violations(G.catalogue, bars, "open_time", 200 * STEP, ["symbol", "open_time"], list(G.IDS), 1e-7) == 0


def test_bars_alone_give_null_positioning(bars):
    alone = bars.select("symbol", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "count", "taker_buy_volume")
    got = G.catalogue(alone, ["E01f_funding_last", "E11f_oi_change_1d", "A17_log_tr_per_overshoot_ratio", "A01_log_return_1"]).agg(*[F.count(c).alias(c) for c in ("E01f_funding_last", "E11f_oi_change_1d", "A17_log_tr_per_overshoot_ratio", "A01_log_return_1")]).first()
    assert tuple(got) == (0, 0, 0, 259)
