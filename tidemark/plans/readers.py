"""Scans, CSV, artifacts and the leakage suite: each writes the events as a table of its own kind and reads that."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import leakage as L
from ..operators import research as X
from ..operators import validation as V
from ..operators import windows as W
from ..sources import artifacts as A
from ..sources import shared
from ..sources import tables as S
from .base import HEAD, HOUR, SYMBOLS, TICKS, hours, query, r, ticks
from .bars import ROUNDED, shown
from .validation import _EMBARGO, spans
from .windows import O, full, log


def place(spark) -> str:
    """A folder of its own, cleared with the application's other tables."""
    return f"{shared._tables(spark)}/{uuid.uuid4().hex}"


def stored(spark, sf_dir, folder: str) -> str:
    t = ticks(spark, sf_dir).withColumns({"first_trade_id": F.col("agg_trade_id"), "last_trade_id": F.col("agg_trade_id"), "quantity": F.col("quantity").cast("double")})
    at = F.timestamp_millis("transact_time")
    t = t.withColumn(folder, F.to_date(at) if folder == "day" else F.date_format(at, "yyyy-MM"))
    root = place(spark)
    t.repartition("symbol", folder).write.partitionBy("symbol", folder).parquet(root)
    return root


_DAYS = f"WITH {TICKS} SELECT symbol, agg_trade_id, transact_time, price, CAST(quantity AS DOUBLE) AS quantity, is_buyer_maker FROM ticks WHERE symbol = 'view' AND transact_time BETWEEN 1704585600000 AND 1704844799999"
_SHOWN = ("symbol", "agg_trade_id", "transact_time", "price", "quantity", "is_buyer_maker")


@query(_DAYS)
def q_scan_days(spark, sf_dir):
    return S.scan(spark, stored(spark, sf_dir, "day"), "agg_trades", "view", "2024-01-07", "2024-01-09").select(*_SHOWN)


@query(_DAYS)
def q_scan_months(spark, sf_dir):
    return S.scan(spark, stored(spark, sf_dir, "month"), "agg_trades", "view", "2024-01-07", "2024-01-09", folder="month").select(*_SHOWN)


@query(f"WITH {TICKS} SELECT symbol, CAST(transact_time // 86400000 AS BIGINT) AS day, count(*) AS n, CAST(sum(agg_trade_id) AS BIGINT) AS ids FROM ticks GROUP BY 1, 2")
def q_split_months(spark, sf_dir):
    to = place(spark)
    S.split_months(spark, stored(spark, sf_dir, "month"), "agg_trades", to)
    days = S.scan(spark, to, "agg_trades")
    return days.groupBy("symbol", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("agg_trade_id").alias("ids"))


@query(
    f"""{HEAD}, two AS (SELECT symbol, open_time // 7200000 * 7200000 AS b, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, CAST(sum(volume) AS BIGINT) AS volume, sum(quote_volume) AS quote_volume,
    CAST(sum(count) AS BIGINT) AS count, CAST(sum(taker_buy_volume) AS BIGINT) AS taker_buy_volume, sum(taker_buy_quote_volume) AS taker_buy_quote_volume FROM bars WHERE open_time >= 1704585600000 GROUP BY 1, 2 HAVING count(*) = 2)
    SELECT symbol, b AS open_time, b + 7199999 AS close_time, {ROUNDED} FROM two"""
)
def q_scan_resampled(spark, sf_dir):
    bars = hours(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("volume", "taker_buy_volume")}).withColumn("day", F.to_date(F.timestamp_millis("open_time")))
    root = place(spark)
    bars.repartition("symbol", "day").write.partitionBy("symbol", "day").parquet(root)
    df = S.scan_bars(spark, root, "bars_1h", "2h", start="2024-01-07")
    return shown(df.withColumns({c: F.col(c).cast("long") for c in ("volume", "taker_buy_volume")}), "symbol", "open_time", "close_time")


@query(f"WITH {TICKS} SELECT agg_trade_id, transact_time, price, CAST(quantity AS DOUBLE) AS quantity, is_buyer_maker FROM ticks")
def q_csv_ingest(spark, sf_dir):
    t = ticks(spark, sf_dir).select("agg_trade_id", "price", "quantity", F.col("agg_trade_id").alias("first_trade_id"), F.col("agg_trade_id").alias("last_trade_id"), "transact_time", "is_buyer_maker")
    root = place(spark)
    t.write.option("header", True).csv(root)
    return S.read_csv(spark, root, "agg_trades").select("agg_trade_id", "transact_time", "price", "quantity", "is_buyer_maker")


@query(f"{HEAD} SELECT symbol, count(*) AS n, min(open_time) AS first, round(sum(close), 4) + 0 AS closes FROM bars WHERE symbol IN ('click', 'view') GROUP BY 1")
def q_artifact_round_trip(spark, sf_dir):
    b, root = hours(spark, sf_dir).select("symbol", "open_time", "close"), place(spark)
    own = b.select(F.col("symbol").alias("name"), "open_time", "close")
    for s in ("click", "error", "view"):
        S.write_artifact(own.where(F.col("name") == s), root, "bars", {"step": "1h"}, s, "1h")
    again = S.read_artifact(spark, root, "bars", {"step": "1h"}, "click", "1h")
    every = S.scan_artifacts(spark, root, "bars", again.schema).where(F.col("symbol").isin("click", "view"))
    return every.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("open_time").alias("first"), r(F.sum("close"), 4).alias("closes"))


@query(f"{HEAD} SELECT count(*) AS n, round(sum(close), 4) + 0 AS closes, true AS holds FROM bars")
def q_sealed_table(spark, sf_dir):
    store = A.Store(spark, place(spark))
    about = A.write_table(store, "bars/step=1h", hours(spark, sf_dir).select("symbol", "open_time", "close"), {"step": "1h"})
    df = A.read_table(store, "bars/step=1h", verify=True)
    return df.agg(F.count(F.lit(1)).alias("n"), r(F.sum("close"), 4).alias("closes")).withColumn("holds", F.col("n") == about["rows"])


_INDEX = "ix AS (SELECT transact_time // 21600000 * 21600000 AS calc_time, avg(price) AS index_value FROM ticks GROUP BY 1)"


@query(
    f"""{HEAD}, {_INDEX}, p AS (SELECT *, lag(close) OVER {O} AS pc FROM bars), q AS (SELECT *, ({log('close')}) - ({log('pc')}) AS r1 FROM p), j AS (SELECT q.*, ix.index_value AS c13 FROM q ASOF LEFT JOIN ix ON q.close_time >= ix.calc_time),
    z AS (SELECT *, {full('avg(c13)', 'c13', 24)} AS m, {full('stddev_samp(c13)', 'c13', 24)} AS sd, {full('stddev_samp(r1)', 'r1', 24)} AS rv FROM j)
    SELECT symbol, open_time, round(CASE WHEN pc <> 0 THEN (open - pc) / pc END, 8) + 0 AS gap_pct, round((open_time - 1704499200000) / 86400000.0e0, 8) + 0 AS days_since, round(c13, 6) + 0 AS c13, round(CASE WHEN sd > 1e-9 THEN (c13 - m) / sd END, 5) + 0 AS c14, round(c13 / 100 - rv * sqrt(8766.0e0), 6) + 0 AS c15 FROM z WHERE open_time >= 1704499200000"""
)
def q_research_features(spark, sf_dir):
    b = hours(spark, sf_dir).withColumn("gap_pct", X.gap_pct()).withColumn("r1", W.log_return("close")).withColumn("rv", X.realised_volatility("r1", 24))
    index = ticks(spark, sf_dir).groupBy(F.expr("transact_time div 21600000 * 21600000").alias("calc_time")).agg(F.avg("price").alias("index_value"))
    b = X.index_features(b, index, 24, "rv", 8766.0)
    b = b.withColumn("C14_bvol_z", F.when(W.rolling(F.stddev_samp("C13_bvol_index"), "C13_bvol_index", 24) > 1e-9, F.col("C14_bvol_z")))
    b = X.days_since(b, spark.createDataFrame([(1704499200000,), (1893456000000,)], "event_ms long")).where("days_since is not null")
    return b.select("symbol", "open_time", r("gap_pct", 8).alias("gap_pct"), r("days_since", 8).alias("days_since"), r("C13_bvol_index").alias("c13"), r("C14_bvol_z", 5).alias("c14"), r("C15_iv_rv_spread").alias("c15"))


@query(f"""{HEAD}, {_INDEX}, a AS (SELECT b.symbol, b.open_time, i.calc_time AS x FROM bars b ASOF LEFT JOIN ix i ON b.open_time >= i.calc_time), c AS (SELECT b.symbol, b.open_time, i.calc_time AS y FROM bars b ASOF LEFT JOIN ix i ON b.close_time >= i.calc_time)
SELECT symbol, count(*) AS n, count(CASE WHEN x IS DISTINCT FROM y THEN 1 END) AS differing FROM a JOIN c USING (symbol, open_time) GROUP BY 1""")
def q_open_close_divergence(spark, sf_dir):
    at = F.expr("transact_time div 21600000 * 21600000")
    index = ticks(spark, sf_dir).select(at.alias("calc_time")).distinct()
    events = index.crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string"))).withColumn("v", F.col("calc_time"))
    return X.open_close_divergence(hours(spark, sf_dir), events, "calc_time", "v")


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus AS regime, o_totalprice AS score, l.ret FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * l_discount) AS ret FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY score, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY regime) AS m FROM b) SELECT regime, CAST(i * 8 // m AS BIGINT) AS bucket, count(*) AS n, round(avg(score), 4) + 0 AS mean_score, round(avg(ret), 4) + 0 AS mean_ret FROM k GROUP BY 1, 2""")
def q_conditioned_quantiles(spark, sf_dir):
    p = S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("regime"), F.col("o_totalprice").alias("score"))
    lab = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("ret"))
    df = X.conditioned(p, lab, ["o_orderkey"], "score", "ret", "regime", 8, ["o_orderkey"])
    return df.select("regime", "bucket", "n", r("mean_score", 4).alias("mean_score"), r("mean_ret", 4).alias("mean_ret"))


_SUITE = {1: "PASS", 2: "PASS", 3: "PASS", 4: "PASS", 5: "PENDING", 6: "PASS", 7: "PASS", 8: "PASS", 9: "PASS", 10: "PENDING", 11: "PENDING", 12: "PASS", 13: "PASS", 14: "PASS"}


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {L.NAMES[i]!r}, {s!r})' for i, s in _SUITE.items())}) v(test_id, name, status)")
def q_leakage_suite(spark, sf_dir):
    from ..operators import ranges as R
    from .joins import funding

    b = shared.materialise(hours(spark, sf_dir))
    low, high = b.agg(F.min("open_time"), F.max("open_time")).first()
    cut = (low + high) // 2 // HOUR * HOUR
    key = ["symbol", "open_time"]
    levels = lambda d: d.withColumn("_step", W.efficiency_ratio("high", 6)[0]).select(*key, W.stochastic("close", "high", "low", 14).alias("k"))
    volume = lambda d: d.select(*key, W.rolling_zscore("quote_volume", 12).alias("z"))
    ranks = lambda d: W.percentile_rank(d, "close").select(*key, "rank")
    labels = spans(spark, sf_dir)
    roles = shared.materialise(V.purged_splits(labels, 6, 2, _EMBARGO))
    weights = R.sample_weight(R.concurrency(b.select("symbol", F.concat_ws(":", *key).alias("label_id"), F.col("open_time").alias("t0"), (F.col("open_time") + 8 * HOUR).alias("t1"), (F.col("close") / F.col("open") - 1).alias("ret_gross"))))
    scored = ticks(spark, sf_dir).select(F.col("agg_trade_id").alias("row_id"), "price", (F.col("price") > 50).cast("int").alias("y"))

    def chance():
        got = L.shuffled_auc(scored, "price", "y")
        return int(abs(got - 0.5) > 0.1), "area after the shuffle within 0.1 of one half"

    prefix = lambda f, columns: L.prefix_violations(f, b, "open_time", cut, key, columns)
    two = B.resample(b, 2 * HOUR, HOUR)
    seen = S.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("used"), F.date_sub(F.to_date("o_orderdate"), 3).cast("timestamp_ntz").alias("valid_from"))
    found = L.suite(spark, {
        1: chance, 2: lambda: prefix(levels, ["k"]), 3: lambda: L.perturbed_violations(volume, b, "open_time", cut, ["quote_volume"], key, ["z"]), 4: lambda: L.asof_probe(b, funding(spark, sf_dir), "close_time", "calc_time", ["symbol"]),
        6: lambda: L.crossing_labels(roles, labels), 7: lambda: L.bad_weights(weights), 8: lambda: prefix(ranks, ["rank"]), 9: lambda: L.early_closes(b, two, 2 * HOUR), 12: lambda: L.both_roles(roles), 13: lambda: L.later_than(seen, "valid_from", "used"),
        14: lambda: prefix(lambda d: W.ema(d, "close", 12).select(*key, "ema"), ["ema"]),
    })
    return found.select("test_id", "name", "status")
