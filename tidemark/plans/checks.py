"""Data quality, projections, set operations, sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import bars as B
from ..operators import quality as Q
from ..sources import tables as S
from .base import BARS, HEAD, HOUR, SYMBOLS, TICKS, clock_sql, hours, query, r, ticks


@query("SELECT * FROM (SELECT 'o_orderkey' AS column, count(*) - count(o_orderkey) AS nulls, count(*) AS n FROM orders UNION ALL SELECT 'status_f', count(*) - count(CASE WHEN o_orderstatus = 'F' THEN 1 END), count(*) FROM orders UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), count(*) FROM orders)")
def q_null_counts(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").withColumn("status_f", F.when(F.col("o_orderstatus") == "F", 1))
    return Q.null_counts(o, ["o_orderkey", "status_f", "o_totalprice"])


@query("WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_keys, CAST(sum(c) - count(*) AS BIGINT) AS surplus, count(CASE WHEN c > 1 THEN 1 END) AS repeated_keys FROM k")
def q_duplicate_keys(spark, sf_dir):
    return Q.duplicates(S.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 20")
def q_duplicate_examples(spark, sf_dir):
    return Q.duplicate_examples(S.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{HEAD} SELECT symbol, count(*) AS n, count(CASE WHEN low > open OR low > close OR high < open OR high < close OR low > high THEN 1 END) AS incoherent, count(CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 1 END) AS not_positive, count(CASE WHEN volume < 0 THEN 1 END) AS negative_volume, count(CASE WHEN taker_buy_volume > volume THEN 1 END) AS taker_over_volume, count(CASE WHEN close_time <> open_time + 3599999 THEN 1 END) AS bad_close_time, count(CASE WHEN open_time % 3600000 <> 0 THEN 1 END) AS off_grid FROM bars GROUP BY 1")
def q_bar_checks(spark, sf_dir):
    return Q.bar_checks(hours(spark, sf_dir), step_ms=HOUR)


@query(f"{HEAD}, p AS (SELECT symbol, open_time, close, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS pc FROM bars), g AS (SELECT *, CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS lr FROM p), s AS (SELECT symbol, stddev_samp(lr) AS sd FROM g GROUP BY 1) SELECT g.symbol, g.open_time, round(lr, 6) + 0 AS log_return FROM g JOIN s ON g.symbol = s.symbol WHERE abs(lr) > 3 * sd")
def q_outlier_returns(spark, sf_dir):
    return Q.outlier_returns(hours(spark, sf_dir), "close", "open_time", ["symbol"], 3.0).select("symbol", "open_time", r("log_return").alias("log_return"))


@query(f"WITH {TICKS}, f AS (SELECT symbol, transact_time AS t, 8 AS declared FROM ticks WHERE agg_trade_id % 40 = 0), g AS (SELECT *, (t - lag(t) OVER (PARTITION BY symbol ORDER BY t)) / 3600000.0 AS gap FROM f) SELECT symbol, round(median(gap), 5) + 0 AS median_hours, round(stddev_samp(gap), 5) + 0 AS std_hours, count(CASE WHEN round(gap) <> declared THEN 1 END) AS mismatches FROM g GROUP BY 1")
def q_funding_interval_check(spark, sf_dir):
    f = ticks(spark, sf_dir).where("agg_trade_id % 40 = 0").withColumn("declared", F.lit(8))
    df = Q.interval_check(f, "transact_time", "declared", ["symbol"])
    return df.select("symbol", r("median_hours", 5).alias("median_hours"), r("std_hours", 5).alias("std_hours"), "mismatches")


@query(f"WITH {TICKS}, c AS (SELECT symbol AS source, min(transact_time) AS first, max(transact_time) AS last FROM ticks GROUP BY 1) SELECT source, first, last, max(first) OVER () AS effective_start FROM c")
def q_coverage(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return Q.coverage({s: (t.where(F.col("symbol") == s), "transact_time") for s in SYMBOLS})


@query(f"""WITH {TICKS}, {BARS}, {clock_sql(86_400_000, 'native')}, d AS (SELECT symbol, open_time // 86400000 * 86400000 AS t, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(quote_volume) AS quote_volume FROM bars GROUP BY 1, 2)
SELECT c AS column, CASE c WHEN 'open' THEN o WHEN 'high' THEN h WHEN 'low' THEN l WHEN 'close' THEN z ELSE q END < 1e-6 AS agrees, n FROM (SELECT count(*) AS n, max(abs(d.open - e.open)) AS o, max(abs(d.high - e.high)) AS h, max(abs(d.low - e.low)) AS l, max(abs(d.close - e.close)) AS z, max(abs(d.quote_volume - e.quote_volume)) AS q FROM d JOIN native e ON d.symbol = e.symbol AND d.t = e.open_time), (VALUES ('open'), ('high'), ('low'), ('close'), ('quote_volume')) v(c)""")
def q_resample_parity(spark, sf_dir):
    coarse = B.resample(hours(spark, sf_dir), 86_400_000, HOUR, complete=False)
    df = Q.max_deviation(coarse, B.clock_bars(ticks(spark, sf_dir), 86_400_000), ["symbol", "open_time"], ["open", "high", "low", "close", "quote_volume"])
    return df.select("column", (F.col("deviation") < 1e-6).alias("agrees"), "n")


@query(f"{HEAD}, g AS (SELECT symbol, count(*) AS n, count(CASE WHEN high = low THEN 1 END) AS flat, count(CASE WHEN volume < 3 THEN 1 END) AS thin FROM bars GROUP BY 1) SELECT symbol, n, flat, thin, round(100 * (1 - (flat / CAST(n AS DOUBLE) + thin / CAST(n AS DOUBLE)) / 2), 6) + 0 AS score, CASE WHEN flat / CAST(n AS DOUBLE) <= 0.9 AND thin / CAST(n AS DOUBLE) <= 0.02 THEN 'PASS' ELSE 'FAIL' END AS gate FROM g")
def q_quality_gate(spark, sf_dir):
    counts = hours(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("high") == F.col("low")).alias("flat"), F.count_if(F.col("volume") < 3).alias("thin"))
    return Q.gate(counts, {"flat": 0.9, "thin": 0.02}).select("symbol", "n", "flat", "thin", r("score").alias("score"), "gate")


@query(f"{HEAD}, s AS (SELECT symbol, unnest(range(min(open_time), max(open_time) + 1, {HOUR})) AS open_time FROM bars GROUP BY 1), g AS (SELECT s.symbol, s.open_time FROM s ANTI JOIN bars b ON s.symbol = b.symbol AND s.open_time = b.open_time), m AS (SELECT 1704067200000 + i * 259200000 AS a, 1704067200000 + i * 259200000 + 21600000 AS b FROM range(10) t(i)) SELECT g.symbol, g.open_time, count(m.a) > 0 AS explained FROM g LEFT JOIN m ON g.open_time >= m.a AND g.open_time < m.b GROUP BY 1, 2")
def q_gap_classification(spark, sf_dir):
    windows = spark.range(10).select((F.lit(1704067200000) + F.col("id") * 259200000).alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 21600000)
    return Q.classify_gaps(Q.missing_from_grid(hours(spark, sf_dir), "open_time", HOUR, ["symbol"]), windows, "open_time")


@query("SELECT 'value' AS column, count(*) AS n, round(avg(value), 6) + 0 AS mean, round(stddev_samp(value), 6) + 0 AS sd, round(quantile_cont(value, 0.05), 6) + 0 AS p05, round(quantile_cont(value, 0.5), 6) + 0 AS p50, round(quantile_cont(value, 0.95), 6) + 0 AS p95, count(*) - count(value) AS missing FROM events UNION ALL SELECT 'user_id', count(*), round(avg(user_id), 6) + 0, round(stddev_samp(user_id), 6) + 0, round(quantile_cont(user_id, 0.05), 6) + 0, round(quantile_cont(user_id, 0.5), 6) + 0, round(quantile_cont(user_id, 0.95), 6) + 0, count(*) - count(user_id) FROM events")
def q_column_stats(spark, sf_dir):
    long = S.table(spark, sf_dir, "events").select("value", F.col("user_id").cast("double").alias("user_id")).unpivot([], ["value", "user_id"], "column", "v")
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("sd"), *[r(F.percentile("v", p)).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))], F.count_if(F.col("v").isNull()).alias("missing"))


@query("SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_totalprice <= 0 OR o_totalprice > 400000 THEN 1 END) AS out_of_range, round(avg(o_totalprice), 4) + 0 AS mean FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def q_membership_and_range_filter(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    bad = (F.col("o_totalprice") <= 0) | (F.col("o_totalprice") > 400000)
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("out_of_range"), r(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"WITH {TICKS} SELECT symbol, agg_trade_id, transact_time, price FROM ticks WHERE transact_time BETWEEN 1704672000000 AND 1704758399999 AND symbol = 'click'")
def q_range_scan(spark, sf_dir):
    day = (F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-09").cast("timestamp_ntz"))
    e = S.table(spark, sf_dir, "events").where(day & (F.col("event_type") == "click"))
    return e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("agg_trade_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("transact_time"), F.col("value").alias("price"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, CAST(NULL AS BIGINT) AS nation FROM customer UNION ALL SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS BIGINT) FROM supplier")
def q_union_diagonal(spark, sf_dir):
    a = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("long").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def q_set_operations(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    by = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return by("F").intersect(by("O")).exceptAll(by("P").distinct())


@query("WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END DESC, l_extendedprice DESC, l_quantity, l_partkey, l_suppkey, l_tax, l_discount) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM k WHERE n = 1")
def q_dedupe_priority(spark, sf_dir):
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy((F.col("l_returnflag") == "N").desc(), F.desc("l_extendedprice"), "l_quantity", "l_partkey", "l_suppkey", "l_tax", "l_discount")
    return S.table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(first)).where("n = 1").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")


@query("SELECT c_custkey, sha256(to_json({'id': c_custkey, 'nation': c_nationkey})) AS h FROM customer")
def q_config_hash(spark, sf_dir):
    return S.table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))), 256).alias("h"))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day, lower(event_type) AS kind, upper(event_type[1:3]) AS head, CAST(year(ts) AS INTEGER) AS y, CAST(quarter(ts) AS INTEGER) AS q, CAST(hour(ts) AS INTEGER) AS h FROM events")
def q_scalar_functions(spark, sf_dir):
    ts = F.col("ts")
    return S.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.lower("event_type").alias("kind"), F.upper(F.substring("event_type", 1, 3)).alias("head"), F.year(ts).alias("y"), F.quarter(ts).alias("q"), F.hour(ts).alias("h"))


@query(f"{HEAD}, m AS (SELECT symbol, open_time, close / 1000 AS cost, 2 + (open_time // 3600000) % 3 AS payoff FROM bars) SELECT symbol, open_time, round(0.5 + cost / (2 * payoff), 10) + 0 AS breakeven, round((0.0002 + 0.6 * 0.0002 + 0.4 * 0.0005) * 1e4, 6) + 0 AS round_trip, cost > 0.1 AS too_dear FROM m")
def q_cost_formulas(spark, sf_dir):
    m = hours(spark, sf_dir).withColumns({"cost": F.col("close") / 1000, "payoff": 2 + F.expr("(open_time div 3600000) % 3")})
    return m.select("symbol", "open_time", r(costs.breakeven_win_rate(F.col("cost"), F.col("payoff")), 10).alias("breakeven"), r(costs.round_trip_bps(0.0002, 0.0005, 0.6)).alias("round_trip"), (F.col("cost") > 0.1).alias("too_dear"))


@query("SELECT o_orderkey, round(CAST(floor(CAST(o_totalprice * 0.01 / 250 AS DECIMAL(28,8)) * 1000) / 1000 AS DOUBLE), 3) + 0 AS quantity, CASE WHEN o_totalprice < 1000 THEN 'TOO_SMALL' WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_totalprice > 300000 THEN 'TOO_LARGE' ELSE 'OK' END AS control FROM orders")
def q_sizing_and_controls(spark, sf_dir):
    price = F.col("o_totalprice")
    first = F.coalesce(F.when(price < 1000, "TOO_SMALL"), F.when(F.col("o_orderstatus") == "P", "PENDING"), F.when(price > 300000, "TOO_LARGE"), F.lit("OK"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", r(costs.floor_to_step(price * 0.01 / 250, "0.001"), 3).alias("quantity"), first.alias("control"))


@query(f"WITH {TICKS}, b AS (SELECT symbol, count(*) AS n, count(CASE WHEN price > 90 THEN 1 END) > 0 AS spike, max(price) > 1e9 AS absurd FROM ticks GROUP BY 1) SELECT symbol, n, spike OR absurd AS stressed, CASE WHEN spike THEN ['spike'] ELSE [] END AS triggers FROM b")
def q_stress_triggers(spark, sf_dir):
    from ..operators.regime import stress

    b = ticks(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") > 90).alias("k"), F.max("price").alias("top"))
    return stress(b, {"spike": F.col("k") > 0, "absurd": F.col("top") > 1e9}).select("symbol", "n", "stressed", "triggers")


@query(f"WITH {TICKS}, d AS (SELECT symbol, CAST(dayofweek(epoch_ms(transact_time)) AS INTEGER) AS weekday, count(*) AS n, round(avg(price), 6) + 0 AS mean FROM ticks GROUP BY 1, 2) SELECT symbol, weekday + 1 AS weekday, n, mean FROM d")
def q_weekday_counts(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("symbol", F.dayofweek(F.timestamp_millis("transact_time")).alias("weekday")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("price")).alias("mean"))


@query("SELECT CAST(sum(l_quantity) AS DOUBLE) AS quantity, l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0 AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 2, 3")
def q_pricing_summary(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("quantity"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) + 0 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def q_dimension_joins(spark, sf_dir):
    n, g = S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "region")
    per = S.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("b"))  # before the join: a row a nation
    return per.join(n, per.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey).select("n_name", "r_name", "customers", r("b", 2).alias("balance"))
