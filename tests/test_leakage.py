"""Each leakage check on clean data and on data that leak."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import leakage as L
from tidemark.operators import validation as V

H = 3_600_000


def rows(spark):
    return spark.createDataFrame([("a", i * H, float((i * 7) % 11), i * H + H - 1, 12.0, -1.0) for i in range(60)], "symbol string, open_time long, close double, close_time long, high double, low double")


def test_prefix_and_perturbation(spark):
    w = Window.partitionBy("symbol").orderBy("open_time")
    past = lambda d: d.select("symbol", "open_time", F.avg("close").over(w.rowsBetween(-5, 0)).alias("x"))
    future = lambda d: d.select("symbol", "open_time", F.avg("close").over(w.rowsBetween(-5, 1)).alias("x"))
    whole = lambda d: d.select("symbol", "open_time", (F.col("close") - F.avg("close").over(Window.partitionBy("symbol"))).alias("x"))
    key = ["symbol", "open_time"]
    assert [L.prefix_violations(f, rows(spark), "open_time", 30 * H, key, ["x"]) > 0 for f in (past, future, whole)] == [False, True, True]
    assert [L.perturbed_violations(f, rows(spark), "open_time", 30 * H, ["close"], key, ["x"]) > 0 for f in (past, future, whole)] == [False, True, True]


def test_splits_weights_and_bars(spark):
    spans = spark.createDataFrame([(str(i), i * H, (i + 4) * H) for i in range(60)], "label_id string, t0 long, t1 long")
    roles = V.purged_splits(spans, 6, 2, H)
    assert L.crossing_labels(roles, spans) == 0 and L.both_roles(roles) == 0
    careless = roles.withColumn("role", F.when(F.col("role") == "purged", "train").otherwise(F.col("role")))
    assert L.crossing_labels(careless, spans) > 0
    assert L.both_roles(roles.unionByName(roles.where("role = 'test'").limit(1).withColumn("role", F.lit("train")))) == 1
    weights = lambda *w: spark.createDataFrame([(x,) for x in w], "sample_weight double")
    assert [L.bad_weights(weights(*w)) for w in ((0.5, 1.5), (1.0, None), (1.0, float("nan")), (2.0, 2.0), (-1.0, 1.0))] == [0, 1, 1, 1, 1]
    from tidemark.operators.bars import resample

    b = rows(spark).withColumns({"open": F.col("close"), **{c: F.lit(1.0) for c in ("volume", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume")}})
    two = resample(b, 2 * H, H)
    assert L.early_closes(b, two, 2 * H) == 0 and L.early_closes(b, two.withColumn("close_time", F.col("close_time") - H), 2 * H) == 30
    assert L.early_closes(b, two.withColumn("high", F.col("high") + 1), 2 * H) == 30


def test_events_keys_and_scores(spark):
    b = rows(spark)
    events = spark.createDataFrame([("a", 5 * H), ("a", 10**12)], "symbol string, t long")
    assert L.asof_probe(b, events, "close_time", "t", ["symbol"]) == 0
    assert L.shared_keys(b, b.limit(3), ["symbol", "open_time"]) == 3 and L.shared_keys(b, b.limit(0), ["open_time"]) == 0
    used = spark.createDataFrame([(1, 2), (3, 2), (2, 2)], "known long, used long")
    assert L.later_than(used, "known", "used") == 1
    scored = spark.range(2000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("s"), (F.col("id") % 2).alias("y"), (F.col("id") > 999).cast("int").alias("z"))
    assert abs(L.shuffled_auc(scored, "s", "z") - 0.5) < 0.06
    scan = {r.feature: (r.elevated, r.hard_fail) for r in L.target_scan(scored.withColumn("c", F.lit(1.0)), ["s", "c"], "z").collect()}
    assert scan == {"s": (True, True), "c": (False, False)}


def test_the_suite_has_a_row_for_each_check(spark):
    got = L.suite(spark, {1: lambda: 0, 4: lambda: (3, "three")}).collect()
    assert [r.test_id for r in got] == list(range(1, 15))
    assert [(r.status, r.violations, r.detail) for r in got if r.test_id in (1, 2, 4)] == [("PASS", 0, ""), ("PENDING", None, "no input"), ("FAIL", 3, "three")]
