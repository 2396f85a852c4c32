"""Fourteen checks that nothing of the future reaches a model, on the data themselves.

Each check is one row: test_id, name, status (PASS, FAIL, or PENDING where its input is not
given), violations (rows that break it) and detail. A check aggregates where the data
lie; one row a check comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof
from .models import shuffle_places
from .validation import auc

NAMES = {
    1: "shuffled target", 2: "future high and low", 3: "future volume", 4: "future funding", 5: "future regime", 6: "labels that cross a test window", 7: "weights of overlapping labels", 8: "global normalisation",
    9: "look-ahead in resampling", 10: "predictions chained in fold", 11: "leaked calibration", 12: "feature selection outside the fold", 13: "anachronistic filters", 14: "batch and stream differ",
}
TOLERANCE = 1e-8


def differing(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], tolerance: float = TOLERANCE) -> int:
    """Rows of b that a lacks, or whose values are not those of a (nulls must agree, numbers up to a tolerance)."""
    kinds = dict(a.dtypes)
    right = b.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    both = right.join(a.select(*key, *columns, F.lit(True).alias("_here")), on, "left")
    far = F.col("_here").isNull()
    for c in columns:
        near = F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance if kinds[c] in ("double", "float") else F.col(c) == F.col(f"_{c}")
        far = far | ~F.coalesce(near, F.col(c).isNull() & F.col(f"_{c}").isNull())
    return both.where(far).count()


def prefix_violations(compute: Callable[[DataFrame], DataFrame], rows: DataFrame, time: str, cut: int, key: Sequence[str], columns: Sequence[str], tolerance: float = TOLERANCE) -> int:
    """Rows up to ``cut`` whose values change when what comes after is taken away: a causal operator has none."""
    whole, prefix = compute(rows).where(F.col(time) <= cut), compute(rows.where(F.col(time) <= cut))
    return differing(whole, prefix, key, columns, tolerance) + differing(prefix, whole, key, columns, tolerance)


def perturbed_violations(compute: Callable[[DataFrame], DataFrame], rows: DataFrame, time: str, cut: int, inputs: Sequence[str], key: Sequence[str], columns: Sequence[str], tolerance: float = TOLERANCE) -> int:
    """Rows up to ``cut`` whose values change when inputs after it are scaled."""
    other = rows.withColumns({c: F.when(F.col(time) > cut, F.col(c) * 1.5 + 1).otherwise(F.col(c)).cast(dict(rows.dtypes)[c]) for c in inputs})
    return differing(compute(rows).where(F.col(time) <= cut), compute(other).where(F.col(time) <= cut), key, columns, tolerance)


def shuffled_auc(scored: DataFrame, score: str, label: str, seed: int = 7) -> float | None:
    """Area under the curve after the labels are dealt anew (row_id tells the rows apart): near one half if the score knows nothing else."""
    places = shuffle_places(scored.select("row_id", label), [], seed, "_place").drop("row_id")
    mine = shuffle_places(scored.select("row_id", score), [], seed + 1, "_place").drop("row_id")
    return auc(mine.join(places, "_place"), score, label).first().roc_auc


def asof_probe(rows: DataFrame, events: DataFrame, on: str, event_time: str, by: Sequence[str] = ()) -> int:
    """Rows that take over an event later than themselves."""
    seen = asof(rows.select(*by, on), events.select(*by, F.col(event_time).alias("_event")), on, "_event", ["_event"], by)
    return seen.where(F.col("_event") > F.col(on)).count()


def crossing_labels(roles: DataFrame, spans: DataFrame, key: str = "label_id") -> int:
    """Training labels [t0, t1] of a split that reach into a group it tests. roles: split_id, key, grp, role; spans: key, t0, t1."""
    windows = roles.where("role = 'test'").join(spans, key).groupBy("split_id", "grp").agg(F.min("t0").alias("_low"), F.max("t0").alias("_high"))
    train = roles.where("role = 'train'").select("split_id", key).join(spans, key)
    met = train.join(F.broadcast(windows.withColumnRenamed("grp", "_grp")), "split_id")  # a row for each split and tested group
    return met.where((F.col("t1") >= F.col("_low")) & (F.col("t0") <= F.col("_high"))).count()


def bad_weights(labels: DataFrame, weight: str = "sample_weight", tolerance: float = 1e-6) -> int:
    """Weights that are null, not finite or negative; one more if their mean is not 1."""
    w = F.col(weight)
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w < 0)
    r = labels.agg(F.count_if(bad).alias("n"), F.avg(F.when(~bad, w)).alias("mean")).first()
    return r.n + int(r.mean is None or abs(r.mean - 1) > tolerance)


def early_closes(fine: DataFrame, coarse: DataFrame, step_ms: int, by: Sequence[str] = ("symbol",)) -> int:
    """Coarse bars that close before one of the fine bars they are made of, or hold a price these do not have."""
    begin = (F.floor(F.col("open_time") / step_ms) * step_ms).alias("open_time")
    parts = fine.groupBy(*by, begin).agg(F.max("close_time").alias("_close"), F.max("high").alias("_high"), F.min("low").alias("_low"))
    return coarse.join(parts, [*by, "open_time"]).where((F.col("close_time") < F.col("_close")) | (F.col("high") > F.col("_high")) | (F.col("low") < F.col("_low"))).count()


def shared_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> int:
    return a.select(*key).distinct().join(b.select(*key).distinct(), list(key)).count()


def later_than(rows: DataFrame, known_at: str, used_at: str) -> int:
    """Rows that use what was known only later (filters of a later day, say)."""
    return rows.where(F.col(known_at) > F.col(used_at)).count()


def both_roles(roles: DataFrame, key: str = "label_id") -> int:
    """Keys that a split both trains on and tests."""
    per = roles.where(F.col("role").isin("train", "test")).groupBy("split_id", key).agg(F.countDistinct("role").alias("n"))
    return per.where("n > 1").count()


def suite(spark, checks: dict[int, Callable[[], int | tuple[int, str]] | None]) -> DataFrame:
    """The fourteen rows. checks: by test_id what gives the number of violations (and a detail); those left out are PENDING."""
    rows = []
    for i, name in NAMES.items():
        check = checks.get(i)
        if check is None:
            rows.append((i, name, "PENDING", None, "no input"))
            continue
        found = check()
        n, detail = found if isinstance(found, tuple) else (found, "")
        rows.append((i, name, "FAIL" if n else "PASS", int(n), detail))
    return spark.createDataFrame(rows, "test_id int, name string, status string, violations long, detail string").coalesce(1)


def target_scan(df: DataFrame, features: Sequence[str], target: str, bonferroni: float = 3.0, hard: float = 0.3) -> DataFrame:
    """feature, n, ic, elevated (beyond bonferroni / sqrt(rows) * sqrt(features)) and hard_fail; no value where a side does not vary."""
    from .analysis import leakage

    n_rows = max(1, df.count())
    limit: Column = F.lit(bonferroni / n_rows**0.5 * len(features) ** 0.5)
    found = leakage(df, features, target, hard).withColumnRenamed("suspicious", "hard_fail")
    return found.select("feature", "n", "ic", F.coalesce(F.abs("ic") > limit, F.lit(False)).alias("elevated"), F.coalesce("hard_fail", F.lit(False)).alias("hard_fail"))
