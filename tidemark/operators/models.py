"""Fitted models: durations, volatility, meta labels, resampling.

Sequential fits are grouped kernels (a task a series or replicate); linear and tree
models are the distributed ones of pyspark.ml.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import correlation
from .ranking import positions
from .ranking import quantiles as exact_quantiles


def nelder_mead(f, x0: np.ndarray, steps: int = 400, tolerance: float = 1e-9) -> np.ndarray:
    """Downhill simplex."""
    n = len(x0)
    points = [x0.astype(float)] + [x0 + np.eye(n)[i] * (0.1 if x0[i] == 0 else 0.1 * abs(x0[i])) for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = centre + (centre - points[-1])
        fr = f(reflected)
        if fr < values[0]:
            further = centre + 2 * (centre - points[-1])
            fe = f(further)
            points[-1], values[-1] = (further, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            inner = centre + 0.5 * (points[-1] - centre)
            fi = f(inner)
            if fi < values[-1]:
                points[-1], values[-1] = inner, fi
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    return points[int(np.argmin(values))]


def _acd_psi(x: np.ndarray, omega: float, alpha: float, beta: float, first: float) -> np.ndarray:
    """Expected durations, each from those before; the first is given (the mean of the training prefix)."""
    psi = np.empty(len(x))
    psi[0] = first
    for i in range(1, len(x)):
        psi[i] = omega + alpha * x[i - 1] + beta * psi[i - 1]
    return psi


def acd(bars: DataFrame, time: str = "close_time", train_share: float = 0.5) -> DataFrame:
    """ACD(1, 1) with Weibull innovations on the durations between bars: the expected duration of each, given those before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        d = np.diff(pdf[time].to_numpy().astype(float)) / 60_000
        out = pdf[["symbol", time]].copy()
        out["expected_minutes"], out["alpha"], out["beta"], out["shape"] = np.nan, np.nan, np.nan, np.nan
        cut = int(len(d) * train_share)
        if cut < 30:
            return out
        x = np.maximum(d, 1e-3)

        def parts(p: np.ndarray) -> tuple[float, float, float, float]:
            a, b = (1 / (1 + math.exp(-v)) for v in p[:2])
            return x[:cut].mean() * max(1e-4, 1 - 0.98 * a - 0.98 * (1 - a) * b), 0.98 * a, 0.98 * (1 - a) * b, math.exp(min(3, max(-3, p[2])))

        def loss(p: np.ndarray) -> float:
            omega, alpha, beta, shape = parts(p)
            psi = np.maximum(_acd_psi(x[:cut], omega, alpha, beta, x[:cut].mean()), 1e-9)
            scale = psi / math.gamma(1 + 1 / shape)
            r = x[:cut] / scale
            return float(-(np.log(shape / scale) + (shape - 1) * np.log(r) - r**shape).sum())

        omega, alpha, beta, shape = parts(nelder_mead(loss, np.array([-2.0, 1.0, 0.0]), 150))
        out.loc[out.index[1:], "expected_minutes"] = _acd_psi(x, omega, alpha, beta, x[:cut].mean())
        out["alpha"], out["beta"], out["shape"] = alpha, beta, shape
        return out

    return bars.select("symbol", time).groupBy("symbol").applyInPandas(run, f"symbol string, {time} long, expected_minutes double, alpha double, beta double, shape double")


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Least squares of each group from its cross products: one aggregation, then a small system a group."""
    names = ["_one", *xs]
    base = df.withColumn("_one", F.lit(1.0)).where(F.col(y).isNotNull())
    for x in xs:
        base = base.where(F.col(x).isNotNull())
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs], *[F.sum(F.col(c) * F.col(y)).alias(f"v{i}") for i, c in enumerate(names)])
    types = dict(sums.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "n long", *(f"b{i} double" for i in range(len(names)))])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    m[i, j] = m[j, i] = r[f"m{i}_{j}"]
                v = np.array([r[f"v{i}"] for i in range(len(names))])
                rows.append((*(r[c] for c in by), r["n"], *np.linalg.lstsq(m, v, rcond=None)[0].tolist()))
            yield pd.DataFrame(rows, columns=[*by, "n", *(f"b{i}" for i in range(len(names)))])

    return sums.mapInPandas(solve, schema)


def egarch(bars: DataFrame, value: str, train_share: float = 0.5) -> DataFrame:
    """EGARCH(1, 1): the variance expected of each bar's return, given those before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", kind="stable")
        x = np.nan_to_num(pdf["_x"].astype(float).to_numpy())
        cut = int(len(x) * train_share)
        var = max(float(x[:cut].var()) if cut else 0.0, 1e-12)
        mean_abs = math.sqrt(2 / math.pi)

        def path(p: np.ndarray, n: int) -> np.ndarray:
            b = math.tanh(p[3])
            out = np.empty(n)
            h = math.log(var)
            for i in range(n):
                out[i] = h
                z = x[i] / math.exp(min(50, max(-50, h / 2)))
                z = min(20.0, max(-20.0, z))
                h = min(50, max(-50, p[0] + b * (h - math.log(var)) + math.log(var) + p[1] * (abs(z) - mean_abs) + p[2] * z))
            return out

        def loss(p: np.ndarray) -> float:
            h = path(p, cut)
            return float((h + x[:cut] ** 2 * np.exp(-h)).sum())

        p = nelder_mead(loss, np.array([0.0, 0.1, 0.0, 1.5]), 120) if cut >= 30 else np.zeros(4)
        return pd.DataFrame({"symbol": pdf["symbol"], "open_time": pdf["open_time"], "variance": np.exp(path(p, len(x)))})

    return bars.select("symbol", "open_time", F.col(value).alias("_x")).groupBy("symbol").applyInPandas(run, "symbol string, open_time long, variance double")


MEAN_ABS = math.sqrt(2 / math.pi)


def coupled_log_variance(x: np.ndarray, psi: np.ndarray, p: Sequence[float], psi_bar: float, seed: float) -> np.ndarray:
    """ln variance of each return given those before; time runs by expected duration.

    With tau = psi / psi_bar a bar that is expected to last long decays the memory by
    beta^tau and takes tau times the news. A missing return carries the variance on; a
    missing duration counts as an average one.
    """
    omega, alpha, beta, gamma = p
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return out
    h = out[known[0]] = seed
    for t in range(known[0], len(x) - 1):
        if not np.isnan(x[t]):
            z = x[t] / math.exp(min(h, 50.0) / 2)
            tau = psi[t] / psi_bar if np.isfinite(psi[t]) and psi[t] > 0 else 1.0
            h = omega + beta**tau * h + tau * (alpha * (abs(z) - MEAN_ABS) + gamma * z)
            if not math.isfinite(h):
                break
        out[t + 1] = h
    return out


def coupled_loss(x: np.ndarray, h: np.ndarray) -> float:
    """Negative log likelihood of normal returns; very large with fewer than fifty."""
    ok = np.isfinite(h) & ~np.isnan(x)
    if ok.sum() < 50:
        return 1e12
    var = np.exp(np.clip(h[ok], -50, 50))
    total = 0.5 * float((np.log(2 * np.pi) + np.log(var) + x[ok] ** 2 / var).sum())
    return total if math.isfinite(total) else 1e12


def egarch_coupled(bars: DataFrame, value: str, expected: str, train_share: float = 0.5, steps: int = 150) -> DataFrame:
    """EGARCH(1, 1) coupled to expected durations (see ``acd``): variance of each return given those before, and the parameters.

    Fitted on a prefix of each symbol; no variance where it is too short or does not vary.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", kind="stable")
        x, psi = pdf["_x"].astype(float).to_numpy(), pdf["_psi"].astype(float).to_numpy()
        cut = int(len(x) * train_share)
        train, psi_train = x[:cut], psi[:cut][np.isfinite(psi[:cut])]
        out = pdf[["symbol", "open_time"]].assign(variance=np.nan, omega=np.nan, alpha=np.nan, beta=np.nan, gamma=np.nan)
        known = train[~np.isnan(train)]
        if len(known) < 50 or known.var() <= 0 or not len(psi_train) or np.median(psi_train) <= 0:
            return out
        seed, psi_bar = math.log(known.var()), float(np.median(psi_train))

        def inside(v: np.ndarray) -> tuple[float, float, float, float]:
            bound = lambda u, most: most * math.tanh(u / most)
            return bound(v[0], 50.0), bound(v[1], 5.0), 0.999 / (1 + math.exp(-v[2])), bound(v[3], 5.0)

        best = inside(nelder_mead(lambda v: coupled_loss(train, coupled_log_variance(train, psi[:cut], inside(v), psi_bar, seed)), np.array([seed * 0.1, 0.1, 2.2, 0.0]), steps))
        out["variance"] = np.exp(np.clip(coupled_log_variance(x, psi, best, psi_bar, seed), -50, 50))
        out[["omega", "alpha", "beta", "gamma"]] = best
        return out

    own = bars.select("symbol", "open_time", F.col(value).alias("_x"), F.col(expected).alias("_psi"))
    return own.groupBy("symbol").applyInPandas(run, "symbol string, open_time long, variance double, omega double, alpha double, beta double, gamma double")


SERIES_MOST = 1_000_000


def block_bootstrap(values: DataFrame, value: str, replicates: int, seed: int, block: int | None = None) -> DataFrame:
    """(replicate, mean) by stationary blocks: geometric lengths around block, by default n^(1/3).

    values is one series of a bounded size (differences by day or path): it goes to each
    replicate's task. A longer one than SERIES_MOST is refused; aggregate it by day first.
    """
    spark = values.sparkSession
    n = values.count()
    if n > SERIES_MOST:
        raise ValueError(f"a series of {n} values is too long to send to each replicate (at most {SERIES_MOST}); aggregate it first")
    x = np.array([r[0] for r in values.select(value).toLocalIterator()], float)
    data = spark.sparkContext.broadcast(x)
    mean_block = block or max(1, round(len(x) ** (1 / 3)))

    def run(batches):
        x = data.value
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                start = rng.random(len(x)) < 1 / mean_block
                start[:1] = True
                at = np.flatnonzero(start)
                first = rng.integers(0, max(1, len(x)), len(at))
                idx = (np.repeat(first - at, np.diff(np.append(at, len(x)))) + np.arange(len(x))) % max(1, len(x))
                out.append((int(k), float(x[idx].mean()) if len(x) else None))
            yield pd.DataFrame(out, columns=["replicate", "mean"])

    return spark.range(replicates).mapInPandas(run, "replicate long, mean double")


def permutation_null(df: DataFrame, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, statistic): the correlation after y is shuffled, the shuffle being the order of a seeded hash of each row's key ``row_id``.

    A replicate's shuffled order is cut into equal ranges of the hash, numbered one by one
    after the counts of those before, so no task needs all rows of a replicate; the rows
    are exploded by replicate and paired by place (replicates times the table in all).
    """
    rows = positions(df.select(x, y, "row_id"), "row_id", name="_i")
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    left = rows.select(reps, "_i", x)
    shuffled = shuffle_places(rows.select(reps, y, "row_id"), ["replicate"], seed, "_i").select("replicate", "_i", y)
    return left.join(shuffled, ["replicate", "_i"]).groupBy("replicate").agg(correlation(x, y).alias("statistic"))


HASH_RANGES = 256


def shuffle_places(rows: DataFrame, by: Sequence[str], seed: int, name: str) -> DataFrame:
    """name: 0, 1, ... in the order of a seeded hash of row_id, in each group; a range of the hash is a task."""
    rows = rows.withColumn("_h", F.xxhash64("row_id", *by, F.lit(seed))).withColumn("_range", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(HASH_RANGES)))
    sizes = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy("_h", "row_id")
    return rows.withColumn("_at", F.row_number().over(inside) - 1).join(sizes, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_h", "_range", "_at", "_before")


def random_entries(df: DataFrame, value: str, size: int, seeds: int, base_seed: int = 0) -> DataFrame:
    """(seed, n, mean, sharpe_like) of samples without replacement: the rows of least seeded hash, by seed."""
    rows = df.select(F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"), "row_id", F.col(value).alias("_v"))
    chosen = shuffle_places(rows, ["seed"], base_seed, "_n").where(F.col("_n") < size)
    return chosen.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), (F.avg("_v") / F.nullif(F.stddev_samp("_v"), F.lit(0.0))).alias("ratio"))


def meta_logit(train: DataFrame, features: Sequence[str], label: str, weight: str, l2: float = 0.01):
    """Weighted logistic regression with an L2 penalty on standardised features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"), LogisticRegression(featuresCol="_features", labelCol=label, weightCol=weight, regParam=l2, elasticNetParam=0.0, maxIter=50, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_prediction")]).fit(train)


def boosted_side(train: DataFrame, features: Sequence[str], label: str, weight: str, trees: int = 10, seed: int = 7):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"), GBTClassifier(featuresCol="_features", labelCol=label, weightCol=weight, maxIter=trees, maxDepth=3, seed=seed, predictionCol="_prediction")]).fit(train)


def isotonic(train: DataFrame, score: str, label: str, weight: str) -> list[tuple[float, float]]:
    """Knots of the calibration curve."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=score, labelCol=label, weightCol=weight, predictionCol="_p").fit(train)
    return list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))


def interpolate(score, knots: list[tuple[float, float]]):
    """Linear between the knots, flat beyond: a column expression."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots[:-1], knots[1:], strict=True))):
        line = F.lit(y0) if x1 == x0 else F.lit(y0) + (score - x0) * ((y1 - y0) / (x1 - x0))
        out = F.when(score < x1, line).otherwise(out)
    return F.when(score <= knots[0][0], knots[0][1]).otherwise(out)


def probability_of(column: str = "_p"):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)[1]


def meta_threshold(scored: DataFrame, score: str, ret: str, quantiles: Sequence[float]) -> float:
    """The score quantile with the greatest summed return above it; of equal ones the highest."""
    cuts = exact_quantiles(scored, score, list(quantiles))
    sums = scored.agg(*[F.sum(F.when(F.col(score) >= c, F.col(ret)).otherwise(0.0)).alias(f"s{i}") for i, c in enumerate(cuts)]).first()
    return max(zip(sums, cuts, strict=True), key=lambda x: (round(x[0], 12), x[1]))[1]
