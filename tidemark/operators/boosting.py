"""Boosted stumps with monotone constraints, and a resumable search over their settings.

A round is one aggregation: gradients and curvatures by feature and quantile bin (a
number of rows that features and bins bound) go to the driver, which picks the best
split whose sides respect the constraint. The score is a column expression.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .validation import auc


@dataclass(frozen=True)
class Stump:
    feature: str
    cut: float
    left: float  # at or below the cut; a missing value goes left
    right: float


def raw_score(stumps: Sequence[Stump], base: float) -> Column:
    out = F.lit(base)
    for s in stumps:
        out = out + F.when(F.col(s.feature) > s.cut, F.lit(s.right)).otherwise(F.lit(s.left))
    return out


def probability(stumps: Sequence[Stump], base: float) -> Column:
    return 1 / (1 + F.exp(-raw_score(stumps, base)))


def _bin(feature: str, cuts: Sequence[float]) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda x: x < F.col(feature))) if cuts else F.lit(0)


def fit(df: DataFrame, features: Sequence[str], label: str, weight: str, signs: dict[str, int] | None = None, rounds: int = 20, bins: int = 32, rate: float = 0.3, l2: float = 1.0) -> tuple[list[Stump], float]:
    """signs: 1 for features that may only raise the score, -1 for those that may only lower it."""
    signs = signs or {}
    data = materialise(df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w")).where("_y is not null"))
    head = data.agg(F.sum(F.col("_w") * F.col("_y")).alias("p"), F.sum("_w").alias("n"), *[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in features]).first()
    if not head.n or head.p in (0, head.n):
        return [], 0.0
    base = math.log(head.p / (head.n - head.p))
    cuts = {f: sorted(set(head[f] or [])) for f in features}
    bin_of = {f: _bin(f, cuts[f]) for f in features}
    stumps: list[Stump] = []
    for _ in range(rounds):
        p = probability(stumps, base)
        g = data.select((F.col("_w") * (p - F.col("_y"))).alias("g"), (F.col("_w") * p * (1 - p)).alias("h"), *[F.coalesce(bin_of[f], F.lit(0)).alias(f) for f in features])
        sums = g.unpivot(["g", "h"], list(features), "feature", "bin").groupBy("feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        best: tuple[float, Stump] | None = None
        for f in features:
            rows = sorted((r.bin, r.g, r.h) for r in sums if r.feature == f)
            all_g, all_h, left_g, left_h = sum(r[1] for r in rows), sum(r[2] for r in rows), 0.0, 0.0
            for b, gg, hh in rows[:-1]:
                left_g, left_h = left_g + gg, left_h + hh
                left, right = -left_g / (left_h + l2), -(all_g - left_g) / (all_h - left_h + l2)
                if b >= len(cuts[f]) or signs.get(f, 0) * (right - left) < 0:
                    continue
                gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, Stump(f, float(cuts[f][b]), rate * left, rate * right)
        if best is None:
            break
        stumps.append(best[1])
    return stumps, base


def search(folds: Sequence[tuple[DataFrame, DataFrame]], features: Sequence[str], label: str, weight: str, grid: dict[str, Sequence], done: Sequence[dict] = ()) -> list[dict]:
    """Mean test AUC of each setting over (train, test) folds, best first; settings in ``done`` are not tried again."""
    known = {json.dumps(t["settings"], sort_keys=True): t for t in done}
    out = []
    for values in itertools.product(*grid.values()):
        settings = dict(zip(grid, values, strict=True))
        key = json.dumps(settings, sort_keys=True)
        if key not in known:
            scores = []
            for train, test in folds:
                stumps, base = fit(train, features, label, weight, **settings)
                scores.append(auc(test.withColumn("_s", probability(stumps, base)), "_s", label).first().roc_auc)
            known[key] = {"settings": settings, "auc": sum(x or 0.5 for x in scores) / len(scores)}
        out.append(known[key])
    return sorted(out, key=lambda t: -t["auc"])


def suggest(tried: Sequence[dict], space: dict[str, tuple[float, float]], seed: int, share: float = 0.25, candidates: int = 24, first: int = 8) -> dict[str, float]:
    """The next setting by a tree-structured Parzen estimator: among draws around the good trials, the one most likely good and least likely not.

    tried: rows with settings and auc; space: bounds of each parameter. The first few are
    uniform draws. Deterministic for a seed and the trials so far.
    """
    rng = np.random.default_rng([seed, len(tried)])
    names = list(space)
    low, high = (np.array([space[n][i] for n in names], float) for i in range(2))
    if len(tried) < first:
        return dict(zip(names, (low + rng.random(len(names)) * (high - low)).tolist(), strict=True))
    ranked = sorted(tried, key=lambda t: -t["auc"])
    cut = max(1, round(share * len(ranked)))
    at = [np.array([[t["settings"][n] for n in names] for t in part], float) for part in (ranked[:cut], ranked[cut:])]
    widths = [np.maximum((high - low) / (len(p) ** 0.2 * 4), 1e-12) for p in at]

    def density(x: np.ndarray, points: np.ndarray, width: np.ndarray) -> np.ndarray:
        z = (x[:, None] - points[None]) / width
        kernels = np.exp(-0.5 * z * z) / width
        return np.log(np.concatenate((kernels, np.broadcast_to(1 / (high - low), (len(x), 1, len(names)))), 1).mean(1)).sum(1)

    draws = at[0][rng.integers(0, len(at[0]), candidates)] + rng.normal(size=(candidates, len(names))) * widths[0]
    draws = np.clip(draws, low, high)
    return dict(zip(names, draws[np.argmax(density(draws, at[0], widths[0]) - density(draws, at[1], widths[1]))].tolist(), strict=True))


def parzen_search(score, space: dict[str, tuple[float, float]], trials: int, seed: int, done: Sequence[dict] = ()) -> list[dict]:
    """Trials (settings, auc), best first: goes on from those in ``done``. score(settings) is the mean test AUC."""
    tried = list(done)
    while len(tried) < trials:
        settings = suggest(tried, space, seed)
        tried.append({"settings": settings, "auc": score(settings)})
    return sorted(tried, key=lambda t: -t["auc"])


def over_seeds(tried: Sequence[dict], k: int, seeds: Sequence[int], score) -> list[dict]:
    """The best k settings scored again with each seed: mean and least AUC, best mean first."""
    out = []
    for t in list(tried)[:k]:
        scores = [score(t["settings"], s) for s in seeds]
        out.append({"settings": t["settings"], "mean": sum(scores) / len(scores), "least": min(scores)})
    return sorted(out, key=lambda t: -t["mean"])


def ablation(folds: Sequence[tuple[DataFrame, DataFrame]], arms: dict[str, Sequence[str]], label: str, score) -> list[dict]:
    """Mean test AUC of a model on each set of features, and what each arm loses against the first. score(train, test, features) gives test with ``_s``."""
    out, base = [], None
    for name, features in arms.items():
        found = [auc(score(train, test, list(features)), "_s", label).first().roc_auc or 0.5 for train, test in folds]
        mean = sum(found) / len(found)
        base = mean if base is None else base
        out.append({"arm": name, "auc": mean, "loss": base - mean})
    return out
