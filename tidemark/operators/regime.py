"""Market states: hysteresis machine, change points, hidden states, stress triggers.

All are recurrences over a symbol's bars: a grouped kernel each, parallel over symbols.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cutoffs:
    """Enter above, leave below; a change is confirmed after so many bars and so much time."""

    trend_enter: float = 0.7
    trend_leave: float = 0.5
    vol_enter: float = 0.7
    vol_leave: float = 0.5
    confirm_bars: int = 2
    confirm_ms: int = 7_200_000


LABELS = {(False, False): "R1", (False, True): "R2", (True, False): "R3", (True, True): "R4"}
REGIMES = "symbol string, open_time long, regime_raw string, regime string, bars_in_regime long, tradeable boolean"


def step_machine(state: tuple, er: float | None, vol: float | None, stress: bool, t: int, c: Cutoffs) -> tuple:
    """(state, raw, regime). state: trend, high volatility, regime, candidate, its bars, its first time.

    R0 while a measure is missing; R5 under stress, at once; else the raw label must hold.
    """
    trend, high, regime, candidate, n, since = state
    if stress:
        return (trend, high, "R5", None, 0, t), "R5", "R5"
    if er is None or vol is None or er != er or vol != vol:
        return (trend, high, "R0", None, 0, t), "R0", "R0"
    trend = er >= (c.trend_leave if trend else c.trend_enter)
    high = vol >= (c.vol_leave if high else c.vol_enter)
    raw = LABELS[trend, high]
    if regime in ("R0", None):
        return (trend, high, raw, None, 0, t), raw, raw
    if raw == regime:
        return (trend, high, regime, None, 0, t), raw, regime
    if raw != candidate:
        candidate, n, since = raw, 0, t
    n += 1
    if n >= c.confirm_bars and t - since >= c.confirm_ms:
        return (trend, high, raw, None, 0, t), raw, raw
    return (trend, high, regime, candidate, n, since), raw, regime


START = (False, False, None, None, 0, 0)


def state_machine(bars: DataFrame, er: str, vol: str, stress: str, cutoffs: Cutoffs = Cutoffs()) -> DataFrame:
    """Regimes R0 to R5 of each bar from quantiles of trend and volatility and a stress flag."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", kind="stable")
        state, out, length, last = START, [], 0, None
        for t, e, v, s in zip(pdf["open_time"], pdf["_er"], pdf["_vol"], pdf["_stress"], strict=True):
            state, raw, regime = step_machine(state, e, v, bool(s), int(t), cutoffs)
            length, last = (length + 1 if regime == last else 1), regime
            out.append((pdf["symbol"].iat[0], t, raw, regime, length, regime not in ("R0", "R5")))
        return pd.DataFrame(out, columns=[x.split()[0] for x in REGIMES.split(", ")])

    own = bars.select("symbol", "open_time", F.col(er).alias("_er"), F.col(vol).alias("_vol"), F.coalesce(F.col(stress), F.lit(False)).alias("_stress"))
    return own.groupBy("symbol").applyInPandas(run, REGIMES)


def cutoff_sweep(bars: DataFrame, er: str, vol: str, stress: str, cells: list[tuple[float, float]]) -> DataFrame:
    """Share of each regime for every (trend, volatility) cutoff; cells are a small grid, a task for each symbol and cell."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cells])).alias("c")
    own = bars.select("symbol", "open_time", F.col(er).alias("_er"), F.col(vol).alias("_vol"), F.coalesce(F.col(stress), F.lit(False)).alias("_stress"), grid).select("*", F.col("c.a").alias("trend_cut"), F.col("c.b").alias("vol_cut")).drop("c")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", kind="stable")
        a, b = float(pdf["trend_cut"].iat[0]), float(pdf["vol_cut"].iat[0])
        c, state, counts = Cutoffs(a, a - 0.2, b, b - 0.2), START, {}
        for t, e, v, s in zip(pdf["open_time"], pdf["_er"], pdf["_vol"], pdf["_stress"], strict=True):
            state, _, regime = step_machine(state, e, v, bool(s), int(t), c)
            counts[regime] = counts.get(regime, 0) + 1
        return pd.DataFrame([(pdf["symbol"].iat[0], a, b, k, n, n / len(pdf)) for k, n in sorted(counts.items())], columns=["symbol", "trend_cut", "vol_cut", "regime", "n", "share"])

    return own.groupBy("symbol", "trend_cut", "vol_cut").applyInPandas(run, "symbol string, trend_cut double, vol_cut double, regime string, n long, share double")


def bar_gap(time: str, step_ms: int, by: tuple[str, ...] = ("symbol",)) -> Column:
    """Whether more than a step lies between this bar's time and the one before; null for the first."""
    return F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time)) > step_ms


#: Fixed values of the modified z-score, and the gaps it needs.
Z_FACTOR, Z_LIMIT, Z_LEAST = 0.6745, 3.5, 3


class RunningMedian:
    """Median of what has come so far: a search and an insertion for each value."""

    def __init__(self) -> None:
        self.x: list[float] = []

    def add(self, value: float) -> None:
        insort(self.x, value)

    def value(self) -> float:
        n = len(self.x)
        return (self.x[(n - 1) // 2] + self.x[n // 2]) / 2


def gap_triggers(times: Sequence[int], z_limit: float = Z_LIMIT, least: int = Z_LEAST) -> list[bool | None]:
    """For ascending times: null for the first, true where the gap before is not positive, else by the gaps before it."""
    gaps, deviations, total, out = RunningMedian(), RunningMedian(), 0.0, []
    for i, t in enumerate(times):
        gap = t - times[i - 1] if i else None
        if gap is None:
            out.append(None)
            continue
        if gap <= 0:
            out.append(True)
            continue
        if len(gaps.x) < least:
            out.append(None)
        else:
            middle, mad = gaps.value(), deviations.value()
            scale = mad if mad > 0 else total / len(deviations.x)
            out.append(bool(Z_FACTOR * (gap - middle) / scale > z_limit if scale > 0 else gap > middle))
        gaps.add(gap)
        deviation = abs(gap - gaps.value())
        deviations.add(deviation)
        total += deviation
    return out


def event_gap(bars: DataFrame, time: str, z_limit: float = Z_LIMIT, least: int = Z_LEAST) -> DataFrame:
    """triggered: whether the gap before a bar is out of line with the positive gaps before it, by a one-sided modified z.

    The scale is the median of past deviations, each from the median at its own time (their
    mean where that is 0; if that is 0 too, any longer gap triggers). Null for a symbol's
    first bar and while there are fewer than ``least`` gaps; a gap that is not positive always
    triggers. A symbol is a task, as in all recurrences.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        found = gap_triggers(pdf[time].tolist(), z_limit, least)
        return pd.DataFrame({"symbol": pdf["symbol"], time: pdf[time], "triggered": pd.Series(found, index=pdf.index, dtype="object")})

    return bars.select("symbol", time).groupBy("symbol").applyInPandas(run, f"symbol string, {time} long, triggered boolean")


def stress(df: DataFrame, triggers: dict[str, Column]) -> DataFrame:
    """triggers: the names that hold; stressed: any of them; null where none holds and one cannot be computed."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in triggers.items()]))
    unknown = F.lit(False)
    for c in triggers.values():
        unknown = unknown | c.isNull()
    return df.withColumn("triggers", names).withColumn("stressed", F.when(F.size("triggers") > 0, True).when(~unknown, False))


def _student_logpdf(x: float, mu: np.ndarray, kappa: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    scale2 = beta * (kappa + 1) / (alpha * kappa)
    nu = 2 * alpha
    gamma = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in nu])
    return gamma - 0.5 * np.log(nu * math.pi * scale2) - (nu + 1) / 2 * np.log1p((x - mu) ** 2 / (nu * scale2))


CHANGE = "symbol string, open_time long, p_change double, run_length long, segment long"


def change_points(bars: DataFrame, value: str, hazard: float = 1 / 100, prune: float = 1e-6, warmup: int = 50) -> DataFrame:
    """Bayesian online change points: run-length posterior under a normal with unknown mean and variance and a constant hazard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", kind="stable")
        xs = pdf["_x"].astype(float).to_numpy()
        head = xs[:warmup][~np.isnan(xs[:warmup])]
        mu0, var0 = (float(np.median(head)), float(np.var(head))) if len(head) else (0.0, 1.0)
        var0 = var0 if var0 > 0 else 1.0
        mu, kappa, alpha, beta = (np.array([v]) for v in (mu0, 1.0, 1.0, var0))
        logp, lengths, segment, out = np.zeros(1), np.zeros(1, int), -1, []
        for t, x in zip(pdf["open_time"], xs, strict=True):
            if x != x:
                out.append((pdf["symbol"].iat[0], t, None, None, max(segment, 0)))
                continue
            pred = _student_logpdf(x, mu, kappa, alpha, beta)
            grow, stop = logp + pred + math.log1p(-hazard), logp + pred + math.log(hazard)
            top = max(grow.max(), stop.max())
            start = top + math.log(np.exp(stop - top).sum())
            joint = np.append(start, grow)
            joint -= joint.max() + math.log(np.exp(joint - joint.max()).sum())
            new = (mu * kappa + x) / (kappa + 1), kappa + 1, alpha + 0.5, beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1))
            mu, kappa, alpha, beta = (np.append(v, n) for v, n in zip((mu0, 1.0, 1.0, var0), new, strict=True))
            lengths = np.append(0, lengths + 1)
            kept = joint > joint.max() + math.log(prune)
            logp, lengths, mu, kappa, alpha, beta = (a[kept] for a in (joint, lengths, mu, kappa, alpha, beta))
            best = int(lengths[np.argmax(logp)])
            segment += best <= 1
            out.append((pdf["symbol"].iat[0], t, float(math.exp(joint[0])), best, max(segment, 0)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")])

    return bars.select("symbol", "open_time", F.col(value).alias("_x")).groupBy("symbol").applyInPandas(run, CHANGE)


class GaussianHMM:
    """Diagonal Gaussian states; EM on a training prefix, forward filter only afterwards."""

    def __init__(self, n_states: int, iterations: int = 25, stickiness: float = 10.0, seed: int = 0):
        self.n, self.iterations, self.stickiness, self.seed = n_states, iterations, stickiness, seed

    def _log_emission(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.mean[None]
        return -0.5 * (d**2 / self.var[None] + np.log(2 * math.pi * self.var[None])).sum(2)

    def fit(self, x: np.ndarray) -> GaussianHMM:
        n = self.n
        order = np.argsort(x[:, -1], kind="stable")
        parts = np.array_split(order, n)
        self.mean = np.array([x[p].mean(0) for p in parts])
        self.var = np.array([x[p].var(0) + 1e-8 for p in parts])
        self.start = np.full(n, 1 / n)
        self.move = np.full((n, n), 0.1 / max(1, n - 1)) + np.eye(n) * (0.9 - 0.1 / max(1, n - 1))
        for _ in range(self.iterations):
            e = self._log_emission(x)
            p = np.exp(e - e.max(1, keepdims=True))
            a, c = np.zeros_like(p), np.zeros(len(x))
            for t in range(len(x)):
                a[t] = (self.start if t == 0 else a[t - 1] @ self.move) * p[t]
                c[t] = max(a[t].sum(), 1e-300)
                a[t] /= c[t]
            b = np.ones_like(p)
            for t in range(len(x) - 2, -1, -1):
                b[t] = self.move @ (p[t + 1] * b[t + 1]) / c[t + 1]
            g = a * b
            g /= g.sum(1, keepdims=True)
            xi = np.einsum("ti,tj->ij", a[:-1], p[1:] * b[1:] / c[1:, None]) * self.move
            xi += np.eye(n) * self.stickiness
            self.move = xi / xi.sum(1, keepdims=True)
            self.start = g[0]
            w = g.sum(0)[:, None]
            self.mean = g.T @ x / w
            self.var = (g.T @ x**2) / w - self.mean**2 + 1e-8
        return self

    def filter(self, x: np.ndarray) -> np.ndarray:
        e = self._log_emission(x)
        p = np.exp(e - e.max(1, keepdims=True))
        out = np.zeros_like(p)
        for t in range(len(x)):
            v = (self.start if t == 0 else out[t - 1] @ self.move) * p[t]
            out[t] = v / max(v.sum(), 1e-300)
        return out


HIDDEN = "symbol string, open_time long, state long, probability double, stress_state boolean, tradeable boolean"


def hidden_states(bars: DataFrame, columns: tuple[str, str], train_share: float = 0.5, n_states: int = 3) -> DataFrame:
    """Filtered states after a training prefix, numbered by (mean, variance) of the last column; -1 before. The most volatile one is stress."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", kind="stable")
        x = pdf[list(columns)].astype(float).to_numpy()
        good = ~np.isnan(x).any(1)
        cut = int(len(pdf) * train_share)
        train = np.flatnonzero(good[:cut])
        test = cut + np.flatnonzero(good[cut:])
        state, prob = np.full(len(pdf), -1), np.full(len(pdf), np.nan)
        if len(train) >= 10 * n_states and len(test):
            model = GaussianHMM(n_states).fit(x[train])
            rank = np.argsort(np.lexsort((model.var[:, -1], model.mean[:, -1])))
            p = model.filter(x[test])
            best = p.argmax(1)
            state[test], prob[test] = rank[best], p[np.arange(len(best)), best]
        stressed = state == n_states - 1
        return pd.DataFrame({"symbol": pdf["symbol"], "open_time": pdf["open_time"], "state": state, "probability": prob, "stress_state": stressed, "tradeable": (state >= 0) & ~stressed})

    return bars.select("symbol", "open_time", *columns).groupBy("symbol").applyInPandas(run, HIDDEN)


def simplex(n: int, step: float = 0.05) -> np.ndarray:
    """Probability vectors of n states on a grid."""
    k = round(1 / step)
    whole = [c for c in np.ndindex(*[k + 1] * (n - 1)) if sum(c) <= k]
    return np.array([[*c, k - sum(c)] for c in whole], float) / k


def jump_costs(vectors: np.ndarray, penalty: float) -> np.ndarray:
    """From each vector to each: the penalty times the squared half of their distance in absolute values (1 between two states)."""
    half = np.abs(vectors[:, None] - vectors[None]).sum(2) / 2
    return penalty * half**2


def jump_path(loss: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The vectors, one a row, whose losses and jumps together are least."""
    value, back = loss[0].copy(), np.zeros(loss.shape, np.int32)
    for t in range(1, len(loss)):
        reach = value[:, None] + costs
        back[t] = reach.argmin(0)
        value = reach.min(0) + loss[t]
    path = np.empty(len(loss), int)
    path[-1] = value.argmin()
    for t in range(len(loss) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def fit_jumps(train: np.ndarray, n_states: int, penalty: float, vectors: np.ndarray) -> np.ndarray:
    """Centres by turns: the best path for the centres, then means weighted by the path's probabilities."""
    centre = np.array([train[p].mean(0) for p in np.array_split(np.argsort(train[:, -1], kind="stable"), n_states)])
    costs = jump_costs(vectors, penalty)
    for _ in range(20):
        loss = ((train[:, None] - centre[None]) ** 2).sum(2) / 2 @ vectors.T
        weight = vectors[jump_path(loss, costs)]
        total = weight.sum(0)
        new = np.where(total[:, None] > 0, weight.T @ train / np.maximum(total, 1e-12)[:, None], centre)
        if np.allclose(new, centre):
            break
        centre = new
    return centre


def jump_states(bars: DataFrame, columns: tuple[str, ...], n_states: int = 2, penalty: float = 5.0, train_share: float = 0.5, cont: bool = True, online: bool = True) -> DataFrame:
    """Jump model: centres fitted on a prefix; a state for each bar, and its probability.

    Continuous: a bar has a vector of probabilities, from a grid, and small moves between
    vectors cost little; discrete (``cont=False``): a bar has one state. Online each bar is
    told from what came up to it, else from the best path through all. States are numbered
    by the mean of the first column.
    """
    vectors = simplex(n_states) if cont else np.eye(n_states)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time", kind="stable")
        x = np.nan_to_num(pdf[list(columns)].astype(float).to_numpy())
        cut = max(n_states, int(len(x) * train_share))
        z = (x - x[:cut].mean(0)) / np.maximum(x[:cut].std(0), 1e-12)
        centre = fit_jumps(z[:cut], n_states, penalty, vectors)
        centre = centre[np.argsort(centre[:, 0], kind="stable")]
        loss, costs = ((z[:, None] - centre[None]) ** 2).sum(2) / 2 @ vectors.T, jump_costs(vectors, penalty)
        if online:
            value, path = np.zeros(len(vectors)), []
            for row in loss:
                value = (value[:, None] + costs).min(0) + row
                value -= value.min()
                path.append(int(value.argmin()))
        else:
            path = jump_path(loss, costs)
        chosen = vectors[path]
        return pd.DataFrame({"symbol": pdf["symbol"], "open_time": pdf["open_time"], "state": chosen.argmax(1).astype(np.int64), "probability": chosen.max(1)})

    return bars.select("symbol", "open_time", *columns).groupBy("symbol").applyInPandas(run, "symbol string, open_time long, state long, probability double")
