"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in its features; preference pairs (a row labelled 1 over
one labelled 0) are fitted by the logistic loss of feature differences. The raw score's
threshold is a quantile of the training scores, and the score that is returned is the
logistic function moved so that this quantile lies at 0.3.

Features: log shares of character classes and ASCII signs, word statistics, and the
presence of words that the labelled rows tell apart (at most ``max_words``).

Every labelled row that is not held out counts in all that is learned: the words, the
means and deviations, the loss (each row labelled 1 with each labelled 0) and the
threshold. The rows' features are packed into blocks that the tasks go over once for the
loss of new weights and once for its gradient; up to LOCAL_BYTES of blocks the driver
goes over them itself. See ``pair_sums`` for how the pairs are summed.

Cases: null text counts as empty; empty and very short texts get a score like others;
a doc_id with several labels counts once for each, with one of its texts; null labels are left out; without
labels of both kinds every document scores 0.5; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running
from . import common as C

LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
THRESHOLD = 0.3
MAX_WORDS = 600
MIN_ROWS_OF_WORD = 4
#: Bits by which documents without a label are left out before their texts move; further ones go in the join.
SIEVE_BITS = 1 << 24
BLOCK_ROWS = 2_000
LOCAL_BYTES = 8 << 20
DECAY = 2e-4
#: Distance of the scores between which the sums over pairs are interpolated.
STEP = 1 / 64


def dense(text: str, raw: bytes, words: list[str]) -> list[float]:
    """Log shares and statistics that do not depend on the language."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    n = max(1, len(raw))
    share = lambda x: float(np.log1p(100.0 * x / n))
    out = [share(count[c]) for c in SIGNS]
    out += [share(count[48:58].sum()), share(count[65:91].sum()), share(count[97:123].sum()), share(count[128:].sum()), share(count[10]), share(count[32])]
    tokens = len(words)
    kinds = len(set(words))
    most = max(Counter(words).values()) if words else 0
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out += [np.log1p(tokens), kinds / max(1, tokens) if tokens > 20 else 1.0, most / tokens if tokens > 20 else 0.0, np.log1p(100.0 * repeated / max(1, tokens))]
    lines = text.split("\n")
    out += [np.log1p(len(lines)), len(set(lines)) / len(lines), sum(map(len, words)) / max(1, tokens)]
    return out


N_DENSE = len(dense("", b"", []))


def features(text: str | None, index: dict[str, int]) -> tuple[list[float], list[int]]:
    text = text or ""
    words = LETTERS.findall(text.lower())
    return dense(text, text.encode(), words), sorted({index[w] for w in words if w in index})


@dataclass
class Model:
    words: list[str]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, text: str | None, index: dict[str, int]) -> float:
        x, present = features(text, index)
        z = np.clip((np.array(x) - self.centre) / self.scale, -6, 6)
        return float(z @ self.weights[:N_DENSE]) + float(sum(self.weights[N_DENSE + i] for i in present))

    def score(self, raw: float) -> float:
        z = np.log(THRESHOLD / (1 - THRESHOLD)) + self.slope * (raw - self.threshold)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Text and label of every labelled row that is not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out())
    known = known.select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    at = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS))
    bits = known.withColumn("_at", at).groupBy(F.expr("_at div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 as int)))").alias("_bits"))
    some = docs.select("doc_id", "text").withColumn("_at", at).withColumn("_word", F.expr("_at div 64"))
    some = some.join(F.broadcast(bits), "_word").where("(shiftright(_bits, cast(_at % 64 as int)) & 1) = 1")
    found = some.select("doc_id", "text").join(known, "doc_id")
    return found.groupBy("doc_id", "y").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))  # of rows that repeat a doc_id one


def telling_words(rows: DataFrame, max_words: int) -> list[str]:
    """The words whose presence the labels tell apart most, by the chi-square of a 2 x 2 table."""
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    words = rows.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where("w <> ''")
    counts = words.groupBy("w").agg(F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("b"))
    gap = F.col("a") / max(1, n0) - F.col("b") / max(1, n1)
    mean = (F.col("a") + F.col("b")) / max(1, n0 + n1)
    best = counts.where(F.col("a") + F.col("b") >= MIN_ROWS_OF_WORD).select("w", (gap * gap / mean).alias("s"))
    return sorted(r.w for r in best.orderBy(F.desc("s"), "w").limit(max_words).collect())


class Block(NamedTuple):
    """Labels, dense features and present words of some rows; of is the row of each word."""

    y: np.ndarray
    x: np.ndarray
    of: np.ndarray
    words: np.ndarray

    def scores(self, w: np.ndarray) -> np.ndarray:
        k = self.x.shape[1]
        return self.x @ w[:k] + np.bincount(self.of, w[k + self.words], len(self.y))

    def sums(self, by: np.ndarray, d: int, power: int = 1) -> np.ndarray:
        """The sum of the rows' features, each to a power and times by."""
        k = self.x.shape[1]
        return np.concatenate((by @ self.x**power, np.bincount(self.words, by[self.of], d - k)))


#: fold(f, merge): what f makes of each block, put together by merge; None without blocks.
Fold = Callable[[Callable, Callable], object]


def packed(rows: DataFrame, index: dict[str, int]) -> DataFrame:
    """A row for each BLOCK_ROWS rows at most, their features on end."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                found = [features(t, index) for t in some.column("text").to_pylist()]
                y = some.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
                x = np.array([f[0] for f in found], float)
                n = np.array([len(f[1]) for f in found], np.int32)
                words = np.array([w for f in found for w in f[1]], np.int32)
                yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (("y", y), ("x", x), ("n", n), ("words", words))})

    return rows.select("y", "text").mapInArrow(turn, "y binary, x binary, n binary, words binary")


def unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    for row in batch.to_pylist():
        y, n, words = (np.frombuffer(row[k], np.int32) for k in ("y", "n", "words"))
        yield Block(y, np.frombuffer(row["x"], float).reshape(len(y), N_DENSE), np.repeat(np.arange(len(y)), n), words)


def fold_of(blocks: DataFrame, change: Callable[[Block], Block] = lambda b: b) -> Fold:
    """A fold by the tasks: what a task found is one value."""

    def fold(f: Callable, merge: Callable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for block in unpacked(batch):
                    found = f(change(block))
                    out = found if out is None else merge(out, found)
            if out is not None:
                yield pa.RecordBatch.from_pydict({"found": pa.array([pickle.dumps(out)], pa.binary())})

        found = blocks.mapInArrow(run, "found binary").toArrow().column("found")
        return reduce(merge, (pickle.loads(v.as_py()) for v in found)) if len(found) else None

    return fold


def fold_here(blocks: list[Block]) -> Fold:
    return lambda f, merge: reduce(merge, map(f, blocks)) if blocks else None


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_words: int = MAX_WORDS, local_bytes: int = LOCAL_BYTES) -> Model:
    rows = C.materialise(training_rows(docs, labels, label))
    words = telling_words(rows, max_words)
    blocks = C.materialise(packed(rows, {w: i for i, w in enumerate(words)}))
    size = blocks.agg(F.sum(sum(F.octet_length(c) for c in blocks.columns))).first()[0] or 0
    here = list(unpacked(blocks.toArrow())) if size <= local_bytes else None
    fold = fold_of(blocks) if here is None else fold_here(here)
    d = N_DENSE + len(words)
    n, total = fold(lambda b: (len(b.y), b.x.sum(0)), lambda p, q: (p[0] + q[0], p[1] + q[1])) or (0, np.zeros(N_DENSE))
    centre = total / max(1, n)
    scale = np.maximum(np.sqrt(fold(lambda b: ((b.x - centre) ** 2).sum(0), np.add) / n), 0.05) if n else np.ones(N_DENSE)
    change = lambda b: b._replace(x=np.clip((b.x - centre) / scale, -6, 6))
    fold = fold_of(blocks, change) if here is None else fold_here([change(b) for b in here])
    w = fit_blocks(fold, d)
    if w is None:
        return Model(words, centre, scale, np.zeros(d), float(np.log(THRESHOLD / (1 - THRESHOLD))), 1.0)
    threshold, spread = place(blocks, change, w) if here is None else place_here([(change(b).scores(w), b.y) for b in here])
    return Model(words, centre, scale, w, threshold, float(2.0 / (spread or 1.0)))


def pair_sums(low: int, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """From the scores' counts of both classes: the mean loss of all pairs, and its derivative by a score of either class, at each step.

    A score lies between two steps and counts for both in linear shares, so a row labelled
    0 meets every row labelled 1 in one convolution. Of a pair's loss that moves at most
    STEP**2 / 16, or 0.00002 (an eighth of the squared step times the curvature, a quarter,
    for each of both scores).
    """
    bad, good = counts
    k = counts.shape[1]
    gap = np.arange(1 - k, k) * STEP
    pull = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
    n = 1 << (3 * k).bit_length()
    meet = lambda h, kernel: np.fft.irfft(np.fft.rfft(h, n) * np.fft.rfft(kernel, n), n)[k - 1 : 2 * k - 1]
    pairs = bad.sum() * good.sum()
    return float(good @ meet(bad, np.logaddexp(0, -gap)) / pairs), meet(good, pull[::-1]) / pairs, -meet(bad, pull) / pairs


def steps_of(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.floor(scores / STEP)
    return at.astype(np.int64), scores / STEP - at


def score_counts(block: Block, w: np.ndarray) -> tuple[int, np.ndarray]:
    """The first step and, for both classes, the rows at each step from there."""
    at, share = steps_of(block.scores(w))
    low, k = int(at.min()), int(at.max() - at.min()) + 2
    rows = [np.flatnonzero(block.y == c) for c in (0, 1)]
    return low, np.array([np.bincount(at[r] - low, 1 - share[r], k) + np.bincount(at[r] - low + 1, share[r], k) for r in rows])


def add_counts(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    low, high = min(a[0], b[0]), max(x[0] + x[1].shape[1] for x in (a, b))
    out = np.zeros((2, high - low))
    for at, counts in (a, b):
        out[:, at - low : at - low + counts.shape[1]] += counts
    return low, out


def gradient_of(block: Block, w: np.ndarray, low: int, slopes: np.ndarray) -> np.ndarray:
    at, share = steps_of(block.scores(w))
    at = at - low
    by = np.zeros(len(block.y))
    for c in (0, 1):
        r = np.flatnonzero(block.y == c)
        by[r] = slopes[c, at[r]] * (1 - share[r]) + slopes[c, at[r] + 1] * share[r]
    return block.sums(by, len(w))


def fit_blocks(fold: Fold, d: int, decay: float = DECAY, most: int = 200, memory: int = 12, enough: float = 1e-6) -> np.ndarray | None:
    """The weights of the least mean logistic loss over all pairs, by L-BFGS; None without rows of both classes.

    It ends when the next step promises less than enough. The loss takes one pass over
    the blocks, the gradient where a step is taken another.
    """
    moments = lambda b: np.array([np.concatenate(([(b.y == c).sum()], b.sums((b.y == c) * 1.0, d), b.sums((b.y == c) * 1.0, d, 2))) for c in (0, 1)])
    found = fold(moments, np.add)
    if found is None or not found[:, 0].all():
        return None
    mean, square = (found[:, 1:] / found[:, :1]).reshape(2, 2, d).transpose(1, 0, 2)
    start = 1 / ((square.sum(0) - 2 * mean.prod(0)) / 4 + decay)  # of the curvature at 0, each weight alone

    def loss(w: np.ndarray):
        low, counts = fold(lambda b: score_counts(b, w), add_counts)
        value, *slopes = pair_sums(low, counts)
        return value + decay / 2 * w @ w, (low, np.array(slopes))

    def gradient(w: np.ndarray, low: int, slopes: np.ndarray) -> np.ndarray:
        return fold(lambda b: gradient_of(b, w, low, slopes), np.add) + decay * w

    w, past = np.zeros(d), []
    value, at = loss(w)
    slope = gradient(w, *at)
    for _ in range(most):
        way, shares = -slope, []
        for s, g in reversed(past):
            shares.append(s @ way / (s @ g))
            way = way - shares[-1] * g
        way = start * way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ (start * past[-1][1])) if past else 1.0)
        for (s, g), share in zip(past, reversed(shares), strict=True):
            way = way + s * (share - g @ way / (s @ g))
        promise = -float(slope @ way)
        if promise / 2 < enough:
            break
        length = 1.0
        while length > 1e-6:
            new, at = loss(w + length * way)
            if new <= value - 1e-4 * length * promise:
                break
            length /= 2
        else:
            break
        after = gradient(w + length * way, *at)
        if (after - slope) @ way > 0:
            past = [*past, (length * way, after - slope)][-memory:]
        w, value, slope = w + length * way, new, after
    return w


def fit_pairs(x: np.ndarray, good: np.ndarray, bad: np.ndarray, seed: int = 0, decay: float = DECAY) -> np.ndarray:
    """fit_blocks over rows in memory; nothing is drawn, whatever the seed."""
    y = np.full(len(x), -1, np.int32)
    y[good], y[bad] = 1, 0
    none = np.empty(0, np.int32)
    w = fit_blocks(fold_here([Block(y, np.asarray(x, float), none, none)]), x.shape[1], decay)
    return np.zeros(x.shape[1]) if w is None else w


def quantile_threshold(raw: np.ndarray, y: np.ndarray) -> float:
    """The score quantile, between two training scores, with the best balanced accuracy."""
    s, at = np.unique(raw, return_inverse=True)
    below = [np.concatenate(([0], np.cumsum(np.bincount(at[y == c], minlength=len(s))))) / max(1, (y == c).sum()) for c in (0, 1)]
    cut = int(np.argmax(below[0] - below[1]))
    return float(s[0] - 1 if cut == 0 else s[-1] + 1 if cut == len(s) else (s[cut - 1] + s[cut]) / 2)


def place_here(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """The threshold, and the median distance of the training scores from it."""
    raw, y = (np.concatenate(v) for v in zip(*found, strict=True))
    threshold = quantile_threshold(raw, y)
    return threshold, float(np.median(np.abs(raw - threshold)))


def place(blocks: DataFrame, change: Callable[[Block], Block], w: np.ndarray) -> tuple[float, float]:
    """As place_here, over a table: running counts in ranges of the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in unpacked(batch):
                yield pa.RecordBatch.from_pydict({"y": pa.array(b.y, pa.int32()), "raw": pa.array(change(b).scores(w), pa.float64())})

    rows = C.materialise(blocks.mapInArrow(run, "y int, raw double"))
    of = lambda c: F.sum(F.when(F.col("y") == c, 1).otherwise(0))
    counts = rows.groupBy("raw").agg(of(0).alias("n0"), of(1).alias("n1"))
    low, high, n0, n1 = rows.agg(F.min("raw"), F.max("raw"), of(0), of(1)).first()
    below = running(counts, {"b0": F.col("n0"), "b1": F.col("n1")}, "raw").select("raw", (F.col("b0") / max(1, n0) - F.col("b1") / max(1, n1)).alias("gain"))
    best = below.orderBy(F.desc("gain"), "raw").first()
    if best.gain <= 0:
        threshold = low - 1
    elif best.raw == high:
        threshold = high + 1
    else:
        threshold = (best.raw + rows.where(F.col("raw") > best.raw).agg(F.min("raw")).first()[0]) / 2
    gaps = rows.groupBy(F.abs(F.col("raw") - threshold).alias("gap")).agg(F.count(F.lit(1)).alias("n"))  # of copies one row
    upto, half = running(gaps, {"k": F.col("n")}, "gap"), (rows.count() - 1) / 2
    middle = upto.agg(*[F.min(F.when(F.col("k") > int(p), F.col("gap"))) for p in (np.floor(half), np.ceil(half))]).first()
    return float(threshold), sum(middle) / 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; the model's size is bounded by max_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(model.words)}
        for batch in batches:
            scores = [model.score(model.raw(t.as_py(), index)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> DataFrame:
    scored = score(docs, fit(docs, labels, label, **options))
    return scored.select("doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> DataFrame:
    """The rows, with all columns, whose score reaches the threshold; one pass, without a join."""
    model = fit(docs, labels, label, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(model.words)}
        for batch in batches:
            good = [model.score(model.raw(t.as_py(), index)) >= THRESHOLD for t in batch.column("text")]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
