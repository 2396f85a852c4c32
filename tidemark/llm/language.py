"""Language ID by word-first backoff.

A known word counts with its log frequency in each language; an unseen word with its
longest known character n-grams: at each of its places four characters, else three,
two, one. A text's score is the sum over its words, and the returned score is the
share of the predicted language after a softmax over languages.

The counts come from at most ``max_rows`` labelled rows (those with the least hashed
doc_id); every language of these rows is learned. ``max_words`` words and ``max_grams``
n-grams of each length, the most frequent, bound the model: rarer words back off to their
n-grams, rarer n-grams to shorter ones.

A word is a run of letters (Unicode category L) in fit and prediction alike.

Cases: null text, or text without a letter, is ``und`` with score 0; ties go to the
first language in alphabetical order; rows without lang teach nothing; without any
labelled row everything is ``und``; of rows that share a doc_id one text teaches, and each
row is predicted; very long texts are summed in stretches; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ALPHANUMERIC = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
MAX_ROWS = 10_000
MAX_WORDS = 40_000
MAX_GRAMS = 40_000
ORDER = 4
BACKOFF = float(np.log(0.4))
#: Numbers of the rows of unseen words that are remembered at once; only memory depends on it.
CACHE = 400_000


def letters_of(text: str) -> list[str]:
    """Runs of letters. The quick pattern also takes numerals that are no digits, so they are looked for."""
    words = ALPHANUMERIC.findall(text)
    return words if not words or "".join(words).isalpha() else LETTERS.findall(text)


class Model:
    """Log frequencies by language: a row for each word, and one for each n-gram, less the price of its shortness."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], grams: list[dict[str, list[int]]]):
        self.langs = langs
        self.words, self.word_logs = list(words), self._logs(words)
        self.grams = [g for table in grams for g in table]
        logs = [self._logs(table) + (ORDER - n) * BACKOFF for n, table in enumerate(grams, 1)]
        self.gram_logs = np.concatenate(logs) if logs else np.zeros((0, len(langs)))

    def _logs(self, counts: dict[str, list[int]]) -> np.ndarray:
        table = np.array(list(counts.values()), float).reshape(len(counts), len(self.langs))
        return np.log((table + 0.5) / (table.sum(0) + 0.5 * len(counts) + 1.0))


class Scorer:
    """Rows of log frequencies by word: the known ones, then unseen ones as they come."""

    def __init__(self, model: Model):
        self.model, self.langs = model, model.langs
        self.gram = {g: i for i, g in enumerate(model.grams)}
        self.cache = max(1000, CACHE // max(1, len(self.langs)))
        self.forget()

    def forget(self) -> None:
        self.seen = {w: i for i, w in enumerate(self.model.words)}
        self.n = len(self.seen)
        self.table = np.zeros((self.n + 2 * self.cache, len(self.langs)))
        self.table[: self.n] = self.model.word_logs

    def learn(self, words: list[str]) -> None:
        """Rows of unseen words: the mean, over a word's places, of the longest known n-gram that begins there."""
        get, at, ends = self.gram.get, [], []
        for w in words:
            p = f"<{w}>"
            for i in range(len(p) - 1):
                a = get(p[i : i + 4])
                if a is None:
                    a = get(p[i : i + 3])
                    if a is None:
                        a = get(p[i : i + 2])
                        if a is None:
                            a = get(p[i])
                            if a is None:
                                continue
                at.append(a)
            ends.append(len(at))
        sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(self.model.gram_logs[at], axis=0)))
        ends = np.array([0, *ends])
        rows = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(1, np.diff(ends))[:, None]
        if self.n + len(words) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((len(words), len(self.langs)))))
        self.table[self.n : self.n + len(words)] = rows
        self.seen.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)

    def total(self, words: list[str]) -> np.ndarray:
        get = self.seen.get
        at = [get(w) for w in words]
        if None in at:
            self.learn(list({w: None for w, a in zip(words, at, strict=True) if a is None}))
            at = [self.seen[w] for w in words]
        return self.table[at].sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letters_of(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for a in range(0, len(words), 20_000):
            total += self.total(words[a : a + 20_000])
            if self.n > len(self.model.words) + self.cache:
                self.forget()
        total -= total.max()
        share = np.exp(total)
        share /= share.sum()
        best = int(np.argmax(share))
        return self.langs[best], float(share[best])


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """docs: doc_id, text, lang; rows that are held out are not learned from."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out()).select("doc_id", "lang")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(rows.distinct()), "doc_id").where(F.col("text").isNotNull())
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # of rows that repeat a doc_id one
    words = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    counts = C.materialise(words.groupBy("lang", "w").agg(F.count("*").alias("c")))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # at most max_rows of them
    place = {x: i for i, x in enumerate(langs)}

    def table(frame: DataFrame, key: str, most: int, least: int) -> dict[str, list[int]]:
        by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "c")))
        best = frame.groupBy(key).agg(F.sum("c").alias("n"), by_lang.alias("by_lang")).where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(most)
        out = {}
        for r in best.collect():
            out[r[0]] = row = [0] * len(langs)
            for lang, c in r.by_lang.items():
                row[place[lang]] = c
        return out

    if not langs:
        return Model([], {}, [])
    grams = []
    padded = F.concat(F.lit("<"), F.col("w"), F.lit(">"))
    for n in range(1, ORDER + 1):
        pieces = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))  # noqa: B023
        exploded = counts.where(F.length(padded) >= n).select("lang", "c", F.explode(pieces).alias("g"))
        grams.append(table(exploded.groupBy("lang", "g").agg(F.sum("c").alias("c")), "g", max_grams, 1 if n < 3 else 2))
    return Model(langs, table(counts, "w", max_words, 2), grams)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    found = predict(docs, fit(docs, **options))
    return found.select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score")
