"""Suffix-array dedup: a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first L bytes, by passes of eight bytes, the most
significant first. What is sorted is a sparse suffix array: of each run of windows that
share an anchor (see ``windows``) the suffix that starts at the anchor stands for all.

1. Suffixes whose anchor lies in one document are dropped: none of their windows repeats.
2. The others are dealt to buckets by their leading bytes, at cuts from a sample; a hot
   digit is parted by the next one. A bucket is a stretch of the suffix order.
3. In a bucket passes over the anchor's bytes group the suffixes; a group of one distinct
   string is settled. In the others the windows, which begin up to L - k bytes before the
   anchor, are ordered by passes through all L bytes, as long as a group has several.
   Groups that are equal after the last pass are exactly the repeated windows.

Cases: null text counts as empty; documents under L bytes have no window; rows with
the same doc_id are one document for the comparison (nothing of them is removed on
account of each other), each cut by its own text; a row without doc_id stays whole and
removes nothing; identical rows give identical results; very long texts are read in
stretches; an empty table gives none; further columns are ignored by the query and kept
by ``dedup_text``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import common as C
from . import windows as W


def byte_tokens(raw: np.ndarray, offsets: np.ndarray) -> W.Tokens:
    at = np.arange(len(raw) + 1, dtype=np.int64)
    return W.Tokens(raw.astype(np.uint64) + np.uint64(1), raw, at[:-1], at[1:], offsets)


def byte_stretches(length: int):
    """Stretches whose windows follow on one another."""

    def stretches(raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for a in range(0, max(1, len(raw) - length + 1), W.BLOCK):
            yield a, min(len(raw), a + W.BLOCK + length - 1), a

    return stretches


def radix_pass(group: np.ndarray, digit: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts groups by a digit: the members in their order, and the group of each."""
    order = np.lexsort((digit, group))
    g, digit = group[order], digit[order]
    return alive[order], np.cumsum(np.append(False, (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])))[: len(g)]


def radix_spans(length: int, k: int):
    """Windows of distinct strings with the least doc_id of their group, as runs of one doc_id."""

    def spans(strings: W.Strings, low: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(low)
        windows = strings.sizes - length + 1
        # the suffixes at the anchors, by the anchors' bytes
        alive, group = np.arange(n), np.zeros(n, np.int64)
        at = strings.starts + strings.anchor
        done = []
        for step in range(0, k, 8):
            alive, group = radix_pass(group, W.digit(strings.data, at[alive] + step, k - step), alive)
            several = np.bincount(group)[group] > 1
            done.append(alive[~several])
            alive, group = alive[several], group[several]
        alone = np.concatenate(done)
        out = [(alone, np.zeros(len(alone), np.int64), windows[alone], low[alone])]
        if len(alive):
            some, count = strings.take(alive), windows[alive]
            least = window_radix(some, count, length, low[alive], group)
            owner = np.repeat(alive, count)
            out.append(W.spans_with_last(owner, C.ranges(np.zeros(len(alive), np.int64), count), least))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(4))

    return spans


def window_radix(strings: W.Strings, count: np.ndarray, length: int, low: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Least doc_id of each window's group after passes through all its bytes."""
    data = np.concatenate((strings.data, np.zeros(8, np.uint8)))
    suffix = C.ranges(strings.starts, count)  # byte where each window starts
    doc = np.repeat(low, count)
    out = doc.copy()
    group, alive = np.repeat(group, count), np.arange(len(suffix))
    for step in [*range(0, length - 7, 8)] + ([max(0, length - 8)] if length % 8 or length < 8 else []):
        alive, group = radix_pass(group, W.digit(data, suffix[alive] + step, min(8, length)), alive)
        several = np.bincount(group)[group] > 1
        alive, group = alive[several], group[several]
        if not len(alive):
            return out
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    out[alive] = np.repeat(np.minimum.reduceat(doc[alive], first), np.diff(np.append(first, len(alive))))
    return out


def spec(length: int = 50, anchor: int = 0) -> W.Spec:
    k = anchor or max(1, length * 2 // 5)
    return W.Spec(length, k, byte_tokens, byte_stretches(length), radix_spans(length, k), bytes_per_anchor=(length - k + 2) / 2, leading=min(k, 16))


def _kept(text: bytes, spans: np.ndarray | None) -> bytes:
    if spans is None:
        return text
    keep, at = [], 0
    for a, b in spans.tolist():
        keep.append(text[at:a])
        at = b
    return b"".join([*keep, text[at:]])


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document of (doc_id, text)."""

    def finish(doc_id: int, text: bytes | None, spans: np.ndarray | None) -> tuple:
        text = text or b""
        kept = _kept(text, spans)
        return doc_id, len(text), len(text) - len(kept), 0 if spans is None else len(spans), hashlib.sha256(kept).hexdigest()

    return W.remove_repeats(docs.select("doc_id", "text"), spec(length), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_text(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents, all columns and rows, without bytes that earlier ones hold.

    A character of which only a part was removed goes as a whole; null stays null.
    """
    return W.rewrite(docs, spec(length), lambda text, spans: _kept(text, spans).decode("utf-8", "ignore"))
