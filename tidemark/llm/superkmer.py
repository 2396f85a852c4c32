"""Substring dedup: super-k-mer partitioning of word windows.

Consecutive windows that share their minimiser (the least-hashed run of five of
their thirteen words) travel as one packed string, the words joined by one space,
to the minimiser's bucket; sorting the windows of a bucket by their hashes, with equal
hashes compared byte by byte, finds equal ones exactly (see ``windows``; minimisers that
lie in one document alone do not travel).

Cases: null text has no words; documents of fewer words than a window keep all;
any ASCII white space parts words and the kept words are joined by one space; rows
with the same doc_id are one document for the comparison, each cut by its own text; one
without doc_id stays whole and removes nothing; very long texts are read in stretches; an
empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import common as C
from . import windows as W


def word_tokens(raw: np.ndarray, offsets: np.ndarray) -> W.Tokens:
    starts, ends, word_offsets = C.words(raw, offsets)
    if not len(starts):
        none = np.empty(0, np.int64)
        return W.Tokens(np.empty(0, np.uint64), raw[:0], none, none, word_offsets)
    sizes = ends - starts
    packed = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    to = np.cumsum(sizes + 1) - sizes - 1
    packed[C.ranges(to, sizes)] = raw[C.ranges(starts, sizes)]
    return W.Tokens(C.word_hashes(raw, starts, ends), packed, to, to + sizes, word_offsets)


def word_stretches(length: int):
    """Stretches of whole words whose windows follow on one another."""

    def stretches(raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        starts, ends, _ = C.words(raw, np.array([0, len(raw)]))
        a = 0
        while a == 0 or a < len(starts) - length + 1:
            b = min(len(starts), max(a + 1, int(np.searchsorted(starts, starts[a] + W.BLOCK))) + length - 1) if len(starts) else 0
            yield int(starts[a]) if b else 0, int(ends[b - 1]) if b else 0, a
            a = max(a + 1, b - length + 1)

    return stretches


def sorted_spans(length: int, k: int):
    """Windows of distinct strings with the least doc_id of their class, as runs of one doc_id."""

    def spans(strings: W.Strings, low: np.ndarray) -> tuple[np.ndarray, ...]:
        blank = np.flatnonzero(strings.data == 32)
        starts, ends = np.sort(np.concatenate((strings.starts, blank + 1))), np.sort(np.concatenate((strings.ends, blank)))
        first = np.searchsorted(starts, strings.starts)
        windows = np.diff(np.append(first, len(starts))) - length + 1
        # strings that alone have their minimiser are settled
        at = first + strings.anchor
        _, class_ = W.distinct(strings.data, starts[at], ends[at + k - 1])
        several = np.bincount(class_)[class_] > 1
        alone, shared = np.flatnonzero(~several), np.flatnonzero(several)
        out = [(alone, np.zeros(len(alone), np.int64), windows[alone], low[alone])]
        if len(shared):
            count = windows[shared]
            at = C.ranges(first[shared], count)
            member, class_ = W.distinct(strings.data, starts[at], ends[at + length - 1])
            least = np.full(len(member), np.iinfo(np.int64).max)
            np.minimum.at(least, class_, np.repeat(low[shared], count))
            out.append(W.spans_with_last(np.repeat(shared, count), C.ranges(np.zeros(len(shared), np.int64), count), least[class_]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(4))

    return spans


def spec(length: int = 13, minimiser: int = 5) -> W.Spec:
    return W.Spec(length, minimiser, word_tokens, word_stretches(length), sorted_spans(length, minimiser), bytes_per_anchor=6 * (length - minimiser + 2) / 2)


def kept_words(text: bytes | None, spans: np.ndarray | None) -> tuple[list[bytes], int]:
    words = (text or b"").translate(_SPACES).split()
    if spans is None:
        return words, 0
    keep, at = [], 0
    for a, b in spans.tolist():
        keep += words[at:a]
        at = b
    keep += words[at:]
    return keep, len(words) - len(keep)


#: bytes.split() also parts at nothing else than these six.
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def dedup(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document of (doc_id, text)."""

    def finish(doc_id: int, text: bytes | None, spans: np.ndarray | None) -> tuple:
        keep, removed = kept_words(text, spans)
        return doc_id, len(keep) + removed, removed, hashlib.sha256(b" ".join(keep)).hexdigest()

    return W.remove_repeats(docs.select("doc_id", "text"), spec(length), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_text(docs: DataFrame, length: int = 13) -> DataFrame:
    """The documents, all columns and rows; where words went, the kept ones are joined by one space."""
    return W.rewrite(docs, spec(length), lambda text, spans: b" ".join(kept_words(text, spans)[0]).decode())
