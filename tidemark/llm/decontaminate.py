"""Benchmark decontamination by SimHash windows.

A document's windows have the size of a benchmark item, in words, and stand at every
word. A window and an item are compared by the SimHash of their five-word shingles
(128 bits); an index of 16 blocks of 8 bits finds every item within the Hamming radius:
fingerprints at most RADIUS bits apart have a block at most RADIUS // 16 bits apart.
What it finds is verified by the exact similarity of weighted shingles (the sum of the
least over the sum of the greatest multiplicities), at 0.75 or more.

Windows that share no shingle with an item have similarity 0 to it, so the items' shingle
hashes, with the items of each, come first and lose nothing: a window is compared with
those items of its size that have a shingle of its stretch, never with all. At similarity
0.75 two fingerprints differ in 22 bits on average (deviation 4.3), so a radius of 44
misses a window with a chance below one in a million; at higher similarities less. So wide
a radius leaves the blocks little to prune (nine in ten random fingerprints pass one): the
shingles keep the candidates few, and blocks and radius then drop those that only share
a phrase.

The items are the stated query set. Up to BLOCK_WORDS words they are one block that is
sent to all executors, in one pass over the documents. A larger set is read in blocks of
that size, one at a time on the driver: one pass with a bitmap of all items' shingles
(BITMAP_BYTES at most) keeps the documents that have any, and only those meet block after
block. The documents are never shuffled.

Cases: words are compared in lower case (A-Z only); null or empty texts match nothing;
a document shorter than an item is one window; items under five words match as a whole;
equal items each match; ties go to the first window; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .windows import block_bounds

SHINGLE = 5
SIMILARITY = 0.75
BITS, BLOCKS, RADIUS = 128, 16, 44
BLOCK_WORDS = 1 << 20
BITMAP_BYTES = 64 << 20


def lower(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    both = np.stack([h, C.mix(h ^ np.uint64(0x6A09E667F3BCC909))], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(h), 16), axis=1)
    return bits.astype(np.int32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """16 bytes for each row of 128 sums."""
    return np.packbits(sums > 0, axis=1)


class Index:
    """Fingerprints and shingles of one block of items."""

    def __init__(self, items: list[tuple[int, list[int], int]]):
        """items: item_id, shingle hashes, number of words."""
        self.items = items
        self.counts = [Counter(s) for _, s, _ in items]
        owner = np.repeat(np.arange(len(items)), [len(c) for c in self.counts])
        shingle = np.array([h for c in self.counts for h in c], np.uint64)
        order = np.argsort(shingle, kind="stable")
        self.known, first = np.unique(shingle[order], return_index=True)
        self.owners, self.first = owner[order], np.append(first, len(order))  # items of each known shingle
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known >> np.uint64(42)).astype(np.int64)] = True
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for i, (_, _, n) in enumerate(items):
            self.by_size[n].append(i)
        self.prints = np.concatenate([simhash(signs(np.array(s, np.uint64)).sum(0, keepdims=True)) for _, s, _ in items]) if items else np.zeros((0, 16), np.uint8)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places whose shingle belongs to an item."""
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == h[maybe]]

    def sharing(self, shingles: np.ndarray) -> dict[int, np.ndarray]:
        """By size, the items that have any of these known shingles."""
        at = np.searchsorted(self.known, np.unique(shingles))
        items = np.unique(self.owners[C.ranges(self.first[at], self.first[at + 1] - self.first[at])])
        sizes = np.array([self.items[i][2] for i in items.tolist()])
        return {int(n): items[sizes == n] for n in np.unique(sizes)}


_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def within_radius(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) places of fingerprints with a near block that are at most RADIUS bits apart."""
    near = np.zeros((len(windows), len(items)), bool)
    for b in range(BLOCKS):
        near |= _ONES[windows[:, None, b] ^ items[None, :, b]] <= RADIUS // BLOCKS
    w, i = np.nonzero(near)
    close = _ONES[windows[w] ^ items[i]].sum(1) <= RADIUS
    return w[close], i[close]


#: Windows that are hashed at once, and pairs of fingerprints that are compared at once.
WINDOWS = 1 << 13
PAIRS = 1 << 20


def similarity(a: Counter, b: Counter) -> float:
    least = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return least / (sum(a.values()) + sum(b.values()) - least)


def matches(h: np.ndarray, n_words: int, index: Index, threshold: float = SIMILARITY) -> list[tuple[int, float, int, int]]:
    """(item_id, similarity, first word, words) of the best window for each item that a document holds."""
    hits = index.hits(h)
    best: dict[int, tuple[float, int, int]] = {}
    if not len(hits):
        return []
    edges = np.flatnonzero(np.diff(hits) > 1) + 1
    for group in np.split(hits, edges):
        for size, mine in index.sharing(h[group]).items():
            wide = min(size, n_words) - SHINGLE + 1  # shingles of a window
            if size < SHINGLE or wide <= 0:
                continue
            # windows (by first word) that cover a hit of this stretch
            a, b = max(0, group[0] - wide + 1), min(len(h) - wide, group[-1])
            if b < a:
                continue
            for from_ in range(a, b + 1, WINDOWS):
                to = min(b + 1, from_ + WINDOWS)
                sums = np.cumsum(np.concatenate((np.zeros((1, BITS), np.int32), signs(h[from_ : to - 1 + wide]))), axis=0)
                prints = simhash(sums[wide:] - sums[:-wide])
                step = max(1, PAIRS // len(prints))
                for some in (mine[i : i + step] for i in range(0, len(mine), step)):
                    at, item = within_radius(prints, index.prints[some])
                    for w, i in zip((from_ + at).tolist(), some[item].tolist(), strict=True):
                        s = similarity(Counter(h[w : w + wide].tolist()), index.counts[i])
                        if s >= threshold and (i not in best or (-s, w) < (-best[i][0], best[i][1])):
                            best[i] = (s, int(w), min(size, n_words))
    return [(index.items[i][0], *found) for i, found in sorted(best.items())]


def short_matches(word_hashes: np.ndarray, index: Index) -> list[tuple[int, float, int, int]]:
    out = []
    for size, mine in index.by_size.items():
        if size < SHINGLE and len(word_hashes) >= size:
            g = C.grams(word_hashes, size)
            for i in mine:
                at = np.flatnonzero(g == np.uint64(index.items[i][1][0]))
                if len(at):
                    out.append((index.items[i][0], 1.0, int(at[0]), size))
    return out


def hashed(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = C.flat(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))
    raw = lower(raw)
    starts, ends, word_offsets = C.words(raw, off)
    return (C.word_hashes(raw, starts, ends) if len(starts) else np.empty(0, np.uint64)), word_offsets


def index_of(items: list[tuple[int, str | None]]) -> Index:
    h, off = hashed([t for _, t in items])
    out = []
    for (item_id, _), a, b in zip(items, off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b > a:
            out.append((item_id, C.grams(h[a:b], min(SHINGLE, b - a)).tolist(), b - a))
    return Index(out)


FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _search(items: list[tuple[int, str | None]], threshold: float):
    def each(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[int, list]]:
        texts = batch.column("text")
        size = np.cumsum(np.append(0, np.array([len(t) if t is not None else 0 for t in texts.to_pylist()])))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, size[a] + (1 << 18), "right")) - 1)
            h, off = hashed(texts.slice(a, b - a))
            g = C.grams(h, SHINGLE)
            full = index.hits(g) if len(index.known) else []
            docs = set(np.unique(np.searchsorted(off, full, "right") - 1).tolist()) if len(full) else set()
            short = any(s < SHINGLE for s in index.by_size)
            for i in range(b - a) if short else sorted(docs):
                own = h[off[i] : off[i + 1]]
                found = matches(C.grams(own, SHINGLE), len(own), index, threshold) if i in docs else []
                found += short_matches(own, index) if short else []
                if found:
                    yield a + i, found
            a = b

    return each


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Bounded blocks of the query set, as they stream to the driver."""
    block, n = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        n += len(r.text) // 4 + 1
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def _words(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.expr("length(text) div 4 + 1"))).first()[0] or 0


def _places(g: np.ndarray, bits: int) -> np.ndarray:
    return (C.mix(g ^ C.MULT) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(benchmark: DataFrame, words: int) -> tuple[bytes, int, list[int]]:
    """Bits set at the items' shingles, their number as a power of two, and the sizes of items under a shingle."""
    bits = max(10, min((BITMAP_BYTES * 8).bit_length() - 1, (16 * words).bit_length()))
    bitmap, short = np.zeros(1 << bits, bool), set()
    for block in _item_blocks(benchmark):
        h, off = hashed([t for _, t in block])
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if 0 < b - a < SHINGLE:
                short.add(b - a)
            if b > a:
                bitmap[_places(C.grams(h[a:b], min(SHINGLE, b - a)), bits)] = True
    return np.packbits(bitmap).tobytes(), bits, sorted(short)


def _marked(docs: DataFrame, benchmark: DataFrame, words: int, kept: bool) -> DataFrame:
    """The documents, all columns, that have (or have not) a shingle of the bitmap."""
    packed, bits, short = _bitmap(benchmark, words)
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            raw, off = C.flat(batch.column("text"))
            for a, b in block_bounds(off):
                h, words_of = hashed(batch.column("text").slice(a, b - a))
                for size in (SHINGLE, *short):
                    g = C.grams(h, size)
                    at = np.flatnonzero(bitmap[_places(g, bits)])
                    doc = np.searchsorted(words_of, at, "right") - 1
                    hit[a + np.unique(doc[at + size <= words_of[doc + 1]])] = True
            yield batch.filter(pa.array(hit == kept))

    return docs.mapInArrow(run, docs.schema)


def _finder(items: list, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, each = index_of(items), _search(items, threshold)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], *m) for i, found in each(batch, index) for m in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def _dropper(items: list, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, each = index_of(items), _search(items, threshold)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _ in each(batch, index)]] = False
            yield batch.filter(pa.array(keep))

    return run


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """A row for each document and item that it holds, with the most similar window."""
    docs = docs.select("doc_id", "text")
    words = _words(benchmark)
    if words <= BLOCK_WORDS:
        items = [x for block in _item_blocks(benchmark) for x in block]
        return docs.mapInArrow(_finder(items, threshold), FOUND) if items else docs.sparkSession.createDataFrame([], FOUND)
    maybe = C.materialise(_marked(docs, benchmark, words, True))
    out = None
    for items in _item_blocks(benchmark):  # written at once: the driver holds one block
        part = C.materialise(maybe.mapInArrow(_finder(items, threshold), FOUND))
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    words = _words(benchmark)
    if words <= BLOCK_WORDS:
        items = [x for block in _item_blocks(benchmark) for x in block]
        return docs.mapInArrow(_dropper(items, threshold), docs.schema) if items else docs
    maybe, clean = C.materialise(_marked(docs, benchmark, words, True)), _marked(docs, benchmark, words, False)
    for items in _item_blocks(benchmark):
        maybe = C.materialise(maybe.mapInArrow(_dropper(items, threshold), docs.schema))
    return clean.unionByName(maybe)
