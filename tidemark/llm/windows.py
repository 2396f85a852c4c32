"""Finding windows of L tokens that start in more than one document, exactly.

Every window holds a content-defined anchor (the least-hashed run of k of its
tokens), so equal windows hold equal anchors at equal places. Three exchanges,
all of packed binary rows, one for each (group of documents, bucket):

1. each group sends its distinct anchor hashes to hash-range buckets; a bucket
   answers with those that lie in more than one document. All other windows are
   unique and travel no further;
2. for the anchors left, consecutive windows with the same anchor travel as one
   packed string, once per group however often it occurs there, with the least
   doc_id that holds it in the group and whether there are more; the bucket finds
   for each window the least doc_id of all;
3. the bucket answers each group with the windows of its strings that a smaller
   doc_id holds. The group finds its strings again, in the same order, and only it
   knows where in its documents they occur.

A hot anchor or string costs a bucket one small row a group, and a group what its own
documents hold: places never travel. Documents are dealt to groups by a hash of doc_id
and text; all steps share that one exchange of texts. Nothing goes to the driver but the
sum of text bytes and the cuts of the buckets. All steps are deterministic functions of
the rows of a group, in whatever order they come, so lost executors are simply recomputed.

Strings are told apart by 64-bit hashes whose matches are compared byte by byte; should
two different strings of one set collide, the set is hashed again with another salt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Text bytes that are worked on at once; a longer document is worked on in stretches.
BLOCK = 1 << 18
#: Anchor hashes of one bucket; for large corpora buckets grow, so that a group sends each of them more than a few.
BUCKET_BYTES = 5 << 20
BUCKET_BYTES_MAX = 64 << 20
BUCKETS_BEFORE_GROWTH = 16_384
#: Buckets of strings for each bucket of anchor hashes.
STRING_BUCKETS = 5


@dataclass
class Tokens:
    """Tokens of a block of documents, on end."""

    hashes: np.ndarray  # uint64
    packed: np.ndarray  # uint8: what travels
    starts: np.ndarray  # of each token in packed
    ends: np.ndarray
    offsets: np.ndarray  # len(docs) + 1, in tokens


@dataclass
class Spec:
    """What a window is and how its bucket orders windows."""

    length: int
    anchor: int
    tokens: Callable[[np.ndarray, np.ndarray], Tokens]
    stretches: Callable[[np.ndarray], Iterator[tuple[int, int, int]]]  # of a long text: bytes from, to, tokens before
    spans: Callable  # spans(strings, least doc_ids) -> (string, first window, last window + 1, least doc_id)
    bytes_per_anchor: float
    leading: int = 0  # bytes of an anchor that order the string buckets; 0: they are ranges of its hash


def block_bounds(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of whole documents of about BLOCK bytes."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK, "right")) - 1)
        yield a, b
        a = b


def blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids (objects, None where there is none), bytes and offsets of the group's documents, in blocks."""
    ids = np.array([*table["doc_id"].to_pylist(), None], object)[:-1]
    raw, off = C.flat(table["text"])
    for a, b in block_bounds(off):
        yield ids[a:b], raw[off[a] : off[b]], off[a : b + 1] - off[a]


@dataclass
class Runs:
    """Consecutive windows of one document with one anchor."""

    first: np.ndarray  # token where the first window starts
    last: np.ndarray  # token where the last window starts
    at: np.ndarray  # token where the anchor starts
    hash: np.ndarray  # of the anchor
    doc: np.ndarray  # index in the block


def runs(t: Tokens, length: int, k: int) -> Runs:
    m = length - k + 1
    none = np.empty(0, np.int64)
    if len(t.hashes) < length:
        return Runs(none, none, none, np.empty(0, np.uint64), none)
    found: list[tuple] = []
    step, low = 1 << 20, np.uint64((1 << 21) - 1)
    for a in range(0, len(t.hashes) - length + 1, step):
        h = C.grams(t.hashes[a : a + step + length - 1], k)
        keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        at = (C.sliding_min(keys, m) & low).astype(np.int64)
        found.append((at + a, C.mix(h[at] * C.MULT)))  # least hashes are small: spread them anew over the buckets
    at = np.concatenate([x for x, _ in found])
    h = np.concatenate([x for _, x in found])
    sizes = np.diff(t.offsets)
    whole = np.ones(len(at), bool)  # windows within a document
    tails = np.minimum(sizes, length - 1)
    cut = C.ranges(t.offsets[1:] - tails, tails)
    whole[cut[cut < len(at)]] = False
    places = np.flatnonzero(whole)
    if not len(places):
        return Runs(none, none, none, np.empty(0, np.uint64), none)
    doc = np.searchsorted(t.offsets, places, "right") - 1
    new = np.ones(len(places), bool)
    new[1:] = (at[places][1:] != at[places][:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(places)) - 1
    return Runs(places[begin], places[end], at[places[begin]], h[places[begin]], doc[begin])


def named(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray]:
    """Rows that have a doc_id, those ids, and the texts."""
    valid = docs["doc_id"].is_valid()
    rows = np.flatnonzero(valid.to_numpy())
    docs = docs.select(["doc_id", "text"]).filter(valid)
    return rows, docs["doc_id"].to_numpy().astype(np.int64), docs["text"]


def runs_of(spec: Spec, texts: pa.ChunkedArray) -> Iterator[tuple[int, int, Tokens, Runs]]:
    """Index of the block's first document, tokens before the stretch, tokens and runs."""
    raw, off = C.flat(texts)
    for a, b in block_bounds(off):
        text = raw[off[a] : off[b]]
        parts = [(0, len(text), 0)] if b - a > 1 or len(text) <= 2 * BLOCK else spec.stretches(text)
        for from_, to, before in parts:
            t = spec.tokens(text[from_:to], off[a : b + 1] - off[a] if b - a > 1 else np.array([0, to - from_]))
            yield a, before, t, runs(t, spec.length, spec.anchor)


# --- exact classes of byte strings ---------------------------------------------------

STRETCH = 1 << 19


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each string data[start:end], by differences of prefix sums; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    values = C.mix(np.arange(1, 257, dtype=np.uint64) * C.MULT + np.uint64(salt))
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + STRETCH, "right")))
        part = data[base : int(ends[i:j].max())]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * C.powers("up", len(part)), out=prefix[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = C.mix((prefix[b] - prefix[a]) * C.powers("down", len(part) + 1)[a])
        i = j
    return out


def _all_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the strings at a and b, two by two, are equal."""
    done = np.cumsum(sizes)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + STRETCH, "right")))
        if (data[C.ranges(a[i:j], sizes[i:j])] != data[C.ranges(b[i:j], sizes[i:j])]).any():
            return False
        i = j
    return True


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A member of each class of equal strings, and the class of each string.

    Classes are in the order of a hash that depends on the set of strings alone.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = ends - starts
    for salt in count():
        h = string_hashes(data, starts, ends, salt)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        x, y = order[:-1][same], order[1:][same]
        if (sizes[x] == sizes[y]).all() and _all_equal(data, starts[x], starts[y], sizes[x]):
            break
    new = np.append(True, ~same)
    class_ = np.empty(len(starts), np.int64)
    class_[order] = np.cumsum(new) - 1
    return order[new], class_


@dataclass
class Strings:
    """Byte strings on end, and the token of each where its anchor starts."""

    data: np.ndarray
    sizes: np.ndarray
    anchor: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)

    @property
    def starts(self) -> np.ndarray:
        return self.ends - self.sizes

    def take(self, at: np.ndarray) -> Strings:
        return Strings(self.data[C.ranges(self.starts[at], self.sizes[at])], self.sizes[at], self.anchor[at])


def joined(parts: list[Strings]) -> Strings:
    return Strings(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("data", "sizes", "anchor")))


# --- step 1: anchors that lie in several documents -----------------------------------


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash ranges: sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


#: Anchors travel as 47 bits of their hash and one that tells of several documents: a chance match only lets a unique
#: window go on to the exact steps.
_LOW = np.uint64(1)


def short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(16)) & ~_LOW


def six_bytes(v: np.ndarray) -> bytes:
    return v.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def bucket_count(n_bytes: int) -> int:
    size = min(BUCKET_BYTES_MAX, max(BUCKET_BYTES, n_bytes // BUCKETS_BEFORE_GROWTH))
    return max(4, n_bytes // size)


def _rows(**columns) -> pa.Table:
    types = {"g": pa.int32(), "bucket": pa.int32(), "blob": pa.binary()}
    return pa.table({k: pa.array(v, types[k]) for k, v in columns.items()})


ASKED = "g int, bucket int, blob binary"
#: The bucket of rows that hold the repeated anchors of a group.
ANCHORS = -1


def anchors_of_group(spec: Spec, n_buckets: int):
    """The group's distinct anchors; the lowest bit tells of several documents."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        hashes, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        _, ids, texts = named(table)
        for first, _, _, r in runs_of(spec, texts):
            hashes.append(short(r.hash))
            docs.append(ids[first + r.doc])
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        if not len(h):
            return _rows(g=[], bucket=[], blob=[])
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        several = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
        sent = h[begin] | several.astype(np.uint64)
        cuts = np.searchsorted(bucket_of(sent << np.uint64(16), n_buckets), np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        return _rows(g=[key[0].as_py()] * len(full), bucket=full, blob=[six_bytes(sent[cuts[b] : cuts[b + 1]]) for b in full])

    return ask


def repeated_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """For each group those of its hashes that lie in several documents (or in two groups: the bucket can't tell)."""
    groups, blobs = table["g"].to_numpy(), table["blob"].to_pylist()
    parts = [from_six_bytes(b) for b in blobs]
    sent = np.concatenate(parts)
    from_ = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(sent, kind="stable")
    h = sent[order] & ~_LOW
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(begin, len(h)))
    several = (size > 1) | (np.maximum.reduceat(sent[order] & _LOW, begin) == 1)
    kept = np.repeat(several, size)
    h, from_ = h[kept], from_[order][kept]
    order = np.argsort(from_, kind="stable")
    h, from_ = h[order], from_[order]
    cuts = np.searchsorted(from_, np.arange(len(parts) + 1))
    full = np.flatnonzero(np.diff(cuts))
    return _rows(g=groups[full], bucket=[ANCHORS] * len(full), blob=[six_bytes(h[cuts[i] : cuts[i + 1]]) for i in full])


# --- step 2: strings of windows ------------------------------------------------------


@dataclass
class Cuts:
    """Buckets of strings: ranges of the anchors' leading bytes, else of their hashes."""

    n: int
    first: np.ndarray | None = None  # of each cut the first eight bytes, and the next eight
    second: np.ndarray | None = None

    def bucket(self, spec: Spec, data: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Of anchors that start at data[at], with hashes h."""
        if not spec.leading:
            return bucket_of(h, self.n)
        first, second = leading(spec, data, at)
        low, high = np.searchsorted(self.first, first, "left"), np.searchsorted(self.first, first, "right")
        out = low.copy()
        tied = np.flatnonzero(low < high)  # a hot digit has several cuts: the next one parts it
        for a in np.unique(low[tied]).tolist():
            mine = tied[low[tied] == a]
            out[mine] = a + np.searchsorted(self.second[a : high[mine[0]]], second[mine], "right")
        return out


def digit(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Up to eight bytes from each place as one number, the first byte the most significant."""
    if size <= 0 or not len(at):
        return np.zeros(len(at), np.uint64)
    out = np.zeros((len(at), 8), np.uint8)
    for i in range(min(8, size)):
        out[:, i] = data[at + i]
    return out.view(">u8").ravel().astype(np.uint64)


def leading(spec: Spec, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return digit(data, at, spec.leading), digit(data, at + 8, spec.leading - 8)


def _pack(blob: bytes) -> bytes:
    """Compressed, after the plain size."""
    return len(blob).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(blob, asbytes=True)


def _unpack(blob: bytes) -> memoryview:
    return memoryview(pa.Codec("zstd", 3).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))


def arrays(view: memoryview, n: int, *kinds) -> tuple[list[np.ndarray], memoryview]:
    """n values of each kind, one after the other, and what is left."""
    out = []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(view[:size], kind))
        view = view[size:]
    return out, view


@dataclass
class Occurrences:
    """The distinct strings of a group in the order of bucket and hash, and where they occur."""

    strings: Strings
    bucket: np.ndarray
    doc: np.ndarray  # index among the documents that have a doc_id
    at: np.ndarray  # token of the document
    string: np.ndarray


def occurrences(spec: Spec, texts: pa.ChunkedArray, repeated: np.ndarray, cuts: Cuts) -> Occurrences | None:
    parts, buckets, docs, ats, owners, n = [], [], [], [], [], 0
    for first, before, t, r in runs_of(spec, texts):
        h = short(r.hash)
        near = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
        kept = np.flatnonzero(repeated[near] == h)
        if not len(kept):
            continue
        a, b = t.starts[r.first[kept]], t.ends[r.last[kept] + spec.length - 1]
        member, class_ = distinct(t.packed, a, b)
        anchor = r.at[kept] - r.first[kept]
        parts.append(Strings(t.packed[C.ranges(a[member], (b - a)[member])], (b - a)[member], anchor[member]))
        buckets.append(cuts.bucket(spec, t.packed, t.starts[r.at[kept[member]]], h[kept[member]] << np.uint64(16)))
        docs.append(first + r.doc[kept])
        ats.append(before + r.first[kept] - t.offsets[r.doc[kept]])
        owners.append(n + class_)
        n += len(member)
    if not parts:
        return None
    strings, bucket = joined(parts), np.concatenate(buckets)
    del parts
    member, class_ = distinct(strings.data, strings.starts, strings.ends)
    order = np.argsort(bucket[member], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    member = member[order]
    return Occurrences(strings.take(member), bucket[member], np.concatenate(docs), np.concatenate(ats), rank[class_][np.concatenate(owners)])


def strings_of_group(spec: Spec, cuts: Cuts):
    """Packed strings of windows whose anchor is repeated, each once."""

    def ask(key: tuple, docs: pa.Table, said: pa.Table) -> pa.Table:
        found = None
        if docs.num_rows and said.num_rows:
            _, ids, texts = named(docs)
            found = occurrences(spec, texts, np.sort(np.concatenate([from_six_bytes(b) for b in said["blob"].to_pylist()])), cuts)
        if found is None:
            return _rows(g=[], bucket=[], blob=[])
        order = np.argsort(found.string, kind="stable")
        begin = np.searchsorted(found.string[order], np.arange(len(found.bucket)))
        doc = ids[found.doc[order]]
        low, several = np.minimum.reduceat(doc, begin), np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
        full, first = np.unique(found.bucket, return_index=True)
        ends, out = found.strings.ends, []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(low)], strict=True):
            s = found.strings
            head = [np.int64(b - a), s.sizes[a:b].astype(np.int32), s.anchor[a:b].astype(np.int32), several[a:b], low[a:b], s.data[ends[a] - s.sizes[a] : ends[b - 1]]]
            out.append(_pack(b"".join(x.tobytes() for x in head)))
        return _rows(g=[key[0].as_py()] * len(full), bucket=full, blob=out)

    return ask


def least_windows(spec: Spec):
    """For each group, and each of its strings in their order, the windows that a smaller doc_id holds."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        groups, parts, lows, severals = table["g"].to_numpy(), [], [], []
        for blob in table["blob"]:
            view = _unpack(blob.as_py())
            (n,), view = arrays(view, 1, np.int64)
            (sizes, anchor, several, low), view = arrays(view, int(n[0]), np.int32, np.int32, np.bool_, np.int64)
            parts.append(Strings(np.frombuffer(view, np.uint8), sizes.astype(np.int64), anchor))
            lows.append(low)
            severals.append(several)
        sent = np.array([len(x) for x in lows])
        strings, low, several = joined(parts), np.concatenate(lows), np.concatenate(severals)
        del parts, lows
        member, class_ = distinct(strings.data, strings.starts, strings.ends)
        least = np.full(len(member), np.iinfo(np.int64).max)
        np.minimum.at(least, class_, low)
        owner, from_, to, doc = spec.spans(strings.take(member), least)
        del strings
        order = np.argsort(owner, kind="stable")
        from_, to, doc = from_[order], to[order], doc[order]
        begin = np.searchsorted(owner[order], np.arange(len(member) + 1))
        times = (begin[1:] - begin[:-1])[class_]
        span, own = C.ranges(begin[class_], times), np.repeat(np.arange(len(class_)), times)
        hit = (doc[span] < low[own]) | several[own]
        span, own = span[hit], own[hit]
        times = np.bincount(own, minlength=len(class_))
        ends = np.cumsum(sent)
        out, keep = [], []
        cut = np.searchsorted(own, [0, *ends])
        for i, (a, b) in enumerate(zip(ends - sent, ends, strict=True)):
            if cut[i + 1] > cut[i]:
                s = span[cut[i] : cut[i + 1]]
                keep.append(i)
                out.append(_pack(b"".join(x.tobytes() for x in (np.int64(b - a), np.int64(len(s)), times[a:b].astype(np.int32), from_[s].astype(np.int32), to[s].astype(np.int32), doc[s].astype(np.int64)))))
        return _rows(g=groups[keep], bucket=[key[0].as_py()] * len(keep), blob=out)

    return answer


def spans_with_last(owner: np.ndarray, place: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows one after the other as runs of one least doc_id: (string, first, last + 1, doc_id)."""
    new = np.append(True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]))
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(least)) - 1
    return owner[a], place[a], place[b] + 1, least[a]


# --- step 3: places in the documents -------------------------------------------------


def merged(spans: np.ndarray) -> np.ndarray:
    """(from, to) rows of one document as disjoint, maximal ranges."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    begin = np.flatnonzero(new)
    return np.stack([spans[begin, 0], reach[np.append(begin[1:], len(spans)) - 1]], axis=1)


def ranges_of_rows(spec: Spec, cuts: Cuts, docs: pa.Table, said: pa.Table) -> dict[int, np.ndarray]:
    """Merged (from, to) token ranges to remove, by row of docs."""
    answers = {b: x for b, x in zip(said["bucket"].to_pylist(), said["blob"].to_pylist(), strict=True) if b != ANCHORS}
    if not answers or not docs.num_rows:
        return {}
    rows, ids, texts = named(docs)
    repeated = said.filter(pa.compute.equal(said["bucket"], ANCHORS))
    found = occurrences(spec, texts, np.sort(np.concatenate([from_six_bytes(b) for b in repeated["blob"].to_pylist()])), cuts)
    times = np.zeros(len(found.bucket), np.int64)
    first = np.searchsorted(found.bucket, np.arange(cuts.n + 1))
    spans = []
    for b in sorted(answers):
        (n, k), view = arrays(_unpack(answers[b]), 1, np.int64, np.int64)
        (own,), view = arrays(view, int(n[0]), np.int32)
        times[first[b] : first[b + 1]] = own
        spans.append(arrays(view, int(k[0]), np.int32, np.int32, np.int64)[0])
    from_, to, doc = (np.concatenate([s[i] for s in spans]) for i in range(3))
    begin = np.cumsum(times) - times
    each = times[found.string]
    span, own = C.ranges(begin[found.string], each), np.repeat(np.arange(len(each)), each)
    hit = doc[span] < ids[found.doc[own]]
    span, own = span[hit], own[hit]
    d, a, b = found.doc[own], found.at[own] + from_[span], found.at[own] + to[span] + spec.length - 1
    order = np.argsort(d, kind="stable")
    d, both = d[order], np.stack([a[order], b[order]], axis=1)
    edge = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d)) if len(d) else np.zeros(1, np.int64)
    return {int(rows[d[x]]): merged(both[x:y]) for x, y in zip(edge[:-1], edge[1:], strict=True)}


#: Text bytes of the sample that the cuts of string buckets come from, and values of it for each bucket; they only balance buckets.
SAMPLE_BYTES = 8 << 20
SAMPLE_OF_BUCKET = 32
SAMPLE_MOST = 400_000


def string_cuts(docs: DataFrame, spec: Spec, n: int, total: int) -> Cuts:
    """Quantiles of the distinct leading bytes of a sample's anchors, at most SAMPLE_MOST of them."""
    if not spec.leading:
        return Cuts(n)
    values = min(SAMPLE_MOST, n * SAMPLE_OF_BUCKET)
    one_in = max(1, total // SAMPLE_BYTES)
    share = min(1.0, values / max(1.0, min(total, SAMPLE_BYTES) / (2 * spec.bytes_per_anchor)))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, t, r in runs_of(spec, pa.chunked_array([batch.column("text")])):
                at = r.at[(C.mix(r.hash + C.MULT) >> np.uint64(11)) < np.uint64(int(share * 2**53))]
                a, b = leading(spec, t.packed, t.starts[at])
                yield pa.RecordBatch.from_arrays([pa.array(x ^ np.uint64(1 << 63)).view(pa.int64()) for x in (a, b)], ["a", "b"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(one_in)) == 0).select("text")
    found = some.mapInArrow(sampled, "a long, b long").orderBy("a", "b").limit(SAMPLE_MOST).toArrow()
    first, second = (found[c].to_numpy().view(np.uint64) ^ np.uint64(1 << 63) for c in ("a", "b"))
    pairs = np.unique(np.stack([first, second], axis=1), axis=0)  # a group sends a string once, however often it occurs
    at = np.unique(np.linspace(0, len(pairs), n + 1).astype(int)[1:-1])
    pairs = pairs[at[at < len(pairs)]]
    return Cuts(len(pairs) + 1, pairs[:, 0].copy(), pairs[:, 1].copy())


def repeats(docs: DataFrame, spec: Spec):
    """Documents by group and what is known of their windows, ready for one last cogroup; docs may have more columns."""
    total = C.text_bytes(docs)
    n_groups = C.group_count(total)
    n_buckets = bucket_count(int(total / spec.bytes_per_anchor * 6))
    cuts = string_cuts(docs.where("doc_id is not null"), spec, n_buckets * STRING_BUCKETS, total)
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int")
    groups = docs.withColumn(GROUP, spread).groupBy(GROUP)
    asked = groups.applyInArrow(anchors_of_group(spec, n_buckets), ASKED)
    repeated = asked.groupBy("bucket").applyInArrow(repeated_anchors, ASKED)
    sent = groups.cogroup(repeated.groupBy("g")).applyInArrow(strings_of_group(spec, cuts), ASKED)
    covered = sent.groupBy("bucket").applyInArrow(least_windows(spec), ASKED)
    return groups.cogroup(repeated.unionByName(covered).groupBy("g")), cuts


#: Column of the group; of no table that is read here.
GROUP = "_tidemark_group"


def _texts(table: pa.Table) -> Iterator[bytes | None]:
    for text in table["text"].cast(pa.large_string()).cast(pa.large_binary()):
        yield text.as_py()


def remove_repeats(docs: DataFrame, spec: Spec, finish, schema: str) -> DataFrame:
    """finish(doc_id, text bytes, ranges or None) -> a tuple of schema, for each document of (doc_id, text)."""
    names, kinds = zip(*(x.split() for x in schema.split(",")), strict=True)
    types = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]
    pairs, cuts = repeats(docs.select("doc_id", "text"), spec)

    def result(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        spans = ranges_of_rows(spec, cuts, table, said)
        out = [finish(d, t, spans.get(i)) for i, (d, t) in enumerate(zip(table["doc_id"].to_pylist(), _texts(table), strict=True))]
        return pa.table({n: pa.array([r[j] for r in out], types[j]) for j, n in enumerate(names)})

    return pairs.applyInArrow(result, schema)


def rewrite(docs: DataFrame, spec: Spec, edit) -> DataFrame:
    """All rows and columns, the text as edit(text bytes, ranges) gives it; null stays null."""
    pairs, cuts = repeats(docs, spec)

    def result(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        spans = ranges_of_rows(spec, cuts, table, said)
        texts = [None if t is None else edit(t, spans[i]) if i in spans else t.decode() for i, t in enumerate(_texts(table))]
        table = table.drop_columns([GROUP])
        return table.set_column(table.column_names.index("text"), "text", pa.array(texts, pa.string()))

    return pairs.applyInArrow(result, docs.schema)
