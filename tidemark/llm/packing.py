"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; pieces are dealt to subsets of about SUBSET by a hash.
Each subset is searched by several islands, each on its own: a population of packings,
where crossover injects whole well-filled bins of one parent into the other, drops
bins that share a piece with them and best-fits the displaced pieces again. After each
round the islands' elites migrate to their neighbours. The pieces of bins that stay
under-filled go on to the next level, where they meet those of other subsets: again
subsets of that size, however many pieces are left. Levels end when one subset holds
all that is left, or when a level leaves nearly as many pieces as it was given: lengths
that do not pair (all over half a sequence, say) are not dealt again and again.

Cases: null or empty text is one piece, the end id alone; pieces as long as a sequence
stand alone; equal lengths and repeated rows are packed one by one, each by a row number
that is written with it, so that copies of one row spread over the subsets; no rows give
none. Which of several good packings comes out depends on the rows' partitions.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

CAPACITY = 2048
SUBSET = 2048  # pieces
ISLANDS = 2
ROUNDS = 2
FULL = 0.995  # bins under this share of the capacity are tried again on the next level
WORTH = 0.8  # a further level is tried while the last one left at most this share of its pieces
#: Islands that one task searches, one after the other, and the most tasks of a round.
ISLANDS_OF_TASK = 4
TASKS_MOST = 20_000
#: The number of a written piece, which deals it to a subset.
ROW = "_row"


def vocabulary(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


_ENCODERS: dict[str, object] = {}
#: In a text, too, the vocabulary makes this one id; it holds no blank, where long texts are parted.
ADDED_TOKENS = {"<|endoftext|>": 50256}


def encoder(ranks_file: str):
    """The byte-level BPE of the JSON vocabulary, from its rank file and its added token: the same ids, four times as fast."""
    if ranks_file not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[ranks_file] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS)
    return _ENCODERS[ranks_file]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
#: Characters that are encoded at once; a text is only parted where a word begins.
_CHUNK = 1 << 20


def encode(enc, text: str) -> np.ndarray:
    """Ids of a whole text. Long texts are parted before a blank between letters, where no token reaches across."""
    if len(text) <= _CHUNK:
        return np.asarray(enc.encode_to_numpy(text, allowed_special="all"), np.uint32)
    parts, a = [], 0
    while a < len(text):
        b = min(len(text), a + _CHUNK)
        while b < len(text) and not (text[b] == " " and text[b - 1].isalpha() and text[b + 1 : b + 2].isalpha()):
            b += 1
        parts.append(np.asarray(enc.encode_to_numpy(text[a:b], allowed_special="all"), np.uint32))
        a = b
    return np.concatenate(parts)


def pieces(docs: DataFrame, ranks_file: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids; of a longer document all but the first are full."""
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(enc, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for n, a in enumerate((0, *range(first, len(ids), capacity))):
                    part = ids[a : first if n == 0 else a + capacity]
                    rows.append((doc_id, n, a, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
            names = schema.fieldNames()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


# --- the search within a subset: pieces are the positions of a descending list of lengths ---


class Bins:
    """Open bins by the room that is left, for best fit."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room, self.rooms, self.members = capacity, 0, {}, [], []

    def add_bin(self, members: list[int], room: int) -> None:
        self.rooms.append(room)
        self.members.append(members)
        self._file(len(self.rooms) - 1, room)

    def _file(self, bin_: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(bin_)
        self.mask |= 1 << room

    def fit(self, piece: int, length: int) -> None:
        """Into the fullest bin with room for it, else into a new one."""
        above = self.mask >> length
        if not above:
            self.add_bin([piece], self.capacity - length)
            return
        room = length + (above & -above).bit_length() - 1
        same = self.by_room[room]
        bin_ = same.pop()
        if not same:
            self.mask &= ~(1 << room)
        self.members[bin_].append(piece)
        self.rooms[bin_] = room - length
        self._file(bin_, room - length)


def fitness(packing: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full bins."""
    return -len(packing), sum((sum(lengths[p] for p in b) / capacity) ** 2 for b in packing)


def best_fit(lengths: list[int], capacity: int, order: list[int]) -> list[list[int]]:
    bins = Bins(capacity)
    for p in order:
        bins.fit(p, lengths[p])
    return bins.members


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Injects whole well-filled bins of b into a and best-fits what that displaces."""
    full = sorted(b, key=lambda bin_: -sum(lengths[p] for p in bin_))
    share = rng.uniform(0.2, 0.5)
    injected = [bin_ for bin_ in full[: max(1, int(len(full) * 0.7))] if rng.random() < share] or full[:1]
    taken = {p for bin_ in injected for p in bin_}
    bins, displaced = Bins(capacity), []
    for bin_ in injected:
        bins.add_bin([*bin_], capacity - sum(lengths[p] for p in bin_))
    for bin_ in a:
        if taken.isdisjoint(bin_):
            bins.add_bin([*bin_], capacity - sum(lengths[p] for p in bin_))
        else:
            displaced += [p for p in bin_ if p not in taken]
    for p in sorted(displaced, key=lambda p: -lengths[p]):
        bins.fit(p, lengths[p])
    return bins.members


def mutate(a: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empties the least filled bin and a few others and best-fits their pieces."""
    worst = min(range(len(a)), key=lambda i: sum(lengths[p] for p in a[i]))
    gone = {worst, *(rng.randrange(len(a)) for _ in range(3))}
    bins = Bins(capacity)
    for i, bin_ in enumerate(a):
        if i not in gone:
            bins.add_bin([*bin_], capacity - sum(lengths[p] for p in bin_))
    for p in sorted((p for i in gone for p in a[i]), key=lambda p: -lengths[p]):
        bins.fit(p, lengths[p])
    return bins.members


def search(lengths: list[int], capacity: int, seeds: list[list[list[int]]], rng: random.Random, population: int = 4, generations: int = 6) -> list[list[list[int]]]:
    """The two best packings after some generations; seeds are packings to begin with."""
    least = -(-sum(lengths) // capacity)
    alive = list(seeds)
    order = list(range(len(lengths)))
    while len(alive) < population:
        if alive:  # lengths that are nearly equal change places
            order = sorted(range(len(lengths)), key=lambda p: -lengths[p] * rng.uniform(0.9, 1.0))
        alive.append(best_fit(lengths, capacity, order))
    score = {id(p): fitness(p, lengths, capacity) for p in alive}
    for _ in range(generations):
        alive.sort(key=lambda p: score[id(p)], reverse=True)
        if len(alive[0]) == least:
            break
        a, b = alive[0], alive[rng.randrange(1, len(alive))]
        for child in (mutate(crossover(a, b, lengths, capacity, rng), lengths, capacity, rng), crossover(b, a, lengths, capacity, rng)):
            score[id(child)] = fitness(child, lengths, capacity)
            alive.append(child)
        alive.sort(key=lambda p: score[id(p)], reverse=True)
        del alive[population:]
    alive.sort(key=lambda p: score[id(p)], reverse=True)
    return alive[:2]


def _to_blob(packing: list[list[int]], n: int) -> bytes:
    out = np.empty(n, np.int32)
    for i, bin_ in enumerate(packing):
        out[bin_] = i
    return out.tobytes()


def _from_blob(blob: bytes) -> list[list[int]]:
    out: list[list[int]] = []
    for p, b in enumerate(np.frombuffer(blob, np.int32).tolist()):
        while len(out) <= b:
            out.append([])
        out[b].append(p)
    return out


STATE = "subset long, island int, lengths binary, elite binary, second binary, bins int, fill double"


def evolve(capacity: int, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], np.int32).tolist()
                seeds = [_from_blob(r[k]) for k in ("elite", "second", "migrant") if r.get(k) is not None]
                rng = random.Random(f"{r['subset']} {r['island']} {round_}")
                best, *rest = search(lengths, capacity, seeds, rng)
                bins, fill = fitness(best, lengths, capacity)
                rows.append((r["subset"], r["island"], r["lengths"], _to_blob(best, len(lengths)), _to_blob((rest or [best])[0], len(lengths)), -bins, fill))
            names = ["subset", "island", "lengths", "elite", "second", "bins", "fill"]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kinds[i]) for i in range(7)], names)

    return run


def _sorted(table: pa.Table, columns: list[str]) -> pa.Table:
    return table.sort_by([("length", "descending"), *((c, "ascending") for c in columns if c != "length")])


def pack_level(rest: DataFrame, columns: list[str], subsets: int, level: int, capacity: int) -> DataFrame:
    """columns, sequence_id, offset and bin_fill of all pieces of rest, packed subset by subset."""
    dealt = rest.select(F.pmod(F.xxhash64(F.lit(level), ROW), F.lit(subsets)).alias("subset"), *columns)

    def lengths_of(key: tuple, table: pa.Table) -> pa.Table:
        lengths = np.sort(table["length"].to_numpy())[::-1]
        lengths = lengths[lengths < capacity].astype(np.int32)
        return pa.table({"subset": pa.array([key[0].as_py()] if len(lengths) else [], pa.int64()), "lengths": pa.array([lengths.tobytes()] if len(lengths) else [], pa.binary())})

    few = dealt.select("subset", "length").groupBy("subset").applyInArrow(lengths_of, "subset long, lengths binary")
    state = few.select("subset", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "lengths")
    tasks = max(1, min(TASKS_MOST, -(-subsets * ISLANDS // ISLANDS_OF_TASK)))  # a given number: else small rows are gathered in one task
    state = C.materialise(state.repartition(tasks, "subset", "island").mapInArrow(evolve(capacity, 0), STATE))
    for round_ in range(1, ROUNDS):
        migrants = state.select("subset", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
        met = state.repartition(tasks, "subset", "island").join(migrants.repartition(tasks, "subset", "island"), ["subset", "island"])
        state = C.materialise(met.mapInArrow(evolve(capacity, round_), STATE))
    best = state.groupBy("subset").agg(F.min_by("elite", F.struct("bins", -F.col("fill"), "island")).alias("elite"))

    def place(key: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        mine = _sorted(mine.select(columns), columns)
        length = mine["length"].to_numpy()
        whole = int((length >= capacity).sum())
        bin_ = np.arange(len(length))
        if found.num_rows:
            bin_[whole:] = whole + np.frombuffer(found["elite"][0].as_py(), np.int32)
        order = np.argsort(bin_, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.append(True, bin_[order][1:] != bin_[order][:-1])
        offset = np.empty(len(length), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bin_, length)[bin_] / capacity
        sequence = (np.int64(level) << np.int64(58)) + (np.int64(key[0].as_py()) << np.int64(20)) + bin_
        out = mine.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return out.append_column("bin_fill", pa.array(fill, pa.float64()))

    kinds = dict(rest.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "sequence_id long, offset long, bin_fill double"])
    return dealt.groupBy("subset").cogroup(best.groupBy("subset")).applyInArrow(place, schema)


def pack(found: DataFrame, capacity: int = CAPACITY, subset: int = SUBSET) -> DataFrame:
    """sequence_id and offset of each piece; found needs a column ROW that differs from piece to piece.

    Levels meet until the under-filled bins share one subset or a level is not worth another.
    """
    columns = found.columns
    rest = found
    n = rest.count()
    done, level = None, 0
    while True:
        subsets = max(1, -(-n // subset))
        packed = C.materialise(pack_level(rest, columns, subsets, level, capacity))
        last = subsets == 1
        left = 0 if last else packed.where(F.col("bin_fill") < FULL).count()
        last = last or left > n * WORTH
        kept = packed if last else packed.where(F.col("bin_fill") >= FULL)
        part = kept.select(*[c for c in columns if c != ROW], "sequence_id", "offset")
        done = part if done is None else done.unionByName(part)
        if last or not left:
            return done
        rest = packed.where(F.col("bin_fill") < FULL).select(*columns)
        level, n = level + 1, left


def pack_documents(docs: DataFrame, ranks_file: str | None = None, capacity: int = CAPACITY, end_id: int = 0, subset: int = SUBSET) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of (doc_id, text)."""
    found = pieces(docs, ranks_file or vocabulary(), capacity, end_id)
    return pack(C.materialise(found.withColumn(ROW, F.monotonically_increasing_id())), capacity, subset)
