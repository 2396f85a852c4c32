"""Helpers that the text operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, shared_dir  # noqa: F401  (C.materialise)

#: Text bytes that one group of documents holds, and the number of groups from
#: which the groups grow instead (up to GROUP_BYTES_MAX).
GROUP_BYTES = 2 << 20
GROUP_BYTES_MAX = 64 << 20
GROUPS_BEFORE_GROWTH = 4096

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text alone, whatever other columns the table has."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def group_count(total_bytes: int) -> int:
    """Number of document groups: 2 MiB each, growing to 64 MiB for large corpora."""
    size = min(GROUP_BYTES_MAX, max(GROUP_BYTES, total_bytes // GROUPS_BEFORE_GROWTH))
    return max(1, -(-total_bytes // size))


def group_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n)).cast("int")


def held_out() -> Column:
    """crc32(doc_id as text) mod 5 is 0; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- numpy over Arrow text -------------------------------------------------------

MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = np.uint64(pow(base, filled, 1 << 64))
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


_POWERS: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    if kind not in _POWERS or len(_POWERS[kind]) < n:
        _POWERS[kind] = _powers(_BASE if kind == "up" else _INVERSE, max(n, 1 << 20))
    return _POWERS[kind][:n]


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows on end, and len + 1 offsets; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_binary())
    array = array.cast(pa.large_string()) if pa.types.is_string(array.type) else array
    array = array.cast(pa.large_binary()).fill_null(b"")
    n = len(array)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and len + 1 word offsets."""
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = ~is_space(raw)
    inner = offsets[1:-1]
    begin = word[1:-1] & ~word[:-2]
    begin[inner[inner < len(raw)]] |= word[1:-1][inner[inner < len(raw)]]
    end = word[1:-1] & ~word[2:]
    end[inner[inner > 0] - 1] |= word[1:-1][inner[inner > 0] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: differences of one polynomial prefix sum."""
    n = len(raw)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers("up", n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers("down", n)[starts])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of k tokens from each position (len - k + 1 of them), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, block, width, left = None, 0, h, 1, k
    while left:
        by, own = (np.uint64((pow(_BASE, 2 * width + i, 1 << 64) ^ 0x2545F4914F6CDD1C) | 1) for i in range(2))
        if left & 1:
            part = block[done : done + n]
            out = part if out is None else out * own + part
            done += width
        left >>= 1
        if left:
            block = block[: len(block) - width] * by + block[width:]
            width *= 2
    return mix(out)


def sliding_min(keys: np.ndarray, m: int) -> np.ndarray:
    """Least of m neighbours from each position."""
    out, width = keys, 1
    while width * 2 <= m:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = m - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return base + np.arange(total)
