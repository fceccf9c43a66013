"""Tables, shared-folder writes and word hashes used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.session import materialise, work_dir

__all__ = ["blank", "combine", "give_back", "materialise", "mix", "read_table", "small_batches", "split_words", "sliding_min", "tidy", "word_hashes", "word_starts", "words_of_texts", "work_dir"]

#: Bytes hashed at a time, few enough for a core's cache; a text of any length needs no more memory and its words.
CHUNK = 1 << 16


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows and bytes handed to a Python worker at a time, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def tidy(work):
    """The same function over batches; each time it ends, its worker gives freed memory back to the system.

    Workers live on for the next stage, and what the allocators keep would add up over an executor's workers.
    """

    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def blank(column: str = "text"):
    """The text as UTF-8 bytes, a null text as none."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one (a multiply and shift finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_CACHE: dict[int, np.ndarray] = {}


def _cached(base: int, n: int) -> np.ndarray:
    have = _CACHE.get(base)
    if have is None or len(have) < n:
        have = _CACHE[base] = _powers(base, max(n, 1024))
    return have[:n]


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _sums_of_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the running sums that any stretch's hash comes from."""
    raw = np.frombuffer(piece, dtype=np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[raw] * _cached(_BASE, len(raw)), out=total[1:])
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1), total


def _hash_piece(piece: bytes) -> np.ndarray:
    start, end, total = _sums_of_piece(piece)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    length = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * _cached(_INVERSE, len(piece))[start] + mix(length))


def _starts_of_piece(piece: bytes, sizes: tuple[int, ...]) -> np.ndarray:
    start, end, total = _sums_of_piece(piece)
    out = [np.empty(0, dtype=np.uint64)]
    for k in sizes:
        at = start[end - start >= k]
        out.append(mix((total[at + k] - total[at]) * _cached(_INVERSE, len(piece))[at] + np.uint64(k)))
    return np.concatenate(out)


def _pieces(data: bytes):
    """``data`` cut at spaces into stretches of about ``CHUNK`` bytes."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, in order; equal words, equal hashes."""
    if len(data) <= CHUNK:
        return _hash_piece(data)
    return np.concatenate([_hash_piece(p) for p in _pieces(data)])


def word_starts(data: bytes, sizes: tuple[int, ...]) -> np.ndarray:
    """One 64-bit hash for the first k bytes of each word that has as many, for each k of ``sizes``; equal starts, equal hashes."""
    return np.concatenate([np.empty(0, dtype=np.uint64), *[_starts_of_piece(p, sizes) for p in _pieces(data)]])


def words_of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the number of words of each."""
    data = b" ".join(texts)
    hashes = word_hashes(data)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.zeros(len(texts), dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(raw), 1 << 20):
        blank_ = _SPACE[raw[max(0, at - 1):at + (1 << 20)]]
        begins = np.flatnonzero(blank_[:-1] & ~blank_[1:]) + max(1, at) if at else np.concatenate((np.zeros(int(not blank_[0]), dtype=np.int64), np.flatnonzero(blank_[:-1] & ~blank_[1:]) + 1))
        counts += np.bincount(np.searchsorted(starts, begins, side="right") - 1, minlength=len(texts))
    return hashes, counts


def split_words(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes; ``bytes.split`` parts at exactly the six ASCII space characters."""
    return data.split()


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _cached(_BASE, len(words)), out=total[1:])
    return mix((total[k:] - total[:n]) * _cached(_INVERSE, n) + np.uint64(k))


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """Smallest of each run of ``k`` values, by doubling."""
    width, out = 1, values
    while width * 2 <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:len(values) - k + 1], out[k - width:k - width + len(values) - k + 1])
