"""Whole Arrow batches of texts as NumPy arrays: bytes, words and 64-bit hashes of word runs."""

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step handles; a longer text makes a step of its own. The arrays of a step
#: take some hundred times as much.
STEP_BYTES = 1 << 18
#: Bytes from which on a word gets a digest instead of run_hashes: long enough for the sums modulo
#: 2**64 of some regular patterns to cancel (from 1,024 elements on), too long for common words.
LONG_WORD = 128

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """run, whose worker gives free memory back to the system once a task ends: workers outlive their
    tasks, and what they keep would add to the needs of the next stage's."""

    @functools.wraps(run)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return each


def release() -> None:
    """Gives free memory of Arrow's pool and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


U = np.uint64
_ODD, _ODD2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> U(32))
    h = h * _ODD2
    h = h ^ (h >> U(29))
    h = h * _ODD
    return h ^ (h >> U(32))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("p", ())) < n:
        base, size = 0xD6E8FEB86659FD93, max(n, 1 << 16)
        for key, b in (("p", base), ("q", pow(base, -1, 1 << 64))):
            x = np.full(size, b, U)
            x[0] = U(1)
            _powers[key] = np.cumprod(x, dtype=U)
    return _powers["p"][:n], _powers["q"][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[starts:ends] for each pair; equal runs have equal hashes. Runs are to be
    shorter than 1,024 elements: patterns of that length and more can cancel."""
    if not len(starts):
        return np.zeros(0, U)
    p, q = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[:-1], dtype=U, out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U) * _ODD)


_byte_values = mix(np.arange(1, 257, dtype=U) * _ODD)
_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some rows: byte ranges, first word of each row, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        data = _lower[data] if lower else data
        n = len(data)
        blank = _space[data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:n] = blank[: max(0, n - 1)]
        before[offsets[:-1]] = True
        after[: max(0, n - 1)] = blank[1:]
        after[offsets[1:] - 1] = True
        self.data = data
        self.starts = np.flatnonzero(~blank & before[:n])
        self.ends = np.flatnonzero(~blank & after[:n]) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each row, and the total
        self.counts = np.diff(self.first)
        self.hashes = run_hashes(_byte_values[data], self.starts, self.ends)
        for k in np.flatnonzero(self.ends - self.starts > LONG_WORD):
            digest = hashlib.blake2b(data[self.starts[k] : self.ends[k]].tobytes(), digest_size=8).digest()
            self.hashes[k] = int.from_bytes(digest, "little")

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each start on, row of each start) for all starts of whole windows."""
        n = np.maximum(self.counts - k + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[row]
        return run_hashes(self.hashes, at, at + k), row


def each_step(batch: pa.RecordBatch, column: int, lower: bool) -> Iterator[tuple[int, int, Words]]:
    data, offsets = raw(batch.column(column))
    for a, b in steps(offsets):
        at = offsets[a : b + 1]
        yield a, b, Words(data[at[0] : at[-1]], at - at[0], lower)


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... of all runs, one after the other."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
