"""Vectorised hashing of words and byte strings held in Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random code for each byte value, and the odd base of the polynomial hashes modulo 2**64.
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes that belong to words: ASCII letters and digits and everything outside ASCII.
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Bytes hashed at a time; bounds the memory of one step.
STEP = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, STEP + 1), base, np.uint64)
        grown[0] = 1
        _powers[base] = have = np.cumprod(grown, dtype=np.uint64, out=grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash can be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] equal to the sum of code(data[k]) * BASE**k over i <= k < j."""
    out, scale = np.zeros(len(data) + 1, np.uint64), powers(BASE, len(data))
    for i in range(0, len(data), STEP):
        part = CODES[data[i : i + STEP]]
        part *= scale[i : i + STEP]
        np.cumsum(part, dtype=np.uint64, out=out[i + 1 : i + 1 + len(part)])
        out[i + 1 : i + 1 + len(part)] += out[i]
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends]; both ascending, the spans disjoint."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + STEP, "right")))
        s, e = starts[i:j] - lo, ends[i:j] - lo
        sums = prefix_hashes(data[lo : int(ends[j - 1])])
        out[i:j] = mix((sums[e] - sums[s]) * powers(INVERSE, int(s[-1]) + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets into them; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = STEP // 2) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or one row where a single row is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def give_back() -> None:
    """Memory that is free goes back to the system: Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at the end of its task it gives memory back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def returning_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run``, and after each group it gives memory back."""

    def tidy(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    return tidy


def returning_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``run``, and after each pair of groups it gives memory back."""

    def tidy(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return tidy


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each row the index of its first word (n + 1 of them). Words don't cross rows."""
    starts, ends = word_spans(data, offsets)
    return spans(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; one hash of all words where there are fewer (none for no words)."""
    n = len(word_hashes)
    size = min(size, n)
    if not size:
        return word_hashes
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + word_hashes[k : n - size + 1 + k]
    return mix(total)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it. Words don't cross rows."""
    inside = WORD[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        at = offsets[:-1][offsets[:-1] < len(data)]
        before[at] = False
        after[at[at > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of the first ``lengths`` bytes of those that are as long: (word index, hash)."""
    index, hashes = [], []
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + STEP, "right")))
        s, e, at = starts[i:j] - lo, ends[i:j] - lo, np.arange(i, j)
        sums, back = prefix_hashes(data[lo : int(ends[j - 1])]), powers(INVERSE, int(s[-1]) + 1)
        for k in (None, *lengths):
            long = slice(None) if k is None else e - s >= k
            b, size = s[long], (e - s)[long] if k is None else np.full(int(long.sum()), k)
            index.append(at[long])
            hashes.append(mix((sums[b + size] - sums[b]) * back[b] + size.astype(np.uint64) + np.uint64((k or 0) << 32)))
        i = j
    return (np.concatenate(index), np.concatenate(hashes)) if index else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
