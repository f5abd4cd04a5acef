"""Vectorised word and shingle hashing over the buffers of Arrow string columns.

Hashes are 64-bit: a word's is a polynomial of its bytes, read off one prefix sum over the whole
buffer, then mixed; a shingle's is a combination of its words' hashes, mixed again.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# An odd base of the polynomial, and the multipliers of the public splitmix64 finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at a time.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def order_within(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by owner (less than 2 ** 16 of them), then value: one fast sort of what fits 64 bits, and a full one if that leaves ties."""
    if len(owner) and owner[-1] >= 1 << 16:
        return np.lexsort((values, owner))
    short = (owner.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16))
    order = np.argsort(short)
    short = short[order]
    tied = np.flatnonzero(short[1:] == short[:-1])
    if len(tied) and (values[order[tied]] != values[order[tied + 1]]).any():
        return np.lexsort((values, owner))
    return order


def release_memory() -> None:
    """Give back what freed arrays still hold: Python workers outlive their tasks and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc
        ctypes.CDLL(None).malloc_trim(0)


#: What empties the caches that an operator keeps in a Python worker from task to task.
CACHES: list = []


def forget() -> None:
    """Empty other operators' caches: a worker goes on to the next stage, and so would they."""
    for clear in CACHES:
        clear()


def tidied(run):
    """run, a function from batches to batches, with memory given back when a task has ended, and that of other operators' caches before."""

    def wrapped(batches):
        forget()
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if large else np.int32
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def words(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and the n + 1 offsets into them by document.

    Works through blocks of about BLOCK bytes, so memory beside the result is bounded but for words longer than that.
    """
    parts, low = [], 0
    while low < len(data):
        high = min(len(data), low + BLOCK)
        while high < len(data) and not _SPACE[data[high]]:
            gap = np.flatnonzero(_SPACE[data[high : high + BLOCK]])
            high = high + int(gap[0]) if len(gap) else min(len(data), high + BLOCK)
        inner = ends[np.searchsorted(ends, low) : np.searchsorted(ends, high)] - low
        h, first, stop = _words_of_block(data[low:high], inner, lower)
        parts.append((h, first + low, stop + low))
        low = high
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(ends), np.int64)
    hashes, first, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, first, stop, np.searchsorted(first, ends)


def _words_of_block(data: np.ndarray, heads: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.ones(len(data) + 2, bool)
    edge[1:-1] = _SPACE[data]
    inside = ~edge[1:-1]
    begins = inside & edge[:-2]
    begins[heads] |= inside[heads]  # a document's first byte begins a word whatever stands before it
    closes = edge[2:].copy()
    closes[:-1] |= begins[1:]
    first, stop = np.flatnonzero(begins), np.flatnonzero(inside & closes) + 1
    low = _LOWER[data] if lower else data
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return mix64((sums[stop] - sums[first]) * powers(INVERSE, len(data))[first] + (stop - first).astype(np.uint64)), first, stop


def slices(texts: pa.Array, most: int = 1 << 22):
    """(first row, rows) of pieces of a column with about `most` bytes each, or one longer text."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i - start
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within each document, and the offsets by document.

    A document with fewer words has one shingle, its whole sequence; one without words has none.
    """
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_at
    multipliers = [np.uint64(m) for m in powers(0xD6E8FEB86659FD93, size + 1)[1:]]
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    rolled = np.zeros(len(hashes), np.uint64)
    for i, m in enumerate(multipliers):
        rolled += padded[i : i + len(hashes)] * m
    owner = np.repeat(np.arange(len(n)), count)
    index = at[:-1][owner] + (np.arange(out_at[-1]) - out_at[owner])
    out = rolled[index]
    for d in np.flatnonzero((n > 0) & (n < size)):
        some = hashes[at[d] : at[d + 1]]
        out[out_at[d]] = (some * np.array(multipliers[: len(some)], np.uint64)).sum(dtype=np.uint64) + np.uint64(len(some))
    return mix64(out), out_at
