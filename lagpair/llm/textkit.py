"""Vectorised text kernels shared by the operators that run on Arrow batches.

Everything here works on the UTF-8 bytes of a whole Arrow string column at
once: no Python string is made for a word. A word's hash is the sum of a mixed
64-bit value for each of its (place, letter) pairs, cut out of prefix sums by one
subtraction. Values of different pairs have nothing to do with each other, so
words of any pattern, such as Thue-Morse words, have equal hashes by chance
alone, with a probability of 2**-64 for two words.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call handles; the temporaries are some twenty times as large. A text over twice this is cut
#: inside where its parts do not meet: its words, grams and ids are those of the parts.
CHUNK_BYTES = 1 << 20
#: Shingle hashes keep so many low bits, which leaves the high ones for a row number.
HASH_BITS = 52
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)


def _lut(predicate) -> np.ndarray:
    return np.array([predicate(b) for b in range(256)], dtype=bool)


#: Bytes of words that white space ends: all but 0x20 and 0x09-0x0D.
SPACED = _lut(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of letters and digits: ASCII alphanumerics and all of a non-ASCII character.
ALNUM = _lut(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Lower-cases A-Z alone.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUE = _BYTE_VALUE[LOWER]


def cache() -> dict:
    """What a process keeps from task to task. It stands in a module of its own, as globals of this one travel with every task."""
    return sys.modules.setdefault("_lagpair_cache", types.ModuleType("_lagpair_cache")).__dict__


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift-multiply, two rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ascending, disjoint runs [start, end) of random letter values, of which none is empty."""
    n = len(values)
    place = np.zeros(n, np.int64)
    place[start] = start
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(n), place, out=place)
    x = place.view(np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x += values
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(x, out=sums[1:])
    return mix(sums[end] - sums[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, rows: int = 2048) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows with at most ``CHUNK_BYTES`` bytes (a longer single row is a slice of its own): first row, end row, bytes, offsets."""
    limit = CHUNK_BYTES
    raw, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    release()


def release() -> None:
    """Gives memory that earlier batches have freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    kept = cache()
    if "trim" not in kept:
        kept["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if kept["trim"] is not None:
        kept["trim"](0)


def parts(raw: np.ndarray, may_cut: np.ndarray) -> list[int]:
    """Ends of the parts of a long text. Each but the last ends before a byte that ``may_cut`` (for each byte) allows, and is
    ``CHUNK_BYTES`` long or, where no such byte is in these, as long as it takes."""
    ends, at, places = [], 0, np.flatnonzero(may_cut)
    while len(raw) - at > CHUNK_BYTES:
        k = int(np.searchsorted(places, at + CHUNK_BYTES, side="right")) - 1
        if k < 0 or places[k] <= at:
            k += 1
        if k >= len(places):
            break
        at = int(places[k])
        ends.append(at)
    return [*ends, len(raw)]


#: Letters and digits of ASCII.
ASCII_ALNUM = _lut(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
ASCII_LETTER = _lut(lambda b: 65 <= b <= 90 or 97 <= b <= 122)


def lone_blanks(raw: np.ndarray, beside: np.ndarray = ASCII_ALNUM) -> np.ndarray:
    """Which bytes are a blank between two bytes of ``beside``."""
    out = raw == 32
    out[1:] &= beside[raw[:-1]]
    out[:-1] &= beside[raw[1:]]
    out[[0, -1]] = False
    return out


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word (A-Z lower-cased), and the word offsets of the rows."""
    if len(raw) <= 2 * CHUNK_BYTES:
        return _words(raw, offsets, inside)
    found, a = [], 0
    for b in parts(raw, ~inside[raw]):
        hashed, start, end, _ = _words(raw[a:b], np.unique(np.clip(offsets - a, 0, b - a)), inside)
        found.append((hashed, start + a, end + a))
        a = b
    hashed, start, end = (np.concatenate(x) for x in zip(*found))
    return hashed, start, end, np.searchsorted(start, offsets)


def _words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    body = inside[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = body.copy()
    first[1:] &= ~body[:-1] | edge[1:-1]
    last = body.copy()
    last[:-1] &= ~body[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return run_hashes(_BYTE_VALUE[raw], start, end), start, end, np.searchsorted(start, offsets)


def word_counts(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> np.ndarray:
    """Number of words of each row."""
    if len(raw) > 2 * CHUNK_BYTES:
        return np.diff(words(raw, offsets, inside)[3])
    body = inside[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    body[1:] &= ~inside[raw[:-1]] | edge[1:-1]
    before = np.concatenate([[0], np.cumsum(body)])[offsets]
    return np.diff(before)


def windows(hashed: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that stay in a row, and the index of each run's first word."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.ones(n, dtype=bool)
    for back in range(1, size):
        near = at[1:-1] - back
        ok[near[(near >= 0) & (near < n)]] = False
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += hashed[k : k + n]
    first = np.flatnonzero(ok)
    return mix(acc[first]), first


def shingle_sets(hashed: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes row by row, ascending in each row, and the rows' offsets among them.

    A row of fewer words than ``size``, but not none, has its whole sequence as its one shingle.
    """
    n = len(at) - 1
    if n > 1 << (64 - HASH_BITS):
        raise ValueError("too many rows for one chunk")
    hashes, first = windows(hashed, at, size)
    row = np.searchsorted(at, first, side="right") - 1
    counts = np.diff(at)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([_sequence(hashed[at[r] : at[r + 1]]) for r in short], dtype=np.uint64)
        hashes, row = np.concatenate([hashes, extra]), np.concatenate([row, short])
    key = (row.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes & HASH_MASK)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(1, n + 1, dtype=np.uint64) << np.uint64(HASH_BITS)) if n < 1 << (64 - HASH_BITS) else None
    if bounds is None:
        bounds = np.append(np.searchsorted(key, np.arange(1, n, dtype=np.uint64) << np.uint64(HASH_BITS)), len(key))
    return key & HASH_MASK, np.concatenate([[0], bounds]).astype(np.int64)


def _sequence(hashes: np.ndarray) -> int:
    acc = 0x5851F42D4C957F2D + len(hashes)
    for h in hashes.tolist():
        acc = ((acc ^ h) * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (1 << 64) - 1
    return int(mix(np.array([acc], dtype=np.uint64))[0])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
