"""Vectorised text primitives over concatenated UTF-8 bytes (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A word is a maximal run of bytes other than these six.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
WORD = r"[^\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
#: Bytes of letters: those of ASCII and of all code points beyond it.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_MIX1, _MIX2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_UNMIX1, _UNMIX2 = (_U(pow(int(m), -1, 2**64)) for m in (_MIX1, _MIX2))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """The value that mix() turned into x."""
    x = x ^ (x >> _U(31)) ^ (x >> _U(62))
    x *= _UNMIX2
    x ^= (x >> _U(27)) ^ (x >> _U(54))
    x *= _UNMIX1
    x ^= (x >> _U(30)) ^ (x >> _U(60))
    return x


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(x * _STEP + (y ^ _MIX1))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, inner: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word (of bytes that ``inner`` marks), and for each text the number of words before it (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = inner[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte slices [start, end)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    size = np.minimum(left, 8).astype(np.uint64)
    keep = np.where(size == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (size * _U(8))) - _U(1))
    out = mix((at[starts] & keep) + mix(left.astype(np.uint64) + _U(seed * 2 + 1)))
    more = np.flatnonzero(left > 8)
    step = 8
    while len(more):
        rest = left[more] - step
        size = np.minimum(rest, 8).astype(np.uint64)
        keep = np.where(size == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (size * _U(8))) - _U(1))
        out[more] = pair(out[more], at[starts[more] + step] & keep)
        step += 8
        more = more[rest > 8]
    return out


def doubled(hashes: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of windows of want elements (want <= 2 * have) from those of have, by overlap of two."""
    shift = want - have
    return pair(hashes[: len(hashes) - shift], hashes[shift:]) if len(hashes) > shift else hashes[:0]


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive items (n - width + 1 of them)."""
    have = 1
    while have < width:
        want = min(width, 2 * have)
        items = doubled(items, have, want)
        have = want
    return items


def _runs_mask(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n items are in one of the runs [start, end), which don't overlap; two bytes an item."""
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def window_ok(offsets: np.ndarray, width: int) -> np.ndarray:
    """For each of n - width + 1 windows over items, whether it lies in one text."""
    n = int(offsets[-1])
    if n < width:
        return np.zeros(0, dtype=bool)
    some = np.flatnonzero(np.diff(offsets))
    # A window that starts in a text's last width - 1 items runs out of it.
    return ~_runs_mask(np.maximum(offsets[some], offsets[some + 1] - width + 1), offsets[some + 1], n)[: n - width + 1]


def leftmost_min(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes, the position of its least value's upper half, leftmost on ties."""
    packed = (hashes >> _U(32) << _U(32)) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < width:
        shift = min(width - have, have)
        packed = np.minimum(packed[: len(packed) - shift], packed[shift:])
        have += shift
    return (packed & _U(0xFFFFFFFF)).astype(np.int64)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items a window [start, start + width) covers."""
    starts = np.sort(starts)
    if not len(starts):
        return np.zeros(n, dtype=bool)
    apart = starts[1:] > starts[:-1] + width
    return _runs_mask(starts[np.concatenate([[True], apart])], starts[np.concatenate([apart, [True]])] + width, n)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... (size of them) for each pair."""
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if total else np.zeros(0, np.int64)


def by_bytes(batches, column: int, most: int = 8 << 20):
    """The batches cut into slices of about ``most`` bytes of text in a column, one row at least."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """The slices of data end to end; indices are made for about ``step`` items at a time."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    at = 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + step, side="right")))
        out[done : int(ends[to - 1])] = data[ranges(starts[at:to], sizes[at:to])]
        at = to
    return out
