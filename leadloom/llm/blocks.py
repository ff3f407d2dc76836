"""Array helpers for tasks that work on the UTF-8 bytes of a whole Arrow batch.

Texts arrive as one byte buffer with offsets.  A span of bytes is hashed eight
bytes at a time through a mixer, so no algebra of the bytes carries over to the
hash; spans over LONG_SPAN bytes go to xxHash.  Where equal hashes stand for
equal bytes, ``distinct_spans`` compares the bytes too.  All constants derive
from fixed seeds: every task and every run hashes alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64

#: Separators of words: space and the control characters 9 to 13.
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string or binary column; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def document_blocks(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer document is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(rows, max(stop, row + 1))
        yield row, stop
        row = stop


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, those behind the end 0; taken by index only."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: Masks that leave the first k bytes of a lane.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of every span from start to stop."""
    size = stop - start
    out = mix(size.astype(U) * BASE + U(seed * 0xD1B54A32D192ED03 % 2**64) + U(1))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    eight, at = lanes(data), start[live].astype(np.int64)
    left = size[live]
    while len(live):
        lane = eight[at] & FIRST_BYTES[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ lane) * U(0x9FB21C651E98DF25) + BASE)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(start[long].tolist(), stop[long].tolist())), U, len(long))
    return out


def equal_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray, other_start: np.ndarray, other_stop: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the other one."""
    size = stop - start
    out = size == other_stop - other_start
    live = np.flatnonzero(out & (start != other_start) & (size <= LONG_SPAN))
    eight, a, b, left = lanes(data), start[live].astype(np.int64), other_start[live].astype(np.int64), size[live]
    while len(live):
        mask = FIRST_BYTES[np.minimum(left, 8)]
        same = (eight[a] & mask) == (eight[b] & mask)
        out[live[~same]] = False
        more = same & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    for k in np.flatnonzero(out & (start != other_start) & (size > LONG_SPAN)).tolist():
        out[k] = np.array_equal(data[start[k] : stop[k]], data[other_start[k] : other_stop[k]])
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each distinct span, and which distinct one each span is; bytes are compared, not hashes alone."""
    seed = 0
    while True:
        _, first, which = np.unique(span_hashes(data, start, stop, seed), return_index=True, return_inverse=True)
        if not len(start) or equal_spans(data, start, stop, start[first][which], stop[first][which]).all():
            return first, which
        seed += 1


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every word, and each document's first word number (one more than documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lowered if asked) and each document's first word number."""
    start, stop, at = find_words(data, offsets)
    return span_hashes(TO_LOWER[data] if lower else data, start, stop), at


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Mixed hash of the n consecutive entries from each place (those near the end run short and are left out)."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, U)
    for k in range(n):
        out = out * BASE + hashes[k : k + m]
    return mix(out)
