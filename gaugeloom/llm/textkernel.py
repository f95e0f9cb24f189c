"""Vectorised kernels over batches of UTF-8 text.

A batch is an Arrow string array; the kernels see its bytes as one numpy array
with document offsets and never loop over characters in Python.  Nulls count as
empty text.  Batches are cut into runs of whole documents of about ``RUN`` bytes
so that the scratch arrays stay bounded (one longer document makes one run).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

RUN = 1 << 20
U64 = np.uint64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Spans of more bytes are hashed one by one.
LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)


def release() -> None:
    """Gives freed memory back to the system; idle Python workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    arr = pc.fill_null(as_array(column).cast(pa.large_string()), "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def runs(buf: np.ndarray, off: np.ndarray, size: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into (first, last, bytes, offsets) of whole documents."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes outside 20 and 09-0D."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off[:-1]] = True
    first[len(buf)] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(off, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    Eight bytes a step are mixed into the state before the next step, so unlike
    a polynomial modulo 2**64 no family of texts collides by its structure.
    """
    size = stops - starts
    state = mix(size.astype(U64) + _TABLE[0])
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[live], size[live]
    while len(live):
        chunk = eight[at] & _MASKS[np.minimum(left, 8)]
        state[live] = mix((state[live] ^ chunk) * _TABLE[1] + _TABLE[2])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        state[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes())
    return state


def word_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z."""
    return span_hashes(LOWER[buf], starts, stops)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct hashes of ``width`` consecutive words.

    With fewer words the whole sequence is one shingle (tagged by its length);
    with none the set is empty.
    """
    starts, stops, doc = word_spans(buf, off)
    words = word_hashes(buf, starts, stops)
    n = len(off) - 1
    bounds = np.searchsorted(doc, np.arange(n + 1))
    rolled = np.zeros(max(0, len(words) - width + 1), U64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _TABLE[k]
    rolled = mix(rolled)
    out = []
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * _TABLE[: b - a]).sum(dtype=U64, keepdims=True)
            out.append(mix(short ^ _TABLE[128 + b - a : 129 + b - a]))
        else:
            out.append(np.zeros(0, U64))
    return out
