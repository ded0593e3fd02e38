"""Vectorised text primitives on Arrow buffers: whole batches of texts at a time, no per-word Python."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LONG_SPAN = 1024
#: The lowest n bytes of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _range in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"):
    _WORD[list(_range)] = True


def has_word(data: np.ndarray) -> np.ndarray:
    """Per byte: is it part of a word."""
    return _WORD[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` of text each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    first, used = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if used and used + size > most_bytes:
            yield first, i
            first, used = i, 0
        used += size
    if first < len(sizes):
        yield first, len(sizes)


def long_parts(data: np.ndarray, most_bytes: int, after: bytes) -> Iterator[tuple[int, int]]:
    """Byte ranges of a text, none much over ``most_bytes``, each ending after one of the ASCII bytes ``after`` if it has any, else between characters."""
    at = 0
    while at < len(data):
        end = min(at + most_bytes, len(data))
        if end < len(data):
            good = np.flatnonzero(np.isin(data[at:end], np.frombuffer(after, np.uint8)))
            if len(good):
                end = at + int(good[-1]) + 1
            else:
                while end < len(data) and (data[end] & 0xC0) == 0x80:
                    end += 1
        yield at, end
        at = end


def parts(column: pa.Array, after: bytes = b" \n", most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """``slices`` with their texts; a text of over ``most_bytes`` comes as several with the same row range."""
    for a, b in slices(column):
        part = column.slice(a, b - a)
        if b - a > 1 or (pc.binary_length(part)[0].as_py() or 0) <= most_bytes:
            yield a, b, part
            continue
        data, _ = buffers(part)
        for x, y in long_parts(data, most_bytes, after):
            yield a, b, pa.array([data[x:y].tobytes().decode()], column.type)


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together, and where each starts (one more entry than texts). Null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """64-bit hash of each byte span; equal spans hash alike wherever they stand.

    Spans are read eight bytes at a time, all spans that are long enough
    together; the few very long ones are digested one by one.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts

    def read(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        found = eights[at]
        some = np.flatnonzero(left < 8)
        found[some] &= _LOW[left[some]]
        return found

    h = mix(size.astype(U64) * U64(seed) + read(starts, np.minimum(size, 8)))
    more, k = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(more):
        left = size[more] - k
        h[more] = mix(h[more] * U64(0x9E3779B97F4A7C15) + read(starts[more] + k, left))
        more, k = more[left > 8], k + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of marked bytes, within one text."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros(len(inside) + 2, dtype=bool)
    padded[1:-1] = inside
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[padded[cuts] & padded[cuts + 1]])
    if len(cuts):  # texts that meet within a run
        edges = np.sort(np.concatenate((edges, cuts, cuts)))
    return edges[::2], edges[1::2]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of ASCII letters and digits and of any non-ASCII bytes, within one text."""
    return runs(_WORD[data], offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash of every word of the lower-cased texts, where each text's words start, and the number of texts."""
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends = word_spans(data, offsets)
    return span_hash(data, starts, ends), np.searchsorted(starts, offsets), len(column)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and where each text's runs start.

    A text of fewer words has one run of all its words; one without words has none.
    """
    counts = np.diff(firsts)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate(([0], np.cumsum(n)))
    if starts[-1] == 0:
        return np.zeros(0, U64), starts
    which = np.repeat(np.arange(len(counts)), n)
    at = np.arange(starts[-1]) - starts[which] + firsts[which]
    left = firsts[which + 1] - at
    h = np.zeros(len(at), dtype=U64)
    for k in range(width):
        ok = left > k
        h = h * U64(0xC2B2AE3D27D4EB4F) + np.where(ok, words[np.where(ok, at + k, at)], U64(k + 1))
    return mix(h), starts
