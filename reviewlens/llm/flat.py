"""Flat (structure-of-arrays) views of Arrow text columns for numpy code.

A batch of texts is one byte array plus offsets, so every step below is a whole
array operation; no Python object is made per word or per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a Python worker (a longer single text is handled alone).
CHUNK_BYTES = 4 << 20

MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string/binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large_binary array over existing bytes (no copy)."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
    )


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no piece has much over ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(text_buffer(batch.column(column))[1])
        starts, total = [0], 0
        for i, size in enumerate(lengths.tolist()):
            if total and total + size > limit:
                starts.append(i)
                total = 0
            total += size
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts.

    ``codes``: number of each word in ``unique`` (exact, by Arrow's dictionary);
    ``doc_offsets``: first word of each document, plus the end;
    ``starts``/``lengths``: place in the flat bytes.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, lower: bool = False):
        space = _SPACE[flat]
        first = ~space
        if len(flat):
            cut = np.zeros(len(flat), np.bool_)
            cut[offsets[:-1][offsets[:-1] < len(flat)]] = True
            first[1:] &= space[:-1] | cut[1:]
        self.starts = np.flatnonzero(first)
        solid = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(~space, out=solid[1:])
        word_offsets = np.append(solid[self.starts], solid[-1])
        self.lengths = np.diff(word_offsets)
        kept = flat[~space]
        self.bytes = _LOWER[kept] if lower else kept
        coded = binary_array(self.bytes, word_offsets).dictionary_encode()
        self.codes = np.asarray(coded.indices, dtype=np.int64)
        self.unique = coded.dictionary
        self.doc_offsets = np.searchsorted(self.starts, offsets)

    def unique_hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each unique word."""
        import xxhash

        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(w, seed) for w in self.unique.to_pylist()), np.uint64, len(self.unique))


_FOLD = seeds(64, 11) | np.uint64(1)


def shingle_hashes(words: Words, width: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and their offsets.

    A document of fewer than ``width`` words (one at least) has its whole word
    sequence as its one shingle; one without words has none.
    """
    per_word = words.unique_hashes(seed)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    counts = np.diff(words.doc_offsets)
    n_shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc_of = np.repeat(np.arange(len(counts)), n_shingles)
    starts = ranges(words.doc_offsets[:-1], n_shingles)
    spans = np.minimum(width, counts)[doc_of]
    with np.errstate(over="ignore"):
        value = np.zeros(len(starts), np.uint64)
        for k in range(width):
            inside = k < spans
            at = np.where(inside, starts + k, 0)
            if len(at):
                value += np.where(inside, mix64(per_word[at] ^ _FOLD[k]), np.uint64(0))
        value = mix64(value + spans.astype(np.uint64) * _FOLD[40])
    bounds = np.concatenate(([0], np.cumsum(n_shingles))).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            value[a:b].sort()
    fresh = np.ones(len(value), np.bool_)
    fresh[1:] = (value[1:] != value[:-1]) | (doc_of[1:] != doc_of[:-1])
    value, doc_of = value[fresh], doc_of[fresh]
    return value, np.searchsorted(doc_of, np.arange(len(counts) + 1))


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Tables of whole groups of consecutive equal ``column``, closed once they have ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and size >= limit:
            last = held[-1].column(column)[-1].as_py()
            other = np.flatnonzero(np.asarray(batch.column(column)) != last)
            step = int(other[0]) if len(other) else batch.num_rows
            if step:
                held.append(batch.slice(0, step))
            if not len(other):
                size += batch.nbytes
                continue
            yield pa.Table.from_batches(held)
            held, size, batch = [], 0, batch.slice(step)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def reduce_min(values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """Minimum of each segment; ``empty`` where a segment has nothing."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, offsets[full])
    return out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment (int64)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
