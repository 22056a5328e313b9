"""Text, hash and key functions."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERSENNE = (1 << 61) - 1
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
DIMENSIONS = 256


def fold_space(text: Column) -> Column:
    """Lower case, white space folded to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


class Grams:
    """Character k-grams of a batch of folded texts as numbers: distinct within each text, sorted.

    Characters are numbered by the batch's own alphabet, so that a gram is one word
    (a pair of words where the alphabet is too large for that).
    """

    def __init__(self, texts: list[str], k: int = 5):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.alphabet, code = np.unique(points, return_inverse=True)
        self.k, self.bits = k, max(1, int(len(self.alphabet)).bit_length())
        # short texts are one gram of their own length, filled up with zeros
        counts = np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0)
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(texts)), counts)
        first = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + (ends - sizes)[doc]
        word = 64 // self.bits
        self.words = -(-k // word)
        keys = [np.zeros(len(first), np.uint64) for _ in range(self.words)]
        for i in range(k):
            inside = first + i < ends[doc]
            at = np.where(inside, first + i, 0)
            value = np.where(inside, code[at].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(code) else keys[0]
            keys[i // word] |= value << np.uint64(self.bits * (i % word))
        if self.words == 1:
            bounds = np.concatenate(([0], np.cumsum(counts))).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                keys[0][a:b].sort()
        else:
            order = np.lexsort((*keys[::-1], doc))
            keys, doc = [x[order] for x in keys], doc[order]
        fresh = np.ones(len(doc), np.bool_)
        fresh[1:] = np.logical_or.reduce([doc[1:] != doc[:-1], *(x[1:] != x[:-1] for x in keys)])
        self.keys = np.column_stack([x[fresh] for x in keys])
        self.offsets = np.searchsorted(doc[fresh], np.arange(len(texts) + 1))

    def unique(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the batch's distinct grams (0: none), and the number of each text's grams among them."""
        keys, inverse = np.unique(self.keys, axis=0, return_inverse=True) if self.words > 1 else np.unique(self.keys[:, 0], return_inverse=True)
        keys = keys.reshape(len(keys), self.words)
        table, word, mask = np.append(np.uint32(0), self.alphabet), 64 // self.bits, np.uint64((1 << self.bits) - 1)
        points = [table[(keys[:, i // word] >> np.uint64(self.bits * (i % word)) & mask).astype(np.int64)] for i in range(self.k)]
        return np.column_stack(points) if len(keys) else np.zeros((0, self.k), np.uint32), inverse.reshape(-1)


def fnv1a64_points(points: np.ndarray) -> np.ndarray:
    """64-bit FNV-1a of the UTF-8 bytes of rows of code points; zeros at a row's end stand for nothing."""
    h = np.full(len(points), FNV_BASIS, np.uint64)
    with np.errstate(over="ignore"):
        for c in points.T.astype(np.uint64):
            size = 1 + (c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000)
            for j in range(4):
                live = np.flatnonzero((j < size) & (c > 0))
                shift = 6 * (size[live] - 1 - j).astype(np.uint64)
                lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint64)[size[live]] if j == 0 else np.uint64(0x80)
                byte = lead | (c[live] >> shift & np.where(j == 0, np.uint64(0x7F), np.uint64(0x3F)))
                h[live] = (h[live] ^ byte) * np.uint64(FNV_PRIME)
    return h


#: Characters of texts whose grams are made at once.
CHARACTERS = 1 << 21


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about ``CHARACTERS`` (a longer text is a run of its own), which bounds the memory that grams take."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHARACTERS:
            yield texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield texts[first:]


@F.pandas_udf(T.LongType())
def shingle_count(folded: pd.Series) -> pd.Series:
    """Distinct shingles of folded texts (an empty text has one, itself); null for null."""
    there = folded.notna().to_numpy()
    counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(Grams(x).offsets) for x in pieces(folded[there].tolist()))])
    out = pd.Series([None] * len(folded), dtype=object)
    out[there] = np.maximum(counts, 1)
    return out


#: Base and modulus of the numbers that ``shingle_digest`` adds up.
DIGEST_BASE, DIGEST_MODULUS = 1_000_003, 2_147_483_647


@F.pandas_udf(T.LongType())
def shingle_digest(folded: pd.Series) -> pd.Series:
    """Sum over the distinct shingles of folded texts of their code points as digits of a number (first lowest), modulo a prime; null for null."""
    there = folded.notna().to_numpy()
    sums = [np.zeros(0, np.int64)]
    for piece in pieces(folded[there].tolist()):
        grams = Grams(piece)
        points, inverse = grams.unique()
        value = np.zeros(len(points), np.uint64)
        for column in points.T[::-1]:
            value = (value * np.uint64(DIGEST_BASE) + column) % np.uint64(DIGEST_MODULUS)
        total = np.concatenate(([0], np.cumsum(value[inverse].astype(np.int64))))
        sums.append(total[grams.offsets[1:]] - total[grams.offsets[:-1]])
    out = pd.Series([None] * len(folded), dtype=object)
    out[there] = np.concatenate(sums)
    return out


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct character k-grams of the folded text; the text itself if it has at most k characters."""
    t = fold_space(text)
    # neighbours come from shifted copies of the character array: a substring by place would walk the text each time
    c = F.split(t, "")
    shifted = [F.slice(c, i + 1, F.greatest(F.length(t), F.lit(1))).alias(f"c{i}") for i in range(k)]
    whole = F.filter(F.arrays_zip(*shifted), lambda x: x[f"c{k - 1}"].isNotNull())
    grams = F.transform(whole, lambda x: F.concat(*[x[f"c{i}"] for i in range(k)]))
    return F.when(text.isNotNull(), F.when(F.length(t) <= k, F.array(t)).otherwise(F.array_distinct(grams)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def terms(text: Column) -> Column:
    """Tokens, then pairs of neighbours."""

    def both(t: Column) -> Column:
        pairs = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)

    # the lambda binds the tokens, so that they are found once
    return F.get(F.transform(F.array(tokens(text)), both), 0)


def fnv1a64_of(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a64_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many strings: one vector step for each byte place."""
    n = len(values)
    sizes = np.fromiter(map(len, values), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(values), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    ordered = sizes[order]
    h = np.full(n, FNV_BASIS, np.uint64)
    with np.errstate(over="ignore"):
        for place in range(int(ordered[0]) if n else 0):
            live = int(np.searchsorted(-ordered, -place, "left"))
            h[:live] = (h[:live] ^ flat[starts[:live] + place]) * np.uint64(FNV_PRIME)
    out = np.empty(n, np.uint64)
    out[order] = h
    return out


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a64(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes, as an unsigned number."""
    from decimal import Decimal

    there = text.notna()
    hashes = fnv1a64_many([t.encode() for t in text[there]])
    out = pd.Series([None] * len(text), dtype=object)
    out[there.to_numpy()] = [Decimal(int(h)) for h in hashes]
    return out


def coefficients(n: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs (a >= 1, b) under 2^61 - 1, from SHA-256 of their number."""
    draw = lambda tag, i: int.from_bytes(hashlib.sha256(f"{i}:{tag}".encode()).digest()[:8], "big") % MERSENNE
    return np.array([max(1, draw("a", i)) for i in range(n)], np.uint64), np.array([draw("b", i) for i in range(n)], np.uint64)


def read_coefficients(text: str, most: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) from a JSON list of pairs of decimal strings, for signatures that others must be able to compare."""
    pairs = [(int(a), int(b)) for a, b in json.loads(text)]
    if not 0 < len(pairs) <= most or any(not 0 < a < MERSENNE or not 0 <= b < MERSENNE for a, b in pairs):
        raise ValueError(f"coefficients must be 1 to {most} pairs below 2^61 - 1")
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


def mulmod(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """a * h mod 2^61 - 1 on unsigned 64-bit words, by halves."""
    low32, m = np.uint64(0xFFFFFFFF), np.uint64(MERSENNE)
    a1, a0 = a >> np.uint64(32), a & low32
    h1, h0 = h >> np.uint64(32), h & low32
    mid = a1 * h0 + a0 * h1  # under 2^62
    low = a0 * h0
    # 2^64 = 8 and 2^61 = 1 (mod m); the sum is under 2^63
    return _reduced((a1 * h1 << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (low >> np.uint64(61)) + (low & m))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x mod 2^61 - 1 by shifts: what is over comes round, and what wraps below zero isn't the smaller."""
    m = np.uint64(MERSENNE)
    x = (x & m) + (x >> np.uint64(61))
    with np.errstate(over="ignore"):
        return np.minimum(x, x - m)


def minhash_of(hashes: np.ndarray, n: int = 128, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """MinHash signature of element hashes, by ``pairs`` of coefficients or the derived ones."""
    a, b = coefficients(n) if pairs is None else pairs
    h, out = _reduced(hashes), np.full(len(a), MERSENNE, np.uint64)
    low32, low29, m = np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1), np.uint64(MERSENNE)
    a1, a0 = (a >> np.uint64(32))[:, None], (a & low32)[:, None]
    # the steps of ``mulmod`` for all pairs at once, over as many hashes as stay in a core's cache
    for first in range(0, len(h), 128):
        h1, h0 = h[first : first + 128] >> np.uint64(32), h[first : first + 128] & low32
        mid = a1 * h0
        part = a0 * h1
        mid += part
        total = (a1 << np.uint64(3)) * h1
        total += b[:, None]
        total += np.right_shift(mid, np.uint64(29), out=part)
        mid &= low29
        mid <<= np.uint64(32)
        total += mid
        np.multiply(a0, h0, out=mid)
        total += np.right_shift(mid, np.uint64(61), out=part)
        mid &= m
        total += mid  # under 2^64
        np.right_shift(total, np.uint64(61), out=part)
        total &= m
        total += part
        np.subtract(total, m, out=part)
        np.minimum(total, part, out=total)
        np.minimum(out, total.min(axis=1), out=out)
    return out


def _permuted(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * h + b mod 2^61 - 1 of reduced h (columns) for each pair (rows), in steps that stay in a core's cache."""
    out = np.empty((len(a), len(h)), np.uint64)
    a, b = a[:, None], b[:, None]
    for first in range(0, len(h), 2048):
        at = slice(first, first + 2048)
        out[:, at] = _reduced(mulmod(a, h[None, at]) + b)
    return out


def minhash_many(hashes: np.ndarray, inverse: np.ndarray, offsets: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """``minhash_of`` of many sets, a row each: set i holds ``hashes[inverse[offsets[i]:offsets[i + 1]]]``.

    Each distinct hash is permuted once.  Of a set with m elements the least value is
    nearly always among the 12 m-ths of all values at most, so only the sets that hold
    such a hash are looked at; a set without one is looked through whole, as are small ones.
    """
    a, b = coefficients() if pairs is None else pairs
    sizes = np.diff(offsets)
    out = np.full((len(a), len(sizes)), MERSENNE, np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kind = np.zeros(len(sizes), np.int64)
    kind[sizes > 0] = np.log2(sizes[sizes > 0]).astype(np.int64)
    classes = []
    small = np.flatnonzero((kind < 7) & (sizes > 0))
    few = inverse[np.flatnonzero((kind < 7)[doc])]
    begin = np.cumsum(sizes[small]) - sizes[small]
    for k in np.unique(kind[kind >= 7]).tolist():
        at = np.flatnonzero((kind == k)[doc])
        at = at[np.argsort(inverse[at], kind="stable")]
        classes.append((min(MERSENNE, 12 * (MERSENNE >> k)), doc[at], np.searchsorted(inverse[at], np.arange(len(hashes) + 1))))
    h = _reduced(hashes)
    for first in range(0, len(a), 4):
        for j, values in enumerate(_permuted(h, a[first : first + 4], b[first : first + 4]), first):
            if len(small):
                out[j, small] = np.minimum.reduceat(values[few], begin)
            low = np.flatnonzero(values < classes[0][0]) if classes else None
            for limit, owners, starts in classes:
                low = low[values[low] < limit]
                n = starts[low + 1] - starts[low]
                place = np.arange(int(n.sum())) + np.repeat(starts[low] - (np.cumsum(n) - n), n)
                np.minimum.at(out[j], owners[place], np.repeat(values[low], n))
            for i in np.flatnonzero((out[j] == MERSENNE) & (sizes > 0)).tolist():
                out[j, i] = values[inverse[offsets[i] : offsets[i + 1]]].min()
    return out.T


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(sets: pd.Series) -> pd.Series:
    """MinHash signature (128 numbers under 2^61 - 1) of each set of strings; null for null or empty sets."""
    out = []
    for s in sets:
        out.append(None if s is None or not len(s) else minhash_of(fnv1a64_many([x.encode() for x in s])).astype(np.int64))
    return pd.Series(out)


def signature(folded: Column, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> Column:
    """``minhash`` of the shingles of folded texts, without making the shingles; null for null."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna().to_numpy()
        made = []
        for piece in pieces(texts[there].tolist()):
            grams = Grams(piece)
            points, inverse = grams.unique()
            hashes = fnv1a64_points(points)
            rows = minhash_many(hashes, inverse, grams.offsets, pairs)
            rows[np.diff(grams.offsets) == 0] = minhash_of(np.array([FNV_BASIS], np.uint64), pairs=pairs)
            made += list(rows.astype(np.int64))
        out = pd.Series([None] * len(texts), dtype=object)
        out[there] = pd.Series(made, index=out.index[there], dtype=object)
        return out

    return run(folded)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


@F.pandas_udf(T.MapType(T.IntegerType(), T.IntegerType()))
def hashed_terms(terms_: pd.Series) -> pd.Series:
    """Signed feature hashing: bucket -> sum of signs (sums of 0 stay)."""
    out = []
    for row in terms_:
        if row is None:
            out.append(None)
            continue
        counts: dict[int, int] = {}
        for h in fnv1a64_many([t.encode() for t in row]).tolist():
            bucket = h % DIMENSIONS
            counts[bucket] = counts.get(bucket, 0) + (-1 if h >> 63 else 1)
        out.append(dict(sorted(counts.items())))
    return pd.Series(out)


def _fnv_on(state: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a states after the bytes ``flat[starts:starts + sizes]`` of each row."""
    order = np.argsort(-sizes, kind="stable")
    ordered, first, h = sizes[order], starts[order], state[order]
    with np.errstate(over="ignore"):
        for place in range(int(ordered[0]) if len(order) else 0):
            live = int(np.searchsorted(-ordered, -place, "left"))
            h[:live] = (h[:live] ^ flat[first[:live] + place]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


#: Tokens of texts whose terms are hashed at once.
TOKENS = 1 << 18


def with_hashed_terms(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``hashed_terms`` of the terms of a text column, in flat arrays.

    Only tokens go to Python; a pair's hash goes on from that of its first word.
    """
    source = rows.withColumn("_tokens", tokens(F.col(text)))
    out = T.StructType([*rows.schema.fields, T.StructField(name, T.MapType(T.IntegerType(), T.IntegerType()))])
    kind = pa.map_(pa.int32(), pa.int32())

    def counted(lists: pa.Array) -> pa.Array:
        offsets = np.asarray(lists.offsets, np.int64)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.large_binary())
        offsets = offsets - offsets[0]
        n, at = len(lists), np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        flat = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] is not None else np.zeros(0, np.uint8)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        one = _fnv_on(np.full(len(words), FNV_BASIS, np.uint64), flat, at[:-1], np.diff(at))
        left = np.flatnonzero(doc[1:] == doc[:-1])
        with np.errstate(over="ignore"):
            joint = (one[left] ^ np.uint64(0x20)) * np.uint64(FNV_PRIME)
        two = _fnv_on(joint, flat, at[left + 1], np.diff(at)[left + 1])
        h, owner = np.concatenate((one, two)), np.concatenate((doc, doc[left]))
        cell = owner * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64)
        total = np.bincount(cell, weights=np.where(h >> np.uint64(63), -1, 1), minlength=n * DIMENSIONS)
        there = np.flatnonzero(np.bincount(cell, minlength=n * DIMENSIONS))
        bounds = np.searchsorted(there, np.arange(n + 1) * DIMENSIONS)
        maps = pa.MapArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(there % DIMENSIONS, pa.int32()), pa.array(total[there].astype(np.int64), pa.int32()))
        valid = np.asarray(lists.is_valid())
        return maps if valid.all() else pa.array([m if v else None for m, v in zip(maps.to_pylist(), valid.tolist(), strict=True)], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(np.diff(np.asarray(batch.column("_tokens").offsets, np.int64)))
            cuts = np.unique(np.concatenate(([0], np.searchsorted(sizes, np.arange(TOKENS, int(sizes[-1]) if len(sizes) else 0, TOKENS), "right"), np.arange(0, batch.num_rows, 1024), [batch.num_rows])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counted(part.column("_tokens"))], names=[*part.schema.names[:-1], name])

    return source.mapInArrow(run, out)


def pack_terms(rows: np.ndarray) -> list[bytes]:
    """Vectors of whole numbers (rows of 256) as bytes: the planes of as many bits as the row's largest number needs."""
    zigzag = np.where(rows < 0, -2 * rows - 1, 2 * rows).astype(np.uint32)
    width = np.maximum(1, np.ceil(np.log2(zigzag.max(axis=1, initial=0) + 1.0))).astype(np.int64)
    bits = np.packbits((zigzag[:, None, :] >> np.arange(int(width.max(initial=1)), dtype=np.uint32)[None, :, None] & np.uint32(1)).astype(np.uint8), axis=2)
    return [bits[i, :w].tobytes() for i, w in enumerate(width.tolist())]


def unpack_terms(packed: list[bytes]) -> np.ndarray:
    """The vectors of ``pack_terms``."""
    out = np.empty((len(packed), DIMENSIONS), np.int64)
    sizes = np.fromiter(map(len, packed), np.int64, len(packed))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        planes = np.unpackbits(np.frombuffer(b"".join([packed[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, DIMENSIONS // 8), axis=2)
        zigzag = np.zeros((len(at), DIMENSIONS), np.int64)
        for w in range(planes.shape[1]):
            zigzag |= planes[:, w].astype(np.int64) << w
        out[at] = np.where(zigzag & 1, -(zigzag + 1) // 2, zigzag // 2)
    return out


def with_packed_terms(rows: DataFrame, text: str, name: str, *keys: str) -> DataFrame:
    """keys and ``name``: the vector of ``hashed_terms`` of a text column, packed; texts whose vector is zero are left out."""
    fields = [f for f in rows.schema.fields if f.name in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = batch.column(batch.num_columns - 1)
            sizes = np.diff(np.asarray(maps.offsets, np.int64))
            first, last = maps.offsets[0].as_py(), maps.offsets[len(maps)].as_py()
            dense = np.zeros((len(maps), DIMENSIONS), np.int64)
            dense[np.repeat(np.arange(len(maps)), sizes), maps.keys[first:last].to_numpy()] = maps.items[first:last].to_numpy()
            there = np.flatnonzero(dense.any(axis=1))
            own = batch.select(range(batch.num_columns - 1)).take(pa.array(there))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pack_terms(dense[there]), pa.binary())], names=[*own.schema.names, name])

    terms_ = with_hashed_terms(rows.select(*[f.name for f in fields], text).where(F.col(text).isNotNull()), text, "_h").drop(text)
    return terms_.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.BinaryType())]))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two maps bucket -> count."""
    return F.aggregate(F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0))), F.lit(0), lambda s, x: s + x)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embedding(terms_: pd.Series) -> pd.Series:
    """Unit vector of the signed hashed terms; null if it is zero."""
    out = []
    for row in terms_:
        vector = np.zeros(DIMENSIONS)
        if row is not None and len(row):
            h = fnv1a64_many([t.encode() for t in row])
            np.add.at(vector, (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0))
        norm = np.sqrt(vector @ vector)
        out.append(list(vector / norm) if norm else None)
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def fnv1a32(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a over UTF-16 units; null for null."""
    there = text.notna().to_numpy()
    rows = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32) for t in text[there]]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    starts, ordered = (np.cumsum(sizes) - sizes)[order], sizes[order]
    h = np.full(len(rows), 0x811C9DC5, np.uint32)
    with np.errstate(over="ignore"):
        for place in range(int(ordered[0]) if len(rows) else 0):
            live = int(np.searchsorted(-ordered, -place, "left"))
            h[:live] = (h[:live] ^ flat[starts[:live] + place]) * np.uint32(0x01000193)
    values = np.empty(len(rows), np.int64)
    values[order] = h
    out = pd.Series([None] * len(text), dtype=object)
    out[there] = values
    return out


def base36(number: Column, digits: int = 8) -> Column:
    """Base-36 digits, padded, lower case."""
    return F.lower(F.lpad(F.conv(number.cast("string"), 10, 36), digits, "0"))


def serial(text: Column) -> Column:
    """A readable serial XXXX-XXXX of a text."""
    d = F.upper(base36(fnv1a32(text)))
    return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 4))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode normal form KC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(texts: pd.Series) -> pd.Series:
    """Unicode normal form KC of each text of an array."""
    return texts.map(lambda row: None if row is None else [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in row])


def category_slug(segment: Column) -> Column:
    """Lower-case letters, digits and marks; runs of anything else become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(segment), r"[^\p{L}\p{N}\p{M}]+", "-"), "^-+|-+$", "")


def category_keys(trail: Column) -> Column:
    """Slugs of a breadcrumb, narrowest first, distinct, none empty."""
    parts = F.transform(nfkc_each(F.split(trail, r"[>›»→/|\n]+")), category_slug)
    return F.array_distinct(F.reverse(F.filter(parts, lambda s: s != "")))


def csv_field(value: Column) -> Column:
    """A CSV field: formulas disarmed by a leading quote, quoted where needed."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def escape_html(value: Column) -> Column:
    """The five special characters of HTML as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def local_name(name: Column) -> Column:
    """What follows the last slash, hash or colon."""
    return F.regexp_extract(name, r"([^/#:]*)$", 1)


def truncated(value: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis if it was longer."""
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n - 1), F.lit("…"))).otherwise(value)


def salted(value: Column, salt: str) -> Column:
    """Hex SHA-256 of value and salt."""
    return F.sha2(F.concat(value, F.lit(salt)), 256)
