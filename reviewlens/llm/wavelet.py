"""Token-id output as one wavelet matrix per shard file.

A wavelet matrix keeps a sequence of ids as bit planes, from the highest bit to
the lowest; after each plane the sequence is stably parted into zeros and ones.
With rank directories over the planes it gives the id at a place (``access``), how
often an id occurs in a range (``count``) and where (``select``), from one
compressed file and without the sequence itself.

File: header ``<8sQQII`` (magic, ids, documents, planes, block bits), zeros of each
plane (u64), then four kinds of zstd frames, each after its u64 size: document
keys (i64, with a null byte each), document starts (u64), and for each plane its
packed bits and its rank samples (ones before every block, u32).

A shard holds whole documents in ascending key order (null keys first, ties by
text) and about ``SHARD_TOKENS`` ids; a longer document has a shard alone.  Files
are written under a temporary name and renamed, so a retried task replaces its
file by an equal one.  Null texts have the end id only; an empty table gives no
files and no rows.  Keys are whole numbers: others are cast, and one that can't be
is an error.  Repeated rows are documents of their own.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.bpe import character_classes, default_vocabulary, vocabulary
from reviewlens.llm.flat import pieces, ranges, text_buffer
from reviewlens.llm.store import fresh_path, written

MAGIC = b"WAVMTX01"
HEADER = struct.Struct("<8sQQII")
BLOCK = 512
SHARD_TOKENS = 4 << 20
END_ID = 0
#: Partitions of the range sort whose totals are added up together.
GROUP = 1024


class WaveletMatrix:
    """A sequence of unsigned ids as bit planes."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], samples: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.samples = samples if samples is not None else [self._sample(p) for p in planes]

    @staticmethod
    def _sample(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of ``BLOCK`` bits."""
        ones = np.bitwise_count(plane).astype(np.uint32)
        ones = np.concatenate((ones, np.zeros(-len(ones) % (BLOCK // 8), np.uint32))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> "WaveletMatrix":
        levels = levels or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (x & x.dtype.type(1 << level)).astype(np.bool_)
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.flatnonzero(~bit)
            zeros.append(len(low))
            x = np.concatenate((x.take(low), x.take(np.flatnonzero(bit))))
        return cls(len(ids), planes, zeros)

    def ids(self) -> np.ndarray:
        """The whole sequence (uint16 or uint32), plane by plane from the last."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level, (plane, zero) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(np.bool_)
            y = np.empty(self.n, kind)
            y[np.flatnonzero(~bit)] = x[:zero]
            y[np.flatnonzero(bit)] = x[zero:] | kind(1 << level)
            x = y
        return x

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place ``i``."""
        block = i // BLOCK
        a, b = block * BLOCK // 8, i // 8
        plane = self.planes[level]
        n = int(self.samples[level][block]) + int(np.bitwise_count(plane[a:b]).sum())
        return n + (int(plane[b] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for level in range(len(self.planes)):
            ones = self._ones(level, i)
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            one_a, one_b = self._ones(level, a), self._ones(level, b)
            if value >> (len(self.planes) - 1 - level) & 1:
                a, b = self.zeros[level] + one_a, self.zeros[level] + one_b
            else:
                a, b = a - one_a, b - one_b
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of ``value`` at places ``a`` to ``b``."""
        if value >> len(self.planes):
            return 0
        low, high = self._range(value, a, self.n if b is None else b)
        return high - low

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane: binary search in the samples, then in the block."""
        samples = self.samples[level].astype(np.int64)
        if not bit:
            samples = np.arange(len(samples), dtype=np.int64) * BLOCK - samples
        block = int(np.searchsorted(samples, k, "right")) - 1
        at = block * BLOCK
        inside = np.unpackbits(self.planes[level][at // 8 : at // 8 + BLOCK // 8], bitorder="little")
        return at + int(np.flatnonzero(inside == bit)[k - samples[block]])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``; -1 if there are fewer."""
        if value >> len(self.planes) or k < 0 or k >= self.count(value):
            return -1
        i = self._range(value, 0, 0)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            if value >> (len(self.planes) - 1 - level) & 1:
                i = self._select_bit(level, 1, i - self.zeros[level])
            else:
                i = self._select_bit(level, 0, i)
        return i

    def _before(self, level: int) -> np.ndarray:
        """Ones of a plane before each of its bytes, and in all."""
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self.planes[level]), dtype=np.int64)))

    def _ranks(self, level: int, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        """``_ones`` of many places at once."""
        plane = np.append(self.planes[level], np.uint8(0))
        byte = at >> 3
        inside = plane[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return before[byte] + np.bitwise_count(inside)

    def accesses(self, at: np.ndarray) -> np.ndarray:
        """The ids at many places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            ones = self._ranks(level, at, self._before(level))
            bit = self.planes[level][at >> 3] >> (at & 7).astype(np.uint8) & 1
            out = out << 1 | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def counts(self, value: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Occurrences of ``value`` in many ranges."""
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        if value >> len(self.planes):
            return np.zeros(len(a), np.int64)
        for level in range(len(self.planes)):
            before = self._before(level)
            one_a, one_b = self._ranks(level, a, before), self._ranks(level, b, before)
            if value >> (len(self.planes) - 1 - level) & 1:
                a, b = self.zeros[level] + one_a, self.zeros[level] + one_b
            else:
                a, b = a - one_a, b - one_b
        return b - a

    def occurrences(self, value: int) -> list[int]:
        """All places of ``value``."""
        return [self.select(value, k) for k in range(self.count(value))]


class Shard:
    """A wavelet matrix with the keys and starts of its documents."""

    def __init__(self, matrix: WaveletMatrix, keys: list[int | None], starts: np.ndarray):
        self.matrix, self.keys, self.starts = matrix, keys, starts

    def to_bytes(self) -> bytes:
        out, packer = io.BytesIO(), zstandard.ZstdCompressor(level=1)
        m = self.matrix
        out.write(HEADER.pack(MAGIC, m.n, len(self.keys), len(m.planes), BLOCK))
        out.write(np.array(m.zeros, "<u8").tobytes())

        def frame(data: bytes) -> None:
            packed = packer.compress(data)
            out.write(struct.pack("<Q", len(packed)))
            out.write(packed)

        frame(np.array([k or 0 for k in self.keys], "<i8").tobytes() + bytes(k is None for k in self.keys))
        frame(self.starts.astype("<u8").tobytes())
        for plane, samples in zip(m.planes, m.samples, strict=True):
            frame(plane.tobytes())
            frame(samples.astype("<u4").tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Shard":
        magic, n, docs, levels, block = HEADER.unpack_from(data)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a wavelet shard")
        at = HEADER.size
        zeros = np.frombuffer(data, "<u8", levels, at).tolist()
        at += 8 * levels
        unpacker = zstandard.ZstdDecompressor()

        def frame() -> bytes:
            nonlocal at
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8 + size
            return unpacker.decompress(data[at - size : at])

        raw = frame()
        keys = [None if null else k for k, null in zip(np.frombuffer(raw, "<i8", docs).tolist(), raw[8 * docs :], strict=True)]
        starts = np.frombuffer(frame(), "<u8").astype(np.int64)
        planes, samples = [], []
        for _ in range(levels):
            planes.append(np.frombuffer(frame(), np.uint8))
            samples.append(np.frombuffer(frame(), "<u4"))
        return cls(WaveletMatrix(n, planes, zeros, samples), keys, starts)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_shard(uri: str) -> Shard:
    """The shard in a file."""
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        return Shard.from_bytes(f.read())


def write_token_files(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, sort by key and write the shard files.  Returns the manifest: file, part, k, n_docs, n_tokens, base."""
    path = path or default_vocabulary()
    classes = character_classes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, classes)
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, k = TaskContext.get().partitionId(), 0
        held_ids: list[np.ndarray] = []
        held_keys: list[int | None] = []
        held_sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal k, held
            ids, sizes = np.concatenate(held_ids), np.concatenate(held_sizes)
            shard = Shard(WaveletMatrix.build(ids, (vocab.size - 1).bit_length()), held_keys, np.concatenate(([0], np.cumsum(sizes))))
            name = f"part-{part:06d}-{k:05d}.wm"
            passing = f"{root}/.{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(passing) as f:
                f.write(shard.to_bytes())
            fs.move(passing, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "n_docs": [len(sizes)], "n_tokens": [len(ids)]})
            k, held = k + 1, 0
            for x in (held_ids, held_keys, held_sizes):
                x.clear()
            return row

        for batch in pieces(batches, "_text"):
            ids, at = vocab.encode(*text_buffer(batch.column("_text")))
            sizes = np.diff(at) + 1
            flat = np.full(int(sizes.sum()), END_ID, np.uint32)
            flat[ranges(np.cumsum(sizes) - sizes, sizes - 1)] = ids
            if held and held + len(flat) > shard_tokens:
                yield flush()
            held_ids.append(flat)
            held_keys.extend(batch.column("_key").to_pylist())
            held_sizes.append(sizes)
            held += len(flat)
        if held:
            yield flush()

    source = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, "_key").sortWithinPartitions("_key", "_text")
    files = written(ordered.mapInArrow(run, "file string, part int, k int, n_docs long, n_tokens long"), "wavelet-files")
    # ids before each file: added up in groups of partitions, so that no task sees more than GROUP rows of a level and its files
    parts_total = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("g", F.floor(F.col("part") / GROUP))
    group_total = parts_total.groupBy("g").agg(F.sum("n").alias("n"))
    of_group = group_total.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("g_base"))
    of_part = parts_total.select("part", "g", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p_base")).join(of_group, "g")
    of_file = files.select("*", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("f_base"))
    return of_file.join(of_part, "part").select("file", "part", "k", "n_docs", "n_tokens", (F.col("f_base") + F.col("p_base") + F.col("g_base")).alias("base"))


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens, ids_crc32, last_id, n_end_ids and shard file of each document.

    The ids are decoded for the checksum; the last one (the end id) is read by access
    and the end ids in the document's range are counted by rank, without decoding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = read_shard(file)
                view = memoryview(shard.matrix.ids().astype("<u4")).cast("B")
                starts = shard.starts
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                last, ends = shard.matrix.accesses(starts[1:] - 1), shard.matrix.counts(END_ID, starts[:-1], starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64()), pa.array(last), pa.array(ends), pa.array([file] * len(crc))],
                    names=[key, "start", "n_tokens", "ids_crc32", "last_id", "n_end_ids", "file"],
                )

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "base").repartition(parts, "file").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long, last_id long, n_end_ids long, file string")


def token_files(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write the files (into the shared folder unless one is named) and read them back."""
    return read_token_files(write_token_files(docs, folder or fresh_path(docs.sparkSession, "wavelet"), text, key), key)
