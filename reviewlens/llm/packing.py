"""Best-fit packing by minimum bin slack over the histogram of lengths.

Texts become token pieces of at most ``capacity`` (a longer document is cut; its
first piece takes the remainder).  Only the number of pieces of each length, at
most ``capacity`` numbers, comes to the driver.  There, bin by bin, the largest
piece left is seeded and a bitset subset-sum dynamic programme over the lengths
left finds the combination that leaves least slack; the combination is removed, as
many times at once as the counts allow.  The plan is a list of runs (length, first
rank, copies a bin, bins, first sequence, offset), again bounded by the lengths.
A piece's rank among those of its length comes from counters per partition and
their totals, and the plan maps the rank to its sequence by binary search.

Null texts are empty (one end token), repeated rows and null keys are packed like
any other, an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.bpe import character_classes, default_vocabulary, vocabulary
from reviewlens.llm.flat import pieces as cut
from reviewlens.llm.flat import ranges, text_buffer
from reviewlens.llm.store import drop, written

END_ID = 0
CAPACITY = 2048


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key``, piece, start, length, ids_crc32, and the partition and rank in it that the length has."""
    path = path or default_vocabulary()
    classes = character_classes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, classes)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in cut(batches, "_text"):
            ids, at = vocab.encode(*text_buffer(batch.column("_text")))
            totals = np.diff(at) + 1
            flat = np.full(int(totals.sum()), END_ID, "<u4")
            begin = np.cumsum(totals) - totals
            flat[ranges(begin, totals - 1)] = ids
            n = -(-totals // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = ranges(np.zeros(len(n), np.int64), n)
            short = (totals - (n - 1) * capacity)[row]
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            length = np.where(piece == 0, short, capacity)
            view = memoryview(flat).cast("B")
            where = ((begin[row] + start) * 4).tolist()
            crc = [zlib.crc32(view[a : a + 4 * size]) for a, size in zip(where, length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            local = np.empty(len(length), np.int64)
            local[order] = seen[ordered] + np.arange(len(ordered)) - first
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(local)],
                names=[key, "piece", "start", "length", "ids_crc32", "part", "local"],
            )

    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part int, local long")


def fullest(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """Lengths (with copies) of the fullest bin that holds ``seed``; ``counts`` excludes it.

    Bit ``s`` of the bitset says that some choice of the lengths so far sums to
    ``s``; the bitset before each item is kept to trace the choice back.
    """
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        most, times = min(counts[size], room // size), 1
        while most > 0:  # binary splitting of the copies
            take = min(times, most)
            after = reach | (reach << (take * size)) & mask
            if after != reach:
                steps.append((size, take, reach))
                reach = after
            most -= take
            times *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = {seed: 1}
    for size, take, before in reversed(steps):
        if before >> total & 1:
            continue
        chosen[size] = chosen.get(size, 0) + take
        total -= take * size
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, copies a bin, bins, first sequence, offset), and the number of bins."""
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    runs, bins = [], 0
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = fullest(left, seed, capacity)
        left[seed] += 1
        times = min(left[size] // n for size, n in chosen.items())
        offset = 0
        for size, n in sorted(chosen.items(), reverse=True):
            runs.append((size, used[size], n, times, bins, offset))
            used[size] += n * times
            left[size] -= n * times
            if not left[size]:
                del left[size]
            offset += n * size
        bins += times
    return np.array(sorted(runs), np.int64).reshape(-1, 6), bins


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key``, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    placed = written(token_pieces(docs, capacity, text, key, path), "pieces")
    counts = written(placed.groupBy("part", "length").count(), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "piece-bases")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    drop(counts)
    runs, _ = plan(histogram, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        scale = np.int64(1) << np.int64(44)  # ranks of one length stay far below
        keys = table[:, 0] * scale + table[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column("length"), dtype=np.int64), np.asarray(batch.column("rank"), dtype=np.int64)
            run = table[np.searchsorted(keys, length * scale + rank, "right") - 1]
            within = rank - run[:, 1]
            each = np.maximum(run[:, 2], 1)
            names = [key, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(run[:, 4] + within // each), pa.array(run[:, 5] + within % each * length)], names=[*names, "sequence_id", "offset"]
            )

    ranked = placed.join(bases.hint("merge"), ["part", "length"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    kind = docs.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
