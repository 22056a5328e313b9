"""Exact substring dedup by hash-compared suffix sorting.

Every byte that lies in a ``LENGTH``-byte string which also starts anywhere else
(in the same text too, overlaps count) is removed; strings are judged on the input.

1. Anchors: of each run of 369 consecutive 32-byte grams the one with the smallest
   hash is an anchor, so that two equal 400-byte strings hold equal anchors at equal
   places.  About one byte in 185 is an anchor.
2. Anchors whose gram occurs at one place only are dropped by a pre-aggregated
   grouping; copies of whole texts are one text here (all of a text of 400 bytes or
   more that has a copy is covered).
3. The anchors left carry the up to 368 bytes before and 400 bytes from their start.
   Those with one gram are sorted by what follows and by what precedes: a mergesort
   that compares two suffixes by binary search over prefix polynomial hashes; the
   common extensions of neighbours are then verified byte by byte (a collision sorts
   the batch by bytes instead).
4. An anchor with common extensions L before and R from its start in another place
   covers [start - L, start + R) if L + R >= 400.  The furthest valid R and L are
   those of its neighbours in the two orders, or else come from all of its group.

A gram at over ``GROUP`` places isn't gathered and sorted in one task: 128-bit
hashes of all its windows are counted by a grouping instead, which the engine can
split.  So memory is bounded by ``GROUP`` contexts.

``length`` is a parameter (over ``GRAM`` bytes); the numbers above are for 400.
Null texts are empty; repeated rows are copies of each other; null keys don't
matter, as texts are told apart by content.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.flat import mix64, pieces, ranges, seeds, text_buffer
from reviewlens.llm.store import drop, written

LENGTH = 400
GRAM = 32
GROUP = 16384
#: Contexts that are sorted at once.
BATCH = 6000
#: Groups up to this size compare an unsettled anchor with all others directly.
DIRECT = 64

_BYTE = seeds(256, 31)
_STEP = seeds(8, 32) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def gram_hashes(flat: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes (a power of two) from each place that has them."""
    if len(flat) < gram:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, width, step = _BYTE[flat], 1, 0
        while width < gram:
            h = h[:-width] * _STEP[step] + h[width:]
            h ^= h >> np.uint64(29)
            width, step = width * 2, step + 1
        return mix64(h)


def window_hashes(flat: np.ndarray, width: int, seed: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes from each place that has them, put together from hashes of powers of two."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, power, step = np.full(n, seed, np.uint64), 0, 1, 0
    salt = seeds(40, seed) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = mix64(seeds(256, seed + 1)[flat])
        while power <= width:
            if width & power:
                out = mix64(out * salt[step] + h[at : at + n])
                at += power
            power, step = power * 2, step + 1
            if power <= width:
                half = power // 2
                h = h[:-half] * salt[step + 16] + h[half:]
                h ^= h >> np.uint64(29)
                h *= salt[step + 8]
    return out


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``flat``) and gram hashes of the anchors of texts."""
    window = length - gram + 1
    h = gram_hashes(flat, gram)
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    v = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    low = _slide(v, window, np.minimum)
    # windows that cross the end of a text don't count
    sizes = np.diff(offsets)
    n_bad = np.minimum(length - 1, sizes)
    bad = ranges(offsets[1:] - n_bad, n_bad)
    low[bad[bad < len(low)]] = 0
    padded = np.concatenate((np.zeros(window - 1, np.uint32), low, np.zeros(window - 1, np.uint32)))
    high = _slide(padded, window, np.maximum)
    at = np.flatnonzero(high[: len(v)] == v)
    return at, h[at]


class Strings:
    """Rows of bytes with prefix hashes, compared in logarithmic time."""

    def __init__(self, matrix: np.ndarray, sizes: np.ndarray):
        self.matrix, self.sizes = matrix, sizes
        n, width = matrix.shape
        table = np.zeros((width + 1, n), np.uint64)
        with np.errstate(over="ignore"):
            for t in range(width):
                table[t + 1] = table[t] * _BASE + _BYTE[matrix[:, t]]
        self.table, self.n = table.ravel(), n
        self.steps = int(width).bit_length()

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefixes of rows p and q, by binary search over their hashes."""
        low, high = np.zeros(len(p), np.int64), np.minimum(self.sizes[p], self.sizes[q])
        for _ in range(self.steps):
            mid = (low + high + 1) >> 1
            same = self.table[mid * self.n + p] == self.table[mid * self.n + q]
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def before(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """-1, 0, 1: how rows p sort against rows q."""
        k = self.common(p, q)
        width = self.matrix.shape[1]
        at = np.minimum(k, width - 1)
        a = np.where(k < self.sizes[p], self.matrix[p, at].astype(np.int64), -1)
        b = np.where(k < self.sizes[q], self.matrix[q, at].astype(np.int64), -1)
        return np.sign(a - b)

    def true(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefixes of rows p and q, by their bytes."""
        out = np.empty(len(p), np.int64)
        for i in range(0, len(p), 1 << 14):
            a, b = p[i : i + (1 << 14)], q[i : i + (1 << 14)]
            differ = self.matrix[a] != self.matrix[b]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), self.matrix.shape[1])
            out[i : i + (1 << 14)] = np.minimum(first, np.minimum(self.sizes[a], self.sizes[b]))
        return out

    def verified(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common prefixes by bytes, and whether the hashes had said the same."""
        true = self.true(p, q)
        return true, bool((true == self.common(p, q)).all())

    def order(self, groups: np.ndarray) -> np.ndarray:
        """Rows sorted within their groups (``groups`` has the first row of each, plus the end): a mergesort of all groups at once."""
        n = self.n
        order = np.arange(n)
        size = np.diff(groups)
        group_start = np.repeat(groups[:-1], size)
        group_end = np.repeat(groups[1:], size)
        place = np.arange(n)
        width = 1
        while width < size.max(initial=0):
            at = np.flatnonzero(group_end - group_start > width)
            local = place[at] - group_start[at]
            run = local // width
            left = run % 2 == 0
            pair = group_start[at] + (run // 2) * 2 * width
            lo = np.where(left, pair + width, pair)
            hi = np.where(left, np.minimum(pair + 2 * width, group_end[at]), pair + width)
            lo = np.minimum(lo, group_end[at])
            start = lo.copy()
            mine = order[at]
            # rows of the other run that come before: the first run's go before equal ones of the second
            for _ in range(width.bit_length() + 1):
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                sign = self.before(order[mid], mine[open_])
                ahead = np.where(left[open_], sign < 0, sign <= 0)
                lo[open_] = np.where(ahead, mid + 1, lo[open_])
                hi[open_] = np.where(ahead, hi[open_], mid)
            new = pair + (local - run * width) + (lo - start)
            after = order.copy()
            after[new] = mine
            order = after
            width *= 2
        return order

    def order_by_bytes(self, groups: np.ndarray) -> np.ndarray:
        """The same order without hashes."""
        out = np.empty(self.n, np.int64)
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            out[a:b] = sorted(range(a, b), key=lambda i: self.matrix[i, : self.sizes[i]].tobytes())
        return out

    def neighbours(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order, and the verified common prefix of each place with the one before (0 at a group's start)."""
        order = self.order(groups)
        lead = np.zeros(self.n, np.bool_)
        lead[groups[:-1][np.diff(groups) > 0]] = True
        at = np.flatnonzero(~lead)
        out = np.zeros(self.n, np.int64)
        out[at], fine = self.verified(order[at - 1], order[at])
        if not fine:
            order = self.order_by_bytes(groups)
            out[at], _ = self.verified(order[at - 1], order[at])
        return order, out


def covered(matrix: np.ndarray, before: np.ndarray, after: np.ndarray, groups: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """How far each anchor's covered run reaches before and after its start (0, 0: not covered).

    matrix: bytes around the anchors, which start at column ``length - gram``;
    before/after: bytes that exist; groups: first row of each gram, plus the end.
    """
    mid = length - gram
    right = Strings(np.ascontiguousarray(matrix[:, mid:]), after)
    left = Strings(np.ascontiguousarray(matrix[:, :mid][:, ::-1]), before)
    n = len(matrix)
    best_l, best_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    max_l, max_r = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def credit(p: np.ndarray, q: np.ndarray, ext_l: np.ndarray, ext_r: np.ndarray) -> None:
        np.maximum.at(max_l, p, ext_l)
        np.maximum.at(max_r, p, ext_r)
        fine = ext_l + ext_r >= length
        np.maximum.at(best_l, p[fine], ext_l[fine])
        np.maximum.at(best_r, p[fine], ext_r[fine])

    lead = np.zeros(n, np.bool_)
    lead[groups[:-1][np.diff(groups) > 0]] = True
    inner = np.flatnonzero(~lead)
    for own, other, is_right in ((right, left, True), (left, right, False)):
        order, common = own.neighbours(groups)
        p, q = order[inner - 1], order[inner]
        mine = common[inner]
        theirs, _ = other.verified(p, q)
        pair = (theirs, mine) if is_right else (mine, theirs)
        credit(p, q, *pair)
        credit(q, p, *pair)
    open_ = np.flatnonzero((max_l + max_r >= length) & ((best_l < max_l) | (best_r < max_r)))
    if len(open_):
        g = np.searchsorted(groups, open_, "right") - 1
        size = groups[g + 1] - groups[g]
        few = open_[size <= DIRECT]
        if len(few):
            gs = np.searchsorted(groups, few, "right") - 1
            count = groups[gs + 1] - groups[gs]
            p, q = np.repeat(few, count), ranges(groups[gs], count)
            p, q = p[p != q], q[p != q]
            for a in range(0, len(p), 1 << 17):
                pp, qq = p[a : a + (1 << 17)], q[a : a + (1 << 17)]
                # the hashes sort out, the bytes decide
                maybe = left.common(pp, qq) + right.common(pp, qq) >= length
                pp, qq = pp[maybe], qq[maybe]
                ext_l, ext_r = left.true(pp, qq), right.true(pp, qq)
                fine = ext_l + ext_r >= length
                credit(pp[fine], qq[fine], ext_l[fine], ext_r[fine])
        for a, b in {(int(groups[k]), int(groups[k + 1])) for k, s in zip(g.tolist(), size.tolist(), strict=True) if s > DIRECT}:
            rows = np.arange(a, b)
            unsettled = np.zeros(b - a, np.bool_)
            unsettled[open_[(open_ >= a) & (open_ < b)] - a] = True
            low = int(max(0, length - max_r[a:b].max()))
            high = int(min(mid, max_l[a:b].max()))
            for j in range(low, high + 1):
                ok = (before[a:b] >= j) & (after[a:b] >= length - j)
                r = rows[ok]
                with np.errstate(over="ignore"):
                    key = mix64(left.table[j * n + r] + _BASE) ^ right.table[(length - j) * n + r]
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                hit = np.zeros(len(r), np.bool_)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                x, y = order[:-1][same], order[1:][same]
                if not np.array_equal(matrix[r[x], mid - j : mid - j + length], matrix[r[y], mid - j : mid - j + length]):
                    strings = [row.tobytes() for row in matrix[r, mid - j : mid - j + length]]
                    times = Counter(strings)
                    hit = np.fromiter((times[t] > 1 for t in strings), np.bool_, len(strings))
                hits = r[hit & unsettled[ok]]
                best_l[hits] = np.maximum(best_l[hits], j)
                best_r[hits] = np.maximum(best_r[hits], length - j)
    out = best_l + best_r >= length
    return np.where(out, best_l, 0), np.where(out, best_r, 0)


def _identity(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("*", F.xxhash64(body).alias("__sd_a"), F.xxhash64(F.lit(1), body).alias("__sd_b"))


def covered_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", group: int = GROUP, length: int = LENGTH) -> DataFrame:
    """__sd_a, __sd_b (the text), spans array<struct<s, e>>: covered bytes, not merged."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM} bytes")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = _identity(docs, text).select(F.col(key).alias("k"), F.col("__sd_a").alias("a"), F.col("__sd_b").alias("b"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = source.schema["k"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            flat, offsets = text_buffer(batch.column("body"))
            at, gram = anchors(flat, offsets, length)
            owner = np.searchsorted(offsets, at, "right") - 1
            bounds = pa.array(np.searchsorted(at, offsets), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("a"), batch.column("b"), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(bounds, pa.array((at - offsets[owner]).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(gram.view(np.int64)))],
                names=["k", "a", "b", "n", "pos", "gram"],
            )

    found = written(source.mapInArrow(find, f"k {kind}, a long, b long, n long, pos array<int>, gram array<long>"), "anchors")
    texts = written(found.where(F.col("n") >= length).groupBy("a", "b", "n").agg(F.count("*").alias("copies"), F.min("k").alias("rep")), "texts")
    same = (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & F.col("k").eqNullSafe(F.col("rep"))
    single = found.join(texts.select(F.col("a").alias("ta"), F.col("b").alias("tb"), "rep").hint("merge"), same).select("k", "a", "b", F.explode(F.arrays_zip("pos", "gram")).alias("x"))
    single = written(single.select("k", "a", "b", "x.pos", "x.gram"), "anchor-places")
    place = F.struct("a", "b", "pos")
    grams = single.groupBy("gram").agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("gram", "n")
    grams = written(grams, "grams")
    wanted = single.join(grams.hint("merge"), "gram").groupBy("k", "a", "b").agg(F.collect_set(F.struct("pos", "gram", "n")).alias("x"))
    wanted = written(wanted.select(F.col("k").alias("wk"), F.col("a").alias("wa"), F.col("b").alias("wb"), "x"), "anchors-wanted")
    joined = source.join(wanted.hint("merge"), (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")) & F.col("k").eqNullSafe(F.col("wk"))).select("a", "b", "body", "x.pos", "x.gram", "x.n")
    reach = length - GRAM
    names = ["a", "b", "pos", "gram", "n", "before", "ctx"]

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            flat, offsets = text_buffer(batch.column("body"))
            lists = batch.column("pos")
            count = np.diff(np.asarray(lists.offsets))
            owner = np.repeat(np.arange(len(count)), count)
            pos = np.asarray(lists.flatten(), dtype=np.int64)
            gram, n = (batch.column(c).flatten() for c in ("gram", "n"))
            before = np.minimum(pos, reach)
            size = before + np.minimum(np.diff(offsets)[owner] - pos, length)
            for i in range(0, len(pos), 8192):
                s = slice(i, i + 8192)
                data = flat[ranges(offsets[owner[s]] + pos[s] - before[s], size[s])]
                body = pa.Array.from_buffers(pa.binary(), len(size[s]), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size[s]))).astype(np.int32)), pa.py_buffer(data)])
                rows = pa.array(owner[s])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(rows), batch.column("b").take(rows), pa.array(pos[s].astype(np.int32)), gram[i : i + 8192], n[i : i + 8192], pa.array(before[s].astype(np.int32)), body], names=names
                )

    contexts = written(joined.mapInArrow(context, "a long, b long, pos int, gram long, n long, before int, ctx binary"), "contexts")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(table: pa.Table) -> pa.RecordBatch:
            gram = np.asarray(table["gram"].combine_chunks())
            a, b, pos, before = (np.asarray(table[c].combine_chunks(), dtype=np.int64) for c in ("a", "b", "pos", "before"))
            order = np.lexsort((pos, b, a, gram))
            fresh = np.ones(len(order), np.bool_)
            fresh[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (gram, a, b, pos)])
            order = order[fresh]  # rows that repeat a text repeat its places
            gram, a, b, pos, before = (x[order] for x in (gram, a, b, pos, before))
            flat, offsets = text_buffer(table["ctx"].combine_chunks().take(pa.array(order)))
            size = np.diff(offsets)
            matrix = np.zeros((len(order), reach + length), np.uint8)
            matrix.ravel()[ranges(np.arange(len(order)) * (reach + length) + reach - before, size)] = flat
            groups = np.append(np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))), len(gram))
            ext_l, ext_r = covered(matrix, before, size - before, groups, length)
            hit = np.flatnonzero(ext_r > 0)
            return pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit]), pa.array(pos[hit] - ext_l[hit]), pa.array(pos[hit] + ext_r[hit])], names=["a", "b", "s", "e"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                gram = np.asarray(batch.column("gram"))
                if rows < BATCH:
                    step = min(batch.num_rows, BATCH)
                else:
                    last = held[-1].column("gram")[-1].as_py()
                    other = np.flatnonzero(gram != last)
                    step = int(other[0]) if len(other) else batch.num_rows
                    if not step:
                        yield settle(pa.Table.from_batches(held))
                        held, rows = [], 0
                        continue
                held.append(batch.slice(0, step))
                rows += step
                batch = batch.slice(step)
        if held:
            yield settle(pa.Table.from_batches(held))

    usual = contexts.where(F.col("n") <= group).repartition(parts, "gram").sortWithinPartitions("gram")
    spans = written(usual.mapInArrow(sort, "a long, b long, s long, e long"), "spans")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ctx", 1 << 18):
            flat, offsets = text_buffer(batch.column("ctx"))
            count = np.maximum(np.diff(offsets) - length + 1, 0)
            within = ranges(np.zeros(len(count), np.int64), count)
            row = np.repeat(np.arange(len(count)), count)
            at = offsets[:-1][row] + within
            start = np.asarray(batch.column("pos"), dtype=np.int64) - np.asarray(batch.column("before"), dtype=np.int64)
            x, y = (window_hashes(flat, length, seed)[at].view(np.int64) for seed in (51, 61))
            rows = pa.array(row)
            for i in range(0, len(row), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(rows[cut]), batch.column("b").take(rows[cut]), pa.array((start[row] + within)[cut]), pa.array(x[cut]), pa.array(y[cut])], names=["a", "b", "s", "x", "y"]
                )

    marks = [spans.select("a", "b", "s", "e"), texts.where("copies > 1").select("a", "b", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))]
    crowded = contexts.where(F.col("n") > group)
    passing = []
    if not crowded.isEmpty():
        each = written(crowded.mapInArrow(windows, "a long, b long, s long, x long, y long").distinct(), "windows")
        spot = F.struct("a", "b", "s")
        again = written(each.groupBy("x", "y").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low <> high").select("x", "y"), "windows-repeated")
        passing = [each, again]
        marks.append(each.join(again.hint("merge"), ["x", "y"]).select("a", "b", "s", (F.col("s") + length).alias("e")))
    union = marks[0]
    for m in marks[1:]:
        union = union.unionByName(m)
    out = written(union.groupBy("a", "b").agg(F.collect_set(F.struct("s", "e")).alias("spans")).select(F.col("a").alias("__sd_sa"), F.col("b").alias("__sd_sb"), F.col("spans").alias("__sd_spans")), "covered")
    drop(found, single, grams, wanted, contexts, spans, texts, *passing)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", group: int = GROUP, length: int = LENGTH, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, plus n_bytes, n_removed, n_spans (long) and kept_sha256.

    The digest is of the kept bytes; in ``text`` a character of which only some
    bytes are kept is left out.  The new columns' names begin with ``prefix``; a
    column of ``docs`` that has the name of one of them gives way to it.
    """
    spans = covered_spans(docs, text, key, group, length)
    new_names = [prefix + c for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    columns = [c for c in docs.columns if c.lower() not in {x.lower() for x in new_names}]
    joined = _identity(docs, text).join(spans.hint("merge"), (F.col("__sd_a") == F.col("__sd_sa")) & (F.col("__sd_b") == F.col("__sd_sb")), "left").select(*[F.col(f"`{c}`") for c in columns], "__sd_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            marks = batch.column("__sd_spans")
            source = batch.column(text)
            flat, offsets = text_buffer(source)
            texts = None
            n_removed, n_spans = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            digests = []
            for i in range(batch.num_rows):
                body = flat[offsets[i] : offsets[i + 1]]
                if marks[i].is_valid:
                    pairs = marks[i].values
                    s, e = np.asarray(pairs.field("s")), np.asarray(pairs.field("e"))
                    delta = np.zeros(len(body) + 1, np.int32)
                    np.add.at(delta, s, 1)
                    np.add.at(delta, e, -1)
                    gone = np.cumsum(delta)[:-1] > 0
                    n_removed[i] = np.count_nonzero(gone)
                    n_spans[i] = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) > 0 and gone[0])
                    body = body[~gone]
                    texts = source.to_pylist() if texts is None else texts
                    texts[i] = body.tobytes().decode("utf-8", "ignore")
                digests.append(hashlib.sha256(body.tobytes()).hexdigest())
            new = source if texts is None else pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(new if c == text else batch.column(c) for c in columns), pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed), pa.array(n_spans), pa.array(digests)], names=[*columns, *new_names]
            )

    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(c, T.LongType()) for c in new_names[:3]), T.StructField(new_names[3], T.StringType())])
    return joined.mapInArrow(run, schema)
