"""Pairs of reviewers with common products, counted without moving a row for each pair.

1. Reviewers are numbered in the order of their keys, and each product becomes the
   sorted list of its reviewers' numbers.
2. Reviewers are dealt to ``parts`` by their number.  A product's list goes once to
   every part that has one of its reviewers, many lists in one compressed block, as
   differences.  So what moves is about two bytes for each member of each list sent,
   and no more than one row for each part and batch of products.
3. A part holds the lists of all products of its reviewers, so it has whole rows of
   the pair matrix.  It unrolls, sorts and counts them for some of its reviewers at a
   time (``PAIRS``), which bounds its memory.  Where members are sent many times, the
   parts are dealt in rounds (``ROUND``), which bounds the disk.

Where all pairs are returned, whole rows aren't needed: reviewers are dealt to g groups
by ranges of their numbers and a part is a pair of groups.  It gets the lists' members
and the keys of these two groups only, so each key moves g times, and names are made of
keys where they are needed.  A part is a task, so a file of the result has names of one
group in each of its two columns; groups are made small enough (``NAMES``) that they fit
the dictionary of a Parquet column, and a row then takes a few bytes and not two names.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import stats
from reviewlens.session import stored, unstored

#: Pairs (both ways) of one part, and those that are counted at once.
PART_PAIRS, PAIRS = 16_000_000, 1_000_000
#: Times that a member is dealt in one round of parts, about; the blocks of a round are deleted before the next.
ROUND = 12
#: Most places of a table of tails by two degrees.
TAILS = 4_000_000
#: Bytes of a group's names, each with four for its length, that Parquet's writer keeps in a dictionary; and pairs of a part, on average, for which that is worth its moves.
NAMES, WORTH = 1 << 20, 100_000
#: Members of lists that are dealt to pairs of groups at once, about.
MEMBERS = 1_500_000


@lru_cache(1 << 18)
def _tail(n: int, low: int, high: int, overlap: int, digits: int | None) -> tuple[float, float]:
    """p_value and weight, which is rounded half up as Spark does unless ``digits`` is None."""
    p = stats.overlap_pvalue_of(n, low, high, overlap)
    weight = 300.0 if p <= 0 else min(-float(np.log10(p)), 300.0)
    return p, weight if digits is None else float(Decimal(repr(weight)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2^32 by bytes of like weight, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _packed_all(arrays: list[np.ndarray]) -> bytes:
    packed = [_packed(x) for x in arrays]
    return struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def _unpacked_all(data: bytes, *sizes: int) -> Iterator[np.ndarray]:
    at = 4 * len(sizes)
    for of_bytes, n in zip(struct.unpack_from(f"<{len(sizes)}I", data), sizes, strict=True):
        yield _unpacked(data[at : at + of_bytes], n)
        at += of_bytes


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i]``, ``starts[i] + 1``, ... (``sizes[i]`` of them) for each i."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def numbered(edges: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """key, k (products), name, id: reviewers numbered from 0 in the order of their names."""
    degrees = edges.where("reviewer_hash IS NOT NULL").groupBy(F.col("reviewer_hash").alias("key")).agg(F.count("*").alias("k")).withColumn("name", name(F.col("key")))
    ids = stored(degrees.orderBy("name").withColumn("at", F.monotonically_increasing_id()), "reviewers")
    first, rows = 0, []
    for part, n in sorted(ids.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        rows.append((part, first))
        first += n
    if first >= 1 << 31:
        raise ValueError("more than 2^31 reviewers")
    starts = F.broadcast(ids.sparkSession.createDataFrame(rows, "part long, first long"))
    out = ids.join(starts, F.shiftright("at", 33) == F.col("part")).select("key", "k", "name", (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id"))
    out._stored_path = ids._stored_path
    return out


def _blocks(parts: int, of_parts: range | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of numbers to rows (part, n lists, m members, block), of some of the parts or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            sizes = np.diff(np.asarray(ids.offsets, np.int64))
            flat = np.asarray(ids.flatten(), np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(owner << 32 | flat)
            flat = flat[order]
            starts = np.cumsum(sizes) - sizes
            steps = np.diff(flat, prepend=0)
            steps[starts] = flat[starts]
            of = flat % parts
            by_part = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[by_part], np.arange(parts + 1))
            for part in of_parts or range(parts):
                mine = owner[by_part[bounds[part] : bounds[part + 1]]]
                if not len(mine):
                    continue
                lists = mine[np.concatenate(([True], mine[1:] != mine[:-1]))]
                n, members = sizes[lists], steps[_runs(starts[lists], sizes[lists])]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([len(n)], pa.int64()), "m": pa.array([len(members)], pa.int64()), "block": pa.array([_packed(np.concatenate((n, members)))], pa.binary())})

    return run


def _tiles(groups: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of numbers to rows (part, n lists, m members, block) for each pair of groups, which are ranges of ``width`` numbers.

    The lists of a block are in the order of their first members, which are told as differences.
    """

    def tiles(sizes: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        code = np.sort((flat // width * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)) * width + flat % width)
        code, flat = np.divmod(code, width)
        group, owner = np.divmod(code, len(sizes))
        bounds = np.searchsorted(group, np.arange(groups + 1))
        counts, starts, steps = [], [], []
        for x in range(groups):
            at = slice(bounds[x], bounds[x + 1])
            counts.append(np.bincount(owner[at], minlength=len(sizes)))
            starts.append(np.cumsum(counts[x]) - counts[x])
            new = np.diff(owner[at], prepend=-1) != 0
            steps.append(np.where(new, flat[at], np.diff(flat[at], prepend=0)))
        for i in range(groups):
            lists = np.flatnonzero(counts[i])
            first = steps[i][starts[i][lists]]
            by_first = np.argsort(first, kind="stable")
            lists, first = lists[by_first], first[by_first]
            rows = []
            for j in range(i, groups):
                use = counts[j][lists] > (i == j)
                own = lists[use]
                if len(own):
                    of = [i] if i == j else [i, j]
                    n = [counts[x][own] for x in of]
                    # the first members of the first group are told apart
                    rest = [steps[x][_runs(starts[x][own] + (x == i), k - (x == i))] for x, k in zip(of, n, strict=True)]
                    block = [np.concatenate(n), np.diff(first[use], prepend=0), np.concatenate(rest)]
                    rows.append((i * groups + j - i * (i + 1) // 2, len(own), len(own) + len(block[2]), _packed_all(block)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "n", "m", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, flat, members = [], [], 0
        for batch in batches:
            ids = batch.column(0)
            sizes.append(np.diff(np.asarray(ids.offsets, np.int64)))
            flat.append(np.asarray(ids.flatten(), np.int64))
            members += len(flat[-1])
            if members >= MEMBERS:
                yield from tiles(np.concatenate(sizes), np.concatenate(flat))
                sizes, flat, members = [], [], 0
        if members:
            yield from tiles(np.concatenate(sizes), np.concatenate(flat))

    return run


def _named_by(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of reviewers to one row (grp, block) for each group, their numbers' rest; with a column ``key`` also a list of these."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            of = batch.column(batch.schema.get_field_index("id")).to_numpy() % groups
            for x in np.unique(of).tolist():
                own = batch.take(pa.array(np.flatnonzero(of == x)))
                keys = {c: pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(c)) for c in own.schema.names if c == "key"}
                for named in _named(iter([own.select([c for c in own.schema.names if c != "key"])])):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), named.column(0), *keys.values()], names=["grp", "block", *[f"{c}s" for c in keys]])

    return run


def _tile_rows(alone: bool, blocks: list[tuple[int, int, bytes]], shift: int, degree: np.ndarray, n: int, level: float, digits: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, overlap, p_value, weight) of the significant pairs within a group (``alone``) or between two; members of the second are ``shift`` higher."""
    sides = 1 if alone else 2
    sizes, members = [[] for _ in range(sides)], [[] for _ in range(sides)]
    while blocks:
        count, m, data = blocks.pop()
        counts, first, rest = _unpacked_all(data, sides * count, count, m - count)
        for x, own in enumerate(np.split(counts, sides)):
            starts = np.cumsum(own) - own
            if x:
                steps = rest[-int(own.sum()) :]
            else:
                steps = np.empty(int(own.sum()), np.int64)
                later = np.ones(len(steps), bool)
                later[starts] = False
                steps[starts], steps[later] = np.cumsum(first), rest[: len(steps) - count]
            total = np.cumsum(steps)
            sizes[x].append(own)
            members[x].append((total - np.repeat(total[starts] - steps[starts], own) + x * shift).astype(np.int32))
    sizes, members = [np.concatenate(x) for x in sizes], [np.concatenate(x) for x in members]
    mine = np.arange(len(members[0]))
    if alone:
        begin = mine + 1
        unrolled = np.repeat(np.cumsum(sizes[0]), sizes[0]) - begin
    else:
        begin = np.repeat(np.cumsum(sizes[1]) - sizes[1], sizes[0]) + len(mine)
        unrolled = np.repeat(sizes[1], sizes[0])
    yield from _counted(np.concatenate(members), mine, begin, unrolled, degree, n, level, False, digits)


def _named(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of reviewers to one row each, as a stream of Arrow's."""
    for batch in rows:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _tails(n: int, low: np.ndarray, high: np.ndarray, overlap: np.ndarray, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``_tail`` of each row; equal arguments are computed once."""
    out = np.empty((2, len(low)))
    side = int(max(low.max(), high.max())) + 1
    for x in np.flatnonzero(np.bincount(overlap)).tolist():
        at = np.flatnonzero(overlap == x)
        code = low[at] * side + high[at]
        if side * side <= TAILS and len(at) > 1000:
            there = np.zeros(side * side, bool)
            there[code] = True
            codes = np.flatnonzero(there)
            inverse = np.empty(side * side, np.int64)
            inverse[codes] = np.arange(len(codes))
            inverse = inverse[code]
        else:
            codes, inverse = np.unique(code, return_inverse=True)
        out[:, at] = np.array([_tail(n, c // side, c % side, x, digits) for c in codes.tolist()]).T[:, inverse]
    return out[0], out[1]


def _rows_of(part: int, parts: int, blocks: list[tuple[int, int, bytes]], degree: np.ndarray, n: int, level: float, both: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, overlap, p_value, weight) of the significant pairs of the part's reviewers a, whole rows at a time; only b > a unless ``both``."""
    lists, members, places, n_members = [], [], [], 0
    while blocks:
        count, m, data = blocks.pop()
        numbers = _unpacked(data, count + m)
        sizes, steps = numbers[:count], numbers[count:]
        starts = np.cumsum(sizes) - sizes
        total = np.cumsum(steps)
        lists.append(sizes.astype(np.int32))
        members.append((total - np.repeat(total[starts] - steps[starts], sizes)).astype(np.int32))
        places.append(np.flatnonzero(members[-1] % parts == part) + n_members)
        n_members += m
    if not lists:
        return
    sizes, member, mine = np.concatenate(lists).astype(np.int64), np.concatenate(members), np.concatenate(places)
    del lists, members, places
    starts = np.cumsum(sizes) - sizes
    owner = np.searchsorted(starts, mine, "right") - 1
    # without both ways a row begins behind its reviewer
    begin = starts[owner] if both else mine + 1
    unrolled = starts[owner] + sizes[owner] - begin
    del owner
    yield from _counted(member, mine, begin, unrolled, degree, n, level, both)


def _counted(member: np.ndarray, mine: np.ndarray, begin: np.ndarray, unrolled: np.ndarray, degree: np.ndarray, n: int, level: float, both: bool, digits: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, overlap, p_value, weight) of the significant pairs of the members at ``mine`` with the ``unrolled`` members from ``begin``, whole rows at a time."""
    by_row = np.argsort(member[mine], kind="stable")
    mine, begin, unrolled = mine[by_row], begin[by_row], unrolled[by_row]
    rows = np.flatnonzero(np.diff(member[mine], prepend=-1))
    after = np.concatenate((np.cumsum(unrolled)[rows[1:] - 1], [unrolled.sum()])) if len(rows) else np.zeros(0, np.int64)
    cut = 0
    while cut < len(rows):
        done = after[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(after, done + PAIRS, "right")))
        at = slice(rows[cut], rows[end] if end < len(rows) else len(mine))
        cut = end
        code = np.repeat(member[mine[at]].astype(np.int64) << 32, unrolled[at])
        code |= member[_runs(begin[at], unrolled[at])]
        if both:
            code = code[code >> 32 != code & 0xFFFFFFFF]
        if not len(code):
            continue
        code.sort()
        heads = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        overlap = np.diff(heads, append=len(code))
        code = code[heads]
        a, b = code >> 32, code & 0xFFFFFFFF
        ka, kb = degree[a], degree[b]
        first = a < b
        p, weight = _tails(n, np.where(first, ka, kb), np.where(first, kb, ka), overlap, digits)
        told = np.flatnonzero(p < level)
        yield a[told], b[told], overlap[told], p[told], weight[told]


def _strong(a: np.ndarray, weight: np.ndarray, level: float) -> np.ndarray:
    """Places of the pairs that are significant at a (disparity filter); whole rows, sorted by a."""
    if not len(a):
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    k = np.diff(heads, append=len(a))
    share = weight / np.repeat(np.add.reduceat(weight, heads), k)
    k = np.repeat(k, k)
    return np.flatnonzero(np.where(k <= 1, 0.0, (1 - share) ** (k - 1)) < level)


def pairs(edges: DataFrame, level: float, strong: float | None = None, name: Callable[[Column], Column] = lambda key: key, unique: bool = False, digits: int | None = None) -> DataFrame:
    """a, b (a < b), overlap, p_value, weight of the pairs under ``level``; with ``strong``: a, b, weight of those that the disparity filter keeps at either end.

    edges: reviewer_hash and product_hash of any type that sorts; those with a null meet nothing.
    name: a reviewer's name from its key; a and b are names.
    digits: what weights are rounded to where all pairs are returned; p_value is left out then.
    """
    found, names = numbered_pairs(edges, level, strong, name, unique, digits)
    if strong is None:
        return found
    of = lambda c: names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    out = stored(found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), "weight"), "backbone")
    unstored(found, names)
    return out


def numbered_pairs(edges: DataFrame, level: float, strong: float | None, name: Callable[[Column], Column], unique: bool = False, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``pairs`` and the reviewers (key, k, name, id); with ``strong`` a and b are ids.

    unique: edges are a stored table without repeats, so that no copy of it is made.
    """
    e = edges.select("reviewer_hash", "product_hash") if unique else stored(edges.select("reviewer_hash", "product_hash").distinct(), "edges")
    names = numbered(e, name)
    met = e.where("product_hash IS NOT NULL").join(names.select("key", "id"), F.col("reviewer_hash") == F.col("key"))
    met = met.select("product_hash", "id").repartition("product_hash")
    lists = stored(met.groupBy("product_hash").agg(F.collect_list("id").alias("ids")).select("ids"), "product-lists")
    size = F.size("ids").cast("long")
    n, members, unrolled = lists.agg(F.count("*"), F.sum(size), F.sum(size * size)).first()
    if not unique:
        unstored(e)
    parts = max(1, -(-(unrolled or 0) // PART_PAIRS), edges.sparkSession.sparkContext.defaultParallelism)
    lists_met = lists.where(F.size("ids") > 1)
    if strong is None:
        return _all_pairs(lists_met, names, parts, ((unrolled or 0) - (members or 0)) // 2, n, level, name, digits), names
    told = names.select("id", "k")

    def dealt(some: range) -> DataFrame:
        blocks = lists_met.mapInArrow(_blocks(parts, some), "part int, n long, m long, block binary")
        every = told.mapInArrow(_named, "block binary").select(F.explode(F.sequence(F.lit(some[0]), F.lit(some[-1]))).alias("part"), F.lit(-1).cast("long").alias("n"), F.lit(-1).cast("long").alias("m"), "block")
        return blocks.unionByName(every).repartition(len(some), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = defaultdict(list), defaultdict(list)
        for batch in batches:
            for part, count, m, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if m >= 0:
                    held[part].append((count, m, data))
                else:
                    known[part].append(data)
        if not known:
            return
        # every part has the same reviewers
        tables = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in next(iter(known.values()))])
        known.clear()
        ids = tables.column("id").to_numpy()
        degree = np.zeros(len(ids), np.int64)
        degree[ids] = tables.column("k").to_numpy()
        del tables
        for part in sorted(held):
            for a, b, _, _, weight in _rows_of(part, parts, held.pop(part), degree, n, level, True):
                at = _strong(a, weight, strong)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[at], pa.int32()), pa.array(np.maximum(a, b)[at], pa.int32()), pa.array(weight[at])], names=["a", "b", "weight"])

    rounds = min(parts, max(1, -(-(unrolled or 0) // (ROUND * (members or 1)))))
    bounds = [parts * i // rounds for i in range(rounds + 1)]
    kept = [stored(dealt(range(*x)).mapInArrow(run, "a int, b int, weight double"), "links-of-round") for x in zip(bounds, bounds[1:])]
    unstored(lists)
    found = stored(reduce(DataFrame.union, kept).dropDuplicates(["a", "b"]), "links")
    unstored(*kept)
    return found, names


def _all_pairs(lists: DataFrame, names: DataFrame, parts: int, pairs: int, n: int, level: float, name: Callable[[Column], Column], digits: int | None) -> DataFrame:
    """a, b (names), overlap, p_value (without ``digits``), weight, from parts of two groups each."""
    columns = ["a", "b", "overlap", *(["p_value"] if digits is None else []), "weight"]
    groups, kind = 1, names.schema["name"].dataType.simpleString()
    while groups * (groups + 1) // 2 < parts:
        groups += 1
    reviewers, longest = names.agg(F.count("*"), F.max(F.octet_length("name") if kind in ("string", "binary") else F.lit(8))).first()
    small = -(-reviewers * (4 + (longest or 0)) // NAMES)
    if small > groups and WORTH * small * (small + 1) // 2 <= pairs:
        groups = small
    width = max(1, -(-reviewers // groups))
    blocks = lists.mapInArrow(_tiles(groups, width), "part int, n long, m long, block binary")
    # dealt by their rest, these numbers give ranges of ids
    turned = F.col("id") % width * groups + F.floor(F.col("id") / width).cast("int")
    told = names.select(turned.alias("id"), "k", "key").mapInArrow(_named_by(groups), f"grp int, block binary, keys array<{names.schema['key'].dataType.simpleString()}>")
    low, high = F.least("grp", "other"), F.greatest("grp", "other")
    told = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select((low * groups + high - F.expr("least(grp, other) * (least(grp, other) + 1) div 2")).cast("int").alias("part"), F.col("grp").cast("long").alias("n"), F.lit(-1).cast("long").alias("m"), "block", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for batch in batches:
            *rows, of = batch.columns
            for at, (part, count, m, data) in enumerate(zip(*[c.to_pylist() for c in rows], strict=True)):
                if m >= 0:
                    held[part].append((count, m, data))
                else:
                    known[part][count].append(pa.ipc.open_stream(data).read_all().append_column("name", of[at].values))
        for part in sorted(held):
            sides = [pa.concat_tables(x).sort_by("id") for _, x in sorted(known.pop(part).items())]
            key, degree = [pa.concat_tables(sides).column(c).combine_chunks() for c in ("name", "k")]
            for a, b, overlap, p, weight in _tile_rows(len(sides) == 1, held.pop(part), len(sides[0]), degree.to_numpy(), n, level, digits):
                for c in range(0, len(a), 100_000):
                    x = slice(c, c + 100_000)
                    row = {"a": key.take(pa.array(a[x])), "b": key.take(pa.array(b[x])), "overlap": pa.array(overlap[x], pa.int64()), "p_value": pa.array(p[x]), "weight": pa.array(weight[x])}
                    yield pa.RecordBatch.from_arrays([row[c] for c in columns], names=columns)

    types = {"a": kind, "b": kind, "overlap": "long", "p_value": "double", "weight": "double"}
    dealt = blocks.unionByName(told, allowMissingColumns=True).repartitionById(groups * (groups + 1) // 2, F.col("part"))
    return dealt.select("part", "n", "m", "block", F.transform("keys", name).alias("names")).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns))
