"""Near-dedup by a chosen-path set similarity join over five-word shingles.

Each document's distinct shingles become minwise coordinates.  Documents of the
same set are one class from the start (any number of copies costs one row).  A
tree of the join starts by parting the classes by one coordinate.  Nodes of at most
``LEAF`` classes are compared exhaustively; a larger node branches again by two
coordinates that no node above it has used, chosen by a hash of the node, so similar
sets meet at some leaf of the tree with a probability that depends on their
similarity alone.  A large node is compared exhaustively, too, block by block, where
branching cannot part it (a child keeps ``DENSE`` percent of it), where all but
``BLOCK`` of its classes are connected already, or after ``DEPTH`` levels.
``TREES`` independent trees leave a pair at the threshold unmet with a probability
under 1e-6 (0.15 ** 8 where nodes don't branch).

Work that cannot change the result is left out: classes already connected are not
compared with each other (the first ``FIRST`` trees are evaluated before the
others), a pair is compared in the first tree that surely has it, and texts move
only for classes whose sketch of ``CODES`` one-byte minwise codes agrees with
another's of the same unit as much as a pair at the threshold does with a
probability of 1 - ``MISS``.

Confirmed links: 100 * |A & B| >= ``PERCENT`` * |A | B|, on the full sets of 64-bit
shingle hashes.  A unit returns a spanning forest of its links, which has the same
components.  Components come from the distributed algorithm in ``components``.

Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of under five words has
its whole sequence as one shingle; a null, empty or blank text has an empty set and
links with nothing.  Repeated rows are copies.  A null key never is a component's
id unless all its keys are null.  Joins are merge joins at every size, so that a
small corpus behaves like a large one and the engine can split frequent keys.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.components import components
from reviewlens.llm.flat import Words, mix64, pieces, ranges, seeds, shingle_hashes, text_buffer, whole_groups
from reviewlens.llm.line_dedup import identity
from reviewlens.llm.store import drop, written

PERCENT = 85
TREES = 8
FIRST = 2
#: Coordinates that part nodes; the first ``TREES`` part the roots.
COORDINATES = 24
CODES = 128
MISS = 1e-6
LEAF = 256
BLOCK = 512
DEPTH = 8
DENSE = 75
#: Pairs of sketches, and bytes of text, that are handled at once.
PAIRS = 1 << 17
SLICE = 4 << 20
#: Units of at most so many classes compare pair by pair, larger ones by a matrix.
FEW = 16
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.lru_cache(maxsize=8)
def agreement(percent: int, codes: int = CODES, miss: float = MISS) -> int:
    """Equal codes that a pair at the threshold has with a probability of 1 - ``miss``."""
    p, total = percent / 100, 0.0
    for k in range(codes + 1):
        total += math.comb(codes, k) * p**k * (1 - p) ** (codes - k)
        if total > miss:
            return k
    return codes


def coordinates(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minwise coordinates (uint64) and one-byte codes of sets ``value[at[i]:at[i + 1]]``."""
    n = len(at) - 1
    sig, code = np.full((n, COORDINATES), _EMPTY, np.uint64), np.zeros((n, CODES), np.uint8)
    wide, narrow = seeds(COORDINATES, 21) | np.uint64(1), (seeds(CODES, 22) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    full = np.flatnonzero(np.diff(at) > 0)
    begin = at[:-1][full]
    # so many sets at once that their hashes stay in the cache
    cuts = np.searchsorted(begin, np.arange(0, len(value) + 1, 1 << 15)) if len(full) else np.zeros(0, np.int64)
    cuts = np.unique(np.append(cuts, [0, len(full)]))
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            low = begin[a]
            v = value[low : begin[b] if b < len(full) else len(value)]
            starts, rows = begin[a:b] - low, full[a:b]
            for k in range(COORDINATES):
                sig[rows, k] = np.minimum.reduceat(v * wide[k], starts)
            v = (v >> np.uint64(32)).astype(np.uint32)
            for k in range(CODES):
                least = np.minimum.reduceat(v * narrow[k], starts)
                code[rows, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return sig, code


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id", trees: int = TREES) -> DataFrame:
    """__nd_k, __nd_a, __nd_b (the document), n_shingles, f1, f2 (fingerprint of the set), sig array<long> and sketch binary.

    A sketch has the one-byte codes and 32 bits of each root's coordinate.
    """
    source = identity(docs, text, key, "__nd_").select("__nd_k", "__nd_a", "__nd_b", F.col(text).alias("__nd_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__nd_text"):
            words = Words(*text_buffer(batch.column("__nd_text")), lower=True)
            value, at = shingle_hashes(words)
            n = len(at) - 1
            sig, code = coordinates(value, at)
            full = np.flatnonzero(np.diff(at) > 0)
            f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            with np.errstate(over="ignore"):
                if len(full):
                    f1[full] = np.add.reduceat(mix64(value ^ np.uint64(0x5EED)), at[:-1][full])
                    f2[full] = np.bitwise_xor.reduceat(mix64(value + np.uint64(0xFEED)), at[:-1][full])
                roots = (mix64(sig[:, :trees]) >> np.uint64(32)).astype("<u4")
            sketch = np.concatenate((code, roots.view(np.uint8).reshape(n, 4 * trees)), axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * COORDINATES, pa.int32()), pa.array(sig.ravel().view(np.int64)))
            width = sketch.shape[1]
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sketch))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__nd_k"), batch.column("__nd_a"), batch.column("__nd_b"), pa.array(np.diff(at)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, binary],
                names=["__nd_k", "__nd_a", "__nd_b", "n_shingles", "f1", "f2", "sig", "sketch"],
            )

    kind = source.schema["__nd_k"].dataType.simpleString()
    return source.mapInArrow(run, f"__nd_k {kind}, __nd_a long, __nd_b long, n_shingles long, f1 long, f2 long, sig array<long>, sketch binary")


def linked(value: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Matrix of links between the sets ``value[at[i]:at[i + 1]]``; only shared shingles are multiplied out."""
    n, sizes = len(at) - 1, np.diff(at)
    owners = np.repeat(np.arange(n), sizes)
    both = np.zeros((n, n), np.float64)
    step = max(1, (8 << 20) // max(1, n))
    parts = 1 + (len(value) >> 21)
    for part in range(parts):
        mine = slice(None) if parts == 1 else np.flatnonzero(value % np.uint64(parts) == np.uint64(part))
        v, o = value[mine], owners[mine]
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        fresh = np.ones(len(v), np.bool_)
        fresh[1:] = v[1:] != v[:-1]
        code = np.cumsum(fresh) - 1
        many = np.bincount(code, minlength=1)[code] > 1 if len(v) else np.zeros(0, np.bool_)
        code, o = code[many], o[many]
        if not len(code):
            continue
        dense = np.cumsum(np.concatenate(([0], np.diff(code) != 0)))
        for a in range(0, int(dense[-1]) + 1, step):
            lo, hi = np.searchsorted(dense, [a, a + step])
            m = np.zeros((n, min(step, int(dense[-1]) + 1 - a)), np.float32)
            m[o[lo:hi], dense[lo:hi] - a] = 1
            both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    out = 100 * both >= percent * union
    out[sizes == 0] = False
    out[:, sizes == 0] = False
    np.fill_diagonal(out, False)
    return out


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the graph with these edges."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            above[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


class Unit:
    """Rows of whole units: where each unit begins, classes, components, trees, masks and sketches."""

    def __init__(self, table: pa.Table, trees: int):
        column = lambda name: np.asarray(table[name].combine_chunks())
        unit, c = column("unit"), column("c").astype(np.int64)
        order = np.lexsort((c, unit))
        same = np.zeros(len(order), np.bool_)
        same[1:] = (unit[order][1:] == unit[order][:-1]) & (c[order][1:] == c[order][:-1])
        self.rows = order[~same]
        self.unit, self.c = unit[self.rows], c[self.rows]
        self.comp, self.tree, self.mask = (column(x)[self.rows] for x in ("comp", "tree", "mask"))
        flat, offsets = text_buffer(table["sketch"].combine_chunks())
        sketch = flat.reshape(len(unit), -1)[self.rows] if len(unit) else np.zeros((0, CODES + 4 * trees), np.uint8)
        self.codes = np.ascontiguousarray(sketch[:, :CODES])
        self.roots = np.ascontiguousarray(sketch[:, CODES:]).view("<u4")
        lead = np.ones(len(self.unit), np.bool_)
        lead[1:] = self.unit[1:] != self.unit[:-1]
        self.starts = np.append(np.flatnonzero(lead), len(self.unit))

    def pairs(self, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places p < q within units that are still to be compared, some at a time."""
        n = len(self.unit)
        end = np.repeat(self.starts[1:], np.diff(self.starts))
        count = end - np.arange(n) - 1
        # places in a unit of one component have nothing to compare
        low = np.repeat(np.minimum.reduceat(self.comp, self.starts[:-1]), np.diff(self.starts)) if n else self.comp
        high = np.repeat(np.maximum.reduceat(self.comp, self.starts[:-1]), np.diff(self.starts)) if n else self.comp
        count[low == high] = 0
        total = np.cumsum(count)
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]) if n else 0, PAIRS)), [0, n]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            p = np.repeat(np.arange(a, b), count[a:b])
            q = ranges(np.arange(a, b) + 1, count[a:b])
            apart = self.comp[p] != self.comp[q]
            p, q = p[apart], q[apart]
            if self.mask.any():
                open_ = np.ones(len(p), np.bool_)
                for t in range(self.roots.shape[1]):
                    met = (self.tree[p] > t) & (self.mask[p] >> t & 1 > 0) & (self.roots[p, t] == self.roots[q, t])
                    open_ &= ~met
                p, q = p[open_], q[open_]
            near = np.empty(len(p), np.bool_)
            for i in range(0, len(p), PAIRS):
                near[i : i + PAIRS] = np.count_nonzero(self.codes[p[i : i + PAIRS]] == self.codes[q[i : i + PAIRS]], axis=1) >= need
            yield p[near], q[near]


_MEMBER = "unit long, tree int, c long, comp long, mask int, sketch binary"


def candidates(members: DataFrame, percent: int, trees: int) -> DataFrame:
    """The rows of ``members`` (unit, tree, c, comp, mask, sketch) whose sketch agrees with that of a class of the unit in another component."""
    need = agreement(percent)
    names = ["unit", "tree", "c", "comp", "mask", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", 1 << 20):
            unit = Unit(table, trees)
            hit = np.zeros(len(unit.unit), np.bool_)
            for p, q in unit.pairs(need):
                hit[p] = True
                hit[q] = True
            if hit.any():
                yield from table.select(names).take(pa.array(unit.rows[hit])).combine_chunks().to_batches()

    return members.select(*names).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, _MEMBER)


def confirmed(members: DataFrame, texts: DataFrame, percent: int, trees: int) -> DataFrame:
    """Edges (u, v) of classes that link within a unit, by their full sets.  members: rows of ``candidates``; texts: c, text."""
    need = agreement(percent)

    def settle(part: Unit, value: list[np.ndarray]) -> list[tuple[int, int]]:
        sizes = np.diff(part.starts)
        large = np.repeat(sizes > FEW, sizes)
        edges: list[tuple[int, int]] = []
        for p, q in part.pairs(need):
            for i, j in zip(p[~large[p]].tolist(), q[~large[p]].tolist(), strict=True):
                x = np.concatenate((value[i], value[j]))
                x.sort()
                both = int(np.count_nonzero(x[1:] == x[:-1]))
                if 100 * both >= percent * (len(x) - both) and both:
                    edges.append((i, j))
        edges = forest(edges)
        for a, b in zip(part.starts[:-1][sizes > FEW].tolist(), part.starts[1:][sizes > FEW].tolist(), strict=True):
            links = linked(np.concatenate(value[a:b]), np.cumsum([0, *map(len, value[a:b])]), percent)
            above = np.argwhere(np.triu(links))
            edges.extend(forest([(a + i, a + j) for i, j in above.tolist()]))
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", SLICE):
            part = Unit(table, trees)
            value: list[np.ndarray] = []
            ordered = pa.RecordBatch.from_arrays([table["text"].combine_chunks().take(pa.array(part.rows))], names=["text"])
            for batch in pieces([ordered], "text", SLICE):
                v, at = shingle_hashes(Words(*text_buffer(batch.column("text")), lower=True))
                value += [v[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            edges = np.array(settle(part, value), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(part.c[edges[:, 0]]), pa.array(part.c[edges[:, 1]])], names=["u", "v"])

    joined = members.join(texts.hint("merge"), "c").select("unit", "tree", "c", "comp", "mask", "sketch", "text")
    return joined.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def _branched(large: DataFrame, sigs: DataFrame, leaf: int, block: int, depth: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Units (unit, tree, c) of the large nodes, the roots that are compared whole, and tables to drop in the end.

    large: node, tree, c, comp.  Only nodes of two components or more are looked at.
    """
    spark = large.sparkSession
    rows, units, made, whole_roots = large.withColumn("used", F.lit(0).cast("long")), [], [], None
    for level in range(depth + 1):
        sides = rows.groupBy("node", "comp").agg(F.count("*").alias("m"))
        stats = sides.groupBy("node").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
        stats = stats.select("node", "n", F.col("most.comp").alias("most"), (F.col("n") - F.col("most.m")).alias("others"))
        alive = written(rows.join(stats.hint("merge"), "node"), "nodes-alive")
        made.append(alive)
        if alive.isEmpty():
            break
        settled = (F.col("n") <= leaf) | (F.col("others") <= block)
        kids = None
        if level < depth:
            unused = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda j: F.call_function("shiftright", F.col("used"), j).bitwiseAND(1) == 0)
            chosen = F.slice(F.array_sort(F.transform(unused, lambda j: F.struct(F.xxhash64("node", j).alias("h"), j.alias("j")))), 1, 2)
            parents = alive.where(~settled).select("node", "tree", "c", "comp", "n", "used", chosen.alias("chosen")).join(sigs.hint("merge"), "c")
            one = F.explode(F.transform("chosen", lambda x: F.struct(x["j"].alias("j"), F.xxhash64("node", x["j"], F.get("sig", x["j"])).alias("child"))))
            kids = parents.select("node", "tree", "c", "comp", "n", "used", one.alias("x")).select("node", "tree", "c", "comp", "n", "x.child", F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.j"))).alias("used"))
            kids = written(kids, "nodes-children")
            made.append(kids)
            top = kids.groupBy("node", "child").agg(F.count("*").alias("size"), F.max("n").alias("n")).groupBy("node").agg((100 * F.max("size") >= DENSE * F.max("n")).alias("dense"))
            dense = written(top.where("dense").select("node", "dense"), "nodes-dense")
            made.append(dense)
            alive = alive.join(dense.hint("merge"), "node", "left")
            kids = kids.join(dense.hint("merge"), "node", "left_anti")
            settled = settled | F.coalesce("dense", F.lit(False))
        else:
            settled = F.lit(True)
        whole = alive.where(settled)
        if level == 0:
            whole_roots = written(whole.select("node").distinct(), "roots-whole")
            made.append(whole_roots)
        small = whole.where(F.col("n") <= leaf).select(F.col("node").alias("unit"), "tree", "c")
        wide = whole.where(F.col("n") > leaf)
        ours, theirs = F.ceil(F.col("others") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
        cell = F.xxhash64("node", "i", "j").alias("unit")
        every = wide.withColumn("j", F.pmod(F.xxhash64("c", "node"), theirs).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(ours, F.lit(1)) - 1)))
        other = wide.where(F.col("comp") != F.col("most")).withColumn("i", F.pmod(F.xxhash64("node", "c"), ours).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), theirs - 1)))
        unit = written(small.unionByName(every.select(cell, "tree", "c")).unionByName(other.select(cell, "tree", "c")), "units-large")
        units.append(unit)
        made.append(unit)
        if kids is None:
            break
        rows = kids.select(F.col("child").alias("node"), "tree", "c", "comp", "used")
    out = functools.reduce(DataFrame.unionByName, units) if units else spark.createDataFrame([], "unit long, tree int, c long")
    return out, whole_roots, made


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Sketches (a row for each row of ``docs``), and for each distinct set: n_shingles, f1, f2, comp, component_id (a key)."""
    rows = written(sketches(docs, text, key, trees), "sketches")
    first = F.min(F.struct("__nd_k", "__nd_a", "__nd_b"))
    sets = rows.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(first.alias("rep"), F.min("__nd_k").alias("low_key"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    sets = written(sets.withColumn("c", F.monotonically_increasing_id()), "sets")
    sigs = sets.select("c", "sig")

    # roots of two classes or more
    roots = sigs.select("c", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.col("sig")[t]).alias("node")) for t in range(trees)])).alias("x")).select("x.node", "x.tree", "c")
    shared = roots.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    met = written(roots.join(shared.hint("merge"), "node"), "nodes-met")
    is_large = F.col("size") > leaf
    part = F.xxhash64("node", F.pmod(F.xxhash64("c", "node"), F.ceil(F.col("size") / leaf)))
    units = met.where(~is_large).select(F.col("node").alias("unit"), "tree", "c").unionByName(met.where(is_large & (F.col("tree") < FIRST)).select(part.alias("unit"), "tree", "c"))
    with_sketch = lambda u: u.join(sets.select("c", "sketch").hint("merge"), "c")
    own = F.col("c").alias("comp"), F.lit(0).alias("mask")
    near = written(candidates(with_sketch(units).select("unit", "tree", "c", *own, "sketch"), percent, trees), "near")

    # texts of the classes that may have to be confirmed; hot: they agree with another in what is known so far
    wanted = near.select("c", F.lit(True).alias("hot")).unionByName(met.where(is_large).select("c", F.lit(False).alias("hot"))).groupBy("c").agg(F.max("hot").alias("hot"))
    wanted = written(wanted.join(sets.select("c", "rep").hint("merge"), "c").select("c", "hot", *[F.col(f"rep.{x}").alias(f"{x}r") for x in ("__nd_k", "__nd_a", "__nd_b")]), "classes-wanted")
    bodies = identity(docs, text, key, "__nd_").select("__nd_k", "__nd_a", "__nd_b", F.col(text).alias("text"))
    same = F.col("__nd_k").eqNullSafe(F.col("__nd_kr")) & (F.col("__nd_a") == F.col("__nd_ar")) & (F.col("__nd_b") == F.col("__nd_br"))
    texts = written(bodies.join(wanted.hint("merge"), same).select("c", "hot", "text").dropDuplicates(["c"]), "texts")
    drop(wanted)

    found = written(confirmed(near.where(F.col("tree") < FIRST), texts.where("hot").select("c", "text"), percent, trees), "edges")
    comp = components(found, "c")
    large = met.where(is_large).select("node", "tree", "c").join(comp.hint("merge"), "c", "left").select("node", "tree", "c", F.coalesce("comp", "c").alias("comp"))
    spread, whole_roots, made = _branched(large, sigs, leaf, block, depth)
    # trees whose root has all pairs of its classes compared
    sure = met.where(~is_large).select("tree", "c")
    if whole_roots is not None:
        sure = sure.unionByName(met.where(is_large).join(whole_roots.hint("merge"), "node").select("tree", "c"))
    masks = sure.groupBy("c").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("tree"))).alias("mask"))
    rest = near.where(F.col("tree") >= FIRST).select("unit", "tree", "c", "sketch").unionByName(with_sketch(spread).select("unit", "tree", "c", "sketch"))
    rest = rest.join(comp.hint("merge"), "c", "left").join(masks.hint("merge"), "c", "left")
    again = written(candidates(rest.select("unit", "tree", "c", F.coalesce("comp", "c").alias("comp"), F.coalesce("mask", F.lit(0)).alias("mask"), "sketch"), percent, trees), "near-later")
    drop(near, met, *made)
    later = written(confirmed(again, texts.select("c", "text"), percent, trees), "edges")
    drop(texts, again, comp)
    comp = components(found.unionByName(later), "c")
    drop(found, later)
    labelled = sets.select("n_shingles", "f1", "f2", "c", "low_key").join(comp.hint("merge"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    low = written(labelled.groupBy("comp").agg(F.min("low_key").alias("component_id")), "component-ids")
    out = written(labelled.join(low.hint("merge"), "comp").select("n_shingles", "f1", "f2", "c", "comp", "component_id"), "classes")
    slim = written(rows.drop("sig", "sketch"), "rows-sketched")
    drop(sets, comp, low, rows)
    return slim, out


def _marked(docs: DataFrame, text: str, key: str, percent: int, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """__nd_k, __nd_a, __nd_b, n_shingles, comp (null without shingles), component_id and kept of every row."""
    rows, sets = classes(docs, text, key, percent, trees, leaf, depth, block)
    sets = sets.select(F.col("n_shingles").alias("n2"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), "comp", "component_id")
    out = rows.join(sets.hint("merge"), (F.col("n_shingles") == F.col("n2")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("__nd_k"))
    return out.select("__nd_k", "__nd_a", "__nd_b", "n_shingles", "comp", component.alias("component_id"), component.eqNullSafe(F.col("__nd_k")).alias("kept"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """``key``, n_shingles, component_id and kept of every row."""
    return _marked(docs, text, key, percent, trees, leaf, depth).select(F.col("__nd_k").alias(key), "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its smallest key, in the same columns.

    Rows are told apart by key and text: of equal ones one stays, and of different
    texts of a component under its smallest key the one with the smallest hashes.
    """
    same = ["__nd_k", "__nd_a", "__nd_b"]
    each = written(_marked(docs, text, key, percent).groupBy(*same).agg(F.count("*").alias("n"), F.first("comp").alias("comp"), F.first("kept").alias("kept")), "near-marks")
    first = each.where("kept AND comp IS NOT NULL")
    ties = first.groupBy("comp").agg(F.min(F.struct("__nd_a", "__nd_b")).alias("low"), F.max(F.struct("__nd_a", "__nd_b")).alias("high")).where("low <> high").select("comp", "low")
    later = first.join(ties.hint("merge"), "comp").where(F.struct("__nd_a", "__nd_b") != F.col("low"))
    gone = written(each.where("NOT kept").select(*same).unionByName(later.select(*same)), "copies")
    equal = lambda other: F.col("__nd_k").eqNullSafe(other["__nd_kv"]) & (F.col("__nd_a") == other["__nd_av"]) & (F.col("__nd_b") == other["__nd_bv"])
    named = lambda rows: rows.select(*[F.col(c).alias(f"{c}v") for c in same])
    left = identity(docs, text, key, "__nd_")
    gone = named(gone)
    out = left.join(gone.hint("merge"), equal(gone), "left_anti")
    repeated = written(named(each.where("kept AND n > 1")), "repeated-rows")
    drop(each)
    if not repeated.isEmpty():
        once = out.join(repeated.hint("merge"), equal(repeated), "left_semi").dropDuplicates(same)
        out = out.join(repeated.hint("merge"), equal(repeated), "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
