"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Vectors are centred on the mean, normalised and rotated by a fixed random
orthogonal matrix; a code keeps the signs of the components, packed into 64-bit
words, with two correction scalars: the distance from the mean and the inner
product of the vector with its own code.  A query is rotated, too, and its
components are rounded to ``PLANES`` bits, one bit plane each.  Then the inner
product of query and code is a sum of the popcounts of their bitwise ANDs; divided
by the correction scalar it estimates the inner product of the vectors, and with
high probability bounds the error.

1. Every vector is encoded once.
2. Blocks of codes meet blocks of the stated query set; a block returns, for each
   query, the ``FIRST`` x k vectors with the smallest estimates.
3. The best estimates of all blocks are measured exactly; the k-th smallest distance
   is a limit that the k nearest cannot exceed.
4. The blocks meet again and return all vectors whose lower bound isn't above the
   limit.  Only those are measured exactly, on the original vectors, and ranked.

Blocks bound memory: ``BASE_BLOCK`` codes and ``QUERY_BLOCK`` queries at once; the
vectors themselves move only for what is left to measure.  Vectors that are null,
empty, zero or hold a null or non-finite component take no part; vectors of
different lengths are never compared.  Rows that repeat a vec_id count once (the
shortest, then smallest vector).  Equal distances rank by smaller vec_id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.store import drop, written

BASE_BLOCK = 16384
QUERY_BLOCK = 1024
#: Standard deviations of the estimate that its bounds allow.
EPSILON = 3.0
#: Bits of a code, at least (the length of the vectors, if that is more).
CODE_BITS = 512
#: Bits to which a query's rotated components are rounded.
PLANES = 4
#: Times k: estimates that are measured for the limit.
FIRST = 3
#: Pairs that are estimated at once.
CELLS = 1 << 17


@functools.lru_cache(maxsize=4)
def rotation(dim: int, bits: int = CODE_BITS, seed: int = 7) -> np.ndarray:
    """``dim`` rows of a random orthogonal matrix of ``bits`` (or ``dim``, if more; whole words) columns.

    A vector padded with zeros to that length and rotated: more bits, smaller error.
    """
    bits = -(-max(dim, bits) // 64) * 64
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return np.ascontiguousarray(q.T)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


class Codes:
    """One-bit codes of vectors: words, distance from the mean (norm) and inner product with the own code (own)."""

    def __init__(self, words: np.ndarray, norm: np.ndarray, own: np.ndarray):
        self.words, self.norm, self.own = words, norm, own
        self.bits = words.shape[1] * 64
        self.ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)

    @classmethod
    def of(cls, x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> "Codes":
        shifted = x - mean
        norm = np.sqrt(np.einsum("ij,ij->i", shifted, shifted))
        turned = (shifted / np.where(norm > 0, norm, 1.0)[:, None]) @ turn
        # <code, vector> is the l1 norm over sqrt(bits); of a vector on the mean, 1 (its norm is 0)
        own = np.where(norm > 0, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]), 1.0)
        return cls(_packed(turned > 0), norm, own)

    def bounds(self, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances (queries x codes)."""
        shifted = queries - mean
        q_norm = np.sqrt(np.einsum("ij,ij->i", shifted, shifted))[:, None]
        turned = shifted @ turn
        low = turned.min(axis=1, keepdims=True)
        step = (turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1)
        rounded = np.rint((turned - low) / np.where(step > 0, step, 1.0)).astype(np.uint8)
        total = np.zeros((len(queries), len(self.words)), np.int32)
        for plane in range(PLANES):
            words = _packed(rounded >> plane & 1)
            for w in range(self.words.shape[1]):
                total += np.bitwise_count(words[:, w, None] & self.words[None, :, w]).astype(np.int32) << plane
        inner = (2 * (low * self.ones + step * total) - turned.sum(axis=1, keepdims=True)) / np.sqrt(self.bits) / self.own
        middle = self.norm**2 + q_norm**2 - 2 * self.norm * inner
        spread = np.maximum(0.0, 1 / self.own**2 - 1) / max(1, self.bits - 1)
        error = 2 * epsilon * self.norm * np.sqrt(spread * q_norm**2 + step**2 / 12 / self.own**2) + 1e-9 * (self.norm**2 + q_norm**2)
        return middle - error, middle + error


def chosen(query_ids: np.ndarray, queries: np.ndarray, base_ids: np.ndarray, codes: Codes, mean: np.ndarray, turn: np.ndarray, few: int, limits: np.ndarray | None = None, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, code place and estimate: of the ``few`` smallest estimates of each query or, with limits, of all whose lower bound isn't above the query's limit (a squared distance)."""
    out = []
    step = max(1, CELLS // max(1, len(base_ids)))
    for a in range(0, len(queries), step):
        low, high = codes.bounds(queries[a : a + step], mean, turn, epsilon)
        own = query_ids[a : a + step, None] == base_ids[None, :]
        middle = (low + high) / 2
        if limits is None:
            middle[own] = np.inf
            best = np.argpartition(middle, min(few, len(base_ids)) - 1, axis=1)[:, :few]
            q = np.repeat(np.arange(len(middle)), best.shape[1])
            b = best.ravel()
            there = ~own[q, b]
            q, b = q[there], b[there]
        else:
            q, b = np.nonzero((low <= limits[a : a + step, None]) & ~own)
        out.append((q + a, b, middle[q, b]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _vectors(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def means(base: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the vectors of each length.  A partition gives one row for each component of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                x = _vectors(batch.column("v").take(pa.array(np.flatnonzero(dims == dim))))
                sums[dim] = sums.get(dim, 0) + x.sum(axis=0)
                counts[dim] = counts.get(dim, 0) + len(x)
        for dim, s in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim, pa.int32()), "at": pa.array(range(dim), pa.int32()), "s": s, "n": pa.array([counts[dim]] * dim, pa.int64())})

    rows = base.select("dim", "v").mapInArrow(run, "dim int, at int, s double, n long").groupBy("dim", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():  # as many rows as a vector has components
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["s"] / r["n"]
    return out


def index(base: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """id, dim, code, norm and own of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                codes = Codes.of(_vectors(batch.column("v").take(at)), centre[dim], rotation(dim))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), pa.array(np.full(len(at), dim, np.int32)), pa.array([w.tobytes() for w in codes.words], pa.binary()), pa.array(codes.norm), pa.array(codes.own)], names=["id", "dim", "code", "norm", "own"]
                )

    return base.select("id", "dim", "v").mapInArrow(run, "id long, dim int, code binary, norm double, own double")


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, dim and v (array<double>) of the vectors that take part, one row for each id."""
    x = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    first = x.where(fine).groupBy("id").agg(F.min(F.struct(F.size("v").alias("dim"), "v")).alias("x"))
    return first.select("id", "x.dim", "x.v")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", base_block: int = BASE_BLOCK, query_block: int = QUERY_BLOCK, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest rows of ``vectors``."""
    base, asked = written(valid(vectors, key, vector), "vectors"), written(valid(queries, key, vector), "queries")
    centre = means(base)
    codes = written(index(base, centre), "codes")
    base_parts, query_parts = max(1, -(-base.count() // base_block)), max(1, -(-asked.count() // query_block))
    spread = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    left = codes.select("*", spread(base_parts).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("h"))

    def meet(limited: DataFrame) -> DataFrame:
        """query_id, vec_id, estimate of what the blocks return for queries id, dim, v, limit (null: the smallest estimates)."""
        right = limited.select("*", F.explode(F.sequence(F.lit(0), F.lit(base_parts - 1))).alias("g"), spread(query_parts).alias("h"))

        def block(code_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
            if not len(code_rows) or not len(query_rows):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "estimate": np.zeros(0)})
            dim = int(code_rows["dim"].iloc[0])
            words = np.frombuffer(b"".join(code_rows["code"]), np.uint64).reshape(len(code_rows), -1)
            coded = Codes(words, code_rows["norm"].to_numpy(), code_rows["own"].to_numpy())
            query_ids, base_ids = query_rows["id"].to_numpy(np.int64), code_rows["id"].to_numpy(np.int64)
            limits = query_rows["limit"].to_numpy(float)
            first = np.isnan(limits).all()
            q, b, estimate = chosen(query_ids, np.stack(query_rows["v"].to_numpy()), base_ids, coded, centre.get(dim, np.zeros(dim)), rotation(dim), FIRST * k, None if first else limits, epsilon)
            return pd.DataFrame({"query_id": query_ids[q], "vec_id": base_ids[b], "estimate": estimate})

        return left.groupBy("g", "h", "dim").cogroup(right.groupBy("g", "h", "dim")).applyInPandas(block, "query_id long, vec_id long, estimate double")

    def measured(pairs: DataFrame) -> DataFrame:
        """query_id, vec_id and score of pairs."""
        both = pairs.select("query_id", "vec_id").join(base.select(F.col("id").alias("vec_id"), F.col("v").alias("bv")).hint("merge"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")).hint("merge"), "query_id")
        squared = F.aggregate(F.zip_with("qv", "bv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)
        return both.select("query_id", "vec_id", F.sqrt(squared).alias("score"))

    by = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    best = written(meet(asked.withColumn("limit", F.lit(None).cast("double"))), "best-estimates")
    first = written(measured(best.withColumn("place", by("estimate", "vec_id")).where(F.col("place") <= FIRST * k)), "first-distances")
    limits = first.withColumn("place", by("score", "vec_id")).where(F.col("place") <= k).groupBy("query_id").agg(F.max("score").alias("far"), F.count("*").alias("n"))
    # fewer than k: all there are; a little more than the limit for rounding
    limits = limits.select(F.col("query_id").alias("id"), F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("far") * F.col("far") * (1 + 1e-9)).alias("limit"))
    limited = asked.join(limits.hint("merge"), "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    rest = meet(limited).select("query_id", "vec_id").join(first.select("query_id", "vec_id").hint("merge"), ["query_id", "vec_id"], "left_anti")
    scored = written(first.unionByName(measured(rest)), "distances")
    drop(base, asked, codes, best, first)
    return scored.withColumn("rank", by("score", "vec_id")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
