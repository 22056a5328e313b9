"""Connected components of an edge table by alternating large-star and small-star.

Every half step is two grouped passes over the edges; the minima are written to
the shared folder before they are joined, so that a node with very many edges can
be split by the engine.  Edges stay distributed throughout; only their number and
a checksum reach the driver, to see that nothing changes any more.

A table of at most ``FEW`` edges isn't worth the rounds: one pass of union-find over
it, in bounded memory, gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.store import drop, written


#: Edges that one task solves alone.
FEW = 1 << 20


def _solved(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the smallest of their component, and the smallest, by labels that fall along edges and are shortened."""
    nodes, at = np.unique(np.concatenate((hi, lo)), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    label = np.arange(len(nodes))
    while len(a):
        # the larger of two roots falls to the smallest root that it meets
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label != (short := label[label])).any():
            label = short
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _at_once(edges: DataFrame) -> DataFrame:
    """``edges`` (hi, lo), few, as (hi, lo) with the smallest node of the component as lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("hi").to_numpy(), b.column("lo").to_numpy()) for b in batches]
        if found:
            hi, lo = _solved(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

    return edges.coalesce(1).mapInArrow(run, "hi long, lo long")


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges (hi, lo), hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
    large = written(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "cc-large")
    low = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "cc-low")
    small = large.join(low.hint("merge"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
    out = written(small.distinct(), "cc-edges")
    drop(least, large, low)
    return out


def components(edges: DataFrame, name: str = "id", few: int = FEW) -> DataFrame:
    """(``name``, comp) of every node of ``edges`` (u, v long) that isn't its component's smallest id.

    Loops and repeated edges don't matter; nulls take no part.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
    if pairs.count() <= few:
        now = written(_at_once(pairs), "cc-edges")
        out = now.select(F.col("hi").alias(name), F.col("lo").alias("comp"))
        out._shared_path = now._shared_path
        return out
    now = written(pairs.distinct(), "cc-edges")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1000000007)).first())

    seen = state(now)
    while seen[0]:
        after = _step(now)
        drop(now)
        now, last = after, seen
        seen = state(now)
        if seen == last:
            break
    out = now.select(F.col("hi").alias(name), F.col("lo").alias("comp"))
    out._shared_path = now._shared_path
    return out
