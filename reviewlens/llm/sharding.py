"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name,
and the smallest draw wins: children get rows in proportion to their weights, and
a changed weight moves rows only into or out of that child.  So a change inside a
rack moves rows only in the subtrees whose weights it changes, and a shard that is
added as a region of its own (``grown``) takes rows only into itself.

All of the descent is built-in column expressions (codegen, no shuffle).  Slots,
numbers without gaps in each shard, are dealt by counters per partition whose
totals are then added up; no shard is ever gathered in one task.

Null keys hash like one more key value, null texts have size 1 and crc32 0,
repeated rows each get a slot of their own, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.store import written


@dataclass(frozen=True)
class Node:
    """A shard (no children) or a rack or region; a parent weighs what its children weigh."""

    name: str
    shard: int = -1
    own_weight: float = 1.0
    children: tuple["Node", ...] = ()

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def balanced(shards: int = 16, racks: int = 8, regions: int = 4) -> Node:
    """Equal shards spread over racks and regions."""
    leaves = [Node(f"shard-{s}", s) for s in range(shards)]
    per_rack, per_region = -(-shards // racks), -(-racks // regions)
    level = [Node(f"rack-{i}", children=tuple(leaves[a : a + per_rack])) for i, a in enumerate(range(0, shards, per_rack))]
    level = [Node(f"region-{i}", children=tuple(level[a : a + per_region])) for i, a in enumerate(range(0, len(level), per_region))]
    return Node("root", children=tuple(level))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, numbered next, in a region and rack of its own."""
    new = max(_shards(tree)) + 1
    leaf = Node(f"shard-{new}", new, weight)
    rack = Node(f"rack-of-{new}", children=(leaf,))
    return Node(tree.name, children=(*tree.children, Node(f"region-of-{new}", children=(rack,))))


def _shards(node: Node) -> list[int]:
    return [s for c in node.children for s in _shards(c)] if node.children else [node.shard]


def shard_column(tree: Node, key: Column) -> Column:
    """The shard of each row as a column expression."""
    if not tree.children:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return shard_column(tree.children[0], key)
    # 52 random bits make u in (0, 1); the draw's order is that of an exponential variable
    draws = []
    for child in tree.children:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(child.name), key), 12)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        draws.append((-F.log(u) / F.lit(float(child.weight)), child))
    best = F.least(*[d for d, _ in draws])
    out = None
    for draw, child in draws:
        below = shard_column(child, key)
        out = F.when(draw == best, below) if out is None else out.when(draw == best, below)
    return out


def assign(docs: DataFrame, tree: Node, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row by its key."""
    return docs.withColumn(column, shard_column(tree, F.col(key)))


def number(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with ``slot``: places without gaps in each shard, from 0.

    The rows are written once to the shared folder with their partition and their
    count so far in it, so that a retried task cannot change a number given.
    """
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            shards = np.asarray(batch.column(shard), dtype=np.int64)
            local = np.empty(len(shards), np.int64)
            for s in np.unique(shards).tolist():
                at = np.flatnonzero(shards == s)
                local[at] = seen.get(s, 0) + np.arange(len(at))
                seen[s] = seen.get(s, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shards), part, np.int32)), pa.array(local)], names=[*columns, "__sh_part", "__sh_local"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = written(rows.mapInArrow(run, f"{fields}, __sh_part int, __sh_local long"), "shard-rows")
    counts = placed.groupBy("__sh_part", shard).count()
    before = Window.partitionBy(shard).orderBy("__sh_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition and shard
    base = written(counts.select("__sh_part", shard, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__sh_base")), "shard-bases")
    return placed.join(base.hint("merge"), ["__sh_part", shard]).select(*columns, (F.col("__sh_base") + F.col("__sh_local")).alias(slot))


def write_shards(docs: DataFrame, tree: Node, path: str, key: str = "doc_id") -> None:
    """Write ``docs`` as Parquet with one folder for each shard."""
    assign(docs, tree, key).write.partitionBy("shard").parquet(path)


def placement(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, size, text_crc32, law, shard, slot and grown_shard of every row."""
    tree = balanced(shards)
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_column(tree, F.col(key)).alias("shard"),
        shard_column(grown(tree), F.col(key)).alias("grown_shard"),
    )
    return number(rows).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
